"""Check queries for vintage cohorts and seasoning."""

from oracles.base import (
    AS_OF, SEASON, avg, avg_usd, grouped, half_up, pct, pct_int, scaled, sql, usd, whole,
)
from oracles.risk import LOSS, RATE, YEAR


def _month_at(p: float) -> str:
    return half_up(f"quantile_cont(m::DOUBLE, {p})", 1)


def _time_by(key: str) -> str:
    return sql(f"""
    SELECT {key}, count(*) AS default_count, {avg('sum(m)', 'count(*)', 1)} AS avg_months_to_default,
      {_month_at(.5)} AS median_months
    FROM timed WHERE m BETWEEN 0 AND 359 GROUP BY 1""")


_SIZES = "(SELECT vintage_year, count(*) AS total FROM known GROUP BY 1)"

ORACLES = {
    "vintage_performance": sql(f"""
    SELECT {YEAR}, n AS total_loans, {usd('vol')} AS total_volume, {avg_usd('vol', 'n')} AS avg_loan_size,
      bad AS defaults, {RATE} AS default_rate, {usd('loss')} AS total_loss, {LOSS} AS loss_rate,
      lag(n) OVER w AS prev_year_loans, lag({RATE}) OVER w AS prev_year_default_rate
    FROM {grouped('vintage_year')} WINDOW w AS (ORDER BY vintage_year NULLS LAST)"""),
    "vintage_vs_portfolio": sql(f"""
    , p AS (SELECT {pct_int('bad', 'n')} AS pr, {pct_int('loss', 'vol')} AS pl FROM {grouped('')}),
    v AS (SELECT vintage_year, n, {pct_int('bad', 'n')} AS r, {pct_int('loss', 'vol')} AS l FROM {grouped('vintage_year')})
    SELECT {YEAR}, n AS loans, {scaled('r', 2)} AS default_rate, {scaled('l', 2)} AS loss_rate,
      {scaled('pr', 2)} AS portfolio_avg_default, {scaled('pl', 2)} AS portfolio_avg_loss,
      {scaled('r - pr', 2)} AS default_vs_avg, {scaled('l - pl', 2)} AS loss_vs_avg,
      CASE WHEN 5 * r < 4 * pr THEN 'Outperformer' WHEN 5 * r > 6 * pr THEN 'Underperformer'
           ELSE 'Average' END AS vintage_performance
    FROM v, p"""),
    "quarterly_vintage": sql(f"""
    SELECT {YEAR}, {whole('vintage_quarter')} AS vintage_quarter,
      vintage_year::VARCHAR || '-Q' || vintage_quarter::VARCHAR AS cohort, n AS total_loans,
      {usd('vol')} AS total_volume, bad AS defaults, {RATE} AS default_rate,
      lag({RATE}) OVER (PARTITION BY vintage_year ORDER BY vintage_quarter) AS prev_quarter_default_rate
    FROM {grouped('vintage_year, vintage_quarter', '(SELECT * FROM known WHERE vintage_year >= 2015)')}"""),
    "seasoning_distribution": sql(f"""
    SELECT band AS seasoning_bucket, n AS default_count, {pct('n', 'sum(n) OVER ()')} AS pct_of_defaults,
      {avg_usd('vol', 'n')} AS avg_loan_size, {usd('loss')} AS total_loss,
      {avg('ms', 'n', 1)} AS avg_months_to_default
    FROM {grouped(f'{SEASON} AS band', '(SELECT * FROM timed WHERE m >= 0 AND approval_date IS NOT NULL)', ', sum(m) AS ms')}"""),
    "seasoning_by_vintage": sql(f"""
    SELECT {YEAR}, count(*) FILTER (m <= 12) AS year_1_defaults, count(*) FILTER (m BETWEEN 13 AND 24) AS year_2_defaults,
      count(*) FILTER (m BETWEEN 25 AND 36) AS year_3_defaults, count(*) FILTER (m BETWEEN 37 AND 48) AS year_4_defaults,
      count(*) FILTER (m BETWEEN 49 AND 60) AS year_5_defaults, count(*) FILTER (m > 60) AS year_6_plus_defaults,
      count(*) AS total_defaults
    FROM timed t WHERE m >= 0 GROUP BY t.vintage_year"""),
    "time_to_default_stats": sql(f"""
    SELECT 'Time to Default Statistics' AS metric, count(*) AS total_defaults,
      {avg('sum(m)', 'count(*)', 1)} AS avg_months, {_month_at(.25)} AS p25_months,
      {_month_at(.5)} AS median_months, {_month_at(.75)} AS p75_months, {_month_at(.9)} AS p90_months,
      {whole('min(m)')} AS min_months, {whole('max(m)')} AS max_months
    FROM timed WHERE m BETWEEN 0 AND 359 AND approval_date IS NOT NULL"""),
    "ttd_by_size": _time_by("loan_size_bucket"),
    "ttd_by_term": _time_by("term_category"),
    "cumulative_default_by_year": sql(f"""
    , d AS (SELECT vintage_year, year(chargeoff_date) AS y, count(*) AS c, sum(co_c) AS l FROM timed GROUP BY 1, 2)
    SELECT {YEAR}, {whole('y')} AS default_year, {whole('y - vintage_year')} AS years_since_origination,
      total AS total_loans, c AS defaults_in_year, {whole('sum(c) OVER w')} AS cumulative_defaults,
      {pct('sum(c) OVER w', 'total')} AS cumulative_default_rate, {usd('sum(l) OVER w')} AS cumulative_loss
    FROM d JOIN {_SIZES} USING (vintage_year) WHERE vintage_year >= 2005
    WINDOW w AS (PARTITION BY vintage_year ORDER BY y ROWS UNBOUNDED PRECEDING)"""),
    "cumulative_default_curve": sql(f"""
    , d AS (SELECT vintage_year, seasoned AS y, count(*) AS c FROM timed
      WHERE vintage_year BETWEEN 2010 AND 2020 AND seasoned BETWEEN 1 AND 10 GROUP BY 1, 2)
    SELECT {YEAR}, y AS years_seasoned, c AS defaults, {whole('sum(c) OVER w')} AS cumulative_defaults,
      {pct('sum(c) OVER w', 'total')} AS cumulative_default_rate_pct
    FROM d JOIN {_SIZES} USING (vintage_year)
    WINDOW w AS (PARTITION BY vintage_year ORDER BY y ROWS UNBOUNDED PRECEDING)"""),
    "vintage_heatmap": sql(f"""
    , d AS (SELECT vintage_year, """ + ", ".join(f"count(*) FILTER (seasoned = {y}) AS c{y}" for y in range(1, 6)) + f"""
      FROM timed GROUP BY 1)
    SELECT {YEAR}, """ + ", ".join(
        pct(f"coalesce(c{y}, 0)", "total") + f" AS yr{y}_default_rate" for y in range(1, 6)
    ) + f""", total AS total_loans FROM {_SIZES} LEFT JOIN d USING (vintage_year) WHERE vintage_year >= 2005"""),
    "vintage_outcomes": sql(f"""
    SELECT {YEAR}, n AS total_originated, paid AS paid_in_full, bad AS charged_off,
      n - paid - bad AS other_unknown, {pct('paid', 'n')} AS pif_rate, {RATE} AS chargeoff_rate,
      {whole('sum(n) OVER w')} AS cumulative_originated, {whole('sum(bad) OVER w')} AS cumulative_chargeoffs
    FROM {grouped('vintage_year', 'clean')} WINDOW w AS (ORDER BY vintage_year NULLS LAST)"""),
    "survival_curve": sql(f"""
    , e AS (SELECT k.vintage_year, k.bad, t.seasoned FROM known k LEFT JOIN timed t ON t.k = k.k
      WHERE k.vintage_year BETWEEN 2010 AND 2018),
    s AS (SELECT vintage_year, y, count(*) AS total, count(*) FILTER (bad = 0 OR seasoned > y) AS alive
      FROM e, range(11) AS r(y) GROUP BY 1, 2)
    SELECT {YEAR}, y AS years_since_origination, alive AS surviving, total, {pct('alive', 'total')} AS survival_rate_pct
    FROM s"""),
    "economic_periods": sql(f"""
    SELECT period AS economic_period, n AS total_loans, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, bad AS defaults, {RATE} AS default_rate,
      {usd('loss')} AS total_loss, {LOSS} AS loss_rate
    FROM {grouped('''CASE WHEN vintage_year >= 2021 THEN 'Post-COVID' WHEN vintage_year >= 2020 THEN 'COVID Year'
      WHEN vintage_year >= 2010 THEN 'Post-2008 Recovery' WHEN vintage_year >= 2007 THEN 'During 2008 Crisis'
      WHEN vintage_year >= 2005 THEN 'Pre-2008 Crisis' ELSE 'Earlier Vintages' END AS period''')}"""),
    "cohort_summary": sql(f"""
    SELECT {YEAR}, n AS cohort_size, {usd('vol')} AS cohort_volume, {avg_usd('vol', 'n')} AS avg_loan_size,
      bad AS total_defaults, {RATE} AS lifetime_default_rate, {usd('loss')} AS total_chargeoff,
      {LOSS} AS lifetime_loss_rate, {whole(f'year({AS_OF}) - vintage_year')} AS cohort_age_years
    FROM {grouped('vintage_year')}"""),
}
