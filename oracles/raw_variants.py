"""Check queries for the reports over the typed table.

Fixed values: the labels of periods, sizes and columns.
"""

from oracles.base import (
    JUMBO, SEASON, SIZES, avg, avg_usd, day, half_up, months, pct, pct_int, scaled, sql, steps, usd,
    whole,
)

# Totals of a group of typed loans; NULL amounts stay out.
_SUMS = """count(*) AS n, count(*) FILTER (loan_status = 'CHGOFF') AS bad, sum(gross_c) AS vol,
 count(gross_c) AS sized, sum(co_c) AS loss, sum(gross_c) FILTER (loan_status = 'CHGOFF') AS bad_vol"""
RATE, LOSS = pct("bad", "n"), pct("loss", "vol")
AVERAGE = avg_usd("vol", "sized")


def _raw(keys: str, where: str = "true", source: str = "loans", extra: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return (
        f"(SELECT {lead}{_SUMS}{extra} FROM {source}"
        f" WHERE loan_status IS NOT NULL AND {where}{' GROUP BY ALL' if keys else ''})"
    )


_SIZE = steps("gross_c", SIZES, JUMBO, "<")
_NUMBERED = steps(
    "gross_c", [(edge, f"{i}. {label}") for i, (edge, label) in enumerate(SIZES, 1)], f"5. {JUMBO}", "<"
)

ORACLES = {
    "nb_status": sql(f"""
    SELECT coalesce(loan_status, 'Unknown') AS status, c AS loan_count,
      {pct('c', 'sum(c) OVER ()')} AS pct_of_total, {usd('v')} AS total_volume
    FROM (SELECT loan_status, count(*) AS c, sum(gross_c) AS v FROM loans GROUP BY 1)"""),
    "nb_kpis": sql(f"""
    SELECT n AS total_loans, {usd('vol')} AS total_volume, {usd('cov')} AS total_sba_guaranteed,
      {AVERAGE} AS avg_loan_size, {avg('terms', 'termed', 1)} AS avg_term_months,
      {half_up('share')} AS avg_guarantee_pct, lenders AS unique_lenders,
      states AS states_served, {day('d0')} AS earliest_loan, {day('d1')} AS latest_loan
    FROM {_raw('', extra=''', sum(sba_c) AS cov, sum(term_months) AS terms, count(term_months) AS termed,
      avg(CASE WHEN gross_c > 0 THEN 100.0::DOUBLE * sba_c / gross_c END) AS share,
      count(DISTINCT bank_name) AS lenders, count(DISTINCT state) AS states,
      min(approval_date) AS d0, max(approval_date) AS d1''')}"""),
    "nb_annual": sql(f"""
    SELECT {whole('approval_fy')} AS fiscal_year, n AS loan_count, {usd('vol')} AS total_volume,
      {AVERAGE} AS avg_loan_size FROM {_raw('approval_fy', 'approval_fy >= 1991')}"""),
    "nb_size_mix": sql(f"""
    SELECT band AS loan_size_bucket, n AS loan_count, {usd('vol')} AS total_volume,
      {pct('n', 'sum(n) OVER ()')} AS pct_of_count, {pct('vol', 'sum(vol) OVER ()')} AS pct_of_volume
    FROM {_raw(f'{_SIZE} AS band')}"""),
    "nb_risk": sql(f"""
    SELECT n AS total_loans, bad AS defaulted_loans, n - bad AS paid_in_full, {RATE} AS default_rate_pct,
      {usd('vol')} AS total_exposure, {usd('coalesce(bad_vol, 0)')} AS defaulted_volume,
      {usd('loss')} AS total_chargeoff, {LOSS} AS loss_rate_pct, {pct('loss', 'bad_vol')} AS lgd_pct
    FROM {_raw('')}"""),
    "nb_vintage_risk": sql(f"""
    , y AS (SELECT *, {pct_int('bad', 'n')} AS r FROM {_raw('approval_fy', 'approval_fy >= 1991')})
    SELECT {whole('approval_fy')} AS vintage_year, n AS total_loans, bad AS defaults,
      {scaled('r', 2)} AS default_rate, {usd('loss')} AS total_chargeoff, {LOSS} AS loss_rate,
      ((sum(r) OVER ())::DOUBLE / 100) / count(*) OVER () AS avg_default_rate FROM y"""),
    "nb_industry_risk": sql(f"""
    SELECT sector AS industry, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {usd('vol')} AS total_volume
    FROM {_raw('sector', source='loans JOIN sectors ON code = naics[1:2]')} WHERE n >= 1000"""),
    "nb_size_risk": sql(f"""
    SELECT band AS loan_size_bucket, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {LOSS} AS loss_rate FROM {_raw(f'{_NUMBERED} AS band')}"""),
    "nb_economic_periods": sql(f"""
    SELECT period AS economic_period, n AS total_loans, {usd('vol')} AS total_volume, bad AS defaults,
      {RATE} AS default_rate, {usd('loss')} AS total_chargeoff
    FROM {_raw('''CASE WHEN approval_fy > 2020 THEN '5. Post-COVID' WHEN approval_fy > 2019 THEN '4. COVID Year'
      WHEN approval_fy > 2009 THEN '3. Post-Crisis Recovery' WHEN approval_fy > 2006 THEN '2. During Crisis'
      WHEN approval_fy > 2004 THEN '1. Pre-2008 Crisis' ELSE '0. Earlier Vintages' END AS period''', 'approval_fy >= 1991')}"""),
    "nb_time_to_default": sql(f"""
    , t AS (SELECT {months('coalesce(disbursement_date, approval_date)', 'chargeoff_date')} AS m FROM loans
      WHERE loan_status = 'CHGOFF' AND chargeoff_date IS NOT NULL AND approval_date IS NOT NULL)
    SELECT band AS seasoning_bucket, c AS default_count, {pct('c', 'sum(c) OVER ()')} AS pct_of_defaults
    FROM (SELECT {SEASON} AS band, count(*) AS c FROM t WHERE m >= 0 GROUP BY 1)"""),
    "nb_state_performance": sql(f"""
    SELECT state, place AS state_name, region, n AS total_loans, {usd('vol')} AS total_volume,
      {AVERAGE} AS avg_loan_size, bad AS defaults, {RATE} AS default_rate
    FROM {_raw('state')} LEFT JOIN places ON code = state WHERE n >= 500
    ORDER BY vol DESC NULLS FIRST, state NULLS LAST LIMIT 20"""),
    "nb_state_default_map": sql(f"""
    SELECT state, n AS total_loans, {RATE} AS default_rate
    FROM {_raw('state', 'state IS NOT NULL')} WHERE n >= 100"""),
    "nb_regions": sql(f"""
    SELECT region, n AS total_loans, {usd('vol')} AS total_volume, {AVERAGE} AS avg_loan_size,
      {RATE} AS default_rate
    FROM {_raw('region', source='loans JOIN places ON code = state')}"""),
    "nb_top_bottom_states": sql(f"""
    , s AS (SELECT state, n, {RATE} AS rate FROM {_raw('state')} WHERE n >= 1000)
    (SELECT 'Best (Lowest Default)' AS category, state, n AS total_loans, rate AS default_rate
     FROM s ORDER BY rate, state NULLS LAST LIMIT 5)
    UNION ALL
    (SELECT 'Worst (Highest Default)', state, n, rate FROM s ORDER BY rate DESC, state NULLS LAST LIMIT 5)"""),
    "nb_top_lenders": sql(f"""
    SELECT bank_name, bank_state, n AS total_loans, {usd('vol')} AS total_volume,
      {AVERAGE} AS avg_loan_size, {RATE} AS default_rate
    FROM {_raw('bank_name, bank_state', 'bank_name IS NOT NULL')} WHERE n >= 100
    ORDER BY vol DESC NULLS FIRST, 1, 2 NULLS LAST LIMIT 15"""),
}
