"""Check queries for the executive views."""

from oracles.base import (
    AS_OF, avg, avg_usd, day, grouped, pct, pct_int, quotient, scaled, sql, usd, whole,
)
from oracles.kpis import RECENT, growth
from oracles.risk import LOSS, RATE

_WIDE = (
    ", max(vintage_year) AS year1, min(vintage_year) AS year0, count(DISTINCT bank_name) AS lenders,"
    " count(DISTINCT state) AS states, count(DISTINCT industry_sector) AS industries,"
    " min(approval_date) AS day0, max(approval_date) AS day1"
)
_YEAR_CTES = f"""
    , latest AS (SELECT max(vintage_year) AS y FROM clean),
    cy AS {grouped('', '(SELECT * FROM known, latest WHERE vintage_year = y)')},
    py AS {grouped('', '(SELECT * FROM known, latest WHERE vintage_year = y - 1)')}"""


# Names of dimensions.
_DIMENSIONS = {
    "State": "state", "Industry": "industry_sector", "Loan Size": "loan_size_bucket",
    "Business Type": "business_type", "Term Category": "term_category",
    "Location Type": "location_type", "Vintage Year": "vintage_year",
}


def _drill(names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, {column}::VARCHAR AS side, n, bad, vol, loss FROM {grouped(column)}"
        for name, column in _DIMENSIONS.items() if name in names
    )


_MONTHLY = f"""
    , mm AS (SELECT *, lag(n) OVER w AS n1, lag(vol) OVER w AS v1, lag(n, 12) OVER w AS n12,
        lag(vol, 12) OVER w AS v12, sum(n) OVER q AS qn, sum(vol) OVER q AS qv, count(*) OVER q AS qc,
        sum(n) OVER y AS yn, sum(vol) OVER y AS yv, sum(bad) OVER y AS yb
      FROM {grouped('mon', RECENT)}
      WINDOW w AS (ORDER BY mon), q AS (ORDER BY mon ROWS 2 PRECEDING), y AS (ORDER BY mon ROWS 11 PRECEDING))"""

# Names of the lists, and of the views below.
_LISTS = f"""
    , s AS (SELECT state, n, vol, {pct_int('bad', 'n')} AS r, bad::DOUBLE / n AS x FROM {grouped('state')}),
    i AS (SELECT industry_sector, n, vol, {pct_int('bad', 'n')} AS r, bad::DOUBLE / n AS x FROM {grouped('industry_sector')}
          WHERE industry_sector <> 'Unknown'),
    lists AS (
      (SELECT 'Top 10 States by Volume' AS category, state AS entity, {quotient('vol', '100000000', 100)} AS v,
         rank() OVER (ORDER BY vol DESC) AS rank FROM s ORDER BY v DESC, 2 LIMIT 10)
      UNION ALL (SELECT 'Top 10 Industries by Volume', industry_sector, {quotient('vol', '100000000', 100)} AS v,
         rank() OVER (ORDER BY vol DESC) FROM i ORDER BY v DESC, 2 LIMIT 10)
      UNION ALL (SELECT 'Highest Default Rate States', state, r, rank() OVER (ORDER BY x DESC) FROM s
         WHERE n >= 500 ORDER BY r DESC, 2 LIMIT 10)
      UNION ALL (SELECT 'Lowest Default Rate States', state, r, rank() OVER (ORDER BY x) FROM s
         WHERE n >= 500 ORDER BY r, 2 LIMIT 10)
      UNION ALL (SELECT 'Highest Default Rate Industries', industry_sector, r, rank() OVER (ORDER BY x DESC) FROM i
         WHERE n >= 500 ORDER BY r DESC, 2 LIMIT 10))"""

_WATCH = f"""
    , p AS (SELECT {pct_int('bad', 'n')} AS pr FROM {grouped('')}),
    seg AS ({_drill(('State', 'Industry', 'Vintage Year'))}),
    w AS (SELECT *, {pct_int('bad', 'n')} AS r FROM seg
      WHERE dimension = 'Vintage Year' OR (n >= 100 AND (dimension = 'State' OR side <> 'Unknown'))),
    watched AS (SELECT * FROM w, p WHERE 5 * r > 6 * pr)"""


def _top(column: str) -> str:
    return f"(SELECT {column} FROM known GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


ORACLES = {
    "volume_labels": sql("""
    SELECT state, CASE WHEN v >= 1e9 THEN '$' || format('{:,.1f}', v / 1e9) || 'B'
      WHEN v >= 1e6 THEN '$' || format('{:,.1f}', v / 1e6) || 'M' ELSE '$' || format('{:,.0f}', v) END AS volume
    FROM (SELECT state, sum(gross_c)::DOUBLE / 100 AS v FROM known GROUP BY state)"""),
    "executive_summary": sql(f"""{_YEAR_CTES}
    SELECT t.n AS total_loans, {usd('t.vol')} AS total_volume, {usd('t.cov')} AS total_sba_exposure,
      {avg_usd('t.vol', 't.n')} AS avg_loan_size, {avg('t.terms', 't.n', 1)} AS avg_term_months,
      {avg_usd('t.guars', 't.n')} AS avg_guarantee_pct, t.lenders AS active_lenders,
      t.states AS states_with_loans, t.industries AS industries_represented,
      t.created AS total_jobs_created, t.retained AS total_jobs_retained,
      t.created + t.retained AS total_jobs_impacted, t.bad AS total_defaults,
      {usd('t.loss')} AS total_chargeoff, {pct('t.bad', 't.n')} AS default_rate,
      {pct('t.loss', 't.vol')} AS loss_rate, {pct('t.loss', 't.bad_vol')} AS loss_given_default,
      cy.n AS ytd_loans, {usd('cy.vol')} AS ytd_volume, coalesce(cy.bad, 0) AS ytd_defaults,
      {pct('cy.bad', 'cy.n')} AS ytd_default_rate, py.n AS prior_loans, {usd('py.vol')} AS prior_volume,
      {pct('py.bad', 'py.n')} AS prior_default_rate, {growth('cy.vol', 'py.vol')} AS volume_growth_pct,
      {scaled(pct_int('cy.bad', 'cy.n') + ' - ' + pct_int('py.bad', 'py.n'), 2)} AS default_rate_change,
      '2015-09-01 00:00:00' AS as_of_date
    FROM cy, py, {grouped('', extra=_WIDE)} t"""),
    "monthly_trends": sql(f"""{_MONTHLY}
    SELECT {day('mon')} AS month, n AS loans, {usd('vol')} AS volume, {avg_usd('vol', 'n')} AS avg_loan_size,
      bad AS defaults, {usd('loss')} AS chargeoff, n1 AS prev_month_loans,
      {growth('n', 'n1')} AS mom_loan_growth, {usd('v1')} AS prev_month_volume,
      {growth('vol', 'v1')} AS mom_volume_growth, {avg('qn', 'qc')} AS rolling_3mo_avg_loans,
      {avg_usd('qv', 'qc')} AS rolling_3mo_avg_volume, yn::BIGINT AS rolling_12mo_loans,
      {usd('yv')} AS rolling_12mo_volume, yb::BIGINT AS rolling_12mo_defaults,
      {pct('yb', 'yn')} AS rolling_12mo_default_rate, n12 AS same_month_prior_year_loans,
      {usd('v12')} AS same_month_prior_year_volume, {growth('n', 'n12')} AS yoy_loan_growth,
      {growth('vol', 'v12')} AS yoy_volume_growth FROM mm"""),
    "ytd_comparison": sql(f"""
    , latest AS (SELECT max(vintage_year) AS y FROM clean),
    g AS (SELECT vintage_month, y - vintage_year AS back, count(*) AS n, sum(gross_c) AS v
      FROM known, latest WHERE y - vintage_year <= 2 GROUP BY ALL),
    t AS (SELECT vintage_month, """ + ", ".join(
        f"max(n) FILTER (back = {b}) AS n{b}, max(v) FILTER (back = {b}) AS v{b}" for b in range(3)
    ) + f""" FROM g GROUP BY 1)
    SELECT {whole('vintage_month')} AS month, n0 AS cy_loans, {usd('v0')} AS cy_volume, n1 AS py_loans,
      {usd('v1')} AS py_volume, n2 AS py2_loans, {usd('v2')} AS py2_volume,
      {growth('n0', 'n1')} AS yoy_loan_change_pct, {growth('v0', 'v1')} AS yoy_volume_change_pct FROM t"""),
    "dimension_drilldown": sql(f"""
    , d AS ({_drill(_DIMENSIONS)})
    SELECT dimension, side AS dimension_value, n AS loans, {usd('vol')} AS volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, {RATE} AS default_rate, {LOSS} AS loss_rate FROM d"""),
    "top_rankings": sql(f"""
    SELECT 'Top States by Volume' AS ranking_category, state AS entity, {usd('vol')} AS metric_value,
      'volume' AS metric_type, rank() OVER (ORDER BY vol DESC) AS rank
    FROM {grouped('state')} ORDER BY vol DESC, state LIMIT 10"""),
    "comprehensive_rankings": sql(f"""{_LISTS}
    SELECT category, entity, {scaled('v', 2)} AS value_millions, rank FROM lists"""),
    "portfolio_snapshot": sql(f"""
    SELECT 'SBA 7(a) Loan Portfolio' AS portfolio_name, {day(AS_OF)} AS snapshot_date, n AS total_loans,
      {scaled(quotient('vol', '100000000000', 100), 2)} AS total_volume_billions,
      {scaled(quotient('cov', '100000000000', 100), 2)} AS sba_exposure_billions,
      {avg_usd('vol', 'n', 0)} AS avg_loan_size, {avg('terms', 'n', 0)} AS avg_term_months,
      {avg_usd('guars', 'n', 1)} AS avg_guarantee_pct, {_top('loan_size_bucket')} AS most_common_size_bucket,
      {_top('industry_sector')} AS largest_industry, {_top('state')} AS largest_state,
      {RATE} AS default_rate_pct, {scaled(quotient('loss', '100000000', 100), 2)} AS total_chargeoff_millions,
      {pct('loss', 'vol', 3)} AS loss_rate_pct, lenders AS num_lenders, states AS num_states,
      industries AS num_industries, created AS total_jobs_created, retained AS total_jobs_retained,
      {day('day0')} AS earliest_loan, {day('day1')} AS latest_loan, {whole('year0')} AS first_vintage,
      {whole('year1')} AS latest_vintage
    FROM {grouped('', extra=_WIDE)}"""),
    "risk_watchlist": sql(f"""{_WATCH}
    SELECT dimension AS segment_type, side AS segment_value, n AS loans, {usd('vol')} AS volume,
      {scaled('r', 2)} AS default_rate, {scaled('pr', 2)} AS portfolio_avg,
      {scaled('r - pr', 2)} AS vs_portfolio_avg, if(2 * r > 3 * pr, 'HIGH RISK', 'ELEVATED') AS risk_classification
    FROM watched"""),
    "dashboard_counts": sql(f"""{_LISTS}{_WATCH}
    , years AS (SELECT max(vintage_year) AS y FROM clean)
    SELECT 'Executive Summary' AS view_name, 1::BIGINT AS record_count UNION ALL
    SELECT 'Monthly Trends', count(DISTINCT mon) FROM {RECENT} UNION ALL
    SELECT 'YTD Comparison', count(DISTINCT vintage_month) FROM known, years WHERE vintage_year >= y - 2 UNION ALL
    SELECT 'Dimension Drilldown', count(*) FROM ({_drill(_DIMENSIONS)}) UNION ALL
    SELECT 'Top Rankings', least(10, count(DISTINCT state)) FROM known UNION ALL
    SELECT 'Comprehensive Rankings', count(*) FROM lists UNION ALL
    SELECT 'Portfolio Snapshot', 1 UNION ALL
    SELECT 'Risk Watchlist', count(*) FROM watched"""),
}
