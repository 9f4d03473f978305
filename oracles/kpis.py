"""Check queries for the portfolio KPIs."""

from oracles.base import (
    AS_OF, GUARANTEE, avg, avg_usd, day, grouped, half_up, pct, sql, usd, whole,
)

RECENT = f"(SELECT * FROM known WHERE approval_date >= {AS_OF} - INTERVAL 60 MONTH)"
FROM_2010 = "(SELECT * FROM known WHERE vintage_year >= 2010)"
SECTORED = "(SELECT * FROM known WHERE industry_sector <> 'Unknown')"
LENDERS = "(SELECT * FROM known WHERE bank_name <> 'Unknown Lender')"


def growth(now: str, before: str) -> str:
    return pct(f"{now} - {before}", before)


def _mix(key: str, average: str, extra: str) -> str:
    return sql(f"""
    SELECT {key}, n AS loan_count, {pct('n', 'sum(n) OVER ()')} AS pct_of_count,
      {usd('vol')} AS total_volume, {pct('vol', 'sum(vol) OVER ()')} AS pct_of_volume,
      {avg_usd('vol', 'n')} AS {average}, {extra}
    FROM {grouped(key)}""")


def _size_where(test: str) -> str:
    return avg_usd(f"sum(gross_c) FILTER ({test})", f"count(*) FILTER ({test})")


ORACLES = {
    "annual_originations": sql(f"""
    , every AS (SELECT approval_fy AS fy, sum(gross_c) AS v FROM clean GROUP BY 1)
    SELECT {whole('approval_fy')} AS fiscal_year, n AS loan_count, {usd('vol')} AS total_approved,
      {usd('cov')} AS total_sba_guaranteed, {avg_usd('vol', 'n')} AS avg_loan_size,
      {growth('vol', 'v')} AS yoy_growth_pct
    FROM {grouped('approval_fy')} LEFT JOIN every ON fy = approval_fy - 1"""),
    "monthly_originations": sql(f"""
    SELECT {day('mon')} AS month, n AS loan_count, {usd('vol')} AS monthly_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size,
      {usd('sum(vol) OVER (ORDER BY mon ROWS 11 PRECEDING)')} AS rolling_12mo_volume
    FROM {grouped('mon', RECENT)}"""),
    "quarterly_originations": sql(f"""
    SELECT {whole('vintage_year')} AS vintage_year, {whole('vintage_quarter')} AS vintage_quarter,
      n AS loan_count, {usd('vol')} AS total_volume, {avg_usd('vol', 'n')} AS avg_loan_size,
      {avg_usd('guars', 'n')} AS avg_guarantee_pct, created + retained AS total_jobs_impacted
    FROM {grouped('vintage_year, vintage_quarter')}"""),
    "loan_size_by_industry": sql(f"""
    SELECT industry_sector, n AS loan_count, {avg_usd('vol', 'n')} AS avg_loan_size,
      {half_up('mid')} AS median_loan_size, {usd('lo')} AS min_loan,
      {usd('hi')} AS max_loan, {usd('vol')} AS total_volume,
      {pct('vol', 'sum(vol) OVER ()')} AS pct_of_portfolio
    FROM {grouped('industry_sector', SECTORED,
                  ', quantile_cont(gross_c::DOUBLE, 0.5) / 100 AS mid, min(gross_c) AS lo, max(gross_c) AS hi')}
    WHERE n >= 100"""),
    "loan_size_by_state": sql(f"""
    SELECT state, place AS state_name, region, n AS loan_count, {avg_usd('vol', 'n')} AS avg_loan_size,
      {usd('vol')} AS total_volume, {pct('n', 'sum(n) OVER ()')} AS pct_of_loans
    FROM {grouped('state')} LEFT JOIN places ON code = state ORDER BY vol DESC, state LIMIT 20"""),
    "size_by_year_business_type": sql(f"""
    SELECT {whole('vintage_year')} AS vintage_year, business_type, n AS loan_count,
      {avg_usd('vol', 'n')} AS avg_loan_size, {avg('terms', 'n', 1)} AS avg_term_months,
      {avg_usd('guars', 'n')} AS avg_guarantee_pct
    FROM {grouped('vintage_year, business_type', FROM_2010)}"""),
    "loan_size_trends": sql(f"""
    SELECT {whole('vintage_year')} AS vintage_year, {avg_usd('sum(gross_c)', 'count(*)')} AS avg_loan_size,
      {_size_where("business_type = 'New'")} AS avg_new_business,
      {_size_where("business_type = 'Existing'")} AS avg_existing_business,
      {_size_where("location_type = 'Urban'")} AS avg_urban,
      {_size_where("location_type = 'Rural'")} AS avg_rural
    FROM known GROUP BY vintage_year"""),
    "yoy_growth": sql(f"""
    SELECT {whole('vintage_year')} AS vintage_year, n AS loan_count, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, n0 AS prev_year_count,
      {growth('n', 'n0')} AS count_growth_pct, {usd('v0')} AS prev_year_volume,
      {growth('vol', 'v0')} AS volume_growth_pct
    FROM (SELECT *, lag(n) OVER w AS n0, lag(vol) OVER w AS v0 FROM {grouped('vintage_year')}
          WINDOW w AS (ORDER BY vintage_year NULLS LAST))"""),
    "segment_cagr": sql(f"""
    , span AS (SELECT min(vintage_year) AS y0, max(vintage_year) AS y1 FROM known),
    s AS (SELECT industry_sector, min(vintage_year) AS a, max(vintage_year) AS b,
        count(DISTINCT vintage_year) AS years,
        coalesce(sum(gross_c) FILTER (vintage_year = (SELECT y0 FROM span)), 0) AS v0,
        coalesce(sum(gross_c) FILTER (vintage_year = (SELECT y1 FROM span)), 0) AS v1
      FROM {SECTORED} GROUP BY 1)
    SELECT industry_sector, {whole('a')} AS start_year, {whole('b')} AS end_year,
      {usd('v0')} AS start_volume, {usd('v1')} AS end_volume, years AS num_years,
      CASE WHEN v1 > 0 THEN {half_up('(pow(v1::DOUBLE / v0::DOUBLE, 1.0::DOUBLE / years) - 1) * 100')} END AS cagr_pct
    FROM s WHERE years > 5 AND v0 > 0"""),
    "mix_by_size": _mix("loan_size_bucket", "avg_in_bucket", f"{avg('terms', 'n', 1)} AS avg_term_months"),
    "mix_by_term": _mix("term_category", "avg_loan_size", f"{avg_usd('guars', 'n')} AS avg_guarantee_pct"),
    "mix_by_business": sql(f"""
    SELECT business_size, business_type, n AS loan_count, {pct('n', 'sum(n) OVER ()')} AS pct_of_total,
      {usd('vol')} AS total_volume, {avg_usd('vol', 'n')} AS avg_loan_size,
      created AS total_jobs_created, retained AS total_jobs_retained
    FROM {grouped('business_size, business_type')}"""),
    "urban_rural_mix": sql(f"""
    SELECT location_type, {whole('vintage_year')} AS vintage_year, n AS loan_count,
      {usd('vol')} AS total_volume, {avg_usd('vol', 'n')} AS avg_loan_size,
      {pct('n', 'sum(n) OVER (PARTITION BY vintage_year)')} AS pct_of_year
    FROM {grouped('location_type, vintage_year', FROM_2010)}"""),
    "guarantee_distribution": sql(f"""
    SELECT band AS guarantee_bucket, n AS loan_count, {pct('n', 'sum(n) OVER ()')} AS pct_of_loans,
      {usd('vol')} AS total_gross, {usd('cov')} AS total_sba_exposure, {avg_usd('vol', 'n')} AS avg_loan_size
    FROM {grouped(f'{GUARANTEE} AS band', '(SELECT * FROM known WHERE gross_c > 0)')}"""),
    "guarantee_by_year": sql(f"""
    SELECT {whole('vintage_year')} AS vintage_year, n AS loan_count, {usd('vol')} AS total_gross_approved,
      {usd('cov')} AS total_sba_guaranteed, {pct('cov', 'vol')} AS portfolio_guarantee_pct,
      {avg_usd('guars', 'n')} AS avg_loan_guarantee_pct
    FROM {grouped('vintage_year')}"""),
    "top_lenders": sql(f"""
    SELECT bank_name, bank_state, n AS loan_count, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, {pct('n', 'sum(n) OVER ()', 4)} AS market_share_count,
      {pct('vol', 'sum(vol) OVER ()', 4)} AS market_share_volume, states AS states_served
    FROM {grouped('bank_name, bank_state', LENDERS, ', count(DISTINCT state) AS states')}
    WHERE n >= 50 ORDER BY vol DESC, 1, 2 LIMIT 25"""),
    "lender_concentration": sql(f"""
    , ranked AS (SELECT vol, row_number() OVER (ORDER BY vol DESC, bank_name) AS r FROM {grouped('bank_name', LENDERS)}),
    part(segment, lo, hi) AS (VALUES ('Top 10 Lenders', 0, 10), ('Top 25 Lenders', 0, 25),
      ('Top 50 Lenders', 0, 50), ('All Other Lenders', 50, 2000000000)),
    s AS (SELECT segment, sum(vol) AS v FROM part LEFT JOIN ranked ON r > lo AND r <= hi GROUP BY 1)
    SELECT segment, {usd('v')} AS segment_volume,
      {pct('v', '(SELECT sum(gross_c) FROM known)')} AS pct_of_portfolio FROM s"""),
    "portfolio_kpi_summary": sql(f"""
    , latest AS (SELECT max(vintage_year) AS y FROM clean),
    t AS (SELECT count(*) FILTER (vintage_year = y) AS n0, sum(gross_c) FILTER (vintage_year = y) AS v0,
        count(*) FILTER (vintage_year = y - 1) AS n1, sum(gross_c) FILTER (vintage_year = y - 1) AS v1
      FROM known, latest)
    SELECT {whole('top')} AS current_year, n AS total_loans, {usd('vol')} AS total_volume,
      {usd('cov')} AS total_sba_exposure, {avg_usd('vol', 'n')} AS avg_loan_size,
      {avg('terms', 'n', 1)} AS avg_term_months, {avg_usd('guars', 'n')} AS avg_guarantee_pct,
      lenders AS active_lenders, states AS states_with_loans, created + retained AS total_jobs_impacted,
      n0 AS ytd_loan_count, {usd('v0')} AS ytd_volume, n1 AS prior_ytd_count,
      {usd('v1')} AS prior_ytd_volume, {growth('v0', 'v1')} AS ytd_vs_prior_pct
    FROM t, {grouped('', extra=', max(vintage_year) AS top, count(DISTINCT bank_name) AS lenders, count(DISTINCT state) AS states')}"""),
}
