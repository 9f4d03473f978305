"""Check queries for segmentation."""

from oracles.base import (
    avg, avg_usd, day, grouped, pct, pct_int, quotient, scaled, sql, usd,
)
from oracles.kpis import LENDERS, SECTORED
from oracles.risk import LOSS, RATE, YEAR

SERVED = (
    ", count(DISTINCT state) AS states, count(DISTINCT industry_sector) AS industries,"
    " min(approval_date) AS day0, max(approval_date) AS day1"
)
GAP = "((r * count(*) OVER () - sum(r) OVER ())::DOUBLE / 100) / count(*) OVER ()"


def _quartile(p: float) -> str:
    return f"(SELECT round(quantile_cont(r::DOUBLE / 100, {p}), 6) FROM s)"


ORACLES = {
    "state_ranking": sql(f"""
    , s AS (SELECT *, {pct_int('bad', 'n')} AS r FROM {grouped('state')} WHERE n >= 100)
    SELECT state, place AS state_name, region, n AS total_loans, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, {scaled('r', 2)} AS default_rate, {LOSS} AS loss_rate,
      rank() OVER (ORDER BY vol DESC) AS volume_rank, rank() OVER (ORDER BY r) AS best_default_rank,
      rank() OVER (ORDER BY r DESC) AS worst_default_rank, {GAP} AS default_vs_national,
      CASE WHEN {scaled('r', 2)} < {_quartile(.25)} THEN 'Top Quartile'
           WHEN {scaled('r', 2)} < {_quartile(.5)} THEN 'Second Quartile'
           WHEN {scaled('r', 2)} < {_quartile(.75)} THEN 'Third Quartile'
           ELSE 'Bottom Quartile' END AS performance_quartile
    FROM s LEFT JOIN places ON code = state"""),
    "best_worst_states": sql(f"""
    , s AS (SELECT state, n, {RATE} AS rate, {LOSS} AS loss_pct FROM {grouped('state')} WHERE n >= 500),
    r AS (SELECT *, row_number() OVER (ORDER BY rate, state) AS b,
                 row_number() OVER (ORDER BY rate DESC, state) AS w FROM s)
    SELECT 'Top 10 Best' AS category, state, n AS total_loans, rate AS default_rate, loss_pct AS loss_rate, b AS rank
    FROM r WHERE b <= 10 UNION ALL
    SELECT 'Top 10 Worst', state, n, rate, loss_pct, w FROM r WHERE w <= 10"""),
    "regional_performance": sql(f"""
    SELECT region, n AS total_loans, {usd('vol')} AS total_volume, {pct('n', 'sum(n) OVER ()')} AS pct_of_portfolio,
      {avg_usd('vol', 'n')} AS avg_loan_size, bad AS defaults, {RATE} AS default_rate,
      {usd('loss')} AS total_loss, {LOSS} AS loss_rate, states AS states_in_region
    FROM {grouped('region', '(SELECT * FROM known JOIN places ON code = state)', ', count(DISTINCT state) AS states')}"""),
    "industry_performance": sql(f"""
    SELECT industry_sector, n AS total_loans, {usd('vol')} AS total_volume,
      {pct('n', 'sum(n) OVER ()')} AS pct_of_portfolio, {avg_usd('vol', 'n')} AS avg_loan_size,
      bad AS defaults, {RATE} AS default_rate, {usd('loss')} AS total_loss, {LOSS} AS loss_rate,
      rank() OVER (ORDER BY bad::DOUBLE / n) AS risk_rank_best,
      rank() OVER (ORDER BY bad::DOUBLE / n DESC) AS risk_rank_worst
    FROM {grouped('industry_sector', SECTORED)}"""),
    "subsector_vs_sector": sql(f"""
    , i AS (SELECT industry_sector AS name, count(*) AS all_n, sum(bad)::BIGINT AS all_bad FROM known GROUP BY 1)
    SELECT naics_sector, industry_sector, n AS total_loans, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, {avg('terms', 'n', 1)} AS avg_term_months, bad AS defaults,
      {RATE} AS default_rate, {LOSS} AS loss_rate,
      {pct('bad * all_n - all_bad * n', 'n * all_n')} AS vs_sector_avg
    FROM {grouped('naics_sector, industry_sector')} JOIN i ON name = industry_sector
    WHERE n >= 100 ORDER BY vol DESC, naics_sector LIMIT 25"""),
    "industry_concentration": sql(f"""
    , s AS (SELECT industry_sector, vol, {quotient('vol', 'sum(vol) OVER ()', 10000)} AS share FROM {grouped('industry_sector')})
    SELECT industry_sector, {usd('vol')} AS sector_volume, {scaled('share', 2)} AS pct_of_portfolio,
      {scaled('sum(share) OVER (ORDER BY vol DESC)', 2)} AS cumulative_concentration FROM s"""),
    "industry_trend": sql(f"""
    SELECT industry_sector, {YEAR}, n AS loans, {RATE} AS default_rate,
      {pct('bad * n0 - bad0 * n', 'n * n0')} AS yoy_change
    FROM (SELECT *, lag(n) OVER w AS n0, lag(bad) OVER w AS bad0
      FROM {grouped('industry_sector, vintage_year', "(SELECT * FROM known WHERE industry_sector <> 'Unknown' AND vintage_year >= 2010)")}
      WHERE n >= 50 WINDOW w AS (PARTITION BY industry_sector ORDER BY vintage_year))"""),
    "lender_ranking": sql(f"""
    , s AS (SELECT *, {pct_int('bad', 'n')} AS r FROM {grouped('bank_name, bank_state', LENDERS, SERVED)} WHERE n >= 100)
    SELECT bank_name, bank_state, n AS total_loans, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, {scaled('r', 2)} AS default_rate, {LOSS} AS loss_rate,
      states AS states_served, industries AS industries_served,
      rank() OVER (ORDER BY vol DESC) AS volume_rank, rank() OVER (ORDER BY r) AS performance_rank,
      ntile(4) OVER (ORDER BY r, vol DESC, bank_name, bank_state) AS performance_quartile,
      {GAP} AS vs_avg_default_rate
    FROM s ORDER BY vol DESC, bank_name, bank_state LIMIT 50"""),
    "lender_ranks": sql(f"""
    , s AS (SELECT *, {pct_int('bad', 'n')} AS r FROM {grouped('bank_name, bank_state', LENDERS, SERVED)} WHERE n >= 1)
    SELECT bank_name, bank_state, n AS total_loans, {usd('vol')} AS total_volume, {scaled('r', 2)} AS default_rate,
      rank() OVER (ORDER BY vol DESC NULLS LAST) AS volume_rank, rank() OVER (ORDER BY r NULLS LAST) AS performance_rank,
      dense_rank() OVER (ORDER BY r NULLS LAST) AS rate_step,
      ntile(4) OVER (ORDER BY r NULLS LAST, vol DESC NULLS LAST, bank_name, bank_state) AS performance_quartile
    FROM s"""),
    "lender_vs_state": sql(f"""
    , s AS (SELECT bank_name, bank_state, n, {pct_int('bad', 'n')} AS r FROM {grouped('bank_name, bank_state', LENDERS)} WHERE n >= 100),
    h AS (SELECT bank_state, {quotient('sum(r)', 'count(*)', 1)} AS hr FROM s GROUP BY 1 HAVING count(*) >= 3)
    SELECT bank_name, bank_state, n AS total_loans, {scaled('r', 2)} AS default_rate,
      {scaled('hr', 2)} AS state_avg_default_rate, {scaled('r - hr', 2)} AS vs_state_avg,
      CASE WHEN 5 * r < 4 * hr THEN 'Outperforms State' WHEN 5 * r > 6 * hr THEN 'Underperforms State'
           ELSE 'Average for State' END AS state_performance
    FROM s JOIN h USING (bank_state) ORDER BY n DESC, bank_name, bank_state LIMIT 30"""),
    "lender_specialisation": sql(f"""
    , best AS (SELECT bank_name FROM {LENDERS} GROUP BY 1 ORDER BY sum(gross_c) DESC, 1 LIMIT 20),
    s AS (SELECT *, sum(n) OVER (PARTITION BY bank_name) AS book
      FROM {grouped('bank_name, industry_sector', "(SELECT * FROM known WHERE bank_name <> 'Unknown Lender' AND industry_sector <> 'Unknown')")})
    SELECT bank_name, industry_sector, n AS loans_in_industry, {pct('n', 'book')} AS pct_of_lender_portfolio,
      {RATE} AS industry_default_rate, rank() OVER (PARTITION BY bank_name ORDER BY n DESC) AS industry_rank
    FROM s WHERE n >= 20 AND bank_name IN (SELECT bank_name FROM best)"""),
    "state_concentration": sql(f"""
    , s AS (SELECT state, n, vol, {quotient('vol', 'sum(vol) OVER ()', 10000)} AS share,
        {quotient('n', 'sum(n) OVER ()', 10000)} AS n_share,
        (vol::DOUBLE / 100) * 100 / ((sum(vol) OVER ())::DOUBLE / 100) AS x FROM {grouped('state')})
    SELECT state, n AS state_loans, {usd('vol')} AS state_volume, {scaled('n_share', 2)} AS pct_of_loans,
      {scaled('share', 2)} AS pct_of_volume, {scaled('sum(share) OVER (ORDER BY vol DESC)', 2)} AS cumulative_volume_pct,
      x * x AS hhi_contribution FROM s"""),
    "geographic_hhi": sql(f"""
    , s AS (SELECT vol::DOUBLE * 100 / (sum(vol) OVER ())::DOUBLE AS x FROM {grouped('state')}),
    h AS (SELECT sum(x * x) AS hhi, count(*) AS c FROM s)
    SELECT 'Geographic Concentration (HHI)' AS metric, round(hhi, 2) AS hhi_score,
      CASE WHEN hhi >= 2500 THEN 'Highly Concentrated' WHEN hhi >= 1500 THEN 'Moderately Concentrated'
           ELSE 'Unconcentrated' END AS concentration_level, c AS num_states FROM h"""),
    "cross_state_flows": sql(f"""
    SELECT bank_state AS lender_home_state, state AS borrower_state,
      if(bank_state = state, 'In-State', 'Out-of-State') AS lending_type, n AS loan_count,
      {usd('vol')} AS total_volume, {RATE} AS default_rate
    FROM {grouped('bank_state, state')} WHERE n >= 50 ORDER BY n DESC, 1, 2 LIMIT 30"""),
    "in_out_of_state": sql(f"""
    SELECT lending_type, n AS total_loans, {usd('vol')} AS total_volume,
      {pct('n', 'sum(n) OVER ()')} AS pct_of_portfolio, {avg_usd('vol', 'n')} AS avg_loan_size,
      bad AS defaults, {RATE} AS default_rate, {LOSS} AS loss_rate
    FROM {grouped("if(bank_state = state, 'In-State Lending', 'Out-of-State Lending') AS lending_type")}"""),
    "state_industry_matrix": sql(f"""
    SELECT state, industry_sector, n AS loans, {usd('vol')} AS volume, {RATE} AS default_rate,
      rank() OVER (PARTITION BY state ORDER BY n DESC) AS industry_rank_in_state,
      rank() OVER (PARTITION BY industry_sector ORDER BY n DESC) AS state_rank_in_industry
    FROM {grouped('state, industry_sector', SECTORED)} WHERE n >= 50 ORDER BY n DESC, 1, 2 LIMIT 50"""),
    "business_location_size": sql(f"""
    SELECT business_type, location_type, loan_size_bucket, n AS total_loans,
      {avg_usd('vol', 'n')} AS avg_loan_size, {RATE} AS default_rate, {LOSS} AS loss_rate
    FROM {grouped('business_type, location_type, loan_size_bucket')} WHERE n >= 100"""),
    "geographic_summary": sql(f"""
    SELECT state, place AS state_name, region, division, n AS total_loans, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, {RATE} AS default_rate, {LOSS} AS loss_rate,
      created + retained AS total_jobs_impacted
    FROM {grouped('state')} LEFT JOIN places ON code = state"""),
    "industry_summary": sql(f"""
    SELECT naics_sector, industry_sector, n AS total_loans, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, {RATE} AS default_rate, {LOSS} AS loss_rate,
      {avg('terms', 'n', 1)} AS avg_term_months
    FROM {grouped('naics_sector, industry_sector')}"""),
    "lender_summary": sql(f"""
    SELECT bank_name, bank_state, n AS total_loans, {usd('vol')} AS total_volume,
      {avg_usd('vol', 'n')} AS avg_loan_size, {RATE} AS default_rate, {LOSS} AS loss_rate,
      states AS states_served, industries AS industries_served, {day('day0')} AS first_loan_date,
      {day('day1')} AS last_loan_date
    FROM {grouped('bank_name, bank_state', LENDERS, SERVED)}"""),
    "summary_counts": sql(f"""
    SELECT 'Geographic Summary' AS view_name, count(DISTINCT state) AS record_count FROM known UNION ALL
    SELECT 'Industry Summary', count(DISTINCT (naics_sector, industry_sector)) FROM known UNION ALL
    SELECT 'Lender Summary', count(DISTINCT (bank_name, bank_state)) FROM {LENDERS}"""),
}
