"""Check queries for default and loss risk."""

from oracles.base import (
    GUARANTEE, avg, avg_usd, day, grouped, pct, pct_int, quotient, scaled, sql, steps, usd, whole,
)
from oracles.kpis import FROM_2010, LENDERS, SECTORED

YEAR = f"{whole('vintage_year')} AS vintage_year"
RATE, LOSS = pct("bad", "n"), pct("loss", "vol")
SEVERITY = "CASE WHEN sev = 0 THEN 'No Loss (0%)' ELSE " + steps("sev", [
    (2500, "Low (1-24%)"), (5000, "Medium (25-49%)"), (7500, "High (50-74%)"), (10000, "Severe (75-99%)"),
], "Total Loss (100%)", "<") + " END"

ORACLES = {
    "portfolio_default": sql(f"""
    SELECT 'Portfolio Default Summary' AS metric, n AS total_loans, bad AS defaulted_loans,
      paid AS paid_in_full, {RATE} AS default_rate_pct, {usd('vol')} AS total_approved_volume,
      {usd('bad_vol')} AS defaulted_volume, {pct('bad_vol', 'vol')} AS default_rate_by_volume_pct
    FROM {grouped('')}"""),
    "default_by_vintage": sql(f"""
    SELECT {YEAR}, n AS total_loans, bad AS defaults, {RATE} AS default_rate_pct,
      {usd('vol')} AS total_volume, {usd('loss')} AS total_chargeoff, {LOSS} AS loss_rate_pct
    FROM {grouped('vintage_year')}"""),
    "monthly_default_trend": sql(f"""
    SELECT {day('mon')} AS month, n AS total_loans, bad AS defaults, {RATE} AS monthly_default_rate,
      n12::BIGINT AS rolling_12mo_loans, b12::BIGINT AS rolling_12mo_defaults,
      {pct('b12', 'n12')} AS rolling_12mo_default_rate
    FROM (SELECT *, sum(n) OVER w AS n12, sum(bad) OVER w AS b12
      FROM {grouped('mon', "(SELECT * FROM known WHERE approval_date >= DATE '2010-01-01')")}
      WINDOW w AS (ORDER BY mon ROWS 11 PRECEDING))"""),
    "chargeoff_by_year": sql(f"""
    SELECT {YEAR}, bad AS defaulted_loans, {usd('loss')} AS gross_chargeoff,
      {avg_usd('bad_loss', 'bad')} AS avg_chargeoff_per_default,
      {usd('bad_cov')} AS sba_exposure_on_defaults, {usd('bad_vol')} AS gross_exposure_on_defaults
    FROM {grouped('vintage_year')}"""),
    "chargeoff_by_industry": sql(f"""
    SELECT industry_sector, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {usd('loss')} AS total_chargeoff, {avg_usd('bad_loss', 'bad')} AS avg_chargeoff,
      {usd('vol')} AS total_exposure, {LOSS} AS loss_rate_pct
    FROM {grouped('industry_sector', SECTORED)} WHERE n >= 100"""),
    "chargeoff_by_size": sql(f"""
    SELECT loan_size_bucket, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {usd('loss')} AS total_chargeoff, {avg_usd('bad_loss', 'bad')} AS avg_chargeoff,
      {LOSS} AS loss_rate_pct
    FROM {grouped('loan_size_bucket')}"""),
    "lgd_overall": sql(f"""
    SELECT 'Loss Given Default Analysis' AS metric, bad AS defaulted_loans,
      {usd('bad_vol')} AS defaulted_exposure, {usd('loss')} AS total_loss,
      {pct('loss', 'bad_vol')} AS lgd_pct, {avg_usd('bad_sev', 'bad')} AS avg_loss_severity_pct
    FROM {grouped('')}"""),
    "lgd_by_vintage": sql(f"""
    SELECT {YEAR}, bad AS defaults, {usd('bad_vol')} AS exposure_at_default,
      {usd('loss')} AS actual_loss, {pct('loss', 'bad_vol')} AS lgd_pct,
      {pct('bad_vol - loss', 'bad_vol')} AS recovery_rate_pct
    FROM {grouped('vintage_year')}"""),
    "severity_distribution": sql(f"""
    SELECT band AS loss_severity_bucket, n AS default_count, {pct('n', 'sum(n) OVER ()')} AS pct_of_defaults,
      {usd('loss')} AS total_loss, {avg_usd('bad_sev', 'n')} AS avg_severity_in_bucket
    FROM {grouped(f'{SEVERITY} AS band', '(SELECT * FROM clean WHERE bad = 1)')}"""),
    "risk_matrix": sql(f"""
    SELECT industry_sector, loan_size_bucket, n AS total_loans, bad AS defaults,
      {RATE} AS default_rate, {LOSS} AS loss_rate,
      rank() OVER (PARTITION BY industry_sector ORDER BY bad::DOUBLE / n DESC) AS risk_rank_in_industry
    FROM {grouped('industry_sector, loan_size_bucket', SECTORED)} WHERE n >= 50"""),
    "geographic_risk": sql(f"""
    , s AS (SELECT *, {pct_int('bad', 'n')} AS r FROM {grouped('state')} WHERE n >= 100)
    SELECT state, region, n AS total_loans, bad AS defaults, {scaled('r', 2)} AS default_rate,
      {LOSS} AS loss_rate,
      ((r * count(*) OVER () - sum(r) OVER ())::DOUBLE / 100) / count(*) OVER () AS vs_portfolio_avg,
      rank() OVER (PARTITION BY region ORDER BY r DESC) AS rank_in_region,
      rank() OVER (ORDER BY r DESC) AS national_rank
    FROM s LEFT JOIN places ON code = state"""),
    "risk_new_vs_existing": sql(f"""
    SELECT business_type, {YEAR}, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {avg_usd('vol', 'n')} AS avg_loan_size, {avg_usd('bad_sev', 'bad')} AS avg_lgd
    FROM {grouped('business_type, vintage_year', FROM_2010)}"""),
    "risk_by_term": sql(f"""
    SELECT term_category, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {usd('vol')} AS total_volume, {usd('loss')} AS total_loss, {LOSS} AS loss_rate,
      {avg('bad_terms', 'bad', 1)} AS avg_term_of_defaults
    FROM {grouped('term_category')}"""),
    "sba_loss_by_vintage": sql(f"""
    SELECT {YEAR}, bad AS defaults, {usd('bad_cov')} AS sba_guaranteed_on_defaults,
      {usd('loss')} AS total_chargeoff, {scaled(quotient('a', '10000', 1), 2)} AS estimated_sba_loss,
      {scaled(quotient('b', '10000', 1), 2)} AS estimated_lender_loss
    FROM {grouped('vintage_year', extra=', sum(bad * co_c::HUGEINT * guar) AS a, sum(bad * co_c::HUGEINT * (10000 - guar)) AS b')}"""),
    "default_by_guarantee": sql(f"""
    SELECT band AS guarantee_bucket, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {usd('vol')} AS total_exposure, {usd('cov')} AS sba_exposure, {usd('loss')} AS total_loss
    FROM {grouped(f'{GUARANTEE} AS band', '(SELECT * FROM known WHERE gross_c > 0)')}"""),
    "riskiest_sectors": sql(f"""
    SELECT naics_sector, industry_sector, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {usd('vol')} AS total_volume, {usd('loss')} AS total_loss, {LOSS} AS loss_rate
    FROM {grouped('naics_sector, industry_sector')} WHERE n >= 500
    ORDER BY default_rate DESC, naics_sector LIMIT 10"""),
    "lender_risk": sql(f"""
    SELECT bank_name, bank_state, n AS total_loans, bad AS defaults, {RATE} AS default_rate,
      {usd('vol')} AS total_volume, {usd('loss')} AS total_loss, {LOSS} AS loss_rate,
      rank() OVER (ORDER BY bad::DOUBLE / n DESC) AS risk_rank
    FROM {grouped('bank_name, bank_state', LENDERS)} WHERE n >= 100
    ORDER BY default_rate DESC, bad::DOUBLE / n DESC, bank_name, bank_state LIMIT 25"""),
    "expected_loss": sql(f"""
    , s AS (SELECT *, {quotient('bad', 'n', 10000)} AS pd, coalesce({quotient('loss', 'bad_vol', 10000)}, 0) AS lgd
      FROM {grouped('industry_sector, loan_size_bucket', SECTORED)} WHERE n >= 50)
    SELECT industry_sector, loan_size_bucket, n AS total_loans, bad AS defaults,
      {scaled('pd', 2)} AS pd_pct, {scaled('lgd', 2)} AS lgd_pct, {usd('vol')} AS total_exposure,
      {scaled(quotient('pd * lgd * vol', '100000000', 1), 2)} AS expected_loss,
      {usd('loss')} AS actual_loss,
      {scaled(quotient('loss * 100000000 - pd * lgd * vol', '100000000', 1), 2)} AS variance
    FROM s ORDER BY expected_loss DESC, 1, 2 LIMIT 20"""),
    "risk_summary": sql(f"""
    , newest AS (SELECT count(*) AS n0, sum(bad)::BIGINT AS b0 FROM known
        WHERE vintage_year = (SELECT max(vintage_year) FROM clean))
    SELECT n AS total_loans, bad AS total_defaults, {usd('vol')} AS total_exposure,
      {usd('cov')} AS total_sba_exposure, {usd('loss')} AS total_loss, {RATE} AS portfolio_default_rate,
      {LOSS} AS portfolio_loss_rate, {pct('loss', 'bad_vol')} AS portfolio_lgd,
      coalesce(b0, 0) AS ytd_defaults, {pct('b0', 'n0')} AS ytd_default_rate
    FROM newest, {grouped('')}"""),
}
