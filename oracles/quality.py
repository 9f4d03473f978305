"""Check queries for data quality."""

from oracles.base import (
    AS_OF, JUMBO, SIZES, avg, avg_usd, day, half_up, pct, pct_int, scaled, sql, steps, usd, whole,
)

_PROFILED = {
    "loan_id": "loan_id", "business_name": "business_name", "state": "state", "naics": "naics",
    "approval_date": "approval_date", "gross_approved": "gross_c", "loan_status": "loan_status",
}
_SECTOR_CODES = "(SELECT code FROM sectors)"


def _counted(label: str, name: str, count: str) -> str:
    return sql(f"""
    SELECT {name}, c AS {count}, {pct('c', 'sum(c) OVER ()')} AS pct_of_total
    FROM (SELECT {label} AS {name}, count(*) AS c FROM loans GROUP BY 1)""")


def _point(p: float, digits: int = 4) -> str:
    return f"round(quantile_cont(gross_c::DOUBLE, {p}) / 100, {digits})"


# Loans that are booked twice: the test table for duplicates.
TWICE = "(SELECT * FROM loans UNION ALL SELECT * FROM loans WHERE k % 28 = 0)"

# Names of the checks, and labels of verdicts below.
_VALID = {
    "pct_with_loan_id": "loan_id IS NOT NULL",
    "pct_valid_state": "length(state) = 2",
    "pct_valid_naics": "length(naics) >= 2",
    "pct_valid_date": f"approval_date <= {AS_OF}",
    "pct_valid_amount": "gross_c > 0",
    "pct_known_outcome": "loan_status IS NOT NULL",
    "pct_valid_term": "term_months BETWEEN 1 AND 360",
}
_VALID_PCTS = ", ".join(
    f"{pct(f'count(*) FILTER ({test})', 'count(*)')} AS {name}" for name, test in _VALID.items()
)
_VALID_SUM = " + ".join(f"count(*) FILTER ({test})" for test in _VALID.values())

_FLAGS = f"""(SELECT loan_id,
  if(coalesce(gross_c, 0) <= 0, 1, 0) AS no_amount,
  if(loan_status IS NOT NULL AND loan_status NOT IN ('PIF', 'CHGOFF'), 1, 0) AS no_outcome,
  if(approval_date IS NULL OR approval_date > {AS_OF}, 1, 0) AS no_date,
  if(state IS NULL OR length(state) <> 2, 1, 0) AS no_state FROM loans)"""

ORACLES = {
    "null_profile": sql(" UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) AS total_rows,"
        f" count(*) - count({column}) AS null_count,"
        f" {pct(f'count(*) - count({column})', 'count(*)')} AS null_pct FROM loans"
        for name, column in _PROFILED.items()
    )),
    "null_profile_wide": sql("SELECT count(*) AS total_rows, " + ", ".join(
        f"count(*) - count({c}) AS {c}_nulls, {pct(f'count(*) - count({c})', 'count(*)')} AS {c}_null_pct"
        for c in ("loan_id", "naics", "loan_status")
    ) + " FROM loans"),
    "amount_distribution": sql(f"""
    SELECT 'Gross Approved Amount' AS metric, count(gross_c) AS total_records,
      {usd('min(gross_c)')} AS min_value, {_point(.25)} AS p25, {_point(.5)} AS median,
      {avg_usd('sum(gross_c)', 'count(gross_c)')} AS mean, {_point(.75)} AS p75,
      {_point(.95)} AS p95, {_point(.99)} AS p99, {usd('max(gross_c)')} AS max_value,
      {half_up('stddev_samp(gross_c / 100.0)')} AS std_dev
    FROM loans"""),
    "iqr_outliers": sql(f"""
    , b AS (SELECT {_point(.25)} AS q1, {_point(.75)} AS q3 FROM loans)
    SELECT 'Loan Amount Outliers' AS analysis, lo AS below_lower_bound, hi AS above_upper_bound,
      n - lo - hi AS within_bounds, {pct('hi', 'n')} AS pct_high_outliers
    FROM (SELECT count(*) AS n,
        count(*) FILTER (gross_c / 100.0 < (SELECT q1 - 1.5 * (q3 - q1) FROM b)) AS lo,
        count(*) FILTER (gross_c / 100.0 > (SELECT q3 + 1.5 * (q3 - q1) FROM b)) AS hi
      FROM loans WHERE gross_c IS NOT NULL)"""),
    "term_outliers": sql(f"""
    SELECT 'Loan Term (Months)' AS metric, count(term_months) AS total_records,
      min(term_months)::BIGINT AS min_term, quantile_cont(term_months::DOUBLE, 0.5) AS median_term,
      {avg('sum(term_months)', 'count(term_months)', 1)} AS avg_term,
      max(term_months)::BIGINT AS max_term, count(*) FILTER (term_months > 300) AS extreme_terms,
      count(*) FILTER (term_months <= 0) AS invalid_terms
    FROM loans"""),
    "employee_buckets": _counted(
        "CASE WHEN num_employees IS NULL THEN 'NULL' WHEN num_employees < 0 THEN 'Negative (invalid)'"
        " ELSE " + steps("num_employees", [
            (0, "0 employees"), (10, "1-10"), (50, "11-50"), (100, "51-100"), (500, "101-500"),
        ], ">500 (potential issue)", "<=") + " END", "employee_bucket", "loan_count"),
    "invalid_states": sql("""
    SELECT state, occurrences, validation_status FROM (
      SELECT state, count(*) AS occurrences,
        CASE WHEN state IS NULL THEN 'NULL' WHEN length(state) <> 2 THEN 'Invalid length'
             WHEN NOT regexp_full_match(state, '[A-Z][A-Z]') THEN 'Invalid format'
             WHEN state NOT IN (SELECT code FROM places) THEN 'Unknown state' END AS validation_status
      FROM loans GROUP BY state) WHERE validation_status IS NOT NULL
    ORDER BY occurrences DESC, state NULLS LAST LIMIT 20"""),
    "naics_validity": _counted(
        "CASE WHEN naics IS NULL THEN 'NULL' WHEN NOT regexp_full_match(naics, '[0-9]+') THEN"
        " 'Non-numeric' WHEN length(naics) < 2 THEN 'Too short' WHEN length(naics) > 6 THEN 'Too long'"
        f" WHEN naics[1:2] NOT IN {_SECTOR_CODES} THEN 'Invalid sector' ELSE 'Valid' END",
        "naics_status", "record_count"),
    "date_checks": sql(f"""
    SELECT 'Date Validation' AS check_type, count(*) AS total_loans,
      count(*) FILTER (approval_date > {AS_OF}) AS future_approval_dates,
      count(*) FILTER (year(approval_date) < 1990) AS ancient_approval_dates,
      count(*) FILTER (disbursement_date < approval_date) AS disbursement_before_approval,
      count(*) FILTER (chargeoff_date < disbursement_date) AS chargeoff_before_disbursement,
      count(*) FILTER (approval_date IS NULL) AS missing_approval_date,
      count(*) FILTER (approval_fy NOT BETWEEN year(approval_date) AND year(approval_date) + 1) AS fy_mismatch
    FROM loans"""),
    "status_distribution": sql(f"""
    SELECT coalesce(loan_status, 'NULL/Unknown') AS status, c AS loan_count,
      {pct('c', 'sum(c) OVER ()')} AS pct_of_total, {avg_usd('v', 'sized')} AS avg_loan_amount,
      {usd('v')} AS total_volume
    FROM (SELECT loan_status, count(*) AS c, sum(gross_c) AS v, count(gross_c) AS sized
          FROM loans GROUP BY 1)"""),
    "duplicate_ids": sql(f"""
    SELECT loan_id, count(*) AS duplicate_count FROM {TWICE} GROUP BY 1 HAVING count(*) > 1
    ORDER BY 2 DESC, 1 LIMIT 10"""),
    "potential_duplicates": sql(f"""
    SELECT business_name, city, state, {day('approval_date')} AS approval_date,
      {usd('gross_c')} AS gross_approved, count(*) AS potential_duplicates
    FROM {TWICE} t WHERE business_name IS NOT NULL
    GROUP BY t.business_name, t.city, t.state, t.approval_date, t.gross_c HAVING count(*) > 1
    ORDER BY 6 DESC, 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST, 4 NULLS LAST, 5 NULLS LAST LIMIT 20"""),
    "guarantee_categories": sql(f"""
    SELECT guarantee_category, count(*) AS loan_count,
      {half_up('avg(100.0::DOUBLE * sba_c / gross_c)')} AS avg_guarantee_pct
    FROM (SELECT gross_c, sba_c,
        CASE WHEN coalesce(gross_c, 0) = 0 THEN 'Cannot calculate'
             WHEN sba_c IS NULL THEN 'Missing SBA amount'
             WHEN sba_c > gross_c THEN 'SBA > Gross (invalid)'
             WHEN 10 * sba_c > 9 * gross_c THEN 'High guarantee (>90%)'
             WHEN 10 * sba_c >= 7 * gross_c THEN 'Standard (70-90%)'
             WHEN 2 * sba_c >= gross_c THEN 'Normal (50-70%)'
             ELSE 'Low guarantee (<50%)' END AS guarantee_category FROM loans)
    GROUP BY 1"""),
    "chargeoff_consistency": sql("""
    SELECT 'Chargeoff Validation' AS check_type,
      count(*) FILTER (loan_status = 'CHGOFF' AND chargeoff_date IS NULL) AS chgoff_missing_date,
      count(*) FILTER (loan_status = 'CHGOFF' AND co_c IS NULL) AS chgoff_missing_amount,
      count(*) FILTER (loan_status = 'CHGOFF' AND co_c = 0) AS chgoff_zero_amount,
      count(*) FILTER (loan_status = 'PIF' AND chargeoff_date IS NOT NULL) AS pif_with_chgoff_date,
      count(*) FILTER (loan_status = 'PIF' AND co_c > 0) AS pif_with_chgoff_amount
    FROM loans"""),
    "clean": sql(f"""
    SELECT loan_id, business_name, city, state, zip_5, bank_name, bank_state, naics, naics_sector,
      industry_sector, {day('approval_date')} AS approval_date, {whole('approval_fy')} AS approval_fy,
      {day('disbursement_date')} AS disbursement_date, {day('chargeoff_date')} AS chargeoff_date,
      {whole('term_months')} AS term_months, term_category, {whole('num_employees')} AS num_employees,
      business_size, business_type, {whole('jobs_created')} AS jobs_created,
      {whole('jobs_retained')} AS jobs_retained, location_type,
      if(rev_line_of_credit = 'Y', 'true', 'false') AS is_revolving_line,
      if(low_doc = 'Y', 'true', 'false') AS is_low_doc, {usd('gross_c')} AS gross_approved,
      {usd('sba_c')} AS sba_approved, {usd('gross_c')} AS disbursement_gross,
      0.0::DOUBLE AS balance_gross, {usd('co_c')} AS chargeoff_amount, loan_size_bucket,
      {scaled('guar', 2)} AS sba_guarantee_pct, loan_status,
      CASE loan_status WHEN 'CHGOFF' THEN 'true' WHEN 'PIF' THEN 'false' END AS is_defaulted,
      CASE loan_status WHEN 'PIF' THEN 'true' WHEN 'CHGOFF' THEN 'false' END AS is_paid_in_full,
      {scaled('sev', 2)} AS loss_severity_pct, {whole('vintage_year')} AS vintage_year,
      {whole('vintage_quarter')} AS vintage_quarter, {whole('vintage_month')} AS vintage_month,
      '2015-09-01 00:00:00' AS processed_at
    FROM clean"""),
    "quality_scorecard": sql(f"""
    SELECT 'Data Quality Summary' AS report, count(*) AS total_records, {_VALID_PCTS},
      {pct(_VALID_SUM, f'{len(_VALID)} * count(*)')} AS overall_quality_score FROM loans"""),
    "exclusion_flags": sql(f"""
    SELECT loan_id, no_amount::BIGINT AS exclude_invalid_amount, no_outcome::BIGINT AS exclude_unknown_outcome,
      no_date::BIGINT AS exclude_invalid_date, no_state::BIGINT AS exclude_invalid_state,
      greatest(no_amount, no_outcome, no_date)::BIGINT AS exclude_from_analysis FROM {_FLAGS}"""),
    "exclusion_summary": sql(f"""
    SELECT 'Exclusion Summary' AS report, n AS total_records, a AS excluded_invalid_amount,
      o AS excluded_unknown_outcome, d AS excluded_invalid_date, s AS excluded_invalid_state,
      x AS total_excluded, n - x AS records_for_analysis, {pct('n - x', 'n')} AS pct_usable
    FROM (SELECT count(*) AS n, sum(no_amount)::BIGINT AS a, sum(no_outcome)::BIGINT AS o,
      sum(no_date)::BIGINT AS d, sum(no_state)::BIGINT AS s,
      sum(greatest(no_amount, no_outcome, no_date))::BIGINT AS x FROM {_FLAGS})"""),
    "helper_values": sql(f"""
    SELECT CASE WHEN gross_c IS NULL THEN 'Unknown' ELSE {steps('gross_c', SIZES, JUMBO, '<')} END AS size_category,
      if(length(naics) >= 2, naics[1:2], 'Unknown') AS sector_code, count(*) AS loan_count,
      {scaled(f"sum({pct_int('sba_c', 'gross_c')})", 2)} AS guarantee_pct_sum
    FROM loans GROUP BY 1, 2"""),
    "nb_quality": sql(f"SELECT count(*) AS total_records, {_VALID_PCTS} FROM loans"),
}
