"""Check queries for the import.

They do not parse text: they state, from the order key alone, what each raw field must become.
"""

from oracles.base import _list, day, pct, quotient, scaled, sql, textwrap, usd, whole
from loanloom.sources.star_mapping import SECTORS, STATE_CODES

# One row per raw row, with the value each field must have after the import.
RAW = f"""
WITH base AS (
  SELECT o_orderkey AS k, k % 23 AS t, CAST(o_orderdate + INTERVAL 168 MONTH AS DATE) AS d,
    CAST(round(o_totalprice * 100) AS BIGINT) AS c, c_name, c_mktsegment, c_custkey
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
),
raw AS (
  SELECT *, k % 211 <> 0 AND k % 199 <> 0 AS usable,
    if(k % 17 IN (3, 4), NULL, d) AS approval_date,
    if(k % 19 IN (3, 4), NULL, d + 30) AS disbursement_date,
    if(k % 9 = 3 AND k % 13 NOT IN (3, 4), d + 700, NULL) AS chargeoff_date,
    if(k % 41 = 0, NULL, year(d)) AS approval_fy,
    if(t IN (0, 1, 3), NULL, if(t = 2, 85, nullif(k % 300, 0))) AS term_months,
    if(t = 7, NULL, if(t = 5, 7, if(t = 6, 9999, k % 120))) AS num_employees,
    if(t = 7, 0, if(t = 5, 4, if(t = 6, 10000, (k % 120) // 2))) AS half_jobs,
    [2, 1, 2, 1, NULL, NULL, 2, 2, 1, NULL][k % 10 + 1] AS new_business,
    CASE WHEN k % 29 IN (1, 2, 3) THEN NULL WHEN k % 29 = 4 THEN 0 ELSE c END AS gross_c,
    CASE WHEN k % 37 IN (1, 2, 3) THEN NULL WHEN k % 37 = 4 THEN 0 ELSE (c * 75 + 50) // 100 END AS sba_c,
    CASE WHEN k % 7 IN (1, 2, 3) THEN NULL WHEN k % 7 = 4 THEN 0 ELSE (c * 30 + 50) // 100 END AS co_c,
    ['PIF', 'PIF', 'PIF', 'CHGOFF', 'CHGOFF', NULL, NULL, NULL, NULL][k % 9 + 1] AS loan_status,
    if(k % 6 IN (0, 2, 3), 'Y', 'N') AS rev_line_of_credit, if(k % 4 IN (0, 2), 'Y', 'N') AS low_doc,
    c_name || ', "Sons" & Co' AS business_name, c_mktsegment AS city,
    if(k % 31 = 0, 'TX', {_list(STATE_CODES)}[k % 24 + 1]) AS state,
    lpad(c_custkey::VARCHAR, 9, '0') AS zip,
    'Bank ' || (c_custkey // 7)::VARCHAR AS bank_name, {_list(STATE_CODES)}[k * 3 % 24 + 1] AS bank_state,
    {_list(SECTORS)}[k % 24 + 1] || '1110' AS naics,
    if(k % 4 = 2, 'S123456789', NULL) AS franchise_code
  FROM base
),
texts AS (
  SELECT k, '  ' || c_name || ', "Sons" & Co ' AS borrname,
    if(k % 41 = 0, 'FY20', year(d)::VARCHAR) AS fy_text,
    CASE k % 17 WHEN 0 THEN strftime(d, '%-m/%-d/%Y') WHEN 1 THEN strftime(d, '%m/%d/%Y')
      WHEN 2 THEN d::VARCHAR || 'T00:00' WHEN 3 THEN strftime(d, '%-m/%-d/%y')
      WHEN 4 THEN '13/45/2020' ELSE d::VARCHAR END AS date_text
  FROM raw WHERE usable
)
"""


def _sql(body: str) -> str:
    return RAW + textwrap.dedent(body)


_LOANS = f"""business_name, city, state, zip, bank_name, bank_state, naics,
 {day('approval_date')} AS approval_date, {whole('approval_fy')} AS approval_fy,
 {day('disbursement_date')} AS disbursement_date, {whole('term_months')} AS term_months,
 {whole('num_employees')} AS num_employees, {whole('new_business')} AS new_business,
 {whole('half_jobs')} AS jobs_created, {whole('half_jobs')} AS jobs_retained, franchise_code,
 0::BIGINT AS urban_rural, rev_line_of_credit, low_doc, {usd('gross_c')} AS gross_approved,
 {usd('sba_c')} AS sba_approved, {usd('gross_c')} AS disbursement_gross, NULL::DOUBLE AS balance_gross,
 loan_status, {day('chargeoff_date')} AS chargeoff_date, {usd('co_c')} AS chargeoff_amount,
 '2015-09-01 00:00:00' AS created_at, '2015-09-01 00:00:00' AS updated_at"""


def _amount_text(cents: str) -> str:
    return f"printf('%d.%02d', ({cents})::BIGINT // 100, ({cents})::BIGINT % 100)"


def _money_text(cents: str, turn: str) -> str:
    return f"""CASE {turn} WHEN 0 THEN '$' || format('{{:,.2f}}', ({cents}) / 100.0) WHEN 1 THEN '-' || {_amount_text(cents)}
      WHEN 2 THEN '1.2.3' WHEN 3 THEN '$' WHEN 4 THEN '0' ELSE {_amount_text(cents)} END"""


def _day_text(date: str, turn: str) -> str:
    return f"""CASE {turn} WHEN 0 THEN strftime({date}, '%-m/%-d/%Y') WHEN 1 THEN strftime({date}, '%m/%d/%Y')
      WHEN 2 THEN {date}::VARCHAR || 'T00:00' WHEN 3 THEN strftime({date}, '%-m/%-d/%y')
      WHEN 4 THEN '13/45/2020' ELSE {date}::VARCHAR END"""


# Columns of the raw files that the mapping leaves empty, and raw rows with one value per column.
EMPTY = """bankfdicnumber bankncuanumber bankstreet bankcity bankzip subprogram initialinterestrate
 fixedorvariableinterestind naicsdescription franchisename projectcounty sbadistrictoffice congressionaldistrict
 businesstype paidinfulldate collateralind soldsecmrktind""".split()
WHOLE = "k % 67 <> 0 AND k % 71 <> 0"


def _rule(columns: str) -> str:
    return _sql(f"SELECT k AS source_key, {columns} FROM raw WHERE usable")


_LOST = {
    "approval_date": "approval_date IS NULL",
    "approval_fy": "approval_fy IS NULL",
    "disbursement_date": "disbursement_date IS NULL",
    "term_months": "term_months IS NULL",
    "num_employees": "num_employees IS NULL",
    "new_business": "new_business IS NULL AND k % 10 <> 9",
    "gross_approved": "gross_c IS NULL",
    "sba_approved": "sba_c IS NULL",
    "chargeoff_date": "chargeoff_date IS NULL AND k % 9 = 3",
    "chargeoff_amount": "co_c IS NULL",
}

_STORED = f"""business_name, city, state, zip, bank_name, bank_state, naics,
 {day('approval_date')} AS approval_date, {whole('approval_fy')} AS approval_fy,
 {day('disbursement_date')} AS disbursement_date, {whole('term_months')} AS term_months,
 {whole('num_employees')} AS num_employees, {whole('new_business')} AS new_business,
 {whole('jobs_created')} AS jobs_created, {whole('jobs_retained')} AS jobs_retained, NULL::VARCHAR AS franchise_code,
 {whole('urban_rural')} AS urban_rural, rev_line_of_credit, low_doc, {usd('gross_c')} AS gross_approved,
 {usd('sba_c')} AS sba_approved, {usd('gross_c')} AS disbursement_gross, loan_status,
 {day('chargeoff_date')} AS chargeoff_date, {usd('co_c')} AS chargeoff_amount,
 NULL::VARCHAR AS created_at, NULL::VARCHAR AS updated_at"""


# Loans of the order mapping, some of them broken on purpose.
BROKEN = """(SELECT loan_id, concat_ws(',', if(k % 17 = 1, 'chk_loan_status', NULL),
   if(k % 19 = 2, 'chk_new_business', NULL), if(k % 23 = 3, 'chk_rev_line', NULL),
   if(k % 29 = 4 AND gross_c IS NOT NULL, 'chk_gross_approved_positive', NULL),
   if(k % 31 = 5, 'chk_term_positive', NULL)) AS reasons FROM loans)"""

ORACLES = {
    "read_raw_csv": _sql(f"""
    SELECT '12/31/2025' AS asofdate, '7A' AS program,
      CASE WHEN k % 211 = 0 THEN '  ' WHEN k % 199 = 0 THEN NULL ELSE (k % 997)::VARCHAR END AS l2locid,
      '  ' || c_name || ', "Sons" & Co ' AS borrname, (k % 500)::VARCHAR || ' Main St, Unit 2' AS borrstreet,
      city AS borrcity, if(k % 31 = 0, NULL, lower(state)) AS borrstate, zip AS borrzip, bank_name AS bankname,
      bank_state AS bankstate, {_money_text('c', 'k % 29')} AS grossapproval,
      {_money_text('(c * 75 + 50) // 100', 'k % 37')} AS sbaguaranteedapproval,
      {_day_text('d', 'k % 17')} AS approvaldate, if(k % 41 = 0, 'FY20', year(d)::VARCHAR) AS approvalfiscalyear,
      {_day_text('(d + 30)', 'k % 19')} AS firstdisbursementdate,
      ['LowDoc', 'Preferred Lender', 'a Low Doc loan', NULL][k % 4 + 1] AS processingmethod,
      CASE t WHEN 0 THEN '0' WHEN 1 THEN '-3' WHEN 2 THEN '84.6' WHEN 3 THEN 'x' ELSE (k % 300)::VARCHAR END AS terminmonths,
      {_list(SECTORS)}[k % 24 + 1] || '111099' AS naicscode,
      CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'S123456789012' END AS franchisecode,
      'tx' AS projectstate,
      ['New Business or 2 years', 'Existing', '1.5', '2.5', 'Unanswered', '3 years', 'STARTUP', ' new ',
       'Existing or more than 2 years old', NULL][k % 10 + 1] AS businessage,
      ['PIF', 'Paid in Full', 'EXEMPT', 'CHGOFF', 'Charged Off', 'COMMIT', 'CANCLD', 'p i f', NULL][k % 9 + 1] AS loanstatus,
      CASE WHEN k % 9 = 3 THEN {_day_text('(d + 700)', 'k % 13')} END AS chargeoffdate,
      {_money_text('(c * 30 + 50) // 100', 'k % 7')} AS grosschargeoffamount,
      ['Y', 'N', 'yes', '1', '0', NULL][k % 6 + 1] AS revolverstatus,
      CASE t WHEN 5 THEN '7.0' WHEN 6 THEN '20000' WHEN 7 THEN '-4' ELSE (k % 120)::VARCHAR END AS jobssupported,
      {', '.join(f'NULL::VARCHAR AS {c}' for c in EMPTY)}
    FROM raw WHERE {WHOLE}"""),
    "rejected_raw_rows": _sql(f"""
    SELECT 'batch=' || (k % 4)::VARCHAR AS folder, '12/31/2025' AS asofdate, k AS source_key,
      if(k % 67 = 0, 3, 50)::BIGINT AS fields FROM raw WHERE NOT ({WHOLE})"""),
    "count_by_source": _sql(f"""
    SELECT 'batch=' || (k % 4)::VARCHAR AS source, count(*) AS row_count,
      (SELECT count(*) FROM raw WHERE {WHOLE}) AS total_rows FROM raw WHERE {WHOLE} GROUP BY 1"""),
    "import_loans": _sql(f"SELECT {_LOANS} FROM raw WHERE usable"),
    "assign_loan_id": _sql("""
    SELECT printf('SBA-%08d', row_number() OVER (ORDER BY fy_text, date_text, borrname)) AS loan_id,
      fy_text AS approvalfiscalyear, date_text AS approvaldate, borrname FROM texts"""),
    "parse_date": _rule(f"{day('approval_date')} AS approval_date, {day('disbursement_date')} AS disbursement_date, {day('chargeoff_date')} AS chargeoff_date"),
    "parse_int_year": _rule(f"{whole('approval_fy')} AS approval_fy"),
    "parse_term": _rule(f"{whole('term_months')} AS term_months"),
    "parse_employees": _rule(f"{whole('num_employees')} AS num_employees"),
    "parse_business_age": _rule(f"{whole('new_business')} AS new_business"),
    "split_jobs": _rule(f"{whole('half_jobs')} AS jobs_created, {whole('half_jobs')} AS jobs_retained"),
    "parse_flags": _rule("rev_line_of_credit, low_doc"),
    "parse_money": _rule(f"{usd('gross_c')} AS gross_approved, {usd('sba_c')} AS sba_approved, {usd('gross_c')} AS disbursement_gross"),
    "parse_chargeoff_amount": _rule(f"{usd('co_c')} AS chargeoff_amount"),
    "map_status": _rule("loan_status"),
    "text_cleanup": _rule("business_name, city, state, zip, bank_name, bank_state, naics, franchise_code"),
    "parse_failures": _sql(" UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) FILTER ({lost}) AS unparsed_count FROM raw WHERE usable"
        for name, lost in _LOST.items()
    )),
    "validate_constraints": sql(f"SELECT loan_id, reasons AS rejected_reasons FROM {BROKEN} WHERE reasons <> ''"),
    "check_unique": sql("SELECT loan_id, 2::BIGINT AS duplicate_count FROM loans WHERE k % 28 = 0"),
    "write_loans": sql(f"""
    SELECT loan_id, {_STORED} FROM loans JOIN {BROKEN} USING (loan_id) WHERE reasons = ''"""),
    "incremental_load": _sql(f"""
    , t AS (SELECT * FROM raw JOIN texts USING (k)),
    one AS (
      SELECT *, row_number() OVER (ORDER BY fy_text, date_text, borrname) AS n FROM t WHERE fy_text < '2013'
    ), two AS (
      SELECT *, (SELECT max(n) FROM one) + row_number() OVER (ORDER BY fy_text, date_text, borrname) AS n
      FROM t WHERE fy_text >= '2013'
    ), kept AS (
      FROM one UNION ALL FROM two WHERE approval_date > (SELECT max(approval_date) FROM one) AND n % 17 <> 1
    )
    SELECT printf('SBA-%08d', n) AS loan_id, business_name, {day('approval_date')} AS approval_date,
      {whole('approval_fy')} AS approval_fy, '2015-09-01 00:00:00' AS created_at FROM kept"""),
    "load_history": sql(f"""
    SELECT version::BIGINT AS version, {whole('approval_fy')} AS approval_fy, count(*) AS loan_count
    FROM loans JOIN (VALUES (1, DATE '2010-01-01'), (2, DATE '2014-07-01'), (3, DATE '9999-01-01')) v(version, before)
      ON approval_date < before GROUP BY ALL"""),
    "stored_ids": sql("SELECT loan_id FROM loans WHERE k % 3 <> 1 AND k % 5 < 2"),
    "sample_loans": sql(f"""
    , booked AS (
      SELECT * FROM loans UNION ALL FROM loans WHERE rev_line_of_credit = 'Y' AND low_doc = 'Y'
    ), odd AS (
      SELECT if(k % 53 = 0, NULL, loan_id) AS loan_id, business_name, approval_date, gross_c,
        coalesce(if(k % 53 = 0, NULL, loan_id), business_name || '|' || zip || '|' || approval_date::VARCHAR || '|' ||
          coalesce({_amount_text('gross_c')}, '')) AS known FROM booked
    )
    SELECT loan_id, business_name, {day('approval_date')} AS approval_date, {usd('gross_c')} AS gross_approved
    FROM odd ORDER BY md5('42' || known), loan_id LIMIT 10000"""),
    "import_report": sql(f"""
    SELECT count(*) AS total_loans, {whole('min(approval_fy)')} AS first_fiscal_year,
      {whole('max(approval_fy)')} AS last_fiscal_year, count(DISTINCT state) AS states_with_loans,
      {scaled(quotient('sum(gross_c)', '100000000000', 100), 2)} AS approved_billions,
      {scaled(quotient('sum(sba_c)', '100000000000', 100), 2)} AS guaranteed_billions,
      {scaled(quotient('sum(co_c) FILTER (co_c > 0)', '100000000000', 100), 2)} AS chargeoff_billions,
      {scaled(quotient('sum(gross_c)', '100 * count(gross_c) FILTER (gross_c > 0)', 1), 0)} AS avg_loan_size,
      {scaled(quotient('sum(term_months)', 'count(term_months) FILTER (term_months > 0)', 1), 0)} AS avg_term_months
    FROM loans"""),
    "import_status_report": sql(f"""
    SELECT coalesce(loan_status, 'ACTIVE/PENDING') AS status, c AS loan_count,
      {pct('c', 'sum(c) OVER ()')} AS pct_of_total
    FROM (SELECT loan_status, count(*) AS c FROM loans GROUP BY 1)"""),
}
_STREET = "(k % 500)::VARCHAR || ' Main St, Unit 2'"
_BREAKS = """CASE WHEN k % 7 = 0 THEN chr(10) || '"rear",' || chr(10) || chr(10) || '2nd floor' WHEN k % 5 = 0 THEN chr(10) ELSE '' END"""
ORACLES["read_quoted_csv"] = ORACLES["read_raw_csv"].replace(_STREET, f"{_STREET} || {_BREAKS}").replace(f"WHERE {WHOLE}", "")
