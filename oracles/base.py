"""Building blocks of the DuckDB check queries.

The check queries are written apart from the Spark code: money is integer cents, percentages
per loan are integer hundredths, and every rounded ratio is one integer division. Dates and
flags are shown as text, sums as BIGINT or DOUBLE.
"""

from __future__ import annotations

import textwrap

from loanloom.dimensions import NAICS_ROWS, STATE_ROWS
from loanloom.sources.star_mapping import SECTORS, STATE_CODES

AS_OF = "DATE '2015-09-01'"


def _list(codes) -> str:
    return "[" + ", ".join(f"'{c}'" for c in codes) + "]"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join("'" + v + "'" for v in row) + ")" for row in rows)


def steps(value: str, edges, last: str, op: str) -> str:
    """CASE over ordered edges."""
    arms = " ".join(f"WHEN {value} {op} {edge} THEN '{label}'" for edge, label in edges)
    return f"CASE {arms} ELSE '{last}' END"


def quotient(a: str, b: str, factor: int) -> str:
    """factor*a/b to the nearest integer, halves away from zero; NULL for b = 0. b is not negative."""
    return (
        f"((CASE WHEN ({a}) < 0 THEN -1 ELSE 1 END) * ((2 * {factor} * abs(({a})::HUGEINT)"
        f" + nullif(({b})::HUGEINT, 0)) // (2 * nullif(({b})::HUGEINT, 0))))"
    )


def scaled(x: str, digits: int) -> str:
    return f"(({x})::DOUBLE / {10**digits})"


def pct(a: str, b: str, digits: int = 2) -> str:
    return scaled(quotient(a, b, 100 * 10**digits), digits)


def pct_int(a: str, b: str) -> str:
    """Percentage in whole hundredths."""
    return quotient(a, b, 10_000)


def avg(a: str, n: str, digits: int = 2) -> str:
    return scaled(quotient(a, n, 10**digits), digits)


def avg_usd(cents: str, n: str, digits: int = 2) -> str:
    return scaled(quotient(cents, f"100 * ({n})", 10**digits), digits)


def half_up(x: str, digits: int = 2) -> str:
    """A double rounded as a decimal."""
    return f"round(CAST({x} AS DECIMAL(28, 6)), {digits})::DOUBLE"


def usd(cents: str) -> str:
    return f"(({cents})::DOUBLE / 100)"


def whole(x: str) -> str:
    return f"({x})::BIGINT"


def day(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# Labels by upper edge.
SIZES = [
    (5_000_000, "Micro (<$50K)"),
    (15_000_000, "Small ($50K-$150K)"),
    (35_000_000, "Medium ($150K-$350K)"),
    (100_000_000, "Large ($350K-$1M)"),
]
JUMBO = "Jumbo (>$1M)"
TERM_STEPS = [(12, "Short (<=1yr)"), (60, "Medium (1-5yr)"), (120, "Long (5-10yr)")]
STAFF_STEPS = [(10, "Micro (1-10)"), (50, "Small (11-50)"), (250, "Medium (51-250)")]
GUARANTEE_STEPS = [(9000, "90-100%"), (8000, "80-89%"), (7500, "75-79%"), (5000, "50-74%")]
GUARANTEE = steps("guar", GUARANTEE_STEPS, "<50%", ">=")
SEASON_STEPS = [
    (12, "0-12 months"), (24, "13-24 months"), (36, "25-36 months"), (48, "37-48 months"),
    (60, "49-60 months"), (84, "61-84 months"),
]
SEASON = steps("m", SEASON_STEPS, "85+ months", "<=")


def months(start: str, end: str) -> str:
    return f"(date_part('year', age({end}, {start})) * 12 + date_part('month', age({end}, {start})))"


PREFIX = f"""
WITH
sectors(code, sector, subsector) AS (VALUES {_rows(NAICS_ROWS)}),
places(code, place, region, division) AS (VALUES {_rows(STATE_ROWS)}),
shipped AS (
  SELECT l_orderkey AS key, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
         CAST(sum(l_quantity) AS BIGINT) AS pieces, min(l_suppkey) AS supp
  FROM lineitem GROUP BY l_orderkey
),
seed AS (
  SELECT o_orderkey AS k, o_custkey AS cust, c_name, c_mktsegment, c_custkey, c_nationkey,
         s_name, s_nationkey, first_ship, last_ship, pieces,
         CAST(o_orderdate + INTERVAL 168 MONTH AS DATE) AS approved,
         CASE WHEN o_orderkey % 101 <> 0
              THEN CAST(round(o_totalprice * 100) AS BIGINT) * (1 + o_orderkey % 5) END AS g,
         CASE o_orderstatus WHEN 'F' THEN 'PIF'
              WHEN 'P' THEN if(o_orderkey % 3 = 0, 'CHGOFF', 'PIF') END AS outcome
  FROM orders
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN shipped ON key = o_orderkey
  LEFT JOIN supplier ON s_suppkey = if(o_orderkey % 5 = 0 OR supp IS NULL, coalesce(supp, o_orderkey) % 8, supp)
),
loans AS (
  SELECT k, printf('SBA-%08d', k) AS loan_id,
    if(k % 97 = 0, ' ', c_name) AS business_name, c_mktsegment AS city,
    {_list(STATE_CODES)}[c_nationkey * c_nationkey // 25 + 1] AS state,
    lpad(c_custkey::VARCHAR, 9, '0') AS zip, s_name AS bank_name,
    {_list(STATE_CODES)}[s_nationkey * s_nationkey // 25 + 1] AS bank_state,
    {_list(SECTORS)}[(k % 26) * (k % 26) // 26 + 1] || '1110' AS naics,
    approved AS approval_date,
    year(approved) + if(month(approved) >= 10, 1, 0) AS approval_fy,
    CAST(first_ship + INTERVAL 168 MONTH AS DATE) AS disbursement_date,
    if(k % 89 = 0, NULL, 6 * (1 + k % 50)) AS term_months,
    pieces AS num_employees, pieces // 2 AS jobs_created, pieces // 2 AS jobs_retained,
    if(cust % 11 = 0, NULL, 1 + cust % 2) AS new_business,
    if(cust % 11 = 0, NULL, cust % 3) AS urban_rural,
    if(k % 4 = 0, 'Y', 'N') AS rev_line_of_credit, if(k % 7 = 0, 'Y', 'N') AS low_doc,
    g AS gross_c,
    if(k % 103 = 0, (11 * g + 5) // 10, (g * (40 + 5 * (k % 13)) + 50) // 100) AS sba_c,
    outcome AS loan_status,
    CASE WHEN outcome = 'CHGOFF' THEN CAST(last_ship + INTERVAL 168 MONTH AS DATE) END AS chargeoff_date,
    CASE WHEN outcome = 'CHGOFF' THEN (g * (k % 11) + 5) // 10 END AS co_c
  FROM seed
),
filled AS (
  SELECT l.* EXCLUDE (business_name, city, state, zip, bank_name, bank_state, naics, gross_c,
                      sba_c, co_c, term_months, num_employees, jobs_created, jobs_retained, approval_fy),
    coalesce(nullif(trim(business_name), ''), 'Unknown') AS business_name,
    coalesce(nullif(trim(city), ''), 'Unknown') AS city,
    upper(coalesce(state, 'XX')) AS state, coalesce(zip, '00000')[1:5] AS zip_5,
    coalesce(nullif(trim(bank_name), ''), 'Unknown Lender') AS bank_name,
    upper(coalesce(bank_state, 'XX')) AS bank_state,
    coalesce(naics, '000000') AS naics, coalesce(naics, '00')[1:2] AS naics_sector,
    coalesce(sector, 'Unknown') AS industry_sector,
    coalesce(approval_fy, year(approval_date)) AS approval_fy,
    coalesce(term_months, 0) AS term_months, term_months AS raw_term,
    coalesce(num_employees, 0) AS num_employees,
    coalesce(jobs_created, 0) AS jobs_created, coalesce(jobs_retained, 0) AS jobs_retained,
    coalesce(gross_c, 0) AS gross_c, coalesce(sba_c, 0) AS sba_c, coalesce(co_c, 0) AS co_c
  FROM loans l LEFT JOIN sectors ON code = naics[1:2]
),
clean AS (
  SELECT * EXCLUDE (loan_status, new_business, urban_rural),
    coalesce(loan_status, 'UNKNOWN') AS loan_status,
    if(loan_status = 'CHGOFF', 1, 0) AS bad, if(loan_status = 'PIF', 1, 0) AS paid,
    CASE WHEN raw_term IS NULL THEN 'Unknown'
         ELSE {steps('raw_term', TERM_STEPS, 'Extended (>10yr)', '<=')} END AS term_category,
    CASE WHEN num_employees = 0 THEN 'Unknown'
         ELSE {steps('num_employees', STAFF_STEPS, 'Large (250+)', '<=')} END AS business_size,
    coalesce(['Existing', 'New'][new_business], 'Unknown') AS business_type,
    coalesce(['Unknown', 'Urban', 'Rural'][urban_rural + 1], 'Unknown') AS location_type,
    {steps('gross_c', SIZES, JUMBO, '<')} AS loan_size_bucket,
    coalesce({pct_int('sba_c', 'gross_c')}, 0) AS guar,
    if(loan_status = 'CHGOFF', coalesce({pct_int('co_c', 'gross_c')}, 0), 0) AS sev,
    year(approval_date) AS vintage_year, quarter(approval_date) AS vintage_quarter,
    month(approval_date) AS vintage_month, date_trunc('month', approval_date)::DATE AS mon
  FROM filled
),
known AS (SELECT * FROM clean WHERE loan_status <> 'UNKNOWN'),
timed AS (
  SELECT *, {months('coalesce(disbursement_date, approval_date)', 'chargeoff_date')} AS m,
         CAST(ceil({months('approval_date', 'chargeoff_date')} / 12.0) AS BIGINT) AS seasoned
  FROM known WHERE bad = 1 AND chargeoff_date IS NOT NULL
)
"""

# Totals of a group of clean loans.
SUMS = """count(*) AS n, sum(bad)::BIGINT AS bad, sum(paid)::BIGINT AS paid, sum(gross_c) AS vol,
 sum(sba_c) AS cov, sum(co_c) AS loss, sum(bad * gross_c) AS bad_vol, sum(bad * sba_c) AS bad_cov,
 sum(bad * co_c) AS bad_loss, sum(bad * sev) AS bad_sev, sum(bad * term_months) AS bad_terms,
 sum(term_months) AS terms, sum(guar) AS guars, sum(jobs_created)::BIGINT AS created,
 sum(jobs_retained)::BIGINT AS retained"""


def grouped(keys: str, source: str = "known", extra: str = "") -> str:
    """Totals per key as a subquery; ``keys`` may hold aliased expressions, or be empty."""
    lead = f"{keys}, " if keys else ""
    return f"(SELECT {lead}{SUMS}{extra} FROM {source}{' GROUP BY ALL' if keys else ''})"


def sql(body: str) -> str:
    return PREFIX + textwrap.dedent(body)
