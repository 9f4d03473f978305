"""Check queries for the state of the views: one pass over all loans, however many loads there were."""

from oracles import dashboard, kpis
from oracles.base import day, sql, usd, whole

# Names of the sides.
_SIDES = {
    "Day": "approval_date", "Lender": "bank_name", "State": "state", "Industry": "industry_sector",
    "Loan Size": "loan_size_bucket", "Business Type": "business_type", "Term Category": "term_category",
    "Location Type": "location_type", "all": "NULL",
}
_REPORTS = (
    "executive_summary", "monthly_trends", "ytd_comparison", "dimension_drilldown", "top_rankings",
    "comprehensive_rankings", "risk_watchlist", "portfolio_snapshot", "portfolio_kpi_summary",
)
_OPEN = "FILTER (loan_status <> 'UNKNOWN')"


def _sums(side: str, column: str) -> str:
    return f"""
    SELECT {whole('vintage_year')} AS vintage_year, '{side}' AS side, {day(column)} AS value, count(*) AS booked,
      count(*) {_OPEN} AS loans, count(*) FILTER (bad = 1) AS defaults,
      {usd(f'sum(gross_c) {_OPEN}')} AS volume, {usd(f'sum(sba_c) {_OPEN}')} AS exposure,
      {whole(f'sum(term_months) {_OPEN}')} AS terms, {usd(f'sum(guar) {_OPEN}')} AS guarantees,
      {whole(f'sum(jobs_created) {_OPEN}')} AS created, {whole(f'sum(jobs_retained) {_OPEN}')} AS retained,
      {usd(f'sum(co_c) {_OPEN}')} AS losses, {usd('sum(gross_c) FILTER (bad = 1)')} AS bad_volume
    FROM clean GROUP BY ALL"""


def _distinct(side: str, column: str, *lead: str) -> str:
    return f"""
    SELECT {', '.join([*lead, f"'{side}' AS side", f'{day(column)} AS value'])},
      count(DISTINCT bank_name) AS {{0}}, count(DISTINCT state) AS {{1}}, count(DISTINCT industry_sector) AS {{2}}
    FROM known GROUP BY ALL"""


def _counts(names: tuple[str, str, str], parts) -> str:
    return sql(" UNION ALL ".join(part.format(*names) for part in parts))


_PLAIN = {"all": "NULL", "State": "state", "Industry": "industry_sector"}
_SPANS = (("'year' AS span", f"{whole('vintage_year')} AS vintage_year"), ("'all' AS span", "NULL::BIGINT AS vintage_year"))

ORACLES = {f"view_{name}": (dashboard.ORACLES | kpis.ORACLES)[name] for name in _REPORTS} | {
    "view_sums": sql(" UNION ALL ".join(_sums(side, column) for side, column in _SIDES.items())),
    "lenders_reached": _counts(
        ("lenders", "states", "industries"),
        [_distinct(side, column, *span) for side, column in _PLAIN.items() for span in _SPANS],
    ),
    "distinct_counts": _counts(
        ("Lender", "State", "Industry"),
        [_distinct(side, column) for side, column in (_PLAIN | {"Vintage Year": "vintage_year"}).items()],
    ),
}
