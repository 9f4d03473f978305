"""All check queries by name."""

from oracles import cohort, dashboard, ingest, kpis, quality, raw_variants, risk, segments, view_state

ORACLES = {
    name: text
    for family in (ingest, quality, kpis, risk, cohort, segments, dashboard, raw_variants, view_state)
    for name, text in family.ORACLES.items()
}
