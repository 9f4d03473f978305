"""Raw loan table -> standardised loan table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from loanloom.dimensions import naics_codes
from loanloom.functions import buckets as B
from loanloom.functions.dates import as_of_date

# Fillers for missing fields.
NO_NAME, NO_LENDER, NO_STATE, NO_ZIP, NO_NAICS, NO_SECTOR, NO_STATUS = (
    "Unknown", "Unknown Lender", "XX", "00000", "000000", "00", "UNKNOWN",
)


def _filled(name: str, filler) -> Column:
    return F.coalesce(F.col(name), F.lit(filler))


def _name(name: str, filler: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit(filler))


def _code_label(name: str, one: str, two: str) -> Column:
    code = F.col(name)
    return F.when(code == 1, one).when(code == 2, two).otherwise(B.UNKNOWN)


def _money(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("decimal(15,2)")


def clean(loans: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """One output row per loan: missing values filled, categories and vintages derived.

    Money NULLs become 0. ``is_defaulted`` and ``is_paid_in_full`` stay NULL while the
    outcome is unknown. The sector lookup has 24 rows, so it is always broadcast.
    """
    sectors = naics_codes(loans.sparkSession).select("naics_code", "sector_name")
    joined = loans.join(
        F.broadcast(sectors), F.substring("naics", 1, 2) == F.col("naics_code"), "left"
    )
    status, gross, approved = F.col("loan_status"), F.col("gross_approved"), F.col("approval_date")
    zero_pct = F.lit(0).cast("decimal(22,2)")
    severity = F.coalesce(B.calculate_guarantee_pct(_money("chargeoff_amount"), gross), zero_pct)
    guarantee = F.coalesce(B.calculate_guarantee_pct(_money("sba_approved"), gross), zero_pct)
    return joined.select(
        "loan_id",
        _name("business_name", NO_NAME).alias("business_name"),
        _name("city", NO_NAME).alias("city"),
        F.upper(_filled("state", NO_STATE)).alias("state"),
        F.substring(_filled("zip", NO_ZIP), 1, 5).alias("zip_5"),
        _name("bank_name", NO_LENDER).alias("bank_name"),
        F.upper(_filled("bank_state", NO_STATE)).alias("bank_state"),
        _filled("naics", NO_NAICS).alias("naics"),
        F.substring(_filled("naics", NO_SECTOR), 1, 2).alias("naics_sector"),
        _filled("sector_name", B.UNKNOWN).alias("industry_sector"),
        "approval_date",
        F.coalesce("approval_fy", F.year(approved)).alias("approval_fy"),
        "disbursement_date",
        "chargeoff_date",
        _filled("term_months", 0).alias("term_months"),
        B.term_category(F.col("term_months")).alias("term_category"),
        _filled("num_employees", 0).alias("num_employees"),
        B.business_size(F.col("num_employees")).alias("business_size"),
        _code_label("new_business", "Existing", "New").alias("business_type"),
        _filled("jobs_created", 0).alias("jobs_created"),
        _filled("jobs_retained", 0).alias("jobs_retained"),
        _code_label("urban_rural", "Urban", "Rural").alias("location_type"),
        (_filled("rev_line_of_credit", "N") == "Y").alias("is_revolving_line"),
        (_filled("low_doc", "N") == "Y").alias("is_low_doc"),
        *[
            _money(name).alias(name)
            for name in (
                "gross_approved", "sba_approved", "disbursement_gross", "balance_gross",
                "chargeoff_amount",
            )
        ],
        B.loan_size(gross, B.SIZE_ORDER[0]).alias("loan_size_bucket"),
        F.when(gross > 0, guarantee).otherwise(zero_pct).alias("sba_guarantee_pct"),
        _filled("loan_status", NO_STATUS).alias("loan_status"),
        (status == "CHGOFF").alias("is_defaulted"),
        (status == "PIF").alias("is_paid_in_full"),
        F.when((status == "CHGOFF") & (gross > 0), severity)
        .otherwise(zero_pct)
        .alias("loss_severity_pct"),
        F.year(approved).alias("vintage_year"),
        F.quarter(approved).alias("vintage_quarter"),
        F.month(approved).alias("vintage_month"),
        as_of_date(as_of).cast("timestamp").alias("processed_at"),
    )
