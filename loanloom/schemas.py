"""Declared schemas. CSV and Parquet are always read with one of these, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

# Header of the raw loan files, in file order; every field is text.
STAGING_COLUMNS = """
asofdate program l2locid borrname borrstreet borrcity borrstate borrzip bankname
bankfdicnumber bankncuanumber bankstreet bankcity bankstate bankzip grossapproval
sbaguaranteedapproval approvaldate approvalfiscalyear firstdisbursementdate
processingmethod subprogram initialinterestrate fixedorvariableinterestind
terminmonths naicscode naicsdescription franchisecode franchisename projectcounty
projectstate sbadistrictoffice congressionaldistrict businesstype businessage
loanstatus paidinfulldate chargeoffdate grosschargeoffamount revolverstatus
jobssupported collateralind soldsecmrktind
""".split()

STAGING = T.StructType([T.StructField(name, T.StringType()) for name in STAGING_COLUMNS])

_TEXT, _INT, _DAY, _TIME = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampType()
_MONEY = T.DecimalType(15, 2)

# The typed loan table, in column order.
LOANS = T.StructType(
    [
        T.StructField("loan_id", _TEXT, nullable=False),
        T.StructField("business_name", _TEXT),
        T.StructField("city", _TEXT),
        T.StructField("state", _TEXT),
        T.StructField("zip", _TEXT),
        T.StructField("bank_name", _TEXT),
        T.StructField("bank_state", _TEXT),
        T.StructField("naics", _TEXT),
        T.StructField("approval_date", _DAY),
        T.StructField("approval_fy", _INT),
        T.StructField("disbursement_date", _DAY),
        T.StructField("term_months", _INT),
        T.StructField("num_employees", _INT),
        T.StructField("new_business", _INT),
        T.StructField("jobs_created", _INT),
        T.StructField("jobs_retained", _INT),
        T.StructField("franchise_code", _TEXT),
        T.StructField("urban_rural", _INT),
        T.StructField("rev_line_of_credit", _TEXT),
        T.StructField("low_doc", _TEXT),
        T.StructField("gross_approved", _MONEY),
        T.StructField("sba_approved", _MONEY),
        T.StructField("disbursement_gross", _MONEY),
        T.StructField("balance_gross", _MONEY),
        T.StructField("loan_status", _TEXT),
        T.StructField("chargeoff_date", _DAY),
        T.StructField("chargeoff_amount", _MONEY),
        T.StructField("created_at", _TIME),
        T.StructField("updated_at", _TIME),
    ]
)


def as_loans(df: DataFrame) -> DataFrame:
    """Project and cast to the declared loan table; columns that are missing become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOANS.fields
        ]
    )


def schema_report(df: DataFrame, table_name: str) -> DataFrame:
    """One row per column of a table, in column order: type and nullability."""
    rows = [
        (table_name, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO")
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, column_name string, data_type string, is_nullable string"
    )
