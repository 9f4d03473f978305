"""Loans derived from the order tables of a star schema.

The order data has no loan table; one order becomes one loan, and the other tables fill the
lender, borrower and outcome fields. All dates move 14 years on.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loanloom.dimensions import SECTOR_CODES
from loanloom.schemas import STAGING_COLUMNS, as_loans

SHIFT_MONTHS = 168

# State and sector codes by position.
STATE_CODES = "CA TX FL NY GA OH IL WA NJ PA NV MT AK ND VT ME AL MI MN CO AZ NC PR ZZ".split()
SECTORS = "72 44 23 81 54 62 31 42 56 48 33 45 32 53 71 51 11 61 52 49 21 22 55 92".split()
assert set(SECTORS) == set(SECTOR_CODES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(codes: list[str], index: Column) -> Column:
    """Code at a 0-based position, NULL outside the list."""
    return F.get(F.array(*[F.lit(c) for c in codes]), index.cast("int"))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _shifted(day: Column) -> Column:
    return F.add_months(day.cast("date"), SHIFT_MONTHS)


def _cents(value: Column) -> Column:
    return value.cast("decimal(15,2)")


def loans_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed loan table.

    Lines are summed per order before the join. The lender is the supplier with the least key
    among the lines; every fifth order, and one without lines, has one of the first eight, so
    that some lenders are large. Lenders are as many as suppliers, so Spark picks the join by their size.
    """
    k = F.col("o_orderkey")
    lines = (
        _table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
            F.sum("l_quantity").cast("int").alias("quantity"),
            F.min("l_suppkey").alias("first_supplier"),
        )
    )
    lenders = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    first = F.col("first_supplier")
    few = (k % 5 == 0) | first.isNull()
    lender = F.when(few, F.coalesce(first, k) % 8).otherwise(first)
    joined = (
        _table(spark, sf_dir, "orders")
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(lines, k == F.col("l_orderkey"), "left")
        .join(lenders, lender == F.col("s_suppkey"), "left")
    )
    customer, nation = F.col("o_custkey"), F.col("c_nationkey")
    slot = k % 26
    approved = _shifted(F.col("o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "F", "PIF").when(
        F.col("o_orderstatus") == "P", F.when(k % 3 == 0, "CHGOFF").otherwise("PIF")
    )
    gross = F.when(k % 101 != 0, _cents(F.col("o_totalprice")) * (k % 5 + 1).cast("decimal(2,0)"))
    guaranteed = F.when(k % 103 == 0, gross * Decimal("1.1")).otherwise(
        gross * ((k % 13) * 5 + 40).cast("decimal(3,0)") * Decimal("0.01")
    )
    charged_off = status == "CHGOFF"
    return as_loans(
        joined.select(
            F.format_string("SBA-%08d", k).alias("loan_id"),
            F.when(k % 97 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("business_name"),
            F.col("c_mktsegment").alias("city"),
            _pick(STATE_CODES, _div(nation * nation, 25)).alias("state"),
            F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("zip"),
            F.col("s_name").alias("bank_name"),
            _pick(STATE_CODES, _div(F.col("s_nationkey") * F.col("s_nationkey"), 25)).alias(
                "bank_state"
            ),
            F.concat(_pick(SECTORS, _div(slot * slot, 26)), F.lit("1110")).alias("naics"),
            approved.alias("approval_date"),
            (F.year(approved) + (F.month(approved) >= 10).cast("int")).alias("approval_fy"),
            _shifted(F.col("first_ship")).alias("disbursement_date"),
            F.when(k % 89 != 0, (k % 50 + 1) * 6).alias("term_months"),
            F.col("quantity").alias("num_employees"),
            F.when(customer % 11 != 0, customer % 2 + 1).alias("new_business"),
            _div(F.col("quantity"), 2).alias("jobs_created"),
            _div(F.col("quantity"), 2).alias("jobs_retained"),
            F.when(customer % 11 != 0, customer % 3).alias("urban_rural"),
            F.when(k % 4 == 0, "Y").otherwise("N").alias("rev_line_of_credit"),
            F.when(k % 7 == 0, "Y").otherwise("N").alias("low_doc"),
            _cents(gross).alias("gross_approved"),
            _cents(guaranteed).alias("sba_approved"),
            _cents(gross).alias("disbursement_gross"),
            status.alias("loan_status"),
            F.when(charged_off, _shifted(F.col("last_ship"))).alias("chargeoff_date"),
            F.when(
                charged_off, _cents(gross * (k % 11).cast("decimal(2,0)") * Decimal("0.1"))
            ).alias("chargeoff_amount"),
        )
    )


def staging_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders as raw text rows, as they would stand in the loan files.

    The fields vary in form, and some are unusable, so that each import rule has rows.
    """
    k = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders").join(
        _table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    day = _shifted(F.col("o_orderdate"))
    gross = _cents(F.col("o_totalprice"))
    n = k % 23

    def cycle(index: Column, values: list[str | None]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))

    def day_text(d: Column, turn: Column) -> Column:
        return (
            F.when(turn == 0, F.date_format(d, "M/d/yyyy"))
            .when(turn == 1, F.date_format(d, "MM/dd/yyyy"))
            .when(turn == 2, F.concat(d.cast("string"), F.lit("T00:00")))
            .when(turn == 3, F.date_format(d, "M/d/yy"))
            .when(turn == 4, F.lit("13/45/2020"))
            .otherwise(d.cast("string"))
        )

    def money_text(amount: Column, turn: Column) -> Column:
        return (
            F.when(turn == 0, F.concat(F.lit("$"), F.format_number(amount, 2)))
            .when(turn == 1, F.concat(F.lit("-"), amount.cast("string")))
            .when(turn == 2, F.lit("1.2.3"))
            .when(turn == 3, F.lit("$"))
            .when(turn == 4, F.lit("0"))
            .otherwise(amount.cast("string"))
        )

    filled = {
        "asofdate": F.lit("12/31/2025"),
        "program": F.lit("7A"),
        "l2locid": F.when(k % 211 == 0, F.lit("  ")).when(
            k % 199 != 0, (k % 997).cast("string")
        ),
        "borrname": F.concat(F.lit("  "), F.col("c_name"), F.lit(', "Sons" & Co ')),
        "borrstreet": F.concat((k % 500).cast("string"), F.lit(" Main St, Unit 2")),
        "borrcity": F.col("c_mktsegment"),
        "borrstate": F.when(k % 31 != 0, F.lower(cycle(k, STATE_CODES))),
        "borrzip": F.lpad(F.col("c_custkey").cast("string"), 9, "0"),
        "bankname": F.concat(F.lit("Bank "), _div(F.col("c_custkey"), 7).cast("string")),
        "bankstate": cycle(k * 3, STATE_CODES),
        "grossapproval": money_text(gross, k % 29),
        "sbaguaranteedapproval": money_text(_cents(gross * Decimal("0.75")), k % 37),
        "approvaldate": day_text(day, k % 17),
        "approvalfiscalyear": F.when(k % 41 == 0, F.lit("FY20")).otherwise(
            F.year(day).cast("string")
        ),
        "firstdisbursementdate": day_text(F.date_add(day, 30), k % 19),
        "processingmethod": cycle(k, ["LowDoc", "Preferred Lender", "a Low Doc loan", None]),
        "terminmonths": F.when(n == 0, "0").when(n == 1, "-3").when(n == 2, "84.6")
        .when(n == 3, "x").otherwise((k % 300).cast("string")),
        "naicscode": F.concat(cycle(k, SECTORS), F.lit("111099")),
        "franchisecode": cycle(k, ["", "  ", "S123456789012", None]),
        "projectstate": F.lit("tx"),
        "businessage": cycle(
            k,
            ["New Business or 2 years", "Existing", "1.5", "2.5", "Unanswered", "3 years",
             "STARTUP", " new ", "Existing or more than 2 years old", None],
        ),
        "loanstatus": cycle(
            k,
            ["PIF", "Paid in Full", "EXEMPT", "CHGOFF", "Charged Off", "COMMIT", "CANCLD",
             "p i f", None],
        ),
        "chargeoffdate": F.when(k % 9 == 3, day_text(F.date_add(day, 700), k % 13)),
        "grosschargeoffamount": money_text(_cents(gross * Decimal("0.3")), k % 7),
        "revolverstatus": cycle(k, ["Y", "N", "yes", "1", "0", None]),
        "jobssupported": F.when(n == 5, "7.0").when(n == 6, "20000").when(n == 7, "-4")
        .otherwise((k % 120).cast("string")),
    }
    return orders.select(
        k.alias("source_key"),
        *[filled.get(c, F.lit(None)).cast("string").alias(c) for c in STAGING_COLUMNS],
    )
