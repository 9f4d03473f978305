"""Raw loan files -> checked, typed loan table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from loanloom.functions import parsing as P
from loanloom.functions.dates import as_of_date
from loanloom.functions.numeric import mean, ratio, share_of
from loanloom.operators.numbering import numbered
from loanloom.plans import view_state
from loanloom.schemas import LOANS, STAGING, STAGING_COLUMNS, as_loans
from loanloom.sources.quoted_csv import read_quoted
from loanloom.sources.store import stored
from loanloom.sources.versions import LoadConflict, Table

ID_ORDER = ("approvalfiscalyear", "approvaldate", "borrname")
# The raw columns that the import uses.
PARSED_COLUMNS = """
l2locid borrname borrcity borrstate projectstate borrzip bankname bankstate naicscode approvaldate
approvalfiscalyear firstdisbursementdate terminmonths jobssupported businessage franchisecode
revolverstatus processingmethod grossapproval sbaguaranteedapproval loanstatus chargeoffdate
grosschargeoffamount
""".split()


#: Where a raw row that does not have one value per column is kept, as it stands in the file.
RAW_LINE = "raw_line"


def _parsed() -> Column:
    """Always true; names a field, since Spark refuses queries on the raw line alone."""
    return F.coalesce(F.length(STAGING_COLUMNS[0]), F.lit(0)) >= 0


def _raw_csv(spark: SparkSession, paths, multi_line: bool) -> DataFrame:
    return (
        spark.read.schema(T.StructType([*STAGING.fields, T.StructField(RAW_LINE, T.StringType())]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW_LINE)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("encoding", "UTF-8")
        .option("nullValue", None)
        .option("emptyValue", "")
        .csv(paths)
    )


def read_raw_csv(spark: SparkSession, paths, multi_line: bool = False) -> DataFrame:
    """Read the raw files as text: header, doubled quotes, an unquoted empty field is NULL.

    A header with other names or another order is an error. Rows with too few or too many
    fields are left out; ``rejected_raw_rows`` returns them. Large files are split. A quoted
    line break makes its row two rejected ones, unless ``multi_line`` is set, which reads each
    file in one task; ``read_quoted_csv`` reads such files by many tasks.
    """
    raw = _raw_csv(spark, paths, multi_line)
    return raw.filter(F.col(RAW_LINE).isNull() & _parsed()).drop(RAW_LINE)


def rejected_raw_rows(spark: SparkSession, paths, multi_line: bool = False) -> DataFrame:
    """The rows ``read_raw_csv`` leaves out: the file and folder, first field, and whole line."""
    raw = _raw_csv(spark, paths, multi_line).filter(F.col(RAW_LINE).isNotNull() & _parsed())
    path = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(
        F.element_at(path, -2).alias("folder"),
        F.element_at(path, -1).alias("file"),
        F.col(STAGING_COLUMNS[0]),
        F.col(RAW_LINE),
    )


def read_quoted_csv(spark: SparkSession, paths) -> DataFrame:
    """The same rows as ``read_raw_csv`` with ``multi_line``, large files split between tasks.

    Costs one stored copy and one shuffle of the lines. A quote that is never closed takes the rest of
    its file there; here a record of over ``quoted_csv.LONGEST`` lines is rejected line by line.
    """
    raw = read_quoted(spark, paths, STAGING, RAW_LINE)
    return raw.filter(F.col(RAW_LINE).isNull()).select(*STAGING_COLUMNS)


def rejected_quoted_rows(spark: SparkSession, paths) -> DataFrame:
    """The rows ``read_quoted_csv`` leaves out: the file and folder, first field, and whole record."""
    raw = read_quoted(spark, paths, STAGING, RAW_LINE).filter(F.col(RAW_LINE).isNotNull())
    path = F.split("file", "/")
    return raw.select(
        F.element_at(path, -2).alias("folder"),
        F.element_at(path, -1).alias("file"),
        F.col(STAGING_COLUMNS[0]),
        F.col(RAW_LINE),
    )


def write_raw_csv(staging: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write text rows in the layout ``read_raw_csv`` reads."""
    writer = staging.write.option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer = writer.option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)


def count_by_source(raw: DataFrame, folders: bool = False) -> DataFrame:
    """Rows per input file, or per folder of files, with the total of all."""
    path = F.split(F.col("_metadata.file_path"), "/")
    source = F.element_at(path, -2 if folders else -1)
    counts = raw.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("row_count"))
    everything = F.sum("row_count").over(Window.partitionBy())
    return counts.withColumn("total_rows", everything).orderBy("source")


def _typed() -> dict[str, Column]:
    c = F.col
    gross = P.parse_money(c("grossapproval"))
    return {
        "business_name": P.trimmed(c("borrname"), 255),
        "city": P.trimmed(c("borrcity"), 100),
        "state": P.code2(F.coalesce("borrstate", "projectstate")),
        "zip": P.trimmed(c("borrzip"), 10),
        "bank_name": P.trimmed(c("bankname"), 255),
        "bank_state": P.code2(c("bankstate")),
        "naics": P.trimmed(c("naicscode"), 6),
        "approval_date": P.parse_date(c("approvaldate")),
        "approval_fy": P.parse_year(c("approvalfiscalyear")),
        "disbursement_date": P.parse_date(c("firstdisbursementdate")),
        "term_months": P.parse_term(c("terminmonths")),
        "num_employees": P.parse_employees(c("jobssupported")),
        "new_business": P.parse_business_age(c("businessage")),
        "jobs_created": P.split_jobs(c("jobssupported")),
        "jobs_retained": P.split_jobs(c("jobssupported")),
        "franchise_code": F.nullif(P.trimmed(c("franchisecode"), 10), F.lit("")),
        "urban_rural": F.lit(0),
        "rev_line_of_credit": P.parse_yes(c("revolverstatus")),
        "low_doc": P.parse_low_doc(c("processingmethod")),
        "gross_approved": gross,
        "sba_approved": P.parse_money(c("sbaguaranteedapproval")),
        "disbursement_gross": gross,
        "loan_status": P.map_status(c("loanstatus")),
        "chargeoff_date": P.parse_date(c("chargeoffdate")),
        "chargeoff_amount": P.parse_money(c("grosschargeoffamount")),
    }


def usable_rows(staging: DataFrame) -> DataFrame:
    """Raw rows with a location id; the others are not loans."""
    return staging.filter(F.trim("l2locid") != "")


def parse_loans(staging: DataFrame, *keep: str) -> DataFrame:
    """The typed columns of the usable rows, one narrow projection, without ids."""
    return usable_rows(staging).select(*keep, *[v.alias(k) for k, v in _typed().items()])


def parse_failures(staging: DataFrame) -> DataFrame:
    """Per parsed field: how many filled-in texts the rules turned into NULL."""
    fields = {
        "approval_date": "approvaldate",
        "approval_fy": "approvalfiscalyear",
        "disbursement_date": "firstdisbursementdate",
        "term_months": "terminmonths",
        "num_employees": "jobssupported",
        "new_business": "businessage",
        "gross_approved": "grossapproval",
        "sba_approved": "sbaguaranteedapproval",
        "chargeoff_date": "chargeoffdate",
        "chargeoff_amount": "grosschargeoffamount",
    }
    typed = _typed()
    lost = [
        F.count_if(F.col(text).isNotNull() & typed[name].isNull()).alias(name)
        for name, text in fields.items()
    ]
    return (
        usable_rows(staging)
        .agg(*lost)
        .unpivot([], list(fields), "column_name", "unparsed_count")
        .orderBy("column_name")
    )


def loan_id(number: Column) -> Column:
    """Id of a loan: at least eight digits, more once the numbers need them."""
    return F.format_string("SBA-%08d", number)


def next_number(loans: DataFrame) -> Column:
    """The number after the largest one in the ids of a table; 1 for an empty table."""
    number = F.regexp_extract("loan_id", r"^SBA-(\d+)$", 1).try_cast("bigint")
    return F.coalesce(loans.agg(F.max(number)).scalar(), F.lit(0)) + 1


def _with_ids(rows: DataFrame, first: Column | int = 1) -> DataFrame:
    ids = numbered(rows, ID_ORDER, "_number")
    first = first if isinstance(first, Column) else F.lit(first)
    return ids.withColumn("loan_id", loan_id(F.col("_number") + first - 1)).drop("_number")


def assign_loan_id(staging: DataFrame, first: Column | int = 1) -> DataFrame:
    """Give each usable row an id, numbered by the texts of year, date and borrower."""
    return _with_ids(usable_rows(staging), first)


def import_loans(
    staging: DataFrame, as_of: dt.date | None = None, first: Column | int = 1
) -> DataFrame:
    """The typed loan table of a set of raw rows; ``next_number`` gives ``first`` of a later batch.

    The raw rows are numbered first, with only the columns that are parsed, and parsed after
    the shuffle: one stored copy on the way, and nothing is parsed twice.
    """
    now = as_of_date(as_of).cast("timestamp")
    rows = _with_ids(usable_rows(staging.select(*PARSED_COLUMNS)), first)
    loans = rows.select("loan_id", *[v.alias(k) for k, v in _typed().items()])
    return as_loans(loans.withColumn("created_at", now).withColumn("updated_at", now))


def _one_of(name: str, *allowed) -> Column:
    return ~F.col(name).isin(*allowed)


def constraints() -> dict[str, Column]:
    """Violations by name (fixed values). A NULL value satisfies every constraint."""
    return {
        "chk_loan_status": _one_of("loan_status", "PIF", "CHGOFF"),
        "chk_new_business": _one_of("new_business", 1, 2),
        "chk_urban_rural": _one_of("urban_rural", 0, 1, 2),
        "chk_rev_line": _one_of("rev_line_of_credit", "Y", "N"),
        "chk_low_doc": _one_of("low_doc", "Y", "N"),
        "chk_gross_approved_positive": F.col("gross_approved") < 0,
        "chk_sba_approved_positive": F.col("sba_approved") < 0,
        "chk_term_positive": F.col("term_months") <= 0,
    }


def validate_constraints(loans: DataFrame) -> DataFrame:
    """Add ``rejected_reasons``: the names of the violated constraints, empty for a good row."""
    names = [F.when(broken, F.lit(name)) for name, broken in constraints().items()]
    return loans.withColumn("rejected_reasons", F.array_compact(F.array(*names)))


def split_valid(loans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and quarantined rows with their reasons."""
    checked = validate_constraints(loans)
    good = F.size("rejected_reasons") == 0
    return checked.filter(good).drop("rejected_reasons"), checked.filter(~good)


def check_unique(df: DataFrame, key: str = "loan_id") -> DataFrame:
    """Keys that occur more than once."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("duplicate_count"))
    return counts.filter("duplicate_count > 1")


def _refuse(ids: DataFrame, what: str) -> None:
    found = [r[0] for r in ids.select("loan_id").limit(5).collect()]
    if found:
        raise ValueError(f"{what}, for example {', '.join(map(str, found))}")


def loan_table(spark: SparkSession, path: str, version: int | None = None) -> Table:
    """The stored loans at their newest version, or at an older one."""
    return Table(spark, path, LOANS, part="approval_fy", key="loan_id", day="approval_date", version=version)


def read_loans(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The loans that the newest version has (or an older one, while it is kept)."""
    return loan_table(spark, path, version).rows()


def write_loans(
    loans: DataFrame,
    path: str,
    mode: str = "overwrite",
    batch: str | None = None,
    table: Table | None = None,
    views: bool | None = None,
) -> DataFrame:
    """Store the loans that satisfy the constraints by fiscal year; the others are returned.

    All of it is published in one step, as the next version: readers see the old table or the new one, also
    if the load is stopped at any point. Nothing is published if an id is missing, occurs twice or
    (with mode "append") is stored already, or if another load was published since ``table`` was opened.
    The rows are written once; ids are checked in what is written.

    ``views`` keeps the state of the report views with the table (``plans.view_state``); a table that
    has it keeps it, unless told otherwise. Rows and state become visible in the same step.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode {mode}")
    table = table or loan_table(loans.sparkSession, path)
    checked = validate_constraints(as_loans(loans))
    load = table.write(checked.withColumn("rejected", F.size("rejected_reasons") > 0))
    good = table.written(load)
    try:
        _refuse(good.filter("loan_id IS NULL"), "loans without an id")
        _refuse(check_unique(good), "ids that occur twice")
        if mode == "append":
            _refuse(table.stored_keys(good), "ids stored already")
        table.describe(load)
        keep = table.views() is not None if views is None else views
        if keep:
            view_state.extend(table, load, good, replace=mode == "overwrite")
        table.publish(load, batch, replace=mode == "overwrite", views=keep)
    except (ValueError, LoadConflict):
        table.forget(load)
        raise
    return table.written(load, rejected=True)


def newer_loans(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming loans approved after the latest stored day; all of them if nothing is stored."""
    latest = existing.agg(F.max("approval_date")).scalar()
    return incoming.filter(latest.isNull() | (F.col("approval_date") > latest))


def incremental_load(
    spark: SparkSession, incoming: DataFrame, path: str, batch: str | None = None
) -> DataFrame:
    """Append the newer loans to a stored table; those that break a constraint are returned.

    The latest stored day is known per file, and only files that can hold one of the new ids are
    read. Nothing is loaded if an id is missing, occurs twice or is stored already; ``next_number``
    of the stored table gives ids that go on from it. A load that was published meanwhile makes
    this one fail with ``LoadConflict``; it can then be run again. A batch whose key the table has
    taken in before adds nothing and returns no rows.
    """
    table = loan_table(spark, path)
    loans = as_loans(incoming)
    if table.has_batch(batch):
        return validate_constraints(loans).limit(0)
    latest = table.latest_day()
    newer = loans if latest is None else loans.filter(F.col("approval_date") > F.lit(latest))
    return write_loans(newer, path, "append", batch, table)


def _sample_key(seed: int) -> Column:
    """A random hash per id; a loan without one is known by its borrower, day and amount."""
    other = ("business_name", "zip", "approval_date", "gross_approved")
    known = F.coalesce(
        "loan_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in other])
    )
    return F.md5(F.concat(F.lit(str(seed)), known))


def sample_loans(loans: DataFrame, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Exactly ``n`` loans (all if there are fewer), random but the same for the same seed.

    The order is that of a hash of seed and id. From the number of loans (file footers, for a stored table)
    follows a bound that just above ``n`` hashes lie below; the loans below it are stored in one read, and
    only these are sorted. If they are fewer than ``n``, which takes many loans that share an id, the bound is
    raised and the loans are read again, so that there are exactly ``n`` whatever the ids.
    """
    keyed = loans.withColumn("_key", _sample_key(seed))
    share = (n + 6 * n**0.5 + 100) / max(1, loans.count())  # six deviations above n
    while True:
        below = F.col("_key") < f"{int(share * 2**64):016x}" if share < 1 else F.lit(True)
        chosen = stored(keyed.filter(below), "sample")
        if share >= 1 or chosen.count() >= n:
            break
        share *= 8
    whole_row = F.xxhash64(*[F.col(c) for c in loans.columns])
    return chosen.orderBy("_key", F.col("loan_id").asc_nulls_last(), whole_row).limit(n).drop("_key")


def import_report(loans: DataFrame) -> DataFrame:
    """One row of figures on a loaded table."""
    billion = F.lit(10**9)
    positive = {
        c: F.when(F.col(c) > 0, F.col(c))
        for c in ("chargeoff_amount", "gross_approved", "term_months")
    }
    return loans.agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.min("approval_fy").alias("first_fiscal_year"),
        F.max("approval_fy").alias("last_fiscal_year"),
        F.countDistinct("state").alias("states_with_loans"),
        ratio(F.sum("gross_approved"), billion).alias("approved_billions"),
        ratio(F.sum("sba_approved"), billion).alias("guaranteed_billions"),
        ratio(F.sum(positive["chargeoff_amount"]), billion).alias("chargeoff_billions"),
        mean(positive["gross_approved"], 0).alias("avg_loan_size"),
        mean(positive["term_months"], 0).alias("avg_term_months"),
    )


def import_status_report(loans: DataFrame) -> DataFrame:
    """Loans per status with their share; NULL is shown as active."""
    return (
        loans.groupBy("loan_status")
        .agg(F.count(F.lit(1)).alias("loan_count"))
        .select(
            F.coalesce("loan_status", F.lit("ACTIVE/PENDING")).alias("status"),
            "loan_count",
            share_of("loan_count", Window.partitionBy()).alias("pct_of_total"),
        )
        .orderBy(F.desc("loan_count"), "status")
    )
