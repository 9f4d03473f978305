"""Large CSV files with line breaks in quoted fields, read by many tasks.

Whether a line begins within quotes depends on all lines before it, so a task that reads the middle of a
file can't know. It speculates instead: of each line it learns where it ends if it began outside
quotes, and where if it began inside. A line either keeps the side, changes it, or ends on one side
whatever came before. Per block of the file, running counts of changes since the last line of the third kind
give both candidates: the side on which each line and the block end, and where the current
record begins. One row per block goes through a prefix over the file, which settles what holds.

Lines that begin and end outside are records. The others are put together by the place of
their first line, also over the borders of blocks. A record of more than LONGEST lines (a quote that
is never closed takes the rest of its file) is not put together: its lines are rejected one by one.

Quotes count as the row reader counts them: one opens a field only at the field's start, two within quotes
are one sign, and within other text they are plain signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.sources.store import stored

LONGEST = 1000
#: What an empty field without quotes is read as before it becomes NULL; no text of a file.
NOTHING = "\0nothing\0"

#: What a quote does to a side (0 plain text, 1 within quotes, 2 at a border: the start of a line or
#: just after a closing quote), given the text between it and the quote before.
_AT_QUOTE = """
aggregate(slice(parts, 1, size(parts) - 1), {start}, (side, part) ->
  CASE WHEN side = 1 THEN 2
       WHEN part LIKE '%,' OR (side = 2 AND part = '') THEN 1
       ELSE 0 END) = 1
"""


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with their file, block, place in it, and both sides on which they can end."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    lines = lines.withColumn("parts", F.split("line", '"', -1))
    return lines.select(
        "file",
        "block",
        "at",
        "line",
        F.expr(_AT_QUOTE.format(start=2)).alias("from_outside"),
        F.expr(_AT_QUOTE.format(start=1)).alias("from_inside"),
    )


def _side(start: Column | bool, changes: Column, fixed: Column) -> Column:
    """Whether one is within quotes after some lines: since the last fixed side, or since the start."""
    start = F.lit(start) if isinstance(start, bool) else start
    since = F.when(fixed.isNull(), changes).otherwise(changes - fixed["changes"])
    first = F.when(fixed.isNull(), start).otherwise(fixed["side"])
    return first != (since % 2 == 1)


def _running(rows: DataFrame, order: Window) -> DataFrame:
    """Adds changes and fixed (after each row), and those before it."""
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    changed = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    rows = rows.withColumn("changes", F.sum(changed).over(upto))
    side = F.when(
        F.col("from_outside") == F.col("from_inside"),
        F.struct(F.col("from_outside").alias("side"), F.col("changes").alias("changes")),
    )
    rows = rows.withColumn("fixed", F.last(side, ignorenulls=True).over(upto))
    return rows.withColumn("changes_before", F.coalesce(F.lag("changes").over(order), F.lit(0))).withColumn(
        "fixed_before", F.lag("fixed").over(order)
    )


def records(spark: SparkSession, paths, longest: int = LONGEST) -> DataFrame:
    """Columns file, first (of its file), record, broken (a line of a record that is too long)."""
    inner = Window.partitionBy("file", "block").orderBy("at")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = _running(_lines(spark, paths), inner)
    rows = rows.withColumn("first", (F.col("block") == 0) & (F.row_number().over(inner) == 1))
    for name, start in (("outside", False), ("inside", True)):
        before = _side(start, F.col("changes_before"), F.col("fixed_before"))
        after = _side(start, F.col("changes"), F.col("fixed"))
        begin = F.last(F.when(~before, F.col("at")), ignorenulls=True).over(upto)
        rows = rows.withColumn(name, F.struct(before.alias("before"), after.alias("after"), begin.alias("begin")))
    rows = stored(rows.select("file", "block", "at", "line", "first", "outside", "inside"), "quoted_lines")

    last = rows.groupBy("file", "block").agg(F.max_by(F.struct("outside", "inside"), "at").alias("end"))
    blocks = last.select(
        "file",
        "block",
        F.col("end.outside.after").alias("from_outside"),
        F.col("end.inside.after").alias("from_inside"),
        F.col("end.outside.begin").alias("begin_outside"),
        F.col("end.inside.begin").alias("begin_inside"),
    )
    along = Window.partitionBy("file").orderBy("block")
    blocks = _running(blocks, along)
    blocks = blocks.withColumn("starts", _side(False, F.col("changes_before"), F.col("fixed_before")))
    begin = F.when(F.col("starts"), F.col("begin_inside")).otherwise(F.col("begin_outside"))
    here = F.when(begin.isNotNull(), F.struct(F.col("block").alias("block"), begin.alias("at")))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(
        blocks.select("file", "block", "starts", F.last(here, ignorenulls=True).over(earlier).alias("open")),
        "quoted_blocks",
    )

    rows = rows.join(blocks, ["file", "block"])
    held = F.when(F.col("starts"), F.col("inside")).otherwise(F.col("outside"))
    rows = rows.withColumn("held", held).select(
        "file",
        "block",
        "at",
        "line",
        "first",
        (F.col("held.before") | F.col("held.after")).alias("part"),
        F.when(F.col("held.begin").isNull(), F.col("open"))
        .otherwise(F.struct(F.col("block").alias("block"), F.col("held.begin").alias("at")))
        .alias("begin"),
    )
    whole = rows.where(~F.col("part")).select("file", "first", "line", F.lit(False).alias("broken"))
    parts = rows.where("part")
    sizes = parts.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("lines"))
    parts = parts.join(sizes, ["file", "begin"])
    joined = (
        parts.where(F.col("lines") <= longest)
        .groupBy("file", "begin")
        .agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("lines"), F.max("first").alias("first"))
        .select("file", "first", F.array_join("lines.line", "\n").alias("line"), F.lit(False).alias("broken"))
    )
    broken = parts.where(F.col("lines") > longest).select("file", "first", "line", F.lit(True).alias("broken"))
    found = whole.union(joined).union(broken)
    record = F.regexp_replace("line", "\r$", "")
    return found.select("file", "first", record.alias("record"), "broken").where("record <> ''")


def read_quoted(spark: SparkSession, paths, schema: T.StructType, raw_line: str, longest: int = LONGEST) -> DataFrame:
    """The fields of all records but headers, the file, and ``raw_line``: a record that is not whole.

    A header with other names or another order is an error.
    """
    full = T.StructType([*schema.fields, T.StructField(raw_line, T.StringType())])
    options = {"escape": '"', "nullValue": NOTHING, "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw_line}
    declared = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.fields)
    rows = records(spark, paths, longest).withColumn("row", F.from_csv("record", declared, options))
    names = F.lower(F.concat_ws(",", *[F.col(f"row.{f.name}") for f in schema.fields]))
    wrong = F.raise_error(F.concat(F.lit("CSV header does not conform to the schema: "), F.col("record"))).cast("boolean")
    right = (names == ",".join(schema.names).lower()) & F.col(f"row.{raw_line}").isNull()
    header = F.when(right, F.lit(False)).otherwise(wrong)
    rows = rows.where(F.when(F.col("first"), header).otherwise(F.lit(True)))
    raw = F.when(F.col("broken"), F.col("record")).otherwise(F.col(f"row.{raw_line}"))
    return rows.select("file", *[F.col(f"row.{f.name}") for f in schema.fields], raw.alias(raw_line))
