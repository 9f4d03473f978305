"""Stored tables with versions, so that a load happens as a whole or not at all.

    <table>/data/load=<load>/rejected=false/<part>=...    rows of one load, never changed
    <table>/known/<load>/files, filters                   what is known of its files
    <table>/known/<load>/views/...                        state of report views up to this load, if kept
    <table>/versions/00000007                             which loads make up a version

A load writes to folders of its own, which no reader knows. Then the list of loads of the next
version is written under another name and moved to its own: that one step is the commit. Before
it readers see the old table, after it the new one, and whatever a killed load leaves behind is never
read (``remove_unused`` deletes it). The name of a version can be taken once only, so of
two loads that start from the same version the later one is refused (``LoadConflict``).

A list has one line per load, not per file; a load can carry a batch key, by which a repeated
batch is noticed. Per file, a Parquet table has the rows, the range of keys, the latest day and a
Bloom filter of the keys, all computed by Spark from the written key columns. ``may_hold`` joins a
batch with these, so that only files that can hold one of its keys are read.

The filter of a file has a power of two of blocks with 32,768 bits each, for at most
BLOCK_KEYS keys on average. A key belongs to one block and sets PROBES bits in it. A key that is stored
always finds its bits; another one finds them by chance in under one of 500 files, which costs a read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.sources.store import stored

DATA, KNOWN, VERSIONS = "data", "known", "versions"
BLOCK_BITS, BLOCK_KEYS, PROBES = 1 << 15, 1 << 11, 5
#: Keys of a batch that are looked up in every file: many times the 500 of which one is found by chance.
ASKED = 1 << 12

FILES = "file string, rows long, least string, most string, latest date, last_number long, blocks long"
FILTERS = "file string, blocks long, block long, least string, most string, bits binary"


class LoadConflict(RuntimeError):
    """Another load has published a version since this one read the table."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def _write(spark: SparkSession, path: str, text: str) -> None:
    files, where = _at(spark, path)
    out = files.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str:
    files, where = _at(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _move_if_free(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file its final name in one step; False if the name is taken.

    File contexts refuse a taken name (HDFS in one step). A local file gets a second name by a
    hard link instead, which is one step there too.
    """
    jvm = spark._jvm
    files, where = _at(spark, source)
    to = jvm.org.apache.hadoop.fs.Path(target)
    try:
        if files.getUri().getScheme() == "file":
            nio = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(
                nio.get(files.makeQualified(to).toUri()), nio.get(files.makeQualified(where).toUri())
            )
            files.delete(where, False)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                files.getUri(), spark._jsc.hadoopConfiguration()
            )
            no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(where, to, no_options)
    except Exception:
        if files.exists(to):
            files.delete(where, False)
            return False
        raise
    return True


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(_hash(key, 0), blocks)


def _bit(key: Column, probe: int) -> Column:
    return F.pmod(_hash(key, probe + 1), F.lit(BLOCK_BITS))


def _is_set(bits: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set; the lowest bit of a byte comes first."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


class Table:
    """A table as it is at one version; reads go on seeing that version whatever is loaded later."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, part: str, key: str, day: str, version: int | None = None
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema, self.part, self.key, self.day = schema, part, key, day
        known = [int(n) for n in _names(spark, f"{self.path}/{VERSIONS}") if n.isdigit()]
        self.version = max(known, default=0) if version is None else version
        self.loads: list[dict] = json.loads(_read(spark, self._version(self.version))) if self.version else []

    def _version(self, number: int) -> str:
        return f"{self.path}/{VERSIONS}/{number:08d}"

    def _data(self, load: str) -> str:
        return f"{self.path}/{DATA}/load={load}"

    # reading

    def _rows(self, loads: list[str], schema: T.StructType, rejected: bool = False) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], schema)
        folders = [T.StructField("load", T.StringType()), T.StructField("rejected", T.BooleanType())]
        read = self.spark.read.schema(T.StructType([*schema.fields, *folders])).option("basePath", f"{self.path}/{DATA}")
        rows = read.parquet(*[self._data(name) for name in loads])
        return rows.where(F.col("rejected") == rejected)

    def rows(self) -> DataFrame:
        """All rows of this version."""
        return self._rows([x["load"] for x in self.loads], self.schema).select(self.schema.names)

    def _known(self, what: str, schema: str, loads: list[str] | None = None) -> DataFrame:
        loads = [x["load"] for x in self.loads] if loads is None else loads
        if not loads:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{KNOWN}/{name}/{what}" for name in loads])

    def files(self) -> DataFrame:
        """One row per file: rows, range of keys, latest day, largest number in a key."""
        return self._known("files", FILES)

    def latest_day(self):
        return self.files().agg(F.max("latest")).first()[0]

    def last_number(self) -> int:
        """The largest number at the end of a key; 0 if there is none."""
        return self.files().agg(F.max("last_number")).first()[0] or 0

    def may_hold(self, keys: DataFrame) -> DataFrame:
        """The files (column file) that can hold one of the keys; keys: one column, named as in the table.

        A file whose range no key lies in is left out before the filters are read. Of a large batch about ASKED
        keys are looked up first, in every file: one stored key or one hit by chance names a file, so where keys and
        files share a range hardly any file is left. Only files left are asked for all keys, unless that
        takes more lookups than they have rows: then reading them costs less, and they count as files that can.
        So the work grows with keys and rows, never with keys times files.
        """
        keys = keys.select(F.col(self.key).alias("key"))
        n, least, most = keys.agg(F.count("key"), F.min("key"), F.max("key")).first()
        in_range = (F.col("least") <= F.lit(most)) & (F.col("most") >= F.lit(least))
        filters = self._known("filters", FILTERS).where(in_range)
        if n <= ASKED:
            return self._asked(keys, filters)
        few = keys.where(F.pmod(_hash(F.col("key"), PROBES + 1), F.lit(n // ASKED)) == 0).distinct()
        found = stored(self._asked(F.broadcast(few), filters), "files_found")
        left = self.files().where(in_range).join(found, "file", "left_anti").select("file", "rows")
        files, rows = left.agg(F.count("file"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if not files:
            return found
        names = left.select("file")
        if n * files <= rows:
            names = self._asked(keys, filters.join(names, "file", "left_semi"))
        return found.unionByName(names)

    def _asked(self, keys: DataFrame, filters: DataFrame) -> DataFrame:
        """The files whose filter has all bits of one of the keys that lie in their range."""
        sizes = [r[0] for r in filters.select("blocks").distinct().collect()]  # powers of two
        blocks = F.array(*[F.lit(n) for n in sizes]).cast("array<long>")
        placed = keys.select("key", F.explode(blocks).alias("blocks"))
        placed = placed.withColumn("block", _block(F.col("key"), F.col("blocks")))
        found = placed.join(filters, ["blocks", "block"]).where(F.col("key").between(F.col("least"), F.col("most")))
        for probe in range(PROBES):
            found = found.where(_is_set(F.col("bits"), _bit(F.col("key"), probe)))
        return found.select("file").distinct()

    def stored_keys(self, keys: DataFrame) -> DataFrame:
        """Those of the keys that the table has; only files that can hold one are read."""
        names = [f"{self.path}/{DATA}/{r.file}" for r in self.may_hold(keys).collect()]
        only_key = T.StructType([self.schema[self.key]])
        if not names:
            return self.spark.createDataFrame([], only_key)
        held = self.spark.read.schema(only_key).parquet(*names)
        return keys.select(self.key).distinct().join(held, self.key, "left_semi")

    # loading

    def has_batch(self, batch: str | None) -> bool:
        return batch is not None and any(x["batch"] == batch for x in self.loads)

    def write(self, rows: DataFrame) -> str:
        """Write the rows of a load (with a column ``rejected``) where no reader looks; its name."""
        load = uuid.uuid4().hex
        rows.hint("rebalance", "rejected", self.part).write.partitionBy("rejected", self.part).parquet(self._data(load))
        return load

    def written(self, load: str, rejected: bool = False) -> DataFrame:
        """What a load has written: its rows, or the rejected ones with their reasons."""
        reasons = T.StructField("rejected_reasons", T.ArrayType(T.StringType()))
        schema = T.StructType([*self.schema.fields, reasons]) if rejected else self.schema
        return self._rows([load], schema, rejected).drop("load", "rejected")

    def describe(self, load: str) -> None:
        """Store what ``files`` and ``may_hold`` need of a load, from its key and day."""
        narrow = T.StructType([self.schema[self.key], self.schema[self.day]])
        place = F.concat(F.lit(f"load={load}/"), F.substring_index("_metadata.file_path", f"/load={load}/", -1))
        keys = self._rows([load], narrow).select(
            place.alias("file"), F.col(self.key).alias("key"), F.col(self.day).alias("day")
        )
        number = F.regexp_extract("key", r"(\d+)$", 1).try_cast("bigint")
        folder = f"{self.path}/{KNOWN}/{load}"
        wanted = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") / BLOCK_KEYS)))
        (
            keys.groupBy("file")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.min("key").alias("least"),
                F.max("key").alias("most"),
                F.max("day").alias("latest"),
                F.max(number).alias("last_number"),
            )
            .withColumn("blocks", F.pow(F.lit(2), wanted).cast("long"))
            .write.parquet(f"{folder}/files")
        )
        files = self._known("files", FILES, [load]).select("file", "blocks", "least", "most")
        placed = keys.select("file", "key").join(files, "file").withColumn("block", _block(F.col("key"), F.col("blocks")))
        probes = F.array(*[_bit(F.col("key"), probe) for probe in range(PROBES)])
        (
            placed.select("file", "blocks", "block", "least", "most", F.explode(probes).alias("bit"))
            .groupBy("file", "blocks", "block", "least", "most")
            .agg(F.bitmap_construct_agg("bit").alias("bits"))
            .write.parquet(f"{folder}/filters")
        )

    def views(self, load: str | None = None) -> str | None:
        """Where a load keeps the state of report views; without a load, where this version has it, if it does."""
        if load is None:
            if not self.loads or not self.loads[-1].get("views"):
                return None
            load = self.loads[-1]["load"]
        return f"{self.path}/{KNOWN}/{load}/views"

    def publish(
        self, load: str, batch: str | None = None, replace: bool = False, views: bool = False
    ) -> int:
        """Make a load part of the table, or with ``replace`` all of it; the number of the version.

        ``views`` says that the load has written the state of report views, which is published with it.

        ``LoadConflict`` if there is a version after the one that this table was opened at.
        """
        loads = [] if replace else list(self.loads)
        loads.append({"load": load, "batch": batch, "views": views})
        staged = f"{self.path}/{VERSIONS}/.staged-{uuid.uuid4().hex}"
        _write(self.spark, staged, json.dumps(loads))
        if not _move_if_free(self.spark, staged, self._version(self.version + 1)):
            raise LoadConflict(f"{self.path} has had another load since version {self.version}; nothing is loaded")
        return self.version + 1

    def forget(self, load: str) -> None:
        """Delete what a refused load has written."""
        for folder in (self._data(load), f"{self.path}/{KNOWN}/{load}"):
            files, where = _at(self.spark, folder)
            files.delete(where, True)


def remove_unused(spark: SparkSession, path: str, keep: int = 2, younger_than_s: int = 7 * 86_400) -> list[str]:
    """Delete loads that none of the newest ``keep`` versions has, and older versions; the loads' names.

    Loads younger than the limit stay: they may be running, or be read at an older version.
    """
    path = path.rstrip("/")
    versions = sorted(n for n in _names(spark, f"{path}/{VERSIONS}") if n.isdigit())
    used = {x["load"] for n in versions[-keep:] for x in json.loads(_read(spark, f"{path}/{VERSIONS}/{n}"))}
    for n in versions[:-keep]:
        files, where = _at(spark, f"{path}/{VERSIONS}/{n}")
        files.delete(where, False)
    limit = spark._jvm.java.lang.System.currentTimeMillis() - 1000 * younger_than_s
    gone = []
    for name in _names(spark, f"{path}/{DATA}"):
        load = name.removeprefix("load=")
        files, where = _at(spark, f"{path}/{DATA}/{name}")
        if name.startswith("load=") and load not in used and files.getFileStatus(where).getModificationTime() <= limit:
            files.delete(where, True)
            files.delete(_at(spark, f"{path}/{KNOWN}/{load}")[1], True)
            gone.append(load)
    return gone
