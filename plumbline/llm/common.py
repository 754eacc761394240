"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Whole documents pass through Python workers, so a
#: batch is kept small enough for documents of a megabyte.
ARROW_ROWS = 256


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of an Arrow batch, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's spark.checkpoint.dir; only in a local session where that
    is unset, as in tests, is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: What new_path() gives inside alone() is noted here, to be deleted.
SCOPE: ContextVar[Tables | None] = ContextVar("scope", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if scope := SCOPE.get():
        scope.paths.append(path)
    return path


#: Spark deletes a query's shuffle files when it ends, not some time later when the driver collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, read again; nothing of the shuffles behind it stays on disk."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage is cut and a lost executor loses no rows."""
    return written(df, new_path(df.sparkSession, name))


class Tables:
    """Tables in the shared folder that are needed for a while only; all are deleted at the end of a with block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        return written(df, path)

    def delete(self, keep_last: int = 0) -> None:
        """Deletes all tables but the last few; nothing may read the others any more."""
        gone, self.paths = self.paths[: len(self.paths) - keep_last], self.paths[len(self.paths) - keep_last :]
        context = self.spark.sparkContext
        for path in gone:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.delete()


def alone(spark: SparkSession, make: Callable[[], DataFrame], name: str, into: Tables | None = None) -> DataFrame:
    """The rows of make() as one stored table (of `into`, if given); all else that it put into the shared folder is deleted."""
    path = new_path(spark, name)
    if into is not None:
        into.paths.append(path)
    with Tables(spark) as t:
        before = SCOPE.set(t)
        try:
            return written(make(), path)
        finally:
            SCOPE.reset(before)


def gathered(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.Table]:
    """Rows with up to about `most` characters of text at a time, one row at least."""
    held, size = [], 0
    for batch in batches:
        k = 0
        for j, n in enumerate(pc.utf8_length(batch.column(column)).to_pylist(), 1):
            size += n or 0
            if size >= most:
                held.append(batch.slice(k, j - k))
                yield pa.Table.from_batches(held)
                held, size, k = [], 0, j
        if k < batch.num_rows:
            held.append(batch.slice(k))
    if held:
        yield pa.Table.from_batches(held)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Smallest reachable id for every id that has an edge: (id, component), as `store` keeps it.

    Alternating large-star and small-star rounds; both are grouped minima
    (combined before the shuffle) followed by joins, so a node with very many
    edges is split by AQE like any other skewed join key. Edges with a null end
    are ignored. A chain of n nodes takes about log n rounds.
    """
    with Tables(edges.sparkSession) as t:
        now = t.stored(
            edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
            .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .distinct(),
            "edges",
        )

        def state(df: DataFrame):
            return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

        before = state(now)
        while before[0]:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = t.stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
            t.delete(keep_last=1)
            after = state(now)
            if after == before:
                break
            before = after
        found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        return store(found, "components")


#: Bits of a membership filter (4 MB, whatever the corpus), and of one of its parts.
FILTER_BITS, PART_BITS = 1 << 25, 1 << 15


def filter_bit(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def filter_parts(df: DataFrame, *columns: str) -> DataFrame:
    """A membership filter of the columns' values as (part, bits): at most 1024 rows of 4 KB, built by Spark."""
    bits = df.select(filter_bit(*columns).alias("h"))
    return bits.groupBy(F.floor(F.col("h") / PART_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("h") % PART_BITS).alias("bits"))


def marked(df: DataFrame, parts: DataFrame, *columns: str) -> DataFrame:
    """df with `maybe__`: whether a row's values may be in the filter. It is true for all that are, and for few others while the filter is not full.

    The filter is broadcast, which its fixed size allows. A full one marks more
    rows, which then go the way of those that are in it, and loses none.
    """
    kept = df.columns
    rows = df.withColumn("h__", filter_bit(*columns)).withColumn("part__", F.floor(F.col("h__") / PART_BITS))
    rows = rows.join(F.broadcast(parts.select(F.col("part").alias("part__"), F.col("bits").alias("bits__"))), "part__", "left")
    at = F.col("h__") % PART_BITS
    byte = F.conv(F.hex(F.substring("bits__", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(h__ % 8 as int))")) != 0
    return rows.select(*kept, F.coalesce(hit, F.lit(False)).alias("maybe__"))


def maybe_in(df: DataFrame, parts: DataFrame, *columns: str) -> DataFrame:
    """The rows of df that marked() marks."""
    return marked(df, parts, *columns).where("maybe__").drop("maybe__")


#: Parts that the members of one group are dealt to before they meet what is decided for the group.
SALTS = 16
#: A key with more than 1 / HEAVY of all rows meets its decision by broadcast.
HEAVY = 1000


def left_by(rows: DataFrame, decided: DataFrame, keys: list[str], many: str, total: int) -> DataFrame:
    """rows left-joined with decided, which has one row a key and `many`, the key's number of rows; the column many is dropped.

    Keys that hold more than 1 / HEAVY of the rows (`total` of them, so fewer
    than HEAVY keys) are broadcast, so no task gets a hot key; of the others only
    rows that may have a decision, by a filter of fixed size, are shuffled.
    """
    new = [c for c in decided.columns if c not in (*keys, many)]
    heavy = decided.where(F.col(many) * HEAVY > total).drop(many)
    light = decided.where(F.col(many) * HEAVY <= total).drop(many)
    first = rows.join(F.broadcast(heavy.withColumn("hot__", F.lit(True))), keys, "left")
    hot = first.where("hot__").drop("hot__")
    others = marked(first.where("hot__ IS NULL").select(*rows.columns), filter_parts(light, *keys), *keys)
    met = others.where("maybe__").drop("maybe__").join(light, keys, "left")
    alone = others.where("NOT maybe__").drop("maybe__")
    for c in new:
        alone = alone.withColumn(c, F.lit(None).cast(decided.schema[c].dataType))
    columns = [*rows.columns, *new]
    return hot.select(columns).unionByName(met.select(columns)).unionByName(alone.select(columns))
