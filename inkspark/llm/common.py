"""What the operators of this subpackage share: written tables, bucketed numbering, salted counts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new temporary one only where that is unset and one machine does all."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="inkspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, so a lost executor costs no more than its own tasks.

    The write's shuffle files go as soon as it ends. compression: Parquet's codec, where the session's own isn't the one wanted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_cleared(spark):
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs run inside hand Python at most ``rows`` rows at once, so that neither side holds many whole texts; the session's own number comes back after."""
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextlib.contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside leave no shuffle files, which else stay until the driver happens to collect its garbage; for frames that are computed once, as a second run shuffles again."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8_bytes(text: str | Column) -> Column:
    """UTF-8 length, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def bucket_of(key: Column, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), n if isinstance(n, Column) else F.lit(n)).cast("int")


def hot_join(rows: DataFrame, keys: DataFrame, on: str, weight: str, hot: int = 10_000) -> DataFrame:
    """Inner join of written ``rows`` with written ``keys``, which hold each key once and in ``weight`` its number of rows.

    Keys with at least 1/hot of all rows - ``hot`` of them at most, whatever the data - are broadcast, so none of them is one task's work;
    the others are shuffled.
    """
    total = keys.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    heavy = F.broadcast(keys.where(F.col(weight) * hot >= total))
    light = keys.where(F.col(weight) * hot < total)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(on), on, "left_anti").join(light, on))


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str, buckets: int) -> DataFrame:
    """Number the rows of each group (columns without nulls) from 0 without gaps, however large a group is.

    A group is dealt into ``buckets`` by a hash of ``order``; a window numbers rows within a (group, bucket) only, and running
    sums of the bucket counts, in two levels of up to 1024 buckets each part, give every bucket its first number. The order is
    that of (bucket, ``order``): fixed by the rows, not by their partitions. Rows that tie in all of ``order`` may swap numbers.
    """
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(max(1, buckets))).cast("int"))
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", F.expr("_b div 1024"))
    before = lambda by, n, *of: F.coalesce(F.sum(n).over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))
    parts = parts.withColumn("_base", before("_part", "_n", *group)).drop("_n")
    first = counts.withColumn("_in", before("_b", "_n", *group, "_part")).join(parts, [*group, "_part"]).select(*group, "_b", (F.col("_base") + F.col("_in")).alias("_first"))
    inner = Window.partitionBy(*group, "_b").orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(inner) - F.lit(1))
    return rows.join(first, [*group, "_b"]).withColumn(out, (F.col("_first") + F.col("_r")).cast("long")).drop("_b", "_first", "_r")


def contracted(edges: DataFrame, passes: int) -> DataFrame:
    """The (a, b) long edges, a > b, after that many rounds of a large-star and a small-star pass: the same components, fewer steps to their smallest ids.

    Each pass is a shuffle whose groups are never gathered: a node's smallest neighbour is a partial aggregate, and the star is rewired by a join.
    Each round is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """large: link each neighbour above a node to the node's smallest; small: link those below, and the node."""
        if large:
            near = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = e
        low = near.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        joined = near.join(low, near.a == low.n).select("a", "b", "m")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") > F.col("b")).distinct()

    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    for _ in range(passes):
        e = written(star(star(e, True), False), "stars")
    return e


def roots_so_far(stars: DataFrame) -> DataFrame:
    """(id, root) of contracted edges: root is some id of the same component, the smallest one where that has settled; ids without a row are their own."""
    return stars.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of written (a, b) long edges: rows (id, root) for every id on an edge, root its smallest reachable id.

    Rounds of ``contracted`` end when one leaves the edges as they were.
    """
    seen, e = None, edges
    for _ in range(max_rounds):
        e = contracted(e, 1)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(ddl))
