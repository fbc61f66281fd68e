"""The corpus pipeline over the smallest tables."""

import os
import time

from pyspark.sql import functions as F

import corpus_pipeline as P
from inkspark.llm import decontaminate, minhash_dedup
from inkspark.llm.common import written
from tests.oracle import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (name, stage) in enumerate(P.STAGES):
        docs = written(stage(spark, docs, SF), name)
        kept.append(docs)
        assert set(columns) <= set(docs.columns) and (docs.columns == columns or i == len(P.STAGES) - 1)
    identified, unique, clean, mixed, sharded = kept[1:]
    assert identified.count() >= 0.97 * kept[0].count()
    assert minhash_dedup.classes(unique).where("id <> class_id").count() == 0
    assert unique.count() == minhash_dedup.classes(identified).select("class_id").distinct().count()
    tests = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.digest(clean, tests).where("n_hit > 0").count() == 0 and 0 < clean.count() < unique.count()
    assert mixed.select("doc_id").distinct().count() == clean.count() <= mixed.count()
    sizes = [r["count"] for r in sharded.groupBy("shard").count().collect()]
    assert sum(sizes) == mixed.count() and max(sizes) - min(sizes) <= 1


def test_run(spark):
    assert {"doc_id", "shard", "slot"} <= set(P.run(spark, SF).columns)


def shuffle_files(spark):
    """Bytes by name of the shuffles' files."""
    tops = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    return {f: os.path.getsize(os.path.join(d, f)) for top in tops for d, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_") and os.path.exists(os.path.join(d, f))}


def left_by(spark, job):
    """Bytes of shuffle files that ``job`` leaves, those aside that go within some seconds."""
    before = shuffle_files(spark)
    kept = job()
    for _ in range(20):
        left = sum(n for f, n in shuffle_files(spark).items() if f not in before)
        if not left:
            break
        time.sleep(0.1)
    return left, kept


def test_written_tables_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name)
    left, rows = left_by(spark, lambda: written(spark.range(50_000).groupBy((F.col("id") % 20_000).alias("k")).count(), "counts"))
    assert left == 0 and spark.conf.get(name) == own
    assert rows.count() == 20_000 and rows.agg(F.sum("count")).first()[0] == 50_000
