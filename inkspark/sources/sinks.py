"""Writers: texts put together from segments again, reports, no-clobber publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.functions.text import stripped


def _joined(parts: DataFrame, key: str) -> DataFrame:
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg_idx", "out"))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda r: r["out"]), "").alias("text"))


def translated(segments: DataFrame, translations: DataFrame, key: str = "doc_id") -> DataFrame:
    """One text a document: each line's translation, or the line itself, with its own line end. segments: key, seg_idx, line, newline; translations: key, seg_idx, dst."""
    both = segments.join(translations, [key, "seg_idx"], "left")
    return _joined(both.select(key, "seg_idx", F.concat(F.coalesce("dst", "line"), "newline").alias("out")), key)


def bilingual(segments: DataFrame, translations: DataFrame, key: str = "doc_id", dedup: bool = True) -> DataFrame:
    """Each line followed by its translation; blank lines once, and equal ones once where ``dedup``."""
    both = segments.join(translations, [key, "seg_idx"], "left").withColumn("dst", F.coalesce("dst", "line"))
    once = stripped(F.col("line")) == ""
    if dedup:
        once = once | (stripped(F.col("line")) == stripped(F.col("dst")))
    out = F.when(once, F.concat("line", "newline")).otherwise(F.concat("line", F.lit("\n"), "dst", "newline"))
    return _joined(both.select(key, "seg_idx", out.alias("out")), key)


def published(df: DataFrame, path: str, format: str = "json", overwrite: bool = False) -> None:
    """Write, but never over what is there unless asked to."""
    df.write.format(format).mode("overwrite" if overwrite else "errorifexists").save(path)


def report(df: DataFrame, path: str) -> None:
    """One-row reports and issue lists as JSON; nothing is written for an empty list."""
    if df.head(1):
        published(df, path, overwrite=True)


def reviewed(sheet: DataFrame, changes: DataFrame) -> DataFrame:
    """A sheet with rows updated or deleted: changes have row_index, dst, info, deleted."""
    new = changes.select("row_index", F.col("dst").alias("_dst"), F.col("info").alias("_info"), F.coalesce("deleted", F.lit(False)).alias("_deleted"))
    rows = sheet.join(new, "row_index", "left").where(~F.coalesce("_deleted", F.lit(False)))
    return rows.withColumn("dst", F.coalesce("_dst", "dst")).withColumn("info", F.coalesce("_info", "info")).drop("_dst", "_info", "_deleted")


def retained(log: DataFrame, limit_bytes: int, by: str = "seq", group: str = "task_id", line: str = "line") -> DataFrame:
    """The newest lines of each log that fit into ``limit_bytes``."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("_sum", F.sum(F.octet_length(line) + 1).over(w)).where(F.col("_sum") <= limit_bytes).drop("_sum")
