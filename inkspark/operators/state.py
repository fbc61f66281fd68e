"""State from logs: last writer wins, field-wise event merges, progress and usage, paging, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate, so a hot key costs one row a task."""
    rest = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*key, "x.*")


def authoritative(log: DataFrame) -> DataFrame:
    """Rows that may write state: completed ones, and failed ones for accepted or preserved segments."""
    return log.where((F.col("status") == "completed") | ((F.col("status") == "failed") & F.coalesce(F.col("accepted") | F.col("preserved"), F.lit(False))))


def first_source(log: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def merged_events(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row a request: each field's last non-null value, first and last place, and how many events."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(key).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count(F.lit(1)).alias("events"), *last)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered result; the order must be total."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def progress(rows: DataFrame, by: list[str], status: str, values: dict[str, str], skipped: str | None = None) -> DataFrame:
    """Counts by status as columns, the total without skipped rows, and whether all are finished."""
    counts = [F.count_if(F.col(status) == v).alias(name) for name, v in values.items()]
    total = F.count_if(F.col(status) != skipped) if skipped else F.count(F.lit(1))
    return rows.groupBy(*by).agg(*counts, total.alias("total"))


def final_status(total: Column, completed: Column, failed: Column, stopped: Column) -> Column:
    return F.when(stopped, "stopped").when(failed > 0, F.when(completed > 0, "completed_with_errors").otherwise("failed")).when(completed >= total, "completed").otherwise("pending")


def dangling_failed(rows: DataFrame, status: str = "status") -> DataFrame:
    """Pending and running rows of an ended run count as failed."""
    return rows.withColumn(status, F.when(F.col(status).isin("pending", "running"), "failed").otherwise(F.col(status)))


def backoff(attempt: Column, first: float = 1.0, most: float = 30.0) -> Column:
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt - 1))


def active_seconds(transitions: DataFrame, key: str, at: str, status: str, active: tuple[str, ...] = ("running",)) -> DataFrame:
    """Seconds spent in active states, from one transition to the next."""
    w = Window.partitionBy(key).orderBy(at)
    span = F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at)
    return transitions.withColumn("_s", F.when(F.col(status).isin(*active), span)).groupBy(key).agg((F.coalesce(F.sum("_s"), F.lit(0)) / 1_000_000).alias("active_seconds"))


def replayed(decisions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Review decisions applied in order to each row: the last target and remark before a deletion, which ends it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    live = decisions.withColumn("_gone", F.coalesce(F.max(F.col("action") == "delete").over(w), F.lit(False))).where(~F.col("_gone"))
    at = F.struct(*order)
    return live.groupBy(*key).agg(F.max_by("dst", F.when(F.col("dst").isNotNull(), at)).alias("dst"), F.max_by("info", F.when(F.col("info").isNotNull(), at)).alias("info"), F.max(F.col("action") == "delete").alias("deleted"), F.count(F.lit(1)).alias("changes"))


def consensus(history: DataFrame, key: list[str], round_: str, state: list[str]) -> DataFrame:
    """Terms whose last two rounds agree, from the third round on."""
    w = Window.partitionBy(*key).orderBy(round_)
    rows = history.withColumn("_n", F.row_number().over(w)).withColumn("_same", F.struct(*state) == F.lag(F.struct(*state)).over(w))
    return rows.groupBy(*key).agg(F.max("_n").alias("rounds"), F.max_by("_same", "_n").alias("agree")).select(*key, "rounds", (F.coalesce("agree", F.lit(False)) & (F.col("rounds") >= 3)).alias("settled"))


def natural_key(name: Column) -> Column:
    """Orders names by their numbers as numbers: digit runs are padded."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.ltrim(p, F.lit("0")), 20, "0")).otherwise(p)), "\x01")


def segment_order(segment_id: Column) -> list[Column]:
    """file:segment as two numbers; malformed ids are (0, 0)."""
    ok = segment_id.rlike(r"^[0-9]{1,9}:[0-9]{1,9}$")
    return [F.when(ok, F.split_part(segment_id, F.lit(":"), F.lit(i))).otherwise("0").cast("int") for i in (1, 2)]


def risk_rank(tags: Column, order: list[str]) -> Column:
    """The place of the first of the ordered tags that a row has; their number if it has none."""
    rank = F.lit(len(order))
    for i, tag in reversed(list(enumerate(order))):
        rank = F.when(F.array_contains(tags, tag), i).otherwise(rank)
    return rank


# fixed values: what names mark side stories with, and the units of volumes and chapters
EXTRA = r"(?:외전|번외|특별|番外|外传|外傳|特别|特別|后日谈|後日談|spinoff|side\s*story|extra|special)"
UNIT = r"(?:권|卷|冊|册|화|話|话|장|章|회|回|부|部|편|篇|탄|巻|episode|ep|chapter|chap|ch|volume|vol)"
ORDERED = rf"(?:(?:第|제)\s*(\d+)\s*{UNIT}?|(\d+)\s*{UNIT})"
UNNUMBERED = 999_999


def natural_parts(text: Column) -> Column:
    """Sorts numbers in a text by their value, before letters."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: p.rlike(r"^\d+$")
    return F.transform(parts, lambda p: F.struct((~digits(p)).alias("text"), F.when(digits(p), p.cast("decimal(38,0)")).otherwise(0).alias("n"), F.when(digits(p), "").otherwise(p).alias("s")))


def volume_key(name: Column) -> Column:
    """(series, extra, number) of a volume's file name: its series without numbers and marks, whether it is a side story, and its number."""
    extra = name.rlike(f"(?i){EXTRA}")
    series = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, f"(?i){EXTRA}", " "), f"(?i){ORDERED}", " "), r"\d+", " ")
    series = F.trim(F.regexp_replace(F.lower(F.regexp_replace(series, r"[\[\]【】()（）<>《》@#,_\-.]+", " ")), r"\s+", " "))
    first = lambda pattern, g: F.nullif(F.regexp_extract(name, f"(?i){pattern}", g), F.lit(""))
    number = F.coalesce(F.when(extra, first(rf"{EXTRA}\s*(\d+)", 1)), first(ORDERED, 1), first(ORDERED, 2), first(r"(\d+)", 1), F.lit(str(UNNUMBERED)))
    return F.struct(series.alias("series"), extra.alias("extra"), number.cast("decimal(38,0)").alias("number"))


def volume_order(name: Column) -> list[Column]:
    """Sorts volumes: by series, main volumes before side stories, by number, then by name; all numbers by their value."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^./]*$", "")
    key = volume_key(stem)
    return [natural_parts(key["series"]), key["extra"], key["number"], natural_parts(name)]
