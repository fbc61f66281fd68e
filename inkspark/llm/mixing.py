"""Mixing sources to target weights by Pfair scheduling.

Weights are made whole numbers of ``period`` slots. A source with n of P slots releases its block k at slot floor(k*P/n), due by
ceil((k+1)*P/n); in each slot the released block with the earliest deadline runs (ties: the source first in order). The weights
fill all slots, so every block meets its deadline and each source is less than one block off its target after every slot. The
schedule repeats each period: one period is planned on the driver (``period`` steps, whatever the data), and block b of a source
runs in period b div n at the slot of its block b mod n.

The mix is as long as it takes to place every row once; sources that end earlier start over (``epoch`` 1, 2, ...), so no row is
lost and the weights hold to the last slot.

Scale: rows are numbered within their source by bucketed windows, so a source with a third of all rows is no single task;
the schedule is a table of at most ``period`` rows, broadcast. Where weights follow from sizes, sources whose target is under one slot of a
period are scheduled as one, mixed by hash in proportion to their rows: so the driver sees fewer than ``period`` sources, however many there are.

Edge cases: a null source is a source of its own (key None in ``weights``), apart from the empty one; an empty table gives an empty mix; rows that repeat
are placed each; weights of sources without rows are ignored, a source without a weight is an error, as are more weights than slots.
``mixed`` leaves out input columns named like one that it adds, ``reweighted`` carries every column as it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import numbered, table

ADDED = ("epoch", "source_row", "block", "slot", "position")


def slots_of(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole slots that sum to ``period``, one at least for each source, by largest remainders."""
    if len(weights) > period:
        raise ValueError("more sources than slots in a period")
    whole = sum(weights.values())
    exact = {s: max(1.0, w / whole * period) for s, w in weights.items()}
    free = period / sum(exact.values())
    out = {s: max(1, int(x * free)) for s, x in exact.items()}
    by = sorted(weights, key=lambda s: (out[s] - exact[s] * free, s))
    k = 0
    while (left := period - sum(out.values())) != 0:
        s = by[k % len(by)] if left > 0 else max(out, key=lambda x: (out[x], x))
        out[s] += 1 if left > 0 else -1
        k += 1
    return out


def schedule(slots: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, k, slot, release, deadline) of each block of one period, by earliest deadline first."""
    period = sum(slots.values())
    blocks = sorted((k * period // n, -(-(k + 1) * period // n), s, k) for s, n in slots.items() for k in range(n))
    ready: list[tuple[int, str, int, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(blocks) and blocks[at][0] <= slot:
            release, deadline, s, k = blocks[at]
            heapq.heappush(ready, (deadline, s, k, release))
            at += 1
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, slot, release, deadline))
    return out


def placed(rows: DataFrame, source: str, order: tuple[str, ...], weights: Mapping[str | None, float] | None, temperature: float, period: int, block_rows: int, rows_per_window: int) -> DataFrame:
    """(doc, epoch, source_row, block, slot, position): the row of ``rows`` as a struct, and its places."""
    spark = rows.sparkSession
    key = F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    named = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("doc"), key.alias("_source"))
    sizes = named.groupBy("_source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("target", F.pow(F.col("n").cast("double"), F.lit(temperature)))
        whole = sizes.agg(F.sum("target")).first()[0] or 0.0
        own = F.col("target") * period > whole
        # fewer than ``period`` sources have more than one slot's share; one row for the others
        found = sizes.withColumn("_source", F.when(own, F.col("_source")).otherwise("+")).groupBy("_source").agg(F.sum("n").alias("n"), F.sum("target").alias("target")).collect()
        count, target = {r["_source"]: r["n"] for r in found}, {r["_source"]: r["target"] for r in found}
        if "+" in count:
            named = named.withColumn("_source", F.when(F.col("_source").isin(sorted(count)), F.col("_source")).otherwise("+"))
    else:
        given = {"-" if s is None else f"={s}": w for s, w in weights.items()}
        count = {r["_source"]: r["n"] for r in sizes.limit(len(given) + 1).collect()}
        if missing := [s for s in count if s not in given]:
            raise ValueError(f"no weight for source {missing[0][1:]!r}")
        target = {s: given[s] for s in count}
    if not count:
        return named.select("doc", *(F.lit(None).cast("long").alias(name) for name in ADDED))
    slots = slots_of(target, period)
    length = sum(slots.values())
    plan = schedule(slots)
    place = {(s, k): slot for s, k, slot, _, _ in plan}

    def slot_of(s: str, row: int) -> int:
        block = row // block_rows
        return block // slots[s] * length + place[s, block % slots[s]]

    end = max(slot_of(s, n - 1) for s, n in count.items()) + 1
    most = {s: (end // length + 1) * slots[s] * block_rows for s in count}
    info = F.broadcast(spark.createDataFrame([(s, n, slots[s], most[s]) for s, n in count.items()], "_source string, _size long, _slots int, _most long"))
    times = F.broadcast(spark.createDataFrame([(s, k, slot) for s, k, slot, _, _ in plan], "_source string, _k int, _slot long"))
    by = [F.col(f"doc.`{c}`") for c in order]
    out = numbered(named, ["_source"], [F.xxhash64(F.lit("mix"), *by), *by], "_i", -(-sum(count.values()) // rows_per_window)).join(info, "_source")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_most - 1 - _i) div _size")))).withColumn("source_row", F.col("epoch") * F.col("_size") + F.col("_i"))
    out = out.withColumn("block", F.expr(f"source_row div {block_rows}")).withColumn("_k", (F.col("block") % F.col("_slots")).cast("int")).join(times, ["_source", "_k"])
    out = out.withColumn("slot", F.expr(f"block div _slots * {length} + _slot")).where(F.col("slot") < end)
    return out.withColumn("position", F.col("slot") * block_rows + F.col("source_row") % block_rows).select("doc", *ADDED)


def mixed(rows: DataFrame, source: str = "source", order: tuple[str, ...] = ("doc_id",), weights: Mapping[str | None, float] | None = None, temperature: float = 0.9, period: int = 1_000, block_rows: int = 4, rows_per_window: int = 500) -> DataFrame:
    """Add epoch, source_row, block, slot and position (the row's place in the mix); ``weights`` default to rows ** temperature."""
    out = placed(rows, source, order, weights, temperature, period, block_rows, rows_per_window)
    return out.select(*(F.col(f"doc.`{c}`") for c in rows.columns if c not in ADDED), *ADDED)


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", *ADDED)


def reweighted(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: every document at least once, those of sources below their target weight again; columns as they were."""
    return placed(docs, "source", ("doc_id",), None, 0.9, 1_000, 4, 500).select(*(F.col(f"doc.`{c}`") for c in docs.columns))
