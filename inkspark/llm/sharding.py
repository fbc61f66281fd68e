"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame and SQL functions only.

The ring has ``CELLS`` cells; each shard owns ``replicas`` virtual nodes on cells that hashes choose, a key's cell belongs to the
next node clockwise (its arc). Loads are bounded by the law ``rows``: shard i holds floor(n/shards) rows, and the first
n mod shards hold one more. An arc gives its own shard all it can take; the rows beyond go on clockwise to the next nodes whose
shards aren't full. Room and rows are equal in number, so every row finds a shard, counts differ by one at most, and only the
overflow of a change of ``shards`` moves besides what the new shard's nodes take over.

Scale: the driver sees the arcs' counts only - shards x replicas numbers, whatever the data - and plans intervals of row numbers
within arcs; rows get their number in their arc from bucketed windows and their shard by a join with that bounded plan. Texts
aren't moved by ``assigned`` unless the caller passes them along.

Edge cases: a null id hashes as the empty text; a null text has size 16 and crc32 0; rows that repeat get different slots; an
empty table gives none; columns other than the key are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import numbered, table, utf8_bytes

CELLS = 1 << 16


def ring(spark, shards: int, replicas: int) -> DataFrame:
    """(shard, cell, id): the virtual nodes; those of a shard are the same for any number of shards."""
    return spark.range(shards * replicas).select(F.expr(f"id div {replicas}").cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(CELLS)).cast("int").alias("cell"), "id")


def plan(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first number, end, shard, first slot): where the rows of each arc go; ``counts`` and ``owner`` by arc, in the ring's order."""
    total, arcs = sum(counts), len(counts)
    room = [total // shards + (i < total % shards) for i in range(shards)]
    used = [0] * shards
    out = []

    def place(arc: int, lo: int, n: int, shard: int) -> None:
        out.append((arc, lo, lo + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    over = []
    for arc, n in enumerate(counts):
        own = min(n, room[owner[arc]])
        if own:
            place(arc, 0, own, owner[arc])
        if n > own:
            over.append((arc, own, n - own))
    next_open = list(range(1, arcs + 1))  # path to the next node clockwise that may have room

    def find(a: int) -> int:
        path = []
        while room[owner[a % arcs]] == 0:
            path.append(a % arcs)
            a = next_open[a % arcs]
        for p in path:
            next_open[p] = a % arcs if a % arcs > p else a % arcs + arcs
        return a % arcs

    for arc, lo, n in over:
        while n:
            at = find(arc)
            part = min(n, room[owner[at]])
            place(arc, lo, part, owner[at])
            lo, n = lo + part, n - part
    return out


def assigned(rows: DataFrame, key: str, shards: int, replicas: int = 128, ties: tuple[str, ...] = (), rows_per_window: int = 2_000) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 in each shard)."""
    spark = rows.sparkSession
    nodes = sorted((r["cell"], r["id"], r["shard"]) for r in ring(spark, shards, replicas).collect())  # shards x replicas rows
    owner = [s for _, _, s in nodes]
    # the arc of a cell: the first node at or after it, else the first of all
    arc_of, a = [], 0
    for cell in range(CELLS):
        while a < len(nodes) and nodes[a][0] < cell:
            a += 1
        arc_of.append(a % len(nodes))
    cells = F.broadcast(spark.createDataFrame(list(enumerate(arc_of)), "_cell int, _arc int"))  # CELLS rows
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = rows.withColumn("_cell", F.pmod(F.xxhash64(F.lit("key"), name), F.lit(CELLS)).cast("int")).join(cells, "_cell").drop("_cell")
    by_arc = {r["_arc"]: r["n"] for r in placed.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row an arc
    counts = [by_arc.get(i, 0) for i in range(len(nodes))]
    moves = F.broadcast(spark.createDataFrame(plan(counts, owner, shards), "_arc int, _lo long, _end long, shard int, _slot long"))
    order = [F.xxhash64(F.lit("order"), name), *(F.xxhash64(t) for t in ties)]
    some = numbered(placed, ["_arc"], order, "_i", -(-sum(counts) // (rows_per_window * len(nodes))))
    inside = (F.col("_i") >= F.col("_lo")) & (F.col("_i") < F.col("_end"))
    return some.join(moves, "_arc").where(inside).withColumn("slot", (F.col("_slot") + F.col("_i") - F.col("_lo")).cast("long")).drop("_arc", "_i", "_lo", "_end", "_slot")


def query(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (utf8_bytes("text") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assigned(rows, "doc_id", shards, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The pipeline's last stage: every document with its shard and slot."""
    taken = [c for c in ("shard", "slot") if c in docs.columns]
    return assigned(docs.drop(*taken), "doc_id", shards, ties=("text",))
