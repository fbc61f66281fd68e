"""Exact top-k inner products by a dual-tree search over a cover tree.

One tree indexes queries and data: nested nets of a sample in farthest-point order, each level's centres at least its scale apart
and within the scale above of a centre there. All rows take their nearest leaf; Spark sums what each node holds, its covering radii,
of data and of queries, and each query group's worst k-th score so far (at first that over the sample). The tree is then descended
against itself: a pair of nodes whose centres and radii allow no score above the group's worst k-th one is pruned with all below
it. The leaf pairs left become tiles, blocks of queries against blocks of data, in which the groups are tried in the order of their
bounds against k-th scores that rise on the way. The rows with the largest scores of a query's tiles are its answer.

The tree has at most ``leaves`` leaves, whatever the data, and is all that the driver holds; hot leaves are cut into blocks of at most
``cells`` components. Where bounds prune nothing, as among unclustered vectors of many dimensions, every query meets every row, in blocks.

Edge cases: vectors that are null, hold a null or have a component whose multiple isn't finite take no part; vectors of
different lengths don't meet; a row with a null id is no query and comes after others of its score; rows that repeat an id are rows
of their own; scores beyond 64 bits saturate; ties go to the smaller id; fewer rows than k give all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import table, written
from inkspark.llm.textvec import U, mix

EXACT = 2.0**53
LONG = 2**63 - 1
_CHUNK = 512


@dataclass
class CoverTree:
    """Node i: centre, parent, children; the leaves are the finest net. radius and least are filled with what Spark finds below each node."""

    centres: np.ndarray
    parents: list[int]
    children: list[list[int]] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, most: int) -> CoverTree:
        """Farthest-point order of the sample, cut where its distance halves: every prefix is a net of the next distance."""
        far = np.linalg.norm(x - x[0], axis=1)
        order, reach = [0], [far.max()]
        while len(order) < most and far.max() > 0:
            order.append(int(far.argmax()))
            reach.append(far.max())
            far = np.minimum(far, np.linalg.norm(x - x[order[-1]], axis=1))
        sizes = [1]
        for k in range(1, len(order)):
            if reach[k] < reach[sizes[-1] if sizes[-1] < len(order) else 0] / 2 and k > sizes[-1]:
                sizes.append(k)
        if sizes[-1] < len(order):
            sizes.append(len(order))
        centres, parents, level = [x[0]], [-1], [0]
        for size in sizes[1:]:
            above = level
            level = []
            for p in x[order[:size]]:
                level.append(len(centres))
                parents.append(above[int(np.linalg.norm(np.array([centres[a] for a in above]) - p, axis=1).argmin())])
                centres.append(p)
        tree = cls(np.array(centres).reshape(len(centres), x.shape[1]), parents, [[] for _ in centres])
        for k, p in enumerate(parents):
            if p >= 0:
                tree.children[p].append(k)
        tree.leaves = [k for k in tree.walk() if not tree.children[k]]
        return tree

    def walk(self) -> Iterator[int]:
        todo = [0]
        while todo:
            k = todo.pop()
            yield k
            todo.extend(reversed(self.children[k]))

    def path(self, leaf: int) -> list[int]:
        out = [leaf]
        while self.parents[out[-1]] >= 0:
            out.append(self.parents[out[-1]])
        return out

    def nearest(self, x: np.ndarray) -> np.ndarray:
        c = self.centres[self.leaves]
        return np.array(self.leaves)[((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)] if len(x) else np.zeros(0, np.int64)


@dataclass
class Node:
    """What lies below a node: rows and queries, their largest distances from the centre, the worst k-th score of its queries."""

    rows: int = 0
    queries: int = 0
    reach: float = 0.0
    query_reach: float = 0.0
    worst: float = np.inf


def bound(cq: np.ndarray, rq: float, cx: np.ndarray, rx: float) -> float:
    """No inner product between the two balls is above it."""
    most = float(cq @ cx) + rx * float(np.linalg.norm(cq)) + rq * float(np.linalg.norm(cx)) + rq * rx
    return most + 1e-9 * (abs(most) + 1) if np.isfinite(most) else np.inf


def surviving(tree: CoverTree, nodes: dict[int, Node]) -> list[tuple[int, int]]:
    """(query leaf, data leaf) pairs that the descent of the tree against itself doesn't prune."""
    out, todo = [], [(0, 0)]
    while todo:
        q, d = todo.pop()
        a, b = nodes.get(q, Node()), nodes.get(d, Node())
        if not a.queries or not b.rows or bound(tree.centres[q], a.query_reach, tree.centres[d], b.reach) < a.worst:
            continue
        below_q, below_d = tree.children[q], tree.children[d]
        if not below_q and not below_d:
            out.append((q, d))
        elif below_q and (not below_d or a.query_reach >= b.reach):
            todo += [(c, d) for c in below_q]
        else:
            todo += [(q, c) for c in below_d]
    return out


def packed(sizes: list[tuple[int, int]], block: int, first: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(leaf, rows) in tree order to (first block, blocks): small leaves share a block, large ones have several; and the next free block."""
    out, at, fill = {}, first, 0
    for leaf, n in sizes:
        if n > block or fill + n > block:
            at, fill = at + (fill > 0), 0
        blocks = max(1, -(-n // block))
        out[leaf] = (at, blocks)
        at, fill = (at, fill + n) if blocks == 1 else (at + blocks, 0)
    return out, at + (fill > 0)


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Blocks of (first, count) ranges, each once."""
    return sorted({b for first, n in ranges for b in range(first, first + n)})


@dataclass
class Plan:
    """By length of vector and leaf: own blocks and those of the other side to meet."""

    data: dict[tuple[int, int], tuple[int, int]]
    queries: dict[tuple[int, int], tuple[int, int]]
    to_queries: dict[tuple[int, int], list[int]]
    to_data: dict[tuple[int, int], list[int]]

    @classmethod
    def of(cls, forest: dict[int, CoverTree], found: dict[tuple[int, int], Node], cells: int) -> Plan:
        plan, next_data, next_query = cls({}, {}, {}, {}), 0, 0
        for size in sorted({d for d, _ in found}):
            tree = forest.get(size)
            nodes = {k: n for (d, k), n in found.items() if d == size}
            leaves = tree.leaves if tree else [0]
            pairs = surviving(tree, nodes) if tree else [(0, 0)] if nodes[0].queries else []
            block = max(1, cells // max(1, size))
            of_data, next_data = packed([(k, nodes[k].rows) for k in leaves if k in nodes], block, next_data)
            of_queries, next_query = packed([(k, nodes[k].queries) for k in leaves if k in nodes and nodes[k].queries], 4 * block, next_query)
            plan.data |= {(size, k): x for k, x in of_data.items()}
            plan.queries |= {(size, k): x for k, x in of_queries.items()}
            by_query, by_data = {}, {}
            for q, d in pairs:
                by_query.setdefault(q, []).append(of_data[d])
                by_data.setdefault(d, []).append(of_queries[q])
            plan.to_data |= {(size, q): merged(x) for q, x in by_query.items()}
            plan.to_queries |= {(size, d): merged(x) for d, x in by_data.items()}
        return plan


def matrix(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, vectors) of a batch (v, id, y) by length of vector, components rounded down."""
    sizes = np.diff(batch.column(2).offsets.to_numpy())
    for d in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == d)))
        yield int(d), part, np.floor(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, int(d)))


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whether there is one)."""
    return column.fill_null(LONG).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def slack(q: np.ndarray, x: np.ndarray) -> float:
    """What a double inner product may be off; 0 where all sums are exact integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return 0.0 if most < EXACT else most * q.shape[1] * 2.0**-50


def first_kth(x: np.ndarray, v: np.ndarray, sample: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches at least: that over the sample without the query itself."""
    if len(sample) <= k:
        return np.full(len(x), -np.inf)
    out = np.empty(len(x))
    for i in range(0, len(x), _CHUNK):
        s = x[i : i + _CHUNK] @ sample.T
        s[v[i : i + _CHUNK, None] == names[None]] = -np.inf
        out[i : i + _CHUNK] = np.partition(s, -k, axis=1)[:, -k]
    out -= slack(x, sample)
    return np.where(np.isfinite(out), out, -np.inf)


@dataclass
class Best:
    """The k best so far of a query group: query, id, whether there is one, score."""

    k: int
    q: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    named: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, q: np.ndarray, ids: np.ndarray, named: np.ndarray, score: np.ndarray) -> None:
        q, ids, named, score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.named, named), (self.score, score)))
        order = np.lexsort((ids, ~named, ~score, q))
        q, ids, named, score = q[order], ids[order], named[order], score[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        top = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < self.k
        self.q, self.id, self.named, self.score = q[top], ids[top], named[top], score[top]

    def kth(self, n: int) -> np.ndarray:
        """By query, the k-th score, where there are k."""
        out = np.full(n, -np.inf)
        count = np.bincount(self.q, minlength=n)
        last = np.cumsum(count) - 1
        full = count == self.k
        out[full] = self.score[last[full]]
        return out


def exact(q: np.ndarray, x: np.ndarray) -> int:
    return max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(q, x, strict=True))))


def searched(q: np.ndarray, qv: np.ndarray, floor: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int) -> Best:
    """The best of a query group over data groups (x, v, id, named), largest bound first; floor: a score that each query's k-th reaches anyhow."""
    best = Best(k)
    centre = q.mean(0)
    radius = float(np.linalg.norm(q - centre, axis=1).max())
    tried = []
    for g in groups:
        c = g[0].mean(0)
        tried.append((bound(centre, radius, c, float(np.linalg.norm(g[0] - c, axis=1).max())), g))
    for most, (x, v, ids, named) in sorted(tried, key=lambda t: -t[0]):
        off = slack(q, x)
        least = np.maximum(floor, best.kth(len(q)) - off)
        if most + off < least.min():
            break
        score = q @ x.T
        _, i, j = np.intersect1d(qv, v, assume_unique=True, return_indices=True)
        score[i, j] = -np.inf
        if not np.isfinite(off):  # beyond doubles: all are taken exactly
            hit = np.ones(score.shape, bool)
        else:
            if len(x) > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] - off)
            hit = score >= (least - off)[:, None]
        hit[i, j] = False
        i, j = np.nonzero(hit)
        best.add(i, ids[j], named[j], score[i, j].astype(np.int64) if not off else np.array([exact(q[a], x[b]) for a, b in zip(i, j, strict=True)], np.int64))
    return best


def nearest_by_product(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", every: int = 50, k: int = 5, scale: float = 256.0, leaves: int = 256, cells: int = 1 << 18, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key ``every`` divides, its k best others."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vec).cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("y"))
    bad = F.exists("y", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # the row number is fixed by writing it
    points = written(rows.where(F.col("y").isNotNull() & ~bad).select(F.monotonically_increasing_id().alias("v"), "id", "y"), "points")
    spark, total = points.sparkSession, points.count()
    share = min(1.0, sample / max(1, total))
    some = (points if share == 1 else points.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample)).toArrow()
    few = {d: (x, part.column(0).to_numpy(zero_copy_only=False)) for batch in some.combine_chunks().to_batches() for d, part, x in matrix(batch)}
    forest = {d: CoverTree.fit(x, leaves) for d, (x, _) in few.items()}
    shared = spark.sparkContext.broadcast((forest, few))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for d, part, x in matrix(batch):
                v = part.column(0).to_numpy(zero_copy_only=False)
                ids, named = ids_of(part.column(1))
                query = named & (ids % every == 0)
                tree = shared.value[0].get(d)
                floor = np.full(len(x), -np.inf)
                if tree:
                    floor[query] = first_kth(x[query], v[query], *shared.value[1][d], k)
                yield d, part, x, v, query, tree.nearest(x) if tree else np.zeros(len(x), np.int64), floor

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, _, x, _, query, leaf, floor in located(batches):
            tree, out = shared.value[0].get(d), []
            for at in np.unique(leaf):
                own = leaf == at
                for node in tree.path(int(at)) if tree else [0]:
                    far = np.linalg.norm(x[own] - tree.centres[node], axis=1) if tree else np.zeros(int(own.sum()))
                    q = query[own]
                    out.append((d, node, int(own.sum()), int(q.sum()), float(far.max()), float(far[q].max(initial=0)), float(floor[own][q].min(initial=np.inf))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["d", "node", "n", "queries", "reach", "query_reach", "worst"])

    found = (
        points.mapInArrow(weigh, "d long, node long, n long, queries long, reach double, query_reach double, worst double").groupBy("d", "node")
        .agg(F.sum("n"), F.sum("queries"), F.max("reach"), F.max("query_reach"), F.min("worst")).collect()
    )
    plan = Plan.of(forest, {(r[0], r[1]): Node(*r[2:]) for r in found}, cells)
    dealt = spark.sparkContext.broadcast(plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = dealt.value
        for d, part, _, v, query, leaf, floor in located(batches):
            h = mix(v.astype(np.uint64)) >> U(1)
            for at in np.unique(leaf):
                key = (d, int(at))
                for own, blocks, to, data in ((leaf == at, p.data[key], p.to_queries.get(key, []), True), ((leaf == at) & query, p.queries.get(key, (0, 1)), p.to_data.get(key, []), False)):
                    of = np.flatnonzero(own)
                    if not len(of):
                        continue
                    mine = (blocks[0] + (h[of] % U(blocks[1])).astype(np.int64)).astype(np.int64)
                    some = part.take(pa.array(of))
                    for other in to:
                        theirs = np.full(len(of), other, np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(theirs if data else mine), pa.array(mine if data else theirs), pa.array(np.full(len(of), data)), pa.array(leaf[of]), *some.columns, pa.array(floor[of])],
                            ["qb", "db", "data", "leaf", "v", "id", "y", "floor"],
                        )

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        data, queries = pdf[pdf["data"]], pdf[~pdf["data"]]
        out = []
        if len(data) and len(queries):
            groups = [(np.floor(np.stack(g["y"])), g["v"].to_numpy(), g["id"].fillna(LONG).to_numpy(np.int64), g["id"].notna().to_numpy()) for _, g in data.groupby("leaf")]
            for _, g in queries.groupby("leaf"):
                for i in range(0, len(g), _CHUNK):
                    part = g.iloc[i : i + _CHUNK]
                    b = searched(np.floor(np.stack(part["y"])), part["v"].to_numpy(), part["floor"].to_numpy(), groups, k)
                    near = pd.Series(b.id, dtype="Int64").mask(~b.named)
                    out.append(pd.DataFrame({"qv": part["v"].to_numpy()[b.q], "query_id": part["id"].to_numpy(np.int64)[b.q], "vec_id": near, "score": b.score}))
        return pd.concat(out) if out else pd.DataFrame({"qv": [], "query_id": [], "vec_id": [], "score": []}).astype({"qv": "int64", "query_id": "int64", "vec_id": "Int64", "score": "int64"})

    tiles = points.mapInArrow(deal, "qb long, db long, data boolean, leaf long, v long, id long, y array<double>, floor double")
    met = tiles.groupBy("qb", "db").applyInPandas(best, "qv long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qv").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest_by_product(table(spark, sf_dir, "embeddings"))


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
