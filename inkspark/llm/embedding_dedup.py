"""Embedding near-duplicates by a random-projection tree forest.

Equal vectors are collapsed first. Two rounds then pack vectors into balls: within the leaves of a tree without overlap, those
that a ball's centre can hold within half the link angle, so that all of a ball link with each other. The forest runs over the
balls: every tree splits recursively along random directions at its nodes' medians, a ball near a split (``spill`` of the node's
rows on either side) goes down both ways, and balls are compared within leaves. Two balls whose centres' angle plus radii is
within the link angle link member by member; those that may link in part are verified by their members' exact cosines; single
vectors by their own. Links are counted by sums of ball sizes, and linked balls are united by connected components.

So a group of G near copies costs about G comparisons with its ball, not G**2 pairs, and only ball pairs are ever emitted.
Medians are fitted on a sample of ``sample`` rows with the smallest hashes; nodes deeper than the sample reaches split at the
projection of their ancestor's mean. Every vector is indexed. Leaves over ``block`` rows are compared whole, in tiles.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
different lengths; a null id is never a component's id unless all are null; rows that repeat an id are judged each by their vector;
cosines within rounding of the limit are decided by double precision; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import components, table, written

REACH = 10  # levels whose medians are fitted
POINT = "v long, x array<double>, radius double, n long"


@dataclass
class Tree:
    """Directions by level; thresholds and overlap margins by level and node down to REACH; the means of the nodes there."""

    directions: np.ndarray
    thresholds: list[np.ndarray]
    margins: list[np.ndarray]
    means: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, depth: int, spill: float, seed: int) -> Tree:
        dim = rows.shape[1]
        directions = np.random.default_rng(seed).normal(size=(depth, dim))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        thresholds, margins = [], []
        nodes = [(rows, rows.mean(0) if len(rows) else np.zeros(dim))]
        for level in range(min(depth, REACH)):
            t, m, below = np.zeros(len(nodes)), np.zeros(len(nodes)), []
            for i, (own, mean) in enumerate(nodes):
                p = own @ directions[level]
                if len(own) >= 16:
                    t[i] = np.median(p)
                    m[i] = np.quantile(np.abs(p - t[i]), 2 * spill)
                else:
                    t[i], m[i] = mean @ directions[level], spill / np.sqrt(dim)
                for side in (own[p <= t[i]], own[p > t[i]]):
                    below.append((side, side.mean(0) if len(side) >= 8 else mean))
            thresholds.append(t)
            margins.append(m)
            nodes = below
        return cls(directions, thresholds, margins, np.stack([mean for _, mean in nodes]))

    def leaves(self, x: np.ndarray, overlap: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf path), a row for each leaf that it falls in."""
        row, path = np.arange(len(x)), np.zeros(len(x), np.int64)
        p = x @ self.directions.T
        for level in range(len(self.directions)):
            if level < REACH:
                t, m = self.thresholds[level][path], self.margins[level][path]
            else:
                top = path >> (level - REACH)
                t, m = self.means[top] @ self.directions[level], np.full(len(path), self.margins[-1].mean())
            at = p[row, level]
            m = m if overlap else 0
            left, right = at <= t + m, at > t - m
            row, path = np.concatenate([row[left], row[right]]), np.concatenate([path[left] * 2, path[right] * 2 + 1])
        return row, path


def fit_forest(points: DataFrame, total: int, trees: int, leaf: int, spill: float, sample: int, seed: int) -> dict[int, list[Tree]]:
    """Trees by dimension, fitted on at most ``sample`` rows; a dimension that the sample lacks has none, and is one leaf, tiled."""
    got = points.orderBy(F.xxhash64("v", F.lit(seed))).limit(sample).select("x").collect()
    depth = max(0, int(np.ceil(np.log2(max(1, total / leaf)))))
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(len(r["x"]), []).append(r["x"])
    return {d: [Tree.fit(np.array(rows), depth, spill, seed * 1000 + t) for t in range(trees)] for d, rows in by.items()}


def in_leaves(points: DataFrame, forest: dict[int, list[Tree]], overlap: bool, block: int, pairs: bool) -> DataFrame:
    """Rows dealt into groups of at most about ``block``: (leaf, i, j, side) and the point. pairs: as tiles that meet every other block of the leaf."""
    shared = points.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column(1)
            sizes = np.diff(xs.offsets.to_numpy())
            for d in np.unique(sizes):
                of = np.flatnonzero(sizes == d)
                part = batch.take(pa.array(of))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(of), d)
                trees = shared.value.get(int(d))
                for t, (row, path) in enumerate(tree.leaves(x, overlap) for tree in trees) if trees else [(0, (np.arange(len(of)), np.zeros(len(of), np.int64)))]:
                    for k in range(0, len(row), 4096):
                        some = part.take(pa.array(row[k : k + 4096]))
                        key = [f"{d}.{t}.{p}" for p in path[k : k + 4096]]
                        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), *some.columns], ["leaf", "v", "x", "radius", "n"])

    rows = points.mapInArrow(route, "leaf string, " + POINT)
    count = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(count, "leaf").withColumn("c", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    if not pairs:
        return dealt.select("leaf", F.col("c").alias("i"), "v", "x", "radius", "n")
    tiles = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1)
    return tiles.select("leaf", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), side.alias("side"), "v", "x", "radius", "n")


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def packed(points: DataFrame, total: int, link: float, leaf: int, block: int, sample: int, seed: int) -> DataFrame:
    """(v, ball, x, radius, n): each point's ball; x and radius on the row of the point that names the ball, n the point's own."""
    most = link / 2 - 1e-6
    forest = fit_forest(points, total, 1, leaf, 0.0, sample, seed)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", ignore_index=True)
        x, r, n = np.stack(pdf["x"]), pdf["radius"].to_numpy(), pdf["n"].to_numpy()
        far = _angles(x, x) + r
        ball, centre, radius = np.arange(len(x)), [None] * len(x), np.zeros(len(x))
        free = np.ones(len(x), bool)
        for i in range(len(x)):
            if not free[i]:
                continue
            near = np.flatnonzero(free & (far[i] <= most))
            near = near if i in near else np.append(near, i)
            c, size = x[i], max(far[i][near].max(), r[i])
            if len(near) > 1:
                mean = (x[near] * n[near, None]).sum(0)
                mean /= np.linalg.norm(mean)
                reach = (np.arccos(np.clip(x[near] @ mean, -1, 1)) + r[near]).max()
                if reach <= size:
                    c, size = mean, reach + 1e-9
            ball[near], free[near] = i, False
            centre[i], radius[i] = c, size if len(near) > 1 else r[i]
        v = pdf["v"].to_numpy()
        return pd.DataFrame({"v": v, "ball": v[ball], "x": centre, "radius": radius, "n": n})

    return in_leaves(points, forest, False, block, False).groupBy("leaf", "i").applyInPandas(pack, "v long, ball long, x array<double>, radius double, n long")


def ball_pairs(balls: DataFrame, total: int, link: float, trees: int, leaf: int, spill: float, block: int, sample: int, seed: int) -> DataFrame:
    """(a, b, whole): pairs of balls some of whose members may link; whole if all surely do."""
    forest = fit_forest(balls, total, trees, leaf, spill, sample, seed)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "whole": []}).astype({"a": "int64", "b": "int64", "whole": bool})
        x, y = np.stack(left["x"]), np.stack(right["x"])
        cos = x @ y.T
        r, s = left["radius"].to_numpy()[:, None], right["radius"].to_numpy()[None]
        v, w = left["v"].to_numpy(), right["v"].to_numpy()
        i, j = np.nonzero((cos >= np.cos(np.minimum(np.pi, link + r + s)) - 1e-12) & (v[:, None] != w[None]))
        angle, radii = np.arccos(np.clip(cos[i, j], -1, 1)), (r + s)[i, np.zeros(len(i), int)] if s.shape[1] == 1 else np.broadcast_to(r + s, cos.shape)[i, j]
        single = radii == 0
        limit = np.cos(link)
        exact = cos[i, j] >= limit
        keep = ~single | exact | (np.abs(cos[i, j] - limit) < 1e-12)
        whole = np.where(single, cos[i, j] >= limit + 1e-12, angle + radii <= link - 1e-7)
        return pd.DataFrame({"a": np.minimum(v[i], w[j])[keep], "b": np.maximum(v[i], w[j])[keep], "whole": whole[keep]})

    found = in_leaves(balls, forest, True, block, True).groupBy("leaf", "i", "j").applyInPandas(compare, "a long, b long, whole boolean")
    return found.groupBy("a", "b").agg(F.max("whole").alias("whole"))


def partial_links(pairs: DataFrame, members: DataFrame, cosine: float, tile: int = 512) -> DataFrame:
    """For ball pairs (a, b): (v, links, a, b) of every member with links in the other ball, by exact cosines. members: (v, ball, x, n)."""

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = {"v": [], "links": []}
        if len(left) and len(right):
            hit = (np.stack(left["x"]) @ np.stack(right["x"]).T) >= cosine
            for rows, other, axis in ((left, right, hit), (right, left, hit.T)):
                links = axis @ other["n"].to_numpy()
                out["v"].append(rows["v"].to_numpy()[links > 0])
                out["links"].append(links[links > 0])
        v, links = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out["v"], out["links"]))
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        return pd.DataFrame({"v": v, "links": links, "a": a, "b": b})

    size = members.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    sized = pairs.join(size.select(F.col("ball").alias("a"), F.col("blocks").alias("na")), "a").join(size.select(F.col("ball").alias("b"), F.col("blocks").alias("nb")), "b")
    sides = sized.select("a", "b", F.col("a").alias("ball"), F.lit(0).alias("side"), F.col("na").alias("own"), F.col("nb").alias("other")).union(sized.select("a", "b", F.col("b"), F.lit(1), "nb", "na"))
    rows = sides.join(members, "ball").withColumn("c", F.pmod(F.xxhash64("v"), F.col("own")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    tiles = rows.select("a", "b", F.when(F.col("side") == 0, F.col("c")).otherwise(F.col("o")).alias("i"), F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("c")).alias("j"), "side", "v", "x", "n")
    return tiles.groupBy("a", "b", "i", "j").applyInPandas(verify, "v long, links long, a long, b long")


def linked(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", cosine: float = 0.9, trees: int = 10, leaf: int = 256, spill: float = 0.03, block: int = 1024, sample: int = 8_192) -> DataFrame:
    """Per row of ``vectors``: (id, n_links, component_id)."""
    link = float(np.arccos(cosine))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.array_max(F.transform("e", F.abs))
    fine = F.coalesce(F.col("e").isNotNull() & (F.size("e") > 0) & ~bad & (top > 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    one = rows.where("fine").groupBy("e").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("v", F.xxhash64("e", "low"))
    # divided by the largest component before the norm, so that neither overflows
    scaled = F.transform("e", lambda x: x / top)
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x))
    unit = one.withColumn("s", scaled).withColumn("norm", norm)
    points = written(unit.select("v", F.transform("s", lambda x: x / F.col("norm")).alias("x"), F.lit(0.0).alias("radius"), "n", "low", "e"), "points")
    names = points.select("v", "e", "low")
    points = points.select("v", "x", "radius", "n")
    total = points.count()
    first = written(packed(points, total, link, leaf, block, sample, 1), "balls")
    small = first.where("v = ball").select("v", "x", "radius").join(first.groupBy("ball").agg(F.sum("n").alias("n")).withColumnRenamed("ball", "v"), "v")
    second = written(packed(small.select("v", "x", "radius", "n"), total, link, leaf, block, sample, 2), "balls")
    owner = first.select("v", F.col("ball").alias("b1")).join(second.select(F.col("v").alias("b1"), "ball"), "b1").select("v", "ball")
    members = written(points.join(owner, "v").select("v", "ball", "x", "n"), "members")
    size = members.groupBy("ball").agg(F.sum("n").alias("size"))
    balls = second.where("v = ball").select("v", "x", "radius").join(size.select(F.col("ball").alias("v"), F.col("size").alias("n")), "v")
    balls = written(balls.select("v", "x", "radius", "n"), "balls")
    pairs = written(ball_pairs(balls, total, link, trees, leaf, spill, block, sample, 3), "pairs")
    part = written(partial_links(pairs.where("not whole").select("a", "b"), members, cosine), "partial")
    sizes = balls.select(F.col("v").alias("ball"), "n")
    whole = pairs.where("whole").select("a", "b").union(pairs.where("whole").select("b", "a"))
    by_ball = whole.join(sizes.withColumnRenamed("ball", "b"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("whole"))
    by_member = part.groupBy("v").agg(F.sum("links").alias("part"))
    roots = components(pairs.where("whole").select("a", "b").union(part.select("a", "b").distinct()))
    zero = F.lit(0).cast("long")
    counted = (
        members.join(sizes.withColumnRenamed("n", "size"), "ball").join(by_ball, "ball", "left").join(by_member, "v", "left").join(roots.select(F.col("id").alias("ball"), "root"), "ball", "left")
        .select("v", (F.col("size") - 1 + F.coalesce("whole", zero) + F.coalesce("part", zero)).alias("n_links"), F.coalesce("root", "ball").alias("root"))
        .join(names, "v")
    )
    counted = written(counted, "counted")
    lowest = counted.groupBy("root").agg(F.min("low").alias("component_id"))
    result = counted.join(lowest, "root").select("e", "n_links", "component_id")
    good = rows.where("fine").join(result, "e").select("id", "n_links", "component_id")
    return good.union(rows.where("not fine").select("id", zero, F.col("id")))


def query(spark, sf_dir: str) -> DataFrame:
    out = linked(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(root) AS component_id, min(root) = vec_id AS kept FROM r GROUP BY vec_id"""
