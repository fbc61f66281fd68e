"""Spelling variants by k-d trees over letter-count vectors.

Words are maximal runs of letters, counted over all texts. One edit moves a word's letter counts by at most two in L1: an inserted
letter adds one, a replaced one adds one and takes one away. For every pair of lengths (L, L) and (L, L + 1) the words of the longer
length lie in a k-d tree over those counts, and a word of the shorter one is a range search in it: it enters a box as long as one
more of some letter, and between equal lengths one less of another, reaches it. What arrives at a leaf is searched by a finer tree
in the task, and the letter order of the pairs left there is verified.

The upper tree of each length is fitted on at most ``2 * sample`` words; every word is in it. Leaves hold about ``leaf`` words; larger
ones, and those that very many searches reach, are cut into tiles. Between equal lengths a search enters its own leaf and those
behind it, so a pair is found once. Words of equal counts are never compared with each other, as no edit leads from one to another.

A word's form is its near word of largest count, roots follow by pointer doubling: counts at least double with each form, so
some six rounds reach any root.

Edge cases: a null text has no words; a null key is the empty text; a run of any length is a word; rows that repeat count each; ties go
to the form first in code-point order; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import table, written
from inkspark.llm.runs import gathered, spans, strings
from inkspark.llm.textvec import LOWER, U, buffers, mix, pieces

LETTERS = 26 + 64  # a to z, U+00C0 to U+00FF
_SHORT = 64
_FEW = 48
_SLOTS = 1 << 20
_PAIRS = 1 << 22


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crcs(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span as if the bytes with the CRC ``before`` stood in front of it."""
    length = stop - start
    order = np.argsort(-length, kind="stable")
    at, sizes, state = start[order], length[order], before[order] ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-sizes, -_SHORT))
    for i in range(long):
        state[i] = zlib.crc32(raw[at[i] : at[i] + sizes[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    end = len(sizes)
    for p in range(_SHORT):
        end = int(np.searchsorted(-sizes, -p)) if p else end
        if end <= long:
            break
        s = state[long:end]
        state[long:end] = _CRC[(s ^ raw[at[long:end] + p]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(batch: pa.RecordBatch, least: int, noise: int | None) -> pa.Array:
    """The words of a batch (key, text). noise: a run whose CRC-32 with its row's key it divides loses the code point that the CRC names."""
    raw, at = buffers(batch.column(1))
    raw = LOWER[raw]
    lead = raw == 0xC3  # the lead byte of U+00C0 to U+00FF and of no other character
    letter = (raw >= 97) & (raw <= 122) | lead
    letter[1:] |= lead[:-1]
    start, stop = spans(letter, at)
    if not len(start):
        return pa.array([], pa.large_string())
    leads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    points = stop - start - (leads[stop] - leads[start])
    size = stop - start
    keep = np.ones(len(raw), bool)
    if noise:
        prefix = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in batch.column(0).to_pylist()], np.uint32)
        h = crcs(raw, start, stop, prefix[np.searchsorted(at, start, "right") - 1])
        hit = np.flatnonzero(h % noise == 0)
        begins = np.flatnonzero(letter & ~np.append(False, lead[:-1]))  # first bytes of letters
        gone = begins[np.searchsorted(begins, start[hit]) + (h[hit] % points[hit])]
        keep[gone] = False
        wide = gone[lead[gone]] + 1
        keep[wide] = False
        size[hit] -= 1 + lead[gone]
        points[hit] -= 1
    fine = points >= least
    data = gathered(raw, start[fine], (stop - start)[fine])
    kept = gathered(keep, start[fine], (stop - start)[fine])
    return strings(data[kept], size[fine])


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, noise: int | None = 97, seen: int = 3) -> DataFrame:
    """(word, n): words of at least ``least`` code points and ``seen`` occurrences over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                c = pc.value_counts(words_of(part, least, noise))
                if len(c):
                    yield pa.RecordBatch.from_arrays([c.field("values").cast(pa.string()), c.field("counts")], ["word", "n"])

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def codes(words: list[str], length: int) -> np.ndarray:
    """Letters as numbers from 0, a row for each word of that length."""
    x = np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length)
    return np.where(x < 128, x - 97, x - (0xC0 - 26)).astype(np.uint8)


def letter_counts(code: np.ndarray) -> np.ndarray:
    n, length = code.shape
    at = code + (np.arange(n, dtype=np.int64) * LETTERS)[:, None]
    return np.bincount(at.ravel(), minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int16 if length < 1 << 15 else np.int32)


def split(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, most on the left side) of the letter whose counts vary most; None if all are equal."""
    if len(counts) < 2:
        return None
    k = int(counts.var(0).argmax())
    x = counts[:, k]
    low, high, most = int(x.min()), int(x.max()), int(np.median(x))
    if low == high:
        return None
    if most > low and 4 * np.count_nonzero(x <= most) > 3 * len(x):
        most -= 1
    return k, min(most, high - 1)


@dataclass
class Tree:
    """Inner nodes by number: letter, limit, children; a child below 0 is the leaf -1 - child."""

    nodes: list[tuple[int, int, int, int]]

    @classmethod
    def fit(cls, counts: np.ndarray, leaf: int) -> Tree:
        nodes: list = []
        leaves = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal leaves
            cut = split(rows) if len(rows) > leaf else None
            if cut is None:
                leaves += 1
                return -leaves
            at = len(nodes)
            nodes.append(None)
            left = rows[:, cut[0]] <= cut[1]
            nodes[at] = (*cut, grow(rows[left]), grow(rows[~left]))
            return at

        grow(counts)
        return cls(nodes)

    def search(self, counts: np.ndarray, more: bool, fewer: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) whose box is within one more of some letter and one less of another, as far as allowed."""
        n = len(counts)
        todo = [(0 if self.nodes else -1, np.arange(n), np.full(n, more), np.full(n, fewer))]
        while todo:
            node, at, up, down = todo.pop()
            if node < 0:
                yield -1 - node, at
                continue
            k, most, left, right = self.nodes[node]
            for child, (ok, u, d) in ((left, to_left(counts[at, k], most, up, down)), (right, to_right(counts[at, k], most, up, down))):
                if ok.any():
                    todo.append((child, at[ok], u[ok], d[ok]))


def to_left(x: np.ndarray, most: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    over = x == most + 1
    return (x <= most) | over & down, up, down & ~over


def to_right(x: np.ndarray, most: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    under = x == most
    return (x > most) | under & up, up & ~under, down


def fitted(words: DataFrame, total: int, leaf: int, sample: int) -> dict[int, Tree]:
    """A tree for each length in a sample by hash; other lengths are one leaf."""
    share = min(1.0, sample / max(1, total))
    some = words.select("word") if share == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word").limit(2 * sample)
    by: dict[int, list[str]] = {}
    for w in some.toArrow().column("word").to_pylist():
        by.setdefault(len(w), []).append(w)
    return {n: Tree.fit(letter_counts(codes(ws, n)), max(16, int(leaf * share))) for n, ws in by.items()}


def routed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(length, leaf, kind, word, n): kind 0 where a word lies, 1 a search in its own leaf, 2 in others of its length, 3 of the next."""
    shared = words.sparkSession.sparkContext.broadcast(trees)
    none = Tree([])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                n = int(n)
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                counts = letter_counts(codes(part.column(0).to_pylist(), n))
                own = np.zeros(len(counts), np.int64)
                for leaf, at in shared.value.get(n, none).search(counts, False, False):
                    own[at] = leaf
                    yield _rows(part, at, n, leaf, 0)
                    yield _rows(part, at, n, leaf, 1)
                for leaf, at in shared.value.get(n, none).search(counts, True, True):
                    yield _rows(part, at[own[at] < leaf], n, leaf, 2)
                for leaf, at in shared.value.get(n + 1, none).search(counts, True, False):
                    yield _rows(part, at, n + 1, leaf, 3)

    return words.mapInArrow(route, "length int, leaf int, kind int, word string, n long")


def _rows(part: pa.RecordBatch, at: np.ndarray, length: int, leaf: int, kind: int) -> pa.RecordBatch:
    some = part.take(pa.array(at))
    same = lambda x: pa.array(np.full(len(at), x, np.int32))
    return pa.RecordBatch.from_arrays([same(length), same(leaf), same(kind), some.column(0), some.column(1)], ["length", "leaf", "kind", "word", "n"])


_WEIGHT = (mix(np.arange(1, LETTERS + 1, dtype=np.uint64)) % U(_SLOTS)).astype(np.int64)
_REPLACED, _INSERTED = np.zeros(_SLOTS, bool), np.zeros(_SLOTS, bool)
_REPLACED[((_WEIGHT[:, None] - _WEIGHT[None])[~np.eye(LETTERS, dtype=bool)]) % _SLOTS] = True
_INSERTED[_WEIGHT] = True


class Side:
    """Words of one length: letters, counts, and the sum of their letters' weights, whose difference tells most pairs that no single letter apart could give."""

    def __init__(self, words: list[str], length: int):
        self.code = codes(words, length) if words else np.zeros((0, length), np.uint8)
        self.counts = letter_counts(self.code)
        self.sum = _WEIGHT[self.code].sum(1) % _SLOTS if len(self.code) else np.zeros(0, np.int64)


def same_but_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ at one place."""
    return np.count_nonzero(a != b, axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of b that are those of a with one letter more: the equal beginning and the equal end cover a."""
    front = np.argmin(np.pad(a == b[:, :-1], ((0, 0), (0, 1))), axis=1)
    back = np.argmin(np.pad((a == b[:, 1:])[:, ::-1], ((0, 0), (0, 1))), axis=1)
    return front + back >= a.shape[1]


def near_pairs(queries: Side, data: Side, shorter: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, datum) pairs one edit apart, by a k-d tree over the data that all queries descend together."""
    n = len(queries.code)
    todo = [(np.arange(len(data.code)), np.arange(n), np.ones(n, bool), np.full(n, not shorter))]
    possible, verified = (_INSERTED, one_inserted) if shorter else (_REPLACED, same_but_one)
    while todo:
        d, q, up, down = todo.pop()
        if not len(d) or not len(q):
            continue
        cut = split(data.counts[d]) if len(d) > _FEW else None
        if cut:
            k, most = cut
            left = data.counts[d, k] <= most
            for side, (ok, u, w) in ((d[left], to_left(queries.counts[q, k], most, up, down)), (d[~left], to_right(queries.counts[q, k], most, up, down))):
                todo.append((side, q[ok], u[ok], w[ok]))
            continue
        if len(d) > _FEW:  # equal counts: the distance is known
            apart = data.counts[d[:1]].astype(np.int32) - queries.counts[q]
            q = q[(np.maximum(apart, 0).sum(1) == 1) & (np.maximum(-apart, 0).sum(1) == (0 if shorter else 1))]
        step = max(1, _PAIRS // len(d))
        for k in range(0, len(q), step):
            i, j = np.nonzero(possible[(data.sum[d][None] - queries.sum[q[k : k + step]][:, None]) % _SLOTS])
            i, j = q[k : k + step][i], d[j]
            few = max(1, _PAIRS // data.code.shape[1])
            for m in range(0, len(i), few):
                fine = verified(queries.code[i[m : m + few]], data.code[j[m : m + few]])
                yield i[m : m + few][fine], j[m : m + few][fine]


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, an, b, bn): the near pairs of a tile."""
    length = int(pdf["length"].iloc[0])
    of = {k: pdf[pdf["kind"] == k] for k in range(4)}
    data = Side(list(of[0]["word"]), length)
    out = []
    for kinds, size in (((1, 2), length), ((3,), length - 1)):
        q = pd.concat([of[k] for k in kinds])
        if not len(q) or not len(data.code):
            continue
        word, own = q["word"].to_numpy(), q["kind"].to_numpy() == 1
        names = of[0]["word"].to_numpy()
        for i, j in near_pairs(Side(list(word), size), data, size < length):
            once = ~own[i] | (word[i] < names[j])
            i, j = i[once], j[once]
            out.append(pd.DataFrame({"a": word[i], "an": q["n"].to_numpy()[i], "b": names[j], "bn": of[0]["n"].to_numpy()[j]}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "an": [], "b": [], "bn": []}).astype({"a": str, "an": "int64", "b": str, "bn": "int64"})


def near(words: DataFrame, leaf: int = 4096, tile: int = 8192, queries: int = 131_072, sample: int = 65_536) -> DataFrame:
    """(a, an, b, bn): every pair of written (word, n) one edit apart, once, with their counts."""
    rows = routed(words, fitted(words, words.count(), leaf, sample))
    tiles = (
        rows.groupBy("length", "leaf")
        .agg(F.count(F.when(F.col("kind") == 0, 1)).alias("lie"), F.count(F.when(F.col("kind") > 0, 1)).alias("come"))
        .select("length", "leaf", F.ceil(F.col("lie") * F.greatest(F.lit(64), "length") / F.lit(tile * 64)).cast("int").alias("blocks"), F.ceil(F.col("come") * F.greatest(F.lit(64), "length") / F.lit(queries * 64)).cast("int").alias("chunks"))
        .where("blocks > 1 or chunks > 1")
    )
    dealt = rows.join(tiles, ["length", "leaf"], "left").withColumns({"blocks": F.greatest(F.coalesce("blocks", F.lit(1)), F.lit(1)), "chunks": F.greatest(F.coalesce("chunks", F.lit(1)), F.lit(1))})
    lies = F.col("kind") == 0
    own = F.pmod(F.xxhash64("word"), F.when(lies, F.col("blocks")).otherwise(F.col("chunks"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(lies, F.col("chunks")).otherwise(F.col("blocks")) - 1)))
    dealt = dealt.select("length", "leaf", F.when(lies, F.col("own")).otherwise(F.col("other")).alias("block"), F.when(lies, F.col("other")).otherwise(F.col("own")).alias("chunk"), "kind", "word", "n")
    return dealt.groupBy("length", "leaf", "block", "chunk").applyInPandas(compare, "a string, an long, b string, bn long")


def rooted(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) of written (word, form) rows whose counts at least double with each form."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max_rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")
    raise RuntimeError("forms run in a circle")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, noise: int | None = None, seen: int = 3, times: int = 2, **sizes: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root): a form is the near word of largest count if that is ``times`` (2 or more) the word's own."""
    words = written(counted_words(docs, key, text, least, noise, seen), "words")
    pairs = written(near(words, **sizes), "near")
    both = pairs.union(pairs.select("b", "bn", "a", "an"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("bn")).alias("n"), F.col("b").alias("w"))).alias("m"))
    fine = -F.col("m.n") >= F.lit(times).cast("decimal(20,0)") * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fine, F.col("m.w")).alias("form"), F.when(fine, -F.col("m.n")).alias("form_n"))
    found = written(found, "forms")
    roots = rooted(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"), noise=97).select("word", "form", "root", "n", "n_near", "form_n")
