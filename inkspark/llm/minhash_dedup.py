"""Near duplicates by Order MinHash.

A text's k-mers are its runs of five words, labelled with their occurrence. Each of ``sketches`` hash functions samples the
``sample`` smallest labelled k-mers and keeps them in text order; their hash is a bucket, so texts meet if some sketch agrees in
content and order - likely when their edit similarity is high. Candidates are verified by a banded alignment of their whole
word sequences: 1 - edits / words of the longer >= ``similarity`` (0.8). Linked texts form classes by connected components.
80 sketches of 2 k-mers find a pair at the limit itself, edits scattered, with a probability of 0.95; README has the measured curve.

Equal texts are collapsed first (a partial aggregate of digests), so copies cost nothing later. In a bucket every text is first
aligned with the bucket's smallest id: G - 1 alignments for a group of G, not G**2. In buckets in which that leaves different classes -
of texts that share a passage or line, say - the texts are also aligned with a member of another class that a hash of
bucket and id picks, so a new one in each of a text's buckets. Last, a prefix filter over the five-word shingles of all texts of
such buckets finds what is left: exactly all pairs of a Jaccard similarity of ``similarity`` or more. What a crowd has in common is frequent and so not
in a prefix, while its members' own words are, so a shared passage makes no pairs. The rules are the same for every bucket, whatever its size.

Candidates pass a signature of 128 bytes before their texts are moved: one-permutation minima of the labelled words, of which
similar texts share 2/3 in expectation; pairs more than 4.5 standard deviations below go (a loss of 1 in 300,000).

Edge cases: a null text is in a class of its own, never a copy; texts without a word are copies only of equal texts; texts of
under five words have one k-mer, and a few words changed in a text of few leave no common k-mer; rows that repeat an id share its
class; other columns are ignored by ``classes``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import components, contracted, hot_join, roots_so_far, table, written
from inkspark.llm.textvec import WORD, U, mix, pieces, words

K, PLACES = 5, 128
COMPACT = "zstd"  # of the texts, which are written once and read often
BROADCAST_ROWS = 200_000  # ids of 8 bytes, or two of them
_C = mix(np.arange(1, K + 1, dtype=np.uint64) * U(0x51ED270B8A4F7C35)) | U(1)


def kmers(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled k-mers, offsets): runs of K words of each row, all words where there are fewer."""
    n = np.diff(at)
    size = np.where(n >= K, n - K + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(n)), size)
    start = at[:-1][row] + np.arange(off[-1]) - off[:-1][row]
    x = np.zeros(len(start), np.uint64)
    padded = np.concatenate([h, np.zeros(K, np.uint64)])
    for j in range(K):
        w = padded[start + j] * _C[j]
        x += np.where(start + j < at[1:][row], w, U(j + 1))
    return labelled(mix(x), row), off


def sketch(x: np.ndarray, sketches: int, sample: int) -> np.ndarray:
    """Order MinHash of one text's labelled k-mers: a hash for each sketch."""
    seed = mix(np.arange(1, sketches + 1, dtype=np.uint64))
    places = np.zeros((sketches, 0), np.int64)
    for lo in range(0, len(x), 32_768):
        here = np.arange(lo, min(lo + 32_768, len(x)))
        rank = np.concatenate([_rank(x[places], seed), _rank(x[here][None], seed)], 1)
        best = []
        for _ in range(min(sample, rank.shape[1])):
            best.append(rank.argmin(1))
            rank[np.arange(sketches), best[-1]] = U(0xFFFFFFFFFFFFFFFF)
        old, best = places, np.stack(best, 1)
        places = np.where(best < old.shape[1], np.take_along_axis(old, np.minimum(best, old.shape[1] - 1), 1) if old.shape[1] else 0, best - old.shape[1] + lo)
    picked = x[np.sort(places, 1)]
    out = seed.copy()
    for j in range(picked.shape[1]):
        out = mix(out * U(0x9FB21C651E98DF25) + picked[:, j])
    return out


def _rank(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return (x ^ seed[:, None]) * (mix(seed)[:, None] | U(1))


def labelled(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes told apart by their occurrence in their row."""
    by = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (row[by][1:] != row[by][:-1])
    run = np.flatnonzero(new)
    occurrence = np.zeros(len(h), np.uint64)
    occurrence[by] = (np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))).astype(np.uint64)
    return mix(h + occurrence * U(0xC2B2AE3D27D4EB4F))


CELLS = 4_000_000


def edits(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[int | None]:
    """For each (a, b, most): their edit distance if at most ``most``, by an alignment in the band of diagonals that so many edits can reach.

    Pairs are aligned side by side in tables of ``CELLS`` cells at most; what is larger goes alone, in memory of the texts' size.
    """
    out: list[int | None] = [None] * len(pairs)
    cut = []
    for p, (a, b, most) in enumerate(pairs):
        short = min(len(a), len(b))
        if max(len(a), len(b)) - short > most:
            continue
        # what both begin and end with is never edited
        differ = np.flatnonzero(a[:short] != b[:short])
        head = int(differ[0]) if len(differ) else short
        a, b, short = a[head:], b[head:], short - head
        differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
        tail = int(differ[0]) if len(differ) else short
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a) or not len(b):
            out[p] = max(len(a), len(b))
        else:
            cut.append((len(a), len(_band(len(a), len(b), most)), p, a, b, most))
    cut.sort(key=lambda x: x[:3])
    group: list = []
    for one in [*cut, None]:
        if group and (one is None or (len(group) + 1) * (one[0] + 1) * max(one[1], *(g[1] for g in group)) > CELLS):
            alone = (group[0][0] + 1) * group[0][1] > CELLS
            found = [_diagonals(*group[0][3:])] if alone else _banded([g[3:] for g in group])
            for g, e in zip(group, found, strict=True):
                out[g[2]] = e
            group = []
        group.append(one)
    return out


def _band(n: int, m: int, most: int) -> np.ndarray:
    """Diagonals that a path of at most ``most`` edits can touch: beyond those between the corners half of the edits left lead out, half back."""
    spare = (most - abs(n - m)) // 2
    return np.arange(min(0, m - n) - spare, max(0, m - n) + spare + 1)


def _banded(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[int | None]:
    """Furthest-reaching points of all diagonals of all pairs' bands at once; next mismatches come from one table."""
    n, m, most = (np.array(x)[:, None] for x in zip(*((len(a), len(b), t) for a, b, t in pairs), strict=True))
    spare = (most - np.abs(n - m)) // 2
    first, last = np.minimum(0, m - n) - spare, np.maximum(0, m - n) + spare
    rows, wide = int(n.max()) + 1, int((last - first).max()) + 1
    d = first + np.arange(wide)
    i = np.arange(rows, dtype=np.int32)
    size = int(m.max())
    a, b = np.zeros((len(pairs), rows), np.uint64), np.zeros((len(pairs), size), np.uint64)
    for p, (x, y, _) in enumerate(pairs):
        a[p, : len(x)], b[p, : len(y)] = x, y
    at = i[None, :, None] + d[:, None, :]
    stop = (at < 0) | (at >= m[:, :, None]) | (i[None, :, None] >= n[:, :, None])
    np.clip(at, 0, size - 1, out=at)
    at += (np.arange(len(pairs)) * size)[:, None, None]
    stop |= b.ravel()[at] != a[:, :, None]
    nxt = np.where(stop, i[None, :, None], np.int32(rows))
    np.minimum.accumulate(nxt[:, ::-1], 1, out=nxt[:, ::-1])
    nxt = nxt.ravel()
    base = (np.arange(len(pairs)) * rows * wide)[:, None] + np.arange(wide)
    end, low, mine, steps = np.minimum(n, m - d), np.maximum(0, -d), d <= last, np.abs(d)
    far = np.full((len(pairs), wide + 2), -2, np.int64)
    row = np.arange(len(pairs))
    far[row, 1 - first[:, 0]] = nxt[base[row, -first[:, 0]]]
    goal, n, most = 1 + (m - n - first)[:, 0], n[:, 0], most[:, 0]
    out: list[int | None] = [None] * len(pairs)
    open_ = np.ones(len(pairs), bool)
    for e in range(int(most.max()) + 1):
        for p in np.flatnonzero(open_ & (far[row, goal] >= n)):
            out[p] = e
            open_[p] = False
        open_ &= most > e
        if not open_.any():
            break
        k = np.minimum(np.maximum(np.maximum(far[:, 1:-1] + 1, far[:, :-2]), far[:, 2:] + 1), end)
        ok = mine & (k >= low) & (steps <= e + 1)
        far[:, 1:-1] = np.where(ok, nxt[base + np.maximum(k, 0) * wide], -2)
    return out


def _diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The same for long texts, whose table would be large: all diagonals at once slide by powers of two over hashes of runs, in memory of the texts' size."""
    n, m = len(a), len(b)
    d = _band(n, m, most)
    lo = int(d[0])
    end = np.minimum(n, m - d)
    steps = int(min(n, m)).bit_length()
    runs = [[a, b]]
    for s in range(1, steps):
        half = 1 << (s - 1)
        if len(runs[-1][0]) <= half or len(runs[-1][1]) <= half:
            break
        runs.append([mix(x[:-half] * U(0x9FB21C651E98DF25) + x[half:]) for x in runs[-1]])

    def slide(i: np.ndarray, on: np.ndarray) -> np.ndarray:
        i = i.copy()
        for s in range(len(runs) - 1, -1, -1):
            x, y = runs[s]
            step = 1 << s
            # the longest step is repeated; of the others one is enough
            while True:
                ok = on & (i + step <= end)
                at = np.flatnonzero(ok)
                at = at[x[i[at]] == y[i[at] + d[at]]]
                i[at] += step
                if s < len(runs) - 1 or not len(at):
                    break
        return i

    far = np.full(len(d) + 2, -2, np.int64)
    zero, goal = -lo + 1, m - n - lo + 1
    far[zero] = slide(np.zeros(len(d), np.int64), d == 0)[zero - 1]
    for e in range(most + 1):
        if far[goal] >= n:
            return e
        i = np.minimum(np.maximum(np.maximum(far[1:-1] + 1, far[:-2]), far[2:] + 1), end)
        on = (i >= 0) & (i + d >= 0) & (np.abs(d) <= e + 1)
        far[1:-1] = np.where(on, slide(np.where(on, i, 0), on), -2)
    return None


def anchored(a: np.ndarray, b: np.ndarray, k: int = 3) -> int:
    """Edits of one alignment, so an upper bound: the n-th occurrences of runs of k words are matched in order, gaps cost their longer side."""
    if min(len(a), len(b)) < k:
        return max(len(a), len(b))
    at = []
    for x in (a, b):
        grams = np.zeros(len(x) - k + 1, np.uint64)
        for j in range(k):
            grams = grams * U(0x9FB21C651E98DF25) + x[j : len(x) - k + 1 + j]
        by = np.argsort(grams, kind="stable")
        run = np.flatnonzero(np.append(True, grams[by][1:] != grams[by][:-1]))
        nth = np.empty(len(grams), np.uint64)
        nth[by] = (np.arange(len(grams)) - np.repeat(run, np.diff(np.append(run, len(grams))))).astype(np.uint64)
        at.append(mix(grams + nth * U(0xC2B2AE3D27D4EB4F)))
    _, i, j = np.intersect1d(*at, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    # longest increasing chain of the places in b
    tails, ends, back = [], [], np.full(len(j), -1)
    for n, place in enumerate(j.tolist()):
        p = bisect_left(tails, place)
        if p == len(tails):
            tails.append(place)
            ends.append(n)
        else:
            tails[p], ends[p] = place, n
        back[n] = ends[p - 1] if p else -1
    chain = []
    n = ends[-1] if ends else -1
    while n >= 0:
        chain.append(n)
        n = back[n]
    i, j = i[chain[::-1]], j[chain[::-1]]
    # word by word, strictly increasing in both
    x, y = (np.repeat(v, k) + np.tile(np.arange(k), len(v)) for v in (i, j))
    ok = np.ones(len(x), bool)
    if len(x):
        ok[1:] = (x[1:] > np.maximum.accumulate(x)[:-1]) & (y[1:] > np.maximum.accumulate(y)[:-1])
    x, y = np.concatenate([[-1], x[ok], [len(a)]]), np.concatenate([[-1], y[ok], [len(b)]])
    return int(np.maximum(np.diff(x) - 1, np.diff(y) - 1).sum())


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Whether each pair of word sequences has the edit similarity asked for.

    Bounds first: e edits leave max(n, m) - 1 - 2e common word pairs at least, and hashing pairs to bins only adds to those in common;
    an alignment over common runs of words that has few enough edits decides too. What is left is aligned in bands.
    """
    ok = np.zeros(len(pairs), bool)
    left = []
    for p, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        most = int((1 - similarity) * longer + 1e-9)
        if not longer or abs(len(a) - len(b)) > most:
            continue
        bins = 1 << int(4 * longer).bit_length()
        counts = [np.bincount(((x[:-1] * U(0x9FB21C651E98DF25) + x[1:]) >> U(40) & U(bins - 1)).astype(np.int64), minlength=bins) for x in (a, b)]
        if np.minimum(*counts).sum() < longer - 1 - 2 * most:
            continue
        ok[p] = anchored(a, b) <= most
        if not ok[p]:
            left.append((p, (a, b, most)))
    for (p, _), e in zip(left, edits([x for _, x in left]), strict=True):
        ok[p] = e is not None
    return ok


def sketched(texts: DataFrame, sketches: int, sample: int) -> DataFrame:
    """(id, bucket) for each sketch of each text of (id, text) that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                x, at = kmers(*words(piece.column(1), WORD))
                has = np.flatnonzero(np.diff(at))
                if len(has):
                    out = np.concatenate([sketch(x[at[r] : at[r + 1]], sketches, sample) for r in has])
                    ids = piece.column(0).take(pa.array(np.repeat(has, sketches)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(out.view(np.int64))], ["id", "bucket"])

    return texts.select("id", "text").mapInArrow(run, "id long, bucket long")


def signed(texts: DataFrame) -> DataFrame:
    """(id, n, sign): the number of words, and of the labelled words' smallest in each of ``PLACES`` parts of the hashes one byte, 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, at = words(piece.column(1), WORD)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                x = labelled(h, row)
                low = np.full((len(at) - 1) * PLACES, 0xFFFFFFFFFFFFFFFF, np.uint64)
                np.minimum.at(low, row * PLACES + (x % U(PLACES)).astype(np.int64), x)
                byte = np.where(low == U(0xFFFFFFFFFFFFFFFF), U(0), (low >> U(20)) % U(255) + U(1)).astype(np.uint8).reshape(-1, PLACES)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(at).astype(np.int32)), pa.array([x.tobytes() for x in byte], pa.binary())], ["id", "n", "sign"])

    return texts.select("id", "text").mapInArrow(run, "id long, n int, sign binary")


def likely(pairs: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) pairs that their lengths and signatures leave open.

    Texts that share ``similarity`` of the longer's words agree in a place with probability similarity / (2 - similarity) at least.
    """
    share = similarity / (2 - similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (c.to_numpy() for c in batch.columns[2:4])
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, PLACES) for c in batch.columns[4:])
                some = ((x > 0) | (y > 0)).sum(1)
                agree = ((x == y) & (x > 0)).sum(1)
                ok = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (agree >= share * some - 4.5 * np.sqrt(share * (1 - share) * some))
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs
    for side in ("a", "b"):
        both = both.join(signs.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sign").alias(f"sign_{side}")), side)
    return both.select("a", "b", "n_a", "n_b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) pairs whose whole texts align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text_a", 2 << 20):
                (ha, oa), (hb, ob) = words(piece.column(2), WORD), words(piece.column(3), WORD)
                ok = similar([(ha[oa[r] : oa[r + 1]], hb[ob[r] : ob[r + 1]]) for r in range(piece.num_rows)], similarity)
                yield piece.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    n = ids.count()
    if n <= BROADCAST_ROWS:  # else the joins below find them
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    # few bytes of pairs are much work: as many tasks as there are partitions, dealt by b, which unlike a is in few pairs
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").repartition(parts, "b")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shingles(texts: DataFrame) -> DataFrame:
    """(id, root, n, k): the labelled k-mers of each text of (id, root, text), and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                x, at = kmers(*words(piece.column(2), WORD))
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                own = piece.select([0, 1]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n[row].astype(np.int32)), pa.array(x.view(np.int64))], ["id", "root", "n", "k"])

    return texts.select("id", "root", "text").mapInArrow(run, "id long, root long, n int, k long")


def sharing(placed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different roots among which are all of a Jaccard similarity of labelled shingles >= ``similarity``, by prefix filtering.

    Two such sets share one of their (1 - similarity) * n + 1 rarest shingles. placed: (id, root). Frequent shingles' counts are broadcast, the rest joined.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    rows = written(shingles(texts.join(placed, "id").repartition(parts)), "shingles")  # crowds sit together in some buckets' tasks: dealt evenly
    df = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "k"))
    ranked = hot_join(rows, df, "k", "df").withColumn("r", rank)
    prefix = ranked.where((F.col("r") <= F.floor((1 - similarity) * F.col("n") + 1e-9) + 1) & (F.col("df") > 1))
    prefix = written(prefix.select("id", "root", "n", "k"), "prefixes")
    shared = prefix.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("k")
    left = prefix.join(shared, "k", "left_semi")
    right = left.select("k", F.col("id").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"))
    sizes = (F.col("n_b") >= similarity * F.col("n") - 1e-9) & (F.col("n") >= similarity * F.col("n_b") - 1e-9)
    return left.join(right, "k").where((F.col("id") < F.col("b")) & (F.col("root") != F.col("root_b")) & sizes).select(F.col("id").alias("a"), "b").distinct()


def starred(open_: DataFrame, few: int | None = None) -> DataFrame:
    """Pairs (a, b) of different roots: the smallest id of each bucket of (bucket, id, root, rep), and the next smallest by a hash, with all its members.

    With ``few``, each text meets those of so many of its buckets only, chosen by a hash.
    """
    lowest = F.min(F.when(F.col("id") == F.col("rep"), F.struct(F.lit(0).cast("long").alias("h"), "id", "root")))
    drawn = F.min(F.when(F.col("id") != F.col("rep"), F.struct(F.xxhash64("bucket", "id").alias("h"), "id", "root")))
    tops = written(open_.groupBy("bucket").agg(F.array(lowest, drawn).alias("tops")), "tops")
    if few:
        open_ = open_.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("bucket", "id"), "bucket"))).where(F.col("r") <= few)
    met = open_.join(tops, "bucket").select("id", F.expr("transform(filter(tops, t -> t.root <> root), t -> t.id)").alias("tops"))
    return met.select(F.explode("tops").alias("a"), F.col("id").alias("b")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, sketches: int = 80, sample: int = 2) -> DataFrame:
    """(id, class_id) for every distinct id with a text: class_id is the smallest id of the class."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    digest = F.struct(F.md5(F.col("text").cast("binary")), F.octet_length("text"))
    copies = written(rows.select("id", digest.alias("digest")), "digests")
    first = written(copies.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    same = written(hot_join(copies, first, "digest", "n").select("id", "first"), "same")
    repeats = _repeats(copies)
    texts = rows.join(first.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    texts = written(texts.dropDuplicates(["id", "text"]) if repeats else texts, "texts", COMPACT)
    buckets = written(sketched(texts, sketches, sample), "buckets")
    low = buckets.groupBy("bucket").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "rep")
    met = written(buckets.join(low, "bucket"), "met")
    signs = written(signed(texts), "signs")
    # first each text with the smallest id that it meets most often; then what is in different classes still
    pairs = met.where("id != rep").groupBy("id", "rep").agg(F.count(F.lit(1)).alias("times")).groupBy("id").agg(F.max(F.struct("times", (-F.col("rep")).alias("low"))).alias("m"))
    pairs = written(likely(pairs.select((-F.col("m.low")).alias("a"), F.col("id").alias("b")), signs, similarity), "pairs")
    links = written(verified(pairs, texts, similarity), "links")
    stars = contracted(links, 1)  # stands for the links so far: the same components
    placed = met.join(roots_so_far(stars), "id", "left").select("bucket", "id", "rep", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    open_ = written(placed.join(mixed, "bucket", "left_semi"), "open")
    if open_.head(1):
        # a few buckets of each text join most of what can be joined, so that few pairs of the second round, in all buckets, are left in different classes
        for few in (4, None):
            near = written(likely(starred(open_, few), signs, similarity), "near")
            stars = contracted(stars.unionByName(written(verified(near, texts, similarity), "links")), 1)
            open_ = written(open_.drop("root").join(roots_so_far(stars), "id", "left").withColumn("root", F.coalesce("root", "id")), "open")
        across = written(likely(sharing(open_.select("id", "root").distinct(), texts, similarity), signs, similarity), "across")
        stars = stars.unionByName(written(verified(across, texts, similarity), "links"))
    # equal texts whose id repeats with another text join their classes
    edges = stars.unionByName(same.where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))) if repeats else stars
    roots = components(edges)
    return same.join(roots.select(F.col("id").alias("first"), "root"), "first", "left").groupBy("id").agg(F.min(F.coalesce("root", "first")).alias("class_id"))


def _repeats(copies: DataFrame) -> bool:
    """Whether some id is on more than one row."""
    return bool(copies.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs)
    out = docs.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: one document of each class stays, the one with the smallest id; rows without id or text stay.

    Where ids repeat, rows are told apart by their place: of a class its first row stays, and texts that merely share an id all do.
    """
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"))
    if not _repeats(ids):
        gone = classes(docs).where("id != class_id").select(F.col("id").alias("_gone"))
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    rows = written(docs.select(F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("row"), F.struct(*docs.columns).alias("doc")), "rows")
    found = classes(rows.select("row", F.col("doc.text").alias("text")), key="row")
    gone = found.where("id != class_id").select(F.col("id").alias("row"))
    return rows.join(gone, "row", "left_anti").select("doc.*")
