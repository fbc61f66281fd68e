"""Language-model scores by a weighted backoff automaton.

States are the empty context and all n-grams shorter than ``order`` that are words or occur twice; an arc carries the log10 probability of
a word after a state, a failure arc the log10 backoff weight to the state without its oldest word. The empty context's probabilities
are (c + 1/2)/(N + (V + 1)/2), those of the base score, in which all unknown words are one more type; above, absolute
discounting (D = 3/4) interpolates them. They sum to one over the V words and the unknown one in every state. A text
is read once from left to right: at each token the longest state takes an arc, or failure arcs down to one that has it. In
logarithms that is a sum: each n-gram read adds its ``gain`` (arc over failure arc and shorter state's arc), and as a state its failure weight;
n-grams that the automaton lacks add nothing.

Scale. The automaton holds every word and every n-gram of two occurrences, whatever their share of the corpus. The most frequent ones,
1/word_share words and 1/arc_share n-grams of each order at most and never more than 250,000, are broadcast, so none of the others is a hot key; those stay in tables
that grow with the corpus, and texts get them by a join of (text, hash, times). N-grams are counted twice: their fingerprints in sorted blocks, of which
those of two occurrences make a Bloom filter of fixed size, then the n-grams in the filter by their two (n-1)-grams. Texts ask only for what the filter
holds; its false positives add rows to a count or a join, nothing else. Words and n-grams are known by 64-bit hashes.

Edge cases: a null or empty text is one end token; without training texts N is 0, every token is unknown and its probability 1
(the one outcome of an empty vocabulary); repeated rows are scored each, told apart by ``row``; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import crc_mod, empty, hot_join, small_batches, written
from inkspark.llm.runs import Sieve, in_blocks, of_blocks
from inkspark.llm.textvec import NOT_SPACE, Counts, U, counted, follow, mix, pieces, words

DISCOUNT = 0.75
_PIECE = 1 << 19
_BROADCAST = 250_000  # words, and n-grams of an order, whatever the shares
_HELD = 500_000  # n-grams that a task sums before it sends them
END = mix(np.array([0x656E64], np.uint64))[0]


def token_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each row's words, offsets)."""
    h, at = words(column, NOT_SPACE)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x, -1 if absent."""
    if not len(sorted_keys):
        return np.full(len(x), -1, np.int64)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == x, at, -1)


def gram_keys(tokens: np.ndarray, at: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By n up to ``order``: (hash of the n-gram that ends at each token, made of those of its two (n-1)-grams; does it lie within its row)."""
    key, ok = tokens, np.ones(len(tokens), bool)
    first = np.zeros(len(tokens), bool)
    first[at[:-1]] = True
    yield key, ok
    for _ in range(1, order):
        longer, within = np.zeros(len(tokens), np.uint64), np.zeros(len(tokens), bool)
        longer[1:], within[1:] = follow(key[:-1], key[1:]), ok[:-1] & ok[1:] & ~first[1:]
        key, ok = longer, within
        yield key, ok


class OneWord(Sieve):
    """A sieve whose keys set their bits in one word each, so that a key is one row of the union."""

    @staticmethod
    def places(keys: np.ndarray, shift: np.uint64) -> Iterator[np.ndarray]:
        h = mix(keys)
        word = (h >> shift) & ~U(63)
        for k in range(Sieve.HASHES):
            yield word | ((h >> U(6 * k)) & U(63))


@dataclass
class Automaton:
    """The broadcast part, by order: ``keys[n-1]`` the sorted hashes of frequent n-grams, ``gain[n-1]`` and ``fail[n-1]`` their log10 terms as arcs and as states.

    ``sieves[n-1]`` holds all other n-grams of the automaton, which are in a table; None if there are no others.
    """

    total: int
    types: int
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    fail: list[np.ndarray] = field(default_factory=list)
    sieves: list[Sieve | None] = field(default_factory=list)

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        """Of the empty context; a count of 0 is that of all unknown words, one type beside the known ones."""
        return (count + 0.5) / (self.total + 0.5 * (self.types + 1))

    def walk(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """One traversal from left to right, in columns: for each token (log10 probability, is it a frequent word, its place among them), and by order (n-gram, is it to be asked for).

        The probability lacks what the tables add: the terms of the n-grams to be asked for, and for a word that isn't frequent the empty context's arc.
        """
        log_p, ask = np.zeros(len(tokens)), []
        first = np.zeros(len(tokens), bool)
        first[at[:-1]] = True
        for n, (key, ok) in enumerate(gram_keys(tokens, at, len(self.keys))):
            held = np.full(len(tokens), -1, np.int64)
            held[ok] = find(self.keys[n], key[ok])
            hit = held >= 0
            if not n:
                word = held
            log_p[hit] += self.gain[n][held[hit]]
            after = np.flatnonzero(hit[:-1] & ~first[1:]) if len(hit) else np.zeros(0, np.int64)
            log_p[after + 1] += self.fail[n][held[after]]
            rest = ok & ~hit
            if self.sieves[n] is None:
                rest[:] = False
            else:
                rest[rest] = self.sieves[n].holds(key[rest])
            ask.append((key, rest))
        return log_p, word >= 0, word, ask


class _Grams:
    """Running counts of n-grams with the hashes of their first and last n - 1 words."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, key: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        k, i, of = np.unique(key, return_index=True, return_inverse=True)
        self.parts.append((k, np.bincount(of, n, len(k)).astype(np.int64), a[i], b[i]))
        self.n += len(k)

    def merge(self) -> None:
        parts, self.parts, self.n = self.parts, [], 0
        if parts:
            self.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for _, n, a, b in self.parts:
            for j in range(0, len(n), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[j : j + 200_000]) for x in (a.view(np.int64), b.view(np.int64), n)], ["a", "b", "n"])
        self.parts, self.n = [], 0


def _emit(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(k), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 200_000].view(np.int64)), pa.array(c[i : i + 200_000])], ["key", "n"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n) of every token, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for piece in pieces(batch, "text"):
                counts.add(token_rows(piece.column(0))[0])
                if full := counts.full():
                    yield from _emit(*full)
        yield from _emit(*counts.merged())

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def twice(docs: DataFrame, n: int, sieves: list[Sieve], log_blocks: int) -> DataFrame:
    """(k): fingerprints of the n-grams that occur twice, cut to their first ``log_blocks`` + 32 bits; longer ones only where their parts are in the last sieve."""
    shared, drop = docs.sparkSession.sparkContext.broadcast(sieves), U(32 - log_blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counts(_HELD)
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                sums.add(passing(piece.column(0), n, shared.value)[0] >> drop)
                if full := sums.full():
                    yield in_blocks(*full, 2)
        yield in_blocks(*sums.merged(), 2)

    def sum_up(rows: pa.Table) -> pa.Table:
        k, c = counted(*of_blocks(rows, 2))
        return pa.table({"k": pa.array(k[c >= 2].view(np.int64))})

    return docs.mapInArrow(count, "block long, gaps binary, n binary").groupBy("block").applyInArrow(sum_up, "k long")


def passing(column: pa.Array, n: int, sieves: list[Sieve]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hashes of the first and the last n - 1 words) of a column's n-grams whose own fingerprint, or else whose parts', the sieves of 2, 3 and more words hold."""
    steps = list(gram_keys(*token_rows(column), n))
    (part, _), (key, ok) = steps[-2:]
    at = np.flatnonzero(ok)
    if len(sieves) == n - 1:
        at = at[sieves[-1].holds(key[at])]
    elif sieves:
        held = np.zeros(len(part), bool)
        held[steps[-2][1]] = sieves[-1].holds(part[steps[-2][1]])
        at = at[held[at] & held[at - 1]]
    return key[at], part[at - 1], part[at]


def gram_counts(docs: DataFrame, n: int, sieves: list[Sieve]) -> DataFrame:
    """(a, b, n) of the n-grams of two occurrences: hashes of their first and last n - 1 words."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                key, a, b = passing(piece.column(0), n, shared.value)
                grams.add(key, np.ones(len(key), np.int64), a, b)
                if grams.n > _HELD:
                    grams.merge()
                    if grams.n > _HELD // 2:
                        yield from grams.batches()
        yield from grams.batches()

    return docs.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n >= 2")


def with_arcs(grams: DataFrame, states: DataFrame) -> DataFrame:
    """(key, n, p, gain) of written (a, b, n) and the states (key, n, p, fail) of one word less."""
    first = states.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "fail")
    last = states.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("p").alias("lower"))
    both = hot_join(hot_join(grams, first, "a", "n_a", 50_000), last, "b", "n_b", 50_000)
    p = (F.col("n") - DISCOUNT) / F.col("n_a") + F.col("fail") * F.col("lower")
    rows = both.select("a", "b", "n", p.alias("p"), (F.log10(p) - F.log10("fail") - F.log10("lower")).alias("gain"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (x.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(follow(a, b).view(np.int64)), *x.columns[2:]], ["key", "n", "p", "gain"])

    return rows.mapInArrow(key, "key long, n long, p double, gain double")


def most_frequent(table: DataFrame, most: int) -> Column | None:
    """What tells the most frequent rows of (key, n), ``most`` of them at most, from the others; None if that is all of them."""
    size = F.floor(F.log2("n") * 16)
    bins = sorted(table.groupBy(size.alias("size")).count().collect(), reverse=True)
    least, held = 1 << 20, 0
    for b, c in bins:
        held += c
        if held > most:
            return size >= least
        least = b
    return None


def train(docs: DataFrame, text: str = "text", order: int = 3, word_share: float = 1e-6, arc_share: float = 1e-6) -> tuple[Automaton, DataFrame]:
    """The automaton's broadcast part and the written table (key, known, base, value) of all its other words and n-grams.

    At most 1/word_share words and 1/arc_share n-grams of each order, the most frequent ones, are broadcast, and never more than ``_BROADCAST``.
    """
    rows = docs.select(F.col(text).alias("text"))
    table = written(word_counts(docs, text), "words")
    total, types = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model, rest = Automaton(int(total), int(types)), []
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_blocks = min(31, max(4, (size // (8 << 20)).bit_length()))
    p = (F.col("n") + 0.5) / F.lit(model.total + 0.5 * (model.types + 1))
    level, sieves = table.select("key", "n", p.alias("p"), F.log10(p).alias("gain")), []
    for n in range(1, order + 1):
        if n < order:
            with small_batches(docs.sparkSession):
                sieves.append(OneWord.of(twice(rows, n + 1, sieves, log_blocks), "k", drop=32 - log_blocks))
                grams = written(gram_counts(rows, n + 1, sieves), "grams")
            left = grams.groupBy(F.col("a").alias("key")).agg(F.sum(F.col("n") - DISCOUNT).alias("kept"))
            fail = F.greatest(F.lit(1e-12), 1 - F.coalesce("kept", F.lit(0.0)) / F.col("n"))
            level = written(level.join(left, "key", "left").select("key", "n", "p", "gain", fail.alias("fail")), "states")
        else:
            level = level.withColumn("fail", F.lit(1.0))
        top = most_frequent(level, min(_BROADCAST, int(1 / (word_share if n == 1 else arc_share))))
        held = (level if top is None else level.where(top)).select("key", "n", "gain", F.log10("fail").alias("fail")).toPandas().sort_values("key", key=lambda k: k.astype(np.uint64))
        model.keys.append(held["key"].to_numpy(np.int64).view(np.uint64))
        model.gain.append(held["gain"].to_numpy(float))
        model.fail.append(held["fail"].to_numpy(float))
        if n == 1:
            model.counts = held["n"].to_numpy(np.int64)
        model.sieves.append(None)
        if top is not None:
            others = level.where(~top)
            model.sieves[-1] = sieves[n - 2] if n > 1 else OneWord.of(others, "key")
            # a text adds the unknown word's arc for every word that isn't broadcast
            base = F.log10((F.col("n") + 0.5) / 0.5) if n == 1 else F.lit(0.0)
            gain = base if n == 1 else F.col("gain")
            rest.append(others.select("key", F.lit(n == 1).cast("int").alias("known"), base.alias("base"), (gain + F.log10("fail")).alias("value")))
        if n < order:
            level = with_arcs(grams, level)
            level = written(level if n + 1 < order else level.drop("p"), "arcs")
    return model, functools.reduce(DataFrame.union, rest) if rest else empty(docs.sparkSession, REST)


REST = "key long, known int, base double, value double"
ASKED = "key long, row long, times int, own struct<doc_id long, held_out boolean, n_tokens long, known long, base double, score double>"


def score(docs: DataFrame, model: Automaton, table: DataFrame, text: str = "text", key: str = "doc_id", flag: str = "held_out") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; written.

    What a text asks of the table goes from the walk straight into the join, with the text's ``own`` sums as one more row, so it is on disk once. ``docs``
    must give its rows in the same order where a task is run again, as files do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base = np.log10(m.word_probability(m.counts))
        unknown = float(np.log10(m.word_probability(np.zeros(1)))[0])
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                n = piece.num_rows
                tokens, at = token_rows(piece.column(3))
                log_p, frequent, word, ask = m.walk(tokens, at)
                row = np.repeat(np.arange(n), np.diff(at))
                plain = np.full(len(tokens), unknown)
                plain[frequent] = base[word[frequent]]
                sums = [np.bincount(row, minlength=n), np.bincount(row[frequent], minlength=n)]
                floats = [np.bincount(row, plain, n), np.bincount(row, log_p + np.where(frequent, 0.0, unknown), n)]
                own = pa.StructArray.from_arrays(
                    [*piece.columns[1:3], *(pa.array(x.astype(np.int64)) for x in sums), *(pa.array(x.astype(float)) for x in floats)],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "score"],
                )
                ids = piece.column(0).to_numpy().astype(np.int64)
                # a hash deals them evenly; 0 times of whatever it meets
                yield asked(mix(ids.view(np.uint64)), ids, np.zeros(n), own)
                r, t = np.concatenate([row[x] for _, x in ask]), np.concatenate([k[x] for k, x in ask])
                order = np.lexsort((t, r))
                r, t = r[order], t[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
                start = np.flatnonzero(new)
                yield asked(t[start], ids[r[start]], np.diff(np.append(start, len(r))), pa.nulls(len(start), own.type))

    def asked(keys: np.ndarray, rows: np.ndarray, times: np.ndarray, own: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rows), pa.array(times.astype(np.int32)), own], ["key", "row", "times", "own"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(flag).alias("held_out"), F.col(text).alias("text"))
    plus = lambda a, b: (F.sum(f"own.{a}") + F.coalesce(F.sum(F.col("times") * F.col(b)), F.lit(0)))
    sums = rows.mapInArrow(walk, ASKED).join(table.withColumnRenamed("known", "is_word").withColumnRenamed("base", "word"), "key", "left").groupBy("row").agg(
        F.max("own.doc_id").alias("doc_id"), F.max("own.held_out").alias("held_out"), F.sum("own.n_tokens").alias("n_tokens"), plus("known", "is_word").cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "word").alias("base_score"), plus("score", "value").alias("score"),
    )
    with small_batches(docs.sparkSession):
        return written(sums.drop("row"), "scores")


def query(spark, sf_dir: str, order: int = 2) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 5) == 1)
    model, table = train(docs.where(~F.col("held_out")), order=order)
    return score(docs, model, table)


def registered(spark, sf_dir: str) -> DataFrame:
    """The whole model, of three words: memory and disk are in the README."""
    return query(spark, sf_dir, 3)
