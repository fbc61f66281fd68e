"""Phrase collocations by Rabin-Karp fingerprints.

Texts are split into pieces at marks and line ends, pieces into words. Prefix polynomials over a column's bytes hash its words, and
prefix polynomials over the words' hashes every n-gram, mixed with its language. Spark sums fingerprints in sorted blocks: of words, then of pairs
both of whose words are frequent, then of longer phrases all of whose pairs are. Nothing frequent is lost, since a phrase is as
frequent as its parts at most; the sets of frequent fingerprints travel as Bloom filters of a fixed size, whose false positives
only add rows to the next sum.

In the last pass a task keeps, for every fingerprint that has passed, a pointer to an occurrence, holds all its other occurrences
against that one's words (those that differ form phrases of their own), and writes out the phrase there. The counts of frequent
phrases are sums by text, so that no collision, not even a planted one, reaches the result.

A candidate's cuts look up the counts of their two parts; parts in very many candidates are the frequent ones, a bounded number of
which is broadcast. Scores and shares are exact decimals.

Edge cases: a null text is empty, a null language is ``und`` and counts with rows that say so; rows that repeat count each; ties
go to the larger count, then to the phrase first in byte order; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import hot_join, small_batches, table, written
from inkspark.llm.runs import Sieve, gathered, in_blocks, of_blocks, powers, spans, strings, word_hashes
from inkspark.llm.textvec import LOWER, Counts, U, buffers, counted, mix, pieces

CUT = np.zeros(256, bool)
CUT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
NOT_WORD = CUT.copy()
NOT_WORD[[0x20, 0x09]] = True
LONGEST = 4
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALTS = 64
_PIECE = 1 << 18
_HELD = 300_000  # fingerprints that a task sums before it sends them


class Words:
    """The words of a batch (lang, text): bytes, spans, hashes, each one's row and how many of those behind it belong to its piece."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column(0)
        raw, at = buffers(batch.column(1))
        self.raw = LOWER[raw]
        self.start, self.stop = spans(~NOT_WORD[self.raw], at)
        self.hash = word_hashes(self.raw, self.start, self.stop)
        self.row = np.searchsorted(at, self.start, "right") - 1
        piece = np.cumsum(CUT[self.raw], dtype=np.int32)[self.start] if len(self.start) else np.zeros(0, np.int64)
        same = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        names = self.langs.dictionary_encode()
        raw, at = buffers(names.dictionary)
        salt = word_hashes(raw, at[:-1], at[1:]) if len(raw) else np.zeros(len(at) - 1, np.uint64)
        self.salt = salt[names.indices.to_numpy(zero_copy_only=False)[self.row]] if len(self.row) else np.zeros(0, np.uint64)
        self.after = [np.ones(len(self.start), bool)]
        for n in range(1, LONGEST):
            ok = np.zeros(len(self.start), bool)
            ok[: len(same) - n + 1] = self.after[-1][: len(same) - n + 1] & same[n - 1 :] if len(same) >= n else False
            self.after.append(ok)

    def keys(self, n: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the n-grams that begin at the words ``at``, each mixed with its language and length."""
        if n == 1:
            h = self.hash[at]
        else:
            total = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * powers(_BASE, len(self.hash)), out=total[1:])
            h = (total[at + n] - total[at]) * powers(_INVERSE, len(self.hash))[at]
        return mix(h + self.salt[at] + U(n * 0xD6E8FEB86659FD93 % (1 << 64)))


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in pieces(batch, "text", _PIECE):
            yield Words(part)


def passing(w: Words, longest: int, sieves: list[Sieve]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words, keys) of the n-grams of up to ``longest`` words whose parts are in the sieves (of words, of pairs)."""
    ok = [np.ones(len(w.start), bool)]
    for n in range(1, longest + 1):
        at = np.flatnonzero(w.after[n - 1] & ok[-1])
        keys = w.keys(n, at)
        yield n, at, keys
        if n == longest:
            return
        if n <= len(sieves):
            held = np.zeros(len(w.start) + 1, bool)
            held[at[sieves[n - 1].holds(keys)]] = True
            ok.append(held[:-1] & held[1:])
        else:
            held = np.append(ok[-1], False)
            ok.append(held[:-1] & held[1:])


def frequent_keys(docs: DataFrame, first: int, longest: int, sieves: list[Sieve], least: int, log_blocks: int) -> DataFrame:
    """(k): fingerprints of ``first`` to ``longest`` words that pass and occur ``least`` times, cut to their first ``log_blocks`` + 32 bits.

    Tasks sum what they read and send sorted blocks of it; a block number is one group of about the same size for any corpus.
    """
    shared, drop = docs.sparkSession.sparkContext.broadcast(sieves), U(32 - log_blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counts(_HELD)
        for w in parsed(batches):
            for n, _, keys in passing(w, longest, shared.value):
                if n >= first:
                    sums.add(keys >> drop)
            if full := sums.full():
                yield in_blocks(*full, least)
        yield in_blocks(*sums.merged(), least)

    def sum_up(rows: pa.Table) -> pa.Table:
        k, n = counted(*of_blocks(rows, least))
        return pa.table({"k": pa.array(k[n >= least].view(np.int64))})

    return docs.mapInArrow(count, "block long, gaps binary, n binary").groupBy("block").applyInArrow(sum_up, "k long")


def distinct_phrases(w: Words, n: int, at: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pointer to an occurrence, occurrences) of each phrase: those that share a fingerprint are compared word by word with the first of them."""
    while len(at):
        _, first, of, c = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        pointer = at[first]
        alike = w.salt[pointer][of] == w.salt[at]
        for k in range(n):
            alike &= ids[pointer + k][of] == ids[at + k]
        if alike.all():
            yield pointer, c
            return
        yield pointer, np.bincount(of[alike], minlength=len(pointer))
        at, keys = at[~alike], keys[~alike]


def texts(docs: DataFrame, sieves: list[Sieve]) -> DataFrame:
    """(lang, words, phrase, n) of the phrases whose fingerprints are in the sieves (of words, pairs, longer ones), by batch; n of the empty phrase: all words."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def materialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in parsed(batches):
            length = w.stop - w.start
            ids = strings(gathered(w.raw, w.start, length), length).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            spaced = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
            begin = np.cumsum(length + 1) - length - 1
            spaced[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = gathered(w.raw, w.start, length)
            rows = np.bincount(w.row, minlength=len(w.langs))
            yield _batch(w.langs, 0, pa.array([""] * len(rows), pa.large_string()), rows)
            for n, at, keys in passing(w, LONGEST, shared.value[:2]):
                fine = shared.value[min(n, 3) - 1].holds(keys)
                for pointer, c in distinct_phrases(w, n, at[fine], keys[fine], ids):
                    size = begin[pointer + n - 1] + length[pointer + n - 1] - begin[pointer]
                    yield _batch(w.langs.take(pa.array(w.row[pointer])), n, strings(gathered(spaced, begin[pointer], size), size), c)

    return docs.mapInArrow(materialise, "lang string, words int, phrase string, n long")


def _batch(langs: pa.Array, words: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(n), words, np.int32)), phrases.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"])


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, log_bits: int = 27, block_bytes: int = 8 << 20) -> DataFrame:
    """(lang, words, phrase, n), written: all phrases of up to four words with at least ``least`` occurrences in their language, and by language the empty phrase with the number of all words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_blocks = min(31, max(4, (size // block_bytes).bit_length()))
    sieves: list[Sieve] = []
    with small_batches(docs.sparkSession):
        for first, longest in ((1, 1), (2, 2), (3, LONGEST)):
            sieves.append(Sieve.of(frequent_keys(rows, first, longest, sieves, least, log_blocks), "k", log_bits, 32 - log_blocks))
        exact = texts(rows, sieves).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
        return written(exact.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of every phrase of two words or more, at its lowest-scoring cut."""
    keys = counts.where("words between 1 and 3").select(F.struct("lang", "phrase").alias("part"), F.col("n").alias("f"))
    cuts = counts.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("part", F.expr("struct(lang, substring_index(phrase, ' ', k) AS phrase)"))
    # a part begins or ends candidates of at least the least count each, so those in many candidates are the frequent ones
    left = written(hot_join(written(cuts, "cuts"), keys, "part", "f").withColumnRenamed("f", "l").withColumn("part", F.expr("struct(lang, substring_index(phrase, ' ', k - words) AS phrase)")), "cuts")
    both = hot_join(left, keys, "part", "f").withColumnRenamed("f", "r")
    score = F.expr("(CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = both.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "words", "phrase", "a", "b.l", "b.r", "b.score")


def covered(counts: DataFrame, cover: int) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer candidate around each phrase of two or three words that stands in one."""
    long = counts.where("words >= 3").select("lang", "n", "words", F.split("phrase", " ").alias("w"))
    inner = long.select("lang", "n", "w", F.explode(F.expr("filter(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i, m)))), x -> x.m >= 2)")).alias("x"))
    return inner.select("lang", "n", F.array_join(F.slice("w", F.col("x.i"), F.col("x.m")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, cover: int = 80, top: int = 2000, **sizes: int) -> DataFrame:
    """Each language's ``top`` collocations: (lang, rank, phrase, a, l, r, n, score)."""
    counts = frequent(docs, text, lang, least, **sizes)
    around = F.col("most").isNotNull() & (F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * cover)
    kept = scored(counts).join(covered(counts, cover), ["lang", "phrase"], "left").where(~around).drop("most", "words")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("n").alias("all_words"))
    return ranked.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents"))


ORACLE = """WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT i, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]'), 1) AS j FROM d),
w AS (SELECT i, lang, j, unnest(regexp_extract_all(piece, '[^\\x20\\x09]+')) AS w, generate_subscripts(regexp_extract_all(piece, '[^\\x20\\x09]+'), 1) AS o FROM p),
q AS (SELECT lang, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4 FROM w WINDOW x AS (PARTITION BY i, j ORDER BY o)),
g AS (SELECT lang, 1 AS words, w1 AS phrase FROM q UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM q WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM q WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM q WHERE w4 IS NOT NULL),
f AS (SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS s, unnest(generate_series(1, words - 1)) AS k FROM f WHERE words >= 2),
z AS (SELECT c.lang, c.phrase, c.a, c.k, c.words, l.n AS l, r.n AS r, (2000000::HUGEINT * c.a) // (l.n + r.n) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.s[1:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.s[c.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM z),
v AS (SELECT DISTINCT lang, array_to_string(s[o:o + m - 1], ' ') AS phrase, a AS most FROM (SELECT lang, s, a, words, m, unnest(generate_series(1, words - m + 1)) AS o FROM (SELECT lang, s, a, words, unnest(generate_series(2, words - 1)) AS m FROM c WHERE words >= 3 AND k = 1))),
h AS (SELECT lang, phrase, max(most) AS most FROM v GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE b.pick = 1 AND (h.most IS NULL OR 100::HUGEINT * h.most < 80::HUGEINT * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, t.n, o.score::BIGINT AS score FROM o JOIN (SELECT lang, count(*) AS n FROM w GROUP BY lang) t USING (lang) WHERE o.rank <= 2000"""
