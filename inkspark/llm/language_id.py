"""Language ID by language-bitmask n-gram filters.

Every byte n-gram of the training texts is counted by language. An n-gram belongs to a language when its share there is at
least ``keep`` of its largest share in any language; its languages form a bitmask. The masks go into bit-sliced Bloom filters:
each slot of a table holds one bit per language, a lookup ANDs the slots of an n-gram and so returns all languages that contain
it at once. A text's per-language popcounts are corrected for the filter's false positives, and the largest decides.

A text whose letters give no n-gram has coverage 1, as nothing in it is foreign. Input columns named like an added one are left out.

Size: n-grams rarer than ``min_share`` of their language are left out, so a language has at most 1/min_share n-grams of each
length whatever the corpus; that bounds what is collected and broadcast.

Edge cases: a null text, an empty one and one without a letter get ``und`` and score 0; a corpus without labelled training texts
gives ``und`` everywhere; ties go to the alphabetically first language; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import crc_mod
from inkspark.llm.textvec import Counts, U, buffers, mix, pieces

SIZES = (3, 4)
#: letters of ASCII in lower case and bytes of other characters as they are; all else is a space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (packed n-grams, the row of each). Rows don't share n-grams; runs of spaces give none."""
    raw, at = buffers(column)
    x = _FOLD[raw]
    row = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(at))
    for n in SIZES:
        if len(x) < n:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int32)
            continue
        m = len(x) - n + 1
        key = np.zeros(m, np.uint32)
        for k in range(n):
            key = (key << np.uint32(8)) | x[k : k + m].astype(np.uint32)
        ok = (row[:m] == row[n - 1 :]) & ~((x[:m] == 32) & (x[1 : m + 1] == 32)) & ~((x[n - 2 : n - 2 + m] == 32) & (x[n - 1 :] == 32))
        yield key[ok].astype(np.uint64) | U(n << 40), row[:m][ok]


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``slots[word][i]`` has a bit for each of 64 languages; ``false`` is each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false: np.ndarray

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, masks: np.ndarray, slots_per_key: int = 8, hashes: int = 3) -> Filters:
        """masks: one row per 64 languages."""
        size = 1 << max(10, int(np.ceil(np.log2(max(1, len(keys)) * slots_per_key))))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        slots = np.zeros((len(masks), size), kind)
        for at in cls.places(keys, size, hashes):
            for w, m in enumerate(masks):
                np.bitwise_or.at(slots[w], at, m.astype(kind))
        fill = [np.count_nonzero(slots[j // 64] >> kind(j % 64) & kind(1)) / size for j in range(len(languages))]
        return cls(languages, slots, hashes, np.array(fill) ** hashes)

    @staticmethod
    def places(keys: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
        h = mix(keys)
        step = mix(h) | U(1)
        for k in range(hashes):
            yield ((h + U(k) * step) & U(size - 1)).astype(np.int64)

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram, a row per 64 languages."""
        out = None
        for at in self.places(keys, self.slots.shape[1], self.hashes):
            out = self.slots[:, at] if out is None else out & self.slots[:, at]
        return out

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(corrected hits by row and language, n-grams by row)."""
        n = len(column)
        raw, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for keys, row in grams(column):
            if not len(keys):
                continue
            masks = self.containing(keys)
            total += np.bincount(row, minlength=n)
            for j in range(len(self.languages)):
                bit = masks[j // 64] >> masks.dtype.type(j % 64) & masks.dtype.type(1)
                raw[:, j] += np.bincount(row, bit, minlength=n)
        return np.maximum(0, (raw - self.false * total[:, None]) / (1 - self.false)), total


def train(docs: DataFrame, text: str = "text", lang: str = "lang", keep: float = 0.4, min_share: float = 1e-6) -> Filters:
    """Count the n-grams of every labelled text of ``docs`` and build the filters."""
    counts = (
        docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang", F.shiftright("gram", 40).alias("size")).agg(F.sum("n").alias("total"))
    share = counts.withColumn("size", F.shiftright("gram", 40)).join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= min_share)
    languages = sorted(r["lang"] for r in totals.select("lang").distinct().collect())  # one row a language
    bit = F.element_at(F.create_map(*(F.lit(x) for pair in zip(languages, range(len(languages)), strict=True) for x in pair)), F.col("lang")) if languages else F.lit(0)
    by_gram = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct(bit.alias("bit"), "share")).alias("by"))  # a language once
    words = range(max(1, -(-len(languages) // 64)))
    masks = [F.expr(f"aggregate(filter(by, x -> x.share >= {keep} * top and x.bit div 64 = {w}), 0L, (m, x) -> m | shiftleft(1L, x.bit % 64))").alias(f"m{w}") for w in words]
    kept = by_gram.select("gram", *masks).toPandas()
    return Filters.build(languages, kept["gram"].to_numpy(np.int64).view(np.uint64), np.stack([kept[f"m{w}"].to_numpy(np.int64).view(np.uint64) for w in words]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, Counts] = {}

    def out(lang: str, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    for batch in batches:
        for piece in pieces(batch, "text"):
            langs = np.array(piece.column(0).to_pylist(), object)
            names, code = np.unique(langs, return_inverse=True)
            for keys, row in grams(piece.column(1)):
                of = code[row]
                for j, name in enumerate(names):
                    counts = by.setdefault(name, Counts())
                    counts.add(keys[of == j])
                    if full := counts.full():
                        yield out(name, *full)
    for name, counts in by.items():
        k, c = counts.merged()
        for i in range(0, len(k), 100_000):
            yield out(name, k[i : i + 100_000], c[i : i + 100_000])


def predict(docs: DataFrame, filters: Filters, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """Add lang_pred, score (the winner's share of all languages' corrected hits) and coverage (of the text's n-grams) under ``names``."""
    docs = docs.drop(*(x for x in names if x in docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text)
    schema = docs.select("*", *(F.lit(x).alias(name) for x, name in zip(("", 0.0, 0.0), names, strict=True))).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for piece in pieces(batch, text):
                column = piece.column(at)
                n = len(column)
                letters = np.array([x is not None and any(map(str.isalpha, x)) for x in column.to_pylist()], bool)  # Unicode category L
                pred, best, cover = np.full(n, "und", object), np.zeros(n), letters.astype(float)
                if f.languages:
                    hits, total = f.hits(column)
                    win = hits.argmax(1)
                    top = hits[np.arange(n), win]
                    ok = letters & (top > 0)
                    pred[letters] = np.array(f.languages, object)[win[letters]]
                    best[ok] = top[ok] / hits.sum(1)[ok]
                    some = letters & (total > 0)
                    cover[some] = np.minimum(1, top[some] / total[some])
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(pred, pa.string()), pa.array(best), pa.array(cover)], names=[*piece.schema.names, *names])

    return docs.mapInArrow(score, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    filters = train(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def accepted(docs: DataFrame, min_coverage: float = 0.2) -> DataFrame:
    """The pipeline's stage: learn from the labelled texts, reject texts without letters or foreign to every learned language; without labels, only the former."""
    columns = docs.columns
    names = tuple(f"_{x}_of_{len(columns)}" for x in ("lang", "score", "coverage"))
    return predict(docs, train(docs), names=names).where(F.col(names[2]) >= min_coverage).select(*columns)
