"""Benchmark decontamination by a distributed positional inverted index, in DataFrame and SQL functions only.

Test items are cut into windows of ``n`` consecutive words (an item of fewer words is one window). The training texts' terms
are counted; a window is anchored at its rarest term, and neighbouring windows of an item with the same anchor share one row with
the words they cover. Postings (term, document, position) of the anchors - and of a second, next rarest term common to
the row's windows, if its list isn't much longer - are written as the index. Lists are intersected from the rarest term: its positions give offset-adjusted
starts, the second term must stand where they say (give or take ``slop``); what is left is compared with the document's whole
words. Exact matches are windows found word for word; proximity matches are windows that aren't, but of whose distinct words
at least ``near`` stand within the window's place widened by ``slop`` words.

Scale: only postings of anchor terms and the texts of documents with a candidate are shuffled. Test rows and candidates' keys are
broadcast only while they are at most ``BROADCAST_ROWS``, else joined by shuffles that adaptive execution splits when skewed.
Nothing is gathered but one document's own candidates.

Edge cases: a null or empty text has no words and is clean; items without text have no windows; repeated rows and repeated ids,
of texts and of items, are judged each by their own text; an item without id counts in n_hit but isn't among the items; other columns are ignored; ties in rarity go to the first term in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000
#: a second list is intersected only if at most so many times as long as the first; beyond, looking at the documents costs less
LONGER = 64


def words_of(text: str | Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and characters beyond ASCII; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, text): k tells rows apart by id and text, so that equal rows share it."""
    return docs.select(F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h")).alias("k"), F.col(text).alias("text"))


def windows(tests: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(item, at, words): every window of every item with its first word's place; item tells texts apart by id and text."""
    words = tests.select(F.struct(F.col(item).alias("id"), F.xxhash64(text).alias("h")).alias("item"), words_of(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    return words.select("item", "w", F.explode(starts).alias("at")).select("item", "at", F.slice("w", F.col("at") + 1, n).alias("words"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def anchors(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """One row per run of an item's windows with the same anchor: (item, lo, hi, n, place, term, place2, term2, segment).

    docs: (k, text). Windows of which some term is in no document can't occur exactly; they keep their rarest known term for
    proximity, and go if they have none.
    """
    terms = written(cut.select(F.explode("words").alias("term")).distinct(), "terms")
    some = terms.count()
    counts = docs.select(F.explode(words_of("text")).alias("term")).join(_small(terms, some), "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    counts = _small(written(counts, "counts"), some)
    each = cut.select("item", "at", F.size("words").alias("n"), F.posexplode("words").alias("o", "term")).join(counts, "term")
    place = F.col("at") + F.col("o")
    rarest = each.groupBy("item", "at", "n").agg(F.min(F.struct("cf", "term", place.alias("place"))).alias("r"))
    runs = rarest.groupBy("item", "n", F.col("r.place").alias("place"), F.col("r.term").alias("term"), F.col("r.cf").alias("rarity")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    # of each run: the terms that all its windows share, but for the anchor
    shared = each.select("item", place.alias("p"), F.col("term").alias("t"), "cf").distinct()
    second = (
        runs.join(shared, "item")
        .where((F.col("p") >= F.col("hi")) & (F.col("p") < F.col("lo") + F.col("n")) & (F.col("p") != F.col("place")) & (F.col("cf") <= LONGER * F.col("rarity")))
        .groupBy("item", "lo", "place")
        .agg(F.min(F.struct("cf", "t", "p")).alias("s"))
    )
    covered = cut.select("item", F.explode(F.arrays_zip(F.sequence(F.col("at"), F.col("at") + F.size("words") - 1).alias("p"), F.col("words").alias("t"))).alias("x")).select("item", "x.p", "x.t").distinct()
    segment = (
        runs.join(covered, "item")
        .where((F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi") + F.col("n")))
        .groupBy("item", "lo", "place")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]).alias("segment"))
    )
    rows = runs.join(segment, ["item", "lo", "place"]).join(second, ["item", "lo", "place"], "left")
    return rows.select("item", "lo", "hi", "n", "place", "term", F.coalesce("s.p", "place").alias("place2"), F.coalesce("s.t", "term").alias("term2"), "segment")


def postings(docs: DataFrame, terms: DataFrame, some: int) -> DataFrame:
    """The positional inverted index of the given terms: (term, k, pos)."""
    return docs.select("k", F.posexplode(words_of("text")).alias("pos", "term")).join(_small(terms, some), "term").select("term", "k", "pos")


def matches(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, slop: int = 2, near: float = 0.8) -> DataFrame:
    """(k, found): for each document with a match, an array of (item, start, n, exact)."""
    rows = keyed(docs, key, text)
    cut = written(windows(tests, item, item_text, n), "windows")
    tested = written(anchors(rows, cut), "anchors")
    some = tested.count()
    terms = tested.select("term").union(tested.select(F.col("term2").alias("term"))).distinct()
    index = written(postings(rows, terms, 2 * some), "postings")
    first = index.join(_small(tested.drop("segment"), some), "term").select("k", "item", "lo", "place", (F.col("pos") - F.col("place")).alias("shift"), "term2", "place2")
    # every place within the slop is asked for by its own key, so that a word repeated through a document meets only itself there
    asked = first.where("place2 <> place").withColumn("pos", F.explode(F.sequence(F.col("place2") + F.col("shift") - slop, F.col("place2") + F.col("shift") + slop)))
    met = asked.join(index.select("k", F.col("term").alias("term2"), "pos"), ["k", "term2", "pos"], "left_semi")
    both = met.drop("pos").unionByName(first.where("place2 = place"))
    runs = _small(tested.select("item", "lo", "hi", "place", "n", "segment"), some)
    by_doc = both.select("k", "item", "lo", "place", "shift").distinct().join(runs, ["item", "lo", "place"]).groupBy("k").agg(F.collect_list(F.struct("item", "lo", "hi", "n", "shift", "segment")).alias("c"))
    by_doc = written(by_doc, "candidates")
    texts = rows.join(_small(by_doc.select("k"), by_doc.count()), "k", "left_semi").dropDuplicates(["k"]).select("k", words_of("text").alias("w"))
    # a window at s of the item starts at s + shift in the document
    exact = "s + x.shift >= 0 and slice(w, greatest(s + x.shift, 0) + 1, x.n) = slice(x.segment, s - x.lo + 1, x.n)"
    around = f"slice(w, greatest(s + x.shift - {slop}, 0) + 1, x.n + {2 * slop})"
    window = "slice(x.segment, s - x.lo + 1, x.n)"
    judged = F.expr(
        f"flatten(transform(c, x -> transform(sequence(x.lo, x.hi), s -> named_struct('item', x.item.id, 'start', s + x.shift, 'n', x.n, 'exact', {exact}, "
        f"'near', size(array_intersect({window}, {around})) >= {near} * size(array_distinct({window}))))))"
    )
    found = by_doc.join(texts, "k").select("k", F.filter(judged, lambda x: x["exact"] | x["near"]).alias("found"))
    return found.where(F.size("found") > 0)


def digest(docs: DataFrame, tests: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: (k, n_words, n_hit, items, n_near): words inside exact matches, ids of matched items as sorted text, items near only."""
    found = written(matches(docs, tests, **how), "matches")
    flat = found.select(
        "k",
        F.size(F.array_distinct(F.expr("flatten(transform(filter(found, x -> x.exact), x -> sequence(x.start, x.start + x.n - 1)))"))).cast("long").alias("n_hit"),
        F.array_distinct(F.expr("transform(filter(found, x -> x.exact), x -> string(x.item))")).alias("whole"),
        F.array_distinct(F.expr("transform(filter(found, x -> not x.exact), x -> string(x.item))")).alias("close"),
    )
    return flat.select("k", "n_hit", F.sort_array(F.array_compact("whole")).alias("items"), F.size(F.array_except("close", "whole")).cast("long").alias("n_near"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, tests = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    counted = docs.select("doc_id", F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")).alias("k"), F.size(words_of("text")).cast("long").alias("n_words"))
    out = counted.join(digest(docs, tests), "k", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, grams.n, s FROM grams JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS x FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(x, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def clean(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The pipeline's stage: documents with an exact match go."""
    hit = digest(docs.select("doc_id", "text"), tests).where("n_hit > 0").select("k")
    k = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    return docs.join(hit, k == hit["k"], "left_anti")
