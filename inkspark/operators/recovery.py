"""Choosing between candidates, aligning answers with what was asked, and the reports of runs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspark.functions import text as X

JAMO = r"[ᄀ-ᇿ㄰-㆏ꥠ-꥿ힰ-퟿ﾠ-ￜ]"
EXPRESSIVE = r"[\p{P}\p{S}&&[^\[\](){}<>【】（）]]"


def best(candidates: DataFrame, key: list[str], ranks: list[Column]) -> DataFrame:
    """The candidate of each key with the largest ranks, compared one after another; a partial aggregate."""
    rest = [c for c in candidates.columns if c not in key]
    return candidates.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)])).alias("x")).select(*key, "x.*")


def quality_rank(tags: Column) -> Column:
    """Smaller is better: residue, echo, weak target, chatter, then how many tags."""
    has = lambda t: F.array_contains(tags, t).cast("int")
    return F.struct(has("source_residue").alias("residue"), has("verbatim_echo").alias("echo"), has("target_language_weak").alias("weak"), has("model_chatter").alias("chatter"), F.size(tags).alias("tags"))


# fixed values: letters by target language, and those that a source leaves behind
KOREAN_LEFT = r"[\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\uac00-\ud7af\ud7b0-\ud7ff\uffa0-\uffdc]"
KANA_LEFT = r"[\u3040-\u309a\u309d-\u309f\u30a0-\u30fa\u30fd-\u30ff\u31f0-\u31ff\uff66-\uff9f]"
TARGET_LETTERS = {"zh": X.CJK, "zh-Hant": X.CJK, "ko": KOREAN_LEFT, "ja": r"[\u3040-\u309a\u309d-\u309f\u30a0-\u30fa\u30fd-\u30ff\u31f0-\u31ff\uff66-\uff9f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", "ru": X.CYRILLIC, "ar": X.ARABIC, "th": X.THAI}
LATIN_TARGET = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
SOURCE_LEFT = {"ko": KOREAN_LEFT, "ja": KANA_LEFT}
RANKS = ("filled", "no_chatter", "not_source", "no_mass_residue", "target_share", "less_residue", "less_alike", "fewer_reasons")


@F.pandas_udf(T.DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio without white space and punctuation, case kept."""
    a, b = (x.fillna("").str.replace(r"[\s\W_]+", "", regex=True) for x in (a, b))
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def ranked(candidates: DataFrame, source: str, target: str, src: str = "src", text: str = "text", reasons: str = "reasons") -> DataFrame:
    """Add rank: eight numbers, compared one after another, the larger the better."""
    said = F.lower(F.array_join(F.coalesce(reasons, F.array().cast("array<string>")), " "))
    t, s = X.stripped(F.col(text)), X.stripped(F.col(src))
    rows = candidates.withColumns({"_t": t, "_s": s, "_said": said}).withColumn("_alike", F.when(F.col("_t") == F.col("_s"), F.when(F.regexp_replace("_t", r"(?U)[\s\W_]+", "") == "", 0.0).otherwise(1.0)))
    rows = rows.withColumn("_alike", F.coalesce("_alike", alike("_t", F.col(src))))
    letters = TARGET_LETTERS.get(target, LATIN_TARGET)
    share = X.count_of(F.col("_t"), f"[{letters}&&\\p{{L}}]") / F.greatest(X.count_of(F.col("_t"), r"\p{L}"), F.lit(1))
    left = F.when(F.col("_t") == "", 1.0).otherwise(X.count_of(F.col("_t"), SOURCE_LEFT[source]) / F.char_length("_t") if source in SOURCE_LEFT else 0.0)
    suspect = F.col("_said").contains("residue") | F.col("_said").contains("too similar")
    mass = suspect & ((F.col("_t") == F.col("_s")) | (F.col("_alike") >= 0.92) | (left >= 0.5))
    keys = [F.col("_t") != "", ~F.col("_said").contains("model_chatter"), F.col("_t") != F.col("_s"), ~mass, share, -left, -F.col("_alike"), -F.size(F.coalesce(reasons, F.array().cast("array<string>")))]
    return rows.withColumn("rank", F.struct(*[k.cast("double").alias(n) for k, n in zip(keys, RANKS, strict=True)])).drop("_t", "_s", "_said", "_alike")


def recovered(candidates: DataFrame, key: str = "segment_id", order: str = "round") -> DataFrame:
    """Rounds of recovery folded: each candidate (key, order, rank, again, ...) with taken, and last on the one that stays.

    A candidate is taken if its rank is above all before it, and as long as the one taken last would be asked for again; what comes when a
    segment isn't asked for any more is nobody's. The first candidate is taken in any case. Equal orders of a key are told apart by the rank, the better first.
    """
    w = Window.partitionBy(key).orderBy(order, F.desc("rank"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = candidates.withColumn("_best", F.max("rank").over(before))
    rows = rows.withColumn("taken", F.col("_best").isNull() | (F.col("rank") > F.col("_best")))
    closed = F.max(F.col("taken") & ~F.coalesce("again", F.lit(False))).over(before)
    rows = rows.withColumn("taken", F.col("taken") & ~F.coalesce(closed, F.lit(False))).drop("_best")
    later = F.max("taken").over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("last", F.col("taken") & ~F.coalesce(later, F.lit(False)))


def aligned(asked: DataFrame, answered: DataFrame, group: str = "subtask_id") -> DataFrame:
    """Answers (group, index, text) put to what was asked (group, index): by key where all keys are known, by position where none is and
    the counts are equal, else the known keys only. Adds text and policy."""
    size = asked.groupBy(group).agg(F.count(F.lit(1)).alias("_asked"))
    known = answered.join(asked.select(group, "index"), [group, "index"], "left_semi")
    count = answered.groupBy(group).agg(F.count(F.lit(1)).alias("_answers")).join(known.groupBy(group).agg(F.count(F.lit(1)).alias("_known")), group, "left").join(size, group)
    policy = F.when(F.coalesce("_known", F.lit(0)) == F.col("_asked"), "complete").when((F.coalesce("_known", F.lit(0)) == 0) & (F.col("_answers") == F.col("_asked")), "positional").otherwise("subset")
    count = count.select(group, policy.alias("policy"))
    place = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("index")))
    left = place(asked).join(count, group, "left")
    by_key = answered.select(group, "index", F.col("text").alias("_by_key"))
    by_place = place(answered).select(group, "_n", F.col("text").alias("_by_place"))
    both = left.join(by_key, [group, "index"], "left").join(by_place, [group, "_n"], "left")
    return both.withColumn("text", F.when(F.col("policy") == "positional", F.col("_by_place")).otherwise(F.col("_by_key"))).withColumn("policy", F.coalesce("policy", F.lit("none"))).drop("_n", "_by_key", "_by_place")


def request_references(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Segments of each request with the translation they have now: matched, different or missing. requests: request_id, segment_id, text; current: segment_id, dst."""
    both = requests.join(current, "segment_id", "left")
    return both.withColumn("state", F.when(F.col("dst").isNull(), "missing").when(F.trim("dst") == F.trim("text"), "matched").otherwise("different"))


_SIMILAR = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("overlap", T.DoubleType())])


@F.pandas_udf(_SIMILAR)
def likeness(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Ratcliff-Obershelp ratio, and matched characters of the shorter, without white space and punctuation."""
    a, b = (x.fillna("").str.lower().str.replace(r"[\s\W_]+", "", regex=True) for x in (a, b))
    out = []
    for x, y in zip(a, b, strict=True):
        m = sum(block.size for block in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) if x and y else 0
        out.append((2.0 * m / max(1, len(x) + len(y)), m / max(1, min(len(x), len(y)))))
    return pd.DataFrame(out, columns=["ratio", "overlap"])


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    """Of neighbouring pairs (left_src, right_src, left_dst, right_dst) those whose translations repeat while their sources don't."""
    size = lambda c: F.char_length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    rows = pairs.withColumn("_n", F.least(size("left_dst"), size("right_dst"))).where(F.col("_n") >= 4)
    rows = rows.withColumn("_s", likeness("left_src", "right_src")).withColumn("_d", likeness("left_dst", "right_dst"))
    source = F.greatest("_s.ratio", "_s.overlap")
    short = (source < 0.35) & (F.col("_d.ratio") >= 0.98)
    long_ = (source < 0.56) & ((F.col("_d.ratio") >= 0.92) | ((F.col("_d.overlap") >= 0.88) & (F.col("_d.overlap") - source >= 0.32)))
    return rows.where(F.when(F.col("_n") < 16, short).otherwise(long_)).drop("_n", "_s", "_d")


def is_compact_nonprose(text: Column) -> Column:
    """Short lines of signs, emoticons and sounds."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    n, jamo, signs = F.char_length(c), X.count_of(c, JAMO), X.count_of(c, EXPRESSIVE)
    letters = X.count_of(c, r"\p{L}") - jamo
    sounds = (jamo > 0) & ((letters == 0) | (c.rlike(r"^[\[({<【（]") & (signs > 0) & (letters <= 4)))
    return (n > 0) & (n <= 80) & (sounds | ((signs >= 2) & (signs >= 0.15 * n) & (letters <= F.greatest(F.lit(4), F.floor(n / 3)))))


def term_groups(audit: DataFrame) -> DataFrame:
    """Audited terms by (src, dst, info): total, applied, missing and the segments concerned; the most missing first."""
    rows = audit.groupBy("src", "dst", "info").agg(F.count(F.lit(1)).alias("total"), F.count_if("present").alias("applied"), F.count_if(~F.col("present")).alias("missing"), F.array_sort(F.collect_set(F.when(~F.col("present"), F.col("segment_id")))).alias("segments"))
    return rows.orderBy(F.desc("missing"), F.desc("total"), "src", "dst")


def replacement_report(occurrences: DataFrame, limit: int = 200) -> DataFrame:
    """Per rule and file: captured occurrences, ``limit`` at most, and whether there were more. A report's cap; counts of all are in total."""
    rows = occurrences.groupBy("rule", "path").agg(F.count(F.lit(1)).alias("total"))
    return rows.select("rule", "path", F.least("total", F.lit(limit)).alias("captured"), "total", (F.col("total") > limit).alias("truncated"))


def first_of_content(files: DataFrame, content: str = "content", name: str = "name", order: str = "ord") -> DataFrame:
    """Each file with the first file of the same content."""
    digest = files.withColumn("_h", F.sha2(content, 256))
    keep = digest.groupBy("_h").agg(F.min_by(name, order).alias("kept_as"))
    return digest.join(keep, "_h").drop("_h")


def fitted(excerpts: DataFrame, limit: int, key: str = "src", order: str = "n", text: str = "excerpt") -> DataFrame:
    """Whole excerpts of each key while they and their line ends fit into ``limit`` characters."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return excerpts.withColumn("_sum", F.sum(F.char_length(text) + 1).over(w) - 1).where(F.col("_sum") <= limit).drop("_sum")


def located(lines: DataFrame, wanted: str, used: list[int] | None = None, line: str = "line", order: str = "seg_idx") -> DataFrame:
    """The first unused line that equals the wanted heading, else the first that contains it."""
    text, title = F.lower(F.trim(line)), wanted.strip().lower()
    free = lines.where(~F.col(order).isin(used)) if used else lines
    return free.where(text.contains(title)).withColumn("_rank", F.when(text == title, 0).otherwise(1)).orderBy("_rank", "doc_id", order).limit(1).drop("_rank")


def expired(records: DataFrame, now: Column, days: int, at: str = "updated_at") -> DataFrame:
    return records.where(F.col(at) <= now - F.make_dt_interval(F.lit(days)))


def search_faults(searches: DataFrame, most: int = 100) -> DataFrame:
    """Saved searches (id, name, query) that break the library's rules: a repeated id, an empty name or query, or a place beyond ``most``."""
    # the library is one user's: its rows are numbered in the user's own group
    w = Window.partitionBy("user").orderBy("ord")
    again = F.row_number().over(Window.partitionBy("user", "id").orderBy("ord")) > 1
    rows = searches.withColumn("_n", F.row_number().over(w)).withColumn("_again", again)
    fault = F.when(F.col("_again"), "repeated id").when(F.trim(F.coalesce("name", F.lit(""))) == "", "empty name").when(F.coalesce("query", F.lit("")) == "", "empty query").when(F.col("_n") > most, "too many")
    return rows.withColumn("fault", fault).where("fault is not null").drop("_n", "_again")


def prompt(terms: Column, context: Column, rows: Column) -> Column:
    """The user message of a chunk: glossary (src, dst, info), context lines, and the numbered lines as JSON Lines in a fence."""
    listed = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), t["src"], F.lit(" -> "), t["dst"], F.when(F.coalesce(t["info"], F.lit("")) != "", F.concat(F.lit(" ("), t["info"], F.lit(")"))).otherwise(""))), "\n")
    before = F.array_join(F.filter(F.transform(context, lambda c: F.rtrim(F.replace(c, F.lit("\n"), F.lit(" ")))), lambda c: c != ""), "\n")
    body = F.array_join(F.transform(rows, lambda r, i: F.to_json(F.map_from_arrays(F.array(i.cast("string")), F.array(r)))), "\n")
    return F.concat_ws(
        "\n\n", F.when(listed != "", F.concat(F.lit("[Glossary]\n"), listed)), F.when(before != "", F.concat(F.lit("[Context - read only, do not translate or include in output]\n"), before)),
        F.concat(F.lit("[Translate]\n```jsonline\n"), body, F.lit("\n```")),
    )
