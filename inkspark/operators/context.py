"""Examples of terms in reference texts, oversized lines, recovery batches, failure kinds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspark.functions import text as X
from inkspark.operators import glossary


def excerpts(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", examples: int = 3, around: int = 80) -> DataFrame:
    """(src, n, key, at, excerpt): each term's first ``examples`` different excerpts, by document and place; case counts, occurrences of a term don't overlap.

    White space in an excerpt is collapsed before excerpts are compared. Terms that are few enough to be sent go to the texts; for more of them a join by grams
    says which document holds which. A text is searched once from left to right, up to its own first ``examples`` different excerpts: a later one can't be among the
    term's first. Equal excerpts of different texts are collapsed to their first place; what differs is then thinned in 64 groups by the
    excerpt's hash before the term's own, so a common term is no single task.
    """
    exact = terms.withColumn("case_sensitive", F.lit(True)).select("src", "case_sensitive")
    schema = T.StructType([docs.schema[key], terms.schema["src"], T.StructField("at", T.LongType()), T.StructField("excerpt", T.StringType())])
    table = glossary.sent(exact)

    def excerpts_of(src: str, whole: str) -> Iterator[tuple[int, str]]:
        seen: set[str] = set()
        at = whole.find(src)
        while at >= 0 and len(seen) < examples:
            excerpt = " ".join(whole[max(at - around, 0) : at + len(src) + around].split())
            if excerpt and excerpt not in seen:
                seen.add(excerpt)
                yield at, excerpt
            at = whole.find(src, at + len(src))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value if shared else None
        for batch in batches:
            places, found = [], []
            for i, (whole, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                held = () if not whole else (index.terms[t][0] for t in index.of(whole)) if index else (given,)
                for src in held:
                    for at, excerpt in excerpts_of(src, whole):
                        places.append(i)
                        found.append((src, at, excerpt))
            columns = zip(*found, strict=True) if found else ((), (), ())
            kept = batch.column(0).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True))], schema.names)

    texts = docs.select(key, F.col(text).alias("_t"))
    if table is not None:
        shared = docs.sparkSession.sparkContext.broadcast(glossary.index_of(table))
        asked = texts.withColumn("src", F.lit(None).cast("string"))
    else:
        shared = None
        asked = glossary.joined(docs.select(key, F.col(text).alias("line")), exact, (key,)).select(key, "src").join(texts, key).select(key, "_t", "src")
    rows = asked.mapInArrow(cut, schema)
    once = rows.groupBy("src", "excerpt").agg(F.min(F.struct(key, "at")).alias("x")).select("src", "excerpt", f"x.{key}", "x.at")
    w = Window.partitionBy("src", F.pmod(F.xxhash64("excerpt"), F.lit(64))).orderBy(key, "at")
    once = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= examples)
    w = Window.partitionBy("src").orderBy(key, "at")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= examples).select("src", "n", key, "at", "excerpt")


def pieces(lines: DataFrame, budget: int, key: str = "doc_id", order: str = "seg_idx", line: str = "line") -> DataFrame:
    """Lines cut to a budget of characters: by sentences put together again while they fit, sentences over it cut hard. Adds piece, part."""
    text = F.col(line)
    sentences = F.filter(F.split(text, r"(?<=[。！？!?….\n])\s*"), lambda s: s != "")
    hard = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / budget).cast("int")), lambda i: F.substr(s, i * budget + 1, F.lit(budget)))))
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        full = (s["now"] != "") & (F.char_length(s["now"]) + F.char_length(p) > budget)
        return F.struct(F.when(full, F.concat(s["done"], F.array(X.stripped(s["now"])))).otherwise(s["done"]).alias("done"), F.when(full, p).otherwise(F.concat(s["now"], p)).alias("now"))

    packed = F.filter(F.aggregate(hard, none, step, lambda s: F.concat(s["done"], F.array(X.stripped(s["now"])))), lambda p: p != "")
    cut = F.when(F.char_length(text) <= budget, F.array(text)).otherwise(packed)
    return lines.select(key, order, F.posexplode(cut).alias("part", "piece"))


def runaway(text: Column, span: int = 120, window: int = 600, unit: int = 20) -> Column:
    """The shortest unit with a letter or digit that the text's end repeats over ``span`` characters or more; '' if there is none."""
    tail = F.substring(text, -window, window)
    found = F.lit("")
    for n in range(unit, 0, -1):
        times = -(-span // n) - 1
        last = F.substring(tail, -n, n)
        hit = tail.rlike(rf"(?s)(.{{{n}}})\1{{{times},}}$") & last.rlike(r"[\p{L}\p{N}]") & (F.char_length(text) >= span)
        found = F.when(hit, last).otherwise(found)
    return found


# fixed values: failure kinds by words of the message
FAILURES = ("http 4", "http 5", "requesterror", "transporterror", "timeouterror", "connectionerror", "noapikeyerror", "api key", "all keys failed", "malformed response", "invalid json", "auth failure")


def is_request_failure(error: Column) -> Column:
    """Failures of the model or the request, not of quality."""
    error = X.stripped(error)
    low, found = F.lower(error), error.rlike(r"^\[(?:llm|runtime)\.[^\]]*\]")
    for marker in FAILURES:
        found = found | low.contains(marker)
    return found


def error_parts(error: Column) -> Column:
    """(code, message) of '[code] message'."""
    return F.struct(F.regexp_extract(error, r"^\[(.*?)\] ?(.*)$", 1).alias("code"), F.when(error.rlike(r"^\[.*?\]"), F.regexp_extract(error, r"^\[(.*?)\] ?(.*)$", 2)).otherwise(error).alias("message"))


def mass_residue(count: Column, total: Column, ratio: float = 0.5, least: int = 4, small_all: bool = False) -> Column:
    many = (count >= least) & (count >= ratio * total)
    return (total > 0) & ((many | ((total > 1) & (total < least) & (count == total))) if small_all else many)


def usage(block: Column) -> Column:
    """(input, output, cached, estimated) of a provider's usage block, whatever its names."""
    get = lambda path: F.try_element_at(F.array(F.get_json_object(block, f"$.{path}").try_cast("long")), F.lit(1))
    zero = F.lit(0).cast("long")
    hit, miss = get("prompt_cache_hit_tokens"), get("prompt_cache_miss_tokens")
    cached = F.when(F.coalesce(get("prompt_tokens_details.cached_tokens"), zero) > 0, get("prompt_tokens_details.cached_tokens")).otherwise(F.coalesce(hit, zero))
    prompt = F.coalesce(F.nullif(get("prompt_tokens"), zero), get("input_tokens"), F.when(hit.isNotNull() | miss.isNotNull(), F.coalesce(hit, zero) + F.coalesce(miss, zero)), zero)
    output = F.coalesce(F.nullif(get("completion_tokens"), zero), get("output_tokens"), zero)
    flags = [F.coalesce(F.get_json_object(block, f"$.{n}") == "true", F.lit(False)) for n in ("usage_estimated", "estimated")]
    return F.struct(prompt.alias("input"), output.alias("output"), cached.alias("cached"), (flags[0] | flags[1]).alias("estimated"))


def owners(subtasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted segment the subtask to run again: of those that hold it the last failed one, else the last. subtasks: subtask_id, ord, status, segments."""
    each = subtasks.select("subtask_id", "ord", "status", F.explode("segments").alias("segment_id")).join(wanted.select("segment_id").distinct(), "segment_id", "left_semi")
    return each.groupBy("segment_id").agg(F.max_by("subtask_id", F.struct(F.col("status") == "failed", "ord")).alias("subtask_id"))


def segment_owners(subtasks: DataFrame) -> DataFrame:
    """The inverted index: each segment with its subtasks in order, each once."""
    each = subtasks.select("subtask_id", "ord", F.explode(F.array_distinct("segments")).alias("segment_id"))
    rows = each.groupBy("segment_id").agg(F.array_sort(F.collect_set(F.struct("ord", "subtask_id"))).alias("x"))
    return rows.select("segment_id", F.array_distinct(F.transform("x", lambda r: r["subtask_id"])).alias("subtasks"))
