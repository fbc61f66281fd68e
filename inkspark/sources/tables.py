"""The tables as the operators read them: segments (lines), pairs, tokens; and files of text, rules and records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.sources.encodings import detected

NEWLINE = r"\r\n|\n|\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(text: Column) -> Column:
    """A text's lines as an array; a final line end adds none, an empty text is one empty line."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, NEWLINE)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row a line: key, seg_idx from 0, line, and the kept columns."""
    return docs.select(key, *keep, F.posexplode(lines(F.col(text))).alias("seg_idx", "line")).withColumn("seg_idx", F.col("seg_idx").cast("long"))


def newlines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line with its own line end, '' where the text ends without one."""
    ends = F.regexp_extract_all(F.col(text), F.lit(f"({NEWLINE})"), 1)
    rows = docs.select(key, ends.alias("ends"), F.posexplode(lines(F.col(text))).alias("seg_idx", "line"))
    return rows.select(key, F.col("seg_idx").cast("long"), "line", F.coalesce(F.get("ends", "seg_idx"), F.lit("")).alias("newline"))


def pairs(conversations: DataFrame) -> DataFrame:
    """A user turn and the assistant turn after it: conv_id, turn, src, dst."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("dst", F.lead("text").over(w))
    return rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("src"), "dst")


def text_files(spark: SparkSession, path: str, suffixes: str = "*.{txt,TXT}") -> DataFrame:
    """Files under a folder, decoded: path, encoding, text, confidence."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffixes).load(path)
    return decoded(files.select("path", "content"))


def decoded(rows: DataFrame) -> DataFrame:
    """(key, content) rows decoded: key, encoding, text, confidence. UTF-8 (with or without mark), UTF-16 with mark, then the likeliest legacy encoding."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(None, None, None) if x is None else detected(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in ((1, pa.string()), (0, pa.string()), (2, pa.float64())))], [batch.schema.names[0], "encoding", "text", "confidence"])

    key = rows.schema.fields[0]
    return rows.mapInArrow(decode, f"`{key.name}` {key.dataType.simpleString()}, encoding string, text string, confidence double")


def replacement_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file: path, line number, src, dst, valid; ``src->dst``, comments and blank lines dropped, ``#->#`` rules kept."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(lines(F.col("value"))).alias("n", "line"))
    rows = text.where((F.trim("line") != "") & (~F.trim("line").startswith("#") | F.trim("line").startswith("#->#")))
    at = F.instr("line", "->")
    src = F.when(at > 0, F.trim(F.substr("line", F.lit(1), at - 1)))
    dst = F.when(at > 0, F.trim(F.substr("line", at + 2)))
    return rows.select("path", (F.col("n") + 1).alias("line_number"), src.alias("src"), dst.alias("dst"), (F.coalesce(src, F.lit("")) != "").alias("valid"))


def glossary_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON glossary: src, dst, info, regex, case_sensitive, enabled with defaults; rows without src or dst are dropped."""
    schema = "src string, dst string, info string, type string, regex boolean, case_sensitive boolean, enabled boolean"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    out = rows.select(F.trim("src").alias("src"), F.trim("dst").alias("dst"), F.trim(F.coalesce("info", "type", F.lit(""))).alias("info"), *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("regex", False), ("case_sensitive", False), ("enabled", True))])
    return out.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != ""))


# fixed values: header synonyms of glossary sheets
HEADERS = {"src": ("src", "source", "original", "原文"), "dst": ("dst", "target", "translation", "译文"), "info": ("info", "type", "category", "note", "备注"), "frequency": ("frequency", "count", "times", "次数")}


def glossary_sheet(df: DataFrame) -> DataFrame:
    """A sheet with any of the known headers as src, dst, info, frequency; the first columns where none is known."""
    low = {c.strip().lower(): c for c in df.columns}
    picked = {}
    for place, (name, known) in enumerate(HEADERS.items()):
        found = next((low[k] for k in known if k in low), None)
        picked[name] = found or (df.columns[place] if place < 2 and place < len(df.columns) else None)
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None)).cast("long" if n == "frequency" else "string").alias(n) for n, c in picked.items()])


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of one JSON document each; those that don't parse are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines log; malformed lines are dropped."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*")


def visible_text(html: Column) -> Column:
    """What a reader of a page sees: hidden elements, comments and tags out, blocks on lines of their own, entities decoded, space collapsed."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|head|template|noscript)\b.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|nav|header|footer|blockquote|pre|body|html|main|aside|figure)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(x, r"[ \t]*\n[ \t\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every href of every page: key, position, href."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), 1)
    return pages.select(key, F.posexplode(found).alias("position", "href"))
