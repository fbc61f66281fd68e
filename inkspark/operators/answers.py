"""Reading model answers that aren't what was asked for: objects glued together, wrapped, nested or cut off, dense rows, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a review may decide, and what a comparison may
ACTIONS = ("keep", "modify", "delete", "category", "modify_category")
COMPARISONS = ("accept_new", "keep_existing", "uncertain")
LONGEST_REASON = 500
# fixed values: headings of a table's columns
SOURCE_HEADS = ("src", "source", "原文", "原词", "korean", "japanese", "english", "韩文原文", "日文原文", "英文原文", "韩语", "日语", "英语", "韩文", "日文", "英文")
TARGET_HEADS = ("dst", "target", "translation", "translated", "译文", "译名", "翻译", "中文译名", "中文翻译", "中文", "chinese")
REMARK_HEADS = ("type", "category", "kind", "类型", "类别", "分类", "大类", "细分类", "实体类型", "所属分类", "info", "备注", "说明", "note", "remark", "comment")

#: a text in full: strings (which don't cross lines), brackets, what lies between
TOKENS = r'"(?:[^"\\\r\n]|\\[^\r\n])*+"|[{}\[\]]|[^"{}\[\]]++|"'
STRING = r'"(?:[^"\\]|\\.)*+"'
NEWLINE = r"\r\n|\n|\r"


def objects(raw: DataFrame, key: str, column: str) -> DataFrame:
    """Every closed {...} of an answer, however deep: key, begin, end (characters from 0), object.

    Brackets in strings don't count, escapes are honoured, and a string ends at its line's end at the latest. An object closes where the depth
    is again what it was before it opened; what was cut off never does, the closed ones within it do.
    """
    tokens = raw.select(key, F.col(column).alias("_text"), F.posexplode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(f"({TOKENS})"), F.lit(1))).alias("_n", "_tok"))
    tokens = tokens.withColumn("_size", F.char_length("_tok").cast("long"))
    upto = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_tok") == "{", 1).when(F.col("_tok") == "}", -1).otherwise(0)
    placed = tokens.select(key, "_text", "_n", "_tok", (F.sum("_size").over(upto) - F.col("_size")).alias("begin"), F.sum(step).over(upto).alias("_depth"))
    # an opening bracket and its own closing one are neighbours among the brackets of their level
    level = Window.partitionBy(key, "_level").orderBy("_n")
    braces = placed.where(F.col("_tok").isin("{", "}")).withColumn("_level", F.when(F.col("_tok") == "{", F.col("_depth") - 1).otherwise(F.col("_depth")))
    closed = braces.withColumns({"_next": F.lead("_tok").over(level), "end": F.lead("begin").over(level) + 1}).where("_tok = '{' AND _next = '}'")
    return closed.select(key, "begin", "end", F.substr("_text", F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int")).alias("object"))


def _field(of: Column, *names: str) -> Column:
    """The first of the named values that is there, without white space around it."""
    return F.trim(F.coalesce(*[F.try_element_at(of, F.lit(n)) for n in names], F.lit("")))


def decisions(raw: DataFrame, key: str, column: str) -> DataFrame:
    """Review decisions of an answer in any shape: key, begin, n, row_index, action, suggested_dst, suggested_info, reason.

    An object with a row_index is a decision, one with a list of decisions holds some; neither is looked for within another. Unknown actions
    keep; rows without a positive index go. ``raw`` has a row for each key.
    """
    found = objects(raw, key, column).withColumn("_map", F.from_json("object", "map<string,string>")).where(F.col("_map").isNotNull())
    listed = F.from_json(F.try_element_at("_map", F.lit("decisions")), "array<map<string,string>>")
    one = F.map_contains_key("_map", F.lit("row_index"))
    found = found.withColumn("_items", F.when(one, F.array("_map")).otherwise(listed)).where(F.col("_items").isNotNull())
    before = Window.partitionBy(key).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn("_covered", F.max("end").over(before)).where(F.col("_covered").isNull() | (F.col("_covered") <= F.col("begin")))
    items = outer.select(key, "begin", F.posexplode("_items").alias("n", "_i")).where(F.col("_i").isNotNull())
    index, action = _field(F.col("_i"), "row_index"), F.lower(_field(F.col("_i"), "action"))
    rows = items.select(
        key, "begin", F.col("n").cast("long").alias("n"), F.when(index.rlike(r"^\d{1,18}$"), index.cast("long")).alias("row_index"), F.when(action.isin(*ACTIONS), action).otherwise("keep").alias("action"),
        _field(F.col("_i"), "suggested_dst", "dst").alias("suggested_dst"), _field(F.col("_i"), "suggested_info", "info").alias("suggested_info"), _field(F.col("_i"), "reason").alias("reason"),
    )
    return rows.where("row_index > 0")


def comparisons(raw: DataFrame, asked: DataFrame, key: str, column: str) -> DataFrame:
    """What an answer decides on each asked item (key, item_id): key, item_id, decision, reason, issue. From its first bracket to its last it is one object of decisions by item."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), r"(?is)^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    by_item = F.from_json(F.try_element_at(F.from_json(inner, "map<string,string>"), F.lit("decisions")), "map<string,map<string,string>>")
    read = raw.select(key, (inner != "").alias("_some"), by_item.alias("_of"))
    both = asked.select(key, "item_id").join(read, key, "left").withColumn("_d", F.try_element_at("_of", F.col("item_id")))
    decision, reason = _field(F.col("_d"), "decision"), F.substring(_field(F.col("_d"), "reason"), 1, LONGEST_REASON)
    issue = F.when(~F.coalesce("_some", F.lit(False)), "no JSON object").when(F.col("_of").isNull(), "no decisions").when(F.col("_d").isNull(), "item is missing").when(~decision.isin(*COMPARISONS), "unknown decision")
    fine = issue.isNull()
    return both.select(key, "item_id", F.when(fine, decision).alias("decision"), F.when(fine, F.when(reason == "", "no reason provided").otherwise(reason)).alias("reason"), issue.alias("issue"))


def is_truncated(raw: Column) -> Column:
    """Whether the last line that isn't blank or a fence doesn't close an object."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), NEWLINE), lambda x: F.regexp_replace(F.trim(x), ",+$", "")), lambda x: (x != "") & ~x.startswith("```"))
    return (F.size(lines) > 0) & ~F.element_at(lines, -1).endswith("}")


def _index(name: Column) -> Column:
    return F.when(F.trim(name).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(name).cast("long"))


def _pairs(rows: DataFrame, text: str) -> DataFrame:
    """The rows with each name and value (null unless it is a string) of the object in ``text``; an object that isn't valid or repeats a name gives none."""
    view = rows.withColumn("_v", F.expr(f"try_parse_json({text})")).where(F.col("_v").isNotNull() & F.expr("schema_of_variant(_v) LIKE 'OBJECT%'"))
    names = F.json_object_keys(text)
    typed = F.from_json(F.col(text), "map<string,variant>")
    out = view.withColumns({"_size": F.size(names), "_map": typed}).select(*rows.columns, "_size", F.explode("_map").alias("name", "_x"))
    return out.withColumn("value", F.when(F.expr("schema_of_variant(_x) = 'STRING'"), F.expr("CAST(_x AS STRING)"))).drop("_x")


def partial_rows(raw: DataFrame, asked: DataFrame, key: str, column: str) -> DataFrame:
    """The rows of a broken answer that surely belong to what was asked (key, index): key, index, text, shape.

    Whole lines of one name and one text each, whose number was asked for and stands there once; where there is none, the one object that
    an answer consists of, if its names are the numbers asked for, each once, and all its values texts. Nothing is put by position.
    """
    lines = raw.select(key, F.explode(F.split(F.coalesce(column, F.lit("")), NEWLINE)).alias("_l")).select(key, F.regexp_replace(F.trim("_l"), ",+$", "").alias("_l"))
    one = _pairs(lines.where(F.col("_l").startswith("{")), "_l").where("_size = 1").select(key, _index(F.col("name")).alias("index"), "value").where((F.trim("value") != "") & F.col("index").isNotNull())
    sure = one.join(asked.select(key, "index"), [key, "index"], "left_semi").groupBy(key, "index").agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("text")).where("_n = 1").select(key, "index", "text", F.lit("line").alias("shape"))
    text = F.trim(F.coalesce(column, F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)^```[^\r\n]*[\r\n]+(.+?)\s*[\r\n]+```$", 1)
    bare = F.trim(F.when(fenced != "", fenced).otherwise(text))
    rest = raw.select(key, bare.alias("_b")).join(sure.select(key).distinct(), key, "left_anti").where(F.col("_b").startswith("{"))
    whole = objects(rest, key, "_b").where("begin = 0").join(rest, key).where(F.regexp_replace(F.expr("substring(_b, CAST(end AS INT) + 1)"), r"\s+", "").isin("", "}"))
    dense = _pairs(whole.select(key, "object"), "object").select(key, "_size", _index(F.col("name")).alias("index"), F.when(F.trim("value") != "", F.col("value")).alias("text"))
    size = asked.groupBy(key).agg(F.count_distinct("index").alias("_asked"))
    good = dense.join(asked.select(key, "index").distinct().withColumn("_hit", F.lit(1)), [key, "index"], "left").groupBy(key).agg(F.min("_size").alias("_size"), F.count_distinct(F.when(F.col("_hit").isNotNull() & F.col("text").isNotNull(), F.col("index"))).alias("_good"))
    fits = good.join(size, key).where((F.col("_good") == F.col("_size")) & (F.col("_good") == F.col("_asked"))).select(key)
    return sure.union(dense.join(fits, key, "left_semi").select(key, "index", "text", F.lit("object")))


def _cell(value: Column) -> Column:
    """A table cell without bold marks, backticks and tags."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\*\*(.+?)\*\*", "$1"), r"`([^`]+)`", "$1")
    return F.trim(F.regexp_replace(plain, r"<[^>]+>", ""))


def table_terms(raw: DataFrame, key: str, column: str) -> DataFrame:
    """Terms in the Markdown tables of an answer: key, pos, src, dst, info.

    A row's columns are those of the last heading above it that names a source and a target; a blank line ends the table, rows without a heading
    go. Where the source isn't the first column and a row begins with a bare number, that is a counter and left out.
    """
    lines = raw.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), NEWLINE)).alias("pos", "_l"))
    upto = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("_table", F.sum((F.trim("_l") == "").cast("int")).over(upto)).where(~F.col("_l").rlike(r"^\s*\|[\s:|\-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_extract("_l", r"^\s*\|(.+)\|\s*$", 1), r"\|"), _cell)
    rows = lines.where(F.col("_l").rlike(r"^\s*\|(.+)\|\s*$")).withColumn("_c", cells).withColumn("_low", F.transform("_c", F.lower))
    at = lambda names: F.array_min(F.transform(F.array_intersect("_low", F.array(*[F.lit(n) for n in names])), lambda n: F.array_position("_low", n)))
    head = F.struct(at(SOURCE_HEADS).alias("src"), at(TARGET_HEADS).alias("dst"), at(REMARK_HEADS).alias("info"))
    rows = rows.withColumn("_h", head).withColumn("_h", F.when(F.col("_h.src").isNotNull() & F.col("_h.dst").isNotNull(), F.col("_h")))
    under = rows.withColumn("_of", F.last("_h", True).over(Window.partitionBy(key, "_table").orderBy("pos"))).where(F.col("_h").isNull() & F.col("_of").isNotNull())
    first = F.try_element_at(F.filter("_c", lambda c: c != ""), F.lit(1))
    counter = (F.col("_of.src") != 1) & F.coalesce(first.rlike(r"^\d+[.)、]?$"), F.lit(False))
    under = under.withColumn("_c", F.when(counter, F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0)))).otherwise(F.col("_c")))
    get = lambda name: F.coalesce(F.try_element_at("_c", F.col(f"_of.{name}").cast("int")), F.lit(""))
    return under.select(key, F.col("pos").cast("long").alias("pos"), get("src").alias("src"), get("dst").alias("dst"), get("info").alias("info")).where("src <> '' AND dst <> ''")


def salvaged_rows(raw: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of an answer that is one JSON value: key, index, text. An object of numbers and texts, a list of texts by place, or either within objects of one name each."""
    text = F.trim(F.coalesce(column, F.lit("")))
    wrap = rf"^(?:\{{\s*{STRING}\s*:\s*(?=[{{\[]))+"
    depth = F.size(F.regexp_extract_all(F.regexp_extract(text, wrap, 0), F.lit(f"({STRING})"), F.lit(1)))
    inner = F.when(depth > 0, F.regexp_replace(F.regexp_replace(text, wrap, ""), F.concat(F.lit(r"(?:\s*\}){"), depth.cast("string"), F.lit(r"}\s*$")), F.lit(""))).otherwise(text)
    rows = raw.select(key, inner.alias("_t")).where(F.expr("try_parse_json(_t)").isNotNull())
    named = _pairs(rows.where(F.col("_t").startswith("{")), "_t").select(key, _index(F.col("name")).alias("index"), F.col("value").alias("text"))
    items = rows.where(F.col("_t").startswith("[")).select(key, F.posexplode(F.from_json("_t", "array<variant>")).alias("index", "_x"))
    listed = items.select(key, F.col("index").cast("long"), F.when(F.expr("schema_of_variant(_x) = 'STRING'"), F.expr("CAST(_x AS STRING)")).alias("text"))
    return named.union(listed).where("index IS NOT NULL AND text IS NOT NULL")
