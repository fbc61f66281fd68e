"""Every registered query of the engine, with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.functions import confidence as C
from inkspark.functions import text as X
from inkspark.operators import chunks, context, duplicates, glossary, limits, quality, rewrite, state
from inkspark.sources import sinks
from inkspark.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: lines of documents, as every oracle reads them
SEG = r"""seg AS (SELECT doc_id, lang, source, (i - 1)::BIGINT AS seg_idx, l[i] AS line FROM
 (SELECT doc_id, lang, source, l, unnest(range(1, len(l) + 1)) AS i FROM
  (SELECT doc_id, lang, source, CASE WHEN len(p) > 1 AND p[-1] = '' THEN p[:-2] ELSE p END AS l FROM
   (SELECT doc_id, lang, source, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS p FROM documents))))"""
PAIRS = """pairs AS (SELECT conv_id, turn, text AS src, dst FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS dst FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""
FINAL = """(right(trim(line), 1) IN ('.', '。', '?', '？', '!', '！', '…', '''', '"', '」', '』'))"""


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return S.segments(_docs(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.pairs(S.table(spark, d, "conversations"))


@query(f"WITH {SEG} SELECT doc_id, seg_idx, lang, source, line FROM seg")
def segment_scan(spark, d):
    return _segments(spark, d)


@query(f"WITH {SEG} SELECT lang, count(*) AS lines, sum(length(line))::BIGINT AS chars, count(*) FILTER (WHERE NOT {FINAL}) AS unfinished FROM seg GROUP BY lang")
def segment_counts_by_lang(spark, d):
    return _segments(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line").cast("long")).alias("chars"), F.count_if(~X.ends_sentence(F.col("line"))).alias("unfinished"))


@query(rf"WITH {SEG} SELECT lang, count(*) FILTER (WHERE regexp_matches(line, '\p{{L}}')) AS with_letters, count(*) FILTER (WHERE regexp_matches(line, '[A-Za-zÀ-ɏ]')) AS latin, count(*) FILTER (WHERE regexp_matches(line, '[Ѐ-ӿ]')) AS cyrillic FROM seg GROUP BY lang")
def script_filter_by_lang(spark, d):
    line = F.col("line")
    return _segments(spark, d).groupBy("lang").agg(F.count_if(~X.is_skippable(line)).alias("with_letters"), F.count_if(X.has_script(line, "en")).alias("latin"), F.count_if(X.has_script(line, "ru")).alias("cyrillic"))


@query(rf"WITH {SEG} SELECT doc_id, seg_idx, regexp_extract(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AS email FROM seg WHERE regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')")
def email_lines(spark, d):
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return _segments(spark, d).where(F.col("line").rlike(pattern)).select("doc_id", "seg_idx", F.regexp_extract("line", pattern, 0).alias("email"))


def _tokens(spark, d):
    return _docs(spark, d).select("doc_id", "lang", "source", F.explode(F.split("text", r"[ \n]+")).alias("raw")).where("raw <> ''")


def _counted(spark, d, *by: str):
    """Each different token once, so that what cleans it runs on few rows."""
    return _tokens(spark, d).groupBy(*by, "raw").agg(F.count(F.lit(1)).alias("n"))


TOKENS = r"tok AS (SELECT doc_id, lang, source, raw FROM (SELECT doc_id, lang, source, unnest(string_split_regex(text, '[ \n]+')) AS raw FROM documents) WHERE raw <> '')"
BARE = """trim(regexp_replace(raw, '^["''「」『』《》〈〉()（）\\[\\]【】,.;:!?，。、；：！？…—–·]+|["''「」『』《》〈〉()（）\\[\\]【】,.;:!?，。、；：！？…—–·]+$', '', 'g'))"""


@query(f"WITH {TOKENS} SELECT term, count(*) AS n FROM (SELECT {BARE} AS term FROM tok) WHERE term <> '' GROUP BY term")
def clean_boundary_terms(spark, d):
    return _counted(spark, d).select(X.bare_term(F.col("raw")).alias("term"), "n").where("term <> ''").groupBy("term").agg(F.sum("n").alias("n"))


@query(rf"WITH {TOKENS} SELECT raw AS token, count(*) AS n FROM tok WHERE NOT regexp_matches(raw, '[^\s\p{{N}}\p{{P}}\p{{S}}]') GROUP BY raw")
def rule_noise_filter(spark, d):
    return _counted(spark, d).where(X.is_noise_term(F.col("raw"))).select(F.col("raw").alias("token"), "n")


@query(f"""WITH {TOKENS}, forms AS (SELECT lower({BARE}) AS key, {BARE} AS form, count(*) AS n FROM tok GROUP BY 1, 2)
SELECT key, form, votes FROM (SELECT key, form, sum(n) OVER (PARTITION BY key)::BIGINT AS votes, row_number() OVER (PARTITION BY key ORDER BY n DESC, form) AS r FROM forms WHERE key <> '') WHERE r = 1""")
def vote_surface_form(spark, d):
    # forms are counted first, so the vote itself works on one row a form
    form = X.bare_term(F.col("raw"))
    forms = _counted(spark, d).select(form.alias("form"), "n").where("form <> ''").groupBy(F.lower("form").alias("key"), "form").agg(F.sum("n").alias("n"))
    return forms.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("top"), F.sum("n").alias("votes")).select("key", "top.form", "votes")


#: a derived glossary: lower-cased words of 7 letters and more in at least 2 % of the documents, target the word spelled backwards
TERMS = rf"""{TOKENS}, terms AS (SELECT src, reverse(src) AS dst FROM (SELECT lower({BARE}) AS src, count(DISTINCT doc_id) AS n FROM tok GROUP BY 1)
 WHERE length(src) >= 7 AND n >= 0.02 * (SELECT count(*) FROM documents))"""


def _terms(spark, d):
    total = _docs(spark, d).count()
    words = glossary.common_words(_docs(spark, d), 7, 0.02 * total)
    return words.select("src", F.reverse("src").alias("dst"), F.lit(False).alias("case_sensitive"))


@query(f"WITH {SEG}, {TERMS} SELECT doc_id, seg_idx, src, dst FROM seg JOIN terms ON contains(lower(line), src)")
def glossary_theta_join(spark, d):
    return glossary.matched(_segments(spark, d), _terms(spark, d)).select("doc_id", "seg_idx", "src", "dst")


@query(f"""WITH {SEG}, {TERMS}, m AS (SELECT doc_id, seg_idx, src, dst, contains(lower(reverse(line)), dst) AND doc_id % 3 <> 0 AS present FROM seg JOIN terms ON contains(lower(line), src))
SELECT count(*) AS matches, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE NOT present) AS review, count(DISTINCT (doc_id, seg_idx)) AS segments, count(DISTINCT CASE WHEN NOT present THEN (doc_id, seg_idx) END) AS review_segments FROM m""")
def glossary_audit_totals(spark, d):
    lines = _segments(spark, d)
    final = F.when(F.col("doc_id") % 3 != 0, F.reverse("line")).otherwise(F.lit(""))  # stands in for translations: a third of the documents has none
    return glossary.audit_totals(glossary.audited(glossary.matched(lines, _terms(spark, d)), lines.select("doc_id", "seg_idx", final.alias("final"))))


@query(f"WITH {SEG} SELECT source, count(*) AS missing FROM seg WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY source")
def missing_translation_anti(spark, d):
    done = S.table(spark, d, "labels").select("doc_id").distinct()
    return _segments(spark, d).join(done, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("missing"))


@query(f"""WITH {TOKENS}, each AS (SELECT source, lower({BARE}) AS src, {BARE} AS form, count(*) AS n FROM tok GROUP BY 1, 2, 3),
whole AS (SELECT src, sum(n)::BIGINT AS frequency FROM each WHERE length(src) >= 4 GROUP BY src HAVING sum(n) >= 20),
refs AS (SELECT source, src, list(form ORDER BY n DESC, form) AS forms FROM each GROUP BY source, src),
rounds AS (SELECT src, list(forms ORDER BY round, source NULLS FIRST) AS lists FROM refs, (SELECT unnest(range(6)) AS round) GROUP BY src),
pick AS (SELECT src, list_reduce(list_prepend(CAST([] AS VARCHAR[]), lists), lambda acc, x: CASE WHEN len(acc) < 6 THEN acc || list_filter(x, lambda y: NOT list_contains(acc, y))[1:1] ELSE acc END) AS refs FROM rounds)
SELECT src, frequency, array_to_string(refs, '|') AS refs FROM whole JOIN pick USING (src)""")
def combine_terms_by_source(spark, d):
    form = X.bare_term(F.col("raw"))
    each = _counted(spark, d, "source").select("source", form.alias("form"), "n").groupBy("source", F.lower("form").alias("src"), "form").agg(F.sum("n").alias("n")).where(F.char_length("src") >= 4)
    records = each.groupBy(F.col("source").alias("file"), "src").agg(F.sum("n").alias("frequency"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "form"))).alias("x"))
    records = records.select("file", "src", F.lit("").alias("dst"), F.lit("").alias("info"), "frequency", F.transform("x", lambda r: r["form"]).alias("references"))
    return glossary.combined(records, 6).where("frequency >= 20").select("src", "frequency", F.array_join("references", "|").alias("refs"))


@query(f"""WITH {SEG}, m AS (SELECT *, contains(line, 'ation') AS a, contains(replace(line, 'ation', '#####'), 'tion') AS b FROM seg)
SELECT 'ation' AS src, count(*) AS frequency FROM m WHERE a UNION ALL SELECT 'tion', count(*) FROM m WHERE b""")
def term_masked_frequency(spark, d):
    return glossary.masked_frequency(_segments(spark, d), [("tion", False), ("ation", False)]).select("src", "frequency")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_per_user(spark, d):
    return state.latest(S.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS events, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id ORDER BY last_at DESC LIMIT 50 OFFSET 10""")
def event_merge_page(spark, d):
    merged = state.merged_events(S.table(spark, d, "events"), "user_id", "event_id", ["event_type", "props"])
    return state.page(merged, [F.desc("last_at"), F.asc("user_id")], 50, 10)


@query("SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus <> 'P') AS total FROM orders GROUP BY 1")
def status_progress_pivot(spark, d):
    rows = S.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "priority")
    return state.progress(rows, ["priority"], "o_orderstatus", {"failed": "F", "open": "O", "pending": "P"}, skipped="P")


@query("SELECT event_type, count(*) AS requests, sum(round(value * 100)::BIGINT)::BIGINT AS cents, bool_or(value > 100) AS large FROM events GROUP BY event_type")
def usage_totals(spark, d):
    return S.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.coalesce(F.bool_or(F.col("value") > 100), F.lit(None)).alias("large"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, round(length(dst)::DOUBLE / greatest(length(src), 1), 6) AS ratio, length(dst)::DOUBLE / greatest(length(src), 1) NOT BETWEEN 0.25 AND 4.0 AS flagged FROM pairs")
def length_ratio_flags(spark, d):
    ratio = C.length_ratio(F.col("src"), F.col("dst"))
    return _pairs(spark, d).select("conv_id", "turn", F.round(ratio, 6).alias("ratio"), (~ratio.between(0.25, 4.0)).alias("flagged"))


MARKS = "[,.;:!?，。；：！？、「」『』《》〈〉…—–]"


@query(f"WITH {PAIRS} SELECT conv_id, turn, abs(len(regexp_extract_all(dst, '{MARKS}')) - len(regexp_extract_all(src, '{MARKS}')))::BIGINT AS delta, abs(len(regexp_extract_all(dst, '{MARKS}')) - len(regexp_extract_all(src, '{MARKS}'))) > 12 AS flagged FROM pairs")
def punctuation_delta_flags(spark, d):
    delta = C.punctuation_delta(F.col("src"), F.col("dst"))
    return _pairs(spark, d).select("conv_id", "turn", delta.alias("delta"), (delta > 12).alias("flagged"))


@query(f"""WITH {PAIRS}, n AS (SELECT conv_id, turn, len(regexp_extract_all(src, '[。！？!?….]'))::BIGINT AS src_marks, len(regexp_extract_all(dst, '[。！？!?….]'))::BIGINT AS dst_marks, length(regexp_replace(trim(src), '(?:[”’』」〉》】》）»›]|\\s)+$', '')) AS l FROM pairs)
SELECT conv_id, turn, src_marks, dst_marks, l >= 30 AND src_marks >= 3 AND dst_marks < src_marks * 0.5 AS flagged FROM n""")
def sentence_loss_flags(spark, d):
    src, dst = F.col("src"), F.col("dst")
    return _pairs(spark, d).select("conv_id", "turn", X.count_of(src, X.SENTENCE_END).alias("src_marks"), X.count_of(dst, X.SENTENCE_END).alias("dst_marks"), C.lost_sentences(src, dst).alias("flagged"))


@query()
def confidence_verdicts(spark, d):
    """All rules at once over user and assistant turns."""
    rows = _pairs(spark, d).withColumn("v", C.verdict(F.col("src"), F.col("dst"), source="en", target="de"))
    return rows.select("conv_id", "turn", "v.low", F.array_join("v.tags", ",").alias("tags"), F.size("v.reasons").alias("reasons"))


@query(f"WITH {SEG} SELECT doc_id, seg_idx // 24 AS chunk, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM seg GROUP BY 1, 2")
def chunk_by_count(spark, d):
    return chunks.by_count(_segments(spark, d), 24).groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line").cast("long")).alias("chars"))


@query(f"""WITH RECURSIVE {SEG}, c AS (SELECT doc_id, seg_idx, greatest(1, length(line) // 4)::BIGINT AS cost FROM seg),
f AS (SELECT doc_id, seg_idx, cost AS used, 0::BIGINT AS chunk FROM c WHERE seg_idx = 0
 UNION ALL SELECT c.doc_id, c.seg_idx, CASE WHEN f.used + c.cost > 400 THEN c.cost ELSE f.used + c.cost END, CASE WHEN f.used + c.cost > 400 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN c ON c.doc_id = f.doc_id AND c.seg_idx = f.seg_idx + 1)
SELECT doc_id, seg_idx, chunk FROM f""")
def chunk_by_budget(spark, d):
    cost = F.greatest(F.lit(1), F.expr("char_length(line) div 4"))
    return chunks.by_budget(_segments(spark, d), cost, 400).select("doc_id", "seg_idx", "chunk")


@query(f"""WITH {SEG}, b AS (SELECT *, coalesce(max(CASE WHEN NOT {FINAL} THEN seg_idx END) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS bar FROM seg)
SELECT b.doc_id, b.seg_idx, count(p.seg_idx) AS n, coalesce(string_agg(p.line, '|' ORDER BY p.seg_idx), '') AS context FROM b LEFT JOIN seg p ON p.doc_id = b.doc_id AND p.seg_idx < b.seg_idx AND p.seg_idx > b.bar AND p.seg_idx >= b.seg_idx - 4 GROUP BY 1, 2""")
def context_lookback(spark, d):
    return chunks.context(_segments(spark, d), 4).select("doc_id", "seg_idx", F.size("context").cast("long").alias("n"), F.array_join("context", "|").alias("context"))


@query(f"""WITH {SEG}, s AS (SELECT *, sum(CASE WHEN NOT {FINAL} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS section FROM seg)
SELECT doc_id, section::BIGINT AS section, min(seg_idx) AS first, count(*) AS lines FROM s GROUP BY 1, 2""")
def sections_by_unfinished_line(spark, d):
    rows = chunks.sections(_segments(spark, d), ~X.ends_sentence(F.col("line")))
    return rows.groupBy("doc_id", "section").agg(F.min("seg_idx").alias("first"), F.count(F.lit(1)).alias("lines"))


@query(f"WITH {SEG} SELECT trim(line) AS line, count(*) AS copies, count(DISTINCT doc_id) AS documents FROM seg WHERE length(trim(line)) >= 10 GROUP BY 1 HAVING count(*) > 1")
def repeated_line_groups(spark, d):
    return duplicates.repeated(_segments(spark, d))


@query(f"WITH {SEG} SELECT a.doc_id, a.seg_idx AS i, b.seg_idx AS j FROM seg a JOIN seg b ON a.doc_id = b.doc_id AND b.seg_idx BETWEEN a.seg_idx + 1 AND a.seg_idx + 3 AND a.line = b.line")
def adjacent_band_pairs(spark, d):
    return duplicates.band(_segments(spark, d)).where(F.col("left") == F.col("right")).select("doc_id", "i", "j")


@query()
def similar_adjacent_pairs(spark, d):
    """Neighbouring lines whose Ratcliff-Obershelp ratio is 0.88 or more."""
    return duplicates.similar_neighbours(_segments(spark, d)).select("doc_id", "i", "j", F.round("ratio", 6).alias("ratio"))


@query(r"SELECT word, count(*) AS count FROM (SELECT lower(unnest(regexp_extract_all(text, '[\p{Latin}\p{Hangul}]+(?:[''’][\p{Latin}]+)?'))) AS word FROM documents) GROUP BY word ORDER BY count DESC, word LIMIT 5000")
def word_frequency_topk(spark, d):
    return quality.top_words(_docs(spark, d))


@query(f"""WITH {SEG} SELECT doc_id, seg_idx, replace(replace(line, 'tion', 'TION'), 'TIONs', 'sNOIT') AS line_new, ((length(line) - length(replace(line, 'tion', ''))) // 4)::BIGINT AS n0, ((length(replace(line, 'tion', 'TION')) - length(replace(replace(line, 'tion', 'TION'), 'TIONs', ''))) // 5)::BIGINT AS n1 FROM seg WHERE contains(line, 'tion')""")
def replace_with_counts(spark, d):
    out = rewrite.replaced(_segments(spark, d), "line", [rewrite.Rule("tion", "TION"), rewrite.Rule("TIONs", "sNOIT")])
    return out.where(F.col("replacements")[0] > 0).select("doc_id", "seg_idx", "line_new", F.col("replacements")[0].alias("n0"), F.col("replacements")[1].alias("n1"))


@query(f"""WITH {SEG}, p AS (SELECT doc_id, seg_idx, line, string_split(line, 'ness') AS parts FROM seg WHERE contains(line, 'ness')),
e AS (SELECT *, unnest(range(1, len(parts))) AS k FROM p), o AS (SELECT doc_id, seg_idx, line, k - 1 AS n, length(array_to_string(parts[1:k], 'ness')) AS pos FROM e)
SELECT doc_id, seg_idx, n::BIGINT AS n, pos::BIGINT AS "at", substr(line, greatest(pos - 45, 0) + 1, least(pos, 45)) AS before, substr(line, pos + 5, 65) AS after FROM o""")
def keyword_in_context(spark, d):
    return rewrite.occurrences(_segments(spark, d), "line", rewrite.Rule("ness"), keep=("doc_id", "seg_idx")).drop("match")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_request_count(spark, d):
    return limits.sliding(S.table(spark, d, "events"), 86_400, ["user_id"]).select("event_id", "n")


@query("SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_request_count_global(spark, d):
    return limits.sliding_global(S.table(spark, d, "events"), 60).select("event_id", "n")


@query("SELECT event_id, (sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW))::BIGINT AS cents FROM events")
def token_sliding_sum(spark, d):
    return limits.sliding(S.table(spark, d, "events"), 86_400, ["user_id"], F.round(F.col("value") * 100).cast("long"), "cents").select("event_id", "cents")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recent_tasks_topk(spark, d):
    return state.page(S.table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS place FROM part")
def natural_sort_parts(spark, d):
    w = Window.partitionBy("p_brand").orderBy(state.natural_key(F.col("p_name")), "p_partkey")
    return S.table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH a AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change, a.n_chars AS before, b.n_chars AS after
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.n_chars <> b.n_chars""")
def full_outer_diff(spark, d):
    docs = _docs(spark, d).select("doc_id", "n_chars")
    after = docs.where("doc_id % 4 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return quality.difference(docs.where("doc_id % 5 <> 0"), after, ["doc_id"], "n_chars")


@query(r"""WITH t AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<template\b.*?</template\s*>|<noscript\b.*?</noscript\s*>', '', 'gis') AS x FROM pages),
u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '<br\s*/?>|</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|nav|header|footer|blockquote|pre|body|html|main|aside|figure)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g') AS x FROM t),
v AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM u)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t]*\n[ \t\n]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM v""")
def visible_text(spark, d):
    return S.table(spark, d, "pages").select("page_id", S.visible_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, (i - 1)::BIGINT AS position, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS h FROM pages))""")
def page_links(spark, d):
    return S.links(S.table(spark, d, "pages")).withColumn("position", F.col("position").cast("long"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
t AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT regexp_replace(href, '[?#].*$', '') AS path, count(*) AS links FROM h WHERE href LIKE '/%' AND regexp_replace(href, '[?#].*$', '') NOT IN (SELECT path FROM t) GROUP BY 1""")
def dangling_page_links(spark, d):
    pages = S.table(spark, d, "pages")
    targets = pages.select(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return quality.dangling_links(S.links(pages), targets).groupBy("path").agg(F.count(F.lit(1)).alias("links"))


@query(r"SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type")
def json_fields(spark, d):
    k = F.get_json_object("props", "$.k")
    return S.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("with_k"), F.count_distinct(k).alias("kinds"))


@query(f"WITH {SEG} SELECT doc_id, string_agg(line, chr(10) ORDER BY seg_idx) || CASE WHEN right(any_value(t), 1) = chr(10) THEN chr(10) ELSE '' END AS text FROM (SELECT seg.*, d.text AS t FROM seg JOIN documents d USING (doc_id)) GROUP BY doc_id")
def rebuilt_text(spark, d):
    """Segments with their line ends put together again: the texts themselves."""
    rows = S.newlines(_docs(spark, d))
    return sinks.translated(rows, rows.select("doc_id", "seg_idx", F.col("line").alias("dst")))


@query(f"WITH {SEG} SELECT doc_id, count(*) AS lines, sum(CASE WHEN length(line) = 0 THEN 0 ELSE greatest(1, floor(length(line) / 3.5)) END)::BIGINT AS tokens, sha256(string_agg(doc_id || ':' || seg_idx || chr(31) || line, chr(30) ORDER BY seg_idx)) AS fingerprint FROM seg GROUP BY doc_id")
def document_fingerprint(spark, d):
    rows = _segments(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(X.token_estimate(F.col("line"))).alias("tokens"), F.array_sort(F.collect_list(F.struct("seg_idx", "line"))).alias("x"))
    parts = F.transform("x", lambda r: F.concat(F.col("doc_id").cast("string"), F.lit(":"), r["seg_idx"].cast("string"), F.lit("\x1f"), r["line"]))
    return rows.select("doc_id", "lines", "tokens", F.sha2(F.array_join(parts, "\x1e"), 256).alias("fingerprint"))


@query(f"""WITH {PAIRS} SELECT trim(dst) AS dst, count(*) AS rows, count(DISTINCT lower(regexp_replace(src, '\\s+', '', 'g'))) AS sources FROM pairs GROUP BY 1 HAVING count(DISTINCT lower(regexp_replace(src, '\\s+', '', 'g'))) >= 2 AND trim(dst) <> '' AND (length(trim(dst)) >= 10 OR count(DISTINCT lower(regexp_replace(src, '\\s+', '', 'g'))) >= 3)""")
def duplicate_drift(spark, d):
    return duplicates.drift_groups(_pairs(spark, d).withColumn("g", F.lit(0)), "g").drop("g")


@query("""SELECT user_id, coalesce(sum(CASE WHEN event_type = 'click' THEN epoch_us(nx) - epoch_us(ts) END), 0) / 1000000 AS active_seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) GROUP BY user_id""")
def active_time(spark, d):
    rows = S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.active_seconds(rows, "user_id", "ts", "event_type", ("click",))


@query(rf"""WITH {TERMS}, m AS (SELECT doc_id, src, text, string_split(text, src) AS parts FROM documents JOIN terms ON contains(text, src)),
k AS (SELECT doc_id, src, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM m),
o AS (SELECT doc_id, src, text, k, n, (sum(length(part)) OVER (PARTITION BY doc_id, src ORDER BY k) + (k - 1) * length(src))::BIGINT AS pos FROM k),
x AS (SELECT src, doc_id, pos, trim(regexp_replace(substr(text, greatest(pos - 80, 0) + 1, pos - greatest(pos - 80, 0) + length(src) + 80), '\s+', ' ', 'g')) AS excerpt FROM o WHERE k < n),
f AS (SELECT src, excerpt, min((doc_id, pos)) AS place FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY place) AS n FROM f)
SELECT src, n::INTEGER AS n, place[1] AS doc_id, place[2]::BIGINT AS "at", excerpt FROM r WHERE n <= 3""")
def reference_contexts(spark, d):
    return context.excerpts(_docs(spark, d), _terms(spark, d))


@query()
def oversized_pieces(spark, d):
    """Lines cut to 200 characters at sentence ends."""
    return context.pieces(_segments(spark, d), 200).select("doc_id", "seg_idx", "part", F.char_length("piece").alias("chars"))


@query(f"""WITH RECURSIVE {SEG}, c AS (SELECT doc_id, seg_idx, CASE WHEN length(line) = 0 THEN 1 ELSE greatest(1, floor(length(line) / 3.5)) END::BIGINT AS cost FROM seg),
f AS (SELECT doc_id, seg_idx, cost AS used, 1 AS n, 0::BIGINT AS batch FROM c WHERE seg_idx = 0
 UNION ALL SELECT c.doc_id, c.seg_idx, CASE WHEN f.n >= 5 OR f.used + c.cost > 1200 THEN c.cost ELSE f.used + c.cost END, CASE WHEN f.n >= 5 OR f.used + c.cost > 1200 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 5 OR f.used + c.cost > 1200 THEN f.batch + 1 ELSE f.batch END
 FROM f JOIN c ON c.doc_id = f.doc_id AND c.seg_idx = f.seg_idx + 1)
SELECT doc_id, batch, count(*) AS lines FROM f GROUP BY 1, 2""")
def retry_micro_batches(spark, d):
    cost = F.greatest(F.lit(1), X.token_estimate(F.col("line")))
    return chunks.by_budget(_segments(spark, d), cost, 1_200, most=5).groupBy("doc_id", F.col("chunk").alias("batch")).agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT segment_id, string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS subtasks FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey AS segment_id FROM lineitem) GROUP BY segment_id")
def segment_owner_index(spark, d):
    rows = S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("segments"))
    index = context.segment_owners(rows.select(F.col("l_orderkey").cast("string").alias("subtask_id"), F.col("l_orderkey").cast("string").alias("ord"), "segments"))
    return index.select("segment_id", F.array_join("subtasks", ",").alias("subtasks"))


@query("""WITH a AS (SELECT c_custkey, c_nationkey FROM customer), n AS (SELECT lower(trim(n_name)) AS key, n_regionkey FROM nation)
SELECT lower(trim(p_name)) AS key, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS targets, count(*) AS entries FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def glossary_conflicts(spark, d):
    rows = S.table(spark, d, "part").select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"))
    return glossary.conflicts(rows).select("key", F.array_join("targets", ",").alias("targets"), "entries")


from inkspark.plans import contrasts, pages, requests, rules  # noqa: E402,F401  they register their queries with those above
