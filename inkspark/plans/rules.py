"""Queries of single rules over lines, pairs, logs and names, each with SQL; ``catalog`` registers them with its own."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from inkspark.functions import confidence as C
from inkspark.functions import text as X
from inkspark.operators import chunks, context, recovery, state
from inkspark.plans.catalog import PAIRS, SEG, TOKENS, _counted, _docs, _pairs, _segments, query
from inkspark.sources import tables as S

SPACE = r"[\s\x0B\x{85}\x1c-\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def _identifier(x: str) -> str:
    s = _strip(x)
    bare = rf"regexp_replace(regexp_replace({s}, '(?i)^\s*ISBN(?:-1[03])?\s*(?:[:：|｜]\s*)?', ''), '[-\s]', '', 'g')"
    return rf"""(regexp_matches({s}, '^[0-9Xx*\s-]*[Xx*]') AND regexp_matches({s}, '^(?:01[016789]|02|0[3-6][1-5])[-\s][0-9Xx*]{{3,4}}[-\s][0-9Xx*]{{4}}$')
 OR regexp_matches({s}, '(?i)^(?:https?://|www\.)[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{{1,5}})?(?:[/?#][^\s]*)?$') OR regexp_matches({s}, '^@[A-Za-z0-9_][A-Za-z0-9_.-]*$')
 OR regexp_matches({s}, '(?i)^\s*ISBN(?:-1[03])?\s*(?:[:：|｜]\s*)?') AND regexp_matches({bare}, '^(?:97[89][0-9]{{10}}|[0-9]{{9}}[0-9Xx])$'))"""


@query(f"""WITH {TOKENS}, c AS (SELECT raw, count(*) AS n FROM tok GROUP BY raw), f AS (SELECT n, CASE length(raw) % 5 WHEN 0 THEN '@' || raw WHEN 1 THEN 'https://' || raw || '.org/' || n WHEN 2 THEN 'ISBN: 978-030640' || (1000 + n % 9000) WHEN 3 THEN '010-' || (1000 + n % 9000) || '-xx' || (10 + n % 90) ELSE raw END AS token FROM c)
SELECT token, sum(n)::BIGINT AS n FROM f WHERE {_identifier('token')} GROUP BY token""")
def identifier_tokens(spark, d):
    """Words dressed as handles, addresses, book and phone numbers; those that are identifiers stay."""
    dressed = F.expr("""CASE length(raw) % 5 WHEN 0 THEN concat('@', raw) WHEN 1 THEN concat('https://', raw, '.org/', n) WHEN 2 THEN concat('ISBN: 978-030640', 1000 + n % 9000)
     WHEN 3 THEN concat('010-', 1000 + n % 9000, '-xx', 10 + n % 90) ELSE raw END""")
    return _counted(spark, d).select(dressed.alias("token"), "n").where(X.is_identifier(F.col("token"))).groupBy("token").agg(F.sum("n").alias("n"))


@query(rf"""WITH {SEG}, s AS (SELECT lang, regexp_matches(line, '[A-Za-zÀ-ɏ]') AS latin, regexp_matches(line, '[Ѐ-ӿ]') AS cyrillic, regexp_matches(line, '\p{{L}}') AS letters, {_identifier('line')} AS identifier FROM seg)
SELECT lang, count(*) FILTER (WHERE NOT identifier AND (cyrillic OR (NOT latin AND letters))) AS from_ru, count(*) FILTER (WHERE NOT identifier AND (latin OR (NOT cyrillic AND letters))) AS into_ru, count(*) FILTER (WHERE NOT identifier AND letters) AS latin_only FROM s GROUP BY lang""")
def translation_need(spark, d):
    need = lambda a, b: F.count_if(X.needs_translation(F.col("line"), a, b))
    return _segments(spark, d).groupBy("lang").agg(need("ru", "en").alias("from_ru"), need("en", "ru").alias("into_ru"), need("en", "de").alias("latin_only"))


@query(f"""WITH {SEG}, i AS (SELECT doc_id, seg_idx, repeat(' ', length(line) % 3) || line || repeat('　', length(line) % 2) AS line FROM seg),
e AS (SELECT doc_id, seg_idx, length(regexp_extract(line, '^({SPACE}*)', 1)) AS lead, {_strip('line')} AS body, length(regexp_extract(line, '({SPACE}*)$', 1)) AS t FROM i)
SELECT doc_id, seg_idx, lead, body, CASE WHEN body = '' THEN 0 ELSE t END AS trail FROM e WHERE lead > 0 OR t > 0""")
def line_edges(spark, d):
    """Lines indented by spaces and ended by ideographic ones, as their length says."""
    rows = _segments(spark, d).withColumn("line", F.expr("concat(repeat(' ', length(line) % 3), line, repeat('　', length(line) % 2))")).withColumn("e", X.edges(F.col("line")))
    rows = rows.select("doc_id", "seg_idx", F.char_length("e.lead").alias("lead"), "e.body", F.char_length("e.trail").alias("trail"))
    return rows.where("lead > 0 or trail > 0")


@query(rf"""WITH {SEG}, c AS (SELECT source, line, {_strip(f"regexp_replace(line, '{SPACE}+', ' ', 'g')")} AS collapsed, regexp_replace(line, '[\x{{200b}}-\x{{200f}}\x{{2060}}\x{{2062}}-\x{{2064}}\x{{feff}}\x{{ad}}]', '', 'g') AS seen FROM seg)
SELECT source, count(*) FILTER (WHERE collapsed <> line) AS spaced, sum(length(collapsed))::BIGINT AS chars, sum(length(line) - length(seen))::BIGINT AS invisible FROM c GROUP BY source""")
def cleaned_lines(spark, d):
    line = F.col("line")
    size = lambda c: F.char_length(c).cast("long")
    return _segments(spark, d).groupBy("source").agg(F.count_if(X.collapsed(line) != line).alias("spaced"), F.sum(size(X.collapsed(line))).alias("chars"), F.sum(size(line) - size(X.without_invisibles(line))).alias("invisible"))


@query(rf"""WITH n AS (SELECT page_id, url, url || '?token=' || page_id || '&part=1' AS link, regexp_replace(regexp_replace(regexp_replace({_strip('url')}, '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name FROM pages)
SELECT page_id, {_identifier('url')} AS identifier, regexp_replace(link, '[?]token=[^&]*', '?token=***') AS redacted, CASE WHEN name = '' THEN 'output' ELSE name END AS file_name, regexp_matches(name, '^[A-Za-z0-9._-]+$') AS safe FROM n""")
def page_names(spark, d):
    url = F.col("url")
    rows = S.table(spark, d, "pages")
    link = F.concat(url, F.lit("?token="), F.col("page_id").cast("string"), F.lit("&part=1"))
    name = X.safe_file_name(url)
    return rows.select("page_id", X.is_identifier(url).alias("identifier"), X.redacted_url(link).alias("redacted"), name.alias("file_name"), X.safe_id(name).alias("safe"))


@query("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant' AND turn % 3 <> 0)
SELECT u.conv_id, u.turn, CASE WHEN a.text IS NULL THEN 'missing' WHEN trim(a.text) = trim(u.text) THEN 'matched' ELSE 'different' END AS state FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn""")
def request_states(spark, d):
    rows = S.table(spark, d, "conversations")
    place = lambda turn: F.concat_ws(":", "conv_id", turn.cast("string")).alias("segment_id")
    asked = rows.where("role = 'user'").select("conv_id", "turn", place(F.col("turn")), "text")
    now = rows.where("role = 'assistant' and turn % 3 <> 0").select(place(F.col("turn") - 1), F.col("text").alias("dst"))
    return recovery.request_references(asked, now).select("conv_id", "turn", "state")


@query("""WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'),
v AS (SELECT conv_id, text, rn, rn + CASE WHEN low % 3 = 0 THEN 100 ELSE 0 END AS place FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, min(length(text)) OVER (PARTITION BY conv_id) AS low FROM conversations WHERE role = 'assistant')),
n AS (SELECT v.conv_id, count(*) AS answers, count(u.place) AS known FROM v LEFT JOIN u ON u.conv_id = v.conv_id AND u.place = v.place GROUP BY v.conv_id),
p AS (SELECT n.conv_id, CASE WHEN known = asked THEN 'complete' WHEN known = 0 AND answers = asked THEN 'positional' ELSE 'subset' END AS policy FROM n JOIN (SELECT conv_id, count(*) AS asked FROM u GROUP BY conv_id) q ON q.conv_id = n.conv_id)
SELECT u.conv_id, u.place, coalesce(p.policy, 'none') AS policy, CASE WHEN p.policy = 'positional' THEN b.text ELSE k.text END AS text
FROM u LEFT JOIN p ON p.conv_id = u.conv_id LEFT JOIN v k ON k.conv_id = u.conv_id AND k.place = u.place LEFT JOIN v b ON b.conv_id = u.conv_id AND b.rn = u.place""")
def aligned_answers(spark, d):
    """Assistant turns as answers to user turns; in a third of the conversations the answers' indices are unknown."""
    rows = S.table(spark, d, "conversations")
    index = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = rows.where("role = 'user'").select("conv_id", index.alias("index"))
    off = F.when(F.min(F.char_length("text")).over(Window.partitionBy("conv_id")) % 3 == 0, 100).otherwise(0)
    answered = rows.where("role = 'assistant'").select("conv_id", (index + off).alias("index"), "text")
    return recovery.aligned(asked, answered, "conv_id").select("conv_id", F.col("index").alias("place"), "policy", "text")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC NULLS LAST, turn) AS r FROM conversations) WHERE r = 1")
def best_turns(spark, d):
    return recovery.best(S.table(spark, d, "conversations"), ["conv_id"], [F.char_length("text"), -F.col("turn")]).select("conv_id", "turn")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_event_per_user(spark, d):
    return state.first_source(S.table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_orderpriority AS priority, count(*) AS rows FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 4 = 0) GROUP BY 1")
def authoritative_orders(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    log = S.table(spark, d, "orders").withColumns({"status": status, "accepted": F.col("o_orderkey") % 4 == 0, "preserved": F.when(F.col("o_orderkey") % 3 == 0, False)})
    return state.authoritative(log).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH x AS (SELECT *, coalesce(bool_or(event_id % 97 = 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM events)
SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 = 0) AS dst, arg_max(props, event_id) FILTER (WHERE event_id % 5 = 0) AS info, bool_or(event_id % 97 = 0) AS deleted, count(*) AS changes FROM x WHERE NOT dead GROUP BY user_id""")
def replayed_decisions(spark, d):
    n = F.col("event_id")
    log = S.table(spark, d, "events").select("user_id", "event_id", F.when(n % 97 == 0, "delete").otherwise("edit").alias("action"), F.when(n % 3 == 0, F.col("event_type")).alias("dst"), F.when(n % 5 == 0, F.col("props")).alias("info"))
    return state.replayed(log, ["user_id"], ["event_id"])


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, max(n) AS rounds, coalesce(bool_or(event_type = before) FILTER (WHERE n = last), false) AND max(n) >= 3 AS settled FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS last FROM r) GROUP BY user_id""")
def settled_rounds(spark, d):
    return state.consensus(S.table(spark, d, "events"), ["user_id"], "event_id", ["event_type"])


@query("""WITH c AS (SELECT o_custkey AS customer, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS other FROM orders GROUP BY 1)
SELECT customer, CASE WHEN other > 1 THEN 'stopped' WHEN failed > 0 AND completed > 0 THEN 'completed_with_errors' WHEN failed > 0 THEN 'failed' WHEN completed >= total THEN 'completed' ELSE 'pending' END AS status FROM c""")
def final_status_by_customer(spark, d):
    rows = state.progress(S.table(spark, d, "orders").withColumnRenamed("o_custkey", "customer"), ["customer"], "o_orderstatus", {"completed": "F", "failed": "O", "other": "P"})
    return rows.select("customer", state.final_status(F.col("total"), F.col("completed"), F.col("failed"), F.col("other") > 1).alias("status"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderpriority AS priority, count(*) AS rows FROM orders GROUP BY 1, 2")
def dangling_orders(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    rows = state.dangling_failed(S.table(spark, d, "orders").withColumn("status", status))
    return rows.groupBy("status", F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_type, sum(least(30.0, pow(2.0, event_id % 8))) AS seconds FROM events GROUP BY event_type")
def backoff_seconds(spark, d):
    return S.table(spark, d, "events").groupBy("event_type").agg(F.sum(state.backoff(F.col("event_id") % 8 + 1)).alias("seconds"))


@query(f"WITH {SEG} SELECT doc_id, seg_idx, concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w) AS preview FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)")
def line_previews(spark, d):
    return chunks.preview(_segments(spark, d)).select("doc_id", "seg_idx", "preview")


@query(f"WITH {SEG} SELECT doc_id, seg_idx, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) <= count(*) OVER (PARTITION BY doc_id) // 2 THEN 0 ELSE 1 END AS half FROM seg")
def payload_halves(spark, d):
    return chunks.halves(_segments(spark, d), "doc_id", "seg_idx").select("doc_id", "seg_idx", "half")


@query(f"""WITH {SEG}, h AS (SELECT doc_id, seg_idx, 1 + length(line) % 4 AS level FROM seg WHERE length(line) % 3 = 0), m AS (SELECT *, max(CASE WHEN level = 1 THEN seg_idx END) OVER w AS a, max(CASE WHEN level = 2 THEN seg_idx END) OVER w AS b, max(CASE WHEN level = 3 THEN seg_idx END) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, seg_idx, level, nullif(greatest(CASE WHEN level > 1 THEN coalesce(a, -1) ELSE -1 END, CASE WHEN level > 2 THEN coalesce(b, -1) ELSE -1 END, CASE WHEN level > 3 THEN coalesce(c, -1) ELSE -1 END), -1) AS parent FROM m""")
def heading_parents(spark, d):
    """The tree of lines that stand in for headings, their length giving the level."""
    size = F.char_length("line")
    return chunks.parents(_segments(spark, d).where(size % 3 == 0).select("doc_id", "seg_idx", (size % 4 + 1).alias("level")))


@query(f"WITH {SEG} SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) - 1 AS used FROM seg) WHERE used <= 500 GROUP BY doc_id")
def fitted_lines(spark, d):
    return recovery.fitted(_segments(spark, d), 500, "doc_id", "seg_idx", "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_as FROM documents WHERE text IS NOT NULL")
def first_of_content(spark, d):
    return recovery.first_of_content(_docs(spark, d), "text", "doc_id", "doc_id").select("doc_id", "kept_as")


@query(f"""WITH {SEG}, o AS (SELECT 'tion' AS rule, source AS path FROM seg WHERE contains(line, 'tion') UNION ALL SELECT 'ness', source FROM seg WHERE contains(line, 'ness'))
SELECT rule, path, least(count(*), 200) AS captured, count(*) AS total, count(*) > 200 AS truncated FROM o GROUP BY rule, path""")
def replacement_report(spark, d):
    rows = _segments(spark, d).select(F.explode(F.array(F.lit("tion"), F.lit("ness"))).alias("rule"), F.col("source").alias("path"), "line")
    return recovery.replacement_report(rows.where(F.expr("contains(line, rule)")))


@query(f"""WITH {PAIRS}, s AS (SELECT conv_id, turn, regexp_replace({_strip('src')}, '(?:[”’』」〉》】》）»›]|\\s)+$', '') AS s, regexp_replace({_strip('dst')}, '(?:[”’』」〉》】》）»›]|\\s)+$', '') AS t FROM (SELECT conv_id, turn, src, CASE WHEN turn % 3 = 0 THEN dst || 'x' ELSE dst END AS dst FROM pairs))
SELECT conv_id, turn, regexp_matches(s, '[。！？!?….]$') AND length(s) >= 6 AND length(t) >= 6 AND regexp_matches(t, '[\\p{{L}}\\p{{N}}]$') AS flagged FROM s""")
def dangling_end_flags(spark, d):
    rows = _pairs(spark, d).withColumn("dst", F.when(F.col("turn") % 3 == 0, F.concat("dst", F.lit("x"))).otherwise(F.col("dst")))
    return rows.select("conv_id", "turn", C.dangling_end(F.col("src"), F.col("dst")).alias("flagged"))


def _norm(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[-\s:：|｜]', '', 'g'))"


@query(f"""WITH {PAIRS}, t AS (SELECT *, {_strip('dst')} AS t FROM pairs), n AS (SELECT *, greatest(length(t), 1) AS n, len(regexp_extract_all(t, '[A-Za-z]')) AS latin, len(regexp_extract_all(t, '[㐀-䶿一-鿿豈-﫿]')) AS han FROM t)
SELECT conv_id, turn, length(t) >= 20 AND NOT ({_identifier('src')} AND {_norm('src')} = {_norm('dst')}) AND latin / n >= 0.4 AND han / n < 0.1 AS flagged FROM n""")
def weak_target_flags(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", C.weak_target(F.col("src"), F.col("dst"), "zh").alias("flagged"))


@query(rf"""WITH {PAIRS}, w AS (SELECT conv_id, turn, lower(regexp_replace(src, '\s+', '', 'g')) AS a, lower(regexp_replace(CASE WHEN turn % 4 = 0 THEN upper(src) ELSE dst END, '\s+', '', 'g')) AS b FROM pairs),
c AS (SELECT *, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM w), m AS (SELECT *, len(list_intersect(x, y)) AS common FROM c)
SELECT conv_id, turn, length(a) >= 8 AND length(b) >= 8 AND (a = b OR common >= 0.92 * (len(x) + len(y) - common)) AS flagged FROM m""")
def echo_flags(spark, d):
    """Every fourth turn's translation is its source in capitals."""
    dst = F.when(F.col("turn") % 4 == 0, X.capitals(F.col("src"))).otherwise(F.col("dst"))
    return _pairs(spark, d).select("conv_id", "turn", C.echo(F.col("src"), dst).alias("flagged"))


@query(f"""WITH {PAIRS} SELECT conv_id, turn, turn % 4 = 0 OR regexp_matches(dst, '(?i)^\\s*(?:translation|translated text|target text)\\s*[:：]|^\\s*(?:here is|here''s)\\b.{{0,40}}\\btranslation\\b|^\\s*(?:as an ai|i(?:''|’)m sorry|sorry,?\\s+i)\\b') OR contains(dst, '```') AS flagged FROM pairs""")
def chatter_flags(spark, d):
    """Every fourth turn's translation has wrapper text before it."""
    dst = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Here is the translation of it: "), "dst")).otherwise(F.col("dst"))
    return _pairs(spark, d).select("conv_id", "turn", C.chatter(dst).alias("flagged"))


def _error() -> Column:
    return F.expr("CASE event_id % 4 WHEN 0 THEN concat('[llm.', event_type, '] failed ', event_type) WHEN 1 THEN 'TimeoutError after a while' WHEN 2 THEN '[quality.residue] words remain' ELSE concat('kept ', event_type) END")


@query("""SELECT CASE event_id % 4 WHEN 0 THEN 'llm.' || event_type WHEN 2 THEN 'quality.residue' ELSE '' END AS code,
 CASE event_id % 4 WHEN 0 THEN 'failed ' || event_type WHEN 1 THEN 'TimeoutError after a while' WHEN 2 THEN 'words remain' ELSE 'kept ' || event_type END AS message, event_id % 4 < 2 AS request, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def failure_kinds(spark, d):
    rows = S.table(spark, d, "events").withColumn("error", _error()).withColumn("p", context.error_parts(F.col("error")))
    return rows.groupBy("p.code", "p.message", context.is_request_failure(F.col("error")).alias("request")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEG} SELECT doc_id, n, total, total > 0 AND n >= 4 AND n >= 0.5 * total AS flagged, total > 0 AND (n >= 4 AND n >= 0.5 * total OR total > 1 AND total < 4 AND n = total) AS small FROM (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE regexp_matches(line, '[0-9]')) AS n FROM seg GROUP BY doc_id)")
def mass_residue_documents(spark, d):
    rows = _segments(spark, d).groupBy("doc_id").agg(F.count_if(F.col("line").rlike("[0-9]")).alias("n"), F.count(F.lit(1)).alias("total"))
    return rows.select("doc_id", "n", "total", context.mass_residue(F.col("n"), F.col("total")).alias("flagged"), context.mass_residue(F.col("n"), F.col("total"), small_all=True).alias("small"))


@query("""WITH u AS (SELECT event_type, event_id % 3 AS kind, event_id % 700 AS a, event_id % 50 AS b, event_id % 40 AS c FROM events)
SELECT event_type, sum(CASE WHEN kind = 2 THEN a + c ELSE a END)::BIGINT AS input, sum(CASE WHEN kind < 2 THEN b ELSE 0 END)::BIGINT AS output, sum(CASE WHEN kind <> 1 THEN c ELSE 0 END)::BIGINT AS cached, count(*) FILTER (WHERE kind = 2) AS estimated FROM u GROUP BY event_type""")
def usage_blocks(spark, d):
    """Three providers' blocks of token counts."""
    block = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"prompt_tokens":', event_id % 700, ',"completion_tokens":', event_id % 50, ',"prompt_tokens_details":{"cached_tokens":', event_id % 40, '}}')
     WHEN 1 THEN concat('{"input_tokens":', event_id % 700, ',"output_tokens":', event_id % 50, '}') ELSE concat('{"prompt_cache_miss_tokens":', event_id % 700, ',"prompt_cache_hit_tokens":', event_id % 40, ',"estimated":true}') END""")
    rows = S.table(spark, d, "events").withColumn("u", context.usage(block))
    return rows.groupBy("event_type").agg(*[F.sum(f"u.{n}").alias(n) for n in ("input", "output", "cached")], F.count_if("u.estimated").alias("estimated"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END AS file, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS segment FROM documents")
def segment_places(spark, d):
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.concat_ws(":", "doc_id", "n_chars"))
    file, segment = state.segment_order(name)
    return _docs(spark, d).select("doc_id", file.alias("file"), segment.alias("segment"))


@query(f"WITH {SEG} SELECT doc_id, seg_idx, CASE WHEN length(line) > 200 THEN 0 WHEN contains(line, '@') THEN 1 WHEN line = '' THEN 2 ELSE 3 END AS rank FROM seg")
def risk_ranks(spark, d):
    line = F.col("line")
    tags = F.array_compact(F.array(F.when(line == "", "empty"), F.when(line.contains("@"), "mail"), F.when(F.char_length(line) > 200, "long")))
    return _segments(spark, d).select("doc_id", "seg_idx", state.risk_rank(tags, ["long", "mail", "empty"]).alias("rank"))
