"""Rules over texts changed so that both outcomes occur: other scripts, invisible characters, repeated answers, names of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions import confidence as C
from inkspark.functions import text as X
from inkspark.operators import context, duplicates, rewrite
from inkspark.plans.catalog import PAIRS, SEG, _pairs, _segments, query
from inkspark.plans.rules import _identifier, _norm, _strip
from inkspark.sources import tables as S

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщхыз"
RUSSIAN = f"CASE WHEN doc_id % 3 = 0 THEN translate(lower(line), '{LATIN}', '{CYRILLIC}') WHEN doc_id % 3 = 1 THEN line ELSE concat(line, ' да') END"


@query(rf"""WITH {SEG}, m AS (SELECT lang, {RUSSIAN} AS line FROM seg), s AS (SELECT lang, regexp_matches(line, '[A-Za-zÀ-ɏ]') AS latin, regexp_matches(line, '[Ѐ-ӿ]') AS cyrillic, regexp_matches(line, '\p{{L}}') AS letters, {_identifier('line')} AS identifier FROM m)
SELECT lang, count(*) FILTER (WHERE latin) AS latin, count(*) FILTER (WHERE cyrillic) AS cyrillic, count(*) FILTER (WHERE NOT identifier AND (cyrillic OR (NOT latin AND letters))) AS from_ru, count(*) FILTER (WHERE NOT identifier AND (latin OR (NOT cyrillic AND letters))) AS into_ru FROM s GROUP BY lang""")
def scripts_mixed(spark, d):
    """A third of the documents in Cyrillic letters, a third with a Cyrillic word."""
    line = F.col("line")
    rows = _segments(spark, d).withColumn("line", F.expr(RUSSIAN))
    return rows.groupBy("lang").agg(
        F.count_if(X.has_script(line, "en")).alias("latin"), F.count_if(X.has_script(line, "ru")).alias("cyrillic"), F.count_if(X.needs_translation(line, "ru", "en")).alias("from_ru"), F.count_if(X.needs_translation(line, "en", "ru")).alias("into_ru"),
    )


HIDDEN = "CASE seg_idx % 4 WHEN 0 THEN concat(substr(line, 1, 3), chr(8203), substr(line, 4)) WHEN 1 THEN concat('  ', substr(line, 1, 5), '   ', substr(line, 6), chr(173)) WHEN 2 THEN concat(line, chr(8289)) ELSE line END"


@query(rf"""WITH {SEG}, h AS (SELECT source, {HIDDEN} AS line FROM seg), c AS (SELECT source, line, {_strip(r"regexp_replace(line, '[\s\x0B\x{85}\x1c-\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')")} AS collapsed, regexp_replace(line, '[\x{{200b}}-\x{{200f}}\x{{2060}}\x{{2062}}-\x{{2064}}\x{{feff}}\x{{ad}}]', '', 'g') AS seen FROM h)
SELECT source, count(*) FILTER (WHERE collapsed <> line) AS spaced, sum(length(collapsed))::BIGINT AS chars, sum(length(line) - length(seen))::BIGINT AS invisible FROM c GROUP BY source""")
def lines_with_invisibles(spark, d):
    """Lines with zero-width spaces, soft hyphens and runs of spaces in them, and with the one mark that is kept."""
    line = F.col("line")
    marks = F.expr(HIDDEN.replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')").replace("chr(173)", "decode(unhex('C2AD'), 'UTF-8')").replace("chr(8289)", "decode(unhex('E281A1'), 'UTF-8')"))
    size = lambda c: F.char_length(c).cast("long")
    rows = _segments(spark, d).withColumn("line", marks)
    return rows.groupBy("source").agg(F.count_if(X.collapsed(line) != line).alias("spaced"), F.sum(size(X.collapsed(line))).alias("chars"), F.sum(size(line) - size(X.without_invisibles(line))).alias("invisible"))


HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
TRANSLATED = "CASE turn % 8 WHEN 0 THEN concat('他慢慢地打开了门，然后走了出去。', substr(dst, 1, 5)) WHEN 2 THEN concat('门', dst) WHEN 4 THEN substr(dst, 1, 12) ELSE dst END"


@query(f"""WITH {PAIRS}, p AS (SELECT conv_id, turn, src, {TRANSLATED} AS dst FROM pairs), t AS (SELECT *, {_strip('dst')} AS t FROM p), n AS (SELECT *, greatest(length(t), 1) AS n, len(regexp_extract_all(t, '[A-Za-z]')) AS latin, len(regexp_extract_all(t, '[{HAN}]')) AS han FROM t)
SELECT conv_id, turn, length(t) >= 20 AND NOT ({_identifier('src')} AND {_norm('src')} = {_norm('dst')}) AND latin / n >= 0.4 AND han / n < 0.1 AS flagged FROM n""")
def weak_targets_mixed(spark, d):
    """Answers some of which are Chinese, nearly none of it, or short."""
    rows = _pairs(spark, d).withColumn("dst", F.expr(TRANSLATED))
    return rows.select("conv_id", "turn", C.weak_target(F.col("src"), F.col("dst"), "zh").alias("flagged"))


@query(f"WITH {SEG} SELECT doc_id, n, total, total > 0 AND n >= 4 AND n >= 0.5 * total AS flagged, total > 0 AND (n >= 4 AND n >= 0.5 * total OR total > 1 AND total < 4 AND n = total) AS small FROM (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE regexp_matches(line, 'ung|eau|ción')) AS n FROM seg GROUP BY doc_id)")
def residue_by_language(spark, d):
    """Documents most of whose lines hold syllables of German, French or Spanish."""
    rows = _segments(spark, d).groupBy("doc_id").agg(F.count_if(F.col("line").rlike("ung|eau|ción")).alias("n"), F.count(F.lit(1)).alias("total"))
    return rows.select("doc_id", "n", "total", context.mass_residue(F.col("n"), F.col("total")).alias("flagged"), context.mass_residue(F.col("n"), F.col("total"), small_all=True).alias("small"))


REPEATED = "CASE WHEN turn % 6 = 0 THEN 'The door opened slowly. ' WHEN conv_id % 7 = 0 THEN 'Yes.' ELSE dst END"


@query(f"""WITH {PAIRS}, r AS (SELECT conv_id % 3 AS g, regexp_replace(lower(src), '\\s+', '', 'g') AS src, trim({REPEATED}) AS dst FROM pairs)
SELECT g, dst, count(*) AS rows, count(DISTINCT src) AS sources FROM r GROUP BY g, dst HAVING count(DISTINCT src) >= 2 AND dst <> '' AND (length(dst) >= 10 OR count(DISTINCT src) >= 3)""")
def repeated_answers(spark, d):
    """Groups in which one sentence and one word answer many questions."""
    rows = _pairs(spark, d).withColumn("dst", F.expr(REPEATED)).withColumn("g", F.col("conv_id") % 3)
    return duplicates.drift_groups(rows, "g")


@query(f"""WITH {SEG}, p AS (SELECT doc_id, string_split(line, 'er') AS parts FROM seg WHERE contains(line, 'er')), e AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS k FROM p)
SELECT doc_id, count(*) AS hits, max(k - 1)::BIGINT AS most, sum(length(array_to_string(parts[1:k], 'er')))::BIGINT AS places FROM e GROUP BY doc_id""")
def keyword_places(spark, d):
    """A syllable that lines hold again and again: occurrences, the last one's number in its line, the sum of their places."""
    hits = rewrite.occurrences(_segments(spark, d), "line", rewrite.Rule("er"), keep=("doc_id",))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("most"), F.sum("at").alias("places"))


NAMED = "CASE page_id % 6 WHEN 0 THEN concat('@page_', page_id) WHEN 1 THEN concat('page ', page_id) WHEN 2 THEN concat('www.host.org/', page_id) WHEN 3 THEN concat('ISBN 978-0-306-40', 100 + page_id % 900, '-7') WHEN 4 THEN concat('@', url, ' and more') ELSE url END"


@query(f"WITH n AS (SELECT page_id, {NAMED} AS name FROM pages) SELECT page_id, name, {_identifier('name')} AS identifier, regexp_matches(name, '^[A-Za-z0-9._-]+$') AS safe FROM n")
def names_of_all_kinds(spark, d):
    rows = S.table(spark, d, "pages").select("page_id", F.expr(NAMED).alias("name"))
    return rows.select("page_id", "name", X.is_identifier(F.col("name")).alias("identifier"), X.safe_id(F.col("name")).alias("safe"))
