"""Queries over what pages show and where it stands in their source; ``catalog`` registers them with its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.operators import markup
from inkspark.plans.catalog import query
from inkspark.plans.rules import SPACE
from inkspark.sources import tables as S


def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


#: two words of a page, the first of which begins with th or de, and what they are replaced by
WORDS, PUT = r"\b(?:[Tt]h|[Dd]e)[a-z]*\s[A-Za-z&]+", "<two words>"
WORDS_SQL = WORDS.replace("'", "''")
#: the visible pieces of pages with their places, the text made of them, and the matches of WORDS
PIECES = rf"""tok AS (SELECT page_id, t, i, length(t) AS size FROM (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html,
 '(?s)<!--.*?-->|<![^>]*>|<\?[^>]*>|(?i:<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>)|</?[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?|[^<&]+|[<&]') AS x FROM pages))),
tag AS (SELECT *, sum(size) OVER w - size AS b, CASE WHEN size > 1 AND regexp_matches(t, '^<[/A-Za-z!?]') THEN lower(regexp_extract(t, '^</?(?:[A-Za-z][^\s/>:]*:)?([A-Za-z][^\s/>:]*)', 1)) END AS tag FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY i)),
hid AS (SELECT *, sum(CASE WHEN tag IN ({_listed(markup.HIDDEN)}) AND NOT ends_with(t, '/>') THEN CASE WHEN starts_with(t, '</') THEN -1 ELSE 1 END ELSE 0 END) OVER w AS o, count(tag) OVER w AS marks FROM tag WINDOW w AS (PARTITION BY page_id ORDER BY i)),
low AS (SELECT *, o > least(0, min(o) OVER (PARTITION BY page_id ORDER BY i)) AS hidden FROM hid),
run AS (SELECT page_id, i, b, marks, unnest(x) AS raw, generate_subscripts(x, 1) AS k, tag IS NOT NULL AS block, tag IS NULL AND regexp_matches(t, '^&.') AS entity FROM (SELECT *, CASE WHEN tag IS NOT NULL THEN [chr(10)] WHEN regexp_matches(t, '^&.') THEN [t] ELSE regexp_extract_all(t, '{SPACE}+|[^{SPACE[1:]}+') END AS x FROM low WHERE NOT hidden AND (tag IS NULL OR tag IN ({_listed(markup.BLOCKS)})))),
val AS (SELECT *, b + sum(length(raw)) OVER (PARTITION BY page_id, i ORDER BY k) - length(raw) AS begin, NOT block AND NOT entity AND regexp_matches(raw, '^{SPACE}') AS space,
 CASE WHEN entity THEN CASE raw WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&#39;' THEN '''' WHEN '&nbsp;' THEN chr(160) WHEN '&amp' THEN '&' WHEN '&middot;' THEN '·' WHEN '&copy;' THEN '©' ELSE raw END WHEN NOT block AND regexp_matches(raw, '^{SPACE}') THEN ' ' ELSE raw END AS v FROM run),
sol AS (SELECT *, NOT space AND NOT block AND v <> chr(160) AS solid, sum((NOT space AND NOT block)::INT) OVER (PARTITION BY page_id ORDER BY i, k) AS filled FROM val),
bef AS (SELECT *, lag(solid) OVER w AS prior, coalesce(max(CASE WHEN block THEN filled END) OVER (PARTITION BY page_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM sol WINDOW w AS (PARTITION BY page_id ORDER BY i, k)),
pieces AS (SELECT page_id, row_number() OVER w - 1 AS m, v, sum(length(v)) OVER w - length(v) AS pos, CASE WHEN NOT block THEN begin END AS begin, CASE WHEN NOT block THEN begin + CASE WHEN space THEN 1 ELSE length(raw) END END AS fin, NOT block AND NOT entity AS exact, marks
 FROM bef WHERE CASE WHEN space THEN coalesce(prior, false) WHEN block THEN filled > since ELSE true END WINDOW w AS (PARTITION BY page_id ORDER BY i, k)),
shown AS (SELECT page_id, string_agg(v, '' ORDER BY m) AS text FROM pieces GROUP BY page_id),
hit AS (SELECT page_id, n - 1 AS n, match, sum(length(gap) + length(match)) OVER (PARTITION BY page_id ORDER BY n) AS stop FROM (SELECT page_id, unnest(regexp_extract_all(text, '(?s)(.*?)({WORDS_SQL})', 1)) AS gap, unnest(regexp_extract_all(text, '(?s)(.*?)({WORDS_SQL})', 2)) AS match, unnest(range(1, len(regexp_extract_all(text, '(?s)(.*?)({WORDS_SQL})', 2)) + 1)) AS n FROM shown)),
part AS (SELECT h.page_id, h.n, h.match, h.stop - length(h.match) AS start, h.stop, p.m, p.marks, p.begin IS NULL AS line, p.begin + CASE WHEN p.exact THEN greatest(h.stop - length(h.match) - p.pos, 0) ELSE 0 END AS low,
  CASE WHEN p.exact AND h.stop < p.pos + length(p.v) THEN p.begin + h.stop - p.pos ELSE p.fin END AS high, NOT p.exact AND p.begin IS NOT NULL AND (p.pos < h.stop - length(h.match) OR p.pos + length(p.v) > h.stop) AS torn
 FROM hit h JOIN pieces p ON p.page_id = h.page_id AND p.pos < h.stop AND p.pos + length(p.v) > h.stop - length(h.match)),
matched AS (SELECT page_id, n, start, stop, match, min(low) AS begin, max(high) AS fin, CASE WHEN bool_or(line) THEN 'crosses a line end' WHEN bool_or(torn) THEN 'splits an entity' END AS fault FROM part GROUP BY ALL)"""


@query(f'WITH {PIECES} SELECT page_id, n::BIGINT AS n, start::BIGINT AS start, stop::BIGINT AS stop, match, begin::BIGINT AS begin, fin::BIGINT AS "end", substr(html, begin::INT + 1, (fin - begin)::INT) AS source, fault FROM matched JOIN pages USING (page_id)')
def visible_matches(spark, d):
    """Where two words that a reader sees next to each other stand in a page's source, markup between them or not."""
    return markup.page_matches(S.table(spark, d, "pages"), WORDS).drop("first", "last")


@query(f"""WITH {PIECES}, runs AS (SELECT page_id, n, marks, min(low) AS low, max(high) AS high, row_number() OVER (PARTITION BY page_id, n ORDER BY marks) AS r FROM part WHERE NOT EXISTS (SELECT 1 FROM matched x WHERE x.page_id = part.page_id AND x.n = part.n AND x.fault IS NOT NULL) GROUP BY page_id, n, marks),
gaps AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY page_id ORDER BY low), 0) AS prev FROM runs),
upd AS (SELECT page_id, string_agg(substr(html, prev::INT + 1, (low - prev)::INT) || CASE WHEN r = 1 THEN '&lt;two words&gt;' ELSE '' END, '' ORDER BY low) || substr(any_value(html), max(high)::INT + 1) AS updated FROM gaps JOIN pages USING (page_id) GROUP BY page_id),
cnt AS (SELECT page_id, count(*) AS matches, count(fault) AS faults FROM matched GROUP BY page_id)
SELECT page_id, matches, faults, sha256(html) AS fingerprint, CASE WHEN page_id % 7 = 0 THEN 'changed' WHEN faults > 0 THEN 'faulty' ELSE 'ready' END AS state, CASE WHEN page_id % 7 <> 0 AND faults = 0 THEN sha256(updated) END AS updated FROM cnt JOIN pages USING (page_id) LEFT JOIN upd USING (page_id)""")
def page_replacements(spark, d):
    """A replacement of those words, held against an earlier plan's fingerprints, of which every seventh is out of date."""
    pages = S.table(spark, d, "pages")
    earlier = pages.select("page_id", F.sha2(F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("fingerprint"))
    return markup.replacement_plan(pages, WORDS, PUT, earlier).withColumn("updated", F.sha2("updated", 256))
