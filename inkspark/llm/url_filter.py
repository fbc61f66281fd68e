"""URL filters by a temporal list join.

List entries are dated: (kind, value, day, action add or remove, verdict block or allow). An entry's history becomes validity intervals -
from each day to the next one that changes it - and a capture is judged by an as-of join with the entries active on its day:
those of its host, of the domains above it, and of its path's prefixes. The most specific active entry decides (prefixes before
hosts before domains, longer before shorter; of equal ones the later, then block).

Scale: captures and intervals are shuffled by (kind, value, salt): a capture takes one of ``salts`` by its own hash and every
interval is given to all of them, so a host or domain with a third of all captures is spread. Verdicts are a partial aggregate. A
history is ordered per entry, after the changes of a day are folded to one.

Edge cases: a null url, or one without scheme and host, has no host and verdict none; a null day is before every entry; entries
with a null value or day are ignored; of one entry's several changes on a day the removal wins, then block; repeated rows are
judged each; an empty list gives none everywhere; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, verdict, since, until): the spans of days on which entries are active; until is null for open ones."""
    rows = entries.where(F.col("value").isNotNull() & F.col("day").isNotNull() & F.col("kind").isNotNull())
    day = rows.groupBy("kind", "value", "day").agg(F.max(F.struct(F.col("action") == "remove", F.col("verdict") == "block", "action", "verdict")).alias("x"))
    ahead = F.lead("day").over(Window.partitionBy("kind", "value").orderBy("day"))
    return day.select("kind", "value", F.col("x.action").alias("action"), F.col("x.verdict").alias("verdict"), F.col("day").alias("since"), ahead.alias("until")).where("action = 'add'").drop("action")


def keys_of(host: Column, path: Column) -> Column:
    """Every (kind, value, rank) that an entry for the url could have; the larger rank decides."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value"), (F.size(labels) - i + 1).cast("int").alias("rank")))
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("value"), (F.lit(2_000_000) + i).cast("int").alias("rank")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(1_000_000).alias("rank")))
    return F.when(host != "", F.concat(domains, own, prefixes)).otherwise(F.array().cast("array<struct<kind:string,value:string,rank:int>>"))


def judged(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "day", salts: int = 16) -> DataFrame:
    """Per row of ``captures``: its key, host, day, verdict (block, allow, none), kind, value and since of the entry that decides."""
    row = F.struct(F.col(key).alias("key"), F.col(url).alias("url"), F.col(day).cast("long").alias("day"))
    rows = captures.select(row.alias("row"))
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    asked = rows.distinct().select("row", salt.alias("salt"), F.explode(keys_of(host_of(F.col("row.url")), path_of(F.col("row.url")))).alias("k")).select("row", "salt", "k.kind", "k.value", "k.rank")
    spans = intervals(entries).withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    active = (F.col("row.day") >= F.col("since")) & (F.col("until").isNull() | (F.col("row.day") < F.col("until")))
    best = asked.join(spans, ["kind", "value", "salt"]).where(active).groupBy("row").agg(F.max(F.struct("rank", "since", F.col("verdict") == "block", "verdict", "kind", "value")).alias("x"))
    judged_rows = rows.withColumn("_r", F.xxhash64("row")).join(best.withColumn("_r", F.xxhash64("row")).withColumnRenamed("row", "_row"), ["_r"], "left").where(F.col("_row").isNull() | F.col("_row").eqNullSafe(F.col("row")))
    return judged_rows.select(F.col("row.key").alias(key), host_of(F.col("row.url")).alias("host"), F.col("row.day").alias("day"), F.coalesce("x.verdict", F.lit("none")).alias("verdict"), F.col("x.kind").alias("kind"), F.col("x.value").alias("value"), F.col("x.since").alias("since"))


def _number(text: Column, salt: str, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text).cast("binary")), 1, 7), 16, 10).cast("long") % n


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts, domains and first path parts: it grows with the table, as lists do."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    first = F.split_part(F.regexp_replace(path, "^/+|/+$", ""), F.lit("/"), F.lit(1))
    values = F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("value")),
        F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), first).alias("value")),
    )
    each = pages.where(host != "").select(F.explode(values).alias("x")).select("x.kind", "x.value").where("value != ''").distinct()
    name = F.concat(F.col("kind"), F.lit(":"), F.col("value"))
    listed = each.where(_number(name, "listed", 3) == 0)
    verdict = F.when(_number(name, "verdict", 4) == 0, "allow").otherwise("block")
    start, stay = _number(name, "start", 500), _number(name, "stay", 200) + 1
    changes = F.array(
        F.struct(start.alias("day"), F.lit("add").alias("action")),
        F.struct((start + stay).alias("day"), F.lit("remove").alias("action")),
        F.when(_number(name, "again", 2) == 0, F.struct((start + stay * 2).alias("day"), F.lit("add").alias("action"))),
    )
    return listed.select("kind", "value", verdict.alias("verdict"), F.explode(changes).alias("c")).where("c is not null").select("kind", "value", "verdict", "c.day", "c.action")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = _number(F.col("page_id").cast("string"), "day", 730)
    return judged(pages.withColumn("day", day), derived_entries(pages))


def _sql_number(text: str, salt: str, n: int) -> str:
    return f"(('0x' || substr(md5('{salt}' || {text}), 1, 7))::BIGINT % {n})"


_NAME = "kind || ':' || value"
ORACLE = rf"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host, trim(regexp_extract(coalesce(url, ''), '{PATH}', 1), '/') AS path, {_sql_number("page_id::VARCHAR", "day", 730)} AS day FROM pages),
v AS (SELECT 'host' AS kind, host AS value FROM p WHERE host <> '' UNION SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM p WHERE host <> '' UNION SELECT 'prefix', host || '/' || split_part(path, '/', 1) FROM p WHERE host <> ''),
e AS (SELECT kind, value, CASE WHEN {_sql_number(_NAME, "verdict", 4)} = 0 THEN 'allow' ELSE 'block' END AS verdict, {_sql_number(_NAME, "start", 500)} AS a, {_sql_number(_NAME, "stay", 200)} + 1 AS n, {_sql_number(_NAME, "again", 2)} = 0 AS again
      FROM v WHERE value <> '' AND {_sql_number(_NAME, "listed", 3)} = 0),
i AS (SELECT kind, value, verdict, a AS since, a + n AS until FROM e UNION ALL SELECT kind, value, verdict, a + 2 * n, NULL FROM e WHERE again),
k AS (SELECT page_id, day, 'host' AS kind, host AS value, 1000000 AS rank FROM p WHERE host <> ''
      UNION ALL SELECT page_id, day, 'domain', array_to_string(string_split(host, '.')[j:], '.'), len(string_split(host, '.')) - j + 1 FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS j FROM p WHERE host <> '')
      UNION ALL SELECT page_id, day, 'prefix', host || '/' || array_to_string(string_split(path, '/')[1:j], '/'), 2000000 + j FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS j FROM p WHERE host <> '')),
b AS (SELECT page_id, k.kind, k.value, verdict, since, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, since DESC, verdict DESC) AS r
      FROM k JOIN i ON k.kind = i.kind AND k.value = i.value AND day >= since AND (until IS NULL OR day < until))
SELECT p.page_id, host, day, coalesce(verdict, 'none') AS verdict, kind, value, since FROM p LEFT JOIN b ON p.page_id = b.page_id AND r = 1
"""
