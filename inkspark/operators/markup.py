"""Searching and replacing in what a reader of a page sees, with every character's place in the page's source."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.entities import html5
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements that stand on lines of their own, and those that aren't seen
BLOCKS = ("address", "article", "aside", "blockquote", "br", "div", "dl", "dt", "dd", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
HIDDEN = ("head", "noscript", "template")

#: a page in full: comments and declarations, scripts and styles whole, tags, entities, text
TOKENS = re.compile(
    r"(?s)<!--.*?-->|<![^>]*+>|<\?[^>]*+>|(?ai:<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>)|</?[A-Za-z](?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>"
    r"|&(?:#[0-9]++|#[xX][0-9A-Fa-f]++|[A-Za-z][A-Za-z0-9]*+);?|[^<&]++|[<&]"
)
TAG = re.compile(r"(?a)</?(?:[A-Za-z][^\s/>:]*:)?([A-Za-z][^\s/>:]*)")
SPACE = " \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{SPACE}]++|[^{SPACE}]++")
BLANK = re.compile(f"[{SPACE}]+")
NUMBER = re.compile(r"&#([xX]?)([0-9A-Fa-f]+);?")
#: the references that HTML names, and the numbers that it reads as Windows-1252
ENTITIES = {f"&{name}": value for name, value in html5.items()} | {f"&#{n};": html.unescape(f"&#{n};") for n in range(0x80, 0xA0)}
SAMPLES = 30
_ROWS = 50_000  # rows of a batch that Python sends

#: what is known of a visible piece beside its page, and of a match
PIECE = "m long, value string, at long, begin long, end long, exact boolean, marks long"
MATCH = "n long, start long, stop long, match string, begin long, end long, first long, last long, fault string"


def _decoded(ref: str) -> str:
    """The characters of an entity, itself where it names none."""
    if ref in ENTITIES:
        return ENTITIES[ref]
    number = NUMBER.fullmatch(ref)
    if not number:
        return ref
    digits = number[2].lstrip("0") or "0"
    n = 1 << 21 if len(digits) > 7 else int(digits, 16 if number[1] else 10)
    return "\ufffd" if not n or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)


def _parts(source: str) -> Iterator[tuple[str, str, int, int, int, bool]]:
    """(kind, value, begin, size in the source, markup before it, is it seen as a character) of blocks, entities, white space and text that aren't hidden."""
    begin = depth = least = marks = 0
    for found in TOKENS.finditer(source):
        token, begin = found[0], found.start()
        if token[0] == "<" and len(token) > 1 and (token[1] in "/!?" or token[1].isascii() and token[1].isalpha()):
            name = TAG.match(token)
            tag = name[1].lower() if name else ""
            marks += 1
            if tag in HIDDEN and not token.endswith("/>"):
                depth += -1 if token[1] == "/" else 1
                # a closing tag without its opening one hides nothing
                least = min(least, depth)
            if tag in BLOCKS and depth <= least:
                yield "block", "\n", begin, len(token), marks, False
        elif depth > least:
            continue
        elif token[0] == "&" and len(token) > 1:
            value = _decoded(token)
            yield "entity", value, begin, len(token), marks, not BLANK.fullmatch(value)
        else:
            for run in RUNS.finditer(token):
                blank = BLANK.match(run[0]) is not None
                yield "space" if blank else "text", " " if blank else run[0], begin + run.start(), len(run[0]), marks, not blank


def _scanned(source: str | None) -> list[tuple]:
    """The visible pieces of a page as ``PIECE`` has them."""
    out, at, filled, before = [], 0, False, False
    for kind, value, begin, size, marks, solid in _parts(source or ""):
        if kind == "block":
            kept, filled = filled, False
        elif kind == "space":
            kept = before
        else:
            kept = filled = True
        before = solid
        if kept:
            line = kind == "block"
            out.append((len(out), value, at, None if line else begin, None if line else begin + (1 if kind == "space" else size), kind in ("space", "text"), marks))
            at += len(value)
    return out


def _found(pieces_: list[tuple], gaps: list[int], texts: list[str]) -> list[tuple]:
    """Matches as ``MATCH`` has them, by the characters between them: their ends are looked up among the pieces."""
    ats = [p[2] for p in pieces_]
    lines = list(accumulate(p[3] is None for p in pieces_))
    following, prior, seen = [None] * len(pieces_), [None] * len(pieces_), None
    for i in range(len(pieces_) - 1, -1, -1):
        following[i], seen = seen, seen if pieces_[i][3] is None else pieces_[i][3]
    seen = None
    for i, p in enumerate(pieces_):
        prior[i], seen = seen, seen if p[4] is None else p[4]
    out, stop = [], 0
    for n, (gap, text) in enumerate(zip(gaps, texts, strict=True)):
        start, stop = stop + gap, stop + gap + len(text)
        if not text:
            continue
        i, j = bisect_right(ats, start) - 1, bisect_right(ats, stop - 1) - 1
        a, b = pieces_[i], pieces_[j]
        begin = following[i] if a[3] is None else a[3] + start - a[2] if a[5] else a[3]
        end = prior[j] if b[3] is None else b[3] + stop - b[2] if b[5] else b[4]
        torn = (not a[5] and start > a[2]) or (not b[5] and stop < b[2] + len(b[1]))
        fault = "crosses a line end" if lines[j] - lines[i] + (a[3] is None) > 0 else "splits an entity" if torn else None
        out.append((n, start, stop, text, begin, end, a[0], b[0], fault))
    return out


def _changed(source: str, pieces_: list[tuple], hits: list[tuple], after: str) -> str:
    """The source with its matches' runs between markup cut out, the first of each replaced; markup stays."""
    cuts = []
    for _, start, stop, _, _, _, first, last, fault in hits:
        runs: dict[int, list[int]] = {}
        for _, value, at, begin, end, exact, marks in pieces_[first : last + 1] if fault is None else ():
            low = begin + start - at if exact and start > at else begin
            high = begin + stop - at if exact and stop < at + len(value) else end
            run = runs.setdefault(marks, [low, high])
            run[0], run[1] = min(run[0], low), max(run[1], high)
        cuts += [(low, high, "" if k else after) for k, (_, (low, high)) in enumerate(sorted(runs.items()))]
    out, done = [], 0
    for low, high, put in sorted(cuts):
        out += [source[done:low], put]
        done = high
    return "".join([*out, source[done:]])


def _by_page(rows: DataFrame, make: Callable[..., list[tuple]], key: str, ddl: str) -> DataFrame:
    """(key, ...) rows that ``make`` gives for each row's columns after the key."""
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string(ddl).fields])
    kinds = [f.dataType for f in schema.fields[1:]]
    arrow = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = schema.names, [arrow[k.simpleString()] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, made = [], []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                new = make(*row)
                of += [i] * len(new)
                made += new
                if len(made) >= _ROWS:
                    yield sent(batch, of, made)
                    of, made = [], []
            yield sent(batch, of, made)

    def sent(batch: pa.RecordBatch, of: list[int], made: list[tuple]) -> pa.RecordBatch:
        columns = zip(*made, strict=True) if made else [()] * len(types)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return rows.mapInArrow(run, schema)


def pieces(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """The visible pieces of a page in order: key, m (from 0), value, at (its place in the visible text), begin, end (its place in the source, null for a line end between blocks), exact (whether its
    characters are those of the source), marks (markup before it).

    White space shows as one space and not at a line's start; entities are decoded; elements that stand for themselves begin and end lines. A page, which is one value of
    a row, is read once from left to right.
    """
    return _by_page(pages.select(key, source), _scanned, key, PIECE)


def visible(found: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text) of the visible pieces."""
    return found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "value"))), lambda x: x["value"]), "").alias("text"))


def _searched(texts: DataFrame, pattern: str) -> DataFrame:
    """Adds the characters before each match and the matches to rows with a text.

    Each match begins where the one before ends, so behind the last one a text is read once and not from every place.
    """
    of = lambda begin, group: F.regexp_extract_all("text", F.lit(f"(?s){begin}(.*?)({pattern})"), F.lit(group))
    # after an empty match the next one can't begin at its end
    found = lambda group: F.when(F.lit("").rlike(pattern), of("", group)).otherwise(of(r"\G", group))
    return texts.withColumns({"_gaps": F.transform(found(1), lambda g: F.char_length(g).cast("long")), "_texts": found(2)}).where(F.size("_texts") > 0).drop("text")


def matches(found: DataFrame, pattern: str, key: str = "page_id") -> DataFrame:
    """Matches of a regular expression without groups in the visible text: key, n, start, stop, match, begin, end (in the source), first, last (pieces), fault.

    A page's pieces are gathered and a match's ends looked up among them, so a page with many of both costs little more than their sum. fault says what forbids to
    replace it: a line end between blocks, or a part of an entity. Empty matches don't count. ``page_matches`` finds them without a shuffle.
    """
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("m", "value", "at", "begin", "end", "exact", "marks"))).alias("_p"))
    texts = _searched(rows.withColumn("text", F.array_join(F.transform("_p", lambda x: x["value"]), "")), pattern)
    return _by_page(texts.select(key, "_p", "_gaps", "_texts"), lambda p, gaps, hits: _found([tuple(x.values()) for x in p], gaps, hits), key, MATCH)


def _page_texts(pages: DataFrame, pattern: str, key: str, source: str) -> DataFrame:
    """(key, source, _gaps, _texts) of the pages with a match."""
    shown = _by_page(pages.select(key, source), lambda x: [(x, "".join(p[1] for p in _scanned(x)))], key, "_source string, text string")
    return _searched(shown, pattern)


def page_matches(pages: DataFrame, pattern: str, key: str = "page_id", source: str = "html") -> DataFrame:
    """``matches`` of the pages' ``pieces``, with the source between begin and end as ``source``; each page is scanned for its text and for its matches' places, and nothing is shuffled."""
    place = lambda x, gaps, texts: [(*h, x[h[4] : h[5]]) for h in _found(_scanned(x), gaps, texts)]
    return _by_page(_page_texts(pages, pattern, key, source), place, key, f"{MATCH}, source string")


def edits(found: DataFrame, hits: DataFrame, replacement: str, key: str = "page_id") -> DataFrame:
    """What to change in the sources: key, begin, end, after. A match's runs between markup are cut out, the first is the replacement; markup stays."""
    each = hits.where("fault IS NULL").select(key, "n", "start", "stop", F.explode(F.sequence("first", "last")).alias("m")).join(found.select(key, "m", "at", "value", "begin", "end", "exact", "marks"), [key, "m"])
    low = F.when(F.col("exact") & (F.col("start") > F.col("at")), F.col("begin") + F.col("start") - F.col("at")).otherwise(F.col("begin"))
    high = F.when(F.col("exact") & (F.col("stop") < F.col("at") + F.char_length("value")), F.col("begin") + F.col("stop") - F.col("at")).otherwise(F.col("end"))
    runs = each.withColumns({"begin": low, "end": high}).groupBy(key, "n", "marks").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    first = F.row_number().over(Window.partitionBy(key, "n").orderBy("marks")) == 1
    return runs.select(key, "begin", "end", F.when(first, F.lit(html.escape(replacement, quote=False))).otherwise("").alias("after"))


def applied(pages: DataFrame, changes: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """The pages that changes concern, with their new source as ``updated``."""
    sets = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "after"))).alias("_e"))
    rows = pages.join(sets, key)
    text = F.col(source)
    before = lambda i: F.when(i > 0, F.try_element_at("_e", i)["end"]).otherwise(0)
    part = lambda e, i: F.concat(F.substr(text, before(i).cast("int") + 1, (e["begin"] - before(i)).cast("int")), e["after"])
    rest = F.substr(text, F.element_at("_e", -1)["end"].cast("int") + 1, F.char_length(text))
    return rows.withColumn("updated", F.concat(F.array_join(F.transform("_e", part), ""), rest)).drop("_e")


def replacement_plan(pages: DataFrame, pattern: str, replacement: str, expected: DataFrame | None = None, key: str = "page_id", source: str = "html") -> DataFrame:
    """Of every page with a match: key, matches, faults, fingerprint (SHA-256 of the source), state, updated (null unless all its matches can be replaced and nobody changed it).

    expected: (key, fingerprint) of an earlier plan; pages that have changed since then, or weren't in it, are ``changed``.
    """
    after = html.escape(replacement, quote=False)

    def planned(text: str, gaps: list[int], texts: list[str]) -> list[tuple]:
        found = _scanned(text)
        hits = _found(found, gaps, texts)
        faults = sum(h[-1] is not None for h in hits)
        return [(len(hits), faults, text, None if faults else _changed(text, found, hits, after))] if hits else []

    rows = _by_page(_page_texts(pages, pattern, key, source), planned, key, "matches long, faults long, _source string, updated string")
    rows = rows.withColumn("fingerprint", F.sha2("_source", 256)).drop("_source")
    if expected is not None:
        rows = rows.join(expected.select(key, F.col("fingerprint").alias("_was")), key, "left")
    else:
        rows = rows.withColumn("_was", F.col("fingerprint"))
    state = F.when(~F.coalesce(F.col("_was") == F.col("fingerprint"), F.lit(False)), "changed").when(F.col("faults") > 0, "faulty").otherwise("ready")
    rows = rows.withColumn("state", state)
    return rows.select(key, "matches", "faults", "fingerprint", "state", F.when(F.col("state") == "ready", F.col("updated")).alias("updated"))


def samples(hits: DataFrame, replacement: str, key: str = "page_id", most: int = SAMPLES) -> DataFrame:
    """A preview: the first ``most`` matches of all pages with what would stand there."""
    return hits.select(key, "begin", F.col("match").alias("before"), F.lit(replacement).alias("after")).orderBy(key, "begin").limit(most)
