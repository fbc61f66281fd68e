"""Prompts under a budget, broken answers, visible text with its places: the known cases and brute force."""

import html
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.functions import text as X
from inkspark.operators import answers, chunks, markup, prompts


def frame(spark, texts, name="t"):
    return spark.createDataFrame(list(enumerate(texts)), f"k int, {name} string")


# prompts


def brute_prompts(lines, terms, size, budget, context_lines, line_budget=None):
    """Chunks of (first, lines, terms, context, prompt), each cut as far as a message still fits."""

    def message(rows, context):
        found = []
        for row in rows:
            found += [t for t in sorted(terms, key=lambda t: t[0]) if t[0].lower() in row.lower() and t not in found]
        found.sort(key=lambda t: -len(t[0]))
        parts = ["[Glossary]\n" + "\n".join(f"- {s} -> {d}" + (f" ({i})" if i else "") for s, d, i in found)] if found else []
        parts += ["[Context - read only, do not translate or include in output]\n" + "\n".join(context)] if context else []
        body = "\n".join(json.dumps({str(k): row}, ensure_ascii=False) for k, row in enumerate(rows))
        return "\n\n".join([*parts, "[Translate]\n```jsonline\n" + body + "\n```"]), len(found)

    cost = lambda text: max(1, int(len(text) / 3.5)) if text else 0
    out, at = [], 0
    while at < len(lines):
        end = at + 1
        while end < min(at + size, len(lines)) and cost(message(lines[at : end + 1], [])[0]) <= budget and (line_budget is None or sum(map(cost, lines[at : end + 1])) <= line_budget):
            end += 1
        context = []
        for line in reversed(lines[:at]):
            if line.strip() and len(context) < context_lines:
                if line.strip()[-1] not in X.CONTEXT_END:
                    break
                context.insert(0, line.rstrip())
        while context and cost(message(lines[at:end], context)[0]) > budget:
            context = context[1:]
        text, n = message(lines[at:end], context)
        out.append((at, end - at, n, len(context), text))
        at = end
    return out


def packed(spark, lines, terms, *args, **more):
    rows = spark.createDataFrame([(1, i, x, "x") for i, x in enumerate(lines)], "doc_id int, seg_idx long, line string, chunk string")
    held = [(1, i, s, d, info) for i, x in enumerate(lines) for s, d, info in terms if s.lower() in x.lower()]
    got = prompts.packed(rows, spark.createDataFrame(held, "doc_id int, seg_idx long, src string, dst string, info string"), *args, **more).orderBy("chunk").collect()
    assert [r.chunk for r in got] == list(range(len(got)))
    return [(r.first, r.lines, r.terms, r.context, r.prompt) for r in got]


@pytest.mark.parametrize(("size", "budget", "context", "line_budget"), [(3, 10_000, 2, None), (50, 60, 3, None), (12, 90, 2, 20), (5, 1, 4, None), (1, 45, 10, None)])
def test_prompts_equal_brute_force(spark, size, budget, context, line_budget):
    r = np.random.default_rng(size)
    words = ["Haebum", "black dragon", "gate.", "the", "old", "went\tout", 'said "no"', "", "ending.", "é"]
    lines = [" ".join(r.choice(words, size=int(r.integers(0, 9)))).strip() for _ in range(60)]
    terms = [("Haebum", "海范", ""), ("black dragon", "黑龙", "name"), ("dragon", "龙", ""), ("gate", "门", "place")]
    assert packed(spark, lines, terms, size, budget, context, line_budget) == brute_prompts(lines, terms, size, budget, context, line_budget)


def test_prompt_context_rules(spark):
    chain = ["Earlier earlier sentence.", "Section header without punctuation", "Sentence right before chunk.", "First chunk line."]
    assert [r[3] for r in packed(spark, chain, [], 1, 1000, 10)] == [0, 1, 0, 1]
    blank = packed(spark, ["First sentence.", "", "Second sentence.", "Chunk start line."], [], 1, 1000, 10)[3]
    assert "First sentence.\nSecond sentence.\n\n[Translate]" in blank[4]
    cjk = packed(spark, ["上一段。", "中段……", "「他说道」", "本块第一行。"], [], 1, 1000, 5)[3]
    assert cjk[3] == 3
    oversized = packed(spark, ["Haebum entered a very long passage", "x"], [("Haebum", "海范", "")], 10, 1, 2)
    assert [r[:4] for r in oversized] == [(0, 1, 1, 0), (1, 1, 0, 0)]


def test_chunk_cuts_equal_a_loop(spark):
    r = np.random.default_rng(0)
    costs = {d: [int(x) for x in r.choice([0, 1, 2, 3, 9, 40], size=n)] for d, n in ((1, 200), (2, 1), (3, 33))}
    rows = spark.createDataFrame([(d, i, c) for d, cs in costs.items() for i, c in enumerate(cs)], "doc_id int, seg_idx int, c int")
    for budget, most, join in ((10, 1_000, 0), (10, 4, 0), (25, 1_000, 2), (0, 3, 1)):
        want = {}
        for d, cs in costs.items():
            chunk, used, n = -1, 0, 0
            for i, c in enumerate(cs):
                if n and used + c + join <= budget and n < most:
                    used, n = used + c + join, n + 1
                else:
                    chunk, used, n = chunk + 1, c, 1
                want[d, i] = chunk
        got = {(x.doc_id, x.seg_idx): x.chunk for x in chunks.by_budget(rows, F.col("c"), budget, most, join_cost=join).collect()}
        assert got == want


# answers


def test_decisions_in_any_shape(spark):
    texts = [
        '[{"row_index":1,"action":"MODIFY","dst":"a{b"},{"row_index":2}]', '```json\n{"decisions":[{"row_index":"3","reason":"x\\"}"},5,{"row_index":0}]}\n```',
        'pre {x} {"row_index":4} mid } {"a":{"row_index":5,"action":"zap"}} {"row_index":6,', '{"row_index":7,"n":{"row_index":8}}{"row_index":9}', "no", '{\n "row_index": 10,\n "reason": "see {x"\n}', None, "", "}}{{",
    ]
    got = answers.decisions(frame(spark, texts), "k", "t").orderBy("k", "begin", "n").collect()
    assert [(r.k, r.row_index, r.action, r.suggested_dst, r.reason) for r in got] == [
        (0, 1, "modify", "a{b", ""), (0, 2, "keep", "", ""), (1, 3, "keep", "", 'x"}'), (2, 4, "keep", "", ""), (2, 5, "keep", "", ""), (3, 7, "keep", "", ""), (3, 9, "keep", "", ""), (5, 10, "keep", "", "see {x"),
    ]


def test_objects_equal_a_scanner(spark):
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list('{}[]a",:\\ \n'), size=40)) for _ in range(60)]
    want = []
    for k, text in enumerate(texts):
        stack, i = [], 0
        while i < len(text):
            if text[i] == '"':
                j = i + 1
                while j < len(text) and text[j] not in '"\n':
                    j += 2 if text[j] == "\\" and j + 1 < len(text) and text[j + 1] != "\n" else 1
                    if text[j - 1] == "\\" and (j >= len(text) or text[j] == "\n"):
                        j = len(text)
                i = j + 1 if j < len(text) and text[j] == '"' else i + 1
                continue
            if text[i] == "{":
                stack.append(i)
            elif text[i] == "}" and stack:
                want.append((k, stack.pop(), i + 1))
            elif text[i] == "}":
                stack = []
            i += 1
    got = [(x.k, x.begin, x.end) for x in answers.objects(frame(spark, texts), "k", "t").collect()]
    assert sorted(got) == sorted(want)


def test_partial_rows_take_nothing_by_place(spark):
    texts = [
        '{"0":"a"}\n{"1":"b"}\n{"1":"c"}\n{"2":"d', '{"0":"a","1":"b","2":"c"}}', '{"0":"a","1":5,"2":"c"}', '{"0":"a","1":"b"}', '```json\n{"0":"a",\n"1":"b","2":" "}\n```', '```json\n{"0":"a",\n"1":"b","2":"x"}\n```',
        '{"0":"a","0":"b","1":"b","2":"x"}', '{"0":"a","1":"b","2":"c"} and more', '{"7":"a"}\n{"x":"b"}\n{"1":" "}\n{" 2 ":"z"}', None, "[]",
    ]
    asked = spark.createDataFrame([(k, i) for k in range(len(texts)) for i in range(3)], "k int, index long")
    got = sorted((r.k, r["index"], r.text, r.shape) for r in answers.partial_rows(frame(spark, texts), asked, "k", "t").collect())
    assert got == [(0, 0, "a", "line"), *[(1, i, x, "object") for i, x in enumerate("abc")], *[(5, i, x, "object") for i, x in enumerate("abx")], (8, 2, "z", "line")]
    cut = frame(spark, ['{"0":"a"}\n{"1":"b', '{"0":"a"},\n```\n', "", "text"])
    assert [r.x for r in cut.select("k", answers.is_truncated(F.col("t")).alias("x")).orderBy("k").collect()] == [True, False, False, True]


def test_comparisons(spark):
    long = json.dumps({"decisions": {"a": {"decision": "accept_new", "reason": "r" * 600}, "b": {"decision": "maybe"}, "d": {"decision": " uncertain "}}})
    asked = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (0, "d"), (1, "a"), (2, "a")], "k int, item_id string")
    got = {(r.k, r.item_id): (r.decision, r.reason and len(r.reason), r.issue) for r in answers.comparisons(frame(spark, [f"```JSON\n{long}\n```", "nothing", '{"x": 1}']), asked, "k", "t").collect()}
    assert got == {(0, "a"): ("accept_new", 500, None), (0, "b"): (None, None, "unknown decision"), (0, "c"): (None, None, "item is missing"), (0, "d"): ("uncertain", 18, None), (1, "a"): (None, None, "no JSON object"), (2, "a"): (None, None, "no decisions")}


def test_table_terms(spark):
    tables = [
        "|原文|译名|备注|\n|---|---|---|\n|**a**|b|`c`|\n|x||y|\n\n|x|y|", "| # | Kind | Target | SRC |\n|--|--|--|--|\n| 1. | place | <b>t</b> | s |\n| place | u | v |", "|a|b|\n|src|src|\n|c|d|", None,
    ]
    got = [(r.k, r.src, r.dst, r.info) for r in answers.table_terms(frame(spark, tables), "k", "t").orderBy("k", "pos").collect()]
    assert got == [(0, "a", "b", "c")]
    shifted = frame(spark, ["| Kind | Target | SRC |\n|--|--|--|\n| 1. | place | t | s |\n| person | u | v |"])
    assert [(r.src, r.dst, r.info) for r in answers.table_terms(shifted, "k", "t").orderBy("pos").collect()] == [("s", "t", "place"), ("v", "u", "person")]


def test_salvaged_rows(spark):
    texts = ['{\n"0":"a",\n"1":"b",\n"x":"c"}', '["p","q",3]', '{"translations":{"2":"z"}}', '{"a": {"b": ["w"]}}', '{"0": "a"', '{"k":"v"}', "", None]
    got = [(r.k, r["index"], r.text) for r in answers.salvaged_rows(frame(spark, texts), "k", "t").orderBy("k", "index").collect()]
    assert got == [(0, 0, "a"), (0, 1, "b"), (1, 0, "p"), (1, 1, "q"), (2, 2, "z"), (3, 0, "w")]


# pages

PAGES = [
    '<html><head><title>no</title></head><body> <p>Hello  <b>wor</b>ld &amp; <i>more</i></p>\n<p>Next&nbsp; line</p><script>var x="</p>";</script>end</body>', "a &#65;&#x42; &bogus; <br/>b<!-- c -->d 1 < 2 & 3", None, "",
    '<p title="a>b">x</p>y', "&fjlig;x &#128;&#0;&#xD800;", "</head>seen<noscript>not<template>nor</template></noscript> <x:p>q</x:p>", "<p>  </p><p> </p>z",
]


def pages(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(PAGES)], "page_id int, html string, value string")


def test_visible_text_of_pages(spark):
    got = {r.page_id: r.text for r in markup.visible(markup.pieces(pages(spark))).collect()}
    assert got == {0: "Hello world & more\nNext\xa0line\nend", 1: "a AB &bogus; \nbd 1 < 2 & 3", 4: "x\ny", 5: "fjx €��", 6: "seen \nq\n", 7: "z"}


def test_source_slices_decode_to_matches(spark):
    found = markup.pieces(pages(spark))
    hits = markup.matches(found, r"world|\w+ & more|Next.|AB|&bogus|x\ny|j|d 1|€|line|b.?d").collect()
    assert len(hits) >= 9
    for r in hits:
        if not r.fault:
            plain = markup.html.unescape(__import__("re").sub(r"(?s)<!--.*?-->|<[A-Za-z/][^>]*>", "", PAGES[r.page_id][r.begin : r.end]))
            assert " ".join(plain.split()) == " ".join(r.match.split())
    assert {r.match: r.fault for r in hits if r.fault} == {"x\ny": "crosses a line end", "j": "splits an entity", "&bogus": "splits an entity"}


def test_replacements_leave_markup_alone(spark):
    plan = {r.page_id: r for r in markup.replacement_plan(pages(spark), "world|AB|x\ny", "<Z>").collect()}
    z = html.escape("<Z>")
    assert plan[0].updated == PAGES[0].replace("wor", z).replace("</b>ld", "</b>") and plan[1].updated == PAGES[1].replace("&#65;&#x42;", z)
    assert (plan[4].state, plan[4].updated, plan[4].matches, plan[4].faults) == ("faulty", None, 1, 1)
    old = spark.createDataFrame([(0, plan[0].fingerprint), (1, "stale")], "page_id int, fingerprint string")
    assert {r.page_id: r.state for r in markup.replacement_plan(pages(spark), "world|AB", "q", old).collect()} == {0: "ready", 1: "changed"}
    assert [(r.page_id, r.before) for r in markup.samples(markup.matches(markup.pieces(pages(spark)), "[a-e]"), "q", most=3).collect()] == [(0, "e"), (0, "d"), (0, "e")]


# drift


def brute_partners(items):
    from difflib import SequenceMatcher
    import re

    def like(a, b):
        a, b = (re.sub(r"[\W_]+", "", x) for x in (a, b))
        return SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0

    out = set()
    for g, o, src, dst, new in items:
        if new is None or len(src) < 120 or len(new) < 80 or len(dst) < 80:
            continue
        own = like(new, dst)
        for g2, o2, src2, dst2, _ in sorted(x for x in items if x[0] == g and x[1] != o):
            if len(dst2) >= 80 and like(new, dst2) >= 0.45 and like(new, dst2) - own >= 0.25 and like(src, src2) < 0.70:
                out.add((g, o, o2))
                break
    return out


def test_drift_partners_equal_all_pairs(spark):
    from inkspark.operators import drift

    r = np.random.default_rng(11)
    text = lambda n: " ".join("".join(r.choice(list("abcdeéfg"), size=int(r.integers(2, 8)))) for _ in range(n))
    items = []
    for g in range(3):
        dsts = [text(int(r.integers(12, 30))) for _ in range(25)]
        srcs = [text(int(r.integers(20, 40))) for _ in range(25)]
        srcs[7] = srcs[8]  # alike sources aren't drift
        for o in range(25):
            new = {0: dsts[(o + 1) % 25], 1: dsts[o], 2: None, 3: dsts[(o + 5) % 25][: len(dsts[(o + 5) % 25]) // 2] + dsts[o][:40], 4: text(20)}[int(r.integers(0, 5))]
            items.append((g, o, srcs[o], dsts[o], new))
    items += [(4, 0, "s" * 130, "d" * 90, ""), (4, 1, "", "", None), (5, 0, "x, " * 50, "y. " * 40, ". " * 50)]
    want = brute_partners(items)
    assert len(want) > 8
    d = spark.createDataFrame(items, "group long, ord long, src string, dst string, candidate string")
    for block in (512, 6):
        assert {tuple(x) for x in drift.partners(d, block=block).collect()} == want


# headings and volumes


def test_heading_presets(spark):
    from inkspark.operators import quality

    texts = ["#### d", "# A  b ：", "第十二章 门", "正文卷 第3回 x", "제 3 화 문", "프롤로그", "第三巻", "Chapter 12 - Door", "1.2 x", "３．門", "12", "plain", "番外 二 y", "CHAPTER", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, line string")
    got = lambda *a, **k: {r.i: (r.level, r.title) for r in quality.headings(rows, *a, **k).collect()}
    assert got() == {0: (4, "d"), 1: (1, "A b")} == got("unknown")
    assert got("zh_novel") == {2: (2, "第十二章 门"), 3: (2, "正文卷 第3回 x"), 8: (2, "1.2 x"), 10: (2, "12"), 12: (2, "番外 二 y")}
    assert got("ko_novel")[4] == (2, "제 3 화 문") and got("ko_novel")[5] == (1, "프롤로그") and got("ja_novel")[6] == (1, "第三巻") and got("en_chapter")[7] == (2, "Chapter 12 - Door")
    assert got(custom=[(3, ""), (2, r"^(x)?(pl)ain")]) == {11: (2, "pl")}
    assert got(advanced=r"^Chapter (?P<title>\d+)", custom=[(2, "plain")]) == {7: (1, "12")}
    folded = {r.i: r.confidence for r in quality.headings(rows, advanced="CHAPTER|^３").collect()}
    assert folded == {7: 0.95, 9: 0.72, 13: 0.95}


def test_volumes_before_side_stories(spark):
    from inkspark.operators import state

    names = ["[플로나] 모두가 1권.epub", "[플로나] 모두가 2권.epub", "[플로나] 모두가 10권.epub", "[플로나] 모두가 외전 1.epub", "[플로나] 모두가 외전 2.epub", "다른 vol 1.epub", "다른.epub", "다른 Side Story.epub"]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    got = [r.name for r in rows.orderBy(*state.volume_order(F.col("name"))).collect()]
    assert got.index("[플로나] 모두가 10권.epub") == got.index("[플로나] 모두가 2권.epub") + 1
    assert [n for n in got if "플로나" in n] == names[:5]
    keys = {r.name: tuple(r.k) for r in rows.select("name", state.volume_key(F.col("name")).alias("k")).collect()}
    assert keys["다른 vol 1.epub"][1:] == (False, 1) and keys["다른 Side Story.epub"][1:] == (True, 999_999) and keys["[플로나] 모두가 외전 2.epub"][1:] == (True, 2)


def test_long_pages_are_searched_once(spark):
    """What follows the last match is read once, not from each of its places."""
    import time

    page = "<p>a world</p><p>" + "no word here " * 15_000 + "</p>"
    df = spark.createDataFrame([(1, page), (2, page.replace("world", "word")), (3, None)], "page_id int, html string")
    started = time.monotonic()
    assert [(r.page_id, r.n, r.begin, r.end, r.source) for r in markup.page_matches(df, r"worl[d]").collect()] == [(1, 0, 5, 10, "world")]
    plan = markup.replacement_plan(df, r"worl[d]", "Z").collect()
    assert [(r.page_id, r.matches, r.state, r.updated) for r in plan] == [(1, 1, "ready", page.replace("world", "Z"))]
    assert time.monotonic() - started < 60


def test_page_matches_are_those_of_the_pieces(spark):
    pattern = r"world|\w+ & more|Next.|AB|&bogus|x\ny|j|d 1|€|line|b.?d"
    want = {tuple(r) for r in markup.matches(markup.pieces(pages(spark)), pattern).collect()}
    got = {tuple(r)[:-1]: r.source for r in markup.page_matches(pages(spark), pattern).collect()}
    assert set(got) == want and len(want) > 5
    assert all(source == PAGES[r[0]][r[5] : r[6]] for r, source in got.items())
