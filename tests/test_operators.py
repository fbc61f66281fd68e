from pyspark.sql import functions as F

from inkspark.operators import chunks, context, duplicates, glossary, limits, quality, rewrite, state
from inkspark.sources import sinks
from inkspark.sources import tables as S


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, seg_idx long, line string")


def test_lines_keep_their_ends(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\n\nc"), (2, "x\n"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.seg_idx): (r.line, r.newline) for r in S.newlines(docs).collect()}
    assert got == {(1, 0): ("a", "\r\n"), (1, 1): ("b", "\n"), (1, 2): ("", "\n"), (1, 3): ("c", ""), (2, 0): ("x", "\n"), (3, 0): ("", ""), (4, 0): ("", "")}
    back = sinks.translated(S.newlines(docs), spark.createDataFrame([(1, 1, "B")], "doc_id long, seg_idx long, dst string"))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "a\r\nB\n\nc", 2: "x\n", 3: "", 4: ""}
    both = sinks.bilingual(S.newlines(docs), spark.createDataFrame([(1, 1, "B")], "doc_id long, seg_idx long, dst string"))
    assert {r.doc_id: r.text for r in both.collect()}[1] == "a\r\nb\nB\n\nc"


def test_decoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("한국어".encode("cp949"))
    (tmp_path / "b.txt").write_bytes("﻿é".encode())
    (tmp_path / "c.txt").write_bytes("x\n".encode("utf-16"))
    got = {r.path[-5:]: (r.encoding, r.text) for r in S.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("cp949", "한국어"), "b.txt": ("utf-8", "é"), "c.txt": ("utf-16", "x\n")}


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# note\na -> b\n\n#->#x\nbroken\n->y\n")
    got = [(r.line_number, r.src, r.dst, r.valid) for r in S.replacement_rules(spark, str(tmp_path / "r.txt")).orderBy("line_number").collect()]
    assert got == [(2, "a", "b", True), (4, "#", "#x", True), (5, None, None, False), (6, "", "y", False)]


def test_matching_agrees_with_a_naive_scan(spark):
    texts = ["The other theory", "THE END", "x", "", "éa the", None, "ΟΔΟΣΑ οδός", "a new  york line", "New York City", "東京都に行く"]
    terms = [("the", False), ("The", True), ("theory", False), ("x", True), ("éa", False), ("zz", False), ("ΟΔΟΣ", True), ("ΟΔΟΣΑ", False), ("New York", True), ("new york", False), ("w y", False), ("京都", False), ("都に", True)]
    want = sorted((i, s) for i, t in enumerate(texts) for s, c in terms if t and (s in t if c else s.lower() in t.lower()))
    rows, known = lines(spark, *texts), spark.createDataFrame(terms, "src string, case_sensitive boolean")
    for hot in (1, 10_000):  # salted grams, and none
        assert sorted((r.seg_idx, r.src) for r in glossary.matched(rows, known, hot=hot).collect()) == want
    first = {r.seg_idx: r.terms for r in glossary.longest_first(glossary.matched(rows, known)).collect()}
    assert first[0] == ["theory", "The", "the"]


def test_masked_frequency(spark):
    rows = lines(spark, "Kim Minsu met Kim", "Minsu", "Kim", "none")
    got = [(r.src, r.frequency, r.references) for r in glossary.masked_frequency(rows, [("Kim", False), ("Kim Minsu", False), ("Minsu", False), ("absent", False)], references=1).collect()]
    assert got == [("Kim", 2, ["Kim Minsu met Kim"]), ("Kim Minsu", 1, ["Kim Minsu met Kim"]), ("Minsu", 1, ["Minsu"])]


def test_votes_and_combination(spark):
    raw = spark.createDataFrame([("Seoul", "首尔", "place"), ("seoul", "漢城", ""), ("Seoul.", "首尔", "place"), ("a / b", "x / y", ""), ("...", "z", ""), ("q", "q", ""), ("skipme", "d", "exclude")], "src string, dst string, info string")
    got = [(r.src, r.dst, r.info, r.votes) for r in glossary.normalized(raw).collect()]
    assert got == [("Seoul", "首尔", "place", 3), ("a", "x", "", 1), ("b", "y", "", 1)]
    records = spark.createDataFrame([("f1", "t", "A", "", 3, ["r1", "r2", "r3"]), ("f2", "t", "A", "", 2, ["r2", "r9"]), ("f3", "t", "B", "", 1, [])], "file string, src string, dst string, info string, frequency long, references array<string>")
    r = glossary.combined(records, 3).first()
    assert (r.dst, r.frequency, r.references) == ("A", 6, ["r1", "r2", "r3"])


def test_references_take_turns(spark):
    def turns(lists, cap):
        """Round by round, a list at a time."""
        chosen, gave = [], True
        while gave and len(chosen) < cap:
            gave = False
            for refs in lists:
                new = [r for r in refs if r not in chosen][:1]
                if len(chosen) < cap and new:
                    chosen += new
                    gave = True
        return chosen

    import random

    r = random.Random(3)
    cases = {f"t{i}": [[r.choice("abcdefgh") for _ in range(r.randrange(6))] for _ in range(r.randrange(1, 9))] for i in range(60)}
    cases["many"] = [["a", "b"]] * 40 + [["b", "c", "d"]] * 40
    rows = [(f"f{k:02d}", src, k % 2 == 5, "A", "", 1, refs) for src, lists in cases.items() for k, refs in enumerate(lists)] + [("f0", "t0", True, "Z", "", 9, ["own"])]
    d = spark.createDataFrame(rows, "file string, src string, regex boolean, dst string, info string, frequency long, references array<string>")
    got = {(x.src, x.regex): x.references for x in glossary.combined(d, 3).collect()}
    assert got.pop(("t0", True)) == ["own"]
    assert got == {(src, False): turns(lists, 3) for src, lists in cases.items()}


def test_chunks_and_context(spark):
    rows = lines(spark, "One.", "two", "Three.", "", "Four.", "Five.")
    got = {r.seg_idx: r.context for r in chunks.context(rows, 2).collect()}
    assert got == {0: [], 1: ["One."], 2: [], 3: ["Three."], 4: ["Three."], 5: ["Three.", "Four."]}
    cost = F.char_length("line")
    assert [r.chunk for r in chunks.by_budget(rows, cost, 7).orderBy("seg_idx").collect()] == [0, 0, 1, 1, 2, 3]
    assert [r.chunk for r in chunks.by_budget(rows, cost, 1).orderBy("seg_idx").collect()] == [0, 1, 2, 3, 4, 5]
    heads = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 1)], "doc_id long, seg_idx long, level int")
    assert [r.parent for r in chunks.parents(heads).orderBy("seg_idx").collect()] == [None, 0, 1, 0, None]


def test_state(spark):
    log = spark.createDataFrame([("s1", 1, "a", None), ("s1", 3, None, "t"), ("s1", 2, "b", "u"), ("s2", 1, "c", None)], "id string, seq long, f string, g string")
    assert {r.id: (r.seq, r.f, r.g) for r in state.latest(log, ["id"], ["seq"]).collect()} == {"s1": (3, None, "t"), "s2": (1, "c", None)}
    assert {r.id: (r.f, r.g, r.events) for r in state.merged_events(log, "id", "seq", ["f", "g"]).collect()} == {"s1": ("b", "t", 3), "s2": ("c", None, 1)}
    decisions = spark.createDataFrame([(1, 1, "edit", "x"), (1, 2, "edit", "y"), (1, 3, "delete", None), (1, 4, "edit", "z"), (2, 1, "keep", None)], "row long, round long, action string, dst string").withColumn("info", F.lit(None).cast("string"))
    got = {r.row: (r.dst, r.deleted, r.changes) for r in state.replayed(decisions, ["row"], ["round"]).collect()}
    assert got == {1: ("y", True, 3), 2: (None, False, 1)}
    names = spark.createDataFrame([("v10",), ("v2",), ("v1",)], "n string")
    assert [r.n for r in names.orderBy(state.natural_key(F.col("n"))).collect()] == ["v1", "v2", "v10"]


def test_rewriting(spark):
    rows = lines(spark, "Cat cat $1", "dog")
    out = rewrite.replaced(rows, "line", [rewrite.Rule("cat", "$x", case_sensitive=False), rewrite.Rule("(d)og", "${1}-og", regex=True), rewrite.Rule("([", regex=True)]).orderBy("seg_idx").collect()
    assert [(r.line_new, r.replacements) for r in out] == [("$x $x $1", [2, 0]), ("d-og", [0, 1])]
    assert rewrite.issues([rewrite.Rule(""), rewrite.Rule("a", "b"), rewrite.Rule("a", "c"), rewrite.Rule("([", "x", regex=True)]) == [(0, "empty_src"), (0, "empty_dst"), (2, "duplicate_src"), (3, "regex_error")]
    found = rewrite.occurrences(lines(spark, "abcabc"), "line", rewrite.Rule("bc"), 1, 1).orderBy("n").collect()
    assert [(r.at, r.match, r.before, r.after) for r in found] == [(1, "bc", "a", "a"), (4, "bc", "a", "")]
    hidden = rewrite.masked(lines(spark, "a {x} b <i>"), "line", [r"\{[^}]*\}", r"<[^>]*>"])
    r = hidden.select("line_masked", "spans", rewrite.restored(F.col("line_masked"), F.col("spans")).alias("back")).first()
    assert (r.line_masked, r.spans, r.back) == ("a ⟦0⟧ b ⟦1⟧", ["{x}", "<i>"], "a {x} b <i>")
    odd = ["own ⟦0⟧ {y}", "{⟦1⟧} {z}", "⟦7⟧", "", None, "plain", "{a\nb}"]
    both = rewrite.masked(lines(spark, *odd), "line", [r"(?s)\{[^}]*\}"]).select("seg_idx", "line_masked", "spans", rewrite.restored(F.col("line_masked"), F.col("spans")).alias("back")).orderBy("seg_idx").collect()
    assert [r.back for r in both] == odd and both[0].line_masked == "⟦0⟧ ⟦1⟧".join(["own ", ""])
    assert both[1].spans == ["{⟦1⟧}", "{z}"]


def test_quality(spark):
    raw = spark.createDataFrame([(1, '```json\n{"0": "a"}\n{"1": "b"},\nnoise\n{"x": "c"}\n{"1": "d"}\n```')], "k long, raw string")
    got = [(r["index"], r.text, r.issue) for r in quality.decoded_lines(raw, "k", "raw").orderBy("pos").collect()]
    assert got[:2] == [(0, "a", None), (1, "b", None)]
    assert [x[2] for x in got[2:]] == ["not a single-key JSON object", "non-numeric index: x", "duplicate index: 1"]
    terms = spark.createDataFrame([(1, '{"src":"s","dst":"d","type":"t"}\n{"src":"","dst":"d"}\nx')], "k long, raw string")
    assert [(r.src, r.info, r.issue) for r in quality.decoded_terms(terms, "k", "raw").orderBy("pos").collect()] == [("s", "t", None), ("", "", "missing or empty 'src'"), ("", "", "not a JSON object")]
    found = quality.lint(lines(spark, "the the end!!!", "a  b")).collect()
    assert sorted((r.kind, r.message) for r in found) == [("punctuation", "!!!"), ("repeated_word", "the the"), ("spacing", "  ")]
    heads = quality.headings(lines(spark, "# One", "text", "## Two")).orderBy("seg_idx").collect()
    assert [(r.level, r.title, float(r.confidence)) for r in heads] == [(1, "One", 0.95), (2, "Two", 0.95)]
    assert quality.difference(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"], "v").orderBy("k").collect() == [("a", "removed", 1, None), ("b", "modified", 2, 3), ("c", "added", None, 4)]


def test_duplicates(spark):
    got = duplicates.similar_neighbours(lines(spark, "The quick brown fox", "zzz", "The quick brown fix", "other")).collect()
    assert [(r.i, r.j) for r in got] == [(0, 2)]


def test_limits(spark):
    rows = spark.createDataFrame([(i, "u", float(t)) for i, t in enumerate((0, 30, 59.999999, 60, 61, 200))], "id long, who string, at double").select("id", "who", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))
    want = [1, 2, 3, 3, 4, 1]
    assert [r.n for r in limits.sliding(rows, 60, ["who"]).orderBy("id").collect()] == want
    assert [r.n for r in limits.sliding_global(rows, 60).orderBy("id").collect()] == want


def test_streams(spark, tmp_path):
    from inkspark.streaming import limiter

    rows = spark.createDataFrame([("p", i, t, 10) for i, t in enumerate((0, 1, 2, 61, 62))], "profile string, request_id long, s long, tokens long").select("profile", "request_id", F.timestamp_seconds("s").alias("ts"), "tokens")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = limiter.admitted(stream, 2, 1_000).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.request_id: (r.admitted, r.waiting_us) for r in spark.sql("select * from admitted").collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 58_000_000), 3: (True, 0), 4: (True, 0)}
    u = limiter.usage(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("used").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).start()
    u.processAllAvailable()
    u.stop()
    assert sorted((r.requests, r.tokens) for r in spark.sql("select * from used").collect()) == [(2, 20), (3, 30)]


def test_books(spark, tmp_path):
    import zipfile

    from inkspark.sources.epub import epub_segments

    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="urn:y"><manifest><item id="a" href="a%20b.xhtml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("O/a b.xhtml", "<html><head><title>no</title></head><body><h1>One</h1><div>two &amp; <b>three</b><p>four<br>five</p></div><ruby>漢<rt>かん</rt></ruby></body></html>")
        z.writestr("O/t.ncx", "<ncx><text> Label </text></ncx>")
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    rows = epub_segments(spark, str(tmp_path)).collect()
    assert [(r.row, r.text) for r in sorted((r for r in rows if r.error is None), key=lambda r: r.row)] == [(0, "One"), (1, "two & three"), (2, "four five"), (3, "漢"), (9_000_000_000, "Label")]
    assert sum(r.error is not None for r in rows) == 1


def test_context_helpers(spark):
    docs = spark.createDataFrame([(1, "aa Cat bb cat cc"), (2, "cat"), (3, "the cat"), (4, "the cat")], "doc_id long, text string")
    terms = spark.createDataFrame([("cat", False)], "src string, case_sensitive boolean")
    got = [(r.n, r.doc_id, r.at, r.excerpt) for r in context.excerpts(docs, terms, around=3).orderBy("n").collect()]
    assert got == [(1, 1, 10, "bb cat cc"), (2, 2, 0, "cat"), (3, 3, 4, "he cat")]
    cut = context.pieces(lines(spark, "One. Two. Three four five six.", "short"), 10).orderBy("seg_idx", "part").collect()
    assert [r.piece for r in cut] == ["One.Two.", "Three four", "five six.", "short"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(context.runaway(F.lit("ok " + "ab" * 80))) == "ab" and one(context.runaway(F.lit("plain text"))) == ""
    assert one(context.is_request_failure(F.lit("[llm.auth] x"))) and not one(context.is_request_failure(F.lit("too short")))
    assert tuple(one(context.error_parts(F.lit("[a.b] went wrong")))) == ("a.b", "went wrong")
    assert tuple(one(context.usage(F.lit('{"prompt_tokens": 7, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 2}}')))) == (7, 3, 2, False)
    assert tuple(one(context.usage(F.lit('{"prompt_cache_hit_tokens": 4, "prompt_cache_miss_tokens": 5, "output_tokens": 1, "estimated": true}')))) == (9, 1, 4, True)
    tasks = spark.createDataFrame([("t1", 1, "failed", ["a", "b"]), ("t2", 2, "completed", ["a", "c"])], "subtask_id string, ord int, status string, segments array<string>")
    assert {r.segment_id: r.subtask_id for r in context.owners(tasks, spark.createDataFrame([("a",), ("c",)], "segment_id string")).collect()} == {"a": "t1", "c": "t2"}


def test_contexts_beside_a_large_group_of_copies(spark):
    docs = spark.createDataFrame([(i, "the cat") for i in range(2_000)] + [(2_000, "a cat"), (2_001, "my cat"), (2_002, "our cat")], "doc_id long, text string")
    terms = spark.createDataFrame([("cat", False)], "src string, case_sensitive boolean")
    got = [(r.n, r.doc_id, r.at, r.excerpt) for r in context.excerpts(docs, terms).orderBy("n").collect()]
    assert got == [(1, 0, 4, "the cat"), (2, 2_000, 2, "a cat"), (3, 2_001, 3, "my cat")]


def test_contexts_after_many_equal_ones(spark):
    line = "x" * 10 + "cat" + "x" * 10
    docs = spark.createDataFrame([(1, line * 3_000 + "a cat."), (2, "my cat")], "doc_id long, text string")
    terms = spark.createDataFrame([("cat", False)], "src string, case_sensitive boolean")
    got = [(r.n, r.doc_id, r.at, r.excerpt) for r in context.excerpts(docs, terms, around=5).orderBy("n").collect()]
    assert got == [(1, 1, 10, "xxxxxcatxxxxx"), (2, 1, 69_002, "xxxa cat."), (3, 2, 3, "my cat")]


def test_recovery(spark):
    from inkspark.operators import recovery as R

    rows = spark.createDataFrame([("s", "a", 1, 0), ("s", "b", 2, 0), ("s", "c", 2, 5)], "id string, text string, x int, y int")
    assert R.best(rows, ["id"], [F.col("x"), F.col("y")]).first().text == "c"
    asked = spark.createDataFrame([("t", 0), ("t", 1), ("u", 0), ("u", 1), ("v", 0), ("v", 1)], "subtask_id string, index int")
    answered = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("u", 7, "c"), ("u", 8, "d"), ("v", 1, "e")], "subtask_id string, index int, text string")
    got = {(r.subtask_id, r["index"]): (r.text, r.policy) for r in R.aligned(asked, answered).collect()}
    assert got == {("t", 0): ("a", "complete"), ("t", 1): ("b", "complete"), ("u", 0): ("c", "positional"), ("u", 1): ("d", "positional"), ("v", 0): (None, "subset"), ("v", 1): ("e", "subset")}
    pairs = spark.createDataFrame([("He went home", "It was cold outside", "他回家了他回家了他回家了他回家了", "他回家了他回家了他回家了他回家了"), ("same", "same", "same text here and now", "same text here and now")], "left_src string, right_src string, left_dst string, right_dst string")
    assert R.duplicate_pairs(pairs).count() == 1
    flags = spark.createDataFrame([("ㅋㅋㅋ",), ("!?!? wow",), ("A normal sentence.",), ("",)], "t string").select(R.is_compact_nonprose(F.col("t"))).collect()
    assert [r[0] for r in flags] == [True, True, False, False]
    text = spark.range(1).select(R.prompt(F.array(F.struct(F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit("n").alias("info"))), F.array(F.lit("x\ny "), F.lit("")), F.array(F.lit('say "hi"')))).first()[0]
    assert text == '[Glossary]\n- a -> b (n)\n\n[Context - read only, do not translate or include in output]\nx y\n\n[Translate]\n```jsonline\n{"0":"say \\"hi\\""}\n```'
    files = spark.createDataFrame([("f1", b"x", 1), ("f2", b"x", 2), ("f3", b"y", 3)], "name string, content binary, ord int")
    assert {r.name: r.kept_as for r in R.first_of_content(files).collect()} == {"f1": "f1", "f2": "f1", "f3": "f3"}
    assert R.located(lines(spark, "see Chapter One", "chapter one"), "Chapter One").first().seg_idx == 1


def _words_and_terms(spark):
    import numpy as np

    r = np.random.default_rng(3)
    parts = ["Ab", "ab", "abc", "Gate of", "gate", "x\ty", "é", "한국어 글", "국어", "q", " lead", "none here", "Straße", ""]
    rows = spark.createDataFrame([(i // 9, i % 9, "".join(r.choice([*parts, " ", "\t", " "], size=int(r.integers(0, 14))))) for i in range(400)] + [(99, 0, None)], "doc_id long, seg_idx long, line string")
    terms = spark.createDataFrame([(p, c, f"{p}!") for p in [*parts, "of gate", "c a", None] for c in (True, False, None)] + [("gate", True, "gate!")], "src string, case_sensitive boolean, dst string")
    return rows, terms


def test_sent_terms_equal_those_met_by_a_join(spark):
    rows, terms = _words_and_terms(spark)
    got, want = (sorted(map(str, f(rows, terms).collect())) for f in (glossary.matched, glossary.joined))
    assert got == want and len(got) > 500


def test_matching_shuffles_no_lines(spark):
    rows, terms = _words_and_terms(spark)
    assert "Exchange" not in glossary.matched(rows, terms)._jdf.queryExecution().toString()


def test_excerpts_shuffle_no_texts(spark):
    rows, terms = _words_and_terms(spark)
    docs = rows.select(F.expr("doc_id * 10 + seg_idx").alias("doc_id"), F.col("line").alias("text"))
    plan = context.excerpts(docs, terms.where("src is not null and src <> ''").select("src").distinct())
    assert "Join" not in plan._jdf.queryExecution().toString() and plan.count() > 10


def test_common_words_count_documents(spark, monkeypatch):
    texts = [(1, "Example, words example"), (1, "“other” example!"), (2, "EXAMPLE\tother-example short"), (3, "«other» examples (example)"), (None, "example"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for sent in (glossary.SENT, 1):
        monkeypatch.setattr(glossary, "SENT", sent)
        assert sorted(r.src for r in glossary.common_words(docs, 5, 2).collect()) == ["example"]
