"""Spelling variants, exact top-k search and phrase mining against brute force and on odd rows."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkspark.llm import phrases, registry, runs, spelling, topk
from inkspark.llm.common import written
from tests.oracle import SF, same


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# spelling variants


def brute_words(docs, noise, seen=3):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= seen}


def brute_forms(n):
    near, masks = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            masks[w[:k], w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def test_spelling_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op11_spelling_variants"](spark, SF).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == brute_forms(brute_words(docs, 97))


@pytest.mark.parametrize("sizes", [{}, {"leaf": 20, "tile": 8, "queries": 16, "sample": 400}])
def test_spelling_made_words(spark, sizes):
    """Few letters, so that boxes are crowded; anagrams in numbers; lengths that no sampled word has; tiles of a few words."""
    r = np.random.default_rng(5)
    words = {"".join(r.choice(list("abcéÉ"), size=k)) for k in r.integers(5, 9, size=700)} | {"".join(r.permutation(list("abcdefgh"))) for _ in range(150)} | {"z" * 300, "z" * 301, "y" + "z" * 299, "z" * 70_000}
    n = {w: int(x) for w, x in zip(sorted(words), r.integers(3, 60, size=len(words)), strict=True)}
    docs = spark.createDataFrame([(k, " ".join([w] * c), None, 1) for k, (w, c) in enumerate(n.items())], "doc_id long, text string, word string, n int")
    got = spelling.grouped(docs, **sizes).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == brute_forms(n)


def test_spelling_odd_rows(spark):
    rows = [(None, "Straße straße STRAßE"), (None, "straße"), (1, None), (2, ""), (3, "12 -- ,"), (4, "strase"), (5, "strase strase strase"), (5, "strase"), (6, "nave náve NÁVEN náven naven naven náven"), (7, "naïve" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: tuple(r)[1:] for r in spelling.grouped(docs, noise=97).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert sorted((w, *x) for w, x in got.items()) == brute_forms(brute_words(rows, 97))
    assert spelling.grouped(docs.limit(0)).count() == 0


def test_crc_equals_zlib():
    r = np.random.default_rng(1)
    raw = r.integers(0, 256, 20_000).astype(np.uint8)
    cuts = np.sort(r.choice(20_000, 400, replace=False))
    start, stop = cuts[:-1], cuts[1:]
    before = r.integers(0, 1 << 32, len(start), dtype=np.uint32)
    want = [zlib.crc32(raw[a:b].tobytes(), int(c)) for a, b, c in zip(start, stop, before, strict=True)]
    assert (spelling.crcs(raw, start, stop, before) == np.array(want, np.uint32)).all()


def test_range_search_visits_every_near_leaf():
    r = np.random.default_rng(2)
    words = sorted({"".join(r.choice(list("abcde"), size=7)) for _ in range(2_000)})
    counts = spelling.letter_counts(spelling.codes(words, 7))
    tree = spelling.Tree.fit(counts, 30)
    home = np.zeros(len(words), int)
    for leaf, at in tree.search(counts, False, False):
        home[at] = leaf
    visits = {(int(w), leaf) for leaf, at in tree.search(counts, True, True) for w in at}
    apart = counts[:, None, :] - counts[None]
    near = (np.maximum(apart, 0).sum(2) <= 1) & (np.maximum(-apart, 0).sum(2) <= 1)
    assert all((i, home[j]) in visits for i, j in zip(*np.nonzero(near), strict=True))
    assert len(visits) < 0.8 * len(words) * (home.max() + 1)


# exact top-k


def brute_products(rows, every=50, k=5):
    fine = [(i, np.floor(np.array(x, float) * 256)) for i, x in rows if x is not None and all(v is not None and np.isfinite(float(v) * 256) for v in x)]
    out = []
    for a, (i, x) in enumerate(fine):
        if i is None or i % every:
            continue
        scores = [(-max(-(2**63), min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(x, y, strict=True)))), j is None, j or 0) for b, (j, y) in enumerate(fine) if b != a and len(y) == len(x)]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_topk_query_equals_sql(spark):
    same(spark, topk.query, topk.ORACLE)


def test_topk_prunes_and_stays_exact(spark, monkeypatch):
    r = np.random.default_rng(7)
    centres = r.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] + 0.05 * r.normal(size=12)).tolist()) for i in range(1_500)]
    rows += [(2_000 + i, rows[0][1]) for i in range(300)]  # a hot vector: its scores tie
    kept = []
    plain = topk.surviving

    def counting(tree, nodes):
        pairs = plain(tree, nodes)
        kept.append(len(pairs) / sum(nodes[k].queries > 0 for k in tree.leaves if k in nodes) / sum(k in nodes for k in tree.leaves))
        return pairs

    monkeypatch.setattr(topk, "surviving", counting)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.nearest_by_product(d, leaves=40, cells=12 * 200, sample=800).collect()
    assert sorted(map(tuple, got), key=str) == brute_products(rows)
    assert kept[0] < 0.5


def test_topk_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.25]), (50, None), (100, [nan, 1.0]), (150, [1.0, None]), (200, [inf, 0.0]), (250, []), (300, []), (350, [1.0, 2.0, 3.0]), (None, [0.5, -0.25]), (400, [0.5, -0.25]), (400, [0.5, -0.25]), (450, [1e300, 1.0]), (-50, [1e300, -1.0]), (7, [1e308, 1.0]), (8, [-0.001, 0.001]), (9, [1e9, 123456.789]), (550, [1e300, 1e300]), (600, [1e300, -1e300]), (11, [1e17, 3.0]), (650, [1e17, 1.0]), (500, [0.0, 0.0])]
    d = spark.createDataFrame([(i, x, 3) for i, x in rows], "vec_id long, embedding array<double>, score int")
    for sizes in ({}, {"leaves": 3, "cells": 4, "sample": 5}):
        assert sorted(map(tuple, topk.nearest_by_product(d, **sizes).collect()), key=str) == brute_products(rows)
    assert topk.nearest_by_product(d.limit(0)).count() == 0


def test_bound_holds():
    r = np.random.default_rng(3)
    q, x = r.normal(size=(200, 5)) + 2, r.normal(size=(300, 5)) * 3 - 1
    cq, cx = q.mean(0), x.mean(0)
    assert (q @ x.T).max() <= topk.bound(cq, np.linalg.norm(q - cq, axis=1).max(), cx, np.linalg.norm(x - cx, axis=1).max())


def test_cover_tree_nets():
    x = np.random.default_rng(4).normal(size=(500, 3))
    tree = topk.CoverTree.fit(x, 60)
    assert len(tree.leaves) == 60
    assert all(tree.parents[c] == k for k, below in enumerate(tree.children) for c in below)
    assert {tree.path(k)[-1] for k in tree.leaves} == {0}
    assert len(topk.CoverTree.fit(np.ones((5, 3)), 60).leaves) == 1


# phrases


def brute_phrases(rows, least, cover=80, top=2000):
    words, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    many = {p: n for p, n in f.items() if n >= least and len(p) > 2}
    around = Counter()
    for (lang, *w), n in many.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[(lang, *w[i : i + m])] = max(n, around[(lang, *w[i : i + m])])
    by = defaultdict(list)
    for (lang, *w), a in many.items():
        if 100 * around[(lang, *w)] >= cover * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        by[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, words[lang], -s) for lang, x in by.items() for rank, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def mined(d, **sizes):
    return sorted(tuple(r) for r in phrases.mined(d, **sizes).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_equal_sql(spark):
    same(spark, phrases.query, phrases.ORACLE)


@pytest.fixture(scope="module")
def made_phrases():
    r = np.random.default_rng(6)
    rows = [("en", " ".join(r.choice(["the", "The", "red", "fox", "of", "né", "É\t", "x."], size=60))) for _ in range(60)]
    rows += [(None, "new york city, New  York\tCity\nnew york"), ("und", "new york city"), ("de", None), ("de", ""), ("fr", " . ;!? "), ("es", "uno"), ("en", rows[0][1]), ("en", "no\x0bbreak\x85here and there " * 40), ("", "a b a b a b")]
    return rows


def test_phrases_of_made_texts(spark, made_phrases):
    d = spark.createDataFrame([(l, t, "x", 1) for l, t in made_phrases], "lang string, text string, phrase string, n int").repartition(5)
    for least in (1, 3, 30):
        assert mined(d, least=least) == brute_phrases(made_phrases, least)
    assert mined(d, least=1, top=7) == brute_phrases(made_phrases, 1, top=7)
    assert mined(d.limit(0)) == []


def test_phrases_with_a_sieve_that_is_full(spark, made_phrases):
    """A filter far too small lets nearly everything through and changes nothing."""
    d = spark.createDataFrame(made_phrases, "lang string, text string")
    assert mined(d, least=3, log_bits=8, block_bytes=64) == brute_phrases(made_phrases, 3)


def test_colliding_fingerprints_stay_apart(made_phrases):
    """Occurrences that share a fingerprint but not their words are phrases of their own."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["a b c a b", "a b b c"])], ["lang", "text"])
    w = phrases.Words(batch)
    at = np.flatnonzero(w.after[1])
    length = w.stop - w.start
    ids = runs.strings(runs.gathered(w.raw, w.start, length), length).dictionary_encode().indices.to_numpy()
    got = Counter()
    for pointer, c in phrases.distinct_phrases(w, 2, at, np.zeros(len(at), np.uint64), ids):
        for p, n in zip(pointer, c, strict=True):
            got[tuple(ids[p : p + 2])] += int(n)
    assert got == Counter(tuple(ids[p : p + 2]) for p in at)


def test_polynomials_that_collide_are_told_apart(spark):
    """Thue-Morse words collide under any polynomial modulo 2**64; their phrases must not be counted together."""
    bits = "a"
    while len(bits) < 4096:
        bits += bits.translate(str.maketrans("ab", "ba"))
    one, two = bits, bits.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((one + two).encode(), np.uint8)
    h = runs.word_hashes(raw, np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] == h[1]
    rows = [("en", f"see {one} now")] * 4 + [("en", f"see {two} now")] * 3
    assert mined(spark.createDataFrame(rows, "lang string, text string"), least=3) == brute_phrases(rows, 3)


def test_phrase_passes_hold_few_bytes(spark, made_phrases, monkeypatch):
    """A batch of 2 MB is parsed in under 20 MB; texts come a thousand at once, and the session's own number is as before."""
    text = pa.array(["mot " * 500] * 1_000)
    batch = pa.RecordBatch.from_arrays([pa.array(["fr"] * 1_000), text], ["lang", "text"])
    list(phrases.passing(next(phrases.parsed([batch])), 4, []))  # the powers are made once
    tracemalloc.start()
    for w in phrases.parsed([batch]):
        list(phrases.passing(w, 4, []))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(phrases, "written", lambda df, n: seen.append(spark.conf.get(name)) or written(df, n))
    phrases.frequent(spark.createDataFrame(made_phrases, "lang string, text string"))
    assert seen == ["1000"] and spark.conf.get(name) == before


def test_blocks_round_trip():
    r = np.random.default_rng(8)
    keys = np.unique(r.integers(0, 1 << 36, 5_000).astype(np.uint64))
    n = r.integers(1, 99, len(keys))
    table = pa.Table.from_batches([runs.in_blocks(keys, n, 30)])
    out = [runs.of_blocks(table.slice(k, 1), 30) for k in range(len(table))]
    assert (np.concatenate([k for k, _ in out]) == keys).all()
    assert (np.concatenate([c for _, c in out]) == np.minimum(n, 30)).all()


def test_sieve_keeps_every_key(spark):
    r = np.random.default_rng(9)
    keys = r.integers(0, 1 << 63, 3_000)
    sieve = runs.Sieve.of(written(spark.createDataFrame([(int(k),) for k in keys], "k long"), "keys"), "k", 16)
    assert sieve.holds(keys.astype(np.uint64)).all()
    assert sieve.holds(r.integers(0, 1 << 63, 3_000).astype(np.uint64)).mean() < 0.05
