"""Recovery rounds: ranks against Python, the batch fold against a loop, the streams against the batch, stopped and started again."""

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.functions import confidence as C
from inkspark.operators import recovery
from inkspark.streaming import rounds

KO = re.compile("[\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\uac00-\ud7af\ud7b0-\ud7ff\uffa0-\uffdc]")
CJK = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def brute_rank(src, text, reasons):
    t, s, said = text.strip(), src.strip(), " ".join(reasons).lower()
    bare = lambda x: re.sub(r"[\s\W_]+", "", x)
    like = lambda a, b: SequenceMatcher(None, bare(a), bare(b), autojunk=False).ratio() if bare(a) and bare(b) else 0.0
    left = len(KO.findall(t)) / len(t) if t else 1.0
    suspect = "residue" in said or "too similar" in said
    mass = suspect and (t == s or like(t, src) >= 0.92 or left >= 0.5)
    letters = [c for c in t if unicodedata.category(c)[0] == "L"]
    return (float(t != ""), float("model_chatter" not in said), float(t != s), float(not mass), len([c for c in letters if CJK.match(c)]) / max(1, len(letters)), -left, -like(t, src), -float(len(reasons)))


def test_ranks_equal_python(spark):
    src = "그는 천천히 문을 열었다."
    texts = ["他慢慢打开了门。", "", src, "그는 문을 열었다", "他 opened 문", "```他打开了门```", "?!", "그는 천천히 문을 열었다!"]
    rows = [(i, src, t, r) for i, (t, r) in enumerate((t, r) for t in texts for r in ([], ["Korean residue remains"], ["too similar", "x"], ["model_chatter: y"]))]
    got = {r.i: tuple(r.rank) for r in recovery.ranked(spark.createDataFrame(rows, "i int, src string, text string, reasons array<string>"), "ko", "zh").collect()}
    for i, s, t, r in rows:
        assert got[i] == pytest.approx(brute_rank(s, t, r)), (t, r)


def made(n=400, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((f"s{r.integers(0, 25)}", i, f"t{i}", [float(r.integers(0, 3)), float(r.integers(0, 6))], bool(r.random() < 0.85)))
    return rows


def looped(rows):
    now, taken = {}, set()
    for seg, rnd, text, rank, again in rows:
        if seg not in now or (now[seg][3] and rank > now[seg][2]):
            now[seg] = (rnd, text, rank, again)
            taken.add(rnd)
    return now, taken


def test_batch_fold_equals_a_loop(spark):
    rows = made()
    want, taken = looped(rows)
    d = spark.createDataFrame(rows, "segment_id string, round long, text string, rank array<double>, again boolean")
    got = recovery.recovered(d).collect()
    assert {r.round for r in got if r.taken} == taken
    assert {r.segment_id: (r.round, r.text, r.rank, r.again) for r in got if r.last} == want


def run(spark, source, make, sink, where, tmp):
    q = make(source).writeStream.foreachBatch(lambda df, i: sink.extend(map(tuple, df.collect()))).outputMode(where).option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def test_stream_stops_and_goes_on_like_the_batch(spark, tmp_path):
    rows = made(seed=3)
    schema = "segment_id string, round long, text string, rank array<double>, again boolean"
    folder, sink = tmp_path / "in", []
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for k, part in enumerate((rows[:150], rows[150:160], rows[160:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        run(spark, source(), rounds.kept, sink, "update", tmp_path / "state")  # a new query each time, from the checkpoint
        now = {x[0]: tuple(x[1:]) for x in sink}
        assert now == looped(rows[: (150, 160, 400)[k]])[0]
    assert len(sink) == len({(x[0], x[1]) for x in sink})  # nothing twice


def test_silent_runs_are_cancelled_by_event_time(spark, tmp_path):
    folder, sink = tmp_path / "in", []
    source = lambda: spark.readStream.schema("request_id string, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    for part in ([("a", 0, "running"), ("b", 0, "queued"), ("c", 1, "running"), ("c", 3, "failed")], [("b", 10, "running"), ("d", 22, "done")], [("b", 24, "completed"), ("e", 40, "running")], [("e", 50, "running"), ("f", 59, "done")]):
        d = spark.createDataFrame([(i, at(m), s) for i, m, s in part], "request_id string, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
        d.coalesce(1).write.mode("append").parquet(str(folder))
        run(spark, source(), rounds.ended, sink, "append", tmp_path / "state")
    got = {(x[0], x[1], str(x[2])[14:16], x[3]) for x in sink}
    assert {("c", "failed", "03", "event"), ("d", "done", "22", "event"), ("a", "cancelled", "00", "timer"), ("b", "completed", "24", "event"), ("f", "done", "59", "event")} == got
    assert len(sink) == len(got)


def test_kept_sounds_are_taken_as_often_as_the_source_has_them(spark):
    src = "ㅋㅋ 우ㅋ 헤ㅋㅋ 아ㅋㅋㅋㅋㅋ"
    cases = {"他笑ㅋㅋ了": "他笑了", "他笑ㅋㅋ了ㅋㅋ": "他笑了ㅋㅋ", "他우ㅋ说": "他说", "ㅋㅋ": "ㅋㅋ", "他아ㅋㅋㅋㅋㅋ": "他아ㅋㅋㅋㅋㅋ", "他헤ㅋㅋ了": "他了", "他说": "他说", "他한국ㅋ": "他한국ㅋ"}
    d = spark.createDataFrame([(src, t) for t in cases], "s string, t string")
    assert {r.t: r.x for r in d.select("t", C.without_kept_sounds(F.col("s"), F.col("t")).alias("x")).collect()} == cases
    flags = {r.t: (r.a, r.b) for r in d.select("t", C.residue(F.col("s"), F.col("t"), "ko", "zh").alias("a"), C.residue(F.col("s"), F.col("t"), "ko", "zh", True).alias("b")).collect()}
    assert flags["他우ㅋ说"] == (True, False) and flags["他한국ㅋ"] == (True, True) and flags["他说"] == (False, False)


def test_arabic_letters_are_all_there(spark):
    d = spark.createDataFrame([(c,) for c in "\u06e5\u06e6\u06ee\u06ef"], "c string")
    assert d.where(F.col("c").rlike(f"[{C.ARABIC_LETTERS}]")).count() == 4
