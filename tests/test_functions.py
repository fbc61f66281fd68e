from pyspark.sql import functions as F

from inkspark.functions import confidence as C
from inkspark.functions import text as X


def column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(make(F.col("t"))).collect()]


def test_skippable_lines(spark):
    skipped = ["", "   ", "1234", "———", "...", "(1)", "ISBN | 979-11-01-87478-2", "010-xxxx-xxxx", "www.example.com", "@example_account", "　", None]
    assert column(spark, skipped, X.is_skippable) == [True] * len(skipped)
    kept = ["a", "장", "第1章", "see www.example.com now", "ISBN hello", "010-1234-5678 x"]
    assert column(spark, kept, X.is_skippable) == [False] * len(kept)


def test_scripts(spark):
    assert column(spark, ["안녕", "hello", "你好", "", None], lambda c: X.has_script(c, "ko")) == [True, False, False, False, False]
    assert column(spark, ["안녕", "你好", "123", "hello"], lambda c: X.needs_translation(c, "ko", "zh")) == [True, False, False, True]
    assert column(spark, ["hola", "12"], lambda c: X.needs_translation(c, "es", "en")) == [True, False]


def test_clean_up(spark):
    assert column(spark, [" 　a b\t", None], X.stripped) == ["a b", ""]
    assert column(spark, ["“「Name」”".replace("“", '"').replace("”", '"'), "(x)", "..."], X.bare_term) == ["Name", "x", ""]
    assert column(spark, ["…!? 12", "a1", ""], X.is_noise_term) == [True, False, True]
    assert column(spark, ["[ruby text='かな']漢字[/ruby]です", "漢字(かんじ)です"], X.without_readings) == ["漢字です", "漢字です"]
    assert column(spark, ["https://u:p@h/x?key=abc&y=1"], X.redacted_url) == ["https://***@h/x?key=***&y=1"]
    assert column(spark, ["a/b:c?  d.", ""], X.safe_file_name) == ["a_b_c_ d", "output"]
    assert column(spark, ["/in/novel.txt"], lambda c: X.output_name(c, F.lit("en"))) == ["novel-en.txt"]


def test_estimates(spark):
    assert column(spark, ["", "a", "abcdefgh"], X.token_estimate) == [0, 1, 2]
    assert column(spark, ["abcde", "漢字a"], X.mixed_token_estimate) == [2, 3]


def tags(spark, src, dst, **how):
    df = spark.createDataFrame([(src, dst)], "s string, d string")
    return df.select(C.verdict(F.col("s"), F.col("d"), **how)["tags"]).first()[0]


def test_verdicts(spark):
    assert tags(spark, "", "x") == []
    assert tags(spark, "hello there", " ") == ["target_language_weak"]
    assert tags(spark, "안녕하세요 여러분.", "你好，안녕。", source="ko", target="zh") == ["source_residue"]
    assert tags(spark, "これは本です。", "这是书です。", source="ja", target="zh") == ["source_residue"]
    assert "model_chatter" in tags(spark, "안녕하세요", "译文：你好", source="ko", target="zh")
    assert "verbatim_echo" in tags(spark, "Some long sentence.", "some long sentence.")
    assert "truncated" in tags(spark, "This is a whole sentence.", "Das ist ein ganzer Sa")
    assert "length_ratio_anomaly" in tags(spark, "a", "abcdefgh ijk")
    assert "function_word_residue" in tags(spark, "그는 말했다", "他 said that with 她", source="ko", target="zh")
    assert "target_language_weak" in tags(spark, "안녕하세요 여러분 반갑습니다", "hello everyone nice to meet you", source="ko", target="zh")
    assert tags(spark, "ISBN 9791101874782", "ISBN: 979-11-01-87478-2", source="ko", target="zh") == []


def test_residue_and_titles(spark):
    assert tags(spark, "안녕 ㅋㅋㅋ", "你好 ㅋㅋㅋ", source="ko", target="zh") == []
    assert "source_residue" in tags(spark, "안녕", "你好 ㄱㄴㄷ", source="ko", target="zh")
    assert tags(spark, "カー・ロ", "卡ー・ロ"[:3], source="ja", target="zh") == []
    assert "source_residue" in tags(spark, "The quick brown foxes jumped over", "他说 the quick brown foxes jumped 了", source="de", target="zh")
    assert "source_residue" in tags(spark, "Привет, как твои дела сегодня", "Привет как твои дела", source="ru", target="zh")
    assert tags(spark, "제품 ABC 200 EX", "产品 ABC 200 EX", source="ko", target="zh") == []


def test_case_character_by_character(spark):
    import duckdb

    newer = (0x19B, 0x264, 0x1C89, 0x1C8A)  # letters that have a second case since Unicode 16
    texts = [chr(i) for i in range(1, 0x2100) if i not in newer] + [X.WIDE, "Keitß\nEinpflich ﬁ", "ΣΑΣ İi", "", "plain"]
    want = duckdb.connect().execute("select list(upper(t)), list(lower(t)) from (select unnest($1) as t)", [texts]).fetchall()[0]
    assert column(spark, texts, X.capitals) == want[0]
    assert column(spark, texts, X.small) == want[1]
    assert column(spark, [None], X.capitals) == [None]


def test_capitals_of_sharp_s_are_an_echo(spark):
    text = "Keitß.\nEinpflich einkeit ßzuber."
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.echo(F.col("t"), X.capitals(F.col("t")))).first()[0]
