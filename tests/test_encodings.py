"""The encoding detector: sentences in every candidate, what can't be known, and whole files."""

import pytest

from inkspark.sources.encodings import CANDIDATES, detected, likelihood

SENTENCES = {'cp949':["권세혁\n","그는 천천히 문을 열고 밖으로 나갔다. 봄이 왔다.","안녕하세요"],
   'cp932':["これはテストです。","彼はゆっくりとドアを開けて外に出た。","プロローグ\n第一章　旅立ち","東京都に行きます"],
   'euc_jp':["これはテストです。","彼はゆっくりとドアを開けて外に出た。春が来た。"],
   'gb18030':["他慢慢地打开了门，走了出去。","第一章 春天来了","你好，世界。这是一个测试。"],
   'big5':["他慢慢地打開了門，走了出去。","第一章 春天來了，這是一個測試。"],
   
'cp1251':["Он медленно открыл дверь и вышел.","Привет, мир"],
   'koi8-r':["Он медленно открыл дверь и вышел.","Пролог. Весна пришла"],
   'cp874':["เขาค่อยๆ เปิดประตูแล้วเดินออกไป"],
   'cp1256':["فتح الباب ببطء وخرج إلى الشارع"],
   'cp1254':["Kapıyı yavaşça açtı ve dışarı çıktı, güneş doğuyordu."],
   'cp1250':["Powoli otworzył drzwi i wyszedł. Wiosna nadeszła wśród źdźbeł."],
   'cp1252':["Il ouvrit lentement la porte et sortit. L'été était là, à côté du château.","Él abrió la puerta y salió mañana.","Er öffnete langsam die Tür und ging für immer."]}


@pytest.mark.parametrize("name", sorted(SENTENCES))
def test_sentences_come_back(name):
    for text in SENTENCES[name]:
        got, encoding, confidence = detected(text.encode(name))
        assert (got, encoding) == (text, name)
        assert 0 < confidence <= 1


def test_confusion_of_the_pair_encodings():
    """Longer texts leave no doubt."""
    table = {}
    for name in ("cp949", "cp932", "euc_jp", "gb18030", "big5"):
        for text in ("\n".join(SENTENCES[name]), SENTENCES[name][-1] * 5):
            _, found, confidence = detected(text.encode(name))
            table[name, found] = table.get((name, found), 0) + 1
            assert confidence > 0.9
    assert table == {(n, n): 2 for n in ("cp949", "cp932", "euc_jp", "gb18030", "big5")}


def test_marks_and_bytes_that_nothing_decodes():
    assert detected("é".encode("utf-8-sig")) == ("é", "utf-8", 1.0)
    assert detected("é\r\n".encode("utf-16")) == ("é\r\n", "utf-16", 1.0)
    assert detected(b"") == ("", "utf-8", 1.0)
    assert detected(b"plain") == ("plain", "utf-8", 1.0)
    assert all(likelihood(b"\xff\xff\x81", n) is None or n in ("koi8-r", "cp1251", "cp1256") for n in CANDIDATES)
    assert detected(b"\xff\xfe\x00")[1] != "utf-16"


@pytest.mark.parametrize(
    "text",
    [
        "SCHEIN!! ENÜÖ!! TZGEER!! ER!! ÖCH!! VON!! CHS\nCHÜ!! CHAUAU!!", "ÇÉ!! ÊELLE!! OURÉ!! QUECHLE,!! ÈÊ.\nDE!! AU!! È!! ÈÉÊ!!", "La é le de de.", "Anaieux éé èçou éç.", "Te auunger von ö beberte. tum",
        "Le " * 24 + "éè " * 25 + "éêqueeau de la porte", "Èêenvi ç un queon ouou èèêé.",
    ],
)
def test_capitals_single_letters_and_repeated_words(text):
    assert detected(text.encode("cp1252"))[:2] == (text, "cp1252")


@pytest.mark.parametrize("name", ["koi8-r", "cp1251"])
def test_other_scripts_among_words_of_ascii(name):
    for text in ("API reference: функция get_user(id) возвращает объект", "The word означает spring in English texts.", "Windows и Linux - это операционные системы"):
        assert detected(text.encode(name))[:2] == (text, name)
