import unicodedata

import pyarrow as pa
import pytest

from colophon.llm import charforms as C


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Café", "Café"), ("Ｃａｆé， ok", "Café, ok"), ("a​b c", "ab c"), ("ﬁne part Ⅱ", "fine part II"), ("Kelvin Ångstrom", "Kelvin Ångstrom"),
        ("Mаrgіnаl А", "Marginal A"), ("Ιnterval", "Interval"), ("Насeление", "Население"), ("co‐op", "co-op"), ("й".replace("й", "й"), "й"),
    ],
)
def test_affected(raw, want):
    out, bad = C.normalize_strings(pa.array([raw]))
    assert out.to_pylist() == [want] and bad.tolist() == [True]


@pytest.mark.parametrize("raw", ["Plain", "", "Café – “quoted” … x²", "Население в районе", "Λ-tracing and μ-effects", "高湿度の条件：測定（結果）", "<i>a</i>  b", "½ of 10 µm", "А это Я", "Łódź"])
def test_ordinary(raw):
    out, bad = C.normalize_strings(pa.array([raw]))
    assert out.to_pylist() == [raw] and bad.tolist() == [False]


def test_composition_equals_nfc():
    words = [unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c)) != chr(c)] + ["ệ", "ȫ", "q́"]
    out, _ = C.normalize_strings(pa.array(words))
    assert out.to_pylist() == [unicodedata.normalize("NFC", w) for w in words]


def test_composition_equals_nfc_in_every_script(spark):
    kana = "湖における季節変化か\u3099ハ\u309aターンて\u3099あり、水温："
    words = [kana, unicodedata.normalize("NFD", "한국어 값 가"), *(w for c in range(0xC0, C._SIZE) if (w := unicodedata.normalize("NFD", chr(c))) != chr(c) and unicodedata.normalize("NFC", w) == chr(c))]
    out, affected = C.normalize_strings(pa.array(words))
    assert out.to_pylist()[:2] == [unicodedata.normalize("NFC", w) for w in words[:2]] and bool(affected[0]) and bool(affected[1])
    # the long s is a compatibility letter and becomes an s first
    assert [(w, o) for w, o in zip(words[2:], out.to_pylist()[2:]) if o != unicodedata.normalize("NFC", w)] == [("ſ\u0307", "ṡ")]
    composed, touched = C.normalize_strings(pa.array([unicodedata.normalize("NFC", w) for w in words[:2]]))
    assert not any(touched) and composed.to_pylist() == [unicodedata.normalize("NFC", w) for w in words[:2]]
    t = spark.createDataFrame([(1, kana, ["x"]), (2, unicodedata.normalize("NFC", kana), ["テ\u3099"])], "record_id bigint, title string, authors array<string>")
    assert {tuple(r) for r in C.affected_fields(t).collect()} == {(1, "title"), (2, "authors")}


def test_tables(spark):
    rows = [(1, "Ａ", ["x", None, "o​k"], 5), (2, None, None, 5), (3, "", [], 5), (4, "ok", ["fine"], 5), (5, "y" * 100_000 + " ", ["fine"], 5)]
    t = spark.createDataFrame(rows, "record_id bigint, title string, authors array<string>, field int")
    got = {r.record_id: (r.title, r.authors) for r in C.canonical_forms(t).collect()}
    assert got[1] == ("A", ["x", None, "ok"]) and got[2] == (None, None) and got[3] == ("", []) and len(got[5][0]) == 100_001
    assert {tuple(r) for r in C.affected_fields(t).collect()} == {(1, "title"), (1, "authors"), (5, "title")}
    assert C.affected_fields(t.limit(0)).count() == 0
