import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colophon.functions import authors as A
from colophon.functions import identifiers as I
from colophon.functions import similarity as S
from colophon.functions import text as T
from colophon.functions import urls as U
from colophon.functions.core import ordered_distinct, round_score


@pytest.mark.parametrize(
    "raw, want",
    [
        ("10.1234/Example", "10.1234/example"), ("doi:10.1234/x", "10.1234/x"), ("DOI : 10.1234/x", "10.1234/x"), ("https://doi.org/10.1234/x.", "10.1234/x"),
        ("http://dx.doi.org/10.1234/x?utm=1", "10.1234/x"), ("info:doi/10.1234/x", "10.1234/x"), ("urn:doi:10.1234/x", "10.1234/x"), ("10.1234%2Fx", "10.1234/x"),
        ("<10.1234/x>", "10.1234/x"), ("(10.1234/x)", "10.1234/x"), ("10.1234/a+b", "10.1234/a+b"), ("10.12/x", None), ("10.1234/", None), ("n/a", None), ("", None), ("10.1234/%zz", None),
    ],
)
def test_doi(value, raw, want):
    assert value(I.normalize_doi, raw) == want


def test_doi_null_and_embedded(value):
    assert value(I.normalize_doi, None, schema="x string") is None
    assert value(I.extract_doi, "see 10.1234/abc, and more") == "10.1234/abc"
    assert value(I.doi_to_url, "doi:10.1234/X") == "https://doi.org/10.1234/x"
    assert value(I.doi_equals, "10.1234/X", "doi:10.1234/x") is True


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Schrödinger's <i>Cat</i>", "schrodinger s cat"), ("Audio &amp;amp; Video", "audio video"), ("COVID-19 – a state-of-the-art review -", "covid-19 a state-of-the-art review"),
        ("α-synuclein and β", "alpha-synuclein and beta"), ("&#x41;&#66;c", "abc"), ("ﬁne ½ Ⅱ", "fine 1 2 ii"), ("深层学习", ""), ("", ""), ("Łódź", "odz"),
    ],
)
def test_title(value, raw, want):
    assert value(T.normalize_title, raw) == want


def test_title_forms(value):
    assert value(lambda c: T.normalize_title(c, True), "The Of") == "the of"
    assert value(T.title_fingerprint, "Deep-Fake Detection") == value(T.title_fingerprint, "Deepfake  detection") == "deepfakedetection"
    assert value(T.title_tokens, "Attention is all you need") == ["attention", "all", "you", "need"]
    assert value(T.normalize_title, None, schema="x string") == ""


def test_keywords(value):
    got = value(lambda *c: T.normalize_keywords(F.array(*c)), "Deep Learning; AI | the", "ai", "<b>x</b>, y")
    assert got == ["deep learning", "ai", "x", "y"]
    assert value(T.normalize_keywords, None, schema="x array<string>") == []
    assert value(T.normalize_keyword, "k" * 130) == "k" * 120


@pytest.mark.parametrize("text, want", [("A study (2019)", 2019), ("In 1998 and 2001", 1998), ("2101 nights", None), ("none", None)])
def test_year_hint(value, text, want):
    assert value(lambda c: T.year_hint(c, 2026), text) == want


@pytest.mark.parametrize("text, want", [("2020", 2020), ("12 May 1987", 1987), ("99", None), ("2100", None)])
def test_clean_year(value, text, want):
    assert value(lambda c: T.clean_year(c, 2026), text) == want


@pytest.mark.parametrize(
    "raw, full, last, initial",
    [
        ("John Doe", "john doe", "doe", "j"), ("Doe, John", "john doe", "doe", "j"), ("Doe J", "j doe", "doe", "j"), ("van der Berg, Anne M.", "anne m van der berg", "van der berg", "a"),
        ("Anne van der Berg", "anne van der berg", "van der berg", "a"), ("Müller, K.-H.", "k h muller", "muller", "k"), ("Vaswani", "vaswani", "vaswani", None), ("John Smith Jr.", "john smith", "smith", "j"),
    ],
)
def test_author(value, raw, full, last, initial):
    assert tuple(value(A.normalize_author, raw)) == (full, last, initial)


def test_author_blank_and_overlap(value, spark):
    assert value(A.normalize_author, "  ") is None
    assert value(A.normalize_author, None, schema="x string") is None
    both = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(A.author_overlap(A.normalize_authors("a"), A.normalize_authors("b")).alias("v")).first().v
    assert both(["John Doe"], ["J. Doe", "A. Roe"]) == pytest.approx(0.9)
    assert both(["John Doe"], ["Adam Doe"]) == pytest.approx(0.2)
    assert both(["Doe"], ["John Doe"]) == pytest.approx(0.75)
    assert both([], ["John Doe"]) == 0.0
    assert both(["John Doe", "John Doe Smith"], ["John Doe"]) == 1.0
    assert value(A.display_name, "Doe,  John ") == "John Doe"


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab c", max_size=12), st.text("ab c", max_size=12)), min_size=8, max_size=8))
def test_similarity_properties(spark, pairs):
    x = spark.createDataFrame([(" ".join(a.split()), " ".join(b.split())) for a, b in pairs], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in x.select("a", "b", S.title_similarity(a, b).alias("s"), S.title_similarity(b, a).alias("t"), S.levenshtein_similarity(a, b).alias("e"), S.dice(a, b).alias("d"), S.banded_levenshtein(a, b, 2).alias("n")).collect():
        assert r.s == pytest.approx(r.t) and 0 <= r.s <= 1
        n = max(len(r.a), len(r.b))
        assert r.e == pytest.approx(1.0 if n == 0 else 1 - _edit(r.a, r.b) / n)
        assert r.n == min(3, _edit(r.a, r.b))
        ga, gb = {r.a[i : i + 2] for i in range(len(r.a) - 1)}, {r.b[i : i + 2] for i in range(len(r.b) - 1)}
        want = 0.0 if not r.a or not r.b else 1.0 if r.a == r.b else 2 * len(ga & gb) / (len(ga) + len(gb)) if ga and gb else 0.0
        assert r.d == pytest.approx(want)


def test_similarity_edges(value, spark):
    assert value(lambda a, b: S.title_similarity(a, b), "attention is all you need", "attention is all you need a study") == pytest.approx(0.9)
    assert value(lambda a: S.jaccard(a, a), [], schema="x array<string>") == 0.0
    assert value(lambda a: S.cosine(S.term_counts(a), S.term_counts(a)), ["x", "y", "x"], schema="x array<string>") == pytest.approx(1.0)
    assert value(lambda a: S.term_counts(a), ["x", "y", "x"], schema="x array<string>") == {"x": 2, "y": 1}
    assert value(lambda a: S.term_counts(a), [], schema="x array<string>") == {}
    assert value(round_score, 0.12345) == 0.1235
    assert value(round_score, float("nan")) == 0.0
    assert [value(lambda y: S.recency_bonus(y, 0.05, 2026), y, schema="x int") for y in (2026, 2020, 2014, None, 2030)] == pytest.approx([0.05, 0.025, 0, 0, 0.05])
    assert value(lambda a: ordered_distinct(a), ["B", "a", "b", None, "A"], schema="x array<string>") == ["B", "a"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Example.org/a.PDF?x=1", "https://example.org/a.PDF?x=1"), ("http://example.org", "http://example.org/"), ("https://example.org:443/x", "https://example.org/x"), ("ftp://example.org/x", None),
        ("javascript:void(0)", None), ("http://192.168.1.5/x.pdf", None), ("http://172.20.0.1/", None), ("http://172.33.0.1/", "http://172.33.0.1/"), ("http://127.0.0.1:80/", None), ("http://[::1]/", None),
        ("http://[::ffff:10.0.0.1]/", None), ("http://localhost:8000/x", None), ("http://u:p@example.org/", None), ("http://169.254.169.254/", None), ("http://host.internal/x", None), ("files/x.pdf", None), ("", None),
    ],
)
def test_links(value, url, want):
    assert value(U.sanitize_external_link, url) == want


def test_pdf_and_policy(value):
    assert value(U.looks_like_pdf, "https://x.org/a.pdf") and value(U.looks_like_pdf, "https://x.org/pdf/12")
    assert not value(U.looks_like_pdf, "https://doi.org/10.1/x.pdf") and not value(U.looks_like_pdf, "N/A")
    assert value(U.is_public_pdf, "https://login.x.org/signin?next=/a.pdf") is False
    assert value(U.api_url_verdict, "https://api.crossref.org/works") is None
    assert value(U.api_url_verdict, "http://api.crossref.org/works") == "scheme is not permitted"
    assert value(U.api_url_verdict, "https://evil.example/") == "host is not on the academic API allowlist"
