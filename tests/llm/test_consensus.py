import datetime as dt

from pyspark.sql import functions as F

from colophon.llm import consensus as C

BODY = "Field crews measured the depth of twelve lakes in spring. The deepest lake was colder than all others. No other lake changed much."


def data(spark, rows):
    """rows: group, record, source, sources, abstract, pdf, doi, day."""
    g = spark.createDataFrame([(r[0], r[1]) for r in rows] * 2, "group_id bigint, record_id bigint").withColumn("field", F.lit("x"))
    p = spark.createDataFrame([(r[1], r[2], r[3], r[4], r[5], r[6], dt.datetime(2024, 1, r[7])) for r in rows], "record_id bigint, source string, sources array<string>, abstract string, pdf_url string, doi string, retrieved_at timestamp")
    s = spark.createDataFrame([("crossref", "Crossref", 6, 1), ("openalex", "OpenAlex", 5, 2), ("core", "CORE", 2, 3)], "source_key string, source_name string, trust int, ordinal int")
    return {(r.group_id, r.field, r.record_id) for r in C.survivors(g, p, s).collect()}


def test_fields(spark):
    rows = [
        (1, 1, "CORE", None, BODY[:60] + "…", "https://x.org/a.pdf", "10.1234/a", 9),
        (1, 2, "OpenAlex", ["open_alex", "Crossref"], "<p>Abstract: " + BODY + "</p>", "https://login.x.org/?f=a.pdf", "doi:10.1234/B", 3),
        (1, 3, "Crossref", ["CROSSREF"], BODY, "http://10.0.0.1/a.pdf", "n/a", 5),
        (1, 4, "OpenAlex", [], "n/a", None, "10.1234/b", 7),
        (2, 5, "CORE", None, None, None, None, 1),
    ]
    assert data(spark, rows) == {(1, "abstract", 2), (1, "pdf_url", 1), (1, "doi", 2), (1, "sources", 1), (1, "sources", 2), (2, "sources", 5)}


def test_notice_and_prefix(spark):
    notice = "Please sign in to read the full text of this record."
    rows = [(k, k, "CORE", None, notice, None, None, 1) for k in range(1, 7)]
    rows += [(10, 10, "CORE", None, BODY.rsplit(" No", 1)[0], None, None, 9), (10, 11, "CORE", None, BODY, None, None, 2)]
    got = {x for x in data(spark, rows) if x[1] == "abstract"}
    assert got == {(10, "abstract", 11)}


def test_alignment_and_tie():
    a, b, c = ("x y z w".split(), "x q z w".split(), "x y z v w".split())
    assert C.consensus([(a, 2.0), (b, 1.0), (c, 1.0)]) == a
    assert C.consensus([(a, 1.0), (b, 3.0), (c, 1.0)]) == b
    assert C.distance(a, c) == 1 and C.distance([], a) == 4
    rows = [{"body": BODY, "whole": True, "retrieved": 1, "record_id": 9}, {"body": BODY + " Extra sentence here.", "whole": True, "retrieved": 1, "record_id": 4}]
    assert C.survivor(rows)["record_id"] == 4


def test_large_group_goes_in_blocks(spark):
    rows = [(1, k, "CORE", None, f"Value {k} of a long list of sentences that is quite complete, number {k}.", None, None, 1 + k % 28) for k in range(1, 200)]
    best = max(range(1, 200), key=lambda k: (1 + k % 28, -k))
    assert {x for x in data(spark, rows) if x[1] == "abstract"} == {(1, "abstract", best)}
    assert data(spark, rows[:0] or [(1, 1, None, None, None, None, None, 1)]) == set()


def test_cut_values_of_a_large_group_are_cut_in_all_of_it(spark):
    rows = []
    for g in range(1, 7):
        full = BODY.replace("lake", f"lake {g}")  # a sentence of many groups would be a notice
        rows += [(g, 1000 * g, "CORE", None, full, None, None, 20), (g, 1000 * g + 1, "CORE", None, full.rsplit(" No", 1)[0], None, None, 28)]
        rows += [(g, 1000 * g + 2 + k, "CORE", None, f"Value {k} of a long list {g} of sentences that is quite complete, number {k}.", None, None, 1 + k % 19) for k in range(100)]
    # a small group beside them: the longer value isn't complete, yet it shows that the other one is cut
    rows += [(50, 90000, "CORE", None, BODY, None, None, 9), (50, 90001, "CORE", None, BODY + " Then the crews", None, None, 2)]
    assert {x for x in data(spark, rows) if x[1] == "abstract"} == {(g, "abstract", 1000 * g) for g in range(1, 7)}


def test_heaviest_equals_survivor(spark):
    texts = [BODY, BODY + " More of it.", BODY[:80], BODY + ' "It is so."', BODY.rsplit(" No", 1)[0], "湖の水は春に冷たく深いところほど変化が少なかった。", "湖の水は春に冷たく深いところほど変化が少なかった。他は不明"]
    rows = [(g, 10 * g + k, None if (g + k) % 5 == 0 else (7 * g + 3 * k) % 11, t) for g in range(1, 12) for k, t in enumerate(texts) if (g * (k + 2)) % 4]
    df = spark.createDataFrame(rows, "group_id bigint, record_id bigint, retrieved bigint, body string").withColumn("whole", C.looks_whole(F.col("body")))
    groups = {}
    for r in df.collect():
        groups.setdefault(r.group_id, []).append(r.asDict())
    want = {(g, s["record_id"]) for g, rs in groups.items() if (s := C.survivor(rs))}
    assert want and {(r.group_id, r.record_id) for r in C.heaviest(df).collect()} == want


def test_alignment_decides(spark):
    body = BODY + " The crews returned in autumn and measured each of the lakes again, with the same result."
    typo = BODY.replace("twelve", "12")
    assert not body.startswith(typo)
    other = [f"Report {k} of another matter that is complete and has little to do with lakes at all, number {k}." for k in range(80)]
    votes = [BODY.replace("spring", "March"), BODY, BODY.replace("colder", "warmer")]
    for extra in ([], other):  # small and large groups
        # an altered beginning of a longer value is cut off, although it is the latest
        rows = [(1, 1, "CORE", None, body, None, None, 5), (1, 2, "CORE", None, typo, None, None, 20)]
        # of values retrieved together, the one that the others confirm
        rows += [(2, 11 + k, "CORE", None, v, None, None, 20) for k, v in enumerate(votes)]
        rows += [(g, 1000 * g + k, "CORE", None, v.replace("number", f"number {g}"), None, None, 1 + k % 4) for g in (1, 2) for k, v in enumerate(extra)]
        assert {x for x in data(spark, rows) if x[1] == "abstract"} == {(1, "abstract", 1), (2, "abstract", 12)}
