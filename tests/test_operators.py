import pytest
from pyspark.sql import functions as F

from colophon.operators import dedup, fulltext, ranking, status, traffic, validate
from colophon.operators.components import connected_components
from colophon.operators.matching import evaluate
from colophon.operators.prepare import prefixed, prepare_papers, prepare_queries
from helpers import papers


def scored(spark, q, rows):
    base = {"query_id": 1, "title": None, "authors": None, "keywords": None, "doi": None, "from_year": None, "to_year": None}
    qs = spark.createDataFrame([tuple({**base, **q}.values())], "query_id bigint, title string, authors array<string>, keywords array<string>, doi string, from_year int, to_year int")
    pairs = prefixed(prepare_queries(qs, 2026), "q_").crossJoin(prefixed(prepare_papers(papers(spark, rows)), "c_"))
    return [r.asDict() for r in evaluate(pairs).orderBy("c_record_id").collect()]


def test_verdicts(spark):
    title = "Attention is all you need"
    doi, exact, contradicted, near, alone = (
        scored(spark, {"title": "something else", "doi": "doi:10.1234/X"}, [{"title": title, "doi": "10.1234/x"}])[0],
        scored(spark, {"title": title, "authors": ["Vaswani"]}, [{"title": title, "authors": ["Ashish Vaswani"]}])[0],
        scored(spark, {"title": title, "authors": ["J. Vaswani"]}, [{"title": title, "authors": ["Ashish Vaswani"]}])[0],
        scored(spark, {"title": "Attention is all you need now"}, [{"title": title}])[0],
        scored(spark, {"title": title}, [{"title": title}])[0],
    )
    assert (doi["match_type"], doi["confidence"], doi["final_score"]) == ("exact", 0.99, 1.0)
    assert exact["is_exact"] and exact["confidence"] >= 0.95
    assert not contradicted["is_exact"]
    assert near["match_type"] == "near-exact"
    assert alone["is_exact"] and alone["final_score"] == 1.0
    assert not scored(spark, {"title": "Editorial"}, [{"title": "Editorial"}])[0]["is_exact"]
    far = scored(spark, {"title": title + " (2001)", "authors": ["Ashish Vaswani"]}, [{"title": title + " (2001)", "authors": ["Ashish Vaswani"], "year": 2017}])[0]
    assert not far["is_exact"] and far["s_year"] == 0.0
    assert scored(spark, {"keywords": ["deep learning"]}, [{"title": "On deep learning"}])[0]["match_type"] == "similar"


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (9, 8), (8, 7), (3, 1), (None, 4)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 7, 9: 7}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(e.limit(0)).count() == 0


def groups(spark, rows):
    got = {}
    for r in dedup.assign(papers(spark, rows)).orderBy("seq").collect():
        got.setdefault(r.first_seq, []).append(r.seq)
    return [tuple(got[k]) for k in sorted(got)]


def test_dedup_groups(spark):
    t = "A long enough title of a paper"
    assert groups(spark, [{"title": t, "doi": "10.1234/x"}, {"title": "Other words altogether", "doi": "doi:10.1234/X"}]) == [(1, 2)]
    assert groups(spark, [{"title": t, "doi": "10.1234/x"}, {"title": t, "doi": "10.1234/y"}]) == [(1,), (2,)]
    assert groups(spark, [{"title": t, "doi": "10.1234/x", "pmid": "7"}, {"title": t, "doi": "10.1234/y", "pmid": "7"}]) == [(1, 2)]
    assert groups(spark, [{"title": t, "year": 2000}, {"title": t, "year": 2003}, {"title": t, "year": 2001}]) == [(1, 3), (2,)]
    assert groups(spark, [{"title": t, "authors": ["A Doe"]}, {"title": t, "authors": ["B Roe"]}]) == [(1,), (2,)]
    assert groups(spark, [{"title": "Editorial"}, {"title": "Editorial"}]) == [(1,), (2,)]
    assert groups(spark, [{"title": ""}, {"title": None}]) == [(1,), (2,)]
    # a record that bridges two groups joins the first and doesn't fuse them
    assert groups(spark, [{"title": t, "pmid": "1"}, {"title": "Quite another heading here", "arxiv_id": "2101.00001"}, {"title": "x", "pmid": "1", "arxiv_id": "2101.00001v2"}]) == [(1, 3), (2,)]
    assert dedup.deduplicate(papers(spark, [{"title": "x"}]).limit(0)).count() == 0


def test_grouping_equals_a_walk_over_all_records(spark):
    """Components, certain members and left-out copies change nothing."""
    from colophon.functions import authors as A
    from colophon.functions import identifiers as I
    from colophon.functions import text as T
    from helpers import SF

    p = spark.read.parquet(f"{SF}/papers.parquet")
    n = dedup.base_columns(p, "record_id").select(
        "seq", "year", "doi", "source", I.identity_keys("doi", "pmcid", "pmid", "arxiv_id", "source", "source_id").alias("keys"), T.normalize_title("title").alias("n_title"), T.title_fingerprint("title").alias("n_print"),
        A.normalize_authors("authors").alias("n_authors"), F.size("authors").alias("n_listed"), F.length("title").alias("length"), dedup._trust(F.col("source")).alias("trust"),
    )
    want = dict(dedup.walk([r.asDict(recursive=True) for r in n.orderBy("seq").collect()], frozenset(T.STOP_WORDS)))
    assert {r.seq: r.first_seq for r in dedup.assign(p).collect()} == want and len(set(want.values())) < len(want)


def test_merge_fields(spark):
    a = {"title": "A long enough title of a paper", "doi": "10.1234/x", "source": "CORE", "abstract": "short text", "authors": ["A Doe"], "keywords": ["AI", "x"], "citation_count": 3, "sources": ["CORE"]}
    b = {"title": "A long enough title of a paper", "doi": "10.1234/x", "source": "Crossref", "abstract": "a much longer text than that", "authors": ["Ann Doe"], "keywords": ["ai", "y"], "citation_count": 9, "is_open_access": True, "pdf_url": "https://x.org/a.pdf", "year": 2020}
    r = dedup.deduplicate(papers(spark, [a, b])).first()
    assert (r.abstract, r.authors, r.keywords, r.citation_count, r.is_open_access, r.pdf_url, r.year, r.source) == (b["abstract"], ["Ann Doe"], ["AI", "x", "y"], 9, True, "https://x.org/a.pdf", 2020, "CORE")
    assert r.sources == ["CORE", "Crossref"] and r.n_members == 2
    # in order: a text takes over from 1.2 times the standing one's length on, lists of equal length yield to trust, titles to longer alike ones
    same = {"doi": "10.1234/x", "title": "A long enough title of a paper"}
    rows = [{**same, "abstract": "x" * 10, "authors": ["A", "B"], "source": "DOAJ", "citation_count": None}, {**same, "abstract": "y" * 12}, {**same, "abstract": "z" * 13, "authors": ["C", "D"], "citation_count": -4, "similarity_score": float("nan")},
            {**same, "abstract": "w" * 15, "authors": ["E", "F"], "title": "<i>A long enough title of a paper</i>", "source": "OpenAlex", "similarity_score": 0.4, "is_open_access": False}]
    r = dedup.deduplicate(papers(spark, rows)).first()
    assert (r.abstract, r.authors, r.citation_count, r.similarity_score, r.title, r.is_open_access, r.source) == ("z" * 13, ["E", "F"], 0, 0.4, rows[3]["title"], False, "DOAJ")
    assert r.source_links == [] and r.keywords is None and r.sources == ["DOAJ", "Crossref", "OpenAlex"]


def test_dedup_is_idempotent(spark):
    from helpers import SF

    once = dedup.deduplicate(spark.read.parquet(f"{SF}/papers.parquet"))
    again = dedup.deduplicate(once.withColumnRenamed("first_seq", "record_id"))
    assert once.count() >= again.count() >= 0.97 * once.count()


def test_fuzzy_pairs_equal_brute_force(spark):
    from colophon.functions import similarity as S
    from colophon.functions import text as T
    from helpers import SF

    t = spark.read.parquet(f"{SF}/papers.parquet").select(T.normalize_title("title").alias("n_title")).where("n_title <> ''").distinct()
    more = t.select(F.concat("n_title", F.lit(" s")).alias("n_title"))
    t = t.unionByName(more).distinct().withColumn("n_tokens", S.content_tokens(F.col("n_title"))).withColumn("n_grams", S.bigrams(F.col("n_title"))).cache()
    got = {(r.title_a, r.title_b) for r in dedup.fuzzy_title_pairs(t).collect()}
    x, y = t.select(F.col("n_title").alias("a")), t.select(F.col("n_title").alias("b"))
    brute = {(r.a, r.b) for r in x.join(y, F.col("a") < F.col("b")).where(S.title_similarity(F.col("a"), F.col("b")) >= 0.93).collect()}
    assert got == brute and len(brute) > 50


def test_ranking(spark):
    r = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "", 1), (4, "", 2), (5, "y", 7)], "seq bigint, c_n_print string, c int").withColumn("g", F.lit(1))
    got = [(x.seq, x.rank) for x in ranking.rank_distinct_titles(r, ["g"], [F.col("c").desc()], 3).orderBy("rank").collect()]
    assert got == [(2, 1), (5, 2), (4, 3)]
    years = lambda y, a, b: spark.createDataFrame([(y, a, b)], "y int, a int, b int").select(ranking.within_years(F.col("y"), F.col("a"), F.col("b")).alias("v")).first().v
    assert years(None, None, None) and not years(None, 2000, None) and years(2000, 2000, 2000) and not years(2001, None, 2000)


def test_full_text(spark):
    rows = [
        {"title": "a", "pdf_url": "https://x.org/a.pdf", "is_open_access": True}, {"title": "b", "pdf_url": "https://x.org/a.pdf", "is_open_access": False}, {"title": "c", "pdf_url": "https://x.org/a.pdf", "arxiv_id": "1"},
        {"title": "d", "landing_page_url": "https://x.org/"}, {"title": "e", "doi": "10.1234/x"}, {"title": "f"},
    ]
    got = [r.f.access_type for r in papers(spark, rows).select("record_id", fulltext.derive_full_text().alias("f")).orderBy("record_id").collect()]
    assert got == ["open-access", "publisher", "repository", "landing-page", "landing-page", "unavailable"]
    loc = spark.createDataFrame(
        [(5, 1, "s1", True, "https://a.org/x.pdf", "pdf", "repository", None), (5, 2, "s2", True, "https://b.org/x.pdf", "pdf", "open-access", None), (6, 1, "s3", True, "https://c.org/x.pdf", "pdf", "open-access", None)],
        "record_id bigint, seq int, source string, available boolean, url string, type string, access_type string, license string",
    )
    out = {r.record_id: r for r in fulltext.back_fill(fulltext.resolve_full_text(papers(spark, rows), loc)).collect()}
    assert out[5].pdf_url == "https://a.org/x.pdf"  # the chain stops at the first free PDF
    assert out[6].pdf_url is None  # without an identifier nobody is asked


def test_status_and_retry(spark):
    rows = [(1, "a", "failed", 1, 10, "x", 1), (1, "a", "skipped", 0, 5, "y", 2), (1, "b", "failed", 0, 1, "z", 3), (1, "b", "success", 4, 1, None, 4)]
    log = spark.createDataFrame(rows, "query_id int, name string, status string, result_count bigint, duration_ms bigint, error string, seq int")
    got = {r.name: (r.status, r.result_count, r.duration_ms, r.error) for r in status.merge_statuses(log, ["query_id"]).collect()}
    assert got == {"a": ("failed", 1, 15, "x"), "b": ("success", 4, 2, None)}
    one = lambda h: spark.range(1).select(status.retry_after_ms(F.lit(h).cast("string"), F.lit("2025-01-01").cast("timestamp")).alias("v")).first().v
    assert (one("5"), one("999999"), one("soon"), one(None), one("Wed, 01 Jan 2025 00:00:09 GMT"), one("Tue, 31 Dec 2024 00:00:00 GMT")) == (5000.0, 86400000.0, None, None, 9000.0, 0.0)
    text = lambda n: spark.range(1).select(status.duration_text(F.lit(n)).alias("v")).first().v
    assert (text(59), text(60), text(3600)) == ("59s", "1m", "1h 0m")
    assert "[redacted]" in spark.range(1).select(status.mask_secrets(F.lit("api_key=abc123 a@b.org")).alias("v")).first().v


def test_traffic_machines():
    b = traffic.Bucket(1.0, 1.0, per_minute=3)
    assert b.take(0) and not b.take(100) and b.wait_ms(100) == pytest.approx(900) and b.take(1100) and b.take(2200)
    assert not b.take(4000) and b.wait_ms(4000) == pytest.approx(56000) and b.take(60001)
    b.cool(60001, 5000)
    assert not b.take(64000) and b.take(66100)
    c = traffic.Breaker(2, 100, 1)
    for t in (0, 1):
        assert c.admit(t)
        c.record(False, t)
    assert c.state == "OPEN" and not c.admit(50) and c.admit(101) and c.state == "HALF_OPEN"
    c.record(True, 101)
    assert c.state == "CLOSED" and c.trips == 1
    m = traffic.TtlLru(1000, 2)
    m.put("a", 0), m.put("b", 1)
    assert m.get("a", 2)
    m.put("c", 3)
    assert not m.get("b", 4) and m.evictions == 1 and m.get("a", 900) and not m.get("a", 1000)
    m.put("z", 0, 0)
    assert not m.get("z", 1)


def test_replay_is_per_source(spark):
    rows = [(k, float(t), t % 2 == 0) for k in ("a", "b") for t in range(10)]
    log = spark.createDataFrame(rows, "source string, ts_ms double, failed boolean").repartition(3)
    got = traffic.circuit_breaker(log, "source", ["ts_ms"], "failed", threshold=1, cooldown_ms=3, needed=1).orderBy("source", "ts_ms").collect()
    assert [r.state for r in got[:10]] == [r.state for r in got[10:]] and got[0].state == "OPEN"


def test_validation(spark):
    rows = [("x" * 501, None, None, None, None, None), (None, None, None, "nope", None, None), ("t", None, None, None, 2020, 2010), (None, ["", " "], None, None, None, None), ("t", ["a"], ["b"], "10.1234/x", 2000, 2001)]
    x = spark.createDataFrame(rows, "title string, authors array<string>, keywords array<string>, doi string, from_year int, to_year int")
    got = [r.e for r in x.select(validate.request_errors(2026).alias("e")).collect()]
    assert got == [["title too long"], ["doi not recognised"], ["from_year after to_year"], ["no search field"], []]
    part = lambda s: tuple(spark.range(1).select(validate.paper_id_parts(F.lit(s)).alias("v")).first().v)
    assert part("doi:10.1234/X")[:2] == ("doi", "10.1234/x") and part("PMCID:pmc12")[:2] == ("pmcid", "PMC12") and part("arxiv:2101.00001v2")[2] is None
    assert part("foo:1")[2] == "unsupported scheme" and part("pmid:x1")[2] == "malformed value" and part("plain")[2]


@pytest.mark.parametrize(
    "line, want",
    [
        ("Attention is all you need", ("Attention is all you need", None, None, None, None, None)),
        ("Deep nets + @Jane Doe + since: 2015", ("Deep nets", ["Jane Doe"], None, None, 2015, None)),
        ("kw: ai, deep learning + author: A. Doe; B. Roe", (None, ["A. Doe", "B. Roe"], ["ai", "deep learning"], None, None, None)),
        ("10.1234/abc", (None, None, None, "10.1234/abc", None, None)), ("graph, deep nets", (None, None, ["graph", "deep nets"], None, None, None)),
        ("year: 2001-2005 + title: X", ("X", None, None, None, 2001, 2005)), ("", (None, None, None, None, None, None)),
    ],
)
def test_free_text(spark, line, want):
    assert tuple(validate.parse_free_text(spark.createDataFrame([(line,)], "raw_query string")).select("title", "authors", "keywords", "doi", "from_year", "to_year").first()) == want
