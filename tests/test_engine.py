import pandas as pd
import pytest
from pyspark.sql import functions as F

from colophon import registry
from colophon.plans import engine
from colophon.streaming.traffic import breaker_stream, status_windows
from helpers import SF, papers


def test_search_identifies_and_lists(spark):
    title = "Graph attention over sparse molecular conformers"
    rows = [
        {"title": title, "authors": ["Jane Doe"], "doi": "10.1234/a", "source": "arXiv", "keywords": ["graphs", "molecules"], "reference_ids": ["10.1234/r1", "10.1234/r2", "10.1234/r3"]},
        {"title": title, "authors": ["Jane Doe"], "doi": "10.1234/b", "source": "Crossref", "pdf_url": "https://x.org/b.pdf", "is_open_access": True},
        {"title": "Sparse molecular conformers revisited with graph attention", "source": "OpenAlex", "doi": "10.1234/c", "reference_ids": ["10.1234/r1", "10.1234/r2", "10.1234/r3"]},
        {"title": "Unrelated botany of alpine meadows", "source": "DOAJ", "doi": "10.1234/d"},
    ]
    q = spark.createDataFrame(
        [(1, title, ["J. Doe"], None, None, None, None), (2, None, None, None, "doi:10.1234/D", None, None), (3, None, None, ["sparse molecular"], None, None, None), (4, "Nothing like it anywhere", None, None, None, None, None)],
        "query_id bigint, title string, authors array<string>, keywords array<string>, doi string, from_year int, to_year int",
    )
    got = {r.query_id: r for r in engine.search(q, papers(spark, rows)).collect()}
    assert got[1].exact_id == 1 and got[1].stopped_early and got[1].match_type == "exact"  # the primary tier comes first
    assert [h.hit for h in got[1].similar_papers] == [3]  # Crossref isn't asked for similar papers
    assert got[2].exact_id == 4 and got[2].confidence == 0.99
    assert got[3].exact_id is None and {h.hit for h in got[3].similar_papers} == {2, 3}  # one of each title
    assert got[4].exact_id is None and got[4].notes == ["No confident match was found in the configured academic sources."]


def test_pool_of_similar_papers(spark):
    """Enough related records: no search. Too few: the sources are searched in order until one and a half times the target is usable."""
    from colophon.operators.prepare import prepare_papers

    refs = ["10.1234/r1", "10.1234/r2", "10.1234/r3"]
    title = "Lichen growth on alpine granite"
    rows = [{"title": title, "doi": "10.1234/m1", "reference_ids": refs}, {"title": "Glacial moraines of the north", "doi": "10.1234/m2"}]
    rows += [{"title": f"Work number {k} coupled", "source": "Semantic Scholar", "reference_ids": refs} for k in range(25)]  # 3 .. 27
    rows += [{"title": f"{title} again {k}", "source": "arXiv"} for k in range(3)]  # 28 .. 30
    rows += [{"title": f"Glacial moraines of the north revisited {k}", "source": s} for s in ("CORE", "OpenAlex", "DOAJ", "Semantic Scholar") for k in range(18 if s != "CORE" else 2)]
    p = prepare_papers(papers(spark, rows))
    mains = p.where("record_id <= 2").withColumn("query_id", F.col("record_id")).withColumns({"from_year": F.lit(None).cast("int"), "to_year": F.lit(None).cast("int")})
    got = {}
    for r in engine.similar_pool(mains, p).collect():
        got.setdefault(r.query_id, set()).add(rows[r.seq - 1]["source"]), got.setdefault(-r.query_id, []).append(r.seq)
    assert sorted(got[-1]) == list(range(3, 23)) and got[1] == {"Semantic Scholar"}  # twice the target, and nothing searched
    assert got[2] == {"Semantic Scholar"} and len(got[-2]) == 18  # 18 usable works: the next source isn't asked


def test_variants_order(spark):
    from colophon.operators.prepare import prepare_queries

    q = spark.createDataFrame([(1, "The study of things", ["A Doe"], ["k"], "10.1234/x", None, None), (2, None, ["A Doe"], None, None, None, None)], "query_id bigint, title string, authors array<string>, keywords array<string>, doi string, from_year int, to_year int")
    got = engine.variants(prepare_queries(q, 2026), 20).orderBy("query_id", "variant_pos").collect()
    assert [r.label for r in got if r.query_id == 1] == ["doi", "exact-title", "title-author", "fuzzy-title", "keywords"]
    assert [r.label for r in got if r.query_id == 2] == ["authors-only"]


def test_discovery_asks_for_all_topics(spark, tmp_path):
    topics = ["lichens", "glaciers", "moraines", "conformers", "molecules", "attention"]
    spark.createDataFrame([(1, topics)], "input_id bigint, topics array<string>").write.parquet(str(tmp_path / "build_inputs.parquet"))
    papers(spark, [{"title": "Attention over conformers of molecules"}, {"title": "Unrelated botany of alpine meadows"}]).write.parquet(str(tmp_path / "papers.parquet"))
    assert [(r.query_id, r.record_id) for r in registry.c07_discover(spark, str(tmp_path)).collect()] == [(1, 1)]


def test_lookup_equals_brute_force(spark):
    asked = [(1, ["a", "b", "c"]), (2, ["z"]), (3, ["a", "q", "r", "s"])]
    recs = [(10, ["a", "b"]), (11, ["c"]), (12, ["a", "q"]), (13, ["z", "y"])]
    got = {(r.aid, r.rid): r.hits for r in engine.lookup(spark.createDataFrame(asked, "aid int, terms array<string>"), spark.createDataFrame(recs, "rid int, terms array<string>"), 0.5).collect()}
    want = {(a, r): len(set(x) & set(y)) for a, x in asked for r, y in recs if len(set(x) & set(y)) >= len(x) / 2}
    assert got == want


def test_entry_is_stable(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    import math
    import os
    from collections import Counter

    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    clean = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    r = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = Counter(tuple(repr(clean(x[names.index(c)])) for c in cols) for x in r.fetchall())
    assert Counter(tuple(repr(clean(x[c])) for c in cols) for x in df.collect()) == want


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"source": ["a"] * 4 + ["b"], "ts": pd.to_datetime([0, 1, 2, 40, 0], unit="s"), "failed": [True, True, False, False, False], "status": "x", "duration_ms": 5})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    run = breaker_stream(stream, threshold=2, cooldown_ms=30_000, needed=1).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    run.awaitTermination(120)
    got = [(r.allowed, r.state) for r in spark.table("breaker").where("source = 'a'").orderBy("ts_ms").collect()]
    assert got == [(True, "CLOSED"), (True, "OPEN"), (False, "OPEN"), (True, "CLOSED")]
    run = status_windows(stream).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    run.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("requests")).first()[0] == 5


def test_a_verdict_needs_few_columns_of_the_corpus(spark):
    from colophon.operators.prepare import prepare_papers, prepare_queries
    from colophon.session import cut

    d = "/root/testdata/sf0.001"
    i = spark.read.parquet(f"{d}/repository_items.parquet")
    none = lambda t: F.lit(None).cast(t)
    q = cut(prepare_queries(i.select(F.col("item_id").alias("query_id"), "title", "authors", none("array<string>").alias("keywords"), "doi", none("int").alias("from_year"), none("int").alias("to_year")), 2026))
    p = cut(prepare_papers(spark.read.parquet(f"{d}/papers.parquet")))
    slim = cut(p.select("record_id", *engine.VERDICT))
    arrivals = cut(engine.retrieve(q, slim))
    # letter pairs follow from the title: the corpus is written, and pairs travel, without them
    got, want = (engine.score_candidates(arrivals, q, x).select(*engine.IDENTIFIED) for x in (slim, p))
    assert "n_grams" not in slim.columns and got.count() and not got.exceptAll(want).count() and not want.exceptAll(got).count()


def test_lookup_drops_pairs_in_the_join(spark):
    """Equal to a count over all pairs, also where terms share bits; pairs that share too little aren't moved."""
    import random

    rnd = random.Random(3)
    sets = lambda n, most: [(k, rnd.sample([f"w{int(rnd.paretovariate(0.6)) % 900}x{i}" for i in range(60)], rnd.randint(0, most))) for k in range(n)]
    words = [f"w{k}" for k in range(40)]
    draw = lambda n, most: [(k, sorted(rnd.sample(words, rnd.randint(0, most)))) for k in range(n)]
    for asked, records, kw in ((draw(40, 12), draw(150, 30), {"share": 0.5}), (draw(40, 9), draw(150, 20), {"least": 3}), (sets(10, 40), sets(30, 60), {"share": 0.5})):
        a, r = (spark.createDataFrame(x, f"{i} bigint, terms array<string>") for x, i in ((asked, "aid"), (records, "rid")))
        found = engine.lookup(a, r, **kw)
        need = lambda n: max(kw.get("least", 1), -(-n // 2) if "share" in kw else 0)
        want = {(i, j, len(set(s) & set(t))) for i, s in asked for j, t in records if s and len(set(s) & set(t)) >= need(len(s))}
        assert {tuple(x) for x in found.collect()} == want
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_first_equals_brute_force(spark, monkeypatch):
    """The first of each source, by terms looked up alone or in pairs; equal sets are compared once, however often they come."""
    import random

    rnd = random.Random(5)
    words = [f"w{k}" for k in range(14)]
    draw = lambda n, most: [sorted(rnd.sample(words, rnd.randint(0, most))) for _ in range(n)]
    asked, records = draw(25, 9) * 2, draw(60, 9) * 3
    a = spark.createDataFrame(list(enumerate(asked)), "aid bigint, terms array<string>")
    r = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(records)], "rid bigint, side int, terms array<string>")
    want = set()
    for i, s in enumerate(asked):
        for side in (0, 1):
            hits = [(-len(set(s) & set(t)), j) for j, t in enumerate(records) if j % 2 == side and s and 2 * len(set(s) & set(t)) >= len(s)]
            want |= {(i, side, j, -h) for h, j in sorted(hits)[:4]}
    compared, real = [], engine._sharing
    monkeypatch.setattr(engine, "_sharing", lambda x, y, *more: compared.append((x.count(), y.count())) or real(x, y, *more))
    for heavy in (None, 0, 5, 1000):
        assert {tuple(x) for x in engine.lookup_first(a, r, 0.5, 4, ("side",), heavy=heavy).collect()} == want
    assert set(compared) == {(len({*map(tuple, asked)}), len({*map(tuple, records)}))}


def test_similar_pairs_move_codes(spark):
    """Scores of coded columns equal those of the texts, and no abstract travels with a pair."""
    from colophon.operators import ranking
    from colophon.operators.prepare import prefixed, prepare_papers

    rows = [{"title": t, "abstract": a, "keywords": k, "topics": k} for t, a, k in (
        ("Lichen growth on alpine granite", "Growth of lichens lichens on granite", ["lichens", "granite"]), ("Lichen growth on granite", "", ["granite"]),
        ("Alpine granite", None, None), ("Granite and lichens", "Granite granite lichens", ["lichens", "Granite walls"]))]
    slim = ranking.similarity_columns(prepare_papers(papers(spark, rows)).select(F.col("record_id").alias("seq"), *engine.SCORED))

    def scores(x):
        pairs = prefixed(x, "m_").crossJoin(prefixed(x, "c_"))
        return sorted(map(tuple, ranking.score_similarity(pairs).select("m_seq", "c_seq", "similarity", "sim_title", "sim_abstract", "sim_keywords", "sim_topics", "relation_bonus").collect()), key=str)

    coded = ranking.coded_columns(slim)
    assert scores(coded) == scores(slim) and len(scores(slim)) == 16
    assert {r.abstract for r in coded.collect()} == {"+", "", None}
