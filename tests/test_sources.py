import json

from pyspark.sql import functions as F

from colophon.sources import grammar, live, mappers, registry


def scan(spark, source, payload):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return [r.asDict(True) for r in mappers.scan(spark.createDataFrame([(text,)], "payload string"), source).collect()]


def test_doaj(spark):
    r = scan(spark, "doaj", {"results": [{"id": "abc", "bibjson": {"title": "<p>T</p>", "abstract": "<p>A</p>", "year": "2020", "author": [{"name": "Doe, John"}], "identifier": [{"type": "DOI", "id": "10.1234/X"}],
        "journal": {"title": "J", "publisher": "P"}, "keywords": ["AI"], "subject": [{"term": "S"}], "link": [{"type": "fulltext", "content_type": "PDF", "url": "https://x.org/f"}]}}, {"id": "none"}]})[0]
    assert (r["title"], r["abstract"], r["year"], r["authors"], r["doi"], r["pdf_url"], r["is_open_access"], r["topics"]) == ("T", "A", 2020, ["John Doe"], "10.1234/x", "https://x.org/f", True, ["S"])


def test_crossref(spark):
    r = scan(spark, "crossref", {"message": {"items": [{"DOI": "10.1234/X", "title": ["", "T"], "author": [{"given": "A", "family": "B"}, {"name": "Org"}], "issued": {"date-parts": [[2019, 1]]}, "type": "proceedings-article",
        "container-title": ["Conf"], "is-referenced-by-count": 3, "reference": [{"DOI": "10.1234/r"}, {}], "abstract": "<jats:p>Ab &amp; c</jats:p>"}]}})[0]
    assert (r["title"], r["authors"], r["year"], r["conference"], r["journal"], r["citation_count"], r["reference_ids"], r["abstract"], r["is_open_access"]) == ("T", ["A B", "Org"], 2019, "Conf", None, 3, ["10.1234/r"], "Ab & c", None)


def test_openalex(spark):
    w = {"id": "https://openalex.org/W2741809807", "title": "T", "abstract_inverted_index": {"We": [0], "present": [1], "a": [2], "method": [3, 30000]}, "concepts": [{"display_name": "K", "score": 0.5}, {"display_name": "L", "score": 0.1}],
        "open_access": {"is_oa": True, "oa_url": "https://doi.org/10.1234/x"}, "best_oa_location": {"pdf_url": "https://x.org/a.pdf"}, "authorships": [{"author": {"display_name": "A B"}}], "publication_year": 2018}
    r = scan(spark, "openalex", {"results": [w]})[0]
    assert (r["abstract"], r["source_id"], r["topics"], r["pdf_url"], r["landing_page_url"]) == ("We present a method", "W2741809807", ["K"], "https://x.org/a.pdf", "https://doi.org/10.1234/x")


def test_semantic_scholar_core_europe_pmc_datacite(spark):
    r = scan(spark, "semanticScholar", {"data": [{"paperId": "p", "title": "T", "venue": "V", "publicationVenue": {"name": "V", "type": "conference"}, "externalIds": {"DOI": "10.1234/x", "PubMedCentral": "12"}, "openAccessPdf": {"url": "https://x.org/a.pdf"}}]})[0]
    assert (r["conference"], r["journal"], r["pmcid"], r["is_open_access"]) == ("V", None, "PMC12", True)
    r = scan(spark, "core", {"results": [{"id": 7, "title": "T", "yearPublished": 2020, "citationCount": 12, "sourceFulltextUrls": ["https://x.org/1", "https://x.org/2.pdf"]}]})[0]
    assert (r["source_id"], r["citation_count"], r["pdf_url"], r["landing_page_url"]) == ("7", 12, "https://x.org/2.pdf", "https://core.ac.uk/works/7")
    r = scan(spark, "europepmc", {"resultList": {"result": [{"id": "1", "title": "T", "authorString": "Doe J, Roe A", "isOpenAccess": "N", "pmcid": "pmc5", "pubTypeList": {"pubType": ["Preprint"]}}]}})[0]
    assert (r["authors"], r["is_open_access"], r["pmcid"], r["publisher"]) == (["Doe J", "Roe A"], False, "PMC5", "Preprint")
    rows = [{"attributes": {"doi": "10.1234/d", "titles": [{"title": "T"}], "publisher": {"name": "Pub"}, "types": {"resourceTypeGeneral": "Journal Article"}}}, {"attributes": {"doi": "10.1234/e", "titles": [{"title": "D"}], "types": {"resourceTypeGeneral": "Dataset"}}}]
    got = scan(spark, "datacite", {"data": rows})
    assert [(r["title"], r["publisher"]) for r in got] == [("T", "Pub")]


def test_xml(spark):
    x = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><JournalIssue><PubDate><Year>2015</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T &amp; U</ArticleTitle>
    <Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText Label="END">two</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article>
    <MeshHeadingList><MeshHeading><DescriptorName>Mesh</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1234/x</ArticleId><ArticleId IdType="pmc">PMC9</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""
    r = scan(spark, "pubmed", x)[0]
    assert (r["title"], r["abstract"], r["authors"], r["year"], r["doi"], r["pmcid"], r["is_open_access"], r["keywords"]) == ("T & U", "AIM: one END: two", ["J Doe", "Group"], 2015, "10.1234/x", "PMC9", True, ["mesh"])
    a = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="x"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>T</title><summary>S</summary><published>2021-01-01T00:00:00Z</published><author><name>A B</name></author>
    <link href="http://arxiv.org/pdf/2101.00001v2" title="pdf" rel="related" type="application/pdf"/><category term="cs.CV"/><arxiv:comment>Proceedings of X</arxiv:comment></entry><entry><id>bad</id><title>E</title></entry></feed>"""
    got = scan(spark, "arxiv", a)
    assert [(r["arxiv_id"], r["topics"], r["pdf_url"], r["conference"], r["year"]) for r in got] == [("2101.00001v2", ["cs.CV"], "http://arxiv.org/pdf/2101.00001v2", "Proceedings of X", 2021)]


def test_bad_payloads(spark):
    x = spark.createDataFrame([("",), ("{oops",), ('{"results": []}',)], "payload string")
    assert sorted(r.error for r in mappers.bad_payloads(x).collect()) == ["empty", "invalid json"]
    assert mappers.scan(x, "doaj").count() == 0


def test_grammar(spark):
    q = spark.createDataFrame([('A "quoted" title', ["Doe"], None, None, None), (None, None, ["ai", "nets"], None, None), (None, None, None, "10.1234/X", None), (None, None, None, None, None)], "title string, authors array<string>, keywords array<string>, doi string, free_text string")
    got = lambda s: [r.e for r in q.select(grammar.expression(s).alias("e")).collect()]
    assert got("doaj") == ['bibjson.title:"A \\"quoted\\" title" AND bibjson.author.name:"Doe"', '"ai" AND "nets"', 'doi:"10.1234/x"', None]
    assert got("pubmed") == ["A quoted title[Title] AND Doe[Author]", "ai[All Fields] AND nets[All Fields]", "10.1234/x[DOI]", None]
    assert got("openalex")[:2] == ['filter=title.search:A "quoted" title,raw_author_name.search:Doe', "search=ai nets"]
    assert got("semanticScholar")[:2] == ['A "quoted" title Doe', "ai nets"]
    assert q.limit(1).select(grammar.query_string([("a", F.lit("x y")), ("b", F.lit(None).cast("string")), ("c", F.lit(""))]).alias("s")).first().s == "a=x+y"


def test_registry_and_live(spark):
    s = {(r.role, r.source_key): r.available for r in registry.sources(spark).collect()}
    assert s[("primary", "core")] is False and s[("primary", "arxiv")] is True and s[("fulltext", "unpaywall")] is False
    assert live.allowed("https://api.crossref.org/works") and not live.allowed("http://api.crossref.org/") and not live.allowed("https://evil.example/")
    assert live.fetch("https://evil.example/") == (None, "blocked")
    assert live.wait_ms(3, 500, 2000) == 2000 and live.wait_ms(0, 500, 2000, 900) == 900


def test_unpaywall(spark):
    rows = [
        ("10.1234/A", True, ("https://x.org/p", None, None, "publisher", None), [("https://r.org/p", "https://r.org/p.pdf", None, "repository", "cc-by")]),
        ("10.1234/b", True, ("http://10.0.0.1/p", None, "https://y.org/l", "publisher", None), None), ("10.1234/c", False, None, None), ("10.1234/d", True, None, []),
    ]
    got = {r.doi: (r.url, r.type, r.access_type, r.license) for r in mappers.map_unpaywall(spark.createDataFrame(rows, mappers.UNPAYWALL)).collect()}
    assert got == {"10.1234/a": ("https://r.org/p.pdf", "pdf", "repository", "cc-by"), "10.1234/b": ("https://y.org/l", "html", "open-access", None)}
