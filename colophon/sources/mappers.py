"""Raw payload rows (explicit schemas) -> the paper schema, one projection per source.

Bronze is what ``spark.read.json``/``spark.read.xml`` or ``from_json``/``from_xml`` give with the schema named here; silver is
``build_paper`` of a mapping, so rules for blanks, links and counts live in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.authors import clean_authors
from ..functions.core import blank_to_null, js_trim, let
from ..functions.identifiers import normalize_arxiv_id, normalize_doi, normalize_openalex_id, trailing_id
from ..functions.text import clean_text, clean_year, normalize_keywords
from ..functions.urls import looks_like_pdf, sanitize_external_link
from ..schemas import LINK, PAPER_COLUMNS

STRINGS = "array<string>"
PDF_NAME = r"(?i)\.pdf(?:$|\?)"
# Resource types that hold text.
TEXTUAL = "text preprint journalarticle conferencepaper report dissertation book bookchapter".split()

DOAJ = (
    "id string, bibjson struct<title:string,abstract:string,year:string,author:array<struct<name:string>>,identifier:array<struct<type:string,id:string>>,"
    "journal:struct<title:string,publisher:string>,keywords:array<string>,subject:array<struct<term:string>>,link:array<struct<type:string,content_type:string,url:string>>>"
)
CORE = (
    "id string, title string, doi string, abstract string, yearPublished string, publishedDate string, authors array<struct<name:string>>, journals array<struct<title:string>>, publisher string, "
    "downloadUrl string, sourceFulltextUrls array<string>, links array<struct<type:string,url:string>>, subjects array<string>, fieldsOfStudy array<string>, citationCount bigint"
)
SEMANTIC_SCHOLAR = (
    "paperId string, title string, abstract string, year int, venue string, url string, isOpenAccess boolean, citationCount bigint, externalIds struct<DOI:string,ArXiv:string,PubMed:string,PubMedCentral:string>, "
    "publicationVenue struct<name:string,type:string,publisher:string>, publicationTypes array<string>, authors array<struct<name:string>>, fieldsOfStudy array<string>, "
    "s2FieldsOfStudy array<struct<category:string>>, openAccessPdf struct<url:string>"
)
_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    f"DOI string, title array<string>, `short-title` array<string>, abstract string, author array<struct<given:string,family:string,name:string>>, issued {_DATE}, published {_DATE}, `published-print` {_DATE}, "
    f"`published-online` {_DATE}, type string, `container-title` array<string>, event struct<name:string>, publisher string, subject array<string>, URL string, link array<struct<`content-type`:string,URL:string>>, "
    "`is-referenced-by-count` bigint, reference array<struct<DOI:string>>"
)
OPENALEX = (
    "id string, doi string, title string, display_name string, publication_year int, publication_date string, type string, ids struct<doi:string,pmid:string,pmcid:string>, "
    "authorships array<struct<author:struct<display_name:string>,raw_author_name:string>>, primary_location struct<landing_page_url:string,source:struct<display_name:string,type:string,host_organization_name:string>>, "
    "best_oa_location struct<landing_page_url:string,pdf_url:string>, open_access struct<is_oa:boolean,oa_url:string>, cited_by_count bigint, topics array<struct<display_name:string>>, "
    "concepts array<struct<display_name:string,score:double>>, keywords array<struct<display_name:string,keyword:string>>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>, related_works array<string>"
)
EUROPE_PMC = (
    "id string, title string, abstractText string, doi string, pmid string, pmcid string, pubYear string, authorString string, authorList struct<author:array<struct<fullName:string,firstName:string,lastName:string>>>, "
    "journalInfo struct<yearOfPublication:string,journal:struct<title:string>>, pubTypeList struct<pubType:array<string>>, keywordList struct<keyword:array<string>>, isOpenAccess string, citedByCount bigint, "
    "fullTextUrlList struct<fullTextUrl:array<struct<availability:string,availabilityCode:string,documentStyle:string,url:string>>>"
)
DATACITE = (
    "doi string, titles array<struct<title:string>>, creators array<struct<name:string,givenName:string,familyName:string>>, publisher string, publicationYear int, "
    "descriptions array<struct<description:string,descriptionType:string>>, subjects array<struct<subject:string>>, types struct<resourceTypeGeneral:string,resourceType:string,citeproc:string>, url string, contentUrl array<string>"
)
_LOCATION = "struct<url:string,url_for_pdf:string,url_for_landing_page:string,host_type:string,license:string>"
UNPAYWALL = f"doi string, is_oa boolean, best_oa_location {_LOCATION}, oa_locations array<{_LOCATION}>"
PUBMED = (
    "MedlineCitation struct<PMID:string,Article:struct<Journal:struct<Title:string,ISOAbbreviation:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,ArticleTitle:string,"
    "Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string>>>,ArticleDate:struct<Year:string>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>,KeywordList:array<struct<Keyword:array<string>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)
ARXIV = (
    "id string, title string, summary string, published string, doi string, journal_ref string, comment string, author array<struct<name:string>>, "
    "link array<struct<_href:string,_title:string,_type:string,_rel:string>>, category array<struct<_term:string>>"
)


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _arr(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array())


def _list(c: Column) -> Column:
    """Empty lists become NULL."""
    return F.when(F.size(c) > 0, c)


def first_where(arr: Column, test) -> Column:
    return F.try_element_at(F.filter(arr, test), F.lit(1))


def _texts(arr: Column, get=lambda x: x) -> Column:
    return F.array_compact(F.transform(arr, lambda x: clean_text(get(x))))


def _doi_link(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def build_paper(rows: DataFrame, source: str, match_type: str = "keyword", keep: tuple[str, ...] = (), **fields: Column) -> DataFrame:
    """One row per record with a title: texts stripped, blanks NULL, unsafe links and negative counts dropped, provenance seeded.

    ``keep`` names further columns to carry. A missing field is NULL, a NULL author list is []."""
    g = lambda n, kind="string": fields.get(n, _null(kind))
    x = rows.select(
        *keep,
        clean_text(g("title")).alias("title"),
        F.coalesce(g("authors", STRINGS), F.array().cast(STRINGS)).alias("authors"),
        clean_text(g("abstract")).alias("abstract"),
        g("doi").alias("doi"),
        g("year", "int").cast("int").alias("year"),
        *[clean_text(g(n)).alias(n) for n in ("journal", "conference", "publisher")],
        _list(g("keywords", STRINGS)).alias("keywords"),
        F.lit(source).alias("source"),
        *[let(g(n).cast("string"), blank_to_null).alias(n) for n in ("source_id", "pmid", "pmcid", "arxiv_id")],
        sanitize_external_link(g("landing_page_url")).alias("landing_page_url"),
        sanitize_external_link(g("pdf_url")).alias("pdf_url"),
        g("is_open_access", "boolean").alias("is_open_access"),
        F.lit(match_type).alias("match_type"),
        F.lit(0.0).alias("confidence"),
        _null("double").alias("similarity_score"),
        F.array(F.lit(source)).alias("sources"),
        let(g("citation_count", "bigint"), lambda n: F.when(n >= 0, n)).cast("bigint").alias("citation_count"),
        _list(g("topics", STRINGS)).alias("topics"),
        _list(g("reference_ids", STRINGS)).alias("reference_ids"),
    ).where("title is not null")
    link = F.array(F.struct("source", "landing_page_url", "pdf_url", "source_id")).cast(f"array<{LINK}>")
    return x.withColumn("source_links", link).select(*keep, *PAPER_COLUMNS)


def map_doaj(rows: DataFrame, year: int = 2026) -> DataFrame:
    b = lambda n: F.col(f"bibjson.{n}")
    doi = normalize_doi(first_where(_arr(b("identifier")), lambda i: F.lower(i["type"]) == "doi")["id"])
    full = first_where(_arr(b("link")), lambda x: F.lower(x["type"]) == "fulltext")["url"]
    pdf = first_where(_arr(b("link")), lambda x: (F.lower(x["content_type"]) == "pdf") | F.regexp_like(x["url"], F.lit(PDF_NAME)))["url"]
    return build_paper(
        rows.where("bibjson is not null"), "DOAJ", title=b("title"), authors=clean_authors(F.transform(_arr(b("author")), lambda a: a["name"])), abstract=b("abstract"), doi=doi,
        year=clean_year(b("year"), year), journal=b("journal.title"), publisher=b("journal.publisher"), keywords=normalize_keywords(b("keywords")), source_id=F.col("id"),
        landing_page_url=F.coalesce(full, _doi_link(doi)), pdf_url=pdf, is_open_access=F.lit(True), topics=_texts(_arr(b("subject")), lambda s: s["term"]),
    )


def map_core(rows: DataFrame, year: int = 2026) -> DataFrame:
    doi = normalize_doi("doi")
    urls = _arr("sourceFulltextUrls")
    pdf = F.coalesce("downloadUrl", first_where(urls, lambda u: F.regexp_like(u, F.lit(PDF_NAME))), F.try_element_at(urls, F.lit(1)))
    landing = F.coalesce(
        first_where(_arr("links"), lambda x: F.lower(x["type"]) == "display")["url"], _doi_link(doi), F.concat(F.lit("https://core.ac.uk/works/"), "id")
    )
    topics = F.slice(_texts(F.concat(_arr("fieldsOfStudy").cast(STRINGS), _arr("subjects").cast(STRINGS))), 1, 20)
    return build_paper(
        rows, "CORE", title=F.col("title"), authors=clean_authors(F.transform(_arr("authors"), lambda a: a["name"])), abstract=F.col("abstract"), doi=doi,
        year=clean_year(F.coalesce("yearPublished", "publishedDate"), year), journal=F.try_element_at(_arr("journals"), F.lit(1))["title"], publisher=F.col("publisher"),
        keywords=normalize_keywords("subjects"), source_id=F.col("id"), landing_page_url=landing, pdf_url=pdf, is_open_access=F.when(pdf.isNotNull(), F.lit(True)),
        citation_count=F.col("citationCount"), topics=topics,
    )


def map_semantic_scholar(rows: DataFrame, year: int = 2026, match_type: str = "keyword") -> DataFrame:
    doi = normalize_doi("externalIds.DOI")
    raw = clean_text("externalIds.PubMedCentral")
    pmcid = let(raw, lambda v: F.when(F.startswith(F.upper(v), F.lit("PMC")), v).otherwise(F.concat(F.lit("PMC"), v)))
    venue = clean_text(F.coalesce("publicationVenue.name", "venue"))
    conference = F.coalesce(F.lower("publicationVenue.type") == "conference", F.lit(False)) | F.exists(_arr("publicationTypes").cast(STRINGS), lambda t: F.lower(t) == "conference")
    conference = F.coalesce(conference, F.lit(False))
    topics = F.array_distinct(_texts(F.concat(_arr("fieldsOfStudy").cast(STRINGS), F.transform(_arr("s2FieldsOfStudy"), lambda f: f["category"]))))
    return build_paper(
        rows, "Semantic Scholar", match_type, title=F.col("title"), authors=clean_authors(F.transform(_arr("authors"), lambda a: a["name"])), abstract=F.col("abstract"), doi=doi,
        year=clean_year("year", year), journal=F.when(~conference, venue), conference=F.when(conference, venue), publisher=F.col("publicationVenue.publisher"), keywords=normalize_keywords(topics),
        source_id=F.col("paperId"), pmid=clean_text("externalIds.PubMed"), pmcid=pmcid, arxiv_id=clean_text("externalIds.ArXiv"), landing_page_url=F.coalesce("url", _doi_link(doi)),
        pdf_url=F.col("openAccessPdf.url"), is_open_access=F.coalesce("isOpenAccess", F.when(blank_to_null(F.col("openAccessPdf.url")).isNotNull(), F.lit(True))),
        citation_count=F.col("citationCount"), topics=topics,
    )


def map_crossref(rows: DataFrame, year: int = 2026) -> DataFrame:
    doi = normalize_doi("DOI")
    title = F.coalesce(first_where(_arr("title").cast(STRINGS), lambda t: js_trim(t) != ""), F.try_element_at(_arr("`short-title`").cast(STRINGS), F.lit(1)))
    people = F.transform(
        _arr("author"), lambda a: F.coalesce(blank_to_null(a["name"]), F.when((a["family"] != "") & (a["given"] != ""), F.concat_ws(" ", a["given"], a["family"])), blank_to_null(a["family"]))
    )
    first = lambda c: clean_year(F.try_element_at(F.try_element_at(F.col(f"`{c}`.`date-parts`"), F.lit(1)), F.lit(1)), year)
    talk = F.coalesce(F.col("type") == "proceedings-article", F.lit(False))
    container = F.try_element_at(_arr("`container-title`").cast(STRINGS), F.lit(1))
    pdf = first_where(_arr("link"), lambda x: (F.lower(x["content-type"]) == "application/pdf") & x["URL"].isNotNull())["URL"]
    return build_paper(
        rows, "Crossref", title=title, authors=clean_authors(people), abstract=F.col("abstract"), doi=doi,
        year=F.coalesce(first("issued"), first("published"), first("published-print"), first("published-online")), journal=F.when(~talk, container),
        conference=F.when(talk, F.coalesce("event.name", container)), publisher=F.col("publisher"), keywords=normalize_keywords("subject"), source_id=doi, landing_page_url=F.coalesce("URL", _doi_link(doi)),
        pdf_url=pdf, citation_count=F.col("`is-referenced-by-count`"), topics=_texts(_arr("subject").cast(STRINGS)),
        reference_ids=F.slice(F.array_compact(F.transform(_arr("reference"), lambda r: normalize_doi(r["DOI"]))), 1, 100),
    )


def reconstruct_abstract(index: Column | str, most: int = 20_000) -> Column:
    """Text of an inverted index: the last word given for a position stands, positions without a word are skipped."""
    c = F.col(index) if isinstance(index, str) else index
    spots = F.flatten(
        F.transform(F.map_entries(c), lambda e, i: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: p.between(0, most)), lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))))
    )
    kept = lambda s: F.filter(s, lambda x, k: (k == F.size(s) - 1) | (F.try_element_at(s, (k + 2).cast("int"))["p"] != x["p"]))
    text = let(F.array_sort(spots), lambda s: js_trim(F.array_join(F.transform(kept(s), lambda x: blank_to_null(x["w"])), " ")))
    return let(text, blank_to_null)


def map_openalex(rows: DataFrame, year: int = 2026, match_type: str = "keyword") -> DataFrame:
    doi = normalize_doi(F.coalesce("doi", "ids.doi"))
    venue = clean_text("primary_location.source.display_name")
    talk = F.coalesce((F.col("type") == "proceedings-article") | (F.col("primary_location.source.type") == "conference"), F.lit(False))
    concepts = F.filter(_arr("concepts"), lambda k: F.coalesce(k["score"], F.lit(0.0)) >= 0.3)
    topics = _texts(F.concat(F.transform(_arr("topics"), lambda t: t["display_name"]), F.transform(concepts, lambda k: k["display_name"])))
    words = _texts(_arr("keywords"), lambda k: F.coalesce(k["display_name"], k["keyword"]))
    pmcid = let(F.upper(trailing_id("ids.pmcid")), lambda v: F.when(F.startswith(v, F.lit("PMC")), v).otherwise(F.concat(F.lit("PMC"), v)))
    oa, best = F.col("open_access.oa_url"), F.col("best_oa_location.pdf_url")
    return build_paper(
        rows, "OpenAlex", match_type, title=F.coalesce("title", "display_name"), authors=clean_authors(F.transform(_arr("authorships"), lambda a: F.coalesce(a["author"]["display_name"], a["raw_author_name"]))),
        abstract=reconstruct_abstract("abstract_inverted_index"), doi=doi, year=clean_year(F.coalesce(F.col("publication_year").cast("string"), "publication_date"), year), journal=F.when(~talk, venue), conference=F.when(talk, venue),
        publisher=F.col("primary_location.source.host_organization_name"), keywords=let(F.struct(words.alias("w"), topics.alias("t")), lambda s: normalize_keywords(F.when(F.size(s["w"]) > 0, s["w"]).otherwise(s["t"]))),
        source_id=normalize_openalex_id("id"), pmid=trailing_id("ids.pmid"), pmcid=pmcid,
        landing_page_url=F.coalesce("best_oa_location.landing_page_url", "primary_location.landing_page_url", F.when(~looks_like_pdf(oa), oa), _doi_link(doi)),
        pdf_url=F.when(looks_like_pdf(best), best).when(looks_like_pdf(oa), oa), is_open_access=F.col("open_access.is_oa"), citation_count=F.col("cited_by_count"),
        topics=F.slice(F.array_distinct(topics), 1, 20), reference_ids=F.slice(F.array_compact(F.transform(_arr("referenced_works").cast(STRINGS), normalize_openalex_id)), 1, 100),
    )


def map_europe_pmc(rows: DataFrame, year: int = 2026) -> DataFrame:
    doi, pmcid = normalize_doi("doi"), F.upper(blank_to_null(F.col("pmcid")))
    listed = F.transform(_arr("authorList.author"), lambda a: F.coalesce(a["fullName"], F.concat_ws(" ", a["firstName"], a["lastName"])))
    authors = F.when(F.size(listed) > 0, listed).otherwise(F.split(F.coalesce("authorString", F.lit("")), ","))
    links = _arr("fullTextUrlList.fullTextUrl")
    free = F.filter(links, lambda x: F.coalesce(x["availabilityCode"] == "OA", F.lit(False)) | F.coalesce(F.regexp_like(x["availability"], F.lit("(?i)open access")), F.lit(False)))
    style = lambda arr, s: first_where(arr, lambda x: F.lower(x["documentStyle"]) == s)["url"]
    preprint = F.exists(_arr("pubTypeList.pubType").cast(STRINGS), lambda t: F.regexp_like(t, F.lit("(?i)preprint")))
    landing = F.coalesce(style(free, "html"), style(links, "doi"), F.concat(F.lit("https://europepmc.org/article/PMC/"), pmcid), _doi_link(doi))
    return build_paper(
        rows, "Europe PMC", title=F.col("title"), authors=clean_authors(authors), abstract=F.col("abstractText"), doi=doi, year=clean_year(F.coalesce("pubYear", "journalInfo.yearOfPublication"), year),
        journal=F.col("journalInfo.journal.title"), publisher=F.when(preprint, F.lit("Preprint")), keywords=normalize_keywords("keywordList.keyword"), source_id=F.col("id"), pmid=clean_text("pmid"), pmcid=pmcid,
        landing_page_url=landing, pdf_url=style(free, "pdf"), is_open_access=F.when(F.col("isOpenAccess") == "Y", F.lit(True)).when(F.col("isOpenAccess") == "N", F.lit(False)), citation_count=F.col("citedByCount"),
    )


def datacite_publisher(c: Column | str) -> Column:
    """The publisher is a string or an object with a name."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(F.startswith(F.ltrim(v), F.lit("{")), F.try_variant_get(F.try_parse_json(v), "$.name", "string")).otherwise(v)


def map_datacite(rows: DataFrame, year: int = 2026) -> DataFrame:
    bare = lambda c: F.lower(F.regexp_replace(F.col(c), r"\s+", ""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    textual = yes(bare("types.resourceTypeGeneral").isin(*TEXTUAL)) | yes(bare("types.resourceType").isin(*TEXTUAL)) | yes(F.col("types.citeproc") == "article-journal")
    people = F.transform(_arr("creators"), lambda p: F.coalesce(p["name"], F.concat_ws(" ", p["givenName"], p["familyName"])))
    pdf = F.coalesce(first_where(_arr("contentUrl").cast(STRINGS), lambda u: F.regexp_like(u, F.lit(PDF_NAME))), F.when(F.regexp_like("url", F.lit(PDF_NAME)), F.col("url")))
    return build_paper(
        rows.where(textual), "DataCite", title=first_where(_arr("titles"), lambda t: js_trim(t["title"]) != "")["title"], authors=clean_authors(people),
        abstract=first_where(_arr("descriptions"), lambda x: F.lower(x["descriptionType"]) == "abstract")["description"], doi=normalize_doi("doi"), year=clean_year("publicationYear", year),
        publisher=datacite_publisher("publisher"), keywords=normalize_keywords(F.transform(_arr("subjects"), lambda s: s["subject"])), source_id=normalize_doi("doi"), landing_page_url=F.col("url"), pdf_url=pdf,
    )


def map_pubmed(rows: DataFrame, year: int = 2026) -> DataFrame:
    a = lambda n: F.col(f"MedlineCitation.Article.{n}")
    ident = lambda kind: first_where(_arr("PubmedData.ArticleIdList.ArticleId"), lambda i: (F.lower(i["_IdType"]) == kind) & (i["_VALUE"] != ""))["_VALUE"]
    doi, pmcid, pmid = normalize_doi(ident("doi")), ident("pmc"), blank_to_null(F.col("MedlineCitation.PMID"))
    parts = F.transform(
        F.filter(_arr(a("Abstract.AbstractText")), lambda t: js_trim(t["_VALUE"]) != ""), lambda t: F.concat(F.coalesce(F.concat(blank_to_null(t["_Label"]), F.lit(": ")), F.lit("")), t["_VALUE"])
    )
    people = F.transform(
        _arr(a("AuthorList.Author")),
        lambda p: F.coalesce(blank_to_null(p["CollectiveName"]), F.when(p["LastName"] != "", F.concat_ws(" ", F.coalesce(blank_to_null(p["ForeName"]), blank_to_null(p["Initials"])), p["LastName"]))),
    )
    terms = F.concat(
        F.transform(_arr("MedlineCitation.MeshHeadingList.MeshHeading"), lambda h: h["DescriptorName"]), F.flatten(F.transform(_arr("MedlineCitation.KeywordList"), lambda k: F.coalesce(k["Keyword"], F.array().cast(STRINGS))))
    )
    pub = lambda n: clean_year(a(f"Journal.JournalIssue.PubDate.{n}"), year)
    landing = F.coalesce(
        F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid, F.lit("/")), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")), _doi_link(doi)
    )
    return build_paper(
        rows.where("MedlineCitation.Article is not null"), "PubMed Central", title=a("ArticleTitle"), authors=clean_authors(people), abstract=F.array_join(parts, " "), doi=doi,
        year=F.coalesce(pub("Year"), pub("MedlineDate"), clean_year(a("ArticleDate.Year"), year)), journal=F.coalesce(a("Journal.Title"), a("Journal.ISOAbbreviation")), keywords=normalize_keywords(terms), source_id=pmid,
        pmid=pmid, pmcid=pmcid, landing_page_url=landing, is_open_access=F.when(pmcid.isNotNull(), F.lit(True)),
    )


def map_arxiv(rows: DataFrame, year: int = 2026) -> DataFrame:
    ident = normalize_arxiv_id("id")
    link = lambda test: F.try_element_at(F.reverse(F.filter(_arr("link"), lambda x: x["_href"].isNotNull() & F.coalesce(test(x), F.lit(False)))), F.lit(1))["_href"]
    is_pdf = lambda x: F.coalesce(F.lower(x["_title"]) == "pdf", F.lit(False)) | F.coalesce(F.lower(x["_type"]) == "application/pdf", F.lit(False))
    meeting = F.when(F.regexp_like("comment", F.lit("(?i)conference|proceedings|workshop|symposium")), F.col("comment"))
    return build_paper(
        rows.where(ident.isNotNull()), "arXiv", title=F.col("title"), authors=clean_authors(F.transform(_arr("author"), lambda p: p["name"])), abstract=F.col("summary"), doi=normalize_doi("doi"), year=clean_year("published", year),
        journal=F.col("journal_ref"), conference=meeting, publisher=F.lit("arXiv"), source_id=ident, arxiv_id=ident,
        landing_page_url=F.coalesce(link(lambda x: ~is_pdf(x) & (x["_rel"] == "alternate")), F.concat(F.lit("https://arxiv.org/abs/"), ident)),
        pdf_url=F.coalesce(link(is_pdf), F.concat(F.lit("https://arxiv.org/pdf/"), ident)), is_open_access=F.lit(True), topics=F.array_compact(F.transform(_arr("category"), lambda k: k["_term"])),
    )


def map_unpaywall(rows: DataFrame) -> DataFrame:
    """(doi, FULLTEXT): the open location of a DOI, the first with a PDF, else the first with a page; none for closed works."""
    places = F.array_compact(F.concat(F.array("best_oa_location"), _arr("oa_locations")))
    pdf = first_where(places, lambda p: sanitize_external_link(p["url_for_pdf"]).isNotNull())
    page = first_where(places, lambda p: F.coalesce(sanitize_external_link(p["url_for_landing_page"]), sanitize_external_link(p["url"])).isNotNull())
    x = rows.where("is_oa").select(normalize_doi("doi").alias("doi"), pdf.alias("pdf"), page.alias("page")).withColumn("at", F.coalesce("pdf", "page")).where("at is not null")
    link = F.coalesce(sanitize_external_link("pdf.url_for_pdf"), sanitize_external_link("at.url_for_landing_page"), sanitize_external_link("at.url"))
    return x.select(
        "doi", F.lit("Unpaywall").alias("source"), F.lit(True).alias("available"), link.alias("url"), F.when(F.col("pdf").isNotNull(), "pdf").otherwise("html").alias("type"),
        F.when(F.col("at.host_type") == "repository", "repository").otherwise("open-access").alias("access_type"), F.col("at.license").alias("license"),
    )


# key -> (schema of a raw row, where the rows lie in the payload, mapping)
JSON_SOURCES = {
    "doaj": (DOAJ, "results", map_doaj), "core": (CORE, "results", map_core), "semanticScholar": (SEMANTIC_SCHOLAR, "data", map_semantic_scholar),
    "crossref": (CROSSREF, "message.items", map_crossref), "openalex": (OPENALEX, "results", map_openalex), "europepmc": (EUROPE_PMC, "resultList.result", map_europe_pmc),
    "datacite": (DATACITE, "data.attributes", map_datacite),
}
XML_SOURCES = {"pubmed": (PUBMED, "PubmedArticle", map_pubmed), "arxiv": (ARXIV, "entry", map_arxiv)}


def payload_rows(payloads: DataFrame, source: str, column: str = "payload") -> DataFrame:
    """Rows of raw JSON responses; a payload that can't be parsed gives none (see ``bad_payloads``)."""
    schema, path, _ = JSON_SOURCES[source]
    names = path.split(".")
    kind = ArrayType(_struct(schema))
    if source == "datacite":
        shape = StructType([StructField("data", ArrayType(StructType([StructField("attributes", kind.elementType)])))])
        items = F.transform(F.from_json(column, shape)["data"], lambda d: d["attributes"])
    else:
        for n in reversed(names):
            kind = StructType([StructField(n, kind)])
        items = F.from_json(column, kind)
        for n in names:
            items = items[n]
    return payloads.select(F.explode(items).alias("row")).select("row.*")


def _struct(schema: str) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema)


def bad_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads that are empty or no JSON, with the reason."""
    reason = F.when(F.trim(F.coalesce(column, F.lit(""))) == "", F.lit("empty")).when(F.try_parse_json(column).isNull(), F.lit("invalid json"))
    return payloads.withColumn("error", reason).where("error is not null")


def xml_rows(payloads: DataFrame, source: str, column: str = "payload") -> DataFrame:
    """Rows of raw XML documents by the row tag; entities and CDATA are resolved by the parser, external ones never."""
    schema, tag, _ = XML_SOURCES[source]
    pieces = F.regexp_extract_all(F.regexp_replace(column, r"(?s)<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", ""), F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))
    plain = F.regexp_replace("piece", r"(</?)[A-Za-z]+:([A-Za-z_]+)", "$1$2")
    return payloads.select(F.explode(pieces).alias("piece")).select(F.from_xml(plain, schema, {"rowTag": tag, "attributePrefix": "_", "valueTag": "_VALUE"}).alias("row")).where("row is not null").select("row.*")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored response file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def scan(payloads: DataFrame, source: str, year: int = 2026) -> DataFrame:
    """Raw responses of a source -> papers."""
    if source in XML_SOURCES:
        return XML_SOURCES[source][2](xml_rows(payloads, source), year)
    return JSON_SOURCES[source][2](payload_rows(payloads, source), year)

