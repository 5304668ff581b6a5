"""All queries of the core library over the driver's tables, with their DuckDB twins.

Keys start with the handle of the operator they exercise. Where SQL can't say an operator, or would be too slow on whole
tables, there is no twin and the tests hold the query against brute force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from . import twins
from .config import DEFAULT
from .functions import authors as A
from .functions import identifiers as I
from .functions import similarity as S
from .functions import text as T
from .functions import urls as U
from .functions.core import capped, ordered_distinct, round_score
from .operators import dedup, fulltext, ranking, status, traffic, validate
from .operators.components import connected_components
from .operators.prepare import prepare_papers, prepare_queries
from .plans import connectors, engine
from .session import cut, spread, sweep
from .session import table as read_table
from .sources import grammar, mappers
from .sources import registry as dimension

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
YEAR = DEFAULT.as_of_year


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Texts are long work, so a table in one small file is spread before they are worked on."""
    x = read_table(spark, sf_dir, name)
    return spread(x) if name in ("papers", "build_inputs", "repository_items", "documents") else x


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _joined(arr):
    return F.array_join(arr, "|")


# Text and identifiers ------------------------------------------------------------------------------------


@query(f"SELECT record_id, {O.strip_markup('title')} AS title, {O.strip_markup('abstract')} AS abstract FROM papers")
def t04_strip_markup(s, d):
    return table(s, d, "papers").select("record_id", T.strip_markup("title").alias("title"), T.strip_markup("abstract").alias("abstract"))


@query(f"SELECT record_id, CASE WHEN t <> '' THEN t END AS title FROM (SELECT record_id, {O.strip_markup('title')} AS t FROM papers)")
def proj02_clean_text(s, d):
    return table(s, d, "papers").select("record_id", T.clean_text("title").alias("title"))


@query(f"SELECT record_id, {O.normalize_title('title')} AS n_title FROM papers")
def t05_normalize_title(s, d):
    return table(s, d, "papers").select("record_id", T.normalize_title("title").alias("n_title"))


@query(
    f"WITH n AS (SELECT record_id, {O.normalize_title('title', False)} AS v FROM papers) SELECT record_id, replace({O.bare('v')}, ' ', '') AS fingerprint FROM n"
)
def t06_fingerprint(s, d):
    return table(s, d, "papers").select("record_id", T.title_fingerprint("title").alias("fingerprint"))


@query(
    f"WITH n AS (SELECT {O.normalize_title('title')} AS v FROM papers), b AS (SELECT {O.bare('v')} AS v FROM n) "
    "SELECT t AS token, count(*) AS n FROM (SELECT unnest(string_split(v, ' ')) AS t FROM b) WHERE t <> '' GROUP BY t"
)
def t06_title_tokens(s, d):
    return table(s, d, "papers").select(F.explode(T.title_tokens("title")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT record_id, {O.normalize_doi('doi')} AS doi FROM papers")
def t01_doi(s, d):
    return table(s, d, "papers").select("record_id", I.normalize_doi("doi").alias("doi"))


@query(
    f"WITH r AS (SELECT input_id, unnest(reference_ids) AS raw FROM build_inputs), n AS (SELECT input_id, {O.normalize_doi('raw')} AS doi FROM r) "
    "SELECT input_id, count(*) AS listed, count(doi) AS usable, count(DISTINCT doi) AS different FROM n GROUP BY input_id"
)
def t01_reference_dois(s, d):
    x = table(s, d, "build_inputs").select("input_id", F.explode("reference_ids").alias("raw")).withColumn("doi", I.normalize_doi("raw"))
    return x.groupBy("input_id").agg(F.count("*").alias("listed"), F.count("doi").alias("usable"), F.countDistinct("doi").alias("different"))


@query(
    f"WITH n AS (SELECT p.record_id, i.item_id, {O.normalize_doi('p.doi')} AS a, i.d AS b FROM papers p JOIN (SELECT item_id, {O.normalize_doi('doi')} AS d, doi FROM repository_items) i ON i.d = {O.normalize_doi('p.doi')}) "
    "SELECT record_id, item_id, 'https://doi.org/' || a AS url FROM n"
)
def t02_doi_equals(s, d):
    p = table(s, d, "papers").select("record_id", I.normalize_doi("doi").alias("k"), I.doi_to_url("doi").alias("url"))
    i = table(s, d, "repository_items").where(I.is_valid_doi("doi")).select("item_id", I.normalize_doi("doi").alias("k"))
    return p.join(i, "k").select("record_id", "item_id", "url")


@query(f"WITH x AS (SELECT doc_id, nullif(regexp_extract(text, {O.q('(?i)' + I.DOI_BODY)}, 0), '') AS raw FROM documents) SELECT doc_id, {O.normalize_doi('raw')} AS doi FROM x")
def t03_extract_doi(s, d):
    return table(s, d, "documents").select("doc_id", I.extract_doi("text").alias("doi"))


@query(
    f"WITH k AS (SELECT record_id, unnest(keywords) AS raw FROM papers), p AS (SELECT record_id, unnest(regexp_split_to_array({O.strip_markup('raw')}, '[;,|]')) AS part FROM k), "
    f"n AS (SELECT record_id, {O.normalize_title('part')} AS v FROM p), c AS (SELECT record_id, CASE WHEN length(v) > 120 THEN trim(substr(v, 1, 120)) WHEN NOT list_contains({O.STOP}, v) THEN v END AS v FROM n) "
    "SELECT record_id, string_agg(v, '|' ORDER BY v) AS keywords FROM (SELECT DISTINCT record_id, v FROM c WHERE v <> '') GROUP BY record_id"
)
def t08_keywords(s, d):
    x = table(s, d, "papers").select("record_id", T.normalize_keywords("keywords").alias("k")).where(F.size("k") > 0)
    return x.select("record_id", _joined(F.array_sort("k")).alias("keywords"))


@query(
    f"WITH k AS (SELECT input_id, unnest(topics) AS raw FROM build_inputs), n AS (SELECT input_id, {O.normalize_title('raw')} AS v FROM k), w AS (SELECT input_id, unnest({O.words('v')}) AS w FROM n) "
    "SELECT input_id, count(DISTINCT w) AS words FROM w GROUP BY input_id"
)
def t09_keyword_tokens(s, d):
    plain = F.transform("topics", lambda t: T.normalize_title(t))
    x = table(s, d, "build_inputs").select("input_id", F.size(T.keyword_tokens(plain)).cast("bigint").alias("words"))
    return x.where("words > 0")


_TOKENS = "list_filter(string_split(regexp_replace({}, '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '' and not list_contains([" + ", ".join(f"'{w}'" for w in A.SUFFIXES) + "], t))"
_PART = "|".join(A.PARTICLES)


def _author_sql(source: str) -> str:
    tok = lambda e: _TOKENS.format(f"lower({O.fold(e)})")
    return (
        f"WITH r AS (SELECT DISTINCT trim(a) AS raw FROM ({source}) WHERE trim(a) <> ''), s AS (SELECT raw, instr(raw, ',') AS c FROM r), "
        f"t AS (SELECT raw, c, CASE WHEN c > 1 THEN {tok('substr(raw, 1, c - 1)')} END AS s0, CASE WHEN c > 1 THEN {tok('substr(raw, c + 1)')} END AS g0, CASE WHEN c <= 1 THEN {tok('raw')} END AS w FROM s), "
        "j AS (SELECT *, array_to_string(w, ' ') AS line, len(w) AS n FROM t), "
        f"v AS (SELECT raw, CASE WHEN c > 1 THEN s0 WHEN n <= 1 THEN w WHEN length(w[n]) <= 2 AND length(w[1]) > 2 THEN w[1:n-1] ELSE string_split(regexp_extract(line, '(?:^| )((?:(?:{_PART}) )*[a-z]+)$', 1), ' ') END AS sur, "
        f"CASE WHEN c > 1 THEN g0 WHEN n <= 1 THEN [] WHEN length(w[n]) <= 2 AND length(w[1]) > 2 THEN [w[n]] ELSE w[1:n - len(string_split(regexp_extract(line, '(?:^| )((?:(?:{_PART}) )*[a-z]+)$', 1), ' '))] END AS giv FROM j), "
        "f AS (SELECT raw, CASE WHEN len(sur) > 0 THEN sur WHEN len(giv) > 0 THEN giv[len(giv):len(giv)] END AS sur, CASE WHEN len(sur) > 0 THEN giv ELSE giv[1:len(giv)-1] END AS giv FROM v) "
        "SELECT raw, array_to_string(list_concat(giv, sur), ' ') AS full_name, array_to_string(sur, ' ') AS last_name, substr(giv[1], 1, 1) AS initial FROM f WHERE sur IS NOT NULL"
    )


@query(_author_sql("SELECT unnest(authors) AS a FROM papers"))
def t10_author(s, d):
    x = table(s, d, "papers").select(F.explode("authors").alias("a")).select(F.trim("a").alias("raw")).where("raw <> ''").distinct()
    return x.withColumn("n", A.normalize_author("raw")).where("n is not null").select("raw", F.col("n.full").alias("full_name"), F.col("n.last").alias("last_name"), F.col("n.first_initial").alias("initial"))


@query()
def t11_authors(s, d):
    """Distinct parsed authors per record, in order."""
    n = A.normalize_authors("authors")
    return table(s, d, "papers").select("record_id", _joined(F.transform(n, lambda a: F.concat_ws("/", a["last"], a["first_initial"]))).alias("authors"), F.size(n).alias("n"))


_PAIRS = (
    f"pr AS (SELECT p.record_id, i.item_id, p.title AS ta, i.title AS tb, p.year AS ya, i.year AS yb FROM (SELECT *, {O.normalize_doi('doi')} AS d FROM papers) p "
    f"JOIN (SELECT *, {O.normalize_doi('doi')} AS d FROM repository_items) i ON p.d = i.d), nt AS (SELECT *, {O.normalize_title('ta')} AS a, {O.normalize_title('tb')} AS b FROM pr)"
)


def _pairs(s, d):
    p = table(s, d, "papers").select("record_id", "title", "year", "authors", I.normalize_doi("doi").alias("k"))
    i = table(s, d, "repository_items").select("item_id", F.col("title").alias("title_b"), F.col("year").alias("year_b"), F.col("authors").alias("authors_b"), I.normalize_doi("doi").alias("k"))
    return p.join(i, "k").withColumn("a", T.normalize_title("title")).withColumn("b", T.normalize_title("title_b"))


@query()
def t12_author_overlap(s, d):
    """Author lists of records and repository items with one DOI, aligned one to one."""
    x = _pairs(s, d).select("record_id", "item_id", A.normalize_authors("authors").alias("x"), A.normalize_authors("authors_b").alias("y"))
    return x.select("record_id", "item_id", round_score(A.author_overlap(F.col("x"), F.col("y"))).alias("overlap"))


@query(
    f"WITH n AS (SELECT record_id, {O.collapse('coalesce(authors[1], ' + chr(39) * 2 + ')')} AS v FROM papers), p AS (SELECT record_id, v, instr(v, ',') AS c FROM n) "
    "SELECT record_id, CASE WHEN c > 1 AND trim(substr(v, 1, c - 1)) <> '' AND trim(substr(v, c + 1)) <> '' THEN trim(substr(v, c + 1)) || ' ' || trim(substr(v, 1, c - 1)) WHEN v <> '' THEN v END AS author FROM p"
)
def t14_display_name(s, d):
    return table(s, d, "papers").select("record_id", A.display_name(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit(""))).alias("author"))


@query(
    f"WITH {_PAIRS}, m AS (SELECT record_id, item_id, greatest(length(a), length(b)) AS n, levenshtein(a, b) AS dist FROM nt) "
    "SELECT record_id, item_id, dist::INT AS distance, CASE WHEN dist <= 5 THEN dist ELSE 6 END::INT AS banded, floor((CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - dist::DOUBLE / n END) * 10000 + 0.5) / 10000 AS edit FROM m"
)
def t15_edit_similarity(s, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(s, d).select("record_id", "item_id", F.levenshtein(a, b).alias("distance"), S.banded_levenshtein(a, b, 5).alias("banded"), round_score(S.levenshtein_similarity(a, b)).alias("edit"))


@query(
    f"WITH {_PAIRS}, t AS (SELECT record_id, item_id, a, b, list_distinct({O.words('a')}) AS x, list_distinct({O.words('b')}) AS y, {O.bigrams('a')} AS g, {O.bigrams('b')} AS h FROM nt), "
    f"c AS (SELECT *, {O.jaccard('x', 'y')} AS j, CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(g, h)) / (len(g) + len(h)) END AS dc, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) END AS ov, "
    "1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1) AS e FROM t), "
    "f AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0::DOUBLE ELSE greatest(0.45::DOUBLE * j + 0.35::DOUBLE * dc + 0.2::DOUBLE * e, CASE WHEN least(length(a), length(b)) >= 20 AND (CASE WHEN length(a) <= length(b) THEN starts_with(b, a) ELSE starts_with(a, b) END) THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END) END AS s FROM c) "
    f"SELECT record_id, item_id, {O.round_score('j')} AS jaccard, {O.round_score('CASE WHEN a = ' + chr(39) * 2 + ' OR b = ' + chr(39) * 2 + ' THEN 0.0 WHEN a = b THEN 1.0 ELSE dc END')} AS dice, {O.round_score('ov')} AS overlap, {O.round_score('s')} AS similarity FROM f"
)
def t21_title_similarity(s, d):
    a, b = F.col("a"), F.col("b")
    x, y = S.content_tokens(a), S.content_tokens(b)
    return _pairs(s, d).select(
        "record_id", "item_id", round_score(S.jaccard(x, y)).alias("jaccard"), round_score(S.dice(a, b)).alias("dice"), round_score(S.overlap_coefficient(x, y)).alias("overlap"), round_score(S.title_similarity(a, b)).alias("similarity")
    )


@query(
    f"WITH n AS (SELECT record_id, {O.normalize_doi('doi')} AS d, {O.normalize_title('abstract')} AS v FROM papers), w AS (SELECT record_id, d, unnest(list_filter(string_split(v, ' '), lambda t: length(t) >= 3 and not list_contains({O.STOP}, t))) AS t FROM n WHERE d IS NOT NULL), "
    "tf AS (SELECT record_id, d, t, count(*) AS c FROM w GROUP BY ALL), nn AS (SELECT record_id, sqrt(sum(c::DOUBLE * c)) AS l FROM tf GROUP BY record_id), "
    "dot AS (SELECT a.record_id AS x, b.record_id AS y, sum(a.c::DOUBLE * b.c) AS s FROM tf a JOIN tf b ON a.d = b.d AND a.t = b.t AND a.record_id < b.record_id GROUP BY ALL) "
    f"SELECT x AS record_a, y AS record_b, {O.round_score('s / (m.l * n.l)')} AS cosine FROM dot JOIN nn m ON m.record_id = x JOIN nn n ON n.record_id = y"
)
def t22_cosine(s, d):
    """Abstracts of records with one DOI. Terms of a bag are joined, so a pair costs its common terms only."""
    p = table(s, d, "papers").select("record_id", I.normalize_doi("doi").alias("k"), T.term_list("abstract").alias("t")).where("k is not null and size(t) > 0")
    tf = cut(p.select("record_id", "k", F.explode("t").alias("t")).groupBy("record_id", "k", "t").agg(F.count("*").cast("double").alias("c")))
    norm = tf.groupBy("record_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l"))
    a, b = (tf.select("k", "t", F.col("record_id").alias(f"record_{n}"), F.col("c").alias(f"c{n}")) for n in "ab")
    dot = a.join(b, ["k", "t"]).where("record_a < record_b").groupBy("record_a", "record_b").agg(F.sum(F.col("ca") * F.col("cb")).alias("s"))
    x = dot.join(norm.withColumnsRenamed({"record_id": "record_a", "l": "la"}), "record_a").join(norm.withColumnsRenamed({"record_id": "record_b", "l": "lb"}), "record_b")
    return x.select("record_a", "record_b", round_score(F.col("s") / (F.col("la") * F.col("lb"))).alias("cosine"))


@query(
    "WITH x AS (SELECT record_id, nullif(regexp_extract(title, '\\(((?:19|20)\\d{2})\\)', 1), '') AS b, nullif(regexp_extract(title, '\\b((?:19|20)\\d{2})\\b', 1), '') AS f FROM papers), y AS (SELECT record_id, try_cast(coalesce(b, f) AS INT) AS y FROM x) "
    f"SELECT record_id, CASE WHEN y BETWEEN 1900 AND {YEAR + 1} THEN y END AS hint FROM y"
)
def t24_year_hint(s, d):
    return table(s, d, "papers").select("record_id", T.year_hint("title", YEAR).alias("hint"))


@query(
    "WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') || CASE WHEN o_orderkey % 3 = 0 THEN ' (revised)' ELSE '' END AS t FROM orders), y AS (SELECT o_orderkey, try_cast(nullif(regexp_extract(t, '(?:1[5-9]\\d{2}|20\\d{2}|21\\d{2})', 0), '') AS INT) AS y FROM x) "
    f"SELECT o_orderkey, CASE WHEN y BETWEEN 1500 AND {YEAR + 2} THEN y END AS year FROM y"
)
def proj04_year(s, d):
    o = table(s, d, "orders")
    text = F.concat(F.date_format("o_orderdate", "dd MMM yyyy"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" (revised)")).otherwise(F.lit("")))
    return o.select("o_orderkey", T.clean_year(text, YEAR).alias("year"))


@query("SELECT record_id, lower(regexp_replace(arxiv_id, '(?i)v\\d+$', '')) AS bare FROM papers WHERE arxiv_id IS NOT NULL")
def t30_arxiv_version(s, d):
    return table(s, d, "papers").where("arxiv_id is not null").select("record_id", I.strip_arxiv_version("arxiv_id").alias("bare"))


@query("SELECT record_id, upper(source_id) AS openalex_id FROM papers WHERE source = 'OpenAlex' AND regexp_full_match(source_id, '(?i)w\\d{4,12}')")
def t31_openalex_id(s, d):
    x = table(s, d, "papers").where("source = 'OpenAlex'").select("record_id", I.normalize_openalex_id("source_id").alias("openalex_id"))
    return x.where("openalex_id is not null")


@query(
    f"WITH k AS (SELECT record_id, [{'{'}'k': 'doi:' || {O.normalize_doi('doi')}{'}'}, {'{'}'k': 'pmcid:' || upper(nullif(pmcid, '')){'}'}, {'{'}'k': 'pmid:' || nullif(pmid, ''){'}'}, {'{'}'k': 'arxiv:' || lower(regexp_replace(nullif(arxiv_id, ''), '(?i)v\\d+$', '')){'}'}, "
    f"{'{'}'k': 'src:' || source || ':' || nullif(source_id, ''){'}'}] AS a FROM papers) SELECT record_id, array_to_string(list_filter(list_transform(a, lambda x: x.k), lambda x: x IS NOT NULL), ' ') AS keys FROM k"
)
def t32_identity_keys(s, d):
    return table(s, d, "papers").select("record_id", F.array_join(I.identity_keys("doi", "pmcid", "pmid", "arxiv_id", "source", "source_id"), " ").alias("keys"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{200b}-\\x{200f}\\x{2028}\\x{2029}\\x{feff}]', ' ', 'g'), '[\\x20\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS text FROM documents")
def t33_sanitize(s, d):
    return table(s, d, "documents").select("doc_id", T.sanitize_text("text").alias("text"))


@query(f"WITH x AS (SELECT record_id, {O.collapse('lower(source)')} AS a, {O.collapse('lower(coalesce(journal, ' + chr(39) * 2 + '))')} AS b, year::VARCHAR AS y FROM papers) SELECT record_id, array_to_string(list_filter([a, b, y], lambda v: v <> ''), '|') AS cache_key FROM x")
def t35_cache_key(s, d):
    return table(s, d, "papers").select("record_id", T.cache_key(F.col("source"), F.col("journal"), F.col("year")).alias("cache_key"))


@query(
    f"SELECT record_id, coalesce('doi:' || {O.normalize_doi('doi')}, 'pmcid:' || nullif(pmcid, ''), 'pmid:' || nullif(pmid, ''), 'arxiv:' || nullif(arxiv_id, ''), "
    "(CASE source WHEN 'Semantic Scholar' THEN 's2' WHEN 'OpenAlex' THEN 'openalex' WHEN 'CORE' THEN 'core' WHEN 'DOAJ' THEN 'doaj' END) || ':' || nullif(source_id, '')) AS paper_id FROM papers"
)
def proj17_paper_id(s, d):
    return table(s, d, "papers").select("record_id", I.paper_id("doi", "pmcid", "pmid", "arxiv_id", "source", "source_id").alias("paper_id"))


# Links ---------------------------------------------------------------------------------------------------

_HOST = "regexp_extract(trim(pdf_url), '(?i)^https?://([^/?#:@]*)', 1)"
_PRIVATE = f"({_HOST} = 'localhost' OR regexp_matches({_HOST}, '^(?:0|10|127)\\.\\d+\\.\\d+\\.\\d+$') OR regexp_matches({_HOST}, '^192\\.(?:168|0)\\.\\d+\\.\\d+$') OR regexp_matches({_HOST}, '^172\\.(?:1[6-9]|2\\d|3[01])\\.\\d+\\.\\d+$') OR regexp_matches({_HOST}, '^169\\.254\\.\\d+\\.\\d+$') OR regexp_matches({_HOST}, '^100\\.(?:6[4-9]|[7-9]\\d|1[01]\\d|12[0-7])\\.\\d+\\.\\d+$') OR regexp_matches({_HOST}, '^(?:22[4-9]|2[3-5]\\d)\\.\\d+\\.\\d+\\.\\d+$'))"


@query(f"SELECT record_id, CASE WHEN {_HOST} <> '' AND NOT {_PRIVATE} THEN trim(pdf_url) END AS link FROM papers")
def u01_safe_link(s, d):
    return table(s, d, "papers").select("record_id", U.sanitize_external_link("pdf_url").alias("link"))


@query(f"SELECT record_id, {_HOST} AS host, {_PRIVATE} AS disallowed FROM papers WHERE {_HOST} <> ''")
def f13_private_address(s, d):
    x = table(s, d, "papers").select("record_id", U.url_parts("pdf_url").alias("u")).where("u.scheme in ('http', 'https') and u.host <> ''")
    return x.select("record_id", F.col("u.host").alias("host"), U.is_disallowed_address("u.host").alias("disallowed"))


@query(
    "SELECT record_id, coalesce(regexp_matches(trim(pdf_url), '^[a-zA-Z][a-zA-Z0-9+.-]*://') AND (regexp_matches(lower(trim(pdf_url)), '^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*\\.pdf(?:[?#].*)?$') OR regexp_matches(lower(trim(pdf_url)), '^[a-z][a-z0-9+.-]*://[^/]*/(?:.*/)?pdf(?:/|$)|[?&](?:type=printable|format=pdf|download=pdf)')), false) AS is_pdf FROM papers"
)
def f14_pdf_link(s, d):
    return table(s, d, "papers").select("record_id", U.looks_like_pdf("pdf_url").alias("is_pdf"))


@query()
def f12_url_policy(s, d):
    """Verdict on every landing page and PDF link as an API address."""
    p = table(s, d, "papers").select(F.explode(F.array_compact(F.array("pdf_url", "landing_page_url"))).alias("url"))
    return p.select(F.coalesce(U.api_url_verdict("url"), F.lit("allowed")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


# Filters, validation, query language -------------------------------------------------------------------------

_RANGE = "CASE WHEN record_id % 4 = 0 THEN NULL ELSE 1995 END AS lo, CASE WHEN record_id % 3 = 0 THEN NULL ELSE 2015 END AS hi"


@query(f"SELECT record_id, year FROM (SELECT record_id, year, {_RANGE} FROM papers) WHERE (lo IS NULL AND hi IS NULL) OR (year IS NOT NULL AND (lo IS NULL OR year >= lo) AND (hi IS NULL OR year <= hi))")
def f01_year_range(s, d):
    p = table(s, d, "papers").select("record_id", "year", F.when(F.col("record_id") % 4 != 0, F.lit(1995)).alias("lo"), F.when(F.col("record_id") % 3 != 0, F.lit(2015)).alias("hi"))
    return p.where(ranking.within_years(F.col("year"), F.col("lo"), F.col("hi"))).select("record_id", "year")


_BARE = f"(SELECT record_id, doi, pmcid, pmid, arxiv_id, source, source_id, journal, {O.bare('v')} AS b FROM (SELECT *, {O.normalize_title('title')} AS v FROM papers))"


@query(
    f"WITH x AS MATERIALIZED {_BARE}, m AS (SELECT journal AS j, min(record_id) AS mid FROM papers WHERE journal IS NOT NULL GROUP BY journal), mm AS (SELECT j, x.* FROM m JOIN x ON x.record_id = mid) "
    "SELECT x.record_id, mm.record_id AS main_id FROM x JOIN mm ON x.journal = mm.j WHERE NOT coalesce(CASE WHEN nullif(x.doi, '') IS NOT NULL AND nullif(mm.doi, '') IS NOT NULL THEN x.doi = mm.doi ELSE "
    "coalesce(upper(nullif(x.pmcid, '')) = upper(mm.pmcid), false) OR coalesce(nullif(x.pmid, '') = mm.pmid, false) OR coalesce(lower(regexp_replace(nullif(x.arxiv_id, ''), '(?i)v\\d+$', '')) = lower(regexp_replace(mm.arxiv_id, '(?i)v\\d+$', '')), false) "
    "OR coalesce(x.source = mm.source AND nullif(x.source_id, '') = mm.source_id, false) OR x.b = mm.b END, false)"
)
def f02_other_papers(s, d):
    """Every journal's papers without the journal's first record and what is the same paper."""
    p = table(s, d, "papers").select("record_id", "doi", "pmcid", "pmid", "arxiv_id", "source", "source_id", "journal", T.normalize_title("title", True).alias("n_bare"))
    first = p.where("journal is not null").groupBy("journal").agg(F.min("record_id").alias("record_id"))
    mains = p.join(first.select("record_id"), "record_id", "left_semi")
    c, m = (p.select(*[F.col(n).alias(f"{x}{n}") for n in p.columns]) if x == "c_" else mains.select(*[F.col(n).alias(f"{x}{n}") for n in p.columns]) for x in ("c_", "m_"))
    pair = c.join(m, F.col("c_journal") == F.col("m_journal"))
    return pair.where(~F.coalesce(ranking.same_paper("m_", "c_"), F.lit(False))).select(F.col("c_record_id").alias("record_id"), F.col("m_record_id").alias("main_id"))


@query(
    f"SELECT record_id, (length(v) >= 15 AND len(list_filter(string_split(v, ' '), lambda t: t <> '')) >= 3) AS distinctive FROM (SELECT record_id, {O.normalize_title('title')} AS v FROM papers)"
)
def f04_distinctive(s, d):
    return table(s, d, "papers").select("record_id", T.looks_distinctive(T.normalize_title("title")).alias("distinctive"))


@query("SELECT record_id FROM papers WHERE nullif(pdf_url, '') IS NULL AND coalesce(doi, pmcid, pmid, arxiv_id) IS NOT NULL")
def f09_needs_full_text(s, d):
    return table(s, d, "papers").where(fulltext.needs_full_text()).select("record_id")


@query()
def f10_validation(s, d):
    """Complaints about build inputs read as requests."""
    x = table(s, d, "build_inputs").select("input_id", "title", F.lit(None).cast("array<string>").alias("authors"), F.col("topics").alias("keywords"), "doi", F.col("year").alias("from_year"), F.lit(2020).alias("to_year"))
    return x.select("input_id", F.array_join(validate.request_errors(YEAR), "; ").alias("errors"))


@query(
    "SELECT record_id, CASE WHEN regexp_full_match(pmcid, '(?i)PMC\\d{1,9}') THEN upper(pmcid) END AS value FROM papers WHERE pmcid IS NOT NULL"
)
def f11_paper_id(s, d):
    x = table(s, d, "papers").where("pmcid is not null")
    return x.select("record_id", validate.paper_id_parts(F.concat(F.lit("PMCID:"), "pmcid"))["value"].alias("value"))


@query()
def k07_free_text(s, d):
    """Lines as people type them, built from repository items, and read back."""
    line = F.concat_ws(" + ", F.concat(F.lit("title: "), "title"), F.concat(F.lit("@"), F.try_element_at("authors", F.lit(1))), F.concat(F.lit("since: "), F.col("year").cast("string")))
    x = validate.parse_free_text(table(s, d, "repository_items").select("item_id", line.alias("raw_query")))
    return x.select("item_id", "title", _joined("authors").alias("authors"), "from_year", "to_year")


# Joins -----------------------------------------------------------------------------------------------------


@query(
    f"SELECT item_id, source, record_id FROM (SELECT i.item_id, p.source, p.record_id, row_number() OVER (PARTITION BY i.item_id, p.source ORDER BY p.record_id) AS rn FROM (SELECT item_id, {O.normalize_doi('doi')} AS d FROM repository_items) i JOIN (SELECT record_id, source, {O.normalize_doi('doi')} AS d FROM papers) p ON p.d = i.d) WHERE rn = 1"
)
def j02_doi_lookup(s, d):
    """The first record of each source for the DOI of an item."""
    p = table(s, d, "papers").select("record_id", "source", I.normalize_doi("doi").alias("k"))
    i = table(s, d, "repository_items").select("item_id", I.normalize_doi("doi").alias("k"))
    return i.join(p, "k").groupBy("item_id", "source").agg(F.min("record_id").alias("record_id"))


@query()
def j03_id_dispatch(s, d):
    p = table(s, d, "papers").withColumn("n_doi", I.normalize_doi("doi"))
    i = table(s, d, "repository_items").select(F.col("item_id").alias("lookup_id"), F.lit("doi").alias("scheme"), I.normalize_doi("doi").alias("value")).where("value is not null")
    m = table(s, d, "papers").where("pmid is not null").select((-F.col("record_id")).alias("lookup_id"), F.lit("pmid").alias("scheme"), F.col("pmid").alias("value"))
    return engine.lookup_by_id(i.unionByName(m), p).select("lookup_id", "scheme", "record_id", "ordinal")


_KEYS = f"ks AS (SELECT record_id, 1 AS pos, 'doi:' || {O.normalize_doi('doi')} AS k FROM papers UNION ALL SELECT record_id, 2, 'pmcid:' || upper(nullif(pmcid, '')) FROM papers UNION ALL SELECT record_id, 3, 'pmid:' || nullif(pmid, '') FROM papers UNION ALL SELECT record_id, 4, 'arxiv:' || lower(regexp_replace(nullif(arxiv_id, ''), '(?i)v\\d+$', '')) FROM papers UNION ALL SELECT record_id, 5, 'src:' || source || ':' || nullif(source_id, '') FROM papers)"


@query(
    f"WITH {_KEYS}, lo AS (SELECT k, min(record_id) AS low FROM ks WHERE k IS NOT NULL GROUP BY k), h AS (SELECT ks.record_id, low, row_number() OVER (PARTITION BY ks.record_id ORDER BY pos, low) AS rn FROM ks JOIN lo USING (k) WHERE low < ks.record_id) "
    "SELECT p.record_id AS id, coalesce(h.low, p.record_id) AS \"group\" FROM papers p LEFT JOIN h ON h.record_id = p.record_id AND rn = 1"
)
def j04_key_groups(s, d):
    return dedup.key_groups(table(s, d, "papers"), "record_id")


@query(
    f"WITH n AS (SELECT DISTINCT {O.normalize_title('title')} AS v FROM papers), t AS MATERIALIZED (SELECT v, list_distinct({O.words('v')}) AS w, {O.bigrams('v')} AS g FROM n WHERE v <> ''), "
    "p AS (SELECT a.v AS a, b.v AS b, len(list_intersect(a.w, b.w))::DOUBLE AS i, len(a.w) AS na, len(b.w) AS nb, a.g AS ga, b.g AS gb FROM t a JOIN t b ON a.v < b.v AND len(a.w) BETWEEN 0.8 * len(b.w) AND 1.25 * len(b.w)), "
    "c AS (SELECT a, b, i / (na + nb - i) AS j, ga, gb FROM p WHERE i > 0 AND i / (na + nb - i) >= 0.84), "
    "s AS (SELECT a, b, 0.45::DOUBLE * j + 0.35::DOUBLE * (2.0::DOUBLE * len(list_intersect(ga, gb)) / (len(ga) + len(gb))) + 0.2::DOUBLE * (1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) AS s FROM c) "
    f"SELECT a AS title_a, b AS title_b, {O.round_score('s')} AS similarity FROM s WHERE s >= 0.93"
)
def j05_fuzzy_titles(s, d):
    t = cut(table(s, d, "papers").select(T.normalize_title("title").alias("n_title"))).where("n_title <> ''").distinct()
    t = t.withColumn("n_tokens", S.content_tokens(F.col("n_title"))).withColumn("n_grams", S.bigrams(F.col("n_title")))
    return dedup.fuzzy_title_pairs(t).select("title_a", "title_b", round_score(F.col("similarity")).alias("similarity"))


@query(
    f"WITH r AS (SELECT DISTINCT input_id, {O.normalize_doi('ref')} AS doi FROM (SELECT input_id, unnest(reference_ids) AS ref FROM build_inputs)) SELECT r.input_id, p.input_id AS cited_id FROM r JOIN (SELECT input_id, {O.normalize_doi('doi')} AS doi FROM build_inputs) p ON p.doi = r.doi"
)
def j08_citations(s, d):
    b = table(s, d, "build_inputs")
    refs = b.select("input_id", F.explode("reference_ids").alias("r")).select("input_id", I.normalize_doi("r").alias("k")).distinct()
    return refs.join(b.select(F.col("input_id").alias("cited_id"), I.normalize_doi("doi").alias("k")), "k").select("input_id", "cited_id")


@query(
    f"WITH k AS (SELECT DISTINCT input_id, {O.normalize_doi('ref')} AS doi FROM (SELECT input_id, unnest(reference_ids) AS ref FROM build_inputs)) "
    "SELECT a.input_id AS id_a, b.input_id AS id_b, count(*) AS shared FROM k a JOIN k b ON a.doi = b.doi AND a.input_id < b.input_id GROUP BY ALL HAVING count(*) >= 3"
)
def j09_coupling(s, d):
    """Inputs that cite three of the same works. A pair shares one of all but the two most cited works of either side, so the
    hottest references are never joined on."""
    b = table(s, d, "build_inputs")
    sets = cut(b.select("input_id", F.array_distinct(F.array_compact(F.transform("reference_ids", I.normalize_doi))).alias("terms")).where(F.size("terms") >= 3))
    x = engine.lookup(sets.withColumnRenamed("input_id", "aid"), sets.withColumnRenamed("input_id", "rid"), least=3)
    return x.where("aid < rid").select(F.col("aid").alias("id_a"), F.col("rid").alias("id_b"), F.col("hits").cast("bigint").alias("shared"))


# Groups, merges, aggregates ----------------------------------------------------------------------------------


@query()
def g01_dedup(s, d):
    """The group of every record, named by its first record."""
    return dedup.assign(table(s, d, "papers")).withColumnRenamed("seq", "record_id")


@query()
def g02_merge(s, d):
    """The given groups, each merged into the record of its first member."""
    m = table(s, d, "merge_groups").groupBy("group_id", "record_id").count().select("group_id", F.col("record_id").alias("seq"))
    m = m.withColumn("first_seq", F.min("seq").over(Window.partitionBy("group_id"))).select("first_seq", "seq").distinct()
    x = dedup.merge(cut(dedup.base_columns(table(s, d, "papers"), "record_id").join(m, "seq")))
    join = lambda c: F.array_join(c, "|", "~")
    links = F.transform("source_links", lambda l: F.concat_ws(";", l["source"], F.coalesce(l["pdf_url"], F.lit("")), F.coalesce(l["landing_page_url"], F.lit(""))))
    return x.select(
        "first_seq", "n_members", "title", "doi", "pmid", "pmcid", "arxiv_id", "year", "journal", "conference", "publisher", "source", "source_id", join("authors").alias("authors"), join("sources").alias("sources"), join(links).alias("links"),
        join("keywords").alias("keywords"), join("topics").alias("topics"), F.size("reference_ids").alias("n_references"), "citation_count", "pdf_url", "landing_page_url", "is_open_access", "confidence", "match_type", "similarity_score", "abstract",
    )


@query(
    "WITH l AS (SELECT record_id, [coalesce(source, ''), coalesce(pdf_url, ''), coalesce(landing_page_url, '')] AS k FROM (SELECT record_id, unnest(source_links, recursive := true) FROM papers)) SELECT record_id, count(DISTINCT k) AS links FROM l GROUP BY record_id"
)
def g03_source_links(s, d):
    x = table(s, d, "papers").select("record_id", F.explode("source_links").alias("l"))
    key = F.struct(*[F.coalesce(f"l.{n}", F.lit("")) for n in ("source", "pdf_url", "landing_page_url")])
    return x.groupBy("record_id").agg(F.countDistinct(key).alias("links"))


@query(
    "WITH u AS (SELECT record_id, lower(v) AS v FROM (SELECT record_id, unnest(list_concat(coalesce(keywords, []), coalesce(topics, []))) AS v FROM papers) WHERE v IS NOT NULL) SELECT record_id, least(count(DISTINCT v), 30)::INT AS n FROM u GROUP BY record_id"
)
def g04_capped_union(s, d):
    x = table(s, d, "papers").select("record_id", dedup.merged_lists(F.col("keywords"), F.col("topics"), 30).alias("l"))
    return x.where("l is not null").select("record_id", F.size("l").alias("n"))


@query()
def g05_select_best(s, d):
    """The best candidate of each repository item among the records that share half of its title words."""
    q, p = _described(s, d), _prepared(s, d, engine.VERDICT)
    arrivals = cut(engine.retrieve(q, p))
    sweep(s)
    scored = engine.score_candidates(arrivals, q, p).select(*engine.IDENTIFIED)
    from .operators.matching import select_best

    return select_best(scored, ["query_id"]).select("query_id", F.col("seq").alias("record_id"), "match_type", "confidence", "final_score", "is_exact")


def _described(s, d):
    """Repository items as queries."""
    i = table(s, d, "repository_items")
    return cut(prepare_queries(
        i.select(F.col("item_id").alias("query_id"), "title", "authors", F.lit(None).cast("array<string>").alias("keywords"), "doi", F.lit(None).cast("int").alias("from_year"), F.lit(None).cast("int").alias("to_year")), YEAR
    ))


def _prepared(s, d, columns=None):
    """Papers with their derived columns (those named, if any are), written once: what follows stays a small plan."""
    p = prepare_papers(table(s, d, "papers"))
    return cut(p.select("record_id", *columns) if columns else p)


_FULL = (
    "CASE WHEN nullif(pdf_url, '') IS NOT NULL THEN 'pdf' WHEN nullif(landing_page_url, '') IS NOT NULL OR nullif(doi, '') IS NOT NULL THEN 'html' END AS type, "
    "CASE WHEN nullif(pdf_url, '') IS NOT NULL THEN (CASE WHEN is_open_access = false THEN 'publisher' WHEN is_open_access THEN 'open-access' WHEN nullif(pmcid, '') IS NOT NULL OR nullif(arxiv_id, '') IS NOT NULL OR source IN ('CORE', 'DOAJ') THEN 'repository' ELSE 'publisher' END) "
    "WHEN nullif(landing_page_url, '') IS NOT NULL THEN (CASE WHEN is_open_access THEN 'open-access' ELSE 'landing-page' END) WHEN nullif(doi, '') IS NOT NULL THEN 'landing-page' ELSE 'unavailable' END AS access_type, "
    "CASE WHEN nullif(pdf_url, '') IS NOT NULL THEN true WHEN nullif(landing_page_url, '') IS NOT NULL THEN coalesce(is_open_access, false) ELSE false END AS available, "
    "coalesce(nullif(pdf_url, ''), nullif(landing_page_url, ''), 'https://doi.org/' || nullif(doi, '')) AS url"
)


@query(f"SELECT record_id, {_FULL} FROM papers")
def proj15_full_text(s, d):
    x = table(s, d, "papers").select("record_id", fulltext.derive_full_text().alias("f"))
    return x.select("record_id", "f.type", "f.access_type", "f.available", "f.url")


@query(
    f"WITH l AS (SELECT DISTINCT m.group_id, p.record_id, {_FULL} FROM merge_groups m JOIN papers p USING (record_id)), s AS (SELECT *, CASE access_type WHEN 'open-access' THEN 50 WHEN 'repository' THEN 40 WHEN 'publisher' THEN 30 WHEN 'landing-page' THEN 20 ELSE 10 END "
    "+ CASE WHEN type = 'pdf' THEN 3 ELSE 0 END + CASE WHEN available THEN 2 ELSE 0 END - CASE WHEN url IS NULL THEN 20 ELSE 0 END AS score FROM l), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, record_id) AS rn FROM s) SELECT group_id, record_id AS seq, access_type, url FROM r WHERE rn = 1"
)
def g06_best_full_text(s, d):
    """The best of the members' own locations in each group."""
    m = table(s, d, "merge_groups").select("group_id", "record_id").distinct().join(table(s, d, "papers"), "record_id")
    loc = m.select("group_id", F.col("record_id").alias("seq"), fulltext.derive_full_text().alias("f")).select("group_id", "seq", "f.*")
    return fulltext.pick_best(loc, ["group_id"]).select("group_id", "seq", "access_type", "url")


@query()
def j10_resolver_chain(s, d):
    """Full text of each group's first record, asked of the other members in order until a free PDF is found."""
    m = table(s, d, "merge_groups").select("group_id", "record_id").distinct()
    first = m.groupBy("group_id").agg(F.min("record_id").alias("main"))
    rest = m.join(first, "group_id").where("record_id <> main").join(table(s, d, "papers"), "record_id")
    loc = rest.select(F.col("main").alias("record_id"), F.row_number().over(Window.partitionBy("group_id").orderBy("record_id")).alias("seq"), fulltext.derive_full_text().alias("f")).select("record_id", "seq", "f.*")
    mains = table(s, d, "papers").join(first.select(F.col("main").alias("record_id")).distinct(), "record_id", "left_semi")
    x = fulltext.back_fill(fulltext.resolve_full_text(mains, loc))
    return x.select("record_id", "full_text.source", "full_text.type", "full_text.access_type", "pdf_url", "is_open_access")


@query()
def c10_enrich(s, d):
    """PDF links of records without one, from the two enrichment resolvers (here: the other members of their groups)."""
    m = table(s, d, "merge_groups").select("group_id", "record_id").distinct()
    p = table(s, d, "papers")
    other = m.join(m.withColumnRenamed("record_id", "o"), "group_id").where("o <> record_id")
    loc = other.join(p.withColumnRenamed("record_id", "o"), "o").select(
        "record_id", F.col("o").alias("seq"), F.when(F.col("o") % 2 == 0, F.lit("unpaywall")).otherwise(F.lit("doaj")).alias("resolver"), fulltext.derive_full_text().alias("f")
    ).select("record_id", "seq", "resolver", "f.*")
    return fulltext.enrich(p, loc).select("record_id", "pdf_url", "is_open_access")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'skipped' WHEN 'click' THEN 'rate-limited' WHEN 'view' THEN 'unavailable' ELSE 'failed' END"
_SEV = "CASE status WHEN 'success' THEN 0 WHEN 'skipped' THEN 1 WHEN 'rate-limited' THEN 2 WHEN 'unavailable' THEN 3 ELSE 4 END"


def _log(s, d):
    kind = F.col("event_type")
    st = F.when(kind == "purchase", "success").when(kind == "signup", "skipped").when(kind == "click", "rate-limited").when(kind == "view", "unavailable").otherwise("failed")
    e = table(s, d, "events")
    return e.select(
        (F.col("user_id") % 50).alias("query_id"), F.concat(F.lit("source "), (F.col("user_id") % 7).cast("string")).alias("name"), st.alias("status"), F.floor("value").cast("bigint").alias("duration_ms"),
        (F.col("event_id") % 20).alias("result_count"), F.when(st != "success", F.concat(F.lit("error "), (F.col("event_id") % 3).cast("string"))).alias("error"), F.col("event_id").alias("seq"), "ts",
    )


_LOG = f"lg AS (SELECT user_id % 50 AS query_id, 'source ' || (user_id % 7)::VARCHAR AS name, {_STATUS} AS status, floor(value)::BIGINT AS duration_ms, event_id % 20 AS result_count, event_id AS seq, ts FROM events), le AS (SELECT *, CASE WHEN status <> 'success' THEN 'error ' || (seq % 3)::VARCHAR END AS error FROM lg)"


@query(
    f"WITH {_LOG}, g AS (SELECT query_id, name, max(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS ok, sum(result_count)::BIGINT AS result_count, sum(duration_ms)::BIGINT AS duration_ms, min(seq) AS ordinal FROM le GROUP BY ALL), "
    f"w AS (SELECT query_id, name, status, row_number() OVER (PARTITION BY query_id, name ORDER BY {_SEV} DESC, seq) AS rn FROM le), e AS (SELECT query_id, name, error, row_number() OVER (PARTITION BY query_id, name ORDER BY seq) AS rn FROM le WHERE error IS NOT NULL) "
    "SELECT g.query_id, g.name, CASE WHEN ok = 1 THEN 'success' ELSE w.status END AS status, g.result_count, g.duration_ms, CASE WHEN ok = 0 THEN e.error END AS error, g.ordinal FROM g JOIN w ON w.query_id = g.query_id AND w.name = g.name AND w.rn = 1 LEFT JOIN e ON e.query_id = g.query_id AND e.name = g.name AND e.rn = 1"
)
def g07_status_merge(s, d):
    return status.merge_statuses(_log(s, d), ["query_id"])


@query(
    f"WITH k AS (SELECT source, coalesce({O.normalize_doi('doi')}, lower(title)) AS k FROM papers) SELECT source, count(DISTINCT k) AS usable FROM k GROUP BY source"
)
def g08_usable(s, d):
    return table(s, d, "papers").groupBy("source").agg(F.countDistinct(F.coalesce(I.normalize_doi("doi"), F.lower("title"))).alias("usable"))


@query(
    f"WITH n AS (SELECT record_id, {O.normalize_title('abstract')} AS v FROM papers), w AS (SELECT unnest(list_filter(string_split(v, ' '), lambda t: length(t) >= 3 and not list_contains({O.STOP}, t))) AS term FROM n) SELECT term, count(*) AS n FROM w GROUP BY term"
)
def g09_term_frequency(s, d):
    return table(s, d, "papers").select(F.explode(T.term_list("abstract")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "WITH v AS (SELECT record_id, CASE WHEN confidence > 0 THEN confidence END AS a, CASE WHEN isfinite(similarity_score) THEN similarity_score END AS b, CASE WHEN citation_count IS NOT NULL THEN least(citation_count, 100)::DOUBLE / 100 END AS c FROM papers), "
    "w AS (SELECT record_id, (CASE WHEN a IS NOT NULL THEN 0.55::DOUBLE ELSE 0 END + CASE WHEN b IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN c IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END) AS w, (coalesce(0.55::DOUBLE * a, 0) + coalesce(0.25::DOUBLE * b, 0) + coalesce(0.08::DOUBLE * c, 0)) AS t FROM v) "
    f"SELECT record_id, {O.round_score('CASE WHEN w > 0 THEN t / w ELSE 0 END')} AS mean FROM w"
)
def g10_weighted_mean(s, d):
    a = F.when(F.col("confidence") > 0, F.col("confidence"))
    b = F.when(~F.isnan("similarity_score"), F.col("similarity_score"))
    c = F.when(F.col("citation_count").isNotNull(), F.least(F.col("citation_count"), F.lit(100)).cast("double") / 100)
    return table(s, d, "papers").select("record_id", round_score(S.weighted_mean([(0.55, a), (0.25, b), (0.08, c)])).alias("mean"))


@query("SELECT coalesce(journal, conference) AS venue, source, count(*) AS n, count(DISTINCT year) AS years FROM papers GROUP BY ALL")
def g12_counts(s, d):
    return table(s, d, "papers").groupBy(F.coalesce("journal", "conference").alias("venue"), "source").agg(F.count("*").alias("n"), F.countDistinct("year").alias("years"))


@query()
def j04_components(s, d):
    """Connected components of records that share an identity key."""
    k = dedup.keyed(table(s, d, "papers"), "record_id")
    star = k.join(k.groupBy("key").agg(F.min("id").alias("low")), "key").select(F.col("id").alias("a"), F.col("low").alias("b"))
    return connected_components(star).withColumnsRenamed({"node": "record_id"})


# Ranking -----------------------------------------------------------------------------------------------------

_ZERO = "coalesce(citation_count, 0) DESC, coalesce(year, 0) DESC"


@query(
    f"SELECT source, record_id, rank FROM (SELECT source, record_id, row_number() OVER (PARTITION BY source ORDER BY {O.round_score('confidence + CASE WHEN year IS NULL OR ' + str(YEAR) + ' - year >= 12 THEN 0.0 WHEN ' + str(YEAR) + ' - year <= 0 THEN 0.05 ELSE 0.05 * (1.0 - (' + str(YEAR) + ' - year)::DOUBLE / 12.0) END')} DESC, (nullif(pdf_url, '') IS NOT NULL)::INT DESC, {_ZERO}, record_id)::INT AS rank FROM papers) WHERE rank <= 10"
)
def w01_rank(s, d):
    """Ten best records of each source: score with recency, PDF, citations, year."""
    p = table(s, d, "papers").select("source", "record_id", "year", "citation_count", "pdf_url", round_score(F.col("confidence") + S.recency_bonus(F.col("year"), 0.05, YEAR)).alias("similarity"))
    x = p.select("source", F.col("record_id").alias("seq"), "similarity", *[F.col(c).alias(f"c_{c}") for c in ("year", "citation_count", "pdf_url")])
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*ranking.similar_order()))).where("rank <= 10").select("source", F.col("seq").alias("record_id"), "rank")


@query(
    f"SELECT source, record_id, rank FROM (SELECT source, record_id, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, coalesce(len(sources), 1) DESC, coalesce(citation_count, 0) DESC, record_id)::INT AS rank FROM papers) WHERE rank <= 20"
)
def w03_rank_candidates(s, d):
    x = table(s, d, "papers").select("source", F.col("record_id").alias("seq"), "confidence", F.col("sources").alias("c_sources"), F.col("citation_count").alias("c_citation_count"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*ranking.candidate_order()))).where("rank <= 20").select("source", F.col("seq").alias("record_id"), "rank")


@query(
    f"WITH f AS (SELECT source, record_id, coalesce(citation_count, 0) AS c, replace({O.bare('v')}, ' ', '') AS fp FROM (SELECT source, record_id, citation_count, {O.normalize_title('title', False)} AS v FROM papers)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, record_id) AS raw FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY raw) AS nth FROM r), "
    "z AS (SELECT source, record_id, row_number() OVER (PARTITION BY source ORDER BY raw)::INT AS rank FROM k WHERE nth = 1 OR fp = '') SELECT source, record_id, rank FROM z WHERE rank <= 25"
)
def w04_distinct_titles(s, d):
    x = table(s, d, "papers").select("source", F.col("record_id").alias("seq"), F.coalesce("citation_count", F.lit(0)).alias("c"), T.title_fingerprint("title").alias("c_n_print"))
    return ranking.rank_distinct_titles(x, ["source"], [F.col("c").desc(), F.col("seq").asc()], 25).select("source", F.col("seq").alias("record_id"), "rank")


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_minute FROM e")
def w07_minute_window(s, d):
    return traffic.minute_counts(table(s, d, "events"), "user_id").select("event_id", "user_id", "in_minute")


@query(
    "WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) "
    "SELECT event_id, user_id, (sum(f::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM e"
)
def w08_failure_runs(s, d):
    e = table(s, d, "events").withColumn("failed", F.col("event_type") == "error")
    return traffic.failure_runs(e, "user_id", "failed", ["ts", "event_id"]).select("event_id", "user_id", "run")


@query(
    f"WITH c AS (SELECT source, year, count(*) AS n FROM papers WHERE year IS NOT NULL GROUP BY ALL), b AS (SELECT source, year AS ordinal, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c) SELECT source, ordinal, n, before FROM b WHERE before < 50"
)
def l03_pool_cap(s, d):
    c = table(s, d, "papers").where("year is not null").groupBy("source", F.col("year").alias("ordinal")).agg(F.count("*").alias("n"))
    return engine.within_budget(c, 50, "source").select("source", "ordinal", "n", "before")


@query("SELECT record_id, len(list_distinct(list_transform(list_filter(coalesce(sources, []), lambda v: v IS NOT NULL), lambda v: lower(v))))::INT AS n FROM papers")
def a01_ordered_distinct(s, d):
    return table(s, d, "papers").select("record_id", F.size(capped(ordered_distinct(F.coalesce("sources", F.array().cast("array<string>"))), 100)).alias("n"))


@query(
    f"WITH n AS (SELECT record_id, {O.collapse('abstract')} AS text FROM papers) SELECT record_id, text FROM n WHERE text <> ''"
)
def a02_inverted_index(s, d):
    """Abstracts taken apart into word positions and put together again."""
    words = F.split(mappers_collapse(F.col("abstract")), " ")
    x = table(s, d, "papers").where("abstract is not null").select("record_id", F.posexplode(words).alias("p", "w")).where("w <> ''")
    index = x.groupBy("record_id", "w").agg(F.sort_array(F.collect_list("p")).alias("at")).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("record_id", mappers.reconstruct_abstract("index").alias("text"))


def mappers_collapse(c):
    from .functions.core import collapse

    return collapse(c)


# Traffic -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 86400000.0::DOUBLE WHEN event_id % 4 = 1 THEN floor(value)::DOUBLE * 1000 WHEN event_id % 4 = 2 THEN 30000.0::DOUBLE END AS wait_ms FROM events")
def d02_retry_after(s, d):
    """Headers in seconds, as dates, too long and unreadable."""
    n = F.col("event_id") % 4
    head = (
        F.when(n == 0, F.lit("999999")).when(n == 1, F.floor("value").cast("string")).when(n == 2, F.date_format(F.lit("2025-01-01 00:00:30").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.lit("soon"))
    )
    return table(s, d, "events").select("event_id", status.retry_after_ms(head, F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("wait_ms"))


@query("SELECT event_id, least(500.0::DOUBLE * pow(2, event_id % 8), 8000.0::DOUBLE)::BIGINT AS delay_ms FROM events")
def r06_backoff(s, d):
    return table(s, d, "events").select("event_id", status.backoff_ms((F.col("event_id") % 8).cast("int"), 500, 8000).alias("delay_ms"))


@query(
    "WITH c AS (SELECT event_id, [429, 401, 403, 404, 408, 500, 503, 200][(event_id % 8 + 1)::INT] AS code, (event_id % 4)::INT AS attempt FROM events) "
    "SELECT event_id, (attempt < 3 AND code IN (429, 408, 500, 503)) AS retry, CASE WHEN attempt >= 3 THEN 'none' WHEN code = 429 THEN 'rate-limited' WHEN code = 408 THEN 'timeout' WHEN code IN (500, 503) THEN 'server-error' ELSE 'none' END AS reason, "
    "CASE code WHEN 429 THEN 'rate-limited' WHEN 401 THEN 'skipped' WHEN 403 THEN 'unavailable' WHEN 500 THEN 'unavailable' WHEN 503 THEN 'unavailable' ELSE 'failed' END AS status, (code IN (429, 500, 503, 200)) AS unhealthy FROM c"
)
def r08_failures(s, d):
    code = F.element_at(F.array(*[F.lit(c) for c in (429, 401, 403, 404, 408, 500, 503, 200)]), (F.col("event_id") % 8 + 1).cast("int"))
    x = table(s, d, "events").select("event_id", code.alias("code"), (F.col("event_id") % 4).cast("int").alias("attempt"))
    kind, none = F.lit("http"), F.lit(None).cast("double")
    r = status.retry_decision(kind, F.col("code"), F.col("attempt"), none, 3, 500, 8000)
    return x.select("event_id", r["retry"].alias("retry"), r["reason"].alias("reason"), status.classify(kind, F.col("code"), none)["status"].alias("status"), status.is_unhealthy(kind, F.col("code")).alias("unhealthy"))


def _clock(s, d):
    return table(s, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ts_ms"))


@query()
def r01_token_bucket(s, d):
    x = traffic.token_bucket(_clock(s, d), "user_id", ["ts_ms", "event_id"], 1 / 3600, 1, per_minute=10)
    return x.select("event_id", "user_id", "admitted", "wait_ms")


@query()
def r07_breaker(s, d):
    x = traffic.circuit_breaker(_clock(s, d).withColumn("failed", F.col("event_type") == "error"), "user_id", ["ts_ms", "event_id"], "failed", 2, 3_600_000.0, 1)
    return x.select("event_id", "user_id", "allowed", "state", "trips")


@query()
def r09_cache(s, d):
    x = _clock(s, d).withColumn("k", F.concat_ws(":", "event_type", (F.col("event_id") % 5).cast("string")))
    return traffic.cache_replay(x, "user_id", ["ts_ms", "event_id"], "k", 24 * 3_600_000.0, 6).select("event_id", "user_id", "hit", "entries", "evictions")


@query(f"WITH {_LOG} SELECT name, status, count(*) AS requests, sum(duration_ms)::BIGINT AS duration_ms, sum(result_count)::BIGINT AS results FROM le GROUP BY ALL")
def g11_traffic_report(s, d):
    return _log(s, d).groupBy("name", "status").agg(F.count("*").alias("requests"), F.sum("duration_ms").alias("duration_ms"), F.sum("result_count").alias("results"))


@query()
def k03_source_report(s, d):
    names = list(dimension.NAMES.values())
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("seq") % len(names) + 1).cast("int"))
    return status.source_report(dimension.sources(s), _log(s, d).withColumn("name", pick))


# Sources -----------------------------------------------------------------------------------------------------



def _term(x: str) -> str:
    return f"substr({O.collapse(O.rx(x, '[' + chr(34) + '\\[\\]():*~]', ' '))}, 1, 400)"


def _as_query(s, d):
    i = table(s, d, "repository_items")
    return i.select("item_id", "title", "authors", F.lit(None).cast("array<string>").alias("keywords"), "doi", F.lit(None).cast("string").alias("free_text"), F.lit(None).cast("array<string>").alias("topics"))


@query(
    "WITH a AS (SELECT item_id, title, doi, list_filter(list_transform(list_filter(coalesce(authors, []), lambda x: x IS NOT NULL), lambda x: trim(x)), lambda x: x <> '') AS au FROM repository_items) "
    f"SELECT item_id, coalesce({_term(O.normalize_doi('doi'))} || '[DOI]', nullif(array_to_string(list_concat(CASE WHEN {_term('title')} <> '' THEN [{_term('title')} || '[Title]'] ELSE [] END, list_transform(list_filter(list_transform(au, lambda x: {_term('x')}), lambda x: x <> ''), lambda x: x || '[Author]')), ' AND '), '')) AS expression FROM a"
)
def s02_pubmed_term(s, d):
    return _as_query(s, d).select("item_id", grammar.expression("pubmed").alias("expression"))


@query()
def s01_expressions(s, d):
    """Every source's own search expression for every item."""
    keys = (*grammar.GRAMMARS, "crossref", "openalex", "semanticScholar")
    x = _as_query(s, d).select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("source"), grammar.expression(k).alias("expression")) for k in keys])).alias("e"))
    return x.select("item_id", "e.source", "e.expression")


@query()
def s04_arxiv_related(s, d):
    return table(s, d, "papers").select("record_id", grammar.arxiv_related_expression().alias("expression"))


@query()
def s11_sources(s, d):
    return dimension.sources(s)


@query()
def s13_traffic_policy(s, d):
    return dimension.traffic_policy(s)


@query(
    f"WITH x AS (SELECT input_id, {O.strip_markup('title')} AS title, {O.normalize_doi('doi')} AS doi, year, CASE WHEN citation_count >= 0 THEN citation_count END AS citation_count FROM build_inputs) SELECT * FROM x WHERE title <> ''"
)
def proj01_build_paper(s, d):
    b = table(s, d, "build_inputs")
    x = mappers.build_paper(b, "batch", keep=("input_id",), title=F.col("title"), doi=I.normalize_doi("doi"), year=F.col("year"), source_id=F.col("source_id"), citation_count=F.col("citation_count"), topics=T.normalize_keywords("topics"))
    return x.select("input_id", "title", "doi", "year", "citation_count")


@query()
def proj11_crossref_scan(s, d):
    """Crossref's records turned into raw payloads and mapped back through the connector."""
    a = table(s, d, "crossref_authors").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("author_position", "author_row_id", "given", "family", "name"))), lambda x: F.struct(x["given"], x["family"], x["name"])).alias("author"))
    p = table(s, d, "papers").where("source = 'Crossref'").join(a, "record_id", "left")
    item = F.struct(
        F.col("doi").alias("DOI"), F.array("title").alias("title"), "abstract", "author", F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.array("journal").alias("container-title"), "publisher",
        F.col("citation_count").alias("is-referenced-by-count"), F.transform("reference_ids", lambda r: F.struct(r.alias("DOI"))).alias("reference"),
    )
    payload = p.select(F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("payload"))
    x = mappers.scan(payload, "crossref", YEAR)
    return x.select("title", "doi", "year", "journal", _joined("authors").alias("authors"), "citation_count", F.size("reference_ids").alias("n_refs"))


# Whole queries -------------------------------------------------------------------------------------------------


@query()
def c02_variants(s, d):
    return engine.variants(_described(s, d), DEFAULT.results_per_source).select("query_id", "variant_pos", "label", "precision", "limit")


@query()
def c05_identify(s, d):
    """Repository items as described papers: the record each one names."""
    q, p = _described(s, d), _prepared(s, d, engine.VERDICT)
    arrivals = cut(engine.retrieve(q, p))
    sweep(s)
    scored = cut(engine.score_candidates(arrivals, q, p).select(*engine.IDENTIFIED))
    sweep(s)
    return engine.identify(scored, arrivals).select("query_id", F.col("seq").alias("record_id"), "match_type", "confidence", "tier", "stopped_early")


@query()
def c07_discover(s, d):
    """Topics of the build inputs as keyword queries: ranked distinct titles."""
    b = table(s, d, "build_inputs").where("topics is not null")
    none = lambda t: F.lit(None).cast(t)
    q = cut(prepare_queries(b.select(F.col("input_id").alias("query_id"), none("string").alias("title"), none("array<string>").alias("authors"), F.col("topics").alias("keywords"), none("string").alias("doi"), none("int").alias("from_year"), none("int").alias("to_year")), YEAR))
    full = prepare_papers(table(s, d, "papers"))
    # what queries of keywords don't compare is neither derived nor moved with the pairs
    p = cut(full.select("record_id", *engine.BY_WORDS)).withColumns({n: F.lit(None).cast(full.schema[n].dataType) for n in engine.VERDICT if n not in engine.BY_WORDS})
    arrivals = cut(engine.retrieve(q, p))
    sweep(s)
    x = engine.discover(engine.score_candidates(arrivals, q, p))
    return x.select("query_id", "rank", F.col("seq").alias("record_id"), "match_type", "final_score")


@query()
def c08_similar(s, d):
    """The papers most similar to the first record of each merge group."""
    first = table(s, d, "merge_groups").groupBy("group_id").agg(F.min("record_id").alias("record_id"))
    p = _prepared(s, d, ("title", *engine.SCORED))
    mains = p.join(first, "record_id").withColumnRenamed("group_id", "query_id").withColumns({"from_year": F.lit(None).cast("int"), "to_year": F.lit(None).cast("int")})
    x = engine.find_similar(mains, p)
    return x.select("query_id", "rank", F.col("seq").alias("record_id"), "similarity", "sim_title", "sim_abstract", "sim_keywords", "sim_topics", "relation_bonus")


@query()
def k01_search(s, d):
    return flagship(s, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository item as a described paper: the identified record, its full text, similar papers, notes."""
    i = table(spark, sf_dir, "repository_items")
    none = lambda t: F.lit(None).cast(t)
    q = i.select(F.col("item_id").alias("query_id"), "title", "authors", none("array<string>").alias("keywords"), "doi", none("int").alias("from_year"), none("int").alias("to_year"))
    x = engine.search(q, table(spark, sf_dir, "papers"))
    return x.select(
        "query_id", "strategy", "exact_id", "paper_id", "match_type", "confidence", "stopped_early", F.col("full_text.access_type").alias("access_type"), "n_similar",
        F.array_join(F.transform("similar_papers", lambda h: h["hit"].cast("string")), " ").alias("similar_ids"), F.array_join("notes", " ").alias("notes"),
    )


def _answers(s, d, source):
    """Records of a source that carry or cite the DOI of an item, as its text search answers them."""
    p = table(s, d, "papers").where(F.col("source") == source).select(F.col("record_id").alias("seq"), I.normalize_doi("doi").alias("n_doi"), "reference_ids")
    named = p.select("seq", "n_doi", F.explode(F.array_compact(F.concat(F.array("n_doi"), F.coalesce(F.transform("reference_ids", I.normalize_doi), F.array().cast("array<string>"))))).alias("asked")).distinct()
    i = table(s, d, "repository_items").select(F.col("item_id").alias("lookup_id"), I.normalize_doi("doi").alias("asked"))
    return i.join(named, "asked").select("lookup_id", "asked", F.col("seq").alias("place"), "seq", "n_doi")


@query()
def s01b_own_doi(s, d):
    return connectors.own_doi(_answers(s, d, "DOAJ"))


@query()
def s02b_own_doi_first(s, d):
    return connectors.own_doi_first(_answers(s, d, "PubMed Central"))


@query()
def j11_id_bridge(s, d):
    p = table(s, d, "papers").select("record_id", "pmid", "pmcid", I.normalize_doi("doi").alias("n_doi"))
    return connectors.with_pmcid(p, connectors.pmc_bridge(p)).select("record_id", "found_pmcid")


@query()
def s05b_recommended(s, d):
    """The other members of a group as recommendations of its first one, asked for by that one's strongest identifier."""
    p = table(s, d, "papers").select(F.col("record_id").alias("query_id"), connectors.strongest_id().alias("identifier"))
    m = table(s, d, "merge_groups")
    first = m.groupBy("group_id").agg(F.min("record_id").alias("query_id"))
    edges = m.join(first, "group_id").where("record_id <> query_id").join(p, "query_id").select("identifier", F.col("record_id").alias("dst")).distinct().withColumn("place", F.col("dst"))
    return connectors.recommended(p, edges, 20)


@query()
def s07b_related_works(s, d):
    """References among OpenAlex's records as its related works; a search by title and topics tops up."""
    p = table(s, d, "papers").where("source = 'OpenAlex'").select(F.col("record_id").alias("seq"), I.normalize_openalex_id("source_id").alias("openalex_id"), "doi", "title", "reference_ids", F.slice(F.coalesce("topics", "keywords", F.array().cast("array<string>")), 1, 3).alias("t"))
    p = cut(p.withColumn("terms", S.content_tokens(T.normalize_title(F.concat_ws(" ", F.col("title"), F.array_join("t", " "))))).drop("title", "t"))
    refs = p.where("openalex_id is not null").select("openalex_id", F.posexplode("reference_ids").alias("place", "doi"))
    edges = refs.join(p.select("doi", F.col("openalex_id").alias("dst_id")), "doi").where("dst_id is not null").groupBy("openalex_id", "dst_id").agg(F.min("place").alias("place"))
    return connectors.related_works(p.select(F.col("seq").alias("query_id"), "openalex_id", "terms"), edges, p.select("seq", "openalex_id", "terms"), 10)


@query()
def k02_paper(s, d):
    """The record that answers an id, with its full text and its link filled in."""
    p = table(s, d, "papers").withColumn("n_doi", I.normalize_doi("doi"))
    i = table(s, d, "repository_items").select(F.col("item_id").alias("lookup_id"), F.lit("doi").alias("scheme"), I.normalize_doi("doi").alias("value")).where("value is not null")
    hit = engine.lookup_by_id(i, p).select("lookup_id", "record_id")
    x = fulltext.back_fill(hit.join(p, "record_id").withColumn("full_text", fulltext.derive_full_text()))
    return x.select("lookup_id", "record_id", "title", "full_text.access_type", "full_text.url", "pdf_url")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLE | {k: v for k, v in twins.SQL.items() if k in QUERIES}
