"""DuckDB twins of registered queries that need more than an expression: plain SQL over the same tables, written apart from the
operators so that the two can be held against each other."""

from __future__ import annotations

from . import oracle as O
from .functions import authors as A

Q = chr(39)
EMPTY = "[]::VARCHAR[]"


def _rows(columns: str, rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else O.q(v) if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) AS v({columns})"


def items(x: str) -> str:
    """Trimmed elements that aren't blank."""
    return f"list_filter(list_transform(list_filter(coalesce({x}, {EMPTY}), lambda e: e IS NOT NULL), lambda e: trim(e)), lambda e: e <> '')"


# Names -------------------------------------------------------------------------------------------------------

_TOK = "list_filter(string_split(regexp_replace({}, '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '' and not list_contains([" + ", ".join(f"'{w}'" for w in A.SUFFIXES) + "], t))"
_SURNAME = "'(?:^| )((?:(?:" + "|".join(A.PARTICLES) + ") )*[a-z]+)$'"


def parsed_names(source: str) -> str:
    """CTEs ending in ``names``: id, pos, full_name, last_name, initial of every element of (id, pos, raw) that is a name."""
    tok = lambda e: _TOK.format(f"lower({O.fold(e)})")
    return (
        f"n0 AS (SELECT id, pos, trim(raw) AS raw, instr(trim(raw), ',') AS c FROM ({source}) WHERE trim(raw) <> ''), "
        f"n1 AS (SELECT id, pos, c, CASE WHEN c > 1 THEN {tok('substr(raw, 1, c - 1)')} END AS s0, CASE WHEN c > 1 THEN {tok('substr(raw, c + 1)')} END AS g0, CASE WHEN c <= 1 THEN {tok('raw')} END AS w FROM n0), "
        "n2 AS (SELECT *, array_to_string(w, ' ') AS line, len(w) AS n FROM n1), "
        f"n3 AS (SELECT id, pos, CASE WHEN c > 1 THEN s0 WHEN n <= 1 THEN w WHEN length(w[n]) <= 2 AND length(w[1]) > 2 THEN w[1:n-1] ELSE string_split(regexp_extract(line, {_SURNAME}, 1), ' ') END AS sur, "
        f"CASE WHEN c > 1 THEN g0 WHEN n <= 1 THEN [] WHEN length(w[n]) <= 2 AND length(w[1]) > 2 THEN [w[n]] ELSE w[1:n - len(string_split(regexp_extract(line, {_SURNAME}, 1), ' '))] END AS giv FROM n2), "
        "n4 AS (SELECT id, pos, CASE WHEN len(sur) > 0 THEN sur WHEN len(giv) > 0 THEN giv[len(giv):len(giv)] END AS sur, CASE WHEN len(sur) > 0 THEN giv ELSE giv[1:len(giv)-1] END AS giv FROM n3), "
        "n5 AS (SELECT id, pos, array_to_string(list_concat(giv, sur), ' ') AS full_name, array_to_string(sur, ' ') AS last_name, substr(giv[1], 1, 1) AS initial FROM n4 WHERE sur IS NOT NULL), "
        "names AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, last_name, coalesce(initial, '') ORDER BY pos) AS nth FROM n5) WHERE nth = 1)"
    )


_LISTED = "SELECT {id} AS id, unnest(range(1, len({a}) + 1)) AS pos, unnest({a}) AS raw FROM {t}"

T11 = (
    f"WITH {parsed_names(_LISTED.format(id='record_id', a='authors', t='papers'))}, g AS (SELECT id, string_agg(last_name || coalesce('/' || initial, ''), '|' ORDER BY pos) AS authors, count(*)::INT AS n FROM names GROUP BY id) "
    "SELECT p.record_id, coalesce(g.authors, '') AS authors, coalesce(g.n, 0)::INT AS n FROM papers p LEFT JOIN g ON g.id = p.record_id"
)


def overlap(pairs: str) -> str:
    """CTEs from ``pairs`` (k, a, b: lists of names) to ``ov`` (k, overlap): each name of the shorter list takes its best free partner."""
    sim = "CASE WHEN x.last_name <> y.last_name THEN 0.0 WHEN x.full_name = y.full_name THEN 1.0 WHEN x.initial IS NULL OR y.initial IS NULL THEN 0.75 WHEN x.initial = y.initial THEN 0.9 ELSE 0.2 END"
    score = f"list_transform(l, lambda y, j: CASE WHEN list_contains(used, j) THEN -1.0::DOUBLE ELSE ({sim.replace('x.', 's[i + 1].')})::DOUBLE END)"
    return (
        f"o0 AS ({pairs}), o1 AS (SELECT k, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l FROM o0), "
        "o2 AS (SELECT k, s, l, 0 AS i, 0.0::DOUBLE AS total, []::BIGINT[] AS used FROM o1 UNION ALL "
        "SELECT k, s, l, i + 1, total + greatest(best, 0.0), CASE WHEN best > 0 THEN list_append(used, list_position(sc, best)::BIGINT) ELSE used END FROM "
        f"(SELECT *, list_max(sc) AS best FROM (SELECT *, {score} AS sc FROM o2 WHERE i < len(s) AND len(l) > 0))), "
        "ov AS (SELECT k, CASE WHEN len(s) = 0 OR len(l) = 0 THEN 0.0::DOUBLE ELSE total / len(s) END AS overlap FROM o2 WHERE i = len(s) OR len(l) = 0)"
    )


def _lists(names: str) -> str:
    return f"SELECT id, list({{'full_name': full_name, 'last_name': last_name, 'initial': initial}} ORDER BY pos) AS l FROM {names} GROUP BY id"


_NAME_TYPE = "STRUCT(full_name VARCHAR, last_name VARCHAR, initial VARCHAR)[]"
_DOI_PAIRS = f"SELECT p.record_id, i.item_id FROM (SELECT record_id, {O.normalize_doi('doi')} AS d FROM papers) p JOIN (SELECT item_id, {O.normalize_doi('doi')} AS d FROM repository_items) i ON p.d = i.d"
T12 = (
    f"WITH RECURSIVE {parsed_names(_LISTED.format(id='record_id', a='authors', t='papers') + ' UNION ALL ' + _LISTED.format(id='-item_id', a='authors', t='repository_items'))}, "
    f"nl AS ({_lists('names')}), "
    + overlap(f"SELECT {{'r': record_id, 'i': item_id}} AS k, coalesce(x.l, []::{_NAME_TYPE}) AS a, coalesce(y.l, []::{_NAME_TYPE}) AS b FROM ({_DOI_PAIRS}) LEFT JOIN nl x ON x.id = record_id LEFT JOIN nl y ON y.id = -item_id")
    + f" SELECT k.r AS record_id, k.i AS item_id, {O.round_score('overlap')} AS overlap FROM ov"
)

SQL = {"t11_authors": T11, "t12_author_overlap": T12}

# Dimension of sources -----------------------------------------------------------------------------------------

_ROLES = {
    "primary": "doaj pubmed core arxiv semanticScholar", "fallback": "crossref openalex", "extended": "europepmc datacite",
    "similar": "semanticScholar openalex europepmc arxiv core", "fulltext": "europepmc unpaywall openalex pubmed core semanticScholar",
}
_NAMES = {"doaj": "DOAJ", "pubmed": "PubMed Central", "core": "CORE", "arxiv": "arXiv", "semanticScholar": "Semantic Scholar", "crossref": "Crossref", "openalex": "OpenAlex", "europepmc": "Europe PMC", "datacite": "DataCite", "unpaywall": "Unpaywall"}
_REASON = {"core": "an API key is required", "unpaywall": "a contact address is required"}
_SOURCES = [(role, n, k, _NAMES[k], k not in _REASON, _REASON.get(k)) for role, keys in _ROLES.items() for n, k in enumerate(keys.split())]
SOURCES = f"SELECT role, ordinal::INT AS ordinal, source_key, source_name, available, reason FROM {_rows('role, ordinal, source_key, source_name, available, reason', _SOURCES)}"
SQL["s11_sources"] = SOURCES
_POLICY = [("doaj", 2.0, None, 2, 2), ("pubmed", 3.0, None, 1, 2), ("core", 1.0, 10, 1, 2), ("arxiv", 1 / 3, None, 1, 2), ("semanticScholar", 1.0, None, 1, 3), ("crossref", 5.0, None, 2, 2), ("openalex", 5.0, None, 2, 2), ("europepmc", 2.0, None, 1, 2), ("datacite", 2.0, None, 1, 2), ("unpaywall", 5.0, None, 2, 2)]
SQL["s13_traffic_policy"] = f"SELECT source, per_second, per_minute::INT AS per_minute, at_once::INT AS at_once, retries::INT AS retries, greatest(1.0::DOUBLE, least(per_second, at_once::DOUBLE)) AS capacity FROM {_rows('source, per_second, per_minute, at_once, retries', _POLICY)}"

# Validation ----------------------------------------------------------------------------------------------------

_SAFE = lambda x: f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{200b}}-\\x{{200f}}\\x{{2028}}\\x{{2029}}\\x{{feff}}]', ' ', 'g'), '[\\x20\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
_CHECKS = [
    ("length(title) > 500", "title too long"), ("len(topics) > 20", "too many keywords"), ("len(list_filter(topics, lambda t: length(t) > 100)) > 0", "keyword too long"), ("length(doi) > 300", "doi too long"),
    (f"{_SAFE('doi')} <> '' AND {O.normalize_doi('doi')} IS NULL", "doi not recognised"), ("year < 1500 OR year > 2028", "from_year out of range"), ("year > 2020", "from_year after to_year"),
    (f"{_SAFE('title')} = '' AND {_SAFE('doi')} = '' AND coalesce(len(list_filter(topics, lambda t: {_SAFE('t')} <> '')), 0) = 0", "no search field"),
]
SQL["f10_validation"] = f"SELECT input_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {O.q(m)} END' for c, m in _CHECKS)}], lambda m: m IS NOT NULL), '; ') AS errors FROM build_inputs"

# Links ---------------------------------------------------------------------------------------------------------

_ALL_URLS = "SELECT trim(u) AS u FROM (SELECT unnest([pdf_url, landing_page_url]) AS u FROM papers) WHERE u IS NOT NULL"
_PARTS = (
    f"u0 AS ({_ALL_URLS}), u1 AS (SELECT u, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS authority FROM u0), "
    "u2 AS (SELECT scheme, CASE WHEN contains(authority, '@') THEN regexp_extract(authority, '^(.*)@', 1) ELSE '' END AS userinfo, lower(regexp_extract(regexp_replace(authority, '^.*@', ''), '^([^:]*)', 1)) AS host, regexp_extract(regexp_replace(authority, '^.*@', ''), ':(\\d+)$', 1) AS port FROM u1)"
)
SQL["f12_url_policy"] = (
    f"WITH {_PARTS}, v AS (SELECT CASE WHEN scheme = '' OR host = '' THEN 'not a valid absolute URL' WHEN scheme <> 'https' THEN 'scheme is not permitted' WHEN userinfo <> '' THEN 'embedded credentials are not permitted' "
    "WHEN port NOT IN ('', '443', '80') THEN 'port is not permitted' WHEN host = 'localhost' OR regexp_matches(host, '^(?:0|10|127)\\.') OR regexp_matches(host, '^192\\.168\\.') OR regexp_matches(host, '^172\\.(?:1[6-9]|2\\d|3[01])\\.') THEN 'private, loopback or reserved address' "
    "ELSE 'host is not on the academic API allowlist' END AS verdict FROM u2) SELECT verdict, count(*) AS n FROM v GROUP BY verdict"
)

# One-line queries: the line is made of three parts, so only a part's own rules matter.
_LINE = "SELECT item_id, title, authors[1] AS author, year FROM repository_items"
SQL["k07_free_text"] = (
    f"WITH l AS ({_LINE}) SELECT item_id, nullif(trim(title), '') AS title, nullif(trim(author), '') AS authors, year AS from_year, NULL::INT AS to_year FROM l"
)

# Look-ups --------------------------------------------------------------------------------------------------------

_ORDER = "CASE source WHEN 'DOAJ' THEN 0 WHEN 'PubMed Central' THEN 1 WHEN 'CORE' THEN 2 WHEN 'arXiv' THEN 3 WHEN 'Semantic Scholar' THEN 4 WHEN 'Crossref' THEN 5 WHEN 'OpenAlex' THEN 6 END"
SQL["j03_id_dispatch"] = (
    f"WITH p AS (SELECT record_id, {O.normalize_doi('doi')} AS d, lower(pmid) AS pmid, source, {_ORDER} AS ordinal FROM papers), "
    f"a AS (SELECT item_id AS lookup_id, 'doi' AS scheme, {O.normalize_doi('doi')} AS value FROM repository_items UNION ALL SELECT -record_id, 'pmid', pmid FROM papers WHERE pmid IS NOT NULL), "
    "h AS (SELECT a.*, p.record_id, p.ordinal FROM a JOIN p ON a.scheme = 'doi' AND a.value = p.d WHERE p.ordinal IS NOT NULL UNION ALL SELECT a.*, p.record_id, p.ordinal FROM a JOIN p ON a.scheme = 'pmid' AND a.value = p.pmid WHERE p.source = 'PubMed Central'), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY ordinal, record_id) AS rn FROM h) SELECT lookup_id, scheme, record_id, ordinal::INT AS ordinal FROM r WHERE rn = 1"
)

# Full text -----------------------------------------------------------------------------------------------------

LOCATION = (
    "CASE WHEN nullif(pdf_url, '') IS NOT NULL THEN 'pdf' WHEN nullif(landing_page_url, '') IS NOT NULL OR nullif(doi, '') IS NOT NULL THEN 'html' END AS type, "
    "CASE WHEN nullif(pdf_url, '') IS NOT NULL THEN (CASE WHEN is_open_access = false THEN 'publisher' WHEN is_open_access THEN 'open-access' WHEN nullif(pmcid, '') IS NOT NULL OR nullif(arxiv_id, '') IS NOT NULL OR source IN ('CORE', 'DOAJ') THEN 'repository' ELSE 'publisher' END) "
    "WHEN nullif(landing_page_url, '') IS NOT NULL THEN (CASE WHEN is_open_access THEN 'open-access' ELSE 'landing-page' END) WHEN nullif(doi, '') IS NOT NULL THEN 'landing-page' ELSE 'unavailable' END AS access_type, "
    "CASE WHEN nullif(pdf_url, '') IS NOT NULL THEN true WHEN nullif(landing_page_url, '') IS NOT NULL THEN coalesce(is_open_access, false) ELSE false END AS available, "
    "coalesce(nullif(pdf_url, ''), nullif(landing_page_url, ''), 'https://doi.org/' || nullif(doi, '')) AS url"
)


def best_location(locations: str) -> str:
    """CTEs from ``locations`` (main, seq, source, type, access_type, available, url) to ``bl``: the chain ends at the first free PDF, the best stands."""
    free = "CASE WHEN type = 'pdf' AND access_type IN ('open-access', 'repository') THEN 1 ELSE 0 END"
    score = "CASE access_type WHEN 'open-access' THEN 50 WHEN 'repository' THEN 40 WHEN 'publisher' THEN 30 WHEN 'landing-page' THEN 20 ELSE 10 END + CASE WHEN type = 'pdf' THEN 3 ELSE 0 END + CASE WHEN available THEN 2 ELSE 0 END - CASE WHEN url IS NULL THEN 20 ELSE 0 END"
    return (
        f"b0 AS ({locations}), b1 AS (SELECT *, coalesce(sum({free}) OVER (PARTITION BY main ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier, {score} AS score FROM b0), "
        "bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY main ORDER BY score DESC, seq) AS rn FROM b1 WHERE earlier = 0) WHERE rn = 1)"
    )


_KNOWN = "coalesce(doi, pmcid, pmid, arxiv_id) IS NOT NULL"
SQL["j10_resolver_chain"] = (
    f"WITH m AS (SELECT DISTINCT group_id, record_id FROM merge_groups), f AS (SELECT group_id, min(record_id) AS main FROM m GROUP BY group_id), lo AS (SELECT record_id, source, {LOCATION} FROM papers), "
    "rest AS (SELECT f.main, row_number() OVER (PARTITION BY m.group_id ORDER BY m.record_id) AS seq, m.record_id FROM m JOIN f USING (group_id) WHERE m.record_id <> f.main), "
    + best_location(f"SELECT record_id AS main, -1 AS seq, lo.* EXCLUDE record_id FROM lo WHERE record_id IN (SELECT main FROM f) UNION ALL SELECT rest.main, rest.seq, lo.* EXCLUDE record_id FROM rest JOIN lo USING (record_id) WHERE rest.main IN (SELECT record_id FROM papers WHERE {_KNOWN})")
    + " SELECT p.record_id, bl.source, bl.type, bl.access_type, CASE WHEN nullif(p.pdf_url, '') IS NULL AND bl.type = 'pdf' THEN bl.url ELSE p.pdf_url END AS pdf_url, CASE WHEN p.is_open_access IS NULL AND bl.available THEN true ELSE p.is_open_access END AS is_open_access FROM bl JOIN papers p ON p.record_id = bl.main"
)
_NEED = f"nullif(pdf_url, '') IS NULL AND {_KNOWN}"
SQL["c10_enrich"] = (
    f"WITH m AS (SELECT DISTINCT group_id, record_id FROM merge_groups), lo AS (SELECT record_id, source, {LOCATION} FROM papers), need AS (SELECT record_id FROM papers WHERE {_NEED}), "
    "asked AS (SELECT a.record_id AS main, b.record_id AS seq, b.record_id FROM m a JOIN m b ON a.group_id = b.group_id AND a.record_id <> b.record_id WHERE b.record_id % 2 = 0), "
    + best_location("SELECT record_id AS main, -1 AS seq, lo.* EXCLUDE record_id FROM lo WHERE record_id IN (SELECT record_id FROM need) UNION ALL SELECT asked.main, asked.seq, lo.* EXCLUDE record_id FROM asked JOIN lo USING (record_id) WHERE asked.main IN (SELECT record_id FROM need)")
    + " SELECT p.record_id, coalesce(CASE WHEN bl.type = 'pdf' THEN bl.url END, p.pdf_url) AS pdf_url, CASE WHEN bl.type = 'pdf' THEN coalesce(p.is_open_access, true) ELSE p.is_open_access END AS is_open_access FROM papers p LEFT JOIN bl ON bl.main = p.record_id"
)

# Groups ----------------------------------------------------------------------------------------------------------

_KEY = f"unnest(['doi:' || {O.normalize_doi('doi')}, 'pmcid:' || upper(nullif(pmcid, '')), 'pmid:' || nullif(pmid, ''), 'arxiv:' || lower(regexp_replace(nullif(arxiv_id, ''), '(?i)v\\d+$', '')), 'src:' || source || ':' || nullif(source_id, '')])"
SQL["j04_components"] = (
    f"WITH RECURSIVE k AS (SELECT record_id, k FROM (SELECT record_id, {_KEY} AS k FROM papers) WHERE k IS NOT NULL), e AS (SELECT DISTINCT x.record_id AS a, y.record_id AS b FROM k x JOIN k y USING (k)), "
    "w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT a AS record_id, min(b) AS component FROM w GROUP BY a"
)

_LISTS = {"keywords": ("v", 30), "topics": ("v", 30), "reference_ids": ("v", 200), "sources": ("v", 10**9)}
_FIRST = "doi pmid pmcid arxiv_id year journal conference publisher".split()
_TRUST = "CASE {} WHEN 'Crossref' THEN 6 WHEN 'PubMed Central' THEN 6 WHEN 'OpenAlex' THEN 5 WHEN 'Semantic Scholar' THEN 4 WHEN 'DOAJ' THEN 4 WHEN 'arXiv' THEN 3 WHEN 'CORE' THEN 2 ELSE 1 END"


def _joined_list(name: str, cap: int) -> str:
    value = "coalesce(sources, [source])" if name == "sources" else name
    return (
        f"l_{name} AS (SELECT head, list(v ORDER BY seq, pos) AS l FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY seq, pos) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY head, lower(v) ORDER BY seq, pos) AS nth FROM "
        f"(SELECT head, seq, unnest(range(len({value}))) AS pos, unnest({value}) AS v FROM m) WHERE v IS NOT NULL) WHERE nth = 1) WHERE rn <= {cap} GROUP BY head)"
    )


SQL["g02_merge"] = (
    "WITH RECURSIVE g AS (SELECT DISTINCT head, seq FROM (SELECT record_id AS seq, min(record_id) OVER (PARTITION BY group_id) AS head FROM merge_groups)), "
    + f"m AS (SELECT g.head, g.seq, p.* REPLACE (nullif(doi, '') AS doi, nullif(pmid, '') AS pmid, nullif(pmcid, '') AS pmcid, nullif(arxiv_id, '') AS arxiv_id, nullif(source_id, '') AS source_id, coalesce(title, '') AS title, coalesce(authors, {EMPTY}) AS authors), {_TRUST.format('source')} AS trust FROM g JOIN papers p ON p.record_id = g.seq), "
    + "h AS (SELECT * FROM m WHERE seq = head), "
    + ", ".join(_joined_list(n, cap) for n, (_, cap) in _LISTS.items())
    + ", lk AS (SELECT head, list(concat_ws(';', l.source, coalesce(l.pdf_url, ''), coalesce(l.landing_page_url, '')) ORDER BY seq, pos) AS l FROM (SELECT *, row_number() OVER (PARTITION BY head, l.source, coalesce(l.pdf_url, ''), coalesce(l.landing_page_url, '') ORDER BY seq, pos) AS nth "
    "FROM (SELECT head, seq, unnest(range(len(source_links))) AS pos, unnest(source_links) AS l FROM m)) WHERE nth = 1 GROUP BY head), "
    # the abstracts of a group are walked through in order
    "ab AS (SELECT head, list({'n': length(abstract), 'a': abstract} ORDER BY seq) AS l FROM m WHERE length(abstract) > 0 GROUP BY head), "
    "aw AS (SELECT head, l, 1 AS i, l[1].a AS a FROM ab UNION ALL SELECT head, l, i + 1, CASE WHEN l[i + 1].n > 1.2 * length(a) THEN l[i + 1].a ELSE a END FROM aw WHERE i < len(l)), "
    + f"tl AS (SELECT m.head, list(m.title ORDER BY m.seq) AS l FROM m JOIN h USING (head) WHERE m.trust >= h.trust GROUP BY m.head), "
    + "tw AS (SELECT tl.head, l, 0 AS i, h.title AS t FROM tl JOIN h USING (head) UNION ALL SELECT head, l, i + 1, "
    + f"CASE WHEN length(l[i + 1]) > 1.15 * length(t) AND {O.normalize_title('l[i + 1]')} = {O.normalize_title('t')} AND {O.normalize_title('t')} <> '' THEN l[i + 1] ELSE t END FROM tw WHERE i < len(l)), "
    + "a0 AS (SELECT m.head, m.seq, m.authors, len(m.authors) AS n, m.trust > h.trust AS better, max(len(m.authors)) OVER (PARTITION BY m.head) AS most FROM m JOIN h USING (head)), "
    "au AS (SELECT head, authors FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY better DESC, CASE WHEN better THEN -seq ELSE seq END) AS rn FROM a0 WHERE n = most) WHERE rn = 1), "
    "o AS (SELECT m.head, count(*) AS n_members, "
    + ", ".join(f"arg_min(m.{c}, m.seq) AS {c}" for c in _FIRST)
    + ", arg_min(CASE WHEN m.source = h.source THEN m.source_id END, m.seq) AS source_id, bool_or(m.is_open_access) AS is_open_access, max(CASE WHEN m.seq <> m.head THEN m.citation_count END) AS later_count, max(CASE WHEN m.seq <> m.head AND NOT isnan(m.similarity_score) THEN m.similarity_score END) AS later_score, "
    "arg_min(nullif(m.pdf_url, ''), m.seq) AS pdf_url, arg_min(nullif(m.landing_page_url, ''), m.seq) AS landing_page_url FROM m JOIN h USING (head) GROUP BY m.head), "
    "co AS (SELECT head, confidence, match_type FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY coalesce(confidence, 0) DESC, seq) AS rn FROM m) WHERE rn = 1) "
    "SELECT o.head AS first_seq, o.n_members, (SELECT t FROM tw WHERE tw.head = o.head AND i = len(l)) AS title, "
    + ", ".join(f"o.{c}" for c in _FIRST)
    + ", h.source, o.source_id, array_to_string(list_transform(au.authors, lambda x: coalesce(x, '~')), '|') AS authors, array_to_string(l_sources.l, '|') AS sources, coalesce(array_to_string(lk.l, '|'), '') AS links, array_to_string(l_keywords.l, '|') AS keywords, array_to_string(l_topics.l, '|') AS topics, len(l_reference_ids.l)::INT AS n_references, "
    "CASE WHEN later_count IS NOT NULL THEN greatest(coalesce(h.citation_count, 0), later_count) ELSE h.citation_count END AS citation_count, coalesce(o.pdf_url, h.pdf_url) AS pdf_url, coalesce(o.landing_page_url, h.landing_page_url) AS landing_page_url, o.is_open_access, co.confidence, co.match_type, "
    "CASE WHEN later_score IS NOT NULL THEN greatest(coalesce(h.similarity_score, 0), later_score) ELSE h.similarity_score END AS similarity_score, (SELECT a FROM aw WHERE aw.head = o.head AND i = len(l)) AS abstract "
    "FROM o JOIN h USING (head) JOIN au USING (head) JOIN co USING (head) LEFT JOIN l_sources USING (head) LEFT JOIN l_keywords USING (head) LEFT JOIN l_topics USING (head) LEFT JOIN l_reference_ids USING (head) LEFT JOIN lk USING (head)"
)

# Greedy grouping: one step per record in order. ``gs`` holds each group's deciding state, ``ow`` the owner of every key; both travel as
# lists in the recursion, so this is for small tables.
_SIM = (
    "CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE greatest(0.45::DOUBLE * ({j}) + 0.35::DOUBLE * (CASE WHEN len({ga}) = 0 OR len({gb}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({ga}, {gb})) / (len({ga}) + len({gb})) END) "
    "+ 0.2::DOUBLE * (1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}), 1)), CASE WHEN least(length({a}), length({b})) >= 20 AND (CASE WHEN length({a}) <= length({b}) THEN starts_with({b}, {a}) ELSE starts_with({a}, {b}) END) THEN 0.9 ELSE 0.0 END) END"
)


def title_similarity(a: str, b: str, wa: str, wb: str, ga: str, gb: str) -> str:
    """Of normalized titles with their sets of words and character pairs."""
    return _SIM.format(a=a, b=b, j=O.jaccard(wa, wb), ga=ga, gb=gb)


# Traffic ----------------------------------------------------------------------------------------------------------

_EV = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
# a rate of one an hour counts as the least one, one in a thousand seconds; at most one token at hand; the ceiling of ten a minute looks at the tenth admission back
SQL["r01_token_bucket"] = (
    f"WITH RECURSIVE {_EV}, st AS (SELECT event_id, user_id, n, t, true AS ok, 0.0::DOUBLE AS wait, 0.0::DOUBLE AS tokens, [t] AS took FROM ev WHERE n = 1 UNION ALL "
    "SELECT event_id, user_id, n, t, ok, wait, CASE WHEN ok THEN have - 1 ELSE have END, CASE WHEN ok THEN list_append(took, t) ELSE took END FROM (SELECT *, have >= 1 AND NOT full_minute AS ok, "
    "greatest(greatest(0.0::DOUBLE, (1 - have)) / 0.001::DOUBLE * 1000, CASE WHEN len(took) >= 10 THEN greatest(0.0::DOUBLE, took[-10] + 60000 - t) ELSE 0 END) AS wait FROM "
    "(SELECT e.event_id, e.user_id, e.n, e.t, s.took, least(1.0::DOUBLE, s.tokens + (e.t - s.t) / 1000 * 0.001::DOUBLE) AS have, len(list_filter(s.took, lambda x: x > e.t - 60000)) >= 10 AS full_minute FROM st s JOIN ev e ON e.user_id = s.user_id AND e.n = s.n + 1))) "
    "SELECT event_id, user_id, ok AS admitted, round(wait, 3) AS wait_ms FROM st"
)
SQL["r07_breaker"] = (
    f"WITH RECURSIVE {_EV}, st AS (SELECT NULL::BIGINT AS event_id, user_id, 0::BIGINT AS n, true AS allowed, 'CLOSED' AS state, 0 AS failures, NULL::DOUBLE AS opened, 0 AS trips FROM ev WHERE n = 1 UNION ALL "
    "SELECT event_id, user_id, n, mode <> 'OPEN', CASE WHEN mode = 'OPEN' THEN 'OPEN' WHEN trip THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN mode = 'OPEN' THEN failures WHEN mode = 'HALF_OPEN' THEN CASE WHEN bad THEN failures ELSE 0 END WHEN bad THEN failures + 1 ELSE 0 END, "
    "CASE WHEN mode = 'OPEN' THEN opened WHEN trip THEN t WHEN mode = 'HALF_OPEN' THEN NULL ELSE opened END, trips + CASE WHEN trip THEN 1 ELSE 0 END FROM "
    "(SELECT *, mode = 'HALF_OPEN' AND bad OR mode = 'CLOSED' AND bad AND failures + 1 >= 2 AS trip FROM (SELECT e.event_id, e.user_id, e.n, e.t, e.event_type = 'error' AS bad, s.failures, s.opened, s.trips, CASE WHEN s.state = 'OPEN' AND e.t >= s.opened + 3600000 THEN 'HALF_OPEN' ELSE s.state END AS mode "
    "FROM st s JOIN ev e ON e.user_id = s.user_id AND e.n = s.n + 1))) SELECT event_id, user_id, allowed, state, trips::INT AS trips FROM st WHERE event_id IS NOT NULL"
)
# the cache is a list of (key, until), oldest use first
SQL["r09_cache"] = (
    f"WITH RECURSIVE {_EV}, st AS (SELECT NULL::BIGINT AS event_id, user_id, 0::BIGINT AS n, false AS hit, []::STRUCT(k VARCHAR, u DOUBLE)[] AS c, 0::BIGINT AS ev_n FROM ev WHERE n = 1 UNION ALL "
    "SELECT event_id, user_id, n, hit, CASE WHEN len(kept) > 6 THEN kept[len(kept) - 5:] ELSE kept END, ev_n + greatest(len(kept) - 6, 0) FROM (SELECT *, CASE WHEN len(put) > 6 THEN list_filter(put, lambda x: x.u > t) ELSE put END AS kept FROM "
    "(SELECT *, found IS NOT NULL AS hit, list_append(list_filter(c, lambda x: x.k <> key), {'k': key, 'u': coalesce(found, t + 86400000.0::DOUBLE)}) AS put FROM "
    "(SELECT e.event_id, e.user_id, e.n, e.t, e.event_type || ':' || (e.event_id % 5)::VARCHAR AS key, s.c, s.ev_n, list_filter(s.c, lambda x: x.k = e.event_type || ':' || (e.event_id % 5)::VARCHAR AND x.u > e.t)[1].u AS found FROM st s JOIN ev e ON e.user_id = s.user_id AND e.n = s.n + 1)))) "
    "SELECT event_id, user_id, hit, len(c)::INT AS entries, ev_n::INT AS evictions FROM st WHERE event_id IS NOT NULL"
)
_STATUS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'skipped' WHEN 'click' THEN 'rate-limited' WHEN 'view' THEN 'unavailable' ELSE 'failed' END"
SQL["k03_source_report"] = (
    f"WITH so AS ({SOURCES}), r AS (SELECT source_key, source_name, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, bool_or(available) AS available FROM so GROUP BY ALL), "
    f"lg AS (SELECT [{', '.join(O.q(n) for n in _NAMES.values())}][(event_id % 10 + 1)::INT] AS name, {_STATUS} AS status, floor(value)::BIGINT AS ms, event_id % 20 AS results, event_id FROM events) "
    "SELECT r.*, g.* EXCLUDE name FROM r LEFT JOIN (SELECT name, count(*) AS requests, sum((status = 'success')::INT)::BIGINT AS successes, sum(results)::BIGINT AS results, round(avg(ms), 4) AS mean_ms, arg_max(status, event_id) AS last_status FROM lg GROUP BY name) g ON g.name = r.source_name"
)

# Search expressions -------------------------------------------------------------------------------------------

_CLEAN = {  # how a source makes a value harmless
    "doaj": lambda x: f"substr({O.collapse(_esc(x))}, 1, 500)", "core": lambda x: f"substr({O.collapse(_esc(x))}, 1, 500)",
    "pubmed": lambda x: f"substr({O.collapse(O.rx(x, '[' + chr(34) + chr(92) + '[' + chr(92) + ']():*~]', ' '))}, 1, 400)", "arxiv": lambda x: f"substr({O.collapse(O.rx(x, '[' + chr(34) + '()]', ' '))}, 1, 400)",
    "europepmc": lambda x: f"substr({O.collapse(O.rx(x, '[' + chr(34) + '():]', ' '))}, 1, 400)", "datacite": lambda x: f"substr({O.collapse(O.rx(x, '[' + chr(92) + chr(92) + chr(34) + '~^]', ' '))}, 1, 400)",
}
_FIELDS = {"doaj": ("bibjson.title:\"%\"", "bibjson.author.name:\"%\"", "doi:\"%\""), "pubmed": ("%[Title]", "%[Author]", "%[DOI]"), "core": ("title:\"%\"", "authors:\"%\"", "doi:\"%\""), "arxiv": ("ti:\"%\"", "au:\"%\"", None), "europepmc": ("TITLE:\"%\"", "AUTH:\"%\"", "DOI:\"%\""), "datacite": ("titles.title:\"%\"", "creators.name:\"%\"", "doi:\"%\"")}


def _esc(x: str) -> str:
    return f"regexp_replace({x}, '([\\\\\"])', '\\\\\\1', 'g')"


def _fill(template: str, x: str) -> str:
    head, tail = template.split("%")
    return f"({O.q(head)} || {x} || {O.q(tail)})"


def _fielded(key: str) -> str:
    title, author, doi = _FIELDS[key]
    c = _CLEAN[key]
    some = lambda t, x: f"(CASE WHEN {c(x)} <> '' THEN {_fill(t, c(x))} END)"
    id_ = some(doi, "nd") if doi else "NULL"
    parts = f"list_concat({'[' + id_ + '], ' if key == 'doaj' else ''}[{some(title, 'title')}], list_transform(au, lambda a: {some(author, 'a')}))"
    parts = parts if key == "doaj" else f"list_concat([{some(title, 'title')}], list_transform(au, lambda a: {some(author, 'a')}))"
    text = f"nullif(array_to_string(list_filter({parts}, lambda p: p IS NOT NULL), ' AND '), '')"
    return text if key == "doaj" else f"coalesce({id_}, {text})"


_LINE_OF = f"array_to_string(list_concat(CASE WHEN title <> '' THEN [title] ELSE {EMPTY} END, au), ' ')"
_PLAIN = f"nullif(substr({O.collapse(_LINE_OF)}, 1, 500), '')"
_XREF = f"nullif(array_to_string(list_filter(['query.bibliographic=' || nullif(substr({O.collapse('title')}, 1, 500), ''), 'query.author=' || nullif(substr({O.collapse('array_to_string(au, ' + Q + ' ' + Q + ')')}, 1, 500), '')], lambda p: p IS NOT NULL), '&'), '')"
_OA_SAFE = lambda x: f"substr({O.collapse(O.rx(x, '[,:|]', ' '))}, 1, 350)"
_OA = f"CASE WHEN title <> '' THEN 'filter=title.search:' || {_OA_SAFE('title')} || coalesce(',raw_author_name.search:' || {_OA_SAFE('au[1]')}, '') ELSE 'search=' || nullif(substr({O.collapse('array_to_string(au, ' + Q + ' ' + Q + ')')}, 1, 350), '') END"
_EXPRESSIONS = {**{k: _fielded(k) for k in _FIELDS}, "crossref": _XREF, "openalex": _OA, "semanticScholar": _PLAIN}
SQL["s01_expressions"] = f"WITH i AS (SELECT item_id, title, {O.normalize_doi('doi')} AS nd, {items('authors')} AS au FROM repository_items) " + " UNION ALL ".join(f"SELECT item_id, {O.q(k)} AS source, {e} AS expression FROM i" for k, e in _EXPRESSIONS.items())
_AX = _CLEAN["arxiv"]
_EIGHT = "array_to_string(regexp_split_to_array(title, '\\s+')[1:8], ' ')"
_CAT = "list_filter(coalesce(topics, []::VARCHAR[]), lambda t: regexp_full_match(t, '[a-z-]+(?:\\.[A-Za-z-]+)?'))[1]"
SQL["s04_arxiv_related"] = f"SELECT record_id, nullif(array_to_string(list_filter([CASE WHEN {_EIGHT} <> '' THEN 'all:\"' || {_AX(_EIGHT)} || '\"' END, 'cat:' || {_AX(_CAT)}], lambda p: p IS NOT NULL), ' AND '), '') AS expression FROM papers"

# Crossref's own records, as they come back from their payloads
_PEOPLE = "SELECT record_id, list(coalesce(nullif(name, ''), CASE WHEN family <> '' AND given <> '' THEN given || ' ' || family END, nullif(family, '')) ORDER BY author_position, author_row_id) AS a FROM crossref_authors GROUP BY record_id"
SQL["proj11_crossref_scan"] = (
    f"WITH pe AS ({_PEOPLE}), x AS (SELECT record_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM pe), y AS (SELECT record_id, pos, {O.collapse('raw')} AS v FROM x WHERE raw IS NOT NULL), "
    "z AS (SELECT record_id, pos, CASE WHEN instr(v, ',') > 1 AND trim(substr(v, 1, instr(v, ',') - 1)) <> '' AND trim(substr(v, instr(v, ',') + 1)) <> '' THEN trim(substr(v, instr(v, ',') + 1)) || ' ' || trim(substr(v, 1, instr(v, ',') - 1)) ELSE v END AS n FROM y WHERE v <> ''), "
    "au AS (SELECT record_id, string_agg(n, '|' ORDER BY pos) AS authors FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lower(n) ORDER BY pos) AS nth FROM z) WHERE nth = 1 GROUP BY record_id), "
    f"r0 AS (SELECT record_id, unnest(range(len(reference_ids))) AS pos, unnest(reference_ids) AS ref FROM papers WHERE source = 'Crossref'), r1 AS (SELECT record_id, pos, {O.normalize_doi('ref')} AS d FROM r0), "
    "r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS k FROM r1 WHERE d IS NOT NULL) WHERE k <= 100), rf AS (SELECT record_id, count(DISTINCT d)::INT AS n FROM r2 GROUP BY record_id), "
    f"p AS (SELECT record_id, {O.strip_markup('title')} AS title, {O.normalize_doi('doi')} AS doi, CASE WHEN year BETWEEN 1500 AND 2028 THEN year END AS year, nullif({O.strip_markup('journal')}, '') AS journal, CASE WHEN citation_count >= 0 THEN citation_count END AS citation_count FROM papers WHERE source = 'Crossref') "
    "SELECT title, doi, year, journal, coalesce(authors, '') AS authors, citation_count, rf.n AS n_refs FROM p LEFT JOIN au USING (record_id) LEFT JOIN rf USING (record_id) WHERE title <> ''"
)

# Whole queries --------------------------------------------------------------------------------------------------

_YEAR = 2026
_TIER = "CASE source WHEN 'DOAJ' THEN 0 WHEN 'PubMed Central' THEN 0 WHEN 'CORE' THEN 0 WHEN 'arXiv' THEN 0 WHEN 'Semantic Scholar' THEN 0 WHEN 'Crossref' THEN 1 WHEN 'OpenAlex' THEN 1 WHEN 'Europe PMC' THEN 2 WHEN 'DataCite' THEN 2 END"
_ORDINAL = "CASE source WHEN 'PubMed Central' THEN 1 WHEN 'CORE' THEN 2 WHEN 'arXiv' THEN 3 WHEN 'Semantic Scholar' THEN 4 WHEN 'OpenAlex' THEN 1 WHEN 'DataCite' THEN 1 ELSE 0 END"
_WORD_SET = lambda lists: f"list_distinct(list_filter(flatten(list_transform({lists}, lambda e: regexp_split_to_array(e, '\\s+'))), lambda t: t <> '' AND NOT list_contains({O.STOP}, t)))"
_SOME = lambda c: f"list_filter(coalesce({c}, {EMPTY}), lambda e: e IS NOT NULL)"
PAPERS = (
    f"p0 AS MATERIALIZED (SELECT *, {O.normalize_title('title')} AS nt, {O.normalize_title('title', False)} AS nf, {O.normalize_title('coalesce(journal, conference)')} AS nv, {O.normalize_doi('doi')} AS nd, {_TIER} AS tier, {_ORDINAL} AS ordinal FROM papers), "
    f"p AS MATERIALIZED (SELECT *, list_distinct({O.words('nt')}) AS wt, {O.bigrams('nt')} AS gt, replace({O.bare('nf')}, ' ', '') AS fp, {O.bare('nt')} AS bare, {_WORD_SET(f'list_concat({_SOME('keywords')}, {_SOME('topics')}, [{O.bare('nt')}])')} AS nw FROM p0)"
)
_HINT = "coalesce(nullif(regexp_extract(title, '\\(((?:19|20)\\d{2})\\)', 1), ''), nullif(regexp_extract(title, '\\b((?:19|20)\\d{2})\\b', 1), ''))"
ITEMS = (
    f"q0 AS MATERIALIZED (SELECT item_id AS query_id, nullif({O.collapse('title')}, '') AS title, {items('authors')} AS au, {O.normalize_doi('doi')} AS doi, {O.normalize_title('title')} AS nt, try_cast({_HINT} AS INT) AS hint FROM repository_items), "
    f"q AS MATERIALIZED (SELECT query_id, title, au, doi, nt, list_distinct({O.words('nt')}) AS wt, {O.bigrams('nt')} AS gt, array_to_string(list_filter(string_split({O.bare('nt')}, ' '), lambda t: t <> ''), ' ') AS fuzzy, CASE WHEN hint BETWEEN 1900 AND {_YEAR + 1} THEN hint END AS hint FROM q0)"
)
_OPTION = lambda when, label, precision, n: f"CASE WHEN {when} THEN {{'label': '{label}', 'precision': '{precision}', 'n': {n}}} END"
VARIANTS = (
    "v0 AS (SELECT query_id, list_filter(["
    + ", ".join(
        [
            _OPTION("doi IS NOT NULL", "doi", "identifier", 5), _OPTION("title IS NOT NULL", "exact-title", "high", 20), _OPTION("title IS NOT NULL AND len(au) > 0", "title-author", "high", 20),
            _OPTION("title IS NOT NULL AND fuzzy <> '' AND fuzzy <> nt", "fuzzy-title", "medium", 20), _OPTION("title IS NULL AND doi IS NULL AND len(au) > 0", "authors-only", "low", 20),
        ]
    )
    + "], lambda o: o IS NOT NULL) AS o FROM q), v AS MATERIALIZED (SELECT query_id, unnest(range(len(o)))::INT AS pos, unnest(o) AS o FROM v0)"
)
SQL["c02_variants"] = f"WITH {ITEMS}, {VARIANTS} SELECT query_id, pos AS variant_pos, o.label AS label, o.precision AS precision, o.n::INT AS \"limit\" FROM v"


def _shared(asked: str, records: str) -> str:
    """(a, r, hits) sharing at least half of the asked words; asked: a, w; records: r, w."""
    return (
        f"(SELECT a, r, hits FROM (SELECT x.a, y.r, any_value(x.n) AS n, count(*) AS hits FROM (SELECT a, len(w) AS n, unnest(w) AS t FROM ({asked})) x JOIN (SELECT r, unnest(w) AS t FROM ({records})) y USING (t) GROUP BY x.a, y.r) WHERE hits >= ceil(0.5 * n - 1e-9))"
    )


_PEOPLE_OF = parsed_names(_LISTED.format(id="record_id", a="authors", t="papers") + " UNION ALL " + _LISTED.format(id="-item_id", a="authors", t="repository_items"))
ARRIVALS = (
    f"hw AS MATERIALIZED {_shared('SELECT query_id AS a, wt AS w FROM q WHERE title IS NOT NULL', 'SELECT record_id AS r, wt AS w FROM p WHERE tier IS NOT NULL')}, "
    "h AS (SELECT v.query_id, v.pos, v.o.n AS n, p.tier, p.ordinal, p.record_id AS seq, 1 AS hits FROM v JOIN q USING (query_id) JOIN p ON p.nd = q.doi WHERE v.o.label = 'doi' AND p.tier IS NOT NULL UNION ALL "
    "SELECT v.query_id, v.pos, v.o.n, p.tier, p.ordinal, p.record_id, hw.hits FROM v JOIN hw ON hw.a = v.query_id JOIN p ON p.record_id = hw.r WHERE v.o.label IN ('exact-title', 'title-author', 'fuzzy-title') UNION ALL "
    "SELECT v.query_id, v.pos, v.o.n, p.tier, p.ordinal, p.record_id, count(*) FROM v JOIN names a ON a.id = -v.query_id JOIN (SELECT DISTINCT id, last_name FROM names) b ON b.last_name = a.last_name JOIN p ON p.record_id = b.id WHERE v.o.label = 'authors-only' AND p.tier IS NOT NULL GROUP BY ALL), "
    "arr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier, pos, ordinal ORDER BY hits DESC, seq) AS rank FROM h) WHERE rank <= n)"
)


def scored(keywords: bool) -> str:
    """CTEs to ``sc``: (query_id, seq) with first arrival, final, kind, conf, exact."""
    nl = f"nl AS MATERIALIZED ({_lists('names')}), " if not keywords else ""
    first = "f AS MATERIALIZED (SELECT query_id, seq, min({'tier': tier, 'pos': pos, 'ordinal': ordinal, 'rank': rank}) AS a FROM arr GROUP BY query_id, seq), "
    if keywords:
        parts = f"cs AS (SELECT f.*, 0.0::DOUBLE AS sd, NULL::DOUBLE AS st, NULL::DOUBLE AS sa, NULL::DOUBLE AS sy, NULL::DOUBLE AS sv, CASE WHEN len(q.nw) > 0 AND len(p.nw) > 0 THEN {O.jaccard('q.nw', 'p.nw')} END AS sk, false AS same, false AS named, false AS telling, false AS titled FROM f JOIN q USING (query_id) JOIN p ON p.record_id = f.seq), "
    else:
        over = overlap(f"SELECT {{'q': f.query_id, 'r': f.seq}} AS k, coalesce(x.l, []::{_NAME_TYPE}) AS a, coalesce(y.l, []::{_NAME_TYPE}) AS b FROM f LEFT JOIN nl x ON x.id = -f.query_id LEFT JOIN nl y ON y.id = f.seq")
        parts = over + ", cs AS (SELECT f.*, CASE WHEN q.doi = p.nd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sd, " + (
            f"CASE WHEN q.title IS NOT NULL THEN {title_similarity('q.nt', 'p.nt', 'q.wt', 'p.wt', 'q.gt', 'p.gt')} END AS st, CASE WHEN len(x.l) > 0 AND len(y.l) > 0 THEN ov.overlap END AS sa, "
            "CASE WHEN abs(p.year - q.hint) = 0 THEN 1.0::DOUBLE WHEN abs(p.year - q.hint) = 1 THEN 0.7 WHEN abs(p.year - q.hint) > 1 THEN 0.0 END AS sy, CASE WHEN q.title IS NOT NULL AND p.nv <> '' AND q.nt <> '' AND contains(q.nt, p.nv) THEN 1.0::DOUBLE END AS sv, NULL::DOUBLE AS sk, "
            "q.nt <> '' AND q.nt = p.nt AS same, coalesce(len(x.l), 0) > 0 AS named, length(q.nt) >= 15 AND len(list_filter(string_split(q.nt, ' '), lambda t: t <> '')) >= 3 AS telling, q.title IS NOT NULL AS titled "
            "FROM f JOIN q USING (query_id) JOIN p ON p.record_id = f.seq LEFT JOIN nl x ON x.id = -f.query_id LEFT JOIN nl y ON y.id = f.seq LEFT JOIN ov ON ov.k.q = f.query_id AND ov.k.r = f.seq), "
        )
    weights = (("st", 0.55), ("sa", 0.25), ("sy", 0.08), ("sv", 0.05), ("sk", 0.07))
    total, weight = " + ".join(f"coalesce({w}::DOUBLE * {c}, 0.0::DOUBLE)" for c, w in weights), " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in weights)
    return (
        nl + first + parts + f"cm AS (SELECT *, CASE WHEN {weight} > 0 THEN greatest(0.0, least(1.0, ({total}) / ({weight}))) ELSE 0.0 END AS mean FROM cs), "
        "ce AS (SELECT *, sd = 1 AS by_doi, coalesce(st >= 0.97, false) AND named AND coalesce(sa, 0) >= CASE WHEN same THEN 0.7 ELSE 0.8 END AND coalesce(sy <> 0, true) AS strong, same AND NOT named AND coalesce(sy <> 0, true) AND telling AND mean >= 0.95 AS alone FROM cm), "
        "sc AS MATERIALIZED (SELECT query_id, seq, a, by_doi OR strong OR alone AS exact, CASE WHEN by_doi OR strong OR alone THEN 'exact' WHEN titled AND mean >= 0.85 THEN 'near-exact' WHEN coalesce(st, 0) >= 0.5 OR coalesce(sk, 0) >= 0.5 THEN 'similar' ELSE 'keyword' END AS kind, "
        f"{O.round_score('CASE WHEN by_doi THEN 0.99::DOUBLE WHEN strong THEN greatest(0.95::DOUBLE, least(0.98::DOUBLE, 0.9::DOUBLE + 0.08::DOUBLE * mean)) WHEN alone THEN greatest(0.95::DOUBLE, mean) ELSE mean END')} AS conf, {O.round_score('CASE WHEN by_doi THEN 1.0 ELSE mean END')} AS final FROM ce)"
    )


_SCORED = f"WITH RECURSIVE {PAPERS}, {ITEMS}, {VARIANTS}, {_PEOPLE_OF}, {ARRIVALS}, {scored(False)}"
SQL["g05_select_best"] = f"{_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, seq) AS rn FROM sc) SELECT query_id, seq AS record_id, kind AS match_type, conf AS confidence, final AS final_score, exact AS is_exact FROM b WHERE rn = 1 AND final > 0"
IDENTIFIED = (
    "e0 AS (SELECT arr.*, sc.final, sc.kind, sc.conf, sc.exact, row_number() OVER (PARTITION BY arr.query_id, arr.tier, arr.pos, arr.ordinal ORDER BY sc.final DESC, arr.rank) AS rn FROM arr JOIN sc USING (query_id, seq)), "
    "e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, pos, ordinal) AS k FROM e0 WHERE rn = 1 AND final > 0 AND exact) WHERE k = 1), "
    "e2 AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.query_id ORDER BY final DESC, seq) AS rn FROM sc JOIN q USING (query_id) WHERE sc.query_id NOT IN (SELECT query_id FROM e1) AND NOT (q.title IS NULL AND q.doi IS NULL)), "
    "main AS MATERIALIZED (SELECT query_id, seq, kind, conf, tier::INT AS tier, true AS early FROM e1 UNION ALL SELECT query_id, seq, kind, conf, NULL, false FROM e2 WHERE rn = 1 AND final > 0 AND NOT (kind = 'keyword' AND conf < 0.4))"
)
SQL["c05_identify"] = f"{_SCORED}, {IDENTIFIED} SELECT query_id, seq AS record_id, kind AS match_type, conf AS confidence, tier, early AS stopped_early FROM main"

_KW = f"list_distinct(list_filter(list_transform(flatten(list_transform({_SOME('topics')}, lambda x: regexp_split_to_array({O.strip_markup('x')}, '[;,|]'))), lambda part: {O.normalize_title('part')}), lambda v: v <> ''))"
_KW_CUT = f"list_distinct(list_filter(list_transform(kw, lambda v: CASE WHEN length(v) > 120 THEN trim(substr(v, 1, 120)) WHEN NOT list_contains({O.STOP}, v) THEN v END), lambda v: v IS NOT NULL))"
_RECENT = lambda y: f"CASE WHEN {y} IS NULL OR {_YEAR} - {y} >= 12 THEN 0.0::DOUBLE WHEN {_YEAR} - {y} <= 0 THEN 0.05::DOUBLE ELSE 0.05::DOUBLE * (1.0::DOUBLE - ({_YEAR} - {y})::DOUBLE / 12.0::DOUBLE) END"


def distinct_titles(rows: str, by: str, order: str) -> str:
    """CTEs from rows (by, fp, ...) to ``dt``: ranks of the first ten different titles; titles without words all count."""
    return (
        f"d0 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS raw FROM ({rows})), d1 AS (SELECT *, row_number() OVER (PARTITION BY {by}, fp ORDER BY raw) AS nth FROM d0), "
        f"dt AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY raw)::INT AS rank FROM d1 WHERE nth = 1 OR fp = '') WHERE rank <= 10)"
    )


SQL["c07_discover"] = (
    f"WITH {PAPERS}, k0 AS (SELECT input_id AS query_id, {_KW} AS kw FROM build_inputs WHERE topics IS NOT NULL), k1 AS (SELECT query_id, {_KW_CUT} AS kw FROM k0), q AS MATERIALIZED (SELECT query_id, {_WORD_SET('kw')} AS nw FROM k1 WHERE len(kw) > 0), "
    f"hw AS {_shared('SELECT query_id AS a, nw AS w FROM q', 'SELECT record_id AS r, nw AS w FROM p WHERE tier IS NOT NULL')}, "
    "arr AS (SELECT * FROM (SELECT hw.a AS query_id, 0 AS pos, p.tier, p.ordinal, p.record_id AS seq, row_number() OVER (PARTITION BY hw.a, p.tier, p.ordinal ORDER BY hw.hits DESC, p.record_id) AS rank FROM hw JOIN p ON p.record_id = hw.r) WHERE rank <= 20), "
    + scored(True)
    + ", " + distinct_titles(f"SELECT sc.query_id, sc.seq, sc.kind, sc.final, p.fp, sc.final + {_RECENT('p.year')} AS rel, coalesce(len(p.sources), 1) AS ns, coalesce(p.citation_count, 0) AS cc, coalesce(p.year, 0) AS yy FROM sc JOIN p ON p.record_id = sc.seq WHERE sc.final > 0", "query_id", "rel DESC, ns DESC, cc DESC, yy DESC, seq")
    + " SELECT query_id, rank, seq AS record_id, kind AS match_type, final AS final_score FROM dt"
)


_SIMILAR = "CASE source WHEN 'Semantic Scholar' THEN 0 WHEN 'OpenAlex' THEN 1 WHEN 'Europe PMC' THEN 2 WHEN 'arXiv' THEN 3 WHEN 'CORE' THEN 4 END"


def _other() -> str:
    """m and x are different papers: two DOIs decide, else any shared identifier or equal titles make them one."""
    arx = lambda c: f"lower(regexp_replace(nullif({c}.arxiv_id, ''), '(?i)v\\d+$', ''))"
    return (
        "NOT coalesce(CASE WHEN nullif(m.doi, '') IS NOT NULL AND nullif(x.doi, '') IS NOT NULL THEN m.doi = x.doi ELSE coalesce(upper(nullif(m.pmcid, '')) = upper(x.pmcid), false) OR coalesce(nullif(m.pmid, '') = x.pmid, false) "
        f"OR coalesce({arx('m')} = {arx('x')}, false) OR coalesce(m.source = x.source AND nullif(m.source_id, '') = x.source_id, false) OR m.bare = x.bare END, false)"
    )


def similar(mains: str) -> str:
    """CTEs from mains (query_id, mid) and ``p`` to ``dt``: the ten most similar other papers of each main paper."""
    terms = f"list_filter(string_split({O.normalize_title('abstract')}, ' '), lambda t: length(t) >= 3 AND NOT list_contains({O.STOP}, t))"
    return (
        f"ms AS MATERIALIZED ({mains}), rf AS MATERIALIZED (SELECT record_id, unnest(list_distinct(reference_ids)) AS ref FROM p), "
        f"so AS MATERIALIZED (SELECT record_id AS seq, {_SIMILAR} AS ordinal, coalesce(doi, lower(title)) AS key FROM p WHERE {_SIMILAR} IS NOT NULL), "
        "rel0 AS (SELECT ms.query_id, ms.mid, so.seq, 1000000 AS strength FROM ms JOIN rf ON rf.record_id = ms.mid JOIN p ON p.doi = rf.ref JOIN so ON so.seq = p.record_id UNION ALL SELECT ms.query_id, ms.mid, so.seq, 1000000 FROM ms JOIN p ON p.record_id = ms.mid JOIN rf ON rf.ref = p.doi JOIN so ON so.seq = rf.record_id UNION ALL "
        "SELECT ms.query_id, ms.mid, so.seq, count(*) FROM ms JOIN rf x ON x.record_id = ms.mid JOIN rf y USING (ref) JOIN so ON so.seq = y.record_id GROUP BY ALL HAVING count(*) >= 3), "
        f"rel1 AS MATERIALIZED (SELECT r.query_id, r.mid, so.ordinal, seq, so.key, row_number() OVER (PARTITION BY r.query_id, so.ordinal ORDER BY r.strength DESC, seq) AS place FROM (SELECT query_id, mid, seq, max(strength) AS strength FROM rel0 GROUP BY ALL) r JOIN so USING (seq) JOIN p m ON m.record_id = r.mid JOIN p x ON x.record_id = r.seq WHERE {_other()}), "
        "rel AS (SELECT * FROM rel1 WHERE place <= 20), rb AS (SELECT query_id, ordinal, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT query_id, ordinal, count(*) AS n FROM rel GROUP BY ALL)), "
        "fst AS MATERIALIZED (SELECT rel.* FROM rel JOIN rb USING (query_id, ordinal) WHERE before < 50), short AS MATERIALIZED (SELECT ms.query_id, ms.mid FROM ms LEFT JOIN (SELECT query_id, count(DISTINCT key) AS u FROM fst GROUP BY query_id) USING (query_id) WHERE coalesce(u, 0) < 8), "
        f"sr1 AS (SELECT short.query_id, short.mid, so.ordinal, so.seq, so.key, row_number() OVER (PARTITION BY short.query_id, so.ordinal ORDER BY s.hits DESC, so.seq) AS place FROM {_shared('SELECT DISTINCT mid AS a, wt AS w FROM short JOIN p ON p.record_id = mid', 'SELECT record_id AS r, wt AS w FROM p')} s JOIN short ON short.mid = s.a JOIN so ON so.seq = s.r JOIN p m ON m.record_id = short.mid JOIN p x ON x.record_id = so.seq WHERE {_other()}), "
        "bo AS MATERIALIZED (SELECT query_id, mid, -1 AS ordinal, seq, key FROM fst WHERE query_id IN (SELECT query_id FROM short) UNION ALL SELECT query_id, mid, ordinal, seq, key FROM sr1 WHERE place <= 20), "
        "nw AS (SELECT query_id, ordinal, count(*) AS works FROM (SELECT query_id, key, min(ordinal) AS ordinal FROM bo GROUP BY ALL) GROUP BY ALL), st AS (SELECT query_id, ordinal, n, coalesce(works, 0) AS works FROM (SELECT query_id, ordinal, count(*) AS n FROM bo GROUP BY ALL) LEFT JOIN nw USING (query_id, ordinal)), "
        "sa AS (SELECT * FROM (SELECT query_id, ordinal, coalesce(sum(n) OVER w, 0) AS rows_before, coalesce(sum(works) OVER w, 0) AS usable FROM st WINDOW w AS (PARTITION BY query_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE ordinal >= 0 AND rows_before < 50 AND usable < 15), "
        "cand AS MATERIALIZED (SELECT query_id, mid, seq FROM fst UNION SELECT bo.query_id, bo.mid, bo.seq FROM bo JOIN sa USING (query_id, ordinal)), "
        f"pe AS MATERIALIZED (SELECT record_id, {_WORD_SET(_SOME('keywords'))} AS kw, list_distinct(list_filter(list_transform({_SOME('topics')}, lambda t: {O.bare(O.normalize_title('t'))}), lambda t: t <> '')) AS tp FROM p WHERE record_id IN (SELECT seq FROM cand UNION SELECT mid FROM ms)), "
        f"tf AS MATERIALIZED (SELECT record_id, t, count(*)::DOUBLE AS c FROM (SELECT record_id, unnest({terms}) AS t FROM p WHERE record_id IN (SELECT record_id FROM pe)) GROUP BY ALL), tn AS (SELECT record_id, sqrt(sum(c * c)) AS l FROM tf GROUP BY record_id), "
        "ck AS (SELECT DISTINCT mid, seq FROM cand), dots AS (SELECT ck.mid, ck.seq, sum(a.c * b.c) AS s FROM ck JOIN tf a ON a.record_id = ck.mid JOIN tf b ON b.record_id = ck.seq AND b.t = a.t GROUP BY ALL), "
        f"pp AS (SELECT c.query_id, c.mid, c.seq, {title_similarity('m.nt', 'x.nt', 'm.wt', 'x.wt', 'm.gt', 'x.gt')} AS s_title, CASE WHEN m.abstract <> '' AND x.abstract <> '' THEN least(1.0::DOUBLE, coalesce(d.s / (la.l * lb.l), 0.0::DOUBLE)) END AS s_abs, "
        f"CASE WHEN len(km.kw) > 0 AND len(kx.kw) > 0 THEN {O.jaccard('km.kw', 'kx.kw')} END AS s_kw, CASE WHEN len(km.tp) > 0 AND len(kx.tp) > 0 THEN {O.jaccard('km.tp', 'kx.tp')} END AS s_tp, "
        "least(CASE WHEN coalesce(list_contains(m.reference_ids, x.doi), false) THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN coalesce(list_contains(x.reference_ids, m.doi), false) THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN len(list_intersect(list_distinct(m.reference_ids), list_distinct(x.reference_ids))) >= 3 THEN 0.04::DOUBLE ELSE 0 END "
        "+ CASE WHEN m.nv <> '' AND m.nv = x.nv THEN 0.02::DOUBLE ELSE 0 END, 0.1::DOUBLE) AS bonus, x.year, x.pdf_url, x.citation_count, x.fp "
        "FROM cand c JOIN p m ON m.record_id = c.mid JOIN p x ON x.record_id = c.seq JOIN pe km ON km.record_id = c.mid JOIN pe kx ON kx.record_id = c.seq LEFT JOIN dots d ON d.mid = c.mid AND d.seq = c.seq LEFT JOIN tn la ON la.record_id = c.mid LEFT JOIN tn lb ON lb.record_id = c.seq "
        f"WHERE {_other()}), "
        "pw AS (SELECT *, 0.4::DOUBLE + CASE WHEN s_abs IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN s_kw IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN s_tp IS NULL THEN 0 ELSE 0.1::DOUBLE END AS w, 0.4::DOUBLE * s_title + coalesce(0.3::DOUBLE * s_abs, 0) + coalesce(0.2::DOUBLE * s_kw, 0) + coalesce(0.1::DOUBLE * s_tp, 0) AS t FROM pp), "
        + distinct_titles(f"SELECT query_id, seq, fp, {O.round_score('least(1.0::DOUBLE, t / w) + bonus + ' + _RECENT('year'))} AS sim, {O.round_score('s_title')} AS s_title, {O.round_score('coalesce(s_abs, 0)')} AS s_abs, {O.round_score('coalesce(s_kw, 0)')} AS s_kw, {O.round_score('coalesce(s_tp, 0)')} AS s_tp, {O.round_score('bonus')} AS bonus, (nullif(pdf_url, '') IS NOT NULL)::INT AS has_pdf, coalesce(citation_count, 0) AS cc, coalesce(year, 0) AS yy FROM pw", "query_id", "sim DESC, has_pdf DESC, cc DESC, yy DESC, seq")
    )


SQL["c08_similar"] = (
    f"WITH {PAPERS}, " + similar("SELECT group_id AS query_id, min(record_id) AS mid FROM merge_groups GROUP BY group_id")
    + " SELECT query_id, rank, seq AS record_id, sim AS similarity, s_title AS sim_title, s_abs AS sim_abstract, s_kw AS sim_keywords, s_tp AS sim_topics, bonus AS relation_bonus FROM dt"
)

_ID = "coalesce('doi:' || nullif(doi, ''), 'pmcid:' || upper(nullif(pmcid, '')), 'pmid:' || nullif(pmid, ''), 'arxiv:' || nullif(arxiv_id, ''), (CASE source WHEN 'Semantic Scholar' THEN 's2' WHEN 'OpenAlex' THEN 'openalex' WHEN 'CORE' THEN 'core' WHEN 'DOAJ' THEN 'doaj' END) || ':' || nullif(source_id, ''))"
SQL["k01_search"] = (
    f"{_SCORED}, {IDENTIFIED}, " + similar("SELECT query_id, seq AS mid FROM main")
    + f", lo AS (SELECT record_id, source, {_ID.replace('nullif(doi, ' + Q + Q + ')', 'nd')} AS paper_id, {LOCATION} FROM p), sl AS (SELECT query_id, count(*)::INT AS n, string_agg(seq::VARCHAR, ' ' ORDER BY rank) AS ids FROM dt GROUP BY query_id) "
    "SELECT q.query_id, CASE WHEN q.doi IS NOT NULL THEN 'doi' WHEN q.title IS NOT NULL THEN 'title' ELSE 'keywords' END AS strategy, main.seq AS exact_id, lo.paper_id, main.kind AS match_type, main.conf AS confidence, coalesce(main.early, false) AS stopped_early, lo.access_type, coalesce(sl.n, 0)::INT AS n_similar, coalesce(sl.ids, '') AS similar_ids, "
    "CASE WHEN main.seq IS NULL THEN CASE WHEN coalesce(sl.n, 0) > 0 THEN 'No single paper could be identified from this query, so the ' || sl.n || ' most relevant results are returned instead.' ELSE 'No confident match was found in the configured academic sources.' END "
    "WHEN main.early THEN 'Exact match confirmed by ' || lo.source || '; remaining main-paper requests were cancelled.' ELSE 'No exact match; returning the closest candidate (' || main.kind || ', confidence ' || printf('%.2f', main.conf) || ').' END AS notes "
    "FROM q LEFT JOIN main USING (query_id) LEFT JOIN lo ON lo.record_id = main.seq LEFT JOIN sl ON sl.query_id = q.query_id"
)

# Second steps of the connectors -----------------------------------------------------------------------------------


def _answers(source: str) -> str:
    return (
        f"pa AS MATERIALIZED (SELECT record_id, {O.normalize_doi('doi')} AS nd, reference_ids FROM papers WHERE source = {O.q(source)}), nm AS (SELECT record_id, nd, nd AS asked FROM pa UNION SELECT record_id, nd, {O.normalize_doi('r')} FROM (SELECT record_id, nd, unnest(reference_ids) AS r FROM pa)), "
        f"an AS (SELECT i.item_id AS lookup_id, nm.record_id AS seq, coalesce(nm.nd = nm.asked, false) AS own FROM (SELECT item_id, {O.normalize_doi('doi')} AS d FROM repository_items) i JOIN nm ON nm.asked = i.d)"
    )


SQL["s01b_own_doi"] = f"WITH {_answers('DOAJ')} SELECT lookup_id, min(seq) AS seq FROM an WHERE own GROUP BY lookup_id"
SQL["s02b_own_doi_first"] = f"WITH {_answers('PubMed Central')} SELECT lookup_id, coalesce(min(CASE WHEN own THEN seq END), min(seq)) AS seq FROM an GROUP BY lookup_id"
SQL["j11_id_bridge"] = (
    f"WITH x AS MATERIALIZED (SELECT record_id, upper(nullif(pmcid, '')) AS pmcid, nullif(pmid, '') AS pmid, {O.normalize_doi('doi')} AS nd FROM papers), k AS (SELECT id, min(pmcid) AS pmcid FROM (SELECT nd AS id, pmcid FROM x UNION ALL SELECT pmid, pmcid FROM x) WHERE id IS NOT NULL AND pmcid IS NOT NULL GROUP BY id) "
    "SELECT x.record_id, coalesce(x.pmcid, k.pmcid) AS found_pmcid FROM x LEFT JOIN k ON k.id = coalesce(x.nd, x.pmid)"
)
_STRONG = "coalesce(CASE WHEN source = 'Semantic Scholar' THEN nullif(source_id, '') END, 'DOI:' || nullif(doi, ''), 'ARXIV:' || nullif(arxiv_id, ''), 'PMID:' || nullif(pmid, ''), 'PMCID:' || nullif(pmcid, ''))"
SQL["s05b_recommended"] = (
    f"WITH x AS (SELECT record_id, {_STRONG} AS id FROM papers), g AS (SELECT record_id, min(record_id) OVER (PARTITION BY group_id) AS head FROM merge_groups), c AS (SELECT DISTINCT x.id, g.record_id AS dst FROM g JOIN x ON x.record_id = g.head WHERE g.record_id <> g.head), "
    "o AS (SELECT x.record_id AS query_id, c.dst, row_number() OVER (PARTITION BY x.record_id ORDER BY c.dst)::INT AS rank FROM x JOIN c USING (id)) SELECT * FROM o WHERE rank <= 20"
)
SQL["s07b_related_works"] = (
    f"WITH x0 AS (SELECT record_id AS seq, doi, reference_ids, CASE WHEN regexp_full_match(source_id, '(?i)w\\d{{4,12}}') THEN upper(source_id) END AS oa, {O.normalize_title('concat_ws(' + Q + ' ' + Q + ', title, array_to_string((coalesce(topics, keywords, []::VARCHAR[]))[1:3], ' + Q + ' ' + Q + '))')} AS nt FROM papers WHERE source = 'OpenAlex'), "
    f"x AS MATERIALIZED (SELECT *, list_distinct({O.words('nt')}) AS w FROM x0), e AS (SELECT r.oa, y.oa AS dst, min(r.place) AS place FROM (SELECT oa, unnest(range(len(reference_ids))) AS place, unnest(reference_ids) AS ref FROM x WHERE oa IS NOT NULL) r JOIN x y ON y.doi = r.ref WHERE y.oa IS NOT NULL GROUP BY ALL), "
    "n AS (SELECT * FROM (SELECT x.seq AS query_id, e.dst, row_number() OVER (PARTITION BY x.seq ORDER BY e.place, e.dst) AS k FROM x JOIN e USING (oa)) WHERE k <= 10), b AS MATERIALIZED (SELECT DISTINCT n.query_id, i.seq FROM n JOIN (SELECT oa, min(seq) AS seq FROM x WHERE oa IS NOT NULL GROUP BY oa) i ON i.oa = n.dst), "
    "sh AS (SELECT x.seq, x.w FROM x LEFT JOIN (SELECT query_id, count(*) AS n FROM b GROUP BY query_id) c ON c.query_id = x.seq WHERE coalesce(c.n, 0) < 10), "
    f"m AS (SELECT * FROM (SELECT a AS query_id, r AS seq, row_number() OVER (PARTITION BY a ORDER BY hits DESC, r) AS k FROM {_shared('SELECT seq AS a, w FROM sh', 'SELECT seq AS r, w FROM x')}) WHERE k <= 20) "
    "SELECT query_id, seq, 'related' AS route FROM b UNION ALL SELECT query_id, seq, 'search' FROM m WHERE (query_id, seq) NOT IN (SELECT query_id, seq FROM b)"
)
SQL["k02_paper"] = (
    f"WITH x AS MATERIALIZED (SELECT record_id, title, pdf_url AS own_pdf, {_ORDER} AS ord, {O.normalize_doi('doi')} AS nd, {LOCATION} FROM papers), i AS (SELECT item_id AS lookup_id, {O.normalize_doi('doi')} AS d FROM repository_items), "
    "h AS (SELECT i.lookup_id, x.*, row_number() OVER (PARTITION BY i.lookup_id ORDER BY ord, record_id) AS rn FROM i JOIN x ON x.nd = i.d WHERE ord IS NOT NULL) "
    "SELECT lookup_id, record_id, title, access_type, url, CASE WHEN nullif(own_pdf, '') IS NULL AND type = 'pdf' THEN url ELSE own_pdf END AS pdf_url FROM h WHERE rn = 1"
)
