"""Link hygiene: which addresses are public, which point at a PDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import blank_to_null, col, js_trim, let

# Hosts that serve instance metadata.
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata.goog", "instance-data", "100.100.100.200")
# The academic API hosts that may be called.
API_HOSTS = (
    "doaj.org", "www.doaj.org", "eutils.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "api.core.ac.uk", "core.ac.uk",
    "export.arxiv.org", "arxiv.org", "api.semanticscholar.org", "www.semanticscholar.org", "api.crossref.org", "api.openalex.org",
    "www.ebi.ac.uk", "europepmc.org", "api.datacite.org", "api.unpaywall.org", "doi.org", "dx.doi.org",
)

_SHAPE = r"(?i)^([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def url_parts(c: Column | str) -> Column:
    """struct(scheme, userinfo, host, port, path, query, fragment); all '' for what isn't an absolute URL."""
    v = js_trim(col(c))
    names = ("scheme", "userinfo", "host", "port", "path", "query", "fragment")
    part = lambda i, n: F.regexp_extract(v, _SHAPE, i + 1).alias(n)
    raw = F.struct(*[part(i, n) for i, n in enumerate(names)])
    return let(
        raw,
        lambda s: F.struct(
            F.lower(s["scheme"]).alias("scheme"), s["userinfo"].alias("userinfo"), F.regexp_replace(F.lower(s["host"]), r"\.$", "").alias("host"),
            s["port"].alias("port"), s["path"].alias("path"), s["query"].alias("query"), s["fragment"].alias("fragment"),
        ),
    )


def _private_v4(host: Column) -> Column:
    n = [F.regexp_extract(host, _V4, i).try_cast("int") for i in (1, 2, 3, 4)]
    a, b = n[0], n[1]
    too_big = (n[0] > 255) | (n[1] > 255) | (n[2] > 255) | (n[3] > 255)
    return (
        too_big
        | a.isin(0, 10, 127)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(168, 0))
        | ((a == 100) & b.between(64, 127))
        | (a >= 224)
    )


def is_disallowed_address(host: Column | str) -> Column:
    """Loopback, private, link-local or reserved literal, or an obviously internal name."""

    def body(h: Column) -> Column:
        v6 = F.regexp_extract(h, r"^\[?([0-9a-f:.]*:[0-9a-f:.]*)\]?$", 1)
        mapped = F.regexp_extract(v6, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
        private6 = v6.isin("::", "::1") | F.regexp_like(v6, F.lit("^(?:fe80|f[cd]|ff)"))
        return (
            F.when(h == "localhost", F.lit(True))
            .when(F.regexp_like(h, F.lit(_V4)), _private_v4(h))
            .when(mapped != "", _private_v4(mapped))
            .when(v6 != "", private6)
            .otherwise(F.regexp_like(h, F.lit(r"\.(?:internal|localhost)$")))
        )

    return let(F.lower(col(host)), body)


def _is_public(p: Column) -> Column:
    host = p["host"]
    return (
        p["scheme"].isin("http", "https")
        & (p["userinfo"] == "")
        & (host != "")
        & (host != "localhost")
        & ~F.regexp_like(host, F.lit(r"\.(?:localhost|local)$"))
        & ~host.isin(*METADATA_HOSTS)
        & ~is_disallowed_address(host)
    )


def sanitize_external_link(c: Column | str) -> Column:
    """Canonical http(s) link without user info to a public host, else NULL: lower-case scheme and host, default port dropped, '/' for an empty path."""

    def body(p: Column) -> Column:
        default = ((p["scheme"] == "https") & (p["port"] == "443")) | ((p["scheme"] == "http") & (p["port"] == "80"))
        port = F.when((p["port"] == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
        path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
        return F.when(_is_public(p), F.concat(p["scheme"], F.lit("://"), p["host"], port, path, p["query"], p["fragment"]))

    return let(url_parts(c), body)


def looks_like_pdf(c: Column | str) -> Column:
    """A .pdf path or one of the usual PDF routes, and not a DOI resolver link."""

    def body(p: Column) -> Column:
        resolver = p["host"].isin("doi.org", "dx.doi.org", "www.doi.org")
        route = F.regexp_like(F.concat(p["path"], p["query"], p["fragment"]), F.lit(r"(?i)/pdf(?:/|$)|[?&](?:type=printable|format=pdf|download=pdf)"))
        return (p["scheme"] != "") & ~resolver & (F.lower(p["path"]).endswith(".pdf") | route)

    return F.coalesce(let(url_parts(c), body), F.lit(False))


def is_public_pdf(c: Column | str) -> Column:
    """A public address whose path itself points at a PDF."""

    def body(p: Column) -> Column:
        return _is_public(p) & F.regexp_like(p["path"], F.lit(r"(?i)(?:\.pdf|/pdf(?:/.*)?)$"))

    return F.coalesce(let(url_parts(c), body), F.lit(False))


def api_url_verdict(c: Column | str) -> Column:
    """NULL when the URL may be called, else the reason."""

    def body(p: Column) -> Column:
        return (
            F.when(p["scheme"] == "", F.lit("not a valid absolute URL"))
            .when(p["scheme"] != "https", F.lit("scheme is not permitted"))
            .when(p["userinfo"] != "", F.lit("embedded credentials are not permitted"))
            .when(p["host"].isin(*METADATA_HOSTS), F.lit("instance metadata endpoints are not permitted"))
            .when(~p["port"].isin("", "443", "80"), F.lit("port is not permitted"))
            .when(is_disallowed_address(p["host"]), F.lit("private, loopback or reserved address"))
            .when(~p["host"].isin(*API_HOSTS), F.lit("host is not on the academic API allowlist"))
        )

    return let(F.coalesce(url_parts(c), url_parts(F.lit(""))), body)


def link_or_null(c: Column | str) -> Column:
    return blank_to_null(sanitize_external_link(c))
