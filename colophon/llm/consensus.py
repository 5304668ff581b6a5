"""One surviving value per field for every group of duplicate records, by token-level consensus.

Values are first brought down to the distinct ones of a group (per value: best weight, smallest
record), so copies cost nothing. The distinct values are aligned progressively, the heaviest
first: a profile of columns grows, each column holds weighted votes for its tokens. The consensus is
the winner of every column; the survivor is the existing value closest to it.

Weights make the vote follow the wanted order of preference. For abstracts a value votes only if it
is complete; what is aligned to a mere beginning of a longer value, up to ``SLIP`` of its tokens, counts as cut off. A later
retrieval outweighs all earlier ones together, so the complete values of the latest retrieval vote, with equal weights. DOIs and links are single-token values, so their
alignment has one column and the vote is an aggregate: trust of the source, then retrieval. Lists of
sources are sets of tokens, one column per distinct source, and every column survives.

Groups may be of any size: aggregation happens before the shuffle, and in groups with more than ``BLOCK``
distinct values the cut ones are found by joins; no task gathers such a group, only its complete values of one retrieval.

Results: NULL, blank, placeholder and notice values never survive; a field without a usable value gives
no row. Values equally close to the consensus: the smallest record id. Repeated memberships count once,
memberships without a record are ignored. Empty tables give an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import collapse, let
from ..functions.identifiers import normalize_doi
from ..functions.text import strip_markup
from ..functions.urls import is_public_pdf
from ..session import cut

BLOCK = 64
# A value differs in at most this share of its tokens from the beginning of the longer value that it was cut from.
SLIP = 0.05
# Retrievals of a large group that are compared at once, the latest first.
LEVELS = 8
MAX_SOURCES = 10_000
MAX_NOTICES = 200_000
# A sentence found in at least this share of all groups, and in four groups, is a notice and no abstract.
NOTICE_SHARE, NOTICE_LEAST = 0.0005, 4
_LABEL = r"(?i)^(?:abstract|summary|background|r[eé]sum[eé]|zusammenfassung|resumen|resumo)\s*[:.—–-]\s*"
_CUT = r"(?i)(?:\.\.\.|…|\[(?:truncated|\.\.\.|…|more)\]|\((?:continued|more|truncated)[^)]*\))$"
_END = r"[.!?。！？][\"'”’»」)\]]*$"
# Between two characters of which the first may end a complete text.
_ENDS = r"(?<=[.!?。！？\"'”’»」)\]])"


def abstract_body(c: Column) -> Column:
    """Text without markup, label and superfluous blanks. The identity of an abstract."""
    return collapse(F.regexp_replace(strip_markup(c), _LABEL, ""))


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s_-]+", "")


def looks_whole(body: Column) -> Column:
    """Ends as a sentence ends, without a mark of truncation or an open bracket."""
    opened = F.length(F.regexp_replace(body, r"[^(（]", "")) - F.length(F.regexp_replace(body, r"[^)）]", ""))
    words = F.size(F.split(body, " ")) + F.length(F.regexp_replace(body, r"[^぀-鿿]", "")) / 2
    return F.regexp_like(body, F.lit(_END)) & ~F.regexp_like(body, F.lit(_CUT)) & (opened == 0) & (words >= 8)


def align(profile: list[dict], tokens: list[str], weight: float) -> tuple[list[dict], int]:
    """Adds a token sequence to the profile; returns it and the last column that the sequence fills.

    Equal ends are taken as they are; only what lies between goes through the dynamic program."""
    n, m = len(profile), len(tokens)
    a = 0
    while a < n and a < m and tokens[a] in profile[a]:
        a += 1
    z = 0
    while z < n - a and z < m - a and tokens[m - 1 - z] in profile[n - 1 - z]:
        z += 1
    mid_p, mid_t = profile[a : n - z], tokens[a : m - z]
    p, q = len(mid_p), len(mid_t)
    steps: list[tuple[int, int]] = []  # (column or -1, token or -1)
    if p and q:
        score = [[0] * (q + 1) for _ in range(p + 1)]
        for i in range(p - 1, -1, -1):
            below, here, col = score[i + 1], score[i], mid_p[i]
            for j in range(q - 1, -1, -1):
                here[j] = below[j + 1] + 1 if mid_t[j] in col else max(below[j], here[j + 1])
        i = j = 0
        while i < p and j < q:
            if mid_t[j] in mid_p[i]:
                steps.append((i, j))
                i, j = i + 1, j + 1
            elif score[i + 1][j] >= score[i][j + 1]:
                steps.append((i, -1))
                i += 1
            else:
                steps.append((-1, j))
                j += 1
        steps += [(k, -1) for k in range(i, p)] + [(-1, k) for k in range(j, q)]
    else:
        steps = [(k, -1) for k in range(p)] + [(-1, k) for k in range(q)]
    out, last = [], -1
    total = sum(profile[0].values()) if profile else 0.0

    def put(column: dict, token: str | None) -> None:
        nonlocal last
        column = dict(column)
        column[token] = column.get(token, 0.0) + weight
        if token is not None:
            last = len(out)
        out.append(column)

    for k in range(a):
        put(profile[k], tokens[k])
    for i, j in steps:
        put(mid_p[i] if i >= 0 else {None: total}, mid_t[j] if j >= 0 else None)
    for k in range(z):
        put(profile[n - z + k], tokens[m - z + k])
    return out, last


def consensus(values: list[tuple[list[str], float]]) -> list[str]:
    profile: list[dict] = []
    for tokens, weight in sorted(values, key=lambda v: -v[1]):
        profile, _ = align(profile, tokens, weight)
    best = [max(c.items(), key=lambda x: x[1])[0] for c in profile]
    return [t for t in best if t is not None]


def distance(a: list[str], b: list[str]) -> int:
    """Tokens to add or remove, after equal ends."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            cur = row[j + 1]
            row[j + 1] = prev + 1 if x == y else max(row[j], cur)
            prev = cur
    return len(a) + len(b) - 2 * row[-1]


def tokens_of(text: str) -> list[str]:
    """Words; unspaced scripts character by character."""
    out: list[str] = []
    for w in text.split():
        if any("぀" <= c <= "鿿" for c in w):
            out += list(w)
        else:
            out.append(w)
    return out


def begins(short: list[str], long: list[str]) -> bool:
    """Whether one token sequence is aligned to a mere beginning of the other: few tokens differ, and more than those follow."""
    m, slip = len(short), int(SLIP * len(short))
    head = long[: m + slip]
    if len(long) <= m or sum((Counter(short) & Counter(head)).values()) < m - slip:
        return False
    profile, last = align([{t: 1.0} for t in head], short, 1.0)
    inserted = len(profile) - len(head)
    used = last + 1 - inserted
    return max(inserted, used - (m - inserted)) <= slip and len(long) - used > slip


def is_cut(row: dict, other: dict) -> bool:
    """Whether ``row`` is only the beginning of the longer ``other``. Both: body, tokens."""
    if len(other["body"]) <= len(row["body"]):
        return False
    return other["body"].startswith(row["body"]) or begins(row["tokens"], other["tokens"])


def elected(rows: list[dict]) -> dict:
    """The value closest to the consensus of values that weigh the same. rows: record_id, tokens."""
    rows = sorted(rows, key=lambda r: r["record_id"])
    if len(rows) < 3:  # of two, the first is the consensus
        return rows[0]
    text = consensus([(r["tokens"], 1.0) for r in rows])
    return min(rows, key=lambda r: (distance(r["tokens"], text), r["record_id"]))


def survivor(rows: list[dict]) -> dict | None:
    """rows: body, whole, retrieved, record_id. Of the complete values of the latest retrieval that has any, the one closest to their consensus."""
    rows = [r | {"tokens": tokens_of(r["body"])} for r in rows]
    levels: dict[int | None, list[dict]] = {}
    for r in rows:
        if r["whole"]:
            levels.setdefault(r["retrieved"], []).append(r)
    for k in sorted(levels, key=lambda t: (t is None, -(t or 0))):
        if whole := [r for r in levels[k] if not any(is_cut(r, o) for o in rows)]:
            return elected(whole)
    return None


def _pick(table: pa.Table) -> pa.Table:
    best = survivor(table.to_pylist())
    keep = [best] if best else []
    return pa.Table.from_pylist(keep, schema=table.schema)  # without the tokens


def _elect(table: pa.Table) -> pa.Table:
    best = elected([r | {"tokens": tokens_of(r["body"])} for r in table.to_pylist()])
    return pa.Table.from_pylist([best], schema=table.schema)


def _cut_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group_id, record_id) of values that are cut: group_id, record_id, body, other."""
    for b in batches:
        out, known = [], ("", [])
        for r in b.to_pylist():
            if len(r["other"]) > len(r["body"]):
                if known[0] != r["body"]:
                    known = (r["body"], tokens_of(r["body"]))
                if is_cut({"body": r["body"], "tokens": known[1]}, {"body": r["other"], "tokens": tokens_of(r["other"])}):
                    out.append(r)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in ("group_id", "record_id")], names=["group_id", "record_id"])


def notices(bodies: DataFrame, groups: int) -> DataFrame:
    """Hashes of sentences that stand in so many groups that they belong to no work.

    Their number is at most the mean number of sentences per group over ``NOTICE_SHARE``, whatever the number of groups."""
    least = max(NOTICE_LEAST, int(groups * NOTICE_SHARE))
    return (
        bodies.select("group_id", F.explode("sentences").alias("sentence"))
        .distinct()
        .groupBy("sentence")
        .count()
        .where(F.col("count") >= least)
        .select("sentence")
    )


def surviving_abstracts(members: DataFrame, n_groups: int, largest: int) -> DataFrame:
    """(group_id, record_id, body) of the surviving abstract of each group. members: see ``prepare``."""
    with_text = members.where("body <> ''")
    note = cut(notices(with_text.select("group_id", "sentences"), n_groups))
    if note.count() <= MAX_NOTICES:
        note = F.broadcast(note)
    rows = with_text.select("group_id", "record_id", F.unix_micros("retrieved_at").alias("retrieved"), "body", "whole", F.element_at("sentences", 1).alias("head"), F.element_at("sentences", -1).alias("tail"))
    # a notice may stand at the head or at the end of the text
    for c in ("head", "tail"):
        rows = rows.join(note.withColumnRenamed("sentence", c), c, "left_anti")
    rows = rows.groupBy("group_id", "body").agg(F.min("record_id").alias("record_id"), F.max("retrieved").alias("retrieved"), F.max("whole").alias("whole"))
    rows = rows.select("group_id", "record_id", "retrieved", "body", "whole")
    schema = "group_id bigint, record_id bigint, retrieved bigint, body string, whole boolean"
    heavy = None
    if largest > BLOCK:  # copies count here, so there may be no such group of distinct values
        big = cut(rows.groupBy("group_id").count().where(F.col("count") > BLOCK).select("group_id"))
        heavy = heaviest(rows.join(big, "group_id", "left_semi"))
        rows = rows.join(big, "group_id", "left_anti")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("group_id")))
    lone = rows.where((F.col("n") == 1) & F.col("whole")).drop("n")
    many = rows.where("n > 1").drop("n").groupBy("group_id").applyInArrow(_pick, schema)
    found = lone.unionByName(many).select("group_id", "record_id", "body")
    return found if heavy is None else found.unionByName(heavy)


def heaviest(rows: DataFrame) -> DataFrame:
    """What ``survivor`` gives, for groups of any size: (group_id, record_id, body).

    Values cut without a change are found over all rows of the group by the hashes of the beginnings of longer values. The latest of
    the others are aligned to all values of their group, ``LEVELS`` retrievals at a time, until each group has a complete one."""
    pieces = F.split("body", _ENDS, -1)
    begun = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.xxhash64(F.array_join(F.slice("p", F.lit(1), k), "")))
    # a text that ends as a sentence ends has an empty last piece: its last beginning is itself
    begun = F.filter(begun, lambda h: h != F.xxhash64("body"))
    begins_with = rows.select("group_id", "body", pieces.alias("p")).where(F.size("p") > 1).select("group_id", F.explode(begun).alias("h")).distinct()
    kept = rows.where("whole").withColumn("h", F.xxhash64("body")).join(begins_with, ["group_id", "h"], "left_anti").select("group_id", "record_id", "retrieved", "body")
    kept = cut(kept)
    latest = Window.partitionBy("group_id").orderBy(F.col("retrieved").desc_nulls_last())
    others = rows.select("group_id", F.col("body").alias("other"))
    out = []
    while not kept.isEmpty():
        top = cut(kept.withColumn("level", F.dense_rank().over(latest)).where(F.col("level") <= LEVELS))
        found = top.select("group_id", "record_id", "body").join(others, "group_id").where(F.length("other") > F.length("body"))
        whole = cut(top.join(found.mapInArrow(_cut_of, "group_id bigint, record_id bigint").distinct(), ["group_id", "record_id"], "left_anti"))
        first = whole.groupBy("group_id").agg(F.min("level").alias("level"))
        out.append(whole.join(first, ["group_id", "level"], "left_semi"))
        kept = cut(kept.join(top.select("group_id", "record_id"), ["group_id", "record_id"], "left_anti").join(first.select("group_id"), "group_id", "left_anti"))
    schema = "group_id bigint, record_id bigint, body string"
    if not out:
        return kept.select("group_id", "record_id", "body")
    return reduce(DataFrame.unionByName, out).select("group_id", "record_id", "body").groupBy("group_id").applyInArrow(_elect, schema)


def prepare(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """Memberships with all that is voted on, computed once and written once."""
    body = let(abstract_body(F.coalesce("abstract", F.lit(""))), lambda v: F.struct(v.alias("body"), looks_whole(v).alias("whole"), F.transform(F.split(v, r"(?<=[.!?])\s+"), lambda s: F.xxhash64(s)).alias("sentences")))
    pdf = F.trim("pdf_url")
    joined = pairs.join(papers.select("record_id", "source", "sources", "abstract", "pdf_url", "doi", "retrieved_at"), "record_id")
    return cut(
        joined.select(
            "group_id", "record_id", "retrieved_at", source_key(F.col("source")).alias("source"), F.when(is_public_pdf(pdf), pdf).alias("pdf_url"), normalize_doi("doi").alias("doi"),
            F.transform(F.array_compact(F.coalesce("sources", F.array("source"))), source_key).alias("listed"), body.alias("b"),
        ).select("*", "b.*").drop("b")
    )


def survivors(groups: DataFrame, papers: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, field, record_id)."""
    pairs = groups.select("group_id", "record_id").where("group_id is not null and record_id is not null").distinct()
    stats = pairs.groupBy("group_id").count().agg(F.count("*").alias("n"), F.max("count").alias("m")).first()
    n_groups, largest = stats["n"], stats["m"] or 0
    listed_sources = sources.select("source_key", "source_name", "trust").limit(MAX_SOURCES + 1).collect()
    if len(listed_sources) > MAX_SOURCES:
        raise ValueError("too many sources for a lookup map")
    trust: dict[str, int] = {}
    names: dict[str, str] = {}
    for r in listed_sources:
        name = source_key_py(r["source_name"]) or source_key_py(r["source_key"])
        for k in (source_key_py(r["source_key"]), name):
            trust[k] = max(trust.get(k, 0), r["trust"] or 0)
            names[k] = name
    lookup = lambda d, kind: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast(f"map<string,{kind}>")
    trust_of, canon = lookup(trust, "int"), lookup(names, "string")
    members = prepare(pairs, papers)

    def vote(name: str) -> DataFrame:
        weight = F.struct(F.coalesce(F.try_element_at(trust_of, F.col("source")), F.lit(0)).alias("t"), F.col("retrieved_at").alias("r"))
        return (
            members.select("group_id", "record_id", F.col(name).alias("v"), weight.alias("w"))
            .where("v is not null")
            .groupBy("group_id", "v")
            .agg(F.max("w").alias("w"), F.min("record_id").alias("record_id"))
            .groupBy("group_id")
            .agg(F.max_by("record_id", F.struct("w", -F.col("record_id"))).alias("record_id"))
            .select("group_id", F.lit(name).alias("field"), "record_id")
        )

    key = F.col("k")
    by_source = (
        members.select("group_id", "record_id", F.explode("listed").alias("k"))
        .select("group_id", "record_id", F.coalesce(F.try_element_at(canon, key), key).alias("k"))
        .where("k <> ''")
        .groupBy("group_id", "k")
        .agg(F.min("record_id").alias("record_id"))
        .select("group_id", F.lit("sources").alias("field"), "record_id")
        .distinct()
    )
    abstracts = surviving_abstracts(members, n_groups, largest).select("group_id", F.lit("abstract").alias("field"), "record_id")
    return reduce(DataFrame.unionByName, [abstracts, vote("pdf_url"), vote("doi"), by_source])


def source_key_py(s: str | None) -> str:
    return "".join(ch for ch in (s or "").lower() if not ch.isspace() and ch not in "_-")


def merged_records(groups: DataFrame, papers: DataFrame, sources: DataFrame) -> DataFrame:
    """One record per group: record ids that give abstract, pdf_url and doi, and those that name its sources."""
    f = survivors(groups, papers, sources)
    one = lambda name: F.max(F.when(F.col("field") == name, F.col("record_id")))
    return f.groupBy("group_id").agg(
        one("abstract").alias("abstract_from"), one("pdf_url").alias("pdf_url_from"), one("doi").alias("doi_from"),
        F.sort_array(F.collect_set(F.when(F.col("field") == "sources", F.col("record_id")))).alias("sources_from"),
    )
