"""Batches of described papers against a corpus of source records.

Order of arrival is a declared total order: tier, variant, source ordinal, rank within the source. Retrieval within a source
is by shared content words: at least ``share`` of the query's words, most shared first. Since a record must
share that many, only the query's rarest words are looked up (prefix filter), so frequent words move no postings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.identifiers import paper_id
from ..functions.similarity import bigrams
from ..functions.text import title_tokens
from ..operators.fulltext import back_fill, resolve_full_text
from ..operators.matching import acceptable, evaluate, select_best
from ..operators.prepare import is_discovery, prefixed, prepare_papers, prepare_queries
from ..operators.ranking import coded_columns, discovery_order, rank_distinct_titles, rank_similar, same_paper, similarity_columns, within_years
from ..session import cut, sweep
from ..sources.registry import NAMES, ROLES

TIERS = ("primary", "fallback", "extended")


def variants(queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, variant_pos, label, precision, terms, free_text, doi, authors, limit) of every normalized query, in the order they are tried."""
    titled, named = F.col("title").isNotNull(), F.size("authors") > 0
    fuzzy = F.array_join("title_tokens", " ")
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def v(label: str, precision, terms, free=none, doi=none, authors=no_list, n: int = limit) -> Column:
        p = precision if isinstance(precision, Column) else F.lit(precision)
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), terms.alias("terms"), free.alias("free_text"), doi.alias("v_doi"), authors.alias("v_authors"), F.lit(n).alias("limit"))

    words = F.col("n_words")
    any_title = titled | F.col("doi").isNotNull()
    options = F.array_compact(
        F.array(
            F.when(F.col("doi").isNotNull(), v("doi", "identifier", no_list, doi=F.col("doi"), n=5)),
            F.when(titled, v("exact-title", "high", F.col("n_tokens"))),
            F.when(titled & named, v("title-author", "high", F.col("n_tokens"), authors=F.slice("authors", 1, 3))),
            F.when(titled & (fuzzy != "") & (fuzzy != F.col("n_title")), v("fuzzy-title", "medium", F.col("n_tokens"), free=fuzzy)),
            F.when(F.size("keywords") > 0, v("keywords", F.when(titled, "low").otherwise("medium"), words, authors=F.when(~titled, F.slice("authors", 1, 2)))),
            F.when(~any_title & (F.size("keywords") == 0) & named, v("authors-only", "low", no_list, authors=F.slice("authors", 1, 3))),
        )
    )
    return queries.select("query_id", F.posexplode(options).alias("variant_pos", "v")).select("query_id", "variant_pos", "v.*")


def similarity_query(title: Column, keywords: Column) -> Column:
    """Text that looks for related work: the title and up to four keywords, 400 characters."""
    text = F.concat_ws(" ", title, F.array_join(F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, 4), " "))
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 400)


# Words of 64 bits that tell which terms a set holds: with 512 bits hardly a pair that shares too little passes.
WORDS = 8
# Words of titles: two such words do, and terms in more than so many records are looked up in pairs.
TITLE_WORDS, HEAVY = 2, 1000


def _masks(side: str, words: int = WORDS) -> list[Column]:
    """The bits that a set of coded terms has set, in ``words`` columns."""
    word = "aggregate(terms, 0L, (m, t) -> if((shiftrightunsigned(t, 6) & {}) = {}, m | shiftleft(1L, cast(t & 63 as int)), m))"
    return [F.expr(word.format(words - 1, k)).alias(f"{side}{k}") for k in range(words)]


def _coded() -> tuple[Column, Column]:
    """Terms as 64-bit codes, and the code of the whole set."""
    codes = F.array_sort(F.transform("terms", lambda t: F.xxhash64(t)))
    return codes.alias("terms"), F.xxhash64(codes).alias("set")


def _pairs(terms: str) -> Column:
    """Codes of all pairs of a sorted list."""
    return F.expr(f"flatten(transform({terms}, (x, i) -> transform(slice({terms}, i + 2, size({terms})), y -> xxhash64(x, y))))")


def _sharing(asked: DataFrame, records: DataFrame, share: float, least: int, words: int, heavy: int | None) -> DataFrame:
    """asked: aid, terms; records: rid, terms (coded). -> (aid, rid, hits), see ``lookup``."""
    need = lambda n: F.greatest(F.lit(least), F.ceil(F.lit(share) * n - 1e-9)).cast("int")
    post = records.select("rid", F.explode("terms").alias("t"))
    want = asked.select("aid", F.size("terms").alias("n"), F.explode("terms").alias("t"))
    # terms of the asked set that share a bit with another one may all be held where the bit is
    a, r = [f"a{k}" for k in range(words)], [f"r{k}" for k in range(words)]
    total = lambda counts: reduce(lambda x, y: x + y, counts)
    spare = F.col("n") - total([F.bit_count(x) for x in a])
    masked = asked.select("aid", F.size("terms").alias("n"), *_masks("a", words)).select("aid", *a, (need(F.col("n")) - spare).cast("int").alias("bits"))
    df = post.select("t").join(want.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("aid").orderBy("df", "t")
    absent = F.coalesce("df", F.lit(0)).alias("df")
    ranked = want.join(df, "t", "left").select("aid", "t", "n", absent).withColumn("k", F.row_number().over(rarest)).withColumn("need", need(F.col("n")))
    first = F.col("k") <= F.col("n") - F.col("need") + 1
    held = records.select("rid", *_masks("r", words), "terms")
    if heavy is None:
        keys = ranked.where(first & (F.col("df") > 0)).select("aid", "t")
        held = held.select("rid", *r, F.explode("terms").alias("t"))
    else:
        # Two of the first n - need + 2 terms are shared: one in few records, which is looked up, or two in many, looked up as a pair.
        paired = (F.col("need") > 1) & (F.col("df") > heavy)
        alone = ranked.where(first & (F.col("df") > 0) & ~paired).select("aid", "t")
        many = ranked.where(paired & (F.col("k") <= F.col("n") - F.col("need") + 2)).select("aid", "t")
        two = many.groupBy("aid").agg(F.array_sort(F.collect_list("t")).alias("ts")).where(F.size("ts") > 1).select("aid", F.explode(_pairs("ts")).alias("t"))
        keys = alone.unionByName(two)
        of_many = post.join(many.select("t").distinct(), "t", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_list("t")).alias("ts")).where(F.size("ts") > 1)
        of_many = of_many.join(held.drop("terms"), "rid").select("rid", *r, F.explode(_pairs("ts")).alias("t"))
        one = held.select("rid", *r, F.explode("terms").alias("t"))
        held = one.join(alone.select("t").distinct(), "t", "left_semi").unionByName(of_many.join(two.select("t").distinct(), "t", "left_semi")).select("rid", *r, "t")
    keys = keys.join(masked, "aid")
    may = total([F.bit_count(F.col(x).bitwiseAND(F.col(y))) for x, y in zip(a, r)]) >= F.col("bits")
    found = keys.join(held, "t").where(may).select("aid", "rid").distinct()
    if heavy is not None:
        # the files of keys and postings aren't needed beside the sets that travel with the pairs
        found = cut(found)
        sweep(found.sparkSession)
    hits = F.size(F.array_intersect("a_terms", "r_terms"))
    return (
        found.join(asked.select("aid", F.col("terms").alias("a_terms")), "aid")
        .join(records.select("rid", F.col("terms").alias("r_terms")), "rid")
        .select("aid", "rid", hits.alias("hits"), F.size("a_terms").alias("asked"))
        .where(F.col("hits") >= need(F.col("asked")))
        .drop("asked")
    )


def lookup(asked: DataFrame, records: DataFrame, share: float = 0.0, least: int = 1) -> DataFrame:
    """asked: aid, terms; records: rid, terms (sets). -> (aid, rid, hits) sharing at least ``share`` of the asked terms, and ``least`` terms.

    Terms are looked up rarest first, and only as many as a sufficient overlap cannot avoid. Terms are 64-bit codes, and both sides of a
    found pair bring the bits of their terms along: a pair that can't share enough terms by these ends in the join, so that only the few
    others are moved and counted."""
    terms, _ = _coded()
    return _sharing(asked.select("aid", terms), records.select("rid", terms), share, least, WORDS, None)


def lookup_first(asked: DataFrame, records: DataFrame, share: float, most: int, by: tuple[str, ...] = (), words: int = TITLE_WORDS, heavy: int | None = HEAVY) -> DataFrame:
    """The first ``most`` of what ``lookup`` finds, by hits, then rid, for each asked set and each value of ``by`` (columns of records): aid, *by, rid, hits.

    Equal sets are one on either side: they have the same hits, so of those that records of one ``by`` hold, only the first ``most`` count,
    and those who ask the same get the same. With ``heavy``, terms in more records than that are looked up in pairs."""
    terms, code = _coded()
    asked = asked.select("aid", terms, code)
    records = records.select("rid", *by, terms, code)
    asks, sets = (x.groupBy("set").agg(F.min(i).alias(i), F.first("terms").alias("terms")) for x, i in ((asked, "aid"), (records, "rid")))
    shared = _sharing(asks.select("aid", "terms"), sets.select("rid", "terms"), share, 1, words, heavy)
    nth = Window.partitionBy("set", *by).orderBy("rid")
    members = records.select("set", *by, "rid").withColumn("k", F.row_number().over(nth)).where(F.col("k") <= most)
    members = members.join(sets.select("set", F.col("rid").alias("held")), "set").select("held", *by, "rid")
    top = Window.partitionBy("ask", *by).orderBy(F.col("hits").desc(), "rid")
    best = shared.select(F.col("aid").alias("ask"), F.col("rid").alias("held"), "hits").join(members, "held").select("ask", *by, "rid", "hits")
    best = best.withColumn("k", F.row_number().over(top)).where(F.col("k") <= most).drop("k")
    same = asked.select("aid", "set").join(asks.select("set", F.col("aid").alias("ask")), "set").select("aid", "ask")
    return same.join(best, "ask").select("aid", *by, "rid", "hits")


def retrieve(queries: DataFrame, papers: DataFrame, config: EngineConfig = DEFAULT, seq: str = "record_id") -> DataFrame:
    """(query_id, tier, variant_pos, ordinal, rank, seq): every candidate in the order of arrival, limited per query, variant and source."""
    tier_of, ordinal_of = {}, {}
    caps = {"primary": config.max_primary, "fallback": config.max_fallback, "extended": config.max_extended}
    for t, role in enumerate(TIERS):
        for o, key in enumerate(ROLES[role][: caps[role]]):
            tier_of[NAMES[key]], ordinal_of[NAMES[key]] = t, o
    pick = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("source"))
    recs = papers.select(F.col(seq).alias("rid"), "source", "n_doi", "n_tokens", "n_words", "n_authors").withColumn("tier", pick(tier_of)).withColumn("ordinal", pick(ordinal_of)).where("tier is not null")
    v = variants(queries, config.results_per_source)
    by_doi = v.where("label = 'doi'").join(recs.select("rid", "tier", "ordinal", F.col("n_doi").alias("v_doi")), "v_doi").select("query_id", "variant_pos", "limit", "tier", "ordinal", "rid", F.lit(1).alias("hits"))

    def found(labels: tuple[str, ...], terms: str, *how) -> DataFrame:
        """Variants of a query that ask with the same terms are looked up once."""
        asks = v.where(F.col("label").isin(*labels))
        once = queries.join(asks.select("query_id").distinct(), "query_id", "left_semi").select(F.col("query_id").alias("aid"), F.col(terms).alias("terms")).where(F.size("terms") > 0)
        hit = lookup_first(once, recs.select("rid", "tier", "ordinal", F.col(terms).alias("terms")), 0.5, config.results_per_source, ("tier", "ordinal"), *how).withColumnRenamed("aid", "query_id")
        return hit.join(asks.select("query_id", "variant_pos", "limit"), "query_id").select("query_id", "variant_pos", "limit", "tier", "ordinal", "rid", "hits")

    hits = found(("exact-title", "title-author", "fuzzy-title"), "n_tokens").unionByName(found(("keywords",), "n_words", WORDS, None))
    surname = F.transform("n_authors", lambda a: a["last"])
    only = v.where("label = 'authors-only'").join(queries.select("query_id", F.explode(surname).alias("last")), "query_id").select("query_id", "variant_pos", "limit", "last")
    people = recs.select("rid", "tier", "ordinal", F.explode(F.array_distinct(surname)).alias("last"))
    named = only.join(people, "last").groupBy("query_id", "variant_pos", "limit", "tier", "ordinal", "rid").agg(F.count("*").cast("int").alias("hits"))
    w = Window.partitionBy("query_id", "tier", "variant_pos", "ordinal").orderBy(F.col("hits").desc(), "rid")
    allhits = by_doi.unionByName(hits).unionByName(named)
    return allhits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("limit")).select("query_id", "tier", "variant_pos", "ordinal", "rank", F.col("rid").alias("seq"))


def arrival() -> Column:
    return F.struct("tier", "variant_pos", "ordinal", "rank", "seq")


# What the verdict reads of a query and of a record; everything else is fetched for the few rows that are returned.
ASKED = ("title", "doi", "from_year", "to_year", "n_title", "n_tokens", "n_authors", "n_words", "year_hint")
JUDGED = ("title", "year", "sources", "citation_count", "n_title", "n_tokens", "n_print", "n_doi", "n_authors", "n_venue", "n_words")
# What a verdict alone needs of the corpus, besides its key.
VERDICT = ("source", *JUDGED)
# What is read of a record, besides its key, to answer queries of keywords alone: they have no title, DOI or author to compare.
BY_WORDS = ("source", "year", "sources", "citation_count", "n_print", "n_words")
# What is read of a scored pair to identify a paper.
IDENTIFIED = ("query_id", "seq", "final_score", "match_type", "confidence", "is_exact", "q_title", "q_doi")


def score_candidates(arrivals: DataFrame, queries: DataFrame, papers: DataFrame, config: EngineConfig = DEFAULT, seq: str = "record_id") -> DataFrame:
    """Each (query, record) scored once, at its first arrival. arrivals are written (see ``cut``)."""
    first = arrivals.groupBy("query_id", "seq").agg(F.min(F.struct("tier", "variant_pos", "ordinal", "rank")).alias("a")).select("query_id", "seq", "a.*")
    # scoring is long work on few bytes: what came in fewer tasks than there are cores is spread over them
    cores = arrivals.sparkSession.sparkContext.defaultParallelism
    if arrivals.rdd.getNumPartitions() < cores:
        first = first.repartition(cores)
    q = prefixed(queries.select("query_id", *ASKED), "q_", ("query_id",))
    c = prefixed(papers.select(F.col(seq).alias("seq"), *JUDGED), "c_", ("seq",))
    drop = [f"q_{n}" for n in ASKED if n[:2] == "n_"] + [f"c_{n}" for n in JUDGED if n[:2] == "n_" and n != "n_print"]
    # the pairs of letters of a title are its longest column: they follow from it, so they don't travel with each pair
    pairs = first.join(q, "query_id").join(c, "seq").withColumns({f"{s}n_grams": bigrams(F.col(f"{s}n_title")) for s in ("q_", "c_")})
    return evaluate(pairs, config).drop(*drop, "q_n_grams", "c_n_grams")


def identify(scored: DataFrame, arrivals: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row per query that names a paper: the first source answer whose best record is exact, in order of arrival
    (so a tier only counts for queries that no earlier tier resolved), else the closest acceptable record."""
    slim = scored.select(*IDENTIFIED)
    each = arrivals.join(slim, ["query_id", "seq"])
    group = ["query_id", "tier", "variant_pos", "ordinal"]
    best = select_best(each, group, "rank").where("is_exact")
    exact = best.groupBy("query_id").agg(F.min_by(F.struct("seq", "match_type", "confidence", "tier"), F.struct("tier", "variant_pos", "ordinal")).alias("b")).select("query_id", "b.*", F.lit(True).alias("stopped_early"))
    rest = slim.join(exact.select("query_id"), "query_id", "left_anti").where(~is_discovery(F.col("q_title"), F.col("q_doi")))
    near = select_best(rest, ["query_id"]).where(acceptable(F.col("match_type"), F.col("confidence")))
    near = near.select("query_id", "seq", "match_type", "confidence", F.lit(None).cast("int").alias("tier"), F.lit(False).alias("stopped_early"))
    return exact.unionByName(near)


def discover(scored: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Ranked distinct titles for queries that name no paper."""
    x = scored.where(is_discovery(F.col("q_title"), F.col("q_doi")) & within_years(F.col("c_year"), F.col("q_from_year"), F.col("q_to_year")) & (F.col("final_score") > 0))
    return rank_distinct_titles(x, ["query_id"], discovery_order(config=config), config.max_similar)


def related_candidates(mains: DataFrame, papers: DataFrame, config: EngineConfig = DEFAULT, seq: str = "record_id") -> DataFrame:
    """(query_id, seq, strength): records that cite or are cited by a main paper, or cite three of the same works (strength: how many).

    mains and papers are prepared; mains also hold query_id."""
    m = mains.select("query_id", F.col(seq).alias("mid"), "doi", "reference_ids")
    refs = papers.select(F.col(seq).alias("seq"), F.explode("reference_ids").alias("ref"))
    mine = m.select("query_id", F.explode("reference_ids").alias("ref"))
    direct = F.lit(1_000_000).alias("strength")
    cited = mine.join(papers.select(F.col(seq).alias("seq"), F.col("doi").alias("ref")), "ref").select("query_id", "seq", direct)
    citing = m.select("query_id", F.col("doi").alias("ref")).where("ref is not null").join(refs, "ref").select("query_id", "seq", direct)
    some = lambda df, key, name: df.where("reference_ids is not null").select(F.col(key).alias(name), F.array_distinct("reference_ids").alias("terms"))
    coupled = lookup(some(m, "query_id", "aid"), some(papers, seq, "rid"), least=3).select(F.col("aid").alias("query_id"), F.col("rid").alias("seq"), F.col("hits").alias("strength"))
    return cited.unionByName(citing).unionByName(coupled).groupBy("query_id", "seq").agg(F.max("strength").alias("strength"))


SAME = ("doi", "pmcid", "pmid", "arxiv_id", "source", "source_id", "n_bare")
SCORED = (*SAME, "n_title", "n_tokens", "n_grams", "n_print", "n_venue", "abstract", "keywords", "topics", "reference_ids", "year", "pdf_url", "citation_count")


def _asked(found: DataFrame, by: DataFrame, sides: DataFrame, order: list[Column], most: int, seq: str) -> DataFrame:
    """found: query_id, seq, ... -> the first ``most`` of each source that isn't the main paper itself: query_id, ordinal, place, seq, key."""
    c = sides.select(F.col(seq).alias("seq"), "ordinal", F.coalesce("doi", F.lower("title")).alias("key"), *[F.col(n).alias(f"c_{n}") for n in SAME]).where("ordinal is not null")
    pairs = found.join(c, "seq").join(by.select("query_id", *[F.col(n).alias(f"m_{n}") for n in SAME]), "query_id")
    other = pairs.where(~F.coalesce(same_paper("m_", "c_"), F.lit(False)))
    w = Window.partitionBy("query_id", "ordinal").orderBy(*order, "seq")
    return other.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "ordinal", "place", "seq", "key")


def similar_pool(mains: DataFrame, papers: DataFrame, config: EngineConfig = DEFAULT, seq: str = "record_id") -> DataFrame:
    """(query_id, seq): candidates of each main paper. The sources for similar papers are asked in order for related records, at most twice
    the target each, until the pool is full. Where less than ``min_similar`` usable ones came, a search by title words tops up,
    source by source, until the pool is full or one and a half times the target is usable."""
    order = {NAMES[k]: n for n, k in enumerate(ROLES["similar"])}
    sides = papers.withColumn("ordinal", F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("source")))
    most = min(2 * config.max_similar, 40)
    related = _asked(related_candidates(mains, sides.where("ordinal is not null"), config, seq), mains, sides, [F.col("strength").desc()], most, seq)
    related = cut(related)
    sweep(papers.sparkSession)
    counts = related.groupBy("query_id", "ordinal").agg(F.count("*").alias("n"))
    first = cut(related.join(within_budget(counts, config.max_candidates).select("query_id", "ordinal"), ["query_id", "ordinal"], "left_semi"))
    had = usable_counts(first)
    short = cut(mains.select("query_id", "n_tokens").join(had, "query_id", "left").where(F.coalesce("usable", F.lit(0)) < config.min_similar).select("query_id", "n_tokens"))
    by_words = lookup(short.select(F.col("query_id").alias("aid"), F.col("n_tokens").alias("terms")).where(F.size("terms") > 0), sides.where("ordinal is not null").select(F.col(seq).alias("rid"), F.col("n_tokens").alias("terms")), 0.5)
    found = by_words.select(F.col("aid").alias("query_id"), F.col("rid").alias("seq"), "hits")
    searched = _asked(found, mains, sides, [F.col("hits").desc()], min(config.results_per_source, 2 * config.max_similar), seq)
    # what is there before a source is asked: rows, and different works
    both = cut(first.join(short.select("query_id"), "query_id", "left_semi").withColumn("ordinal", F.lit(-1)).unionByName(searched))
    new = both.groupBy("query_id", "key").agg(F.min("ordinal").alias("ordinal")).groupBy("query_id", "ordinal").agg(F.count("*").alias("works"))
    steps = both.groupBy("query_id", "ordinal").agg(F.count("*").alias("n")).join(new, ["query_id", "ordinal"], "left")
    before = Window.partitionBy("query_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    asked = steps.withColumns({"rows": earlier("n"), "usable": earlier("works")}).where((F.col("ordinal") >= 0) & (F.col("rows") < config.max_candidates) & (F.col("usable") < 1.5 * config.max_similar))
    more = both.join(asked.select("query_id", "ordinal"), ["query_id", "ordinal"], "left_semi")
    return first.select("query_id", "seq").unionByName(more.select("query_id", "seq")).distinct()


def find_similar(mains: DataFrame, papers: DataFrame, config: EngineConfig = DEFAULT, seq: str = "record_id") -> DataFrame:
    """The most similar papers of each main paper, among the candidates of its pool. mains: prepared paper columns, query_id, from_year, to_year.

    Pairs are scored on the columns that the score reads, derived for the records of the pools only; titles come at the end."""
    pairs = cut(similar_pool(mains, papers, config, seq))
    sweep(papers.sparkSession)
    slim = papers.select(F.col(seq).alias("seq"), *SCORED).join(pairs.select("seq").distinct(), "seq", "left_semi")
    c = prefixed(cut(coded_columns(similarity_columns(slim)).drop("keywords", "topics")), "c_", ("seq",))
    sweep(papers.sparkSession)
    m = prefixed(cut(coded_columns(similarity_columns(mains.select("query_id", "from_year", "to_year", *SCORED))).drop("keywords", "topics")), "m_", ("query_id", "from_year", "to_year"))
    sweep(papers.sparkSession)
    ranked = rank_similar(pairs.join(m, "query_id").join(c, "seq"), ["query_id"], config.max_similar, config)
    ranked = ranked.select("query_id", "rank", "seq", "similarity", "sim_title", "sim_abstract", "sim_keywords", "sim_topics", "relation_bonus")
    return ranked.join(papers.select(F.col(seq).alias("seq"), F.col("title").alias("c_title")), "seq")


def usable_counts(pool: DataFrame) -> DataFrame:
    """(query_id, usable): different works in a pool; key: DOI or lower-case title."""
    return pool.groupBy("query_id").agg(F.countDistinct("key").alias("usable"))


def within_budget(counts: DataFrame, cap: int, by: str = "query_id") -> DataFrame:
    """Sources that are still asked: the pool filled by earlier ones is below the cap (it may then overshoot). counts: ordinal, n."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).where(F.col("before") < cap)


def notes() -> Column:
    """Remarks of a response, from found, stopped_early, match_type, confidence, source and the number of results."""
    exact = F.when(F.col("stopped_early"), F.concat(F.lit("Exact match confirmed by "), F.col("source"), F.lit("; remaining main-paper requests were cancelled.")))
    near = F.when(
        F.col("found") & ~F.col("stopped_early"),
        F.concat(F.lit("No exact match; returning the closest candidate ("), F.col("match_type"), F.lit(", confidence "), F.format_number("confidence", 2), F.lit(").")),
    )
    listed = F.when(
        ~F.col("found") & (F.col("n_similar") > 0), F.concat(F.lit("No single paper could be identified from this query, so the "), F.col("n_similar").cast("string"), F.lit(" most relevant results are returned instead."))
    )
    nothing = F.when(~F.col("found") & (F.col("n_similar") == 0), F.lit("No confident match was found in the configured academic sources."))
    return F.array_compact(F.array(exact, near, listed, nothing))


def search(queries: DataFrame, papers: DataFrame, locations: DataFrame | None = None, config: EngineConfig = DEFAULT, seq: str = "record_id") -> DataFrame:
    """One response per query: the identified paper with its full text, similar or discovered papers, notes.

    papers holds the paper schema and ``seq``; deduplicate it first if sources overlap. locations: seq column, resolver order ``seq``, FULLTEXT."""
    # each stage is written once, so no later one repeats it and plans stay small
    q, p = cut(prepare_queries(queries, config.as_of_year)), cut(prepare_papers(papers))
    arrivals = cut(retrieve(q, p, config, seq))
    scored = cut(score_candidates(arrivals, q, p, config, seq))
    main = cut(identify(scored, arrivals, config))
    found = main.join(p.drop("match_type", "confidence").withColumn("seq", F.col(seq)), "seq")
    if locations is None:
        locations = p.sparkSession.createDataFrame([], f"{seq} bigint, seq int, source string, available boolean, url string, type string, access_type string, license string")
    full = cut(back_fill(resolve_full_text(found.drop("seq"), locations, seq)))
    similar = find_similar(full.join(q.select("query_id", "from_year", "to_year"), "query_id"), p, config, seq)
    hits = similar.select("query_id", "rank", F.col("seq").alias("hit"), F.col("c_title").alias("hit_title"), F.col("similarity").alias("score"))
    found_by_words = discover(scored, config).select("query_id", "rank", F.col("seq").alias("hit"), F.col("c_title").alias("hit_title"), F.col("final_score").alias("score"))
    listed = hits.unionByName(found_by_words).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hit", "hit_title", "score"))).alias("similar_papers"))
    ident = paper_id("doi", "pmcid", "pmid", "arxiv_id", "source", "source_id")
    paper = full.select("query_id", F.col(seq).alias("exact_id"), ident.alias("paper_id"), F.col("title").alias("exact_title"), "match_type", "confidence", "stopped_early", "source", "full_text", "pdf_url")
    empty = F.array().cast("array<struct<rank:int,hit:bigint,hit_title:string,score:double>>")
    x = q.select("query_id", "strategy").join(paper, "query_id", "left").join(listed, "query_id", "left")
    x = x.withColumns({"similar_papers": F.coalesce("similar_papers", empty), "found": F.col("exact_id").isNotNull(), "stopped_early": F.coalesce("stopped_early", F.lit(False))})
    return x.withColumn("n_similar", F.size("similar_papers")).withColumn("notes", notes())


def lookup_by_id(ids: DataFrame, papers: DataFrame, seq: str = "record_id") -> DataFrame:
    """ids: lookup_id, scheme, value -> the first record that answers, in the order of primary then fallback sources.

    DOIs are answered by every source, other schemes only by the sources that know them."""
    from ..sources.registry import ID_SCHEMES

    order = {NAMES[k]: n for n, k in enumerate([*ROLES["primary"], *ROLES["fallback"]])}
    pick = F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("source"))
    own = {"s2": "Semantic Scholar", "openalex": "OpenAlex", "core": "CORE", "doaj": "DOAJ"}
    keys = [F.struct(F.lit("doi").alias("scheme"), F.col("n_doi").alias("value"))]
    for scheme, column, shape in (("pmid", "pmid", F.lower), ("pmcid", "pmcid", F.upper), ("arxiv", "arxiv_id", F.lower)):
        answers = [NAMES[k] for k in ID_SCHEMES[scheme]]
        keys.append(F.when(F.col("source").isin(*answers), F.struct(F.lit(scheme).alias("scheme"), shape(F.col(column)).alias("value"))))
    for scheme, name in own.items():
        keys.append(F.when(F.col("source") == name, F.struct(F.lit(scheme).alias("scheme"), F.col("source_id").alias("value"))))
    known = papers.withColumn("ordinal", pick).where("ordinal is not null").select(seq, "ordinal", F.explode(F.array_compact(F.array(*keys))).alias("k")).select(seq, "ordinal", "k.*").where("value is not null")
    w = Window.partitionBy("lookup_id").orderBy("ordinal", seq)
    asked = ids.withColumn("value", F.when(F.col("scheme") == "arxiv", F.lower("value")).otherwise(F.col("value")))
    return asked.join(known, ["scheme", "value"]).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


__all__ = ["search", "identify", "discover", "find_similar", "retrieve", "score_candidates", "variants", "lookup", "lookup_first", "lookup_by_id", "related_candidates", "similar_pool", "title_tokens"]
