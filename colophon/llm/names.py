"""Spellings of one person's or organisation's name.

1. Every distinct spelling is reduced to a form: look-alike characters made ordinary, accents folded, titles
   and suffixes removed, tokens sorted (so order and commas don't matter), initials kept apart,
   abbreviations of organisations spelled out. Equal forms are one node.
2. Blocks: the phonetic code of each distinctive token, and the codes with one letter left out together with the
   first letter of another token. A typing error (letter added, lost, changed, or two swapped) keeps
   one of these codes; blocks hold a handful of forms however large the table is. Tokens with very many
   partners (given names, and surnames of many people) make no block of their own; forms of nothing else block by all
   tokens and by each token with another's first letter, and those with initials or a nickname ask for other forms by such keys.
   Two complete forms go on only if they have as many tokens, given names that can agree and nearly the same letters (``fit_code``): the join drops the rest, so
   people who merely share a surname or a misspelt given name, whose pairs grow with the square of the table, cost no comparison.
3. Pairs of a block are compared token by token: equal, nickname of each other, or - once per pair -
   Jaro-Winkler above ``JARO`` and at most two edits; a token may stand for an initial.
4. Clusters: connected components over pairs of complete forms. A form with initials or a surname only (a surname may have
   two parts) joins a cluster if all complete forms it agrees with lie in that one cluster, because people who share a
   surname and an initial differ. Where they lie in several, those that occur in the author list of the same work
   (same DOI or title) as the form decide.

Results: NULL and blank names and stand-ins for unnamed authors are no spellings. Repeated rows count once. Empty
tables give an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_doi
from ..operators.components import connected_components
from ..session import cut, release
from .charforms import normalize_strings

JARO = 0.87
# A token is a common given name from this many partner tokens on, and this share of the most connected token's partners.
PARTNERS, PARTNER_SHARE = 14, 0.1
# Titles and suffixes that are no part of a name.
TITLES = set("dr prof phd msc bsc md jr sr ii iii iv mr mrs ms the".split())
# Stand-ins for unnamed authors.
STAND_INS = {"anonymous", "anon", "author unknown", "unknown author", "unknown", "et al", "no author", "various", "various authors", "n a", "none", "not available", "authors not listed", "na"}
# Words of organisations, with their usual abbreviations.
ORGANISATION = {
    "consortium": "consortium", "cons": "consortium", "consort": "consortium", "collaboration": "collaboration", "collab": "collaboration", "coll": "collaboration",
    "network": "network", "netw": "network", "net": "network", "group": "group", "grp": "group", "gp": "group", "party": "party", "working": "working", "wp": "working party",
    "study": "study", "stud": "study", "wg": "working group", "sg": "study group", "committee": "committee", "comm": "committee", "team": "team", "project": "project",
    "proj": "project", "initiative": "initiative", "init": "initiative", "society": "society", "soc": "society", "institute": "institute", "inst": "institute", "association": "association", "assoc": "association",
}
# Familiar short forms of given names.
NICKNAMES = """
abdu abdurrahman; aga agnieszka; alex alexander; sasha alexander; ayse aysegul; bayo adebayo; bene benedicte; beppe giuseppe; peppe giuseppe; beth elizabeth; betty elizabeth; liz elizabeth; lizzie elizabeth;
bill william; will william; billy william; willi wilhelm; bob robert; rob robert; bert robert; chris christopher; kit christopher; kit katherine; deb deborah; debbie deborah; dick richard; rick richard; rich richard;
dima dmitri; emeka chukwuemeka; fati fatemeh; fran francisco; fran francois; paco francisco; fritz friedrich; gabi gabriela; gen genevieve; gosia malgorzata; hannes johannes; hans johannes; jen jennifer; jenny jennifer;
kate katherine; kathy katherine; katie katherine; leo leonardo; lola dolores; lucka lucja; maggie margaret; peggy margaret; meg margaret; max maximilien; memo guillermo; meo bartolomeo; mick michael; mike michael;
ming xiaoming; misha mikhail; nacho ignacio; nadya nadezhda; nat nathaniel; nate nathaniel; nella antonella; nkechi nkechinyere; penny penelope; pepe jose; priya priyanka; raju rajendra; sam samuel; seun oluwaseun;
staszek stanislaw; sue susannah; susie susannah; taka takahiro; ted theodore; theo theodore; tom thomas; tommy thomas; tori victoria; vicky victoria; ulla ursula; venky venkatesh; volodya vladimir; vova vladimir;
yuki yukiko; zach zachary; zak zachary; zbyszek zbigniew; zhenya yevgeniya; hubi hubert; jo johannes; tony antonio; joe joseph; jim james; dan daniel; dave david; steve stephen; andy andrew; nick nicholas; ben benjamin
"""
_FOLDS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})


def _umlauts(token: str) -> str:
    """Written-out umlauts and their plain vowels are one."""
    return token.replace("oe", "o").replace("ae", "a").replace("ue", "u") if len(token) > 3 else token


def _nicknames() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for pair in NICKNAMES.split(";"):
        short, full = (_umlauts(t) for t in pair.split())  # as parse() leaves them
        out.setdefault(short, set()).add(full)
    return {k: frozenset(v) for k, v in out.items()}


_NICK = _nicknames()
_NICK_WORDS = frozenset(_NICK).union(*_NICK.values())
_SPLIT = re.compile(r"[^\w]+|_+|\d+")
_MARKS = re.compile("[̀-ͯ]")


def fold(text: str) -> str:
    import unicodedata

    text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_FOLDS)
    return text


def parse(spelling: str) -> tuple[str, ...] | None:
    """Sorted tokens, complete ones first, then initials marked by a trailing dot. None for stand-ins and names without letters."""
    import unicodedata

    raw = [t for t in _SPLIT.split(_MARKS.sub("", unicodedata.normalize("NFKD", spelling.replace("'", "").replace("’", "")))) if t]
    if not raw:
        return None
    if " ".join(raw).lower() in STAND_INS:
        return None
    long, initials = [], []
    mixed = any(t != t.upper() for t in raw if len(t) > 2)
    for t in raw:
        low = t.lower().translate(_FOLDS)
        if low in TITLES:
            continue
        if low in ORGANISATION and len(raw) > 2:
            long += ORGANISATION[low].split()
        elif len(t) == 1 or (len(t) <= 2 and t.isupper()) or (len(t) == 3 and t.isupper() and mixed):
            initials += [c + "." for c in low]
        else:
            long.append(_umlauts(low))
    if not long:
        return None
    return (*sorted(long), *sorted(initials))


def phonetic(token: str) -> str:
    """Spelling variants that sound alike share a code; vowels are kept, so codes stay selective."""
    for a, b in (("ph", "f"), ("sch", "sh"), ("ck", "k"), ("c", "k"), ("q", "k"), ("z", "s"), ("w", "v"), ("y", "i"), ("dt", "t")):
        token = token.replace(a, b)
    out = token[:1]
    for ch in token[1:]:
        if ch != out[-1]:
            out += ch
    return out


def _others(form: tuple[str, ...], token: str) -> set[str]:
    """First letters of the form's tokens beside this one; of a nickname also those of what it stands for."""
    others = {t[0] for t in form if t[-1] == "."}
    for o in form:
        if o != token and o[-1] != ".":
            others.update(x[0] for x in _NICK.get(o, (o,)))
            others.add(o[0])
    return others


def initial_keys(form: tuple[str, ...], common: frozenset[str] | set[str]) -> tuple[bool, set[str]]:
    """(asks, keys): common tokens with another token's first letter. A form of common tokens with initials or a nickname asks for
    the forms that have a token of their own; those don't meet each other here, for such blocks would be large."""
    long = [t for t in form if t[-1] != "."]
    plain = [t for t in long if (t in common or t in _NICK) and t not in _ORG_WORDS]
    asks = len(plain) == len(long)
    if asks and len(long) == len(form) and not any(t in _NICK for t in long):
        return asks, set()
    return asks, {f"{t}|{o}" for t in plain for o in _others(form, t)}


def block_keys(form: tuple[str, ...], common: frozenset[str] | set[str]) -> set[tuple[str, str | None]]:
    """(key, code): two forms meet under a key unless both have the same code there, for then they meet elsewhere."""
    long = [t for t in form if t[-1] != "."]
    own = [t for t in long if t not in common and t not in _NICK and t not in _ORG_WORDS]
    if not own:
        code = "".join(phonetic(t) for t in sorted(long))
        keys: set[tuple[str, str | None]] = {("a" + code, None), *(("e" + phonetic(code[:k] + code[k + 1 :]), code) for k in range(len(code))), ("e" + code, code)}
    else:
        keys = {("k" + phonetic(t), None) for t in own}
    for t in own or [t for t in long if t not in _ORG_WORDS]:
        code = phonetic(t)
        for o in _others(form, t):
            if not own:
                keys.add((f"c{code}|{o}", None))
            keys.add((f"d{code}|{o}", code))
            keys.update((f"d{phonetic(t[:k] + t[k + 1 :])}|{o}", code) for k in range(len(t)))
    return keys


_ORG_WORDS = set(" ".join(ORGANISATION.values()).split())


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    reach = max(0, max(la, lb) // 2 - 1)
    hit_a, hit_b, m = [False] * la, [False] * lb, 0
    for i in range(la):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not hit_b[j] and a[i] == b[j]:
                hit_a[i] = hit_b[j] = True
                m += 1
                break
    if not m:
        return 0.0
    x = [a[i] for i in range(la) if hit_a[i]]
    y = [b[j] for j in range(lb) if hit_b[j]]
    t = sum(p != q for p, q in zip(x, y)) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    k = 0
    while k < min(4, la, lb) and a[k] == b[k]:
        k += 1
    return jaro + 0.1 * k * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, up to 3."""
    if abs(len(a) - len(b)) > 2:
        return 3
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        prev2, prev = prev, row
    return prev[-1]


def _typo(a: str, b: str, jaro: float = JARO) -> float | None:
    """How near two tokens are that may be a typing error apart."""
    if min(len(a), len(b)) >= 4 and edits(a, b) <= (1 if min(len(a), len(b)) < 6 else 2) and (s := jaro_winkler(a, b)) >= jaro:
        return s
    return None


def _same_given(a: str, b: str) -> bool:
    return bool(_NICK.get(a, frozenset((a,))) & _NICK.get(b, frozenset((b,))))


def agree(a: tuple[str, ...], b: tuple[str, ...], common, jaro: float = JARO) -> int:
    """0 no, 1 with an initial or a missing given name, 2 all tokens agree."""
    la, lb = [t for t in a if t[-1] != "."], [t for t in b if t[-1] != "."]
    ia, ib = [t[0] for t in a if t[-1] == "."], [t[0] for t in b if t[-1] == "."]
    rest_b = list(lb)
    rest_a = []
    shared, telling = 0, False
    for t in la:
        if t in rest_b:
            rest_b.remove(t)
            shared += 1
            telling |= t not in common and t not in _NICK
        else:
            rest_a.append(t)
    for t in list(rest_a):
        u = next((u for u in rest_b if _same_given(t, u)), None)
        if u:
            rest_a.remove(t)
            rest_b.remove(u)
            shared += 1
    level = 2
    if rest_a and rest_b:
        pair = None
        for t in rest_a:
            for u in rest_b:
                if not (t in common and u in common) and not (t in _NICK and u in _NICK):
                    if (s := _typo(t, u, jaro)) is not None and (pair is None or s > pair[0]):
                        pair = (s, t, u)
        if pair is None:
            # one name in full against another in full: only initials may bridge, and not on both sides
            if len(rest_a) and len(rest_b):
                return 0
        else:
            rest_a.remove(pair[1])
            rest_b.remove(pair[2])
            if pair[1] in common or pair[2] in common:
                shared += 0
            else:
                shared += 1
                telling = True
        if rest_a and rest_b:
            return 0
    for rest, own, other in ((rest_a, ia, ib), (rest_b, ib, ia)):
        for t in list(rest):
            firsts = {x[0] for x in _NICK.get(t, (t,))} | {t[0]}
            hit = next((c for c in other if c in firsts), None)
            if hit:
                other.remove(hit)
                rest.remove(t)
                level = 1
    if rest_a or rest_b:
        rest, long, mine = (rest_a, lb, ib) if rest_a else (rest_b, la, ia)
        # a bare surname agrees with anyone of that surname
        if len(long) != 1 or mine or long[0] in common or long[0] in _NICK:
            return 0
        level = 1
    if ia and ib and not set(ia) & set(ib):
        return 0
    if not shared:
        return 0
    # common tokens count only where nothing of either form is left over
    if not telling and sorted(ia) != sorted(ib):
        return 0
    if level == 2 and (len(la) < 2 or len(lb) < 2):
        level = 1
    return level


def fit_code(form: tuple[str, ...], common: frozenset[str] | set[str], cache: dict[str, int] | None = None) -> int:
    """0 for forms with initials or a single token. Of the others, from the lowest bit: how many tokens (4 bits) and given names (4; common ones, or words of
    the nickname table) they have, whether one is a nickname (1), their length (6), 16 bits of the given names, of what these are short for and of rare given
    names a typing error away, and for 32 classes of letters whether their number is odd."""
    if len(form) < 2 or any(t[-1] == "." for t in form):
        return 0
    cache = {} if cache is None else cache
    bits, odd, given = 0, 0, [t for t in form if t in common or t in _NICK_WORDS]
    for t in given:
        if t not in cache:
            # two common names never count as a typing error, so the rare ones suffice
            alike = {t, *_NICK.get(t, ()), *(v for v in _NICK_WORDS if v not in common and (_typo(t, v) or _typo(v, t)))}
            cache[t] = sum({1 << zlib.crc32(x.encode()) % 16 for x in alike})
        bits |= cache[t]
    for ch in "".join(form):
        odd ^= 1 << ord(ch) % 32
    code = odd << 31 | bits << 15 | min(sum(map(len, form)), 63) << 9 | any(t in _NICK for t in form) << 8 | min(len(given), 15) << 4 | min(len(form), 15)
    return code


def fits(a: str = "fit_a", b: str = "fit_b") -> str:
    """Whether two forms can agree by their ``fit_code``. Tokens of complete forms agree one by one, but for one pair a typing error apart: so there are as many,
    given names (equal, or nicknames) agree with given names, and at most one of them with another token, misspelt. Without nicknames two edits are all that
    differs, and each changes the length by one and the number of letters of two classes at most."""
    part = lambda c, shift, mask: f"(shiftright({c}, {shift}) & {mask})"
    n, m = (part(c, 0, 15) for c in (a, b))
    p, q = (part(c, 4, 15) for c in (a, b))
    given = f"if({p} = {q}, {p} = 0 or {part(f'{a} & {b}', 15, 65535)} <> 0, abs({p} - {q}) = 1)"
    letters = f"({part(f'{a} | {b}', 8, 1)} = 1 or (abs({part(a, 9, 63)} - {part(b, 9, 63)}) <= 2 and bit_count(shiftright({a} ^ {b}, 31)) <= 4))"
    return f"({n} = 0 or {m} = 0 or ({n} = {m} and {given} and {letters}))"


def spelled_out() -> Column:
    """The spelling of a row of crossref_authors."""
    return F.coalesce("name", F.when(F.col("given").isNull(), F.col("family")).otherwise(F.concat("family", F.lit(", "), "given")))


def spellings(papers: DataFrame, crossref: DataFrame) -> DataFrame:
    """Distinct spellings exactly as stored."""
    listed = papers.select(F.explode("authors").alias("name"))
    typed = crossref.select(spelled_out().alias("name"))
    return listed.unionByName(typed).where("trim(name) <> ''").distinct()


def occurrences(papers: DataFrame, crossref: DataFrame) -> DataFrame | None:
    """(spelled, work): hashes of a spelling and of a work, by its DOI and by its title, that lists it. None where the tables name no works."""
    if "doi" not in papers.columns or "title" not in papers.columns:
        return None
    title = F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", "")
    keys = F.array_compact(F.array(F.when(F.col("d").isNotNull(), F.xxhash64(F.lit("d"), "d")), F.when(F.length("t") > 11, F.xxhash64(F.lit("t"), "t"))))
    works = papers.select(F.explode("authors").alias("name"), normalize_doi("doi").alias("d"), title.alias("t"))
    if "work_doi" in crossref.columns:
        typed = crossref.select(spelled_out().alias("name"), normalize_doi("work_doi").alias("d"), F.lit(None).cast("string").alias("t"))
        works = works.unionByName(typed)
    return works.where("trim(name) <> ''").select(F.xxhash64("name").alias("spelled"), F.explode(keys).alias("work"))


def forms(names: DataFrame) -> DataFrame:
    """(name, form): form is the tokens joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain, _ = normalize_strings(b.column("name"))
            got = [parse(x or "") for x in plain.to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column("name"), pa.array([" ".join(g) if g else None for g in got], pa.string())], names=["name", "form"])
            yield out.filter(out.column("form").is_valid())

    return names.mapInArrow(run, "name string, form string")


def meetings(form: DataFrame, common: Broadcast[frozenset[str]]) -> DataFrame:
    """Pairs of forms (id_a, form_a, id_b, form_b) that share a block and can agree."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache: dict[str, int] = {}
        for b in batches:
            ids, texts, codes, own, fit = [], [], [], [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("form").to_pylist()):
                tokens = tuple(text.split(" "))
                code_of_fit = fit_code(tokens, common.value, cache)
                for k, code in block_keys(tokens, common.value):
                    ids.append(i)
                    texts.append(text)
                    fit.append(code_of_fit)
                    codes.append(xxhash.xxh64_intdigest(k) - (1 << 63))
                    own.append(None if code is None else xxhash.xxh32_intdigest(code) - (1 << 31))
            arrays = [pa.array(codes, pa.int64()), pa.array(own, pa.int32()), pa.array(fit, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "code", "fit", "id", "form"])

    rows = form.mapInArrow(keys, "key bigint, code int, fit bigint, id bigint, form string")
    a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("code", "fit", "id", "form")]) for s in "ab")
    return a.join(b, "key").where(f"id_a < id_b and (code_a is null or code_a <> code_b) and {fits()}").select("id_a", "form_a", "id_b", "form_b")


def links(form: DataFrame) -> DataFrame:
    """(a, b, level) of agreeing forms; form: id, form."""
    spark = form.sparkSession
    token = F.explode(F.array_distinct(F.filter(F.split("form", " "), lambda t: (F.length(t) >= 3) & ~F.endswith(t, F.lit(".")))))
    exploded = form.select("id", token.alias("token"))
    pair = exploded.join(exploded.withColumnRenamed("token", "partner"), "id").where("token <> partner").select("token", "partner").distinct()
    degree = cut(pair.groupBy("token").agg(F.count("*").alias("n")))
    top = degree.agg(F.max("n")).first()[0] or 0
    # given names are few; the bound keeps the broadcast small whatever the table holds
    rows = degree.where(F.col("n") >= max(PARTNERS, int(top * PARTNER_SHARE))).select("token").limit(200_001).collect()
    release(degree)
    if len(rows) > 200_000:
        raise ValueError("too many common tokens; raise PARTNER_SHARE")
    common = spark.sparkContext.broadcast(frozenset(r["token"] for r in rows))
    near = meetings(form, common)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out = []
            for i, text in zip(b.column("id").to_pylist(), b.column("form").to_pylist()):
                asks, found = initial_keys(tuple(text.split(" ")), common.value)
                out += [(xxhash.xxh64_intdigest(k) - (1 << 63), asks, i, text) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.string()))], names=["key", "asks", "id", "form"])

    asked = form.mapInArrow(asking, "key bigint, asks boolean, id bigint, form string")
    a, b = (asked.where(c).select("key", F.col("id").alias(f"id_{s}"), F.col("form").alias(f"form_{s}")) for s, c in (("a", "asks"), ("b", "not asks")))
    near = near.unionByName(a.join(b, "key").drop("key"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            got = []
            for x, y, s, t in zip(b.column("id_a").to_pylist(), b.column("id_b").to_pylist(), b.column("form_a").to_pylist(), b.column("form_b").to_pylist()):
                if (x, y) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add((x, y))
                if level := agree(tuple(s.split(" ")), tuple(t.split(" ")), common.value):
                    got.append((x, y, level))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "level"])

    return near.mapInArrow(verify, "a bigint, b bigint, level int").distinct()


def clusters(papers: DataFrame, crossref: DataFrame) -> DataFrame:
    """(name, cluster) of every spelling."""
    named = cut(forms(spellings(papers, crossref)).withColumn("id", F.xxhash64("form")))
    form = named.select("id", "form").distinct()
    edges = cut(links(form))
    n_long = F.size(F.filter(F.split("form", " "), lambda t: ~F.endswith(t, F.lit("."))))
    info = form.select("id", n_long.alias("n"))
    # of two forms with several complete tokens that agree by an initial, the one with less of them has a surname of several parts and no given name
    sizes = [info.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab"]
    by_initial = edges.where("level = 1").join(sizes[0], "a").join(sizes[1], "b").where("n_a >= 2 and n_b >= 2 and n_a <> n_b")
    short = cut(by_initial.select(F.when(F.col("n_a") < F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct())
    full = info.where("n >= 2").select("id").join(short, "id", "left_anti")
    part = info.where("n < 2").select("id").unionByName(short)
    # complete forms
    strong = edges.where("level = 2").join(full.withColumnRenamed("id", "a"), "a", "left_semi").join(full.withColumnRenamed("id", "b"), "b", "left_semi")
    first = connected_components(strong.select("a", "b").unionByName(full.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    first = first.select(F.col("node").alias("id"), "component")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # incomplete forms whose complete partners all lie in one cluster
    partners = cut(both.join(part.withColumnRenamed("id", "a"), "a", "left_semi").join(first.select(F.col("id").alias("b"), "component"), "b"))
    reach = lambda rows: rows.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    seen, at = reach(partners), None
    listed = occurrences(papers, crossref)
    if listed is not None:
        # several clusters: partners that a work of the form lists as well decide
        open_ = partners.join(seen.where("low <> high").select("a"), "a", "left_semi")
        at = cut(listed.join(named.select(F.xxhash64("name").alias("spelled"), "id"), "spelled").select("id", "work").distinct())
        together = open_.join(at.withColumnRenamed("id", "a"), "a").join(at.withColumnRenamed("id", "b"), ["b", "work"], "left_semi")
        told = reach(together).where("low = high").select("a", F.col("low").alias("told"))
        seen = seen.join(told, "a", "left").select("a", F.coalesce("told", "low").alias("low"), F.coalesce("told", "high").alias("high"))
    seen = cut(seen)
    release(partners)
    if at is not None:
        release(at)
    attached = seen.where("low = high").select(F.col("a").alias("id"), F.col("low").alias("component"))
    # those without any complete partner cluster among themselves, and follow an attached one
    free = part.join(seen.select(F.col("a").alias("id")), "id", "left_anti")
    loose = both.join(free.withColumnRenamed("id", "a"), "a", "left_semi").join(part.withColumnRenamed("id", "b"), "b", "left_semi")
    ambiguous = seen.where("low <> high").select(F.col("a").alias("b"))
    loose = loose.join(ambiguous, "b", "left_anti").join(attached.select(F.col("id").alias("b"), "component"), "b", "left").select("a", F.coalesce("component", "b").alias("b"))
    # a loose form with several neighbours is ambiguous as well
    single = loose.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo = hi").select(F.col("a").alias("id"), F.col("lo").alias("to"))
    # neighbours are mutual, so two forms that only have each other are a pair; all others follow a form that stands for itself
    mutual = single.select(F.col("id").alias("to"), F.lit(True).alias("mutual"))
    follows = single.join(mutual, "to", "left").select("id", F.when(F.col("mutual"), F.least("id", "to")).otherwise(F.col("to")).alias("component"))
    rest = part.join(attached.select("id"), "id", "left_anti").join(single.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    label = first.unionByName(attached).unionByName(follows).unionByName(rest)
    label = label.groupBy("id").agg(F.min("component").alias("cluster"))
    return named.join(label, "id").select("name", "cluster")


def variant_pairs(papers: DataFrame, crossref: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point."""
    c = cut(clusters(papers, crossref))
    a, b = c.withColumnRenamed("name", "name_a"), c.withColumnRenamed("name", "name_b")
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
