"""Evaluation texts that leak into training text.

The test items form an inverted index whose terms are pairs of neighbouring words (hashed), with BM25
impacts. Items are grouped in blocks; every term carries its largest impact per block (block-max) and
over all items. Each corpus document is read as overlapping passages, each a query against the index:

1. a passage is dropped if the sum of its terms' largest impacts stays below the threshold (the WAND
   bound: no item can reach it), then each block whose block-max sum stays below it;
2. what remains is scored exactly against the items of the remaining blocks; all (passage, item)
   pairs above the threshold are kept - no top-k, no cap;
3. kept pairs are verified word by word: chains of matching words along a diagonal, which allow single
   changed or inserted words, must add up to ``min_words`` words of the
   item's own text, ``min_passage`` of them in one passage (or to ``min_scattered`` words in any passages). Words of
   phrases that ``shared_items`` or more items have in common (instructions) don't count.

Only the items are broadcast; their size is checked (``max_index_bytes``), and larger item sets are
processed in slices of items, each a pass over the corpus. What is counted over items - how many hold a term, how many
share a phrase, how many there are - is counted over all of them by Spark, so results don't depend on slices. Items of equal
text are one item there and in the index. The threshold is stated in terms that only one item holds, so it
means the same for one item as for a million. Words are compared without case, accents, punctuation and invisible characters.

The filter between 2 and 3 (``in_sequence``) drops nothing that 3 accepts: ``min_passage`` words in runs of three or more hold at least
``min_passage`` - ``min_passage`` / 3 neighbouring pairs in the item's order, within the words it looks at.

Results: NULL, empty and blank documents or items match nothing. Repeated documents and repeated items
are reported each. Empty tables give an empty table. Whether the item's answer stands in the document too is verified and reported;
it doesn't decide, for a passage of the question alone is a leak.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .points import code_points, pieces

PASSAGE, STEP = 64, 32
K1, B = 1.2, 0.5
# In weights of a term that a single item holds.
THRESHOLD = 6.8
MIN_WORDS = 16
MIN_PASSAGE = 14
# Words in sequence that are a leak however short their runs are (marks inserted everywhere).
MIN_SCATTERED = 26
SHARED_ITEMS = 3
# Terms of an item of ordinary length.
TYPICAL_LENGTH = 150
BLOCK = 16
MAX_INDEX_BYTES = 64_000_000
ITEMS_PER_SLICE = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> folded code point of a word character, 0 separates words, 1 is skipped."""
    t = np.zeros(0x20000, np.uint32)
    for cp in range(0x20000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Mn", "Cf") or ch == "­":
            t[cp] = 1
        elif cat[0] in "LN":
            t[cp] = ord(unicodedata.normalize("NFKD", ch).lower()[0])
    return t


def words(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, row of every word). Han and kana characters are words of their own."""
    folded = fold_table()[np.minimum(cp, 0x1FFFF)]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = folded != 1
    folded, row = folded[keep], row[keep]
    if not len(folded):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    is_word = folded > 0
    han = (folded >= 0x3040) & (folded < 0xA000)
    cont = is_word[:-1] & is_word[1:] & (row[:-1] == row[1:]) & ~han[:-1] & ~han[1:]
    first = np.flatnonzero(is_word & ~np.append(False, cont))
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # polynomial hash of each word: position in the word gives the power
    pos = np.arange(len(folded))
    start = np.zeros(len(folded), np.int64)
    start[first] = first
    start = np.maximum.accumulate(start)
    power = _powers(int((pos - start)[is_word].max()) + 1)
    with np.errstate(over="ignore"):
        part = np.where(is_word, (folded.astype(np.uint64) + np.uint64(7)) * power[np.where(is_word, pos - start, 0)], np.uint64(0))
        h = np.add.reduceat(part, first)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, row[first]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _pairs(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of (word, next word); 0 at the end of a text."""
    out = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        with np.errstate(over="ignore"):
            p = h[:-1] * np.uint64(0x94D049BB133111EB) + h[1:]
            p ^= p >> np.uint64(31)
        out[:-1] = np.where(row[:-1] == row[1:], p | np.uint64(1), np.uint64(0))
    return out


def _fives(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every phrase of five words, position of its first word)."""
    if len(word) < 5:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        five = sum((word[k : len(word) - 4 + k] * np.uint64(2 * k * k + 6 * k + 1) for k in range(5)), np.zeros(len(word) - 4, np.uint64))
    at = np.flatnonzero(row[:-4] == row[4:])
    return five[at], at


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, kind, hash) of what is counted over items: 0 the phrases, 1 the pairs of each text, without repeats."""
    cp, at = code_points(pa.array(texts, pa.string()))
    word, row = words(cp, at)
    five, first = _fives(word, row)
    pair = _pairs(word, row)
    some = pair > 0
    all_rows = np.concatenate([row[first], row[some]])
    kind = np.repeat([0, 1], [len(first), int(some.sum())])
    got = np.unique(np.stack([all_rows.astype(np.uint64), kind.astype(np.uint64), np.concatenate([five, pair[some]])]), axis=1)
    return got[0].astype(np.int64), got[1].astype(np.int64), got[2]


class Index:
    """Inverted index of the items, as arrays only. n: different items in all slices; phrases: hashes of the phrases that
    several of them share; df: number of them that hold a pair (0 where nothing is known)."""

    def __init__(self, ids: list, texts: list[str | None], n: int, phrases: np.ndarray, df: tuple[np.ndarray, np.ndarray], block: int = BLOCK):
        self.ids = ids
        count = len(ids)
        cp, at = code_points(pa.array(texts, pa.string()))
        self.word, self.row = words(cp, at)
        self.start = np.searchsorted(self.row, np.arange(count + 1))
        pair = _pairs(self.word, self.row)
        # words of phrases (five words) that several items share don't count
        own = np.ones(len(self.word), bool)
        five, first = _fives(self.word, self.row)
        for k in first[np.isin(five, phrases)]:
            own[k : k + 5] = False
        self.own = own
        valid = (pair > 0) & own & np.append(own[1:], False)
        p, r, q = pair[valid], self.row[valid], np.flatnonzero(valid) - self.start[self.row[valid]]
        order = np.lexsort((q, r, p))
        self.post_item, self.post_pos = r[order].astype(np.int32), q[order].astype(np.int32)
        self.terms, begin = np.unique(p[order], return_index=True)
        self.begin = np.append(begin, len(order)).astype(np.int64)
        length = np.bincount(r, minlength=count)
        term_of = np.repeat(np.arange(len(self.terms)), np.diff(self.begin))
        key = term_of.astype(np.int64) * max(1, count) + self.post_item
        uk, tf = np.unique(key, return_counts=True)
        self.w_term, self.w_item = (uk // max(1, count)).astype(np.int64), (uk % max(1, count)).astype(np.int32)
        known, held = df
        where = np.minimum(np.searchsorted(known, self.terms), max(0, len(known) - 1))
        holds = np.where(known[where] == self.terms, held[where], 1) if len(known) else np.ones(len(self.terms))
        idf = np.log(1 + (n - holds + 0.5) / (holds + 0.5))
        # the length that BM25 compares with is a fixed one, so an item's weights don't depend on the others' lengths
        norm = K1 * (1 - B + B * length[self.w_item] / TYPICAL_LENGTH)
        self.unit = float(np.log(1 + (n - 0.5) / 1.5))
        self.w = (idf[self.w_term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        self.w_begin = np.searchsorted(self.w_term, np.arange(len(self.terms) + 1))
        self.block = block
        bk = self.w_term * (count // block + 1) + self.w_item // block
        ub, bi = np.unique(bk, return_index=True)
        self.b_max = np.maximum.reduceat(self.w, bi) if len(bi) else np.empty(0, np.float32)
        self.b_term, self.b_block = ub // (count // block + 1), ub % (count // block + 1)
        self.b_begin = np.searchsorted(self.b_term, np.arange(len(self.terms) + 1))
        self.top = np.maximum.reduceat(self.w, self.w_begin[:-1]) if len(self.terms) else np.empty(0, np.float32)

    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))


def _spread(begin: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence of a term all positions of its list: (occurrence, position)."""
    n = begin[term + 1] - begin[term]
    occ = np.repeat(np.arange(len(term)), n)
    off = np.arange(len(occ)) - np.repeat(np.cumsum(n) - n, n)
    return occ, begin[term][occ] + off


def in_sequence(ix: Index, pairs: np.ndarray, term: np.ndarray, pos: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """Those (row, item) where at least ``least`` matching terms keep the item's order within a few words."""
    n = len(ix.ids)
    keys = pairs[:, 0] * n + pairs[:, 1]
    sel = np.isin(row, pairs[:, 0])
    term, pos, row = term[sel], pos[sel], row[sel]
    occ, at = _spread(ix.begin, term)
    key = row[occ] * n + ix.post_item[at]
    where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    sel = keys[where] == key
    where, at_word, shift = where[sel], pos[occ][sel], (pos[occ] - ix.post_pos[at])[sel] + (1 << 20)
    keep = np.zeros(len(keys), bool)
    for half in (0, 4):  # overlapping bands of eight diagonals, overlapping stretches of 48 words
        for part in (0, 24):
            band, count = np.unique((where << 42) + ((shift + half) // 8 << 20) + (at_word + part) // 48, return_counts=True)
            keep[band[count >= least] >> 42] = True
    return pairs[keep]


def candidates(ix: Index, term: np.ndarray, pos: np.ndarray, row: np.ndarray, threshold: float, least: int = 7) -> np.ndarray:
    """All (row, item) with a passage that scores above the threshold; columns row, item."""
    none = np.empty((0, 2), np.int64)
    if not len(term):
        return none
    hits = (term, pos, row)
    # a term occurrence at word p belongs to the passages that cover it
    p = np.concatenate([pos // STEP, pos // STEP - 1])
    ok = p >= 0
    span = int(pos.max()) // STEP + 2
    passage = (np.concatenate([row, row]) * span + p)[ok]
    term = np.concatenate([term, term])[ok]
    uniq, inv = np.unique(passage, return_inverse=True)
    live = np.bincount(inv, weights=ix.top[term]) >= threshold  # bound over all items
    sel = live[inv]
    inv, term = inv[sel], term[sel]
    if not len(inv):
        return none
    n_blocks = len(ix.ids) // ix.block + 1
    occ, at = _spread(ix.b_begin, term)
    key = inv[occ] * n_blocks + ix.b_block[at]
    ukey, kinv = np.unique(key, return_inverse=True)
    ukey = ukey[np.bincount(kinv, weights=ix.b_max[at]) >= threshold]  # bound per block
    if not len(ukey):
        return none
    occ, at = _spread(ix.w_begin, term)
    item = ix.w_item[at].astype(np.int64)
    key = inv[occ] * n_blocks + item // ix.block
    where = np.minimum(np.searchsorted(ukey, key), len(ukey) - 1)
    sel = ukey[where] == key
    pair = inv[occ][sel] * len(ix.ids) + item[sel]
    upair, pinv = np.unique(pair, return_inverse=True)
    good = upair[np.bincount(pinv, weights=ix.w[at][sel]) >= threshold]
    if not len(good):
        return none
    found = np.unique(uniq[good // len(ix.ids)] // span * len(ix.ids) + good % len(ix.ids))
    return in_sequence(ix, np.stack([found // len(ix.ids), found % len(ix.ids)], 1), *hits, least)


def overlap(doc: np.ndarray, ix: Index, item: int, least: int = 6, shift: int = 3) -> tuple[int, int]:
    """(Words of the item's own text that the document holds in sequence, most in one passage).

    Matches are grouped by diagonal (document position less item position) and cut where two or more
    words in a row differ, so a run allows single changed words. Runs on neighbouring diagonals that
    follow each other closely (a word split, joined or inserted) count together. What is left with fewer
    than ``least`` words or less than 70 % of its span is a common phrase and doesn't count."""
    lo, hi = ix.start[item], ix.start[item + 1]
    w, own = ix.word[lo:hi], ix.own[lo:hi]
    order = np.argsort(w, kind="stable")
    ws = w[order]
    a, b = np.searchsorted(ws, doc, "left"), np.searchsorted(ws, doc, "right")
    n = b - a
    occ = np.repeat(np.arange(len(doc)), n)
    q = order[np.repeat(a, n) + np.arange(len(occ)) - np.repeat(np.cumsum(n) - n, n)]
    sel = own[q]
    occ, q = occ[sel], q[sel]
    if len(occ) < least:
        return 0, 0
    diag = occ - q
    by = np.lexsort((occ, diag))
    occ, q, diag = occ[by], q[by], diag[by]
    new = np.append(True, (diag[1:] != diag[:-1]) | (occ[1:] - occ[:-1] > 2))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(occ)) - 1
    size = last - first + 1
    # a run needs three words to take part at all
    runs = [(int(occ[f]), int(occ[g]), int(q[f]), int(q[g]), int(n)) for f, g, n in zip(first, last, size) if n >= 3]
    runs.sort()
    used, found, most = [False] * len(runs), set(), 0
    for i, (p0, p1, q0, q1, n) in enumerate(runs):
        if used[i]:
            continue
        used[i] = True
        spans, total, end_p, end_q = [(q0, q1)], n, p1, q1
        for j in range(i + 1, len(runs)):
            a0, a1, b0, b1, m = runs[j]
            if a0 - end_p > 4:
                break
            if not used[j] and a0 > end_p and b0 > end_q and b0 - end_q <= 4 and abs((a0 - end_p) - (b0 - end_q)) <= shift:
                used[j] = True
                spans.append((b0, b1))
                total, end_p, end_q = total + m, a1, b1
        if total >= least and total >= 0.7 * (end_q - q0 + 1) and total >= 0.7 * (end_p - p0 + 1) and any(y - x >= 4 for x, y in spans):
            most = max(most, total)
            for x, y in spans:
                found.update(range(x, y + 1))
    return len(found), most


def distinct_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, text) of every different text of items, and (rep, eval_id, answer) of every item."""
    member = items.where("eval_id is not null and trim(text) <> ''").select(F.xxhash64("text").alias("rep"), "eval_id", "text", "answer")
    return member.groupBy("rep").agg(F.min("text").alias("text")), member.drop("text")


def statistics(reps: DataFrame, slices: int) -> tuple[int, DataFrame]:
    """(number of different items; slice, kind, hash, n of what the slice's items hold and more than one item has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, kind, h = counted(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("slice").take(pa.array(text)), pa.array(kind, pa.int32()), pa.array(h.view(np.int64))], names=["slice", "kind", "hash"])

    held = reps.select(slice_of(slices).alias("slice"), "text").mapInArrow(run, "slice int, kind int, hash bigint")
    per_slice = held.groupBy("slice", "kind", "hash").agg(F.count("*").alias("n"))
    # a hash stands in at most as many rows as there are slices
    total = per_slice.groupBy("kind", "hash").agg(F.sum("n").alias("n"), F.collect_list("slice").alias("slices")).where("n > 1")
    return reps.count(), total.select(F.explode("slices").alias("slice"), "kind", "hash", "n")


def slice_of(slices: int) -> Column:
    return F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE, min_scattered: int = MIN_SCATTERED, max_index_bytes: int = MAX_INDEX_BYTES, items_per_slice: int = ITEMS_PER_SLICE) -> DataFrame:
    """(eval_id, doc_id, words, item_words, answer_found): every document with a passage of an item's own text."""
    spark = docs.sparkSession
    reps, member = distinct_items(items)
    reps = cut(reps)
    slices = max(1, -(-reps.count() // items_per_slice))
    n, stats = statistics(reps, slices)
    stats = cut(stats)
    data = docs.select("doc_id", "text")
    id_type = data.schema["doc_id"].dataType.simpleString()
    out = f"rep bigint, doc_id {id_type}, words int, item_words int, answers array<string>"
    # of equal items, all answers are looked for; their number per text is that of its copies with different answers
    answers_of = member.where("trim(answer) <> ''").select("rep", "answer").distinct().groupBy("rep").agg(F.collect_list("answer").alias("answers"))
    asked = reps.join(answers_of, "rep", "left")

    def one(k: int) -> DataFrame:
        rows = asked.where(slice_of(slices) == k).toArrow().to_pylist()  # at most one slice of items
        known = stats.where(F.col("slice") == k).select("kind", "hash", "n").toArrow()  # at most their phrases and pairs
        kind, h, held = (known.column(c).to_numpy() for c in ("kind", "hash", "n"))
        h = h.view(np.uint64)
        order = np.argsort(h[kind == 1])
        ix = Index([r["rep"] for r in rows], [r["text"] for r in rows], n, h[(kind == 0) & (held >= SHARED_ITEMS)], (h[kind == 1][order], held[kind == 1][order]))
        if ix.nbytes() > max_index_bytes:
            raise ValueError(f"index of {ix.nbytes()} bytes exceeds the bound; use smaller slices of items")
        answers = [[(a, " ".join(a.lower().split())) for a in r["answers"] or []] for r in rows]
        shared = spark.sparkContext.broadcast((ix, answers))
        least = max(3, min(7, min_passage - -(-min_passage // 3)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, answers = shared.value
            for b in pieces(batches, "text"):
                cp, at = code_points(b.column("text"))
                word, row = words(cp, at)
                got = []
                if len(word) and len(ix.terms):
                    pair = _pairs(word, row)
                    where = np.minimum(np.searchsorted(ix.terms, pair), len(ix.terms) - 1)
                    hit = np.flatnonzero(ix.terms[where] == pair)
                    first = np.searchsorted(row, np.arange(len(at)))
                    for r, item in candidates(ix, where[hit], hit - first[row[hit]], row[hit], threshold * ix.unit, least):
                        found, most = overlap(word[first[r] : first[r + 1]], ix, int(item))
                        if (found >= min_words and most >= min_passage) or found >= min_scattered:
                            text = " ".join(b.column("text")[int(r)].as_py().lower().split())
                            got.append((ix.ids[item], int(r), found, int(ix.own[ix.start[item] : ix.start[item + 1]].sum()), [a for a, plain in answers[item] if plain in text]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), b.column("doc_id").take(pa.array([g[1] for g in got], pa.int32()))] + [pa.array([g[c] for g in got], t) for c, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.list_(pa.string())))],
                    names=["rep", "doc_id", "words", "item_words", "answers"],
                )

        return data.mapInArrow(run, out)

    found = reduce(DataFrame.unionByName, [one(k) for k in range(slices)])
    said = F.coalesce(F.array_contains("answers", F.col("answer")), F.lit(False))
    return found.join(member, "rep").select("eval_id", "doc_id", "words", "item_words", said.alias("answer_found"))
