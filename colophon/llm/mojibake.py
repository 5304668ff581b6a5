"""Text that was decoded with the wrong character encoding.

1. A smoothed character bigram model is trained on the clean records of the whole table. Characters
   are mapped to a fixed alphabet of 512 symbols, so the counts are one 512 x 512 table whatever the
   corpus holds: partial tables per task, one aggregation, at most 262,144 cells to the driver.
   A record counts as clean for training when it has no replacement character, no C1 control and no
   misread UTF-8 sequence.
2. Every word with an unlikely pair is scored under each chain "encode as the wrong set, decode as the
   right one" (twice and three times for repeated damage); the likeliest reading wins. It is accepted if
   the gain in log-likelihood passes ``margin``: per word for UTF-8, whose byte structure is evidence in
   itself, per document for one-byte and double-byte sets.

Results: NULL, empty and blank text is never garbled. Repeated rows give repeated rows. Replacement
characters mark a text as garbled but can't be restored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import code_points, pieces

SYMBOLS = 512
MARGIN = 6.0
DOC_MARGIN = 14.0
UNLIKELY = math.log(2e-4)
# Sets that text is read with by mistake, and the sets it was written in.
WRONG = ("cp1252", "latin-1", "cp437", "cp850", "cp852", "mac-roman", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-15", "cp1254", "iso8859-9", "mac-latin2")
CHAINS = (
    ("latin-1", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "koi8-r"), ("cp1252", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8-r"), ("koi8-r", "cp866"), ("cp1251", "iso8859-5"), ("latin-1", "iso8859-5"),
    ("latin-1", "iso8859-2"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"),
    ("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp852"), ("cp852", "cp1250"), ("cp1250", "cp852"),
    ("latin-1", "cp437"), ("latin-1", "cp850"), ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "mac-latin2"),
    ("latin-1", "cp932"), ("cp1252", "cp932"), ("latin-1", "euc-jp"), ("cp1252", "euc-jp"), ("mac-roman", "cp932"), ("mac-roman", "euc-jp"), ("cp437", "cp932"),
)
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
# Typographic signs with a symbol of their own.
_SIGNS = "–—‘’“”…•†‡‰‹›€™≥≤"


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    t = np.full(0x20000, 511, np.uint16)
    t[:0x180] = np.arange(0x180)
    t[0x400:0x460] = 384 + np.arange(0x60)
    for lo, hi, s in ((0x370, 0x400, 480), (0x1F00, 0x2000, 480), (0x3040, 0x30A0, 481), (0x30A0, 0x3100, 482), (0x3400, 0xA000, 483), (0x3000, 0x3040, 484), (0xFF00, 0xFF61, 485), (0xFF61, 0xFFA0, 509), (0x2500, 0x25A0, 486), (0x2200, 0x2300, 503), (0xE000, 0xF900, 504), (0x1F000, 0x20000, 505), (0x180, 0x250, 507), (0x460, 0x530, 508), (0x2000, 0x200C, 510), (0xFFFD, 0xFFFE, 506)):
        t[lo:hi] = s
    for k, ch in enumerate(_SIGNS):
        t[ord(ch)] = 487 + k if k < 16 else 510
    return t


@lru_cache(maxsize=1)
def byte_views() -> dict[str, dict[int, int]]:
    """Per wrong set: code point -> the byte it was read from (undefined bytes were read as C1), anything else -> U+FFFF."""
    out = {}
    for name in {*WRONG, *(w for w, _ in CHAINS)}:
        view = {c: 0xFFFF for c in range(0x80, 0x100)}
        for b in range(0x80, 0x100):
            try:
                view[ord(bytes([b]).decode(name))] = b
            except UnicodeDecodeError:
                view[b] = b
        out[name] = view
    return out


@lru_cache(maxsize=1)
def sequence_masks() -> tuple[np.ndarray, ...]:
    """Per code point, one bit per wrong set: it is a lead byte of a two, three or four byte sequence, or a continuation."""
    masks = tuple(np.zeros(0x20000, np.uint16) for _ in range(4))
    for k, name in enumerate(w for w in WRONG if w not in ("koi8-r", "cp866")):  # there ordinary words form sequences
        for c, b in byte_views()[name].items():
            for m, (lo, hi) in zip(masks, ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4), (0x80, 0xBF))):
                if lo <= b <= hi and chr(c) not in "\u0451\u0401":
                    m[c] |= 1 << k
    return masks


@lru_cache(maxsize=1)
def class_weights() -> np.ndarray:
    """Log of one over the number of characters that share a symbol."""
    w = np.zeros(SYMBOLS, np.float64)
    for s, n in ((480, 100), (481, 85), (482, 85), (483, 2500), (484, 30), (485, 90), (486, 128), (503, 200), (504, 3000), (505, 600), (507, 200), (508, 200), (509, 63), (510, 10), (511, 20000)):
        w[s] = -math.log(n)
    return w


def _symbols(cp: np.ndarray) -> np.ndarray:
    return symbol_table()[np.minimum(cp, 0x1FFFF)]


def _damage(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions with a certain sign of damage (U+FFFD, C1) and positions that start a misread UTF-8 sequence."""
    sure = (cp == 0xFFFD) | ((cp >= 0x80) & (cp < 0xA0) & (cp != 0x85))
    pair = np.zeros(len(cp), bool)
    at = np.flatnonzero(cp >= 0x80)
    if len(at):
        lead2, lead3, lead4, cont = sequence_masks()
        safe = np.minimum(np.concatenate([cp, np.zeros(3, cp.dtype)]), 0x1FFFF)
        c1 = cont[safe[at + 1]]
        c2 = c1 & cont[safe[at + 2]]
        hit = (lead2[safe[at]] & c1) | (lead3[safe[at]] & c2) | (lead4[safe[at]] & c2 & cont[safe[at + 3]])
        pair[at[hit != 0]] = True
    return sure, pair


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log P(b | a) as a 512 x 512 table, from every clean record."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for b in pieces(batches, "text"):
            cp, at = code_points(b.column(0))
            if len(cp) < 2:
                continue
            sure, pair = _damage(cp)
            bad = np.concatenate([[0], np.cumsum(sure | pair)])
            dirty = np.repeat(bad[at[1:]] > bad[at[:-1]], np.diff(at))
            s = _symbols(cp).astype(np.int64)
            ok = ~dirty[:-1]
            ok[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(cp))] - 1] = False
            total += np.bincount((s[:-1] * SYMBOLS + s[1:])[ok], minlength=SYMBOLS * SYMBOLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS * SYMBOLS)
    counts[np.asarray(rows.column("cell"), dtype=np.int64)] = np.asarray(rows.column("n"), dtype=np.float64)
    return model(counts.reshape(SYMBOLS, SYMBOLS))


def model(counts: np.ndarray, strength: float = 20.0, discount: float = 4.0) -> np.ndarray:
    """Pairs interpolated with single symbols, single symbols with a uniform floor. Pairs beyond ASCII are discounted,
    so that what a few damaged records hold doesn't count as seen in a small corpus."""
    counts = counts.copy()
    counts[128:, :] = np.maximum(counts[128:, :] - discount, 0)
    counts[:128, 128:] = np.maximum(counts[:128, 128:] - discount, 0)
    single = counts.sum(0)
    p = (single + 0.02) / (single.sum() + 0.02 * SYMBOLS)
    return np.log((counts + strength * p) / (counts.sum(1, keepdims=True) + strength)).astype(np.float32)


class Scorer:
    """Scores words under every chain; remembers words, since the same ones come again."""

    def __init__(self, table: np.ndarray, margin: float, doc_margin: float, memory: int = 200_000):
        self.rows = [r.tolist() for r in table.astype(np.float64) + class_weights()]
        self.margin, self.doc_margin, self.memory = margin, doc_margin, memory
        self.symbols = symbol_table().tolist()
        self.seen: dict[str, tuple] = {}

    def score(self, word: str) -> float:
        sym, rows = self.symbols, self.rows
        prev, total = 32, 0.0
        for ch in word:
            s = sym[min(ord(ch), 0x1FFFF)]
            total += rows[prev][s]
            prev = s
        return total + rows[prev][32]

    @staticmethod
    def as_utf8(word: str, wrong: str) -> str:
        view = word.translate(byte_views()[wrong])
        out, last = [], 0
        for m in _UTF8.finditer(view):
            try:
                ch = m.group().encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [word[last : m.start()], ch]
            last = m.end()
        return "".join(out) + word[last:] if out else word

    def utf8(self, word: str) -> tuple[str, float, str]:
        """Best repeated UTF-8 repair: text, gain, chain."""
        best, gain, chain = word, 0.0, ""
        for _ in range(3):
            base, step = self.score(best), None
            for wrong in WRONG:
                new = self.as_utf8(best, wrong)
                if new != best:
                    g = self.score(new) - base
                    if step is None or g > step[1]:
                        step = (new, g, wrong)
            if step is None or step[1] < self.margin / 2:
                break
            best, gain, chain = step[0], gain + step[1], f"{chain}>{step[2]}" if chain else step[2]
        return best, gain, chain

    def others(self, word: str) -> list[tuple[int, str, float]]:
        base, out = self.score(word), []
        for k, (wrong, right) in enumerate(CHAINS):
            try:
                new = word.translate(byte_views()[wrong]).encode("latin-1").decode(right)
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            if new != word and new.isprintable():
                out.append((k, new, self.score(new) - base))
        return out

    def word(self, word: str) -> tuple:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            got = self.seen[word] = (*self.utf8(word), tuple(self.others(word)))
        return got

    def document(self, text: str, spans: list[tuple[int, int]]) -> tuple[str, str, float]:
        """(chains, restored text, gain); no chain if nothing passes the margin."""
        fixes: dict[tuple[int, int], tuple[str, float, str]] = {}
        words = [(span, self.word(text[span[0] : span[1]])) for span in spans]
        for span, (new, gain, chain, _) in words:
            if gain >= self.margin:
                fixes[span] = (new, gain, f"utf-8 read as {chain}")
        for _ in range(3):  # a text may hold passages of different history
            by_chain: dict[int, float] = defaultdict(float)
            for span, (_, _, _, rest) in words:
                have = fixes[span][1] if span in fixes else 0.0
                for k, _, g in rest:
                    by_chain[k] += g - have if g > have else (0.0 if have else 2 * g)
            k, gain = max(by_chain.items(), key=lambda x: x[1], default=(0, 0.0))
            if gain < self.doc_margin:
                break
            for span, (_, _, _, rest) in words:
                have = fixes[span][1] if span in fixes else 0.0
                for j, new, g in rest:
                    if j == k and g > have:
                        fixes[span] = (new, g, "{1} read as {0}".format(*CHAINS[k]))
        if not fixes:
            return "", text, 0.0
        out, last = [], 0
        for (a, b), (new, _, _) in sorted(fixes.items()):
            out += [text[last:a], new]
            last = b
        return "; ".join(sorted({f[2] for f in fixes.values()})), "".join(out) + text[last:], sum(f[1] for f in fixes.values())


def repair(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, doc_margin: float = DOC_MARGIN) -> DataFrame:
    """(id, chains, gain, restorable, restored) of every garbled record. ``restored`` keeps what can't be repaired."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    data = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = data.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lp = shared.value
        scorer = Scorer(lp, margin, doc_margin)
        flat = lp.reshape(-1)
        for b in pieces(batches, "text"):
            cp, at = code_points(b.column("text"))
            got = []
            if len(cp) > 1:
                sure, pair = _damage(cp)
                s = _symbols(cp).astype(np.int32)
                high = cp >= 0x80
                # the blank before a text's first character stands for its start
                prev = np.append(np.int32(32), s[:-1])
                prev[at[:-1][at[:-1] < len(cp)]] = 32
                odd = (flat[prev * SYMBOLS + s] < UNLIKELY) & (high | np.append(False, high[:-1]))
                sus = sure | pair | odd
                n_sus = np.concatenate([[0], np.cumsum(sus)])
                n_sure = np.concatenate([[0], np.cumsum(sure)])
                blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
                for r in np.flatnonzero(n_sus[at[1:]] > n_sus[at[:-1]]):
                    lo, hi = int(at[r]), int(at[r + 1])
                    edges = np.concatenate([[-1], np.flatnonzero(blank[lo:hi]), [hi - lo]])
                    hit = np.unique(np.searchsorted(edges, np.flatnonzero(sus[lo:hi]), side="right"))
                    spans = [(int(edges[k - 1]) + 1, int(edges[k])) for k in hit if k < len(edges) and edges[k] > edges[k - 1] + 1]
                    text = b.column("text")[int(r)].as_py()
                    chains, restored, gain = scorer.document(text, spans)
                    lost = bool(n_sure[hi] > n_sure[lo])
                    if chains or lost:
                        got.append((int(r), chains or "characters lost", gain, restored))
            idx = pa.array([g[0] for g in got], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(idx), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[1] != "characters lost" for g in got], pa.bool_()), pa.array([g[3] for g in got], pa.string())],
                names=["id", "chains", "gain", "restorable", "restored"],
            )

    return data.mapInArrow(run, f"id {id_type}, chains string, gain double, restorable boolean, restored string").withColumnRenamed("id", id_col)
