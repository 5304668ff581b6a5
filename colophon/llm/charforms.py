"""One consistent form for text that looks the same but differs in its characters.

Each Arrow batch is handled as one code-point array: the UTF-8 buffer of all strings is decoded
once, classes and replacements come from lookup tables by gathers, expanding replacements move
through offset arithmetic (``repeat`` + cumulative sums), and combining marks are composed by
one vectorized pass per mark position over (base, mark) keys. No string method runs per row.

A text is *affected* when it holds
  * invisible format characters (zero-width, joiners, soft hyphen, marks of direction, BOM) - joiners
    between letters of joining scripts are ordinary,
  * blanks other than the ASCII one (the ideographic blank is ordinary next to CJK text),
  * full-width letters and digits; full-width punctuation where the text has no CJK character,
  * compatibility letters (ligatures, letter-like signs, script g, Roman numeral signs), look-alike hyphens,
  * combining marks (of any script, and conjoining jamo) that have a precomposed form with their base,
  * letters of another script inside a word, or standing for a whole word although nothing else
    in the text is of that script, where each looks like a letter of the text's own script.
Typographic quotes, long dashes, ellipses, superscripts, markup and double blanks are ordinary.

NULL stays NULL and is never affected; an empty text stays empty; an empty list stays empty; NULL
list elements stay NULL.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic and Greek that look like a Latin letter.
CYRILLIC_LIKE = dict(zip("АВЕЅЗІЈКМНОРСТУХЬаеіјорсухѕһԁԛԝҮҺ", "ABESЗIJKMHOPCTYXbaeijopcyxshdqwYH"))
GREEK_LIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονκιυρ", "ABEZHIKMNOPTYXovkiupp"))
CYRILLIC_LIKE.pop("З")
CYRILLIC_LIKE.pop("Ь")
# Latin letters that look like a Cyrillic letter, for Cyrillic words.
LATIN_LIKE_CYRILLIC = dict(zip("ABEKMHOPCTYXaeopcyxis", "АВЕКМНОРСТУХаеорсухіѕ"))
LATIN_LIKE_GREEK = dict(zip("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"))
# Single signs that stand for an ordinary letter or hyphen.
LETTER_SIGNS = {"ɡ": "g", "ı": "ı", "‐": "-", "‑": "-", "﹣": "-"}
# Compatibility characters that are ordinary in running text.
ORDINARY_COMPAT = "…‥ªº²³¹¼½¾™℠№µ´¨¯¸·"

INVISIBLE, BLANK, WIDE_LETTER, WIDE_PUNCT, COMPAT, MARK = 1, 2, 4, 8, 16, 32
LATIN, CYRILLIC, GREEK, CJK, JOINING, OTHER_LETTER = 1, 2, 3, 4, 5, 6
_SIZE = 0x20000


def _script(ch: str) -> int:
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0x250 <= cp < 0x2B0:
        return LATIN
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return GREEK
    if 0x400 <= cp < 0x530 or 0x1C80 <= cp < 0x1C90:
        return CYRILLIC
    if 0x3040 <= cp < 0x3100 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7B0 or 0xF900 <= cp < 0xFB00 or cp in (0x3005, 0x3006):
        return CJK
    if 0x600 <= cp < 0x780 or 0x840 <= cp < 0x870 or 0x900 <= cp < 0xE00 or 0x1000 <= cp < 0x10A0 or 0x1780 <= cp < 0x18B0:
        return JOINING
    return OTHER_LETTER


@lru_cache(maxsize=1)
def tables():
    """Class, script and replacement per code point, and the sorted (base, mark) composition keys."""
    flag = np.zeros(_SIZE, np.uint8)
    script = np.zeros(_SIZE, np.uint8)
    alike = np.zeros(_SIZE, np.uint8)  # bit 1 looks Latin, bit 2 Latin that looks Cyrillic, bit 4 Latin that looks Greek
    plain: dict[int, str] = {}
    for cp in range(0x80, _SIZE):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            script[cp] = _script(ch)
        elif cat in ("Mn", "Mc"):
            script[cp] = 0
        if cat == "Cf" and not 0x600 <= cp <= 0x61C and cp != 0xE0001:
            flag[cp], plain[cp] = INVISIBLE, ""
        elif cat == "Zs":
            flag[cp], plain[cp] = BLANK, " "
        elif 0xFF01 <= cp <= 0xFF5E:
            plain[cp] = chr(cp - 0xFEE0)
            flag[cp] = WIDE_LETTER if plain[cp].isalnum() else WIDE_PUNCT
            if cat[0] == "L":
                script[cp] = LATIN
        elif ch in LETTER_SIGNS:
            if LETTER_SIGNS[ch] != ch:
                flag[cp], plain[cp] = COMPAT, LETTER_SIGNS[ch]
        elif ch not in ORDINARY_COMPAT and cat in ("Ll", "Lu", "Lt", "Nl", "Lo", "Nd", "Lm"):
            k = unicodedata.normalize("NFKC", ch)
            d = unicodedata.decomposition(ch)
            singleton = d and not d.startswith("<") and " " not in d
            latin = all(x.isalnum() and ord(x) < 0x250 for x in k)
            if k != ch and latin and (singleton or d.startswith("<") and not d.startswith(("<super>", "<sub>"))):
                flag[cp], plain[cp] = COMPAT, k
                script[cp] = LATIN
        if cat == "Mn":
            flag[cp] = MARK
    for cp in range(0x80):
        if chr(cp).isalpha():
            script[cp] = LATIN
    for ch in CYRILLIC_LIKE:
        alike[ord(ch)] |= 1
    for ch in GREEK_LIKE:
        alike[ord(ch)] |= 1
    for ch in LATIN_LIKE_CYRILLIC:
        alike[ord(ch)] |= 2
    for ch in LATIN_LIKE_GREEK:
        alike[ord(ch)] |= 4
    first = np.arange(_SIZE, dtype=np.uint32)
    length = np.ones(_SIZE, np.uint8)
    extra_at = np.zeros(_SIZE, np.uint32)
    extra: list[int] = []
    for cp, text in plain.items():
        length[cp] = len(text)
        if text:
            first[cp] = ord(text[0])
        if len(text) > 1:
            extra_at[cp] = len(extra)
            extra += [ord(x) for x in text[1:]]
    compose = {}
    for cp in range(0xC0, _SIZE):
        d = unicodedata.decomposition(chr(cp))
        if d and not d.startswith("<") and " " in d:
            base, mark = (int(x, 16) for x in d.split())
            if unicodedata.normalize("NFC", chr(base) + chr(mark)) == chr(cp):
                compose[(base << 17) | mark] = cp
    for cp in range(0xAC00, 0xD7A4):  # Hangul syllables decompose by rule, not by table
        n, tail = divmod(cp - 0xAC00, 28)
        base, mark = (cp - tail, 0x11A7 + tail) if tail else (0x1100 + n // 21, 0x1161 + n % 21)
        compose[(base << 17) | mark] = cp
    second = np.zeros(_SIZE, bool)
    second[[k & (_SIZE - 1) for k in compose]] = True
    keys = np.array(sorted(compose), np.uint64)
    values = np.array([compose[int(k)] for k in keys], np.uint32)
    to_latin, to_cyr, to_greek = (np.arange(_SIZE, dtype=np.uint32) for _ in range(3))
    for k, v in {**CYRILLIC_LIKE, **GREEK_LIKE}.items():
        to_latin[ord(k)] = ord(v)
    for k, v in LATIN_LIKE_CYRILLIC.items():
        to_cyr[ord(k)] = ord(v)
    for k, v in LATIN_LIKE_GREEK.items():
        to_greek[ord(k)] = ord(v)
    return dict(flag=flag, script=script, alike=alike, first=first, length=length, extra_at=extra_at, extra=np.array(extra or [0], np.uint32), second=second, keys=keys, values=values, to_latin=to_latin, to_cyr=to_cyr, to_greek=to_greek)


def _per_row(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Bitwise or of values by row."""
    out = np.zeros(n, values.dtype)
    ends = np.append(starts[1:], len(values))
    full = starts < ends
    if len(values) and full.any():
        out[full] = np.bitwise_or.reduceat(values, starts[full])
    return out


def _compose(cp: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composes (base, mark) neighbours until none is left; returns code points, rows and rows that changed."""
    changed = np.empty(0, row.dtype)
    while len(cp) > 1:
        safe = np.minimum(cp, _SIZE - 1)
        at = np.flatnonzero(t["second"][safe[1:]] & (row[1:] == row[:-1])) + 1
        if not len(at):
            break
        key = (cp[at - 1].astype(np.uint64) << np.uint64(17)) | cp[at].astype(np.uint64)
        pos = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = t["keys"][pos] == key
        at, pos = at[hit], pos[hit]
        if len(at) > 1:  # a mark's base mustn't itself be a mark composed in this round
            clear = np.append(True, at[1:] != at[:-1] + 1)
            at, pos = at[clear], pos[clear]
        if not len(at):
            break
        cp = cp.copy()
        cp[at - 1] = t["values"][pos]
        changed = np.append(changed, row[at])
        keep = np.ones(len(cp), bool)
        keep[at] = False
        cp, row = cp[keep], row[keep]
    return cp, row, changed


def normalize_points(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and row starts of a batch -> normalized code points, row lengths, affected rows."""
    t = tables()
    n = len(starts)
    row = np.repeat(np.arange(n), np.diff(np.append(starts, len(cp))))
    safe = np.minimum(cp, _SIZE - 1)
    flag, script = t["flag"][safe], t["script"][safe]
    has_cjk = _per_row((script == CJK).astype(np.uint8), starts, n).astype(bool)
    bad = np.zeros(len(cp), bool)

    invisible = flag == INVISIBLE
    if invisible.any():
        nxt, prv = np.append(script[1:], 0), np.append(0, script[:-1])
        joiner = (cp == 0x200C) | (cp == 0x200D)
        emoji = joiner & (np.append(cp[1:], 0) > 0x2000) & (np.append(0, cp[:-1]) > 0x2000) & (nxt == 0) & (prv == 0)
        invisible &= ~(joiner & (nxt == JOINING) & (prv == JOINING)) & ~emoji
    bad |= invisible
    blank = (flag == BLANK) & ~((cp == 0x3000) & has_cjk[row])
    wide = (flag == WIDE_LETTER) | ((flag == WIDE_PUNCT) & ~has_cjk[row])
    bad |= blank | wide | (flag == COMPAT)

    # table gather with expansion offsets
    length = np.where(bad, t["length"][safe], 1).astype(np.int64)
    out_cp = np.repeat(np.where(bad, t["first"][safe], cp), length)
    out_row = np.repeat(row, length)
    src = np.repeat(np.arange(len(cp)), length)
    begin = np.cumsum(length) - length
    k = np.arange(len(out_cp)) - begin[src]
    tail = np.flatnonzero(k > 0)
    if len(tail):
        out_cp[tail] = t["extra"][t["extra_at"][safe[src[tail]]] + k[tail] - 1]
    affected = np.zeros(n, bool)
    affected[row[bad]] = True

    out_cp, out_row, changed = _compose(out_cp.astype(np.uint32), out_row, t)
    affected[changed.astype(int)] = True

    # look-alike letters, word by word
    safe = np.minimum(out_cp, _SIZE - 1)
    script, alike = t["script"][safe], t["alike"][safe]
    letter = (script > 0) | (t["flag"][safe] == MARK)
    if len(out_cp):
        first = letter & ~np.append(False, letter[:-1] & (out_row[1:] == out_row[:-1]))
        word = np.cumsum(first) - 1
        ls = np.flatnonzero(letter)
        nw = int(first.sum())
        foreign = np.flatnonzero((script == CYRILLIC) | (script == GREEK))
        if len(foreign) and nw:
            w = word[ls]
            count = lambda mask: np.bincount(w, weights=mask[ls], minlength=nw).astype(np.int64)
            lat, cyr, gre = count(script == LATIN), count(script == CYRILLIC), count(script == GREEK)
            looks_lat = count(((script == CYRILLIC) | (script == GREEK)) & ((alike & 1) > 0))
            lat_as_cyr, lat_as_gre = count((script == LATIN) & ((alike & 2) > 0)), count((script == LATIN) & ((alike & 4) > 0))
            word_row = out_row[np.flatnonzero(first)]
            per_row = lambda v: np.bincount(word_row, weights=v, minlength=n).astype(np.int64)
            foreign_n = cyr + gre
            # words with a real letter of the other script show that the text holds that script
            true_cyr = per_row(((cyr > 0) & (looks_lat < cyr) & (gre == 0)).astype(int))
            true_gre = per_row(((gre > 0) & (looks_lat < gre) & (cyr == 0)).astype(int))
            row_lat = per_row(lat)
            mixed_to_lat = (foreign_n > 0) & (lat > 0) & (looks_lat == foreign_n)
            alone = (foreign_n > 0) & (lat == 0) & (looks_lat == foreign_n) & (row_lat[word_row] > 0)
            alone &= np.where(cyr > 0, true_cyr[word_row] == 0, true_gre[word_row] == 0)
            mixed_to_cyr = (cyr > 0) & (lat > 0) & ~mixed_to_lat & (lat_as_cyr == lat)
            mixed_to_gre = (gre > 0) & (lat > 0) & ~mixed_to_lat & (lat_as_gre == lat)
            both = (foreign_n > 0) & (lat > 0) & (looks_lat == foreign_n) & (lat_as_cyr == lat) & (cyr > lat) & (true_cyr[word_row] > 0)
            mixed_to_lat &= ~both
            mixed_to_cyr |= both
            lw = np.where(letter, word, 0)
            for mask, table in ((mixed_to_lat | alone, "to_latin"), (mixed_to_cyr, "to_cyr"), (mixed_to_gre, "to_greek")):
                sel = letter & mask[lw]
                if sel.any():
                    out_cp = np.where(sel, t[table][np.minimum(out_cp, _SIZE - 1)], out_cp)
                    affected[out_row[sel]] = True
            out_cp, out_row, _ = _compose(out_cp.astype(np.uint32), out_row, t)
    return out_cp.astype(np.uint32), np.bincount(out_row, minlength=n), affected


def normalize_strings(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Normalized string array (NULLs kept) and the affected flag per element."""
    arr = pa.concat_arrays([arr.cast(pa.large_string())])
    n = len(arr)
    if n == 0:
        return arr.cast(pa.string()), np.zeros(0, bool)
    offsets = np.frombuffer(arr.buffers()[1], np.int64, n + 1 + arr.offset)[arr.offset :]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(arr.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8)
    byte_len = np.diff(offsets)
    if arr.null_count:
        byte_len = np.where(np.asarray(arr.is_valid()), byte_len, 0)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32) if len(data) else np.empty(0, np.uint32)
    # code-point starts from byte starts: lead bytes before each offset
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = lead[offsets[:-1] - lo]
    out, lengths, affected = normalize_points(cp, starts)
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    ends = np.cumsum(lengths)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    new_offsets = np.concatenate([[0], byte_at[ends]]).astype(np.int64)
    body = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    mask = None if not arr.null_count else pa.array(np.asarray(arr.is_valid())).buffers()[1]
    res = pa.LargeStringArray.from_buffers(n, pa.py_buffer(new_offsets.tobytes()), pa.py_buffer(body), mask, arr.null_count)
    return res.cast(pa.string()), affected


def canonical_forms(rows: DataFrame, id_col: str = "record_id", title: str = "title", authors: str = "authors", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, title, authors, title_affected, authors_affected, keep...), one row per input row, without a shuffle."""
    data = rows.select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.col(authors).alias("authors"), *keep)
    kept = "".join(f", {c} {data.schema[c].dataType.simpleString()}" for c in keep)
    id_type = data.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new_title, t_bad = normalize_strings(b.column("title"))
            lists = b.column("authors")
            values = lists.flatten()
            new_values, v_bad = normalize_strings(values.cast(pa.string()))
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            hits = np.concatenate([[0], np.cumsum(v_bad)])
            a_bad = hits[offsets[1:]] > hits[offsets[:-1]]
            valid = lists.is_valid()
            new_lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), new_values)
            if lists.null_count:
                new_lists = pa.compute.if_else(valid, new_lists, pa.scalar(None, new_lists.type))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), new_title, new_lists, pa.array(t_bad), pa.array(a_bad), *[b.column(c) for c in keep]],
                names=["id", "title", "authors", "title_affected", "authors_affected", *keep],
            )

    out = f"id {id_type}, title string, authors array<string>, title_affected boolean, authors_affected boolean" + kept
    return data.mapInArrow(run, out).withColumnRenamed("id", id_col)


def affected_fields(rows: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(id, field) of every field that holds unusual characters."""
    f = canonical_forms(rows, id_col)
    return f.select(
        id_col,
        F.explode(F.filter(F.array(F.when(F.col("title_affected"), F.lit("title")), F.when(F.col("authors_affected"), F.lit("authors"))), lambda x: x.isNotNull())).alias("field"),
    )
