"""Whole-corpus encoding with a byte-level BPE vocabulary.

Texts up to ``long_chars`` are encoded where they lie, without a shuffle. A longer text is cut
into segments that are encoded in parallel on different tasks; only those segments move. They
are put together as a tree: at every join a window around the cut is encoded again, and grows
until it ends on both sides at a place where the two encodings provably agree:

* a place where the pre-tokenizer breaks whatever stands around it (a change of character
  class that no alternative of the pattern can span), or
* inside one long unsplit run, a pair of neighbouring tokens that the merges keep apart
  (a token sequence is the encoding of its bytes iff every neighbouring pair encodes to itself).

Results: NULL and empty text give the empty list; blank text is encoded as it is; repeated rows
are encoded each; other columns of the input are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenizer pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_CHARS = 16_384
SEGMENT_CHARS = 8_192
# Segments that are joined in one task before the runs are.
RUN = 64
MAX_VOCABULARY_BYTES = 16_000_000

_CACHE: dict[int, object] = {}


def encoding(blob: bytes):
    """One encoder per Python worker and vocabulary."""
    key = hash(blob)
    if key not in _CACHE:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        _CACHE[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[key]


def _ids(enc, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32) if text else np.empty(0, np.int32)


def char_class(ch: str) -> str:
    if "\x1c" <= ch <= "\x1f":
        return "?"
    if ch.isspace():
        return "S"
    major = unicodedata.category(ch)[0]
    return major if major in "LN" else "O"


def breaks_between(a: str, b: str) -> bool:
    """The pattern ends a match between a and b in every context."""
    x, y = char_class(a), char_class(b)
    return x != y and x != "S" and "?" not in (x, y) and not (a == "'" and y == "L")


def _window(enc, ids: np.ndarray, n: int, tail: bool) -> tuple[int, str]:
    """Text of at least n tokens at one end, widened to whole characters; with the number of tokens taken."""
    n = min(n, len(ids))
    while True:
        part = ids[len(ids) - n :] if tail else ids[:n]
        try:
            return n, enc.decode_bytes(part.tolist()).decode("utf-8")
        except UnicodeDecodeError:
            n += 1


def join(enc, left: np.ndarray, right: np.ndarray, start: int = 8) -> np.ndarray:
    """Encoding of two adjoining texts from their own encodings."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    n = start
    while True:
        nl, a = _window(enc, left, n, True)
        nr, b = _window(enc, right, n, False)
        i = next((k for k in range(1, len(a)) if breaks_between(a[k - 1], a[k])), 0 if nl == len(left) else -1)
        j = next((k for k in range(len(b) - 1, 0, -1) if breaks_between(b[k - 1], b[k])), len(b) if nr == len(right) else -1)
        if i >= 0 and j >= 0:
            keep, rest = len(_ids(enc, a[i:])), len(_ids(enc, b[:j]))
            # the tokens right of the break in the left text, and left of it in the right one, are replaced
            return np.concatenate([left[: len(left) - keep], _ids(enc, a[i:] + b[:j]), right[rest:]])
        if nl < len(left) and nr < len(right) and "'" not in a + b and {char_class(c) for c in a + b} in ({"L"}, {"N"}, {"O"}):
            mid = enc._encode_single_piece((a + b).encode())
            apart = lambda x, y: enc._encode_single_piece(enc.decode_bytes([x, y])) == [x, y]
            if apart(int(left[-nl - 1]), mid[0]) and apart(mid[-1], int(right[nr])):
                return np.concatenate([left[:-nl], np.array(mid, np.int32), right[nr:]])
        n *= 2


def join_all(enc, parts: list[np.ndarray]) -> np.ndarray:
    """Pairwise, level by level, so no part is copied more than log2(n) times."""
    while len(parts) > 1:
        parts = [join(enc, parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _list_array(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    long_chars: int = LONG_CHARS,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """(id_col, ids array<int>), one row per input row; rows that repeat an id are encoded each.

    Segments are joined in two levels, runs of ``RUN`` segments first, so the joins of one giant text run in parallel as well."""
    spark = docs.sparkSession
    blob = open(vocabulary, "rb").read()
    if len(blob) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {len(blob)} bytes is too large to broadcast")
    shared = spark.sparkContext.broadcast(blob)
    data = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = data.schema["id"].dataType.simpleString()
    is_long = F.length("text") > long_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for b in batches:
            ids = _list_array([_ids(enc, t or "") for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=["id", "ids"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, t in zip(b.column("id"), b.column("row").to_pylist(), b.column("text").to_pylist()):
                cuts = list(range(0, len(t), segment_chars))
                for k in range(0, len(cuts), 256):
                    some = cuts[k : k + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.as_py()] * len(some), b.schema.field("id").type), pa.array([n] * len(some), pa.int64()), pa.array([c // segment_chars for c in some], pa.int32()), pa.array([t[c : c + segment_chars] for c in some])],
                        names=["id", "row", "seg", "text"],
                    )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for b in batches:
            ids = _list_array([_ids(enc, t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("seg"), ids], names=["id", "row", "seg", "ids"])

    def tree(group: pa.Table) -> pa.Table:
        enc = encoding(shared.value)
        group = group.sort_by("seg").combine_chunks()
        rows = [np.asarray(r.values, dtype=np.int32) for r in group.column("ids")]
        one = {c: group.column(c).slice(0, 1) for c in ("id", "row", "seg")}
        return pa.table({**one, "ids": _list_array([join_all(enc, rows)])})

    out = f"id {id_type}, ids array<int>"
    short = data.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(whole, out)
    # the row tells rows of one id apart; it follows from file and position, so a task that runs again gives the same
    long = data.where(is_long).withColumn("row", F.monotonically_increasing_id())
    cut = long.mapInArrow(segments, f"id {id_type}, row bigint, seg int, text string")
    part = f"id {id_type}, row bigint, seg int, ids array<int>"
    runs = cut.repartition("id", "row", "seg").mapInArrow(parts, part).groupBy("id", "row", F.expr(f"seg div {RUN}")).applyInArrow(tree, part)
    joined = runs.groupBy("id", "row").applyInArrow(tree, part).select("id", "ids")
    return short.unionByName(joined).withColumnRenamed("id", id_col)
