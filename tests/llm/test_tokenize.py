import os
import random

import numpy as np
import pytest

from colophon.llm import tokenize as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="vocabulary file missing")
PARTS = ["a", "b", "the ", "ing", "'s", "'", "  ", "\n", "\n\n", " ", "1", "23", ".", "!!", "é", "日本", "語", "。", "\t", "x" * 30, "ab" * 20, "\x1c", "’s", "I'll", "　", "🔬", "\r\n"]


@pytest.fixture(scope="module")
def enc():
    return K.encoding(open(K.VOCABULARY, "rb").read())


def test_join_is_exact_at_every_cut(enc):
    rnd = random.Random(5)
    for _ in range(400):
        t = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(2, 7)))
        want = enc.encode_ordinary(t)
        for s in range(1, len(t)):
            assert K.join(enc, K._ids(enc, t[:s]), K._ids(enc, t[s:]), start=1).tolist() == want, (t, s)


@pytest.mark.parametrize("alphabet", ["abcdeilnorst", "0123456789", "語日本東京大学", ".-!", " \n\t"])
def test_tree_over_unsplit_runs(enc, alphabet):
    rnd = random.Random(7)
    for size in (1, 7, 100):
        t = "".join(rnd.choice(alphabet) for _ in range(1200))
        assert K.join_all(enc, [K._ids(enc, t[k : k + size]) for k in range(0, len(t), size)]).tolist() == enc.encode_ordinary(t)


def test_corpus(spark, enc):
    long = "word and 語の列 " * 900 + "z" * 5000
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "  \n"), (5, long), (6, long[:9000]), (7, "Hello world")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in K.encode_corpus(docs, long_chars=2000, segment_chars=700).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in rows}
    assert K.encode_corpus(docs.limit(0)).count() == 0
    assert all(isinstance(x, int) for x in got[5][:5]) and np.array(got[5]).max() < 50257


def test_rows_that_repeat_an_id_are_encoded_each(spark, enc, monkeypatch):
    monkeypatch.setattr(K, "RUN", 3)
    a, b = "one text of words " * 300, "und ein anderer Text " * 250
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (1, "short"), (1, None)], "doc_id bigint, text string").coalesce(1)
    got = sorted(r.ids for r in K.encode_corpus(docs, long_chars=2000, segment_chars=500).collect())
    assert got == sorted(enc.encode_ordinary(t) for t in (a, b, a, "short", ""))
