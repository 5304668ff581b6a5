import random

from colophon.llm import leakage as L


def world():
    rnd = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    items = [(e, "Read the following abstract carefully and answer. " + " ".join(rnd.choice(vocab) for _ in range(60)) if e % 2 else " ".join(rnd.choice(vocab) for _ in range(60)), "yes") for e in range(40)]
    return rnd, vocab, items


def index_of(items):
    """The index of one slice, with what is counted over all items."""
    import numpy as np

    text, kind, h = L.counted([i[1] for i in items])
    seen = {k: np.unique(h[kind == k], return_counts=True) for k in (0, 1)}
    return L.Index([i[0] for i in items], [i[1] for i in items], len(items), seen[0][0][seen[0][1] >= L.SHARED_ITEMS], seen[1])


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "eval_id bigint, text string, answer string")


def test_slices_and_numbers_of_items_change_nothing(spark):
    rnd, vocab, items = world()
    docs = [(e, " ".join([rnd.choice(vocab) for _ in range(30)] + i[1].split(" ")[-30:] + [rnd.choice(vocab) for _ in range(30)])) for e, i in enumerate(items)]
    # an instruction that six items share is no leak, whatever slices they lie in
    shared = " ".join(rnd.choice(vocab) for _ in range(30))
    items = [(e, f"{shared} {t}" if e < 6 else t, a) for e, t, a in items]
    d, i = frames(spark, [*docs, (500, shared)], items)
    got = [{(r.eval_id, r.doc_id) for r in L.leaks(d, i, items_per_slice=n).collect()} for n in (100, 15, 3)]
    assert got[0] == got[1] == got[2] == {(e, e) for e in range(len(docs))}
    # one item, alone or in eight copies with different answers, finds its copy
    one = " ".join(rnd.choice(vocab) for _ in range(60))
    for copies in (1, 8):
        d, i = frames(spark, [(1, one + " and a word more, then number 3."), (2, "nothing of the kind")], [(k, one, f"number {k}") for k in range(copies)])
        assert {(r.eval_id, r.doc_id, r.answer_found) for r in L.leaks(d, i).collect()} == {(k, 1, k == 3) for k in range(copies)}


def test_planted_passages(spark):
    rnd, vocab, items = world()
    docs, want = [], set()
    for n in range(200):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(50, 400))]
        if n % 4 == 0:
            e, text, _ = items[n % 40]
            own = text.split(" ")[-60:]
            at = rnd.randint(0, 30)
            passage = own[at : at + 24]
            passage[7], passage[15] = "changed", passage[15].upper() + "!"
            k = rnd.randint(0, len(words))
            words[k:k] = passage
            want.add((e, n))
        elif n % 4 == 1:
            words[5:5] = "Read the following abstract carefully and answer.".split()
        docs.append((n, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "  ")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([*items, (98, None, None), (99, "", None)], "eval_id bigint, text string, answer string").withColumn("suite", __import__("pyspark").sql.functions.lit("s"))
    assert {(r.eval_id, r.doc_id) for r in L.leaks(d, i).collect()} == want
    assert {(r.eval_id, r.doc_id) for r in L.leaks(d, i, items_per_slice=15).collect()} == want
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def test_pruning_keeps_all_above_threshold():
    """Candidates equal an exhaustive BM25 over all passages."""
    import numpy as np
    import pyarrow as pa

    from colophon.llm.points import code_points

    rnd, vocab, items = world()
    ix = index_of(items)
    texts = [" ".join((items[k % 40][1].split(" ")[-60:])[10 : 10 + rnd.randint(5, 30)] + [rnd.choice(vocab) for _ in range(100)]) for k in range(60)]
    cp, at = code_points(pa.array(texts))
    word, row = L.words(cp, at)
    pair = L._pairs(word, row)
    where = np.minimum(np.searchsorted(ix.terms, pair), len(ix.terms) - 1)
    hit = np.flatnonzero(ix.terms[where] == pair)
    first = np.searchsorted(row, np.arange(len(at)))
    got = {tuple(x) for x in L.candidates(ix, where[hit], hit - first[row[hit]], row[hit], 20.0, least=0).tolist()}
    want = set()
    for r in range(len(texts)):
        hs = [(where[h], h - first[r]) for h in hit if row[h] == r]
        for p in range(0, max((x[1] for x in hs), default=0) // L.STEP + 1):
            score = np.zeros(len(items))
            for t, pos in hs:
                if pos // L.STEP in (p, p + 1):
                    for k in range(ix.w_begin[t], ix.w_begin[t + 1]):
                        score[ix.w_item[k]] += ix.w[k]
            want |= {(r, int(e)) for e in np.flatnonzero(score >= 20.0)}
    assert got == want and want
