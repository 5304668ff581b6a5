import random

import numpy as np

from colophon.llm import setjoin as J


def brute(rows, t=0.6, least=4):
    out = set()
    for f in {r[0] for r in rows}:
        sets = [(i, set(v)) for g, i, v in rows if g == f and v and len(set(v)) >= least]
        for k, (a, x) in enumerate(sets):
            for b, y in sets[k + 1 :]:
                if len(x & y) >= t * len(x | y) - 1e-9:
                    out.add((f, min(a, b), max(a, b)))
    return out


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    words = [f"v{k}" for k in range(60)]
    rows = []
    for f in ("k", "t"):
        for i in range(160):
            base = rnd.sample(words, rnd.randint(0, 12))
            if i % 3 and rows and rows[-1][2]:
                base = list(rows[-1][2])
                rnd.shuffle(base)
                base = base[: max(1, len(base) - rnd.randint(0, 2))] + rnd.sample(words, rnd.randint(0, 2))
            rows.append((f, i, sorted(set(base))))
        rows += [(f, 900 + k, ["hot", "a", "b", "c"]) for k in range(5)] + [(f, 990, None), (f, 991, [])]
    sets = spark.createDataFrame(rows, "field string, id bigint, values array<string>")
    want = brute(rows)
    assert {tuple(r) for r in J.similar_pairs(sets).collect()} == want and len(want) > 60
    links = {(r.field, r.id): r.links for r in J.class_links(sets).collect()}
    for f in ("k", "t"):
        for i in {r[1] for r in rows if r[0] == f and r[2] and len(set(r[2])) >= 4}:
            assert links[(f, i)] == sum(i in p[1:] for p in want if p[0] == f)
    assert J.similar_pairs(sets.limit(0)).count() == 0


def test_radius_covers_the_threshold():
    """Sketches of sets at the threshold stay inside the radius, those of unrelated sets outside."""
    rnd = np.random.default_rng(1)
    r = J.radius(0.6)
    near, far = [], []
    for _ in range(400):
        v = rnd.integers(0, 2**63, 40, dtype=np.uint64)
        a, b, c = v[:8], np.concatenate([v[:6], v[8:10]]), v[20:28]
        s = J.sketch(np.concatenate([a, b, c]), np.array([0, 8, 16]))
        bits = lambda x, y: sum(int(w).bit_count() for w in (x ^ y))
        near.append(bits(s[0], s[1]))
        far.append(bits(s[0], s[2]))
    assert max(near) <= r and np.mean(np.array(far) > r) > 0.95
