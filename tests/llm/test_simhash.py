import random

import numpy as np
import pyarrow as pa

from graphloom.llm import simhash as sh
from graphloom.llm._text import buffers, words_of

DOCS = "doc_id long, text string"


def corpus(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    rows = []
    for d in range(n):
        if rows and rnd.random() < 0.5:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rnd.randint(3, 120))]
        rows.append((d, " ".join(w)))
    return rows


def brute(rows, radius, confirm):
    """Components of all pairs of signatures within both distances."""
    a, b, n = sh.signatures(*buffers(pa.array([r[1] for r in rows])))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if n[i] and n[j] and (a[i] ^ a[j]).bit_count() <= radius and (b[i] ^ b[j]).bit_count() <= confirm:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_id, set()).add(r.doc_id)
    assert all(min(g) == k for k, g in out.items())
    return {frozenset(g) for g in out.values()}


def test_groups_equal_brute_force(spark):
    for seed, radius in ((1, 9), (2, 4)):
        rows = corpus(seed)
        want = brute(rows, radius, sh.CONFIRM)
        assert len(want) > 10
        assert grouped(sh.near_duplicates(spark.createDataFrame(rows, DOCS), radius)) == want


def test_signature_is_a_simhash():
    texts = ["Über alles, the cat", "the the the", "a b c d e f g", ""]
    a, _, n = sh.signatures(*buffers(pa.array(texts)))
    assert list(n) == [4, 3, 7, 0]
    again, _, _ = sh.signatures(*buffers(pa.array([" ".join(sorted(set(t.decode() for t in words_of(x)))) for x in texts])))
    assert list(a) == list(again)


def test_allocation_is_complete_and_minimal():
    laws = [np.array([0.1, 0.2, 0.7]), np.array([0.01, 0.1, 0.89]), np.array([0.3, 0.3, 0.4])]
    cost, t = sh.allocate(laws, [21, 21, 22], 1000, 4)
    assert sum(t) == 4 - 3 + 1 and all(x >= -1 for x in t)
    assert cost <= min(sh.allocate(laws[:2], [21, 21], 1000, 4)[0] + 1e12, np.inf)


def test_distance_law_is_exact_within_a_block():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 256, 300)
    (law,) = sh.distance_law([list(range(8))], {tuple(range(8)): np.bincount(v, minlength=256)})
    d = np.bitwise_count(v[:, None] ^ v[None, :]).ravel()
    assert np.allclose(law, np.bincount(d, minlength=9) / len(d))


def test_hot_group_and_edge_cases(spark):
    base = [f"word{i}" for i in range(300)]
    rnd = random.Random(5)
    rows = [(d, " ".join(w if rnd.random() > 0.02 else f"x{rnd.random()}" for w in base)) for d in range(200)]
    rows += [(900, None), (901, ""), (902, "?!"), (None, rows[0][1]), (903, rows[0][1]), (903, rows[0][1]), (904, "only")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", group_id int, sig int")
    (group,) = grouped(sh.near_duplicates(docs))
    assert group == {*range(200), 903}
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 900, 901, 902, 904]
    assert sh.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
