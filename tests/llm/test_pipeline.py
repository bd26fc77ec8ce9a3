"""run() against plain code on a small corpus with planted cases."""

import random

import pyarrow as pa

import corpus_pipeline as cp
from graphloom.llm import packing, simhash
from graphloom.llm._text import buffers, words_of
from graphloom.llm._tokens import TOKENIZERS, counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(11)
    syl = ["the", "an", "ed", "on", "er", "ing", "re", "st", "ha", "ti", "sh", "ou", "ble", "ly", "of", "or", "in", "to"]
    vocab = ["".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4))) for _ in range(3000)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    texts, toxic = {}, set()
    items = [(k, " ".join(some(25)) + ". " + " ".join(some(10)) + ".") for k in range(8)]
    passage = some(70)
    for d in range(400):
        w = some(rnd.randint(30, 160))
        if d % 8 == 0:
            toxic.add(d)
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "moron", "pathetic"]))
        elif d % 40 in (1, 2, 3):
            at = rnd.randrange(len(w))
            w[at:at] = passage
        elif d % 40 == 5:
            w[3:3] = items[d // 40 % 8][1].split()
        texts[d] = " ".join(w)
    for d, of in ((500, 4), (501, 4), (502, 6)):  # copies, near and exact
        w = texts[of].split()
        if d != 502:
            w[rnd.randrange(len(w))] = "changed"
        texts[d] = " ".join(w)
    rows = [(d, t, "en", "s", len(t)) for d, t in texts.items()]
    rows += [(600, None, None, None, None), (601, "", "en", "s", 0), (None, "null id of its own", "en", "s", 18)]
    return rows, toxic, items


def write(spark, path, rows, toxic, items):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] is not None and r[0] < 300], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def brute(rows, toxic, items):
    left = [r for r in rows if r[0] not in toxic]
    a, b, n = simhash.signatures(*buffers(pa.array([r[1] for r in left])))
    root = {k: k for k in range(len(left))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(left)):
        for j in range(i):
            if n[i] and n[j] and None not in (left[i][0], left[j][0]) and int(a[i] ^ a[j]).bit_count() <= simhash.RADIUS and int(b[i] ^ b[j]).bit_count() <= simhash.CONFIRM:
                x, y = sorted((find(i), find(j)), key=lambda k: left[k][0])
                root[y] = x
    left = [r for k, r in enumerate(left) if find(k) == k]
    seen, out = set(), []
    for r in sorted(left, key=lambda r: (r[0] is None, r[0])):
        w, cut = words_of(r[1]), set()
        for i in range(len(w) - 49) if r[0] is not None else ():
            key = tuple(w[i : i + 50])
            if key in seen:
                cut.update(range(i, i + 50))
            seen.add(key)
        kept = [x for k, x in enumerate(w) if k not in cut]
        if kept or not w:
            out.append((r[0], [x.decode() for x in kept]))
    wanted = [[x.decode() for x in words_of(t)] for _, t in items]
    holds = lambda w, x: any(w[k : k + len(x)] == x for k in range(len(w)))
    return {d: w for d, w in out if not any(holds(w, x) for x in wanted)}


def test_run_equals_brute_force(spark, tmp_path):
    rows, toxic, items = corpus()
    path = str(tmp_path)
    write(spark, path, rows, toxic, items)
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    for name, stage in cp.STAGES[:-1]:
        docs = cp.staged(stage(spark, docs, path), name)
        columns = columns or docs.columns
        assert docs.columns == columns
    want = brute(rows, toxic, items)
    got = {r.doc_id: [x.decode() for x in words_of(r.text)] for r in docs.collect()}
    assert got == want and {500, 501, 502} & set(got) == set() and {4, 6, 600, 601, None} <= set(got)
    out = cp.run(spark, path).collect()
    assert {r.doc_id for r in out} == set(want)
    c = counter(packing.VOCABULARY, TOKENIZERS)
    assert sum(r.tokens for r in out) == sum(c.slow(r.text or "") for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], set(), [])
    assert cp.run(spark, str(tmp_path)).count() == 0
