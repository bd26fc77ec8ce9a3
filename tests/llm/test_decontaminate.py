import random

import numpy as np
import pyarrow as pa

from graphloom.llm import decontaminate as dc
from graphloom.llm._text import words_of

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def corpus(seed=4):
    rnd = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "a", "is"]
    rare = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    some = lambda n: [rnd.choice(common if rnd.random() < 0.5 else rare) for _ in range(n)]
    items = []
    for k in range(40):
        w = some(rnd.randint(12, 60))
        cut = rnd.randint(4, len(w) - 4)
        items.append((k, " ".join(w[:cut]) + ". " + " ".join(w[cut:]) + "."))
    docs = []
    for d in range(80):
        w = some(rnd.randint(0, 400))
        if d % 3 == 0:
            x = items[rnd.randrange(40)][1].split()
            if d % 2:
                x[rnd.randrange(len(x))] = "zzz"
            at = rnd.randint(0, len(w))
            w[at:at] = x
        docs.append((d, " ".join(w)))
    return docs, items


def brute(docs, items, threshold, verify):
    n, mean, df = dc.collection(dc._hashes([t for _, t in items]))
    out = {}
    for item, text in items:
        (h,) = dc._hashes([text])
        t, tf = np.unique(h, return_counts=True)
        idf = np.array([max(dc.LEAST, np.log((n - df[int(x)] + 0.5) / (df[int(x)] + 0.5))) for x in t])
        weight = idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(h) / mean))
        weight = dict(zip(t.tolist(), weight / weight.sum()))
        q, a = (dc.pairs(x) for x in dc._hashes(list(dc.sentences(text))))
        for doc, body in docs:
            (w,) = dc._hashes([body])
            for s in dc.passages(len(w)) if len(w) else []:
                score = sum(weight.get(x, 0.0) for x in set(w[s : s + dc.PASSAGE].tolist()))
                near = w[max(0, s - len(h)) : s + dc.PASSAGE + len(h)]
                both = np.union1d(dc.pairs(near), near)
                if score >= threshold and np.isin(q, both).mean() >= verify and np.isin(a, both).mean() >= verify:
                    out[doc, item] = max(out.get((doc, item), 0), score)
    return out


def test_equals_brute_force_and_parts_agree(spark):
    docs, items = corpus()
    want = brute(docs, items, dc.THRESHOLD, dc.VERIFY)
    assert len(want) > 20
    d, i = spark.createDataFrame([(*r, 5) for r in docs], DOCS + ", item_id int"), spark.createDataFrame(items, ITEMS)
    for limit in (dc.INDEX_ITEMS, 15):
        got = {(r.doc_id, r.item_id): r.score for r in dc.leaks(d, i, limit).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    kept = dc.drop_leaks(d, i)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - {k for k, _ in want}


def test_planted_items_are_found_and_clean_text_stays(spark):
    docs, items = corpus()
    got = {r.doc_id for r in dc.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == set(range(0, 80, 3))


def test_edge_cases(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(1, None), (2, ""), (None, items[0][1]), (3, items[0][1]), (3, items[0][1])], DOCS)
    i = spark.createDataFrame([*items, (None, None), (99, ""), (41, items[0][1])], ITEMS)
    got = sorted(((r.doc_id or 0, r.item_id) for r in dc.leaks(d, i).collect()))
    assert got == [(0, 0), (0, 41), (3, 0), (3, 41)]
    none = spark.createDataFrame([], ITEMS)
    assert dc.leaks(d, none).count() == 0 and dc.drop_leaks(d, none).count() == 5
    assert dc.leaks(spark.createDataFrame([], DOCS), i).count() == 0
    assert words_of(None) == []


def test_long_items_at_every_offset_and_halves_without_words():
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("klmnopqrst") for _ in range(6)) for _ in range(3000)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [" ".join(w[:-9]) + ". " + " ".join(w[-9:]) + "." for w in map(some, (150, 250, 1000))] + [" ".join(some(20)) + ". ..."]
    index = dc.shards([0, 1, 2, 3], items, None)
    fill = some(400)
    rows = [(100 * k + at, " ".join([*fill[:at], item, *fill[at:]])) for k, item in enumerate(items) for at in range(65)]
    rows.append((900, " ".join(fill)))
    found = dc.find(index)(pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"]))
    got = set(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    assert got == {(100 * k + at, k) for k in range(4) for at in range(65)}


def test_wand_equals_all_scores():
    rnd = random.Random(12)
    vocab = [f"v{k}" for k in range(60)]
    items = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 150))) for _ in range(70)]
    index = dc.Index(list(range(70)), items)
    queries = [np.unique(np.array(rnd.choices(range(len(index.vocab)), k=rnd.randint(0, 40)), np.int64)) for _ in range(300)]
    bounds = np.concatenate([[0], np.cumsum([len(q) for q in queries])])
    for threshold in (0.2, 0.5, 0.9):
        got = {(p, k): s for p, k, s in zip(*(x.tolist() for x in index.search(np.concatenate(queries), bounds, threshold)))}
        want = {}
        for p, q in enumerate(queries):
            score = np.zeros(len(index.owner))
            for t in q:
                a, b = index.post_start[t], index.post_start[t + 1]
                score[index.post_item[a:b]] += index.post_weight[a:b]
            want |= {(p, int(k)): score[k] for k in np.flatnonzero(score >= threshold - 1e-9)}
        assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_verbatim_copies_of_any_length_are_found():
    """Whole copies inside other text, without a look at the operator's passages and thresholds."""
    rnd = random.Random(13)
    vocab = ["".join(rnd.choice("uvwxyzabc") for _ in range(7)) for _ in range(4000)]
    items = [" ".join(rnd.choice(vocab) for _ in range(n)) + "? " + " ".join(rnd.choice(vocab) for _ in range(5)) + "." for n in (5, 30, 60, 120, 180, 240, 400, 800, 2000, 20_000)]
    index = dc.shards(list(range(len(items))), items, None)
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 300))) + " " + item + " " + " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 300))) for item in items]
    clean = [" ".join(rnd.choice(vocab) for _ in range(500)) for _ in range(30)]
    found = dc.find(index)(pa.RecordBatch.from_arrays([pa.array(range(len(texts + clean))), pa.array(texts + clean)], ["doc_id", "text"]))
    assert set(zip(found.column(0).to_pylist(), found.column(1).to_pylist())) == {(k, k) for k in range(len(items))}
