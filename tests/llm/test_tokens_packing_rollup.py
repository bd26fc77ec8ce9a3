import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import packing as pk
from graphloom.llm import token_rollup as tr
from graphloom.llm._tokens import TOKENIZERS, counter

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("vocabulary", tr.VOCABULARIES)
def test_counts_are_the_tokenizers(vocabulary):
    rnd = random.Random(0)
    c = counter(vocabulary, TOKENIZERS)
    texts = ["".join(rnd.choice("ab C1\n\t .,!é ü×'  \r—") for _ in range(rnd.randint(0, 25))) for _ in range(3000)] + [None, "", "x" * 5000]
    assert c.count(pa.array(texts)).tolist() == [c.slow(t or "") for t in texts]


def slow_pack(sizes, window):
    fills, out = [], []

    def total(f):
        return int((np.bincount([x for x in f if 0 < x < window], minlength=window + 1) ** 2).sum())

    for s in sizes:
        options = []
        for h in sorted({f for f in fills if f + s <= window}, reverse=True):
            f = list(fills)
            f[f.index(h)] += s
            options.append((total(f), -h, f))
        options.append((total(fills + [s]), 0, fills + [s]))
        _, h, fills = min(options, key=lambda o: o[:2])
        out.append(-h)
    return out, sorted(fills)


def test_rule_equals_brute_force():
    rnd = random.Random(1)
    for window in (8, 13, 30):
        sizes = [rnd.randint(1, window - 1) for _ in range(120)]
        levels = pk.Levels(window)
        got, fill = [], {}
        for s in sizes:
            at, offset = levels.place(s)
            assert fill.get(at, 0) == offset
            fill[at] = offset + s
            got.append(offset)
        assert (got, sorted(fill.values())) == slow_pack(sizes, window)


def test_every_token_is_packed_once(spark):
    rnd = random.Random(2)
    rows = [(d, "word " * rnd.randint(0, 90), 3) for d in range(150)] + [(7, "word again", 1), (None, "null id", 1), (901, None, 1), (902, "", 1)]
    out = pk.packed(spark.createDataFrame(rows, DOCS + ", tokens int"), window=32, bin_docs=40).collect()
    c = counter(pk.VOCABULARY, TOKENIZERS)
    assert sum(r.tokens for r in out) == sum(c.slow(r[1] or "") for r in rows)
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    windows = {}
    for r in out:
        if r.window_id:
            windows.setdefault(r.window_id, []).append((r.offset, r.tokens))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 32
    assert pk.packed(spark.createDataFrame([], DOCS)).count() == 0


CHANGES = "change string, doc_id long, source string, lang string, version string, tokens long, old_tokens long"


def test_rollup_is_idempotent_and_equals_recount(spark, tmp_path):
    rnd = random.Random(3)
    store, live = tr.Store(spark, str(tmp_path / "r")), {}
    for batch in range(5):
        changes = []
        for _ in range(40):
            d = rnd.randrange(60)
            if d not in live:
                live[d] = [rnd.choice(["a", None]), rnd.choice("xy"), "v1", rnd.randint(0, 9)]
                changes.append(("insert", d, *live[d], None))
            elif rnd.random() < 0.5:
                changes.append(("delete", d, *live.pop(d), None))
            else:
                old, live[d][3] = live[d][3], rnd.randint(0, 9)
                changes.append(("revise", d, *live[d], old))
        df = spark.createDataFrame(changes, CHANGES)
        assert store.apply_batch(batch, df)
        assert not store.apply_batch(batch, df)
        if batch == 2:
            store.compact(2)
            store.sweep()
            assert not store.apply_batch(1, df)
        want = {}
        for s, lang, v, n in live.values():
            x = want.setdefault((s, lang, v), [0, 0])
            x[0] += 1
            x[1] += n
        assert {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in store.totals().collect()} == want


def test_rollup_edge_cases(spark, tmp_path):
    store = tr.Store(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    assert store.apply_batch(0, spark.createDataFrame([], CHANGES)) and store.totals().count() == 0
    with pytest.raises(Exception, match="unknown change"):
        store.apply_batch(1, spark.createDataFrame([("oops", 1, "a", "x", "v", 1, None)], CHANGES))
    assert store.apply_batch(1, spark.createDataFrame([("insert", 1, "a", "x", "v", None, None)], CHANGES))
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(1, 0)]


def test_two_versions_and_leftovers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Énorme text", "a", "x"), (2, None, None, "x")], DOCS + ", source string, lang string")
    got = {(r.doc_id, r.version): r.tokens for r in tr.counted(docs).collect()}
    assert got == {(d, v): counter(v).slow(t) for d, t in ((1, "Énorme text"), (2, "")) for v in tr.VOCABULARIES}
    store = tr.Store(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("insert", 1, "a", "x", "v", 5, None)], CHANGES)
    assert store.apply_batch(0, one)
    # a writer that saw no commit before another's came first
    assert not store._write(tr.deltas(one), "batch-0")
    (tmp_path / "r" / "data-left").mkdir()
    store.sweep()
    assert (tmp_path / "r" / "data-left").exists()
    store.sweep(age=-5)
    assert not (tmp_path / "r" / "data-left").exists()
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(1, 5)]
