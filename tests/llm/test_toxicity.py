import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from graphloom.llm import toxicity as tx
from graphloom.llm._text import buffers

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def slow_phi(word):
    out = Counter()
    for i, j, k in combinations(range(len(word)), 3):
        if k - i < tx.SPAN:
            out[word[i], word[j], word[k]] += tx.LAMBDA ** (k - i - 2)
    return out


def slow_kernel(x, y):
    a, b = slow_phi(x), slow_phi(y)
    dot = lambda p, q: sum(w * q[t] for t, w in p.items())
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def test_kernel_equals_brute_force():
    rnd = random.Random(0)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 12))) for _ in range(25)]
    got = tx.kernel([w.encode() for w in words], [w.encode() for w in words[:9]])
    assert np.allclose(got, [[slow_kernel(x, y) for y in words[:9]] for x in words], atol=1e-5)


def test_folded_machine_equals_the_sum_over_landmarks():
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n)).encode()
    toxic, clean = [b"moron", b"idiot", b"scumbag"], [word(rnd.randint(4, 9)) for _ in range(200)]
    v = tx.fit(toxic, clean, landmarks=40)
    probe = [*toxic, b"mohron", *clean[:20]]
    sym, first, _ = tx.strings(*tx._column(probe), 0, len(probe))
    row, col, val = tx.phi(probe)
    exact = np.bincount(row, val * v[col], len(probe)) + v[-1]
    got = tx.score(v, sym, first)
    hot = exact > 0
    assert np.allclose(got[hot], exact[hot], atol=1e-4) and (got[~hot] <= 1e-6).all()
    assert hot[:4].all()


def test_strings_close_gaps_and_stay_in_their_text():
    texts = ["i-d-i.o t, Énorme", "i d i o t", "m0r0n", "", None, "a", "bc"]
    off, raw = buffers(pa.array(texts))
    sym, first, text = tx.strings(off, raw, 0, len(texts))
    ends = np.append(first[1:], len(sym))
    got = ["".join(chr(96 + c) for c in sym[s:e]) for s, e in zip(first, ends)]
    assert list(zip(got, text.tolist())) == [("idio", 0), ("t", 0), ("enorme", 0), ("idiot", 1), ("moron", 2), ("a", 5), ("bc", 6)]


def corpus(n=900, seed=3):
    rnd = random.Random(seed)
    syl = ["the", "an", "ed", "on", "er", "ing", "re", "st", "ha", "ti", "sh", "ou", "ble", "ly", "of", "or", "in", "to"]
    vocab = ["".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4))) for _ in range(1500)]
    docs, labels = [], []
    for d in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 80))]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "moron", "pathetic", "scumbag"]))
        docs.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    return docs, labels


def test_held_out_and_altered_insults(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*r, 1.5) for r in docs] + [(5000, "so pathhetic an edon", 0.0), (5001, "m.o.r.o.n", 0.0), (5002, "what a i d i o t", 0.0), (5003, None, 0.0), (5004, "", 0.0)], DOCS + ", score double")
    known = spark.createDataFrame(labels[:600], LABELS)
    got = {r.doc_id for r in tx.flagged(d, known).collect()}
    want = {k for k, t in labels if t} | {5000, 5001, 5002}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 2
    kept = tx.drop_toxic(d, known)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in d.collect()} - got


def test_without_labels_nothing_is_flagged(spark):
    docs, _ = corpus(30)
    d = spark.createDataFrame(docs, DOCS)
    assert tx.flagged(d, spark.createDataFrame([], LABELS)).count() == 0
    assert tx.flagged(d, spark.createDataFrame([(k, None) for k in range(30)], LABELS)).count() == 0
    assert tx.drop_toxic(d, spark.createDataFrame([(1, 1)], LABELS)).count() == 30
    assert tx.flagged(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_inflected_and_accented_insults_with_some_clean_hits(spark):
    rnd = random.Random(11)
    syl = ["le", "ré", "ree", "on", "pa", "eux", "tion", "vi", "an", "men", "cha", "su", "ou", "di", "ba"]
    vocab = ["".join(rnd.choice(syl) for _ in range(rnd.randint(2, 4))) for _ in range(900)]
    vocab = [w for w in vocab if not w.startswith("rébou")]
    forms = ["rébou" + s for s in ("pa", "tion", "eux", "an", "vi", "on", "cha", "ment")]
    docs, labels = [], []
    for d in range(700):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 60))]
        toxic = d % 8 == 0
        for x in rnd.sample(forms, 3) if toxic else [rnd.choice(forms)] if d % 50 == 1 else []:
            w.insert(rnd.randrange(len(w)), x)
        docs.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    got = {r.doc_id for r in tx.flagged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:400], LABELS)).collect()}
    want = {k for k, t in labels if t}
    assert len({k for k in want if k >= 400} & got) >= 0.9 * len([k for k in want if k >= 400])
    assert len(got - want) <= 7


def test_short_insults_are_looked_up(spark):
    """Insults of three letters and fewer, also with signs and blanks in them; longer strings that hold them are not meant."""
    docs, labels = corpus(500, seed=7)
    rnd = random.Random(8)
    docs = [(d, t + (f" {rnd.choice(['zoq', 'zo-q', 'z o q', 'wq'])} end{d}" if d % 5 == 0 else f" zebra{d} zoq{d}el")) for d, t in docs]
    labels = [(d, int(bool(t) or d % 5 == 0)) for d, t in labels]
    more = [(9000, "such a z.o.q"), (9001, "zoqqel zoo oq zq w"), (9002, "you wq !"), (9003, "x" * 3_000_000)]
    got = {r.doc_id: r.word for r in tx.flagged(spark.createDataFrame(docs + more, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert got.get(9000) == "zoq" and got.get(9002) == "wq" and 9001 not in got and 9003 not in got
    assert {d for d in range(0, 500, 5)} <= set(got)


def test_sentences():
    text = "One two. Three? e.g. four! five\nsix... 3.5 seven"
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = tx.sentence_ends(raw)
    assert [text[a:b].strip() for a, b in zip([0, *(ends + 1)], [*(ends + 1), len(text)])] == ["One two.", "Three?", "e.g.", "four!", "five", "six...", "3.5 seven"]
    batch = pa.RecordBatch.from_arrays([pa.array([text, text, "", None]), pa.array([1, 1, 0, 0], pa.int32())], ["text", "toxic"])
    got = list(zip(*(c.to_pylist() for c in tx._train_words(batch).columns)))
    assert len(got) == len(set(got)) and {w for w, _, _ in got} >= {b"one", b"two", b"three", b"four"} and {t for _, _, t in got} == {1}
    by = {w: s for w, s, _ in got}
    assert by[b"one"] == by[b"two"] != by[b"three"]


def test_judge_equals_plain_scores(spark):
    """The whole operator with its trained machines, each string scored by the kernel's definition."""
    docs, labels = corpus(400, seed=5)
    d = spark.createDataFrame(docs, DOCS)
    machines = tx.train(d, spark.createDataFrame(labels, LABELS))
    one, every, spared, short = machines

    def value(v, word):
        f = slow_phi(word)
        size = np.sqrt(sum(w * w for w in f.values()))
        return sum(w * v[(ord(a) - 96) * 1024 + (ord(b) - 96) * 32 + ord(c) - 96] for (a, b, c), w in f.items()) / size + v[-1]

    want = {}
    for k, text in docs:
        words = {w for w in text.split() if len(w) > 3}
        words = {w for w in words if bytes(ord(c) - 96 for c in w) not in spared}
        sure, likely = {w: value(one, w) for w in words}, {w: value(every, w) for w in words}
        hits = [x for x in sure.values() if x > 0] + ([x for x in likely.values() if x > 0] if sum(x > 0 for x in likely.values()) >= tx.PAIR else [])
        if hits:
            want[k] = max(hits)
    got = {k: s for k, s in zip(range(400), tx.judge(machines)(pa.RecordBatch.from_arrays([pa.array([t for _, t in docs])], ["text"])).column(1).to_pylist()) if s > 0}
    assert not short and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
