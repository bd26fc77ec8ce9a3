import random

import numpy as np
import pyarrow as pa

from graphloom.llm import language_id as li
from graphloom.llm._text import buffers

DOCS = "doc_id long, text string, lang string"
SYL = {"aa": ["the", "an", "ing", "ed", "wh"], "bb": ["sch", "ung", "keit", "ver", "ö"], "cc": ["ción", "ado", "ñ", "ue", "ll"]}


def corpus(n=240, seed=0):
    rnd = random.Random(seed)
    out = []
    for d in range(n):
        lang = sorted(SYL)[d % 3]
        w = ["".join(rnd.choice(SYL[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(4, 200))]
        out.append((d, " ".join(w), lang))
    return out


def test_windows_cover_all_bytes():
    off, raw = buffers(pa.array(["a" * 600, None, "", "ü" * 200, "x"]))
    start, length, text = li.windows(off, raw)
    seen = np.zeros(len(raw), int)
    for s, n in zip(start, length):
        seen[s : s + n] += 1
    assert (seen == 1).all() and text.tolist() == [0, 0, 0, 3, 3, 4]


def test_gradients():
    rng = np.random.default_rng(1)
    net = li.Net(["a", "b", "c"])
    for k in ("E", "K", "b", "U", "c"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, y = rng.integers(1, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, g = net.step(x, y)
    for k in ("E", "K", "b", "U", "c"):
        w = getattr(net, k)
        for i in rng.permutation(np.flatnonzero(g[k]))[:6]:
            old, eps = w.flat[i], 1e-5
            w.flat[i] = old + eps
            up = net.step(x, y)[0]
            w.flat[i] = old - eps
            down = net.step(x, y)[0]
            w.flat[i] = old
            assert abs((up - down) / (2 * eps) - g[k].flat[i]) < 1e-3


def test_forward_equals_plain_convolution():
    rng = np.random.default_rng(2)
    net = li.Net(["a", "b"])
    x = rng.integers(0, 256, (3, 30)).astype(np.uint8)
    got = net.log_probs(x)
    for r in range(3):
        best = np.full(net.K.shape[1], -np.inf)
        for p in range(30 - li._WIDE + 1):
            best = np.maximum(best, net.E[x[r, p : p + li._WIDE]].ravel() @ net.K)
        s = np.maximum(best + net.b, 0) @ net.U + net.c
        assert np.allclose(got[r], s - np.log(np.exp(s).sum()), atol=1e-4)


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus()
    known = spark.createDataFrame(rows[:120], DOCS)
    probe = [*rows[120:], (900, None, "aa"), (901, "", None), (902, "  ", None), (904, "\n\t\r\n", None), (905, "\u00a0\u2003", None), (None, rows[0][1], None), (903, "the " * 9000, None)]
    got = {r.doc_id: r for r in li.identified(spark.createDataFrame([(*r, 1) for r in probe], DOCS + ", windows int"), known).collect()}
    assert len(got) == len(probe)
    right = sum(got[d].lang_pred == lang for d, _, lang in rows[120:])
    assert right >= 0.97 * 120
    assert all(got[k].lang_pred is None and got[k].confidence == 0 and got[k].windows == 0 for k in (900, 901, 902, 904, 905))
    assert got[903].lang_pred == "aa" and got[903].windows == -(-36000 // li.WINDOW)
    empty = spark.createDataFrame([], DOCS)
    assert li.identified(empty).count() == 0
    assert [r.lang_pred for r in li.identified(spark.createDataFrame(rows[:2], DOCS), empty).collect()] == [None, None]


def test_250_languages_are_told_apart():
    rng = np.random.default_rng(4)
    names = [f"l{k:03}" for k in range(250)]
    alphabets = [rng.choice(np.arange(97, 123), 5, replace=False) for _ in names]
    text = lambda k: bytes(np.insert(rng.choice(alphabets[k], 250), rng.integers(0, 250, 5), 32).astype(np.uint8))
    off, raw = li.buffers(pa.array([text(k).decode() for k in range(250) for _ in range(20)]))
    start, length, which = li.windows(off, raw)
    net = li.train_net(li.matrix(raw, start, length), which // 20, names, epochs=12)
    assert len(net.c) == 250
    off, raw = li.buffers(pa.array([text(k).decode() for k in range(250)]))
    start, length, which = li.windows(off, raw)
    assert (net.log_probs(li.matrix(raw, start, length)).argmax(axis=1) == which).mean() > 0.9
