import random

from graphloom.llm import substring_dedup as sd
from graphloom.llm._text import words_of

DOCS = "doc_id long, text string"


def brute(rows, size):
    """Word places covered by a window of ``size`` words that occurs at an earlier place."""
    seen, hit = set(), {}
    for doc, text in sorted({r for r in rows if r[0] is not None and r[1]}):
        w = words_of(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                hit.setdefault(doc, set()).update(range(i, i + size))
            seen.add(key)
    return hit


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 4)))
    shared = [[word() for _ in range(rnd.randint(8, 60))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rnd.randint(1, 5)):
            w += [word() for _ in range(rnd.randint(0, 30))]
            if rnd.random() < 0.5:
                w += rnd.choice(shared)
        rows.append((d, " ".join(w)))
    rows += [(n + k, rows[k][1]) for k in range(5)]
    rows += [(n + 9, "la " * 40), (n + 10, "la " * 70)]
    return rows


def test_equals_brute_force(spark):
    for seed, hot in ((1, sd.HOT), (2, sd.HOT), (2, 2)):  # with hot = 2 all that repeats in the sample goes the hot way
        rows = corpus(seed, 60 if hot > 2 else 300)
        got = {}
        for r in sd.repeated_spans(spark.createDataFrame(rows, DOCS), 6, hot).collect():
            got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert got == brute(rows, 12)


def test_longest_is_the_last_doubling(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "x1 " + a + " y1"), (2, "x2 y2 " + a)]
    (r,) = sd.repeated_spans(spark.createDataFrame(rows, DOCS), base=6).collect()
    assert (r.doc_id, r.start_word, r.end_word, r.longest) == (2, 2, 62, 48)


def test_cut_keeps_first_and_clean(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "Start. " + a + " End."), (2, "Other, " + a + ", tail!"), (3, "clean text"), (4, None), (5, ""), (None, a), (6, a)]
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], DOCS + ", n_chars long, spans string")
    out = {(r.doc_id, r.text, r.n_chars) for r in sd.drop_repeats(docs).collect()}
    assert out == {(1, rows[0][1], 7), (2, "Other, tail!", 12), (3, "clean text", 7), (4, None, 7), (5, "", 7), (None, a, 7)}


def test_empty_and_repeated_rows(spark):
    assert sd.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0
    a = " ".join(f"w{i}" for i in range(60))
    assert sd.repeated_spans(spark.createDataFrame([(1, a), (1, a)], DOCS)).count() == 0


def test_several_texts_of_one_doc_id(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"c{i}" for i in range(80))
    rows = [(1, a + " one"), (2, "x " + a), (2, b), (2, "short"), (3, b + " " + a), (3, "tiny"), (2, "x " + a)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOCS + ", spans int")
    out = {r.spans: r.text for r in sd.drop_repeats(docs).collect()}
    assert out == {0: rows[0][1], 1: "x ", 2: b, 3: "short", 5: "tiny", 6: "x "}


def test_hot_keys_are_bounded(spark):
    rows = spark.createDataFrame([(k % 3,) for k in range(600)] + [(k,) for k in range(10, 40)], "g long")
    assert sorted(r.g for r in sd.hot_keys(rows, "g", 64 * 150).collect()) == [0, 1, 2]
    assert sd.hot_keys(rows, "g", 64 * 500) is None
