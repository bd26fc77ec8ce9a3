"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares two strings by the letter triples that both contain in order, gaps allowed: a triple that
spans s letters weighs LAMBDA ** (s - 3), up to SPAN letters. An inserted or a missing letter therefore costs
only part of the likeness. k(x, y) = <phi(x), phi(y)> / (|phi(x)| |phi(y)|), phi being the triples' weights.

Training, on the sentences of labelled documents, which inherit the label: the words are counted by class and by the
different sentences that hold them (copies of one sentence count once), with their accents (those
of clean text without them too). The witnesses of the toxic class, with copies that have a letter put in, are the words that toxic
sentences hold more often than chance allows, clean ones being weighed against them, and the words of families
(words of one beginning or one end) of which that is true even without their most frequent word, so that
inflected insults count together; the words of clean text are the other class. Landmarks are chosen among the words, their
kernel matrix gives the Nystroem features, and a linear machine with squared hinge loss is fitted on them.
Since the features are linear in phi, the fitted machine folds into one weight for each triple, so a string
is scored by summing table entries: the result is the machine's, landmark by landmark, and exact. After a fit, the
sample's clean words that score high join the clean class, and it is fitted again.

Scoring covers every string of every text. A string is a run without blanks, less all that isn't a letter
("i-d-i-o-t"), or several one-letter strings in a row ("i d i o t"); digits and signs that stand for letters
count as these. A string with accents is scored with them and without, and the higher value counts. Clean text
holds some words of some families by chance: a machine of its own has only the witnesses of which clean text holds
hardly any (SURE), and the others, as far as it is concerned, are clean. A text is toxic if that machine's value of
a string is above 0, or if those of the machine of all witnesses are for PAIR different strings. Not counted are strings
that the labelled sentences show to be clean (as many clean ones hold it as toxic ones) though they score above 0 with
either machine, such as the bare stem of a family.

Result of ``flagged``: one row for each toxic document: doc_id, toxic (true), score, word (the string).

Defined cases: null and empty texts are not toxic; a null doc_id can be flagged and stays null; rows of one
doc_id are judged each, and the highest score counts; without labels of both classes nothing is flagged;
labels that contradict each other count as toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, discard, staged, table
from ._text import _CHARS, _TAB, buffers, chunks, mix

LAMBDA, SPAN = 0.6, 6
#: Bound of the training sample: labelled documents that are read, by order of a hash of doc_id.
SAMPLE = 12_000
#: Words of clean text, landmarks, and altered copies (a letter put in or doubled) of each witness to train on.
NEGATIVES, LANDMARKS, ALTERED = 15_000, 256, 6
#: A word is a witness if that many words seen in as many sentences, all toxic by chance, are less likely.
CHANCE = 0.01
PARTS = 4
#: Rounds in which clean words of the sample that score above NEAR are added to the clean class (HARD at most a round).
MINED, NEAR, HARD = 3, -0.5, 5_000
#: A word with that share of toxic sentences or more, some clean ones too, is of neither class.
UNSURE = 0.9
#: Least toxic share of a witness's or a family's sentences, and the share from which one such string makes a text toxic.
LIKELY, SURE = 0.6, 0.99
#: Different strings of likely witnesses that make a text toxic.
PAIR = 2
#: Scores above it are toxic: half-way between the clean words' side and where altered insults lie.
THRESHOLD = 0.4
#: Strings of up to SHORT letters have one triple at most, so that they are like themselves alone: they are looked up.
SHORT = 3
#: Strings of the training sample: none longer than LONGEST letters, WITNESSES of the toxic class (the most frequent);
#: beginnings and ends that make a family have up to PIECE letters. Strings of any length are scored.
LONGEST, WITNESSES, PIECE = 64, 4_000, 24
_LETTERS = 32
Machines = tuple[np.ndarray, np.ndarray, frozenset[bytes], dict[bytes, float]]


def _table() -> tuple[bytes, bytes]:
    """Byte to symbol: 1-26 letters, 27-30 other non-ASCII, 0 blank, 31 to be dropped; and the same for a byte after 0xC3."""
    sym = bytearray([31] * 256)
    for c in b" \t\n\r\x0b\x0c":
        sym[c] = 0
    for c in range(26):
        sym[97 + c] = sym[65 + c] = c + 1
    for a, b in zip("013457@$", "oieastas"):
        sym[ord(a)] = ord(b) - 96
    for c in range(0x80, 0xC0):
        sym[c] = 27 + c % 4
    latin = bytearray(sym)
    plain = "aaaaaaaceeeeiiiidnooooo ouuuuyts" + "aaaaaaaceeeeiiiidnooooo ouuuuyty"
    for k, c in enumerate(plain):
        latin[0x80 + k] = ord(c) - 96 if c != " " else 31
    return bytes(sym), bytes(latin)


_SYM, _LATIN = _table()
#: The triples' offsets from their first letter, with the weight of the span.
OFFSETS = [(a, b, LAMBDA ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


def strings(offsets: np.ndarray, raw: np.ndarray, i: int, j: int, accents: bool = False) -> tuple[np.ndarray, ...]:
    """(symbols, start of each string, text of each string) of the texts i to j. With accents also the symbols of which
    letters that have an accent are others than those without, and the byte where each string starts."""
    lo, hi = int(offsets[i]), int(offsets[j])
    data = raw[lo:hi].tobytes()
    sym = np.frombuffer(data.translate(_SYM), np.uint8)
    byte = raw[lo:hi]
    after = np.flatnonzero(byte[:-1] == 0xC3) + 1
    sym = sym.copy()
    sym[after] = np.frombuffer(_LATIN, np.uint8)[byte[after]]
    # a new string starts after a blank and where a text starts
    off = offsets[i:j] - lo
    cut = sym == 0
    keep = (sym != 31) & ~cut
    if accents:
        kept = sym.copy()
        kept[after] = np.where(keep[after] & (byte[after] >= 0x80), np.frombuffer(_SYM, np.uint8)[byte[after]], sym[after])
        kept = kept[keep]
    breaks = cut.astype(np.int64)
    starts = off[off < len(sym)]
    np.add.at(breaks, starts, 1)
    run = np.cumsum(breaks)[keep]
    place = np.flatnonzero(keep)
    sym = sym[keep]
    if not len(sym):
        return (sym, *[np.zeros(0, np.int64)] * 2, *([sym, np.zeros(0, np.int64)] if accents else []))
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    text = np.searchsorted(offsets[i : j + 1] - lo, place[first], "right") - 1
    size = np.diff(np.append(first, len(sym)))
    join = np.concatenate([[False], (size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1])])
    out = sym, first[~join], text[~join]
    return (*out, kept, place[out[1]]) if accents else out


def triples(sym: np.ndarray, first: np.ndarray):
    """For each offset pair: (index of the triple in the table, its weight, mask of places whose triple stays in one string)."""
    n = len(sym)
    s = sym.astype(np.int32)
    last = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    left = last - np.arange(n)  # letters from here to the string's end
    pad = np.concatenate([s, np.zeros(SPAN, np.int32)])
    head = s * 1024
    for a, b, w in OFFSETS:
        yield head + pad[a : a + n] * 32 + pad[b : b + n], w, left > b


def norms(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """|phi| of each string, exactly: equal triples of a string add up before they are squared."""
    n = len(first)
    who = np.repeat(np.arange(n), np.diff(np.append(first, len(sym))))
    keys, weights = [], []
    for index, w, ok in triples(sym, first):
        keys.append((who[ok].astype(np.int64) << 15) | index[ok])
        weights.append(np.full(ok.sum(), w))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    if not len(key):
        return np.zeros(n)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return np.sqrt(np.bincount(key[at] >> 15, np.add.reduceat(weight, at) ** 2, n))


def phi(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of normalised features: (row, triple, weight)."""
    sym, first, _ = strings(*_column(words), 0, len(words))
    assert len(first) == len(words)
    who = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sym))))
    size = norms(sym, first)
    row, col, val = [], [], []
    for index, w, ok in triples(sym, first):
        row.append(who[ok])
        col.append(index[ok])
        val.append(np.full(ok.sum(), w))
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    return row, col, val / np.maximum(size, 1e-12)[row]


def _column(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column that has one word for each text."""
    return np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64), np.frombuffer(b"".join(words), np.uint8)


def kernel(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """The normalised kernel between two lists of strings."""
    dense = np.zeros((len(y), _LETTERS**3), np.float32)
    row, col, val = phi(y)
    np.add.at(dense, (row, col), val)
    out = np.zeros((len(x), len(y)), np.float32)
    row, col, val = phi(x)
    order = np.argsort(row, kind="stable")
    row, col, val = row[order], col[order], val[order]
    cols = np.ascontiguousarray(dense.T)
    for s in range(0, len(row), 1 << 15):
        e = min(len(row), s + (1 << 15))
        r = row[s:e]
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[at]] += np.add.reduceat(cols[col[s:e]] * val[s:e, None], at, axis=0)
    return out


def fit(toxic: list[bytes], clean: list[bytes], hard: list[bytes] = (), landmarks: int = LANDMARKS, rounds: int = 60, c: float = 10.0) -> np.ndarray:
    """Weight of each triple, with the bias as last entry: the machine, folded over its landmarks."""
    rng = np.random.default_rng(0)
    toxic, known = list(toxic), set(clean)
    marks_from = len(toxic)
    toxic += [w for w in altered(toxic, rng) if w not in known]
    half = min(marks_from, landmarks // 2)
    marks = [toxic[k] for k in rng.permutation(marks_from)[:half]] + [clean[k] for k in rng.permutation(len(clean))[: landmarks - half]]
    marks += [hard[k] for k in rng.permutation(len(hard))[: landmarks // 2]]
    clean = [*clean, *hard]
    x = kernel(toxic + clean, marks)
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(float))
    keep = value > 1e-6
    root = vector[:, keep] / np.sqrt(value[keep])
    f = np.hstack([x @ root, np.ones((len(x), 1))])
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    dear = c * len(clean) / max(len(toxic), 1)
    cost = np.concatenate([np.full(len(toxic), dear), np.full(len(clean) - len(hard), c), np.full(len(hard), max(c, dear))])
    beta = np.zeros(f.shape[1])
    reg = np.eye(f.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(rounds):  # Newton steps on the squared hinge loss
        active = y * (f @ beta) < 1
        a = f[active]
        new = np.linalg.solve(reg + (a * cost[active, None]).T @ a, (a * cost[active, None]).T @ y[active])
        if np.abs(new - beta).max() < 1e-7:
            break
        beta = new
    v = np.zeros(_LETTERS**3 + 1)
    row, col, val = phi(marks)
    np.add.at(v, col, val * (root @ beta[:-1])[row])
    v[-1] = beta[-1]
    return v


def altered(words: list[bytes], rng) -> list[bytes]:
    """Copies with a letter put in at an inner place, every other time the one before it again."""
    out = []
    for w in words:
        for k in range(ALTERED if len(w) > 4 else ALTERED // 2):
            at = int(rng.integers(1, len(w)))
            out.append(w[:at] + (w[at - 1 : at] if k % 2 else bytes([97 + int(rng.integers(26))])) + w[at:])
    return out


def score(v: np.ndarray, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The machine's value for each string. Strings that cannot reach 0 have a bound of it instead, also below 0."""
    return scores([v], sym, first)[0]


def scores(machines: list[np.ndarray], sym: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """``score`` for several machines, in one pass over the triples.

    |phi| is at least the root of the sum of the triples' squared weights, which a string's length gives; only
    strings that stay above 0 with that bound need their exact norm."""
    n = len(first)
    if not n:
        return [np.zeros(0) for _ in machines]
    totals = [np.zeros(len(sym), np.float32) for _ in machines]
    tables = [v[:-1].astype(np.float32) for v in machines]
    for index, w, ok in triples(sym, first):
        weight = ok * np.float32(w)
        for total, table in zip(totals, tables):
            total += table[index] * weight
    size = np.diff(np.append(first, len(sym)))
    square = np.zeros(size.max() + 1)
    for _, b, w in OFFSETS:
        square += w * w * np.maximum(np.arange(len(square)) - b, 0)
    low = np.maximum(np.sqrt(square)[size], 1e-12)
    long, outs = size > SHORT, []  # the short ones are looked up
    for v, total in zip(machines, totals):
        sums = np.add.reduceat(total, first).astype(float)
        out = np.where(long, sums / low + v[-1], -1.0)
        hot = np.flatnonzero(out > 0)
        if len(hot):
            ends = np.append(first[1:], len(sym))
            pieces = [sym[first[k] : ends[k]] for k in hot]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
            out[hot] = sums[hot] / norms(np.concatenate(pieces), starts) + v[-1]
        outs.append(out)
    return outs


def sentence_ends(raw: np.ndarray) -> np.ndarray:
    """Places of the bytes that end a sentence: . ! ? before white space, and line ends."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    after = np.concatenate([blank[1:], [True]]) if len(raw) else blank
    return np.flatnonzero((np.isin(raw, np.frombuffer(b".!?", np.uint8)) & after) | (raw == 10))


def _train_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct (word, sentence, class): the strings of the sentences of a batch of labelled texts, a sentence being
    the hash of its strings and inheriting its text's label."""
    offsets, raw = buffers(batch.column("text"))
    toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int32)
    words, sentences, classes = [], [], []
    for i, j in chunks(offsets):
        plain, first, text, sym, place = strings(offsets, raw, i, j, accents=True)
        if not len(first):
            continue
        ends, own = np.append(first[1:], len(sym)), hashes(sym, first)
        number = np.searchsorted(sentence_ends(raw[offsets[i] : offsets[j]]), place)
        new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (text[1:] != text[:-1])]))
        total = np.repeat(np.add.reduceat(mix(own), new), np.diff(np.append(new, len(own))))
        label = toxic[i + text]
        for letters, hashed, some in ((sym, own, np.ones(len(own), bool)), (plain, hashes(plain, first), label == 0)):
            if letters is plain:
                some &= hashed != own
            some &= ends - first <= LONGEST
            k = np.flatnonzero(some)
            _, once = np.unique(mix(hashed[k] ^ mix(total[k] + label[k].astype(np.uint64))), return_index=True)
            data = (letters + 96).astype(np.uint8).tobytes()
            words += [data[a:b] for a, b in zip(first[k[once]].tolist(), ends[k[once]].tolist())]
            sentences.append(total[k[once]].view(np.int64))
            classes.append(label[k[once]])
    none = np.zeros(0, np.int64)
    cols = [pa.array(words, pa.binary()), pa.array(np.concatenate([none, *sentences])), pa.array(np.concatenate([none.astype(np.int32), *classes]))]
    return pa.RecordBatch.from_arrays(cols, ["word", "sentence", "toxic"])


def hashes(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string."""
    up, down = _CHARS.get(len(sym) + 1)
    sums = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(_TAB[sym] * up[:-1], out=sums[1:])
    return mix((sums[np.append(first[1:], len(sym))] - sums[first]) * down[first])


def _unsymbol(word) -> bytes:
    """Symbols 27-30 come back as non-ASCII bytes, so that a stored word reads as the same symbols."""
    return bytes(c if c < 123 else 0x80 + (c - 123) for c in bytes(word))


def beyond_chance(t: str, c: str, share: float, kinds: int) -> str:
    """SQL: of t + c sentences more are toxic, with that share of all, than chance gives any of ``kinds`` words.

    Chernoff's bound of the binomial tail; with c = 0 it is share ** t."""
    n = f"({t} + {c})"
    gain = f"{t} * ln({t} / ({n} * {share!r})) + if({c} > 0, {c} * ln({c} / ({n} * {1 - share!r})), 0)"
    return f"({t} >= 3 and {t} >= {LIKELY} * {n} and {t} > {share!r} * {n} and {gain} >= {float(np.log(max(kinds, 1) / CHANCE))!r})"


def witnesses(words: DataFrame, share: float, kinds: int) -> DataFrame:
    """(word, t, p) of ``words`` (word, t, c): the witnesses, p being the least toxic share of what each is one for."""
    own = words.filter(beyond_chance("t", "c", share, kinds)).select("word", "t", F.expr("(t + 1) / (t + c + 1)").alias("p"))
    pieces = words.filter(f"length(word) > {SHORT}").select("word", "t", "c", F.explode(F.expr(
        f"flatten(transform(sequence(3, least(length(word) - 1, {PIECE})), k -> array(named_struct('end', false, 's', substring(word, 1, k)), named_struct('end', true, 's', substring(word, length(word) - k + 1, k)))))"
    )).alias("piece"))
    family = pieces.groupBy("piece").agg(F.sum("t").alias("ft"), F.sum("c").alias("fc"), F.max("t").alias("most"))
    family = family.filter(beyond_chance("(ft - most)", "fc", share, kinds)).select("piece", F.expr("(ft + 1) / (ft + fc + 1)").alias("p"))
    member = pieces.filter("t > 0 and t >= c").join(family, "piece").select("word", "t", "p")
    return own.unionByName(member).groupBy("word").agg(F.max("t").alias("t"), F.min("p").alias("p"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machines | None:
    """The machine of the sure witnesses, that of all and the strings that it spares; None where the labels don't have both classes."""
    labels = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter("__id is not null and toxic is not null")
    some = labels.groupBy("__id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = texts.join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("text", "toxic")
    # the sample is bounded, so a few partitions hold it, and each sends few candidates to the driver
    words = staged(
        arrow_map(both, _train_words, "word binary, sentence long, toxic int").distinct()
        .groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).coalesce(PARTS), "words"
    )
    all_t, all_c, kinds = words.agg(F.sum("t"), F.sum("c"), F.count("*")).first()
    if not all_t or not all_c:
        return None
    chosen = staged(witnesses(words, all_t / (all_t + all_c), kinds), "witnesses")
    found = {_unsymbol(r.word): r.p for r in chosen.orderBy(F.desc("t"), "word").limit(WITNESSES).collect()}
    short = {bytes(c - 96 if c < 123 else c - 0x80 + 27 for c in w): p for w, p in found.items() if len(w) <= SHORT}
    seen = {w: p for w, p in found.items() if len(w) > SHORT}
    sure, likely = [w for w in seen if seen[w] >= SURE], [w for w in seen if seen[w] < SURE]
    fair = words.filter(f"c > 0 and t < {UNSURE} * (t + c) and length(word) > {SHORT}").join(chosen.select("word"), "word", "left_anti")
    fair = staged(fair.select("word", "t", "c").coalesce(PARTS), "fair")
    often = fair.orderBy(F.desc("c"), "word").limit(NEGATIVES // 2).collect()
    rest = fair.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES // 2).collect()
    clean = list(dict.fromkeys(_unsymbol(r.word) for r in often + rest))
    never = np.append(np.zeros(_LETTERS**3), -1.0)
    one, every, spared = never, never, frozenset()
    if seen and clean:
        one = every = mined(fair, list(seen), clean, [])
        if likely:
            one = mined(fair, sure, clean, likely) if sure else never
        clear = fair.filter("t <= c").select("word")
        shown = arrow_map(clear, _hard(every), "word binary, s double").unionByName(arrow_map(clear, _hard(one), "word binary, s double")).filter("s > 0")
        spared = frozenset(bytes(c - 96 for c in r.word) for r in shown.select("word").distinct().collect())
    discard(words, chosen, fair)
    return (one, every, spared, short) if seen and clean or short else None


def mined(fair: DataFrame, toxic: list[bytes], clean: list[bytes], added: list[bytes]) -> np.ndarray:
    """The machine fitted again and again, with the clean words of the sample that score high; less the threshold."""
    known, added = {*clean, *added}, list(added)
    v = fit(toxic, clean, added)
    for _ in range(MINED):
        hard = arrow_map(fair.select("word"), _hard(v), "word binary, s double").orderBy(F.desc("s"), "word").limit(HARD).collect()
        new = [w for w in (_unsymbol(r.word) for r in hard) if w not in known]
        if not new:
            break
        known |= {*new}
        added += new
        v = fit(toxic, clean, added)
    v[-1] -= THRESHOLD
    return v


def _hard(v: np.ndarray):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [_unsymbol(w) for w in batch.column(0).to_pylist()]
        sym, first, _ = strings(*_column(words), 0, len(words))
        s = score(v, sym, first)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["word", "s"]).filter(pa.array(s > NEAR))

    return run


def both_ways(machines: list[np.ndarray], kept: np.ndarray, plain: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each machine the values of the strings with their accents, and the higher ones of these and those without."""
    own = scores(machines, kept, first)
    outs = [o.copy() for o in own]
    ends = np.append(first[1:], len(kept))
    other = np.flatnonzero(np.add.reduceat(kept != plain, first)) if len(first) else first
    if len(other):
        size = (ends - first)[other]
        start = np.cumsum(size) - size
        at = np.repeat(first[other] - start, size) + np.arange(size.sum())
        for out, more in zip(outs, scores(machines, plain[at], start)):
            out[other] = np.maximum(out[other], more)
    return own, outs


def _key(string: bytes) -> int:
    """Strings of up to SHORT symbols as numbers."""
    return sum((c + 1) << (8 * k) for k, c in enumerate(string))


def looked_up(sym: np.ndarray, first: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the short strings that are among ``keys``."""
    k = np.flatnonzero(ends - first <= SHORT)
    if not len(keys) or not len(k):
        return k[:0]
    pad = np.append(sym, np.zeros(SHORT, sym.dtype)).astype(np.int64)
    at = first[k][:, None] + np.arange(SHORT)
    own = np.where(at < ends[k][:, None], (pad[at] + 1) << (8 * np.arange(SHORT)), 0).sum(axis=1)
    return k[keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own]


def judge(machines: Machines):
    """The highest score, and its string, of each text of a batch; -1 where a text is not toxic."""
    one, every, spared, short = machines
    keys = np.sort(np.array([_key(w) for w in short], np.int64))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = buffers(batch.column(batch.schema.get_field_index("text")))
        top = np.full(batch.num_rows, -1.0)
        word: list[str | None] = [None] * batch.num_rows
        for i, j in chunks(offsets):
            plain, first, text, kept, _ = strings(offsets, raw, i, j, accents=True)
            ends = np.append(first[1:], len(kept))
            own, high = both_ways([one] if every is one else [one, every], kept, plain, first)

            def hits(machine: int):
                """(number, string, value) of the strings above 0, but for those known to be clean."""
                for k in np.flatnonzero(high[machine] > 0).tolist():
                    string, value = kept[first[k] : ends[k]].tobytes(), float(high[machine][k])
                    if plain[first[k] : ends[k]].tobytes() in spared:
                        value = float(own[machine][k])
                    if value > 0 and string not in spared:
                        yield k, string, value

            found: dict[int, dict[bytes, tuple[float, int]]] = {}
            for k, string, value in hits(-1):
                found.setdefault(i + int(text[k]), {})[string] = (value, k)
            best: dict[int, tuple[float, int]] = {}
            for k in looked_up(kept, first, ends, keys):
                t, string = i + int(text[k]), kept[first[k] : ends[k]].tobytes()
                found.setdefault(t, {})[string] = (float(short[string]), int(k))
                if short[string] >= SURE:
                    best[t] = max(best.get(t, (-1.0, 0)), (float(short[string]), int(k)))
            for t, x in found.items():
                if len(x) >= PAIR:
                    best[t] = max([best.get(t, (-1.0, 0)), *x.values()])
            for k, _, value in hits(0):
                t = i + int(text[k])
                best[t] = max(best.get(t, (-1.0, 0)), (value, k))
            for t, (s, k) in best.items():
                if s > top[t]:
                    top[t] = s
                    word[t] = "".join(chr(c + 96) if c <= 26 else "?" for c in plain[first[k] : ends[k]].tolist())
        cols = [batch.column(c) for c in range(batch.num_columns)] + [pa.array(top), pa.array(word, pa.string())]
        return pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "__score", "__word"])

    return run


def flagged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    v = train(docs, labels, sample)
    if v is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, toxic boolean, score double, word string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = arrow_map(texts.filter("text is not null"), _only_hits(judge(v)), "doc_id long, __score double, __word string")
    best = scored.groupBy("doc_id").agg(F.max(F.struct("__score", "__word")).alias("b"))
    return best.select("doc_id", F.lit(True).alias("toxic"), F.round("b.__score", 6).alias("score"), F.col("b.__word").alias("word"))


def _only_hits(run):
    def hits(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = run(batch)
        out = out.select(["doc_id", "__score", "__word"])
        return out.filter(pa.array(out.column(1).to_numpy() > 0))

    return hits


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text the machine, trained on ``labels``, finds toxic; all columns stay."""
    v = train(docs, labels)
    if v is None:
        return docs
    run = judge(v)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = run(batch)
        return batch.filter(pa.array(out.column(out.num_columns - 2).to_numpy() <= 0))

    return arrow_map(docs, clean, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
