"""SimHash near-dedup by the generalised pigeonhole principle.

1. Each text gets two 64-bit SimHashes: one of its set of words, one of its set of neighbouring
   word pairs.
2. From all signatures the correlations of bits and the histograms of small groups of bits are counted.
   Correlated bits go into the same partition. If the partitions' thresholds t_i (each at least -1, which
   leaves the partition out) add up to ``radius`` - partitions + 1, two signatures within ``radius`` agree
   within t_i bits in some partition. Dynamic programming chooses the t_i, and the number of partitions, that
   cost least: the rows to enumerate plus the candidate pairs that the histograms let expect.
3. For threshold t, values within t // 2 bits on one side and within t - t // 2 on the other are enumerated
   and meet on equal values, so the search is exact: recall is 1 against brute force on the signatures.
4. Candidates are verified by both Hamming distances; verified pairs join into groups.

Result of ``near_duplicates``: one row for each document of a group of two or more: doc_id, group_id (the
smallest doc_id of the group, which is the document to keep), group_size.

Defined cases: a text without words (null and empty among them) and a row with a null doc_id have no
signature and are in no group; rows of one doc_id are one document, described by its least signature; copies
share their signature and so their group; ties of a bit's sum count as 0.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, discard, fresh, id_and_text, staged, table
from ._text import Words, buffers, chunks, mix

#: Bits of the word signature within which two texts are candidates, and of the pair signature that confirm it.
RADIUS, CONFIRM = 9, 20
BITS, BLOCK = 64, 8
#: Costs, in microseconds, of a row to enumerate and of a pair to compare.
ROW_COST, PAIR_COST = 3.0, 0.05
_LOW = np.uint64((1 << 46) - 1)


def _signature(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash of each slice of ``words``; an empty slice gives 0."""
    out = np.zeros((len(bounds) - 1, BITS), np.int64)
    for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
        for a in range(s, e, 1 << 16):
            b = min(e, a + (1 << 16))
            bits = np.unpackbits(words[a:b].view(np.uint8)).reshape(-1, BITS).astype(np.float32)
            out[k] += (np.ones(b - a, np.float32) @ bits).astype(np.int64)
    return np.packbits(out * 2 > np.diff(bounds)[:, None], axis=1).view(np.uint64).ravel()


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of 46-bit values of each text, sorted by text, and where each text begins."""
    key = np.sort((text.astype(np.uint64) << np.uint64(46)) | (values & _LOW))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _LOW, np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(46))


def signatures(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word signature, pair signature, number of words) of each text."""
    one, two, count = [], [], []
    for i, j in chunks(offsets):
        w = Words(offsets, raw, i, j)
        text, n = w.text_of(), j - i
        v, bounds = _distinct(w.hash, text, n)
        one.append(_signature(mix(v), bounds))
        before = np.empty_like(w.hash)
        before[1:] = w.hash[:-1]
        heads = w.first[:-1][np.diff(w.first) > 0]
        before[heads] = 0
        v, bounds = _distinct(mix(before * np.uint64(3) + w.hash), text, n)
        two.append(_signature(mix(v), bounds))
        count.append(np.diff(w.first))
    return np.concatenate(one), np.concatenate(two), np.concatenate(count)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b, n = signatures(*buffers(batch.column(1)))
    out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "sig", "sig2"])
    return out.filter(pa.array(n > 0))


def _profile(batches):
    """Counts of pairs of set bits, and of the values of each block of bits of each order that is tried."""
    bits, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8)).reshape(-1, BITS).astype(np.float32)
        bits += x.T @ x
        n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(bits.ravel().astype(np.int64)), pa.array(np.full(BITS * BITS, n))], ["k", "c", "n"])


def correlated_groups(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size, give or take one: each takes the bits that correlate most with it."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        seed = max(left, key=lambda b: (corr[b, left].max(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _extract(sig: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each signature as a number; bit b is column b of unpackbits over little-endian bytes."""
    x = np.unpackbits(sig.view(np.uint8)).reshape(-1, BITS)[:, bits].astype(np.int64)
    return x @ (1 << np.arange(len(bits), dtype=np.int64))


def distance_law(groups: list[list[int]], histograms: dict[tuple[int, ...], np.ndarray]) -> list[np.ndarray]:
    """For each group the share of pairs at each distance, from exact histograms of blocks taken as independent."""
    laws = []
    for group in groups:
        law = np.ones(1)
        for s in range(0, len(group), BLOCK):
            block = tuple(group[s : s + BLOCK])
            h = histograms[block].astype(float)
            h = h / max(h.sum(), 1)
            for bit in range(len(block)):  # Walsh-Hadamard: its square gives all pairs by their exclusive or
                h = h.reshape(-1, 2, 1 << bit)
                h = np.stack([h[:, 0] + h[:, 1], h[:, 0] - h[:, 1]], axis=1)
            h = h.ravel() ** 2
            for bit in range(len(block)):
                h = h.reshape(-1, 2, 1 << bit)
                h = np.stack([h[:, 0] + h[:, 1], h[:, 0] - h[:, 1]], axis=1) / 2
            h = h.ravel()
            weight = np.array([bin(v).count("1") for v in range(len(h))])
            law = np.convolve(law, np.bincount(weight, h, len(block) + 1))
        laws.append(law)
    return laws


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, d) for d in range(radius + 1))


def _sides(t: int) -> list[int]:
    """Radii that are enumerated for threshold t: one list that meets itself if t is even, two if it is odd."""
    return [] if t < 0 else [t // 2] if t % 2 == 0 else [t // 2, t - t // 2]


def allocate(laws: list[np.ndarray], widths: list[int], n: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds of least cost that add up to radius - partitions + 1, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for law, width in zip(laws, widths):
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(radius, width)):
                if used + t + 1 > radius + 1:
                    break
                rows = n * sum(_ball(width, r) for r in _sides(t))
                pairs = 0.0 if t < 0 else n * n / 2 * sum(p * _ball(min(d, width), t // 2) for d, p in enumerate(law[: t + 1]))
                c = (cost + ROW_COST * rows + PAIR_COST * pairs, [*chosen, t])
                if c < new.get(used + t + 1, (np.inf, [])):
                    new[used + t + 1] = c
        best = new
    return best.get(radius + 1, (np.inf, []))


def plan(sigs: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """Partitions (bits) with their thresholds, from counts over all signatures."""
    got = sigs.select("sig").mapInArrow(_profile, "k long, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    if not got:
        return []
    together, n = np.zeros(BITS * BITS), got[0]["n"]
    for r in got:
        together[r["k"]] = r["c"]
    options = [correlated_groups(together.reshape(BITS, BITS), n, parts) for parts in range(2, 9)]
    blocks = sorted({tuple(g[s : s + BLOCK]) for o in options for g in o for s in range(0, len(g), BLOCK)})

    def count(batches):
        total = None
        for batch in batches:
            sig = batch.column(0).to_numpy(zero_copy_only=False)
            part = np.stack([np.bincount(_extract(sig, list(b)), minlength=1 << BLOCK) for b in blocks])
            total = part if total is None else total + part
        if total is not None:
            b, v = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(v), pa.array(total[b, v])], ["b", "v", "c"])

    hist = {b: np.zeros(1 << len(b)) for b in blocks}
    for r in sigs.select("sig").mapInArrow(count, "b long, v long, c long").groupBy("b", "v").agg(F.sum("c").alias("c")).collect():
        hist[blocks[r["b"]]][r["v"]] = r["c"]
    found = [(*allocate(distance_law(o, hist), [len(g) for g in o], n, radius), o) for o in options]
    _, thresholds, groups = min(found, key=lambda f: (f[0], len(f[2])))
    return list(zip(groups, thresholds))


def _word(bits) -> int:
    """Mask, as the number that a signature is, of bits numbered as in unpackbits."""
    x = np.zeros(BITS, np.uint8)
    x[list(bits)] = 1
    return int(np.packbits(x).view(np.uint64)[0])


def _probes(chosen: list[tuple[list[int], int]]):
    """Rows (key, sig, sig2, rep) for every value that is enumerated."""
    sets = []
    for part, (bits, t) in enumerate(chosen):
        for radius in _sides(t):
            flips = [_word(c) for d in range(radius + 1) for c in combinations(bits, d)]
            sets.append((np.uint64(_word(bits)), np.array(flips, np.uint64), np.uint64(part * 0x9E3779B97F4A7C15 % (1 << 64))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig, sig2, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        u = sig.view(np.uint64)
        keys = np.concatenate([mix(((u & mask)[:, None] ^ flips[None, :]) + salt).ravel() for mask, flips, salt in sets])
        at = np.concatenate([np.repeat(np.arange(len(u)), len(flips)) for _, flips, _ in sets])
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sig[at]), pa.array(sig2[at]), pa.array(rep[at])], ["key", "sig", "sig2", "rep"])

    return run


def _near(a, b, a2, b2, radius: int, confirm: int) -> np.ndarray:
    return (np.bitwise_count(a ^ b) <= radius) & (np.bitwise_count(a2 ^ b2) <= confirm)


def _verify(radius: int, confirm: int, small: int = 64):
    """Verified links between the rows of equal keys. A run of equal keys beyond ``small`` rows gives links that
    connect the same rows as all its pairs would: what is linked already isn't compared within itself again."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        key = t.column("key").to_numpy()
        order = np.argsort(key)
        key = key[order]
        sig, sig2 = (t.column(c).to_numpy()[order].view(np.uint64) for c in ("sig", "sig2"))
        rep = t.column("rep").to_numpy()[order]
        del t, rows
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        left, right = [], []
        at = starts[(sizes > 1) & (sizes <= small)]
        size = sizes[(sizes > 1) & (sizes <= small)]
        for gap in range(1, small):
            at, size = at[size > gap], size[size > gap]
            if not len(at):
                break
            many = size - gap
            i = np.repeat(at, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            j = i + gap
            ok = _near(sig[i], sig[j], sig2[i], sig2[j], radius, confirm)
            left.append(rep[i[ok]])
            right.append(rep[j[ok]])
        for s, n in zip(starts[sizes > small], sizes[sizes > small]):
            loose = np.arange(s, s + n)
            while len(loose) > 1:
                front, loose = [loose[0]], loose[1:]
                while front and len(loose):
                    x = front.pop()
                    ok = _near(sig[x], sig[loose], sig2[x], sig2[loose], radius, confirm)
                    if ok.any():
                        left.append(np.full(ok.sum(), rep[x]))
                        right.append(rep[loose[ok]])
                        front.extend(loose[ok].tolist())
                        loose = loose[~ok]
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([lo, hi], 1)[lo < hi], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of links (a, b); root is the smallest node.

    Alternating large-star and small-star rounds; each is written to the shared folder, so that no lineage
    grows, and ends when a round changes nothing."""
    now = staged(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u > v").distinct(), "links")
    size = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        last, now = now, staged(small, "links")
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == size:
            break
        size = seen
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def signed(docs: DataFrame) -> DataFrame:
    """One row for each document that has words: doc_id, sig, sig2."""
    s = arrow_map(id_and_text(docs).filter("doc_id is not null and text is not null"), _sign, "doc_id long, sig long, sig2 long")
    return s.groupBy("doc_id").agg(F.min(F.struct("sig", "sig2")).alias("s")).select("doc_id", "s.sig", "s.sig2")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    sigs = staged(signed(docs), "signatures")
    reps = staged(sigs.groupBy("sig", "sig2").agg(F.min("doc_id").alias("rep")), "distinct")
    chosen = plan(reps, radius)
    if not chosen:
        return docs.sparkSession.createDataFrame([], "doc_id long, group_id long, group_size long")
    rows = arrow_map(reps.select("sig", "sig2", "rep"), _probes(chosen), "key long, sig long, sig2 long, rep long")
    links = rows.repartition("key").mapInArrow(_verify(radius, confirm), "a long, b long")
    roots = components(links)
    own = reps.join(roots, reps["rep"] == roots["node"], "left").select("sig", "sig2", F.coalesce("root", "rep").alias("group_id"))
    members = sigs.join(own, ["sig", "sig2"]).select("doc_id", "group_id")
    sizes = members.groupBy("group_id").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return members.join(sizes, "group_id").select("doc_id", "group_id", "group_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are near copies of another with a smaller doc_id; all columns stay."""
    key = fresh(docs, "gone")
    gone = near_duplicates(docs).filter("doc_id != group_id").select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
