"""Benchmark decontamination: BM25 over an inverted index of test items, pruned by block maxima (WAND).

Test items are indexed; every passage of every text (PASSAGE words from every STRIDE-th word on, so that the
passages overlap) is a query. Items of more than PART words are indexed as parts of PART words that overlap by half, so
that each part of a copy lies in one passage wherever the copy begins. A passage scores a part by the BM25 weights of the
words they share, as a share of what the part scores for itself; all items with a part at or above THRESHOLD are retrieved. Postings are in the order of parts, in blocks
of BLOCK parts of like length with the largest weight of each word in each block. Passages whose words' maxima add up to the threshold in
no block are left out a batch at a time; the others run block-max WAND: cursors, pivots, skips over blocks that can't
reach the threshold, scores for the parts that are left. Both are exact. SHARD parts have a table of maxima of
their own, so that its size is bounded.

A hit is verified: the item's question (all sentences but the last) and answer (the last sentence; both the
whole item if it has one sentence or if that half has no words) must each share with the text around the passage at least VERIFY of their
word pairs.

Result of ``leaks``: one row for each text and item that is verified: doc_id, item_id, start_word (of the best
passage), score, question_overlap, answer_overlap.

Defined cases: null or empty texts and items hit nothing; a null doc_id or item_id stays null in the result;
rows that repeat give one result row; items of the same text each have their own row; without items there
are no rows. An index beyond INDEX_ITEMS items is split by a hash of item_id and each part is searched in a
pass of its own, with the statistics of all items, so no side that is broadcast grows with the data.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, id_and_text, table
from ._text import Words, buffers, chunks

PASSAGE, STRIDE, BLOCK = 128, 64, 8
#: Words of an item's part: the overlap of two passages, so that one of them holds it whole.
PART = PASSAGE - STRIDE
K1, B = 1.2, 0.75
#: Floor of a word's weight, for words that half of the items have.
LEAST = 1e-3
THRESHOLD, VERIFY = 0.6, 0.5
#: Items' parts that one pass over the texts looks for, and parts that one table of block maxima covers.
INDEX_ITEMS, SHARD = 16_384, 2_048
#: Passages whose cursors move together.
AT_ONCE = 1024


def sentences(text: str) -> tuple[str, str]:
    """(question, answer): all sentences but the last, and the last."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    off, raw = buffers(pa.array(texts, pa.string()))
    out = []
    for i, j in chunks(off):
        w = Words(off, raw, i, j)
        out += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    return out


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; of a single word, itself."""
    return np.unique(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else np.unique(h)


def cuts(n: int) -> list[int]:
    """First words of the parts of an item of n words; the last part reaches the end."""
    return [*range(0, max(n - PART, 0), PART // 2), max(n - PART, 0)]


class Index:
    """Words, their postings by blocks of items, and what verification needs."""

    def __init__(self, ids: list, texts: list[str], stats: tuple[int, float, dict[int, int]] | None = None):
        words = _hashes(texts)
        keep = sorted((k for k, w in enumerate(words) if len(w)), key=lambda k: len(words[k]))
        self.ids = [ids[k] for k in keep]
        words = [words[k] for k in keep]
        n, mean, df = stats or collection(words)
        terms, weights = [], []
        #: the item of each part
        self.owner = np.repeat(np.arange(len(words)), [len(cuts(len(w))) for w in words])
        for w in (w[a : a + PART] for w in words for a in cuts(len(w))):
            t, tf = np.unique(w, return_counts=True)
            idf = np.array([max(LEAST, np.log((n - df[int(x)] + 0.5) / (df[int(x)] + 0.5))) for x in t])
            s = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            terms.append(t)
            weights.append(s / s.sum())
        self.vocab = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        term = [np.searchsorted(self.vocab, t) for t in terms]
        item = np.repeat(np.arange(len(terms)), [len(t) for t in terms]) if terms else np.zeros(0, int)
        flat = np.concatenate(term) if terms else np.zeros(0, int)
        weight = np.concatenate(weights) if terms else np.zeros(0)
        order = np.lexsort((item, flat))
        self.post_item, self.post_weight = item[order], weight[order]
        self.post_start = np.searchsorted(flat[order], np.arange(len(self.vocab) + 1))
        #: postings by (word, part) as one number, for cursors that skip; each word's largest weight
        self.post_key = flat[order] * (len(terms) + 1) + self.post_item
        # largest weight of each word in each block of items
        self.maxima = np.zeros((len(self.vocab), -(-len(terms) // BLOCK)), np.float32)
        np.maximum.at(self.maxima, (flat, item // BLOCK), weight.astype(np.float32))
        self.top = self.maxima.max(axis=1) if len(terms) else np.zeros(0, np.float32)
        # a bit map by 20 bits of the hash keeps most words out of the exact look-up
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.vocab >> np.uint64(44)] = True
        halves = [sentences(texts[k]) for k in keep]
        self.question, self.answer = ([pairs(h if len(h) else w) for h, w in zip(_hashes([x[k] for x in halves]), words)] for k in (0, 1))
        self.size = np.array([len(w) for w in words])

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        if len(self.vocab):
            may = np.flatnonzero(self.bits[h >> np.uint64(44)])
            k = np.minimum(np.searchsorted(self.vocab, h[may]), len(self.vocab) - 1)
            hit = self.vocab[k] == h[may]
            out[may[hit]] = k[hit]
        return out

    def search(self, terms: np.ndarray, bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, part, score) of all parts that reach the threshold, by block-max WAND.

        Passage k has the distinct words terms[bounds[k]:bounds[k + 1]]. Its cursors, one for each word's postings, stand
        in the order of parts. The pivot is the first part where the largest weights of the words that stand up to
        it add up to the threshold. If those of the pivot's block do too, the cursors before it skip to it and it
        is scored; if not, they skip past the block, or to the next cursor behind the pivot. All passages take
        their steps together, so a step is a few numpy calls."""
        many = np.diff(bounds)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        order = np.argsort(many, kind="stable")  # passages of about as many words share a table
        for group in (order[k : k + AT_ONCE] for k in range(0, len(order), AT_ONCE)):
            width = int(many[group].max())
            if width:
                place = bounds[group][:, None] + np.arange(width)
                word = np.where(np.arange(width) < many[group][:, None], terms[np.minimum(place, len(terms) - 1)], -1)
                out += self._wand(group, word, threshold)
        return tuple(np.concatenate(c) for c in zip(*out))

    def _wand(self, passage: np.ndarray, word: np.ndarray, threshold: float):
        """Steps of the passages (rows of words, -1 for none) until none has a pivot any more."""
        parts, low = len(self.owner), threshold - 1e-4
        kind = np.uint16 if parts < 65_535 else np.int64
        item_at, weight_at, key = np.append(self.post_item, parts).astype(kind), np.append(self.post_weight, 0.0), self.post_key
        last = self.post_start[word + 1]
        at = np.where(word < 0, len(self.post_item), self.post_start[word])
        top = np.where(word < 0, 0.0, self.top[word]).astype(np.float32)
        item = item_at[at]
        while len(passage):
            order = np.argsort(item, axis=1, kind="stable")
            found = np.cumsum(np.take_along_axis(top, order, 1), axis=1) >= low
            rows = np.arange(len(passage))
            where = found.argmax(axis=1)
            pivot = item[rows, order[rows, where]].astype(np.int64)
            go = found[rows, where] & (pivot < parts)
            if not go.all():
                passage, word, last, at, top, item, pivot = (x[go] for x in (passage, word, last, at, top, item, pivot))
                rows = np.arange(len(passage))
                if not len(passage):
                    break
            upto = item <= pivot[:, None]
            block = pivot // BLOCK
            deep = np.where(upto, self.maxima[word, block[:, None]], np.float32(0)).sum(axis=1) >= low
            behind = np.where(upto, parts, item).min(axis=1).astype(np.int64)
            target = np.where(deep, pivot, np.minimum((block + 1) * BLOCK, behind))
            move = upto & (item < target[:, None])
            r, c = np.nonzero(move)
            to = np.searchsorted(key, word[r, c] * (parts + 1) + target[r])
            at[r, c] = to
            item[r, c] = np.where(to < last[r, c], item_at[to], parts)
            hit = deep[:, None] & (item == pivot[:, None])
            score = np.where(hit, weight_at[at], 0.0).sum(axis=1)
            some = deep & (score >= threshold - 1e-9)
            if some.any():
                yield passage[some], pivot[some], score[some]
            r, c = np.nonzero(hit)
            to = at[r, c] + 1
            at[r, c] = to
            item[r, c] = np.where(to < last[r, c], item_at[to], parts)


def collection(words: list[np.ndarray]) -> tuple[int, float, dict[int, int]]:
    df: dict[int, int] = {}
    for w in words:
        for x in np.unique(w):
            df[int(x)] = df.get(int(x), 0) + 1
    full = [len(w) for w in words if len(w)]
    return len(full), sum(full) / max(len(full), 1), df


def passages(n: int) -> range:
    """First words of the passages of a text of n words; the last passage reaches the end."""
    return range(0, max(1, n - (PASSAGE - STRIDE)), STRIDE)


def upper_bounds(index: Index, term: np.ndarray, w: Words, start: np.ndarray) -> np.ndarray:
    """For each passage and block a bound of its items' scores: the maxima of its halves' distinct words."""
    at = np.flatnonzero(term >= 0)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[at]
    before = np.concatenate([[0], np.cumsum(-(-np.diff(w.first) // STRIDE))])
    half = before[text] + (at - w.first[text]) // STRIDE
    key = np.sort((half.astype(np.uint64) << np.uint64(24)) | term[at].astype(np.uint64))
    gain = np.zeros((before[-1] + 1, index.maxima.shape[1]), np.float32)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        half, word = (key >> np.uint64(24)).astype(np.int64), (key & np.uint64((1 << 24) - 1)).astype(np.int64)
        for a in range(0, len(key), 1 << 16):
            h = half[a : a + (1 << 16)]
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            gain[h[edge]] += np.add.reduceat(index.maxima[word[a : a + (1 << 16)]], edge, axis=0)
    text = np.searchsorted(w.first, start, "right") - 1
    lo = before[text] + (start - w.first[text]) // STRIDE
    second = np.where(lo + 1 < before[text + 1], lo + 1, before[-1])
    return gain[lo] + gain[second]


def find(shards: list[Index], threshold: float = THRESHOLD, verify: float = VERIFY):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = buffers(batch.column("text"))
        ids, out = batch.column("doc_id"), []
        for i, j in chunks(offsets):
            w = Words(offsets, raw, i, j)
            n = np.diff(w.first)
            many = np.where(n > 0, np.maximum(1, -(-(n - (PASSAGE - STRIDE)) // STRIDE)), 0)
            text = np.repeat(np.arange(j - i), many)
            start = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STRIDE + w.first[:-1][text]
            end = np.minimum(start + PASSAGE, w.first[1:][text])
            for index in shards:
                term = index.look_up(w.hash)
                live = upper_bounds(index, term, w, start) >= threshold - 1e-4
                hot = np.flatnonzero(live.any(axis=1))
                words = [np.unique(term[start[p] : end[p]]) for p in hot]
                words = [x[np.searchsorted(x, 0) :] for x in words]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
                row, part, score = index.search(np.concatenate(words) if words else np.zeros(0, np.int64), bounds, threshold)
                best: dict[tuple[int, int], float] = {}
                for k, item, x in zip(row.tolist(), index.owner[part].tolist(), score.tolist()):
                    best[k, item] = max(best.get((k, item), 0.0), x)
                for (k, item), x in best.items():
                    p = hot[k]
                    s, e, t = int(start[p]), int(end[p]), int(text[p])
                    reach = int(index.size[item])
                    a, b = max(int(w.first[t]), s - reach), min(int(w.first[t + 1]), e + reach)
                    near = np.union1d(pairs(w.hash[a:b]), w.hash[a:b])
                    q, r = (float(np.isin(y, near).mean()) for y in (index.question[item], index.answer[item]))
                    if q >= verify and r >= verify:
                        out.append((ids[i + t].as_py(), index.ids[item], s - int(w.first[t]), round(x, 6), round(q, 6), round(r, 6)))
        cols = list(zip(*out)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        names = ["doc_id", "item_id", "start_word", "score", "question_overlap", "answer_overlap"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


SCHEMA = "doc_id long, item_id long, start_word int, score double, question_overlap double, answer_overlap double"


def shards(ids: list, texts: list[str], stats) -> list[Index]:
    many = [len(cuts(len(w))) for w in _hashes(texts)]
    groups, room = [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if many[k] > room:
            groups.append([])
            room = SHARD
        groups[-1].append(k)
        room -= many[k]
    return [Index([ids[k] for k in g], [texts[k] for k in g], stats) for g in groups]


def indexes(items: DataFrame, limit: int = INDEX_ITEMS):
    """The index of all items in shards, or one for each part of them where there are more than ``limit``."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    words = arrow_map(items.select("text"), _item_words, _WORDS)
    size = words.filter("h is null").agg(F.sum("df"), F.sum("n"), F.sum("parts")).first()
    parts = max(1, -(-(size[2] or 0) // limit))
    totals = words.filter("h is not null").groupBy("h").agg(F.sum("df").alias("df"))
    for k in range(parts):
        part, own = items, totals
        if parts > 1:
            part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
            own = totals.join(arrow_map(part.select("text"), _item_words, _WORDS).select("h").distinct(), "h")
        df = {r.h % (1 << 64): r.df for r in own.collect()}
        rows = part.orderBy("item_id", "text").collect()
        yield shards([r.item_id for r in rows], [r.text for r in rows], (size[0] or 0, (size[1] or 0) / max(size[0] or 0, 1), df))


_WORDS = "h long, df long, n long, parts long"


def _item_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Words of items with the number of items that have them; a row without word has items, words and parts in all."""
    n, _, df = collection(words := _hashes(batch.column(0).to_pylist()))
    h = pa.array(np.fromiter(df, np.uint64, len(df)).view(np.int64).tolist() + [None], pa.int64())
    sums = [pa.array([0] * len(df) + [x], pa.int64()) for x in (sum(map(len, words)), sum(len(cuts(len(w))) for w in words))]
    return pa.RecordBatch.from_arrays([h, pa.array([*df.values(), n], pa.int64()), *sums], ["h", "df", "n", "parts"])


def leaks(docs: DataFrame, items: DataFrame, limit: int = INDEX_ITEMS) -> DataFrame:
    texts = id_and_text(docs).filter("text is not null")
    spark, found = docs.sparkSession, None
    for index in indexes(items, limit):
        shared = spark.sparkContext.broadcast(index)
        part = arrow_map(texts, lambda batch, s=shared: find(s.value)(batch), SCHEMA)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), "question_overlap", "answer_overlap"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("start_word"), "b.score", "b.question_overlap", "b.answer_overlap")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a verified item; all columns stay, clean rows as they are."""
    spark, kept = docs.sparkSession, docs
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def clean(batch: pa.RecordBatch, s=shared) -> pa.RecordBatch:
            text = batch.column(batch.schema.get_field_index("text"))
            hit = find(s.value)(pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["doc_id", "text"]))
            keep = np.ones(batch.num_rows, bool)
            keep[hit.column(0).to_numpy()] = False
            return batch.filter(pa.array(keep))

        kept = arrow_map(kept, clean, docs.schema)
    return kept


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
SQL: dict[str, str] = {}
