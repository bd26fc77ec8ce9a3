"""Substring dedup by level-wise doubling.

Windows of ``BASE`` words are compared first. Only windows that occur more than once are extended to
twice their length and compared again, and so on until no candidate survives.

The base level looks only at *minimizers*: in every run of ``BASE + 1`` neighbouring windows the one with
the smallest hash. Equal texts choose equal minimizers, and each window of ``2 * BASE`` words holds exactly
one such run, so no repeat of ``2 * BASE`` words can be missed although about 2 / ``BASE`` of the windows are
compared. From there on every window start is a row.

Windows are compared by grouping them by their hash. A window that HOT rows or more have (a line that a third of
all texts hold) would be one task's work: such hashes are looked for among one in SAMPLE texts, and their first and
last places are found by an aggregate that is combined before the shuffle. A long window is at most as frequent as
the anchor in it, so without a hot anchor there is no hot window.

Result of ``repeated_spans``: one row for each maximal run of words that already occurred earlier (earlier is
by doc_id, then by place): doc_id, text_hash, start_word, end_word (exclusive), longest (largest window length, doubled
from 2 * BASE, that is repeated there). The first occurrence is not in the result.

Defined cases: a null or empty text has no words and no spans; a row with a null doc_id takes part in
nothing; rows of equal text are copies, of which the one with the smallest doc_id is the first and all
others are repeated as a whole; rows equal in doc_id and text are one document; several texts under one
doc_id are separate texts of that document, told apart by ``text_hash``, which is the order among them too. Words are compared without case and punctuation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_map, discard, fresh, id_and_text, staged, table
from ._text import Words, buffers, chunks, sliding, window_hashes

BASE = 25
#: Words of the shortest repeat that is reported.
SHORTEST = 2 * BASE
#: Rows from which a hash is hot, least; hot hashes at most (they are broadcast); share of texts that are looked at for them.
HOT, MOST_HOT, SAMPLE = 1_000_000, 100_000, 64


def minimizers(w: Words, base: int) -> np.ndarray:
    """Places of the windows that are smallest among some base + 1 neighbours inside one text."""
    g = window_hashes(w.hash, base)
    n = np.diff(w.first)
    inside = np.zeros(len(w.hash), bool)
    text = w.text_of()
    at = np.arange(len(w.hash))
    inside[:] = at + 2 * base <= w.first[text + 1]  # a window of 2 * base words starts here
    if not n.size or len(g) < base + 1:
        return np.zeros(0, np.int64)
    low = sliding(g, base + 1, np.minimum)
    ok = inside[: len(low)]
    top = np.where(ok, low, np.uint64(0))
    pad = np.zeros(base, np.uint64)
    reach = sliding(np.concatenate([pad, top, pad]), base + 1, np.maximum)
    # a place is chosen if a whole run around it has it as minimum
    return np.flatnonzero((reach == g) & _covered(ok, base, len(g)))


def _covered(ok: np.ndarray, base: int, n: int) -> np.ndarray:
    """Places within base after a start of a run."""
    edge = np.zeros(n + base + 2, np.int64)
    edge[: len(ok)] += ok
    edge[base + 1 : base + 1 + len(ok)] -= ok
    return np.cumsum(edge)[:n] > 0


def _anchors(base: int):
    """(g, th, pos) of the anchors, and for each text of 2 * base words or more a row without g, its words as pos."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = buffers(batch.column(1))
        th = batch.column(0).to_numpy(zero_copy_only=False)
        g, doc, pos, whole = [], [], [], []
        for i, j in chunks(offsets):
            w = Words(offsets, raw, i, j)
            at = minimizers(w, base)
            text = w.text_of()[at]
            g.append(window_hashes(w.hash, base)[at] if len(at) else np.zeros(0, np.uint64))
            doc.append(th[i + text])
            pos.append((at - w.first[text]).astype(np.int32))
            long = np.flatnonzero((n := np.diff(w.first)) >= 2 * base)
            whole.append(np.stack([th[i + long], n[long]]))
        whole = np.concatenate(whole, axis=1)
        keys = pa.concat_arrays([pa.array(np.concatenate(g).view(np.int64)), pa.nulls(whole.shape[1], pa.int64())])
        return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([*doc, whole[0]])), pa.array(np.concatenate([*pos, whole[1].astype(np.int32)]))], ["g", "th", "pos"])

    return run


def _windows(base: int):
    """Rows of (doc_id, alt, places, text) to all windows of 2 * base words that hold an anchor: (h, doc_id, pos), pos being
    the first word's number with the text's number among its document's in the upper half."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = buffers(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        alt = batch.column("alt").to_numpy(zero_copy_only=False) << 32
        places = batch.column("places")
        at, bounds = places.flatten().to_numpy(zero_copy_only=False), places.offsets.to_numpy(zero_copy_only=False)
        bounds = bounds - bounds[0]
        h, doc, pos = [], [], []
        for i, j in chunks(offsets):
            w = Words(offsets, raw, i, j)
            mark = np.zeros(len(w.hash) + 1, bool)
            text = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
            mark[w.first[text] + at[bounds[i] : bounds[j]]] = True
            seen = np.concatenate([[0], np.cumsum(mark)])
            win = window_hashes(w.hash, 2 * base)
            n = len(win)
            start = np.arange(n)
            text = w.text_of()[:n]
            ok = (start + 2 * base <= w.first[text + 1]) & (seen[start + base + 1] > seen[start])
            start, text = start[ok], text[ok]
            h.append(win[start])
            doc.append(ids[i + text])
            pos.append(start - w.first[text] + alt[i + text])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos))], ["h", "doc_id", "pos"])

    return run


def hot_keys(sample: DataFrame, key: str, hot: int) -> DataFrame | None:
    """The keys that are expected to have ``hot`` rows or more, from the rows of one in SAMPLE texts; None if there are none."""
    counts = staged(sample.groupBy(key).count().filter(F.col("count") > 1), "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    # no more than MOST_HOT keys can have a MOST_HOT-th of the rows
    least = max(hot / SAMPLE, total / MOST_HOT)
    found = staged(counts.filter(F.col("count") >= least).select(key), "hot")
    discard(counts)
    if found.isEmpty():
        discard(found)
        return None
    return found


def _repeated(windows: DataFrame, key: str, doc: str, hot: DataFrame | None) -> DataFrame:
    """The windows whose hash occurs at two places (doc, pos) at least; later: it isn't the first of them."""
    place = F.struct(doc, "pos")
    later = (place != F.col("lo")).alias("later")

    def grouped(rows: DataFrame) -> DataFrame:
        same = Window.partitionBy(key)
        rows = rows.withColumn("lo", F.min(place).over(same)).withColumn("hi", F.max(place).over(same))
        return rows.filter(F.col("lo") != F.col("hi")).select(key, doc, "pos", later)

    if hot is None:
        return grouped(windows)
    some = windows.join(F.broadcast(hot), key, "left_semi")
    ends = some.groupBy(key).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter(F.col("lo") != F.col("hi")).select(key, "lo")
    apart = some.join(F.broadcast(ends), key).select(key, doc, "pos", later)
    return grouped(windows.join(F.broadcast(hot), key, "left_anti")).unionByName(apart)


def one_in(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(SAMPLE)) == 0)


def repeated_spans(docs: DataFrame, base: int = BASE, hot: int = HOT) -> DataFrame:
    docs = id_and_text(docs).filter("doc_id is not null and text is not null and text != ''")
    hashed = docs.select(F.xxhash64("text").alias("th"), "doc_id", "text")
    texts = staged(_texts(hashed.select("th", "doc_id").distinct()), "texts")
    anchors = staged(arrow_map(hashed.select("th", "text"), _anchors(base), "g long, th long, pos int"), "anchors")
    words = anchors.filter("g is null").groupBy("th").agg(F.max("pos").alias("n"))
    cut = anchors.filter("g is not null")
    often = hot_keys(one_in(cut, "th"), "g", hot)
    places = _repeated(cut, "g", "th", often).groupBy("th").agg(F.collect_set("pos").alias("places"))
    firsts = texts.filter("doc_id = canon").select("th", "doc_id", "alt")
    wanted = staged(places.join(firsts, "th").select("doc_id", "th", "alt", "places"), "places")
    again = hashed.join(wanted, ["doc_id", "th"]).select("doc_id", "alt", "places", "text")
    longer = arrow_map(again, _windows(base), "h long, doc_id long, pos long")
    length, spans = 2 * base, None
    while True:
        # where an anchor is hot, windows can be
        often = often and hot_keys(one_in(longer, "doc_id"), "h", hot)
        level = staged(_repeated(longer, "h", "doc_id", often), "level")
        if spans is not None and level.isEmpty():
            break
        part = level.filter("later").select("doc_id", "pos", F.lit(length).alias("length"))
        spans = part if spans is None else spans.unionByName(part)
        after = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(length, length)
        longer = level.withColumn("h2", F.first("h").over(after)).filter("h2 is not null").select(F.xxhash64("h", "h2").alias("h"), "doc_id", "pos")
        length *= 2
    return _islands(spans, texts, words, 2 * base)


def _texts(pairs: DataFrame) -> DataFrame:
    """(th, doc_id) with canon, the first document of the text, and alt, the text's number among its document's."""
    canon = pairs.groupBy("th").agg(F.min("doc_id").alias("canon"))
    several = pairs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy("th")
    alt = pairs.join(several, "doc_id", "left_semi").select("th", "doc_id", (F.row_number().over(order) - 1).cast("long").alias("alt"))
    return pairs.join(canon, "th").join(alt, ["th", "doc_id"], "left").select("th", "doc_id", "canon", F.coalesce("alt", F.lit(0)).alias("alt"))


def _islands(windows: DataFrame, texts: DataFrame, words: DataFrame, shortest: int) -> DataFrame:
    """Windows that touch or overlap make one span; to them the copies of whole texts."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    spans = (
        windows.groupBy("doc_id", "pos").agg(F.max("length").alias("length"))
        .withColumn("new", F.when(F.col("pos") <= F.lag("pos").over(order) + shortest, 0).otherwise(1))
        .withColumn("k", F.sum("new").over(order))
        .groupBy("doc_id", "k").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("length").alias("longest"))
        .withColumn("alt", F.shiftrightunsigned("lo", 32))
    )
    place = lambda c: F.col(c).bitwiseAND((1 << 32) - 1).cast("int")
    spans = spans.join(texts.select("doc_id", "alt", "th"), ["doc_id", "alt"]).select("doc_id", F.col("th").alias("text_hash"), place("lo").alias("start_word"), (place("hi") + shortest).alias("end_word"), "longest")
    whole = texts.filter("doc_id != canon").join(words.filter(f"n >= {shortest}"), "th").select(
        "doc_id", F.col("th").alias("text_hash"), F.lit(0).alias("start_word"), F.col("n").cast("int").alias("end_word"),
        (shortest * F.pow(F.lit(2), F.floor(F.log2(F.col("n") / shortest)))).cast("int").alias("longest"),
    )
    return spans.unionByName(whole)


def _cut(spans_name: str, chars: str | None):
    """Cuts the spans out of each text; rows of which nothing is left go, rows without spans pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at_text, at_spans = batch.schema.get_field_index("text"), batch.schema.get_field_index(spans_name)
        spans = batch.column(at_spans).to_pylist()
        columns, names = list(batch.columns), batch.schema.names
        if any(spans):
            offsets, raw = buffers(batch.column(at_text))
            out, keep = batch.column(at_text).to_pylist(), np.ones(batch.num_rows, bool)
            for i, j in chunks(offsets):
                if not any(spans[i:j]):
                    continue
                w = Words(offsets, raw, i, j)
                for k in range(i, j):
                    if not spans[k]:
                        continue
                    f, n, base = w.first[k - i], w.first[k - i + 1] - w.first[k - i], int(offsets[i])
                    text, parts, at = bytes(raw[offsets[k] : offsets[k + 1]]), [], 0
                    for s in sorted(spans[k], key=lambda s: s["start_word"]):
                        a, b = s["start_word"], min(s["end_word"], n)
                        lo = int(w.starts[f + a]) + base - int(offsets[k])
                        hi = int(w.starts[f + b]) + base - int(offsets[k]) if b < n else len(text)
                        lo = 0 if a == 0 else lo
                        parts.append(text[at:lo])
                        at = max(at, hi)
                    out[k] = b"".join([*parts, text[at:]]).decode("utf-8", "ignore")
                    keep[k] = bool(out[k].strip())
            columns[at_text] = pa.array(out, columns[at_text].type)
            if chars:
                at = batch.schema.get_field_index(chars)
                hit = pa.array([bool(s) for s in spans])
                columns[at] = pc.if_else(hit, pc.utf8_length(columns[at_text]).cast(columns[at].type), columns[at])
            batch = pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))
        left = [n for k, n in enumerate(names) if k != at_spans]
        return pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at_spans], left)

    return run


def drop_repeats(docs: DataFrame, base: int = BASE) -> DataFrame:
    """``docs`` with every repeat but the first cut out of the texts; a document of which nothing is left goes.

    n_chars, where it is a column, follows the text. Rows without spans, with a null doc_id or a null text stay
    as they are. Of several texts under one doc_id each is cut by its own spans."""
    spans = repeated_spans(docs, base).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    name = fresh(docs, "spans")
    key = (docs["doc_id"].cast("long") == spans["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == spans["text_hash"])
    both = docs.join(spans, key, "left").select(*[docs[c] for c in docs.columns], spans["spans"].alias(name))
    return arrow_map(both, _cut(name, "n_chars" if "n_chars" in docs.columns else None), docs.schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQL: dict[str, str] = {}
