"""Passages that repeat across documents, by bucket-pointer refinement of suffix buckets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_map, bounded_batches, frugal, gram_hashes, load_spread, materialize, restricted, span_hashes, text_slices, utf8, word_hashes, word_spans

MIN_WORDS = 50
Q = 8
CHUNK_BYTES = 1 << 20
#: A bucket of more anchors than this is sorted in parts of about as many, and its windows are then compared across parts.
PART = 20_000


def anchors(grams: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Positions of the least Q-gram (the leftmost, if several) of every window of min_words words within a text.

    A window's anchor depends on its content alone, so equal windows have equal anchors at equal offsets.
    """
    w = min_words - Q + 1
    if len(grams) < w:
        return np.empty(0, np.int64)
    least = np.concatenate([_least(grams[k : k + _PIECE + w - 1], w) + k for k in range(0, len(grams) - w + 1, _PIECE)])
    text = np.searchsorted(bounds, np.arange(len(least)), "right")
    whole = np.arange(len(least)) + min_words <= bounds[np.minimum(text, len(bounds) - 1)]
    return np.unique(least[whole])


_PIECE = 1 << 22


def _least(grams: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w consecutive grams: 40 bits of it, packed over its place, by minima to and from the ends of blocks of w."""
    packed = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(packed) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(packed) - w + 1], ahead[w - 1 : len(packed)])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        words, bounds = word_hashes(part.column("text"))
        grams = gram_hashes(words, Q)
        at = anchors(grams, bounds)
        row = np.searchsorted(bounds, at, "right") - 1
        owner = [part.column(c).take(pa.array(row)) for c in ("doc_id", "copy")]
        yield pa.record_batch([*owner, pa.array(grams[at].view(np.int64)), pa.array((at - bounds[row]).astype(np.int32))], ["doc_id", "copy", "bucket", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For each anchor of a bucket that several documents share, the words that its windows span."""
    for part in text_slices(batches):
        data, offsets = utf8(pc.utf8_lower(part.column("text").cast(pa.large_string())))
        starts, ends, bounds = word_spans(data, offsets)
        ids, buckets, parts, firsts, texts = [], [], [], [], []
        raw = data.tobytes()
        for row, (doc, marks) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("anchors").to_pylist())):
            a, b = int(bounds[row]), int(bounds[row + 1])
            for mark in marks:
                low, high = max(a, a + mark["pos"] - (MIN_WORDS - Q)), min(b, a + mark["pos"] + MIN_WORDS)
                if high - low >= MIN_WORDS:
                    ids.append(doc)
                    buckets.append(mark["bucket"])
                    parts.append(hash((doc, mark["pos"])) % -(-mark["n"] // most) if mark["n"] > most else -1)
                    firsts.append(low - a)
                    texts.append(raw[starts[low] : ends[high - 1]])
        columns = [pa.array(buckets, pa.int64()), pa.array(parts, pa.int32()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.record_batch(columns, ["bucket", "part", "doc_id", "first", "text"])


def refine(words: np.ndarray, bounds: np.ndarray, depth: int = MIN_WORDS) -> np.ndarray:
    """Bucket pointers of all suffixes by their first `depth` words; only those of starts with depth words left in their text are final.

    Initial buckets are the Q-grams. A bucket is then refined by sorting its suffixes on the bucket pointers at the
    offset that it is sorted to; pointers are updated at once, so the next round reads buckets twice as deep. Single
    suffixes are done and take no part again.
    """
    n = len(words)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    pointer = np.arange(n, dtype=np.int64) + n
    at = np.flatnonzero(room >= Q)
    grams = gram_hashes(words, Q)[at] if len(at) else np.empty(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    at, grams = at[order], grams[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(at) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    pointer[at] = np.flatnonzero(new)[group] if len(at) else at
    size = np.bincount(group) if len(at) else group
    at = at[size[group] > 1] if len(at) else at
    done = Q
    while done < depth and len(at):
        step = min(done, depth - done)
        at = at[room[at] >= done + step]
        own, later = pointer[at], pointer[at + step]
        order = np.lexsort((later, own))
        at, own, later = at[order], own[order], later[order]
        if not len(at):
            break
        fresh = np.concatenate([[True], own[1:] != own[:-1]])
        new = fresh | np.concatenate([[True], later[1:] != later[:-1]])
        place = np.arange(len(at))
        pointer[at] = own + (np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(fresh, place, 0)))
        group = np.cumsum(new) - 1
        at = at[np.bincount(group)[group] > 1]
        done += step
    return pointer


def classes(words: np.ndarray, bounds: np.ndarray, docs: np.ndarray, depth: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of `depth` words in order of their content, bounds of equal ones, and which of these groups have two or more document ids."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
    at = np.flatnonzero(room >= depth)
    if not len(at):
        return at, np.zeros(1, np.int64), np.empty(0, bool)
    pointer = refine(words, bounds, depth)[at]
    owner = np.repeat(docs, np.diff(bounds))[at]
    order = np.lexsort((owner, pointer))
    pointer, owner, at = pointer[order], owner[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], pointer[1:] != pointer[:-1], [True]]))
    return at, edge, owner[edge[:-1]] != owner[edge[1:] - 1]


def repeats(words: np.ndarray, bounds: np.ndarray, docs: np.ndarray, depth: int = MIN_WORDS) -> np.ndarray:
    """Starts of the windows of `depth` words that occur under two or more document ids."""
    at, edge, shared = classes(words, bounds, docs, depth)
    return np.sort(at[np.repeat(shared, np.diff(edge))])


_OUT = ["doc_id", "start", "stop", "h1", "h2"]


def _spans(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows in each context. Rows come sorted by bucket and part; a chunk ends where a part does.

    Windows of a bucket in parts also give rows with a 128-bit hash: for each group of equal ones under several documents its
    least and its greatest document, which stand for the chunk, so that any document elsewhere meets another than itself;
    where the chunk has them under one document only, one row for each.
    """

    def chunk(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        data, offsets = utf8(table.column("text").combine_chunks())
        starts, ends, bounds = word_spans(data, offsets)
        docs, first, part = (table.column(c).to_numpy() for c in ("doc_id", "first", "part"))
        words = span_hashes(data, starts, ends)
        at, edge, shared = classes(words, bounds, docs)
        place = lambda x: (r := np.searchsorted(bounds, x, "right") - 1, first[r] + x - bounds[r])
        split = np.flatnonzero(part[place(at)[0]] >= 0) if (part >= 0).any() else np.empty(0, np.int64)
        if len(split):
            group = np.repeat(np.arange(len(shared)), np.diff(edge))
            met = np.unique(group[split])
            met = met[shared[met]]
            alone = split[~shared[group[split]]]
            chosen = at[np.concatenate([edge[met], edge[met + 1] - 1, alone])]
            row, start = place(chosen)
            single = np.arange(len(chosen)) >= 2 * len(met)
            h1, h2 = (gram_hashes(w, MIN_WORDS)[chosen].view(np.int64) for w in (words, words * np.uint64(0x9E3779B97F4A7C15) ^ (words >> np.uint64(29))))
            yield pa.record_batch([pa.array(docs[row]), pa.array(start.astype(np.int64), mask=~single), pa.array(start.astype(np.int64) + MIN_WORDS), pa.array(h1), pa.array(h2)], _OUT)
        at = np.sort(at[np.repeat(shared, np.diff(edge))])
        if len(at):
            row = place(at)[0]
            head = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0)])
            begin, end = at[head], at[np.concatenate([head[1:], [True]])]
            (row, low), high = place(begin), place(end)[1] + MIN_WORDS
            none = pa.nulls(len(row), pa.int64())
            yield pa.record_batch([pa.array(docs[row]), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64)), none, none], _OUT)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in text_slices(batches, limit=max(1, chunk_bytes // 4)):
        if size >= chunk_bytes:
            last = held[-1].slice(held[-1].num_rows - 1)
            same = np.logical_and.reduce([batch.column(c).to_numpy() == last.column(c)[0].as_py() for c in ("bucket", "part")])
            cut = int(np.argmin(same)) if not same.all() else len(same)
            if cut < len(same):
                yield from chunk([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from chunk(held)


def repeated_passages(docs: DataFrame, part: int = PART, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, start_word, n_words): maximal spans covered by windows of 50 words that also occur in another document.

    Words are lower-cased runs of letters and digits, counted from 0. Every window of 50 words is compared: windows are
    brought together by their anchor (anchors()), a Q-gram that depends on the window alone, and the suffixes of the
    words around the anchors of a shared bucket are sorted to 50 words by bucket-pointer refinement (refine()). A bucket of
    more than `part` anchors is sorted in parts, whose windows meet by hash afterwards, so that no task grows with a passage's
    copies. All occurrences are reported, the first among them; spans that overlap or touch are joined.

    Rows with null doc_id or text are left out; texts under 50 words have no window; a passage that only repeats within
    one doc_id, repeated rows of it included, is not reported, and spans of rows that share a doc_id are joined. Ids must be numeric,
    texts may be of any length. Further columns are ignored; an empty table gives an empty result. Buckets and hashes are counted before they are
    shuffled, then joined back, so that no task gathers the anchors of a passage that all documents share.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = arrow_map(source, ["doc_id", "copy", "text"], _anchored, "doc_id long, copy long, bucket long, pos int")
    found = materialize(found, "found")
    met = found.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low <> high").select("bucket", "n")
    shared = found.join(met, "bucket").groupBy("doc_id", "copy")
    marked = materialize(shared.agg(F.collect_set(F.struct("bucket", "pos", "n")).alias("anchors")), "anchors")
    texts = restricted(source, materialize(marked.select("doc_id").distinct(), "marked"))
    bounded_batches(docs.sparkSession)
    around = texts.join(marked, ["doc_id", "copy"]).select("doc_id", "text", "anchors").mapInArrow(frugal(partial(_contexts, most=part)), "bucket long, part int, doc_id long, first int, text string")
    sorted_ = around.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    found = materialize(sorted_.mapInArrow(frugal(partial(_spans, chunk_bytes=chunk_bytes)), "doc_id long, start long, stop long, h1 long, h2 long"), "spans")
    hashed = found.where("h1 IS NOT NULL")
    several = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("h1", "h2")
    across = hashed.where("start IS NOT NULL").join(several, ["h1", "h2"], "left_semi")
    spans = found.where("h1 IS NULL").select("doc_id", "start", "stop").unionByName(across.select("doc_id", "start", "stop")).distinct()
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.withColumn("head", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("part", F.sum("head").over(order))
    return joined.groupBy("doc_id", "part").agg(F.min("start").alias("start_word"), (F.max("stop") - F.min("start")).alias("n_words")).select("doc_id", "start_word", "n_words")


def op9_repeated_passages(spark, sf_dir):
    return repeated_passages(load_spread(spark, sf_dir, "documents", "doc_id", "text"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS p FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, p, sha256(array_to_string(ws[p + 1 : p + 50], ' ')) AS h FROM s),
r AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
t AS (SELECT DISTINCT doc_id, p FROM g WHERE h IN (SELECT h FROM r)),
i AS (SELECT doc_id, p, CASE WHEN p <= 50 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) THEN 0 ELSE 1 END AS head FROM t),
k AS (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS part FROM i)
SELECT doc_id, min(p) AS start_word, max(p) + 50 - min(p) AS n_words FROM k GROUP BY doc_id, part
"""
