"""Exact semantic search as a plan: score, best window of each document, top k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.vectors import dot, literal


def scored(vectors: DataFrame, vector: Column, query: Column) -> DataFrame:
    """vectors with `score`; NaN becomes -inf, since it never beats another score."""
    return vectors.withColumn("score", F.nanvl(dot(vector, query), F.lit(float("-inf"))))


def best_per_group(rows: DataFrame, keys: Sequence[str], payload: Sequence[str], order: str) -> DataFrame:
    """For each group the row of the highest score, of equal ones that of the lowest `order`; partial aggregation leaves one row of a group per task."""
    best = F.max_by(F.struct(*payload, "score"), F.struct(F.col("score"), -F.col(order)))
    out = rows.groupBy(*keys).agg(best.alias("best"))
    return out.select(*keys, *[F.col(f"best.{c}").alias(c) for c in payload], F.col("best.score").alias("score"))


def top_k(rows: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k highest scores with their rank; ties in order of the given columns."""
    if k < 0:
        raise ValueError("limit must not be negative")
    order = [F.desc("score"), *ties]
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Bytes of query vectors, and of what is kept for them, that travel to the workers in one pass over the rows.
PASS_BYTES = 16 << 20
#: Rows and queries that are compared at a time, and values of a slice's vectors; a worker holds one table of scores of that size, whatever the batches and queries.
SLICE_ROWS, BLOCK_QUERIES, SLICE_VALUES = 4096, 512, 1 << 21


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length; null elements become NaN."""
    size = np.diff(np.asarray(column.offsets))
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.astype(np.float64).reshape(len(rows), n)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to SLICE_ROWS rows and SLICE_VALUES values, one row at least."""
    for b in batches:
        ends, at = np.asarray(b.column("vector").offsets).astype(np.int64), 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + SLICE_VALUES, "right")) - 1
            stop = min(max(stop, at + 1), at + SLICE_ROWS, b.num_rows)
            yield b.slice(at, stop - at)
            at = stop


def _blocks(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers and matrix of n queries, in blocks of one length; those of length 0 are in no part."""
    empty = np.setdiff1d(np.arange(n), np.concatenate([np.empty(0, np.int64), *(own for own, _ in parts)]))
    each = [*parts, (empty, np.empty((len(empty), 0)))]
    return [(own[k : k + BLOCK_QUERIES], q[k : k + BLOCK_QUERIES]) for own, q in each for k in range(0, len(own), BLOCK_QUERIES)]


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class _Scores:
    """Inner products of a slice's vectors with blocks of queries, by the rules of dot() and scored().

    near() multiplies matrices, which adds in an order that depends on their shapes; what it can't decide is settled by exact(),
    which adds from left to right as dot() does, so that equal vectors have equal scores wherever they stand.
    """

    def __init__(self, column: pa.Array):
        self.size, self.of = len(column), {}
        for rows, x in _by_length(column):
            place = np.full(self.size, -1)
            place[rows] = np.arange(len(rows))
            with np.errstate(all="ignore"):
                norm = _norm(x)
            sound = np.isfinite(norm)
            self.of[x.shape[1]] = rows, x, place, rows[~sound], norm[sound].max(initial=0.0)

    def near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, how far each query's may be off (inf where that is unknown), and the rows whose scores mean nothing, which have -inf."""
        out, off = np.zeros((len(q), self.size)), np.zeros((len(q), 1))
        if q.shape[1] not in self.of:
            return out, off, np.empty(0, np.int64)
        rows, x, _, unsound, norm = self.of[q.shape[1]]
        with np.errstate(all="ignore"):
            if len(rows) == self.size:
                np.matmul(q, x.T, out=out)
            else:
                out[:, rows] = q @ x.T
            off = (2 * q.shape[1] * np.finfo(float).eps * norm * _norm(q) + np.finfo(float).tiny)[:, None]
        out[np.isnan(out)] = -np.inf
        out[:, unsound] = -np.inf
        return out, np.where(np.isfinite(off), off, np.inf), unsound

    def exact(self, q: np.ndarray, at: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a row."""
        out = np.zeros(len(at))
        if q.shape[1] in self.of:
            _, x, place, _, _ = self.of[q.shape[1]]
            same = np.flatnonzero(place[col] >= 0)
            at, row, sums = at[same], place[col[same]], np.zeros(len(same))
            with np.errstate(all="ignore"):
                for k in range(q.shape[1]):
                    sums += q[at, k] * x[row, k]
            out[same] = np.where(np.isnan(sums), -np.inf, sums)
        return out


def _least(limit: np.ndarray, off: np.ndarray) -> np.ndarray:
    """limit - off, -inf where either is unknown."""
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(limit - off, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _best(s: np.ndarray, other: np.ndarray, keys: np.ndarray, q: np.ndarray, rows: _Scores, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each query in order, with their keys: of those so far and a slice's."""
    score, off, unsound = rows.near(q)
    kept, width = s.shape[1], rows.size
    limit = np.full((len(q), 1), -np.inf)
    if kept == k:
        limit = _least(s[:, -1:], off)
    elif width > k:
        limit = _least(np.partition(score, width - k, axis=1)[:, width - k, None], 2 * off)
    near = score >= limit
    near[:, unsound] = True
    at, col = np.nonzero(near)
    new, key = rows.exact(q, at, col), keys[col]
    if kept == k:
        better = (new > s[at, -1]) | ((new == s[at, -1]) & (key < other[at, -1]))
        at, new, key = at[better], new[better], key[better]
        if not len(at):
            return s, other
    at = np.concatenate([np.repeat(np.arange(len(q)), kept), at])
    new, key = np.concatenate([s.ravel(), new]), np.concatenate([other.ravel(), key])
    order = np.lexsort((key, -new, at))
    at, new, key = at[order], new[order], key[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return new[keep].reshape(len(q), -1), key[keep].reshape(len(q), -1)


def _each_pass(queries: DataFrame, key: str, vector: str, kept: int = 0) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Keys and vectors of the queries with a vector, in passes of about PASS_BYTES with what is kept for each, so that what travels is bounded however many there are."""
    known = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    total = known.agg(F.sum(F.size("vector").cast("long") * 8 + 8 + kept)).first()[0] or 0
    parts = max(1, -(-total // PASS_BYTES))
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow().combine_chunks()
        if len(own):
            yield own.column("key").to_numpy(), list(_by_length(own.column("vector").combine_chunks()))


def search_each(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each of the queries the k rows of highest inner product, ties in order of the key, which is a number.

    The rows stay where they are; the queries travel to them in passes of PASS_BYTES, and each task keeps k rows of a query,
    so what is shuffled grows with queries and tasks, not with the rows. A worker compares BLOCK_QUERIES queries with SLICE_ROWS
    rows at a time. Null vectors are left out on both sides.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    out = None
    for ids, parts in _each_pass(queries, key, vector, 16 * max(k, 0)):
        sent = vectors.sparkSession.sparkContext.broadcast((ids, parts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, parts = sent.value
            blocks = _blocks(len(ids), parts) if k > 0 else []
            best = [(np.empty((len(own), 0)), np.empty((len(own), 0), np.int64)) for own, _ in blocks]
            for b in _slices(batches):
                keys, own = b.column("key").to_numpy(), _Scores(b.column("vector"))
                best = [_best(s, other, keys, q, own, k) for (s, other), (_, q) in zip(best, blocks)]
            for (own, _), (s, other) in zip(blocks, best):
                yield pa.record_batch([pa.array(np.repeat(ids[own], s.shape[1])), pa.array(other.ravel()), pa.array(s.ravel())], ["query_id", key, "score"])

        found = rows.mapInArrow(run, f"query_id long, `{key}` long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _links(ids: np.ndarray, keys: np.ndarray, q: np.ndarray, rows: _Scores, least: float) -> np.ndarray:
    """How many rows of other keys reach `least` with each query."""
    score, off, unsound = rows.near(q)
    near, sure = score >= _least(np.float64(least), off), score > -_least(np.float64(-least), off)
    near[:, unsound], sure[:, unsound] = True, False
    at, col = np.nonzero(near & ~sure)
    sure[at, col] = rows.exact(q, at, col) >= least
    return (sure & (ids[:, None] != keys[None, :])).sum(axis=1)


def count_near(vectors: DataFrame, queries: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, links): for each of the queries, how many other rows have an inner product of at least `least` with it."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    out = vectors.sparkSession.createDataFrame([], "query_id long, links long")
    for ids, parts in _each_pass(queries, key, vector):
        sent = vectors.sparkSession.sparkContext.broadcast((ids, parts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, parts = sent.value
            links, blocks = np.zeros(len(ids), np.int64), _blocks(len(ids), parts)
            for b in _slices(batches):
                keys, rows = b.column("key").to_numpy(), _Scores(b.column("vector"))
                for own, q in blocks:
                    links[own] += _links(ids[own], keys, q, rows, least)
            yield pa.record_batch([pa.array(ids), pa.array(links)], ["query_id", "links"])

        out = out.unionByName(rows.mapInArrow(run, "query_id long, links long"))
    return out.groupBy("query_id").agg(F.sum("links").alias("links"))


def _highest(q: np.ndarray, rows: _Scores) -> np.ndarray:
    """Each row's highest score with any of the queries."""
    score, off, unsound = rows.near(q)
    near = score >= _least(score.max(axis=0), off + off.max())
    near[:, unsound] = True
    out = np.full(rows.size, -np.inf)
    at, col = np.nonzero(near)
    np.maximum.at(out, col, rows.exact(q, at, col))
    return out


def best_pairs(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(path, score): the highest inner product of each document's vectors with any of own(vector)."""
    known = rows.select("path", F.col("vector").cast("array<double>").alias("vector"))
    out = rows.sparkSession.createDataFrame([], "path string, score double")
    for ids, parts in _each_pass(own.withColumn("key", F.xxhash64("vector")), "key", "vector"):
        sent = rows.sparkSession.sparkContext.broadcast((len(ids), parts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            n, parts = sent.value
            blocks = _blocks(n, parts)
            for b in _slices(batches):
                rows = _Scores(b.column("vector"))
                yield pa.record_batch([b.column("path"), pa.array(reduce(np.maximum, (_highest(q, rows) for _, q in blocks)))], ["path", "score"])

        out = out.unionByName(known.mapInArrow(run, "path string, score double"))
    return out.groupBy("path").agg(F.max("score").alias("score"))


def search(documents: DataFrame, chunks: DataFrame, query: Sequence[float], limit: int = 10, roots: Sequence[str] = (), spaces: Sequence[str] = ("text",)) -> DataFrame:
    """(rank, path, title, source_root, heading_path, text, score): the documents whose best window is nearest to the query.

    Texts stay out of scoring and aggregation, and are fetched for the hits alone. No roots means all.
    """
    own = documents.select("path", "title", "source_root")
    if roots:
        own = own.where(F.col("source_root").isin(*roots))
    vectors = chunks.where(F.col("space").isin(*spaces) & F.col("vector").isNotNull()).select("path", "ord", "vector")
    rows = scored(vectors, F.col("vector"), literal(query)).select("path", "ord", "score")
    if roots:
        rows = rows.join(own.select("path"), "path", "left_semi")
    hits = top_k(best_per_group(rows, ["path"], ["ord"], "ord"), limit, "path")
    texts = chunks.where(F.col("space").isin(*spaces)).select("path", "ord", "heading_path", "text")
    full = F.broadcast(hits).join(own, "path").join(texts, ["path", "ord"])
    shown = lambda c: F.when(F.col("score") == float("-inf"), "").otherwise(F.coalesce(c, F.lit(""))).alias(c)
    return full.select("rank", "path", "title", "source_root", shown("heading_path"), shown("text"), F.col("score").cast("float").alias("score")).orderBy("rank")


def related(documents: DataFrame, chunks: DataFrame, links: DataFrame, path: str, limit: int = 10, include_linked: bool = False) -> DataFrame:
    """(rank, path, title, score): documents by the best pair of windows with the note at `path`, without those that it links to by stem or path."""
    text = chunks.where("space = 'text' AND vector IS NOT NULL").select("path", "ord", "vector")
    rows = best_pairs(text.where(F.col("path") != path), text.where(F.col("path") == path).select("vector"))
    rows = rows.join(documents.select("path", "title"), "path")
    if not include_linked:
        # What a link can name a note by: its stem, and each end of its path that begins behind a slash, without `.md`.
        steps = F.split(F.lower("path"), "/")
        ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.regexp_extract(F.array_join(F.slice(steps, k, F.size(steps)), "/"), r"^(.*)\.md$", 1))
        names = F.array_append(F.slice(ends, 2, F.size(ends)), F.lower(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)))
        targets = links.where(F.col("src_path") == path).select(F.lower("dst").alias("name")).distinct()
        linked = rows.select("path", F.explode(names).alias("name")).join(targets, "name", "left_semi").select("path")
        rows = rows.join(linked, "path", "left_anti")
    return top_k(rows, limit, "path").select("rank", "path", "title", F.col("score").cast("float").alias("score")).orderBy("rank")
