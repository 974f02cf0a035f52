"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_map, bounded_batches, frugal, gram_hashes, load_spread, materialize, mix64, restricted, shingles, text_slices, without, word_hashes
from inkwell.llm.components import components

SHINGLE = 2
THRESHOLD = 0.6
BANDS, ROWS = 40, 5
DOMAIN = 1 << 22
#: Documents of each open bucket that are compared with the rest of it in one round.
HUBS = 64


@lru_cache(maxsize=1)
def _circle(width: int) -> np.ndarray:
    """The second permutation of DOMAIN, laid out so that its `width` circular shifts at x are the row at x."""
    pi = np.random.default_rng(11).permutation(DOMAIN).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)


def signature(grams: np.ndarray, width: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is min over the set of pi(sigma(x) + k mod DOMAIN): two permutations give all coordinates.

    sigma is the hash's bijective mix folded to the domain, pi a random permutation of it.
    """
    rows, out = _circle(width), None
    at = (mix64(grams ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(DOMAIN)).astype(np.int64)
    for k in range(0, len(at), 2048):
        low = rows[at[k : k + 2048]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        words, bounds = word_hashes(part.column("text"))
        grams, ids, signatures = gram_hashes(words, SHINGLE), [], []
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b > a:
                ids.append(k)
                signatures.append(signature(grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else gram_hashes(words[a:b], int(b - a))))
        if ids:
            s = np.stack(signatures).astype(np.uint64).reshape(len(ids), BANDS, ROWS)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
            for r in range(ROWS):
                h = mix64(h + s[:, :, r] * np.uint64(0xD6E8FEB86659FD93))
            flat = pa.array(h.astype(np.int64, casting="unsafe").ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
            yield pa.record_batch([part.column("doc_id").take(pa.array(ids)), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "bands"])


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices([batch], "text_a"):
            for cut in text_slices([part], "text_b"):
                sims = []
                for x, y in zip(shingles(cut.column("text_a"), SHINGLE), shingles(cut.column("text_b"), SHINGLE)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    sims.append(both / max(1, len(x) + len(y) - both))
                yield pa.record_batch([cut.column("a"), cut.column("b"), pa.array(sims, pa.float64())], ["a", "b", "jaccard"])


def verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of which the exact Jaccard similarity of the shingle sets reaches the threshold."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "verify-ids")
    texts = restricted(docs.select("doc_id", "text").where("text IS NOT NULL"), ids)
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    bounded_batches(docs.sparkSession)
    return both.mapInArrow(frugal(_jaccard), "a long, b long, jaccard double").where(F.col("jaccard") >= threshold)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, n_members, keep): one row for each document of a group of two or more near copies.

    Groups are the connected components of pairs with exact Jaccard similarity >= threshold over the sets of word
    bigrams; group_id is the smallest doc_id and the one to keep. 40 bands of 5 rows find a pair of similarity 0.6 with
    probability 0.96, of 0.7 with 0.999, and any chain of pairs joins a group.

    Pairs are compared in rounds, each linear in the rows of the buckets. In the first, each document is verified against one, the smallest that shares a
    bucket with it; that joins large groups. Buckets whose documents are not all in one component stay open: in
    each further round HUBS documents of each open bucket are verified against all those of other components in it and then leave
    the bucket, until no bucket is open or all pairs left are at most HUBS for each row and are verified at once. A pair within one component cannot change the result, so nothing is left out. No
    task gathers a bucket: its ends are aggregated before they are shuffled, and its rows only stream by.

    Ids must be numeric. Null doc_id or text and texts without words are never grouped; texts of any length count whole. Rows that repeat a doc_id are one document, similar
    where any of its texts is. Further columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = arrow_map(source.where("doc_id IS NOT NULL AND text IS NOT NULL"), ["doc_id", "text"], _bands, "doc_id long, bands array<long>")
    rows = materialize(signed, "signatures").select("doc_id", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub <> top").select("bucket", "hub")
    members = materialize(rows.join(hubs, "bucket").select("bucket", "doc_id", "hub"), "members")

    tried = materialize(members.where("doc_id <> hub").groupBy(F.col("doc_id").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"), "hub-pairs")
    edges = materialize(verified(source, tried, threshold), "hub-edges").select("a", "b")
    comp = materialize(components(edges), "hub-components")
    edges = comp.select(F.col("comp").alias("a"), F.col("doc_id").alias("b"))

    open_ = _open(members.join(comp, "doc_id", "left").select("bucket", "doc_id", F.coalesce("comp", "doc_id").alias("comp")))
    found = texts = None
    while size := _sizes(open_):
        if texts is None:
            texts = materialize(restricted(source.where("text IS NOT NULL"), materialize(open_.select("doc_id").distinct(), "open-ids")), "open-texts")
        order = Window.partitionBy("bucket").orderBy("doc_id")
        turn = open_.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= HUBS).drop("turn")
        turn = open_ if size[1] <= HUBS * size[0] else materialize(turn, "hubs")
        x, y = open_.alias("x"), turn.alias("y")
        pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")))
        pairs = pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "open-pairs")
        tried = tried.unionByName(pairs)
        new = materialize(verified(texts, pairs, threshold), "open-edges").select("a", "b")
        found = new if found is None else found.unionByName(new)
        if turn is open_:
            break
        rest = open_.join(turn, ["bucket", "doc_id"], "left_anti")
        if new.take(1):
            at = open_.select("doc_id", "comp").distinct()
            links = new.join(at.toDF("a", "comp_a"), "a").join(at.toDF("b", "comp_b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
            joined = components(links).select(F.col("doc_id").alias("comp"), F.col("comp").alias("least"))
            rest = rest.join(joined, "comp", "left").select("bucket", "doc_id", F.coalesce("least", "comp").alias("comp"))
        open_ = _open(rest)
    groups = materialize(components(edges.unionByName(found)), "components") if found is not None else comp
    size = groups.groupBy("comp").agg(F.count("*").alias("n_members"))
    return groups.join(size, "comp").select("doc_id", F.col("comp").alias("group_id"), "n_members", (F.col("doc_id") == F.col("comp")).alias("keep"))


def _sizes(open_: DataFrame) -> tuple[int, int] | None:
    """How many rows open buckets have, and how many pairs of different components; None without any."""
    counts = open_.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("own"))
    rows, pairs = counts.agg(F.sum("n"), F.sum((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2)).first()
    return (rows, pairs) if rows else None


def _open(placed: DataFrame) -> DataFrame:
    """The distinct rows (bucket, doc_id, comp) of buckets with more than one component, written once."""
    placed = materialize(placed.distinct(), "placed")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    return materialize(placed.join(several, "bucket", "left_semi"), "open")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that near_duplicates() marks; ungrouped rows, null ids among them, stay."""
    return without(docs, near_duplicates(docs, threshold).where("NOT keep"))


def op2_near_duplicates(spark, sf_dir):
    return near_duplicates(load_spread(spark, sf_dir, "documents", "doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                                      WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.6),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id WHERE r.root < u.b),
g AS (SELECT doc_id, min(root) AS group_id FROM r GROUP BY doc_id)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS n_members, doc_id = group_id AS keep FROM g
"""
