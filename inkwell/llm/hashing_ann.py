"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes, reranked by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_map, load, materialize, sized

ROTATIONS = 2
ITERATIONS = 8
#: Rotations and mean are fitted on as many vectors, those of smallest hash of id.
FIT_SAMPLE = 32_768
CALIBRATION = 256
COVERED = 0.97
#: Bits of a substring in the index of a block.
SUBSTRING_BITS = 16
BLOCK = 1 << 16
#: A bucket of the joined index with more rows is left to the search by blocks, and so are all queries that probe it.
HOT = 4096
#: Bytes of query vectors that travel to the workers in one pass.
PASS_BYTES = 16 << 20


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dims)


def unit_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v): unit vectors of the table's most frequent length, one of each id, the least where an id has several; null,
    zero, other-sized and non-finite ones are left out."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = sizes["n"] if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            good = np.isfinite(norm) & (norm > 0)
            x = (x[good] / norm[good, None]).astype(np.float32)
            yield pa.record_batch([b.column("vec_id").filter(pa.array(good)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.float32()))], ["vec_id", "v"])

    if not dims:
        return rows.where("false"), 0
    unit = materialize(arrow_map(rows.where(F.size("v") == dims), ["vec_id", "v"], run, "vec_id long, v array<float>"), "vectors")
    # Only the rows of ids that repeat are shuffled with their vectors.
    some, others = _split(unit, F.col("vec_id"), 1)
    return unit if some is None else materialize(others.unionByName(some.groupBy("vec_id").agg(F.min("v").alias("v"))), "vectors"), dims


def _split(rows: DataFrame, key: Column, most: int) -> tuple[DataFrame | None, DataFrame]:
    """The rows whose key more than `most` rows have, None if there are none; and the others."""
    keyed = rows.withColumn("_key", key)
    many = materialize(keyed.groupBy("_key").count().where(F.col("count") > most).select("_key"), "many")
    n = many.count()
    if not n:
        return None, rows
    return tuple(keyed.join(sized(many, n), "_key", how).drop("_key") for how in ("left_semi", "left_anti"))


def sampled(vectors: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the n rows of smallest hash of id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toArrow().combine_chunks()
    return rows.column("vec_id").to_numpy(), np.stack(rows.column("v").to_numpy()).astype(np.float32)


def learn_rotations(x: np.ndarray, rotations: int = ROTATIONS, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and `rotations` matrices that bring the centred vectors near their own signs (iterative quantisation)."""
    x = x.astype(np.float64)
    mean = x.mean(axis=0)
    x -= mean
    rng = np.random.default_rng(7)
    r = np.stack([np.linalg.qr(rng.normal(size=(x.shape[1],) * 2))[0] for _ in range(rotations)])
    for k in range(rotations):
        for _ in range(iterations):
            u, _, vt = np.linalg.svd(np.where(x @ r[k] > 0, 1.0, -1.0).T @ x)
            r[k] = vt.T @ u.T
    return mean, r


def packed(x: np.ndarray, mean: np.ndarray, rotations: np.ndarray, width: int) -> np.ndarray:
    """Bytes of the rotated sign codes, filled with zeros to a multiple of `width` bits."""
    bits = np.concatenate([(x - mean) @ m > 0 for m in rotations], axis=1)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % width))), axis=1)


def codes(x: np.ndarray, mean: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Substrings of SUBSTRING_BITS bits of the rotated sign code, shape (rows, substrings)."""
    return packed(x, mean, rotations, SUBSTRING_BITS).reshape(len(x), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)


class Index:
    """Multi-index over a block of codes: for each substring, rows by its value."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.columns = [np.ascontiguousarray(c) for c in code.T]
        self.order = [np.argsort(c, kind="stable") for c in code.T]
        self.values = [np.unique(c[o], return_index=True) for c, o in zip(code.T, self.order)]
        self.masks: dict[int, np.ndarray] = {}

    def _masks(self, radius: int) -> np.ndarray:
        if radius not in self.masks:
            self.masks[radius] = np.array([sum(1 << b for b in bits) for d in range(radius + 1) for bits in combinations(range(SUBSTRING_BITS), d)], np.uint16)
        return self.masks[radius]

    def within(self, queries: np.ndarray, radius: int) -> list[np.ndarray]:
        """For each query code the rows of all codes within the Hamming radius.

        Pigeonhole: with m substrings and radius = m*a + b, a code within it is within a of the query in one of the first
        b+1 substrings, or within a-1 in one of the others. Buckets are probed by value while there are fewer values to
        probe than buckets; else the query's substring is compared with that of every code. Both find the same rows.
        """
        m = self.code.shape[1]
        a, b = divmod(radius, m)
        limits = [a if j <= b else a - 1 for j in range(m)]
        if all(near < 0 or near <= 3 and len(self._masks(near)) < len(self.values[j][0]) for j, near in enumerate(limits)):
            return [self._probed(q, limits, radius) for q in queries]
        out = []
        for k in range(0, len(queries), 64):
            part = queries[k : k + 64]
            hit, total = np.zeros((len(part), len(self.code)), bool), np.zeros((len(part), len(self.code)), np.uint8 if m * SUBSTRING_BITS < 256 else np.uint16)
            for j, near in enumerate(limits):
                d = np.bitwise_count(part[:, j, None] ^ self.columns[j])
                total += d
                if near >= 0:
                    hit |= d <= near
            hit &= total <= radius
            out += [np.flatnonzero(h) for h in hit]
        return out

    def _probed(self, query: np.ndarray, limits: list[int], radius: int) -> np.ndarray:
        found = [np.empty(0, np.int64)]
        for j, near in enumerate(limits):
            if near >= 0:
                values, starts = self.values[j]
                probes = query[j] ^ self._masks(near)
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                at = at[values[at] == probes]
                ends = np.append(starts[1:], len(self.code))
                found += [self.order[j][starts[k] : ends[k]] for k in at]
        rows = np.unique(np.concatenate(found))
        return rows[np.bitwise_count(self.code[rows] ^ query).sum(axis=1) <= radius]


def calibrate(vectors: DataFrame, own: np.ndarray, x: np.ndarray, k: int, mean: np.ndarray, rotations: np.ndarray) -> tuple[int, float]:
    """The radius that holds the share COVERED of the true k nearest of the sample x with ids `own`, found by
    comparing it with all rows; and by how many standard deviations a radius for one vector must exceed the expected
    distance to hold that share (vouched()), not less than for independent bits."""
    dims = x.shape[1]
    code = codes(x, mean, rotations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, far = np.full((len(x), 0), -2.0, np.float32), np.zeros((len(x), 0), np.int32)
        for b in batches:
            y, ids = _matrix(b.column("v"), dims), b.column("vec_id").to_numpy()
            s = np.where(own[:, None] == ids[None, :], np.float32(-2), x @ y.T)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (len(x), 1))
            apart = np.bitwise_count(code[:, None] ^ codes(y, mean, rotations)[top]).sum(axis=2).astype(np.int32)
            best, far = np.hstack([best, np.take_along_axis(s, top, 1)]), np.hstack([far, apart])
            order = np.argsort(-best, axis=1, kind="stable")[:, :k]
            best, far = np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(x)), best.shape[1])), pa.array(best.ravel().astype(float)), pa.array(far.ravel())], ["q", "s", "far"])

    best = Window.partitionBy("q").orderBy(F.desc("s"), "far")
    rows = arrow_map(vectors, ["vec_id", "v"], run, "q long, s double, far int").where("s > -2").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "s", "far").toPandas()
    if not len(rows):
        return 0, 0.0
    apart = np.sqrt(np.maximum(0, 2 - 2 * rows["s"].to_numpy()))
    off = np.maximum(np.linalg.norm(x - mean, axis=1), 1e-9)[rows["q"].to_numpy()]
    bits = len(rotations) * dims
    share = 2 * np.arcsin(np.minimum(1, apart / (2 * off))) / np.pi
    deviations = (rows["far"].to_numpy() - bits * share) / np.maximum(1, np.sqrt(bits * share * (1 - share)))
    return int(np.ceil(np.quantile(rows["far"], COVERED))), max(float(np.quantile(deviations, COVERED)), NormalDist().inv_cdf(COVERED))


def vouched(cosine: Column, off: Column, bits: int, margin: float) -> Column:
    """The radius that a vector at distance `off` from the mean needs for neighbours of this cosine: a bit differs with the
    share that their angle, seen from the mean, has of a half turn."""
    share = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine)) / (2 * F.greatest(off, F.lit(1e-9))))) / np.pi
    return F.least(F.lit(bits), F.ceil(bits * share + margin * F.greatest(F.lit(1.0), F.sqrt(bits * share * (1 - share))))).cast("int")


def probed(indexed: DataFrame, queries: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, neighbour_id, cosine) of all rows within Hamming radius 2m-1 of a query, m being the number of substrings; and the
    ids of queries for which that isn't vouched, as they probe a hot bucket.

    Each code is indexed under each of its substrings of `width` bits, each query probes the buckets of its substrings and of
    those with one bit flipped, and the two meet in an equi-join on (substring, value): by the pigeonhole principle a code within
    2m-1 bits differs in at most one bit of some substring. Only codes travel; vectors are fetched for the codes within the radius.
    """
    bucket = lambda df: df.select("vec_id", "code", F.posexplode("code").alias("j", "value"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width)])
    probes = bucket(queries).select(F.col("vec_id").alias("q"), F.col("code").alias("q_code"), "j", F.explode(F.transform(flips, lambda f: F.col("value").bitwiseXOR(f))).alias("value"))
    rows = bucket(indexed)
    hot = materialize(rows.groupBy("j", "value").count().where(F.col("count") > HOT).select("j", "value"), "hot")
    n_hot = hot.count()
    if n_hot:
        open_ = probes.join(sized(hot, n_hot), ["j", "value"], "left_semi").select(F.col("q").alias("vec_id")).distinct()
        rows = rows.join(sized(hot, n_hot), ["j", "value"], "left_anti")
    else:
        open_ = queries.select("vec_id").where("false")
    apart = F.aggregate(F.zip_with("code", "q_code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    near = probes.hint("merge").join(rows, ["j", "value"]).where((F.col("q") != F.col("vec_id")) & (apart <= 2 * F.size("code") - 1)).select("q", "vec_id").distinct()
    near = materialize(near, "probed")
    with_own = near.join(queries.select(F.col("vec_id").alias("q"), F.col("v").alias("q_v")), "q").join(indexed.select("vec_id", "v"), "vec_id")
    s = F.aggregate(F.zip_with("v", "q_v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return with_own.select(F.col("q").alias("vec_id"), F.col("vec_id").alias("neighbour_id"), F.round(s, 9).alias("cosine")), open_


def searched(indexed: DataFrame, queries: DataFrame, count: int, k: int, mean: np.ndarray, rotations: np.ndarray) -> DataFrame:
    """(vec_id, neighbour_id, cosine): the k best of each task's rows within the query's own `radius`. Queries travel to the rows
    in passes of PASS_BYTES; each task indexes its rows in blocks (Index) and keeps k rows of a query."""
    dims, spark = len(mean), indexed.sparkSession
    parts, out = max(1, -(-count * (4 * dims + 16) // PASS_BYTES)), None
    for part in range(parts):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).select("vec_id", "v", "radius").toArrow().combine_chunks()
        if not len(own):
            continue
        sent = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), np.stack(own.column("v").to_numpy()).astype(np.float32), own.column("radius").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, x, radii = sent.value
            code = codes(x, mean, rotations)
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)

            def block(held: list[pa.RecordBatch]) -> None:
                others = np.concatenate([b.column("vec_id").to_numpy() for b in held])
                y = np.concatenate([_matrix(b.column("v"), dims) for b in held])
                index = Index(codes(y, mean, rotations))
                for near in np.unique(radii):
                    mine = np.flatnonzero(radii == near)
                    for at in range(0, len(mine), 64):
                        for q, rows in zip(mine[at : at + 64], index.within(code[mine[at : at + 64]], int(near))):
                            rows = rows[others[rows] != ids[q]]
                            s = np.concatenate([best[q][0], np.round(y[rows].astype(np.float64) @ x[q].astype(np.float64), 9)])
                            other = np.concatenate([best[q][1], others[rows]])
                            order = np.lexsort((other, -s))[:k]
                            best[q] = s[order], other[order]

            held: list[pa.RecordBatch] = []
            for b in batches:
                held.append(b)
                if sum(h.num_rows for h in held) >= BLOCK:
                    block(held)
                    held = []
            if held:
                block(held)
            size = [len(s) for s, _ in best]
            if sum(size):
                yield pa.record_batch([pa.array(np.repeat(ids, size)), pa.array(np.concatenate([o for _, o in best])), pa.array(np.concatenate([s for s, _ in best]))], ["vec_id", "neighbour_id", "cosine"])

        found = arrow_map(indexed, ["vec_id", "v"], run, "vec_id long, neighbour_id long, cosine double")
        out = found if out is None else out.unionByName(found)
    return out


def nearest(embeddings: DataFrame, k: int = 10, query: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): for the vectors of `query` (all, if it is not given) the k most similar of all others.

    Codes are the signs under ROTATIONS learned rotations, fitted on FIT_SAMPLE vectors; every vector is indexed. First, all codes
    within a small Hamming radius are found by joining probes with the multi-index (probed()). A query is done with that
    if it has k neighbours and the k-th is so near that the radius holds COVERED of such (vouched()). The others, and
    those that probe a hot bucket, are compared by blocks of the index, at the radius that held COVERED of the neighbours of
    CALIBRATION vectors or a wider one of their own, until each has k and a radius to match (searched()). Cosines, in double from the
    unit float vectors, decide among the codes within the radius; equal ones (to 9 digits) go to the smaller id.

    Ids must be numeric. Left out on both sides: null ids, null, empty, zero and non-finite vectors and those not of the most frequent
    length. An id with several vectors counts with the least of them. Of equal vectors the index holds the k+1 of smallest id, as
    no other can be among the k nearest of any query; all of them are queries. Only where the table has fewer than k others does a
    vector get fewer rows. Further columns are ignored; an empty table gives an empty result.
    """
    schema = "vec_id long, rank int, neighbour_id long, cosine double"
    vectors, dims = unit_vectors(embeddings)
    n = vectors.count() if dims else 0
    if n < 2:
        return embeddings.sparkSession.createDataFrame([], schema)
    ids, x = sampled(vectors, FIT_SAMPLE)
    mean, rotations = learn_rotations(x)
    radius, margin = calibrate(vectors, ids[:CALIBRATION], x[:CALIBRATION], k, mean, rotations)
    bits, want = ROTATIONS * dims, min(k, n - 1)
    width = min(32, max(16, 8 * -(-n.bit_length() // 8)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b.column("v"), dims)
            whole = packed(y, mean, rotations, width).reshape(len(y), -1, width // 8).astype(np.int64) @ (256 ** np.arange(width // 8 - 1, -1, -1))
            lists = pa.ListArray.from_arrays(np.arange(0, whole.size + 1, whole.shape[1], dtype=np.int32), pa.array(whole.ravel()))
            yield pa.record_batch([*b.columns, lists, pa.array(np.linalg.norm(y - mean, axis=1).astype(float))], ["vec_id", "v", "code", "off"])

    coded = materialize(arrow_map(vectors, ["vec_id", "v"], code, "vec_id long, v array<float>, code array<long>, off double"), "coded")
    copies, indexed = _split(coded.select("vec_id", "v", "code"), F.xxhash64("v"), k + 1)
    if copies is not None:
        copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        indexed = materialize(indexed.unionByName(copies.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")), "indexed")
    queries = materialize(coded if query is None else coded.where(query), "queries")
    order = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id")
    best = lambda found: materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "neighbours")
    ends = lambda found: found.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("cosine").alias("worst"))

    hits, open_ = probed(indexed, queries, width)
    found = best(hits)
    reach = 2 * -(-bits // width) - 1
    done = ends(found).where(F.col("n") >= want).join(queries, "vec_id").where(vouched(F.col("worst"), F.col("off"), bits, margin) <= reach)
    done = materialize(done.select("vec_id").join(open_, "vec_id", "left_anti"), "done")
    out = found.join(done, "vec_id", "left_semi")
    queries = materialize(queries.join(done, "vec_id", "left_anti").select("vec_id", "v", "off", F.lit(max(reach + 1, min(radius, bits))).alias("radius")), "open")
    while count := queries.count():
        found = best(searched(indexed, queries, count, k, mean, rotations))
        wider = F.least(F.lit(bits), F.greatest(2 * F.col("radius"), F.col("radius") + 8))
        needs = F.when(F.coalesce("n", F.lit(0)) < want, wider).otherwise(vouched(F.col("worst"), F.col("off"), bits, margin))
        judged = queries.join(ends(found), "vec_id", "left").withColumn("needs", needs).where("needs > radius")
        queries = materialize(judged.select("vec_id", "v", "off", F.col("needs").cast("int").alias("radius")), "open")
        out = out.unionByName(found.join(queries, "vec_id", "left_anti"))
    return out.select("vec_id", "rank", "neighbour_id", F.round("cosine", 6).alias("cosine"))


def op6_nearest(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 50, among all vectors."""
    return nearest(load(spark, sf_dir, "embeddings"), query=F.col("vec_id") % 50 == 0)
