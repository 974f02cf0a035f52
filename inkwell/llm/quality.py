"""Quality classifier: factorisation machines over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_map, load, load_spread, materialize, sized, span_hashes, text_slices, utf8, word_spans

BINS = 1 << 20
SAMPLE = 10_000
FACTORS = 4
META = 64
#: Value of a metadata feature; words have 1.
META_VALUE = 0.1
Z_MIN, DF_MIN = 4.0, 5


def words_and_stats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word buckets with the bounds of each text, and the structure statistics of each text (zeros for an empty one)."""
    plain, offsets = utf8(texts)
    data, lower_offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, bounds = word_spans(data, lower_offsets)
    buckets = (span_hashes(data, starts, ends) >> np.uint64(44)).astype(np.int32)
    table = np.zeros((256, 6), bool)
    table[65:91, 0] = table[48:58, 1] = table[10, 2] = True
    table[[33, 63], 3] = True
    table[[35, 36, 37, 38, 42, 94, 124, 126, 64, 61, 43, 60, 62, 123, 125, 91, 93, 95], 4] = True
    table[[9, 10, 13, 32], 5] = True
    size = np.maximum(1, np.diff(offsets)).astype(float)
    kinds = np.stack([np.diff(np.concatenate([[0], np.cumsum(table[plain, k])])[offsets]) for k in range(6)], axis=1) / size[:, None]
    n = np.diff(bounds)
    length = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[bounds]) / np.maximum(1, n)
    distinct = np.array([len(np.unique(buckets[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]) / np.maximum(1, n) ** 0.9
    stats = np.column_stack([kinds, length / 10, distinct, np.log1p(n) / 5, np.log1p(size) / 8])
    return buckets, bounds, np.where((n > 0)[:, None], stats, 0).astype(np.float32)


def meta_bins(lang: list, source: list) -> np.ndarray:
    """Two metadata buckets of META for each row; null has its own."""
    from zlib import crc32

    return np.array([[crc32(f"{k}={v}".encode()) % META for k, v in (("lang", a), ("source", b))] for a, b in zip(lang, source)], np.int64).reshape(-1, 2)


def interact(linear: np.ndarray, factors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """FM score without bias: x.w + 1/2 sum_f ((x.v_f)^2 - (x^2).(v_f^2)), linear in the number of features."""
    return x @ linear + 0.5 * ((x @ factors) ** 2 - (x**2) @ (factors**2)).sum(axis=1)


class Features:
    """Sparse rows: numbers of the words present with their bounds by row, metadata buckets, and scaled statistics."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, meta: np.ndarray, stats: np.ndarray):
        self.words, self.bounds, self.meta, self.stats = words, bounds, meta, stats

    def __len__(self) -> int:
        return len(self.stats)

    def take(self, rows: np.ndarray) -> Features:
        size = np.diff(self.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return Features(self.words[np.repeat(self.bounds[rows] - bounds[:-1], size) + np.arange(bounds[-1])], bounds, self.meta[rows], self.stats[rows])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def dot(self, table: np.ndarray, power: int = 1) -> np.ndarray:
        """x**power times each column of a table over words, metadata and statistics, in time linear in the features present."""
        n_words = len(table) - META - self.stats.shape[1]
        rows = self.rows()
        out = np.stack([np.bincount(rows, c, len(self)) for c in table[:n_words].T[:, self.words]], axis=1).astype(np.float32)
        out += table[n_words + self.meta].sum(axis=1) * np.float32(META_VALUE**power)
        return out + self.stats**power @ table[n_words + META :]

    def back(self, values: np.ndarray, n_words: int, power: int = 1) -> np.ndarray:
        """The transpose of dot(): for each feature the sum over rows of x**power times the row's values."""
        words = np.stack([np.bincount(self.words, c, n_words) for c in values.T[:, self.rows()]], axis=1)
        meta = np.stack([np.bincount(self.meta.ravel(), np.repeat(c, self.meta.shape[1]), META) for c in values.T], axis=1) * META_VALUE**power
        return np.concatenate([words, meta, (self.stats**power).T @ values]).astype(np.float32)


def margin(p: dict, x: Features) -> tuple[np.ndarray, np.ndarray]:
    """FM score of sparse rows by the sum-of-squares identity, and the rows' factor sums."""
    first = x.dot(np.column_stack([p["w"], p["v"]]))
    squares = x.dot((p["v"] ** 2).sum(axis=1, keepdims=True), 2)
    return p["b"] + first[:, 0] + 0.5 * ((first[:, 1:] ** 2).sum(axis=1) - squares[:, 0]), first[:, 1:]


def fit_head(x: Features, y: np.ndarray, n_words: int, epochs: int = 60, rate: float = 0.05, l2: float = 1e-4, seed: int = 5) -> dict:
    """Logistic FM by mini-batch AdaGrad over sparse rows."""
    rng = np.random.default_rng(seed)
    size = n_words + META + x.stats.shape[1]
    p = {"b": np.zeros(1, np.float32), "w": np.zeros(size, np.float32), "v": rng.normal(0, 0.01, (size, FACTORS)).astype(np.float32)}
    total = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 256):
            r = x.take(order[k : k + 256])
            z, rv = margin(p, r)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[k : k + 256]]) / len(r)).astype(np.float32)
            d = r.back(np.column_stack([g, g[:, None] * rv]), n_words)
            grads = {"b": g.sum(keepdims=True), "w": d[:, 0] + l2 * p["w"], "v": d[:, 1:] - r.back(g[:, None], n_words, 2) * p["v"] + l2 * p["v"]}
            for name, d in grads.items():
                total[name] += d * d
                p[name] -= rate * d / np.sqrt(total[name])
    return p


class Model:
    """Two FM heads, P(quality = 1) and P(toxic = 1), over selected word buckets, statistics and metadata."""

    def __init__(self, buckets: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.buckets, self.mean, self.scale, self.heads = buckets, mean, scale, {}

    def features(self, words: np.ndarray, bounds: np.ndarray, stats: np.ndarray, meta: np.ndarray) -> Features:
        """Rows of all words of texts: each selected bucket counts once in a row."""
        n = len(self.buckets)
        number = np.full(BINS, -1, np.int32)
        number[self.buckets] = np.arange(n)
        hit = np.flatnonzero(number[words] >= 0) if len(words) else np.empty(0, np.int64)
        pairs = np.unique((np.searchsorted(bounds, hit, "right") - 1) * max(1, n) + number[words[hit]])
        rows, present = np.divmod(pairs, max(1, n))
        return Features(present, np.searchsorted(rows, np.arange(len(stats) + 1)), meta, np.clip((stats - self.mean) / self.scale, -6, 6).astype(np.float32))

    def score(self, head: str, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin(self.heads[head], x)[0].astype(np.float64), -30, 30)))


def telling(counts: DataFrame, rates: dict[str, float]) -> np.ndarray:
    """All word buckets whose document frequency differs between the classes of a head by Z_MIN standard errors, in DF_MIN documents at
    least. counts: bucket, df, and for each head the documents of its positive class."""
    z = lambda head: F.abs(F.col(head) - F.col("df") * rates[head]) / F.sqrt(F.greatest(F.col("df") * rates[head] * (1 - rates[head]), F.lit(1e-9)))
    return np.sort(counts.where((F.col("df") >= DF_MIN) & (F.greatest(z("quality"), z("toxic")) >= Z_MIN)).select("bucket").toArrow().column("bucket").to_numpy()).astype(np.int32)


def fit(words: list[np.ndarray], stats: np.ndarray, meta: np.ndarray, quality: np.ndarray, toxic: np.ndarray, chosen: np.ndarray) -> Model:
    """Both heads over the chosen buckets. words: distinct ones of each row."""
    flat, bounds = np.concatenate(words), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    model = Model(chosen.astype(np.int32), stats.mean(axis=0), stats.std(axis=0) + 1e-3)
    x = model.features(flat, bounds, stats, meta)
    model.heads = {"quality": fit_head(x, quality, len(chosen)), "toxic": fit_head(x, toxic, len(chosen))}
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        words, bounds, stats = words_and_stats(part.column("text"))
        packed = [np.unique(words[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        meta = meta_bins(part.column("lang").to_pylist(), part.column("source").to_pylist())
        columns = [part.column(c) for c in ("doc_id", "quality", "toxic")]
        yield pa.record_batch([*columns, pa.array(packed, pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary()), pa.array([m.astype(np.int16).tobytes() for m in meta], pa.binary())], ["doc_id", "quality", "toxic", "words", "stats", "meta"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the word buckets in a task's rows, and in those of each head's positive class."""
    total = np.zeros((3, BINS), np.int64)
    for b in batches:
        for words, q, t in zip(b.column("words").to_pylist(), b.column("quality").to_pylist(), b.column("toxic").to_pylist()):
            own = np.frombuffer(words, np.int32)
            for row, positive in zip(total, (1, q, t)):
                if positive > 0:
                    row[own] += 1
    at = np.flatnonzero(total[0])
    yield pa.record_batch([pa.array(at), *(pa.array(row[at]) for row in total)], ["bucket", "df", "quality", "toxic"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled documents, those of smallest hash of doc_id. None where no label meets a text.

    Words are counted where the texts are; the driver gets the telling ones of each row alone.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = materialize(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    rows = _source(docs).where("text IS NOT NULL").join(sized(chosen, chosen.count()), "doc_id")
    schema = "doc_id long, quality int, toxic int, words binary, stats binary, meta binary"
    rows = materialize(arrow_map(rows, ["doc_id", "text", "lang", "source", "quality", "toxic"], _featured, schema), "featured")
    n, q, t = rows.agg(F.count("*"), F.avg((F.col("quality") > 0).cast("int")), F.avg((F.col("toxic") > 0).cast("int"))).first()
    if not n:
        return None
    counts = arrow_map(rows, ["words", "quality", "toxic"], _counted, "bucket long, df long, quality long, toxic long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("df", "quality", "toxic")])
    buckets = telling(counts, {"quality": q, "toxic": t})

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(BINS, bool)
        known[buckets] = True
        for b in batches:
            words = [(w := np.frombuffer(v, np.int32))[known[w]].tobytes() for v in b.column("words").to_pylist()]
            yield b.set_column(b.schema.get_field_index("words"), "words", pa.array(words, pa.binary()))

    table = arrow_map(rows, rows.columns, kept, schema).toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending"), ("stats", "ascending")])
    unpack = lambda c, t: [np.frombuffer(v, t) for v in table.column(c).to_pylist()]
    q, t = (table.column(c).to_numpy().astype(np.float32) for c in ("quality", "toxic"))
    return fit(unpack("words", np.int32), np.stack(unpack("stats", np.float32)), np.stack(unpack("meta", np.int16)).astype(np.int64), q, t, buckets)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def quality_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, quality, toxic, keep) for every row of docs: two probabilities, and keep = quality >= 0.5 and toxic < 0.5.

    Each probability is a degree-2 factorisation machine over the presence of hashed words of the whole text, ten
    structure statistics and hashed lang and source. It is scored in linear time by the sum-of-squares identity and
    trained on a bounded sample of the labels (train()); words count only where they tell the classes apart.

    Ids must be numeric, texts may be of any length. Null and empty texts score quality 0 and are not kept. Null doc_id, lang and source are scored as they are; repeated
    rows each give a row; repeated labels count as the worst of them; labels with nulls are ignored. Further columns are
    ignored. Without usable labels every row with text scores quality 1, toxic 0. An empty table gives an empty result.
    """
    model = model or train(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words, bounds, stats = words_and_stats(part.column("text"))
            some = np.diff(bounds) > 0
            q, t = some.astype(float), np.zeros(len(some))
            if model:
                x = model.features(words, bounds, stats, meta_bins(part.column("lang").to_pylist(), part.column("source").to_pylist()))
                q, t = (model.score(h, x) for h in ("quality", "toxic"))
            q, t = np.where(some, q, 0.0), np.where(some, t, 0.0)
            yield pa.record_batch([part.column("doc_id"), pa.array(q), pa.array(t), pa.array((q >= 0.5) & (t < 0.5))], ["doc_id", "quality", "toxic", "keep"])

    return arrow_map(_source(docs), ["doc_id", "text", "lang", "source"], score, "doc_id long, quality double, toxic double, keep boolean")


def op7_quality(spark, sf_dir):
    return quality_scores(load_spread(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), load(spark, sf_dir, "labels"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects. Each row is judged by itself and carried through, so nothing is joined back."""
    model = train(docs, labels)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words, bounds, stats = words_and_stats(part.column("text"))
            keep = np.diff(bounds) > 0
            if model:
                lang, source = (part.column(c).cast(pa.string()).to_pylist() for c in ("lang", "source"))
                x = model.features(words, bounds, stats, meta_bins(lang, source))
                keep &= (model.score("quality", x) >= 0.5) & (model.score("toxic", x) < 0.5)
            yield part.filter(pa.array(keep))

    return arrow_map(docs, names, kept, docs.schema)
