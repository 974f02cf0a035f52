"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_map, load_spread, text_slices, utf8

BINS = 4096
PER_LANGUAGE = 1000
#: Languages that a model tells apart: the most frequent ones, so that a column of stray values can't swell it.
LANGUAGES = 256
MARGIN = 0.15


def profiles(texts: pa.Array) -> np.ndarray:
    """Root-scaled, unit-length counts of hashed 2- and 3-byte grams of each lower-cased text (whole texts); zero for empty ones."""
    data, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    out = np.zeros((len(offsets) - 1, BINS), np.float32)
    if len(data) >= 2:
        d = data.astype(np.uint32)
        two = d[:-1] | d[1:] << np.uint32(8)
        three = two[:-1] | d[2:] << np.uint32(16)
        two, three = (((g * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64) for g in (two + np.uint32(1 << 24), three))
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            if b - a >= 2:
                out[k] = np.bincount(two[a : b - 1], minlength=BINS)
                out[k] += np.bincount(three[a : max(a, b - 2)], minlength=BINS)
        np.sqrt(out, out=out)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(norm > 0, norm, 1)
    return out


def code_matrix(languages: int) -> np.ndarray:
    """Codewords in {-1, 1}, one row a language. Up to 7 languages: all 2**(n-1)-1 distinct splits; beyond: 10*log2(n) random ones, the most distant of 50 draws."""
    if languages <= 7:
        columns = [(1, *c) for c in product((1, -1), repeat=languages - 1) if -1 in c]
        return np.array(columns, np.float32).T if columns else np.ones((languages, 1), np.float32)
    rng, best = np.random.default_rng(3), (-1, None)
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.float32), (languages, int(np.ceil(10 * np.log2(languages)))))
        d = (m.shape[1] - m @ m.T) / 2 + np.eye(languages) * m.shape[1]
        best = max(best, (d.min(), m), key=lambda x: x[0])
    return best[1]


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 150, rate: float = 20.0, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """One logistic classifier for each code bit, by gradient descent over all given rows. y: language numbers."""
    want = code[y]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    weight = (1 / np.bincount(y, minlength=len(code))[y]).astype(np.float32)[:, None]
    weight /= weight.sum()
    for _ in range(steps):
        g = -want * weight / (1 + np.exp(np.clip(want * (x @ w + b), -30, 30)))
        w -= rate * (x.T @ g + l2 * w)
        b -= rate / 10 * g.sum(axis=0)
    return w, b


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Loss of each language: mean logistic loss of the bits' margins against its codeword (loss-weighted decoding)."""
    return np.stack([np.logaddexp(0, -margins * c).mean(axis=1) for c in code], axis=1)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """Fit on a sample of about 1.2 * `per_language` labelled rows of each language, chosen by hash of doc_id and text; None without labels.
    Texts under 20 characters say too little to be learnt from and are left out here."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang IS NOT NULL AND length(text) >= 20")
    counts = {r["lang"]: r["count"] for r in source.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    names = sorted(counts)
    if not names:
        return None
    source, bound = source.where(F.col("lang").isin(names)), F.lit(1.0)
    for name, n in counts.items():
        bound = F.when(F.col("lang") == name, F.lit(min(1.0, 1.2 * per_language / n))).otherwise(bound)
    thin = source.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)) < bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield pa.record_batch([part.column("doc_id"), part.column("lang"), pa.array([x.astype(np.float16).tobytes() for x in profiles(part.column("text"))], pa.binary())], ["doc_id", "lang", "profile"])

    rows = arrow_map(thin, ["doc_id", "lang", "text"], count, "doc_id long, lang string, profile binary").toArrow().sort_by([("doc_id", "ascending")])
    y = np.array([names.index(v) for v in rows.column("lang").to_pylist()])
    x = np.stack([np.frombuffer(v.as_py(), np.float16).astype(np.float32) for v in rows.column("profile")])
    code = code_matrix(len(names))
    w, b = fit_bits(x, y, code)
    return {"names": names, "code": code, "w": w, "b": b}


def identify(docs: DataFrame, model: dict | None = None, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, predicted, loss, margin, ambiguous) for every row of docs.

    Each bit of a language's codeword is predicted by a binary classifier over hashed byte 2- and 3-grams of the whole
    text; the codeword of least mean logistic loss wins. `margin` is the loss of the second language less that of the
    first; `ambiguous` is set where it is below the parameter. Training takes a bounded sample (train()).

    Null or empty texts and texts under two bytes get predicted = NULL, loss and margin NULL, ambiguous = true. Null
    doc_id and lang pass through, repeated rows each give a row; further columns are ignored; where no row has a usable
    label (one of a text of 20 characters at least), predicted is NULL everywhere; an empty table gives an empty result. Equal losses go to the first name
    by alphabet, with margin 0, and are ambiguous. Ids must be numeric, texts may be of any length.
    """
    model = model or train(docs)
    schema = "doc_id long, lang string, predicted string, loss double, margin double, ambiguous boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            x = profiles(part.column("text"))
            known = x.any(axis=1) if model else np.zeros(len(x), bool)
            if model:
                loss = decode(x @ model["w"] + model["b"], model["code"])
                best = loss.argmin(axis=1)
                ranked = np.sort(loss, axis=1)
                low, gap = ranked[:, 0], (ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf))
                names = np.array(model["names"], object)[best]
            else:
                low = gap = np.zeros(len(x))
                names = np.full(len(x), "", object)
            hide = ~known
            yield pa.record_batch([part.column("doc_id"), part.column("lang"), pa.array(names, pa.string(), mask=hide), pa.array(low.astype(float), mask=hide), pa.array(gap.astype(float), mask=hide), pa.array(hide | (gap < margin))], schema_names)

    schema_names = ["doc_id", "lang", "predicted", "loss", "margin", "ambiguous"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    return arrow_map(source, ["doc_id", "text", "lang"], score, schema)


def op10_language_id(spark, sf_dir):
    return identify(load_spread(spark, sf_dir, "documents", "doc_id", "text", "lang"))
