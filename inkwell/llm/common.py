"""Shared pieces of the corpus operators: scratch tables, byte-bounded Arrow slices and vectorised word hashing.

A *word* is everywhere a maximal run of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters.
The same runs are `regexp_extract_all(lower(text), WORD_SQL)` in SQL.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkwell.operators.partitions import spread
from inkwell.plans.scratch import scratch_dir

WORD_SQL = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
ROOT = str(Path(__file__).resolve().parents[2])
SLICE_BYTES = 1 << 20
BROADCAST_ROWS = 1_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table, or some columns of it, for work in Python: a few files are spread over all cores."""
    scan = load(spark, sf_dir, table)
    return spread(scan.select(*columns) if columns else scan)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that a run of very long texts cannot fill a Python worker; let workers import this package.
    The two settings stay as they are set here for the session, since a plan reads them when it runs."""
    paths = spark.sparkContext.environment.setdefault("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


#: Paths of materialised tables by application, in order.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write df once to the shared folder, in folders by the partition columns, and read it back: lineage is cut, and a lost executor
    costs no recomputation."""
    spark = df.sparkSession
    own = spark.sparkContext.applicationId
    path = f"{scratch_dir(spark)}/{own}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(own, []).append(path)
    df.write.partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, mark: int) -> DataFrame:
    """df materialised; what was materialised since written() was `mark`, only to make it, is deleted."""
    out = materialize(df, name)
    spark = df.sparkSession
    own = _written[spark.sparkContext.applicationId]
    for path in own[mark:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    own[mark:] = own[-1:]
    return out


def written(spark: SparkSession) -> int:
    """How many tables this application has materialised and not deleted."""
    return len(_written.get(spark.sparkContext.applicationId, ()))


def quoted(columns: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Mark a narrow id table for broadcast when its counted rows are few; beyond that Catalyst shuffles it as any other side."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids(doc_id); rows with a null doc_id stay."""
    ids = materialize(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "dropped")
    return docs.join(sized(ids, ids.count()), "doc_id", "left_anti").select(*quoted(docs.columns))


def restricted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in the materialised distinct table ids(doc_id)."""
    return docs.join(sized(ids, ids.count()), "doc_id", "left_semi")


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 on uint64."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each slice hold at most `limit` bytes, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        start, n = 0, batch.num_rows
        while start < n:
            base = end[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(end, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset or isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _IS_WORD[_lo:_hi] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + (64 << 10))
        for k, p in enumerate((_P, _PINV)):
            step = np.full(m, p, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), all from one running polynomial sum."""
    up, down = _pow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of lower-cased texts, and the bounds (one more than texts) of each text's words."""
    inside = _IS_WORD[data]
    edge = np.empty(len(data) + 1, bool)
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
        edge[1:-1] = inside[1:] != inside[:-1]
    else:
        edge[:] = False
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = np.unique(cut[inside[cut] & inside[cut - 1]])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the bounds of each text's words."""
    data, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends), bounds


def gram_hashes(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q consecutive words from each position; they also run over the texts' bounds, which callers leave out."""
    if len(words) < q:
        return np.empty(0, np.uint64)
    h = words[: len(words) - q + 1].copy()
    for k in range(1, q):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[k : len(words) - q + 1 + k]
    return mix64(h)


def shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct hashes of each text's word n-grams; a text shorter than `size` words gives one for all its words, an empty one none."""
    words, bounds = word_hashes(texts)
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else grams[:0])
    return out


def string_array(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def frugal(fn: Callable) -> Callable:
    """fn over batches, after which the worker gives freed memory back to the system, where the C library can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def arrow_map(df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """fn over Arrow batches of the columns. Columns travel under numbers where a name could be read as a path."""
    bounded_batches(df.sparkSession)
    if not any("." in c or "`" in c for c in columns):
        return df.select(*columns).mapInArrow(frugal(fn), schema)
    fields = schema.fields

    @frugal
    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b.rename_columns(columns) for b in batches):
            yield out.rename_columns([f"c{k}" for k in range(len(fields))])

    safe = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(fields)])
    moved = df.select(*[c.alias(f"c{k}") for k, c in enumerate(quoted(columns))]).mapInArrow(renamed, safe)
    return moved.toDF(*[f.name for f in fields])


def tokenizer_path(name: str) -> str:
    return os.path.join(os.environ.get("INKWELL_TOKENIZERS", "/opt/tokenizers"), name)
