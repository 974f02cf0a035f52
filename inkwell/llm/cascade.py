"""URL filter: a cascade of Bloom filters that is exact over the corpus's own keys, so that pages need no join with the list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_map, load, materialize, mix64

#: Name parts of listed domains; the demonstration list is every key of the corpus under such a domain.
LISTED = ("adult-x", "free-bets", "cheap-pills", "casino-win", "ads-track", "spam-farm")
LATER_RATE = 1 / 64
#: Bytes of filters that travel to the workers in one pass; more of them are split by ranges of keys.
MAX_BYTES = 64 << 20
_BUCKET_BITS = 4096 * 8


def url_key(url: Column) -> Column:
    """Lower-cased host and path of a URL, without scheme, port, query, fragment and trailing slashes; the text itself where it has no scheme."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(F.lower(url).rlike(r"^[a-z][a-z0-9+.-]*://"), F.concat(host, path)).otherwise(url)


def hashed(key: Column) -> list[Column]:
    """128 bits of a key, as two longs; keys count as equal where both are."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions of keys in the filter of a level, shape (hashes, keys)."""
    k = np.arange(1, hashes + 1, dtype=np.uint64)[:, None] + np.uint64(level * 64)
    return mix64(mix64(h1.view(np.uint64)[None, :] ^ k * np.uint64(0x9E3779B97F4A7C15)) + h2.view(np.uint64)[None, :]) % np.uint64(bits)


@dataclass
class Level:
    bits: int
    hashes: int
    bitmap: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        p = positions(h1, h2, level, self.bits, self.hashes)
        return ((self.bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe: a key is listed if the first level that lacks it is an even one, counted from 1."""
        out, alive = np.zeros(len(h1), bool), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            alive = alive[level.has(h1[alive], h2[alive], k)]
            out[alive] = k % 2 == 0
        return out


def _bits(n: int, rate: float) -> int:
    return max(64, int(np.ceil(-n * np.log(rate) / np.log(2) ** 2)))


def _first_rate(listed: int, others: int) -> float:
    return min(0.5, max(1e-6, 0.7 * listed / max(1, others)))


def _filter(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """Bloom filter of the n keys at a false positive rate; its bits are gathered as 4 KB bitmaps by the executors."""
    bits = _bits(n, rate)
    hashes = max(1, round(bits / n * np.log(2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = positions(b.column("h1").to_numpy(), b.column("h2").to_numpy(), level, bits, hashes)
            yield pa.record_batch([pa.array(np.unique(p).astype(np.int64) + 1)], ["p"])

    at = arrow_map(keys, ["h1", "h2"], run, "p long").groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    whole = np.zeros(-(-bits // _BUCKET_BITS) * _BUCKET_BITS // 8 + 4096, np.uint8)
    for r in at.toLocalIterator():
        part = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        start = (r["b"] - 1) * 4096  # buckets and the positions in them count from 1
        whole[start : start + len(part)] |= part
    return Level(bits, hashes, whole)


def build(universe: DataFrame) -> Cascade:
    """Cascade over universe(h1, h2, listed), distinct by key: level 1 holds the listed keys, level 2 the others that level 1
    wrongly has, level 3 the listed ones that level 2 wrongly has, and so on until a level is wrong about none."""
    counts = universe.agg(F.count_if("listed").alias("r"), F.count_if(~F.col("listed")).alias("s")).first()
    inside, outside = universe.where("listed").select("h1", "h2"), universe.where("NOT listed").select("h1", "h2")
    n, rate, levels = counts["r"], _first_rate(counts["r"], counts["s"]), []
    while n:
        level, number = _filter(inside, len(levels), n, rate), len(levels)

        def wrong(batches: Iterator[pa.RecordBatch], level: Level = level, number: int = number) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(level.has(b.column("h1").to_numpy(), b.column("h2").to_numpy(), number)))

        levels.append(level)
        inside, outside = materialize(arrow_map(outside, ["h1", "h2"], wrong, "h1 long, h2 long"), "cascade"), inside
        n, rate = inside.count(), LATER_RATE
    return Cascade(levels)


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("key"))


def cascades(pages: DataFrame, listed: DataFrame) -> list[Cascade]:
    """The cascades of the list over all distinct keys of pages, one for each range of keys: as few as keep each under MAX_BYTES. They can be
    kept (by pickle) and applied to any pages of the same keys."""
    names = listed.select("key").where("key IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    distinct = _keyed(pages).where("key IS NOT NULL").select("key").distinct()
    marked = distinct.join(names, "key", "left").select(*hashed(F.col("key")), F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = materialize(marked, "universe")
    counts = universe.agg(F.count_if("listed").alias("r"), F.count_if(~F.col("listed")).alias("s")).first()
    # Level 1, the others that it wrongly has, and a geometric rest; bitmaps come in whole pages.
    total = _bits(counts["r"], _first_rate(counts["r"], counts["s"])) + 1.1 * _bits(counts["r"], LATER_RATE)
    parts = max(1, int(np.ceil(total / 8 / MAX_BYTES)))
    if parts == 1:
        return [build(universe)]
    split = materialize(universe.withColumn("part", _part(F.col("h1"), parts)), "ranges", "part")
    return [build(split.where(F.col("part") == k)) for k in range(parts)]


def _part(h1: Column, parts: int) -> Column:
    """The range of the key space, of equal width, that a key's hash falls in."""
    return F.shiftright(F.shiftrightunsigned(h1, 32) * parts, 32).cast("int")


def filter_urls(pages: DataFrame, listed: DataFrame, built: list[Cascade] | None = None) -> DataFrame:
    """(page_id, url, key, blocked) for every row of pages; listed(key) is the block list in the form of url_key().

    The cascade's universe is every distinct key of pages, so its answers on pages are exact. It is built by as many
    passes over distinct keys as it has levels and sent to the workers. Filters of over MAX_BYTES are split by ranges of the keys' hashes into
    several cascades, each of which is applied in a pass of its own to the pages of its range. `built` takes cascades() kept
    from before.

    Ids must be numeric. Null url: key NULL, blocked false. An empty url is a key like any other, and one of any length counts whole. Null and repeated entries of the list and
    entries that no page has are harmless. Repeated rows each give a row; further columns are ignored; an empty list blocks nothing; no pages give no rows.
    """
    built = cascades(pages, listed) if built is None else built
    keyed = _keyed(pages).select("*", *hashed(F.col("key")))
    names, schema = ["page_id", "url", "key", "h1", "h2"], "page_id long, url string, key string, blocked boolean"
    out = None
    for number, cascade in enumerate(built):
        own = keyed if len(built) == 1 else keyed.where(F.coalesce(F.when(F.col("key").isNotNull(), _part(F.col("h1"), len(built))), F.lit(0)) == number)
        sent = pages.sparkSession.sparkContext.broadcast(cascade)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                known = np.asarray(b.column("key").is_valid())
                hit = sent.value.has(*(b.column(c).to_numpy() for c in ("h1", "h2"))) & known
                yield pa.record_batch([*(b.column(c) for c in ("page_id", "url", "key")), pa.array(hit)], ["page_id", "url", "key", "blocked"])

        found = arrow_map(own, names, run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def demonstration_list(pages: DataFrame) -> DataFrame:
    """The keys of pages under a domain of LISTED."""
    key = url_key(F.col("url"))
    return pages.select(key.alias("key")).where(F.col("key").rlike(rf"^([^/]*\.)?({'|'.join(LISTED)})\.")).distinct()


def op3_url_filter(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return filter_urls(pages, demonstration_list(pages))


OP3_SQL = rf"""
WITH k AS (
  SELECT page_id, url, CASE WHEN regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://')
      THEN regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]*)', 1) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
      ELSE url END AS key FROM pages)
SELECT page_id, url, key, coalesce(regexp_matches(key, '^([^/]*\.)?({"|".join(LISTED)})\.'), false) AS blocked FROM k
"""
