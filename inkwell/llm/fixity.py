"""Merkle fixity audit of WARC replicas: hash trees over ordered offset ranges, descended only where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import load, materialize

BITS = 4
FILE_RECORDS = 512
#: Records of one id that start with as many equal hex digits of their digest are placed together, so that no task holds all of a hot id's.
PREFIX = 3


def warc_record(url: Column, payload: Column) -> Column:
    """A response record: version line, target URI, length of the block in bytes, the block, two line ends. Null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """One row for each distinct record of an id: warc_file, key, page_id, slot, offset, length, copies, sha, leaf.

    Files hold the pages of FILE_RECORDS consecutive ids, in order of id and digest, equal records one behind the other; pages with a null id lie in
    file -1 under key 0. Only digests and lengths leave the scan. `slot` is the record's place in its file; the leaf digest binds id,
    offset, length, number of copies and the record's own digest. Places are sums over the file's groups of (id, digest's
    prefix) and within a group, so that neither a repeated id nor the null one gathers its records in one task.
    """
    record = warc_record(F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("sha"))
    rows = rows.groupBy("page_id", "length", "sha").agg(F.count("*").alias("copies"))
    rows = rows.withColumns({"warc_file": F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), F.lit(-1)).cast("long"), "key": F.coalesce("page_id", F.lit(0).cast("long")), "part": F.substring("sha", 1, PREFIX)})
    rows = materialize(rows, "records")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    size = F.col("length") * F.col("copies")
    within, along = Window.partitionBy("warc_file", "key", "part").orderBy("sha"), Window.partitionBy("warc_file").orderBy("key", "part")
    groups = rows.groupBy("warc_file", "key", "part").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    groups = groups.select("warc_file", "key", "part", before("bytes", along).alias("start"), before("n", along).alias("first"))
    placed = rows.withColumns({"ahead": before(size, within), "place": F.row_number().over(within) - 1}).join(groups, ["warc_file", "key", "part"])
    placed = placed.withColumns({"offset": F.col("start") + F.col("ahead"), "slot": F.col("first") + F.col("place")})
    bound = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("offset"), "length", "copies", "sha")
    return placed.select("warc_file", "key", "page_id", "slot", "offset", "length", "copies", "sha", F.sha2(bound, 256).alias("leaf"))


def tree(leaf: DataFrame, heights: tuple[int, int]) -> DataFrame:
    """All nodes over materialised leaves: level, warc_file, slot, digest. A node's digest is over places and digests of its children in order.

    heights: levels that join 16 slots of a file each, and levels above them that join 16 files each."""
    level = leaf.select("warc_file", "slot", F.col("leaf").alias("digest"))
    nodes = level.withColumn("level", F.lit(0))
    for number in range(1, sum(heights) + 1):
        child = "slot" if number <= heights[0] else "warc_file"
        grouped = level.groupBy(*_above(number, heights)).agg(F.array_sort(F.collect_list(F.struct(F.col(child).alias("at"), "digest"))).alias("c"))
        digest = F.sha2(F.concat_ws("|", F.transform("c", lambda x: F.concat_ws(":", x["at"].cast("string"), x["digest"]))), 256)
        level = materialize(grouped.select("warc_file", "slot", digest.alias("digest")), "level")
        nodes = nodes.unionByName(level.withColumn("level", F.lit(number)))
    return nodes


def _above(number: int, heights: tuple[int, int]) -> list[Column]:
    """Place, on level `number`, of the parent of a node one level below."""
    if number <= heights[0]:
        return [F.col("warc_file"), F.shiftright("slot", BITS).alias("slot")]
    return [F.shiftright("warc_file", BITS).alias("warc_file"), F.lit(0).cast("long").alias("slot")]


def _heights(sides: list[DataFrame]) -> tuple[int, int]:
    """Levels after which the slots of each file are one node, and those after which the files are one or, with negative ones, two."""
    ends = [s.agg(F.max("slot").alias("slot"), F.max("warc_file").alias("high"), F.min("warc_file").alias("low")).first() for s in sides]
    need = lambda n: -(-max(0, n).bit_length() // BITS)
    return need(max(e["slot"] or 0 for e in ends)), need(max(max(e["high"] or 0, -1 - (e["low"] or 0)) for e in ends))


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """(warc_file, page_id, offset, length, copies, sha, replica_sha, status) of each damaged record; offset and length are those in the original.

    Both replicas are hashed to trees of one height, however different their sizes. From the roots on, only children of nodes that differ
    are compared, level by level; at the leaves the records of the ranges left are matched by page_id and digest. status: `corrupt` (one
    record of the id is lost, and another is there in its place), `missing` from the replica, or `extra` in it (offset and length are then
    the replica's); `copies` says how many equal records are. Records that only moved because another is missing are not damaged.

    Ids must be numeric. Null url and html hash as empty ones, texts of any length are hashed whole. Of records with a null page_id, and of
    an id that lost or gained several, those lost are `missing` and the new ones `extra`; equal copies count by their number.
    Further columns are ignored; equal or two empty replicas give an empty result.
    """
    sides = [materialize(leaves(df), "leaves") for df in (original, replica)]
    heights = _heights(sides)
    trees = [materialize(tree(s, heights), "tree") for s in sides]
    at = ["warc_file", "slot"]
    ranges = None
    for number in range(sum(heights), -1, -1):
        a, b = (t.where(F.col("level") == number).select(*at, F.col("digest").alias(n)) for t, n in zip(trees, ("x", "y")))
        if ranges is not None:
            a, b = (t.join(ranges, at, "left_semi") for t in (a, b))
        bad = a.join(b, at, "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(*at)
        if number:
            grown = "slot" if number <= heights[0] else "warc_file"
            bad = bad.withColumn(grown, F.explode(F.sequence(F.shiftleft(grown, BITS), F.shiftleft(grown, BITS) + (1 << BITS) - 1)))
        ranges = materialize(bad, "ranges")
        if not ranges.take(1):
            break
    a, b = (s.join(ranges, at, "left_semi").select("warc_file", "key", "page_id", "offset", "length", "copies", "sha") for s in sides)
    own = ["warc_file", "key", "sha"]
    both = a.join(b.select(*own, F.col("page_id").alias("b_id"), F.col("offset").alias("b_offset"), F.col("length").alias("b_length"), F.col("copies").alias("b_copies")), own, "full")
    more = F.coalesce("copies", F.lit(0)) - F.coalesce("b_copies", F.lit(0))
    changed = both.select("warc_file", "key", "sha", F.coalesce("page_id", "b_id").alias("page_id"), F.coalesce("offset", "b_offset").alias("offset"), F.coalesce("length", "b_length").alias("length"), more.alias("more"))
    changed = materialize(changed.where("more <> 0"), "changed")
    lost, new = F.col("more") > 0, F.col("more") < 0
    record = F.struct("offset", "length", "sha")
    sums = changed.groupBy("warc_file", "key", "page_id").agg(F.sum(F.when(lost, F.col("more")).otherwise(0)).alias("lost"), F.sum(F.when(new, -F.col("more")).otherwise(0)).alias("new"), F.max(F.when(lost, record)).alias("was"), F.max(F.when(new, record)).alias("now"))
    pair = F.col("page_id").isNotNull() & (F.col("lost") == 1) & (F.col("new") == 1)
    corrupt = sums.where(pair).select("warc_file", "page_id", "was.offset", "was.length", F.col("lost").alias("copies"), "was.sha", F.col("now.sha").alias("replica_sha"), F.lit("corrupt").alias("status"))
    single = changed.join(sums.where(~pair).select("warc_file", "key"), ["warc_file", "key"], "left_semi")
    none = F.lit(None).cast("string")
    alone = single.select("warc_file", "page_id", "offset", "length", F.abs("more").alias("copies"), F.when(lost, F.col("sha")).otherwise(none).alias("sha"), F.when(new, F.col("sha")).otherwise(none).alias("replica_sha"), F.when(lost, "missing").otherwise("extra").alias("status"))
    return corrupt.unionByName(alone)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the whole table with faults to find: in ids of 7 mod 211 the first `<p>` has become `<q>`, those of 11 mod 503 are gone."""
    html = F.when(F.col("page_id") % 211 == 7, F.regexp_replace("html", "(?s)^(.*?)<p>", "$1<q>")).otherwise(F.col("html"))
    return pages.where("page_id IS NULL OR page_id % 503 <> 11").withColumn("html", html)


def op4_fixity_audit(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


OP4_SQL = r"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 512) AS BIGINT) AS warc_file, html,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS gap, coalesce(html, '') AS body,
         CASE WHEN page_id % 211 = 7 THEN regexp_replace(coalesce(html, ''), '<p>', '<q>') ELSE coalesce(html, '') END AS body2 FROM pages),
a AS (SELECT page_id, warc_file, body <> body2 AS changed, head || strlen(body) || gap || body || gap AS rec, head || strlen(body2) || gap || body2 || gap AS rec2 FROM r),
o AS (SELECT *, coalesce(sum(strlen(rec)) OVER (PARTITION BY warc_file ORDER BY page_id, sha256(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM a)
SELECT warc_file, page_id, CAST(pos AS BIGINT) AS "offset", CAST(strlen(rec) AS BIGINT) AS length, CAST(1 AS BIGINT) AS copies, sha256(rec) AS sha,
       CASE WHEN page_id % 503 = 11 THEN NULL ELSE sha256(rec2) END AS replica_sha, CASE WHEN page_id % 503 = 11 THEN 'missing' ELSE 'corrupt' END AS status
FROM o WHERE page_id % 503 = 11 OR changed
"""
