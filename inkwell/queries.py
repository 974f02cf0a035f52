"""Registered queries of the engine's own operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import Config, Workspace
from inkwell.functions import text as T
from inkwell.functions.markdown import section_structs
from inkwell.functions.vectors import is_unit, literal
from inkwell.operators.changes import change_actions, counts_by_root, first_root_wins, paths_for_roots, pruned, replaced, status
from inkwell.operators.partitions import spread
from inkwell.operators.search import best_per_group as best_rows
from inkwell.operators.search import count_near, related, scored, search, search_each, top_k
from inkwell.plans import indexer
from inkwell.plans.indexer import chunk_rows, ship
from inkwell.plans.scratch import scratch_dir
from inkwell.plans.snapshot import Snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query_vector(vectors: DataFrame, vec_id: int = 0):
    return literal(vectors.where(F.col("vec_id") == vec_id).first()["embedding"])


# --- vectors

_DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SCORED = f"SELECT e.vec_id, e.label, {_DOT} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT row_number() OVER (ORDER BY s DESC, vec_id) AS rank, vec_id, label, round(s, 6) AS score FROM ({_SCORED}) ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return top_k(scored(e, F.col("embedding"), _query_vector(e)), 10, "vec_id").select("rank", "vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT label, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS n FROM ({_SCORED})) WHERE n = 1")
def best_per_group(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    best = best_rows(scored(e, F.col("embedding"), _query_vector(e)), ["label"], ["vec_id"], "vec_id")
    return best.select("label", "vec_id", F.round("score", 6).alias("score"))


@query(
    f"""SELECT row_number() OVER (ORDER BY s DESC, label) AS rank, label, vec_id, round(s, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS n FROM ({_SCORED}) WHERE label IN (1, 3, 5)) WHERE n = 1 ORDER BY s DESC, label LIMIT 10"""
)
def search_filtered(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    rows = scored(e.where(F.col("label").isin(1, 3, 5)), F.col("embedding"), _query_vector(e))
    return top_k(best_rows(rows, ["label"], ["vec_id"], "vec_id"), 10, "label").select("rank", "label", "vec_id", F.round("score", 6).alias("score"))


#: Many-query searches take as queries all rows whose id is divisible by 50.
_ASKED = "vec_id % 50 = 0"


@query(
    f"""SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.{_ASKED}) WHERE rank <= 10"""
)
def multi_query_topk(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    ship(spark)
    return search_each(e, e.where(_ASKED), 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT q.vec_id AS query_id, CAST(count_if(e.vec_id <> q.vec_id AND {_DOT} >= 0.25) AS BIGINT) AS links FROM embeddings e, embeddings q WHERE q.{_ASKED} GROUP BY 1")
def near_pairs(spark, sf_dir):
    """How many others are near each query."""
    e = _table(spark, sf_dir, "embeddings")
    ship(spark)
    return count_near(e, e.where(_ASKED), 0.25)


# Notes of five windows from the vectors; windows of ids of 3 mod 7 are images, those of 5 mod 11 have no vector.
_CHUNK_SQL = "SELECT vec_id, vec_id // 5 AS n, vec_id % 5 AS ord, embedding, label FROM embeddings WHERE vec_id % 7 <> 3 AND vec_id % 11 <> 5"
_PATH_SQL = "'/v/r' || n % 3 || '/n' || n || '.md'"


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and links of an index over the vectors."""
    n = F.floor(F.col("vec_id") / 5)
    root = F.concat(F.lit("/v/r"), (n % 3).cast("string"))
    path = F.concat(root, F.lit("/n"), n.cast("string"), F.lit(".md"))
    e = _table(spark, sf_dir, "embeddings").withColumns({"path": path, "source_root": root, "n": n})
    documents = e.groupBy("path", "source_root", "n").agg(F.count("*")).select("path", F.concat(F.lit("Note "), F.col("n").cast("string")).alias("title"), "source_root", "n")
    heading = F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("H"), F.col("label").cast("string")))
    chunks = e.select(
        "path", (F.col("vec_id") % 5).cast("int").alias("ord"), F.when(F.col("vec_id") % 7 == 3, "image").otherwise("text").alias("space"), heading.alias("heading_path"),
        F.concat(F.lit("window "), F.col("vec_id").cast("string")).alias("text"), F.when(F.col("vec_id") % 11 != 5, F.col("embedding")).alias("vector"),
    )
    links = documents.where("n % 7 = 3").select(F.lit("/v/r0/n0.md").alias("src_path"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("N"), F.col("n").cast("string"))).otherwise(F.regexp_replace(F.substring("path", 2, 99), r"\.md$", "")).alias("dst"))
    return documents, chunks, links


@query(
    f"""WITH s AS (SELECT e.*, {_DOT} AS s FROM ({_CHUNK_SQL}) e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    b AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s DESC, ord) AS k FROM s WHERE n % 3 IN (0, 2)),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, {_PATH_SQL}) AS rank FROM b WHERE k = 1)
    SELECT rank, {_PATH_SQL} AS path, 'Note ' || n AS title, '/v/r' || n % 3 AS source_root, CASE WHEN vec_id % 4 <> 0 THEN 'H' || label ELSE '' END AS heading_path, 'window ' || vec_id AS text, round(s, 5) AS score FROM r WHERE rank <= 10"""
)
def search_index(spark, sf_dir):
    """The engine's search under two of three roots."""
    documents, chunks, _ = _indexed(spark, sf_dir)
    query_ = _table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    hits = search(documents, chunks, query_, 10, ["/v/r0", "/v/r2"])
    return hits.withColumn("score", F.round(F.col("score").cast("double"), 5))


@query(
    f"""WITH c AS ({_CHUNK_SQL}), s AS (SELECT e.n, max({_DOT}) AS s FROM c e, c q WHERE q.n = 0 AND e.n <> 0 AND e.n % 7 <> 3 GROUP BY e.n),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, {_PATH_SQL}) AS rank FROM s) SELECT rank, {_PATH_SQL} AS path, 'Note ' || n AS title, round(s, 5) AS score FROM r WHERE rank <= 10"""
)
def related_notes(spark, sf_dir):
    """The engine's related notes of one note, without those that it links to by name or path."""
    documents, chunks, links = _indexed(spark, sf_dir)
    ship(spark)
    return related(documents, chunks, links, "/v/r0/n0.md", 10).withColumn("score", F.round(F.col("score").cast("double"), 5))


@query("SELECT vec_id, len(embedding) AS dim, abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001 AS is_unit FROM embeddings")
def unit_invariant(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), is_unit(F.col("embedding")).alias("is_unit"))


# --- text

_NOTE_SQL = r"""SELECT doc_id, source, CASE doc_id % 5
  WHEN 0 THEN '# ' || source || chr(10) || chr(10) || text
  WHEN 1 THEN '---' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || 'tags: [' || lang || ']' || chr(10) || '---' || chr(10) || '# H ' || source || chr(10) || text || chr(10) || '[[' || lang || '|alias]] [[ ' || source || '#part ]]'
  WHEN 2 THEN '---' || chr(10) || 'title: open' || chr(10) || text
  WHEN 3 THEN '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '## Two ' || lang || chr(10) || text || chr(10) || '### Three' || chr(10) || 'see [[' || source || ']] and [[' || source || ']]'
  ELSE text END AS content FROM documents"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's texts as Markdown notes of five kinds."""
    d, nl = spread(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")), F.lit("\n")
    c, text, lang, source = F.concat, F.col("text"), F.col("lang"), F.col("source")
    kinds = [
        c(F.lit("# "), source, nl, nl, text),
        c(F.lit('---\ntitle: "Doc '), F.col("doc_id").cast("string"), F.lit('"\ntags: ['), lang, F.lit("]\n---\n# H "), source, nl, text, F.lit("\n[["), lang, F.lit("|alias]] [[ "), source, F.lit("#part ]]")),
        c(F.lit("---\ntitle: open\n"), text),
        c(F.lit("```\n# code\n```\n## Two "), lang, nl, text, F.lit("\n### Three\nsee [["), source, F.lit("]] and [["), source, F.lit("]]")),
    ]
    content = text
    for k, kind in enumerate(kinds):
        content = F.when(F.col("doc_id") % 5 == k, kind).otherwise(content)
    return d.select("doc_id", "source", content.alias("content"))


_FM = r"'(?s)\A---\n(.*?)\n---(?:\n|\z)(.*)\z'"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(content, {_FM}) THEN regexp_extract(content, {_FM}, 1) END AS frontmatter, CASE WHEN regexp_matches(content, {_FM}) THEN regexp_extract(content, {_FM}, 2) ELSE content END AS body FROM ({_NOTE_SQL})")
def frontmatter_split(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", T.frontmatter(F.col("content")).alias("frontmatter"), T.body(F.col("content")).alias("body"))


@query(f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN 'Doc ' || doc_id ELSE 'note' || doc_id || '.v1' END AS title FROM ({_NOTE_SQL})")
def title_derive(spark, sf_dir):
    path = F.concat(F.lit("/notes/note"), F.col("doc_id").cast("string"), F.lit(".v1.md"))
    n = _notes(spark, sf_dir)
    return n.select("doc_id", T.title(path, T.frontmatter(F.col("content")), T.body(F.col("content"))).alias("title"))


@query(
    rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(all_, dst)) AS ord, dst FROM (SELECT doc_id, all_, unnest(list_distinct(all_)) AS dst FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(content, '(?s)\[\[(.*?)\]\]', 1), lambda x: trim(regexp_extract(x, '(?s)^([^|#]*)', 1))), lambda x: x <> '') AS all_ FROM ({_NOTE_SQL})))"""
)
def wikilinks(spark, sf_dir):
    links = _notes(spark, sf_dir).select("doc_id", F.posexplode(T.wikilinks(F.col("content"))).alias("ord", "dst"))
    return links.select("doc_id", (F.col("ord") + 1).alias("ord"), "dst")


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\v\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents),
    k AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 384 THEN 1 ELSE CAST(ceil((len(w) - 384) / 320.0) AS BIGINT) + 1 END)) AS ord FROM w)
    SELECT doc_id, ord, array_to_string(w[ord * 320 + 1 : ord * 320 + 384], ' ') AS text FROM k"""
)
def chunk_windows(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("ord", "text"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE source || ' > ' || lang || chr(10) || text END AS embed_input FROM documents")
def embed_input(spark, sf_dir):
    trail = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat_ws(" > ", "source", "lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.embed_input(trail, F.col("text")).alias("embed_input"))


_LINKS_SQL = r"list_distinct(list_filter(list_transform(regexp_extract_all({}, '(?s)\[\[(.*?)\]\]', 1), lambda x: trim(regexp_extract(x, '(?s)^([^|#]*)', 1))), lambda x: x <> ''))"


@query(
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN 'Doc ' || doc_id ELSE 'note' || doc_id END AS title, frontmatter, body, array_to_string(list_sort({_LINKS_SQL.format("body")}), chr(10)) AS links
    FROM (SELECT doc_id, source, CASE WHEN regexp_matches(content, {_FM}) THEN regexp_extract(content, {_FM}, 1) END AS frontmatter, CASE WHEN regexp_matches(content, {_FM}) THEN regexp_extract(content, {_FM}, 2) ELSE content END AS body FROM ({_NOTE_SQL}))"""
)
def parsed_notes(spark, sf_dir):
    """All that the indexer takes from a note."""
    path = F.concat(F.lit("/notes/note"), F.col("doc_id").cast("string"), F.lit(".md"))
    n = _notes(spark, sf_dir).select("doc_id", T.parsed(path, F.col("content")).alias("note"))
    return n.select("doc_id", "note.title", "note.frontmatter", "note.body", F.array_join(F.array_sort("note.links"), "\n").alias("links"))


# The texts stand in fenced code, which a Markdown parser leaves as it is, so that SQL can follow it over whole texts.
_FENCE = "~" * 40
_TRIMMED = r"regexp_replace(replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')"
_SECTIONS_SQL = rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, heading_path, text FROM (
    SELECT doc_id, 0 AS k, '' AS heading_path, {_TRIMMED.format("text")} AS text FROM documents UNION ALL SELECT doc_id, 1, source, {_TRIMMED.format("text || chr(10) || chr(10) || 'one'")} FROM documents
    UNION ALL SELECT doc_id, 2, source || ' > ' || lang, {_TRIMMED.format("'two' || chr(10) || text")} FROM documents UNION ALL SELECT doc_id, 3, 'Last', 'end' FROM documents) WHERE text <> ''"""


def _fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with ATX and setext headings, and each text three times in fenced code."""
    d, nl = spread(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")), F.lit("\n\n")
    code = F.concat(F.lit(f"{_FENCE}\n"), F.col("text"), F.lit(f"\n{_FENCE}"))
    note = F.concat(code, nl, F.lit("# "), F.col("source"), nl, code, nl, F.lit("**one**"), nl, F.lit("## "), F.col("lang"), F.lit(" ##"), nl, F.lit("`two`"), nl, code, nl, F.lit("Last\n====\n\nend\n"))
    return d.select("doc_id", note.alias("body"))


@query(_SECTIONS_SQL)
def heading_trail(spark, sf_dir):
    """Sections of notes over the whole texts."""
    ship(spark)
    return _fenced(spark, sf_dir).select("doc_id", F.posexplode(section_structs(F.col("body"))).alias("ord", "s")).select("doc_id", F.col("ord").cast("long").alias("ord"), "s.heading_path", "s.text")


@query(
    rf"""WITH w AS (SELECT doc_id, ord AS section, heading_path, list_filter(regexp_split_to_array(text, '[\s\v\x{{85}}\p{{Z}}]+'), lambda x: x <> '') AS w FROM ({_SECTIONS_SQL})),
    k AS (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 384 THEN 1 ELSE CAST(ceil((len(w) - 384) / 320.0) AS BIGINT) + 1 END)) AS k FROM w)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, k) - 1 AS ord, heading_path, array_to_string(w[k * 320 + 1 : k * 320 + 384], ' ') AS text FROM k"""
)
def note_chunks(spark, sf_dir):
    """The indexer's windows of the sections of whole texts, numbered through each note."""
    ship(spark)
    notes = _fenced(spark, sf_dir).select(F.col("doc_id").alias("path"), "body")
    return chunk_rows(notes, 384, 64).select(F.col("path").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "heading_path", "text")


@query()
def note_sections(spark, sf_dir):
    """Sections of the texts themselves, read as Markdown with all their signs; SQL can't follow that."""
    ship(spark)
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(section_structs(F.col("text"))).alias("ord", "s")).select("doc_id", "ord", "s.heading_path", "s.text")


@query("SELECT doc_id, format('{:>2}. [{:.3f}] [{}] {}  ({})', doc_id % 20, n_chars / 7.0, source, lang, '/v/' || source) AS line, substring(text, 1, 280) AS snippet FROM documents")
def result_lines(spark, sf_dir):
    path = F.concat(F.lit("/v/"), F.col("source"))
    tag = F.concat(F.lit("["), T.root_label(path), F.lit("] "))
    line = T.result_line((F.col("doc_id") % 20).cast("int"), F.col("n_chars") / F.lit(7.0), tag, F.col("lang"), path)
    return _table(spark, sf_dir, "documents").select("doc_id", line.alias("line"), T.snippet(F.col("text")).alias("snippet"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash_groups(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


# --- snapshots
# `source` stands for the root. Version 2 of the corpus lacks the ids of 0 mod 10 and has new texts for those of 1 mod 7.

_OLD = "SELECT doc_id, source, sha256(text) AS h, n_chars FROM documents"
_NEW = "SELECT doc_id, source, sha256(CASE WHEN doc_id % 7 = 1 THEN text || '!' ELSE text END) AS h, n_chars FROM documents WHERE doc_id % 10 <> 0"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _table(spark, sf_dir, "documents").withColumnRenamed("source", "source_root")
    row = lambda df, t: df.select("doc_id", "source_root", F.sha2(t, 256).alias("content_hash"), "n_chars")
    edited = F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return row(d, F.col("text")), row(d.where("doc_id % 10 <> 0"), edited)


@query("SELECT (SELECT count(*) FROM documents) AS documents, count(*) FILTER (quality = 1) AS chunks_text, count(*) FILTER (quality = 0) AS chunks_image, (SELECT max(n_chars) FROM documents) AS indexed_at FROM labels")
def status_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("n_chars").alias("indexed_at"))
    chunks = _table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "text").when(F.col("quality") == 0, "image").alias("space"))
    return status(docs, chunks)


@query("SELECT source AS source_root, count(*) AS documents FROM documents GROUP BY 1")
def root_counts(spark, sf_dir):
    return counts_by_root(_table(spark, sf_dir, "documents"), "source")


@query(f"SELECT n.doc_id, CASE WHEN o.h = n.h THEN 'skip' ELSE 'index' END AS action FROM ({_NEW}) n LEFT JOIN (SELECT * FROM ({_OLD}) WHERE doc_id % 13 <> 2) o USING (doc_id)")
def change_detection(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return change_actions(new, old.where("doc_id % 13 <> 2"), key="doc_id").select("doc_id", "action")


@query(
    f"""SELECT count(*) AS scanned, count(*) FILTER (o.h IS DISTINCT FROM n.h) AS indexed, count(*) FILTER (o.h = n.h) AS skipped, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0 AND source <> 'src3') AS deleted
    FROM ({_NEW}) n LEFT JOIN ({_OLD}) o USING (doc_id)"""
)
def run_counters(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    a = change_actions(new, old, key="doc_id")
    gone = pruned(old, new, old.where("source_root <> 'src3'"), key="doc_id").agg(F.count("*").alias("deleted"))
    return a.agg(F.count("*").alias("scanned"), F.count_if(F.col("action") == "index").alias("indexed"), F.count_if(F.col("action") == "skip").alias("skipped")).crossJoin(gone)


@query(f"SELECT doc_id FROM ({_OLD}) WHERE source IN ('src0', 'src1', 'src2') AND doc_id NOT IN (SELECT doc_id FROM ({_NEW}))")
def prune_scoped(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return pruned(old, new, ["src0", "src1", "src2"], key="doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src3', 'src4')")
def root_paths(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("source_root"))
    return paths_for_roots(d, ["src3", "src4"]).withColumnRenamed("path", "doc_id")


@query(
    f"""SELECT doc_id, source AS source_root, h AS content_hash FROM ({_OLD}) WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 1
    UNION ALL SELECT doc_id, source, h FROM ({_NEW}) WHERE doc_id % 7 = 1"""
)
def upsert_snapshot(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    changed = change_actions(new, old, key="doc_id").where("action = 'index'")
    gone = pruned(old, new, old, key="doc_id").select("doc_id").unionByName(changed.select("doc_id"))
    return replaced(old, gone, changed.drop("action"), key="doc_id").select("doc_id", "source_root", "content_hash")


@query(
    """SELECT d.source AS source_root, count(*) AS documents, CAST(sum(1 + (len(d.text) > 900)::INT) AS BIGINT) AS chunks, count_if(doc_id % 3 = 0)::BIGINT AS links FROM documents d WHERE source <> 'src0' GROUP BY 1"""
)
def forget_root(spark, sf_dir):
    """An index of the table's documents is published, one root of it forgotten, and what is left counted."""
    ship(spark)
    path = F.col("doc_id").cast("string")
    d = _table(spark, sf_dir, "documents").withColumn("path", path)
    documents = d.select("path", F.lit("markdown").alias("kind"), F.col("source").alias("source_root"), F.unhex(F.sha2("text", 256)).alias("content_hash"), F.lit(0).cast("long").alias("mtime"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("frontmatter"), F.lit(1).cast("long").alias("indexed_at"))
    pieces = F.when(F.length("text") > 900, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    chunks = d.select("path", F.explode(pieces).alias("ord"), F.lit("text").alias("space"), F.lit("text").alias("modality"), F.col("lang").alias("text"), F.lit("").alias("heading_path"), F.lit(None).cast("array<float>").alias("vector"))
    links = d.where("doc_id % 3 = 0").select(F.col("path").alias("src_path"), F.col("lang").alias("dst"))
    ws = Workspace(Config(), Path("none"), f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}")
    store = Snapshot(spark, ws.store)
    store.publish(documents.select("path").limit(0), {"documents": documents, "chunks": chunks, "links": links}, {}, documents.count())
    indexer.forget(spark, ws, "src0")
    left = store.table("documents").select("path", "source_root")
    n_chunks, n_links = store.table("chunks").groupBy("path").agg(F.count("*").alias("chunks")), store.table("links").groupBy(F.col("src_path").alias("path")).agg(F.count("*").alias("links"))
    all_ = left.join(n_chunks, "path", "full").join(n_links, "path", "full")
    return all_.groupBy("source_root").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


@query(
    """SELECT path, source_root FROM (SELECT doc_id // 2 AS path, source AS source_root, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY CAST(substr(source, 4) AS INT), doc_id) AS n FROM documents) WHERE n = 1"""
)
def dedupe_first_root(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    rank = F.struct(F.substring("source", 4, 9).cast("int"), "doc_id")
    found = d.select(F.floor(F.col("doc_id") / 2).alias("path"), F.col("source").alias("source_root"), rank.alias("root_ord"))
    return first_root_wins(found).select("path", "source_root")


@query("SELECT d.source AS source_root, count(*) AS chunks FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def chunks_per_root(spark, sf_dir):
    """Chunks joined with their documents; the labels stand for chunks."""
    d, chunks = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_root")), _table(spark, sf_dir, "labels").select("doc_id")
    return chunks.join(d, "doc_id").groupBy("source_root").agg(F.count("*").alias("chunks"))
