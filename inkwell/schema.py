"""Table schemas of an index snapshot; `path` is the key that joins them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StringType, StructField, StructType

DOCUMENTS = StructType([
    StructField("path", StringType(), False),
    StructField("kind", StringType(), False),
    StructField("source_root", StringType(), False),
    StructField("content_hash", BinaryType(), False),
    StructField("mtime", LongType(), False),
    StructField("title", StringType()),
    StructField("frontmatter", StringType()),
    StructField("indexed_at", LongType(), False),
])
CHUNKS = StructType([
    StructField("path", StringType(), False),
    StructField("ord", IntegerType(), False),
    StructField("space", StringType(), False),
    StructField("modality", StringType(), False),
    StructField("text", StringType()),
    StructField("heading_path", StringType()),
    StructField("vector", ArrayType(FloatType())),
])
LINKS = StructType([StructField("src_path", StringType(), False), StructField("dst", StringType(), False)])
FOUND = StructType([
    StructField("path", StringType()),
    StructField("kind", StringType()),
    StructField("source_root", StringType()),
    StructField("root_ord", IntegerType()),
    StructField("mtime", LongType()),
    StructField("content_hash", BinaryType()),
])
#: The column of each table that holds the path of its document.
KEYS = {"documents": "path", "chunks": "path", "links": "src_path"}
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "links": LINKS}
