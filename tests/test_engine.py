import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.embed import HashingEmbedder, OnnxEmbedder, embedded, known_dim
from inkwell.functions import text as T
from inkwell.functions.markdown import sections
from inkwell.operators import search as S
from inkwell.operators.changes import paths_for_roots
from inkwell.plans.indexer import chunk_rows
from inkwell.plans.scratch import clear_scratch, scratch_dir
from inkwell.plans.storage import Storage
from inkwell.queries import QUERIES


def test_chunks_of_two_headings(spark):
    words = " ".join(f"w{k}" for k in range(24))
    body = f"# Upper\n{words}.\n## Lower\n{words}!\n"
    got = chunk_rows(spark.createDataFrame([("p", body)], "path string, body string"), 10, 2).orderBy("ord").collect()
    assert [(r["ord"], r["heading_path"]) for r in got] == [(k, "Upper" if k < 3 else "Upper > Lower") for k in range(6)]
    assert [len(r["text"].split()) for r in got] == [10, 10, 8] * 2 and got[1]["text"].startswith("w8 ") and got[5]["text"].endswith("w23!")


def test_roots_without_a_name_give_no_paths(spark):
    docs = spark.createDataFrame([("a", "/r"), ("b", "/s")], "path string, source_root string")
    assert paths_for_roots(docs, []).count() == 0
    assert [r["path"] for r in paths_for_roots(docs, ["/s", "/none"]).collect()] == ["b"]


@pytest.mark.parametrize("model,dim", [("bge-small-en-v1.5", 384), ("bge-base-en-v1.5", 768), ("all-MiniLM-L6-v2", 384), ("nomic-embed-text-v1.5", 768)])
def test_embedder_gives_unit_vectors_of_the_models_size(model, dim):
    own = HashingEmbedder(model)
    assert own.dim == dim == known_dim(model)
    v = np.array(own.embed(["a king rules over the realm", "a queen rules over the realm", "we fixed an engine part today", ""]))
    assert v.shape == (4, dim) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-3)
    assert v[0] @ v[1] > v[0] @ v[2]


def test_unknown_model():
    with pytest.raises(ValueError, match="unknown text model"):
        known_dim("none")


def message(*fields):
    """A protocol buffer of (number, value) fields: ints as varints, bytes and strings as they are, others as messages."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def tiny_encoder(folder, table):
    """An ONNX model that looks up each token's row of a table, and a tokenizer of five words."""
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    words = {w: k for k, w in enumerate(["[CLS]", "[PAD]", "king", "queen", "car"])}
    t = Tokenizer(models.WordLevel(words, unk_token="[PAD]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="$A [CLS]", special_tokens=[("[CLS]", 0)])
    t.save(str(folder / "tokenizer.json"))
    dim = lambda d: message((1, message((1 if isinstance(d, int) else 2, d))))
    shaped = lambda name, kind, *dims: message((1, name), (2, message((1, message((1, kind), (2, b"".join(map(dim, dims))))))))
    weights = message((1, table.shape[0]), (1, table.shape[1]), (2, 1), (8, "table"), (9, table.astype("<f4").tobytes()))
    node = message((1, "table"), (1, "input_ids"), (2, "hidden"), (4, "Gather"))
    graph = message((1, node), (2, "g"), (5, weights), (11, shaped("input_ids", 7, "batch", "length")), (12, shaped("hidden", 1, "batch", "length", table.shape[1])))
    (folder / "model.onnx").write_bytes(message((1, 8), (7, graph), (8, message((1, ""), (2, 13)))))


def test_onnx_encoder_runs(spark, tmp_path):
    table = np.random.default_rng(1).normal(size=(5, 6)).astype(np.float32)
    tiny_encoder(tmp_path, table)
    own = OnnxEmbedder(f"onnx:{tmp_path}")
    assert own.dim == 6
    got = np.array(own.embed(["king", "queen car", "car"]))
    first = table[[2, 3, 4]]
    assert np.allclose(got, first / np.linalg.norm(first, axis=1, keepdims=True), atol=1e-6)
    assert own.embed([]) == []
    frame = spark.createDataFrame([("king",), (None,), ("car",)], "t string")
    rows = frame.select("t", embedded(F.col("t"), f"onnx:{tmp_path}").alias("v")).where("t IS NOT NULL").collect()
    assert np.allclose([r["v"] for r in rows], got[[0, 2]], atol=1e-6)


def test_a_long_note_with_code_and_a_raw_link(spark):
    """The first heading line outside the fences, by parity of fence lines alone, gives the title; a link runs on over lines."""
    long = "x, ".join(f"part {k}\n" for k in range(140))
    body = "intro\n\n````md\n```sh\n# a comment in code\n```\n````\n\n" + "para\n\n" * 4000 + f"# Real\n\nsee [[{long}]] and [[short|s]]\n"
    row = spark.createDataFrame([("/v/big.md", body)], "path string, content string").select(T.parsed(F.col("path"), F.col("content")).alias("n")).first()["n"]
    assert row["title"] == "a comment in code" and [len(x) for x in row["links"]] == [len(long.strip()), 5]
    assert sections(body)[0] == ("", ("intro\n```sh\n# a comment in code\n```\n\n" + "para\n" * 4000).strip())


def brute(rows, asked, k):
    out = []
    for q, v in rows:
        if q in asked and v is not None:
            s = []
            for i, x in rows:
                if x is not None:
                    d = sum(a * b for a, b in zip(map(float, v), map(float, x))) if len(v) == len(x) else 0.0
                    s.append((-(float("-inf") if np.isnan(d) else d), i))
            out += [(q, r, i) for r, (_, i) in enumerate(sorted(s)[:k], 1)]
    return out


def test_many_queries_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-2, 3, 4).tolist()) for k in range(300)] + [(300, None), (301, []), (302, [1.0]), (303, [float("nan")] * 4), (304, [1.0])]
    frame = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>").repartition(3)
    asked = {*range(0, 300, 7), 300, 301, 302, 303}
    for size in (16 << 20, 500):
        monkeypatch.setattr(S, "PASS_BYTES", size)
        got = S.search_each(frame, frame.where(F.col("vec_id").isin(*asked)), 5)
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == sorted(brute(rows, asked, 5))
        links = {r["query_id"]: r["links"] for r in S.count_near(frame, frame.where(F.col("vec_id").isin(*asked)), 3.0).collect()}
        assert links[0] == sum(np.dot(rows[0][1], v) >= 3 for i, v in rows[1:300]) and links[303] == 0
    assert S.search_each(frame, frame.limit(0), 5).count() == S.search_each(frame.limit(0), frame, 5).count() == S.search_each(frame, frame, 0).count() == 0


def test_sections_of_whole_texts(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], k, h, t) for r in texts for k, (h, t) in enumerate(sections(r["text"]))}
    assert {tuple(r) for r in QUERIES["note_sections"](spark, sf_dir).collect()} == want and len(want) >= 190


def test_storage(spark, tmp_path):
    files = Storage(spark, tmp_path / "a b")
    assert not files.exists("x")
    files.write("d/x", "é1")
    files.write("d/x", "é2")
    assert files.read("d/x") == "é2" and files.exists("d/x")
    files.delete("d")
    assert not files.exists("d/x") and files.at("x").startswith("file:")


def test_scratch_is_cleared(spark):
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/some-table"
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    assert not Storage(spark, path).exists(".")


@pytest.mark.parametrize("find", [lambda e, q: S.search_each(e, q, 5), lambda e, q: S.count_near(e, q, 0.5)], ids=["search_each", "count_near"])
def test_many_queries_in_bounded_memory(spark, monkeypatch, find):
    """A worker's memory follows neither the queries of a pass nor the rows of a batch."""
    rng, passes = np.random.default_rng(4), []
    frame = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(3000)], "vec_id long, embedding array<float>")
    whole = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: passes.append(run) or whole(self, run, schema))
    find(frame, frame)
    vectors = pa.array(rng.normal(size=(10_000, 4)).tolist(), pa.list_(pa.float64()))
    batch = pa.record_batch([pa.array(np.arange(10_000)), vectors], ["key", "vector"])
    passes[0](iter([batch]))
    tracemalloc.start()
    got = sum(b.num_rows for b in passes[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(passes) == 1 and got >= 3000 and peak < 100e6


def left_to_right(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y  # sum() would compensate
    return total


def test_equal_vectors_have_equal_scores_wherever_they_stand(spark):
    """Products of matrices add in an order that depends on their shapes; ties go by the key all the same."""
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(9, 64)).astype(np.float32)
    rows = [(k, kinds[k % 9].tolist()) for k in range(4613)] + [(5000, [float("inf")] + [1.0] * 63), (5001, [3e38] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    asked = frame.where("vec_id < 7 OR vec_id > 4999")
    order = {q: sorted(rows, key=lambda r: (-left_to_right(v, r[1]), r[0])) for q, v in rows[:7]}
    got = S.search_each(frame, asked, 700).where("query_id < 7").collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, k, r[0]) for q, best in order.items() for k, r in enumerate(best[:700], 1)}
    least = S.search_each(frame, asked, 700).where("query_id = 0 AND rank = 600").first()["score"]
    links = {r["query_id"]: r["links"] for r in S.count_near(frame, asked, least).collect()}
    dots = {i: left_to_right(rows[0][1], v) for i, v in rows}
    assert links[0] == sum(d >= least for i, d in dots.items() if i)
    own = frame.select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("vector"))
    best = {r["path"]: r["score"] for r in S.best_pairs(own, own.where("path IN ('0', '1', '2')")).collect()}
    for i in (3, 12, 4611, 4612, 5000):
        want = max(left_to_right(rows[q][1], dict(rows)[i]) for q in (0, 1, 2))
        assert best[str(i)] == want
