import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tests.llm.test_operators import scanned_everywhere
from tests.test_queries import compare

from inkwell.llm import common, langid, pii, quality, queries
from inkwell.llm.bpe import SPLIT, encoder, split_words
from inkwell.llm.common import load, tokenizer_path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


def test_nearest_as_registered(spark):
    """Every id divisible by 50 has ten rows, and 0.9 of the true ten nearest are among them."""
    sf_dir = "/root/testdata/sf0.1"
    table = load(spark, sf_dir, "embeddings").toPandas()
    x, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.flatnonzero(ids % 50 == 0)
    s = np.round(x[own] @ x.T, 9)
    s[np.arange(len(own)), own] = -2
    true = {int(ids[q]): set(ids[np.lexsort((ids, -r))[:10]]) for q, r in zip(own, s)}
    got = queries.QUERIES["op6_nearest"](spark, sf_dir).toPandas().groupby("vec_id")["neighbour_id"]
    assert {q: len(g) for q, g in got} == dict.fromkeys(true, 10)
    assert np.mean([len(true[q] & set(g)) / 10 for q, g in got]) >= 0.9


def test_pseudonyms_as_registered(spark):
    """Every text against the plain scan of all kinds at all places, with neither search nor screen."""
    sf_dir = "/root/testdata/sf0.001"
    f = pii.Feistel(pii.DEMO_KEY)
    texts = {r["doc_id"]: r["text"] for r in load(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in queries.QUERIES["op5_pseudonyms"](spark, sf_dir).collect()}
    assert got == {k: scanned_everywhere(f, t) for k, t in texts.items()} and sum(n for _, n in got.values()) > 20


def test_quality_as_registered(spark):
    """Every score against the sum over all pairs of features, text by text."""
    sf_dir = "/root/testdata/sf0.001"
    docs = load(spark, sf_dir, "documents").toPandas()
    model = quality.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    got = queries.QUERIES["op7_quality"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        words, _, stats = quality.words_and_stats(pa.array([r.text]))
        meta = quality.meta_bins([r.lang], [r.source])[0] + len(model.buckets)
        values = dict.fromkeys(np.flatnonzero(np.isin(model.buckets, words)).tolist(), 1.0)
        values |= {int(m): quality.META_VALUE for m in meta}
        scaled = np.clip((stats[0] - model.mean) / model.scale, -6, 6)
        values |= {len(model.buckets) + quality.META + k: float(v) for k, v in enumerate(scaled)}
        at, x = np.array(list(values)), np.array(list(values.values()))
        for head in ("quality", "toxic"):
            p = model.heads[head]
            v = p["v"][at].astype(float) * x[:, None]
            z = float(p["b"][0]) + p["w"][at] @ x + sum(v[i] @ v[:i].sum(axis=0) for i in range(len(at)))
            want = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if len(words) else 0.0
            if meta[0] != meta[1]:
                assert abs(got[head][r.doc_id] - want) < 1e-3


def test_bpe_as_registered(spark):
    """Every text's tokens against a public implementation, and back."""
    sf_dir = "/root/testdata/sf0.001"
    e = encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=e.ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in load(spark, sf_dir, "documents").collect()}
    rows = queries.QUERIES["op1_bpe"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["tokens"] for r in rows} == {k: plain.encode_ordinary(t) for k, t in texts.items()}
    assert all(r["round_trip"] and plain.decode(r["tokens"]) == texts[r["doc_id"]] for r in rows)


def test_leaks_as_registered(spark):
    """Every document and item against the whole table of edit distances, filled row by row."""
    sf_dir = "/root/testdata/sf0.001"
    plain = lambda t: " ".join(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())).encode()
    docs = [(r["doc_id"], plain(r["text"])) for r in load(spark, sf_dir, "documents").collect()]
    # All texts in one row, apart by more of a byte that no item has than any item has edits.
    gap = b"\x00" * 200
    data = np.frombuffer(gap + gap.join(t for _, t in docs), np.uint8)
    owner = np.concatenate([np.full(len(t) + len(gap), k) for k, (_, t) in enumerate(docs)])
    steps, want = np.arange(len(data) + 1, dtype=np.int32), set()
    for r in load(spark, sf_dir, "benchmark").collect():
        item = plain(r["text"])
        row = np.zeros(len(data) + 1, np.int32)
        for n, c in enumerate(item, 1):
            new = np.empty_like(row)
            new[0] = n
            np.minimum(row[:-1] + (data != c), row[1:] + 1, out=new[1:])
            row = np.minimum.accumulate(new - steps) + steps
        best = np.full(len(docs), 10**6)
        np.minimum.at(best, owner, row[1:])
        want |= {(docs[k][0], r["item_id"], int(best[k])) for k in np.flatnonzero(best <= len(item) // 10)}
    assert {tuple(r) for r in queries.QUERIES["op8_leaks"](spark, sf_dir).collect()} == want and want


def test_language_as_registered(spark):
    """Every text against grams counted one by one, margins summed by bit, and losses compared by language."""
    sf_dir = "/root/testdata/sf0.001"
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_language_id"](spark, sf_dir).collect()}
    rows = docs.collect()
    for r in rows:
        raw, counts = r["text"].lower().encode(), {}
        for k in range(len(raw) - 1):
            for size in (2, 3):
                if k + size <= len(raw):
                    number = int.from_bytes(raw[k : k + size], "little") + (1 << 24) * (size == 2)
                    at = (number * 0x9E3779B1 % (1 << 32)) >> 20
                    counts[at] = counts.get(at, 0) + 1
        norm = sum(counts.values()) ** 0.5
        margins = sum(n**0.5 / norm * model["w"][at].astype(float) for at, n in counts.items()) + model["b"]
        loss = sorted((sum(np.log1p(np.exp(-m * c)) for m, c in zip(margins, code)) / len(code), name) for name, code in zip(model["names"], model["code"]))
        own = got[r["doc_id"]]
        assert abs(own["loss"] - loss[0][0]) < 1e-3 and abs(own["margin"] - (loss[1][0] - loss[0][0])) < 2e-3
        assert own["predicted"] == loss[0][1] or loss[1][0] - loss[0][0] < 1e-3
    assert np.mean([got[r["doc_id"]]["predicted"] == r["lang"] for r in rows if len(r["text"]) > 200]) > 0.9


def test_pipeline_leaves_one_table(spark):
    before = common.written(spark)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert common.written(spark) == before + 1


def test_pipeline_stage_by_stage(spark):
    """Each stage's decisions against its operator's own output, and the last one's tokens against plain merging."""
    sf_dir = "/root/testdata/sf0.001"
    docs = load(spark, sf_dir, "documents")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir).cache()
        assert after.schema.names == docs.schema.names and ids(after) <= ids(kept)
        seen.append(name)
        if name == "near_duplicates":
            assert not corpus_pipeline.drop_near_duplicates(after).select("doc_id").exceptAll(after.select("doc_id")).count()
        if name == "pseudonyms":
            assert after.count() == kept.count()
        kept = after
    assert seen == ["quality", "near_duplicates", "decontamination", "pseudonyms"]
    e = encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect():
        want = [t for w in split_words(texts[r["doc_id"]]) for t in e._merge(w.encode(), 1 << 30)]
        assert r["tokens"] == want and r["round_trip"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == set(texts)


def test_pipeline_of_no_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = load(spark, sf_dir, "documents").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
