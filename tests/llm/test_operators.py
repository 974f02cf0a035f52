"""Each operator against a brute-force version, with nulls, empty, long and repeated rows, ties, empty tables and clashing columns."""

import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from inkwell.llm import bpe, cascade, components, decontaminate, fixity, hashing_ann, langid, minhash, pii, quality, suffixes
from inkwell.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket long, `a.b` string"
WORDS = [a + b + c for a in ("ba", "ke", "li", "mo", "nu") for b in ("r", "st", "nd", "l") for c in ("an", "e", "ist", "ou")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", None if t is None else len(t), 7, "x") for i, t in rows], DOCS)


def norm(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())


# ---- 1 ----


def test_bpe_equals_merging(spark):
    e = bpe.encoder(tokenizer_path(bpe.VOCABULARY))
    whole = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab c'stREé²١ \n\t日😀_-.0 ªİß<|endoftext|>", k=rng.randint(0, 60))) for _ in range(400)] + [prose(rng, 30_000), "a" * 5000, "", " "]
    assert [x.tolist() for x in e.encode_texts(texts)] == [whole.encode_ordinary(t) for t in texts]
    assert [e.decode(x.tolist()) for x in e.encode_texts(texts)] == texts
    rows = [(1, "Hello world"), (1, "Hello world"), (None, ""), (2, None)]
    got = {(r["doc_id"], r["n_tokens"], r["round_trip"], None if r["tokens"] is None else tuple(r["tokens"])) for r in bpe.encode(table(spark, rows)).collect()}
    assert got == {(1, 2, True, tuple(whole.encode_ordinary("Hello world"))), (None, 0, True, ()), (2, None, None, None)}
    encoded = bpe.encode(table(spark, rows))
    assert encoded.columns == ["doc_id", "lang", "source", "n_chars", "bucket", "a.b", "tokens", "n_tokens", "round_trip"]
    assert sorted(map(str, (r["text"] for r in bpe.decode(encoded).collect()))) == sorted(map(str, (t for _, t in rows)))
    assert bpe.encode(table(spark, [])).count() == 0


# ---- 2 ----


def brute_groups(rows, threshold):
    sets = {}
    for i, t in rows:
        if i is not None and t and norm(t):
            w = norm(t)
            sets.setdefault(i, []).append(set(zip(w, w[1:])) if len(w) > 1 else set(w))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(len(a & b) / len(a | b) >= threshold for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = {}
    for i in sets:
        out.setdefault(root(i), []).append(i)
    return sorted((i, g, len(m), i == g) for g, m in out.items() if len(m) > 1 for i in m)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(None, "null id"), (None, "null id"), (900, None), (901, ""), (902, "?!"), (903, "One"), (904, "one!")]
    for k in range(6):
        base = prose(rng, rng.choice([40, 200, 3000])).split()
        for c in range(rng.choice([1, 2, 12])):
            w = [x if rng.random() > 0.04 else rng.choice(WORDS) + "x" for x in base]
            rows.append((100 * k + c, " ".join(w) if c % 2 else ", ".join(w).upper()))
    rows += [(0, rows[7][1]), (700, rows[-1][1]), (700, rows[-1][1])]
    docs = table(spark, rows)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_groups(rows, minhash.THRESHOLD) and len(got) > 15
    kept = minhash.drop_near_duplicates(docs)
    gone = {i for i, _, _, keep in got if not keep}
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in gone)


def test_one_bucket_of_all_rows(spark, monkeypatch):
    """All documents share a bucket and most are dissimilar: rounds go on until every pair of different components is compared."""

    def same(batches):
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([[7]] * b.num_rows, pa.list_(pa.int64()))], ["doc_id", "bands"])

    rng, rows = random.Random(26), []
    for k in range(24):
        base = prose(rng, 40).split()
        for c in range(k % 4 + 1):
            # Each copy is near the one before and ever further from the first.
            base = [w if rng.random() > 0.08 else rng.choice(WORDS) + "y" for w in base]
            rows.append((10 * k + 3 - c if k % 2 else 10 * k + c, " ".join(base)))
    monkeypatch.setattr(minhash, "_bands", same)
    monkeypatch.setattr(minhash, "HUBS", 12)
    got = sorted(tuple(r) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == brute_groups(rows, minhash.THRESHOLD) and len(got) > 20


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_of_chains_and_empty(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (100, 101), (101, 101), (None, 3)]
    got = {r["doc_id"]: r["comp"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_signature_agrees_with_jaccard():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 600).astype(np.uint64)
    same = (minhash.signature(x[:400], 512) == minhash.signature(x[200:], 512)).mean()
    assert abs(same - 1 / 3) < 0.08


# ---- 3 ----


def test_cascade_is_exact(spark):
    urls = [f"http://{h}.example.com/p/{k}" for h in ("spam-farm", "blog.casino-win", "ok", "m.fine") for k in range(150)]
    rows = [(k, u, 1) for k, u in enumerate(urls)] + [(None, urls[0], 1), (1, None, 1), (2, "", 1), (3, "HTTPS://Spam-Farm.example.com:80/x/?a#b", 1), (4, "no scheme", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key long")
    listed = cascade.demonstration_list(pages)
    got = cascade.filter_urls(pages, listed.unionByName(listed).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS key UNION ALL SELECT 'unseen'"))).collect()
    assert len(got) == len(rows)
    assert all(r["blocked"] == bool(r["url"] and re.search("spam-farm|casino-win", r["url"].lower())) for r in got)
    assert {r["key"] for r in got if r["page_id"] == 3 and r["url"].startswith("HTTPS")} == {"spam-farm.example.com/x"}
    assert not cascade.filter_urls(pages, listed.limit(0)).where("blocked").count()
    assert cascade.filter_urls(pages.limit(0), listed).count() == 0


def test_cascades_by_ranges_of_keys_give_the_same(spark, monkeypatch):
    rows = [(k, f"http://{'spam-farm' if k % 3 else 'ok'}.example.com/{k}") for k in range(900)] + [(None, None), (1, "http://ok.example.com/" + "long" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = cascade.demonstration_list(pages)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = order(cascade.filter_urls(pages, listed))
    assert len(cascade.cascades(pages, listed)) == 1 and [r[3] for r in want] == [bool(r[1]) and "spam-farm" in r[1] for r in want]
    monkeypatch.setattr(cascade, "MAX_BYTES", 400)
    built = cascade.cascades(pages, listed)
    assert len(built) > 2 and order(cascade.filter_urls(pages, listed, built)) == want
    kept = pickle.loads(pickle.dumps(built))
    assert order(cascade.filter_urls(pages, listed, kept)) == want
    assert max(sum(x.bits for x in c.levels) for c in built) < 8 * 400 * 1.5


# ---- 4 ----


def test_fixity_audit_finds_the_damage(spark):
    rows = [(k, f"u{k}", f"<p>{k}</p>", 1) for k in range(1200)] + [(None, "n", None, 1), (None, "m", "", 1), (5, "u5", "copy", 1)]
    schema = "page_id long, url string, html string, node int"
    bad = [r for r in rows if r[0] not in (10, 600)]
    bad = [(r[0], r[1], r[2] + "!" if r[0] in (0, 511, 512, 1199) else r[2], 1) for r in bad] + [(5000, "new", "x", 1)]
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(bad, schema)
    got = sorted((r["page_id"], r["status"]) for r in fixity.audit(a, b).collect())
    assert got == [(0, "corrupt"), (10, "missing"), (511, "corrupt"), (512, "corrupt"), (600, "missing"), (1199, "corrupt"), (5000, "extra")]
    assert fixity.audit(a, a).count() == 0
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0
    assert fixity.audit(a.where("page_id < 3"), a.limit(0)).count() == 3
    assert {r["status"] for r in fixity.audit(a.limit(0), a.where("page_id < 3")).collect()} == {"extra"}


def brute_audit(old, new):
    """Statuses by (page_id, number of copies), from multisets of records."""
    a, b = (Counter((i, u or "", h or "") for i, u, h in rows) for rows in (old, new))
    lost, gained = a - b, b - a
    out = Counter()
    for i in {r[0] for r in [*lost, *gained]}:
        x, y = ({r: n for r, n in c.items() if r[0] == i} for c in (lost, gained))
        if i is not None and sum(x.values()) == sum(y.values()) == 1:
            out[i, 1, "corrupt"] += 1
        else:
            for rows, status in ((x, "missing"), (y, "extra")):
                for n in rows.values():
                    out[i, n, status] += 1
    return out


def test_fixity_audit_equals_brute_force(spark):
    rng = random.Random(21)
    base = [(k, f"u{k}", f"<p>{k % 7}</p>") for k in range(20)]
    moved = [(k if k < 7 else k + 1, u, h) for k, u, h in base]
    file_ = [(1024 + k, f"u{k}", "x") for k in range(600)]
    hot = [(9, f"u{k}", "y" * (k % 5)) for k in range(5000)] + [(None, f"n{k}", None) for k in range(5000)] + [(None, "same", "z")] * 5000
    cases = [(base, moved), (file_, [(k - 512, u, h) for k, u, h in file_]), (hot + base, hot[1:4990] + hot[5003:14_990] + base[:7] + [(-3, "neg", "h"), (10**12, "far", "h")])]
    for _ in range(2):
        rows = [(rng.choice([None, rng.randint(-40, 1300)]), rng.choice(["a", "b", None]), rng.choice(["", "x", None, "long " * 9000])) for _ in range(400)]
        cases.append((rows, [r if rng.random() > 0.1 else (r[0], "c", r[2]) for r in rows if rng.random() > 0.05] + rng.choices(rows, k=5)))
    for old, new in cases:
        frames = [spark.createDataFrame(x, "page_id long, url string, html string") for x in (old, new)]
        got = Counter((r["page_id"], r["copies"], r["status"]) for r in fixity.audit(*frames).collect())
        assert got == brute_audit(old, new) and got


def test_offsets_follow_one_another(spark):
    rows = [(k % 3 if k % 4 else None, f"u{k % 50}", "h" * (k % 11)) for k in range(300)]
    got = fixity.leaves(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("warc_file", "slot").collect()
    at, slot = {}, {}
    for r in got:
        assert r["offset"] == at.get(r["warc_file"], 0) and r["slot"] == slot.get(r["warc_file"], 0)
        at[r["warc_file"]], slot[r["warc_file"]] = r["offset"] + r["length"] * r["copies"], r["slot"] + 1
    assert sum(r["copies"] for r in got) == 300


# ---- 5 ----


def test_feistel_is_a_permutation():
    f = pii.Feistel("k")
    assert sorted(tuple(f([a, b], [10, 7], "t")) for a in range(10) for b in range(7)) == [(a, b) for a in range(10) for b in range(7)]
    assert pii.Feistel("other")([1, 2, 3], [10] * 3, "t") != f([1, 2, 3], [10] * 3, "t")


@pytest.mark.parametrize(
    "kind,value",
    [("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713"), ("phone", "+49 30 1234567"), ("ip", "97.51.17.173"), ("ssn", "123-45-6789"), ("date", "2024-02-29"), ("date", "31/12/1999"), ("date", "01.02.2003"), ("iban", "DE89 3704 0044 0532 0130 00"), ("email", "und.34@mail7.example.com")],
)
def test_pseudonyms_keep_the_format(kind, value):
    f = pii.Feistel("k")
    text, n = pii.pseudonymised(f, f"é see {value}, and {value}.")
    new = re.fullmatch(r"é see (.*), and \1\.", text)[1]
    assert n == 2 and new != value and len(new) == len(value) and pii._FIND.fullmatch(new).lastgroup == kind
    assert re.sub(r"[0-9]", "9", new) == re.sub(r"[0-9]", "9", value) or kind in ("email", "iban")
    digits = [int(c) for c in new if c.isdigit()]
    assert kind != "card" or pii.luhn(digits[:-1]) == digits[-1]
    assert kind != "iban" or pii._iban(f, new) != new


def test_long_runs_and_neighbours():
    f = pii.Feistel("k")
    run = "a1B2" * 100_000
    assert pii.pseudonymised(f, f"{run} 12 {run}")[1] == 0
    text, n = pii.pseudonymised(f, "+1 (269) 555-3296 4524132264652876 555 .jo@x.org, 4111 1111 1111 1111 555")
    assert n == 3 + (pii.luhn([int(c) for c in "452413226465287"]) == 6) and text.endswith(" 555") and "jo@" not in text


@pytest.mark.parametrize(
    "value,rest",
    [("3056 930902 5904", ""), ("4222 222 222 222", ""), ("4222-222-222-222", ""), ("6304 0000 0000 0000 000", " 1234"), ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", ""), ("4111 1111 1111 1111", " 4222-222-222-222"), ("BE68 5390 0754 7034", " FROM"), ("ES9121000418450200051332", " BIC"), ("BE68 5390 0754 7034", " 1234 5678")],
)
def test_groups_and_what_follows(value, rest):
    f = pii.Feistel("k")
    got, counts = pii._replaced(pa.array([f"no {value}{rest}", f"77 {value}{rest}."]), f)
    both = 1 + (len(rest) > 10)
    assert counts == [both, both] and value not in got[0].as_py() + got[1].as_py()
    assert len(got[0].as_py()) == len(f"no {value}{rest}") and (both == 2 or got[0].as_py().endswith(rest))


def test_card_groups_leave_dates_and_phones_whole():
    f = pii.Feistel("k")
    for k in range(100):
        text = f"{k} 2024-01-{k % 28 + 1:02d} 2024 555-123-45{k:02d} 555-123-4568"
        date, phone = text.split()[1], text.split()[3]
        got = pii.pseudonymised(f, text)[0].split()
        assert got[1] == pii.pseudonymised(f, date)[0] and got[3] == pii.pseudonymised(f, phone)[0]


@pytest.mark.parametrize(
    "text,values",
    [
        ("+1 415 555 0123 4111 1111 1111 1111", ["+1 415 555 0123", "4111 1111 1111 1111"]),
        ("+1 415 555 0123 2024-01-02", ["+1 415 555 0123", "2024-01-02"]),
        ("call +44 20 7183 8750 020 7183 8751", ["+44 20 7183 8750"]),
        ("call +442071838750 2024 now", ["+442071838750"]),
        ("+49 30 12345 4111 1111 1111 1111", ["+49 30 12345", "4111 1111 1111 1111"]),
        ("+123456789012345678 4111111111111111", ["4111111111111111"]),
        ("000-12-3456 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("DE89370400440532013000 +1 415 555 0123 97.51.17.173", ["DE89370400440532013000", "+1 415 555 0123", "97.51.17.173"]),
    ],
)
def test_phones_end_where_others_begin(text, values):
    f = pii.Feistel("k")
    got, n = pii.pseudonymised(f, text)
    want = text
    for v in values:
        want = want.replace(v, pii.pseudonymised(f, v)[0])
    assert (got, n) == (want, len(values)) and not any(v in got for v in values)


def test_phones_link_in_all_forms():
    one = [re.sub("[^0-9]", "", pii.pseudonymised(pii.Feistel("k"), v)[0]) for v in ("+14155550123", "+1 415 555 0123", "+1 (415) 555-0123")]
    assert len(set(one)) == 1 and one[0][0] == "1"
    assert re.sub("[^0-9]", "", pii.pseudonymised(pii.Feistel("k"), "(415) 555-0123")[0]) == one[0][1:]


def test_addresses_have_pseudonyms_of_their_own():
    f = pii.Feistel("k")
    values = [f"{a}.{b}.7.{c}" for a in (1, 9, 10, 99, 100, 255) for b in range(0, 256, 5) for c in (0, 9, 10, 200)]
    new = [pii._ip(f, v) for v in values]
    assert len(set(new)) == len(values) and [len(v) for v in new] == [len(v) for v in values]


def test_dates_of_all_forms_have_pseudonyms_of_their_own():
    f = pii.Feistel("k")
    days = [f"{y}-{m:02d}-{d:02d}" for y in range(1900, 2100, 7) for m in range(1, 13) for d in range(1, 29)]
    slashed = {f"{d:02d}/{m:02d}/{y}" for y in range(1990, 2011) for m in range(1, 32) for d in range(1, 32) if min(m, d) < 13 and max(m, d) < 29}
    new = [pii._date(f, s) for s in slashed]
    assert len(set(new)) == len(slashed) and None not in new
    assert all(pii._date(f, s) is not None for s in set(new))
    iso = [pii._date(f, s) for s in days]
    assert len(set(iso)) == len(days)
    turn = lambda s: f"{s[8:]}/{s[5:7]}/{s[:4]}"
    assert [pii._date(f, turn(s)) for s in days[:500]] == list(map(turn, iso[:500]))


def scanned_everywhere(f, text):
    """The values found by trying every kind at every place, without search or screen."""
    out, n, at = "", 0, 0
    while at < len(text):
        if got := pii._accepted(f, text, at):
            out, n, at = out + got[1], n + 1, at + len(got[0])
        else:
            out, at = out + text[at], at + 1
    return out, n


def test_neighbouring_values_of_all_kinds():
    rng, f = random.Random(20), pii.Feistel("k")
    make = {
        "card": lambda: rng.choice(["4111 1111 1111 1111", "4222222222222", "3056-930902-5904"]),
        "iban": lambda: rng.choice(["DE89 3704 0044 0532 0130 00", "BE68539007547034"]),
        "date": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        "ssn": lambda: f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "phone": lambda: rng.choice(["+1 415 555 0123", "+442071838750", "(415) 555-0123", "415-555-0123"]),
        "ip": lambda: f"{rng.randint(1, 126)}.{rng.randint(0, 255)}.7.{rng.randint(0, 255)}",
        "email": lambda: f"name{rng.randint(1, 99)}@x.org",
    }
    for _ in range(1500):
        kinds = rng.choices(list(make), k=rng.randint(1, 4))
        values = [make[k]() for k in kinds]
        noise = rng.choice(["", "7 ", "12345 ", "x1 ", "2024 "])
        for text in (", ".join(values), noise + " and ".join(values), "; ".join(values) + " " + noise):
            got, n = pii.pseudonymised(f, text)
            assert (got, n) == scanned_everywhere(f, text) and n >= len(values)
            assert pii._replaced(pa.array([text]), f)[0].to_pylist() == [got]
            assert not any(v in got for v in values if len(v) > 8)
        got, n = pii.pseudonymised(f, " ".join(values))
        assert (got, n) == scanned_everywhere(f, " ".join(values)) and not any(v in got for v in values if len(v) > 8), values


@pytest.mark.parametrize("value", ["4111111111111112", "999.1.1.1", "127.0.0.1", "2023-02-30", "000-12-3456", "DE00 3704 0044 0532 0130 00", "version 4.0.", "12345", "a@b"])
def test_invalid_values_stay(value):
    assert pii.pseudonymised(pii.Feistel("k"), value) == (value, 0)


def test_pseudonyms_of_a_table(spark):
    rows = [(1, "mail jo.1@x.org"), (2, "to jo.1@x.org " + "z " * 200_000), (2, None), (None, ""), (3, "clean 2.0. text")]
    docs = table(spark, rows).withColumn("n_replaced", F.lit(9))
    got = {r["doc_id"]: r for r in pii.pseudonyms(docs).where("text IS NOT NULL").collect()}
    one, two = (re.search(r"\S+@x\.org", got[k]["text"])[0] for k in (1, 2))
    assert one == two != "jo.1@x.org" and got[1]["n_replaced"] == 1 and got[3]["text"] == rows[4][1] and got[None]["text"] == ""
    plain = pii.replace_pii(docs)
    assert plain.columns == docs.columns and {r["n_replaced"] for r in plain.collect()} == {9} and plain.count() == 5
    assert pii.replace_pii(docs.limit(0)).count() == 0


# ---- 6 ----


def test_nearest_has_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    x[:60] = x[60] + rng.normal(scale=0.05, size=(60, 32))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    extra = [(None, [1.0] * 32, 1), (1000, None, 1), (1001, [0.0] * 32, 1), (1002, [1.0], 1), (1003, [float("nan")] * 32, 1), (1004, [], 1), (7, x[7].tolist(), 1)]
    got = hashing_ann.nearest(spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>, rank int")).toPandas()
    assert set(got["vec_id"]) == set(range(900)) and not (got["vec_id"] == got["neighbour_id"]).any()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {k: set(np.argsort(-r)[:10].tolist()) for k, r in enumerate(s)}
    assert np.mean([len(true[k] & set(g)) / 10 for k, g in got.groupby("vec_id")["neighbour_id"]]) >= 0.9
    assert hashing_ann.nearest(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>, rank int")).count() == 0


def test_sparse_vectors_have_neighbours_too(spark):
    rng = np.random.default_rng(17)
    x = np.repeat(rng.normal(size=(40, 32)), 20, axis=0) + rng.normal(scale=1e-4, size=(800, 32))
    x[:24] = rng.normal(size=(24, 32))
    got = hashing_ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).toPandas()
    assert (got.groupby("vec_id").size() == 10).sum() == 800
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    tenth = np.sort(s, axis=1)[:, -10]
    recall = {k: np.mean([s[k, j] >= tenth[k] - 1e-6 for j in g]) for k, g in got.groupby("vec_id")["neighbour_id"]}
    assert np.mean([recall[k] for k in range(24)]) >= 0.9 and min(recall.values()) >= 0.5


def true_neighbours(ids, x, own, k=10):
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u[own] @ u.T, 6)
    s[np.arange(len(own)), own] = -2
    return {int(ids[q]): np.sort(r)[::-1][:k] for q, r in zip(own, s)}


def test_probing_settles_queries_with_near_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(18)
    x = (np.repeat(rng.normal(size=(60, 32)), 20, axis=0) + rng.normal(scale=0.01, size=(1200, 32))).astype(np.float32)
    x[600:840] = x[600]
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen, searched = [], hashing_ann.searched
    monkeypatch.setattr(hashing_ann, "searched", lambda indexed, queries, count, *a: seen.append(count) or searched(indexed, queries, count, *a))
    run = lambda: hashing_ann.nearest(docs, query=F.col("vec_id") % 7 == 0).orderBy("vec_id", "rank").toPandas()
    got = run()
    assert sum(seen) < 10 and set(got["vec_id"]) == set(range(0, 1200, 7)) and (got.groupby("vec_id").size() == 10).all()
    true = true_neighbours(np.arange(1200), x, np.arange(0, 1200, 7))
    assert all(np.allclose(g, true[q], atol=2e-5) for q, g in got.groupby("vec_id")["cosine"])
    copies = got[got["vec_id"].isin(range(602, 840, 7))]
    assert all(g.tolist() == list(range(600, 610)) for q, g in copies.groupby("vec_id")["neighbour_id"] if q >= 610)
    monkeypatch.setattr(hashing_ann, "HOT", 3)
    before = len(seen)
    assert run().equals(got) and sum(seen[before:]) > 100


def test_repeated_ids_and_passes(spark, monkeypatch):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    rows = [(k, v.tolist(), "c") for k, v in enumerate(x)]
    docs = spark.createDataFrame(rows + [(5, [9.0] * 16, "c"), (5, [-9.0] * 16, "c")], "vec_id long, embedding array<float>, code string")
    want = [tuple(r) for r in hashing_ann.nearest(docs).orderBy("vec_id", "rank").collect()]
    x[5] = min([x[5] / np.linalg.norm(x[5]), np.full(16, 0.25), np.full(16, -0.25)], key=lambda v: v.tolist())
    true = true_neighbours(np.arange(300), x, np.arange(300))
    assert np.mean([abs(s - true[q][r - 1]) < 1e-5 for q, r, _, s in want]) >= 0.9
    monkeypatch.setattr(hashing_ann, "PASS_BYTES", 4000)
    monkeypatch.setattr(hashing_ann, "BLOCK", 50)
    assert [tuple(r) for r in hashing_ann.nearest(docs).orderBy("vec_id", "rank").collect()] == want


@pytest.mark.parametrize("radius", [0, 3, 7, 11, 20, 40])
def test_index_finds_every_code(radius):
    code = np.random.default_rng(6).integers(0, 64, (500, 4)).astype(np.uint16) * 1021
    index = hashing_ann.Index(code)
    for q, rows in zip(code[:70], index.within(code[:70], radius)):
        assert rows.tolist() == np.flatnonzero(np.bitwise_count(code ^ q).sum(axis=1) <= radius).tolist()


# ---- 7 ----


def test_interactions_equal_pairs():
    rng = np.random.default_rng(7)
    x, w, v = rng.normal(size=(5, 6)), rng.normal(size=6), rng.normal(size=(6, 3))
    want = [r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(quality.interact(w, v, x), want)


def test_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(24)
    bounds = np.array([0, 0, 4, 5, 9])
    x = quality.Features(np.array([0, 1, 5, 6, 3, 0, 2, 4, 6]), bounds, rng.integers(0, quality.META, (4, 2)), rng.normal(size=(4, 10)).astype(np.float32))
    dense = np.zeros((4, 7 + quality.META + 10))
    for r in range(4):
        dense[r, x.words[bounds[r] : bounds[r + 1]]] = 1
        for m in x.meta[r]:
            dense[r, 7 + m] += quality.META_VALUE
    dense[:, 7 + quality.META :] = x.stats
    p = {"b": np.float32(0.3), "w": rng.normal(size=dense.shape[1]), "v": rng.normal(size=(dense.shape[1], 3))}
    each = dense.copy()
    each[:, 7 : 7 + quality.META] = 0
    want = quality.interact(p["w"], p["v"], dense) + 0.3
    twice = [r for r in range(4) if x.meta[r, 0] == x.meta[r, 1]]
    ok = [r for r in range(4) if r not in twice]
    assert np.allclose(quality.margin(p, x)[0][ok], want[ok], atol=1e-4)
    g = rng.normal(size=(4, 2))
    assert np.allclose(x.back(g, 7), dense.T @ g, atol=1e-4)
    part = x.take(np.array([3, 0, 1]))
    assert np.allclose(part.dot(p["v"]), (dense @ p["v"])[[3, 0, 1]], atol=1e-4)


def test_words_of_whole_texts_count(spark):
    """Hundreds of telling words, each in few texts, count all, and so does one at the end of a very long text."""
    rng = random.Random(25)
    bad = [f"bad{k}word" for k in range(900)]
    rows = [(k, prose(rng, 30) + (" " + " ".join(rng.sample(bad, 30)) if k % 2 else "")) for k in range(1600)]
    marks = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(1600)], "doc_id long, quality int, toxic int")
    model = quality.train(table(spark, rows), marks)
    assert len(model.buckets) > 700
    df, pos = Counter(), Counter()
    for k, t in rows:
        for w in set(quality.words_and_stats(pa.array([t]))[0].tolist()):
            df[w] += 1
            pos[w] += k % 2
    want = sorted(w for w, n in df.items() if n >= quality.DF_MIN and abs(pos[w] - n / 2) / (n / 4) ** 0.5 >= quality.Z_MIN)
    assert model.buckets.tolist() == want
    long = " ".join([prose(rng, 40)] + ["the"] * 200_000)
    words, bounds, stats = quality.words_and_stats(pa.array([long, long + " " + " ".join(bad[:60])]))
    x = model.features(words, bounds, stats, np.zeros((2, 2), np.int64))
    assert len(x.words) > 50 and x.bounds[1] < 5


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        t, q, bad = prose(rng, rng.randint(30, 200)), 1, 0
        if k % 5 == 0:
            t, q = " ".join(w + "$%&"[rng.randrange(3)] * 3 for w in t.split()), 0
        elif k % 5 == 1:
            t, bad = t + " nastyword " + t[:20], 1
        rows.append((k, t))
        labels.append((k, q, bad))
    extra = [(None, "x y"), (2000, None), (2001, ""), (2, rows[2][1])]
    docs = table(spark, rows + extra)
    marks = spark.createDataFrame(labels[:400] + labels[:3] + [(None, 1, 0), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.quality_scores(docs, marks).collect()}
    right = [got[k] == (q == 1 and bad == 0) for k, q, bad in labels[400:]]
    assert np.mean(right) > 0.95 and len(got) == 603 and got[2000] is got[2001] is False
    kept = quality.keep_quality(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} - {None} == {k for k, v in got.items() if v and k is not None}
    assert quality.quality_scores(docs, marks.limit(0)).where("keep").count() == 602
    assert quality.keep_quality(docs.limit(0), marks).count() == 0


# ---- 8 ----


def levenshtein_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(12, 40))) for k in range(12)] + [(20, "tiny"), (21, None), (None, "null id item of some length"), (22, ""), (23, "a b"), (24, "exactly 15 byt"), (25, "!?")]
    rows = [(900, None), (901, ""), (None, items[0][1]), (902, "A, b; tiny"), (903, "xa b tinyx"), (904, "exactly 15 bytes"), (905, "tiny"), (906, "a"), (907, "b"), (908, prose(rng, 60_000) + " " + items[3][1])]
    for k in range(60):
        t = prose(rng, rng.randint(5, 120))
        if k % 2:
            leak = list(" ".join(norm(items[k % 12][1])))
            for _ in range(rng.randint(0, int(len(leak) * 0.1))):
                at = rng.randrange(len(leak))
                leak[at : at + rng.randint(0, 1)] = rng.choice("abcxyz")
            t = f"{t}. {''.join(leak).upper()}! {prose(rng, 30)}"
        rows.append((k, t))
    rows.append(rows[4])
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = []
    for i, t in rows:
        for j, item in items:
            a, b = (" ".join(norm(x or "")).encode() for x in (item, t))
            if j is not None and 0 < len(a) < decontaminate.Q and b" " + a + b" " in b" " + b + b" ":
                want.append((i, j, 0))
            if j is not None and len(a) >= decontaminate.Q and i == 908:
                if a in b:
                    want.append((i, j, 0))
            elif j is not None and len(a) >= decontaminate.Q and (d := levenshtein_in(a, b)) <= decontaminate.edit_limit(len(a)):
                want.append((i, j, d))
    key = lambda x: tuple(map(str, x))
    docs = table(spark, rows)
    assert sorted((tuple(r) for r in decontaminate.leaks(docs, bench).collect()), key=key) == sorted(want, key=key) and len(want) > 15
    dirty = {i for i, _, _ in want}
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in dirty)
    assert decontaminate.leaks(docs, bench.limit(0)).count() == decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_long_items_are_found_at_the_limit():
    rng = random.Random(16)
    items = [" ".join(norm(prose(rng, n))) for n in range(180, 480, 12)]
    b = decontaminate.Benchmark(list(range(len(items))), items)
    texts = []
    for item in items:
        leak = list(item)
        for _ in range(decontaminate.edit_limit(len(item))):
            at = rng.randrange(len(leak))
            leak[at : at + rng.randint(0, 1)] = rng.choice("abcxyz")
        texts.append(f"{prose(rng, 20)} {''.join(leak)} {prose(rng, 20)}")
    assert len(items[0]) < 1200 and len(items[-1]) > 2500
    assert {(r, i) for r, i, _ in b.matches(pa.array(texts))} == {(k, k) for k in range(len(items))}


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.randint(0, 1)] = rng.choice("abcxyz")
    return "".join(out)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.075, 0.09, 0.0999])
def test_target_recall_up_to_the_limit(share):
    rng = random.Random(22)
    items = [" ".join(norm(prose(rng, n % 60 + 12))) for n in range(200)]
    b = decontaminate.Benchmark(list(range(200)), items)
    assert all(c.walks for c in b.classes)
    texts = [f"{prose(rng, 20)} {edited(rng, item, int(len(item) * share))} {prose(rng, 20)}" for item in items]
    assert decontaminate.edit_limit(200) == 20
    found = {(r, i) for r, i, _ in b.matches(pa.array(texts))}
    assert sum((k, k) in found for k in range(200)) >= 200 * decontaminate.RECALL


def test_classes_are_at_most_64():
    rng = random.Random(23)
    sizes = [int(9 * 1.3**k) for k in range(1, 55)] + [30_000_000]
    items = ["".join(rng.choices("abcdefgh ", k=n)) for n in sizes[:40]] + ["ab cd ef gh " * (n // 12 + 1) for n in sizes[40:]]
    b = decontaminate.Benchmark(list(range(len(items))), items, walks=[0] * 64)
    assert len(b.classes) <= 64 and sum(len(c.own) for c in b.classes) == len(items)


def test_benchmark_passes_give_the_same(spark, monkeypatch):
    rng = random.Random(10)
    items = [(k, prose(rng, 30)) for k in range(9)]
    docs, bench = table(spark, [(k, f"x {t} y") for k, t in items]), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 2)
    assert sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect()) == want == [(k, k, 0) for k in range(9)]


# ---- 9 ----


def brute_spans(rows, n):
    seen = {}
    for i, t in rows:
        if i is not None and t:
            w = norm(t)
            for k in range(len(w) - n + 1):
                seen.setdefault(tuple(w[k : k + n]), set()).add((i, k))
    marks = {}
    for at in seen.values():
        if len({i for i, _ in at}) > 1:
            for i, k in at:
                marks.setdefault(i, set()).add(k)
    out = []
    for i, ks in marks.items():
        ks = sorted(ks)
        start = last = ks[0]
        for k in [*ks[1:], None]:
            if k is None or k > last + n:
                out.append((i, start, last + n - start))
                start = k
            last = k
    return sorted(out)


def test_repeated_passages_equal_brute_force(spark):
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (50, 49, 70, 400)]
    rows = [(900, None), (None, shared[3]), (901, ""), (902, "a " * 300), (903, "b " + "a " * 120), (904, "line one two " * 60), (905, shared[2]), (905, shared[2])]
    for k in range(40):
        parts = [prose(rng, rng.randint(0, 80)) for _ in range(3)]
        rows.append((k, f"{parts[0]} {shared[k % 4] if k % 3 else ''} {parts[1]} {shared[(k + 1) % 4].upper() if k % 5 == 0 else ''} {parts[2]}"))
    docs = table(spark, rows)
    got = sorted(tuple(r) for r in suffixes.repeated_passages(docs).collect())
    assert got == brute_spans(rows, suffixes.MIN_WORDS) and len(got) > 20
    assert suffixes.repeated_passages(table(spark, [])).count() == 0
    assert sorted(tuple(r) for r in suffixes.repeated_passages(docs, part=3, chunk_bytes=4096).collect()) == got


def test_split_buckets_keep_a_documents_second_copy(spark):
    rng = random.Random(15)
    rows = []
    for k in range(40):
        passage = prose(rng, 60)
        rows += [(10 * k + 3, f"{passage} {prose(rng, 70)} {passage}"), (10 * k + 5, f"{prose(rng, 9)} {passage}"), (10 * k + 4, f"{prose(rng, k)} {passage} {prose(rng, 60)} {passage}")]
    docs = table(spark, rows)
    want = brute_spans(rows, suffixes.MIN_WORDS)
    for part, chunk_bytes in ((2, 1), (3, 1), (4, 4096)):
        assert sorted(tuple(r) for r in suffixes.repeated_passages(docs, part=part, chunk_bytes=chunk_bytes).collect()) == want


def test_a_passage_that_all_documents_share(spark):
    rng = random.Random(27)
    licence = prose(rng, 70)
    rows = [(k, f"{prose(rng, k % 9)} {licence} {prose(rng, 30)}") for k in range(200)] + [(7, f"{prose(rng, 90)} {licence}"), (8, licence), (8, licence)]
    docs = table(spark, rows)
    want = brute_spans(rows, suffixes.MIN_WORDS)
    assert sorted(tuple(r) for r in suffixes.repeated_passages(docs).collect()) == want
    assert sorted(tuple(r) for r in suffixes.repeated_passages(docs, part=10, chunk_bytes=2000).collect()) == want


def test_anchors_are_the_least_grams():
    rng = np.random.default_rng(14)
    grams, bounds = rng.integers(0, 40, 700).astype(np.uint64) << np.uint64(50), np.array([0, 30, 300, 707])
    w = suffixes.MIN_WORDS - suffixes.Q + 1
    want = {s + int(np.argmin(grams[s : s + w])) for a, b in ((30, 300), (300, 707)) for s in range(a, b - suffixes.MIN_WORDS + 1)}
    assert set(suffixes.anchors(grams, bounds).tolist()) == want


def test_refinement_sorts_to_the_depth():
    rng = np.random.default_rng(12)
    words, bounds = rng.integers(0, 2, 3000).astype(np.uint64) * np.uint64(977), np.array([0, 1100, 1100, 3000])
    pointer = suffixes.refine(words, bounds, 50)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(3000)
    groups = {}
    for k in np.flatnonzero(room >= 50):
        groups.setdefault(words[k : k + 50].tobytes(), set()).add(int(pointer[k]))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


# ---- 10 ----


def test_language_on_held_out_rows(spark):
    rng = random.Random(13)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "hijkl", "dd": "abklm"}
    text = lambda a, n: " ".join("".join(rng.choices(a, k=rng.randint(2, 7))) for _ in range(n))
    rows = [(k, text(alphabets[lang], 40), lang) for k in range(100) for lang in alphabets]
    held = [(1000 + 20 * j + k, text(alphabets[lang], 25), None, lang) for k in range(20) for j, lang in enumerate(alphabets)]
    extra = [(None, "abcde abc", "aa"), (3000, None, "aa"), (3001, "", None), (3002, "9", "bb")]
    docs = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang in rows + extra] + [(i, t, lang, 1.0) for i, t, lang, _ in held], "doc_id long, text string, lang string, loss double")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert np.mean([got[i]["predicted"] == lang for i, _, _, lang in held]) > 0.95
    assert all(got[i]["predicted"] is None and got[i]["ambiguous"] for i in (3000, 3001, 3002))
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("predicted IS NOT NULL").count() == 0
    assert langid.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_codewords_differ(n):
    code = langid.code_matrix(n)
    assert len({tuple(r) for r in code}) == n
    assert (langid.decode(code * 3, code).argmin(axis=1) == np.arange(n)).all()


def test_equal_losses_are_ambiguous(spark):
    """Two languages with the same texts: no bit can tell them apart."""
    texts = ["abcde abc dbca ebcda", "fghij fgh jhgf gfjih"]
    code = langid.code_matrix(2)
    model = {"names": ["aa", "bb"], "code": code, "w": np.zeros((langid.BINS, code.shape[1]), np.float32), "b": np.zeros(code.shape[1], np.float32)}
    docs = spark.createDataFrame([(1, texts[0], "bb"), (2, texts[1] * 20_000, "aa")], "doc_id long, text string, lang string")
    assert [(r["predicted"], r["margin"], r["ambiguous"]) for r in langid.identify(docs, model).collect()] == [("aa", 0.0, True)] * 2


def test_profiles_count_whole_texts():
    a = langid.profiles(pa.array(["ab" * 50_000 + "zzz", None, "", "x"]))
    assert a[0].any() and not a[1:].any()
