"""Benchmark decontamination: CGK random-walk embedding and bit-sampling LSH over item-sized windows, with exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import _IS_WORD, arrow_map, load, load_spread, text_slices, utf8

EDIT_SHARE = 0.10
Q = 8
#: Walks that may be taken for a length class: the fewest that reach the target recall.
WALKS, TABLES, BITS = (4, 8, 16), 32, 5
#: Target share of PROBES copies at the edit limit that the tables of a length class must find; a class that none of WALKS
#: brings there is verified without tables, item by item.
RECALL, PROBES = 0.99, 128
CLASS_RATIO = 1.25
#: Items and bytes of items that travel to the workers in one pass over the documents.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 4 << 20
_TABLE_BITS = 24


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words, each followed by one space, as bytes, with the bounds of each text."""
    ended = pc.binary_join_element_wise(pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), pa.scalar("", pa.large_string())), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    data, offsets = utf8(ended)
    inside = _IS_WORD[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    return np.where(inside, data, np.uint8(32))[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def edit_limit(n: int) -> int:
    """Edits allowed in an item of n bytes: EDIT_SHARE of it, and few enough that a match must share a Q-gram with the item. None under 16 bytes."""
    return max(0, min(int(n * EDIT_SHARE), (n - Q) // Q))


def best_distance(pattern: bytes, text: bytes) -> int:
    """Least edit distance between the pattern and any substring of the text (Myers' bit-vectors)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        pv, mv = (mh << 1 & full) | ~(xv | ph) & full, ph & xv
    return best


class LengthClass:
    """Items of similar length: the embedding walks over windows of `span` bytes and samples its first `steps` steps."""

    def __init__(self, numbers: list[int], items: list[bytes], walks: int):
        self.numbers, self.walks = np.array(numbers), walks
        own = [items[k] for k in numbers]
        sizes = np.array([len(s) for s in own])
        limits = np.array([edit_limit(n) for n in sizes])
        self.own, self.span, self.steps = own, int(sizes.max()), 2 * int(sizes[0])
        #: For each item, the Q-gram positions that a match must have, and the bytes that it can take.
        self.needs, self.reaches = sizes - Q + 1 - Q * limits, sizes + limits
        self.need, self.reach = int(self.needs.min()), int(self.reaches.max())
        grams = [np.unique(_grams(np.frombuffer(s, np.uint8))) for s in own]
        flat, holders = np.concatenate(grams), np.repeat(np.arange(len(own), dtype=np.int32), [len(g) for g in grams])
        order = np.argsort(flat, kind="stable")
        #: The class's Q-grams, and from first[k] on in `holders` the items with the k-th.
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first, self.holders = np.append(first, len(flat)), holders[order]
        self.keys = self.of_texts(own, walks) if walks else None

    def of_texts(self, texts: list[bytes], walks: int) -> np.ndarray:
        """Keys of texts of about the class's length, shape (walks * TABLES, texts)."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
        starts = np.concatenate([[0], ends[:-1]])
        return self.embed(data, starts, np.minimum(starts + self.span, ends), walks)

    def embed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, walks: int) -> np.ndarray:
        """LSH keys (walks * TABLES, windows) of the windows of data from starts to ends.

        CGK: a pointer goes over the window and the step's symbol is the byte under it; a shared random bit for each (walk,
        step, byte) says whether it moves on. Bit sampling keeps BITS steps in each table.
        """
        flips, sampled = _walks(int(self.steps), walks)
        padded = np.zeros(len(data) + self.steps + 1, np.uint8)
        padded[: len(data)] = data
        keys = np.zeros((walks, TABLES, len(starts)), np.uint64)
        for low in range(0, len(starts), 2048):
            w = len(starts[low : low + 2048])
            base = np.repeat(np.arange(walks, dtype=np.int32) * 256, w)
            at, end = (np.tile(x[low : low + 2048].astype(np.int32), walks) for x in (starts, ends))
            out = np.empty((self.steps, walks * w), np.uint8)
            for j in range(self.steps):
                symbol = padded[at]
                symbol *= at < end
                out[j] = symbol
                at += flips[j].take(base + symbol)
            out = out.reshape(self.steps, walks, w)
            for b in range(BITS):
                for r in range(walks):
                    keys[r, :, low : low + w] = keys[r, :, low : low + w] << np.uint64(8) | out[sampled[r, :, b], r]
        return keys.reshape(walks * TABLES, len(starts))

    def recall(self, walks: int) -> float:
        """Share of copies of the class's items, with as many random edits as the limit allows, that share a key with their item."""
        rng = np.random.default_rng(43)
        chosen, copies = np.linspace(0, len(self.own) - 1, PROBES).astype(int), []
        for k in chosen:
            copy = bytearray(self.own[k])
            for _ in range(edit_limit(len(copy))):
                at, kind, byte = int(rng.integers(len(copy))), int(rng.integers(3)), copy[int(rng.integers(len(copy)))]
                copy[at : at + (kind > 0)] = bytes([byte][: 2 - kind])
            copies.append(bytes(copy))
        return float((self.of_texts(self.own, walks)[:, chosen] == self.of_texts(copies, walks)).any(axis=0).mean())

    def passages(self, places: np.ndarray, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, row, low, high, last) of all passages of the texts that by the Q-gram lemma can hold a match of an item of the class,
        which then begins from low to last and ends by high. Lossless. places: those of the class's Q-grams, and their numbers."""
        sizes = self.first[numbers + 1] - self.first[numbers]
        base = np.repeat(self.first[numbers] - np.cumsum(sizes) + sizes, sizes)
        item, at = self.holders[base + np.arange(len(base))].astype(np.int64), np.repeat(places, sizes)
        owner = item * len(bounds) + np.searchsorted(bounds, at, "right") - 1
        order = np.argsort(owner, kind="stable")
        item, at, owner = item[order], at[order], owner[order]
        last = np.arange(len(at)) + self.needs[item] - 1
        head = np.flatnonzero(last < len(at))
        head = head[(owner[last[head]] == owner[head]) & (at[last[head]] - at[head] <= self.reaches[item[head]] - Q)]
        item, owner, reach = item[head], owner[head], self.reaches[item[head]]
        low, high, begin = at[last[head]] + Q - reach, at[head] + reach, at[head]
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (low[1:] > high[:-1]))[: len(owner)])
        if not len(new):
            return (item[:0],) * 5
        row = owner[new] % len(bounds)
        return item[new], row, np.maximum(low[new], bounds[row]), np.minimum(np.maximum.reduceat(high, new), bounds[row + 1]), np.maximum.reduceat(begin, new)


def _grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each position as one number."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", np.ascontiguousarray(data), 0, (1,))


@lru_cache(maxsize=128)
def _walks(steps: int, walks: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared random bits of each step, and the steps sampled by each table."""
    rng = np.random.default_rng([41, steps, walks])
    return rng.integers(0, 2, (steps, walks * 256), np.uint8), rng.integers(0, steps, (walks, TABLES, BITS))


class Benchmark:
    """The items of one pass, their Q-gram screens and their LSH keys. walks: those of each length class, chosen here if not given."""

    def __init__(self, ids: list[int], texts: list[str], walks: list[int] | None = None):
        data, bounds = normalised(pa.array(texts, pa.string()))
        self.ids = ids
        self.items = [data[a : max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        usable = sorted((k for k, s in enumerate(self.items) if len(s) >= Q), key=lambda k: len(self.items[k]))
        #: Items too short for a Q-gram, with the space behind them, by their length.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, s in enumerate(self.items):
            if 0 < len(s) < Q:
                self.short.setdefault(len(s) + 1, {}).setdefault(int.from_bytes(s + b" ", "little"), []).append(k)
        self.classes: list[LengthClass] = []
        # At most 64 classes, since a Q-gram's classes are kept in the bits of one number.
        ratio = max(CLASS_RATIO, (len(self.items[usable[-1]]) / len(self.items[usable[0]])) ** (1 / 60)) if usable else CLASS_RATIO
        while usable:
            own = [k for k in usable if len(self.items[k]) <= len(self.items[usable[0]]) * ratio]
            usable = usable[len(own) :]
            c = LengthClass(own, self.items, walks[len(self.classes)] if walks else 0)
            if walks is None and edit_limit(len(self.items[own[-1]])):
                c.walks = next((w for w in WALKS if c.recall(w) >= RECALL), 0)
                c.keys = c.of_texts(c.own, c.walks) if c.walks else None
            self.classes.append(c)
        self.grams = np.unique(np.concatenate([c.grams for c in self.classes])) if self.classes else np.empty(0, np.uint64)
        #: For each Q-gram, a bit for each length class that has an item with it.
        self.members = np.zeros(len(self.grams), np.uint64)
        for number, c in enumerate(self.classes):
            self.members[np.searchsorted(self.grams, c.grams)] |= np.uint64(1) << np.uint64(number)
        self.screen = np.zeros(1 << _TABLE_BITS, bool)
        self.screen[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def near(self, hits: np.ndarray, c: LengthClass) -> np.ndarray:
        """The hits that lie where a match of the class can. Lossless: by the Q-gram lemma a substring within the edit limit of
        an item has `need` positions of the items' Q-grams within `reach` bytes."""
        need = max(1, c.need)
        if len(hits) < need:
            return hits[:0]
        dense = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] <= c.reach - Q)
        if not len(dense):
            return hits[:0]
        low, high = hits[dense + need - 1] + Q - c.reach, hits[dense] + c.reach
        at = np.searchsorted(low, hits, "right") - 1
        return hits[(at >= 0) & (hits < np.maximum.accumulate(high)[at])]

    def _verify(self, row: int, item: int, text: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        """Note the item's least distance in the text, if it is within the limit and less than what was found."""
        if found.get((row, item), 1) > 0:
            raw = text.tobytes()
            d = 0 if self.items[item] in raw else best_distance(self.items[item], raw)
            if d <= edit_limit(len(self.items[item])):
                found[row, item] = min(d, found.get((row, item), d))

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item number, distance) of each text and item within the item's edit limit."""
        data, bounds = normalised(texts)
        found: dict[tuple[int, int], int] = {}
        if not len(data):
            return []
        begins = np.empty(len(data), bool)
        begins[0], begins[1:] = True, data[:-1] == 32
        if self.short:
            self._shorts(data, bounds, begins, found)
        grams = _grams(data)
        hits = np.flatnonzero(self.screen[self._slot(grams)])
        if not len(hits) or not len(self.grams):
            return sorted((row, item, d) for (row, item), d in found.items())
        found_at = np.minimum(np.searchsorted(self.grams, grams[hits]), len(self.grams) - 1)
        real = self.grams[found_at] == grams[hits]
        hits, members = hits[real], self.members[found_at[real]]
        for number, c in enumerate(self.classes):
            places = self.near(hits[members >> np.uint64(number) & np.uint64(1) == 1], c)
            if not len(places):
                continue
            item, row, low, high, last = c.passages(places, np.searchsorted(c.grams, grams[places]), bounds)
            if c.walks and len(item):
                # Windows at every word at which a match of a passage can begin, the one that it may begin inside among them.
                words = np.flatnonzero(begins)
                first, stop = np.maximum(np.searchsorted(words, low, "right") - 1, np.searchsorted(words, bounds[row])), np.searchsorted(words, last, "right")
                use = np.zeros(len(words) + 1, np.int64)
                np.add.at(use, first, 1)
                np.add.at(use, stop, -1)
                chosen = np.flatnonzero(np.cumsum(use)[:-1] > 0)
                ends = bounds[np.searchsorted(bounds, words[chosen], "right")]
                keys = c.embed(data, words[chosen], np.minimum(words[chosen] + c.span, ends), c.walks)
                first, stop = np.searchsorted(chosen, first), np.searchsorted(chosen, stop)
                own = np.ascontiguousarray(c.keys.T)
                hit = [(own[i][:, None] == keys[:, a:b]).any() for i, a, b in zip(item, first, stop)]
                item, row, low, high = (x[np.array(hit, bool)] for x in (item, row, low, high))
            for i, r, a, b in zip(c.numbers[item].tolist(), row.tolist(), low.tolist(), high.tolist()):
                self._verify(r, i, data[a:b], found)
        return sorted((row, item, d) for (row, item), d in found.items())

    def _shorts(self, data: np.ndarray, bounds: np.ndarray, begins: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        """Items under Q bytes, where their words are whole words of the text."""
        at = np.flatnonzero(begins)
        row = np.searchsorted(bounds, at, "right") - 1
        start = _grams(np.concatenate([data, np.zeros(Q, np.uint8)]))[at]
        for size, items in self.short.items():
            word = start & np.uint64((1 << 8 * size) - 1)
            for k in np.flatnonzero(np.isin(word, np.array(list(items), np.uint64)) & (at + size <= bounds[row + 1])):
                for item in items[int(word[k])]:
                    found[int(row[k]), item] = 0


@lru_cache(maxsize=1)
def _built(ids: tuple[int, ...], texts: tuple[str, ...], walks: tuple[int, ...]) -> Benchmark:
    return Benchmark(list(ids), list(texts), list(walks))


class Pass:
    """What travels of a pass: ids, texts and chosen walks. Each worker builds the Benchmark from it once."""

    def __init__(self, ids: list[int], texts: list[str]):
        own = Benchmark(ids, texts)
        self.ids, self.texts, self.walks = tuple(ids), tuple(texts), tuple(c.walks for c in own.classes)

    def benchmark(self) -> Benchmark:
        return _built(self.ids, self.texts, self.walks)


def passes(benchmark: DataFrame) -> list[Pass]:
    """The benchmark's items in passes of ITEMS_PER_PASS and BYTES_PER_PASS, so that what travels to the workers is bounded; null ids and texts are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    out, ids, texts, size = [], [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) == ITEMS_PER_PASS or size + len(r["text"]) > BYTES_PER_PASS):
            out.append(Pass(ids, texts))
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    return [*out, Pass(ids, texts)] if ids else out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance): documents with a passage within the edit limit of a benchmark item.

    Texts and items are compared as lower-cased words with single spaces; distance is the edit distance in UTF-8 bytes to
    the nearest passage found, at most 10 % of the item's length. Passages where by the Q-gram lemma a match is possible (a
    lossless screen) are covered with item-sized windows at every word, each window embedded by CGK walks and sampled into TABLES
    tables a walk; items that share a key are verified exactly. For each length of item the fewest WALKS are taken that find RECALL of PROBES
    trial copies at the edit limit; where none do, and for items under 16 bytes, every passage left by the screen is verified, so none is lost.

    Ids must be numeric. Null doc_id passes through; null and empty texts match nothing; items with null id or without words match
    nothing, and items of under 8 bytes match where they are whole words of a text; an item_id with several texts matches by the nearest. Texts of
    any length are searched whole. Repeated rows of docs each give their rows, further columns are ignored, and an empty table on either side gives an empty result.
    """
    out = None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    for p in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], p: Pass = p) -> Iterator[pa.RecordBatch]:
            b = p.benchmark()
            for part in text_slices(batches):
                best: dict[tuple[int, int], int] = {}
                for row, item, d in b.matches(part.column("text")):
                    key = (row, b.ids[item])
                    best[key] = min(d, best.get(key, d))
                ids = part.column("doc_id")
                yield pa.record_batch([ids.take(pa.array([r for r, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64()), pa.array(list(best.values()), pa.int32())], ["doc_id", "item_id", "distance"])

        found = arrow_map(source, ["doc_id", "text"], run, "doc_id long, item_id long, distance int")
        out = found if out is None else out.unionByName(found)
    return source.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int") if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage (leaks()); each row is judged where it is read, so nothing is shuffled."""
    for p in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], p: Pass = p) -> Iterator[pa.RecordBatch]:
            b = p.benchmark()
            for part in text_slices(batches):
                keep = np.ones(part.num_rows, bool)
                keep[[row for row, _, _ in b.matches(part.column("text"))]] = False
                yield part.filter(pa.array(keep))

        docs = arrow_map(docs, docs.columns, run, docs.schema)
    return docs


def op8_leaks(spark, sf_dir):
    return leaks(load_spread(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark"))
