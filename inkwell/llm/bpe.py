"""Byte-pair encoding of whole texts by depth-first traversal of a trie of their distinct words, and decoding."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from inkwell.llm.common import arrow_map, load_spread, quoted, text_slices, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split in the standard library's engine, equal on the characters of _PLAIN.
_FAST = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ſ–—‘-”…]")
_EXACT = regex.compile(SPLIT)
#: Words kept in each of two generations; the older one goes when the newer is full, and a word met again moves over.
CACHE_WORDS = 200_000
FITS = 500_000


def split_words(text: str) -> list[str]:
    return _EXACT.findall(text) if _PLAIN.search(text) else _FAST.findall(text)


class Encoder:
    """Encoder and decoder over a vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        for rank in sorted(ranks.values()):
            if len(token := self.tokens[rank]) > 1:
                pieces = self._merge(token, rank)
                if len(pieces) == 2:
                    self.parts[rank] = (pieces[0], pieces[1])
                    self.merged[pieces[0], pieces[1]] = rank
        #: For the last four bytes of a prefix, the lengths of the tokens that it can end with, longest first.
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) >= 4:
                ends.setdefault(token[-4:], set()).add(len(token))
        self.lengths = {k: (*sorted(v, reverse=True), 3, 2, 1) for k, v in ends.items()}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merge(self, word: bytes, below: int) -> list[int]:
        """Plain merging with the tokens of rank under `below` only."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1], below)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, seam: int) -> bool:
        """Whether the encoding of two tokens' bytes (a << 32 | b) is just these two: no merge across the seam comes before theirs."""
        known = self.fits[seam] = self._fit(seam >> 32, seam & 0xFFFFFFFF)
        return known

    def _fit(self, a: int, b: int) -> bool:
        """Plays the merges at the seam in order of rank. A token grows through its spine: on the left of the seam the tokens that a ends with
        while it is built, on the right those that b begins with; a spine's token lives until the next one's rank. Of merges of
        equal rank the leftmost comes first.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        never = len(self.tokens)
        x, y = left.pop(), right.pop()
        while True:
            x_ends, y_ends = left[-1] if left else never, right[-1] if right else never
            across = self.merged.get((x, y), never)
            if across < x_ends and across <= y_ends and across < never:
                return False
            if x_ends <= y_ends:
                if not left:
                    return True
                x = left.pop()
            else:
                y = right.pop()

    def _spine(self, token: int, side: int) -> list[int]:
        """The token, its part on the side, that one's part, and so on to a token without parts."""
        out = [token]
        while (part := self.parts[out[-1]][side]) != out[-1]:
            out.append(part)
        return out

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Distinct words with their encodings.

        Sorted words are the trie in depth-first order: the bytes that a word shares with the one before are the path
        that both have in common, and the last token of each prefix on it stays on the stack. The last token of a
        prefix is its one suffix that fits the last token of what remains; going back through last tokens gives the word's encoding.
        """
        ranks, lengths, fits, fit, tokens_of, short = self.ranks, self.lengths, self.fits, self.fit, self.tokens, ((), (1,), (2, 1), (3, 2, 1))
        last: list[int] = []
        before = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            for depth in range(shared + 1, len(word) + 1):
                for n in lengths.get(word[depth - 4 : depth], short[3]) if depth > 3 else short[depth]:
                    if n <= depth and (token := ranks.get(word[depth - n : depth])) is not None:
                        if n == depth:
                            break
                        seam = last[depth - n - 1] << 32 | token
                        known = fits.get(seam)
                        if known or known is None and fit(seam):
                            break
                last.append(token)
            at, tokens = len(word), []
            while at:
                tokens.append(last[at - 1])
                at -= len(tokens_of[tokens[-1]])
            yield word, tokens[::-1]
            before = word

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; the words that are new to this worker go through one trie."""
        split = [split_words(t) for t in texts]
        cache, older = self.cache, self.older
        unseen = set().union(*split).difference(cache)
        raw = {}
        for w in unseen:
            if (known := older.get(w)) is not None:
                cache[w] = known
            else:
                raw[w.encode("utf-8", "surrogatepass")] = w
        for word, ids in self.encode_words(raw):
            cache[raw[word]] = pack(ids)
        look = cache.__getitem__
        out = [np.frombuffer(b"".join(map(look, words)), np.int32) for words in split]
        if len(cache) > CACHE_WORDS:
            self.older, self.cache = cache, {}
        if len(self.fits) > FITS:
            self.fits.clear()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as lines:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs without `text`, with tokens (array<int>), n_tokens and round_trip: whether decoding the tokens gives the text again.

    Byte-level BPE over the vocabulary file at `path`. Null text gives null tokens, n_tokens and round_trip; empty text
    an empty array, 0 and true. Whole texts are encoded, strings like those of special tokens as ordinary text. Repeated rows
    and further columns pass through, columns named as the new ones are replaced; an empty table gives an empty result.
    """
    path = path or tokenizer_path(VOCABULARY)
    names = [c for c in docs.columns if c not in ("text", "tokens", "n_tokens", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in text_slices(batches):
            texts = part.column("text").to_pylist()
            null = np.array([t is None for t in texts], bool)
            ids = bpe.encode_texts([t or "" for t in texts])
            same = [bpe.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
            size = np.array([len(x) for x in ids], np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(null, False))
            tokens = pa.ListArray.from_arrays(offsets, values)
            yield pa.record_batch([*(part.column(c) for c in names), tokens, pa.array(size, mask=null), pa.array(same, mask=null)], [*names, "tokens", "n_tokens", "round_trip"])

    schema = docs.select(*quoted(names)).schema.add("tokens", ArrayType(IntegerType())).add("n_tokens", IntegerType()).add("round_trip", BooleanType())
    return arrow_map(docs, [*names, "text"], run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with `text`, decoded from `tokens`; null tokens or a null among them give null text, no tokens an empty one."""
    path = path or tokenizer_path(VOCABULARY)
    names = [c for c in encoded.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in batches:
            texts = [None if t is None or None in t else bpe.decode(t) for t in part.column("tokens").to_pylist()]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], [*names, "text"])

    return arrow_map(encoded, names, run, encoded.select(*quoted(names)).schema.add("text", StringType()))


def op1_bpe(spark, sf_dir):
    return encode(load_spread(spark, sf_dir, "documents", "doc_id", "text"))
