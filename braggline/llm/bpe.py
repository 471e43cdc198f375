"""Byte-pair encoding and decoding of whole texts by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be merged
over, so the gap between such bytes is a certain cut: the fragments on both sides are
encoded independently and their ids concatenated.  Three kinds of such gaps are left
uncut, as the pre-tokenizer looks over them: after white space (its rule for runs of
blanks looks one character ahead), before an apostrophe (a contraction must not begin
at a fragment that is the middle of a run of marks), and inside a UTF-8 character.  What
a fragment still holds is pre-tokenized and merged once per distinct fragment; each
worker keeps the results of the fragments it has seen in a table of bounded size.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, received, shipped, slices, texts

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The largest tokenizer file that is sent to the executors.
MAX_FILE_BYTES = 64 << 20
#: Distinct fragments a worker remembers before it starts afresh, and the longest it remembers.
MEMORY = 400_000
LONGEST = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary, merge ranks and certain cuts of one byte-level tokenizer; encodes and decodes texts."""

    def __init__(self, spec: dict):
        model, alphabet = spec["model"], byte_alphabet()
        pre = spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                                       "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE files are supported")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match as they stand")
        ids = {bytes(alphabet[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
        self.single = [ids.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("every byte needs a token")
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = (bytes(alphabet[c] for c in s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks.setdefault((ids[left], ids[right]), rank)
            self.made.append(ids[left + right])
        self.single_array = np.array(self.single, np.int64)
        self.made_array = np.array(self.made, np.int64)
        self.width = 1 + max(max(ids.values()), 1)
        keys = np.array([left * self.width + right for left, right in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        self.tokens = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in special.items()}
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.cuts = certain_cuts(ids)
        self.pattern = None
        self.seen: dict[bytes, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"pattern": None, "seen": {}}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one long pre-token: its pairs wait in a heap by rank and place, stale entries are passed over."""
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i, j):
            if i >= 0 and j < n and (rank := self.ranks.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = self.made[rank], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [i for i in ids if i is not None]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of many pairs, the number of merges where there is none."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.made))

    def merged_block(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens of one length: every round merges the best pair of each row, which takes a column off."""
        ids = self.single_array[np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)]
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        out: list[bytes | None] = [None] * len(pieces)
        rows, none = np.arange(len(pieces)), len(self.made)
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            rank = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), none)
            ended = rank == none
            if ended.any():
                step, packed = 4 * ids.shape[1], ids[ended].astype("<u4").tobytes()
                for k, row in enumerate(rows[ended].tolist()):
                    out[row] = packed[k * step:(k + 1) * step]
                if ended.all():
                    return out
                going = ~ended
                ids, ranks, rows, best, rank = ids[going], ranks[going], rows[going], best[going], rank[going]
            n, w = ids.shape
            line = np.arange(n)
            ids[line, best] = self.made_array[rank]
            keep = np.ones((n, w), bool)
            keep[line, best + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[line, best] = False
            ranks = ranks[keep].reshape(n, w - 2)
            if w > 2:
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < w - 2)
                at = best[left]
                ranks[left, at - 1] = self.rank_of(ids[left, at - 1], ids[left, at])
                at = best[right]
                ranks[right, at] = self.rank_of(ids[right, at], ids[right, at + 1])

    def learn(self, fragments: Iterable[bytes]) -> dict[bytes, bytes]:
        """The packed ids of fragments: pre-tokenize each, merge the pre-tokens in blocks of equal length."""
        if self.pattern is None:
            self.pattern = regex.compile(PATTERN)
        parts: dict[bytes, list[bytes]] = {}
        by_length: dict[int, set[bytes]] = {}
        packed: dict[bytes, bytes] = {}
        for piece in fragments:
            if piece.isalpha() or (piece[0] == 32 and piece[1:].isalpha()):  # ASCII letters: one pre-token
                tokens = [piece]
            else:
                tokens = [t.encode("utf-8") for t in self.pattern.findall(piece.decode("utf-8"))]
            if len(tokens) > 1 or len(tokens[0]) > LONGEST:
                parts[piece] = tokens
            for token in tokens:
                by_length.setdefault(len(token), set()).add(token)
        for length, tokens in by_length.items():
            if length <= LONGEST:
                block = list(tokens)
                packed.update(zip(block, self.merged_block(block)))
                continue
            for token in tokens:  # inside one pre-token every certain cut holds, also within characters
                arr = np.frombuffer(token, np.uint8).astype(np.int32)
                at = (np.flatnonzero(self.cuts[0][(arr[:-1] << 8) | arr[1:]]) + 1).tolist()
                ids = [i for a, b in zip([0, *at], [*at, length]) for i in self.merged(token[a:b])]
                packed[token] = struct.pack(f"<{len(ids)}I", *ids)
        packed.update({piece: b"".join([packed[t] for t in tokens]) for piece, tokens in parts.items()})
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as little-endian unsigned 32-bit numbers."""
        cut = self.special_pattern.split if self.special_pattern is not None else lambda text: [text]
        pieces = [[p if i % 2 else self.fragments(p) for i, p in enumerate(cut(text))] for text in texts]
        if len(self.seen) >= MEMORY:
            self.seen.clear()
        seen = self.seen
        new = {f for text in pieces for part in text if type(part) is list for f in part} - seen.keys()
        long = {}
        for piece, ids in self.learn(new).items():
            (seen if len(piece) <= LONGEST else long)[piece] = ids
        of = (lambda p: seen[p] if p in seen else long[p]) if long else seen.__getitem__
        return [b"".join([b"".join(map(of, part)) if type(part) is list else self.special[part].to_bytes(4, "little")
                          for part in text]) for text in pieces]

    def fragments(self, text: str) -> list[bytes]:
        """The bytes of a text between its certain cuts."""
        raw = text.encode("utf-8")
        if not raw:
            return []
        arr = np.frombuffer(raw, np.uint8)
        at = (np.flatnonzero(self.cuts[1][(arr[:-1].astype(np.int32) << 8) | arr[1:]]) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def certain_cuts(vocabulary: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables over ``256 * left + right``: pairs inside no token, and those of them where a text may be cut."""
    free = np.ones(65536, bool)
    for token in vocabulary:
        for left, right in zip(token, token[1:]):
            free[left * 256 + right] = False
    safe = free.reshape(256, 256).copy()
    # Not after white space, whose non-ASCII kinds end in these bytes (U+0085, U+00A0, U+1680, U+2000-200A, U+2028/9, U+202F, U+205F, U+3000).
    safe[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    safe[:, 0x27] = False          # not before an apostrophe
    safe[:, 0x80:0xC0] = False     # not inside a character
    return free, safe.reshape(-1)


def load_codec(path: str) -> Codec:
    """Read a tokenizer file on the driver; its size is checked, as it is sent to every executor."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"the tokenizer file is over {MAX_FILE_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return Codec(json.load(file))


def _carry(docs: DataFrame, keep: list[str], fields: list[T.StructField]) -> T.StructType:
    return T.StructType([docs.schema[c] for c in keep] + fields)


def encode(spark: SparkSession, docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           with_text: bool = False) -> DataFrame:
    """``keep..., ids`` (and ``decoded`` if asked for): the token ids of every whole text.

    ``ids`` is binary, little-endian unsigned 32-bit.  A null or empty text has no ids
    and decodes to the empty text; the strings of special tokens inside a text become
    their ids.  Rows are independent: repeated rows give repeated results, other
    columns are not read, and an empty table gives an empty result.
    """
    codec = shipped(spark, load_codec(tokenizer))
    keep = list(keep)
    fields = [T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * with_text
    own_text = fresh(docs, "__text")
    source = docs.select(*keep, docs[text].alias(own_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(codec)
        for batch in slices(batches, own_text):
            ids = own.encode(texts(batch.column(own_text)))
            columns = [batch.column(c) for c in keep] + [pa.array(ids, pa.binary())]
            if with_text:
                columns.append(pa.array([own.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", *["decoded"] * with_text])

    return source.mapInArrow(run, _carry(docs, keep, fields))


def decode(spark: SparkSession, encoded: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep..., decoded``: the text of binary ids as ``encode`` writes them; null ids give the empty text."""
    codec = shipped(spark, load_codec(tokenizer))
    keep = list(keep)
    own_ids = fresh(encoded, "__ids")
    source = encoded.select(*keep, encoded[ids].alias(own_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(codec)
        for batch in slices(batches, own_ids):
            out = [own.decode(i) if i else "" for i in batch.column(own_ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(out, pa.string())], [*keep, "decoded"])

    return source.mapInArrow(run, _carry(encoded, keep, [T.StructField("decoded", T.StringType())]))
