"""Byte-level BPE encoding of a corpus with padded numpy matrices.

A text is cut into words by the tokenizer's pattern. Words seen before come from a bounded cache of the Python
worker. A new word is cut where no token of the vocabulary spans the two neighbouring bytes (no merge can cross
such a place, so the cut changes nothing); its new pieces go, by length, into padded matrices of token ids. In
each round every row merges its leftmost pair of minimum rank: ranks come from an open-addressing hash table of
pairs, only the two pairs beside a merge are looked up anew, and rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ranges

#: Where the public vocabulary files are unless told otherwise.
TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the published pre-tokenization pattern of the byte-level vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same pattern for the standard library's faster engine; ``ODD`` finds the characters the two see differently.
FAST_WORDS = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")

NO_MERGE = np.int32(2**31 - 1)
CACHED_WORDS = 200_000


def read_ranks(tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> bytes:
    """The rank file of a byte-level vocabulary (about 1 MB; sent to the executors as a broadcast)."""
    with open(os.path.join(tokenizers, f"{name}.tiktoken"), "rb") as f:
        return f.read()


@cache
def odd() -> re.Pattern[str]:
    """Matches any character of the basic plane that ``FAST_WORDS`` would put into another class than ``WORDS`` does."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    differ: set[str] = set()
    for exact, fast in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        differ |= set(regex.findall(exact, every)) ^ set(re.findall(fast, every))
    return re.compile("[" + "".join(map(re.escape, sorted(differ))) + "]")


#: Characters outside the basic plane always take the exact pattern: a class with both is no longer a bitmap.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


class MatrixBpe:
    """Encoder for one rank file. ``encode_words`` is exact BPE; see the module's text."""

    def __init__(self, rank_file: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        if max(ranks.values()) >= 65_536:
            raise ValueError("pair keys hold two ids below 65,536")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.joined = np.zeros((256, 256), bool)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                self.joined[token[i - 1], token[i]] = True
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 16 | right)
                    values.append(rank)
        self._hash(np.array(keys, np.uint32), np.array(values, np.int32))
        self.word, self.odd = regex.compile(WORDS), odd()
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {bytes([b]): (int(i),) for b, i in enumerate(self.byte_id)}

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, at most an eighth full; an empty slot has the value NO_MERGE."""
        self.bits = max(8, int(len(keys) * 8 - 1).bit_length())
        self.slot_key = np.zeros(1 << self.bits, np.uint32)
        self.slot_rank = np.full(1 << self.bits, NO_MERGE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_rank[slot[left]] == NO_MERGE
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.slot_key[slot[put]] = keys[put]
            self.slot_rank[slot[put]] = values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, which is also the id of the merged token; NO_MERGE where there is none."""
        flat = ((left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)).ravel()
        out = np.full(flat.shape, NO_MERGE, np.int32)
        slot, open_ = self._slot(flat), np.arange(len(flat))
        while len(open_):
            at = slot[open_]
            found = self.slot_rank[at]
            hit = self.slot_key[at] == flat[open_]
            out[open_[hit]] = found[hit]
            open_ = open_[~hit & (found != NO_MERGE)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece. Pieces share a matrix with those of a similar length."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        width = 2
        order = np.argsort(lengths, kind="stable")
        ends = [0]
        while ends[-1] < len(pieces):
            ends.append(int(np.searchsorted(lengths[order], width, "right")))
            bucket = order[ends[-2] : ends[-1]]
            # the matrix of a bucket stays near 16 MB however many or long its pieces are
            step = max(1, 2_000_000 // width)
            for i in range(0, len(bucket), step):
                self._merge_bucket(pieces, bucket[i : i + step], min(width, int(lengths[bucket].max(initial=2))), out)
            width *= 2
        return out

    def _merge_bucket(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[tuple[int, ...]]) -> None:
        size = np.array([len(pieces[r]) for r in rows], np.int64)
        raw = np.frombuffer(b"".join(pieces[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        ids = self.byte_id[raw]
        column = np.arange(width)
        ranks = np.where(column[None, 1:] < size[:, None], self.rank(ids[:, :-1], ids[:, 1:]), NO_MERGE)
        while len(rows):
            at = ranks.argmin(1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == NO_MERGE
            for r, n, line in zip(rows[done], size[done], ids[done], strict=True):
                out[r] = tuple(line[:n].tolist())
            if done.any():
                keep = ~done
                rows, size, ids, ranks, at, best = rows[keep], size[keep], ids[keep], ranks[keep], at[keep], best[keep]
                every = every[: len(rows)]
                if not len(rows):
                    return
            ids[every, at] = best
            width = ids.shape[1]
            stay = np.ones(ids.shape, bool)
            stay[every, at + 1] = False
            ids = ids[stay].reshape(len(rows), width - 1)
            # the pair after the merge takes the place of the merged one
            ranks = ranks[stay[:, 1:]].reshape(len(rows), width - 2)
            size -= 1
            before, after = at > 0, at + 1 < size
            if before.any():
                e, a = every[before], at[before]
                ranks[e, a - 1] = self.rank(ids[e, a - 1], ids[e, a])
            if after.any():
                e, a = every[after], at[after]
                ranks[e, a] = self.rank(ids[e, a], ids[e, a + 1])
            last = ~after & (at < ranks.shape[1])
            ranks[every[last], at[last]] = NO_MERGE
            if ids.shape[1] > 2 and (top := max(2, int(size.max()))) < ids.shape[1]:
                ids, ranks = np.ascontiguousarray(ids[:, :top]), np.ascontiguousarray(ranks[:, : top - 1])
            elif ids.shape[1] == 1:
                for r, line in zip(rows, ids, strict=True):
                    out[r] = tuple(line.tolist())
                return

    def learn(self, new: list[str]) -> None:
        """Put the ids of new words into the cache."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        last = np.searchsorted(at, ends)
        start, size = at[:-1], np.diff(at)
        # each piece gets the number of its distinct bytes: short ones packed into 64 bits, long ones by dictionary
        which = np.empty(len(start), np.int64)
        short = np.flatnonzero(size < 8)
        packed = size[short].astype(np.uint64) << np.uint64(56)
        for k in range(7):
            has = size[short] > k
            packed[has] |= data[start[short][has] + k].astype(np.uint64) << np.uint64(8 * k)
        _, first, which[short] = np.unique(packed, return_index=True, return_inverse=True)
        pieces = [joined[a : a + n] for a, n in zip(start[short][first].tolist(), size[short][first].tolist(), strict=True)]
        numbers: dict[bytes, int] = {}
        for i in np.flatnonzero(size >= 8).tolist():
            which[i] = len(pieces) + numbers.setdefault(joined[start[i] : start[i] + size[i]], len(numbers))
        pieces += numbers
        if len(self.pieces) > CACHED_WORDS:
            self.pieces = {bytes([b]): (int(i),) for b, i in enumerate(self.byte_id)}
        fresh = [p for p in pieces if p not in self.pieces]
        self.pieces.update(zip(fresh, self.merge(fresh), strict=True))
        known = [self.pieces[p] for p in pieces]
        length = np.array([len(k) for k in known], np.int64)
        flat = np.fromiter(chain.from_iterable(known), np.int32, int(length.sum()))
        offset = np.cumsum(length) - length
        ids = flat[ranges(offset[which], length[which])].tolist()
        stop = np.concatenate(([0], np.cumsum(length[which])))[last].tolist()
        begin = 0
        for w, end in zip(new, stop, strict=True):
            self.words[w] = tuple(ids[begin:end])
            begin = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for an empty or null text."""
        cut = [(self.word if self.odd.search(t) or ASTRAL.search(t) else FAST_WORDS).findall(t) if t else [] for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        words = self.words
        new = [w for w in set(chain.from_iterable(cut)) if w not in words]
        if new:
            self.learn(new)
        get = self.words.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, c)), np.int32) for c in cut]


_encoders: dict[int, MatrixBpe] = {}


def encoder(rank_file: bytes) -> MatrixBpe:
    """One encoder for each vocabulary and Python worker."""
    key = hash(rank_file)
    if key not in _encoders:
        _encoders[key] = MatrixBpe(rank_file)
    return _encoders[key]


def text_groups(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together, so that memory doesn't follow the batch."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_column(
    df: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k"
) -> DataFrame:
    """``key`` and the token ids of ``text`` of every row, without special tokens, in one pass and no shuffle.

    A null and an empty text have an empty list of ids. A text's strings that look like special tokens are ordinary
    text. Repeated rows give repeated rows; other columns are not read, so their names don't matter.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizers, name))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                found = bpe.encode(texts[a:b])
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(f) for f in found], out=offsets[1:])
                values = np.concatenate(found) if found else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, ids])

    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, `{ids}` array<int>")


def token_counts(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokens: str = "n_tokens", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k"
) -> DataFrame:
    """``key`` and the number of tokens of ``text`` of every row; null and empty texts have none."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizers, name))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                n = pa.array([len(f) for f in bpe.encode(texts[a:b])], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n], names=[key, tokens])

    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, `{tokens}` bigint")
