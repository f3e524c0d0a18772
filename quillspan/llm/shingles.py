"""Token shingles of texts as sets of 64-bit hashes, computed in Arrow batches.

Tokens are maximal runs of letters or digits of the lower-cased text. A shingle is `width` consecutive tokens; its number
mixes the tokens' 64-bit hashes in order and keeps BITS bits, so a set of shingles is a sorted array of distinct numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

TOKEN = re.compile(r"[^\W_]+")
CACHE_LIMIT = 200_000
#: Bits of a shingle's number: two texts of 1,000 shingles share one by chance in about one of 280 million pairs.
BITS = 48
_KEPT = np.uint64(64 - BITS)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class TokenHashes(dict):
    """Hashes of tokens by token; emptied when it holds CACHE_LIMIT of them."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


def shingle_set(text: str | None, width: int, min_tokens: int, hashes: TokenHashes) -> np.ndarray | None:
    """Sorted distinct shingle hashes; None for null texts and those of fewer than `min_tokens` tokens."""
    if not text:
        return None
    tokens = TOKEN.findall(text.lower())
    if len(tokens) < max(min_tokens, width):
        return None
    t = np.array([hashes[x] for x in tokens], dtype=np.uint64)
    n = len(t) - width + 1
    h = t[:n].copy()
    for i in range(1, width):
        h = (h * _A) ^ ((t[i : i + n] + _B) * _C)
        h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return np.unique(h >> _KEPT)


class Sets:
    """The shingle sets of a batch, end to end: of the row at[i] they are values[offsets[i] : offsets[i + 1]], sorted."""

    def __init__(self, at: list[int], values: np.ndarray, sizes: np.ndarray):
        self.at, self.values, self.sizes = at, values, sizes
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.offsets[i] : self.offsets[i + 1]]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at)), self.sizes)

    def packed(self) -> list[bytes]:
        """Each set as bytes: the lowest bytes of its numbers, then the next ones, which compress better side by side."""
        planes = np.ascontiguousarray(self.values.view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T)
        return [planes[:, a:b].tobytes() for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]


def unpacked(packed: bytes) -> np.ndarray:
    """The set that `Sets.packed` made the bytes of."""
    planes = np.frombuffer(packed, np.uint8).reshape(BITS // 8, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : BITS // 8] = planes.T
    return wide.view(np.uint64).ravel()


def sets_from(packed: list[bytes]) -> Sets:
    values = [unpacked(x) for x in packed]
    return Sets(list(range(len(values))), np.concatenate(values) if values else np.empty(0, np.uint64), np.array([len(x) for x in values], np.int64))


def shingle_sets(texts: list[str | None], width: int, min_tokens: int, hashes: TokenHashes) -> Sets:
    """shingle_set of many texts at once."""
    at, flat, counts = [], [], []
    least = max(min_tokens, width)
    for i, text in enumerate(texts):
        if text:
            tokens = TOKEN.findall(text.lower())
            if len(tokens) >= least:
                at.append(i)
                flat += tokens
                counts.append(len(tokens))
    if not at:
        return Sets([], np.empty(0, np.uint64), np.empty(0, np.int64))
    t = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    n = np.array(counts)
    h = t[: len(t) - width + 1].copy()
    for i in range(1, width):
        h = (h * _A) ^ ((t[i : i + len(h)] + _B) * _C)
        h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    h >>= _KEPT
    doc = np.repeat(np.arange(len(n)), n)[: len(h)]
    inside = np.ones(len(h), dtype=bool)
    ends = np.cumsum(n)[:-1]
    for i in range(1, width):
        inside[ends - i] = False
    # Text and number side by side in 64 bits (a call has at most TEXTS texts): one sort orders both.
    both = np.sort((doc[inside].astype(np.uint64) << np.uint64(BITS)) | h[inside])
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    doc = (both >> np.uint64(BITS)).astype(np.int64)
    return Sets(at, both & np.uint64((1 << BITS) - 1), np.bincount(doc, minlength=len(n)))


#: Texts are turned into sets in runs of about so many characters, and of so many texts at most.
RUN = 2_000_000
TEXTS = 1 << (64 - BITS)


def sets_of(batches: Iterator[pa.RecordBatch], width: int, min_tokens: int, text_at: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    """Batches in runs of about RUN characters, with the sets of their texts."""
    hashes = TokenHashes()
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        upto = np.cumsum([len(t) if t else 0 for t in texts])
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + RUN, side="right")))
            end = min(end, begin + TEXTS)
            yield batch.slice(begin, end - begin), shingle_sets(texts[begin:end], width, min_tokens, hashes)
            begin = end
