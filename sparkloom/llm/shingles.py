"""Word hashes and word shingles of texts, as numpy over whole Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(0x51A9))
#: A random 64-bit value for each byte, and the odd base of prefix sums: rolling hashes, which only pick places.
EXACT_VALUE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) mod 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base % (1 << 64)), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, each text followed by one space; and where each text begins (one more entry for the end). Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lengths = np.diff(offsets)
    starts = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    out = np.full(int(starts[-1]), 32, dtype=np.uint8)
    if len(lengths) and offsets[-1] > offsets[0]:
        body = np.ones(len(out), dtype=bool)
        body[starts[1:] - 1] = False
        out[body] = data[offsets[0] : offsets[-1]]
    return out, starts


def bounded(batch: pa.RecordBatch, text: int, limit: int = 1 << 20):
    """Slices of a batch whose texts have about `limit` bytes at most (one longer text is a slice)."""
    column = batch.column(text)
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.float64)) + 64
    slot = (np.cumsum(sizes) // limit).astype(np.int64)
    cuts = np.flatnonzero(np.diff(slot)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if end > begin:
            yield batch.slice(begin, end - begin)


_HASHED = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_AS_SMALL = np.arange(256, dtype=np.uint8)
_AS_SMALL[65:91] = _AS_SMALL[97:123]


def spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, exact: bool = False, key: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [begin, end); ASCII capitals as small letters, unless exact.

    Eight bytes at a time go through a finaliser that depends on those before, so unlike a polynomial's the hashes have no collisions
    that a pattern makes; with a secret key nobody can look for any.  Ranges over 256 bytes have a cryptographic hash.
    """
    wide = np.concatenate([data if exact else _AS_SMALL[data], np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(wide, shape=(len(data) + 1, 8), strides=(1, 1), writeable=False)
    size = ends - begins
    by_size = mixed(np.arange(_HASHED + 1, dtype=np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    code = by_size[np.minimum(size, _HASHED)]
    # All ranges at once, then those that go on.
    code = mixed(code + (eight[begins].view(np.uint64).ravel() & _MASKS[np.minimum(size, 8)]))
    at, done = np.flatnonzero((size > 8) & (size <= _HASHED)), 8
    while len(at):
        chunk = eight[begins[at] + done].view(np.uint64).ravel() & _MASKS[np.minimum(size[at] - done, 8)]
        code[at] = mixed(code[at] * np.uint64(0x9E3779B97F4A7C15) ^ chunk)
        done += 8
        at = at[size[at] > done]
    secret = key.to_bytes(8, "little")
    for i in np.flatnonzero(size > _HASHED).tolist():
        code[i] = int.from_bytes(hashlib.blake2b(wide[begins[i] : ends[i]], digest_size=8, key=secret).digest(), "little")
    return code


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = SPACE[data]
    inside = ~gap
    begins = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    return begins, np.flatnonzero(inside & np.concatenate([gap[1:], [True]])) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices start, start + 1, ... of ranges, one range after another."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of anything but ASCII white space, A-Z as a-z) and the number of each text's first word (one more entry for the end)."""
    data, starts = text_bytes(column)
    begins, ends = word_spans(data)
    words = spans(data, begins, ends)
    return words, np.searchsorted(begins, starts)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place on (of all words of a batch), and from which place on each text has none."""
    total = np.zeros(len(words), dtype=np.uint64)
    for j in range(k):
        factor = np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1)
        total[: max(len(words) - j, 0)] += words[j:] * factor
    return mixed(total), np.maximum(first[1:] - (k - 1), first[:-1])


def shingle_sets(column: pa.Array, k: int):
    """For each text its sorted distinct shingle hashes (uint64); with fewer than k words one hash of them all; without words none."""
    words, first = word_hashes(column)
    grams, ends = shingle_hashes(words, first, k)
    for begin, end, stop in zip(first[:-1].tolist(), ends.tolist(), first[1:].tolist()):
        if end > begin:
            x = np.sort(grams[begin:end])
            if len(x) > 1:
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
            yield x
        elif stop > begin:
            whole = np.uint64(stop - begin)
            for w in words[begin:stop]:
                with np.errstate(over="ignore"):
                    whole = mixed(np.array([whole * np.uint64(0x9E3779B97F4A7C00) + whole + w], dtype=np.uint64))[0]
            yield np.array([whole], dtype=np.uint64)
        else:
            yield np.empty(0, dtype=np.uint64)
