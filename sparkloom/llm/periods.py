"""Periodic runs of words, by tandem repeats after Gusfield and Stoye.

A run is a stretch with smallest period q and at least two periods, extended as
far as q holds.  All texts of an Arrow slice are one sequence, in which unique
marks part them:

1. Lempel-Ziv blocks.  A square (tandem repeat) that occurs here first crosses a
   block's begin, so common extensions from the blocks' begins, one for each
   root length that the blocks allow, give squares that cover the first
   occurrence of every distinct square.
2. Suffix-link walks.  From a square's place the suffix link leads to the
   sequence without its first word; the walk goes on while the next word makes
   that a square again.  On a suffix array a link is the next place of the
   sequence, and one common extension tells how far a walk goes.  All loci passed,
   each once, are the vocabulary of squares.
3. Every locus is an interval of the suffix array, whose places are all
   occurrences of its square.  Squares of one root length at successive places
   merge into a run.

Squares whose root is itself a power are left out before step 2: their runs are
those of the shorter root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .shingles import SPACE, bounded, mixed, ragged, shingle_hashes, text_bytes, word_spans

#: Words of a repeat that every run of LEAST words or more holds: a run has length - period >= LEAST / 2 words that return a period later.
LEAST, REPEAT = 12, 6


class Extensions:
    """Names of all substrings of 2^level symbols, level by level, until all differ: exact comparison of substrings.

    The sequence must be parted by symbols that occur once, the last symbol being one; compared places must differ.
    """

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        name = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        levels = []
        while True:
            levels.append(np.append(name, -1).astype(np.int32))
            distinct = int(name.max()) + 1 if n else 0
            if distinct == n:
                break
            step = 1 << (len(levels) - 1)
            second = np.zeros(n, dtype=np.int64)
            second[: n - step] = name[step:] + 1
            pair = name * (distinct + 1) + second
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            new = np.zeros(n, dtype=np.int64)
            new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
            name = np.empty(n, dtype=np.int64)
            name[order] = new
        self.levels = levels
        self.rank = levels[-1][:n]
        self.order = np.empty(n, dtype=np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common sequence from i and j on (j at most n)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            names = self.levels[level]
            same = (names[i] == names[j]) << level
            i += same
            j += same
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common sequence that ends with i and j (inclusive; i < j, i may be -1)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[level], 1 << level
            a = i - (step - 1)
            same = (a >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(j - (step - 1), 0)])
            same = same.astype(np.int64) << level
            i -= same
            j -= same
        return begin - i

    def interval(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that begin with the `length` symbols at `at`."""
        low, high = self.rank[at].astype(np.int64), self.rank[at].astype(np.int64)
        level = np.frexp(length.astype(np.float64))[1] - 1
        for one in np.unique(level).tolist():
            some, names = np.flatnonzero(level == one), self.levels[one]
            # Two names, of the first and of the last 2^level symbols, tell the whole.
            tail = length[some] - (1 << one)
            head_name, tail_name = names[at[some]], names[at[some] + tail]

            def same(rank: np.ndarray, inside: np.ndarray) -> np.ndarray:
                place = self.order[np.where(inside, rank, 0)].astype(np.int64)
                return inside & (names[place] == head_name) & (names[np.minimum(place + tail, self.n)] == tail_name)

            a, b = low[some], high[some]
            for bit in range(self.n.bit_length(), -1, -1):
                step = 1 << bit
                a = a - step * same(a - step, a >= step)
                b = b + step * same(b + step, b + step < self.n)
            low[some], high[some] = a, b
        return low, high


def _blocks(ext: Extensions) -> np.ndarray:
    """Begins of the Lempel-Ziv blocks: the longest earlier match of each place, or one new symbol."""
    n = ext.n
    order = ext.order.tolist()
    before, after = [n] * (n + 1), [n] * (n + 1)
    for a, b in zip(order[:-1], order[1:]):
        after[a] = b
        before[b] = a
    # Taken out from the last place to the first: the neighbours left are the nearest suffixes that begin earlier.
    for i in range(n - 1, -1, -1):
        a, b = before[i], after[i]
        after[a] = b
        before[b] = a
    at = np.arange(n)
    longest = np.maximum(ext.forward(np.array(before[:n], dtype=np.int64), at), ext.forward(np.array(after[:n], dtype=np.int64), at)) if n else at
    longest, begins, i = np.maximum(longest, 1).tolist(), [], 0
    while i < n:
        begins.append(i)
        i += longest[i]
    return np.array(begins, dtype=np.int64)


def _prime_factors(n: int) -> np.ndarray:
    """The smallest prime factor of each number up to n."""
    factor = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, n + 1, p)] = p
    return factor


def _covering(ext: Extensions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin, end and root length of stretches of squares that cover the first occurrence of every square of a primitive root."""
    cuts = _blocks(ext)
    sizes = np.diff(np.append(cuts, ext.n))
    h, size, last = cuts[1:], sizes[1:], sizes[:-1]
    # The first half crosses the block's begin: the second half is inside the block.
    a, k = np.repeat(h, size), ragged(np.ones(len(size), dtype=np.int64), size)
    # The second half crosses it: that lies in this block and the one before.
    both = np.minimum(size + last, h)
    b, kb = np.repeat(h, both), ragged(np.ones(len(both), dtype=np.int64), both)
    left, k = np.concatenate([a, b - kb]), np.concatenate([k, kb])
    inside = left + k < ext.n
    left, k = left[inside], k[inside]
    names = ext.levels[0]
    near = (names[left] == names[left + k]) | ((left > 0) & (names[np.maximum(left - 1, 0)] == names[np.maximum(left - 1, 0) + k]))
    left, k = left[near], k[near]
    begin, end = left - ext.backward(left - 1, left + k - 1), left + k + ext.forward(left, left + k)
    square = end - begin >= 2 * k
    begin, end, k = begin[square], end[square], k[square]
    rest, power = k.copy(), np.zeros(len(k), dtype=bool)
    factor = _prime_factors(int(k.max(initial=1)))
    while (rest > 1).any():
        p = np.where(rest > 1, factor[rest], 1)
        shift = k // p
        at = np.flatnonzero((p > 1) & ~power)
        power[at] = ext.forward(begin[at], begin[at] + shift[at]) >= k[at] - shift[at]
        rest = rest // p
    found = np.unique(np.stack([begin, end, k])[:, ~power], axis=1)
    return found[0], found[1], found[2]


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin, end and smallest period of all runs of a sequence whose texts are parted, and ended, by symbols that occur once."""
    ext = Extensions(symbols)
    begin, end, k = _covering(ext)
    # Walks along suffix links: one locus for each rotation, as many as the stretch has squares or the root has words.
    steps = np.minimum(end - begin - 2 * k + 1, k)
    at, k = ragged(begin, steps), np.repeat(k, steps)
    low, high = ext.interval(at, 2 * k)
    locus = np.unique(np.stack([k, low, high]), axis=1)
    k, low, high = locus[0], locus[1], locus[2]
    places = high - low + 1
    at, k = ext.order[ragged(low, places)].astype(np.int64), np.repeat(k, places)
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)
    last = np.append(first[1:], True)[: len(at)]
    return at[first], at[last] + 2 * k[last], k[first]


def _candidates(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that can be in a run of LEAST words, and the number of each one's stretch: all others have no repeat of REPEAT words in theirs."""
    at, part = np.arange(len(ids)), text
    codes = mixed(ids.astype(np.uint64) + np.uint64(1))
    for _ in range(6):
        if not len(at):
            break
        grams, _ = shingle_hashes(codes[at], np.array([0, len(at)]), REPEAT)
        whole = np.zeros(len(at), dtype=bool)
        whole[: max(len(at) - REPEAT + 1, 0)] = part[REPEAT - 1 :] == part[: max(len(at) - REPEAT + 1, 0)]
        where = np.flatnonzero(whole)
        key = mixed(grams[where] ^ mixed(part[where].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(where), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cover = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(cover, where[twice], 1)
        np.subtract.at(cover, where[twice] + REPEAT, 1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        fresh = np.ones(len(kept), dtype=bool)
        fresh[1:] = (np.diff(kept) > 1) | (part[kept[1:]] != part[kept[:-1]])
        number = np.cumsum(fresh) - 1
        long = np.bincount(number, minlength=1)[number] >= LEAST if len(kept) else np.zeros(0, dtype=bool)
        done = len(kept) == len(at) and long.all()
        at, part = at[kept[long]], number[long]
        if done:
            break
    return at, part


def text_runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, begin, end, period) of all runs of LEAST words or more; ids are the words of all texts, first each text's first word (and the end)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, part = _candidates(ids, text)
    if not len(at):
        return np.zeros((0, 4), dtype=np.int64)
    parts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
    # Behind each stretch a mark, below all words' symbols.
    place = np.arange(len(at)) + np.cumsum(np.concatenate([[0], np.diff(part) != 0]))
    symbols = np.empty(len(at) + len(parts), dtype=np.int64)
    symbols[:] = -1
    symbols[place] = ids[at].astype(np.int64) + len(parts)
    marks = symbols < 0
    symbols[marks] = np.arange(len(parts))
    source = np.zeros(len(symbols), dtype=np.int64)
    source[place] = at
    begin, end, period = runs(symbols)
    long = end - begin >= np.maximum(LEAST, 2 * period)
    begin, end, period = source[begin[long]], source[end[long] - 1] + 1, period[long]
    owner = text[begin]
    found = np.stack([owner, begin - first[owner], end - first[owner], period], axis=1)
    return found[np.lexsort((period, found[:, 1], owner))]


def planted(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which word stands at each place: where h % 10 is 0, words from g % n on repeat with period 1 + (n - a) // (3 + g % 8), g = h // 10; h is -1 for none."""
    source = np.arange(first[-1])
    for d in np.flatnonzero((h >= 0) & (h % 10 == 0)).tolist():
        begin, n = int(first[d]), int(first[d + 1] - first[d])
        if n:
            g = int(h[d]) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[begin + a : begin + n] = begin + a + np.arange(n - a) % p
    return source


def _summary(part: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    data, starts = text_bytes(part.column(1))
    data[SPACE[data]] = 32
    begins, ends = word_spans(data)
    first = np.searchsorted(begins, starts)
    bounds = np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[~SPACE[data]])])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    source = planted(first, part.column(2).fill_null(-1).to_numpy(zero_copy_only=False))
    found = text_runs(ids[source], first)
    change = np.zeros(len(source) + 1, dtype=np.int64)
    at = first[found[:, 0]]
    np.add.at(change, at + found[:, 1] + found[:, 3], 1)
    np.subtract.at(change, at + found[:, 2], 1)
    kept = np.cumsum(change[:-1]) == 0
    chosen = source[kept]
    sizes = ends[chosen] - begins[chosen] + 1
    # Each kept word with the white space behind it.
    joined = memoryview(data[ragged(begins[chosen], sizes)])
    cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(kept)])[first]].tolist()
    edges = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1)).tolist()
    rows = []
    for d, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        own = found[lo:hi, 1:]
        length = own[:, 1] - own[:, 0]
        best = (None,) * 4
        if hi > lo:
            i = int(np.argmax(length))
            n, q = int(length[i]), int(own[i, 2])
            best = (int(own[i, 0]), n, q, 1000 * n // q)
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in own.tolist())
        text = joined[cuts[d] : max(cuts[d + 1] - 1, cuts[d])]
        rows.append((hi - lo, *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    columns = [part.column(0).cast(pa.int64())] + [pa.array(x, f.type) for x, f in zip(zip(*rows), list(schema)[1:])]
    return pa.record_batch(columns, schema=schema)


def periodic_runs(docs: DataFrame, salt: F.Column | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    `salt` (a bigint column, null or left out: none) decides which texts get planted repeats.  Words are runs of anything but ASCII white
    space, compared byte by byte.  Null and empty texts have no runs; every row has its result, whatever its doc_id, repeated rows the same;
    of runs of equal length the first counts, then the one of the smallest period; whole texts of any length are read, one text by one task.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 1):
                yield _summary(part, schema)

    salt = F.lit(None) if salt is None else salt
    slim = docs.select("doc_id", "text", salt.cast("long").alias("__sl_h"))
    return small_batches(slim).mapInArrow(find, ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in schema))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more in all documents, with repeats planted by the crc32 of doc_id.

    A null doc_id plants none; nulls, empty texts, ties, repeated rows and empty tables as in `periodic_runs`.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return periodic_runs(docs, F.crc32(F.col("doc_id").cast("string")))
