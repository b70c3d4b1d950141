"""Suffix-array dedup: long byte strings that start more than once, by interval trees of sparse suffix arrays.

1. Anchors.  In every window of `length` bytes the gram of `length // 5` bytes with the least hash (the first of equal ones) is an
   anchor; so two places of one string of `length` bytes have anchors at the same offset, and the suffixes that begin at anchors are
   enough.  Only hashes of an anchor's gram and context (the bytes that any window over it can hold) are shuffled.  Anchors whose gram
   occurs once go; where all contexts of a gram are equal, they are repeats as a whole.
2. Suffix arrays.  Of other grams each distinct context is cut from one text and dealt by its gram.  A task sorts the suffixes of
   its grams, scans the common prefixes of neighbours with a stack for the tree of prefix intervals, and sorts the members of each
   interval by what stands before them: neighbours there tell how far a member's match extends to the left, and where extensions
   branch.  An interval and a branch of its left extensions are a maximal repeat with all its occurrences.
3. A gram with more than GROUP distinct contexts is dealt anew: windows are split by the offset of the anchor in them, and
   contexts by the bytes that all windows of a part of the offsets hold; equal trimmed contexts become one.  At last a part is one
   offset, whose contexts are all equal; so groups of any size are split, and no pair is lost.
4. The covers of contexts go back to all their places, and are merged text by text.

Gram hashes only deal contexts out; equality is told by bytes, or by 120 bits of a cryptographic hash.  Repeats longer than a context
are found piece by piece, at their anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, sized, small_batches, stage
from .shingles import BASE, BASE_INVERSE, EXACT_VALUE, bounded, mixed, powers, text_bytes

#: Distinct contexts of a gram that one task sorts at most; parts that a larger one's offsets are split into.
GROUP, FAN = 2048, 8
#: Window begins that are looked at together.
CHUNK = 1 << 20
#: Bytes of contexts that are sorted together, besides those of one gram.
BLOCK_BYTES = 1 << 21


def seed_of(length: int) -> int:
    return max(length // 5, 1)


def _stretches(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin, end and period of all stretches of `seed` bytes or more that have a period of half a seed at most (of multiples of a period, each)."""
    found = []
    word = 8 if seed >= 30 else 1
    kind = np.uint64 if word == 8 else np.uint8
    for p in range(1, seed // 2 + 1):
        n = (len(data) - p) // word
        if n < 1:
            break
        # Aligned words that return p bytes later; what of a stretch is no whole word is looked at byte by byte.
        hits = np.flatnonzero(data[: n * word].view(kind) == data[p : p + n * word].copy().view(kind))
        if not len(hits):
            continue
        new = np.flatnonzero(np.diff(hits) > 1)
        begin, end = hits[np.append(0, new + 1)] * word, (hits[np.append(new, len(hits) - 1)] + 1) * word
        for _ in range(word - 1):
            begin = begin - ((begin > 0) & (data[np.maximum(begin - 1, 0)] == data[np.maximum(begin - 1, 0) + p]))
            here = np.minimum(end, len(data) - p - 1)
            end = end + ((end < len(data) - p) & (data[here] == data[here + p]))
        long = end + p - begin >= seed
        found.append((begin[long], end[long] + p, np.full(int(long.sum()), p)))
    none = [(np.empty(0, np.int64),) * 3]
    return tuple(np.concatenate(x) for x in zip(*(found or none)))


def _anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all texts (each followed by one byte that isn't its own); and begin and end of stretches that repeat themselves.

    Grams with a period of half their size at most are anchors only where a window has no other.  In a stretch of such a period that is
    longer than a window and a period, every window is also one of those at its first places; the others have no anchor.
    """
    seed = seed_of(length)
    w = length - seed + 1
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    begins_of, ends_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, max(len(data) - length, 0), CHUNK):
        chunk = data[at : at + CHUNK + length - 1]
        n = len(chunk) - seed + 1
        sums = np.zeros(len(chunk) + 1, dtype=np.uint64)
        np.cumsum(EXACT_VALUE[chunk] * powers(BASE, len(chunk)), out=sums[1:])
        gram = mixed((sums[seed:] - sums[:n]) * powers(BASE_INVERSE, n))
        a, b, p = _stretches(chunk, seed)
        change = np.zeros(len(chunk) + 2, dtype=np.int64)
        np.add.at(change, a, 1)
        np.subtract.at(change, b - seed + 1, 1)
        last = (np.cumsum(change[:n]) > 0).astype(np.uint64) << np.uint64(63)
        least = last | (gram >> np.uint64(33) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        have = 1
        while 2 * have <= w:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        least = np.minimum(least[: len(least) - (w - have)], least[w - have :])
        begins = np.arange(len(least)) + at
        text = np.searchsorted(starts, begins, side="right") - 1
        wanted = begins + length < starts[text + 1]
        own = np.searchsorted(starts, [a + at, b - 1 + at], side="right") - 1
        for begin, end, period, first, final in zip((a + at).tolist(), (b + at).tolist(), p.tolist(), *own.tolist()):
            for t in range(first, final + 1):
                low, high = max(begin, int(starts[t])), min(end, int(starts[t + 1]) - 1)
                if high - low >= length + period:
                    wanted[low + period - at : high - length + 1 - at] = False
                    begins_of.append(np.array([low]))
                    ends_of.append(np.array([high]))
        first = np.unique((least[wanted] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        places.append(first + at)
        hashes.append(gram[first])
    places, kept = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[kept], np.concatenate(begins_of), np.concatenate(ends_of)


def _anchored(raw: bytes, place: int, length: int) -> bool:
    """Whether `place` is the anchor of a window inside these bytes; then it is one wherever they occur."""
    data = np.frombuffer(raw + b" ", dtype=np.uint8)
    return place in _anchors(data, np.array([0, len(data)]), length)[0]


def _name(*parts: bytes) -> tuple[int, int]:
    """120 bits of a cryptographic hash, as two numbers."""
    h = hashlib.blake2b(digest_size=15)
    for p in parts:
        h.update(p)
    whole = int.from_bytes(h.digest(), "big")
    return whole >> 60, whole & ((1 << 60) - 1)


def _names(found: list[tuple[int, int]]) -> list[pa.Array]:
    x = np.array(found, dtype=np.int64).reshape(-1, 2)
    return [pa.array(x[:, 0]), pa.array(x[:, 1])]


def _short(n: int) -> bytes:
    return n.to_bytes(8, "big")


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, digest (sha256 of the text) and r1, r2: 120 bits of a hash of doc_id and text.

    Rows of one doc_id and text are one occurrence each, but have one name and one result.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))
    name = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest"), 256)
    return df.select("*", *[F.conv(F.substring(name, a, 15), 16, 10).cast("long").alias(r) for r, a in (("r1", 1), ("r2", 16))])


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """(r1, r2, text) -> g, c1, c2, r1, r2, pos, end: each anchor's gram hash, context name, text name and place (in bytes); and,
    without a gram, begin and end of each stretch that repeats itself."""
    reach = length - seed_of(length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 2):
                data, starts = text_bytes(part.column(2))
                places, grams, selfs, ends = _anchors(data, starts, length)
                text = np.searchsorted(starts, places, side="right") - 1
                begin = np.maximum(places - reach, starts[text])
                end = np.minimum(places + length, starts[text + 1] - 1)
                raw = memoryview(data)
                contexts = [_name(_short(p - a), raw[a:b]) for p, a, b in zip(places.tolist(), begin.tolist(), end.tolist())]
                own = np.searchsorted(starts, selfs, side="right") - 1
                rows, none = pa.array(np.concatenate([text, own])), pa.nulls(len(own), pa.int64())
                both = [pa.concat_arrays([x, none]) for x in (pa.array(grams.view(np.int64)), *_names(contexts))]
                pos = pa.array(np.concatenate([places - starts[text], selfs - starts[own]]))
                end = pa.concat_arrays([pa.nulls(len(text), pa.int64()), pa.array(ends - starts[own])])
                yield pa.record_batch([*both, part.column(0).take(rows), part.column(1).take(rows), pos, end], names=["g", "c1", "c2", "r1", "r2", "pos", "end"])

    slim = texts.where(F.octet_length("text") >= length).select("r1", "r2", "text")
    return small_batches(slim).mapInArrow(find, "g bigint, c1 bigint, c2 bigint, r1 bigint, r2 bigint, pos bigint, end bigint")


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """texts(r1, r2, text), wanted(r1, r2, pos, g, c1, c2, n) -> k1, k2, t1, t2, n, low, high, before, context: the bytes of each wanted context."""
    reach = length - seed_of(length)
    listed = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("pos", "g", "c1", "c2", "n")).alias("wanted"))
    listed = stage(listed, "wanted")
    names = listed.select("r1", "r2")
    texts = texts.join(sized(names, listed.count(), 48), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = wanted.values
                pos = flat.field("pos").to_numpy()
                before = np.minimum(pos, reach)
                contexts = [raw[p - b : p + length] for p, b in zip(pos.tolist(), before.tolist())]
                n = len(pos)
                fixed = [pa.array(np.full(n, x, dtype=np.int32)) for x in (0, reach)]
                columns = [flat.field("g"), pa.array(np.zeros(n, dtype=np.int64)), *[flat.field(c) for c in ("c1", "c2", "n")], *fixed, pa.array(before.astype(np.int32)), pa.array(contexts, pa.binary())]
                yield pa.record_batch(columns, names=["k1", "k2", "t1", "t2", "n", "low", "high", "before", "context"])

    joined = texts.join(listed, ["r1", "r2"]).select(F.col("text").cast("binary").alias("text"), "wanted")
    return small_batches(joined).mapInArrow(cut, "k1 bigint, k2 bigint, t1 bigint, t2 bigint, n bigint, low int, high int, before int, context binary")


class SuffixArray:
    """The enhanced suffix array of one block of contexts: suffixes from the anchors on, sorted inside their groups, with common prefixes
    of neighbours; and the same of the reversed bytes before the anchors."""

    def __init__(self, group: np.ndarray, data: np.ndarray, starts: np.ndarray, before: np.ndarray, length: int):
        at, sizes = starts[:-1] + before, np.diff(starts)
        self.after, self.before = sizes - before, before
        right = self._matrix(data, at[:, None] + np.arange(length), self.after, length)
        left = self._matrix(data, at[:, None] - 1 - np.arange(length - seed_of(length)), before, length - seed_of(length))
        self.order, self.common = self._sorted(group, right, self.after)
        self.left_order, self.left_common = self._sorted(group, left, self.before)
        self.left_rank = np.empty(len(at), dtype=np.int64)
        self.left_rank[self.left_order] = np.arange(len(at))

    @staticmethod
    def _matrix(data: np.ndarray, index: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        index[np.arange(width) >= sizes[:, None]] = -1
        return np.append(data, np.uint8(0))[index]

    @staticmethod
    def _sorted(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the rows inside their groups (a prefix of another row comes first), and the common prefix of each with the row before (-1: another group)."""
        ends = [x.astype(">u4").view(np.uint8).reshape(-1, 4) for x in (group, sizes)]
        whole = np.ascontiguousarray(np.concatenate([ends[0], rows, ends[1]], axis=1))
        order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
        a, b = order[:-1], order[1:]
        other = rows[a] != rows[b]
        first = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
        common = np.minimum(first, np.minimum(sizes[a], sizes[b]))
        common[group[a] != group[b]] = -1
        return order, np.concatenate([[-1], common])

    def intervals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Every interval of the prefix tree: its common prefix, its members by what stands before them, and how much of that each shares with the one before it."""
        stack: list[tuple[int, int]] = []
        common = self.common.tolist()
        for i, now in enumerate([*common[1:], -1], 1):
            begin = i - 1
            while stack and stack[-1][0] > now:
                prefix, begin = stack.pop()
                ranks = np.sort(self.left_rank[self.order[begin:i]])
                yield prefix, self.left_order[ranks], np.minimum.reduceat(self.left_common[: ranks[-1] + 1], ranks[:-1] + 1)
            if now >= 0 and (not stack or stack[-1][0] < now):
                stack.append((now, begin))

    def covers(self, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """How far to the left and right of its anchor each context is covered by strings of `length` bytes that start elsewhere too (0, 0: not at all)."""
        left, right = np.where(n > 1, self.before, 0), np.where(n > 1, self.after, 0)
        for prefix, members, shared in self.intervals():
            extension = np.zeros(len(members), dtype=np.int64)
            extension[1:] = shared
            extension[:-1] = np.maximum(extension[:-1], shared)
            whole = extension + prefix >= length
            if whole.any():
                at = members[whole]
                left[at] = np.maximum(left[at], extension[whole])
                right[at] = np.maximum(right[at], prefix)
        return left, right

    def groups(self, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Maximal repeats of `length` bytes or more: bytes before and from the anchor on that all members share, and the members.

        The members' left extensions differ beyond the first number, their right ones beyond the second.
        """
        rank = np.empty(len(self.order), dtype=np.int64)
        rank[self.order] = np.arange(len(self.order))
        for prefix, members, shared in self.intervals():
            stack: list[tuple[int, int]] = []
            for i, now in enumerate([*shared.tolist(), -1], 1):
                begin = i - 1
                while stack and stack[-1][0] > now:
                    extension, begin = stack.pop()
                    places = np.sort(rank[members[begin:i]])
                    # Members in one child of the interval share more than its prefix: they are that child's.
                    if extension + prefix >= length and np.minimum.reduceat(self.common[: places[-1] + 1], places[:-1] + 1).min() == prefix:
                        yield extension, prefix, members[begin:i]
                if now >= 0 and (not stack or stack[-1][0] < now):
                    stack.append((now, begin))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (k1, k2), in tables of about BLOCK_BYTES that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) < BLOCK_BYTES:
            continue
        whole = pa.Table.from_batches(held)
        k1, k2 = whole.column("k1").to_numpy(), whole.column("k2").to_numpy()
        new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        if len(new):
            cut = int(new[-1]) + 1
            yield whole.slice(0, cut)
            whole = whole.slice(cut)
        held = whole.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _array_of(table: pa.Table, length: int) -> SuffixArray:
    k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
    group = np.concatenate([[0], np.cumsum((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))])
    column = table.column("context").combine_chunks().cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[starts[0] : starts[-1]]
    return SuffixArray(group, data, starts - starts[0], table.column("before").to_numpy().astype(np.int64), length)


def _dealt(contexts: DataFrame) -> DataFrame:
    return contexts.repartition("k1", "k2").sortWithinPartitions("k1", "k2")


def _solve(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts of groups that fit a task -> t1, t2, before, after: the cover of each that has one."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            left, right = _array_of(table, length).covers(table.column("n").to_numpy(), length)
            at = np.flatnonzero(right)
            named = [table.column(c).combine_chunks().take(pa.array(at)) for c in ("t1", "t2")]
            yield pa.record_batch([*named, pa.array(left[at].astype(np.int32)), pa.array(right[at].astype(np.int32))], names=["t1", "t2", "before", "after"])

    return _dealt(contexts).mapInArrow(solve, "t1 bigint, t2 bigint, before int, after int")


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """Each context once for every part of its offsets: dealt by the bytes that all windows of the part hold, and trimmed to those that any holds; p1, p2 is the context it comes from."""
    schema = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, t1 bigint, t2 bigint, n bigint, low int, high int, before int, context binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, made, rows = [], [], []
            for r in batch.to_pylist():
                raw, at = r["context"], r["before"]
                width = -(-(r["high"] - r["low"] + 1) // FAN)
                for low in range(r["low"], r["high"] + 1, width):
                    high = min(low + width - 1, r["high"])
                    if max(low, length - (len(raw) - at)) > min(high, at):
                        continue
                    before = min(high, at)
                    trimmed = raw[at - before : at + length - low]
                    keys.append(_name(_short(low), _short(high), raw[at - low : at - high + length]))
                    made.append(_name(_short(low), _short(high), _short(before), trimmed))
                    rows.append((r["t1"], r["t2"], r["n"], low, high, before, trimmed))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            p1, p2, *rest = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([*_names(keys), p1, p2, *_names(made), *rest], names=names)

    return small_batches(contexts.select("k1", "k2", "t1", "t2", "n", "low", "high", "before", "context")).mapInArrow(split, schema)


def _large(contexts: DataFrame) -> DataFrame | None:
    """k1, k2 of groups of more than GROUP contexts; None if there are none."""
    found = stage(contexts.groupBy("k1", "k2").count().where(F.col("count") > GROUP).select("k1", "k2"), "large")
    rows = found.count()
    return sized(found, rows) if rows else None


def _over_groups(contexts: DataFrame, length: int, solve: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """`solve` on all groups of stored contexts, larger ones in parts: (t1, t2, before, after), the cover of each context that has one."""
    large = _large(contexts)
    if large is None:
        return solve(contexts, length)
    small = solve(contexts.join(large, ["k1", "k2"], "left_anti"), length)
    parts = stage(_split(contexts.join(large, ["k1", "k2"]), length), "parts")
    firsts = [F.first(c).alias(c) for c in ("low", "high", "before", "context")]
    distinct = stage(parts.groupBy("k1", "k2", "t1", "t2").agg(F.sum("n").alias("n"), *firsts), "contexts")
    found = stage(_over_groups(distinct, length, solve), "covers")
    found = parts.select("p1", "p2", "t1", "t2").join(found, ["t1", "t2"])
    drop_staged(distinct)
    return small.unionByName(found.groupBy(F.col("p1").alias("t1"), F.col("p2").alias("t2")).agg(F.max("before").alias("before"), F.max("after").alias("after")))


def _repeated(placed: DataFrame) -> DataFrame:
    """Anchors of grams that occur more than once, with `plain`: all contexts of the gram are equal."""
    placed = placed.where("g is not null").drop("end")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)]
    grams = placed.groupBy("g").agg(F.count("*").alias("times"), *ends).where("times > 1")
    # Stored, so that the join's sides are plain exchanges, whose large keys Spark can split.
    grams = stage(grams.select("g", F.expr("min_c1 = max_c1 and min_c2 = max_c2").alias("plain")), "grams")
    return placed.join(grams, "g")


def _distinct_contexts(texts: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """The distinct contexts of grams that have several, with their bytes from one text each."""
    place = F.min(F.struct("r1", "r2", "pos")).alias("at")
    wanted = repeated.where("not plain").groupBy("g", "c1", "c2").agg(F.count("*").alias("n"), place)
    return stage(_cut(texts, wanted.select("at.*", "g", "c1", "c2", "n"), length), "contexts")


def spans(texts: DataFrame, length: int) -> DataFrame:
    """(r1, r2, text) of `keyed` -> r1, r2, spans: the maximal stretches (begin, end in bytes; the last end may lie behind the text's)
    covered by strings of `length` bytes that start anywhere else too.  Texts without any have no row."""
    reach = length - seed_of(length)
    placed = stage(anchors(texts, length), "anchors")
    repeated = stage(_repeated(placed), "repeated")
    covers = _over_groups(_distinct_contexts(texts, repeated, length), length, _solve)
    covers = covers.select(F.col("t1").alias("c1"), F.col("t2").alias("c2"), "before", "after")
    some = repeated.where("not plain").join(covers, ["c1", "c2"]).select("r1", "r2", "pos", "before", "after")
    every = repeated.where("plain").select("r1", "r2", "pos", F.lit(reach).alias("before"), F.lit(length).alias("after"))
    begin = F.greatest(F.col("pos") - F.col("before"), F.lit(0)).alias("begin")
    selfs = placed.where("g is null").select("r1", "r2", "pos", F.lit(0).alias("before"), (F.col("end") - F.col("pos")).cast("int").alias("after"))
    listed = some.unionByName(every).unionByName(selfs).groupBy("r1", "r2").agg(F.collect_set(F.struct(begin, (F.col("pos") + F.col("after")).alias("end"))).alias("spans"))
    return listed.select("r1", "r2", _merged(F.array_sort("spans")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap as one."""
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def add(have: Column, x: Column) -> Column:
        last = F.try_element_at(have, F.lit(-1))
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(last["end"] >= x["begin"], F.concat(F.slice(have, 1, F.size(have) - 1), F.array(longer))).otherwise(F.concat(have, F.array(x)))

    return F.aggregate(spans, none, add)


def _shortened(texts: DataFrame, partly: DataFrame, with_text: bool) -> DataFrame:
    """texts(r1, r2, text), partly(r1, r2, spans) -> r1, r2, n_removed, kept_sha256 (and kept, the bytes)."""
    partly = stage(partly, "partly")
    texts = texts.join(sized(partly.select("r1", "r2"), partly.count(), 48), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, digests, kept = [], [], []
            for raw, cuts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                edges = [0, *[x for c in cuts for x in (c["begin"], min(c["end"], len(raw)))], len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                gone.append(len(raw) - len(rest))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["r1", "r2", "n_removed", "kept_sha256"]
            yield pa.record_batch(columns + [pa.array(kept, pa.binary())] * with_text, names=names + ["kept"] * with_text)

    joined = texts.join(partly, ["r1", "r2"]).select("r1", "r2", F.col("text").cast("binary").alias("text"), "spans")
    return small_batches(joined).mapInArrow(shorten, "r1 bigint, r2 bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * with_text)


def without_repeats(docs: DataFrame, length: int = 400, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: and kept, the bytes left).

    Every byte under a string of `length` bytes that also starts anywhere else, in this text or another, goes.  Null texts count as
    empty; texts under `length` bytes stay whole; rows of one doc_id and text, and copies of any number, are all repeats of each other
    and have one result; a null doc_id is an id; texts of any length are read whole; an empty table gives none; other columns are left out.
    """
    if length < 2:
        raise ValueError("length must be 2 or more")
    texts = keyed(docs)
    found = spans(texts.select("r1", "r2", "text"), length)
    slim = texts.select("doc_id", "r1", "r2", "digest", F.octet_length("text").cast("long").alias("n_bytes"), *([F.col("text").cast("binary").alias("whole")] if with_text else []))
    slim = stage(slim.join(found, ["r1", "r2"], "left"), "spans")
    full = (F.size("spans") == 1) & (F.col("spans")[0]["begin"] == 0) & (F.col("spans")[0]["end"] >= F.col("n_bytes"))
    some = slim.where(F.col("spans").isNotNull() & ~full).select("r1", "r2", "spans").dropDuplicates(["r1", "r2"])
    rest = _shortened(texts.select("r1", "r2", "text"), some, with_text)
    joined = slim.join(rest, ["r1", "r2"], "left")
    none = F.col("spans").isNull()
    columns = [
        F.when(none, F.lit(0)).when(full, F.col("n_bytes")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(none, F.lit(0)).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.when(none, F.col("digest")).when(full, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(none, F.col("whole")).when(full, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
    return joined.select("doc_id", "n_bytes", *columns)


def repeat_groups(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs(doc_id, text) -> g1, g2, length, doc_id, start: every maximal repeat of `length` bytes or more with all its occurrences.

    Of a stretch with a short period (see `_anchors`) the occurrences behind the first periods are left out.  A repeat longer than a context (length - length // 5 bytes before an anchor, length bytes from it on) is several, one at each anchor.
    Groups of more than GROUP contexts are reported by windows of `length` bytes.  Rows as in `without_repeats`.
    """
    texts = keyed(docs)
    repeated = stage(_repeated(stage(anchors(texts.select("r1", "r2", "text"), length), "anchors")), "repeated")
    contexts = _distinct_contexts(texts.select("r1", "r2", "text"), repeated, length)
    schema = "g1 bigint, g2 bigint, c1 bigint, c2 bigint, before int, length int"

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            array = _array_of(table, length)
            raw, before = table.column("context").combine_chunks(), array.before
            t1, t2, n = (table.column(c).to_numpy() for c in ("t1", "t2", "n"))
            made = [(left, right, members) for left, right, members in array.groups(length)]
            # A context of several places is a repeat by itself unless it is one with others already.
            seen = {int(m) for left, right, members in made for m in members.tolist() if left == before[m] and right == array.after[m]}
            made += [(int(before[m]), int(array.after[m]), np.array([m])) for m in np.flatnonzero(n > 1).tolist() if m not in seen]
            rows = []
            for left, right, members in made:
                m = int(members[0])
                string = raw[m].as_py()[before[m] - left : before[m] + right]
                if _anchored(string, left, length):
                    name = _name(_short(left), string)
                    rows += [(*name, int(t1[i]), int(t2[i]), left, left + right) for i in members.tolist()]
            kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in schema.split(", ")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw, at = r["context"], r["before"]
                for offset in range(max(0, length - (len(raw) - at)), at + 1):
                    window = raw[at - offset : at - offset + length]
                    if _anchored(window, offset, length):
                        rows.append((*_name(_short(offset), window), r["t1"], r["t2"], offset, length))
            kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in schema.split(", ")])

    large = _large(contexts)
    found = _dealt(contexts if large is None else contexts.join(large, ["k1", "k2"], "left_anti")).mapInArrow(group, schema)
    if large is not None:
        found = found.unionByName(small_batches(contexts.join(large, ["k1", "k2"])).mapInArrow(windows, schema))
    places = repeated.where("not plain").join(found, ["c1", "c2"]).select("g1", "g2", "length", "r1", "r2", (F.col("pos") - F.col("before")).alias("start"))
    ids = texts.select("doc_id", "r1", "r2", F.octet_length("text").alias("__sl_n"))
    begin = F.greatest(F.col("pos") - (length - seed_of(length)), F.lit(0))
    plain = repeated.where("plain").join(ids.dropDuplicates(["r1", "r2"]), ["r1", "r2"])
    plain = plain.select(F.col("c1").alias("g1"), F.col("c2").alias("g2"), (F.least(F.col("pos") + length, F.col("__sl_n").cast("long")) - begin).cast("int").alias("length"), "r1", "r2", begin.alias("start"))
    every = stage(places.unionByName(plain).distinct(), "groups")
    # A window of one text only is no repeat.
    many = every.groupBy("g1", "g2").count().where("count > 1").select("g1", "g2")
    every = every.join(many, ["g1", "g2"]) if large is not None else every
    return every.join(ids.drop("__sl_n"), ["r1", "r2"]).select("g1", "g2", "length", "doc_id", "start")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes under strings of 400 bytes that start more than once.

    Nulls, empty and long texts, repeated rows and empty tables as in `without_repeats`.
    """
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
