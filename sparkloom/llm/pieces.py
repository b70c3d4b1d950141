"""SentencePiece encoding by streaming Viterbi, and decoding.

The vocabulary file gives pieces without probabilities of a unigram model; its
ranks stand in for them: a piece of rank r costs log(r + 2), in ten-thousandths
as an integer, so that sums are exact.  Bytes have pieces of their own that cost
more than any other.  Of all segmentations of a text (with one space put before
it) the cheapest is taken, of equally cheap ones that with the longer last
piece.

The forward pass keeps costs of the last `longest piece` boundaries only.  All
paths pass through a boundary that no piece can span: before a space that
follows another character, around bytes that stand in no longer piece (a line
feed), and wherever the backpointers of all boundaries in the window meet.
There ids are committed.  Distinct stretches between such boundaries are
encoded once a batch, in step with each other; long stretches as a stream.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .shingles import BASE, BASE_INVERSE, EXACT_VALUE, bounded, mixed, powers, ragged, spans, text_bytes

#: Stretches of more bytes are encoded as streams; backpointers are followed every so many bytes.
IN_STEP, LOOK_BACK = 64, 256
#: Hashes tell stretches apart inside one worker only, so each has a key of its own that no text can be made for.
KEY = secrets.randbits(63)
TABLE_BITS = 18
FAR = np.int64(1) << 60


_VOCABULARIES: dict[str, "Vocabulary"] = {}


def vocabulary(path: str) -> "Vocabulary":
    """The process's vocabulary of a file, loaded once a worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.load(path)
    return _VOCABULARIES[path]


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary:
    def __init__(self, pieces: list[tuple[int, bytes]], byte_ids: list[int], n: int):
        """pieces: (id, bytes with spaces as spaces) in order of rank; byte_ids: the 256 bytes' ids; n: all ids."""
        self.bytes_of = [b""] * n
        self.cost = np.full(n + 1, FAR, dtype=np.int64)
        self.by_bytes: dict[bytes, int] = {}
        most = round(1e4 * np.log(n + 2.0)) + 100_000
        for b, i in enumerate(byte_ids):
            self.by_bytes[bytes([b])] = i
            self.bytes_of[i] = bytes([b])
            self.cost[i] = most
        for rank, (i, raw) in enumerate(pieces):
            self.by_bytes[raw] = i
            self.bytes_of[i] = raw
            self.cost[i] = round(1e4 * np.log(rank + 2.0))
        self.n = n
        self.longest = max(map(len, self.by_bytes))
        together = {b for raw in self.by_bytes if len(raw) > 1 for b in raw}
        self.alone = np.array([b not in together for b in range(256)])
        self.spaces_lead = not any(b" " in raw.lstrip(b" ") for raw in self.by_bytes)
        self.lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths
        self._index()

    def _index(self) -> None:
        raws = list(self.by_bytes)
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        begins = ends - [len(r) for r in raws]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(EXACT_VALUE[data] * powers(BASE, len(data)), dtype=np.uint64)])
        # As viterbi_in_step names what it meets; pieces are far shorter than the patterns that such hashes confuse.
        codes = mixed((sums[ends] - sums[begins]) * powers(BASE_INVERSE, len(data) + 1)[begins] + (ends - begins).astype(np.uint64))
        ids = np.array([self.by_bytes[r] for r in raws], dtype=np.int64)
        slot = (codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, codes, ids = slot[order], codes[order], ids[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        number = np.arange(len(slot))
        layer = number - np.maximum.accumulate(np.where(first, number, 0))
        self.layers = []
        for k in range(int(layer.max()) + 1):
            table, found = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, self.n, np.int64)
            table[slot[layer == k]], found[slot[layer == k]] = codes[layer == k], ids[layer == k]
            self.layers.append((table, found, found < self.n))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Ids of pieces by their hash; n where there is none."""
        slot = (codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        table, found, _ = self.layers[0]
        out = np.where(table[slot] == codes, found[slot], self.n)
        for table, found, used in self.layers[1:]:
            at = np.flatnonzero(used[slot])
            hit = at[table[slot[at]] == codes[at]]
            out[hit] = found[slot[hit]]
        return out

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, byte_ids = [], [-1] * 256
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((i, name.replace("▁", " ").encode()))
        if min(byte_ids) < 0:
            raise ValueError("the vocabulary must have a piece for each byte")
        return cls(pieces, byte_ids, n)


class Stream:
    """Ids of one stretch of any length that arrives in parts; memory for one window and what is not committed yet."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.raw = bytearray()
        self.cost, self.back = [0], [0]
        self.done = 0

    def feed(self, part: bytes) -> list[int]:
        out: list[int] = []
        v, longest = self.v, self.v.longest
        for byte in part:
            self.raw.append(byte)
            end = len(self.raw)
            best, start = FAR, end
            for length in range(min(longest, end), 0, -1):
                i = v.by_bytes.get(bytes(self.raw[end - length : end]))
                if i is not None and (c := self.cost[end - length] + int(v.cost[i])) < best:
                    best, start = c, end - length
            self.cost.append(best)
            self.back.append(start)
            if end >= LOOK_BACK + longest and end % LOOK_BACK == 0:
                out += self._commit()
        return out

    def _path(self, end: int) -> list[int]:
        path = [end]
        while path[-1]:
            path.append(self.back[path[-1]])
        return path[::-1]

    def _ids(self, path: list[int]) -> list[int]:
        return [self.v.by_bytes[bytes(self.raw[a:b])] for a, b in zip(path, path[1:])]

    def _commit(self) -> list[int]:
        """The ids before the last boundary that the paths of all boundaries in the window share."""
        end = len(self.raw)
        live = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.back[top])
        meet = live.pop()
        ids = self._ids(self._path(meet))
        self.raw = self.raw[meet:]
        low = self.cost[meet]
        self.cost = [c - low for c in self.cost[meet:]]
        self.back = [0] + [b - meet for b in self.back[meet + 1 :]]
        return ids

    def finish(self) -> list[int]:
        return self._ids(self._path(len(self.raw)))


def viterbi_in_step(v: Vocabulary, rows: np.ndarray, length: int) -> np.ndarray:
    """rows: stretches of `length` bytes each (uint8, rows x length) -> ids, rows x length, -1 behind each row's last id."""
    n = len(rows)
    sums = np.zeros((length + 1, n), dtype=np.uint64)
    np.cumsum(EXACT_VALUE[rows.T] * powers(BASE, length)[:, None], axis=0, out=sums[1:])
    inverse = powers(BASE_INVERSE, length + 1)
    cost = np.zeros((length + 1, n), dtype=np.int64)
    piece, size = np.zeros((length + 1, n), dtype=np.int64), np.zeros((length + 1, n), dtype=np.int64)
    for end in range(1, length + 1):
        best = np.full(n, FAR)
        for k in range(min(v.longest, end), 0, -1):
            found = v.find(mixed((sums[end] - sums[end - k]) * inverse[end - k] + np.uint64(k)))
            c = cost[end - k] + v.cost[found]
            less = c < best
            best[less], piece[end][less], size[end][less] = c[less], found[less], k
        cost[end] = best
    out = np.full((n, length), -1, dtype=np.int64)
    place, number, at = np.full(n, length), np.arange(n), np.zeros(n, dtype=np.int64)
    while len(number):
        out[number, length - 1 - at[number]] = piece[place[number], number]
        place[number] -= size[place[number], number]
        at[number] += 1
        number = number[place[number] > 0]
    shift = np.argsort(out < 0, axis=1, kind="stable")
    return np.take_along_axis(out, shift, axis=1)


def encode(v: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids (uint32), and where each text's begin (one more entry for the end). Null and empty texts have none."""
    data, starts = text_bytes(column)
    data = np.concatenate([[np.uint8(32)], data[:-1]]) if len(data) else data
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[starts] = True
    gap = data == 32
    if v.spaces_lead and len(data):
        begins[1:-1] |= gap[1:] & ~gap[:-1]
    single = v.alone[data]
    begins[:-1] |= single
    begins[1:] |= single
    at = np.flatnonzero(begins)
    at, ends = at[:-1], at[1:]
    empty = np.zeros(len(data) + 1, dtype=bool)
    empty[starts[:-1][np.diff(starts) == 1]] = True
    at, ends = at[~empty[at]], ends[~empty[at]]
    codes, _ = pd.factorize(spans(data, at, ends, exact=True, key=KEY)) if len(at) else (np.empty(0, np.int64), None)
    first = np.zeros(codes.max() + 1 if len(codes) else 0, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    begin, size = at[first], (ends - at)[first]
    found, kept = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    which = [np.empty(0, np.int64)]
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        if length <= IN_STEP:
            ids = viterbi_in_step(v, data[begin[rows][:, None] + np.arange(length)], length)
            found.append(ids[ids >= 0])
            kept.append((ids >= 0).sum(axis=1))
        else:
            for r in rows.tolist():
                stream = Stream(v)
                ids = stream.feed(data[begin[r] : begin[r] + length].tobytes()) + stream.finish()
                found.append(np.array(ids, dtype=np.int64))
                kept.append(np.array([len(ids)]))
        which.append(rows)
    flat, counts, rows = np.concatenate(found), np.concatenate(kept), np.concatenate(which)
    where, many = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    where[rows], many[rows] = np.cumsum(counts) - counts, counts
    sizes = many[codes]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return flat[ragged(where[codes], sizes)].astype(np.uint32), bounds[np.searchsorted(at, starts)]


def decode(v: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each begins; the space that encoding put before a text is taken off."""
    sizes = v.lengths[ids]
    data = v.flat[ragged(v.at[ids], sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes)])[starts]
    keep = np.ones(len(data), dtype=bool)
    keep[bounds[:-1][np.diff(bounds) > 0]] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def encoded(docs: DataFrame, columns: list[str], with_ids: bool, path: str | None = None) -> DataFrame:
    """The given columns of docs(..., text) and n_ids, ids_crc32 (ids as little-endian unsigned 32-bit numbers), n_bytes (ids that
    stand for single bytes), round_trip (decoding gives the text back); with_ids: also ids, array<int>."""
    path = path or default_model()
    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__sl_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    schema += ", n_ids bigint, ids_crc32 bigint, n_bytes bigint, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        single = np.zeros(v.n, dtype=bool)
        for raw, i in v.by_bytes.items():
            single[i] = len(raw) == 1 and v.cost[i] == v.cost[v.cost < FAR].max()
        for batch in batches:
            for part in bounded(batch, batch.num_columns - 1):
                column = part.column(part.num_columns - 1)
                ids, starts = encode(v, column)
                back, ends = decode(v, ids, starts)
                data, texts = text_bytes(column)
                raw, bounds = ids.astype("<u4").tobytes(), starts.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
                whole, given, a, t = back.tobytes(), data.tobytes(), ends.tolist(), texts.tolist()
                same = [whole[a[i] : a[i + 1]] == given[t[i] : t[i + 1] - 1] for i in range(len(crc))]
                ones = np.concatenate([[0], np.cumsum(single[ids], dtype=np.int64)])
                out = [*part.columns[:-1], pa.array(np.diff(starts)), pa.array(crc, pa.int64()), pa.array(ones[starts[1:]] - ones[starts[:-1]]), pa.array(same, pa.bool_())]
                names = [*part.schema.names[:-1], "n_ids", "ids_crc32", "n_bytes", "round_trip"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return small_batches(kept).mapInArrow(run, schema)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, their digest, and whether decoding gives the text back.

    Null and empty texts have no ids and a true round trip; of equally cheap segmentations the one with the longest last piece is taken, so
    equal texts have equal ids; rows may repeat, a null doc_id is kept; long texts are streamed; an empty table has no rows.
    """
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], with_ids=True)
