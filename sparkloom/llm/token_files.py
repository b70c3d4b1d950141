"""Token ids of a corpus in grammar-compressed shard files.

Documents are dealt by ranges of doc_id, so that file order is id order.  Each
task encodes its texts and cuts them into shards of about SHARD_TOKENS ids.  A
shard's ids are compressed by Re-Pair: rounds replace the most frequent pairs of
neighbours (never across documents) by new symbols, until no pair occurs often
enough to pay for its rule.  A shard stores the rules,
how many ids each symbol expands to, the remaining sequence and its documents'
bounds, so that any range of a document is decoded without the rest.

Shards are rows of a Parquet table (part, place, ids before it in the part,
bytes); Spark's committer makes each file appear whole or not at all.
"""

from __future__ import annotations

import itertools
import json
import math
import secrets
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches, small_table, stage
from .shingles import bounded, ragged, spans, text_bytes, word_spans

SHARD_TOKENS = 1 << 20
#: A rule takes 12 bytes and each of its uses saves 4: with four uses it pays.
LEAST_PAIRS = 4
#: A round replaces pairs that occur at least this fraction of the most frequent pair's times.
ROUND_SHARE = 1 / 16
HASH_BITS = 20
#: Units whose ids a worker keeps (about 50 bytes each).
KNOWN_UNITS = 1_000_000
MAGIC = b"RPSH"
#: Hashes tell units apart inside one worker only, so each has a key of its own that no text can be made for.
KEY = secrets.randbits(63)
#: Bytes as ASCII small letters, and their kinds: 0 white space, 1 letters and all beyond ASCII, 2 digits, 3 others.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Tells units of equal bytes and different kinds apart.
_KIND_CODE = np.array([0, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)

#: The normalizer and pre-tokenizer with which texts fall into units; files with others are encoded text by text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The process's encoder of a tokenizer file: tasks of one worker share what it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Known:
    """Ids of units by their hash, in arrays: hashes sorted but for the latest, and the ids one after another."""

    def __init__(self, most: int):
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.codes, self.entries = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.late, self.late_entries = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.start, self.length, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.odd = np.empty(0, bool)
        self.n, self.used = 0, 0

    @staticmethod
    def _look(codes: np.ndarray, entries: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.full(len(wanted), -1, dtype=np.int64)
        # In order, so that neighbours in the table are looked up together.
        order = np.argsort(wanted)
        wanted = wanted[order]
        at = np.searchsorted(codes, wanted)
        at[at == len(codes)] = 0
        out = np.empty(len(wanted), dtype=np.int64)
        out[order] = np.where(codes[at] == wanted, entries[at], -1)
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Entry of each hash; -1 where there is none."""
        out = self._look(self.codes, self.entries, wanted)
        rest = np.flatnonzero(out < 0)
        out[rest] = self._look(self.late, self.late_entries, wanted[rest])
        return out

    def add(self, codes: np.ndarray, ids: list[list[int]], odd: list[bool]) -> np.ndarray:
        """Entries of new units; odd: whether the unit can't be encoded alone."""
        if not ids:
            return np.empty(0, np.int64)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum()))
        for name, n in (("start", self.n + len(ids)), ("length", self.n + len(ids)), ("odd", self.n + len(ids)), ("flat", self.used + len(flat))):
            have = getattr(self, name)
            if len(have) < n:
                setattr(self, name, np.concatenate([have, np.zeros(max(n, 1024) + len(have) // 2 - len(have), have.dtype)]))
        made = np.arange(self.n, self.n + len(ids))
        self.start[made], self.length[made], self.odd[made] = self.used + np.cumsum(lengths) - lengths, lengths, odd
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        self.late, self.late_entries = np.concatenate([self.late, codes]), np.concatenate([self.late_entries, made])
        if len(self.late) > 1 << 16:
            self.late, self.late_entries = np.concatenate([self.codes, self.late]), np.concatenate([self.entries, self.late_entries])
            order = np.argsort(self.late, kind="stable")
            self.codes, self.entries = self.late[order], self.late_entries[order]
            self.late, self.late_entries = self.late[:0], self.late_entries[:0]
        else:
            order = np.argsort(self.late, kind="stable")
            self.late, self.late_entries = self.late[order], self.late_entries[order]
        return made

    def trim(self) -> None:
        """Forgets all once there are too many; frequent units come back with the next texts."""
        if self.n > self.most:
            self._empty()


class Encoder:
    """Ids of whole texts, equal to the library's, with each distinct unit encoded once.

    With the normalizer and pre-tokenizer above, texts fall into units that can
    be encoded alone: runs of letters, of digits, of other characters.  Around
    an apostrophe before a letter, and where a character beyond ASCII is no
    letter or is none in lower case, everything between white space is one
    unit.  Units are told apart by 64-bit hashes of their bytes and kind.  Other
    tokenizer files are used text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in made["added_tokens"]]
        usual = made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == _PRE_TOKENIZER and made["model"]["type"] == "BPE"
        self.by_units = usual and not any(c.isspace() or c.isupper() for t in self.special for c in t)
        self.model = self.tokenizer.model
        self.known = Known(KNOWN_UNITS)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}

    def _is_odd(self, text: str) -> bool:
        """Whether a run of letters and characters beyond ASCII has another than letters, as the library sees them after its normalizer."""
        if not text.isalpha() or not text.lower().isalpha():
            return True
        # The library may know fewer letters than Python: between two letters they make one piece.
        return max(text) > "ÿ" and len(self.tokenizer.pre_tokenizer.pre_tokenize_str("a" + self.tokenizer.normalizer.normalize_str(text) + "a")) != 1

    def _unit(self, text: str, letters: bool) -> list[int]:
        """A unit's ids.  Lower-case letters up to Latin-1 go to the model at once, as the bytes' letters."""
        if letters and text.isascii():
            return [t.id for t in self.model.tokenize(text)]
        if letters and max(text) <= "ÿ":
            mapped = "".join([self.alphabet[b] for b in text.lower().encode()])
            return [t.id for t in self.model.tokenize(mapped)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _units(self, data: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and kinds of units; whole: numbers of stretches between white space that are one unit each."""
        kind = _KIND[data]
        if len(whole):
            begins, ends = word_spans(data)
            kind[ragged(begins[whole], (ends - begins)[whole])] = 4
        change = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(data) else np.empty(0, np.int64)
        ends = np.concatenate([change[1:], [len(data)]]) if len(data) else change
        used = kind[change] > 0
        return change[used], ends[used], kind[change[used]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids (uint32), and where each text's begin (one more entry for the end)."""
        data, starts = text_bytes(column)
        data = _LOWER[data]
        plain = data.tobytes()
        if not self.by_units or any(t.encode() in plain for t in self.special):
            return self._texts(column)
        stretches = word_spans(data)[0]
        quotes = np.flatnonzero(data == 39)
        quotes = quotes[_KIND[data[quotes + 1]] == 1] if len(quotes) else quotes
        whole = np.unique(np.searchsorted(stretches, quotes, side="right") - 1)
        while True:
            begins, ends, kind = self._units(data, whole)
            codes, values = pd.factorize(spans(data, begins, ends, key=KEY) ^ _KIND_CODE[kind])
            first = np.zeros(len(values), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            entry = self.known.find(values)
            fresh = np.flatnonzero(entry < 0)
            at = first[fresh]
            made, odd = [], []
            for b, e, letters in zip(begins[at].tolist(), ends[at].tolist(), (kind[at] == 1).tolist()):
                text = plain[b:e].decode()
                odd.append(letters and not text.isascii() and self._is_odd(text))
                made.append([] if odd[-1] else self._unit(text, letters))
            entry[fresh] = self.known.add(values[fresh], made, odd)
            alone = ~self.known.odd[entry] if len(entry) else np.empty(0, bool)
            if alone.all():
                break
            found = begins[~alone[codes]]
            whole = np.union1d(whole, np.searchsorted(stretches, found, side="right") - 1)
        at, lengths = self.known.start[entry], self.known.length[entry]
        sizes = lengths[codes]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = self.known.flat[ragged(at[codes], sizes)]
        self.known.trim()
        return out, bounds[np.searchsorted(begins, starts)]

    def _texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text by text, as the library does it: for batches with special tokens' strings in any case."""
        ids = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
        return np.array(list(itertools.chain.from_iterable(ids)), dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


def repair(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """ids and documents' starts (with the end) -> sequence, its documents' starts, rules (n x 2), first new symbol.

    A round counts all pairs of neighbours inside documents by sorting (of a run
    of one symbol every other pair) and takes those of about the greatest counts.
    Where two of their occurrences overlap the more frequent pair is replaced,
    so the most frequent of all is replaced everywhere.  Pairs with too few
    replacements wait for later rounds, which go on until no pair occurs
    LEAST_PAIRS times.  Rules of a round use symbols of earlier rounds only.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    n, rules, symbol = len(ids), [], base
    # Symbols stay where they are; neighbours are linked, -1 at a document's bounds.
    seq, left, right = ids.astype(np.uint64), np.arange(-1, n - 1), np.arange(1, n + 1)
    filled = starts[:-1][starts[1:] > starts[:-1]]
    left[filled], right[starts[1:][starts[1:] > starts[:-1]] - 1] = -1, -1
    there, live = np.ones(n, dtype=bool), right >= 0
    while True:
        # A pair of old symbols never gets more frequent: places of rare pairs are left out until a neighbour changes.
        at = np.flatnonzero(live)
        if not len(at):
            break
        after = right[at]
        first, second = seq[at], seq[after]
        pairs = (first << np.uint64(32)) | second
        twice = same = np.flatnonzero(first == second)
        if len(same):
            # Of a run of one symbol every other pair counts.
            run = np.concatenate([[True], after[same[:-1]] != at[same[1:]]])
            number = np.arange(len(same))
            twice = same[(number - np.maximum.accumulate(np.where(run, number, 0))) % 2 == 1]
        # Counts of hashed pairs are never too low: pairs of rare hashes are sorted out before the exact count.
        # Each round has a hash of its own, so that a rare pair beside a frequent one is left out in the next.
        bits = min(HASH_BITS, len(at).bit_length())
        hashed = ((pairs * np.uint64(int(_SPREAD) * (2 * len(rules) + 1) % (1 << 64))) >> np.uint64(64 - bits)).view(np.int64)
        rough = np.bincount(hashed, minlength=1 << bits) - (np.bincount(hashed[twice], minlength=1 << bits) if len(twice) else 0)
        rough_of = rough[hashed]
        live[at[rough_of < LEAST_PAIRS]] = False
        greatest = rough.max()
        rough_of[twice] = 0
        for least in (max(LEAST_PAIRS, math.ceil(greatest * ROUND_SHARE)), LEAST_PAIRS):
            near = np.flatnonzero(rough_of >= least)
            here = pairs[near]
            ordered = np.sort(here)
            cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
            times = np.diff(np.concatenate([cut, [len(ordered)]]))
            often = np.flatnonzero(times >= least)
            if len(often):
                break
        if not len(often):
            break
        chosen, times = ordered[cut[often]], times[often]
        rank = np.empty(len(chosen), dtype=np.int64)
        # Of equally frequent pairs a hash decides: in their own order only the last of a repeated passage would win a round.
        rank[np.lexsort((chosen * _SPREAD, times))] = np.arange(len(chosen))
        which = np.searchsorted(chosen, here)
        which[which == len(chosen)] = 0
        hit = chosen[which] == here
        place, which = at[near[hit]], which[hit]
        apart = right[place[:-1]] != place[1:]
        won = np.ones(len(place), dtype=bool)
        won[:-1] &= apart | (rank[which[:-1]] > rank[which[1:]])
        won[1:] &= apart | (rank[which[1:]] > rank[which[:-1]])
        kept = np.bincount(which[won], minlength=len(chosen)) >= LEAST_PAIRS
        won &= kept[which]
        place, which = place[won], (np.cumsum(kept) - 1)[which[won]]
        seq[place] = symbol + which.astype(np.uint64)
        gone = right[place]
        there[gone] = live[gone] = False
        right[place] = right[gone]
        follows = right[place] >= 0
        left[right[place[follows]]] = place[follows]
        live[place] = follows
        before = left[place]
        live[before[before >= 0]] = True
        chosen = chosen[kept]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        symbol += len(chosen)
    bounds = np.concatenate([[0], np.cumsum(there)])
    return seq[there].astype(np.uint32), bounds[starts], np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each new symbol stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, dtype=np.int64)


def write_shard(doc_ids: np.ndarray, has_id: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file format: magic; counts of documents, ids, sequence, rules, first new symbol, bytes a symbol; then little-endian
    doc_ids (int64), whether each has one (bytes), sequence starts and id starts (uint64), rules (uint32), expansion lengths (uint32), sequence."""
    seq, at, rules, base = repair(ids, starts)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = struct.pack("<4s6Q", MAGIC, len(doc_ids), len(ids), len(seq), len(rules), base, width)
    parts = [doc_ids.astype("<i8"), has_id.astype("u1"), at.astype("<u8"), starts.astype("<u8"), rules.astype("<u4"), expansion_lengths(rules, base).astype("<u4"), seq.astype(f"<u{width}")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard read back; documents and ranges of them are decoded on demand."""

    def __init__(self, raw: bytes):
        magic, docs, self.n_ids, n_seq, n_rules, self.base, width = struct.unpack_from("<4s6Q", raw)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.at = struct.calcsize("<4s6Q")

        def take(kind: str, n: int) -> np.ndarray:
            out = np.frombuffer(raw, dtype=kind, count=n, offset=self.at)
            self.at += out.nbytes
            return out

        self.doc_ids, self.has_id = take("<i8", docs), take("u1", docs).astype(bool)
        self.seq_starts, self.starts = take("<u8", docs + 1).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64), take("<u4", n_rules).astype(np.int64)
        self.seq = take(f"<u{width}", n_seq)
        self._expanded: tuple[np.ndarray, np.ndarray] | None = None

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Each new symbol's ids, one after another, and where they begin."""
        if self._expanded is None:
            at = np.concatenate([[0], np.cumsum(self.lengths)])
            flat = np.zeros(int(at[-1]), dtype=np.uint32)
            # All rules a level deeper at once: the symbols still to expand, and where their ids begin.
            symbols, places = np.arange(self.base, self.base + len(self.rules)), at[:-1]
            while len(symbols):
                pairs = self.rules[symbols - self.base]
                places = np.concatenate([places, places + self._sizes(pairs[:, 0])])
                symbols = pairs.T.ravel()
                new = symbols >= self.base
                flat[places[~new]] = symbols[~new]
                symbols, places = symbols[new], places[new]
            self._expanded = flat, at
        return self._expanded

    def _sizes(self, seq: np.ndarray) -> np.ndarray:
        sizes = np.ones(len(seq), dtype=np.int64)
        new = seq >= self.base
        sizes[new] = self.lengths[seq[new] - self.base]
        return sizes

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.int64)
        flat, at = self._tables()
        table = np.concatenate([flat, np.zeros(1, np.uint32)])
        sizes = self._sizes(seq)
        where = np.repeat(seq, sizes)
        out = where.astype(np.uint32)
        new = seq >= self.base
        out[np.repeat(new, sizes)] = table[ragged(at[seq[new] - self.base], sizes[new])]
        return out

    def all_ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def tokens(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the document at that place; only the symbols that cover them are expanded."""
        seq = self.seq[self.seq_starts[document] : self.seq_starts[document + 1]].astype(np.int64)
        ends = np.cumsum(self._sizes(seq))
        total = int(ends[-1]) if len(ends) else 0
        start, stop, _ = slice(start, stop).indices(total)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop - 1, side="right")
        before = int(ends[first - 1]) if first else 0
        return self._expand(seq[first : last + 1])[start - before : stop - before]


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """docs(doc_id, text) -> the staged shard table (part, place, before, n_docs, n_tokens, shard), in ascending doc_id order by (part, place)."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place, before = 0, 0
        ids, sizes, names, has = [], [], [], []

        def shard() -> pa.RecordBatch:
            nonlocal place, before
            flat, counts = np.concatenate(ids), np.concatenate(sizes)
            raw = write_shard(np.concatenate(names), np.concatenate(has), flat, np.concatenate([[0], np.cumsum(counts)]))
            row = [[part], [place], [before], [len(counts)], [len(flat)], [raw]]
            place, before = place + 1, before + len(flat)
            for x in (ids, sizes, names, has):
                x.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "place", "before", "n_docs", "n_tokens", "shard"])

        held = 0
        for batch in batches:
            for piece in bounded(batch, 1):
                flat, starts = encoder(path).encode(piece.column(1))
                n = np.diff(starts)
                ended = np.full(len(flat) + len(n), end_id, dtype=np.uint32)
                ended[ragged(starts[:-1] + np.arange(len(n)), n)] = flat
                ids.append(ended)
                sizes.append(n + 1)
                names.append(piece.column(0).fill_null(0).to_numpy())
                has.append(piece.column(0).is_valid().to_numpy(zero_copy_only=False))
                held += len(ended)
                if held >= SHARD_TOKENS:
                    yield shard()
                    held = 0
        if held:
            yield shard()

    n = 2 * shuffle_partitions(docs.sparkSession)
    # Rows of one doc_id may be many: their places in the input part them among tasks.
    ranged = docs.select("doc_id", "text").withColumn("__sl_row", F.monotonically_increasing_id()).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "__sl_row")
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__sl_row").select("doc_id", "text")
    shards = small_batches(ordered).mapInArrow(run, "part int, place int, before bigint, n_docs bigint, n_tokens bigint, shard binary")
    return stage(shards, "token-shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """The shard table -> doc_id, start, n_tokens, ids_crc32 of each document, from the decoded files.

    Ids before a part are sums over parts, of which the driver gets one number each.
    """
    totals = sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, so_far = [], 0
    for part, n in totals:
        starts.append({"part": part, "part_start": so_far})
        so_far += n
    table = small_table(shards.sparkSession, starts, "part int, part_start bigint")
    placed = shards.join(F.broadcast(table), "part").select((F.col("part_start") + F.col("before")).alias("start"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(raw.as_py())
                ids = shard.all_ids().astype("<u4").tobytes()
                bounds = shard.starts.tolist()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
                doc_ids = pa.array(shard.doc_ids, mask=~shard.has_id)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(start + shard.starts[:-1]), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return small_batches(placed).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, each with end id 2, written to grammar-compressed files and read back.

    Null texts count as empty (the end id alone); rows of a null doc_id come first; rows of equal ids are neighbours in any order; an empty table has no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs))
