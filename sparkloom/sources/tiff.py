"""TIFF files as a Spark source and sink that reads only the pages it is asked for.

    spark.dataSource.register(tiff.TiffPages)
    spark.read.format("tiffpages").load(path).where("frame between 10 and 20 and channel = 0")

Directories of pages are a few dozen bytes each; pixels are read page by page.  Small files are dealt to tasks whole, several to one;
of a large one each task gets a range of pages, whose directory places were noted when the scan was planned.  Filters on path, frame and
channel are pushed down: files, pages and ranges that they rule out are never opened, planned or read.  Classic and big files (8-byte
places, beyond 4 GB) in strips or tiles, uncompressed, deflated or packed by run lengths.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "path string, frame int, channel int, h int, w int, data array<double>, description string, resolution double, unit string"
#: Bytes of pixels that a task reads, about.
TASK_BYTES = 64 << 20
#: Fixed values of the format: field types by number, and names of resolution units.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
UNITS = {1: "none", 2: "inch", 3: "cm"}


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


class Tiff:
    """Directories and pages of one open file; only what is asked for is read."""

    def __init__(self, file):
        self.file = file
        head = self._read(0, 16)
        self.end = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        kind = struct.unpack_from(self.end + "H", head, 2)[0] if self.end else 0
        if kind not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = kind == 43
        self.first = struct.unpack_from(self.end + ("Q" if self.big else "I"), head, 8 if self.big else 4)[0]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _layout(self) -> tuple[str, int, int, str]:
        """Format and size of a directory's count, size of an entry, format of a place."""
        return ("Q", 8, 20, "Q") if self.big else ("H", 2, 12, "I")

    def following(self, at: int) -> int:
        """Where the next directory is; 0 behind the last."""
        count, size, entry, place = self._layout()
        n = struct.unpack(self.end + count, self._read(at, size))[0]
        return struct.unpack(self.end + place, self._read(at + size + n * entry, struct.calcsize("=" + place)))[0]

    def directories(self) -> Iterator[int]:
        at, seen = self.first, set()
        while at:
            if at in seen:
                raise ValueError("directories form a ring")
            seen.add(at)
            yield at
            at = self.following(at)

    def tags(self, at: int) -> dict[int, object]:
        count, size, entry, place = self._layout()
        n = struct.unpack(self.end + count, self._read(at, size))[0]
        raw, out = self._read(at + size, n * entry), {}
        inline = struct.calcsize("=" + place)
        for i in range(n):
            code, kind, many = struct.unpack_from(self.end + "HH" + place, raw, i * entry)
            if kind not in KINDS:
                continue
            bytes_ = struct.calcsize("=" + KINDS[kind]) * many
            where = i * entry + 4 + inline
            value = raw[where : where + bytes_] if bytes_ <= inline else self._read(struct.unpack_from(self.end + place, raw, where)[0], bytes_)
            out[code] = value.rstrip(b"\0").decode(errors="replace") if kind == 2 else struct.unpack(self.end + KINDS[kind] * many, value)
        return out

    def _unpacked(self, raw: bytes, method: int, n: int) -> bytes:
        if method == 1:
            return raw
        if method in (8, 32946):
            return zlib.decompress(raw)
        if method == 32773:
            out, i = bytearray(), 0
            while i < len(raw) and len(out) < n:
                k = raw[i]
                if k < 128:
                    out += raw[i + 1 : i + 2 + k]
                    i += k + 2
                elif k > 128:
                    out += raw[i + 1 : i + 2] * (257 - k)
                    i += 2
                else:
                    i += 1
            return bytes(out)
        raise ValueError(f"TIFF compression {method} is not supported")

    def pixels(self, tags: dict[int, object]) -> np.ndarray:
        """h x w x channels."""
        one = lambda code, default: tags.get(code, (default,))[0]
        w, h, channels, method, planes = tags[256][0], tags[257][0], one(277, 1), one(259, 1), one(284, 1)
        kind = np.dtype(f"{self.end}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)] }{one(258, 8) // 8}")
        tiled = 322 in tags
        bw, bh = (tags[322][0], tags[323][0]) if tiled else (w, min(one(278, h), h))
        places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        deep = channels if planes == 1 else 1
        out = np.zeros((h, w, channels), dtype=kind.newbyteorder("="))
        across, down = -(-w // bw), -(-h // bh)
        for i, (at, n) in enumerate(zip(places, sizes)):
            plane, rest = divmod(i, across * down)
            y, x = rest // across * bh, rest % across * bw
            rows = bh if tiled else min(bh, h - y)
            block = np.frombuffer(self._unpacked(self._read(at, n), method, rows * bw * deep * kind.itemsize), dtype=kind, count=rows * bw * deep).reshape(rows, bw, deep)
            if one(317, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            target = out[y : y + rows, x : x + bw, :] if planes == 1 else out[y : y + rows, x : x + bw, plane : plane + 1]
            target[:] = block[: target.shape[0], : target.shape[1]]
        return out


@dataclass
class Wanted:
    """What the pushed filters leave: equal paths, a range and a set of frames, a set of channels."""

    paths: set[str] | None = None
    frames: set[int] | None = None
    first: int = 0
    last: int = 1 << 62
    channels: set[int] | None = None

    def add(self, f: Filter) -> bool:
        """Takes a filter in; False if it can't."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if isinstance(f, (EqualTo, EqualNullSafe, In)) and name in ("path", "frame", "channel"):
            values = {v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
            name += "s"
            have = getattr(self, name)
            setattr(self, name, values if have is None else have & values)
        elif name == "frame" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.first = max(self.first, f.value + isinstance(f, GreaterThan))
        elif name == "frame" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.last = min(self.last, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def frame(self, i: int) -> bool:
        return self.first <= i <= self.last and (self.frames is None or i in self.frames)

    def beyond(self, i: int) -> bool:
        """No wanted frame is i or later."""
        return i > self.last or (self.frames is not None and i > max(self.frames, default=-1))

    def channel(self, i: int) -> bool:
        return self.channels is None or i in self.channels


@dataclass
class Pages(InputPartition):
    """Files of one task: the path, and of a large file the pages as (number, place of the directory)."""

    files: list[tuple[str, list[tuple[int, int]] | None]]


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*.tif*")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.add(f):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _filesystem(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else sorted((f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and fnmatch(f.base_name, self.glob)), key=lambda f: f.path)
        out, held, size = [], [], 0
        for f in found:
            path = prefix + f.path
            if self.wanted.paths is not None and path not in self.wanted.paths:
                continue
            if f.size > self.task_bytes:
                out += self._ranges(fs, f.path, path, f.size)
                continue
            held.append((path, None))
            size += f.size
            if size >= self.task_bytes:
                out.append(Pages(held))
                held, size = [], 0
        return [*out, *([Pages(held)] if held else [])] or [Pages([])]

    def _ranges(self, fs: pafs.FileSystem, name: str, path: str, size: int) -> list[Pages]:
        """Ranges of the wanted pages of a large file; its directories are walked, no pixel is read."""
        with fs.open_input_file(name) as file:
            tiff, pages = Tiff(file), []
            n = 0
            for n, at in enumerate(tiff.directories()):
                if self.wanted.beyond(n):
                    break
                if self.wanted.frame(n):
                    pages.append((n, at))
            each = max(int(self.task_bytes / (size / (n + 1))), 1)
        return [Pages([(path, pages[i : i + each])]) for i in range(0, len(pages), each)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for path, pages in partition.files:
            fs, name = _filesystem(path)
            with fs.open_input_file(name) as file:
                yield from self._rows(Tiff(file), path, pages)

    def _rows(self, tiff: Tiff, path: str, pages: list[tuple[int, int]] | None) -> Iterator[pa.RecordBatch]:
        for n, at in pages if pages is not None else enumerate(tiff.directories()):
            if self.wanted.beyond(n):
                return
            if not self.wanted.frame(n):
                continue
            tags = tiff.tags(at)
            channels = [c for c in range(tags.get(277, (1,))[0]) if self.wanted.channel(c)]
            if not channels:
                continue
            image = tiff.pixels(tags).astype(np.float64)
            ratio = tags.get(282)
            resolution = ratio[0] / ratio[1] if ratio and ratio[1] else None
            h, w = image.shape[:2]
            for c in channels:
                data = pa.ListArray.from_arrays(pa.array([0, h * w], pa.int32()), pa.array(np.ascontiguousarray(image[:, :, c]).ravel()))
                fixed = [pa.array([v], pa.int32()) for v in (n, c, h, w)]
                columns = [pa.array([path]), *fixed, data, pa.array([tags.get(270, "")], pa.string()), pa.array([resolution], pa.float64()), pa.array([UNITS.get(tags.get(296, (2,))[0])], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "frame", "channel", "h", "w", "data", "description", "resolution", "unit"])


def encoded(pages: Sequence[tuple[np.ndarray, str | None, float | None, str | None]]) -> Iterator[bytes]:
    """The bytes of a big-format file of double pages, piece by piece: each directory stands before its pixels, so nothing is written twice."""
    codes = {v: k for k, v in UNITS.items()}
    at = 16
    yield b"II" + struct.pack("<HHHQ", 43, 8, 0, at if len(pages) else 0)
    for i, (data, description, resolution, unit) in enumerate(pages):
        h, w = data.shape
        text = (description or "").encode() + b"\0"
        text += b"\0" * (max(9 - len(text), 0) + len(text) % 2)
        text_at = at + 8 + 12 * 20 + 8
        raw_at = text_at + len(text)
        behind = raw_at + 8 * h * w
        ratio = (round((resolution or 0) * 1_000_000), 1_000_000)
        entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 64), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(text), text_at), (273, 16, 1, raw_at), (277, 3, 1, 1), (279, 16, 1, 8 * h * w), (282, 5, 1, ratio[0] | ratio[1] << 32), (296, 3, 1, codes.get(unit or "none", 1)), (339, 3, 1, 3)]
        yield struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", *e) for e in entries) + struct.pack("<Q", behind if i + 1 < len(pages) else 0)
        yield text
        yield data.astype("<f8").tobytes()
        at = behind


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class TiffWriter(DataSourceWriter):
    """One file for each path of a partition's rows (paths below the folder); rows of a file must lie in one partition, in order of frames.

    Files are written under another name and renamed when the job commits, so retried tasks leave nothing half done.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator) -> Written:
        fs, root = _filesystem(self.path)
        moves, held, name = [], [], None

        def close() -> None:
            if name is None:
                return
            target = f"{root.rstrip('/')}/{name}"
            fs.create_dir(os.path.dirname(target), recursive=True)
            temporary = f"{target}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(temporary) as out:
                for piece in encoded(held):
                    out.write(piece)
            moves.append((temporary, target))

        for row in iterator:
            if row["path"] != name:
                close()
                held, name = [], row["path"]
            data = np.array([np.nan if v is None else v for v in row["data"]], dtype=float).reshape(row["h"], row["w"])
            held.append((data, row["description"], row["resolution"], row["unit"]))
        close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        moves = [m for message in messages if message for m in message.moves]
        if len({t for _, t in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("rows of one file lie in several partitions")
        if self.overwrite and fs.get_file_info(root).type == pafs.FileType.Directory:
            fresh = {a for a, _ in moves}
            for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
                if f.type == pafs.FileType.File and f.path not in fresh:
                    fs.delete_file(f.path)
        for a, b in moves:
            fs.move(a, b)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _filesystem(self.path)
        for a, _ in (m for message in messages if message for m in message.moves):
            if fs.get_file_info(a).type == pafs.FileType.File:
                fs.delete_file(a)


class TiffPages(DataSource):
    """Format "tiffpages": options path, glob (default *.tif*), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "tiffpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_pages(spark: SparkSession, path: str, glob: str = "*.tif*", task_bytes: int = TASK_BYTES) -> DataFrame:
    """A row for each page and channel of all TIFF files below path; filters on path, frame and channel reach the files."""
    spark.dataSource.register(TiffPages)
    # Off by default; it holds for this session's Python sources.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tiffpages").option("glob", glob).option("taskBytes", str(task_bytes)).load(path)


def write_pages(frames: DataFrame, path: str, mode: str = "append") -> None:
    """frames(path, frame, h, w, data[, description, resolution, unit]) -> one file of double pages for each path, below the folder `path`; mode: append or overwrite."""
    frames.sparkSession.dataSource.register(TiffPages)
    extra = {"description": "string", "resolution": "double", "unit": "string"}
    df = frames.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in frames.columns}).withColumn("channel", F.lit(0))
    df = df.select(*[F.col(n).cast(t).alias(n) for n, t in (f.split() for f in SCHEMA.split(", "))])
    df.repartition("path").sortWithinPartitions("path", "frame").write.format("tiffpages").mode(mode).save(path)
