"""The TIFF source reads what it is asked for, and no more."""

import io
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains
from pyspark.sql import functions as F

from sparkloom.functions import images
from sparkloom.sources import tiff


def _movie(folder, name, n=6, shape=(8, 5), channels=1, seed=0):
    rng = np.random.default_rng(seed)
    pages = [rng.integers(0, 1000, (*shape, channels) if channels > 1 else shape).astype(np.uint16) for _ in range(n)]
    with open(f"{folder}/{name}", "wb") as f:
        f.write(images.write_tiff(pages, "about", 5.0))
    return pages


class Counted(io.FileIO):
    """A file that counts the bytes read."""

    total = 0

    def read(self, n=-1):
        out = super().read(n)
        Counted.total += len(out)
        return out


def _bytes_of(path, *filters, **options):
    reader = tiff.TiffReader({"path": path, **options})
    left = list(reader.pushFilters(list(filters)))
    rows = []
    Counted.total = 0
    for part in reader.partitions():
        for name, pages in part.files:
            with Counted(name.removeprefix("file://")) as f:
                rows += [r for b in reader._rows(tiff.Tiff(f), name, pages) for r in b.to_pylist()]
    return rows, Counted.total, left


def test_bytes_fall_with_the_filter(tmp_path):
    _movie(tmp_path, "a.tif", n=50, shape=(64, 64))
    size = os.path.getsize(f"{tmp_path}/a.tif")
    every, all_bytes, _ = _bytes_of(str(tmp_path))
    few, some, left = _bytes_of(str(tmp_path), GreaterThan(("frame",), 10), LessThanOrEqual(("frame",), 13))
    one, least, _ = _bytes_of(str(tmp_path), In(("frame",), (40,)))
    none, nothing, _ = _bytes_of(str(tmp_path), EqualTo(("path",), "elsewhere"))
    assert len(every) == 50 and all_bytes > 0.9 * size
    assert [r["frame"] for r in few] == [11, 12, 13] and some < 0.1 * size and left == []
    assert [r["frame"] for r in one] == [40] and least < 0.1 * size
    assert none == [] and nothing == 0


def test_unknown_filters_are_left_to_spark(tmp_path):
    reader = tiff.TiffReader({"path": str(tmp_path)})
    f = [StringContains(("path",), "x"), EqualTo(("h",), 3), EqualTo(("channel",), 1)]
    assert list(reader.pushFilters(f)) == f[:2] and reader.wanted.channels == {1}


def test_pages_of_a_large_file_are_dealt_to_tasks(spark, tmp_path):
    pages = _movie(tmp_path, "a.tif", n=20, shape=(32, 32))
    df = tiff.read_pages(spark, str(tmp_path), task_bytes=5 * 2048)
    assert df.rdd.getNumPartitions() >= 4
    found = {r.frame: np.array(r.data).reshape(r.h, r.w) for r in df.collect()}
    assert sorted(found) == list(range(20)) and all((found[i] == p).all() for i, p in enumerate(pages))
    some = df.where("frame >= 15 and frame < 17 and channel = 0")
    assert some.rdd.getNumPartitions() == 1 and sorted(r.frame for r in some.collect()) == [15, 16]


def test_channels_and_several_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/deep/er")
    rgb = _movie(f"{tmp_path}/deep/er", "c.tiff", n=2, channels=3)
    grey = _movie(tmp_path, "g.tif", n=3)
    (tmp_path / "no.txt").write_text("not an image")
    df = tiff.read_pages(spark, f"file://{tmp_path}")
    found = {(r.path.rsplit("/", 1)[1], r.frame, r.channel): r for r in df.collect()}
    assert len(found) == 9 and all((np.array(found["c.tiff", f, c].data) == rgb[f][:, :, c].ravel()).all() for f in range(2) for c in range(3))
    r = found["g.tif", 0, 0]
    assert (np.array(r.data) == grey[0].ravel()).all() and (r.description, r.resolution, r.unit) == ("about", 5.0, "cm") and r.path.startswith("file:///")
    assert {(r.channel, r.frame) for r in df.where("channel = 1").collect()} == {(1, 0), (1, 1)}
    assert tiff.read_pages(spark, str(tmp_path), glob="*.none").count() == 0


def _tiled(method):
    """A 20 x 35 page of 16 x 16 tiles, two planes, big-endian; written by hand."""
    planes = np.random.default_rng(1).integers(0, 60000, (2, 20, 35)).astype(">u2")
    blocks = []
    for p in planes:
        wide = np.zeros((32, 48), dtype=">u2")
        wide[:20, :35] = p
        for y in (0, 16):
            for x in (0, 16, 32):
                raw = wide[y : y + 16, x : x + 16].tobytes()
                if method == 8:
                    raw = zlib.compress(raw)
                if method == 32773:
                    raw = b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128)) + bytes([128])
                blocks.append(raw)
    places, at = [], 8
    for b in blocks:
        places.append(at)
        at += len(b)
    table = struct.pack(f">{len(blocks)}I", *places) + struct.pack(f">{len(blocks)}I", *map(len, blocks))
    tags = [(256, 3, 1, 35 << 16), (257, 3, 1, 20 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, method << 16), (277, 3, 1, 2 << 16), (284, 3, 1, 2 << 16), (322, 3, 1, 16 << 16), (323, 3, 1, 16 << 16), (324, 4, len(blocks), at), (325, 4, len(blocks), at + 4 * len(blocks))]
    where = at + len(table)
    return b"MM" + struct.pack(">HI", 42, where) + b"".join(blocks) + table + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", 0), planes


@pytest.mark.parametrize("method", [1, 8, 32773])
def test_tiles_planes_and_compression(method):
    raw, planes = _tiled(method)
    t = tiff.Tiff(io.BytesIO(raw))
    assert (t.pixels(t.tags(next(t.directories()))) == np.moveaxis(planes, 0, 2)).all()


def test_bad_files_raise():
    for raw in (b"no image here....", b"II" + b"\0" * 14):
        with pytest.raises(ValueError):
            tiff.Tiff(io.BytesIO(raw))
    with pytest.raises(ValueError, match="compression"):
        tiff.Tiff(io.BytesIO(_tiled(1)[0]))._unpacked(b"", 7, 1)


def test_a_file_above_two_gigabytes(tmp_path):
    """A sparse file whose second page lies behind 5 GB: only directories and the wanted page are read."""
    path = f"{tmp_path}/big.tif"
    far = 5 << 30
    first, second = (list(tiff.encoded([(np.full((4, 6), v), None, None, None)])) for v in (1.0, 2.0))
    with open(path, "wb") as f:
        head = bytearray(b"".join(first))
        struct.pack_into("<Q", head, 16 + 8 + 12 * 20, far)
        f.write(head)
        f.seek(far)
        body = bytearray(b"".join(second)[16:])
        for code in (5, 6):
            entry = 8 + 20 * code + 12
            struct.pack_into("<Q", body, entry, struct.unpack_from("<Q", body, entry)[0] + far - 16)
        f.write(body)
    rows, read, _ = _bytes_of(path, EqualTo(("frame",), 1))
    assert [(r["frame"], set(r["data"])) for r in rows] == [(1, {2.0})] and read < 4096
    assert len(tiff.TiffReader({"path": path}).partitions()) == 2


def test_writing_and_reading_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"m{i % 3}/movie{i}.tif", f, 3, 4, rng.normal(size=12).tolist(), f"page {f}", 12.5, "cm") for i in range(5) for f in range(4)]
    df = spark.createDataFrame(rows, "path string, frame int, h int, w int, data array<double>, description string, resolution double, unit string").repartition(6)
    tiff.write_pages(df, f"file://{tmp_path}/out")
    found = {(r.path.split("/out/")[1], r.frame): r for r in tiff.read_pages(spark, f"file://{tmp_path}/out").collect()}
    assert len(found) == 20 and not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".part")]
    for r in rows:
        got = found[r[0], r[1]]
        assert (list(got.data), got.h, got.w, got.description, got.resolution, got.unit) == (r[4], 3, 4, r[5], 12.5, "cm")
    tiff.write_pages(df.where("path = 'm0/movie0.tif'").drop("description", "resolution", "unit"), f"file://{tmp_path}/out", "overwrite")
    again = tiff.read_pages(spark, f"file://{tmp_path}/out").collect()
    assert len(again) == 4 and again[0].resolution == 0 and again[0].description == ""
