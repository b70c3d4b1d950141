"""Sources and sinks: image files, metadata, JSON, series as text, result tables."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images
from ..functions.units import pixel_size
from .staging import stage

IMAGE = "path string, frame int, h int, w int, data array<double>, description string, resolution double, unit string"


def _pages(raw: bytes, frames: Sequence[int] | None, channel: int | None):
    pages, info = images.read_tiff(raw)
    for i, page in enumerate(pages):
        if frames is not None and i not in frames:
            continue
        if page.ndim == 3:
            if channel is None:
                page = images.grey(page)
            if page.ndim == 3:
                if channel is None or not 0 <= channel < page.shape[-1]:
                    raise ValueError(f"channel {channel} of {page.shape[-1]}")
                page = page[..., channel]
        yield i, page, info


def read_images(spark: SparkSession, path: str, frames: Sequence[int] | None = None, channel: int | None = None, glob: str = "*.tif*") -> DataFrame:
    """Frames of all TIFF files below path: one row a frame with its pixels. frames: only those; channel: of colour images (default: grey)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    wanted = None if frames is None else {int(f) for f in frames}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in IMAGE.split(", ")]
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                for i, page, info in _pages(raw, wanted, channel):
                    yield pd.DataFrame([(p, i, *page.shape, page.astype(float).ravel().tolist(), info["description"], info["resolution"], info["unit"])], columns=names)

    return files.mapInPandas(run, IMAGE)


def list_files(spark: SparkSession, path: str, glob: str = "*.tif*") -> DataFrame:
    """Paths, lengths and times of matching files at any depth; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def base_name(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def date_in_name(path: Column) -> Column:
    """The first YYYYMMDD in a path's file name that is a date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(F.substring_index(path, "/", -1), r"(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def loi_name(x0: Column, y0: Column, x1: Column, y1: Column, width: Column) -> Column:
    """{x0}_{y0}_{x1}_{y1}_{width}_loi"""
    return F.concat_ws("_", *[c.cast("string") for c in (x0, y0, x1, y1, width)], F.lit("loi"))


def metadata(files: DataFrame) -> DataFrame:
    """files(..., info map<string,string>, n_pages int, resolution double, unit string) -> + frames, frametime, pixelsize, time array.

    frames: info's frames, slices, the pages.  frametime: finterval, Frame
    interval, frame_interval, frametime, 1 / fps.  pixelsize: info's, else unit
    over resolution.  What is not known is NULL.
    """
    get = lambda k: F.try_element_at("info", F.lit(k)).try_cast("double")
    out = files.withColumn("frames", F.coalesce(get("frames"), get("slices"), F.col("n_pages").cast("double")).cast("int"))
    out = out.withColumn("frametime", F.coalesce(get("finterval"), get("Frame interval"), get("frame_interval"), get("frametime"), F.try_divide(F.lit(1.0), get("fps"))))
    out = out.withColumn("pixelsize", F.coalesce(get("pixelsize"), pixel_size(F.col("resolution"), F.col("unit"))))
    times = F.transform(F.sequence(F.lit(0), F.col("frames") - 1), lambda i: i * F.col("frametime"))
    return out.withColumn("time", F.when((F.col("frames") > 0) & F.col("frametime").isNotNull(), times))


def has_metadata(files: DataFrame) -> Column:
    return files["pixelsize"].isNotNull()


def lines_of_files(images: DataFrame, found: DataFrame) -> DataFrame:
    """images(path), found(path) -> (path, loi): the line files (*_loi.json) in the folder that is named like the image, less its extension.

    An image without such a folder, or with no line in it, has no row; images that differ in their extension alone share a folder.
    """
    folder = F.regexp_replace("path", r"\.[^./]*$", "")
    parent = F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
    lines = found.where(F.col("path").endswith("_loi.json")).select(parent.alias("folder"), F.substring_index("path", "/", -1).alias("loi"))
    return images.select("path", folder.alias("folder")).join(lines, "folder").select("path", "loi")


#: Old column names and the present ones; fixed values.
LEGACY = {"points": "pos_vectors", "timepoints": "frames", "resxy": "pixelsize", "tint": "frametime"}


def renamed_legacy(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in LEGACY.items() if a in df.columns and b not in df.columns})


def tagged(value) -> object:
    """JSON form of numpy values: arrays, scalars and sparse matrices carry a type tag."""
    if isinstance(value, np.ndarray):
        return {"type": "ndarray", "values": value.tolist()}
    if isinstance(value, np.generic):
        return {"type": value.dtype.name, "value": value.item()}
    if isinstance(value, dict):
        if set(value) == {"row", "col", "data", "shape"}:
            return {"type": "sparse_matrix", **{k: np.asarray(v).tolist() for k, v in value.items()}}
        return {k: tagged(v) for k, v in value.items()}
    return [tagged(v) for v in value] if isinstance(value, (list, tuple)) else value


def untagged(value) -> object:
    if isinstance(value, dict):
        kind = value.get("type")
        if kind == "ndarray":
            return np.array(value["values"])
        if kind == "sparse_matrix":
            return {k: value[k] for k in ("row", "col", "data", "shape")}
        if kind is not None and set(value) == {"type", "value"}:
            return np.dtype(kind).type(value["value"])
        return {k: untagged(v) for k, v in value.items()}
    return [untagged(v) for v in value] if isinstance(value, list) else value


def dumps(value) -> str:
    return json.dumps(tagged(value))


def loads(text: str):
    return untagged(json.loads(text))


def sparse_to_json(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cells(keys, row, col, data) -> (keys, json) with parallel lists in row and column order."""
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "col", "data"))).alias("c"))
    lists = F.struct(*[F.expr(f"transform(c, x -> x.{n})").alias(n) for n in ("row", "col", "data")])
    return rows.select(*keys, F.to_json(lists).alias("json"))


def sparse_from_json(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.from_json("json", "row array<int>, col array<int>, data array<double>")
    cells = df.select(*keys, F.explode(F.arrays_zip(p["row"].alias("row"), p["col"].alias("col"), p["data"].alias("data"))).alias("c"))
    return cells.select(*keys, F.col("c.row").alias("row"), F.col("c.col").alias("col"), F.col("c.data").alias("data"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Line files (JSON with profiles[t][x], length, line) -> (path, length, line, frame, x_pos array, profile array).

    x_pos runs evenly from 0 to the length; a missing length is the line's.
    """
    schema = "profiles array<array<double>>, length double, line array<array<double>>"
    files = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path).withColumn("path", F.input_file_name())
    step = lambda a, b, i: F.pow(F.get(F.get("line", F.lit(a)), F.lit(i)) - F.get(F.get("line", F.lit(b)), F.lit(i)), 2)
    length = F.coalesce("length", F.sqrt(step(0, 1, 0) + step(0, 1, 1)))
    rows = files.select("path", length.alias("length"), "line", F.posexplode("profiles").alias("frame", "profile"))
    n = F.size("profile")
    x = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.coalesce(F.try_divide(F.col("length"), n - 1), F.lit(0.0)))
    return rows.withColumn("x_pos", F.when(n > 0, x))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Text files of one number a line -> (path, frame, y); lines that are no number are missing.  The parts that Spark writes of one
    series are one, under their folder's path.

    Files of any size are read in blocks: lines are numbered inside their block, blocks by the counts of those before.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = stage(lines, "lines")
    parent = F.expr("substring(file, 1, length(file) - length(substring_index(file, '/', -1)) - 1)")
    series = F.when(F.substring_index("file", "/", -1).startswith("part-"), parent).otherwise(F.col("file"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("path", series)
    order = Window.partitionBy("path").orderBy("file", "block")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    return lines.withColumn("i", inside).join(blocks, ["file", "block"]).select("path", (F.col("before") + F.col("i")).alias("frame"), F.trim("value").try_cast("double").alias("y"))


def write_series(df: DataFrame, path: str, frame: str, y: str) -> None:
    """One number a line in the order of frames; a large series is several parts, whose names keep the order."""
    df.orderBy(frame).select(F.col(y).cast("string").alias("value")).write.mode("overwrite").text(path)


#: Rows of one sheet at most, with the header; fixed value of the format.
SHEET_ROWS = 1_048_576
_SHEET_FILES = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _sheet_row(values: Sequence) -> str:
    def cell(v) -> str:
        if v is None or isinstance(v, float) and not np.isfinite(v):
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        text = v if isinstance(v, str) else json.dumps(v, default=str)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("".join(c for c in text if c.isprintable() or c in " \t\n"))}</t></is></c>'

    return f"<row>{''.join(map(cell, values))}</row>"


def write_sheet(df: DataFrame, path: str) -> None:
    """Writes a result table as one XLSX sheet, row by row from the driver; more rows than a sheet holds raise before anything is read."""
    if df.limit(SHEET_ROWS).count() >= SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows; export as csv or parquet")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _SHEET_FILES.items():
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            sheet.write(_sheet_row(df.columns).encode())
            for row in df.toLocalIterator():
                sheet.write(_sheet_row(row).encode())
            sheet.write(b"</sheetData></worksheet>")


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes a result table as csv, json, xml, parquet or one xlsx file; arrays become JSON text where the format has none. Unknown formats raise."""
    if fmt not in ("csv", "json", "xml", "parquet", "xlsx"):
        raise ValueError(f"unknown export format {fmt!r}")
    if fmt == "xlsx":
        write_sheet(df, path)
        return
    writer = lambda d: d.write.mode("overwrite")
    if fmt == "csv":
        flat = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema])
        writer(flat).option("header", "true").csv(path)
    elif fmt == "xml":
        writer(df).format("xml").option("rowTag", "row").save(path)
    else:
        writer(df).format(fmt).save(path)


def key_value_lines(df: DataFrame) -> DataFrame:
    """One row a column and row: key, value as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    return df.select(F.explode(pairs).alias("p")).select("p.key", "p.value")


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes df partitioned by columns; only partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
