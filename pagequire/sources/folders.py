"""Folders of page images as tables of pages."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import natural_key, size_label

# fixed values: endings of page files
ENDINGS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")


def image_size(head: bytes) -> tuple[int, int] | None:
    """Width and height out of the beginning of a PNG, JPEG, BMP or WebP file; None if they are not in it."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:4] == b"RIFF" and head[8:15] == b"WEBPVP8" and len(head) >= 30:
        if head[15:16] == b"X":
            return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
        if head[15:16] == b"L":
            bits = int.from_bytes(head[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", head[26:30])
        return w & 0x3FFF, h & 0x3FFF
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head):
        kind = head[at + 1]
        if head[at] == 0xFF and 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h
        at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


#: Bytes in which sizes are looked for first, and, in a JPEG with much before its size, then.
HEAD, MORE = 1 << 16, 1 << 22
#: Schemes that tasks open by themselves, to read heads only; of other stores Spark reads whole files.
OWN = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def _sizes_of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSystem, LocalFileSystem

    known: dict[str, FileSystem] = {}
    for b in batches:
        sizes = []
        for path in b.column(0).to_pylist():
            scheme = path.partition(":")[0]
            if scheme == "file":
                fs, at = known.setdefault(scheme, LocalFileSystem()), "/" + path[5:].lstrip("/")
            else:
                fs, at = FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                head = f.read(HEAD)
                size = image_size(head)
                if size is None and head[:2] == b"\xff\xd8":
                    size = image_size(head + f.read(MORE))
            sizes.append(size or (None, None))
        made = [pa.array([s[i] for s in sizes], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "width", "height"])


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages under a folder, each folder a chapter: chapter_id, ord (natural order of names), page_key, name, width,
    height, size_label, modified, length. Sizes are null where a file's head does not tell; empty
    files are no pages. Of files only the heads are
    read, where tasks can open the store themselves."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join([*ENDINGS, *map(str.upper, ENDINGS)]) + "}").load(folder)
    if (folder.partition("://")[0] if "://" in folder else "file") in OWN:
        listed = files.select("path", "length", "modificationTime")  # without their content, which is not read then
        rows = listed.mapInArrow(_sizes_of_heads, "path string, length long, modificationTime timestamp, width int, height int")
    else:

        @F.pandas_udf("struct<width:int,height:int>")
        def measured(heads: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([image_size(bytes(h)) or (None, None) for h in heads], columns=["width", "height"]).astype("Int32")

        rows = files.select("path", "length", "modificationTime", measured(F.substring("content", 1, HEAD)).alias("size")).select("path", "length", "modificationTime", "size.*")
    name, chapter = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rows = rows.select(chapter.alias("chapter_id"), F.col("path").alias("page_key"), name.alias("name"), "width", "height", size_label(F.col("length")).alias("size_label"), F.col("modificationTime").alias("modified"), "length")
    return rows.withColumn("ord", (F.row_number().over(W.partitionBy("chapter_id").orderBy(natural_key(F.col("name")), "name")) - 1).cast("int"))


def without_collisions(targets: DataFrame, sources: DataFrame, path: str, aside: Callable[[str], str] = lambda folder: folder + "/export") -> DataFrame:
    """Output paths; those that are inputs go to a subfolder beside them."""
    taken = sources.select(F.col(path).alias("__taken")).distinct()
    folder, name = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.element_at(F.split(path, "/"), -1)
    marked = targets.join(taken, F.col(path) == F.col("__taken"), "left")
    return marked.withColumn(path, F.when(F.col("__taken").isNotNull(), F.concat(folder, F.lit(aside("")), F.lit("/"), name)).otherwise(F.col(path))).drop("__taken")
