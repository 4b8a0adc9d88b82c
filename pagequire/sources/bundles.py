"""Project bundles: a ZIP with project.json and images, as tables of pages, regions and assets, and written back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_files

#: Newest version of the format that is read.
VERSION = 1
PAGES = "array<struct<name:string,path:string,relative_path:string,width:int,height:int,size_label:string>>"
REGIONS = "map<string,array<struct<id:string,x:int,y:int,width:int,height:int,confidence:double,text:string,translation:string>>>"


def _bundle_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("bundle"), "content")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """bundle (its path), error and project (version, source_root, pages, regions) of every bundle under a path; those
    without a readable project, or of a newer version, have an error instead."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for content in b.column(1):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        found.append((z.read("project.json").decode(), None))
                except (zipfile.BadZipFile, KeyError, UnicodeDecodeError) as e:
                    found.append((None, type(e).__name__))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]], names=["bundle", "project", "error"])

    files = _bundle_files(spark, path).mapInArrow(opened, "bundle string, project string, error string")
    parsed = files.select("bundle", "error", F.from_json("project", f"version int, source_root string, pages {PAGES}, regions {REGIONS}").alias("p"))
    error = F.coalesce("error", F.when(F.col("p.version") > VERSION, "newer version"), F.when(F.col("p.version").isNull(), "no version"))
    return parsed.select("bundle", error.alias("error"), F.when(error.isNull(), F.col("p")).alias("project"))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """bundle, asset (its name in the bundle) and content of everything in the bundles but their projects, one at a time."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, content in enumerate(b.column(1)):
                raw = content.as_py()
                if zipfile.is_zipfile(io.BytesIO(raw)):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for name in z.namelist():
                            if name != "project.json" and not name.endswith("/"):
                                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["bundle", "asset", "content"])

    return _bundle_files(spark, path).mapInArrow(opened, "bundle string, asset string, content binary")


def is_local(path: Column) -> Column:
    """Whether a path is one on this store: neither a network share nor a URL, which another's project must not reach."""
    return ~F.coalesce(path.rlike(r"^(\\\\|//|[a-zA-Z][a-zA-Z0-9+.-]+://)"), F.lit(False))


def bundle_pages(bundles: DataFrame) -> DataFrame:
    """chapter_id, ord, page_key, name, width and height of the readable bundles; paths to other hosts are refused."""
    rows = bundles.filter("error is null").select(F.col("bundle").alias("chapter_id"), F.posexplode("project.pages").alias("ord", "p"))
    return rows.filter(is_local(F.col("p.path"))).select("chapter_id", "ord", F.coalesce("p.path", "p.name").alias("page_key"), "p.name", "p.width", "p.height")


def resolved_pages(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """Pages of the readable bundles with page_key, the first of their candidate paths that is among the files (path): below
    the saved root, below the bundle's own folder, or as it stands; missing where none is, and then page_key is null.
    Paths to other hosts are no candidates."""
    below = lambda root: F.when(F.col("p.relative_path") != "", F.concat(root, F.lit("/"), F.col("p.relative_path")))
    folder = F.regexp_replace(F.regexp_extract("bundle", "^(.*)/[^/]*$", 1), "^file:/+", "/")
    rows = bundles.filter("error is null").select("bundle", folder.alias("folder"), F.col("project.source_root").alias("root"), F.posexplode("project.pages").alias("ord", "p"))
    rows = rows.withColumn("paths", F.array(below(F.nullif("root", F.lit(""))), below(F.col("folder")), F.nullif("p.path", F.lit(""))))
    tried = rows.select("bundle", "ord", F.posexplode("paths").alias("turn", "path")).filter(F.col("path").isNotNull() & is_local(F.col("path")))
    there = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path")).distinct()
    found = tried.join(there, "path").groupBy("bundle", "ord").agg(F.min_by("path", "turn").alias("page_key"))
    return rows.join(found, ["bundle", "ord"], "left").select(F.col("bundle").alias("chapter_id"), "ord", "page_key", "p.name", "p.width", "p.height", F.col("page_key").isNull().alias("missing"))


def bundle_regions(bundles: DataFrame) -> DataFrame:
    rows = bundles.filter("error is null").select(F.col("bundle").alias("chapter_id"), F.explode("project.regions").alias("page_key", "r"))
    return rows.select("chapter_id", "page_key", F.posexplode("r").alias("ord", "b")).select("chapter_id", "page_key", "ord", "b.*")


def write_bundles(pages: DataFrame, regions: DataFrame, folder: str, assets: DataFrame | None = None) -> None:
    """One bundle per chapter, `<hash of the chapter>.zip`, put in place together. `assets`: chapter_id, asset, content.

    The project is written in pieces, a page or a page's regions each, so that no chapter is gathered; regions stand under
    their pages' keys. Chapters without pages have no bundle, nor have assets without a chapter."""
    chapters = pages.select("chapter_id").distinct()
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    own = pages.select("chapter_id", F.col("ord").cast("long").alias("n"), "page_key", F.to_json(F.struct("name", F.col("page_key").alias("path"), "width", "height")).alias("body"))
    held = regions.join(chapters, "chapter_id", "left_semi").groupBy("chapter_id", "page_key").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "id", "x", "y", "width", "height", "confidence", "text", "translation")))).alias("r"))
    held = held.select("chapter_id", F.lit(0).cast("long").alias("n"), "page_key", F.concat(quoted(F.col("page_key")), F.lit(":"), "r").alias("body"))

    def listed(rows: DataFrame, step: int) -> DataFrame:
        """The pieces of a list, all but the first behind a comma."""
        first = rows.groupBy("chapter_id").agg(F.min(F.struct("n", "page_key", "body")).alias("first"))
        body = F.when(F.struct("n", "page_key", "body") == F.col("first"), F.col("body")).otherwise(F.concat(F.lit(","), "body"))
        return rows.join(first, "chapter_id").select("chapter_id", F.struct(F.lit(step).alias("step"), "n", "page_key", F.col("body").alias("b")).alias("ord"), body.alias("body"))

    def fixed(step: int, text: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return chapters.select("chapter_id", F.struct(F.lit(step).alias("step"), F.lit(0).cast("long").alias("n"), none.alias("page_key"), none.alias("b")).alias("ord"), F.lit(text).alias("body"))

    parts = fixed(0, f'{{"version":{VERSION},"pages":[').unionByName(listed(own, 1)).unionByName(fixed(2, '],"regions":{')).unionByName(listed(held, 3)).unionByName(fixed(4, "}}"))
    name = F.concat(F.sha2(F.col("chapter_id").cast("string"), 256), F.lit(".zip")).alias("file")
    pieces = parts.select(name, F.lit("project.json").alias("entry"), "ord", F.encode("body", "UTF-8").alias("content"))
    if assets is not None:
        held = assets.join(chapters, "chapter_id", "left_semi").filter("asset <> 'project.json'")
        pieces = pieces.unionByName(held.select(name, F.col("asset").alias("entry"), F.lit(None).cast(pieces.schema["ord"].dataType).alias("ord"), "content"))
    write_files(pieces, folder)
