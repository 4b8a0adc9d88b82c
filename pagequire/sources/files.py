"""A sink of whole files, plain or ZIP, written in pieces by tasks and put in place together.

Tasks write below `_temporary` of the target folder; only when all have ended does the driver drop what is to be replaced
and move the files to their names. A job that fails leaves the folder as it was.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    task: str
    files: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.replaced, self.job = options["path"], options.get("replaced"), uuid.uuid4().hex

    def at(self):
        """The file system of the folder, and the folder there."""
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.folder if re.match(r"[a-zA-Z][\w+.-]*:/", self.folder) else f"file://{self.folder}")

    def write(self, rows: Iterator[Row]) -> Written:
        """Rows come by file, entry and place: pieces of one entry follow each other, and so do entries of one file."""
        fs, root = self.at()
        task, files, out, archive, entry, now = uuid.uuid4().hex, [], None, None, None, (None, None)

        def ended() -> None:
            for open_ in (entry, archive, out):
                if open_ is not None:
                    open_.close()

        for row in rows:
            if row.file != now[0]:
                ended()
                archive = entry = None
                if "/" in row.file or row.file in ("", ".", "..", "_temporary"):
                    raise ValueError(f"no name of a file: {row.file!r}")
                fs.create_dir(f"{root}/_temporary/{self.job}/{task}", recursive=True)
                out = fs.open_output_stream(f"{root}/_temporary/{self.job}/{task}/{row.file}", compression=None)
                files.append(row.file)
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if row.entry is not None else None
            if archive is not None and (row.file, row.entry) != now:
                if entry is not None:
                    entry.close()
                entry = archive.open(row.entry, "w", force_zip64=True)
            (entry or out).write(bytes(row.content or b""))
            now = (row.file, row.entry)
        ended()
        return Written(task, files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, root = self.at()
        names = [f for m in messages if m for f in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several tasks wrote one file: deal rows by file")
        fs.create_dir(root, recursive=True)
        if self.replaced:
            for old in fs.get_file_info(FileSelector(root)):
                if old.is_file and re.fullmatch(self.replaced, old.base_name, re.IGNORECASE):
                    fs.delete_file(old.path)
        for m in messages:
            for f in m.files if m else ():
                fs.move(f"{root}/_temporary/{self.job}/{m.task}/{f}", f"{root}/{f}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Drop what tasks have written and not put in place, failed attempts' files too."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = self.at()
        for path in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            if fs.get_file_info(path).type == FileType.Directory and (path.endswith(self.job) or not fs.get_file_info(FileSelector(path))):
                fs.delete_dir(path)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagequire_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def write_files(pieces: DataFrame, folder: str, replaced: str | None = None) -> None:
    """Write pieces (file, entry, ord of any orderable kind, content) as files of a folder that driver and executors share. The pieces of a file
    are joined by ord; where an entry is named the file is a ZIP of its entries, in the order of their names. `replaced`:
    a pattern of the names of earlier output, which goes when the new files are put in place, and not before.

    Files of the same name are replaced. Null content is empty. A file is written by one task, piece by piece."""
    spark: SparkSession = pieces.sparkSession
    spark.dataSource.register(FileSink)
    rows = pieces.repartition("file").sortWithinPartitions("file", "entry", "ord").select("file", "entry", "content")
    out = rows.write.format("pagequire_files").mode("append").option("path", folder)
    (out.option("replaced", replaced) if replaced else out).save()


def slice_plan(strips: DataFrame, height: int, sliver: float = 0.25) -> DataFrame:
    """The slices (chapter_id, number from 1, top, bottom) of strips (chapter_id, height): each of a height, but for the
    last; a rest of less than `sliver` of it joins the slice before. Strips without height have none."""
    n = F.greatest(F.lit(1), F.expr(f"height div {height}") + (F.col("height") % height >= int(height * sliver)).cast("long"))
    rows = strips.filter("height > 0").select("chapter_id", "height", F.posexplode(F.sequence(F.lit(1).cast("long"), n)).alias("i", "number"), n.alias("n"))
    top = (F.col("number") - 1) * height
    return rows.select("chapter_id", "number", top.alias("top"), F.when(F.col("number") == F.col("n"), F.col("height")).otherwise(top + height).alias("bottom"))


def write_slices(slices: DataFrame, folder: str, prefix: str = "", ending: str = "jpg", archive: str | None = None) -> None:
    """Write slices (number, content) as prefix001.ending and so on, and with `archive` as a ZIP of this name too. Slices of
    an earlier output in the folder go, whatever their number and kind; other files stay."""
    name = F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.length(F.col("number").cast("string"))), F.lit("0")), F.lit(f".{ending}"))
    none = F.lit(None).cast("string")
    pieces = slices.select(name.alias("file"), none.alias("entry"), F.lit(0).alias("ord"), "content")
    if archive:
        pieces = pieces.unionByName(slices.select(F.lit(archive).alias("file"), name.alias("entry"), F.lit(0).alias("ord"), "content"))
    write_files(pieces, folder, re.escape(prefix) + r"\d{3,}\.(?:jpg|webp|png)")
