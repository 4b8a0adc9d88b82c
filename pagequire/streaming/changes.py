"""A stream of files that have changed and been left alone since: new and overwritten ones, each signature once.

The source looks at a folder at each trigger. Its offset is a digest of the signatures of all files that have been quiet for
a while, so a batch begins only when these have changed; whatever changes while a batch runs is seen together by the next.
What has been told already is kept as state by path, in the checkpoint with the offsets: a run that starts again goes on.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

SIGNATURES = "path string, modified long, length long"


@dataclass
class Some(InputPartition):
    files: list[tuple[str, int, int]]


class Polls(DataSourceStreamReader):
    """Options: path; quiet, seconds that a file must have been left alone (0.65); pattern of whole names (any)."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.quiet, self.pattern = options["path"], float(options.get("quiet", 0.65)), options.get("pattern", ".*")

    def listing(self) -> list[tuple[str, int, int]]:
        """path, time of change in nanoseconds and length of the quiet, non-empty files, by path."""
        from pyarrow.fs import FileSelector, FileSystem

        fs, root = FileSystem.from_uri(self.folder if re.match(r"[a-zA-Z][\w+.-]*:/", self.folder) else f"file://{self.folder}")
        last = time.time_ns() - int(self.quiet * 1e9)
        found = fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((f.path, f.mtime_ns, f.size) for f in found if f.is_file and f.size and f.mtime_ns <= last and re.fullmatch(self.pattern, f.base_name, re.IGNORECASE))

    def initialOffset(self) -> dict:
        return {"files": ""}

    def latestOffset(self) -> dict:
        digest = hashlib.sha256()
        for f in self.listing():
            digest.update(repr(f).encode("utf-8", "surrogatepass"))
        return {"files": digest.hexdigest()}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        """The files as they are now: one that has changed since the offset was made is told with its new signature, or, not
        quiet any more, by a later batch."""
        files = self.listing()
        return [Some(files[i : i + 1000]) for i in range(0, len(files), 1000)]

    def read(self, partition: Some) -> Iterator[tuple[str, int, int]]:
        yield from partition.files


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagequire_changes"

    def schema(self) -> str:
        return SIGNATURES

    def streamReader(self, schema: StructType) -> Polls:
        return Polls(self.options)


def told_once(signatures: DataFrame) -> DataFrame:
    """Of a stream of path, modified and length each signature of a path that differs from the last one told. Within a batch
    the latest counts. The state keeps a signature for each path ever seen."""

    def tell(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["modified", "length"])
        now = (int(rows.modified.iloc[-1]), int(rows.length.iloc[-1]))
        if not state.exists or state.get != now:
            state.update(now)
            yield pd.DataFrame({"path": [key[0]], "modified": [now[0]], "length": [now[1]]})

    return signatures.groupBy("path").applyInPandasWithState(tell, SIGNATURES, "modified long, length long", "append", GroupStateTimeout.NoTimeout)


def changed_files(spark: SparkSession, folder: str, quiet: float = 0.65, pattern: str = ".*") -> DataFrame:
    """A stream of path, modified and length: each file of a folder and those below when it is new or overwritten, once it
    has been left alone for `quiet` seconds; empty files do not count. With a checkpoint, files of earlier runs that have
    not changed since are not told again. Deleted files are not told; one that comes back as it was is not new."""
    spark.dataSource.register(ChangedFiles)
    return told_once(spark.readStream.format("pagequire_changes").option("path", folder).option("quiet", quiet).option("pattern", pattern).load())
