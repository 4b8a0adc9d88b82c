"""Watching files: which changed, and which have stopped changing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stable_files(observed: DataFrame) -> DataFrame:
    """path and signature (modified, length) of each file that has been seen twice in a row with the same signature and is
    not empty, once for each signature. `observed`: a stream of path, modified (long), length and seen (a rising number)."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else ("", "")
        out = []
        for row in pd.concat(list(frames)).sort_values("seen").itertuples():
            now = f"{row.modified}:{row.length}"
            if now == last and now != told and row.length > 0:
                out.append((key[0], row.modified, row.length))
                told = now
            last = now
        state.update((last, told))
        yield pd.DataFrame(out, columns=["path", "modified", "length"])

    return observed.groupBy("path").applyInPandasWithState(watch, "path string, modified long, length long", "last string, told string", "append", GroupStateTimeout.NoTimeout)
