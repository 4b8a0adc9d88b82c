"""Small helpers shared by the corpus operators: raw bytes of Arrow text columns, words, seeded hashes."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# fixed value: the separators of the word pattern [^\x20\x09-\x0D]+; bytes.split() without an argument splits on the same six bytes
SPACES = b" \t\n\x0b\x0c\r"
#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; nulls stay None."""
    return column.cast(pa.binary()).to_pylist()


def free(frame: DataFrame, *names: str) -> list[str]:
    """The names with underscores before them, as many as it takes for no column to have them in any case."""
    taken = {c.lower() for c in frame.columns}
    mark = next("_" * n for n in range(1, len(taken) + 2) if not taken & {"_" * n + x for x in names})
    return [mark + x for x in names]


#: Bytes of a batch that are worked on at once, beyond which it is cut; a longer row stands alone.
STEP_BYTES = 8 << 20


def map_rows(frame: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str, step: int = 512) -> DataFrame:
    """mapInArrow for functions that turn a batch of at most `step` rows and, but for a single row, STEP_BYTES into a dict
    of columns (or several)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows > 1 and (batch.num_rows > step or batch.nbytes > STEP_BYTES):
            half = batch.num_rows // 2
            yield from parts(batch.slice(0, half))
            yield from parts(batch.slice(half))
        elif batch.num_rows:
            yield batch

    def run(batches):
        for batch in batches:
            for some in parts(batch):
                made = work(some)
                for part in [made] if isinstance(made, dict) else made:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type, from_pandas=True) for x, f in zip((part[f.name] for f in out), out, strict=True)], schema=out)

    return frame.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shift-multiply finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def cut(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold at most `most` items each; a larger row stands alone."""
    out, start = [], 0
    for i in range(1, len(offsets) - 1):
        if offsets[i + 1] - offsets[start] > most:
            out.append((start, i))
            start = i
    if start < len(offsets) - 1:
        out.append((start, len(offsets) - 1))
    return out


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="pagequire-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only in local mode, where it is one machine, a
    folder of our own if the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or _own_folder(spark.sparkContext.applicationId)


#: What writing tables needs: the shuffle files of a write go when it ends, and rows of many columns, which can be large,
#: reach Python in small batches.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


@functools.cache
def defaults(version: str) -> dict[str, str]:
    """Spark's own values of the settings, before anyone has set them."""
    spark = SparkSession.active().newSession()
    out = {}
    for k in SETTINGS:
        spark.conf.unset(k)
        out[k] = spark.conf.get(k, None)
    return out


def settle(spark: SparkSession) -> None:
    """Give the session the settings, once and for good, where it still has Spark's own values: nothing is switched to
    and fro while other queries of the session run."""
    for k, v in SETTINGS.items():
        now = spark.conf.get(k, None)
        if now != v and now == defaults(spark.version)[k]:
            spark.conf.set(k, v)


_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that kept() writes inside go at the end, but for those that the yielded function writes."""
    outer, paths = _scope.get(), []
    token = _scope.set(paths)

    def spare(frame: DataFrame) -> DataFrame:
        inner = _scope.set(outer)
        try:
            return kept(frame)
        finally:
            _scope.reset(inner)

    try:
        yield spare
    finally:
        _scope.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(frame: DataFrame) -> DataFrame:
    """The frame written once as a table in the shared folder, and read from there: what follows neither computes it
    again nor depends on the executors that made it."""
    spark = frame.sparkSession
    settle(spark)
    path = f"{shared_folder(spark)}/pagequire-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    if _scope.get() is not None:
        _scope.get().append(path)
    return spark.read.schema(frame.schema).parquet(path)


BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose hashes are computed at once: with the rest of their last word no more than 2^18, as a rule.
CHUNK_BYTES = (1 << 18) - (1 << 13)
_separates = np.isin(np.arange(256), list(SPACES))
_lowered = np.frombuffer(LOWER, np.uint8)
#: A random 64-bit number for each byte.
_values = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 .. n - 1, and to those powers negated, modulo 2**64. A worker keeps the longest ones."""
    if len(_powers[0]) < n:
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: pa.Array, affixes: tuple[int, ...] = (), lower: bool = True, lines: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a batch of texts, in lower case (A-Z) unless told not to, text after text, and the
    words of each text. With affixes there is a column for the word and one for each affix: so many first bytes, or, if
    negative, last bytes of the word. With lines the last column tells whether a line's end stands before the word.

    A word's hash is the sum of its bytes' numbers times powers of an odd base: sums over all prefixes of the bytes give
    every word by one subtraction, and dividing by the power at its start makes it independent of its place.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    counts, none = np.zeros(len(texts), np.int64), np.zeros((0, 1 + len(affixes) + lines) if affixes or lines else 0, np.uint64)
    if offsets[-1] == offsets[0]:
        return none, counts
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out, at, size = [], 0, len(raw)
    while at < size:
        end = min(at + CHUNK_BYTES, size)
        while end < size:  # cut between two words
            gap = np.flatnonzero(_separates[raw[end : end + 4096]])
            edge = offsets[np.searchsorted(offsets, end)]
            stop = min(end + int(gap[0]) if len(gap) else min(end + 4096, size), int(edge))
            if len(gap) or stop == edge:
                end = stop
                break
            end = stop
        part = raw[at:end]
        word = ~_separates[part]
        first = np.ones(len(part) + 1, bool)
        first[1:-1] = False
        first[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at] = True
        begins = np.flatnonzero(word & (first[:-1] | ~np.r_[False, word[:-1]]))
        ends = np.flatnonzero(word & (first[1:] | ~np.r_[word[1:], False])) + 1
        if len(begins):
            up, down = powers(1 << max(18, (len(part) - 1).bit_length()))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_values[_lowered[part] if lower else part] * up[: len(part)], out=sums[1:])
            hashes = [mix64((sums[ends] - sums[begins]) * down[begins])]
            for n in affixes:
                lo, hi = (begins, np.minimum(begins + n, ends)) if n > 0 else (np.maximum(ends + n, begins), ends)
                hashes.append(mix64((sums[hi] - sums[lo]) * down[lo] + np.uint64(abs(n) + (n < 0) * 64)))
            if lines:
                ended = np.concatenate([[0], np.cumsum(part == 10)])
                hashes.append((ended[begins] > ended[np.concatenate([[0], ends[:-1]])]).astype(np.uint64))
            out.append(np.stack(hashes, 1) if len(hashes) > 1 else hashes[0])
            counts += np.bincount(np.searchsorted(offsets, begins + at, "right") - 1, minlength=len(counts))
        at = end
    return np.concatenate(out) if out else none, counts


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the n-word shingles of each text: with fewer words, of the whole sequence; without
    words, none."""
    words, counts = word_hashes(texts)
    rolled = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        rolled = rolled * BASE + words[k : k + len(rolled)]
    rolled = mix64(rolled)
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= n:
            one = np.sort(rolled[end - count : end - n + 1])
            out.append(one[np.r_[True, one[1:] != one[:-1]]])
        elif count:
            out.append(mix64(np.sum(words[end - count : end] * powers(count + 1)[0][1:], keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
