"""Lookups and merges by key: cached readings, results of runs, imported terms, positional pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import casefold, lowered, simple_lower
from ..functions.values import flag, has_text


def hits_and_pending(requests: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached value, and the distinct keys that are still to be computed. An empty value is a hit."""
    hits = requests.join(cache.select(key, value), key)
    pending = requests.select(key).distinct().join(cache, key, "left_anti")
    return hits, pending


def spread_results(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One result for every request of its key."""
    return requests.join(results, key, "left")


def latest(rows: DataFrame, key: str | list[str], newest: Column) -> DataFrame:
    """Of each key the row with the greatest `newest`; upserts are this over the union of old and new rows."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), newest).alias("__row")).select(*keys, "__row.*")


def keep_newest(rows: DataFrame, n: int, *newest: Column) -> DataFrame:
    """The n newest rows in all: a top-n, so no task sorts the whole table."""
    return rows.orderBy(*newest).limit(n)


def keep_newest_per_key(rows: DataFrame, keys: list[str], n: int, *newest: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).filter(F.col("__n") <= n).drop("__n")


def merge_results(regions: DataFrame, results: DataFrame, token: str, key: str, columns: list[str]) -> DataFrame:
    """Regions updated by a result with their token, else by one without a token and with their key; results of regions
    that are gone fall away, and a region keeps what no result replaces."""
    by_token = results.filter(F.col(token).isNotNull()).select(token, *[F.col(c).alias(f"__t_{c}") for c in columns], F.lit(True).alias("__t"))
    by_key = results.filter(F.col(token).isNull()).select(key, *[F.col(c).alias(f"__k_{c}") for c in columns], F.lit(True).alias("__k"))
    joined = regions.join(by_token, token, "left").join(by_key, key, "left")
    new = {c: F.when(flag("__t"), F.coalesce(f"__t_{c}", c)).when(flag("__k"), F.coalesce(f"__k_{c}", c)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(*regions.columns)


def apply_values(rows: DataFrame, values: DataFrame, key: str | list[str], column: str) -> DataFrame:
    """Rows with the new value of their key, if there is one."""
    keys = [key] if isinstance(key, str) else key
    return rows.join(values.select(*keys, F.col(column).alias("__new")), keys, "left").withColumn(column, F.coalesce("__new", column)).select(*rows.columns)


def pair_by_place(targets: DataFrame, entries: DataFrame, group: str, target_order: list[Column], entry_order: list[Column], free: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The k-th entry of a group goes to its k-th (free) target; returns the pairs and the entries left over."""
    place = lambda order: F.row_number().over(W.partitionBy(group).orderBy(*order))
    spots = (targets if free is None else targets.filter(free)).withColumn("place", place(target_order))
    queue = entries.withColumn("place", place(entry_order))
    return spots.join(queue, [group, "place"]), queue.join(spots.select(group, "place"), [group, "place"], "left_anti")


def by_name_or_stem(pages: DataFrame, names: DataFrame, page_order: str) -> DataFrame:
    """Pages for given names: by full name, else by the name without its ending, in any case; of clashing pages the last."""
    low = pages.withColumns({"__name": F.lower("name"), "__stem": F.regexp_replace(F.lower("name"), r"\.[^.]*$", "")})
    full = low.groupBy("__name").agg(F.max_by("page_key", page_order).alias("__full"))
    stem = low.groupBy("__stem").agg(F.max_by("page_key", page_order).alias("__short"))
    asked = names.withColumn("__asked", F.lower("page_name"))
    found = asked.join(full, F.col("__asked") == F.col("__name"), "left").join(stem, F.col("__asked") == F.col("__stem"), "left")
    return found.select(*names.columns, F.coalesce("__full", "__short").alias("page_key"))


def merge_terms(first: DataFrame, second: DataFrame, key: Column, order: str) -> DataFrame:
    """Terms of both lists, one for each key: the first list's wins over the second's, then the earlier; an empty note is
    filled by the next one that is not."""
    both = first.withColumn("__list", F.lit(0)).unionByName(second.withColumn("__list", F.lit(1)))
    return first_per_key(both, key, F.struct("__list", order)).drop("__list")


def first_per_key(terms: DataFrame, key: Column, order: Column) -> DataFrame:
    """Terms (source, target, category, note) with blank sources or targets dropped and one row per key, in order."""
    kept = terms.filter(has_text(F.col("source")) & has_text(F.col("target"))).withColumns({"__key": key, "__order": order})
    note = F.min_by("note", F.when(has_text(F.col("note")), F.col("__order")))
    others = [c for c in terms.columns if c != "note"]
    return kept.groupBy("__key").agg(F.min_by(F.struct(*others), "__order").alias("__row"), F.coalesce(note, F.lit("")).alias("note")).select("__row.*", "note")


def term_changes(stored: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """How many imported terms are new, changed or equal to a stored one."""
    old = stored.select(key, F.col("target").alias("__old"))
    kind = F.when(F.col("__old").isNull(), "new").when(F.col("__old") != F.col("target"), "changed").otherwise("same")
    return imported.join(old, key, "left").groupBy(kind.alias("change")).agg(F.count("*").alias("terms"))


#: Terms, and characters of terms, that one automaton holds.
SHARD_TERMS, SHARD_CHARS = 1 << 17, 1 << 23


def relevant_terms(terms: DataFrame, texts: DataFrame, batch: str, text: str, shard_terms: int = SHARD_TERMS, folded: bool = True) -> DataFrame:
    """The terms whose source stands anywhere in a text of a batch, in any case: batch with the terms' columns. Cases are
    folded (ß is ss) or, without `folded`, lowered character by character as by SQL's lower().

    Blank sources and null texts match nothing; repeated terms are each returned. The different sources are dealt into
    shards of a bounded size; a task makes an automaton of a shard and reads each text once, whatever its length, so that
    texts are not shuffled. A batch sends on each term it holds once for each of its texts."""
    keyed = terms.filter(has_text(F.col("source"))).withColumn("__key", (casefold if folded else lowered)(F.col("source")))
    size = keyed.select("__key").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("__key")), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-size.n // shard_terms), -(-size.chars // SHARD_CHARS))
    keyed = keyed.withColumn("__shard", F.pmod(F.xxhash64("__key"), F.lit(shards)))
    kind, found = texts.schema[batch].dataType.simpleString(), None
    for shard in range(shards):
        keys = [r[0] for r in keyed.filter(F.col("__shard") == shard).select("__key").distinct().collect()]  # a shard
        part = texts.select(F.col(batch).alias("batch"), text).mapInArrow(_finder(texts.sparkSession.sparkContext.broadcast(keys), folded), f"batch {kind}, key string")
        found = part if found is None else found.unionByName(part)
    found = found.distinct().select(F.col("batch").alias(batch), F.col("key").alias("__key"))
    return found.join(keyed, "__key").select(batch, *terms.columns)


def _finder(keys: Broadcast, folded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (batch, text): each batch with the keys that its text holds."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        fold = str.casefold if folded else simple_lower
        automaton = ahocorasick.Automaton()
        for k in keys.value:
            automaton.add_word(k, k)
        automaton.make_automaton()
        for rows in batches if keys.value else ():
            owner, held = [], []
            for i, t in enumerate(rows.column(1)):
                some = {k for _, k in automaton.iter(fold(t.as_py() or ""))}
                owner += [i] * len(some)
                held += some
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner, pa.int64())), pa.array(held, pa.string())], names=["batch", "key"])

    return find
