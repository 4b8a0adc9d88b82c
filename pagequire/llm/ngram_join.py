"""N-gram Jaccard join: classes of documents whose shingle sets overlap by a given percentage.

The document-by-n-gram matrix is multiplied with itself in blocks of columns. Size bounds say how many of a row's
rarest columns any linked pair must share in at least one place, so only these columns are dealt out to find pairs; for
the pairs found, overlap counts are accumulated over blocks of all columns, and a pair is dropped as soon as its count
and what is left of both rows cannot reach the bound that follows from its sizes.

Rows with the same set are one node. A column held by many nodes is not turned into all its pairs. Its nodes get a
centre, the columns that most of a few of them hold, and are described by their difference to it. Two rows are linked
when they differ in at most (100 - p) / (100 + p) of their sizes' sum, so:
- rows close enough to the centre are all linked to the closest one, without being compared;
- of any other linked pair, the differences share columns, as many as both are too far from the centre.
So the differences' rarest columns are dealt out in turn, with the same bounds, and columns of many nodes among them get
centres again. Each time the closest row leaves, compared with those that are not linked to it, so this ends.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .text import kept, map_rows, scratch, shingle_sets

#: The most frequent shingles, which are moved to the end of every row's order: at most so many are sent to the tasks.
#: They only steer which columns are rare; any list gives the same links.
FREQUENT = 1 << 20
#: Columns with at most so many nodes give all their pairs at once, at most half as many as nodes times this.
SMALL = 32
#: Nodes of a large column that its centre is taken from, and nodes of one that meet one copy of the centre. Both steer
#: cost only: any centre gives the same links.
SAMPLE, PIECE = 33, 1024
#: So many ids of wanted texts at most are sent to all tasks; more of them are joined by a shuffle.
BROADCAST = 1 << 20
#: Blocks of columns in the final product.
BLOCKS = 8


def frequent_shingles(docs: DataFrame, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles that recur within batches of different texts, the most frequent FREQUENT."""

    def count(batch: pa.RecordBatch) -> dict:
        sets = {s.tobytes(): s for lo in range(0, batch.num_rows, 1000) for s in shingle_sets(batch.column(0).slice(lo, 1000), n) if len(s)}
        every, times = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
        return {"h": every[times > 1].astype(np.int64), "n": times[times > 1]}

    counts = kept(map_rows(docs.select(text_col), count, "h long, n long", 10_000).groupBy("h").agg(F.sum("n").alias("n")))
    step = F.when(F.col("n") <= 1000, F.col("n")).otherwise(1000 + F.floor(64 * F.log2(F.col("n") / 1000))).cast("long")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("m")).orderBy(F.desc("step")).collect()  # some thousand rows
    least, total = None, 0
    for r in steps:  # the lowest count from which on the shingles are few enough; none, if even the highest are too many
        total += r.m
        if total > FREQUENT:
            break
        least = r.step
    top = counts.filter(step >= least if least is not None else F.lit(False)).toArrow()
    h, n = top["h"].to_numpy().astype(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], np.minimum(n[order], 1 << 30).astype(np.int32)


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> int | None:
    """The common columns of two rows, accumulated over blocks of columns; None as soon as `need` is out of reach."""
    edges = np.array([i << (64 - BLOCKS.bit_length() + 1) for i in range(1, BLOCKS)], np.uint64)
    cut_a, cut_b = ([0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (a, b))
    got = 0
    for i in range(BLOCKS):
        both = np.sort(np.concatenate([a[cut_a[i] : cut_a[i + 1]], b[cut_b[i] : cut_b[i + 1]]]))
        got += int(np.count_nonzero(both[1:] == both[:-1]))
        if got + min(len(a) - cut_a[i + 1], len(b) - cut_b[i + 1]) < need:
            return None
    return got


def counts_of(one: np.ndarray, hot: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each column is counted among the frequent ones, else 0."""
    if not len(hot) or not len(one):
        return np.zeros(len(one), np.int32)
    at = np.minimum(np.searchsorted(hot, one), len(hot) - 1)
    return np.where(hot[at] == one, times[at], 0)


def rarest_first(one: np.ndarray, hot: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A row's columns in the order common to all rows: by count, then by hash."""
    return one[np.argsort(counts_of(one, hot, times), kind="stable")]


def least_shared(s: int, f: int, n: int, centre: int, percent: int) -> tuple[int, int]:
    """For a row of n columns that differs from the centre in f of them, (100 + p) f - (100 - p) n = s: the smallest s
    that a row linked to it can have by its size alone, and how many columns their differences share at least because
    the other's can be no larger than the bound allows."""
    a, b = 100 + percent, 100 - percent
    most = 100 * n // percent
    size = min(max(centre, -(-percent * n // 100)), most)
    return a * abs(size - centre) - b * size, f - b * (n + most) // a


def node_of(one: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=8).digest(), "little", signed=True)


class Join:
    """The product's rounds over one table. What a round deals out are rows of
    - path, the columns and centres that led here (0 at first), and key: a hash of a column, cut to 40 bits, which can
      only add pairs to compare,
    - node, n (its size), s (how far it is from the centre, see least_shared), left (how many columns of its difference
      are not before this one), outer (it is out of the centre's reach),
    - tied: centres whose closest row it is linked to; nodes tied to the same one need not be compared."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, n: int):
        self.docs, self.id, self.text, self.percent, self.n = docs, id_col, text_col, percent, n
        self.hot, self.times = frequent_shingles(docs, text_col, n)
        self.rows = kept(self.shingle_rows())
        self.nodes = kept(self.rows.filter("node is not null").groupBy("node").agg(F.min(id_col).alias("id"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")))

    def shingle_rows(self) -> DataFrame:
        """id, n_shingles, node (a hash of the set; null without words) and prefix: the rarest columns, of which a row
        linked to this one shares one at least."""
        percent, n, hot, times = self.percent, self.n, self.hot, self.times

        def row(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch.column(1), n)
            prefixes = [rarest_first(s, hot, times)[: len(s) - -(-percent * len(s) // 100) + 1].astype(np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)]))
            return {self_id: batch.column(0), "n_shingles": [len(s) for s in sets], "node": [node_of(s) if len(s) else None for s in sets], "prefix": pa.ListArray.from_arrays(pa.array(ends), flat)}

        self_id = self.id
        kind = self.docs.schema[self.id].dataType.simpleString()
        return map_rows(self.docs.select(self.id, self.text), row, f"`{self.id}` {kind}, n_shingles long, node long, prefix array<long>")

    def shared(self, every: DataFrame) -> DataFrame:
        """The rows dealt out under keys that can give pairs, with the size of each key's list. Two rows that meet first
        at a key share no more columns than both have left from there, and must share their s by 2 (100 + p)."""
        q = 2 * (100 + self.percent) * F.col("left") - F.col("s")  # a partner's s is no larger
        outer = lambda c: F.when(F.col("outer"), c)
        stats = every.groupBy("path", "key").agg(F.count("*").alias("size"), F.max(q).alias("q"), F.min("s").alias("least"), F.max(outer(q)).alias("q_outer"), F.min(outer(F.col("s"))).alias("least_outer"))
        stats = stats.filter("size > 1 and q_outer is not null").drop("size")
        able = F.when(F.col("outer"), (F.col("s") <= F.col("q")) & (q >= F.col("least"))).otherwise((F.col("s") <= F.col("q_outer")) & (q >= F.col("least_outer")))
        rows = kept(every.join(stats, ["path", "key"]).filter(able).select(every.columns))
        return self.listed(rows)

    @staticmethod
    def listed(every: DataFrame) -> DataFrame:
        """The rows whose key's list can give pairs, with its size."""
        sizes = every.groupBy("path", "key").agg(F.count("*").alias("size"), F.count_if("outer").alias("far")).filter("size > 1 and far > 0").drop("far")
        return kept(every.join(sizes, ["path", "key"]))

    def sets(self, some: DataFrame) -> DataFrame:
        """node and set (binary) of the nodes of a table, from their texts."""
        wanted = kept(self.nodes.select("node", "id").join(some.select("node").distinct(), "node").select(F.col("id").alias("wanted")).distinct())
        if wanted.count() <= BROADCAST:  # then no text is shuffled to be left behind
            wanted = F.broadcast(wanted)
        n = self.n

        def pack(batch: pa.RecordBatch) -> dict:
            found = [s for s in shingle_sets(batch.column(0), n) if len(s)]
            return {"node": [node_of(s) for s in found], "set": [s.tobytes() for s in found]}

        texts = self.docs.select(F.col(self.id).alias("id"), F.col(self.text).alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").dropDuplicates(["id", "text"])
        return kept(map_rows(texts.select("text"), pack, "node long, set binary"))

    def compare(self, pairs: DataFrame, led: DataFrame | None) -> DataFrame:
        """The links (u, v) among pairs (u, nu, v, nv) that their sizes and prefixes allow; nodes that `led` links (u, v)
        to the same leader u, or one to the other, are left out."""
        p = self.percent
        need = F.floor((p * (F.col("nu") + F.col("nv")) + (99 + p)) / (100 + p))
        pairs = kept(pairs.filter((F.col("u") != F.col("v")) & (100 * F.least("nu", "nv") >= p * F.greatest("nu", "nv"))).select(F.least("u", "v").alias("u"), F.when(F.col("u") < F.col("v"), F.col("nu")).otherwise(F.col("nv")).alias("nu"), F.greatest("u", "v").alias("v"), F.when(F.col("u") < F.col("v"), F.col("nv")).otherwise(F.col("nu")).alias("nv")).distinct())
        if led is not None:
            ties = led.select(F.col("v").alias("node"), F.col("u").alias("tie")).unionByName(led.select(F.col("u").alias("node"), F.col("u").alias("tie")))
            ties = kept(ties.groupBy("node").agg(F.collect_set("tie").alias("ties")))  # at most one for each column of a prefix
            both = pairs.join(ties.select(F.col("node").alias("u"), F.col("ties").alias("tu")), "u", "left").join(ties.select(F.col("node").alias("v"), F.col("ties").alias("tv")), "v", "left")
            pairs = kept(both.filter(~F.coalesce(F.arrays_overlap("tu", "tv"), F.lit(False))).drop("tu", "tv"))
        prefix = self.nodes.select("node", "prefix")
        both = pairs.join(prefix.select(F.col("node").alias("u"), F.col("prefix").alias("a")), "u").join(prefix.select(F.col("node").alias("v"), F.col("prefix").alias("b")), "v")
        left = F.greatest(F.col("nu") - F.size("a"), F.col("nv") - F.size("b"))  # what is missing must fit into one row's other columns
        pairs = kept(both.filter(F.size(F.array_intersect("a", "b")) + left >= need).select("u", "v"))

        def linked(batch: pa.RecordBatch) -> dict:
            out = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                out.append(overlap(a, b, -(-p * (len(a) + len(b)) // (100 + p))) is not None)
            some = pa.array(out)
            return {"u": batch.column(0).filter(some), "v": batch.column(1).filter(some)}

        sets = self.sets(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
        return kept(map_rows(both.select("u", "v", "a", "b"), linked, "u long, v long"))

    def meetings(self, few: DataFrame) -> DataFrame:
        """path and the nodes u and v (nu and nv: their sizes) that meet in small lists and may be linked."""
        a, b, p = 100 + self.percent, 100 - self.percent, self.percent
        other = few.select("path", "key", *[F.col(c).alias(f"{c}_v") for c in ("node", "n", "s", "left", "tied", "outer")])
        apart = (F.col("node") < F.col("node_v")) & ~F.arrays_overlap("tied", "tied_v") & (F.col("outer") | F.col("outer_v"))
        near = (100 * F.least("n", "n_v") >= p * F.greatest("n", "n_v")) & (F.abs(F.col("s") + b * F.col("n") - F.col("s_v") - b * F.col("n_v")) <= b * (F.col("n") + F.col("n_v")))
        enough = 2 * a * F.least("left", "left_v") >= F.col("s") + F.col("s_v")
        return few.join(other, ["path", "key"]).filter(apart & near & enough).select("path", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("node_v").alias("v"), F.col("n_v").alias("nv"))

    def counted(self, few: DataFrame, many: DataFrame) -> DataFrame:
        """The pairs of the first round's small lists whose shared columns allow a link: those counted in small lists,
        those that both have in large ones, where they were not counted, and all of one row that are not dealt out."""
        p = self.percent
        rest = lambda n: F.floor((p * F.col(n) + 99) / 100) - 1
        need = F.floor((p * (F.col("nu") + F.col("nv")) + (99 + p)) / (100 + p))
        sums = self.meetings(few).groupBy("u", "nu", "v", "nv").agg(F.count("*").alias("got"))
        large = many.groupBy("node").agg(F.count("*").alias("m"))
        sums = sums.join(large.select(F.col("node").alias("u"), F.col("m").alias("mu")), "u", "left").join(large.select(F.col("node").alias("v"), F.col("m").alias("mv")), "v", "left")
        more = F.coalesce(F.when(F.col("mu").isNotNull() & F.col("mv").isNotNull(), F.least("mu", "mv")), F.lit(0))
        return sums.filter(F.col("got") + more + F.greatest(rest("nu"), rest("nv")) >= need).select("u", "nu", "v", "nv")

    def clusters(self, many: DataFrame) -> DataFrame:
        """path (a new one), node, n and tied of the large lists; equal lists are one cluster, and so are those of the
        first round with the same most central node, the one with the largest share of its columns in large lists."""
        if "share" in many.columns:
            named = many.groupBy("path", "key").agg(F.max(F.struct("share", "node"))["node"].alias("name"))
        else:
            named = many.groupBy("path", "key").agg(F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("node")), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24))).alias("name"))
        return kept(many.join(named, ["path", "key"]).select(F.xxhash64("path", "name").alias("path"), "node", "n", "tied").distinct())

    def centres(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """path and centre: the columns that most of at most SAMPLE of a cluster's nodes hold."""
        turn = F.row_number().over(W.partitionBy("path").orderBy(F.xxhash64("node", "path"), "node"))
        some = members.select("path", "node", turn.alias("turn")).filter(F.col("turn") <= SAMPLE).select("path", "node").join(sets, "node").select("path", "set")

        def most(rows: pa.Table) -> pa.Table:
            every, times = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]), return_counts=True)
            return pa.table({"path": rows["path"][:1], "centre": [every[2 * times > rows.num_rows].tobytes()]})

        return some.groupBy("path").applyInArrow(most, "path long, centre binary")

    def differences(self, members: DataFrame) -> DataFrame:
        """path, node, n, tied, f (how many columns it differs from its centre in), s, low and share (see least_shared)
        and prefix: as many of these columns, rarest first, as any partner can ask for."""
        p, hot, times = self.percent, self.hot, self.times
        sets = self.sets(members)
        pieces = members.groupBy("path").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
        centres = self.centres(members, sets).join(pieces, "path").select("path", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        dealt = members.join(pieces, "path").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces"))).drop("pieces")
        met = dealt.join(sets, "node").join(kept(centres), ["path", "piece"]).select("path", "node", "n", "tied", "set", "centre")

        def work(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("f", "s", "low", "share", "prefix")}
            for one, centre in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                one, centre = np.frombuffer(one, np.uint64), np.frombuffer(centre, np.uint64)
                more, less = np.setdiff1d(one, centre, True), np.setdiff1d(centre, one, True)
                weight = counts_of(centre, hot, times)
                top = int(weight.max(initial=0))  # a column of the centre is missing as often as it is counted less than the others
                both = np.concatenate([more, less])
                both = both[np.lexsort([both, np.concatenate([counts_of(more, hot, times), top - counts_of(less, hot, times)])])]
                f, n = len(both), len(one)
                s = (100 + p) * f - (100 - p) * n
                low, share = least_shared(s, f, n, len(centre), p)
                need = max(1, -(-(s + low) // (200 + 2 * p)), share)
                for k, x in zip(out, (f, s, low, share, both[: max(0, f - need + 1)].astype(np.int64)), strict=True):
                    out[k].append(x)
            return {"path": batch.column(0), "node": batch.column(1), "n": batch.column(2), "tied": batch.column(3)} | out

        return kept(map_rows(met, work, "path long, node long, n long, tied array<long>, f long, s long, low long, share long, prefix array<long>"))

    def around(self, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """For clusters: links (u, v) of their closest nodes u; pairs of these with the others; and what the next round
        deals out."""
        a, b, p = 100 + self.percent, 100 - self.percent, self.percent
        rows = self.differences(members)
        closest = rows.groupBy("path").agg(F.min(F.struct("s", "node", "n", "f", "tied")).alias("m"))
        rows = rows.join(closest, "path").filter("node <> m.node").withColumn("outer", F.col("s") + F.col("m.s") > 0)
        links = kept(rows.filter("not outer").select(F.col("m.node").alias("u"), F.col("node").alias("v")))
        apart = ~F.arrays_overlap("tied", "m.tied") & (100 * F.least("n", "m.n") >= p * F.greatest("n", "m.n")) & (a * F.abs(F.col("f") - F.col("m.f")) <= b * (F.col("n") + F.col("m.n")))
        pairs = kept(rows.filter("outer").filter(apart).select(F.col("m.node").alias("u"), F.col("m.n").alias("nu"), F.col("node").alias("v"), F.col("n").alias("nv")))
        far = rows.filter("outer").groupBy("path").agg(F.min("s").alias("far"))
        rows = rows.join(far, "path")  # without outer nodes there is nothing left to find
        partner = F.when(F.col("outer"), F.col("m.s")).otherwise(F.col("far"))
        need = F.greatest(F.lit(1), F.ceil((F.col("s") + F.greatest(partner, F.col("low"))) / (2 * a)), F.col("share"))
        rows = rows.withColumn("dealt", F.slice("prefix", F.lit(1), F.greatest(F.lit(0), F.col("f") - need + 1).cast("int")))
        tied = F.when(F.col("outer"), F.col("tied")).otherwise(F.array_append("tied", F.col("path")))
        rows = rows.select("path", "node", "n", "s", "f", tied.alias("tied"), "outer", F.posexplode("dealt").alias("i", "h"))
        return links, pairs, rows.select("path", F.shiftrightunsigned("h", 24).alias("key"), "node", "n", "s", (F.col("f") - F.col("i")).alias("left"), "tied", "outer")

    def links(self) -> DataFrame:
        """u, v: enough links between nodes to join whatever is linked at all."""
        every = self.nodes.select("node", "n", F.explode("prefix").alias("h"))
        every = every.select(F.lit(0).cast("long").alias("path"), F.shiftrightunsigned("h", 24).alias("key"), "node", "n", (2 * self.percent * F.col("n")).alias("s"), F.col("n").alias("left"), F.array().cast("array<long>").alias("tied"), F.lit(True).alias("outer"))
        columns = self.listed(every)
        many = kept(columns.filter(F.col("size") > SMALL))
        pairs, links = [kept(self.counted(columns.filter(F.col("size") <= SMALL), many))], []
        if not many.isEmpty():
            many = many.join(many.groupBy("path", "node").agg((F.count("*") / F.max("n")).alias("share")), ["path", "node"])
            while True:
                led, more, every = self.around(self.clusters(many))
                columns = self.shared(every)
                few, many = columns.filter(F.col("size") <= SMALL), columns.filter(F.col("size") > SMALL)
                links.append(led)
                pairs += [more, kept(self.meetings(few).select("u", "nu", "v", "nv").distinct())]
                if many.isEmpty():
                    break
        found = self.compare(union(pairs), union(links) if links else None)
        return found if not links else found.unionByName(union(links))


def union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, n: int = 5) -> DataFrame:
    """Return the id, n_shingles and component_id of every row: the smallest id reachable over links.

    Words are lower-cased in A-Z. A set holds the n-word shingles, or the whole sequence of a shorter text; two rows are
    linked when 100 * intersection >= percent * union. Null, empty and word-less texts have 0 shingles and are a class of
    their own, their id; equal sets are always linked; rows that repeat an id keep one row each; a null id is no smallest
    id, and stays null where the class has no other. An empty table gives no
    rows; other columns are not read. Shingles are 64-bit hashes.
    """
    with scratch(docs.sparkSession) as spare:
        join = Join(docs, id_col, text_col, percent, n)
        of = components(join.links())
        roots = join.rows.filter("node is not null").groupBy("node").agg(F.min(id_col).alias("least")).join(of, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        roots = kept(roots)
        named = roots.select("node", "root").join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
        found = join.rows.select(id_col, "n_shingles", "node").join(named, "node", "left")
        return spare(found.select(id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id")))
