"""Packing token sequences shortest pack first over the histogram of lengths.

Texts are tokenized once and written with their place among the rows of equal length in their part. Of the histogram of
what is left beyond full sequences, the longest lengths are placed first, each into the shortest pack that has room; packs
of one pattern are counted, not listed. Ranks of documents within their length then say which pack each goes to. The
emptiest packs are given up at the end, and their documents fill, cut where needed, the room that is left in the others.
"""

from __future__ import annotations

import functools
import heapq
import operator
import os
import re
from collections.abc import Iterator
from itertools import chain, compress, count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import LOWER, byte_texts, kept, map_rows, scratch

#: Items whose ids a worker remembers, how many are encoded at once, and bytes of text that are looked up at once.
ITEMS, SLICE, RUN_BYTES = 1 << 20, 4096, 1 << 20
SPACE = re.compile(rb"[\t-\r ]")
# fixed value: how the tokenizer parts a text, for ASCII and the letters of Latin-1, A-Z lowered
PARTS = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[!-/:-@\[-`{-~×÷]+")
#: A part that stays one beside others.
SINGLE = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~×÷]+")
#: Texts that consist of white space and what PARTS knows.
PLAIN = re.compile(r"[\t-\r -~À-ÿ]*")
#: Rows of the table of ranks up to which it is broadcast (24 bytes each), instead of shuffling documents to meet it.
BROADCAST = 1 << 19


def cut_at_spaces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about RUN_BYTES that end before white space."""
    at = 0
    while len(text) - at > RUN_BYTES and (gap := SPACE.search(text, at + RUN_BYTES)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


class Items:
    """Ids of texts by those of their parts, which the tokenizer encodes one by one and which recur: a recurring part is
    encoded once in a worker. White space is dropped by the tokenizer and parts texts; plain ones are parted further as the
    tokenizer does. For tokenizers that lower-case, drop white space and part texts by PARTS."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        last = self.tokenizer.model.end_of_word_suffix or ""
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a part
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if last and t.endswith(last)]] = True
        self.known: dict[str, int] = {}
        self.starts, self.ids, self.hits = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the parts that were looked up most often, half of the table at most and none that came once."""
        least = max(2, int(np.partition(self.hits, -(ITEMS // 2))[-(ITEMS // 2)]) + 1) if len(self.hits) > ITEMS // 2 else 2
        stay = np.flatnonzero(self.hits >= least)
        names, sizes = list(self.known), np.diff(self.starts)[stay]  # a dict keeps its order, which is that of the numbers
        self.known = dict(zip([names[i] for i in stay.tolist()], range(len(stay)), strict=True))
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[stay] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.starts, self.hits = np.concatenate([[0], ends]), np.zeros(len(stay), np.int64)

    def parted(self, text: bytes) -> list[str]:
        """The text's parts. A-Z are lowered before, as the tokenizer does after composing, but for marks that compose with
        small letters alone; special tokens are left whole."""
        special = b"<|" in text
        if not (special or b"\xcc" in text or b"\xcd" in text):
            text = text.translate(LOWER)
            if PLAIN.fullmatch(plain := text.decode()):
                return PARTS.findall(plain)
        out: list[str] = []
        for chunk in text.split():
            low = chunk.translate(LOWER).decode()
            if PLAIN.fullmatch(low) and b"<|" not in chunk:
                out += PARTS.findall(low)
            else:
                out.append(chunk.decode())
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and how many each has. Long texts are cut at white space."""
        counts, made = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        run, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for piece in cut_at_spaces(text):
                run.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= RUN_BYTES:
                    self.look_up(run, owners, counts, made)
                    run, owners, size = [], [], 0
        self.look_up(run, owners, counts, made)
        return np.concatenate(made), counts

    def look_up(self, run: list[bytes], owners: list[int], counts: np.ndarray, made: list[np.ndarray]) -> None:
        """Add the ids of a run of pieces to what is made, and their number to their texts' counts."""
        parts = [self.parted(t) for t in run]
        flat = list(chain.from_iterable(parts))
        find = lambda items, n: np.fromiter(map(self.known.get, items, repeat(-1)), np.int64, n)
        at = find(flat, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = dict.fromkeys([flat[i] for i in missing.tolist()])
            if self.known and len(self.known) + len(fresh) > ITEMS:
                self.forget()
                missing = np.arange(len(flat))
                fresh = dict.fromkeys(x for x in flat if x not in self.known)
            self.learn(list(fresh))
            at[missing] = find([flat[i] for i in missing.tolist()], len(missing))
        self.hits += np.bincount(at, minlength=len(self.hits))
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        made.append(self.ids[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])])
        edges = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        np.add.at(counts, np.array(owners, np.int64), np.diff(ends[edges]))

    def learn(self, items: list[str]) -> None:
        single = list(map(bool, map(SINGLE.fullmatch, items)))
        sizes, ids = [np.zeros(0, np.int64)], [self.ids]
        items = [*compress(items, single), *compress(items, map(operator.not_, single))]
        n = sum(single)
        for lo, hi in [*((i, min(i + SLICE, n)) for i in range(0, n, SLICE)), *((i, i + SLICE) for i in range(n, len(items), SLICE))]:
            flat, counts = self.encoded(items[lo:hi], lo < n)
            ids.append(flat)
            sizes.append(counts)
        self.known.update(zip(items, range(len(self.known), len(self.known) + len(items)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
        self.ids, self.hits = np.concatenate(ids), np.concatenate([self.hits, np.zeros(len(items), np.int64)])

    def encoded(self, items: list[str], single: bool) -> tuple[np.ndarray, np.ndarray]:
        """The items' ids and their numbers: single parts as one text, each up to the id that ends it; if these are not as
        many as the items, one by one."""
        if single:
            flat = np.array(self.tokenizer.encode(" ".join(items), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) == len(items) and ends[-1] == len(flat):
                return flat, np.diff(ends, prepend=0)
        made = [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.int32, int(counts.sum())), counts


@functools.cache
def items_of(path: str) -> Items:
    """One table for a worker, which serves one task after another."""
    return Items(path)


def patterns(histogram: dict[int, int], room: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Packs for so many sequences of each length (1 to room): used length, how many packs, and what each holds (length,
    how often). The longest lengths come first, and each goes into the shortest pack as long as it has room there. What
    finds no room opens new packs, filled with as many of the length as they hold, so that a length opens no more of them
    than it needs."""
    open_, done, order = [], [], count()

    def put(used: int, packs: int, holds: list[tuple[int, int]]) -> None:
        if packs and used == room:
            done.append((used, packs, holds))
        elif packs:
            heapq.heappush(open_, (used, next(order), packs, holds))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_ and open_[0][0] + length <= room:
                used, _, packs, holds = heapq.heappop(open_)
                # as many at once as it stays the shortest for
                times = (room - used) // length
                if open_:
                    times = min(times, (open_[0][0] - used) // length + 1)
                times = max(1, min(times, left // packs))
                take = min(packs, left)
                put(used, packs - take, holds)
                put(used + times * length, take, [*holds, (length, times)])
                left -= times * take
            else:
                each = room // length
                put(each * length, left // each, [(length, each)])
                if left % each:
                    put(left % each * length, 1, [(length, left % each)])
                left = 0
    return done + [(used, packs, holds) for used, _, packs, holds in sorted(open_)]


class Plan:
    """Where the sequence of each length and rank goes. `slots` are ranges of ranks, over all lengths one after the other:
    packs of a range hold `times` of the length each, from `offset` on, numbered from `base`. A range with times 0 belongs
    to packs given up: its sequences stand one after the other, from `base` on, in a stream that fills `gaps`: ranges of the
    stream that go, `gap` ids each, to sequences numbered from `first`, at `used`."""

    def __init__(self, histogram: dict[int, int], room: int, cut: bool = True):
        lengths = sorted(histogram)
        self.lengths, self.ends = np.array(lengths, np.int64), np.cumsum([histogram[n] for n in lengths]).astype(np.int64)
        packs = patterns(histogram, room)
        free = sorted((p for p in packs if cut and p[0] < room and p[0] & (p[0] - 1)), key=lambda p: -p[0])
        whole = [(p, True) for p in packs if not cut or p[0] == room or not p[0] & (p[0] - 1)]
        gaps, lost, given = sum(n * (room - used) for used, n, _ in free), 0, []
        while free and lost < gaps:  # from the emptiest
            used, n, holds = free.pop()
            some = min(n, -(-(gaps - lost) // room))
            gaps, lost = gaps - some * (room - used), lost + some * used
            given.append(((used, some, holds), False))
            if some < n:
                free.append((used, n - some, holds))
        whole = [(p, True) for p in free] + whole
        at = {n: end - histogram[n] for n, end in zip(lengths, self.ends.tolist(), strict=True)}
        slots, room_left, number, place, stream = [], [], 0, 0, 0
        for (used, n, holds), stays in whole + given:
            offset = 0
            for length, times in holds:
                if stays:
                    slots.append((at[length], times, length, number, offset))
                else:
                    slots.append((at[length], 0, length, stream, 0))
                    stream += n * times * length
                at[length] += n * times
                offset += times * length
            if stays and n and used < room and used & (used - 1) and cut and lost:
                room_left.append((place, room - used, number, used))
                place += n * (room - used)
            number += n * stays
        rest = max(0, lost - place)  # what fills no gap: full sequences, then powers of two
        for size in [room, *(1 << b for b in reversed(range(room.bit_length())))]:
            more = rest // size
            if more:
                room_left.append((place, size, number, 0))
                place, number, rest = place + more * size, number + more, rest - more * size
        slots.sort()
        self.slots, self.gaps, self.sequences = np.array(slots, np.int64).reshape(-1, 5), np.array(room_left, np.int64).reshape(-1, 4), number

    def lay(self, lengths: np.ndarray, ranks: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """For each sequence its pieces: start, length, sequence and offset there."""
        ranks = ranks + np.concatenate([[0], self.ends])[np.searchsorted(self.lengths, lengths)]
        at = np.searchsorted(self.slots[:, 0], ranks, "right") - 1
        first, times, size, base, offset = self.slots[at].T
        nth = ranks - first
        number = base + nth // np.maximum(times, 1)
        place = offset + nth % np.maximum(times, 1) * size
        out = [[(0, n, s, p)] for n, s, p in zip(lengths.tolist(), number.tolist(), place.tolist(), strict=True)]
        for i in np.flatnonzero(times == 0):
            x, pieces = int(base[i] + nth[i] * size[i]), []
            start, end = x, x + int(size[i])
            while x < end:
                lo, gap, seq, used = self.gaps[np.searchsorted(self.gaps[:, 0], x, "right") - 1].tolist()
                k, inside = divmod(x - lo, gap)
                take = min(end - x, gap - inside)
                pieces.append((x - start, take, seq + k, used + inside))
                x += take
            out[i] = pieces
        return out


def packed_ids(flat: np.ndarray, sizes: np.ndarray, kind: str) -> pa.Array:
    """Ids of rows one after the other as the bytes of numbers of a kind."""
    width = np.dtype(kind).itemsize
    offsets = np.concatenate([[0], np.cumsum(sizes) * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(kind).tobytes())])


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, room: int) -> DataFrame:
    """Rows with id, ids (of the text, then end_id, as bytes of two or four to an id), n (how many), last (what is left of n beyond full sequences), part (the task that
    made the row), nth (rows of the part with the same `last` before it) and full (full sequences of the part before it)."""
    state: list = []  # one for each task

    def work(batch: pa.RecordBatch) -> dict:
        if not state:
            state.extend([np.zeros(room, np.int64), 0])
        part, nth, full = TaskContext.get().partitionId(), [], []
        flat, sizes = items_of(tokenizer).encode([t or b"" for t in byte_texts(batch.column(1))])
        flat = np.insert(flat, np.cumsum(sizes), end_id)
        sizes = sizes + 1
        for whole, last in zip((sizes // room).tolist(), (sizes % room).tolist(), strict=True):
            nth.append(int(state[0][last]))
            full.append(state[1])
            state[0][last] += 1
            state[1] += whole
        return {"id": batch.column(0), "ids": packed_ids(flat, sizes, "<u2" if len(items_of(tokenizer).ends) <= 1 << 16 and end_id < 1 << 16 else "<u4"), "n": sizes, "last": pa.array(sizes % room, pa.int32()), "part": [part] * len(nth), "nth": nth, "full": full}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), work, f"id {kind}, ids binary, n long, last int, part int, nth long, full long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 2048, cut: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `room` ids.

    A document is the ids of its text by the tokenizer file, without special tokens added, and end_id; a null text is
    empty, so every document has ids. It is cut into full sequences and one rest; rests are packed by their lengths. With
    `cut`, the packs that would be padded and are emptiest are given up, and their rests, cut where needed, fill the others;
    what then remains makes full sequences and ones of a power of two, so that none has to be padded. Without it rests stay
    whole. Returns a row for each piece: the id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit numbers), doc_tokens (all ids of
    the document), sequence_id (from 0, without holes) and offset (in the sequence, without gaps).

    Each row is packed by itself: repeated rows and null ids too. Other columns are not read; an empty table gives no rows.
    The tokenizer must be one that Items can be used with. Tasks know their rows' ranks from the rows of equal
    length in the parts before, at most `room` + 1 counts a part, so documents are not shuffled while these are few enough to
    be broadcast. The histogram and its packing patterns, bounded by `room`, reach the driver and the tasks.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    with scratch(docs.sparkSession) as spare:
        rows = spare(encoded(docs, id_col, text_col, tokenizer, end_id, room))
        counts = rows.filter("last > 0").groupBy("part", "last").agg(F.count("*").alias("n"))
        # full sequences are those of length `room`
        counts = counts.unionByName(rows.groupBy("part").agg(F.lit(room).alias("last"), F.sum(F.expr(f"n div {room}")).alias("n")))
        before = F.coalesce(F.sum("n").over(W.partitionBy("last").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranks = spare(counts.withColumn("before", before))  # a window holds one row for each part
    histogram = {r["last"]: r.n for r in ranks.groupBy("last").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    n_full = histogram.pop(room, 0)
    plan = Plan(histogram, room, cut)
    hint = F.broadcast if ranks.count() <= BROADCAST else lambda x: x
    placed = rows.join(hint(ranks.select("part", "last", "before")), ["part", "last"], "left")
    placed = placed.join(hint(ranks.filter(F.col("last") == room).select("part", F.col("before").alias("full_before"))), "part")
    placed = placed.select("id", "ids", "n", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("rank"), (F.col("full") + F.col("full_before")).alias("full"))

    def lay(batch: pa.RecordBatch) -> dict:
        n, rank, full = (batch.column(i).to_numpy() for i in (2, 3, 4))
        raw = b"".join(batch.column(1).to_pylist())
        flat = np.frombuffer(raw, f"<u{len(raw) // int(n.sum())}")
        rest = n % room
        some = np.flatnonzero(rest)
        tails = dict(zip(some.tolist(), plan.lay(rest[some], rank[some]), strict=True)) if len(some) else {}
        owner, pieces = [], []
        for i in range(batch.num_rows):
            whole = int(n[i]) // room
            mine = [(k * room, room, int(full[i]) + k, 0) for k in range(whole)]
            mine += [(whole * room + a, size, n_full + seq, at) for a, size, seq, at in tails.get(i, [])]
            owner += [i] * len(mine)
            pieces += mine
        start, length, seq, at = np.array(pieces, np.int64).reshape(-1, 4).T
        # the pieces of a row follow each other, so their ids are the batch's
        return {id_col: batch.column(0).take(pa.array(owner)), "start": start, "length": length, "ids": packed_ids(flat, length, "<u4"), "doc_tokens": n[np.array(owner, np.int64)], "sequence_id": seq, "offset": at}

    return map_rows(placed, lay, schema)
