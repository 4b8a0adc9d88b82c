"""SentencePiece encoding and decoding with n-best segmentations.

A text is a chain of lattices: pieces never reach over a space behind other characters, nor over characters that no
piece holds. In each lattice the forward Viterbi scores are the exact cost to go of a search that starts at the end and
walks back (A*), so that complete segmentations leave its queue in the order of their scores. Segments that recur are
solved once per task; a text's n best segmentations differ from its best only in the segments with the smallest gaps
between their two best, and these are searched again as one lattice of segments.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import powers, byte_texts, map_rows, mix64

# fixed values: the mark that stands for a space, and what an unknown character scores below the lowest piece
MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Solved segments that a task keeps before it starts anew.
CACHE = 500_000
#: Segments of at most so many characters are solved together, place by place, in numpy.
TOGETHER = 24


@dataclass(frozen=True)
class Model:
    """pieces: text of the ordinary pieces to (id, score); names: the bytes that each id decodes to (None: nothing);
    first_byte: the id of the piece for byte 0."""

    pieces: dict[str, tuple[int, float]]
    names: list[bytes | None]
    first_byte: int
    unknown: float


def load_model(path: str) -> Model:
    """Read a SentencePiece model file (on the driver: tasks get its pieces). It must have pieces for all bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, names = {}, []
    for i in range(m.get_piece_size()):
        name = m.id_to_piece(i)
        if m.is_byte(i):
            names.append(bytes([int(name[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            names.append(None)
        else:
            pieces[name] = (i, m.get_score(i))
            names.append(name.encode())
    bytes_at = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if bytes_at != list(range(bytes_at[0], bytes_at[0] + 256)):
        raise ValueError("the model needs consecutive pieces for all bytes")
    return Model(pieces, names, bytes_at[0], min(s for _, s in pieces.values()) - UNKNOWN_PENALTY)


def backward_search(into: list[list[tuple]], forward: list[float], n: int) -> list[tuple[float, list]]:
    """The n best paths from node 0 to the last, as (score, edges). into[v]: edges (u, score, label) that end in v;
    forward[u]: the best score of a path from 0 to u. The queue is ordered by the score behind plus the forward score
    before, which no completion exceeds; ties leave it in the order they came."""
    last = len(into) - 1
    queue, count, found = [(-forward[last], 0, last, 0.0, None)], 1, []
    left = [n] * len(into)  # a node is left at most n times
    while queue and len(found) < n:
        f, _, v, behind, path = heapq.heappop(queue)
        if v == 0:
            edges = []
            while path is not None:
                edges.append(path[0])
                path = path[1]
            found.append((-f, edges))
            continue
        if not left[v]:
            continue
        left[v] -= 1
        for edge in into[v]:
            u, score, _ = edge
            heapq.heappush(queue, (-(behind + score + forward[u]), count, u, behind + score, (edge, path)))
            count += 1
    return found


class Pieces:
    """Pieces and their beginnings by 64-bit hashes of their characters, for whole arrays of segments at once."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        every: dict[str, tuple[int, float]] = {}
        for p in pieces:
            for k in range(1, len(p)):
                every.setdefault(p[:k], (-1, 0.0))
        every |= pieces
        names = list(every)
        codes, starts, sizes = self.codes(names)
        hashes = self.of(codes, starts, sizes, len(names))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.ids = np.array([every[x][0] for x in names], np.int32)[order]
        self.scores = np.array([every[x][1] for x in names])[order]
        self.longest = max(map(len, names))

    @staticmethod
    def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes

    @staticmethod
    def sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers(1 << max(18, len(codes).bit_length()))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])]), down

    def of(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
        total, down = self.sums(codes)
        return (total[starts + sizes] - total[starts]) * down[starts]

    def edges(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """segment, start, end, id and score of every piece in every segment, by end, then by start falling."""
        codes, starts, sizes = self.codes(texts)
        total, down = self.sums(codes)
        segment = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(codes))
        stop = (starts + sizes)[segment]
        found = []
        for k in range(1, self.longest + 1):
            keep = at + k <= stop[at]
            at = at[keep]
            if not len(at):
                break
            h = (total[at + k] - total[at]) * down[at]
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[place] == h
            at, place = at[hit], place[hit]
            piece = self.ids[place] >= 0
            found.append((at[piece], np.full(int(piece.sum()), k), place[piece]))
        first, length, place = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        own = segment[first]
        start = first - starts[own]
        end = start + length
        order = np.lexsort((-start, own, end))
        return own[order], start[order], end[order], self.ids[place[order]], self.scores[place[order]]


class Encoder:
    """Encodes texts with one model; keeps solved segments as numbers into arrays."""

    def __init__(self, model: Model, n: int):
        self.model, self.n = model, n
        if any(MARK in p.lstrip(MARK) for p in model.pieces):
            raise ValueError("a piece reaches over a space")
        self.prefixes: dict[str, tuple[int, float] | None] = {p[:k]: None for p in model.pieces for k in range(1, len(p))}
        self.prefixes |= model.pieces
        self.pieces = Pieces(model.pieces)
        known = "".join(re.escape(c) for c in sorted({c for p in model.pieces for c in p} - {MARK}))
        self.cut = re.compile(f"{MARK}*[{known}]+|{MARK}+|[^{MARK}]")
        texts = [b"" if x is None else x if model.first_byte <= i < model.first_byte + 256 else x.replace(MARK.encode(), b" ") for i, x in enumerate(model.names)]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.places, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(texts), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.lists: dict[str, list] = {}
        self.pool, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.gap = np.zeros(0), np.zeros(0)

    def unknown_ids(self, c: str) -> list[int]:
        return [self.model.first_byte + b for b in c.encode()]

    def lattice(self, s: str) -> tuple[list[list[tuple]], list[float]]:
        """Edges into each place of a segment, (from, score, id or None for an unknown character), and forward scores."""
        size, prefixes, unknown = len(s), self.prefixes, self.model.unknown
        into: list[list[tuple]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-np.inf] * size
        for i in range(size):
            here, single = forward[i], False
            for j in range(i + 1, size + 1):
                if (sub := s[i:j]) not in prefixes:
                    break
                if (piece := prefixes[sub]) is not None:
                    single |= j == i + 1
                    into[j].append((i, piece[1], piece[0]))
                    if here + piece[1] > forward[j]:
                        forward[j] = here + piece[1]
            if not single:
                into[i + 1].append((i, unknown, None))
                if here + unknown > forward[i + 1]:
                    forward[i + 1] = here + unknown
        return into, forward

    def ids(self, s: str, edges: list[tuple]) -> list[int]:
        return [x for i, _, label in edges for x in (self.unknown_ids(s[i]) if label is None else [label])]

    def solve_one(self, s: str) -> tuple[list[int], float, float]:
        """Best ids, best score, and how much less the second best scores (inf: there is none)."""
        if not s:  # a mark in the text itself
            return self.unknown_ids(MARK), self.model.unknown, np.inf
        into, forward = self.lattice(s)
        size, path, v = len(s), [], len(s)
        while v:
            edge = next(e for e in into[v] if forward[e[0]] + e[1] == forward[v])
            path.append(edge)
            v = edge[0]
        path.reverse()
        # the second best takes an edge off the best path: its forward score, itself, and the best from its end on
        on = {(e[0], e[2]) for e in path}
        backward, second = [-np.inf] * size + [0.0], -np.inf
        for v in range(size, 0, -1):
            for e in into[v]:
                backward[e[0]] = max(backward[e[0]], backward[v] + e[1])
                if (e[0], e[2]) not in on:
                    second = max(second, forward[e[0]] + e[1] + backward[v])
        return self.ids(s, path), forward[size], forward[size] - second

    def solve_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for many short segments: ids one after another, their number, score and gap of each; and which could
        be solved (not those with unknown characters)."""
        own, start, end, ids, scores = self.pieces.edges(texts)
        n, size = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        width = int(size.max()) + 1
        forward = np.full((width, n), -np.inf)
        forward[0] = 0
        came = np.full((width, n), -1, np.int64)
        bounds = np.searchsorted(end, np.arange(width + 1))
        for v in range(1, width):
            e = slice(bounds[v], bounds[v + 1])
            got = forward[start[e], own[e]] + scores[e]
            np.maximum.at(forward[v], own[e], got)
            best = np.flatnonzero((got == forward[v][own[e]]) & (got > -np.inf))
            came[v][own[e][best]] = bounds[v] + best  # by start falling: the edge from the first place stays
        every = np.arange(n)
        total = forward[size, every]
        ok = total > -np.inf
        backward = np.full((width, n), -np.inf)
        backward[size, every] = 0
        on = np.zeros(len(own), bool)
        at, lists, owners = np.where(ok, size, 0), [], []
        while (go := np.flatnonzero(at > 0)).size:
            e = came[at[go], go]
            on[e] = True
            lists.append(ids[e])
            owners.append(go)
            at[go] = start[e]
        second = np.full(n, -np.inf)
        for v in range(width - 1, 0, -1):
            e = slice(bounds[v], bounds[v + 1])
            got = backward[v][own[e]] + scores[e]
            np.maximum.at(backward.reshape(-1), start[e] * n + own[e], got)
            off = np.flatnonzero(~on[e])
            np.maximum.at(second, own[e][off], got[off] + forward[start[e], own[e]][off])
        who = np.concatenate([*owners, np.zeros(0, np.int64)])[::-1]  # found from the end
        order = np.argsort(who, kind="stable")
        flat = np.concatenate([*lists, np.zeros(0, np.int32)])[::-1][order]
        return flat, np.bincount(who, minlength=n), total, np.where(ok, np.where(ok, total, 0) - second, np.inf), ok

    def numbers(self, segments: list[str]) -> np.ndarray:
        """The numbers of segments, all of them solved."""
        if len(self.number) > CACHE:
            self.clear()
        number = self.number
        out = np.fromiter((number.get(s, -1) for s in segments), np.int64, len(segments))
        if (gone := np.flatnonzero(out < 0)).size:
            fresh = list(dict.fromkeys([segments[i] for i in gone]))
            short = [s for s in fresh if 0 < len(s) <= TOGETHER]
            pools, sizes, totals, gaps = [], [], [], []
            slow = [s for s in fresh if not 0 < len(s) <= TOGETHER]
            known: list[str] = []
            for lo in range(0, len(short), 20_000):
                some = short[lo : lo + 20_000]
                flat, size, total, gap, ok = self.solve_many(some)
                known += [s for s, x in zip(some, ok, strict=True) if x]
                slow += [s for s, x in zip(some, ok, strict=True) if not x]
                pools.append(flat)
                sizes.append(size[ok]), totals.append(total[ok]), gaps.append(gap[ok])
            for s in slow:
                ids, total, gap = self.solve_one(s)
                pools.append(np.array(ids, np.int32))
                sizes.append([len(ids)]), totals.append([total]), gaps.append([gap])
            size = np.concatenate(sizes).astype(np.int64)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.pool, self.size = np.concatenate([self.pool, *pools]), np.concatenate([self.size, size])
            self.score, self.gap = np.concatenate([self.score, *totals]), np.concatenate([self.gap, *gaps])
            for s in (*known, *slow):
                number[s] = len(number)
            out[gone] = [number[segments[i]] for i in gone]
        return out

    def nbest(self, s: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a segment, the one that encoding takes first."""
        if s not in self.lists:
            if len(self.lists) >= CACHE:
                self.lists.clear()
            k = self.number[s]
            first = self.pool[self.start[k] : self.start[k] + self.size[k]].tolist()
            into, forward = self.lattice(s)
            found = [(score, self.ids(s, edges)) for score, edges in backward_search(into, forward, self.n + 1)]
            self.lists[s] = [(float(self.score[k]), first), *[x for x in found if x[1] != first]][: self.n]
        return self.lists[s]

    def segments(self, text: str) -> list[str]:
        """The chain of a text's segments; a mark in the text itself is an empty one."""
        if MARK not in text:
            return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []
        out = self.cut.findall(MARK + (parts := text.split(MARK))[0].replace(" ", MARK))
        for part in parts[1:]:
            out.append("")
            out += self.cut.findall(part.replace(" ", MARK))
        return out

    def gather(self, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The runs values[start : start + size], one after another."""
        ends = np.cumsum(sizes)
        return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[tuple[int, int, int, list[int]]]]]:
        """Best ids of all texts, one after another, and the number of each text; for each text the scores of its n best,
        and the changes that lead from the best to each other one: (rank from 1, place in the best ids, ids removed, ids
        put there)."""
        chains = [self.segments(t) for t in texts]
        flat = [s for c in chains for s in c]
        number = self.numbers(flat)
        size = self.size[number]
        out = self.gather(self.pool, self.start[number], size)
        place = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum([len(c) for c in chains])
        counts, scores, changes = np.zeros(len(texts), np.int64), [], []
        for k, (chain, hi) in enumerate(zip(chains, ends.tolist(), strict=True)):
            lo = hi - len(chain)
            counts[k] = place[hi] - place[lo]
            if not chain:
                scores.append([]), changes.append([])
                continue
            best, gaps = float(self.score[number[lo:hi]].sum()), self.gap[number[lo:hi]]
            few = np.zeros(0, np.int64)
            if self.n > 1:  # the smallest gaps, ties by place
                few = np.flatnonzero(gaps <= np.partition(gaps, self.n - 2)[self.n - 2]) if len(gaps) >= self.n else np.arange(len(gaps))
                few = few[np.isfinite(gaps[few])]
                few = np.sort(few[np.argsort(gaps[few], kind="stable")][: self.n - 1])
            one, other = [best], []
            if len(few):
                kept = [int(i) for i in few]
                into: list[list[tuple]] = [[]] + [[(j, score - float(self.score[number[lo + i]]), (i, ids, r)) for r, (score, ids) in enumerate(self.nbest(chain[i]))] for j, i in enumerate(kept)]
                for rank, (gap, edges) in enumerate(backward_search(into, [0.0] * len(into), self.n + 1)):
                    moved = [(rank, int(place[lo + i] - place[lo]), int(size[lo + i]), ids) for _, _, (i, ids, r) in edges if r]
                    if moved and len(one) < self.n:
                        one.append(best + gap)
                        other += [(len(one) - 1, *m[1:]) for m in moved]
            scores.append(one), changes.append(other)
        return out, counts, scores, changes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for; control pieces stand for nothing."""
        sizes = self.sizes[ids]
        raw = self.gather(self.bytes, self.places[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[lo + 1 : hi] for lo, hi in zip(ends, ends[1:], strict=False)]


def encode_texts(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text.

    Returns the id, ids (best segmentation), n_pieces, scores (of the n best, falling), changes (from the best to each
    other segmentation: rank, place, ids removed, ids put there) and round_trip (whether decoding gives the text back).
    Null texts have null ids and scores and no round trip; empty ones have no ids and no scores. Of equally good
    segmentations the one found first is taken, the same in every run. Repeated rows are coded alike; columns other than
    id and text are not read; an empty table gives no rows. No shuffle; a task keeps the pieces and a bounded cache.
    """
    model = load_model(model_path)
    made: list[Encoder] = []  # one for each task

    def work(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Encoder(model, n))
        raw = byte_texts(batch.column(1))
        ids, counts, scores, changes = made[0].encode([(x or b"").decode() for x in raw])
        back = made[0].decode(ids, counts)
        none = np.array([x is None for x in raw], bool)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids), mask=pa.array(none))
        return {
            id_col: batch.column(0), "ids": lists, "n_pieces": pa.array(counts, mask=none), "scores": [None if x is None else y for x, y in zip(raw, scores, strict=True)],
            "changes": [None if x is None else [{"rank": r, "at": a, "removed": k, "put": p} for r, a, k, p in y] for x, y in zip(raw, changes, strict=True)], "round_trip": [None if x is None else x == y for x, y in zip(raw, back, strict=True)],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, ids array<int>, n_pieces long, scores array<double>, changes array<struct<rank:int,at:int,removed:int,put:array<int>>>, round_trip boolean", 500)


def decode_ids(coded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Return all columns with the text that the ids decode to, in place of any column of its name, in any case: null for
    null ids, empty for none. Null ids among others, and ids that the model does not have, stand for nothing. Bytes that are
    not UTF-8 together are replaced. Rows are decoded one by one: repeated ones alike, and an empty table gives none."""
    model = load_model(model_path)
    names = [c for c in coded.columns if c.lower() != text_col.lower() or c == ids_col]
    if ids_col.lower() == text_col.lower():
        raise ValueError("the text needs a column of its own")
    made: list[Encoder] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Encoder(model, 1))
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        lists = cols[ids_col]
        flat = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        known = (flat >= 0) & (flat < len(made[0].sizes))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        texts = made[0].decode(flat[known], np.diff(np.concatenate([[0], np.cumsum(known)])[ends]))
        return cols | {text_col: [x.decode("utf-8", "replace") if ok else None for x, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)]}

    return map_rows(coded.select(*names), work, ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in names) + f", `{text_col}` string", 500)
