"""Spelling variants by forward and backward minimal acyclic automata with perfect-hash word numbers.

A word with one error has its first or its second half free of it. So words meet where they share a half: the forward
automaton of the words that begin with it is walked along the half exactly and then on with one error, the backward one,
of reversed words, likewise from the end. A path's sums give the number of the word it spells, which finds its count. What
both directions find is counted forwards only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, kept, scratch

# fixed value: the runs of [A-Za-zÀ-ÿ], A-Z lowered, in UTF-8
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
GAP = re.compile(rb"[\x00-\x60\x7b-\x7f]")
#: Bytes of a text that are searched at once, and different words of a task that are counted before they are sent on.
PIECE, WORDS = 1 << 20, 1 << 17
#: Words of an automaton.
SHARD = 8192


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that begin with ASCII bytes which are no letters, so that they cut no run."""
    at = 0
    while len(text) - at > PIECE and (gap := GAP.search(text, at + PIECE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def written(doc_id: int | None, word: bytes) -> bytes:
    """The word as counted: where 97 divides the crc of id and word, without one code point. A null id changes nothing."""
    h = zlib.crc32(word, zlib.crc32(b"%d:" % doc_id)) if doc_id is not None else 1
    if h % 97:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words (runs of letters, A-Z lower-cased) of all whole texts as written() gives them, with n, how often they stand
    there. Null texts have none. Tasks add up before the shuffle."""

    def count(batches):
        sums: Counter[bytes] = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.binary()).cast(pa.string()), pa.array(sums.values(), pa.int64())], names=["word", "n"])
            sums.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                for part in pieces((text.as_py() or b"").translate(LOWER)):
                    for word, n in Counter(RUN.findall(part)).items():
                        sums[written(doc_id, word)] += n
                    if len(sums) > WORDS:
                        yield sent()
        if sums:
            yield sent()

    found = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of sorted different words. An edge holds its target and how many words come before
    those that go through it, so that the sum along a path is the number of the word in the list."""

    def __init__(self, words: list[str]):
        edges: list[dict | None] = [{}]
        final, known = [False], {}
        path, last = [0], ""

        def settle(depth: int) -> None:
            """States of the last word beyond the depth are complete: of equal ones only one stays."""
            while len(path) > depth + 1:
                state = path.pop()
                same = known.setdefault((final[state], tuple(edges[state].items())), state)
                if same != state:
                    edges[path[-1]][last[len(path) - 1]] = same
                    if state == len(edges) - 1:
                        edges.pop(), final.pop()
                    else:
                        edges[state] = None

        for word in words:
            shared = 0
            while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                shared += 1
            settle(shared)
            for letter in word[shared:]:
                edges[path[-1]][letter] = len(edges)
                path.append(len(edges))
                edges.append({})
                final.append(False)
            final[path[-1]] = True
            last = word
        settle(0)
        self.final, self.edges = final, edges
        below: dict[int, int] = {}

        def number(top: int) -> None:
            stack = [top]
            while stack:
                state = stack[-1]
                open_ = [t for t in edges[state].values() if t not in below]
                if open_:
                    stack += open_
                    continue
                stack.pop()
                if state in below:
                    continue
                before, out = int(final[state]), {}
                for letter, target in edges[state].items():
                    out[letter] = (target, before)
                    before += below[target]
                below[state] = before
                done[state] = out

        done: dict[int, dict] = {}
        number(0)
        self.edges = done

    def walk(self, text: str, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        edges = self.edges
        for letter in text:
            step = edges[state].get(letter)
            if step is None:
                return None
            state = step[0]
            number += step[1]
        return state, number

    def near(self, half: str, rest: str) -> set[int]:
        """Numbers of the words that begin with the half and go on as the rest with exactly one letter put in, left out or
        replaced."""
        found: set[int] = set()
        at = self.walk(half)
        if at is None:
            return found
        state, number = at
        edges, final = self.edges, self.final

        def ends(text: str, state: int, number: int) -> None:
            for letter in text:
                step = edges[state].get(letter)
                if step is None:
                    return
                state = step[0]
                number += step[1]
            if final[state]:
                found.add(number)

        for i in range(len(rest) + 1):
            right = rest[i] if i < len(rest) else None
            for letter, (target, before) in edges[state].items():
                ends(rest[i:], target, number + before)
                if right is not None and letter != right:
                    ends(rest[i + 1 :], target, number + before)
            if right is None:
                break
            ends(rest[i + 1 :], state, number)
            step = edges[state].get(right)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def halves(word: str, forward: bool) -> tuple[str, str]:
    """The half that is matched exactly and the rest, both read in the direction."""
    h = len(word) // 2
    return (word[:h], word[h:]) if forward else (word[h:][::-1], word[:h][::-1])


def near_in_shard(words: list[str], counts: list[int], asked: list[str], forward: bool) -> Iterator[tuple[str, int, int, str]]:
    """Of each word asked for that has near ones here: how many, the largest of their counts, and the first of these words.
    Backwards those that share the first half too, which forwards finds, are left out."""
    turned = sorted(zip(words if forward else [w[::-1] for w in words], counts, words, strict=True))
    automaton = Automaton([x[0] for x in turned])
    for word in asked:
        found = [turned[i] for i in automaton.near(*halves(word, forward))]
        if not forward:
            half = word[: len(word) // 2]
            found = [x for x in found if not x[2].startswith(half)]
        if found:
            n, best = min((-n, w) for _, n, w in found)
            yield word, len(found), -n, best


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """`words`: different words (at least two code points) with counts n. Returns for each word with near ones (one code
    point put in, left out or replaced) word, n_near (how many), best_n (the largest of their counts) and best (the first
    in code-point order of the words with that count).

    A word is filed under the halves by which words of its length or one more or less would look for it. Halves are dealt
    into shards; a half that more words share than an automaton shall hold is split by word, and who looks for it asks each
    split. Words go out with counts only; no pairs are sent. An empty table gives no rows.
    """
    size = F.length("word")
    prefix = lambda n: F.substring(F.col("word"), F.lit(1), n)
    suffix = lambda n: F.reverse(F.substring(F.reverse("word"), F.lit(1), n))
    half = lambda n: F.floor(n / 2).cast("int")
    lengths = F.array(size - 1, size, size + 1)
    keys = lambda around: F.array_union(F.transform(around, lambda n: F.concat(F.lit("<"), prefix(half(n)))), F.transform(around, lambda n: F.concat(F.lit(">"), suffix(n - half(n)))))
    with scratch(words.sparkSession) as spare:
        words = kept(words.select("word", "n"))
        filed = words.select("word", "n", F.explode(keys(lengths)).alias("key"))
        hot = kept(filed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > shard).select("key", F.ceil(F.col("size") / shard).cast("int").alias("splits")))
        n_shards = max(1, -(-2 * words.count() // shard))
        split = filed.join(hot, "key", "left").withColumn("split", F.when(F.col("splits").isNotNull(), F.pmod(F.xxhash64("word"), "splits")).cast("int"))
        asking = words.select(F.col("word").alias("asked"), F.explode(keys(F.array(size))).alias("key")).join(hot, "key", "left")
        asking = asking.withColumn("split", F.explode_outer(F.when(F.col("splits").isNotNull(), F.sequence(F.lit(0), F.col("splits") - 1))))
        # a half of its own where it is split, else one of the shards of its direction
        place = F.when(F.col("split").isNotNull(), F.concat_ws("|", "key", "split")).otherwise(F.concat(F.substring("key", 1, 1), F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("string")))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                counts = dict(zip(left["word"].to_pylist(), left["n"].to_pylist(), strict=True))
                out = list(near_in_shard(list(counts), list(counts.values()), right["asked"].to_pylist(), left["place"][0].as_py()[0] == "<"))
            kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
            return pa.table({k: pa.array([x[i] for x in out], kind) for i, (k, kind) in enumerate(kinds.items())})

        left = split.select("word", "n", place.alias("place")).groupBy("place")
        right = asking.select("asked", place.alias("place")).groupBy("place")
        found = left.cogroup(right).applyInArrow(lambda a, b: meet(a, b), "word string, n_near long, best_n long, best string")
        summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
        return spare(summed.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """`forms`: word and form, without circles. Returns word and root, the end of the chain of forms. Each step doubles how
    far a word has come; the number of steps grows with the logarithm of the longest chain."""
    with scratch(forms.sparkSession) as spare:
        now = kept(forms.select("word", F.col("form").alias("root")))
        while True:
            ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
            step = kept(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            now = step.select("word", "root")
            if step.filter("moved").isEmpty():
                return spare(now)


def spelling_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, factor: int = 2, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Group the spellings of the words of all whole texts.

    Words are those of word_counts() with at least so many code points and occurrences. Returns word, form (of its near
    words the one of largest n, ties to the first in code-point order, if that n is at least `factor` times the word's;
    else null), root (the word at the end of the chain of forms; the word itself without one), n, n_near (how many words are
    near) and form_n (the form's n or null). Null and empty texts have no words; rows with a null id are counted, and their
    words stay as they stand; repeated rows count as often as they stand. Other columns are not read; tables without words
    give no rows. A factor of at least 2 keeps chains free of circles. `least_length` must be at least 3.
    """
    if factor < 2 or least_length < 3:
        raise ValueError("factor must be at least 2, least_length at least 3")
    with scratch(docs.sparkSession) as spare:
        words = spare(word_counts(docs, id_col, text_col).filter((F.length("word") >= least_length) & (F.col("n") >= least_count)))
        near = near_words(words, shard)
        named = words.join(near, "word", "left")
        real = F.col("best_n") >= factor * F.col("n")
        named = spare(named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(real, F.col("best")).alias("form"), F.when(real, F.col("best_n")).alias("form_n")))
        ends = spare(roots(named.filter("form IS NOT NULL").select("word", "form")))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
