"""Benchmark decontamination: CGK embedding, bit-sampling LSH on item-sized windows, exact edit verification.

A walk goes through words: at every step it writes down the word it stands on and moves on by one random bit that
depends on step and word (the CGK embedding).  Similar passages fall into step again after an edit, so that edit
distance becomes Hamming distance of what was written down.  Short walks start at every word of an item, so that all of
it is looked at wherever its edits stand, and at every word of a text; a hit says where the item would begin.  A
repetition samples a few steps as its key; odd repetitions walk backwards.  Their number follows from the target recall,
measured at the items' own lengths by simulated edits at the threshold: at random places, at both ends, in the middle
and evenly spaced.  Every candidate is verified with the exact edit distance of words.

The benchmark is the query set: it is handled in blocks of bounded size, each sent to all tasks, and the corpus is
scanned per block without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caresift.llm.common import WordHasher, mixed, ranges, separators, small_batches, stored, text_slices, unused, word_bounds

SIMILARITY = 0.8
STEPS = 8
SAMPLED = 4
#: Simulated items are at most this long: longer ones have more unedited runs at the same share of edits.
SIMULATED_WORDS = 60
#: Words of one block of benchmark items: what is sent to every task stays within a few MB.
BLOCK_WORDS = 200_000

NOT_WORD = [c for c in range(128) if not chr(c).isalnum()]


@dataclass(frozen=True)
class Walk:
    """One repetition: its sampled steps, its step factors, its direction, and whether its samples must stand apart."""

    picks: tuple[int, ...]
    factors: np.ndarray
    backward: bool
    apart: bool = True


def walks(count: int, steps: int = STEPS, sampled: int = SAMPLED, apart: bool = True) -> list[Walk]:
    random = np.random.default_rng(41)
    out = []
    for k in range(count):
        picks = tuple(sorted(int(x) for x in random.choice(steps, min(sampled, steps), replace=False)))
        out.append(Walk(picks, random.integers(0, 1 << 63, steps).astype(np.uint64) * np.uint64(2) + np.uint64(1), k % 2 == 1, apart))
    return out


def walked(words: np.ndarray, at: np.ndarray, walk: Walk, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``at`` are left, their keys): if ``apart``, those whose samples all stand on different places, as
    a walk that lingers on a common word tells little; ``keep(keys, n)`` may drop more after the n-th sample."""
    left, here, before, key = np.arange(len(at)), at.copy(), np.full(len(at), -1), np.zeros(len(at), np.uint64)
    for step in range(walk.picks[-1] + 1):
        if step in walk.picks:
            if walk.apart:
                held = np.flatnonzero(here != before)
                left, here, key = left[held], here[held], key[held]
            before, word = here, words[here]
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + word)
            if keep is not None:
                held = np.flatnonzero(keep(key, walk.picks.index(step)))
                left, here, before, key, word = left[held], here[held], before[held], key[held], word[held]
        else:
            word = words[here]
        move = ((word * walk.factors[step]) >> np.uint64(63)).astype(np.int64)
        here = here - move if walk.backward else here + move
    return left, key


def edited(words: np.ndarray, edits: int, random: np.random.Generator) -> np.ndarray:
    out = list(words)
    for _ in range(edits):
        at, kind = int(random.integers(0, max(1, len(out)))), int(random.integers(0, 3))
        if kind == 0 and len(out) > 1:
            del out[at]
        elif kind == 1:
            out.insert(at, np.uint64(random.integers(1, 1 << 62)))
        else:
            out[at] = np.uint64(random.integers(1, 1 << 62))
    return np.array(out, np.uint64)


def edit_patterns(item: np.ndarray, edits: int, random: np.random.Generator) -> list[np.ndarray]:
    """Copies of an item with ``edits`` edits: random ones, both ends or the middle replaced, evenly spaced words replaced or dropped."""
    n, half = len(item), edits // 2
    spaced = np.array([(k + 1) * (n + 1) // (edits + 1) - 1 for k in range(edits)], np.int64)
    both = np.concatenate([np.arange(half), np.arange(n - edits + half, n)])
    out = [edited(item, edits, random), np.delete(item, spaced)]
    for places in (both, np.arange((n - edits) // 2, (n - edits) // 2 + edits), spaced):
        other = item.copy()
        other[places] = random.integers(1, 1 << 62, len(places)).astype(np.uint64)
        out.append(other)
    return out


def anchors(sizes: np.ndarray, walk: Walk) -> tuple[np.ndarray, np.ndarray]:
    """(which of the word sequences, offset in it) of all starts from which the sampled steps surely stay inside."""
    counts = np.maximum(sizes - walk.picks[-1], 0)
    return np.repeat(np.arange(len(sizes)), counts), ranges(np.full(len(sizes), walk.picks[-1] if walk.backward else 0), counts)


@lru_cache(maxsize=1_000)
def simulated(target: float, length: int, edits: int, steps: int, sampled: int, trials: int = 100, most: int = 24) -> int | None:
    """The fewest repetitions that find ``target`` of the copies of every pattern of edits; none if ``most`` are too few."""
    random = np.random.default_rng(43)
    items = [random.integers(1, 1 << 62, length).astype(np.uint64) for _ in range(trials)]
    pairs = [(x, y) for x in items for y in edit_patterns(x, edits, random)]
    first = np.full(len(pairs), most)
    for k, walk in enumerate(walks(most, steps, sampled)):
        sides = []
        for side in (0, 1):
            sizes = np.array([len(x[side]) for x in pairs])
            owner, offset = anchors(sizes, walk)
            left, key = walked(np.concatenate([x[side] for x in pairs]), (np.cumsum(sizes) - sizes)[owner] + offset, walk)
            owner, offset = owner[left], offset[left]
            sides.append((mixed(key + owner.astype(np.uint64)), owner, offset))
        (keys, owner, offset), (others, _, there) = sides
        order = np.argsort(others, kind="stable")
        low, high = np.searchsorted(others[order], keys), np.searchsorted(others[order], keys, "right")
        hit = order[ranges(low, high - low)]
        # A hit elsewhere in the item does not lead to the passage.
        near = np.abs(there[hit] - np.repeat(offset, high - low)) <= edits
        found = np.repeat(owner, high - low)[near]
        first[found] = np.minimum(first[found], k)
        worst = np.sort(first.reshape(trials, -1), axis=0)[max(0, int(np.ceil(target * trials)) - 1)].max()
        if worst <= k:
            return int(worst) + 1
    return None


def repetitions(target: float, length: int, edits: int) -> tuple[int, int, int]:
    """(steps, samples, repetitions) for items of ``length`` words with up to ``edits`` edits: as many samples as let recall reach the target.

    Without edits one walk finds every item, if its samples need not stand apart.
    """
    if not edits:
        return min(length, STEPS), min(length, SAMPLED), 1
    if length > SIMULATED_WORDS:
        length, edits = SIMULATED_WORDS, -(-edits * SIMULATED_WORDS // length)
    for sampled in range(min(length, SAMPLED), 1, -1):
        for steps in sorted({min(length, sampled * STEPS // SAMPLED), sampled}, reverse=True):
            count = simulated(target, length, edits, steps, sampled)
            if count is not None:
                return steps, sampled, count
    return 1, 1, 1


def edit_distances(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact edit distance of the first ``lengths[k]`` words of ``a[k]`` and ``b[k]``, for all k at once."""
    n, width = a.shape
    row = np.broadcast_to(np.arange(width + 1), (n, width + 1)).astype(np.int32)
    column = np.arange(width + 1, dtype=np.int32)
    out = np.zeros(n, np.int32)
    for i in range(1, width + 1):
        best = row + 1
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + (b != a[:, i - 1:i]))
        row = np.minimum.accumulate(best - column, axis=1) + column
        done = lengths == i
        out[done] = row[done, i]
    return out


def passage_distances(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For all k at once and every j: the least edit distance of the first ``lengths[k]`` words of ``a[k]`` to words of ``b[k]`` that end before j."""
    width = b.shape[1]
    row = np.zeros((len(b), width + 1), np.int16)
    column = np.arange(width + 1, dtype=np.int16)
    out = np.zeros_like(row)
    for i in range(1, a.shape[1] + 1):
        best = row + np.int16(1)
        np.minimum(best[:, 1:], row[:, :-1] + (b != a[:, i - 1:i]), out=best[:, 1:])
        row = np.minimum.accumulate(best - column, axis=1) + column
        done = lengths == i
        out[done] = row[done]
    return out


@dataclass(frozen=True)
class Item:
    item_id: int | None
    words: np.ndarray


class Finder:
    """Finds the items of one block in slices of text."""

    def __init__(self, items: list[Item], similarity: float, target: float, passages: bool = False) -> None:
        self.passages = passages
        self.hasher, self.between = WordHasher(), separators(*NOT_WORD)
        self.items, self.similarity = items, similarity
        self.size = np.array([len(x.words) for x in items])
        self.padded = np.zeros((len(items), int(self.size.max())), np.uint64)
        for k, x in enumerate(items):
            self.padded[k, :len(x.words)] = x.words
        self.limit = np.floor((1 - similarity) * self.size + 1e-9).astype(int)
        self.plans = []
        need = np.array([repetitions(target, int(n), int(edits)) for n, edits in zip(self.size, self.limit)]).reshape(-1, 3)
        need = np.column_stack([need, self.limit > 0])
        for steps, sampled, apart in np.unique(need[:, [0, 1, 3]], axis=0):
            mine = np.flatnonzero((need[:, [0, 1, 3]] == (steps, sampled, apart)).all(1))
            for k, walk in enumerate(walks(int(need[mine, 2].max()), int(steps), int(sampled), bool(apart))):
                some = mine[need[mine, 2] > k]
                self.plans.append((walk, *self.tables(some, walk)))

    def tables(self, mine: np.ndarray, walk: Walk) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Per sampled step a bit table of the anchors' partial keys, then the sorted full keys, their items and offsets."""
        owner, offset = anchors(self.size[mine], walk)
        bits = min(22, max(16, len(owner).bit_length() + 3))
        partial: list[np.ndarray] = []

        def note(key: np.ndarray, n: int) -> np.ndarray:
            held = partial[n] if n < len(partial) else np.zeros(1 << bits, bool)
            if n == len(partial):
                partial.append(held)
            held[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
            return np.ones(len(key), bool)

        begin = np.cumsum(self.size[mine]) - self.size[mine]
        left, keys = walked(np.concatenate([self.items[k].words for k in mine]), begin[owner] + offset, walk, note)
        owner, offset = owner[left], offset[left]
        order = np.argsort(keys, kind="stable")
        return partial, keys[order], mine[owner[order]], offset[order]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """(text, item, first word, distance), the nearest and then earliest window or passage of each text and item."""
        starts, ends, first = word_bounds(data, offsets, self.between)
        words = self.hasher(data, starts, ends)
        sizes = np.diff(first)
        last, start = np.repeat(first[1:], sizes), np.repeat(first[:-1], sizes)
        place = np.arange(len(words))
        found = []
        for walk, partial, keys, owner, offset in self.plans:
            shift = 64 - (len(partial[0]).bit_length() - 1)
            reach = walk.picks[-1]
            at = np.flatnonzero(place - start >= reach if walk.backward else place + reach < last)
            left, key = walked(words, at, walk, lambda k, n: partial[n][(k >> np.uint64(shift)).astype(np.int64)])
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            hit = ranges(low, high - low)
            anchor = np.repeat(at[left], high - low)
            text = np.searchsorted(first, anchor, "right") - 1
            found.append((anchor - offset[hit], owner[hit], text))
        begin, item, text = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] != begin[:-1])
        text, item, begin = text[new], item[new], begin[new]
        text, item, begin, distance = (self.near_passages if self.passages else self.near_windows)(words, first, text, item, begin)
        near = np.flatnonzero(distance <= self.limit[item])
        order = near[np.lexsort((begin[near], distance[near], item[near], text[near]))]
        text, item, begin, distance = text[order], item[order], begin[order] - first[text[order]], distance[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        return [x[new] for x in (text, item, begin, distance)]


    def near_windows(self, words: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows of the item's own length about each candidate, with their distances."""
        # As many words may be inserted as dropped in a window, each half of the edits: it begins at most so far away.
        spread = self.limit[item] // 2
        begin = np.repeat(begin - spread, 2 * spread + 1) + ranges(np.zeros(len(item), np.int64), 2 * spread + 1)
        text, item = np.repeat(text, 2 * spread + 1), np.repeat(item, 2 * spread + 1)
        fits = (begin >= first[text]) & (begin + self.size[item] <= first[text + 1])
        text, item, begin = np.unique(np.stack([text[fits], item[fits], begin[fits]]), axis=1)
        distance = np.full(len(item), np.iinfo(np.int64).max)
        folded, folded_items = (words >> np.uint64(49)).astype(np.int16), (self.padded >> np.uint64(49)).astype(np.int16)
        for at in range(0, len(item), 1_000):
            mine = item[at:at + 1_000]
            size = self.size[mine]
            inside = np.arange(int(size.max())) < size[:, None]
            spots = np.minimum(begin[at:at + 1_000, None] + np.arange(inside.shape[1]), len(words) - 1)
            # Every edit mends one word of the item at most: with more words missing in the window it is too far.
            window = np.where(inside, folded[spots], np.int16(-1))
            missing = (inside & ~(folded_items[mine, :inside.shape[1], None] == window[:, None, :]).any(2)).sum(1)
            some = np.flatnonzero(missing <= self.limit[mine])
            if len(some):
                distance[at + some] = edit_distances(words[spots[some]], self.padded[mine[some], :inside.shape[1]], size[some])
        return text, item, begin, distance

    def near_passages(self, words: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """The nearest and then earliest passage of any length about each candidate, with its distance."""
        distance = np.full(len(item), np.iinfo(np.int64).max)
        at = begin.copy()
        folded, folded_items = (words >> np.uint64(49)).astype(np.int16), (self.padded >> np.uint64(49)).astype(np.int16)
        # Candidates of like lengths together; a thousand items of usual length at once, fewer of long ones.
        order = np.argsort(self.size[item], kind="stable")
        low = 0
        while low < len(order):
            high = min(len(order), low + max(1, min(1_000, 4_000_000 // int(self.size[item[order[min(len(order), low + 1_000) - 1]]]) ** 2)))
            mine = order[low:high]
            low = high
            which, size, limit = item[mine], self.size[item[mine]], self.limit[item[mine]]
            # Read backwards from where the passage may end at the latest, so that an end in the table is a begin in the text.
            end = begin[mine] + size + limit
            width = size + 2 * limit
            spots = end[:, None] - 1 - np.arange(int(width.max()))
            inside = (spots >= np.maximum(end - width, first[text[mine]])[:, None]) & (spots < first[text[mine] + 1][:, None])
            spots = np.clip(spots, 0, len(words) - 1)
            of_item = np.arange(int(size.max())) < size[:, None]
            # Every edit mends one word of the item at most: with more words missing in the region it is too far.
            around = np.where(inside, folded[spots], np.int16(-1))
            missing = (of_item & ~(folded_items[which, :of_item.shape[1], None] == around[:, None, :]).any(2)).sum(1)
            some = np.flatnonzero(missing <= limit)
            if not len(some):
                continue
            back = np.maximum(size[some, None] - 1 - np.arange(of_item.shape[1]), 0)
            reversed_items = self.padded[which[some, None], back]
            # No word of an item equals what stands outside the text or the region.
            region = np.where(inside[some], words[spots[some]], np.uint64(0))
            table = passage_distances(reversed_items, region, size[some])
            begins = end[some, None] - np.arange(table.shape[1])
            table[(begins < np.maximum(end[some] - width[some], first[text[mine[some]]])[:, None]) | (begins > first[text[mine[some]] + 1][:, None])] = np.iinfo(np.int16).max
            best = table.shape[1] - 1 - table[:, ::-1].argmin(1)
            distance[mine[some]], at[mine[some]] = table[np.arange(len(some)), best], end[some] - best
        return text, item, at, distance


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[Item]]:
    """Items with at least one word, block by block."""
    hasher, between = WordHasher(), separators(*NOT_WORD)
    block, held = [], 0
    for row in benchmark.select(F.col(item_id), F.lower(F.col(text))).toLocalIterator():
        for _, _, data, offsets in text_slices(pa.array([row[1] or ""])):
            starts, ends, _ = word_bounds(data, offsets, between)
            if len(starts):
                block.append(Item(row[0], hasher(data, starts, ends)))
                held += len(starts)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, target: float = 0.99, block_words: int = BLOCK_WORDS, passages: bool = False) -> DataFrame:
    """``doc_id, item_id, first_word, distance``: one row per row of ``docs`` and benchmark item found in it.

    With ``passages`` an item of n words is found if some passage, of any number of consecutive words, differs from it by
    at most (1 - similarity) n edits of words; else only windows of exactly n words count, in which a dropped or inserted
    word costs two edits and which a text shorter than the item lacks.  Words are lower-cased runs of ASCII letters and digits and of all other characters beyond ASCII.
    The reported window or passage is the nearest, then the earliest of those found.  Null texts and items without words match
    nothing; repeated rows and items are reported each.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType), T.StructField("first_word", T.LongType()), T.StructField("distance", T.LongType())])
    source = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))
    result = None
    for items in item_blocks(benchmark, item_id, item_text, block_words):
        def find(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, similarity, target, passages)
            names = pa.array([x.item_id for x in items])
            for batch in batches:
                for low, high, data, offsets in text_slices(batch.column(1)):
                    row, item, begin, distance = finder(data, offsets)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(row)), names.take(pa.array(item)), pa.array(begin), pa.array(distance)], names=schema.names)

        part = source.mapInArrow(find, schema)
        # Several blocks: each result is written before the next block is sent out.
        result = part if result is None else stored(result, "leaks").unionByName(part)
    return result if result is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, target: float = 0.99, block_words: int = BLOCK_WORDS, passages: bool = False) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found (see ``leaks``), all columns, one pass per block."""
    small_batches(docs.sparkSession)
    kept, names, lower = docs, docs.columns, unused(docs, "_lower")
    for items in item_blocks(benchmark, item_id, item_text, block_words):
        width = len(names)

        def clean(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, similarity, target, passages)
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for low, _, data, offsets in text_slices(batch.column(width)):
                    good[low + finder(data, offsets)[0]] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:width]], names=names)

        kept = kept.withColumn(lower, F.lower(F.col(text))).mapInArrow(clean, docs.schema)
    return kept
