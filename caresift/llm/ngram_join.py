"""N-gram Jaccard join: MinHash LSH forest, followed by exact verification.

Documents with the same words are one class of copies, represented by its smallest id.  Every representative gets one
label of ``max_depth`` MinHash values per tree; the labels of a tree, sorted, are its trie.  A representative asks for all
labels that share a prefix with its own.  Prefixes start at the whole label and are shortened level by level, all trees
alike, until a pair at the threshold meets in one of them with the target probability.  A prefix is shortened first only
as long as few labels share it; prefixes that many share, as of boilerplate, stay long where other trees make up for it,
and are shortened last, if the target asks for it.  So the recall bound holds for every document, whatever its neighbours.

1. shared prefixes are counted, for all labels at the shortest length, for those of large nodes at every length;
2. within blocks of the nodes that are asked for, sketches (one byte of every MinHash value) join what shares a long
   enough prefix and looks alike to stars;
3. connected stars are candidate groups, and each member's shingles are sent to its group once per block;
4. blocks of a group count common shingles exactly; links are counted in place, and verified stars are connected.

No task holds an unbounded group and no table of pairs is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.llm.common import (
    WHITE_SPACE, WordHasher, binary_rows, few_tasks, full_windows, group_starts, mixed, separators, shuffle_partitions, small_batches, stored, text_slices,
    whole_groups, window_hashes, word_bounds,
)
from caresift.llm.components import components
from caresift.operators.sizes import checked_broadcast

SHINGLE = 5
THRESHOLD = 0.8
#: Sketches of a pair at the threshold agree on fewer values than are let pass only this many standard deviations below the mean.
SKETCH_DEVIATIONS = 4.5
BUCKET_BLOCK = 256
GROUP_BLOCK = 256
#: Levels by which prefixes may get shorter than trees of equal depth would need, to make up for others that stay long.
SPARE_LEVELS = 1


def forest_depth(threshold: float, trees: int, target: float, max_depth: int) -> int:
    """The longest prefix at which a pair at the threshold meets in one of the trees with probability ``target``."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold ** depth) ** trees >= target:
            return depth
    return 1


@dataclass(frozen=True)
class Forest:
    """Trees of labels of ``deepest`` values, of which prefixes of at least ``shortest`` values are matched."""

    threshold: float
    trees: int
    target: float
    shortest: int
    deepest: int

    def prefix_lengths(self, small: np.ndarray) -> np.ndarray:
        """Prefix lengths per document and tree; ``small``: the shortest prefix that few labels share, at most ``deepest`` + 1.

        What a length contributes is the log of the chance of a miss, which adds up over trees.
        """
        chance = np.minimum(self.threshold, 1 - 1e-9) ** np.arange(self.deepest + 1.0)
        chance[0] = 1 - 1e-12
        gain = -np.log1p(-chance)
        need = -np.log1p(-min(self.target, 1 - 1e-12))
        lengths = np.full(small.shape, self.deepest)
        reached = np.full(len(small), self.trees * gain[self.deepest])
        for few in (True, False):
            for level in range(self.deepest - 1, self.shortest - 1, -1):
                for tree in range(self.trees):
                    shorten = (reached < need) & (lengths[:, tree] == level + 1)
                    if few:
                        shorten &= small[:, tree] <= level
                    lengths[shorten, tree] = level
                    reached[shorten] += gain[level] - gain[level + 1]
        return lengths

    @property
    def sketch_least(self) -> int:
        """How many bytes of two sketches have to agree."""
        n = self.trees * self.deepest
        return max(0, int(n * self.threshold - SKETCH_DEVIATIONS * (n * self.threshold * (1 - self.threshold)) ** 0.5))


def forest_of(threshold: float, trees: int, target: float, max_depth: int) -> Forest:
    depth = forest_depth(threshold, trees, target, max_depth)
    return Forest(threshold, trees, target, max(1, depth - SPARE_LEVELS), max_depth)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher, between: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles in text order, their number per text, word hashes, first word of each text).

    A text of fewer than ``size`` words has one shingle, all its words; one without words has none.
    """
    starts, ends, first = word_bounds(data, offsets, between)
    words = hasher(data, starts, ends)
    n_words = np.diff(first)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    windows = window_hashes(words, size)
    values = windows[full_windows(first, size, len(windows))]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        at = np.cumsum(counts) - counts
        result = np.zeros(int(counts.sum()), np.uint64)
        long = np.ones(len(result), bool)
        long[at[short]] = False
        result[long] = values
        for width in range(1, size):
            docs = short[n_words[short] == width]
            result[at[docs]] = window_hashes(words, width)[first[docs]] if len(docs) else 0
        values = result
    return values, counts, words, first


def reduced(ufunc, values: np.ndarray, counts: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over consecutive runs of ``values``; runs without values give ``empty``."""
    out = np.full(len(counts), empty, values.dtype)
    held = counts > 0
    if held.any():
        out[held] = ufunc.reduceat(values, (np.cumsum(counts) - counts)[held])
    return out


def local_roots(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index each index is connected with."""
    root = np.full(len(near), -1, np.int64)
    for start in range(len(near)):
        if root[start] < 0:
            root[start] = start
            front = np.array([start])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (root < 0))
                root[front] = start
    return root


def signatures(docs: DataFrame, forest: Forest, doc_id: str, text: str) -> DataFrame:
    """``doc_id, d1, d2`` (digest of the word sequence), ``keys`` and ``sketch`` of every text with words.

    ``keys``: per tree, a hash of the shortest prefix.  ``sketch``: one byte of every value, tree by tree; a tree's bytes
    beyond the shortest prefix continue its key to the whole label.
    """
    trees, depth = forest.trees, forest.deepest
    total = trees * depth

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, between = WordHasher(), separators(*WHITE_SPACE)
        random = np.random.default_rng(7)
        flips = random.integers(0, 1 << 32, total, np.uint32)
        factors = random.integers(0, 1 << 31, total).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        salts = random.integers(1, 1 << 62, trees).astype(np.uint64)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                shingles, counts, words, first = shingle_hashes(data, offsets, hasher, between)
                place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
                d1 = mixed(reduced(np.add, mixed(words + hasher.byte[7] * place.astype(np.uint64)), np.diff(first), 0))
                d2 = mixed(reduced(np.add, mixed((words ^ hasher.byte[8]) + hasher.byte[9] * place.astype(np.uint64)), np.diff(first), 0))
                short = (shingles >> np.uint64(32)).astype(np.uint32)
                least = np.empty((high - low, total), np.uint32)
                for i in range(total):
                    least[:, i] = reduced(np.minimum, (short ^ flips[i]) * factors[i], counts, 0)
                label = np.zeros((high - low, trees), np.uint64)
                for level in range(forest.shortest):
                    label = mixed(label * np.uint64(0x9E3779B97F4A7C15) + least[:, level::depth])
                keys = mixed(label ^ salts).view(np.int64)
                sketch = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                rows = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low).take(pa.array(rows)), pa.array(d1[rows].view(np.int64)), pa.array(d2[rows].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * trees), pa.array(keys[rows].ravel())),
                    pa.array([x.tobytes() for x in sketch[rows]], pa.binary()),
                ], ["doc_id", "d1", "d2", "keys", "sketch"])

    source = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(sign, "doc_id bigint, d1 bigint, d2 bigint, keys array<bigint>, sketch binary")


def in_blocks(rows: DataFrame, keys: list[str], size: str, node: str, block: int) -> DataFrame:
    """Deal groups of any size into pairs of blocks: columns ``i``, ``l`` (i <= l) and the row's own block ``own``."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node), n).cast("int")
    return (
        rows.withColumn("_n", n).withColumn("own", own)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("i", F.least("own", "_j")).withColumn("l", F.greatest("own", "_j")).drop("_j", "_n", size)
    )


def _prefix(forest: Forest, length: Column) -> Column:
    """A label's bytes from the shortest prefix up to ``length`` values."""
    return F.substring("sketch", F.col("tree") * forest.deepest + forest.shortest + 1, length - forest.shortest)


def asked_prefixes(classes: DataFrame, forest: Forest, many: int) -> DataFrame:
    """``node, tree, length, bucket, m, sketch``: each label that shares a prefix asked for, in the largest such node.

    ``length``: the prefix this representative asks for.  ``m``: labels in the node ``bucket`` of the trie; prefixes that
    more than ``many`` labels share count as shared by many.
    """
    labels = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    sizes = labels.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    members = stored(labels.join(sizes, ["tree", "key"]), "jaccard-labels")
    crowded = F.col("m") > many
    n_crowded = members.where(crowded).count()
    n_longer = n_crowded * (forest.deepest - forest.shortest + 1)
    sketches = classes.select("node", "sketch")

    # Nodes of many labels, at every length: with what number of values does a label leave them?
    longer = F.sequence(F.lit(forest.shortest + 1), F.lit(forest.deepest)) if forest.deepest > forest.shortest else F.array().cast("array<int>")
    grown = members.where(crowded).join(sketches, "node").select("node", "tree", "key", "sketch", F.explode(longer).alias("length"))
    grown = grown.select("node", "tree", "key", "length", _prefix(forest, F.col("length")).alias("prefix"))
    place = ["tree", "key", "length", "prefix"]
    large = grown.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select(*place)
    large = stored(few_tasks(large, n_longer), "jaccard-large")
    left = grown.join(checked_broadcast(large), place, "left_semi").groupBy("node", "tree").agg((F.max("length") + 1).alias("small"))
    uneven = (
        members.where(crowded).join(left, ["node", "tree"], "left")
        .groupBy("node").agg(F.collect_list(F.struct("tree", F.coalesce("small", F.lit(forest.shortest + 1)).alias("small"))).alias("held"))
    )

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = np.full((batch.num_rows, forest.trees), forest.shortest)
            held = batch.column(1)
            flat = held.flatten()
            rows = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy())
            small[rows, flat.field("tree").to_numpy()] = flat.field("small").to_numpy()
            lengths = forest.prefix_lengths(small).astype(np.int32)
            cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * forest.trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(lengths.ravel()))], ["node", "lengths"])

    usual = F.lit(forest.prefix_lengths(np.full((1, forest.trees), forest.shortest))[0].tolist())
    # written: both the few and the many look them up
    planned = stored(few_tasks(uneven, n_crowded).mapInArrow(plan, "node bigint, lengths array<int>"), "jaccard-planned")
    length = F.element_at(F.coalesce("lengths", usual), F.col("tree") + 1)
    asking = members.join(planned, "node", "left").join(sketches, "node").select("node", "tree", "key", "m", "sketch", length.alias("length"))
    few = asking.where(~crowded).select("node", "tree", "length", F.col("key").alias("bucket"), "m", "sketch")
    if not n_crowded:
        return few

    # In a large node, a label stands in the largest of the nodes on its way that somebody asks for.
    many_asking = stored(few_tasks(asking.where(crowded), n_crowded), "jaccard-crowded")
    asked = many_asking.select("tree", "key", "length", _prefix(forest, F.col("length")).alias("prefix")).distinct()
    asked = stored(few_tasks(asked, n_crowded), "jaccard-asked")
    every = F.sequence(F.lit(forest.shortest), F.lit(forest.deepest))
    way = many_asking.select("node", "tree", "key", "sketch", F.explode(every).alias("length")).select("node", "tree", "key", "length", _prefix(forest, F.col("length")).alias("prefix"))
    top = way.join(checked_broadcast(asked), place, "left_semi").groupBy("node", "tree").agg(F.min("length").alias("top"))
    placed = many_asking.drop("m").join(top, ["node", "tree"]).withColumn("bucket", F.xxhash64("key", "top", _prefix(forest, F.col("top"))))
    counted = placed.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    return few.unionByName(placed.join(counted, ["tree", "bucket"]).select("node", "tree", "length", "bucket", "m", "sketch"))


def bucket_stars(rows: DataFrame, forest: Forest) -> DataFrame:
    """Edges ``a, b`` from every member of a block to the smallest member it hangs on.

    Two members hang together if they share the prefix that one of them asks for and their sketches look alike.
    """
    keys = ["tree", "bucket", "i", "l"]
    least = forest.sketch_least

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            node, tree, asked = (table.column(c).to_numpy() for c in ("node", "tree", "length"))
            sketch = np.stack(binary_rows(table.column("sketch"), np.uint8))
            rest = sketch.reshape(len(node), forest.trees, forest.deepest)[np.arange(len(node)), tree, forest.shortest:]
            cuts = np.append(group_starts(table, keys), len(node))
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            shared = forest.shortest + np.logical_and.accumulate(rest[two] == rest[two + 1], axis=1).sum(1)
            two = two[shared >= np.minimum(asked[two], asked[two + 1])]
            two = two[(sketch[two] == sketch[two + 1]).sum(1) >= least]
            found = [(node[two], node[two + 1])]
            for low, high in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2]):
                order = low + np.argsort(node[low:high])
                mine, label, wish = sketch[order], rest[order], asked[order]
                near = np.zeros((len(mine), len(mine)), bool)
                for at in range(0, len(mine), 64):
                    part = slice(at, at + 64)
                    shared = forest.shortest + np.logical_and.accumulate(label[part, None, :] == label[None, :, :], axis=2).sum(2)
                    one, other = np.nonzero(shared >= np.minimum(wish[part, None], wish[None, :]))
                    alike = (mine[at + one] == mine[other]).sum(1) >= least
                    near[at + one[alike], other[alike]] = True
                root = local_roots(near)
                moved = np.flatnonzero(root != np.arange(len(root)))
                found.append((node[order][moved], node[order][root[moved]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))], ["a", "b"])

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "node", "length", "sketch").mapInArrow(stars, "a bigint, b bigint")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node, shingles``: the distinct shingles of each text, sorted, as packed 64-bit numbers (other columns pass)."""
    names = docs.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, between = WordHasher(), separators(*WHITE_SPACE)
        text = names.index("text")
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(text)):
                shingles, counts, _, _ = shingle_hashes(data, offsets, hasher, between)
                cuts = np.append(0, np.cumsum(counts))
                packed = pa.array([np.unique(shingles[cuts[i]:cuts[i + 1]]).tobytes() for i in range(high - low)], pa.binary())
                yield pa.RecordBatch.from_arrays([packed if i == text else batch.column(i).slice(low, high - low) for i in range(len(names))], ["shingles" if n == "text" else n for n in names])

    schema = ", ".join("shingles binary" if n == "text" else f"{n} {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(pack, schema)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    value, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    new = np.append(True, value[1:] != value[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    take = shared[column]
    doc, column = doc[take], (np.cumsum(shared) - 1)[column[take]]
    counts = np.zeros((len(sets), len(sets)), np.int64)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        held = np.zeros((len(sets), width), np.float32)
        held[doc[part], column[part] - k * width] = 1
        counts += (held @ held.T).astype(np.int64)
    return counts


def verified_links(rows: DataFrame, threshold: float) -> DataFrame:
    """``node, links, root`` per block: how many documents it links with here, and the smallest node it hangs on."""
    keys = ["component", "i", "l"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            nodes, own, copies = (table.column(c).to_numpy() for c in ("node", "own", "copies"))
            i, last = table.column("i").to_numpy(), table.column("l").to_numpy()
            sets = binary_rows(table.column("shingles"), np.uint64)
            cuts = np.append(group_starts(table, keys), len(nodes))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for low, high in zip(cuts[:-1], cuts[1:]):
                if high - low < 2:
                    continue
                order = low + np.argsort(nodes[low:high])
                mine = [sets[k] for k in order]
                size = np.array([len(x) for x in mine])
                if len(mine) == 2:
                    n = len(np.intersect1d(mine[0], mine[1], assume_unique=True))
                    both = np.array([[size[0], n], [n, size[1]]])
                else:
                    both = common_counts(mine)
                near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                if i[low] != last[low]:
                    near &= own[order][:, None] != own[order][None, :]
                np.fill_diagonal(near, False)
                links = near @ copies[order]
                root = local_roots(near)
                held = np.flatnonzero(links)
                out.append((nodes[order][held], links[held], nodes[order][root[held]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).astype(np.int64)) for k in range(3)], ["node", "links", "root"])

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "own", "node", "copies", "shingles").mapInArrow(verify, "node bigint, links bigint, root bigint")


def jaccard_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    trees: int = 20,
    target: float = 0.9999,
    max_depth: int = 8,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, copy_id, n_links``.

    ``copy_id``: smallest id with the same words.  ``class_id``: smallest id reachable over links, a link being a
    Jaccard similarity of the sets of five-word shingles of at least ``threshold``.  ``n_links``: rows other than this
    one that it links with, copies included.  A text of one to four words has one shingle.  Texts that are null or have
    no words, and rows without an id, link with nothing and are their own class.  ``doc_id`` identifies a text: rows
    that repeat an id repeat its text and count as copies.  Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    forest = forest_of(threshold, trees, target, max_depth)
    signed = stored(signatures(docs, forest, doc_id, text), "jaccard-signed")
    classes = stored(
        signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")),
        "jaccard-classes",
    )
    asked = asked_prefixes(classes, forest, BUCKET_BLOCK)
    stars = bucket_stars(in_blocks(asked, ["tree", "bucket"], "m", "node", BUCKET_BLOCK), forest)
    groups = components(stars)

    group_sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    held = groups.join(group_sizes, "component").join(classes.select("node", "copies"), "node")
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).alias("text"))
    sets = shingle_sets(held.join(texts, "node").dropDuplicates(["node"]))
    checked = stored(verified_links(in_blocks(sets, ["component"], "m", "node", GROUP_BLOCK), threshold), "jaccard-links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))

    described = (
        classes.select("d1", "d2", "node", "copies").join(links, "node", "left").join(joined, "node", "left")
        .select("d1", "d2", F.coalesce("component", "node").alias("class_id"), F.col("node").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    found = signed.select("doc_id", "d1", "d2").join(described, ["d1", "d2"]).select("doc_id", "class_id", "copy_id", "n_links")
    words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    alone = docs.where(F.col(doc_id).isNull() | ~words).select(F.col(doc_id).cast("bigint").alias("doc_id"))
    return found.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("bigint").alias("n_links")))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every class; rows that repeat an id are kept once, rows without one all."""
    kept = jaccard_classes(docs).where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.where(F.col("doc_id").isNull()))
