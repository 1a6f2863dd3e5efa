"""Jaccard self-join on word n-grams: MinHash LSH forest with exact verification.

1. Texts become sets of hashed shingles (5 lower-cased words; shorter texts are one shingle). Equal
   sets are one node, counted in every task before the shuffle; the row with the least key stands for it.
   A row's key is its doc_id, a hash of its text and the text's length, so rows are told apart whatever
   their ids are.
2. A forest of ``trees`` prefix tries holds the MinHash signatures, ``deepest`` values a tree. A trie
   is its signatures in sorted order: entries that share a prefix of any length are neighbours. The
   forest is one table, range-partitioned and sorted, so a hot prefix is spread like any other. Entries
   alone under the shortest prefix that can be needed are left out before the sort.
3. The sorted forest is walked once, in its order, by ``window``: an entry is compared with the next ones
   as long as they share the shortest prefix, which are those with the longest common prefixes. So the
   prefix is as short as it must be where few texts share it and longer where many do. Sketches of 256
   one-byte minima are compared; what is connected already is not compared again, and pairs leave the
   task as stars.
4. Regions (entries that share the shortest prefix) that the window did not hold whole, or that lie in
   two partitions, are looked at again: one whose texts are all connected by now is closed, since its
   pairs meet in step 5 anyway. In an open one only texts that are not connected yet are compared, in
   blocks of at most ``block`` texts, block against block in tasks of their own. With this every
   pair that shares the shortest prefix in some tree is compared or connected, and that prefix is so short
   that a pair at the threshold shares it in some tree with the target recall.
5. Connected parts of these stars are families. Their texts are brought together once (again block
   against block when large) and every pair is verified exactly, on shingles of the words themselves;
   a task gives the number of links of each text and a star per verified part, never the pairs.
6. Connected parts of the verified stars are the classes.

Defined cases: null and empty texts have no shingle: a class of its own without links. Null doc_id
counts as the least number. Rows with the same doc_id are rows of their own: each has the class and the
links of its own text. Copies (equal shingle sets) share a class and count in n_copies, not in n_links.
Very long texts are whole. An empty table gives an empty table. Columns other than doc_id and text,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, mixed, narrow, numbered_columns, table, text_bytes, word_hashes, written

WORDS = 5
THRESHOLD = (4, 5)  # similarity of 4 / 5 or more
TREES = 32
DEEPEST = 10
STEP = 2
RECALL = 0.9999
SKETCH = 256
WINDOW = 12  # following entries that an entry is compared with
BLOCK = 256
VERIFY_BLOCK = 128  # texts that a task holds at once, twice that for two blocks
VERIFY_BYTES = 4 << 20  # and about how long they are together
HAS_WORD = r"[^\x20\x09-\x0D]"
MARGIN = 0.14  # of the sketch's estimate: over five standard deviations at the threshold


class Likeness(NamedTuple):
    """When texts are similar, and how they are looked for."""

    words: int = WORDS  # of a shingle
    threshold: tuple[int, int] = THRESHOLD  # similarity, as a fraction
    margin: float = MARGIN
    trees: int = TREES
    deepest: int = DEEPEST
    recall: float = RECALL

    @property
    def lengths(self) -> list[int]:
        return prefix_lengths(self.trees, self.deepest, recall=self.recall, threshold=self.threshold)

    @property
    def least(self) -> float:
        """The share of a sketch that has to agree."""
        return self.threshold[0] / self.threshold[1] - self.margin


FIVE_WORDS = Likeness()


def expected_recall(length: int, trees: int = TREES, threshold: tuple[int, int] = THRESHOLD) -> float:
    """How probable it is that a pair at the threshold shares a prefix of that length in some tree."""
    return 1 - (1 - (threshold[0] / threshold[1]) ** length) ** trees


def prefix_lengths(trees: int = TREES, deepest: int = DEEPEST, step: int = STEP, recall: float = RECALL, threshold: tuple[int, int] = THRESHOLD) -> list[int]:
    """The lengths that are matched, from the deepest to the first with the target recall."""
    lengths = [deepest]
    while expected_recall(lengths[-1], trees, threshold) < recall:
        if lengths[-1] == 1:
            raise ValueError("the target recall needs more trees")
        lengths.append(max(1, lengths[-1] - step))
    return lengths


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    hashes, ends = word_hashes(raw, offsets)
    sizes = np.diff(ends)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    rolled = np.zeros(len(hashes), np.uint64)
    place = np.arange(len(hashes)) - np.repeat(ends[:-1], sizes)
    left = np.repeat(sizes, sizes) - place  # words from here to the end of the text
    for k in range(words):
        rolled = np.where(left > k, mixed(rolled + padded[k : k + len(hashes)] + np.uint64(k + 1)), rolled)
    whole = (left >= words) | (place == 0)
    row = np.repeat(np.arange(len(sizes)), sizes)[whole]
    shingles = rolled[whole]
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    new = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])])[: len(row)]
    return shingles[new], np.searchsorted(row[new], np.arange(len(sizes) + 1))


def signatures(shingles: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values, hashes x texts (each text has a shingle)."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    random = np.random.default_rng(11)
    factors = random.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = random.integers(0, 1 << 32, hashes, dtype=np.uint32)
    out = np.empty((hashes, len(starts)), np.uint32)
    for i in range(hashes):
        out[i] = np.minimum.reduceat(values * factors[i] + shifts[i], starts)
    return out


KEY = "struct<doc_id:bigint,mark:bigint,bytes:bigint>"
SIGNED = f"key {KEY}, set_a long, set_b long, shingles int, roots array<long>, tails array<int>, sketch binary"
SET = ["set_a", "set_b", "shingles"]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key and text of every row; null doc_id as the least number."""
    number = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)))
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct(number.alias("doc_id"), F.xxhash64(body).alias("mark"), F.octet_length(body).cast("bigint").alias("bytes")).alias("key"), body.alias("text"))


def signed(rows: DataFrame, like: Likeness) -> DataFrame:
    """Each text's shingle set as two hashes and a size, its place in each tree, and its sketch. A place
    is a root (a hash of the tree and the first values, as many as the shortest prefix has) and a tail (a
    byte for each later value up to the deepest, at most four); entries with equal values have equal places."""
    trees, shortest, deepest = like.trees, like.lengths[-1], like.deepest
    hashes = max(SKETCH, trees * deepest)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        shingles, ends = shingle_sets(*text_bytes(batch.column("text")), like.words)
        full = np.flatnonzero(np.diff(ends))
        if not len(full):
            return
        starts, sizes = ends[:-1][full], np.diff(ends)[full]
        minima = signatures(shingles, starts, hashes).T
        labels = ((minima * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
        roots = np.repeat(np.arange(trees, dtype=np.uint64)[None], len(full), axis=0)
        tails = np.zeros((len(full), trees), np.uint32)
        for k in range(deepest):
            own = slice(k * trees, (k + 1) * trees)
            if k < shortest:
                roots = mixed(roots + minima[:, own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            else:
                tails = (tails << np.uint32(8)) | labels[:, own]
        offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * trees)
        yield {
            "key": batch.column("key").take(pa.array(full)), "set_a": np.add.reduceat(mixed(shingles), starts).view(np.int64), "set_b": np.bitwise_xor.reduceat(mixed(~shingles), starts).view(np.int64),
            "shingles": sizes.astype(np.int32), "roots": pa.ListArray.from_arrays(offsets, pa.array(roots.reshape(-1).view(np.int64))),
            "tails": pa.ListArray.from_arrays(offsets, pa.array(tails.reshape(-1).view(np.int32))), "sketch": pa.array([x.tobytes() for x in labels[:, :SKETCH]], pa.binary()),
        }

    return mapped(rows, run, SIGNED)


def distinct_sets(found: DataFrame) -> DataFrame:
    """One row for each shingle set: key (the least), rows, and node, a number that is new in each table."""
    firsts = [F.first(c).alias(c) for c in ("roots", "tails", "sketch")]
    return found.groupBy(*SET).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("rows"), *firsts).withColumn("node", F.monotonically_increasing_id())


def live_entries(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """root, n of every region of more than one entry, and root, tail, node of its entries; both written."""
    entries = texts.select("node", F.explode(F.arrays_zip("roots", "tails")).alias("e")).select("node", F.col("e.roots").alias("root"), F.col("e.tails").alias("tail"))
    regions = written(entries.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "forest-roots")
    return regions, written(entries.join(regions, "root", "left_semi").select("node", "root", "tail"), "forest-entries")


def sorted_forest(texts: DataFrame, live: DataFrame) -> DataFrame:
    """The entries with their sketches, each partition in order and after the one before it."""
    order = ["root", "tail", "node"]
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return live.join(texts.select("node", "sketch"), "node").select(*order, "sketch").repartitionByRange(partitions, *order).sortWithinPartitions(*order)


def neighbour_stars(forest: DataFrame, least: float, window: int) -> DataFrame:
    """Walk the sorted forest. Rows (a, b): texts that may be similar, as stars; rows (root): the regions at
    both ends of each partition."""

    def compared(root: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = np.arange(len(node))
        one, two = [label[:0]], [label[:0]]
        for step in range(1, window + 1):
            i = np.flatnonzero(root[step:] == root[:-step])
            i = i[(label[i] != label[i + step]) & (node[i] != node[i + step])]
            if not len(i):
                continue
            near = np.concatenate([(sketch[x] == sketch[x + step]).sum(axis=1) >= least * SKETCH for x in np.array_split(i, -(-len(i) // 20_000))])
            one.append(i[near])
            two.append(i[near] + step)
            label = stars(np.concatenate(one), np.concatenate(two), len(node))
        centre = np.full(len(node), np.iinfo(np.int64).max)  # the least node of a part, so that trees agree on it
        np.minimum.at(centre, label, node)
        moved = np.flatnonzero(centre[label] != node)
        return node[moved], centre[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, ends = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                own = (part.column("root").to_numpy(), part.column("node").to_numpy(), np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH))
                ends = [*ends[:1], int(own[0][0]), int(own[0][-1])]
                root, node, sketch = own if carried is None else (np.concatenate(x) for x in zip(carried, own))
                carried = root[-window:], node[-window:], sketch[-window:].copy()
                a, b = compared(root, node, sketch)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "root"])
        rest = sorted({ends[0], ends[-1]}) if ends else []
        yield pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array(rest, pa.int64())], names=["a", "b", "root"])

    return forest.mapInArrow(run, "a long, b long, root long")


def forest_stars(texts: DataFrame, like: Likeness, block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """Stars (a, b) over all pairs of nodes that share the shortest prefix and may be similar."""
    regions, live = live_entries(texts)
    walked = written(neighbour_stars(sorted_forest(texts, live), like.least, window), "forest-walk")
    edges = walked.where("root is null").select("a", "b")
    ends = walked.where("root is not null").select("root").distinct()  # two a partition at most
    partly = regions.where(F.col("n") > window + 1).select("root").unionByName(ends.join(regions, "root", "left_semi")).distinct()
    labels = connected(edges, "forest-labels")
    level = live.join(partly, "root", "left_semi").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = level.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    once = written(narrow(nodes.where("low < high").groupBy("n", "first", "members").agg(F.min("root").alias("root")).select("root", "n")), "forest-open")
    members = level.join(once, "root").join(texts.select("node", "sketch"), "node")
    found = written(sketched_stars(members.withColumn("blocks", F.ceil(F.col("n") / float(block))), like.least), "forest-stars")
    both = written(narrow(edges.unionByName(found)), "forest-edges")
    discard(regions, live, walked, labels, once, found)
    return both


def by_group(rows: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], most: int = 4096) -> DataFrame:
    """Deal rows out by keys and hand work a table of whole groups and the groups' offsets."""
    # a number of partitions keeps Spark from merging these few, small and slow groups into a few tasks
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(partitions, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(whole: pa.Table) -> np.ndarray:
            new = np.zeros(whole.num_rows, bool)
            new[:1] = True
            for k in keys:
                column = whole.column(k).to_numpy()
                new[1:] |= column[1:] != column[:-1]
            return np.flatnonzero(new)

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(batch.slice(at, most))
                if sum(b.num_rows for b in held) >= most:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    starts = groups(whole)
                    if len(starts) > 1:
                        yield from work(whole.slice(0, int(starts[-1])), starts)
                        held = whole.slice(int(starts[-1])).to_batches()
        if held and (whole := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield from work(whole, np.append(groups(whole), whole.num_rows))

    return dealt.mapInArrow(run, schema)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Copies of each row for every pair of blocks that its block is in, of ``blocks`` blocks (one copy
    when one block holds the group)."""
    blocks = F.greatest(F.col("blocks").cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64(F.col("node")), blocks).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks")


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each row's connected part, rows being joined by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def star_rows(nodes: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def inner_pairs(starts: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs to compare in each group, some 100,000 at a time: all of a block, or one block against another."""
    a, b, held = [], [], 0
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if low[s] == high[s]:
            x, y = np.triu_indices(e - s, 1)
        else:
            one, two = np.flatnonzero(own[s:e] == low[s]), np.flatnonzero(own[s:e] == high[s])
            x, y = np.repeat(one, len(two)), np.tile(two, len(one))
        a.append(x + s)
        b.append(y + s)
        held += len(x)
        if held > 100_000:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if a:
        yield np.concatenate(a), np.concatenate(b)


def sketched_stars(members: DataFrame, least: float) -> DataFrame:
    """Stars (a, b) over those pairs of each trie node that have different labels and whose sketches
    agree in at least that share."""

    def work(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes = rows.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")  # stars() takes the least row: make it the least node
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        own, low, high, labels = (rows.column(c).to_numpy() for c in ("own", "low", "high", "label"))
        found_a, found_b = [], []
        for a, b in inner_pairs(starts, own, low, high):
            apart = labels[a] != labels[b]
            a, b = a[apart], b[apart]
            for i in range(0, len(a), 20_000):
                x, y = a[i : i + 20_000], b[i : i + 20_000]
                near = (sketch[x] == sketch[y]).sum(axis=1) >= least * SKETCH
                found_a.append(rank[x[near]])
                found_b.append(rank[y[near]])
        if found_a:
            label = stars(np.concatenate(found_a), np.concatenate(found_b), len(nodes))
            yield star_rows(nodes[order], label)

    rows = in_blocks(members.select("node", "root", "label", "sketch", "blocks"))
    return by_group(rows, ["root", "low", "high"], "a long, b long", work)


def connected(edges: DataFrame, name: str) -> DataFrame:
    """node, label: the least node of each node's connected part, written; nodes without an edge are left
    out. Alternates large and small stars until only stars are left."""
    now = written(narrow(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), name)
    while True:
        both = now.select("u", "v", F.lit(True).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("down")))
        down = F.when(F.col("down"), F.col("v"))
        seen = both.groupBy("u").agg(F.min("v").alias("m"), F.min(down).alias("low"), F.max(down).alias("high"), F.bool_and("down").alias("leaf"))
        # written: next to a plain side Spark can split the rows of a hub
        least = written(narrow(seen.select("u", F.least("u", "m").alias("m"), (F.col("low").isNotNull() & ((F.col("low") != F.col("high")) | ~F.col("leaf"))).alias("moves"))), name)
        if least.where("moves").isEmpty():  # every node with a smaller neighbour has that one alone: stars
            break
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(narrow(others.unionByName(smallest.withColumnRenamed("m", "v"))), name)  # as many rows as large has
        discard(now, least)
        now = after
    labelled = written(narrow(least.select(F.col("u").alias("node"), F.col("m").alias("label"))), name)
    discard(now, least)
    return labelled


def word_shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The shingle set of each text; a shingle's number stands for its words themselves, so equal
    numbers are equal shingles."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    split = [np.array([number(w, len(numbers) + 1) for w in t.lower().split()], np.int64) for t in texts]
    short = [np.concatenate([w, np.zeros(words - len(w), np.int64)]) if 0 < len(w) < words else w for w in split]
    windows = [max(0, len(w) - words + 1) for w in short]
    at = np.cumsum([0, *windows])
    whole = np.concatenate([w[: n] for w, n in zip(short, windows)]) if at[-1] else np.empty(0, np.int64)
    for k in range(1, words):  # pairs of numbers become numbers
        following = np.concatenate([w[k : k + n] for w, n in zip(short, windows)]) if at[-1] else whole
        whole = np.unique(whole * (len(numbers) + 1) + following, return_inverse=True)[1]
    return [np.unique(whole[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]


def family_texts(rows: DataFrame, texts: DataFrame, families: DataFrame) -> DataFrame:
    """node, key, family and text (binary) of every node that has a family; rows are (key, text)."""
    places = families.select("node", F.col("label").alias("family")).join(texts.select("node", "key"), "node")
    return places.join(rows, "key").select("node", "key", "family", F.col("text").cast("binary").alias("text"))


def verified(held: DataFrame, like: Likeness, block: int) -> DataFrame:
    """Per node and task: key, links (verified neighbours there) and root (the key of its verified part)."""
    sizes = written(narrow(held.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))), "forest-sizes")
    blocks = F.greatest(F.ceil(F.col("n") / float(block)), F.ceil(F.col("bytes") / float(VERIFY_BYTES)))
    spread = in_blocks(held.join(sizes.select("family", blocks.alias("blocks")), "family"))

    def work(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts, keys = rows.column("text"), rows.column("key")
        nodes, own, low, high = (rows.column(c).to_numpy() for c in ("node", "own", "low", "high"))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            at = s + np.unique(nodes[s:e], return_index=True)[1]  # repeated rows count once
            close = near_pairs(word_shingles([texts[i].as_py() for i in at.tolist()], like.words), like.threshold)
            np.fill_diagonal(close, False)
            if low[s] != high[s]:
                close &= own[at][:, None] != own[at][None, :]
            label = stars(*np.nonzero(close), len(at))
            yield pa.RecordBatch.from_arrays([taken(keys, at), pa.array(close.sum(axis=1).astype(np.int64)), taken(keys, at[label])], names=["key", "links", "root"])

    return by_group(spread, ["family", "low", "high"], f"key {KEY}, links long, root {KEY}", work, most=128)


def taken(column: pa.ChunkedArray, places: np.ndarray) -> pa.Array:
    found = column.take(pa.array(places))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def near_pairs(sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly; shingles that one set alone holds cannot be shared."""
    sizes = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = max(64, (1 << 22) // len(sets))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        common += part @ part.T
    top, bottom = threshold
    return (top + bottom) * common >= top * (sizes[:, None] + sizes[None, :])


class Indexed(NamedTuple):
    """What the stages of a search have in common; all but rows are written tables."""

    rows: DataFrame  # key, text
    signs: DataFrame  # of every row with a shingle
    texts: DataFrame  # of every shingle set

    def drop(self) -> None:
        discard(self.signs, self.texts)


def indexed(docs: DataFrame, like: Likeness, doc_id: str, text: str) -> Indexed:
    rows = keyed(docs, doc_id, text)
    signs = written(signed(rows, like), "forest-signatures")
    return Indexed(rows, signs, written(distinct_sets(signs), "forest-texts"))


def classes_of(index: Indexed, like: Likeness, block: int) -> tuple[DataFrame, DataFrame]:
    """key, links of every verified node, and node (a key), label (the least key of its class); both written."""
    edges = forest_stars(index.texts, like, block)
    families = connected(edges, "forest-families")
    links = written(verified(family_texts(index.rows, index.texts, families), like, min(block, VERIFY_BLOCK)), "forest-links")
    degrees = written(narrow(links.groupBy("key").agg(F.sum("links").alias("links"))), "forest-degrees")
    classes = connected(links.select(F.col("key").alias("a"), F.col("root").alias("b")), "forest-classes")
    discard(edges, families, links)
    return degrees, classes


def near_duplicates(docs: DataFrame, like: Likeness = FIVE_WORDS, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_links (other texts of at
    least the threshold's similarity), copy_of (least doc_id with the same shingles), n_copies."""
    index = indexed(docs, like, doc_id, text)
    degrees, classes = classes_of(index, like, block)
    nodes = index.texts.select(*SET, "key", "rows").join(degrees, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left")
    placed = index.signs.select(F.col("key.doc_id").alias("doc_id"), *SET).join(nodes, SET)
    number = F.lit(0).cast("bigint")
    with_set = placed.select("doc_id", F.coalesce("label", "key").getField("doc_id").alias("class_id"), F.coalesce("links", number).alias("n_links"), F.col("key.doc_id").alias("copy_of"), (F.col("rows") - 1).alias("n_copies"))
    own = index.rows.where(~F.col("text").rlike(HAS_WORD)).select("key.doc_id")
    result = written(with_set.unionByName(own.select("doc_id", F.col("doc_id").alias("class_id"), number.alias("n_links"), F.col("doc_id").alias("copy_of"), number.alias("n_copies"))), "forest-result")
    index.drop()
    discard(degrees, classes)
    return result


def keep_one_of_each(docs: DataFrame, like: Likeness = FIVE_WORDS, block: int = BLOCK) -> DataFrame:
    """Of each class of similar texts one row, with its columns, whatever those are called: that with the
    least doc_id (null counts as least; of a tie the least text hash; of rows with equal doc_id and text any
    one). Null and empty texts are classes of their own and stay, every row of them."""
    plain, name = numbered_columns(docs)
    index = indexed(plain, like, name["doc_id"], name["text"])
    degrees, classes = classes_of(index, like, block)
    gone = classes.where("node != label").select(F.col("node").alias("key"))
    # the next stages are asked for lazily: what they read stays, the rest goes
    stay = written(index.texts.select("key").join(gone, "key", "left_anti"), "forest-kept")
    index.drop()
    discard(degrees, classes)
    body = F.coalesce(F.col(name["text"]), F.lit(""))
    own = plain.withColumns({"doc_id": F.coalesce(F.col(name["doc_id"]).cast("bigint"), F.lit(-(1 << 63))), "mark": F.xxhash64(body), "bytes": F.octet_length(body).cast("bigint")})
    keys = ["doc_id", "mark", "bytes"]
    kept = own.where(body.rlike(HAS_WORD)).join(stay.select("key.*"), keys, "left_semi").dropDuplicates(keys)
    return kept.unionByName(own.where(~body.rlike(HAS_WORD))).select(*plain.columns).toDF(*docs.columns)


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
