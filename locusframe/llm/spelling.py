"""Spelling variants: words one code point apart, found in a trie of letter-group counts.

1. Runs of letters are counted in every task (distinct words of a document once, with their number), then
   by one shuffle. Words of at least ``least_length`` code points and ``least_count`` occurrences stay.
2. A word's vector holds how many of its letters fall into each of ten letter groups. The trie has one
   level for each group; a node is a prefix of the vector. An inserted or deleted code point changes one
   count by one, a replaced one adds one to a count and takes one from another (or from the same), so
   a search may follow counts with a surplus of one and a deficit of one in all.
3. The upper levels are rows: words sit in the deepest node so far, and searches, each with what is left
   of its budget, are joined with the nodes of their level. Nodes of more than ``leaf`` words are
   divided at the next group, and only the searches that reach them go on; a search ends where no word
   is. So the trie is as deep as the words need and no task gets a whole level.
4. A task holds the words of one upper node (or a block of at most ``leaf`` of them where even the whole
   vector is shared by more) as the lower levels of the trie, in numpy arrays, and walks all searches of
   that node depth first by levels, in runs of a bounded number. Words at the leaves are verified: equal
   but for one code point. A task returns for each search how many words it found and the best of them,
   never the pairs.
5. A word's form is its best near word if that is at least ``ratio`` times as frequent; roots follow
   forms by pointer doubling (counts grow along a path, so it has no circle and a logarithmic length).

Letters are the code points of Latin-1 that the contract names, so words are rows of bytes.

Defined cases: null and empty texts have no words. Null doc_id counts as empty text in the draw of
deletions. Rows with the same doc_id and text are rows of their own. Words of any length take part;
counts above 63 of a letter group count as 63, which keeps differences of at most one. Ties of frequency
go to the smallest word in code-point order. An empty table gives an empty table. Columns other than
doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, table, text_batches, written

RUN = re.compile("[a-zÀ-ÿ]+")
DELETED = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
GROUPS = 10
BITS = 6  # of a count in a packed vector
TOP = 3  # levels that every search crosses as rows
LEAF = 2048
SEARCHES = 32_768  # of one node in a task
HELD_BYTES = 64 << 20  # of words that a task counts at once
PAIRS = 200_000  # pairs that are verified at once


def counted_words(batches: Iterator[pa.RecordBatch], least_length: int) -> Iterator[pa.RecordBatch]:
    """word, n: some rows for each word of a task; words too short to matter are left out."""
    held: Counter = Counter()
    room = HELD_BYTES

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return made

    for batch in batches:
        for start, stop in text_batches(batch, "text"):
            part = batch.slice(start, stop - start)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes.lower() takes A-Z alone
                    draw = zlib.crc32(run.encode(), seed)
                    if draw % DELETED == 0:
                        at = draw % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_length:
                        held[run] += n
                        room -= len(run) + 100
                if room < 0:
                    yield flush()
                    room = HELD_BYTES
    if held:
        yield flush()


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that count."""
    lean(docs.sparkSession)
    counts = docs.select("doc_id", "text").mapInArrow(lambda batches: counted_words(batches, least_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def flat(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes in Latin-1, end to end, and their offsets."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return raw, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def vectors(words: Sequence[str], groups: int = GROUPS) -> np.ndarray:
    """Letter-group counts, words x groups; a letter's group is its code point modulo their number."""
    raw, offsets = flat(words)
    row = np.repeat(np.arange(len(words)), np.diff(offsets))
    counts = np.bincount(row * groups + raw % groups, minlength=len(words) * groups)
    return np.minimum(counts.reshape(len(words), groups), (1 << BITS) - 1)


def packed(vector: np.ndarray) -> np.ndarray:
    """A vector as one number, the first group in the highest bits."""
    out = np.zeros(len(vector), np.int64)
    for g in range(vector.shape[1]):
        out = (out << BITS) | vector[:, g]
    return out


def node_at(level: int) -> Column:
    """The number of the vector's first ``level`` counts."""
    return F.call_function("shiftright", "vector", F.lit(BITS * (GROUPS - level)))


def with_vectors(words: DataFrame) -> DataFrame:
    """word, n, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed(vectors(batch.column("word").to_pylist())))], names=["word", "n", "vector"])

    return words.mapInArrow(run, "word string, n long, vector long")


def stepped(searches: DataFrame, level: int) -> DataFrame:
    """Each search at the children of its node that its budget allows: the own count of that group, one
    more for the surplus, one less for the deficit."""
    own = F.call_function("shiftright", "vector", F.lit(BITS * (GROUPS - level))).bitwiseAND(F.lit((1 << BITS) - 1))
    moves = F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1)))
    moved = searches.withColumn("move", moves).withColumn("child", own + F.col("move"))
    allowed = ((F.col("move") != 1) | (F.col("surplus") == 1)) & ((F.col("move") != -1) | (F.col("deficit") == 1)) & F.col("child").between(0, (1 << BITS) - 1)
    left = [(F.col(name) - (F.col("move") == sign).cast("int")).alias(name) for name, sign in (("surplus", 1), ("deficit", -1))]
    return moved.where(allowed).select("word", "vector", (F.col("node") * (1 << BITS) + F.col("child")).alias("node"), *left)


def dealt(words: DataFrame, leaf: int, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Members (word, n, vector) and searches (word, vector, surplus, deficit), each with level, node, block
    and part: at most about ``leaf`` members and ``most`` searches have those four in common. Also the
    written tables that both read."""
    members, searches, scratch = [], [], []
    searching = words.select("word", "vector", F.lit(0).cast("long").alias("node"), F.lit(1).alias("surplus"), F.lit(1).alias("deficit"))
    for level in range(1, TOP + 1):
        searching = stepped(searching, level)
    staying = words
    for level in range(TOP, GROUPS + 1):
        placed = staying.withColumn("node", node_at(level))
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n_words")).join(searching.groupBy("node").agg(F.count(F.lit(1)).alias("n_searches")), "node")
        blocks = F.ceil(F.col("n_words") / float(leaf)) if level == GROUPS else F.when(F.col("n_words") > leaf, 0).otherwise(1)
        nodes = written(sizes.select("node", blocks.cast("int").alias("blocks"), F.ceil(F.col("n_searches") / float(most)).cast("int").alias("parts")), "spelling-nodes")
        placed, searching = (x.join(nodes, "node") for x in (placed, searching))
        here, key = F.col("blocks") > 0, [F.lit(level).alias("level"), "node"]
        every = {name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name) for name in ("block", "part")}
        one = {name: F.pmod(F.xxhash64("word"), F.col(f"{name}s")).cast("int").alias(name) for name in ("block", "part")}
        members.append(placed.where(here).select("word", "n", "vector", *key, one["block"], every["part"]))
        searches.append(searching.where(here).select("word", "vector", "surplus", "deficit", *key, every["block"], one["part"]))
        scratch.append(nodes)
        if level == GROUPS or nodes.where("blocks = 0").isEmpty():
            break
        staying = written(placed.where(~here).select("word", "n", "vector"), "spelling-members")
        going = written(searching.where(~here).select("word", "vector", "node", "surplus", "deficit"), "spelling-searches")
        scratch += [staying, going]
        searching = stepped(going, level + 1)
    return reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, searches), scratch


class Trie:
    """Vectors as nodes by level: a node is its parent's number and its own count."""

    def __init__(self, vector: np.ndarray):
        self.order = np.lexsort(vector.T[::-1])
        parent, self.levels = np.zeros(len(vector), np.int64), []
        for g in range(vector.shape[1]):
            keys, parent = np.unique((parent << BITS) | vector[self.order, g], return_inverse=True)
            self.levels.append(keys)
        self.first = np.searchsorted(parent, np.arange(int(parent[-1]) + 2))  # members of each leaf

    def search(self, vector: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(searches, members) at the leaves that the budgets reach."""
        row, node = np.arange(len(vector)), np.zeros(len(vector), np.int64)
        for g, keys in enumerate(self.levels):
            found = []
            for move in (0, 1, -1):
                may = np.ones(len(row), bool) if move == 0 else (surplus if move == 1 else deficit) > 0
                child = vector[row, g] + move
                may &= (child >= 0) & (child < 1 << BITS)
                key = (node << BITS) | np.maximum(child, 0)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                may &= keys[at] == key
                found.append((row[may], at[may], surplus[may] - (move == 1), deficit[may] - (move == -1)))
            row, node, surplus, deficit = (np.concatenate(x) for x in zip(*found))
        sizes = self.first[node + 1] - self.first[node]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(row, sizes), self.order[np.repeat(self.first[node], sizes) + within]


def one_apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether word x of a and word y of b differ by exactly one inserted, deleted or replaced byte."""
    (raw_a, at_a), (raw_b, at_b) = a, b
    start_a, start_b = at_a[x], at_b[y]
    size_a, size_b = at_a[x + 1] - start_a, at_b[y + 1] - start_b
    out = np.zeros(len(x), bool)
    for shift in (0, 1, -1):  # how much longer b's word is
        pairs = np.flatnonzero(size_b - size_a == shift)
        shorter = np.minimum(size_a, size_b)[pairs]
        for rows in runs_of(shorter, 1 << 22):
            own, width = pairs[rows], shorter[rows]
            ends = np.cumsum(width)
            row = np.repeat(np.arange(len(own)), width)
            place = np.arange(int(ends[-1])) - np.repeat(ends - width, width)
            front = raw_a[start_a[own][row] + place] != raw_b[start_b[own][row] + place]
            if shift == 0:
                out[own] = np.bincount(row, weights=front, minlength=len(own)) == 1
                continue
            # the shorter word is a prefix and a suffix of the longer one that together cover it
            back = raw_a[start_a[own][row] + place + (shift == -1)] != raw_b[start_b[own][row] + place + (shift == 1)]
            first = np.minimum.reduceat(np.where(front, place, np.iinfo(np.int64).max), ends - width)
            last = np.maximum.reduceat(np.where(back, place, -1), ends - width)
            out[own] = np.minimum(first, width) > last
    return out


def runs_of(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about ``most`` in all, of one item at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield slice(start, stop)
        start = stop


class Node:
    """The members of one node, ready to be searched; ``level`` upper levels are the same in all."""

    def __init__(self, members: pa.Table, level: int):
        self.trie = Trie(unpacked(members.column("vector").to_numpy(), level))
        self.words, self.n = np.array(members.column("word").to_pylist(), object), members.column("n").to_numpy()
        self.ranked = np.lexsort((np.argsort(np.argsort(self.words)), -self.n))  # best first
        self.place = np.empty(len(self.words), np.int64)
        self.place[self.ranked] = np.arange(len(self.words))
        self.text = flat(self.words)

    def found(self, searches: pa.RecordBatch, level: int) -> pa.RecordBatch:
        looked = searches.column("word").to_pylist()
        row, member = self.trie.search(unpacked(searches.column("vector").to_numpy(), level), searches.column("surplus").to_numpy(), searches.column("deficit").to_numpy())
        text = flat(looked)
        near, best = np.zeros(len(looked), np.int64), np.full(len(looked), len(self.words))
        for p in range(0, len(row), PAIRS):
            x, y = row[p : p + PAIRS], member[p : p + PAIRS]
            good = one_apart(text, self.text, x, y)
            np.add.at(near, x[good], 1)
            np.minimum.at(best, x[good], self.place[y[good]])
        has = np.flatnonzero(near)
        chosen = self.ranked[best[has]]
        return pa.RecordBatch.from_arrays([pa.array([looked[i] for i in has.tolist()], pa.string()), pa.array(near[has]), pa.array(self.n[chosen]), pa.array(self.words[chosen], pa.string())], names=["word", "n_near", "best_n", "best"])


def unpacked(vector: np.ndarray, level: int) -> np.ndarray:
    """The counts below the first ``level`` ones (one column of zeros when there are none)."""
    columns = [(vector >> (BITS * (GROUPS - 1 - g))) & ((1 << BITS) - 1) for g in range(level, GROUPS)]
    return np.stack(columns or [np.zeros(len(vector), np.int64)], axis=1)


def found_near(members: DataFrame, searches: DataFrame) -> DataFrame:
    """Per search and task: n_near, and best, the near word of largest best_n; searches that find none give no row."""
    keys = ["level", "node", "block", "part"]
    none = F.lit(0).alias
    both = members.select(*keys, none("kind"), "word", "n", "vector", none("surplus"), none("deficit"))
    both = both.unionByName(searches.select(*keys, F.lit(1).alias("kind"), "word", F.lit(0).cast("long").alias("n"), "vector", "surplus", "deficit"))
    partitions = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(partitions, *keys).sortWithinPartitions(*keys, "kind")  # members come before the searches of their node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, node = None, [], None
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in (*keys, "kind")]
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:]):
                key = tuple(int(c[s]) for c in columns[:-1])
                if key != now:
                    now, members, node = key, [], None
                if columns[-1][s] == 0:
                    members.append(batch.slice(s, e - s).select(["word", "n", "vector"]))
                elif members:
                    node = node or Node(pa.Table.from_batches(members), key[0])
                    for at in range(s, e, 2048):
                        if (made := node.found(batch.slice(at, min(2048, e - at)), key[0])).num_rows:
                            yield made

    return ordered.mapInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, leaf: int = LEAF, most: int = SEARCHES) -> DataFrame:
    """word, n_near, best_n, best of every word (of word, n) that has a near word."""
    known = written(with_vectors(words), "spelling-vectors")
    members, searches, scratch = dealt(known, leaf, most)
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), "best")).alias("top")
    found = found_near(members, searches).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    made = written(found.select("word", "n_near", (-F.col("top.rank")).alias("best_n"), F.col("top.best").alias("best")), "spelling-near")
    discard(known, *scratch)
    return made


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of (word, form), form never null: forms are followed to the last."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped_ = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = stepped_.select("word", "root")
        if stepped_.where("moved").isEmpty():
            return now
        now = stepped_


def variants(words: DataFrame, ratio: int = RATIO, leaf: int = LEAF, most: int = SEARCHES) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near, form_n."""
    near = near_words(words, leaf, most)
    joined = words.join(near, "word", "left")
    good = F.col("best_n") >= F.lit(ratio) * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    words = written(vocabulary(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))), "spelling-words")
    return variants(words)


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
