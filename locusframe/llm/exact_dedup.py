"""Exact duplicates by owners in Patricia tries.

1. Each task inserts its normalised texts into a compressed radix trie and writes, for every
   document, the row key of the first equal text it met, and for every distinct text one row with
   the smallest identifier and the number of copies. A group of copies, however large, leaves a
   task as one row. When the local trie outgrows its memory it starts anew; that only costs a few
   rows more.
2. Those rows are dealt out by length and content hash. Each partition inserts the full byte strings
   into a trie whose terminal nodes keep the smallest identifier; a trie over its memory limit
   spills its heaviest subtree to a file of its own, which is read back as a trie of its own. Such a
   file has no name, so nothing of it stays when its task ends, however it ends.
3. The owners go back to the documents by the row key of step 1; such a key never has more rows
   than one task read.

Defined cases: null text counts as empty; texts that are empty are equal. A null doc_id sorts last.
Of repeated rows (same doc_id, equal text) one is kept. Ties cannot arise otherwise. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, numbered_columns, row_bytes, table, text_batches, written

MEMORY = 64 << 20


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    lead = b" " if text[0] in b" \t\n\r\x0b\x0c" else b""
    tail = b" " if text[-1] in b" \t\n\r\x0b\x0c" else b""
    return lead + b" ".join(words) + tail


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.children, self.owner = label, {}, owner


class Spill:
    """A subtree's strings in a file without a name."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile(prefix="subtree-")

    def add(self, *entry: object) -> None:
        pickle.dump(entry, self.file)

    def take(self, other: Spill) -> None:
        other.file.seek(0)
        shutil.copyfileobj(other.file, self.file)
        other.file.close()

    def entries(self) -> Iterator[tuple]:
        """All entries, once; the file goes."""
        with self.file as lines:
            lines.seek(0)
            while True:
                try:
                    yield pickle.load(lines)
                except EOFError:
                    return


class PatriciaOwners:
    """Byte strings with the smallest identifier, the summed count and the members of each."""

    def __init__(self, memory: int = MEMORY):
        self.root, self.memory, self.held = Node(b""), memory, 0
        self.files: list[Spill] = []

    def insert(self, text: bytes, identifier: tuple, count: int, members: list[int]) -> list | None:
        """The owner record [identifier, count, members], or None when the text went to a spill file."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += len(child.label) + 300
                node, at = child, len(text)
            elif isinstance(child, Spill):
                child.add(text, identifier, count, members)
                return None
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                same = common_prefix(child.label, text, at)
                upper = node.children[text[at]] = Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node, at = upper, at + same
        if node.owner is None:
            node.owner = [identifier, count, members]
        else:
            node.owner[0] = min(node.owner[0], identifier)
            node.owner[1] += count
            node.owner[2].extend(members)
        owner = node.owner
        if self.held > self.memory:
            self.spill()
        return owner

    def spill(self) -> None:
        node, path = self.root, b""
        while node.owner is None and len(node.children) == 1 and isinstance(child := next(iter(node.children.values())), Node):
            node, path = child, path + child.label
        live = {k: weight(c) for k, c in node.children.items() if isinstance(c, Node)}
        if not live:
            self.memory *= 2  # one string, or nothing but spilled subtrees
            return
        first = max(live, key=live.get)
        out = Spill()
        for text, owner in terminals(node.children[first], path):
            out.add(text, *owner)
        for inner in spilled(node.children[first]):  # their strings come here from now on
            out.take(inner)
            self.files.remove(inner)
        node.children[first] = out
        self.files.append(out)
        self.held -= live[first]

    def owners(self) -> Iterator[list]:
        """Every owner record; spilled subtrees are read back one at a time."""
        for _, owner in terminals(self.root, b""):
            yield owner
        self.root = Node(b"")
        for spill in self.files:
            part = PatriciaOwners(self.memory)
            for entry in spill.entries():
                part.insert(*entry)
            yield from part.owners()


def weight(node: Node) -> int:
    total, left = 0, [node]
    while left:
        x = left.pop()
        total += len(x.label) + 300
        left += [c for c in x.children.values() if isinstance(c, Node)]
    return total


def spilled(node: Node) -> list[Spill]:
    found, left = [], [node]
    while left:
        x = left.pop()
        found += [c for c in x.children.values() if isinstance(c, Spill)]
        left += [c for c in x.children.values() if isinstance(c, Node)]
    return found


def terminals(node: Node, path: bytes) -> Iterator[tuple[bytes, list]]:
    left = [(node, path + node.label)]
    while left:
        x, text = left.pop()
        if x.owner is not None:
            yield text, x.owner
        left += [(c, text + c.label) for c in x.children.values() if isinstance(c, Node)]


def common_prefix(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of label equal those of text from at on."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


LOCAL = "row_key long, doc_id long, local_key long, text_sha256 string, copies long, least_id long, least_row long, length long, content_hash long, body binary"


def local_tries(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        trie, bodies = PatriciaOwners(1 << 62), {}

        def flush() -> pa.RecordBatch:
            owners = [owner for _, owner in terminals(trie.root, b"")]
            texts = [bodies[o[2]] for o in owners]
            least = [None if o[0][0] else o[0][1] for o in owners]
            return arrow_rows(
                [None] * len(owners), [None] * len(owners), [o[2] for o in owners], [None] * len(owners), [o[1] for o in owners], least, [o[0][2] for o in owners],
                [len(t) for t in texts], [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], texts,
            )

        for batch in batches:
            for start, stop in text_batches(batch, "text"):
                part = batch.slice(start, stop - start)
                ids, texts = part.column("doc_id").to_pylist(), row_bytes(part.column("text"))
                keys, firsts, digests = [], [], []
                for doc_id, raw in zip(ids, texts):
                    text = normalised(raw)
                    owner = trie.insert(text, (doc_id is None, doc_id or 0, key), 1, [key])
                    if isinstance(owner[2], list):  # met for the first time
                        owner[2] = First(key)
                        bodies[key] = text
                    keys.append(key)
                    firsts.append(int(owner[2]))
                    digests.append(hashlib.sha256(text).hexdigest())
                    key += 1
                n = len(keys)
                yield arrow_rows(keys, ids, firsts, digests, *[[None] * n] * 6)
                if trie.held > memory:
                    yield flush()
                    trie, bodies = PatriciaOwners(1 << 62), {}
        if bodies:
            yield flush()

    return run


class First(int):
    """The row key of the first copy; later members only count."""

    def extend(self, members: list[int]) -> None:
        pass


def arrow_rows(*columns: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in LOCAL.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary()}
    types = [kinds.get(x.split()[1], pa.int64()) for x in LOCAL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def owner_tries(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaOwners(memory)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("body", "least_id", "least_row", "copies", "local_key")]
            for body, least_id, least_row, copies, local_key in zip(*columns):
                trie.insert(body, (least_id is None, least_id or 0, least_row), copies, [local_key])
        made: list[tuple] = []
        for (missing, keep_id, keep_row), count, members in trie.owners():
            made += [(m, None if missing else keep_id, keep_row, count) for m in members]
            if len(made) > 50_000:
                yield owner_rows(made)
                made = []
        if made:
            yield owner_rows(made)

    return run


def owner_rows(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], names=["local_key", "keep_id", "keep_row", "group_size"])


def exact_duplicates(docs: DataFrame, memory: int = MEMORY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    lean(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    local = written(rows.mapInArrow(local_tries(memory), LOCAL), "exact-dedup")
    dealt = local.where("row_key is null").select("local_key", "copies", "least_id", "least_row", "length", "content_hash", "body").repartition("length", "content_hash")
    owners = dealt.mapInArrow(owner_tries(memory), "local_key long, keep_id long, keep_row long, group_size long")
    found = local.where("row_key is not null").select("row_key", "doc_id", "local_key", "text_sha256").join(owners, "local_key")
    return found.select("doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns, whatever those are called: of equal texts (null
    and empty ones are equal) that with the smallest doc_id, a null doc_id being the largest; of
    repeated rows one. The join and that choice have the same keys, so texts are shuffled once."""
    plain, name = numbered_columns(docs)
    lowest = F.lit(-(1 << 63))
    own = F.coalesce(F.col(name["doc_id"]).cast("bigint"), lowest).alias("own_id")
    digest = F.sha2(F.regexp_replace(F.coalesce(name["text"], F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    found = exact_duplicates(plain, doc_id=name["doc_id"], text=name["text"])
    kept = found.where("kept").select(F.coalesce("doc_id", lowest).alias("own_id"), F.col("text_sha256").alias("own_sha256"))
    keys = ["own_id", "own_sha256"]
    stay = plain.select("*", own, digest.alias("own_sha256")).join(kept, keys, "left_semi")
    return stay.dropDuplicates(keys).select(*plain.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
