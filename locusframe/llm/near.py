"""MinHash near-dedup: an LSH forest of sorted signature orders, and components of exact links.

Candidates come from the forest of ``similar``: 32 sorted orders of MinHash signatures, walked in
order; an entry's candidates are its neighbours, those with the longest common prefixes, so the depth
that is matched adapts to how crowded a region is. Regions that the walk does not settle are compared
block against block where texts are not connected yet. Connected candidates are families.

Only components are asked for, not every link, so a family is not compared in full:

1. Families are dealt into blocks; each block is verified exactly, on whole sets of shingles that stand
   for the words themselves. A family of one block is settled with that. Larger ones are dealt ``deals``
   times more, each time otherwise, so that parts meet in other blocks: 1 + ``deals`` copies of each of their
   texts, whatever the family's size. Mutually similar texts, a third of the corpus say, become one part here.
2. What is left apart is settled exactly: all texts outside a family's largest part, in blocks, against
   every block of the family; texts of one part are not compared with each other.

Links are never rows: a task returns stars of its verified parts. Only links are lost whose texts never
shared a prefix (expected recall 0.9999 at the threshold, higher above it) or whose sketches are over five
standard deviations off.

Defined cases: null and empty texts (white space alone) have an empty set and are linked with nothing, not
even with each other. Texts of fewer than three words have their whole sequence as one shingle. Null
doc_id counts as the least number, and comes back as null. Rows with the same doc_id are rows of
their own with the component of their own text. Very long texts are whole. Equal sets are linked. An empty
table gives an empty table. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, narrow, table, written
from .similar import HAS_WORD, KEY, SET, VERIFY_BLOCK, VERIFY_BYTES, Likeness, by_group, connected, family_texts, forest_stars, indexed, near_pairs, stars, taken, word_shingles

THREE_WORDS = Likeness(words=3, threshold=(85, 100), margin=0.12, deepest=12)
DEALS = 2


def block_stars(dealt: DataFrame, keys: list[str], like: Likeness) -> DataFrame:
    """Stars (a, b) of keys over the verified links in each group; of rows with a ``label``, those of the
    same label count as linked, and of rows with ``first`` and ``second`` only pairs of one each are compared."""
    labelled, sided = "label" in dealt.columns, "first" in dealt.columns

    def work(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts, own, nodes = rows.column("text"), rows.column("key"), rows.column("node").to_numpy()
        label = rows.column("label").to_numpy() if labelled else nodes
        first = rows.column("first").to_numpy() if sided else None
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            _, at, which = np.unique(nodes[s:e], return_index=True, return_inverse=True)  # repeated rows count once
            at += s
            parts = np.unique(label[at], return_inverse=True)[1]
            apart = parts[:, None] != parts[None, :]
            if sided:  # a text may be on both sides
                outer = np.bincount(which, weights=first[s:e], minlength=len(at)) > 0
                apart &= outer[:, None] | outer[None, :]
            if not apart.any():
                continue
            close = near_pairs(word_shingles([texts[i].as_py() for i in at.tolist()], like.words), like.threshold) & apart
            joined = stars(*np.nonzero(close), len(at))
            moved = np.flatnonzero(joined != np.arange(len(at)))
            yield pa.RecordBatch.from_arrays([taken(own, at[moved]), taken(own, at[joined[moved]])], names=["a", "b"])

    return by_group(dealt, keys, f"a {KEY}, b {KEY}", work, most=128)


def blocks_of(rows: Column, size: Column, block: int) -> Column:
    return F.greatest(F.ceil(rows / float(block)), F.ceil(size / float(VERIFY_BYTES))).cast("int")


def open_families(held: DataFrame, parts: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of large families with ``label``, a number of their part so far; and family, biggest (the
    label of its largest part) of those that have more than one. Both written."""
    marked = held.join(large, "family").join(parts.select(F.col("node").alias("key"), F.col("label").alias("part")), "key", "left")
    # a hash of the part's least key: two parts of one family would need the same 64 bits
    labelled = written(marked.withColumn("label", F.xxhash64(F.coalesce("part", "key"))).drop("part"), "near-members")
    sizes = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    biggest = sizes.groupBy("family").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "label")).alias("top")).where("parts > 1")
    return labelled, written(narrow(biggest.select("family", F.col("top.label").alias("biggest"))), "near-open")


def components(held: DataFrame, like: Likeness, block: int, deals: int) -> DataFrame:
    """node (a key), label (the least key of its component), written; keys without a link are left out."""
    sizes = written(narrow(held.groupBy("family").agg(blocks_of(F.count(F.lit(1)), F.sum(F.octet_length("text")), block).alias("blocks"))), "near-sizes")
    large = sizes.where("blocks > 1")
    times = F.when(F.col("blocks") > 1, deals).otherwise(0)
    dealt = held.join(sizes, "family").withColumn("deal", F.explode(F.sequence(F.lit(0), times)))
    own = F.pmod(F.xxhash64("deal", "node"), F.col("blocks")).cast("int")
    edges = written(block_stars(dealt.withColumn("own", own), ["family", "deal", "own"], like), "near-stars")
    parts = connected(edges, "near-parts")
    if large.isEmpty():
        discard(edges, sizes)
        return parts
    labelled, still = open_families(held, parts, large)
    if still.isEmpty():
        discard(edges, sizes, labelled, still)
        return parts
    going = labelled.join(still, "family")
    outside = going.where("label != biggest")
    counts = written(narrow(outside.groupBy("family").agg(blocks_of(F.count(F.lit(1)), F.sum(F.octet_length("text")), block).alias("outer"))), "near-outside")
    both = going.join(counts, "family")
    every = {name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name) for name, n in (("one", "outer"), ("two", "blocks"))}
    kept = ["node", "key", "family", "text", "label"]
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    left = both.where("label != biggest").select(*kept, place("outer", 1).alias("one"), every["two"], F.lit(True).alias("first"))
    right = both.select(*kept, every["one"], place("blocks", 2).alias("two"), F.lit(False).alias("first"))
    found = written(block_stars(left.unionByName(right), ["family", "one", "two"], like), "near-stars")
    joined = parts.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found)
    whole = connected(joined, "near-components")
    discard(edges, sizes, parts, labelled, still, counts, found)
    return whole


def near_components(docs: DataFrame, like: Likeness = THREE_WORDS, block: int = VERIFY_BLOCK, deals: int = DEALS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (the least doc_id of its component), kept
    (whether doc_id is component_id)."""
    index = indexed(docs, like, doc_id, text)
    candidates = forest_stars(index.texts, like)
    families = connected(candidates, "near-families")
    held = written(family_texts(index.rows, index.texts, families), "near-texts")
    parts = components(held, like, block, deals)
    discard(candidates, families, held)
    sets = index.texts.select(*SET, "key").join(parts.withColumnRenamed("node", "key"), "key", "left").select(*SET, F.coalesce("label", "key").getField("doc_id").alias("component_id"))
    linked = index.signs.select(F.col("key.doc_id").alias("doc_id"), *SET).join(sets, SET).select("doc_id", F.col("shingles").cast("bigint").alias("n_shingles"), "component_id")
    alone = index.rows.where(~F.col("text").rlike(HAS_WORD)).select(F.col("key.doc_id").alias("doc_id"), F.lit(0).cast("bigint").alias("n_shingles"), F.col("key.doc_id").alias("component_id"))
    none = F.lit(-(1 << 63))
    result = linked.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    result = written(result.withColumns({c: F.nullif(c, none) for c in ("doc_id", "component_id")}), "near-result")
    index.drop()
    discard(parts)
    return result


def op13_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


#: All pairs by shared shingles, and the least number reachable over links of at least 85 %.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END) AS s
    FROM words, unnest(range(1, greatest(2, len(w) - 1))) AS u(i) WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
    SELECT doc_id AS origin, doc_id AS met FROM documents UNION SELECT origin, y FROM reach JOIN links ON x = met
), least AS (
    SELECT origin AS doc_id, min(met) AS component_id FROM reach GROUP BY origin
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
