"""Fill-in-the-middle: texts cut at two token ends, their parts put in another order.

A text's token ends form a compressed set of offsets in the manner of roaring bitmaps: every 65,536 code
points have a container, which holds its offsets as a sorted array, as a bitmap or as runs, whichever is
smallest. Cumulative cardinalities find the container of the k-th token end by binary search, a select
inside it gives the offset. Both cuts are two such selects; tokens are never built.

Which units are cut, and whether a text stays plain, depends on doc_id and ``seed`` alone (the first four
8-digit groups of a SHA-256), so any executor gives the same result again.

Defined cases: null text counts as empty; empty texts and texts that contain a marker stay plain. Null
doc_id hashes like an empty one. Rows with the same doc_id and text give equal results; every row gives
one. Very long texts are cut whole, the set takes at most 8 KB for 65,536 code points. An empty table
gives an empty table. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table

MARKERS = ("<P>", "<S>", "<M>")
SEED = 1
PLAIN_FROM = 90  # of 100: draws from here on stay plain
SPM_BELOW = 20  # of 100: draws below are suffix first
CONTAINER = 1 << 16
ARRAY_MOST = 4096  # offsets; beyond, a bitmap is smaller


class ArrayContainer:
    """Sorted 16-bit offsets."""

    def __init__(self, offsets: np.ndarray):
        self.offsets, self.cardinality = offsets.astype(np.uint16), len(offsets)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class BitmapContainer:
    """A bit for each offset, and how many are set before each 64 of them."""

    def __init__(self, present: np.ndarray):
        words = np.zeros(-(-len(present) // 64) * 64, bool)
        words[: len(present)] = present
        self.bits = np.packbits(words, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(words.reshape(-1, 64).sum(axis=1))])
        self.cardinality = int(self.before[-1])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        own = np.flatnonzero(np.unpackbits(self.bits[8 * word : 8 * word + 8], bitorder="little"))
        return 64 * word + int(own[k - self.before[word]])


class RunContainer:
    """First offsets of maximal runs, and how many offsets come before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), np.concatenate([[0], np.cumsum(lengths)])
        self.cardinality = int(self.before[-1])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(present: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of the offsets where present is true."""
    offsets = np.flatnonzero(present)
    breaks = np.flatnonzero(np.diff(offsets) > 1) + 1
    runs = len(breaks) + 1 if len(offsets) else 0
    plain = 2 * len(offsets) if len(offsets) <= ARRAY_MOST else CONTAINER // 8
    if 4 * runs < plain:
        edges = np.concatenate([[0], breaks, [len(offsets)]])
        return RunContainer(offsets[edges[:-1]], np.diff(edges))
    return ArrayContainer(offsets) if len(offsets) <= ARRAY_MOST else BitmapContainer(present)


class BoundarySet:
    """The set of true places of a mask."""

    def __init__(self, present: np.ndarray):
        self.containers = [container(present[i : i + CONTAINER]) for i in range(0, len(present), CONTAINER)]
        self.before = np.concatenate([[0], np.cumsum([c.cardinality for c in self.containers])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th place, from 0."""
        which = int(np.searchsorted(self.before, k, side="right")) - 1
        return which * CONTAINER + self.containers[which].select(k - int(self.before[which]))


def token_ends(text: str) -> BoundarySet:
    """The last code point of each token: maximal runs of A-Z and a-z, and every other code point alone."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32) | np.uint32(32)
    letter = (points >= 97) & (points <= 122)
    last = np.ones(len(letter), bool)
    last[:-1] = ~(letter[:-1] & letter[1:])
    return BoundarySet(last)


def arranged(text: str, first: int, second: int, form: str) -> str:
    """The text cut at two offsets, in the order of the form."""
    p, s, m = MARKERS
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{p}{prefix}{s}{suffix}{m}{middle}"
    return f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else text


def restored(output: str, form: str) -> str:
    """The text that an output was made from. No part holds a marker, and a marker's first character stands
    nowhere else in markers, so the first occurrence after its predecessor is the marker itself."""
    p, s, m = MARKERS
    if form == "plain":
        return output
    one, two = (p, s) if form == "psm" else (s, p)
    at = output.index(two, len(one))
    end = output.index(m, at + len(two))
    left, right, middle = output[len(one) : at], output[at + len(two) : end], output[end + len(m) :]
    return left + middle + right if form == "psm" else right + middle + left


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (code points;
    null if plain), output, and restored, which is read back from output and form."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *draws)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        made = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output", "restored")}
        for body, *h in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4"))):
            ends = token_ends(body)
            n = len(ends)
            plain = not body or h[2] % 100 >= plain_from or any(x in body for x in MARKERS)
            form = "plain" if plain else "spm" if h[3] % 100 < spm_below else "psm"
            units = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            first, second = (ends.select(k - 1) + 1 if k else 0 for k in units)
            output = arranged(body, first, second, form)
            for name, value in zip(made, (n, form, None if plain else first, None if plain else second - first, output, restored(output, form))):
                made[name].append(value)
        kinds = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
        yield {"doc_id": batch.column("doc_id"), **{k: pa.array(v, kinds.get(k, pa.string())) for k, v in made.items()}}

    return mapped(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
    SELECT doc_id, body, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS tokens,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM hashed
), counted AS (
    SELECT *, len(tokens) AS n,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM counted
), parts AS (
    SELECT doc_id, body, n, form, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix,
        coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle, coalesce(array_to_string(tokens[b + 1:n], ''), '') AS suffix
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM parts
"""
