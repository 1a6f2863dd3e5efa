"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each of 2**slot_bits slots, one bit per language. An n-gram (a
fixed number of bytes of the lower-cased text, everything in ASCII but letters being a space) is
looked up in ``hashes`` slots; the AND of the slots names every language that contains it. A text's
counts per language are popcounts over its n-grams, taken as histograms of the mask's bytes. A
language whose bits fill the share f of the slots answers a foreign n-gram with probability
f**hashes; the counts are corrected for that, and the largest one decides.

Learning counts the documents of each n-gram per language with partial sums in every task. An
n-gram goes into the filter of each language that has it in at least ``least_share`` of its learnt
documents (one document at least). At most about ``max_docs`` documents of each language, picked by
a hash of doc_id and text, are learnt from (a bound on fitting only; all documents are scored). The
filter has a fixed size and is broadcast; a slot has as many 64-bit words as the languages need.

Defined cases: null text or text without any letter: ``und`` with score 0. Texts with letters always
get a learnt language; one whose n-grams are all unknown gets the first one with score 0. Ties go to
the language that sorts first. Without a learnable row every text is ``und``. Rows with null lang or
null text teach nothing; null doc_id counts as the empty text in the hold-out hash. Repeated rows are
scored alike; an empty table gives an empty table. Texts are whole, long ones included. Other columns
pass through if named in ``keep``; those called lang_pred or score give way to the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, mixed, numbered_columns, powers, prefix_hashes, table, text_batches

NGRAM = 5
SLOT_BITS = 20
HASHES = 2
MAX_DOCS = 4000
LEAST_SHARE = 0.0005
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = 32
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of each text (with a space on both sides) and the row offsets."""
    lowered = [b" " + t.lower().encode("utf-8", "replace") + b" " * NGRAM for t in texts]
    raw = _CLEAN[np.frombuffer(b"".join(lowered), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lowered])]).astype(np.int64)
    sums = prefix_hashes(raw.astype(np.uint64) + np.uint64(1))
    n = len(raw) - NGRAM + 1
    hashes = mixed((sums[NGRAM:] - sums[:-NGRAM]) * powers(len(raw))[1][:n]) if n > 0 else np.empty(0, np.uint64)
    inside = np.ones(max(n, 0), bool)
    for k in range(1, NGRAM):  # those that reach into the next text, or lie in the padding
        ends = offsets[1:] - k
        inside[ends[(ends >= 0) & (ends < n)]] = False
    blank = (raw[:n] == 32) & (raw[1 : n + 1] == 32)
    inside &= ~blank
    kept = np.flatnonzero(inside)
    return hashes[kept], np.searchsorted(kept, offsets).astype(np.int64)


def slots(hashes: np.ndarray, which: int, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(which * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


class Filter:
    """masks: a row of 64-bit words for each slot; bit i of a slot stands for language i."""

    def __init__(self, languages: list[str], masks: np.ndarray, bits: int, hashes: int):
        self.languages, self.masks, self.bits, self.hashes = languages, masks, bits, hashes
        filled = [((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        self.false_positive = np.array(filled) ** hashes

    def masks_of(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bit masks (a row of words each)."""
        found = self.masks[slots(hashes, 0, self.bits)]
        for k in range(1, self.hashes):
            found = found & self.masks[slots(hashes, k, self.bits)]
        return found

    def shares(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text and language, the corrected share of n-grams that the language contains."""
        rows, size = len(offsets) - 1, np.diff(offsets)
        masks = self.masks_of(hashes)
        counts = np.zeros((rows, len(self.languages)))
        row = np.repeat(np.arange(rows), size)
        for first in range(0, len(self.languages), 8):
            part = ((masks[:, first // 64] >> np.uint64(first % 64)) & np.uint64(255)).astype(np.int64)
            histogram = np.bincount((row << 8) | part, minlength=rows << 8).reshape(rows, 256)
            ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
            counts[:, first : first + 8] = (histogram @ ones)[:, : len(self.languages) - first]
        seen = counts / np.maximum(size, 1)[:, None]
        return np.clip((seen - self.false_positive) / np.maximum(1 - self.false_positive, 1e-9), 0, 1)


def learnable(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 != 2


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, bits: int = SLOT_BITS, hashes: int = HASHES, least_share: float = LEAST_SHARE) -> Filter:
    """Learn from doc_id, text and lang of every given row (the caller leaves held-out rows away)."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    masks = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    if not languages:
        return Filter([], masks, bits, hashes)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    code = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: list[np.ndarray] = []
        for batch in batches:
            for start, stop in text_batches(batch, "text"):
                part = batch.slice(start, stop - start)
                grams, offsets = gram_hashes(part.column("text").to_pylist())
                lang = np.repeat(np.array([code[x] for x in part.column("lang").to_pylist()], np.int64), np.diff(offsets))
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                order = np.lexsort((grams, row))
                new = np.concatenate([[True], (grams[order][1:] != grams[order][:-1]) | (row[order][1:] != row[order][:-1])])[: len(order)]
                held.append(grams[order][new])
                names.append(lang[order][new])
                if sum(map(len, held)) > 500_000:
                    yield counted(held, names)
                    held, names = [], []
        if held:
            yield counted(held, names)

    counts = docs.where(draw < share).mapInArrow(count, "gram long, lang int, docs long").groupBy("gram", "lang").agg(F.sum("docs").alias("docs"))
    learnt = docs.where(draw < share).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    if not learnt:
        return Filter(languages, masks, bits, hashes)
    least = F.create_map(*[F.lit(x) for r in learnt for x in (code[r["lang"]], r["n"] * least_share)])[F.col("lang")]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lang") % 64)
    where = F.array(*[F.call_function("shiftrightunsigned", "gram", F.lit(k * bits)).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(hashes)])
    kept = counts.where(F.col("docs") >= least).select((F.col("lang") / 64).cast("int").alias("word"), bit.alias("bit"), F.explode(where).alias("slot"))
    # one row a slot and word at most: the fixed size of the filter bounds what comes to the driver
    rows = kept.groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toArrow()
    masks[rows.column("slot").to_numpy(), rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return Filter(languages, masks, bits, hashes)


def counted(held: list[np.ndarray], names: list[np.ndarray]) -> pa.RecordBatch:
    grams, lang = np.concatenate(held), np.concatenate(names)
    order = np.lexsort((lang, grams))
    grams, lang = grams[order], lang[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (lang[1:] != lang[:-1])])[: len(grams)])
    docs = np.diff(np.append(first, len(grams)))
    return pa.RecordBatch.from_arrays([pa.array(grams[first].view(np.int64)), pa.array(lang[first].astype(np.int32)), pa.array(docs)], names=["gram", "lang", "docs"])


def predict(docs: DataFrame, filters: Filter, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns with lang_pred string and score double (the corrected share of the language)."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.bits, filters.hashes))
    keep = tuple(c for c in keep if c.lower() not in ("lang_pred", "score"))
    plain, name = numbered_columns(docs)
    read = name[text]  # among the kept columns or the last one
    rows = plain.select(*dict.fromkeys([*(name[c] for c in keep), read]))
    schema = StructType(rows.schema.fields[: len(keep)]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = Filter(*shared.value)
        for batch in batches:
            for start, stop in text_batches(batch, read):
                part = batch.slice(start, stop - start)
                texts = [t or "" for t in part.column(read).to_pylist()]
                known = np.array([bool(learnt.languages) and has_letter(t) for t in texts])
                names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if known.any():
                    shares = learnt.shares(*gram_hashes([t for t, k in zip(texts, known) if k]))
                    best = shares.argmax(axis=1)
                    names[known] = np.array(learnt.languages, object)[best]
                    scores[known] = shares[np.arange(len(best)), best]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores)], names=[*(name[c] for c in keep), "lang_pred", "score"])

    return rows.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.where(learnable(F.col("doc_id"))))
    return predict(docs, filters).select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """The rows of docs in a known language, with their columns, whatever those are called; a text is
    rejected when it has no letter (null and empty ones have none) or when its best language contains
    less than ``least`` of its n-grams. Without a learnable row no text is known and all are rejected."""
    filters = fit(docs.where(learnable(F.col("doc_id"))))
    plain, name = numbered_columns(docs)
    found = predict(plain, filters, tuple(plain.columns), name["text"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*plain.columns).toDF(*docs.columns)
