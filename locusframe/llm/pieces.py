"""SentencePiece BPE by vectorised merge rounds.

Text is cut into units that no piece crosses (a run of meta spaces and what follows it). The units
that a worker has not met yet lie one after another in a flat numpy array of symbols. In each round
every word finds the best rank among its adjacent pairs (a segmented minimum), merges the leftmost
non-overlapping pairs of that rank at once, and the array is compacted; a word without a pair left
leaves it. Merging several pairs of a word in one round is exact as long as no merge makes a pair of
the same or a better rank; from the first one that does, the rest of that word waits a round.

Characters outside the vocabulary become byte pieces. Decoding is the library's decode(ids).

Defined cases: null text counts as empty; empty text gives the end id alone (or nothing without
it). Repeated rows are encoded alike, ties between pairs go to the leftmost. Other columns pass
through if named in ``keep``; those called ids or decoded give way to the results. Very long texts
are whole: they are cut only where no piece of the vocabulary could join the two sides. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import lean, mixed, numbered_columns, table, text_batches

SPACE = "▁"
SHIFT = 21
NONE = np.int64(1) << np.int64(60)
CACHED_BYTES = 96 << 20  # of units and their ids that a worker keeps
UNIT_BYTES = 150  # of a unit beside its characters


class PairTable:
    """Adjacent symbols -> rank and merged symbol, as a hash table in flat arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = self.keys[slot] == -1
            taken = left[free]
            _, first = np.unique(slot[free], return_index=True)
            self.keys[slot[free][first]] = keys[taken[first]]
            self.values[slot[free][first]] = values[taken[first]]
            wait = self.keys[slot] != keys[left]
            left, slot = left[wait], (slot[wait] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if not all(sp.is_byte(int(i)) for i in self.byte_ids) or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the model needs byte pieces and no piece with a space after other characters")
        if sp.decode(sp.encode(" ａ  b ")) != " ａ  b ":
            raise ValueError("the model changes its input text")
        self.end = sp.eos_id()
        scores = sorted({sp.get_score(i) for i in pieces.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        of = lambda s: pieces.get(s, int(self.symbol[ord(s)]) if len(s) == 1 else None)
        pairs, joins = {}, set()
        for p, i in pieces.items():
            value = (rank[sp.get_score(i)] << SHIFT) | i
            for k in range(1, len(p)):
                joins.add((int(self.symbol[ord(p[k - 1])]) << SHIFT) | int(self.symbol[ord(p[k])]))
                a, b = of(p[:k]), of(p[k:])
                if a is not None and b is not None:
                    pairs[(a << SHIFT) | b] = value
        self.pairs = PairTable(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        #: Adjacent characters that some piece holds; elsewhere words can be cut.
        self.joins = PairTable(np.fromiter(joins, np.int64, len(joins)), np.zeros(len(joins), np.int64))
        runs = [sp.get_score(pieces[SPACE * k]) for k in range(2, 65) if SPACE * k in pieces]
        longest = len(runs) + 1
        tied = bool(runs) and len(set(runs)) == 1 and runs[0] == scores[-1] and SPACE * longest in pieces
        block = f"{SPACE}{{{longest}}}(?={SPACE})|" if tied else ""  # a long run falls into blocks from the left
        self.units = re.compile(f"{block}{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.flat, self.held = np.zeros(1 << 12, np.int64), np.empty(1 << 12, np.int32), 0

    def cut(self, text: str) -> list[str]:
        """Units without their first meta space."""
        text = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE not in text:
            return text.split(SPACE)[1:]
        return [u[1:] for u in self.units(text)]

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts into them."""
        units = [self.cut(t) if t else [] for t in texts]
        fresh = {u for row in units for u in row if u not in self.known}
        size = sum(map(len, fresh)) * 6 + len(fresh) * UNIT_BYTES
        if self.known and self.held + size > CACHED_BYTES:
            self.reset()
            fresh = {u for row in units for u in row}
        if fresh:
            fresh, n = list(fresh), len(self.known)
            ids, ends = self.merge([SPACE + u for u in fresh])
            used = int(self.starts[n])
            self.flat, self.starts = grown(self.flat, used + len(ids)), grown(self.starts, n + len(fresh) + 1)
            self.flat[used : used + len(ids)] = ids
            self.starts[n + 1 : n + len(fresh) + 1] = ends[1:] + used
            self.known.update(zip(fresh, range(n, n + len(fresh))))
            self.held += sum(map(len, fresh)) * 6 + len(fresh) * UNIT_BYTES
        known = self.known
        index = np.fromiter((known[u] for row in units for u in row), np.int64)
        rows = np.concatenate([[0], np.cumsum([len(row) for row in units])]).astype(np.int64)
        starts = self.starts
        begin, length = starts[index], starts[index + 1] - starts[index]
        total = np.concatenate([[0], np.cumsum(length)])
        flat = self.flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])] if total[-1] else np.empty(0, np.int32)
        offsets = total[rows]
        if end:
            flat = np.insert(flat, offsets[1:], np.int32(self.end))
            offsets = offsets + np.arange(len(offsets))
        return flat, offsets

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and the offsets of the words."""
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        keys = (symbols[:-1] << SHIFT) | symbols[1:]
        joined = (word[1:] == word[:-1]) & (self.joins[keys] == 0)
        part = np.concatenate([[0], np.cumsum(~joined)])  # words cut where nothing can join
        part_word, at = word[np.concatenate([[True], ~joined])], part
        values = np.append(np.where(joined, self.pairs[keys], NONE), NONE)
        done_part, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sizes = np.diff(np.append(starts, len(at)))
            ranks = values >> SHIFT
            best = np.minimum.reduceat(ranks, starts)
            live = np.repeat(best < (NONE >> SHIFT), sizes)
            done_part.append(at[~live])
            done_symbols.append(symbols[~live])
            symbols, at, values, ranks = symbols[live], at[live], values[live], ranks[live]
            if not len(symbols):
                break
            best = np.repeat(best, sizes)[live]
            chosen = np.flatnonzero(ranks == best)
            run = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1] + 1]))
            within = np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))
            chosen = chosen[within % 2 == 0]
            chosen = chosen[self.allowed(chosen, symbols, at, values)]
            symbols[chosen] = values[chosen] & ((1 << SHIFT) - 1)
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            moved = (np.cumsum(keep) - 1)[chosen]
            symbols, at, values = symbols[keep], at[keep], values[keep]
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            inside = touched[touched + 1 < len(at)]
            inside = inside[at[inside] == at[inside + 1]]
            values[touched] = NONE
            values[inside] = self.pairs[(symbols[inside] << SHIFT) | symbols[inside + 1]]
        part, symbols = np.concatenate(done_part), np.concatenate(done_symbols)
        order = np.argsort(part, kind="stable")
        word, symbols = part_word[part[order]], symbols[order]
        strange = symbols >= self.size
        if strange.any():
            spelled = [chr(c).encode("utf-8") for c in (symbols[strange] - self.size).tolist()]
            times = np.ones(len(symbols), np.int64)
            times[strange] = [len(x) for x in spelled]
            first = (np.cumsum(times) - times)[strange]
            symbols, word = np.repeat(symbols, times), np.repeat(word, times)
            for k in range(4):
                which = [i for i, x in enumerate(spelled) if len(x) > k]
                symbols[first[which] + k] = self.byte_ids[[spelled[i][k] for i in which]]
        return symbols, np.searchsorted(word, np.arange(len(words) + 1))

    def allowed(self, chosen: np.ndarray, symbols: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which of the chosen pairs merge now: in each word those up to the first that makes a pair
        of the same or a better rank."""
        several = np.zeros(len(chosen), bool)
        same = at[chosen[1:]] == at[chosen[:-1]]
        several[1:] |= same
        several[:-1] |= same
        if not several.any():
            return np.ones(len(chosen), bool)
        made, rank = values[chosen] & ((1 << SHIFT) - 1), values[chosen] >> SHIFT
        before = chosen - 1
        left = symbols[before]
        touching = np.flatnonzero(chosen[1:] == chosen[:-1] + 2) + 1
        left[touching] = made[touching - 1]
        left_ok = (before >= 0) & (at[before] == at[chosen])
        after = np.minimum(chosen + 2, len(symbols) - 1)
        right_ok = (chosen + 2 < len(symbols)) & (at[after] == at[chosen])
        bad = left_ok & ((self.pairs[(left << SHIFT) | made] >> SHIFT) <= rank)
        bad |= right_ok & ((self.pairs[(made << SHIFT) | symbols[after]] >> SHIFT) <= rank)
        seen = np.cumsum(bad) - bad
        firsts = np.flatnonzero(np.concatenate([[True], ~same]))
        return seen == np.repeat(seen[firsts], np.diff(np.append(firsts, len(chosen))))


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for size entries; twice the room when it has to move."""
    if size <= len(array):
        return array
    more = np.empty(max(size, 2 * len(array)), array.dtype)
    more[: len(array)] = array
    return more


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """Read once per worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", end: bool = True) -> DataFrame:
    """The kept columns with ids array<int> and decoded string (decode(ids) of the library)."""
    lean(docs.sparkSession)
    keep = tuple(c for c in keep if c.lower() not in ("ids", "decoded"))
    plain, name = numbered_columns(docs)
    rows = plain.select(*[name[c] for c in keep], F.col(name[text]).alias("piece_text"))
    schema = StructType(rows.schema.fields[:-1]).add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for start, stop in text_batches(batch, "piece_text"):
                part = batch.slice(start, stop - start)
                texts = [t or "" for t in part.column("piece_text").to_pylist()]
                ids, offsets = pieces.encode(texts, end)
                listed, ends = ids.tolist(), offsets.tolist()
                decoded = [pieces.library.decode(listed[a:b]) if b > a else "" for a, b in zip(ends, ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(decoded, pa.string())], names=[*(name[c] for c in keep), "ids", "decoded"])

    return rows.mapInArrow(run, schema).toDF(*keep, "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), path or public_tokenizers.path("piece_bpe_32k.model")))
