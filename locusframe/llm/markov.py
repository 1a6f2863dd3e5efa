"""Scores of a hidden Markov language model.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per text. Exact counts of
all training tokens are summed in every task and then by word, and written to the shared folder.

Lexicon: words with at least ``symbol_share`` of all tokens are symbols of the model (there can be
no more than 1 / symbol_share of them); every other word is emitted as the class "rare" and then
drawn from the smoothed counts of the rare words, so a text's score is a proper probability. The
most frequent words, at most ``lookup_words`` of them, have their counts broadcast; the rest go
through a join by word, which therefore has no hot key. That bound decides where a count is looked
up, never what it is.

Texts are split and looked up once: every text becomes a row of symbol numbers, sums over the words
that were looked up, and the words that were not; the rows are written. Training and scoring read
those numbers.

Training: Baum-Welch, every round over all training texts. Each task runs the scaled forward and
backward recursions over its texts, all texts of a run in step (numpy, packed by time; texts of like
length share a run), and adds up expected starts, transitions and emissions; they are summed by
symbol across tasks, and the new model comes to the driver (symbols x states numbers). Scoring is
the exact scaled forward recursion.

Defined cases: null and empty text is the end token alone. Null doc_id counts as the empty text in
the hold-out hash. Without training rows every count is 0, N and V are 0, no model is learnt and the score
is the base score. Training texts without words teach the end token alone. Repeated rows count and are scored as rows of their own. An empty table gives an empty
table. Texts are whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, row_bytes, table, text_batches, text_bytes, written

END = " "  # no word holds a space
STATES = 8
SYMBOL_SHARE = 1e-5
LOOKUP_WORDS = 300_000
ROUNDS = 8
STEPS = 8  # tokens between scalings
RUN_BYTES = 2 << 20
RUN_TOKENS = 1 << 19


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def counts(docs: DataFrame) -> DataFrame:
    """word, c over all rows; the end token is END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for start, stop in text_batches(batch, "text"):
                for text in row_bytes(batch.slice(start, stop - start).column("text")):
                    held.update(words(text))
                    held[END.encode()] += 1
                if len(held) > 400_000:
                    yield counted(held)
                    held = Counter()
        if held:
            yield counted(held)

    parts = docs.select("text").mapInArrow(run, "word string, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "c"])


class Lexicon:
    """Index of each looked-up word (symbols first), its count, and the totals of the corpus."""

    def __init__(self, names: list[str], found: list[int], symbols: int, tokens: int, types: int, ends: int):
        self.index = {w.encode(): i for i, w in enumerate(names)}
        self.counts = np.append(np.array(found, float), [0.0, 0.0])  # the last two are for ends (-2), counted apart, and words that are not here (-1)
        self.symbols, self.tokens, self.types, self.ends = symbols, tokens, types, ends
        self.end, self.rare = symbols, symbols + 1
        self.base = np.log10(tokens + 0.1 * (types + 1))
        rest = tokens - ends - sum(found[:symbols])
        self.rest = np.log10(rest + 0.1 * (types - symbols - (ends > 0) + 1))
        self.unigram = np.append(np.array(found[:symbols], float), [ends, rest]) + 0.1
        self.unigram /= self.unigram.sum()

    def read(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words of all texts; the index of each token (-1: unknown here, -2: end); token offsets of the texts."""
        split = [words(t) for t in texts]
        flat = list(chain.from_iterable(split))
        ends = np.cumsum([len(s) for s in split], dtype=np.int64)
        index = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        return flat, np.insert(index, ends, -2), np.concatenate([[0], ends + np.arange(1, len(split) + 1)]).astype(np.int64)

    def symbols_of(self, index: np.ndarray) -> np.ndarray:
        return np.where(index == -2, self.end, np.where((index < 0) | (index >= self.symbols), self.rare, index))


def lexicon(table_of_counts: DataFrame, symbol_share: float = SYMBOL_SHARE, lookup_words: int = LOOKUP_WORDS) -> Lexicon:
    totals = table_of_counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    tokens, types, ends = totals["n"] or 0, totals["v"], totals["ends"] or 0
    others = table_of_counts.where(F.col("word") != END)
    # the count from which on there are at most lookup_words words: their ranks are those of count-sorted rows
    edge = others.orderBy(F.desc("c")).limit(lookup_words + 1).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).first()
    least = edge["c"] + 1 if edge["n"] > lookup_words else 0
    # at most lookup_words and 1 / symbol_share rows
    rows = others.where(F.col("c") >= min(least, max(1, tokens * symbol_share))).toArrow().to_pydict()
    order = sorted(range(len(rows["word"])), key=lambda i: (-rows["c"][i], rows["word"][i]))
    found = [rows["c"][i] for i in order]
    return Lexicon([rows["word"][i] for i in order], found, sum(c >= tokens * symbol_share for c in found), tokens, types, ends)


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: symbols x states


def first_model(unigram: np.ndarray, states: int, seed: int = 5) -> Model:
    random = np.random.default_rng(seed)
    emit = unigram[:, None] * random.uniform(0.5, 1.5, (len(unigram), states))
    move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Packed:
    """Texts in step: position o[t] + j is token t of the j-th longest text."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.order, self.longest = order, int(sizes.max(initial=0))
        self.active = np.searchsorted(-sizes[order], -np.arange(self.longest), side="left")  # texts longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        time = np.arange(len(symbols)) - np.repeat(offsets[:-1], sizes)
        self.symbols = np.empty_like(symbols)
        self.symbols[self.at[time] + np.repeat(rank, sizes)] = symbols
        self.last = self.at[sizes[order] - 1] + np.arange(len(order))  # the last token of each text, which has one at least

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward probabilities, scaled at every STEPS-th token (so far they stay in range), the log10
        probability of the texts from the longest on, and the emission probabilities of each token."""
        emitted = model.emit[self.symbols]
        alpha, logs, ones = np.empty_like(emitted), np.zeros(len(self.order)), np.ones(len(model.start))
        at, active = self.at.tolist(), self.active.tolist()
        if self.longest:
            np.multiply(emitted[: at[1]], model.start, out=alpha[: at[1]])
        for t in range(1, self.longest):
            a, n, b = at[t], active[t], at[t - 1]
            now = np.matmul(alpha[b : b + n], model.move, out=alpha[a : a + n])
            now *= emitted[a : a + n]
            if t % STEPS == 0:
                total = now @ ones
                now /= total[:, None]
                logs[:n] += np.log10(total)
        if self.longest:
            logs += np.log10(alpha[self.last] @ ones)
        return alpha, logs, emitted

    def logs(self, ranked: np.ndarray) -> np.ndarray:
        """log10 probability of each text, in the order in which the texts were given."""
        out = np.empty(len(self.order))
        out[self.order] = ranked
        return out

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions (symbols x states)."""
        alpha, _, ahead = self.forward(model)
        beta, ones = np.ones_like(alpha), np.ones(len(model.start))
        at, active = self.at.tolist(), self.active.tolist()
        back = model.move.T.copy()
        for t in range(self.longest - 2, -1, -1):
            a, n, b = at[t], active[t + 1], at[t + 1]
            ahead[b : b + n] *= beta[b : b + n]
            now = np.matmul(ahead[b : b + n], back, out=beta[a : a + n])
            if t % STEPS == 0:
                ahead[b : b + n] /= (total := (now @ ones)[:, None])
                now /= total
        beta *= alpha  # in proportion to the states of each token
        share = 1 / (beta @ ones)
        beta *= share[:, None]
        move = np.zeros_like(model.move)
        if self.longest > 1:
            n = self.active[1:]
            before = np.repeat(self.at[:-2], n) + np.arange(int(n.sum())) - np.repeat(self.at[1:-1] - self.at[1], n)
            alpha *= share[:, None]
            move = model.move * (alpha[before].T @ ahead[self.at[1] :])
        emit = np.stack([np.bincount(self.symbols, weights=beta[:, s], minlength=len(model.emit)) for s in range(len(ones))], axis=1)
        return beta[: self.at[1]].sum(axis=0) if self.longest else np.zeros(len(ones)), move, emit


ENCODED = "row long, doc_id long, training boolean, n_tokens long, known long, base double, rest double, symbols binary, rare array<string>"


def encoded(docs: DataFrame, lexicon_, training: Column | None = None) -> DataFrame:
    """Each row's number, doc_id, whether it teaches, how many tokens it has, how many of those looked
    up are known, their sums of log10 in the base score and in the class "rare", the symbols of all
    tokens (int32), and the words that were not looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_.value
        logs, end = np.log10(lexicon.counts + 0.1), np.log10(lexicon.ends + 0.1)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start, stop in text_batches(batch, "text", RUN_BYTES):
                part = batch.slice(start, stop - start)
                flat, index, offsets = lexicon.read(row_bytes(part.column("text")))
                n = len(part)
                symbols = lexicon.symbols_of(index)
                sums = lambda values: np.add.reduceat(values, offsets[:-1])  # noqa: E731, B023  every text has a token
                here = index != -1
                log = np.where(index == -2, end, logs[index])
                away = np.flatnonzero(~here)
                rare_ends = np.searchsorted(away, offsets).astype(np.int32)
                own = away - np.searchsorted(offsets, away, side="right") + 1  # without the ends before them
                raw, ends = symbols.astype("<i4").tobytes(), (4 * offsets).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("training"), pa.array(np.diff(offsets)),
                        pa.array(sums((here & ((index >= 0) | (lexicon.ends > 0))).astype(np.int64))), pa.array(sums(np.where(here, log - lexicon.base, 0.0))),
                        pa.array(sums(np.where(here & (symbols == lexicon.rare), log - lexicon.rest, 0.0))), pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(rare_ends), pa.array([flat[i] for i in own.tolist()], pa.binary()).cast(pa.string())),
                    ],
                    names=[x.split()[0] for x in ENCODED.split(", ")],
                )
                row += n

    teaches = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), teaches.alias("training")).mapInArrow(run, ENCODED)


def runs_of_texts(raw: np.ndarray, offsets: np.ndarray, limit: int = RUN_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and offsets of runs of about limit tokens, one text at least, from the shortest text to the longest."""
    for _, symbols, ends in numbered_runs(raw, offsets, limit):
        yield symbols, ends


def numbered_runs(raw: np.ndarray, offsets: np.ndarray, limit: int = RUN_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same runs with the places of their texts."""
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    total, start = np.concatenate([[0], np.cumsum(sizes[order])]), 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        kept = order[start:stop]
        yield kept, np.concatenate([raw[offsets[i] : offsets[i + 1]] for i in kept.tolist()]).astype(np.int64), total[start : stop + 1] - total[start]
        start = stop


def baum_welch_round(symbols: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One round over the encoded texts."""
    shared, states = symbols.sparkSession.sparkContext.broadcast(model), model.move.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = None
        for batch in batches:
            raw, offsets = text_bytes(batch.column("symbols"))
            for part_symbols, part_offsets in runs_of_texts(raw.view("<i4"), offsets // 4):
                part = Packed(part_symbols, part_offsets).expected(model)
                total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            begun, moved, emitted = total
            used = np.flatnonzero(emitted.any(axis=1))
            keys = np.concatenate([[-1], -2 - np.arange(states), used])
            values = np.concatenate([begun[None], moved, emitted[used]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=["key", *(f"s{i}" for i in range(states))])

    parts = symbols.select("symbols").mapInArrow(run, ", ".join(["key long", *(f"s{i} double" for i in range(states))]))
    rows = parts.groupBy("key").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(states)]).toArrow()  # one row a symbol
    keys = rows.column("key").to_numpy()
    values = np.stack([rows.column(f"s{i}").to_numpy() for i in range(states)], axis=1) if len(keys) else np.zeros((0, states))
    start, move, emit = np.full(states, 0.1), np.full((states, states), 0.1), 20.0 * np.repeat(unigram[:, None], states, axis=1)
    start = start + values[keys == -1].sum(axis=0)
    inner = keys <= -2
    move[-2 - keys[inner]] += values[inner]
    emit[keys[keys >= 0]] += values[keys >= 0]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(symbols: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """``rounds`` over all texts of symbols (encoded and written)."""
    model = first_model(unigram, states)
    for _ in range(rounds):
        model = baum_welch_round(symbols, model, unigram)
    return model


SCORED = "row long, doc_id long, n_tokens long, known long, base double, score double"


def score(texts: DataFrame, table_of_counts: DataFrame, lexicon_, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of texts (encoded and written).
    lexicon_: a broadcast Lexicon."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column("symbols"))
            logs = np.empty(len(batch))
            for kept, symbols, ends in numbered_runs(raw.view("<i4"), offsets // 4):
                packed = Packed(symbols, ends)
                logs[kept] = packed.logs(packed.forward(model)[1])
            columns = [*(batch.column(c) for c in ("row", "doc_id", "n_tokens", "known", "base")), pa.array(batch.column("rest").to_numpy() + logs)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    parts = texts.select("row", "doc_id", "n_tokens", "known", "base", "rest", "symbols").mapInArrow(run, SCORED)
    words_away = texts.select("row", F.explode("rare").alias("word"))
    counted_ = words_away.join(table_of_counts.hint("shuffle_hash"), "word", "left")  # a word has one count, so no side is hot
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1))
    rare = counted_.groupBy("row").agg(F.count("c").alias("rare_known"), F.sum(log).alias("rare_log"), F.count(F.lit(1)).alias("rare"))
    none = F.lit(0)
    known, logs, many = F.coalesce("rare_known", none), F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare", none)
    learnt = lexicon_.value
    base = F.col("base") + logs - many * float(learnt.base)
    modelled = F.col("score") + logs - many * float(learnt.rest) if learnt.tokens else base
    return parts.join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + known).alias("n_known"), base.alias("base_score"), modelled.alias("score")
    )


def learnable(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 != 0


def op4_hmm_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keep = learnable(F.col("doc_id"))
    found = written(counts(docs.where(keep)), "word-counts")
    lexicon_ = spark.sparkContext.broadcast(lexicon(found))
    texts = written(encoded(docs, lexicon_, keep), "encoded-texts")
    model = train(texts.where("training"), lexicon_.value.unigram)
    scored = score(texts, found, lexicon_, model)
    result = scored.select("doc_id", (~keep).alias("held_out"), "n_tokens", "n_known", F.lit(int(lexicon_.value.tokens)).cast("bigint").alias("train_tokens"), "base_score", "score")
    result = written(result, "hmm-scores")
    discard(found, texts)
    return result
