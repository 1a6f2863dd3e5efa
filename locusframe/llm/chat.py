"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to text. Successive turn prefixes are rendered and
consecutive outputs compared: what a longer prefix adds is that turn's span, and a probe text in the
same place shows which part of the span is the turn's own text. Where a longer prefix does not begin
with the shorter one the template rewrites history; then every turn is located in the final output
by a probe of its own and the conversation is marked.

Conversations are dealt out by conv_id, sorted by turn and streamed. A template that is declared
append-only (its attribute ``append_only``: what a turn adds depends on it and the turn before alone)
renders one of more than ``segment`` turns in segments that start with the last turn before them, so
neither memory nor the length of a prefix grows with the conversation. Every other template is given
the full prefix at each turn, however long, as it may rewrite or count turns at any point.

The template given here marks turns by control strings. Inside texts and roles a backslash is
doubled and a control string gets one after its first character, so no control string stands in
them and the original can be read back.

Defined cases: null text or role counts as empty; a null conv_id is a conversation of its own; turns
with equal numbers are ordered by role and text; repeated rows are turns of their own; empty
conversations do not occur (an empty table gives an empty table). Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

Turn = tuple[str, str]  # role, text
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
SEGMENT = 64
_SPECIAL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[SYS\] (?P<system>.*?) \[/SYS\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[/ROLE\]", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[Turn]) -> str:
    out = []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f"<s>{text}</s>")
        elif role == "system":
            out.append(f"[SYS] {text} [/SYS]")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE]{text}[/ROLE]")
    return "".join(out)


render.append_only = True


def parse(formatted: str) -> list[Turn]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


def own_part(template: Callable[[list[Turn]], str], turns: list[Turn], i: int, rendered: str) -> tuple[int, int] | None:
    """Where in rendered, the output for turns, the text of turn i stands."""
    probe = "\ue000"
    while probe in rendered:
        probe += "\ue000"
    probed = template([*turns[:i], (turns[i][0], probe), *turns[i + 1 :]])
    at = probed.find(probe)
    if at < 0 or probed.count(probe) != 1:
        return None
    tail = len(probed) - at - len(probe)
    if rendered[:at] != probed[:at] or rendered[len(rendered) - tail :] != probed[at + len(probe) :] or at > len(rendered) - tail:
        return None
    return at, len(rendered) - tail


class Rendering:
    """Segments of one conversation, turn by turn."""

    def __init__(self, template: Callable[[list[Turn]], str], segment: int | None):
        self.template, self.segment = template, segment
        self.turns: list[Turn] = []
        self.output, self.base, self.spans, self.rewrites, self.count = "", 0, [], False, 0

    def add(self, turn: Turn) -> tuple[str, list, bool] | None:
        """Take a turn; a finished segment (text, spans, rewrites) when the turn begins another."""
        longer = self.template([*self.turns, turn])
        done = None
        if self.segment and len(self.turns) >= self.segment and not self.rewrites and longer.startswith(self.output):
            context = self.template(self.turns[-1:])
            short = self.template([self.turns[-1], turn])
            if short.startswith(context) and short[len(context) :] == longer[len(self.output) :]:
                done = self.finish()
                self.turns, self.output, self.spans, self.base = self.turns[-1:], context, [], len(context)
                longer = short
        if longer.startswith(self.output) and not self.rewrites:
            own = own_part(self.template, [*self.turns, turn], len(self.turns), longer)
            self.spans.append((turn[0], *(x - self.base for x in own or (len(longer), len(longer)))))
        else:
            self.rewrites = True
        self.turns.append(turn)
        self.output = longer
        return done

    def finish(self) -> tuple[str, list, bool]:
        if self.rewrites:
            self.spans, at = [], 0
            for i, (role, _) in enumerate(self.turns):
                at, end = own_part(self.template, self.turns, i, self.output) or (at, at)
                self.spans.append((role, at, end))
            return self.output, self.spans, True
        return self.output[self.base :], self.spans, False


SEGMENTS = "conv_id long, segment int, formatted string, turns array<struct<role:string,start:int,end:int,loss:boolean>>, rewrites_history boolean"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())]))


def format_conversations(conversations: DataFrame, template: Callable[[list[Turn]], str] = render, segment: int = SEGMENT, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per segment, in order within its partition: the formatted text, each turn's own part
    of it, whether the loss covers it, and whether the template rewrites history."""
    cut = segment if getattr(template, "append_only", False) else None
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, number = None, None, 0

        def row(made: tuple) -> pa.RecordBatch:
            text, spans, rewrites = made
            turns = [{"role": r, "start": a, "end": b, "loss": r in loss_roles} for r, a, b in spans]
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([number], pa.int32()), pa.array([text]), pa.array([turns], _TURNS), pa.array([rewrites])],
                names=["conv_id", "segment", "formatted", "turns", "rewrites_history"],
            )

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if open_ is None or conv != now:
                    if open_ is not None:
                        yield row(open_.finish())
                    now, open_, number = conv, Rendering(template, cut), 0
                if (done := open_.add((role, text))) is not None:
                    yield row(done)
                    number += 1
        if open_ is not None:
            yield row(open_.finish())

    return ordered.mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation from the formatted segments; they come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, turns, loss, n = [], None, None, None, None
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        for batch in batches:
            for conv, number, text, spans, rewrites in zip(*(c.to_pylist() for c in batch.columns)):
                if number == 0:
                    if turns is not None:
                        made.append((now, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3]))
                    now, turns, loss, n = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, False]
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n[0] += 1
                for span in spans:
                    if span["loss"]:
                        said = unescape(text[span["start"] : span["end"]])
                        loss.update(said.encode())
                        n[1] += len(said)
                n[2] += len(text)
                n[3] = n[3] or rewrites
            if len(made) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*made)], names=names)
                made = []
        if turns is not None:
            made.append((now, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3]))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) if k == 0 else pa.array(list(c)) for k, c in enumerate(zip(*made))], names=names)

    return segments.mapInArrow(run, DIGESTS)


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    return read_back(format_conversations(conversations.unionByName(extra)))
