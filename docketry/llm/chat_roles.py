"""Chat formatting: a transcript's lines get their speakers' roles from a hidden Markov model, and turns are rendered in one form.

The model's states are role and place (first line of a turn, or a later one); its observations are a line's speaker marker and
coarse features (question mark, length, whether it is blank, and whether a blank line stands before), all of them told from the raw
text, in which a blank line stands between turns and others may stand within one. Start, transition and
emission tables are counts, with one added, over a bounded sample of labelled turns (TRAIN_BLOCKS blocks of BLOCK turn numbers) rendered as
transcripts. Viterbi's path gives each line its role; runs of lines that belong to a turn are joined and rendered as
`<|role|>\\ntext\\n<|end|>`, where `<|` within a text becomes `<||`, so that no text can forge a turn (`unrender` reads both back).
Only the marker at the head of a turn's first line is taken off; later lines keep all they have.

A conversation is one transcript, whatever its length; its rows are ordered by turn, then by role and text. Turns are dealt by ranges
of that order, so that no conversation has to fit one task. Where one goes on in the next range, the best score from every state
to every state over each range's lines is enough to join Viterbi's paths: these tables, at most two for each range, are put together
first, and each range then finds its own part of the path, the same as that of the whole.

Null texts are empty turns, null and unknown roles are `user`. Repeated rows are turns of their own; rows without conv_id are one
conversation. Columns other than conv_id, turn, role and text are ignored, also those named as in the result. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import saved

ROLES = ("assistant", "system", "user")
#: Of the labelled conversations, this many blocks of so many turn numbers are learned from.
TRAIN_BLOCKS, BLOCK = 1000, 64
#: What transcripts call their speakers.
MARKERS = {"user": "user", "human": "user", "q": "user", "customer": "user", "you": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "agent": "assistant", "system": "system", "note": "system", "context": "system"}
_MARKER = re.compile(r"^\s*[\[(*#>-]*\s*([A-Za-z]+)\s*[\])*]*\s*[:>]\s?(.*)$", re.S)
#: How a turn's first line may be marked in the transcripts that `transcripts` writes, by a hash of conversation and turn; the
#: last has none, and the model has to tell the role from what stands around it.
STYLES = ({"user": "User: ", "assistant": "Assistant: ", "system": "System: "}, {"user": "Human: ", "assistant": "AI: ", "system": "Note: "}, {"user": "Q: ", "assistant": "A: ", "system": "[Context]: "}, {"user": "", "assistant": "", "system": ""})
UNMARKED_EVERY = 4
MARKS, LENGTHS = 4, 5
STATES = 2 * len(ROLES)
SYMBOLS = MARKS * LENGTHS * 4 + 1
UNIT = 1 << 20


def _observe(line: str, blank_before: bool) -> tuple[int, str]:
    """(observation, the line without its marker)."""
    if not line.strip():
        return SYMBOLS - 1, line
    found = _MARKER.match(line)
    role = MARKERS.get(found[1].lower()) if found else None
    text = found[2] if role else line
    mark = 0 if role is None else 1 + ROLES.index(role)
    return ((mark * LENGTHS + min(len(text) // 60, LENGTHS - 1)) * 2 + ("?" in text)) * 2 + blank_before, text


def raw_text(turns: list[list[str]]) -> str:
    """The transcript of turns' lines: a blank line between turns."""
    return "\n\n".join("\n".join(lines) for lines in turns)


def observe(raw: str) -> tuple[list[int], list[str], list[str]]:
    """Observations of a raw transcript's lines, the lines, and the lines without their markers."""
    lines = raw.split("\n")
    seen = [_observe(line, k > 0 and not lines[k - 1].strip()) for k, line in enumerate(lines)]
    return [o for o, _ in seen], lines, [text for _, text in seen]


def line_states(turns: list[tuple[str, list[str]]]) -> list[int]:
    """The true state of each line of `raw_text`; the blank line after a turn is a later line of it."""
    out: list[int] = []
    for k, (role, lines) in enumerate(turns):
        later = ROLES.index(role) * 2 + 1
        out += [later - 1] + [later] * (len(lines) - 1 + (k < len(turns) - 1))
    return out


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the turn's lines in a raw transcript, in which every fourth turn or so has no marker."""
    role = F.when(F.lower("role").isin(*ROLES), F.lower("role")).otherwise("user")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES) - 1))
    mark = F.lit("")
    for k, marks in enumerate(STYLES[:-1]):
        for name, value in marks.items():
            mark = F.when((style == k) & (role == name), value).otherwise(mark)
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(UNMARKED_EVERY)) == 0
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.split(F.concat(F.when(bare, "").otherwise(mark), text), "\n").alias("lines"))


@dataclass
class Model:
    """Logarithms in whole parts of UNIT, so that sums are exact and ties fall alike wherever a transcript is cut."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def path(self, observed: list[int], forward: np.ndarray | None = None, last: int | None = None) -> tuple[int | None, list[int]]:
        """(state before, states) of lines, the likeliest. `forward` has the best score by the state before them (none at the head of
        a transcript), `last` is the state of the last line, if it is known."""
        back = np.zeros((len(observed), STATES), np.int8)
        score = self.start if forward is None else forward
        for t, o in enumerate(observed):
            if t or forward is not None:
                ways = score[:, None] + self.step
                back[t] = ways.argmax(0)
                score = ways.max(0)
            score = score + self.emit[:, o]
        out = [int(score.argmax()) if last is None else last]
        for t in range(len(observed) - 1, 0, -1):
            out.append(int(back[t, out[-1]]))
        return None if forward is None else int(back[0, out[-1]]), out[::-1]

    def scores(self, observed: list[int], first: bool) -> np.ndarray:
        """The best score of the lines by the state before them (one row at the head of a transcript) and the state of the last."""
        score = (self.start[None] if first else self.step) + self.emit[:, observed[0]]
        for o in observed[1:]:
            score = (score[:, :, None] + self.step[None]).max(1) + self.emit[:, o]
        return score


def model_of(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
    """Of probabilities."""
    return Model(*(np.rint(np.log(p) * UNIT).astype(np.int64) for p in (start, step, emit)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[dict]]]:
    """(conv_id, first turn of which it is the n-th run, rows) of sorted turns."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for n, (key, own) in enumerate(itertools.groupby(rows, key=lambda r: r["conv_id"])):
        yield key, n, list(own)


def train(turns: DataFrame, blocks: int = TRAIN_BLOCKS) -> Model:
    """Tables from at most `blocks` blocks of conversations, chosen by a hash; what comes to the driver is their counts."""
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(0)))
    chosen = turns.select("conv_id", "block").distinct().orderBy(F.xxhash64("conv_id", "block"), "conv_id", "block").limit(blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, own in itertools.groupby(rows, key=lambda r: (r["conv_id"], r["block"])):
            while part := list(itertools.islice(own, BLOCK)):
                states, seen = line_states([(r["role"], r["lines"]) for r in part]), observe(raw_text([r["lines"] for r in part]))[0]
                start[states[0]] += 1
                np.add.at(step, (states[:-1], states[1:]), 1)
                np.add.at(emit, (states, seen), 1)
        yield pa.RecordBatch.from_arrays([pa.array([t.ravel().tolist()]) for t in (start, step, emit)], ["start", "step", "emit"])

    # `blocks` pairs of numbers at most
    rows = turns.join(F.broadcast(chosen), (turns["conv_id"].eqNullSafe(chosen["conv_id"])) & (turns["block"] == chosen["block"]), "left_semi")
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text").select("conv_id", "block", "role", "lines")
    tables = [np.ones(STATES), np.ones((STATES, STATES)), np.ones((STATES, SYMBOLS))]
    for row in rows.mapInArrow(count, "start array<double>, step array<double>, emit array<double>").collect():  # one row a task
        tables = [t + np.array(v).reshape(t.shape) for t, v in zip(tables, row, strict=True)]
    start, step, emit = tables
    return model_of(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.replace('<|', '<||')}\n<|end|>"


_TURN = re.compile(r"<\|([a-z]+)\|>\n(.*?)\n<\|end\|>", re.S)


def unrender(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of rendered turns."""
    return [(m[1], m[2].replace("<||", "<|")) for m in _TURN.finditer(rendered)]


@dataclass
class Turn:
    first: int  # its first line
    role: str
    lines: list[str]
    goes_on: bool = False  # it began before these lines

    def closed(self) -> None:
        """The blank line before a further turn belongs to neither."""
        if (self.goes_on or len(self.lines) > 1) and not self.lines[-1].strip():
            self.lines.pop()


def turns_of(states: list[int], lines: list[str], bare: list[str], entry: int | None = None, first: int = 0) -> list[Turn]:
    """The turns of lines with their states: a first-line state or another role begins one."""
    out: list[Turn] = []
    for k, state in enumerate(states):
        role = ROLES[state // 2]
        before = out[-1].role if out else None if entry is None else ROLES[entry // 2]
        if state % 2 == 0 or before != role:
            if out:
                out[-1].closed()
            out.append(Turn(first + k, role, [bare[k] if state % 2 == 0 else lines[k]]))
        elif out:
            out[-1].lines.append(lines[k])
        else:
            out.append(Turn(first, role, [lines[k]], goes_on=True))
    return out


def parse(raw: str, model: Model) -> list[tuple[str, str]]:
    """(role, text) of the turns of a raw transcript."""
    observed, lines, bare = observe(raw)
    return [(t.role, "\n".join(t.lines)) for t in turns_of(model.path(observed)[1], lines, bare)]


def _lines(rows: list[dict], first: bool) -> tuple[list[int], list[str], list[str], list[str | None]]:
    """Observations, lines, bare lines and true roles (none for the blank lines between turns) of a run of turns. All but a
    conversation's first run begin with the blank line after the turn before."""
    observed, lines, bare = observe(("" if first else "\n") + raw_text([r["lines"] for r in rows]))
    true: list[str | None] = [] if first else [None]
    for k, r in enumerate(rows):
        true += [None] * (k > 0) + [r["role"]] * len(r["lines"])
    return observed, lines, bare, true


_SCHEMA = "conv_id long, first_line long, part int, nth int, goes_on boolean, edge boolean, ended boolean, role string, n_lines long, lines_right long, text string"
_FIELDS = pa.schema([("conv_id", pa.int64()), ("first_line", pa.int64()), ("part", pa.int32()), ("nth", pa.int32()), ("goes_on", pa.bool_()), ("edge", pa.bool_()), ("ended", pa.bool_()), ("role", pa.string()), ("n_lines", pa.int64()), ("lines_right", pa.int64()), ("text", pa.string())])


def _edges(ordered: DataFrame, value, kind: str) -> list:
    """(conv_id, part, run, n, value of its rows) of the first and last conversation of every range: only these can go over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for key, n, rows in _runs(batches):
            if n:
                last = (key, n, rows)
            else:
                yield made(part, key, n, rows)
        if last:
            yield made(part, *last)

    def made(part: int, key: int | None, n: int, rows: list[dict]) -> pa.RecordBatch:
        lines = sum(len(r["lines"]) for r in rows) + len(rows) - 1
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([x], pa.int64()) for x in (part, n, lines)), pa.array([value(part, n, rows)], pa.list_(pa.int64()))], ["conv_id", "part", "run", "n", "value"])

    return ordered.mapInArrow(run, f"conv_id long, part long, run long, n long, value {kind}").collect()  # at most two rows a range


def _joints(ordered: DataFrame, model: Model) -> dict[tuple[int, int], tuple[np.ndarray | None, int, int]]:
    """(best scores by the state before, state of the last line, lines before) of each (part, run) of a conversation that goes over ranges."""
    tables = _edges(ordered, lambda part, n, rows: np.concatenate([model.scores(_lines(rows, first)[0], first).ravel() for first in (True, False)]).tolist(), "array<long>")
    by = defaultdict(list)
    for r in sorted(tables, key=lambda r: (r["part"], r["run"])):
        by[r["conv_id"]].append(r)
    by = {key: runs for key, runs in by.items() if len(runs) > 1}
    forward: dict[tuple[int, int], np.ndarray] = {}
    ends = {}
    for key, runs in by.items():
        score = np.array(runs[0]["value"][:STATES])
        for r in runs[1:]:
            forward[r["part"], r["run"]] = score
            score = (score[:, None] + np.array(r["value"][STATES:]).reshape(STATES, STATES)).max(0)
        ends[key] = int(score.argmax())
    if not by:
        return {}
    # the state before a run by the state of its last line
    ways = _edges(ordered, lambda part, n, rows: [model.path(_lines(rows, False)[0], f, last)[0] for last in range(STATES)] if (f := forward.get((part, n))) is not None else None, "array<long>")
    way = {(r["part"], r["run"]): r["value"] for r in ways}
    out = {}
    for key, runs in by.items():
        state, states = ends[key], []
        for r in runs[::-1]:
            states.append(state)
            state = way[r["part"], r["run"]][state] if (r["part"], r["run"]) in forward else None
        before = 0
        for r, state in zip(runs, states[::-1], strict=True):
            out[r["part"], r["run"]] = (forward.get((r["part"], r["run"])), state, before)
            before += r["n"] + 1
    return out


def format_conversations(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """One row a recovered turn: its conversation, first line, lines, role, text and canonical form, and how many of its lines have their true role."""
    turns = transcripts(conversations)
    fitted = train(turns) if model is None else model
    order = ("conv_id", "turn", "role", "text")
    # the last key only lets equal rows be dealt to more than one range
    ordered = saved(turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").select("conv_id", "role", "lines"))
    joints = _joints(ordered, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for key, n, rows in _runs(batches):
            joint = joints.get((part, n))
            forward, end, before = joint or (None, None, 0)
            observed, lines, bare, true = _lines(rows, forward is None)
            before -= forward is not None  # the blank line between turns is counted where it is
            entry, states = fitted.path(observed, forward, end)
            found = turns_of(states, lines, bare, entry, before)
            edges, last = [t.first - before for t in found] + [len(states)], len(found) - 1
            right = [sum(true[x] == t.role for x in range(a, b)) for t, a, b in zip(found, edges, edges[1:], strict=False)]
            columns = zip(*((key, t.first, part, k, t.goes_on, joint is not None and k in (0, last), k < last, t.role, len(t.lines), r, "\n".join(t.lines)) for k, (t, r) in enumerate(zip(found, right, strict=True))), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)

    found = saved(ordered.mapInArrow(run, _SCHEMA))
    whole = found.where("NOT edge").select("conv_id", "first_line", "role", "n_lines", "lines_right", "text")
    # of turns that go over ranges the parts are joined: at most two rows a run at the edge of a range
    so_far = Window.partitionBy("conv_id").orderBy("part", "nth")
    parts = found.where("edge").withColumn("head", F.last(F.when(~F.col("goes_on"), F.col("first_line")), True).over(so_far))
    pieces = F.array_sort(F.collect_list(F.when(F.col("n_lines") > 0, F.struct("part", "nth", "text"))))
    text = F.array_join(F.transform(pieces, lambda x: x["text"]), "\n")
    joined = parts.groupBy("conv_id", F.col("head").alias("first_line")).agg(F.min_by("role", "part").alias("role"), F.sum("n_lines").alias("n_lines"), F.sum("lines_right").alias("lines_right"), text.alias("text"), F.max_by("ended", F.struct("part", "nth")).alias("ended"))
    # a turn's last blank line goes also where the next turn begins in another range
    more = F.max("first_line").over(Window.partitionBy("conv_id")) > F.col("first_line")
    ends = joined.withColumn("cut", more & (F.col("n_lines") > 1) & ~F.col("ended") & F.col("text").rlike(r"\n\s*\z"))
    joined = ends.select("conv_id", "first_line", "role", (F.col("n_lines") - F.col("cut").cast("long")).alias("n_lines"), "lines_right", F.when(F.col("cut"), F.regexp_replace("text", r"\n[^\n]*\z", "")).otherwise(F.col("text")).alias("text"))
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.replace("text", F.lit("<|"), F.lit("<||")), F.lit("\n<|end|>"))
    return whole.unionByName(joined).withColumn("rendered", rendered)
