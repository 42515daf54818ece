"""Chat transcripts: roles by a hidden Markov model, then canonical turns.

A transcript is lines of text. The states are (role, first line of a turn or a
later one). A line shows a speaker marker of some class (``User:``, ``<|bot|>``,
``### System`` ...) or none, whether a blank line precedes it, a length class and
a shape (question, list or code, other). Start, transition and emission counts are
taken over all lines of a labelled corpus (``train``) outside a held-out fold of
conversations. Viterbi finds the best states; turns are cut at first lines,
markers and trailing blank lines are taken off, and each turn is rendered between
the canonical marks.

The query makes transcripts of ``conversations`` in which, by a hash of
conversation and turn, ``UNMARKED`` percent of the turns show no marker and only
``SPACED`` percent end with a blank line, so that roles and bounds of many turns
have to be inferred from the lines and turns around them.

A conversation may be of any length. It is cut into segments of ``SEGMENT``
source turns. For each segment a task finds the best score between each pair of
first and last state, a 6 x 6 table; one scan over a conversation's tables fixes
the first and last state of each segment; the segments are then decoded on
their own. The result is that of Viterbi over the whole conversation, without
holding one in a task. A turn that reaches over the end of a segment comes in
parts, which ``begins`` and ``ends`` tell.

Defined cases: a null or empty text is one blank line; rows with a null role
show no marker; a null conv_id is a conversation of its own; rows that share
conv_id and turn follow each other by line; lines of any length are taken
whole; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ["system", "user", "assistant"]
NAMES = {"system": "system|sys|instructions?", "user": "user|human|question|q", "assistant": "assistant|ai|bot|gpt|model|answer|a"}
STATES = 6  # 2 * role + (1 if a later line)
MARKS = 4  # none, then one class for each role
LENGTHS, SHAPES = 5, 3
SYMBOLS = MARKS * 2 * LENGTHS * SHAPES
#: Of a hundred turns of the query's transcripts so many show no marker, and so many end with a blank line.
UNMARKED, SPACED = 40, 80
#: One conversation in so many is not learnt from.
FOLDS = 5
#: Source turns in a segment.
SEGMENT = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _marker() -> regex.Pattern:
    def names(n: int) -> str:
        return "|".join(f"(?P<{r}{n}>{own})" for r, own in NAMES.items())

    # ``name:`` with optional emphasis or brackets, or a tag such as ``<|name|>`` or ``### name``
    return regex.compile(rf"^\s*(?:[*_\[(]{{0,3}}(?:{names(1)})[*_\])]{{0,3}}\s*:[*_]{{0,3}}|<\|?(?:{names(2)})\|?>:?|#{{1,6}}\s*(?:{names(3)})\s*(?::|$)) ?", regex.IGNORECASE)


MARKER = _marker()


def read_marker(line: str) -> tuple[int, str]:
    """Class of the speaker marker (0: none) and the line without it."""
    found = MARKER.match(line)
    if not found:
        return 0, line
    role = next(k for k, v in found.groupdict().items() if v)
    return 1 + ROLES.index(role[:-1]), line[found.end() :]


def symbol(line: str, gap: bool) -> int:
    """Class of a line; ``gap``: a blank line or nothing precedes it."""
    mark, rest = read_marker(line)
    n = len(rest)
    length = 0 if not n else 1 if n <= 60 else 2 if n <= 140 else 3 if n <= 280 else 4
    shape = 1 if rest[-1:] == "?" else 2 if rest[:1] in "-*`>|{}" or rest[:2].strip().rstrip(".)").isdigit() else 0
    return ((mark * 2 + gap) * LENGTHS + length) * SHAPES + shape


@dataclass
class Hmm:
    """Log probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


STYLES = [("{}: ", str.capitalize), ("### {}: ", str.capitalize), ("<|{}|> ", str.lower), ("**{}**: ", str.upper)]


def held_out() -> Column:
    """Conversations that ``train`` leaves out."""
    return F.pmod(F.xxhash64("conv_id", F.lit("fold")), F.lit(FOLDS)) == 0


def is_unmarked(unmarked: int = UNMARKED) -> Column:
    return F.pmod(F.xxhash64("conv_id", "turn", F.lit("mark")), F.lit(100)) < unmarked


def transcript_turns(conversations: DataFrame, unmarked: int = UNMARKED, spaced: int = SPACED) -> DataFrame:
    """conv_id, turn, role, lines: turns as a transcript shows them.

    The first line shows the role in the style of the conversation, but not in
    ``unmarked`` percent of the turns; ``spaced`` percent end with a blank line.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    mark: Column = F.lit("")
    for i, (shape, case) in enumerate(STYLES):
        for role in ROLES:
            mark = F.when((style == i) & (F.col("role") == role), shape.format(case(role))).otherwise(mark)
    mark = F.when(is_unmarked(unmarked), "").otherwise(mark)
    space = F.when(F.pmod(F.xxhash64("conv_id", "turn", F.lit("space")), F.lit(100)) < spaced, "\n").otherwise("")
    text = F.coalesce(F.col("text"), F.lit(""))
    return conversations.select("conv_id", "turn", "role", F.split(F.concat(mark, text, space), "\n").alias("lines"))


def to_lines(conversations: DataFrame, unmarked: int = UNMARKED, spaced: int = SPACED) -> DataFrame:
    """conv_id, turn, role, line_no, line of the transcripts."""
    return transcript_turns(conversations, unmarked, spaced).select("conv_id", "turn", "role", F.posexplode("lines").alias("line_no", "line"))


def turn_counts(conversations: DataFrame, unmarked: int = UNMARKED, spaced: int = SPACED) -> DataFrame:
    """kind, i, j, n: symbols by state (0), roles by the role before (1) and first roles (2), over all rows with a known role outside the held-out fold.

    What precedes a turn's first line, and the step between turns, come from
    joining each turn with the one before it, which deals by conversation and turn.
    Of several rows for the turn before, the one with the least role counts, so
    repeated rows are counted once each and never meet in pairs.
    """
    known = conversations.filter(F.col("role").isin(*ROLES) & ~held_out())
    turns = transcript_turns(known, unmarked, spaced)
    ends = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.struct(F.col("role").alias("last_role"), (F.element_at("lines", -1) == "").alias("blank")).alias("end"))
    ends = ends.groupBy("conv_id", "turn").agg(F.min("end").alias("end")).select("conv_id", "turn", "end.*")
    joined = turns.join(ends, ["conv_id", "turn"], "left").select("role", "last_role", F.coalesce("blank", F.lit(True)).alias("blank"), "lines")

    def count(batches):
        lines, step, start = np.zeros((STATES, SYMBOLS), np.int64), np.zeros((3, 3), np.int64), np.zeros(3, np.int64)
        for b in batches:
            for role, last, blank, own in zip(*(b.column(c).to_pylist() for c in ("role", "last_role", "blank", "lines")), strict=True):
                r = ROLES.index(role)
                if last is None:
                    start[r] += 1
                else:
                    step[ROLES.index(last), r] += 1
                for n, line in enumerate(own):
                    lines[2 * r + (n > 0), symbol(line, blank)] += 1
                    blank = not line
        rows = [(k, i, j, int(table[i, j])) for k, table in enumerate((lines, step, start[None])) for i, j in zip(*np.nonzero(table), strict=True)]
        yield pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())))})

    return joined.mapInArrow(count, "kind int, i int, j int, n long").groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))


def train(conversations: DataFrame, unmarked: int = UNMARKED, spaced: int = SPACED) -> Hmm:
    """The model of ``turn_counts``; some hundred sums reach the driver."""
    lines, move, start = np.full((STATES, SYMBOLS), 0.1), np.ones((3, 3)), np.full(STATES, 1e-6)
    seen = np.zeros(STATES)
    for r in turn_counts(conversations, unmarked, spaced).collect():
        if r["kind"] == 0:
            lines[r["i"], r["j"]] += r["n"]
            seen[r["i"]] += r["n"]
        elif r["kind"] == 1:
            move[r["i"], r["j"]] += r["n"]
        else:
            start[2 * r["j"]] += r["n"]
    move /= move.sum(axis=1, keepdims=True)
    step = np.full((STATES, STATES), 1e-9)
    for r in range(3):
        # lines after a first line, and after a later one, of a turn of average length
        first, later = seen[2 * r] + 1, seen[2 * r + 1] + 1
        stay = min(later / (first + later), 1 - 1e-3)
        for own in (2 * r, 2 * r + 1):
            step[own, 2 * r + 1] = stay
            step[own, 0::2] = (1 - stay) * move[r]
    start[1::2] = 1e-9
    return Hmm(np.log(start / start.sum()), np.log(step), np.log(lines / lines.sum(axis=1, keepdims=True)))


def _groups(batches, keys: list[str]):
    """Consecutive rows with equal keys, across batches: (key, rows as lists by column)."""
    key, held = None, None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        for i in range(b.num_rows):
            now = tuple(cols[c][i] for c in keys)
            if held is None or now != key:
                if held is not None:
                    yield key, held
                key, held = now, {c: [] for c in cols}
            for c, values in cols.items():
                held[c].append(values[i])
    if held is not None:
        yield key, held


def _emissions(model: Hmm, lines: list[str], gap: bool) -> np.ndarray:
    return model.emit[:, [symbol(x, g) for x, g in zip(lines, [gap, *(not x for x in lines[:-1])], strict=True)]].T


def viterbi(model: Hmm, emit: np.ndarray, first: int, last: int) -> np.ndarray:
    """Best states of a segment whose first and last are given."""
    n = len(emit)
    best = np.full(STATES, -np.inf)
    best[first] = emit[0, first]
    back = np.zeros((n, STATES), np.int8)
    for t in range(1, n):
        score = best[:, None] + model.step
        back[t] = score.argmax(axis=0)
        best = score.max(axis=0) + emit[t]
    out = np.empty(n, np.int8)
    out[-1] = last
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def parse_transcripts(lines: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, turn (of its first line), line_no, role, begins, ends, n_lines, text, rendered.

    ``lines`` has conv_id, turn, line_no, line. A row is a turn, or the part of
    one that lies in a segment: ``begins`` and ``ends`` tell whether the turn
    opens and closes here. Rendered parts in order give the conversation.
    """
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cut = lines.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "line_no", "line").withColumn("segment", F.floor(F.col("turn") / SEGMENT).cast("long"))
    dealt = cut.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "line_no", "line")

    def tables(batches):
        m = shared.value
        for (conv, segment), g in _groups(batches, ["conv_id", "segment"]):
            emit = _emissions(m, g["line"], False)
            lift = _emissions(m, g["line"][:1], True)[0] - emit[0]  # if the segment before ends with a blank line
            table = np.full((STATES, STATES), -np.inf)
            np.fill_diagonal(table, emit[0])
            for t in range(1, len(emit)):
                table = (table[:, :, None] + m.step[None]).max(axis=1) + emit[t]
            yield pa.record_batch({"conv_id": pa.array([conv], pa.int64()), "segment": pa.array([segment], pa.int64()), "best": pa.array([table.ravel().tolist()], pa.list_(pa.float64())), "lift": pa.array([lift.tolist()], pa.list_(pa.float64())), "blank": pa.array([not g["line"][-1]])})

    scores = stored(dealt.select("conv_id", "segment", "line").mapInArrow(tables, "conv_id long, segment long, best array<double>, lift array<double>, blank boolean"), "chat-segments")

    def fix(batches):
        m = shared.value
        for (conv,), g in _groups(batches, ["conv_id"]):
            gaps = [True, *g["blank"][:-1]]
            best = [np.array(x).reshape(STATES, STATES) + (np.array(lift)[:, None] if gap else 0) for x, lift, gap in zip(g["best"], g["lift"], gaps, strict=True)]
            enter, at_first, at_last = m.start, [], []
            for table in best:  # best score of each last state, and the first state it came from
                scored = enter[:, None] + table
                at_first.append(scored.argmax(axis=0))
                end = scored.max(axis=0)
                move = end[:, None] + m.step
                at_last.append(move.argmax(axis=0))
                enter = move.max(axis=0)
            last = [int(end.argmax())]
            first = []
            for k in range(len(best) - 1, -1, -1):
                first.append(int(at_first[k][last[-1]]))
                if k:
                    last.append(int(at_last[k - 1][first[-1]]))
            first, last = first[::-1], last[::-1]
            n = len(first)
            yield pa.record_batch({"conv_id": pa.array([conv] * n, pa.int64()), "segment": pa.array(g["segment"], pa.int64()), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32()), "next": pa.array([*first[1:], 0], pa.int32()), "gap": pa.array(gaps)})

    fixed = stored(scores.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(fix, "conv_id long, segment long, first int, last int, next int, gap boolean"), "chat-bounds")
    bounds = fixed.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "first", "last", "next", "gap")
    placed = cut.join(bounds, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")
    placed = placed.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "line_no", "line")

    def decode(batches):
        m = shared.value
        out: list[tuple] = []

        def flush():
            names = [("conv_id", pa.int64()), ("turn", pa.int64()), ("line_no", pa.int32()), ("role", pa.string()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("n_lines", pa.int32()), ("text", pa.string()), ("rendered", pa.string())]
            return pa.record_batch({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(names)})

        for (conv, _), g in _groups(batches, ["conv_id", "segment"]):
            states = viterbi(m, _emissions(m, g["line"], g["gap"][0]), g["first"][0], g["last"][0])
            cuts = [i for i in range(len(states)) if i == 0 or states[i] % 2 == 0] + [len(states)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                begins = states[i] % 2 == 0
                ends = j < len(states) or g["next"][0] % 2 == 0
                role = ROLES[states[i] // 2]
                body = [read_marker(g["line"][i])[1] if begins else g["line"][i], *g["line"][i + 1 : j]]
                while ends and len(body) > 1 and not body[-1]:
                    body.pop()
                text = "\n".join(body)
                rendered = (f"{OPEN}{role}\n" if begins else "\n") + text + (f"{CLOSE}\n" if ends else "")
                out.append((conv, g["turn"][i], g["line_no"][i], role, bool(begins), bool(ends), len(body), text, rendered))
            if len(out) >= 2000:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return placed.mapInArrow(decode, "conv_id long, turn long, line_no int, role string, begins boolean, ends boolean, n_lines int, text string, rendered string")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Transcripts of all ``conversations``, parsed: conv_id, turn, line_no, role, begins, ends, n_lines, text, rendered."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return parse_transcripts(to_lines(conversations).drop("role"), train(conversations))
