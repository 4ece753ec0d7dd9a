"""Chat formatting: roles of transcript turns by a hidden Markov model, then canonical rendering.

A text is cut before each of its lines that opens with a speaker marker, so that a transcript in one text comes apart.
A piece shows signs: a speaker marker at its start, its length, its lines, whether it asks, whether it holds code or a
list. Pieces of one text that turn out to be of one role in a row are one turn again. The model's states are roles; what each role shows and which role follows which are counted from turns whose
role is known. Viterbi's path over a whole conversation is found in pieces, as its steps are products of matrices
over (max, +): blocks of turns become one matrix each, the blocks of a conversation are chained by these small
matrices, and each block is then walked by itself. No task holds a whole conversation, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import materialise, runs

ROLES = ("system", "user", "assistant", "tool")
#: Names that transcripts give to speakers.
NAMES = {
    "system": ["system", "context", "instructions"],
    "user": ["user", "human", "customer", "question", "q", "prompt"],
    "assistant": ["assistant", "ai", "bot", "agent", "answer", "a", "response", "model"],
    "tool": ["tool", "function", "observation"],
}
BLOCK = 512
ALPHA = 0.5
#: Signs with the number of values of each; a marker names one of the roles or none.
SIGNS = {"marker": 5, "length": 8, "lines": 4, "asks": 2, "code": 2, "listed": 2, "first": 2}
MARKER = r"^\s*(?:<\|im_start\|>|<\|)?(?:#{1,4}\s*|\*\*|\[)?(%s)\b(?:\]|\*\*|\|>)?\s*(?::|\n|\|>|\])"


#: What opens a line of another speaker within a text: a name with a colon, or a name as a tag.
INNER = r"(?i)\n(?=[ \t]*(?:(?:#{1,4}[ \t]*|\*\*|\[)?(?:%s)\b(?:\]|\*\*)?[ \t]*:|<\|(?:im_start\|>)?(?:%s)\b))"


def pieces_of(text: Column) -> Column:
    """A text in pieces, cut before each line but the first that opens with a speaker marker; line breaks join them again."""
    names = "|".join(n for k in ROLES for n in NAMES[k])
    return F.split(F.coalesce(text, F.lit("")), INNER % (names, names))


def with_signs(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, text) and the signs of each turn, as small whole numbers."""
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    marker = F.lit(4)
    for k, role in reversed(list(enumerate(ROLES))):
        marker = F.when(low.rlike(MARKER % "|".join(NAMES[role])), F.lit(k)).otherwise(marker)
    words = F.regexp_count(text, F.lit(r"\S+"))
    signs = {
        "marker": marker,
        "length": F.least(F.lit(7), F.floor(F.log2(words + 1))),
        "lines": F.least(F.lit(3), F.regexp_count(text, F.lit("\n"))),
        "asks": F.rtrim(text).endswith("?"),
        "code": text.contains("```"),
        "listed": text.rlike(r"(?m)^\s*(?:[-*]|\d+[.)])\s"),
        "first": F.col("turn") == 0,
    }
    return turns.withColumns({"sign_" + k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in signs.items()})


def bare(text: Column) -> Column:
    """A turn's text without its speaker marker and closing marks."""
    names = "|".join(n for k in ROLES for n in NAMES[k])
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?i)" + MARKER % names, ""), r"<\|im_end\|>\s*$", ""), r"^\s+|\s+$", "")


class HMM:
    """Log-probabilities: ``start`` (states), ``step`` (states, states), ``emit`` per sign (states, values)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: dict[str, np.ndarray]):
        self.start, self.step, self.emit = start, step, emit

    def shows(self, signs: dict[str, np.ndarray]) -> np.ndarray:
        """(turns, states): log-probability of what each turn shows."""
        return sum(self.emit[k][:, np.minimum(v, SIGNS[k] - 1)].T for k, v in signs.items())


def part_of_turn() -> Column:
    return F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).cast("long")


def with_blocks(turns: DataFrame) -> DataFrame:
    """``turns`` with ``block`` (at most 512 turns; blocks of a conversation rise with its turns) and ``place`` within it."""
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "text")) - 1
    ranked = turns.withColumn("part", part_of_turn()).withColumn("rank", rank)
    block = F.col("part") * (1 << 24) + F.floor(F.col("rank") / BLOCK)
    return ranked.withColumn("block", block.cast("long")).withColumn("place", F.pmod("rank", F.lit(BLOCK)).cast("int")).drop("part", "rank")


def logs(counts: np.ndarray) -> np.ndarray:
    counts = counts + ALPHA
    return np.log(counts / counts.sum(-1, keepdims=True))


def fit(turns: DataFrame) -> HMM:
    """Counts over all turns of known role whose text is one piece; a marker at odds with the role is what the counts say it is.

    The counts that reach the driver are of a fixed number: states times states, and states times values.
    """
    state = F.lit(None).cast("int")
    for k, role in enumerate(ROLES):
        state = F.when(F.lower(F.trim("role")) == role, F.lit(k)).otherwise(state)
    known = with_signs(turns).withColumn("state", F.when(F.size(pieces_of(F.col("text"))) == 1, state))
    before = F.lag("state").over(Window.partitionBy("conv_id", part_of_turn()).orderBy("turn", "text"))  # pairs within a part
    s = len(ROLES)
    start, step, emit = np.zeros(s), np.zeros((s, s)), {k: np.zeros((s, n)) for k, n in SIGNS.items()}
    emit["marker"][:, :s] += np.eye(s) * 50  # a marker names its role, unless the data say otherwise
    names = ["sign_" + k for k in SIGNS]
    counted = known.withColumn("before", before).where("state IS NOT NULL").groupBy("state", "before", F.col("turn") == 0, *names).count()
    sums = materialise(counted, "chat-counts")
    for r in sums.groupBy("state", "before", sums.columns[2]).agg(F.sum("count").alias("n")).collect():
        if r.before is not None:
            step[r.before, r.state] += r.n
        elif r[2]:
            start[r.state] += r.n
    for k in SIGNS:
        for r in sums.groupBy("state", "sign_" + k).agg(F.sum("count").alias("n")).collect():
            emit[k][r.state, min(r[1], SIGNS[k] - 1)] += r.n
    return HMM(logs(start), logs(step), {k: logs(v) for k, v in emit.items()})


def product(shows: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(max, +) matrix of a block: best log-probability from the state before it to the state at its end."""
    out = None
    for e in shows:
        m = step + e[None, :]
        out = m if out is None else (out[:, :, None] + m[None, :, :]).max(1)
    return out


def walk(shows: np.ndarray, step: np.ndarray, first: np.ndarray, last: int | None) -> list[int]:
    """Best states within a block: ``first`` holds the log-probability of each state at its first turn. Ties: the lower state."""
    best, back = first, []
    for e in shows[1:]:
        m = best[:, None] + step
        back.append(m.argmax(0))
        best = m.max(0) + e[None, :][0]
    path = [int(best.argmax()) if last is None else last]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def viterbi(model: HMM, signs: dict[str, np.ndarray]) -> list[int]:
    """The best path over a whole conversation at once; ``recover_roles`` finds the same in blocks."""
    shows = model.shows(signs)
    return walk(shows, model.step, model.start + shows[0], None) if len(shows) else []


def recover_roles(turns: DataFrame, model: HMM) -> DataFrame:
    """(conv_id, turn, part, role, text, recovered): the pieces of every turn, joined where neighbours in a turn have one
    role; ``recovered`` is the role on the best path of the conversation, ``part`` counts the parts of a turn from 0."""
    turns = turns.select("conv_id", "turn", "role", "text")
    spark, signs = turns.sparkSession, ["sign_" + k for k in SIGNS]
    held = spark.sparkContext.broadcast(model)  # of a fixed size
    s = len(ROLES)
    cut = with_blocks(turns).withColumn("pieces", pieces_of(F.col("text")))
    cut = cut.select("conv_id", "turn", "role", "block", "place", F.size("pieces").alias("several"), F.posexplode("pieces").alias("piece", "text"))
    cut = with_signs(cut).withColumn("sign_first", F.when(F.col("piece") > 0, 0).otherwise(F.col("sign_first")))
    rows = materialise(cut.withColumn("place", F.shiftleft(F.col("place").cast("long"), 32) + F.col("piece")), "chat-turns")

    def arranged(columns: list[str]) -> DataFrame:
        return rows.select(*columns).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")

    def shows_of(group: dict[str, list]) -> np.ndarray:
        return held.value.shows({k: np.array(group["sign_" + k], np.int64) for k in SIGNS})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out = [], []
        for key, group in runs(batches, ("conv_id", "block")):
            shows, model = shows_of(group), held.value
            entered = np.vstack([model.step, model.start]) + shows[0]  # the last row: as the first block
            m = (entered[:, :, None] + product(shows[1:], model.step)[None, :, :]).max(1) if len(shows) > 1 else entered
            keys.append(key)
            out.append(m.ravel())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["conv_id", "block", "m"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State before each block and at its end, on the best path; a number pair per 512 turns."""
        for (conv,), group in runs(batches, ("conv_id",)):
            ms = [np.array(m).reshape(s + 1, s) for m in group["m"]]
            best, back = ms[0][s], []
            for m in ms[1:]:
                t = best[:, None] + m[:s]
                back.append(t.argmax(0))
                best = t.max(0)
            ends = [int(best.argmax())]
            for b in back[::-1]:
                ends.append(int(b[ends[-1]]))
            ends = ends[::-1]
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(ends), pa.int64()), pa.array(group["block"], pa.int64()), pa.array([-1, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())], ["conv_id", "block", "enters", "leaves"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in runs(batches, ("conv_id", "block")):
            shows, model = shows_of(group), held.value
            enters, leaves = group["enters"][0], group["leaves"][0]
            first = (model.start if enters < 0 else model.step[enters]) + shows[0]
            path = walk(shows, model.step, first, leaves)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(path), pa.int64()), pa.array([key[1]] * len(path), pa.int64()), pa.array(group["place"], pa.int64()), pa.array([ROLES[k] for k in path])], ["conv_id", "block", "place", "recovered"])

    blocks = arranged(["conv_id", "block", "place", *signs]).mapInArrow(summed, "conv_id long, block long, m array<double>")
    ends = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chained, "conv_id long, block long, enters int, leaves int")
    ends = materialise(ends, "chat-ends")
    placed = rows.select("conv_id", "block", "place", *signs).join(ends, ["conv_id", "block"]).sortWithinPartitions("conv_id", "block", "place")
    paths = materialise(placed.mapInArrow(walked, "conv_id long, block long, place long, recovered string"), "chat-paths")
    told = rows.join(paths, ["conv_id", "block", "place"]).withColumn("source", F.shiftright("place", 32))
    whole = told.where("several = 1").select("conv_id", "turn", F.lit(0).alias("part"), "role", "text", "recovered")
    within = Window.partitionBy("conv_id", "block", "source").orderBy("place")
    turned = F.coalesce((F.lag("recovered").over(within) != F.col("recovered")).cast("int"), F.lit(0))
    parts = told.where("several > 1").withColumn("turned", turned).withColumn("part", F.sum("turned").over(within).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    joined = parts.groupBy("conv_id", "block", "source", "part").agg(F.max("turn").alias("turn"), F.max("role").alias("role"), text.alias("text"), F.max("recovered").alias("recovered"))
    return whole.union(joined.select(*whole.columns))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, recovered, n_turns, rendered), a row per turn of every conversation, and several
    (``part`` from 0) where a turn's text is itself a transcript; ``n_turns`` counts the rows of the table.

    ``rendered`` is ``<|role|>``, a line break, the bare text, ``<|end|>`` and a line break; a conversation is its
    turns' renderings in order. Nulls: a null text is empty, a null role is only not learned from, a null turn comes
    first, and rows without conv_id are left out. Ties: turns of one number in the order of their texts. Repeated
    rows are turns of their own. Very long texts are cut at their markers alone, and no text is lost: the parts of a turn
    are its whole text but for the markers that open them. Empty table: an empty result. Other columns are not read.
    """
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    found = recover_roles(rows, fit(rows))
    many = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    rendered = F.concat(F.lit("<|"), F.col("recovered"), F.lit("|>\n"), bare(F.coalesce("text", F.lit(""))), F.lit("<|end|>\n"))
    return found.join(many, "conv_id").select("conv_id", "turn", "part", "role", "recovered", "n_turns", rendered.alias("rendered"))
