"""Chat formatting in budgeted windows: turn-aligned spans by prefix sums of tokens, with repeated context and a loss mask.

The running sum of a conversation's tokens is cut into cells; the turns that begin in one cell are the new turns of one window. A
turn of more than a quarter of the budget stands alone. Before its new turns a window repeats the system turn (a first turn of
that role) and up to ``history`` turns of the window before. A cell is as wide as the budget leaves it:

    cell = budget - system - history room - longest turn of a quarter of the budget or less

so no window exceeds ``budget``, but for the one defined case of a single turn over it, which is a window by itself, uncut. The
system turn is repeated where it takes a quarter of the budget at most (and, before a turn that stands alone, as far as it fits);
the history takes a quarter at most. Every turn is new in one window; the loss mask covers the assistant texts that are new.

The template writes a turn as ``<turn:role:n>``, the text, ``</turn>``, each on its own line, ``n`` for new and ``h`` for repeated.
Inside texts ``\\`` becomes ``\\\\`` and ``<`` becomes ``\\l`` (in roles also ``:`` ``\\c``, ``>`` ``\\g``, a line end ``\\n``), so no text can
hold a control string, and reading back gives each text as it was.

The prefix sums are distributed: turns are dealt by ranges of conversation and place, each range sums its own, and a table of one
row per conversation and range gives what stands before. So a conversation of any length is spread over tasks; windows are
bounded by the budget. Only the ordered digest of ``read_back`` streams through one task, which holds a window.

Defined results: a null text or role is empty; turns of one number are ordered by role, then text; a turn has one token at least;
rows that repeat count as turns of their own; a null conversation id is a conversation. Numbers of windows rise, with gaps.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

BUDGET, HISTORY = 1024, 2
OVERHEAD = 8
TURN = re.compile(r"<turn:([^:<>]*):([nh])>\n([^<]*)\n</turn>\n")
ESCAPES = {"\\": "\\\\", "<": "\\l", ":": "\\c", ">": "\\g", "\n": "\\n"}
UNESCAPES = {v: k for k, v in ESCAPES.items()}
ESCAPED = re.compile(r"\\[\\lcgn]")


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escaped_role(role: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in role)


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: UNESCAPES[m[0]], text) if "\\" in text else text


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, and what marks the turn; any other count can stand in its place."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4) + OVERHEAD


def format_turn(role: str, text: str, new: bool) -> tuple[str, int, int]:
    """The formatted turn and the place of its text within."""
    head = f"<turn:{escaped_role(role)}:{'n' if new else 'h'}>\n"
    body = escaped(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def ranged(turns: DataFrame, tokens: Column) -> DataFrame:
    """Turns with the range of conversations and places that they fell into, written once; a null id is told by ``no_id``."""
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit("0").cast(kind)).alias("id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.greatest(tokens.cast("long"), F.lit(1)).alias("tokens"),
    )
    order = ["no_id", "id", "turn", "role", F.substring("text", 1, 64)]  # what is equal in these stays in one range
    return staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "chat")


def placed(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its window, the sum of tokens before it, and the system turn and history room of its conversation."""
    big, key = budget // 4, ["no_id", "id"]
    first = F.min_by(F.struct("role", "text", "tokens"), F.struct("turn", "role", "text"))
    is_big = (F.col("tokens") > big).cast("long")
    sums = rows.groupBy(*key, "part").agg(F.sum("tokens").alias("sum"), F.sum(is_big).alias("n_big"), F.max(F.when(F.col("tokens") <= big, F.col("tokens"))).alias("longest"), first.alias("first"))
    # one row per conversation and range
    every, before = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.min_by("first", "part").over(every)
    system = F.when((start["role"] == "system") & (start["tokens"] <= big), start)
    longest = F.coalesce(F.max("longest").over(every), F.lit(1))
    sums = sums.select(*key, "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n_big").over(before), F.lit(0)).alias("base_big"), longest.alias("longest"), system.alias("system"))
    sums = sums.withColumn("room", F.least(F.lit(big), F.col("longest") * history))
    sums = sums.withColumn("cell", budget - F.coalesce("system.tokens", F.lit(0)) - F.col("room") - F.col("longest"))
    here = Window.partitionBy(*key, "part").orderBy("turn", "role", "text", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, [*key, "part"])
    rows = rows.withColumns({"at": F.col("base") + F.sum("tokens").over(here) - F.col("tokens"), "alone": 2 * (F.col("base_big") + F.sum(is_big).over(here)) - is_big})
    return rows.withColumn("window", F.floor(F.col("at") / F.col("cell")) + F.col("alone"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """(conv_id, window, n_turns, n_tokens, formatted, loss): loss as [start, end) code points of ``formatted``."""
    if budget < 16:
        raise ValueError("a budget has 16 tokens at least")
    rows = placed(ranged(turns, estimated_tokens(F.col("text")) if tokens is None else tokens), budget, history)
    own = F.array_sort(F.collect_list(F.struct("at", "role", "text", "tokens")))
    cut = rows.groupBy("no_id", "id", "window").agg(own.alias("turns"), F.min("at").alias("at"), F.max(F.col("at") + F.col("tokens")).alias("until"), F.first("system").alias("system"), F.first("room").alias("room"))
    cut = staged(cut, "chat-windows")
    # the last turns of the window before, newest first; a window begins where the one before it ends
    lent = cut.select("no_id", "id", F.col("until").alias("at"), F.slice(F.reverse("turns"), 1, max(history, 1)).alias("lent"))
    cut = cut.join(lent, ["no_id", "id", "at"], "left").select(F.when(~F.col("no_id"), F.col("id")).alias("conv_id"), "window", "at", "turns", "system", "room", "lent")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("window", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                made = [formatted_window(*row, budget, history) for row in zip(*(part.column(c).to_pylist() for c in range(2, 7)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=schema.names)

    return cut.mapInArrow(write, schema)


def formatted_window(at: int, turns: list[dict], system: dict | None, room: int, lent: list[dict] | None, budget: int, history: int) -> tuple[int, int, str, list[dict]]:
    """Turns, tokens, text and loss of one window: the system turn and the lent turns that fit, then its own turns."""
    used = sum(t["tokens"] for t in turns)
    context, kept = [], []
    if system and at and used + system["tokens"] <= budget:
        context, used = [system], used + system["tokens"]
    room = min(room, budget - used)
    for turn in (lent or []) if history else []:
        if turn["tokens"] > room or (system and not turn["at"]):
            break
        kept.append(turn)
        room, used = room - turn["tokens"], used + turn["tokens"]
    parts, loss, length = [], [], 0
    for turn, new in [(t, False) for t in context + kept[::-1]] + [(t, True) for t in turns]:
        part, start, end = format_turn(turn["role"], turn["text"], new)
        if new and turn["role"] == "assistant":
            loss.append({"start": length + start, "end": length + end})
        parts.append(part)
        length += len(part)
    return len(turns), used, "".join(parts), loss


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows hold, one row per conversation: turns, loss text and length, read from the formatted text alone."""
    schema = T.StructType([formatted.schema["conv_id"], *[T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("n_windows", T.LongType()))]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = batches
        state: list = []
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def flushed(id_type: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*done), (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key != now:
                    close()
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, flag, body in TURN.findall(text):
                    if flag == "n":
                        state[0] += 1
                        state[1].update(f"{unescaped(role)}\n{unescaped(body)}\n".encode("utf-8", "surrogatepass"))
                for part in loss:
                    target = unescaped(text[part["start"] : part["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
            if len(done) >= 4096:
                yield flushed(id_type)
        close()
        if done:
            yield flushed(id_type)

    return formatted.select("conv_id", "window", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(read, schema)
