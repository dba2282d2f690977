"""Chat formatting in budgeted windows.

Turns are marked as ``<|role|>`` newline text ``<|end|>`` newline.  Control
strings inside roles and texts are escaped so that no mark can be forged, and
the escape can be undone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from newsiq.llm.batches import cut, strings, with_columns
from newsiq.llm.bpe import _codec, _file

#: Tokens of a window, and of the earlier turns that it may repeat.
BUDGET, HISTORY = 1024, 256
#: Windows' worth of tokens after which a conversation may be handled by another task.
BLOCK = 32

# Marks of common chat templates, ours among them; none may appear in a text unescaped.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")
_ESCAPE = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROL)) + ").", re.DOTALL)
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.DOTALL)

SPAN = "struct<start: int, end: int>"
TURN = "struct<start: int, end: int, repeated: boolean>"


def escape(text: str) -> str:
    """Backslashes are doubled, and a backslash is put behind the first character of every control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn(role: str, text: str) -> str:
    return f"<|{escape(role)}|>\n{escape(text)}<|end|>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window; anything else in it is an error."""
    found = list(_TURN.finditer(formatted))
    if "".join(m[0] for m in found) != formatted:
        raise ValueError("not a formatted window")
    return [(unescape(m[1]), unescape(m[2])) for m in found]


def _by_key(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with one key, as the sorted partition streams by."""
    rows = (row for batch in batches for at in range(0, batch.num_rows, 512) for row in batch.slice(at, 512).to_pylist())
    return itertools.groupby(rows, lambda r: tuple(r[k] for k in key))


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the row's number in its conversation, and ``begin``, the tokens before it.

    Rows are sorted over all tasks, each task adds up its own stretch, and the
    stretches' sums, one row per task and conversation that crosses into the
    task, are added in front.  A long conversation is spread over tasks.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("in_pos", T.LongType()), T.StructField("in_begin", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, pos, begin = TaskContext.get().partitionId(), object(), 0, 0
        for batch in batches:
            ids, tokens = batch.column(batch.schema.get_field_index("conv_id")).to_pylist(), batch.column(batch.schema.get_field_index("n_tokens")).to_pylist()
            places = []
            for conv, n in zip(ids, tokens, strict=True):
                if conv != last:
                    last, pos, begin = conv, 0, 0
                places.append((pos, begin))
                pos, begin = pos + 1, begin + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(ids), pa.int32()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())], names=schema.names)

    rows = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(number, schema))
    sums = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("task").alias("_task"), F.sum("n").over(before).alias("_n"), F.sum("t").over(before).alias("_t"))
    carried = sums.where(F.col("_n").isNotNull())  # a task has at most one conversation that began before it
    rows = rows.join(F.broadcast(carried), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("task") == F.col("_task")), "left")
    out = rows.withColumn("pos", F.col("in_pos") + F.coalesce("_n", F.lit(0))).withColumn("begin", F.col("in_begin") + F.coalesce("_t", F.lit(0)))
    return out.drop("task", "in_pos", "in_begin", "_conv", "_task", "_n", "_t")


def windows_of(begins: np.ndarray, ends: np.ndarray, first: int, system: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(first repeated, first new, end) turn numbers of each window, found in the prefix sums of turn tokens.

    Turns from ``first`` on are new, those before it only history.  A window
    has ``system`` tokens, as many whole earlier turns as ``history`` and the
    budget allow, and as many new turns as then fit, at least one.
    """
    i = first
    while i < len(begins):
        room = budget - system - (ends[i] - begins[i])
        j = int(np.searchsorted(begins, begins[i] - max(0, min(history, room)), "left"))
        j = min(j, i)
        e = max(i + 1, int(np.searchsorted(ends, begins[i] + budget - system - (begins[i] - begins[j]), "right")))
        yield j, i, e
        i = e


def format_windows(
    df: DataFrame, ranks_path: str, pattern: str, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """(conv_id, block, window, text, turns, loss, n_tokens, over_budget) of the conversations in ``df``.

    ``df`` has a row per turn (conv_id, turn, role, text).  Every turn is new
    in exactly one window, in order.  A window holds the conversation's system
    turn (its first turn, if the role is system), up to ``history`` tokens of
    whole turns before its new ones, and new turns up to ``budget`` tokens in
    all; a turn that does not fit alone has a window of its own and sets
    ``over_budget``.  ``turns`` are the spans of the turns in ``text`` with a
    flag for repeated ones, ``loss`` the spans of the texts of new assistant
    turns; repeated targets are masked.

    Rows are ordered by turn, ties by role and text.  Null roles and texts
    count as empty; rows with a null conv_id are one conversation; a null turn
    comes first.  Repeated rows are turns of their own.  An empty table gives
    no windows; other columns are ignored.

    A conversation is cut into blocks of ``BLOCK`` windows' tokens, which are
    handled apart, so no task gets a long one as a whole.
    """
    if history >= budget:
        raise ValueError("history must be below the budget")
    files = _file(df, ranks_path)
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def measure(batch: pa.RecordBatch) -> list:
        call = _codec(files, pattern)[0]
        return [pa.array([len(call(turn(r, t))) for r, t in zip(strings(batch, "role").to_pylist(), strings(batch, "text").to_pylist(), strict=True)], pa.int64())]

    placed = _placed(with_columns(rows, "n_tokens long", measure), ["conv_id"], ["turn", "role", "text"])
    size = budget * BLOCK
    placed = placed.withColumn("block", F.floor(F.col("begin") / size)).withColumn("until", F.floor((F.col("begin") + history) / size))
    system = placed.where("pos = 0 and role = 'system'")
    base = ["conv_id", "pos", "begin", "n_tokens", "role", "text"]
    new = placed.select(*base, "block", F.lit(2).alias("kind"))
    earlier = placed.where("until > block and not (pos = 0 and role = 'system')").select(*base, F.col("until").alias("block"), F.lit(1).alias("kind"))
    blocks = placed.where("block > 0").select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block")).distinct()
    again = system.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*base, F.col("_block").alias("block"), F.lit(0).alias("kind"))
    dealt = new.unionByName(earlier).unionByName(again)
    dealt = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "pos")
    schema = T.StructType([
        T.StructField("conv_id", df.schema["conv_id"].dataType), *T.StructType.fromDDL(
            f"block long, window int, text string, turns array<{TURN}>, loss array<{SPAN}>, n_tokens long, over_budget boolean"
        ).fields,
    ])
    arrow = {"turns": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("repeated", pa.bool_())])), "loss": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}

    def made(conv, block, group: list[dict]) -> Iterator[dict]:
        head = next((r for r in group if r["pos"] == 0 and r["role"] == "system"), None)
        turns = [r for r in group if r is not head]
        first = next((i for i, r in enumerate(turns) if r["kind"] == 2), len(turns))
        begins = np.array([r["begin"] for r in turns], np.int64)
        ends = begins + np.array([r["n_tokens"] for r in turns], np.int64)
        cost = head["n_tokens"] if head else 0
        spans = list(windows_of(begins, ends, first, cost, budget, history))
        if head and head["kind"] == 2 and not spans:
            spans = [(0, 0, 0)]  # a conversation of a system turn alone
        for w, (j, i, e) in enumerate(spans):
            parts = [(head, head["kind"] != 2 or w > 0)] if head else []
            parts += [(r, k < i) for k, r in zip(range(j, e), turns[j:e], strict=True)]
            places, loss, pieces, at, total = [], [], [], 0, 0
            for r, repeated in parts:
                piece = turn(r["role"], r["text"])
                places.append({"start": at, "end": at + len(piece), "repeated": repeated})
                if r["role"] == "assistant" and not repeated:
                    loss.append({"start": at + len(turn(r["role"], "")) - len("<|end|>\n"), "end": at + len(piece) - len("<|end|>\n")})
                pieces.append(piece)
                at, total = at + len(piece), total + r["n_tokens"]
            yield {"conv_id": conv, "block": block, "window": w, "text": "".join(pieces), "turns": places, "loss": loss, "n_tokens": total, "over_budget": total > budget}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {f.name: f.dataType for f in schema}
        out, chars = [], 0

        def flush():
            simple = {"block": pa.int64(), "window": pa.int32(), "text": pa.string(), "n_tokens": pa.int64(), "over_budget": pa.bool_(), "conv_id": None}
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], arrow.get(n) or simple[n] or to_arrow_type(kinds[n])) for n in schema.names], names=schema.names)

        for (conv, block), group in _by_key(batches, ("conv_id", "block")):
            for row in made(conv, block, list(group)):  # at most a block's tokens and one turn
                out.append(row)
                chars += len(row["text"])
                if chars > 1 << 22:
                    yield flush()
                    out, chars = [], 0
        if out:
            yield flush()

    return dealt.mapInArrow(run, schema)


def digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the windows.

    Turns are parsed out of the formatted texts, repeated ones skipped; the
    loss text is cut out by its spans.  A digest runs over a conversation's
    windows in order, so they stream through one task, one window at a time.
    """
    schema = T.StructType([windows.schema["conv_id"], *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv,), group in _by_key(batches, ("conv_id",)):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for row in group:
                size += len(row["text"])
                for (role, text), place in zip(parse(row["text"]), row["turns"], strict=True):
                    if not place["repeated"]:
                        n += 1
                        turns.update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    part = unescape(row["text"][span["start"] : span["end"]])
                    chars += len(part)
                    loss.update(part.encode())
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
        kinds = [to_arrow_type(schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=schema.names)

    rows = windows.select("conv_id", "block", "window", "text", "turns", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").mapInArrow(run, schema)
