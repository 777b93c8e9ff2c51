"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans that fit the tokens a window has left beside the
system turn and its history. A window shows the system turn, limited history from before its span, and the span's
turns; what it repeats is masked, so every assistant turn is a target exactly once. Control strings inside texts and
roles are escaped, and the escaping is undone when a window is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, stored

WINDOW_TOKENS, HISTORY_TOKENS = 1280, 256
TURN_BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def turn_tokens(text: Column) -> Column:
    """Tokens a turn is budgeted with: its words and four for the marks around it."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 4).cast("bigint")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows from rows (conv_id, span, turns, tokens); turns are (repeated, start, role, text), the repeated ones first."""
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in small_batches(batches, 64):
        texts, repeated, masks = [], [], []
        for turns in batch.column(2).to_pylist():
            parts, at, loss = [], 0, []
            for t in turns:
                head, body = f"{OPEN}{escaped_role(t['role'])}\n", escaped(t["text"])
                if t["role"] == "assistant" and not t["repeated"]:
                    loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts += [head, body, CLOSE, "\n"]
                at += len(head) + len(body) + len(CLOSE) + 1
            texts.append("".join(parts))
            repeated.append(sum(t["repeated"] for t in turns))
            masks.append(loss)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(repeated, pa.int32()), pa.array(masks, loss_type), batch.column(3)],
            names=["conv_id", "window", "formatted", "n_repeated", "loss", "tokens"],
        )


def chat_windows(
    turns: DataFrame, window_tokens: int = WINDOW_TOKENS, history_tokens: int = HISTORY_TOKENS, tokens=turn_tokens
) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss, tokens) from rows (conv_id, turn, role, text); windows count upwards, with gaps.

    ``loss`` has the spans of code points of assistant texts that are targets. No window is over ``window_tokens``, but
    for one whose only turn beside the system turn and the history does not fit, which stays whole. History is the turns
    that start in the last ``history_tokens`` tokens before a span, which are no more tokens than that. Only a
    first turn with role 'system' is retained in all windows. ``tokens`` counts words and marks unless another column
    function is given; a turn counts one at least. Null texts and roles count as empty; rows of a null conv_id are one conversation;
    null turns come first; ties of turn are ordered by role and text; repeated rows stay. An empty table gives no windows.
    """
    if not 0 <= history_tokens < window_tokens:
        raise ValueError("history must be smaller than a window")
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = (
        turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
        .withColumn("n", F.greatest(tokens(F.col("text")), F.lit(1))).withColumn("block", F.expr(f"turn div {TURN_BLOCK}"))
    )
    # Prefix sums in two steps, so that one conversation with very many turns is not one group.
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    past = (Window.unboundedPreceding, -1)
    inside = stored(
        rows.withColumn("inside", F.coalesce(F.sum("n").over(order.rowsBetween(*past)), F.lit(0))).withColumn("first", F.row_number().over(order) == 1),
        "turns",
    )
    leads = F.max(F.when(F.col("first") & (F.col("role") == "system"), F.col("n"))).alias("leads")
    sums = inside.groupBy("conv_id", "block").agg(F.sum("n").alias("n"), leads)
    blocks = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    sums = sums.select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(blocks.rowsBetween(*past)), F.lit(0)).alias("before"),
        F.coalesce(F.first("leads").over(blocks.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("system"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))
    # Places count from behind the system turn; ``room`` is what a span has.
    placed = inside.join(sums, same).select(
        "conv_id", "role", "text", "n", (F.col("before") + F.col("inside") - F.col("system")).alias("start"),
        F.greatest(F.lit(window_tokens - history_tokens) - F.col("system"), F.lit(1)).alias("room"),
    )
    placed = placed.withColumn("cell", F.expr("greatest(start, 0) div room")).withColumn("end", F.col("start") + F.col("n"))
    # A cell of the places' grid is as long as a span may be. A turn that passes its cell's end is a span by itself, unless it fits to
    # the cell's turns before it or there are none. Cells and spans have few turns, as each turn has tokens.
    cell_start = F.min(F.when(F.col("start") >= 0, F.col("start"))).over(Window.partitionBy("conv_id", "cell"))
    placed = placed.withColumn("cell_start", cell_start).withColumn("span", F.expr(
        "2 * cell + CASE WHEN end > (cell + 1) * room AND start > cell_start AND end - cell_start > room THEN 1 ELSE 0 END"
    ))
    span_end = F.max("end").over(Window.partitionBy("conv_id", "cell", "span"))
    placed = stored(placed.select("conv_id", "span", "start", "n", "role", "text", "room", span_end.alias("span_end")), "placed")
    shown = ["start", "n", "role", "text"]
    new = placed.select("conv_id", "span", F.lit(False).alias("repeated"), *shown)
    first = stored(placed.groupBy("conv_id", "span").agg(F.min("start").alias("at"), F.expr("greatest(min(start), 0) div any_value(room)").alias("cell")), "spans")
    spans = first.select(F.col("conv_id").alias("_c"), F.col("span").alias("_s"), "at", F.col("cell").alias("_cell"))
    # The spans that start behind a turn, but not more than the history's tokens behind its start; few turns have any.
    late = placed.filter((F.col("start") >= F.col("span_end") - history_tokens) & (F.col("start") >= 0))
    near = late.withColumn("cell", F.explode(F.expr(f"sequence(span_end div room, (start + {history_tokens}) div room)")))
    follows = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("cell") == F.col("_cell")) & F.col("at").between(F.col("span_end"), F.col("start") + history_tokens)
    history = near.join(spans, follows).select("conv_id", F.col("_s").alias("span"), F.lit(True).alias("repeated"), *shown)
    # A system turn goes to each later window of its conversation; the windows are far fewer than the turns.
    kept = placed.filter("start < 0").join(spans.filter("_s > 0"), F.col("conv_id").eqNullSafe(F.col("_c")))
    retained = kept.select("conv_id", F.col("_s").alias("span"), F.lit(True).alias("repeated"), *shown)
    turn = F.struct((~F.col("repeated")).alias("new"), "start", "repeated", "role", "text")
    windows = new.unionByName(history).unionByName(retained).groupBy("conv_id", "span").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("n").alias("tokens")
    )
    return windows.select("conv_id", "span", "turns", "tokens").mapInArrow(
        _format, "conv_id bigint, window bigint, formatted string, n_repeated int, loss array<struct<start:bigint,end:bigint>>, tokens bigint"
    )


def read_window(formatted: str, n_repeated: int, loss: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
    """(new turns as (role, text), texts under the loss mask) of one window."""
    turns = [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]
    return turns[n_repeated:], [unescaped(formatted[s["start"] : s["end"]]) for s in loss]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose windows come in order, one after the other; only digests are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def closed(c):
        return [c["conv"], c["n"], c["turns"].hexdigest(), c["chars"], c["loss"].hexdigest(), c["formatted"]]

    now = None
    for batch in small_batches(batches):
        done = []
        for conv, _, formatted, n_repeated, loss in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now["conv"] != conv:
                if now is not None:
                    done.append(closed(now))
                now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
            turns, targets = read_window(formatted, n_repeated, loss)
            now["n"] += len(turns)
            for role, text in turns:
                now["turns"].update(f"{role}\n{text}\n".encode())
            for text in targets:
                now["chars"] += len(text)
                now["loss"].update(text.encode())
            now["formatted"] += len(formatted)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=_DIGEST)
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, closed(now)))], schema=_DIGEST)


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the windows alone.

    A digest over a whole conversation has to see its windows in order: one task streams them, whatever their number.
    """
    ordered = windows.select("conv_id", "window", "formatted", "n_repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
