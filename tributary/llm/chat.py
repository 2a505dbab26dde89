"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens give every turn its place. A conversation
that fits the budget is one window. A longer one is divided by its prefix sums into stretches of ``SPAN`` budgets; within
a stretch a window takes turns until the next one would not fit, and the only state is what the window holds so far, so
stretches are worked apart and each begins a window. A window repeats the conversation's first system turn and the
turns before it within the history limit; the loss mask has the assistant texts that are new in it, so each is a target
once.

A window holds at most ``budget`` tokens; it is larger only where a single turn is, or the system turn leaves no room.
Prefix sums are taken within stretches of turn numbers and then over stretches, so a conversation that holds a large
part of all rows is spread over tasks; a window's rows are bounded by its tokens.

Turns are marked ``<s>role``, line break, text, ``</s>``. Control strings inside roles and texts get a backslash after
their first character, and backslashes are doubled, which ``unescaped`` undoes.

Null texts and roles count as empty; a null turn number comes first; equal turn numbers are ordered by role and text,
rows repeated exactly are turns of their own. A null conversation id is an id like any other. Further columns are not
looked at. An empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm import columns as C
from tributary.session import written_once

BUDGET, HISTORY = 1024, 128
OPEN, CLOSE = "<s>", "</s>"
TARGET, SYSTEM = "assistant", "system"
_CONTROL = r"([<\[])(?=/?(?:s>|INST\]|<?/?SYS>>|\|))"
MARKS = 4  # tokens of what marks a turn
SPAN = 64  # budgets of a stretch
_STRETCH = 256  # turn numbers whose rows are summed together
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    """The text without control strings."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def token_count(text: Column) -> Column:
    """Words and single marks, and what marks a turn."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + MARKS


def placed(turns: DataFrame, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """Each turn with its marked ``piece``, its tokens and characters, the sums of those before it, and the system turn."""
    role, text = C.whole("role"), C.whole("text")
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")
    )
    marked = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = rows.select("*", marked.alias("head"), escaped(F.col("text")).alias("body"), tokens(F.col("text")).cast("bigint").alias("tokens"))
    rows = rows.select(
        "conv", "turn", "role", "text", F.floor(F.col("turn") / _STRETCH).alias("stretch"),
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.char_length("head").alias("head"),
        F.greatest("tokens", F.lit(1)).alias("tokens"),
    )
    rows = rows.select("*", F.char_length("piece").cast("bigint").alias("chars"))

    order = F.struct("turn", "role", "text")
    system = F.when(F.col("role") == SYSTEM, F.struct(order.alias("order"), "piece", "tokens", "chars"))
    sums = rows.groupBy("conv", "stretch").agg(
        F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"), F.min(system).alias("system")
    )
    along = Window.partitionBy("conv").orderBy("stretch")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv").alias("c"), F.col("stretch").alias("s"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.min("system").over(Window.partitionBy("conv")).alias("system"),
    )
    joined = rows.join(sums, F.col("conv").eqNullSafe(F.col("c")) & F.col("stretch").eqNullSafe(F.col("s")))
    within = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        "conv", "role", "piece", "head", "tokens", "chars", "system",
        (F.col("tokens_before") + F.sum("tokens").over(within) - F.col("tokens")).alias("start"),
        (F.col("chars_before") + F.sum("chars").over(within) - F.col("chars")).alias("char_start"),
        (order == F.col("system.order")).alias("is_system"),
        (order > F.col("system.order")).alias("after_system"),
    )


def _filled(names: list[str], budget: int):
    """A ``mapInArrow`` function over turns sorted by conversation, stretch and place: adds where each turn's window begins."""
    conv_at, part_at, start_at, size_at, room_at = map(names.index, ("conv", "part", "start", "tokens", "room"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begin, held, room = None, 0, 0, 0
        for batch in batches:
            out = []
            for conv, part, start, size, most in zip(*(batch.column(i).to_pylist() for i in (conv_at, part_at, start_at, size_at, room_at))):
                if now != (conv, part) or held + size > room:
                    # The conversation's first window repeats nothing and may be full.
                    now, begin, held, room = (conv, part), start, 0, most if start else budget
                held += size
                out.append(begin)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, "window"])

    return run


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = token_count
) -> DataFrame:
    """``(conv_id, window, text, targets, n_tokens, n_repeated)`` of ``(conv_id, turn, role, text)``.

    Windows of a conversation are ordered by ``window``, the tokens before it. ``targets`` are the spans of new assistant texts in ``text``,
    in code points, the end exclusive. The first ``n_repeated`` turns of a window stand in an earlier window too.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)), F.lit(1)).cast("bigint")
    rows = placed(turns, tokens).withColumns({"room": room, "part": F.floor(F.col("start") / (SPAN * budget))})
    ordered = rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "start")
    names = ordered.columns
    rows = written_once(ordered.mapInArrow(_filled(names, budget), ordered.withColumn("window", F.lit(0).cast("bigint")).schema))

    # Turns within ``history`` tokens before a window: each window asks for two of the buckets that turns lie in.
    size = max(history, 1)
    begins = rows.where((F.col("start") == F.col("window")) & (F.col("start") > 0)).select(F.col("conv").alias("c"), F.col("window").alias("begin"))
    begins = begins.withColumn("bucket", F.explode(F.array(F.floor(F.col("begin") / size), F.floor(F.col("begin") / size) - 1)))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.floor(F.col("start") / size) == F.col("bucket"))
    before = (F.col("start") >= F.col("begin") - history) & (F.col("start") < F.col("begin"))
    again = rows.drop("window").join(begins, same & before).withColumn("window", F.col("begin")).withColumn("new", F.lit(False))
    turn = F.struct("start", "new", "role", "piece", "head", "chars", "char_start", "tokens", "is_system", "after_system")
    used = ["conv", "window", "system", turn.alias("turn")]
    rows = rows.withColumn("new", F.lit(True)).select(*used).unionByName(again.select(*used))
    grouped = rows.groupBy("conv", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.any_value("system").alias("system"))
    # A window before the system turn does not repeat it: it would stand ahead of its place.
    leads = F.coalesce(F.get("turns", F.lit(0))["after_system"] & ~F.exists("turns", lambda t: t["is_system"]), F.lit(False))
    grouped = grouped.select("*", F.when(leads, F.col("system.chars")).otherwise(F.lit(0)).alias("lead"), leads.alias("leads"))
    offset = F.col("lead") - F.get("turns", F.lit(0))["char_start"]
    targets = F.transform(
        F.filter("turns", lambda t: t["new"] & (t["role"] == TARGET)),
        lambda t: F.struct(
            (offset + t["char_start"] + t["head"]).alias("start"),
            (offset + t["char_start"] + t["chars"] - len(CLOSE)).alias("end"),
        ),
    )
    told = F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"])
    return grouped.select(
        F.col("conv").cast(kind).alias("conv_id"),
        F.col("window"),
        F.concat(F.when(F.col("leads"), F.col("system.piece")).otherwise(F.lit("")), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("text"),
        targets.alias("targets"),
        (told + F.when(F.col("leads"), F.col("system.tokens")).otherwise(F.lit(0))).alias("n_tokens"),
        (F.size(F.filter("turns", lambda t: ~t["new"])) + F.col("leads").cast("int")).alias("n_repeated"),
    )


def read_turns(text: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a window's text."""
    found = []
    for piece in text.split(CLOSE)[:-1]:
        role, _, body = piece[len(OPEN) :].partition("\n")
        found.append((_role(role), unescaped(body)))
    return found


class _Read:
    """What the windows of a conversation say, read one after another."""

    def __init__(self, conv):
        self.conv = conv
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.windows = 0

    def add(self, text: str, targets: list[dict], repeated: int) -> None:
        self.chars += len(text)
        self.windows += 1
        for role, body in read_turns(text)[repeated:]:
            self.n_turns += 1
            self.turns.update(f"{role}\n{body}\n".encode())
        for span in targets:
            target = unescaped(text[span["start"] : span["end"]])
            self.loss_chars += len(target)
            self.loss.update(target.encode())

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows)


def digests(found: DataFrame) -> DataFrame:
    """For each conversation of ``windows`` its turns and targets, read back from the windows.

    A digest runs over a conversation's windows in their order, so they pass through one task, one window at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = None
        for batch in batches:
            rows, kind = [], batch.schema.field(0).type
            for conv, text, targets, repeated in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
                if read is None or read.conv != conv.as_py():
                    rows += [read.row()] if read else []
                    read = _Read(conv.as_py())
                read.add(text.as_py(), targets.as_py(), repeated.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, [kind, *kinds])], names)
        if read:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(read.row(), [kind, *kinds])], names)

    ordered = found.select("conv_id", "window", "text", "targets", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kind = found.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"
    )
