"""Sliding windows over a stream of messages, and a report of the late ones.

State per group: a list state with the last ``length - 1`` messages and a value
state with how many were seen and how many came too late. A full window is
emitted when its last message arrives; these are the batch windows with
``n_messages = length``. A group that stays idle can be ended by a timer.

The messages of a group have an order, so a group is one state and one task per
micro-batch. That task only orders and numbers its new messages, and hands them
on in pieces that overlap by ``length - 1``; the windows, many times larger, are
cut from the pieces by all tasks. What one group can bring in a micro-batch is
bounded by the trigger (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``).

Python looks at the order of messages only. Their values pass through it as JSON
texts that the JVM writes and reads, so NULL, NaN and whole numbers stay apart.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chatwarden.functions.fixed_values import WINDOW_LENGTH, WINDOW_STEP
from chatwarden.streaming.scoring import start_batches, write_batch

_TIMES = (T.TimestampType, T.TimestampNTZType)
# Window starts in one piece of messages.
_PIECE = 500
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LEAST = -(1 << 63)


class _Cutter(StatefulProcessor):
    """Orders and numbers the messages of a group; hands on pieces and late messages."""

    def __init__(self, group: str, order_type: T.StructType, length: int, stride: int, idle: int | None):
        self.group, self.order_type = group, order_type
        self.length, self.stride, self.idle = length, stride, idle
        self.names = [*order_type.names, "message"]
        self.piece = Row(group, "_first", "_last", "late_messages", "_messages")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "seen bigint, late bigint")
        tail = T.StructType([*self.order_type.fields, T.StructField("message", T.StringType())])
        self.tail = handle.getListState("tail", tail)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Each call of the state is a message to the JVM: a group that is new has no tail to ask for.
        seen, late = self.counts.get() or (0, 0)
        tail = [tuple(t) for t in self.tail.get()] if seen else []
        arrived = sorted((tuple(row[c] for c in self.names) for row in rows), key=lambda m: m[:-1])
        # In order, the late messages come first.
        n_late = bisect_right([m[:-1] for m in arrived], tail[-1][:-1]) if tail else 0
        offset = seen - len(tail)  # place of messages[0] in the group
        messages = tail + arrived[n_late:]
        first = -(-max(seen - self.length + 1, 0) // self.stride) * self.stride
        seen, late = offset + len(messages), late + n_late
        self.counts.update((seen, late))
        if len(arrived) > n_late:
            self.tail.put(messages[-max(self.length - 1, 1) :])
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        starts = range(first, seen - self.length + 1, self.stride)
        pieces = [starts[i : i + _PIECE] for i in range(0, len(starts), _PIECE)]
        too_late = arrived[:n_late]
        out = [(p[0], p[-1], messages[p[0] - offset : p[-1] - offset + self.length]) for p in pieces]
        out += [(None, None, too_late[i : i + _PIECE]) for i in range(0, n_late, _PIECE)]
        for one, last, held in out:
            yield self.piece(key[0], one, last, late, "[" + ",".join(m[-1] for m in held) + "]")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.counts.clear()
        self.tail.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Messages:
    """How the messages of a stream travel: their order, and their values as JSON."""

    def __init__(self, messages: DataFrame, order: Sequence[str], columns: Sequence[str]):
        self.order, self.columns = list(order), list(columns)
        self.kept = list(dict.fromkeys([*order, *columns]))
        self.kinds = {c: messages.schema[c].dataType for c in self.kept}
        self.times = [c for c in self.kept if isinstance(self.kinds[c], _TIMES)]
        # Points in time are kept as microseconds, which JSON and state hold exactly.
        fields = [T.StructField(c, T.LongType() if c in self.times else self.kinds[c]) for c in self.kept]
        self.json = T.ArrayType(T.StructType(fields))

    def plain(self, name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp")) if name in self.times else F.col(name)

    def restored(self, name: str, value: Column) -> Column:
        return F.timestamp_micros(value).cast(self.kinds[name]) if name in self.times else value

    def order_columns(self) -> list[Column]:
        """Comparable values; a missing one comes first."""
        out = []
        for i, c in enumerate(self.order):
            whole = c in self.times or isinstance(self.kinds[c], T.IntegralType)
            value = self.plain(c).cast("bigint") if whole else F.col(c)
            least = F.lit(_LEAST) if whole else F.lit("" if isinstance(self.kinds[c], T.StringType) else float("-inf"))
            out.append(F.coalesce(value, least).alias(f"o{i}"))
        return out

    def message(self) -> Column:
        return F.to_json(F.struct(*[self.plain(c).alias(c) for c in self.kept])).alias("message")


def stream_pieces(
    messages: DataFrame,
    group: str,
    order: Sequence[str],
    columns: Sequence[str],
    length: int = WINDOW_LENGTH,
    step: int = WINDOW_STEP,
    idle: int | None = None,
) -> DataFrame:
    """What the state hands on: pieces of messages to cut windows from, and late messages.

    :func:`cut_windows` and :func:`late_rows` read it. ``idle`` is the time in
    milliseconds after which the state of a group without messages ends, in the
    next micro-batch with messages; a group that comes back then starts anew, at
    ``window_start`` 0. Sets the session's state store to the one that has list
    states and timers and, with ``idle``, turns off micro-batches without data,
    of which a run to the end of what is available would never see the last.
    """
    if length < 1 or step < 1:
        raise ValueError("length and step must be at least 1")
    conf = messages.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    if idle is not None:
        conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    travel = _Messages(messages, order, columns)
    plain = messages.filter(F.col(group).isNotNull()).select(
        F.col(group).alias("_group"), *travel.order_columns(), travel.message()
    )
    order_type = T.StructType([f for f in plain.schema if f.name not in ("_group", "message")])
    out = T.StructType(
        [
            T.StructField(group, messages.schema[group].dataType),
            T.StructField("_first", T.LongType()),
            T.StructField("_last", T.LongType()),
            T.StructField("late_messages", T.LongType()),
            T.StructField("_messages", T.StringType()),
        ]
    )
    cutter = _Cutter(group, order_type, length, min(step, length), idle)
    # Rows, not pandas: groups are many and small, and each frame costs more than its messages.
    return plain.groupBy("_group").transformWithState(
        cutter, out, "append", "none" if idle is None else "processingTime"
    )


def cut_windows(
    pieces: DataFrame,
    messages: DataFrame,
    group: str,
    order: Sequence[str],
    columns: Sequence[str],
    length: int = WINDOW_LENGTH,
    step: int = WINDOW_STEP,
) -> DataFrame:
    """The full windows of :func:`stream_pieces`, cut by all tasks."""
    travel = _Messages(messages, order, columns)
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where("_first IS NOT NULL").repartition(tasks, group, "_first")
    span = (F.col("_last") - F.col("_first")).cast("int")
    cut = dealt.withColumn("_list", F.from_json("_messages", travel.json)).withColumn(
        "_place", F.explode(F.sequence(F.lit(0), span, F.lit(min(step, length))))
    )

    def column(c: str) -> Column:
        values = F.slice(F.col(f"_list.{c}"), F.col("_place") + 1, length)
        return (F.transform(values, lambda t: travel.restored(c, t)) if c in travel.times else values).alias(c)

    return cut.select(
        group,
        (F.col("_first") + F.col("_place")).alias("window_start"),
        F.lit(length).alias("n_messages"),
        "late_messages",
        *[column(c) for c in columns],
    )


def late_rows(pieces: DataFrame, messages: DataFrame, group: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The late messages of :func:`stream_pieces`: the group and all columns that were given."""
    travel = _Messages(messages, order, columns)
    late = pieces.where("_first IS NULL").select(group, F.explode(F.from_json("_messages", travel.json)).alias("_m"))
    return late.select(group, *[travel.restored(c, F.col(f"_m.{c}")).alias(c) for c in travel.kept if c != group])


def stream_windows(
    messages: DataFrame,
    group: str,
    order: Sequence[str],
    columns: Sequence[str],
    length: int = WINDOW_LENGTH,
    step: int = WINDOW_STEP,
    idle: int | None = None,
) -> DataFrame:
    """Full windows of a streaming log.

    Messages are put in order inside a micro-batch. A message that sorts before
    one its group has already seen is left out and counted: ``late_messages``
    is the group's count so far. :func:`write_windows` reports the messages too.
    """
    pieces = stream_pieces(messages, group, order, columns, length, step, idle)
    return cut_windows(pieces, messages, group, order, columns, length, step)


def write_windows(
    messages: DataFrame,
    group: str,
    order: Sequence[str],
    columns: Sequence[str],
    windows_path: str,
    late_path: str,
    checkpoint: str,
    length: int = WINDOW_LENGTH,
    step: int = WINDOW_STEP,
    idle: int | None = None,
) -> StreamingQuery:
    """Writes two tables from one state: the windows and the messages that came too late.

    Both are folders of micro-batches (column ``batch_id``); a batch that is
    run again replaces its own rows.
    """
    pieces = stream_pieces(messages, group, order, columns, length, step, idle)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        write_batch(cut_windows(held, messages, group, order, columns, length, step), windows_path, batch_id)
        write_batch(late_rows(held, messages, group, order, columns), late_path, batch_id)
        held.unpersist()

    return start_batches(pieces, write, checkpoint)
