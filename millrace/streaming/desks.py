"""Appointments and inbound messages as keyed state, on streams and on tables.

Each key is folded in the order of event time, whatever the order of arrival: rows wait in the state until the watermark
has passed them, a timer wakes the key up then, and what falls due in between - a visit that nobody came to - happens
at its time. The same fold over sorted rows gives the batch result, in constant memory for each key.
"""

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.catalog import Catalog
from millrace.io import load
from millrace.operators import signals
from millrace.streaming.ingest import event_stream, events_of, written_to_end

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, SECOND = 3_600_000_000, 1_000_000
#: Groups that the keys of a stream are dealt into, and rows or states in one value of a group's state.
GROUPS, CHUNK = 4_096, 1_000

# What may follow what. An event that isn't listed for a state is refused and changes nothing.
LEGAL: dict[tuple[str, str], str] = {
    ("none", "propose"): "proposed", ("cancelled", "propose"): "proposed", ("visited", "propose"): "proposed", ("no_show", "propose"): "proposed",
    ("proposed", "propose"): "proposed", ("proposed", "confirm"): "confirmed", ("proposed", "visit"): "visited", ("proposed", "cancel"): "cancelled",
    ("confirmed", "propose"): "proposed", ("confirmed", "confirm"): "confirmed", ("confirmed", "visit"): "visited", ("confirmed", "cancel"): "cancelled", ("confirmed", "lapse"): "no_show",
}
#: Time after which a confirmed visit counts as missed.
GRACE = 2 * HOUR


@dataclass
class Fold:
    """A key's state as a flat dict, and how a row and the passing of time change it. Times are microseconds.

    columns: of a row, after `at` and `seq`; state: DDL of the state; start: its first value.
    """

    columns: str
    state: str
    start: dict[str, Any]
    step: Callable[[dict, dict], None]
    lapse: Callable[[dict, int], None] = field(default=lambda state, until: None)
    due: Callable[[dict], int | None] = field(default=lambda state: None)

    def rows(self, state: dict, rows: list[dict], until: int | None) -> dict:
        """The state after rows, which are in order, and after the time until, if there is one."""
        for r in rows:
            self.lapse(state, r["at"])
            self.step(state, r)
        if until is not None:
            self.lapse(state, until)
        return state


def moved(state: dict, event: str) -> bool:
    new = LEGAL.get((state["status"], event))
    if new:
        state["status"] = new
    return bool(new)


def appointment_step(state: dict, row: dict) -> None:
    if row["event"] is None:
        return
    if not moved(state, row["event"]):
        state["refused"] += 1
    elif row["event"] == "propose":
        state["proposals"] += 1
        state["due"] = row["due"]


def appointment_lapse(state: dict, until: int) -> None:
    if state["status"] == "confirmed" and state["due"] is not None and state["due"] + GRACE <= until:
        moved(state, "lapse")
        state["missed"] += 1


APPOINTMENTS = Fold(
    "event string, due long", "status string, due long, proposals long, missed long, refused long",
    {"status": "none", "due": None, "proposals": 0, "missed": 0, "refused": 0}, appointment_step, appointment_lapse,
    lambda s: s["due"] + GRACE if s["status"] == "confirmed" and s["due"] is not None else None,
)

#: The same words from the same writer within this time are one message.
REPEAT = 120 * SECOND


def message_step(state: dict, row: dict) -> None:
    recent = [x for x in (state["recent"] or "").split(" ") if x and int(x.split(":")[1]) >= row["at"] - REPEAT]
    repeated = any(x.split(":")[0] == row["digest"] for x in recent)
    state["recent"] = " ".join([*(x for x in recent if x.split(":")[0] != row["digest"]), f"{row['digest']}:{row['at']}"])
    if repeated:
        state["repeats"] += 1
        return
    if state["refused_at"] is not None:  # who refused and writes again is for a human
        state["handed_off"] += 1
        return
    state["messages"] += 1
    for slot in ("place", "colour", "item"):
        if row[slot] is not None:
            state[slot] = row[slot]
    if row["stage"] is not None and row["strength"] >= state["strength"]:
        state["stage"], state["strength"] = row["stage"], row["strength"]
    if row["negative"]:
        state["refused_at"] = row["at"]


MESSAGES = Fold(
    "digest string, place string, colour string, item string, stage string, strength double, negative boolean",
    "messages long, repeats long, handed_off long, refused_at long, place string, colour string, item string, stage string, strength double, recent string",
    {"messages": 0, "repeats": 0, "handed_off": 0, "refused_at": None, "place": None, "colour": None, "item": None, "stage": None, "strength": 0.0, "recent": ""}, message_step,
)


def plain(x: Any) -> Any:
    """A value of a frame as a Python value."""
    return None if x is None or x is pd.NaT or isinstance(x, float) and x != x else x.item() if hasattr(x, "item") else x


def plain_rows(frame: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    """Rows of a frame as tuples of Python values, read column by column."""
    return zip(*([plain(x) for x in frame[c].tolist()] for c in names), strict=True)


def records(frame: pd.DataFrame) -> list[dict]:
    names = list(frame.columns)
    return [dict(zip(names, r, strict=True)) for r in plain_rows(frame, names)]


class Folder(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then folds them in order."""

    def __init__(self, fold: Fold, names: list[str]):
        self.fold, self.names = fold, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.state)
        self.waiting = handle.getListState("waiting", "rows string")  # a value for the rows of a micro-batch, as each value costs a call

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [row for frame in rows for row in plain_rows(frame, self.names)]
        mark = timerValues.getCurrentWatermarkInMs()
        if new and min(r[0] for r in new) // 1000 > mark:
            # none is due: they wait, and what is due without them has a timer of its own
            self.waiting.appendValue((json.dumps(new),))
            wakes = [t for t in self.handle.listTimers() if t > mark]
            first = min(r[0] for r in new) // 1000
            if not wakes or first < min(wakes):
                for t in wakes:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(first)
            return
        yield from self.worked_off(key, timerValues, new)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.worked_off(key, timerValues)

    def worked_off(self, key: Any, timers: Any, new: Sequence[tuple] = ()) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs()
        waiting = sorted((dict(zip(self.names, r, strict=True)) for r in (*(r for own in self.waiting.get() for r in json.loads(own[0])), *new)), key=lambda r: (r["at"], r["seq"]))
        ripe = [r for r in waiting if r["at"] // 1000 <= mark]
        names = [c.split()[0] for c in self.fold.state.split(", ")]
        state = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict(self.fold.start)
        before = dict(state)
        state = self.fold.rows(state, ripe, (mark + 1) * 1000 - 1 if mark > 0 else None)
        if ripe or new:
            left = [tuple(r[c] for c in self.names) for r in waiting[len(ripe) :]]
            if left:
                self.waiting.put([(json.dumps(left),)])
            else:
                self.waiting.clear()
        due = [waiting[len(ripe)]["at"] // 1000] if len(waiting) > len(ripe) else []
        if (lapses := self.fold.due(state)) is not None:
            due.append(lapses // 1000)
        for t in [t for t in self.handle.listTimers() if t > mark]:
            self.handle.deleteTimer(t)
        if due:
            self.handle.registerTimer(max(min(due), mark + 1))
        if state != before or ripe:
            self.state.update(tuple(state[n] for n in names))
            yield pd.DataFrame([{"key": key[0], **state}]).astype(object)

    def close(self) -> None:
        pass


class GroupFolder(StatefulProcessor):
    """The same for keys that are dealt into groups. A group's rows and states are values of its own state, so that calls of
    the state, which cost far more than a row's fold, grow with the groups that a micro-batch meets and not with its keys.

    Rows come as JSON, as they wait.
    """

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getListState("states", "states string")  # of up to CHUNK keys each
        self.waiting = handle.getListState("waiting", "rows string")  # up to CHUNK rows each

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            for texts in chunks(frame["row"].tolist()):
                self.waiting.appendValue((f"[{','.join(texts)}]",))
            least = int(frame["at"].min()) // 1000
            first = least if first is None else min(first, least)
        if first is not None and first <= mark:
            yield from self.worked_off(timerValues)
        elif first is not None:
            self.wake(first, mark, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.worked_off(timerValues)

    def wake(self, at: int | None, mark: int, replace: bool) -> None:
        """One timer to come: the earliest, or the new one if it replaces what was set."""
        wakes = [t for t in self.handle.listTimers() if t > mark]
        if not replace and wakes and min(wakes) <= at:
            return
        for t in wakes:
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(max(at, mark + 1))

    def worked_off(self, timers: Any) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs()
        until = (mark + 1) * 1000 - 1 if mark > 0 else None
        ripe: dict[Any, list[dict]] = {}
        left = []
        for (texts,) in self.waiting.get():
            for r in json.loads(texts):
                if r["at"] // 1000 <= mark:
                    ripe.setdefault(r.pop("key"), []).append(r)
                else:
                    left.append(r)
        states = {key: state for (own,) in self.states.get() for key, state in json.loads(own)}
        changed = []
        for key in dict.fromkeys([*states, *ripe]):
            state = dict(states.get(key) or self.fold.start)
            own = sorted(ripe.get(key, ()), key=lambda r: (r["at"], r["seq"]))
            state = self.fold.rows(state, own, until)
            if own or state != states[key]:
                states[key] = state
                changed.append({"key": key, **state})
        if ripe:
            self.kept(self.waiting, left)
        if changed:
            self.kept(self.states, list(states.items()))
        due = [x // 1000 for x in (*(r["at"] for r in left), *map(self.fold.due, states.values())) if x is not None]
        self.wake(min(due, default=None), mark, True)
        if changed:
            yield pd.DataFrame(changed, dtype=object)  # whole numbers beside null stay whole

    @staticmethod
    def kept(state: Any, values: list) -> None:
        if values:
            state.put([(json.dumps(own),) for own in chunks(values)])
        else:
            state.clear()

    def close(self) -> None:
        pass


def chunks(values: list) -> Iterator[list]:
    return (values[i : i + CHUNK] for i in range(0, len(values), CHUNK))


def folded_stream(rows: DataFrame, fold: Fold, delay: str = "1 hour", groups: int | None = GROUPS) -> DataFrame:
    """Streaming: key and its state, each time it changes. rows: key, ts, at (ts in microseconds), seq and the fold's columns.

    Keys are numbers or strings and share the state of one of so many groups. None gives each key a state of its own, for
    micro-batches that meet few of very many keys.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    names = ["at", "seq", *(c.split()[0] for c in fold.columns.split(", "))]
    out = StructType.fromDDL(f"key {rows.schema['key'].dataType.simpleString()}, {fold.state}")
    marked = rows.withWatermark("ts", delay)
    if groups is None:
        return marked.groupBy("key").transformWithStateInPandas(Folder(fold, names), out, "Update", "EventTime")
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) if rows.schema[c].dataType.simpleString() in ("double", "float") else F.col(c) for c in ("key", *names)]
    row = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    dealt = marked.select(F.pmod(F.hash("key"), F.lit(groups)).alias("group"), "ts", "at", row.alias("row"))
    return dealt.groupBy("group").transformWithStateInPandas(GroupFolder(fold), out, "Update", "EventTime")


def folded(rows: DataFrame, fold: Fold, until: int | None) -> DataFrame:
    """On a table: key and its state at the time `until`. Rows of a key are read in order, one after the other."""
    names = ["at", "seq", *(c.split()[0] for c in fold.columns.split(", "))]
    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.select("key", *names).repartition("key").sortWithinPartitions("key", "at", "seq")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        out: list[dict] = []
        for frame in frames:
            for r in records(frame):
                if state is None or r["key"] != key:
                    if state is not None:
                        out.append({"key": key, **fold.rows(state, [], until)})
                    key, state = r["key"], dict(fold.start)
                fold.rows(state, [r], None)
            if len(out) > 5_000:
                yield pd.DataFrame(out).astype(object)
                out = []
        if state is not None:
            out.append({"key": key, **fold.rows(state, [], until)})
        if out:
            yield pd.DataFrame(out).astype(object)

    return ordered.mapInPandas(work, f"key {kind}, {fold.state}")


def last_state(changes: DataFrame, fold: Fold) -> DataFrame:
    """The state of each key after the last micro-batch that changed it."""
    names = [c.split()[0] for c in fold.state.split(", ")]
    return changes.groupBy("key").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("key", "s.*")


def micros(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def appointment_rows(events: DataFrame) -> DataFrame:
    """Events as steps of an appointment: a signup proposes a visit in as many hours as its value, a click confirms it."""
    kind = F.create_map(*(F.lit(x) for kv in (("signup", "propose"), ("click", "confirm"), ("purchase", "visit"), ("error", "cancel")) for x in kv))
    at = micros("ts")
    return events.select(F.col("user_id").alias("key"), F.col("ts"), at.alias("at"), F.col("event_id").alias("seq"), kind[F.col("event_type")].alias("event"), (at + F.floor(F.col("value") * 3600) * SECOND).alias("due"))


_APPOINTMENT_SQL = """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS moment, epoch_us(ts) + floor(value * 3600)::BIGINT * 1000000 AS due, CASE event_type WHEN 'signup' THEN 'propose' WHEN 'click' THEN 'confirm' WHEN 'purchase' THEN 'visit' WHEN 'error' THEN 'cancel' END AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, 'none' AS status, NULL::BIGINT AS due, 0::BIGINT AS proposals, 0::BIGINT AS missed, 0::BIGINT AS refused FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT user_id, i, CASE WHEN event IS NULL THEN was WHEN event = 'propose' THEN 'proposed' WHEN was IN ('proposed', 'confirmed') THEN CASE event WHEN 'confirm' THEN 'confirmed' WHEN 'visit' THEN 'visited' ELSE 'cancelled' END ELSE was END,
    CASE WHEN event = 'propose' THEN new_due ELSE due END, proposals + coalesce((event = 'propose')::INT, 0), missed, refused + CASE WHEN event IS NOT NULL AND event <> 'propose' AND was NOT IN ('proposed', 'confirmed') THEN 1 ELSE 0 END
  FROM (SELECT s.user_id, e.i, e.event, e.due AS new_due, s.due, s.proposals, s.refused, s.missed + lapsed::INT AS missed, CASE WHEN lapsed THEN 'no_show' ELSE s.status END AS was
        FROM (SELECT s.*, e2.moment AS m2 FROM s JOIN e e2 ON e2.user_id = s.user_id AND e2.i = s.i + 1) s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1, LATERAL (SELECT coalesce(s.status = 'confirmed' AND s.due + 7200000000 <= s.m2, false) AS lapsed))),
z AS (SELECT user_id, arg_max(status, i) AS status, arg_max(coalesce(due, -1), i) AS due, max(proposals) AS proposals, max(missed) AS missed, max(refused) AS refused FROM s GROUP BY user_id), t AS (SELECT (max(epoch_ms(ts)) + 1) * 1000 - 1 AS m FROM events)
SELECT user_id, CASE WHEN status = 'confirmed' AND due + 7200000000 <= m THEN 'no_show' ELSE status END AS state, proposals, missed + (status = 'confirmed' AND due + 7200000000 <= m)::INT AS missed, refused FROM z, t"""


@catalog.query("appointment_states", _APPOINTMENT_SQL)
def appointment_states(spark: SparkSession, d: str) -> DataFrame:
    """Appointments of all users as a stream of events leaves them, missed visits by timers."""
    changes = written_to_end(folded_stream(appointment_rows(events_of(spark, d)), APPOINTMENTS, "0 seconds"), "update")
    return last_state(changes, APPOINTMENTS).select(F.col("key").alias("user_id"), F.col("status").alias("state"), "proposals", "missed", "refused")


@catalog.query("appointments_of_table", _APPOINTMENT_SQL)
def appointments_of_table(spark: SparkSession, d: str) -> DataFrame:
    """The same by one pass over the sorted table."""
    rows = appointment_rows(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    last = rows.agg(F.max("at").alias("m")).first().m
    until = None if last is None else (last // 1000 + 1) * 1000 - 1
    return folded(rows, APPOINTMENTS, until).select(F.col("key").alias("user_id"), F.col("status").alias("state"), "proposals", "missed", "refused")


def message_rows(spark: SparkSession, d: str, orders: DataFrame) -> DataFrame:
    """Messages of customers, analysed, as rows of the fold."""
    told = signals.messages(spark, d, orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    rules = signals.rule_table(spark).unionByName(signals.entities(spark, d))
    found = signals.analyse(told.select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey", "text"), rules)
    last = F.element_at(F.col("items"), F.when(F.size("items") > 0, -1))
    return found.select(F.col("o_custkey").alias("key"), "ts", micros("ts").alias("at"), F.col("o_orderkey").alias("seq"), F.md5("text").alias("digest"), "place", "colour", last.alias("item"), "stage", "strength", "negative")


@catalog.query("inbound_messages", f"""
WITH {signals._MESSAGE_SQL}, f AS (SELECT m.o_orderkey, o_custkey, o_orderdate, {signals._STOCK} AS stock, {signals._PRICE} AS price, {signals._VISIT} AS visit, {signals._LOVE} AS love, {signals._OWN} AS own, pr = '1-URGENT' AS loan, pr = '2-HIGH' AS noloan, st = 'P' AND q < 5 AS stop, st = 'O' AS placed, pr = '3-MEDIUM' AS budget, r = 'N' AND s = 'F' AS jacket, colour, thing, n_name, m.o_totalprice AS total FROM m JOIN orders USING (o_orderkey)),
g AS (SELECT *, CASE WHEN visit THEN 'purchase_imminent' WHEN stock THEN 'active_shopping' WHEN price AND placed THEN 'active_shopping' WHEN price OR loan THEN 'price_shopping' WHEN budget THEN 'research' WHEN love THEN 'awareness' END AS reached, stop OR own AS negative,
  row_number() OVER (PARTITION BY o_custkey, o_orderdate, stock, price, jacket, noloan, loan, placed, visit, stop, love, own, CASE WHEN budget THEN total END, CASE WHEN stock THEN colour END, CASE WHEN stock OR price OR love OR own THEN thing END ORDER BY o_orderkey) AS copy FROM f),
k AS (SELECT *, {{'d': o_orderdate, 'k': o_orderkey}} AS o, CASE WHEN NOT negative THEN reached END AS stage FROM g), u AS (SELECT * FROM k WHERE copy = 1),
x AS (SELECT o_custkey, min(o) AS stop FROM u WHERE negative GROUP BY o_custkey), v AS (SELECT u.*, x.stop IS NULL OR u.o <= x.stop AS heard, CASE stage WHEN 'price_shopping' THEN 0.88 WHEN 'research' THEN 0.2 WHEN 'awareness' THEN 0.1 WHEN NULL THEN 0 ELSE 1.0 END AS strength FROM u LEFT JOIN x USING (o_custkey))
SELECT o_custkey, count(*) FILTER (WHERE heard) AS messages, (SELECT count(*) FROM k WHERE k.o_custkey = v.o_custkey AND copy > 1) AS repeats, count(*) FILTER (WHERE NOT heard) AS handed_off, bool_or(negative AND heard) AS refused,
  coalesce(arg_max(n_name, o) FILTER (WHERE heard AND placed), '') AS place, coalesce(arg_max(colour, o) FILTER (WHERE heard AND stock), '') AS colour, coalesce(arg_max(thing, o) FILTER (WHERE heard AND (stock OR price OR love OR own)), '') AS item,
  coalesce(arg_max(stage, {{'s': strength, 'o': o}}) FILTER (WHERE heard AND stage IS NOT NULL), '') AS stage FROM v GROUP BY o_custkey""")
def inbound_messages(spark: SparkSession, d: str) -> DataFrame:
    """Threads of customers as a stream of their messages leaves them: repeats dropped, slots filled, refusals kept."""
    schema = load(spark, d, "orders").schema
    stream = event_stream(spark, f"{d}/order[s].parquet", schema, None)
    changes = written_to_end(folded_stream(message_rows(spark, d, stream), MESSAGES, "0 seconds"), "update")
    s = last_state(changes, MESSAGES)
    return s.select(F.col("key").alias("o_custkey"), "messages", "repeats", "handed_off", F.col("refused_at").isNotNull().alias("refused"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("place", "colour", "item", "stage")))
