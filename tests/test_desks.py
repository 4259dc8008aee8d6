"""Appointments and messages: streams that arrive out of order, replays, and timers equal the fold over sorted rows."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F


from millrace.streaming import desks
from millrace.streaming.ingest import event_stream, written_to_end

H = desks.HOUR


def fold(fold_, rows, until=None):
    state = dict(fold_.start)
    for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
        fold_.rows(state, [r], None)
    return fold_.rows(state, [], until)


def test_legal_transitions():
    row = lambda at, event, due=None, seq=0: {"at": at * H, "seq": seq, "event": event, "due": None if due is None else due * H}
    run = lambda *rows, until=None: fold(desks.APPOINTMENTS, rows, None if until is None else until * H)
    assert run()["status"] == "none" and run(row(1, "confirm"), row(2, "visit"), row(3, None))["refused"] == 2
    assert run(row(1, "propose", 5), row(2, "confirm"), row(4, "visit"))["status"] == "visited"
    s = run(row(1, "propose", 5), row(2, "confirm"), row(8, "visit"))
    assert (s["status"], s["missed"], s["refused"]) == ("no_show", 1, 1)  # came after it had lapsed
    assert run(row(1, "propose", 5), row(2, "confirm"), until=6)["status"] == "confirmed" and run(row(1, "propose", 5), row(2, "confirm"), until=7)["status"] == "no_show"
    assert run(row(1, "propose", 5), row(2, "confirm"), row(3, "propose", 9), until=20)["status"] == "proposed"  # a new time has to be confirmed again
    assert run(row(1, "propose", 5), row(2, "cancel"), row(3, "confirm"), row(4, "propose", 9))["proposals"] == 2


def test_messages_fold():
    row = lambda at, digest, seq=0, **k: {"at": at * desks.SECOND, "seq": seq, "digest": digest, "place": None, "colour": None, "item": None, "stage": None, "strength": 0.0, "negative": False, **k}
    s = fold(desks.MESSAGES, [row(0, "a", place="x"), row(60, "a"), row(170, "a"), row(400, "a", colour="red", stage="s", strength=0.5), row(500, "b", stage="t", strength=0.4), row(600, "c", negative=True, place="y"), row(700, "d", place="z")])
    assert (s["messages"], s["repeats"], s["handed_off"], s["refused_at"]) == (4, 2, 1, 600 * desks.SECOND)
    assert (s["place"], s["colour"], s["stage"]) == ("y", "red", "s") and s["recent"].count(":") <= 2


def test_stream_out_of_order_equals_the_table(spark, tmp_path):
    rnd = random.Random(3)
    rows, t = [], 1_700_000_000_000_000
    for i in range(600):
        t += rnd.randrange(20 * 60) * desks.SECOND
        event = rnd.choice(["propose", "confirm", "confirm", "visit", "cancel", None])
        rows.append((rnd.randrange(12), t, i, event, t + rnd.randrange(30) * H))
    made = lambda own: spark.createDataFrame(own, "key long, at long, seq long, event string, due long").withColumn("ts", F.timestamp_micros("at"))
    until = (max(r[1] for r in rows) // 1000 - 3 * 3_600_000 + 1) * 1000 - 1  # what the watermark reaches: three hours less
    seen = [r for r in rows if r[1] // 1000 <= until // 1000]
    want = {r.key: (r.status, r.proposals, r.missed, r.refused) for r in desks.folded(made(seen), desks.APPOINTMENTS, until).collect()}
    by_hand = {k: fold(desks.APPOINTMENTS, [{"at": r[1], "seq": r[2], "event": r[3], "due": r[4]} for r in seen if r[0] == k], until) for k in {r[0] for r in seen}}
    assert want == {k: (s["status"], s["proposals"], s["missed"], s["refused"]) for k, s in by_hand.items()} and sum(v[2] for v in want.values()) > 5
    # arrives in files of forty rows, each row up to two hours late
    late = sorted(rows, key=lambda r: r[1] + rnd.randrange(2 * 3600) * desks.SECOND)
    for k in range(0, 600, 40):
        made(late[k : k + 40]).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    for run in range(2):  # and once more from the start
        stream = event_stream(spark, f"{tmp_path}/in/*", made(rows).schema, 2)
        changes = written_to_end(desks.folded_stream(stream, desks.APPOINTMENTS, "3 hours"), "update")
        got = {r.key: (r.status, r.proposals, r.missed, r.refused) for r in desks.last_state(changes, desks.APPOINTMENTS).collect()}
        assert got == want, run
    assert changes.select("batch").distinct().count() > 3


def test_fold_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, at long, seq long, event string, due long")
    assert desks.folded(empty, desks.APPOINTMENTS, None).count() == 0
    one = spark.createDataFrame([("a", 1, 1, None, None), (None, 1, 1, "propose", None)], empty.schema)
    assert sorted((str(r.key), r.status) for r in desks.folded(one, desks.APPOINTMENTS, 5).collect()) == [("None", "proposed"), ("a", "none")]


class Held:
    """A list state, value state or handle of one key, in memory."""

    def __init__(self):
        self.values, self.timers, self.calls = [], set(), 0

    def get(self):
        return list(self.values) if not self.values or isinstance(self.values[0], tuple) else tuple(self.values)

    def exists(self):
        return bool(self.values)

    def appendValue(self, value):  # noqa: N802
        self.values.append(value)
        self.calls += 1

    def appendList(self, values):  # noqa: N802
        self.values.extend(values)
        self.calls += len(values)

    def put(self, values):
        self.values = list(values)
        self.calls += len(values)

    def update(self, value):
        self.values = list(value)

    def clear(self):
        self.values = []

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_rows_that_wait_are_one_value():
    folder = desks.Folder(desks.APPOINTMENTS, ["at", "seq", "event", "due"])
    folder.handle, folder.state, folder.waiting = Held(), Held(), Held()
    frame = pd.DataFrame([(k * H, k, ["propose", "confirm", None][k % 3], (k + 1) * H) for k in range(1, 41)], columns=folder.names)
    assert list(folder.handleInputRows(("a",), iter([frame.iloc[20:], frame.iloc[:20]]), Mark(0))) == []
    assert folder.waiting.calls == 1 and folder.handle.timers == {H // 1000}
    out = list(folder.handleExpiredTimer(("a",), Mark(20 * H // 1000), None))[0].iloc[0]
    rows = [{"at": r.at_, "seq": r.seq, "event": r.event, "due": r.due} for r in frame.rename(columns={"at": "at_"}).itertuples()]
    want = fold(desks.APPOINTMENTS, rows[:20], 20 * H + 999)
    assert (out.status, out.due, out.proposals, out.missed, out.refused) == tuple(want.values()) and folder.waiting.calls == 2
    late = pd.DataFrame([(19 * H, 99, "propose", 30 * H), (50 * H, 100, "visit", 51 * H)], columns=folder.names)
    list(folder.handleInputRows(("a",), iter([late]), Mark(20 * H // 1000)))
    out = list(folder.handleExpiredTimer(("a",), Mark(60 * H // 1000), None))[0].iloc[0]
    assert folder.waiting.values == [] and out.proposals == sum(r["event"] == "propose" for r in rows) + 1


def test_calls_of_the_state_are_a_groups():
    """Keys dealt into a group share its timer and the calls of its state; each of them ends as its own fold does."""
    rnd = random.Random(7)
    rows = [{"key": rnd.choice([None, *range(2**53, 2**53 + 300)]), "at": rnd.randrange(1, 400) * H // 4, "seq": i, "event": rnd.choice(["propose", "confirm", "visit", "cancel", None]), "due": rnd.randrange(120) * H} for i in range(2_500)]
    folder = desks.GroupFolder(desks.APPOINTMENTS)
    folder.handle, folder.states, folder.waiting = Held(), Held(), Held()
    frames = lambda own: iter([pd.DataFrame({"at": [r["at"] for r in part], "row": [json.dumps(r) for r in part]}) for part in (own[:1_700], own[1_700:]) if part])
    assert list(folder.handleInputRows((0,), frames(rows[:2_400]), Mark(0))) == []
    assert folder.waiting.calls == 3 and folder.states.calls == 0 and folder.handle.timers == {min(r["at"] for r in rows[:2_400]) // 1000}
    got = {}

    def taken(out, mark):
        for frame in out:
            got.update({r["key"]: {k: r[k] for k in desks.APPOINTMENTS.start} for r in frame.to_dict("records")})
        folder.handle.timers = {t for t in folder.handle.timers if t > mark}  # Spark drops those that are past

    marks = [20 * H // 1000, 60 * H // 1000, 130 * H // 1000]
    taken(folder.handleExpiredTimer((0,), Mark(marks[0]), None), marks[0])
    assert folder.handle.timers and len(folder.waiting.values) <= 3 and len(folder.states.values) == 1
    late = [{**r, "at": 70 * H} for r in rows[2_400:2_450]] + [{**r, "at": 21 * H} for r in rows[2_450:]]
    taken(folder.handleInputRows((0,), frames(late), Mark(marks[1])), marks[1])  # some are due at once
    for mark in marks[1:]:
        taken(folder.handleExpiredTimer((0,), Mark(mark), None), mark)
    all_ = rows[:2_400] + late
    until = marks[-1] * 1000 + 999
    want = {k: fold(desks.APPOINTMENTS, [r for r in all_ if r["key"] == k], until) for k in {r["key"] for r in all_}}
    assert got == want and folder.waiting.values == [] and folder.handle.timers == set() and sum(s["missed"] for s in want.values()) > 50


def test_groups_don_t_change_the_stream(spark, tmp_path):
    rnd = random.Random(11)
    rows, t = [], 1_700_000_000_000_000
    for i in range(200):
        t += rnd.randrange(40) * desks.SECOND
        rows.append((rnd.choice([None, "a", "b", 'c"\\é', ""]), t, i, rnd.choice("uvw"), rnd.choice([None, "x", "y"]), None, None, rnd.choice([None, "s"]), rnd.choice([0.88, 1.0, 0.1]), rnd.random() < 0.01))
    schema = "key string, at long, seq long, digest string, place string, colour string, item string, stage string, strength double, negative boolean"
    made = lambda own: spark.createDataFrame(own, schema).withColumn("ts", F.timestamp_micros("at"))
    for k in range(0, 200, 50):
        made(rows[k : k + 50]).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    names = ["key", "at", "seq", *(c.split()[0] for c in desks.MESSAGES.columns.split(", "))]
    own = [dict(zip(names, r, strict=True)) for r in rows]
    want = {k: fold(desks.MESSAGES, [r for r in own if r["key"] == k]) for k in {r["key"] for r in own}}
    for groups in (2, None):
        stream = event_stream(spark, f"{tmp_path}/in/*", made(rows).schema, 2)
        last = desks.last_state(written_to_end(desks.folded_stream(stream, desks.MESSAGES, "0 seconds", groups), "update"), desks.MESSAGES)
        assert {r.key: {k: r[k] for k in desks.MESSAGES.start} for r in last.collect()} == want, groups


def test_a_table_of_many_files_is_read_whole(spark, tmp_path):
    """Rows of a file that is read late aren't late: no order of files drops any."""
    source = "/root/testdata/sf0.001"
    for t in ("customer", "lineitem", "nation", "part"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{source}/{t}.parquet")
    spark.read.parquet(f"{source}/orders.parquet").repartitionByRange(220, F.desc("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    assert len(list((tmp_path / "orders.parquet").glob("*.parquet"))) > 200
    want, got = (sorted(map(tuple, desks.inbound_messages(spark, str(d)).collect())) for d in (source, tmp_path))
    assert got == want
