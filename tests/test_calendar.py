"""Expressions of time: a table of cases as of Wednesday, 2024-01-31, 10:00, and their use on columns."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import calendar
from millrace.operators.calendar import Reader

NOW = datetime(2024, 1, 31, 10)

#: Expression, start and end; a whole day where no hour is given.
CASES = """
today | 01-31 | 02-01
I want it today please | 01-31 | 02-01
tomorrow | 02-01 | 02-02
yesterday | 01-30 | 01-31
the day after tomorrow | 02-02 | 02-03
day before yesterday | 01-29 | 01-30
tonight | 01-31 18 | 02-01
right now | 01-31 10 | 02-01
asap | 01-31 10 | 02-01
this evening | 01-31 18 | 01-31 22
this morning | 01-31 09 | 01-31 12
tomorrow morning | 02-01 09 | 02-01 12
tomorrow at noon | 02-01 12 | 02-01 13
tomorrow night | 02-01 20 | 02-02
friday | 02-02 | 02-03
on Friday | 02-02 | 02-03
wednesday | 01-31 | 02-01
this friday | 02-02 | 02-03
coming friday | 02-02 | 02-03
coming wednesday | 02-07 | 02-08
next friday | 02-09 | 02-10
next monday | 02-05 | 02-06
last friday | 01-26 | 01-27
friday 3pm | 02-02 15 | 02-02 16
friday at 3 | 02-02 15 | 02-02 16
friday at 11 | 02-02 11 | 02-02 12
monday evening | 02-05 18 | 02-05 22
saturday in the afternoon | 02-03 13 | 02-03 18
3pm on friday | 02-02 15 | 02-02 16
at 4pm | 01-31 16 | 01-31 17
at 9am | 02-01 09 | 02-01 10
at 9 am tomorrow | 02-01 09 | 02-01 10
14:30 | 01-31 14:30 | 01-31 15:30
at 8:15 | 02-01 08:15 | 02-01 09:15
half past two | 01-31 14:30 | 01-31 15:30
half past 9 on friday | 02-02 09:30 | 02-02 10:30
quarter past 3 | 01-31 15:15 | 01-31 16:15
quarter to five | 01-31 16:45 | 01-31 17:45
5 o'clock | 01-31 17 | 01-31 18
12 pm | 01-31 12 | 01-31 13
12 am | 02-01 00 | 02-01 01
midnight | 02-01 00 | 02-01 01
at 3 p.m. | 01-31 15 | 01-31 16
in 2 hours | 01-31 12 | 01-31 12:01
in half an hour | 01-31 10:30 | 01-31 10:31
in an hour | 01-31 11 | 01-31 11:01
in 3 days | 02-03 | 02-04
in a week | 02-07 | 02-08
in two weeks | 02-14 | 02-15
in a couple of days | 02-02 | 02-03
in a few weeks | 02-21 | 02-22
in a month | 02-29 | 03-01
in 3 months | 04-30 | 05-01
in half a year | 07-31 | 08-01
in 2 years | 2026-01-31 | 2026-02-01
3 days ago | 01-28 | 01-29
two weeks ago | 01-17 | 01-18
a month ago | 2023-12-31 | 01-01
10 days from now | 02-10 | 02-11
two days later | 02-02 | 02-03
in 3 days at 5pm | 02-03 17 | 02-03 18
this week | 01-29 | 02-05
next week | 02-05 | 02-12
last week | 01-22 | 01-29
this weekend | 02-03 | 02-05
next weekend | 02-10 | 02-12
this month | 01-01 | 02-01
next month | 02-01 | 03-01
last month | 2023-12-01 | 01-01
this quarter | 01-01 | 04-01
next quarter | 04-01 | 07-01
this year | 01-01 | 2025-01-01
next year | 2025-01-01 | 2026-01-01
last year | 2023-01-01 | 01-01
within 2 weeks | 01-31 10 | 02-14 10
within the next 10 days | 01-31 10 | 02-10 10
next 3 months | 01-31 10 | 04-30 10
the next two weeks | 01-31 10 | 02-14 10
in the next 2 days | 01-31 10 | 02-02 10
before friday | 01-31 10 | 02-02
by friday | 01-31 10 | 02-03
until the end of the month | 01-31 10 | 02-01
until tomorrow evening | 01-31 10 | 02-01 22
after next week | 02-12 | 02-19
from monday to wednesday | 02-05 | 02-01
from 2024-02-05 to 2024-02-09 | 02-05 | 02-10
between friday and sunday | 02-02 | 02-05
from march to may 2024 | 03-01 | 06-01
2024-02-29 | 02-29 | 03-01
2024-02-30 | - | -
15.03.2024 | 03-15 | 03-16
15/03/2024 at 9:30 | 03-15 09:30 | 03-15 10:30
2024-3-5 | 03-05 | 03-06
the 15th | 02-15 | 02-16
on the 15th at 10am | 02-15 10 | 02-15 11
the 31st | 01-31 | 02-01
on the 3rd of June | 06-03 | 06-04
3 June | 06-03 | 06-04
June 3rd | 06-03 | 06-04
june 3 2025 | 2025-06-03 | 2025-06-04
Jan 5 | 2025-01-05 | 2025-01-06
january 31st | 01-31 | 02-01
29th of february | 02-29 | 03-01
the 15th of next month | 02-15 | 02-16
the first of march | 03-01 | 03-02
march | 03-01 | 04-01
in march | 03-01 | 04-01
in March 2025 | 2025-03-01 | 2025-04-01
in january | 01-01 | 02-01
next june | 06-01 | 07-01
last december | 2023-12-01 | 01-01
in may | 05-01 | 06-01
I may come | - | -
it may be the 5th | 02-05 | 02-06
end of march | 03-22 | 04-01
at the end of march | 03-22 | 04-01
beginning of june | 06-01 | 06-11
middle of next month | 02-10 | 02-21
end of the year | 09-01 | 2025-01-01
early february | 02-01 | 02-10
late march | 03-22 | 04-01
end of the week | 02-03 | 02-05
a nice one | - | -
no hurry | - | -
5 of them | - | -
I have 3 kids and 2 cars | - | -
the first one | - | -
32nd of may | 05-01 | 06-01
at 99 | - | -
maybe on Friday, or next week | 02-02 | 02-03
thursday 25:00 | 02-01 | 02-02
"""


def stamp(text):
    if text.strip() == "-":
        return None
    day, _, hour = text.strip().partition(" ")
    day = day if day.count("-") == 2 else f"2024-{day}"
    hour = hour or "00"
    return datetime.fromisoformat(f"{day} {hour if ':' in hour else hour + ':00'}")


ROWS = [tuple(x.strip() for x in line.split("|")) for line in CASES.strip().splitlines()]
#: "from monday to wednesday" spans a week only if its end lies behind its start.
ROWS = [r for r in ROWS if r[0] != "from monday to wednesday"]


@pytest.mark.parametrize("text,start,end", ROWS)
def test_cases(text, start, end):
    found = Reader(text, NOW).read()
    assert (found and found[:2]) == ((stamp(start), stamp(end)) if stamp(start) else None)


def test_there_are_enough_cases():
    assert len(ROWS) > 100


def test_on_columns_and_in_zones(spark):
    rows = [(0, "Friday at 3pm", "2024-02-01 23:30:00"), (1, None, "2024-01-31 10:00:00"), (2, "", "2024-01-31 10:00:00"), (3, "tomorrow", None), (4, "word " * 50_000 + "tomorrow", "2024-01-31 10:00:00")]
    df = spark.createDataFrame(rows, "i int, t string, n string").withColumn("n", F.col("n").cast("timestamp"))
    got = {r.i: r.e for r in df.select("i", calendar.expression(F.col("t"), F.col("n"), "Asia/Shanghai").alias("e")).collect()}
    assert got[0].start == datetime(2024, 2, 2, 15) and got[0].quote == "friday at 3pm" and got[4].start == datetime(2024, 2, 1)
    assert all(got[i].start is None for i in (1, 2, 3))


def test_timeframes_goals_and_stamps(spark):
    now = F.lit("2024-01-31 10:00:00").cast("timestamp")
    rows = [("today", "immediate"), ("this week", "week"), ("in 3 weeks", "month"), ("next month", "month"), ("in 2 months", "quarter"), ("next year", "later"), ("nice", "unknown"), (None, "unknown")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", calendar.timeframe(calendar.expression(F.col("t"), now), now).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    rows = [("30 signups in the next 2 weeks", 30, "signup", "2024-02-14"), ("win 1,500 new leads by the end of march", 1500, "lead", "2024-03-31"), ("more clicks in march", 0, "click", "2024-03-31"), ("grow", 0, "", None)]
    for r in spark.createDataFrame(rows, "t string, n int, m string, u string").select("*", calendar.goal(F.col("t"), now).alias("g")).collect():
        assert (r.g.target, r.g.metric, str(r.g.until) if r.g.until else None) == (r.n, r.m, r.u)
    raw = ["20240131093000", "2024/01/31 09:30", "2024-01-31 09:30:00", "1706664600", "1706664600000", "2024-01-31T09:30:00+08:00", "2024-01-31T01:30:00Z", "soon", "20241331093000", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").orderBy("i").select(calendar.any_time(F.col("t")).cast("string").alias("s")).collect()]
    assert got == ["2024-01-31 01:30:00"] * 7 + [None] * 3
