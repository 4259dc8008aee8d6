"""Expressions of time in texts: a small grammar over words, evaluated against a time and its zone.

    moment  := range | edge? day (at? clock)? | clock
    range   := from moment (to | until) moment | before moment | by moment | until moment | after moment | within span | next span
    day     := today | tomorrow | yesterday | day after tomorrow | day before yesterday | (this | next | last | coming)? weekday
             | (this | next | last) unit | in span | span (ago | from now) | date | the? ordinal (of? month)? | month ordinal? year?
    edge    := (end | beginning | middle) of
    span    := (number | a | an | a couple of | half a) unit
    clock   := hour (: minute)? (am | pm)? | noon | midnight | part of the day | half past hour | quarter (past | to) hour

A week begins on Monday. What is found is a stretch of local time, [start, end), and the words that say it; of all
places in a text the first counts at which a rule holds, and there the longest.
"""

import re
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.io import load

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

# Names of the calendar.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
UNITS = ("minute", "hour", "day", "week", "weekend", "month", "quarter", "year")
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "couple": 2, "few": 3, "several": 3}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5}
PARTS = {"morning": (9, 12), "noon": (12, 13), "afternoon": (13, 18), "evening": (18, 22), "tonight": (18, 24), "night": (20, 24), "midnight": (0, 1)}
#: Words after which a month is one, though it could be another word.
LEADS = ("in", "of", "this", "next", "until", "by", "before", "early", "late", "from", "to", "after", "on")
NOW_WORDS = ("asap", "immediately", "now", "soonest")

TOKEN = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}:\d{2}|\d+|[a-z]+")

Found = tuple[int, datetime, datetime]  # tokens used, start, end


def add_months(d: date, n: int) -> date:
    """The same day n months on, or the last one of that month."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m + 1, min(d.day, last))


def at(d: date, hour: int = 0, minute: int = 0) -> datetime:
    return datetime(d.year, d.month, d.day) + timedelta(hours=hour, minutes=minute)


class Reader:
    """The grammar over the tokens of one text; each rule returns what it has read from token i on, or None."""

    def __init__(self, text: str, now: datetime):
        self.text = text.lower()
        self.spans = [(m.start(), m.end()) for m in TOKEN.finditer(self.text)]
        self.t = [self.text[a:b] for a, b in self.spans]
        self.now, self.today = now, now.date()

    def word(self, i: int) -> str:
        return self.t[i] if i < len(self.t) else ""

    def has(self, i: int, *words: str) -> bool:
        return self.t[i : i + len(words)] == list(words)

    def unit(self, i: int) -> str | None:
        w = self.word(i).removesuffix("s")
        return w if w in UNITS else None

    def name(self, i: int, names: tuple[str, ...]) -> int | None:
        """The number of a name or of its first three letters."""
        w = self.word(i)
        return next((k for k, n in enumerate(names) if w == n or w == n[:3] or len(w) > 3 and w == n[:4] and n[:4] == "sept"), None)

    def span(self, i: int) -> tuple[int, float, str] | None:
        """Tokens, number and unit."""
        start = i
        if self.has(i, "half", "a") or self.has(i, "half", "an"):
            u = self.unit(i + 2)
            return (3, 0.5, u) if u else None
        if self.word(i) == "a" and self.word(i + 1) in ("couple", "few"):
            i += 1
        w = self.word(i)
        n = int(w) if w.isdigit() and len(w) < 5 else NUMBERS.get(w)
        if n is None:
            return None
        i += 1
        if self.word(i) == "of" or self.word(i) == "more":
            i += 1
        u = self.unit(i)
        if u == "weekend":
            return None
        return (i + 1 - start, n, u) if u else None

    def moved(self, n: float, unit: str) -> datetime:
        """Now, n units on."""
        if unit in ("month", "quarter", "year"):
            months = n * {"month": 1, "quarter": 3, "year": 12}[unit]
            d = add_months(self.today, int(months)) + timedelta(days=round((months - int(months)) * 30))
            return datetime.combine(d, self.now.time())
        return self.now + n * {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(days=7)}[unit]

    def block(self, unit: str, k: int) -> tuple[datetime, datetime]:
        """The k-th unit from that of now on, whole."""
        if unit == "day":
            d = self.today + timedelta(days=k)
            return at(d), at(d + timedelta(days=1))
        if unit in ("week", "weekend"):
            monday = self.today - timedelta(days=self.today.weekday()) + timedelta(days=7 * k)
            return at(monday + timedelta(days=5 * (unit == "weekend"))), at(monday + timedelta(days=7))
        size = {"month": 1, "quarter": 3, "year": 12}[unit]
        first = date(self.today.year, (self.today.month - 1) // size * size + 1, 1)
        return at(add_months(first, k * size)), at(add_months(first, (k + 1) * size))

    def whole(self, d: date) -> tuple[datetime, datetime]:
        return at(d), at(d + timedelta(days=1))

    def in_month(self, day: int, month: int | None, year: int | None) -> date | None:
        """The day of a month; without a year, or a month, the next that is not past."""
        if month is None:
            for k in range(13):
                first = add_months(self.today.replace(day=1), k)
                if (d := self.dated(first.year, first.month, day)) and d >= self.today:
                    return d
            return None
        if year is not None:
            return self.dated(year, month, day)
        return next((d for y in range(self.today.year, self.today.year + 9) if (d := self.dated(y, month, day)) and d >= self.today), None)

    @staticmethod
    def dated(year: int, month: int, day: int) -> date | None:
        try:
            return date(year, month, day)
        except ValueError:
            return None

    def ordinal(self, i: int) -> tuple[int, int] | None:
        """Tokens and number of 15th, 3 rd, third."""
        w = self.word(i)
        if w in ORDINALS and (self.word(i + 1) == "of" or self.name(i + 1, MONTHS) is not None):
            return 1, ORDINALS[w]
        if w.isdigit() and 1 <= int(w) <= 31 and self.word(i + 1) in ("st", "nd", "rd", "th"):
            return 2, int(w)
        return None

    def year(self, i: int) -> tuple[int, int | None]:
        w = self.word(i)
        return (1, int(w)) if len(w) == 4 and w.isdigit() and 1900 <= int(w) <= 2199 else (0, None)

    # -------------------------------------------------------------------- rules

    def written(self, i: int) -> Found | None:
        w = self.word(i)
        if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", w):
            d = self.dated(*map(int, m.groups()))
        elif m := re.fullmatch(r"(\d{1,2})[./](\d{1,2})[./](\d{4})", w):
            d = self.dated(int(m[3]), int(m[2]), int(m[1]))
        else:
            return None
        return (1, *self.whole(d)) if d else None

    def month(self, i: int) -> Found | None:
        """June, June 3rd, June 2025, 3rd of June 2025, 3 June, the 3rd."""
        start, i = i, i + (self.word(i) == "the")
        o = self.ordinal(i)
        w = self.word(i)
        if not o and w.isdigit() and 1 <= int(w) <= 31 and self.name(i + 1, MONTHS) is not None:
            o = (1, int(w))
        if o:
            k = i + o[0] + (self.word(i + o[0]) == "of")
            m = self.name(k, MONTHS)
            if m is None:
                if self.word(k) in ("this", "next") and self.word(k + 1) == "month" and k > i + o[0]:
                    first = add_months(self.today.replace(day=1), self.word(k) == "next")
                    d = self.dated(first.year, first.month, o[1])
                    return (k + 2 - start, *self.whole(d)) if d else None
                d = self.in_month(o[1], None, None) if self.unit(i + o[0]) is None else None
                return (i + o[0] - start, *self.whole(d)) if d else None
            n, year = self.year(k + 1)
            d = self.in_month(o[1], m + 1, year)
            return (k + 1 + n - start, *self.whole(d)) if d else None
        m = self.name(i, MONTHS)
        if m is None:
            return None
        if self.word(i) in ("may", "mar") and self.word(i - 1) not in LEADS and not self.word(i + 1).isdigit():
            return None  # may be a verb, or a name
        if o := self.ordinal(i + 1) or ((1, int(self.word(i + 1))) if self.word(i + 1).isdigit() and 1 <= int(self.word(i + 1)) <= 31 and self.unit(i + 2) is None else None):
            n, year = self.year(i + 1 + o[0])
            d = self.in_month(o[1], m + 1, year)
            return (i + 1 + o[0] + n - start, *self.whole(d)) if d else None
        n, year = self.year(i + 1)
        if year is None:
            year = self.today.year + (m + 1 < self.today.month)
        first = date(year, m + 1, 1)
        return i + 1 + n - start, at(first), at(add_months(first, 1))

    def day(self, i: int) -> Found | None:
        w = self.word(i)
        for k, words in ((2, ("day", "after", "tomorrow")), (-2, ("day", "before", "yesterday"))):
            if self.has(i, *words):
                return 3, *self.whole(self.today + timedelta(days=k))
        if w in ("today", "tomorrow", "yesterday"):
            return 1, *self.whole(self.today + timedelta(days={"today": 0, "tomorrow": 1, "yesterday": -1}[w]))
        if w == "tonight":
            return 1, at(self.today, 18), at(self.today, 24)
        if w in NOW_WORDS or w == "right" and self.word(i + 1) == "now":
            return 1 + (w == "right"), self.now, at(self.today, 24)
        if w in ("this", "next", "last", "coming", "on"):
            k = {"next": 1, "last": -1}.get(w, 0)
            if w != "on" and (u := self.unit(i + 1)) and u not in ("minute", "hour"):
                if self.word(i + 1).endswith("s"):
                    return None
                return 2, *self.block(u, k)
            if w == "this" and self.word(i + 1) in PARTS:
                a, b = PARTS[self.word(i + 1)]
                return 2, at(self.today, a), at(self.today, b)
            if (n := self.name(i + 1, WEEKDAYS)) is not None:
                ahead = (n - self.today.weekday()) % 7
                monday = self.today - timedelta(days=self.today.weekday())
                d = monday + timedelta(days=7 * k + n) if w in ("next", "last") else self.today + timedelta(days=ahead if w != "coming" else ahead or 7)
                return 2, *self.whole(d)
            if w in ("this", "next", "last") and (m := self.name(i + 1, MONTHS)) is not None:
                year = self.today.year + (k == 1 and m + 1 <= self.today.month) + (k == 0 and m + 1 < self.today.month) - (k == -1 and m + 1 >= self.today.month)
                return 2, at(date(year, m + 1, 1)), at(add_months(date(year, m + 1, 1), 1))
            return None
        if (n := self.name(i, WEEKDAYS)) is not None and len(w) > 3:
            return 1, *self.whole(self.today + timedelta(days=(n - self.today.weekday()) % 7))
        if w == "in" and (s := self.span(i + 1)):
            return self.point(1 + s[0], s, 1)
        if s := self.span(i):
            if self.word(i + s[0]) == "ago":
                return self.point(s[0] + 1, s, -1)
            if self.has(i + s[0], "from", "now") or self.word(i + s[0]) == "later":
                return self.point(s[0] + (1 if self.word(i + s[0]) == "later" else 2), s, 1)
        return self.written(i) or self.month(i)

    def point(self, n: int, span: tuple[int, float, str], sign: int) -> Found:
        """A moment some time off: of the same minute, or the whole day for days and more."""
        moment = self.moved(sign * span[1], span[2])
        if span[2] in ("minute", "hour"):
            return n, moment, moment + timedelta(minutes=1)
        return n, *self.whole(moment.date())

    def clock(self, i: int) -> tuple[int, int, int, int] | None:
        """Tokens, start and end hour and minute of the day, in minutes: (tokens, start, end, 0)."""
        start, i = i, i + (self.word(i) in ("at", "around", "about"))
        asked = i > start
        if self.has(i, "in", "the"):
            i += 2
        w = self.word(i)
        if w in PARTS:
            a, b = PARTS[w]
            return i + 1 - start, a * 60, b * 60, 0
        shift, back = 0, False
        if self.has(i, "half", "past"):
            shift, i = 30, i + 2
        elif w == "quarter" and self.word(i + 1) in ("past", "to"):
            shift, back, i = 15, self.word(i + 1) == "to", i + 2
        w = self.word(i)
        if m := re.fullmatch(r"(\d{1,2}):(\d{2})", w):
            hour, minute = int(m[1]), int(m[2])
        elif w.isdigit() and len(w) < 3:
            hour, minute = int(w), 0
        elif shift and NUMBERS.get(w, 99) <= 12 and len(w) > 2:
            hour, minute = NUMBERS[w], 0
        else:
            return None
        i += 1
        half = self.word(i)
        if half in ("am", "pm"):
            if not 1 <= hour <= 12:
                return None
            hour, i = hour % 12 + 12 * (half == "pm"), i + 1
        elif half in ("a", "p") and self.word(i + 1) == "m":
            hour, i = hour % 12 + 12 * (half == "p"), i + 2
        elif self.has(i, "o", "clock"):
            hour, i = hour + 12 * (hour < 8), i + 2
        elif ":" not in w and not shift:
            if not asked or self.unit(i):
                return None
            hour += 12 * (hour < 8)  # visits are by day
        elif shift:
            hour += 12 * (hour < 8)
        minutes = hour * 60 + minute + (-shift if back else shift)
        return (i - start, minutes, minutes + 60, 0) if 0 <= minutes < 24 * 60 and minute < 60 else None

    def edged(self, i: int) -> Found | None:
        """A day or a longer stretch, or its end, beginning or middle."""
        k = i + (self.word(i) == "the")
        edge = self.word(k) if self.word(k) in ("end", "beginning", "start", "middle", "early", "late") else None
        if not edge:
            return self.day(i)
        k += 1 + (self.word(k + 1) == "of")
        if self.word(k) in ("the", "this") and (u := self.unit(k + 1)) and u not in ("minute", "hour"):
            found = (2, *self.block(u, 0))
        elif (u := self.unit(k)) and u not in ("minute", "hour"):
            found = (1, *self.block(u, 0))
        else:
            found = self.day(k)
        if not found:
            return None
        n, a, b = found
        third = timedelta(days=(b - a).days // 3) or (b - a) / 3
        a, b = (b - third, b) if edge in ("end", "late") else (a, a + third) if edge in ("beginning", "start", "early") else (a + third, b - third)
        return k - i + n, a, b

    def moment(self, i: int) -> Found | None:
        found = self.edged(i)
        if found and found[2] - found[1] <= timedelta(days=1):
            k = i + found[0]
            if clock := self.clock(k):
                base = at(found[1].date())
                return found[0] + clock[0], base + timedelta(minutes=clock[1]), base + timedelta(minutes=clock[2])
            return found
        if found:
            return found
        if clock := self.clock(i):  # a time, perhaps before its day
            k = i + clock[0]
            later = self.edged(k + (self.word(k) == "on" and self.name(k + 1, WEEKDAYS) is None))
            if later and later[2] - later[1] == timedelta(days=1):
                base, n = later[1], clock[0] + later[0] + (self.word(k) == "on" and self.name(k + 1, WEEKDAYS) is None)
            else:
                base, n = at(self.today), clock[0]
                if base + timedelta(minutes=clock[2]) <= self.now:
                    base += timedelta(days=1)
            return n, base + timedelta(minutes=clock[1]), base + timedelta(minutes=clock[2])
        return None

    def stretch(self, i: int) -> Found | None:
        w = self.word(i)
        if w in ("from", "between") and (a := self.moment(i + 1)):
            k = i + 1 + a[0]
            if self.word(k) in ("to", "until", "till", "through", "and") and (b := self.moment(k + 1)) and b[2] > a[1]:
                return k + 1 + b[0] - i, a[1], b[2]
        if w in ("before", "by", "until", "till") and (a := self.moment(i + 1)):
            end = a[1] if w == "before" else a[2]
            return 1 + a[0], self.now if self.now < end else a[1], end
        if w == "after" and (a := self.moment(i + 1)):
            return 1 + a[0], a[2], a[2] + timedelta(days=7)
        if w in ("within", "next", "coming") or w == "the" and self.word(i + 1) in ("next", "coming"):
            k = i + 1 + (w == "the") + (w == "within" and self.word(i + 1) in ("the", "next"))
            if s := self.span(k):
                return k + s[0] - i, self.now, self.moved(s[1], s[2])
        return self.moment(i)

    def read(self) -> tuple[datetime, datetime, str] | None:
        for i in range(len(self.t)):
            if found := self.stretch(i):
                a, b = self.spans[i][0], self.spans[i + found[0] - 1][1]
                return found[1], found[2], self.text[a:b]
        return None


STRETCH = "struct<start: timestamp_ntz, end: timestamp_ntz, quote: string>"


def expression(text: Column, now: Column, tz: str = "UTC") -> Column:
    """The first expression of time in each text: start and end as local times of tz, and its words; null if there is none.

    now: an instant. Only the sentence around a place is ever looked at twice, so time is linear in the text.
    """

    @F.pandas_udf("start timestamp_ntz, end timestamp_ntz, quote string")
    def read(texts: pd.Series, times: pd.Series) -> pd.DataFrame:
        out = [Reader(t, n.to_pydatetime()).read() if t and not pd.isna(n) else None for t, n in zip(texts, times, strict=True)]
        frame = pd.DataFrame([o or (None, None, None) for o in out], columns=["start", "end", "quote"])
        return frame.assign(start=pd.to_datetime(frame["start"]), end=pd.to_datetime(frame["end"]))

    return read(text, F.from_utc_timestamp(now, tz).cast("timestamp_ntz"))


def timeframe(found: Column, now: Column) -> Column:
    """How far off the end of a stretch of time is: immediate, week, month, quarter or later."""
    days = F.datediff(F.to_date(found["end"] - F.expr("interval 1 second")), F.to_date(now))
    return F.when(found["end"].isNull(), "unknown").when(days <= 1, "immediate").when(days <= 7, "week").when(days <= 31, "month").when(days <= 92, "quarter").otherwise("later")


def any_time(raw: Column, tz: str = "Asia/Shanghai") -> Column:
    """Fourteen digits, a date with slashes or dashes, or ISO 8601 with a zone; epoch seconds or milliseconds; else null."""
    local = lambda pattern, form: F.when(raw.rlike(pattern), F.to_utc_timestamp(F.try_to_timestamp(raw, F.lit(form)), tz))
    number = raw.try_cast("long")
    epoch = F.when(raw.rlike("^[0-9]{9,10}$"), F.timestamp_seconds(number)).when(raw.rlike("^[0-9]{12,13}$"), F.timestamp_millis(number))
    zoned = F.when(raw.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(raw))
    return F.coalesce(local("^[0-9]{14}$", "yyyyMMddHHmmss"), local("^[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}$", "yyyy/MM/dd HH:mm"), local("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm:ss"), zoned, epoch)


METRICS = ("signup", "purchase", "click", "lead", "visit", "order")


def goal(text: Column, now: Column, tz: str = "UTC", metrics: tuple[str, ...] = METRICS) -> Column:
    """What a goal asks for: target (0 if none is told), metric, and the day by which, from the expression of time in it."""
    words = "|".join(metrics)
    low = F.lower(text)
    target = F.coalesce(F.regexp_replace(F.regexp_extract(low, rf"([0-9][0-9,]*) (?:more |new )?(?:{words})", 1), ",", "").try_cast("long"), F.lit(0))
    end = expression(text, now, tz)["end"]
    return F.struct(target.alias("target"), F.regexp_extract(low, rf"({words})", 1).alias("metric"), F.to_date(end - F.expr("interval 1 second")).alias("until"))


# ------------------------------------------------------------------------------------ queries


def dated_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their latest line: what the expressions of the queries are made of."""
    top = F.max(F.struct("l_shipdate", "l_linenumber", "l_quantity", "l_returnflag")).alias("l")
    line = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(top).select("o_orderkey", "l.*")
    return load(spark, d, "orders").join(line, "o_orderkey").withColumn("now", F.col("o_orderdate").cast("timestamp") + F.expr("interval 10 hours"))


_DATED_SQL = "l AS (SELECT l_orderkey, max({'s': l_shipdate, 'n': l_linenumber, 'q': l_quantity, 'r': l_returnflag}) AS l FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey, o_orderdate AS d, l.s AS s, l.q::INTEGER AS q, l.r AS r, o_orderstatus AS st, o_orderpriority AS pr FROM orders JOIN l ON l_orderkey = o_orderkey)"


@catalog.query("appointment_time", f"""
WITH {_DATED_SQL}, w AS (SELECT *, d::DATE AS t, ((isodow(s) - isodow(d) + 7) % 7)::INTEGER AS ahead, (isodow(s) - 1)::INTEGER AS n, (9 + q % 3)::INTEGER AS h FROM o)
SELECT o_orderkey, CASE WHEN st = 'F' THEN CASE r WHEN 'A' THEN t + ahead WHEN 'N' THEN (t - (isodow(t) - 1)::INTEGER) + 7 + n ELSE CASE WHEN day(s) >= day(t) THEN date_trunc('month', t)::DATE ELSE (date_trunc('month', t) + INTERVAL 1 MONTH)::DATE END + (day(s) - 1)::INTEGER END + to_hours(h)
  WHEN st = 'O' THEN CASE r WHEN 'A' THEN s::DATE + to_hours(12 + h - 9) WHEN 'N' THEN (t + q) + INTERVAL 13 HOUR ELSE s::DATE + to_hours(h) + INTERVAL 30 MINUTE END ELSE CASE r WHEN 'A' THEN t + INTERVAL 42 HOUR WHEN 'N' THEN t + INTERVAL 57 HOUR ELSE (t + ahead) + INTERVAL 13 HOUR END END::TIMESTAMP AS visit
FROM w WHERE NOT (st = 'F' AND r = 'R' AND day(s) > 28)""")
def appointment_time(spark: SparkSession, d: str) -> DataFrame:
    """When customers say that they come: the day and hour of each order's message, as of the order's own date."""
    day = F.date_format("l_shipdate", "EEEE")
    number = F.dayofmonth("l_shipdate").cast("string")
    ordinal = F.concat(number, F.when(number.rlike("^(1|21|31)$"), "st").when(number.rlike("^(2|22)$"), "nd").when(number.rlike("^(3|23)$"), "rd").otherwise("th"))
    h = 9 + F.col("l_quantity").cast("int") % 3
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    status, flag = F.col("o_orderstatus"), F.col("l_returnflag")
    text = F.when(status == "F", F.when(flag == "A", say("See you ", day, " at ", h, "am?")).when(flag == "N", say("I come next ", day, " at ", h, ":00.")).otherwise(say("On the ", ordinal, " at ", h, " am"))).when(
        status == "O", F.when(flag == "A", say("It is ", F.when(h == 9, "12").otherwise(h - 9), " pm on ", F.date_format("l_shipdate", "MMMM d yyyy"), " then")).when(flag == "N", say("maybe in ", F.col("l_quantity").cast("int"), " days in the afternoon")).otherwise(say("half past ", F.element_at(F.array(*map(F.lit, ("nine", "ten", "eleven"))), h - 8), " on ", F.date_format("l_shipdate", "yyyy-MM-dd")))
    ).otherwise(F.when(flag == "A", "Tomorrow evening suits me").when(flag == "N", "the day after tomorrow in the morning").otherwise(say("this ", day, " afternoon")))
    o = dated_orders(spark, d).where(~((status == "F") & (flag == "R") & (F.dayofmonth("l_shipdate") > 28)))
    return o.select("o_orderkey", expression(text, F.col("now"))["start"].alias("visit"))


@catalog.query("timeframe", f"""
WITH {_DATED_SQL}, w AS (SELECT *, d::DATE AS t FROM o), e AS (SELECT o_orderkey, CASE st WHEN 'F' THEN q WHEN 'O' THEN CASE r WHEN 'A' THEN 7 - isodow(t) WHEN 'N' THEN datediff('day', t, last_day(t)) ELSE datediff('day', t, last_day(t + INTERVAL 1 MONTH)) END ELSE CASE r WHEN 'A' THEN 0 WHEN 'N' THEN datediff('day', t, (date_trunc('year', t) + INTERVAL 1 YEAR)::DATE + 365 + CASE WHEN isodow(t) > 0 AND (year(t) + 1) % 4 = 0 THEN 1 ELSE 0 END - 1) END END AS days FROM w)
SELECT o_orderkey, CASE WHEN days IS NULL THEN 'unknown' WHEN days <= 1 THEN 'immediate' WHEN days <= 7 THEN 'week' WHEN days <= 31 THEN 'month' WHEN days <= 92 THEN 'quarter' ELSE 'later' END AS timeframe FROM e""")
def timeframe_query(spark: SparkSession, d: str) -> DataFrame:
    """How soon customers want to buy, as of their orders' dates."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    status, flag = F.col("o_orderstatus"), F.col("l_returnflag")
    text = F.when(status == "F", say("I buy in ", F.col("l_quantity").cast("int"), " days")).when(status == "O", F.when(flag == "A", "sometime this week!").when(flag == "N", "by the end of this month or so").otherwise("maybe next month, may be not")).otherwise(F.when(flag == "A", "I need it today").when(flag == "N", "Not before next year ends, so next year").otherwise("a nice one"))
    text = F.when((status == "P") & (flag == "N"), "some day next year").otherwise(text)
    o = dated_orders(spark, d)
    return o.select("o_orderkey", timeframe(expression(text, F.col("now")), F.col("now")).alias("timeframe"))


@catalog.query("goal_parse", f"""
WITH {_DATED_SQL} SELECT o_orderkey, CASE WHEN r = 'R' THEN 0 ELSE q END::BIGINT AS target, CASE st WHEN 'F' THEN 'signup' WHEN 'O' THEN 'purchase' ELSE 'click' END AS metric,
CASE r WHEN 'A' THEN (d::DATE + 7 * q + INTERVAL 10 HOUR)::DATE WHEN 'N' THEN last_day(s::DATE) ELSE last_day(d::DATE) END::VARCHAR AS until FROM o""")
def goal_parse(spark: SparkSession, d: str) -> DataFrame:
    """Goals in words: how many of what by when, each as of its order's date."""
    metric = F.when(F.col("o_orderstatus") == "F", "signups").when(F.col("o_orderstatus") == "O", "purchases").otherwise("clicks")
    n = F.col("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_returnflag") == "A", F.concat(n, F.lit(" "), metric, F.lit(" within "), n, F.lit(" weeks"))).when(F.col("l_returnflag") == "N", F.concat(n, F.lit(" new "), metric, F.lit(" in "), F.date_format("l_shipdate", "MMMM yyyy"))).otherwise(F.concat(F.lit("more "), metric, F.lit(" this month")))
    g = dated_orders(spark, d).select("o_orderkey", goal(text, F.col("now")).alias("g"))
    return g.select("o_orderkey", "g.target", "g.metric", F.col("g.until").cast("string").alias("until"))


@catalog.query("time_variants", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderpriority <> '4-NOT SPECIFIED') THEN o_orderdate - INTERVAL 8 HOUR ELSE o_orderdate END AS seen_at FROM orders")
def time_variants(spark: SparkSession, d: str) -> DataFrame:
    """Times of orders in five forms, back as instants; wall clocks are those of Shanghai."""
    ts, status, urgency = F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus"), F.col("o_orderpriority")
    seconds = F.unix_seconds(ts).cast("string")
    raw = F.when(status == "F", F.date_format(ts, "yyyyMMddHHmmss")).when(status == "O", F.when(urgency < "3", seconds).when(urgency < "4", F.concat(seconds, F.lit("000"))).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    raw = F.coalesce(raw, F.when(urgency == "5-LOW", F.concat(F.lit("soon, "), F.date_format(ts, "yyyy"))).when(urgency == "4-NOT SPECIFIED", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")).when(urgency < "3", F.date_format(ts, "yyyy/MM/dd HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    return load(spark, d, "orders").select("o_orderkey", any_time(raw).cast("timestamp_ntz").alias("seen_at"))
