"""Column builders that the operators share: rounding, ratios, predicates, text and time."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half up towards plus infinity, as a double; `round` differs on negatives and on 0.285."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def conjunction(terms: Iterable[Column]) -> Column:
    """All of the terms; none: true."""
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def matches(**conditions) -> Column:
    """Equality, IN (lists; an empty one is false) and IS NULL (None) terms, all of which must hold."""
    terms = []
    for name, v in conditions.items():
        if v is None:
            terms.append(F.col(name).isNull())
        elif isinstance(v, list | tuple | set):
            terms.append(F.col(name).isin(*v) if v else F.lit(False))
        else:
            terms.append(F.col(name) == v)
    return conjunction(terms)


def between(ts: Column, start: str, end: str) -> Column:
    """The half-open window [start, end)."""
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Whether [start, end], open-ended where end is null, meets [lo, hi]."""
    return (start <= hi) & (end.isNull() | (end >= lo))


def depth_of(value: Column, order: Iterable[str]) -> Column:
    """Position in an ordered enumeration, -1 outside it."""
    pairs = [x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(-1))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400e6)


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word boundaries know ASCII words only, as those of other engines do; Java's know all letters."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def meaningful(text: Column) -> Column:
    """Letters and digits of any script alone, lower-cased."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def char_ngrams(text: Column, n: int = 2) -> Column:
    """The distinct character n-grams of the meaningful characters; a shorter text is its own; an empty one has none."""
    m = meaningful(text)
    chars = F.split(m, "")
    grams = F.slice(chars, 1, F.greatest(F.char_length(m) - n + 1, F.lit(1)))
    for k in range(1, n):  # linear: a substring of UTF-8 is found from the text's start each time
        grams = F.zip_with(grams, F.slice(chars, k + 1, F.greatest(F.char_length(m) - n + 1, F.lit(1))), lambda x, y: F.concat(x, y))
    return F.when(F.char_length(m) == 0, F.array().cast("array<string>")).when(F.char_length(m) < n, F.array(m)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def count_of(text: Column) -> Column:
    """A count written as digits with separators, or with k, w or m for thousands, ten thousands and millions."""
    t = F.lower(F.regexp_replace(text, r"[,\s]", ""))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)(k|w|m)?\+?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)(k|w|m)?\+?$", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "w", 1e4).when(unit == "m", 1e6).otherwise(1.0)
    return F.when(number != "", F.floor(number.cast("double") * factor + 0.5)).cast("long")


def instant_of(number: Column) -> Column:
    """Epoch seconds or milliseconds (from 1e11 on) as a timestamp."""
    return F.timestamp_millis(F.when(number < F.lit(100_000_000_000), number * 1000).otherwise(number).cast("long"))
