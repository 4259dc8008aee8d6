"""An algebra of spans: columns over arrays of structs that have at least `start` and `end`, end not included.

All of it stays in the JVM. Cost is the product of the sizes of the arrays, so long texts bring their spans clause by
clause (`operators.dictionary.clause_spans`).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"])


def gap(a: Column, b: Column) -> Column:
    """Characters between two spans; 0 if they touch or overlap."""
    return F.greatest(a["start"] - b["end"], b["start"] - a["end"], F.lit(0))


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def outside(spans: Column, others: Column) -> Column:
    """Those that no other one contains."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: contains(o, s)))


def apart(spans: Column, others: Column) -> Column:
    """Those that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: overlaps(o, s)))


def inside(spans: Column, scopes: Column) -> Column:
    """Those that lie in one of the scopes."""
    return F.filter(spans, lambda s: F.exists(scopes, lambda o: contains(o, s)))


def follows(spans: Column, others: Column, within: int) -> Column:
    """Those that begin at most `within` characters after the end of another one."""
    return F.filter(spans, lambda s: F.exists(others, lambda o: (o["end"] <= s["start"]) & (s["start"] - o["end"] <= within)))


def nearest(span: Column, others: Column) -> Column:
    """The other one with the fewest characters between, the first of several; null if there is none."""
    best = F.array_min(F.transform(others, lambda o: F.struct(gap(span, o).alias("gap"), o["start"].alias("at"), o.alias("span"))))
    return best["span"]


def longest_first(spans: Column) -> Column:
    """Spans that don't overlap: the longest first, of equal ones the earliest; in the order of the text."""
    order = lambda s: F.struct((s["start"] - s["end"]).alias("n"), s["start"].alias("at"), s.alias("span"))
    ranked = F.transform(F.array_sort(F.transform(spans, order)), lambda r: r["span"])
    taken = F.aggregate(ranked, F.filter(ranked, lambda s: F.lit(False)), lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s))))
    return F.transform(F.array_sort(F.transform(taken, lambda s: F.struct(s["start"].alias("at"), s.alias("span")))), lambda r: r["span"])
