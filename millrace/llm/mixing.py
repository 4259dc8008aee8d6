"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

The tokens of every cell (source, language, topic) are counted; raking scales the cells again and again until the
marginals of source, language and topic have the target shares. A cell's weight is its natural share times a factor for each
of its categories, and a step of raking is one sum per category; factors of few categories are literals, those of
many a table. The sample is to have `keep` of all tokens in this
mixture: a cell's documents are kept with the probability that gives it its share, or with 1 where it has too few tokens
for that (`residuals` tells by how much marginals then fall short). A document is kept if the hash of its id lies below its
cell's probability: the draw needs no order, is the same in every run and on every cluster, and each document is
judged on its own.

Targets are given per marginal as a map of shares, or as a power of the natural shares ("temperature"). Topic is a
column of the row; `form_topic` is one for corpora without topics, from the text's form.

Defined cases: null source, language or topic are a category of their own, `?`; null, empty and blank texts have no
tokens, join their cell and are kept with its probability (1 in cells without tokens); repeated rows of an id
are drawn alike; rows without an id are drawn by their text; categories with target zero are never kept; an empty
table stays empty; columns named like those that `mix` adds stay as they are, and the added ones are left out.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, written

ROUNDS, POWER, KEEP = 8, 0.8, 0.5
#: Categories of a marginal up to which its factors are literals of the plan; more are a table.
CATEGORIES = 2_000
MARGINALS = ("source_", "lang_", "topic_")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def form_topic(text: Column, n: Column) -> Column:
    """A topic from the form of the text alone: tables, shouting, marked-up, short or long prose."""
    size = F.greatest(F.length(text), F.lit(1))
    signs = size - F.length(F.translate(text, "#$%&*|{}<>=", ""))
    shouts = size - F.length(F.translate(text, "!", ""))
    return F.when(signs * 25 > size, "marked").when(shouts * 25 > size, "loud").when(n < 40, "note").when(n < 400, "article").otherwise("long")


def draw(ident: Column) -> Column:
    """A number in [0, 1) from the id's digest."""
    return F.conv(F.substring(F.md5(ident.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def looked_up(cells: DataFrame, m: str, values: dict[str, float] | DataFrame, name: str) -> DataFrame:
    """Adds the value of each row's category of a marginal: out of a literal, or of a table (m, name); 0 where there is none."""
    if isinstance(values, DataFrame):
        return cells.join(values.select(m, F.col("value").alias(name)), m, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    literal = F.map_from_arrays(F.lit(list(values)).cast("array<string>"), F.lit(list(values.values())).cast("array<double>"))
    return cells.withColumn(name, F.coalesce(literal[F.col(m)], F.lit(0.0)))


def by_category(rows: DataFrame, m: str, value: Column) -> dict[str, float] | DataFrame:
    """A value for each category: a dict of at most CATEGORIES, or a table."""
    values = rows.select(m, value.cast("double").alias("value"))
    few = values.limit(CATEGORIES + 1).collect()
    return {r[m]: r.value for r in few} if len(few) <= CATEGORIES else written(values)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """Per cell: tokens, w, its share of the mixture, and p, the probability of its documents.

    cells: source_, lang_, topic_, tokens - one row a cell, written, as each step reads them again. Sums of a category
    are combined where the cells are, so neither cells nor documents meet.
    """
    fitted = cells.where("tokens > 0")
    total = float(fitted.agg(F.sum("tokens")).first()[0] or 1)
    goal: dict[str, dict[str, float] | DataFrame] = {}
    factor: dict[str, dict[str, float] | DataFrame] = {}
    for m in MARGINALS:
        own = fitted.groupBy(m).agg(F.sum("tokens").alias("own"))
        if targets and m.rstrip("_") in targets:
            goal[m] = {k: float(v) for k, v in targets[m.rstrip("_")].items()}
        else:
            norm = own.agg(F.sum(F.pow(F.col("own") / total, F.lit(power)))).first()[0] or 1.0
            goal[m] = by_category(own, m, F.pow(F.col("own") / total, F.lit(power)) / norm)
        factor[m] = by_category(own, m, F.lit(1.0))

    def weighed(rows: DataFrame) -> DataFrame:
        for m in MARGINALS:
            rows = looked_up(rows, m, factor[m], f"f_{m}")
        return rows.withColumn("w", F.col("tokens") / total * F.col("f_source_") * F.col("f_lang_") * F.col("f_topic_"))

    for _ in range(rounds):
        for m in MARGINALS:
            got = weighed(fitted).groupBy(m).agg(F.sum("w").alias("got"), F.max(f"f_{m}").alias("f"))
            factor[m] = by_category(looked_up(got, m, goal[m], "t"), m, F.when(F.col("got") > 0, F.col("f") * F.col("t") / F.col("got")).otherwise(0.0))
    fitted = weighed(fitted)
    for m in MARGINALS:
        fitted = looked_up(fitted, m, goal[m], f"t_{m}")
    return fitted.select(*MARGINALS, "tokens", *(f"t_{m}" for m in MARGINALS), "w", F.least(F.lit(1.0), keep * total * F.col("w") / F.col("tokens")).alias("p"))


def residuals(raked: DataFrame) -> DataFrame:
    """Per marginal and category: its target, its share of the fitted mixture, and its expected share of the sample,
    which is lower where cells are too small for theirs."""
    rows = raked.select(F.inline(F.array(*(F.struct(F.lit(m.rstrip("_")).alias("marginal"), F.col(m).alias("category"), F.col(f"t_{m}").alias("target"), F.col("w"), (F.col("tokens") * F.col("p")).alias("kept")) for m in MARGINALS))))
    sums = rows.groupBy("marginal", "category").agg(F.max("target").alias("target"), F.sum("w").alias("fitted"), F.sum("kept").alias("kept"))
    return sums.withColumn("sampled", F.col("kept") / F.sum("kept").over(Window.partitionBy("marginal")))


def celled(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """The documents as row, with their cell and n_tokens_."""
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), n_words(docs["text"]).alias("n_tokens_"))
    kind = form_topic(F.coalesce("row.text", F.lit("")), F.col("n_tokens_")) if topic is None else topic
    return named.withColumns({"source_": F.coalesce("row.source", F.lit("?")), "lang_": F.coalesce("row.lang", F.lit("?")), "topic_": F.coalesce(kind, F.lit("?"))})


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, rounds: int = ROUNDS, keep: float = KEEP, ident: str = "doc_id") -> DataFrame:
    """The documents drawn, with all their columns, and with their cell, n_tokens_ and p_ where no column has that name."""
    named = celled(docs, topic)
    cells = written(named.groupBy(*MARGINALS).agg(F.sum("n_tokens_").alias("tokens")))
    p = rake(cells, targets, power, rounds, keep).select(*MARGINALS, F.col("p").alias("p_"))
    drawn = named.join(p, list(MARGINALS), "left").withColumn("p_", F.coalesce("p_", F.lit(1.0)))
    kept = drawn.where(draw(F.coalesce(F.col(f"row.`{ident}`").cast("string"), F.col("row.text"), F.lit(""))) < F.col("p_"))
    return kept.select("row.*", *(c for c in (*MARGINALS, "n_tokens_", "p_") if c not in docs.columns))
