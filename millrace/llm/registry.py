"""The queries of this subpackage and, where SQL can express them, the SQL they are held against."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, impacts, langid, media, mixing, pages, quality, scoring, simhash, substring, tokens, toxicity, whitening
from millrace.llm.common import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(read(spark, sf_dir, "documents"), texts=False)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(read(spark, sf_dir, "documents"))
    return drawn.select("doc_id", F.col("source_").alias("source"), F.col("lang_").alias("lang"), F.col("topic_").alias("topic"), F.col("n_tokens_").alias("n_tokens"), F.round("p_", 6).alias("p"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(read(spark, sf_dir, "documents"))


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.tensors(media.store(read(spark, sf_dir, "documents"))))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.search(impacts.build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_entries(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_mix_sources,
        op3_html_extraction,
        op4_quality_classifier,
        op5_token_counts,
        op6_language_id,
        op7_decontaminate,
        op8_simhash,
        op9_lm_scores,
        op10_progressive_jpeg,
        op11_toxicity,
        op12_ranked_search,
        op13_whitening,
    )
}

_WORD_COUNT = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _mix_sql() -> str:
    """Raking written out: one step of each round after the other."""
    parts = [
        f"n0 AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, {_WORD_COUNT} AS n_tokens FROM documents)",
        "n1 AS (SELECT *, greatest(length(text), 1) AS size, greatest(length(text), 1) - length(translate(text, '#$%&*|{}<>=', '')) AS signs, greatest(length(text), 1) - length(translate(text, '!', '')) AS shouts FROM n0)",
        "n AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN signs * 25 > size THEN 'marked' WHEN shouts * 25 > size THEN 'loud' WHEN n_tokens < 40 THEN 'note' WHEN n_tokens < 400 THEN 'article' ELSE 'long' END AS topic FROM n1)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM n GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "total AS (SELECT sum(tokens) AS t FROM c)",
    ]
    for m in ("source", "lang", "topic"):
        parts.append(f"o_{m} AS (SELECT {m}, pow(sum(tokens) / (SELECT t FROM total), {mixing.POWER}) AS o FROM c GROUP BY {m})")
        parts.append(f"t_{m} AS (SELECT {m}, o / (SELECT sum(o) FROM o_{m}) AS t FROM o_{m})")
    parts.append("w0 AS (SELECT source, lang, topic, tokens, tokens / (SELECT t FROM total) AS w FROM c)")
    k = 0
    for _ in range(mixing.ROUNDS):
        for m in ("source", "lang", "topic"):
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.tokens, a.w * t.t / sum(a.w) OVER (PARTITION BY a.{m}) AS w FROM w{k} a JOIN t_{m} t ON a.{m} = t.{m})")
            k += 1
    parts.append(f"p AS (SELECT source, lang, topic, least(1.0, {mixing.KEEP} * (SELECT t FROM total) * w / tokens) AS p FROM w{k})")
    return f"""WITH {", ".join(parts)}
SELECT n.doc_id, n.source, n.lang, n.topic, n.n_tokens::BIGINT AS n_tokens, round(coalesce(p.p, 1.0), 6) AS p
FROM n LEFT JOIN p ON n.source = p.source AND n.lang = p.lang AND n.topic = p.topic
WHERE CAST('0x' || substr(md5(n.doc_id::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p.p, 1.0)"""


#: op1's contract in SQL: windows as lists of words, the smallest id of each, and the words that none covers.
_SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least USING (h) WHERE win.doc_id > least.m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.k) AS t, count(*) AS n
         FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.k = gone.k WHERE gone.k IS NULL GROUP BY each.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

#: op12's contract in SQL: postings of all terms, weights of the items' terms, and a rank.
_RANKED_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
size AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM t WHERE len(terms) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM t) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, size GROUP BY term, n),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qw AS (SELECT item_id, q.term, sum(w)::BIGINT AS w FROM q JOIN w USING (term) GROUP BY item_id, q.term),
s AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms) * n) // l))))::BIGINT AS score
      FROM qw JOIN p USING (term) JOIN t USING (r), size GROUP BY item_id, r HAVING score > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s JOIN t USING (r))
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""

ORACLE_SQL: dict[str, str] = {"op12_ranked_search": _RANKED_SQL, "op1_substring_dedup": _SUBSTRING_SQL, "op2_mix_sources": _mix_sql()}
