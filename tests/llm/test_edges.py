"""Nulls, empty tables, very long texts, repeated rows and clashing columns, operator by operator."""

from pyspark.sql import functions as F

from millrace.llm import media, simhash, tokens

LONG = "word " * 100_000 + "x" * 100_000


def table(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (None, "one two three four"), (None, "alone in its words here"), (2, None), (3, ""), (4, " \t\n"), (5, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("fp", "rep", "key", "n_bytes", "media", "payload", "rgb", "n_tokens"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_token_counts(spark):
    df = table(spark)
    got = tokens.count_tokens(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "5", "None", "None"]
    by = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in got}
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert by[2, 0] == by[3, 0] == (0, False) and by[5, len(LONG)] == (len(model.encode(LONG)), True)
    assert tokens.count_tokens(df.limit(0)).count() == 0
    counter = tokens.MergeCounter({"ab": 0, "abab": 1}, cache=10)
    assert counter.count("ab" * 1000) == counter.count("ab" * 1000) and not any(len(k) > tokens.KEPT for k in counter)


def test_simhash(spark):
    df = table(spark)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    same = got[0][1]
    assert [g for g in got if g[1] == same] == [("1", same, 1), ("1", same, 1), ("None", same, 1)]
    assert [g[2] for g in got if g[0] == "None" and g[1] != same] == [None] and {g[1:] for g in got if g[0] in "234"} == {("0" * 16, 2)}
    empty = simhash.near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]


def test_media(spark):
    df = table(spark)
    got = media.features(media.tensors(media.store(df))).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "5", "None", "None"]
    for r in got:
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes) and r.payload_bytes < r.n_bytes + 384
    assert len({r.media_sha256 for r in got if r.n_bytes in (0, 18)}) == 2 and {r.payload_bytes for r in got if r.n_bytes == 0} == {192}
    assert media.features(media.tensors(media.store(df.limit(0)))).count() == 0
    assert list(media.groups([5, 5, 5, 50, 1, 1, 1], 10, 2)) == [(0, 2), (2, 1), (3, 1), (4, 2), (6, 1)] and list(media.groups([], 1, 1)) == []
