import random

import public_tokenizers
import sentencepiece

from millrace.llm.tokens import count_tokens, merge_counter

MODEL = "piece_bpe_32k.model"


def test_counts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    rnd = random.Random(1)
    texts = ["", " ", "  ", "a", "hello  world ", "a\nb\n\nc", "▁x ▁", "<s>x</s>", "日本 字①", "\t\tif (x) {\n    y;\n}", "a" * 5000, "!!!! ????", "\U0001f600 ok", "x　y\xa0z"]
    texts += ["".join(rnd.choice("abeth iéñ\n,.  12▁ß$") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    counter = merge_counter(MODEL)
    for t in texts:
        assert counter.count(t) == len(sp.encode(t)), repr(t)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "the é", "x"), (3, "the é", "y")], "doc_id long, text string, n_bytes string")
    rows = sorted(map(tuple, count_tokens(df, limit=1).collect()))
    assert rows[0] == (1, 0, 0, False) and rows[1] == (2, 0, 0, False)
    assert rows[2] == rows[3] == (3, 6, 2, True)
    assert count_tokens(df.limit(0)).count() == 0
