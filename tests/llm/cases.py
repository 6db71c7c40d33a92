"""Texts with nulls, blanks, ties, repeats and odd characters, and a folder of tables made of them."""

import random

LONG = " ".join(f"w{k % 977}" for k in range(30_000))
EDGE_TEXTS = [
    None, "", " ", "\n", "\n\n\n", "a", "one two three four", "one two three four five",
    "One TWO three FOUR five six seven", "one two three four five six seven", "tabs\tand\x0bfeeds\x0c\rhere  twice  ",
    "É à ü ß 日本語 テキスト 🙂🙂 é", "nul\x00byte", "nbsp\u00a0\u2003and\u0085 next\u2028line", "x" * 5000, LONG, LONG,
    "don't we'll I'VE it's", "a\n\nb\n \nc", "12345 67 8.9", "!!! ??? ***", "\u200b<|im_end|>", "ﬁ ligature Å Å",
]


def random_texts(n=60, seed=7):
    rng = random.Random(seed)
    vocabulary = ["ha", "the", "of", "être", "über", "x1", "a,b", "don't", "  ", "\n", "\n\n", "\t", "99", "…", "🙂", "Ünder", "#", "%%"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def documents(spark, texts, extra=False):
    rows = [(k, t, ("en", "de", None)[k % 3], f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in ("spans", "n", "key", "words", "body", "blob", "size", "label")})
    return df


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
