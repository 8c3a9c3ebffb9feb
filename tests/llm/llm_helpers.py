"""Small documents with the awkward cases, for all operators."""

from __future__ import annotations

import random

EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, start string, score string, class string, id string, a string, bucket string, rate string"


def frame(spark, texts, sources=None):
    """Documents 0, 1, ... with columns whose names operators might use themselves."""
    rows = [
        (i, t, "en", sources[i] if sources else f"s{i % 3}", None, "x", "x", "x", "x", "x", "x", "x", "x")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, EXTRA)


def with_rows(df, *rows):
    """More rows (doc_id, text)."""
    spark = df.sparkSession
    more = spark.createDataFrame([(i, t, None, None, None, *[None] * 8) for i, t in rows], EXTRA)
    return df.unionByName(more)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


ODD_TEXTS = ["", None, " \n\t ", "one", "naïve Ünïcode   text here", "a  b\n\n c \n", "x" * 5000, "<|endoftext|> a"]
