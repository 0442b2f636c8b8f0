"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "er", "th", "in", "on", "re", "es", "ti"]
    common = ["the", "of", "and", "to", "in", "is", "that", "with"]
    return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)) + "."


def odd_rows() -> list[tuple]:
    long = "\n".join(prose(i, 400) for i in range(60))
    return [
        (1, prose(1, 120), "en", "a", 5), (2, prose(1, 120), "en", "a", 5), (2, prose(1, 120), "en", "a", 5),
        (3, None, None, None, None), (4, "", "en", "b", 0), (5, "  \n\t ", "en", "b", 4), (None, prose(2, 60), "fr", None, 1), (None, None, None, "c", None),
        (6, long, "de", "c", len(long)), (7, "x" * 50_000, "en", "c", 50_000), (8, "Ünïcode 😀   text\x1cwith\x0bodd spaces", "fr", "ä", 3), (9, "one", "en", "b", 3),
    ]


def frame(spark, rows, clashing: bool = False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars")
    if clashing:
        from pyspark.sql import functions as F

        names = ["score", "held_out", "predicted", "size", "taken", "target", "source_size", "rank", "shard", "quota", "kept", "n_words", "fp", "fingerprint", "component_id", "root", "run", "extra", "at", "put", "label", "words", "line", "row", "key", "n", "length", "start", "offset", "n_tokens", "block", "full"]
        df = df.withColumns({n: F.lit(n) for n in names})
    return df


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
