from collections import Counter

import numpy as np
from helpers import frame, odd_rows
from pyspark.sql import functions as F

from canopy.llm import langid
from canopy.llm.queries import op4_language


def brute(text):
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    n = Counter()
    for w in text.split():
        p = " " + w + " "
        n.update(w)
        n.update(p[i : i + 2] for i in range(len(p) - 1))
        n.update(p[i : i + 3] for i in range(len(p) - 2))
    return {tuple(1 if c == " " else ord(c) for c in k): v for k, v in n.items()}


def decoded(codes, counts):
    out = {}
    for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
        parts = []
        while c:
            parts.append(c & ((1 << 21) - 1))
            c >>= 21
        out[tuple(reversed(parts))] = n
    return out


def test_ngrams(monkeypatch):
    texts = ["Hello, World! été  x", "a", "ab\n\ncd 12 ef", "😀 Ünï𝒳"]
    for t in texts:
        assert decoded(*langid.ngrams(t)) == brute(t)
    monkeypatch.setattr(langid, "PART", 5)
    for t in texts:
        assert decoded(*langid.ngrams(t)) == brute(t)
    assert len(langid.ngrams("12 !?")[0]) == 0


def test_distance():
    lists = {n: langid.ranked(*langid.ngrams(t)).tolist() for n, t in {"x": "abc abd abe", "y": "xyz xyw xyv"}.items()}
    p = langid.Profiles(lists)
    own = langid.ranked(*langid.ngrams("abc xy"))
    away = {n: sum(abs(i - lists[n].index(c)) if c in lists[n] else langid.TOP for i, c in enumerate(own.tolist())) for n in lists}
    best = min(sorted(away), key=away.get)
    assert p.nearest("abc xy") == (best, 1 - away[best] / (langid.TOP * len(own)))
    assert p.nearest("12") == ("und", 0.0) and p.nearest(None) == ("und", 0.0) and langid.Profiles({}).nearest("abc") == ("und", 0.0)
    assert langid.Profiles({"b": lists["x"], "a": lists["x"]}).nearest("abc")[0] == "a"


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    found = op4_language(spark, sf).join(docs, "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.truth).mean() >= 0.97 and found.score.between(0, 1).all()


def test_odd_rows(spark):
    df = frame(spark, odd_rows(), True)
    profiles = langid.learn(df)
    assert profiles.names == ["de", "en", "fr"]
    rows = df.select("doc_id", "text", langid.identify(F.col("text"), profiles).alias("r")).collect()
    assert [(r.r.lang_pred, r.r.score) for r in rows] == [profiles.nearest(r.text) for r in rows]
    assert {r.r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.learn(df.limit(0)).names == []
    assert langid.learn(df.withColumn("lang", F.lit(None).cast("string"))).names == []
    assert df.limit(0).select(langid.identify(F.col("text"), profiles)).count() == 0


def test_sample_is_bounded(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("en").alias("lang"))
    one = langid.learn(df, per_language=10)
    assert np.all(one.ranks >= 0) and one.names == ["en"]


def test_memory_does_not_grow_with_the_text():
    import tracemalloc

    peaks = []
    for n in (4_000_000, 16_000_000):
        text = ("some words of no meaning, " * (n // 20))[:n]
        tracemalloc.start()
        langid.ngrams(text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.1 * peaks[0] < 400e6
