import re
from collections import Counter

import duckdb
from helpers import frame, odd_rows, prose, rows_of

from canopy.llm import rules
from canopy.llm.queries import op5_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_against_brute_force(spark):
    again = " ".join(["alpha beta gamma delta epsilon zeta eta theta iota"] * 3)
    rows = [*odd_rows(), (20, again, "en", "a", 1), (21, "## a *b* <c>\nx\nx\n\nx", "en", "a", 1), (22, "a b c d e f g h a b c d e f g h", "en", "a", 1)]
    found = rules.assess(frame(spark, rows, True))
    assert found.columns[:3] == ["doc_id", "n_words", "word_chars"]
    texts = sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in found.collect()), key=repr) == texts
    for r in found.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_stage_keeps_columns_and_agrees(spark):
    df = frame(spark, odd_rows(), True)
    kept = rules.clean(df)
    assert kept.columns == df.columns
    verdicts = sorted((r.doc_id for r in rules.assess(df).where("kept").collect()), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == verdicts != []


def test_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = op5_rules(spark, sf)
    assert rows_of(found) == sorted(duckdb.sql(rules.oracle()).project(", ".join(found.columns)).fetchall(), key=repr)


def test_empty(spark):
    df = frame(spark, odd_rows()).limit(0)
    assert rules.assess(df).count() == 0 and rules.clean(df).count() == 0


def test_junk_goes_and_prose_stays(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()}
    found = {r.doc_id: r for r in op5_rules(spark, sf.replace("0.001", "0.01")).collect()}
    clean = [found[d] for d, q in labels.items() if q == 1 and not found[d].base_failed]
    junk = [found[d] for d, q in labels.items() if q == 0]
    assert all(r.kept for r in clean) and sum(not r.kept for r in junk) >= 0.9 * len(junk)


def test_clashing_prefix(spark):
    df = frame(spark, [(1, prose(1, 120), "en", "a", 5), (2, None, None, "a", 5)]).withColumnsRenamed({"n_chars": "__rules_words", "lang": "__rules_kept"})
    out = rules.clean(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]
