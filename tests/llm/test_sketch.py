import hashlib

import numpy as np
import pytest
from helpers import frame, odd_rows, prose

from canopy.llm import sketch
from canopy.llm.queries import op7_sketch


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def successors(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    return {order[k]: order[(k + 1) % len(order)] for k in range(len(order))}


def wanted(rows):
    out = []
    for i, j in successors(rows).items():
        a, b = rows[i][1] or "", rows[j][1] or ""
        half = len(a) // 2
        e = a[: len(a) - half] + b[:half]
        out.append((rows[i][0], len(a), hashlib.sha256(e.encode()).hexdigest(), likeness(shingles(a), shingles(e)), likeness(shingles(a), shingles(b))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [256, 8, 1])
def test_against_brute_force(spark, rows):
    data = [*odd_rows(), *[(100 + 7 * i, prose(i, 20 + i), "en", "a", 1) for i in range(40)], (-5, "negative ids come first", "en", "a", 1)]
    found = sketch.fingerprints(frame(spark, data, True), k=100_000, run_rows=rows).collect()
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found), key=repr)
    for a, b in zip(got, wanted(data), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_estimates(spark, sf):
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in op7_sketch(spark, sf).collect()), key=repr)
    errors = []
    for a, b in zip(found, wanted(data), strict=True):
        assert a[:3] == b[:3]
        errors += [a[3] - b[3], a[4] - b[4]]
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.2


def test_sketches():
    a, b = prose(1, 3000), prose(2, 3000)
    both = a + " " + b
    x, y, z = (sketch.Sketch.of_text(t, k=512) for t in (a, b, both))
    assert sketch.Sketch.parse(x.text(), 512).hashes.tolist() == x.hashes.tolist()
    n = len(shingles(a))
    assert abs(x.distinct() - n) < 0.2 * n
    assert x.merge(y).resemblance(z) > 0.95
    assert x.containment(z) > 0.9 and z.containment(x) == pytest.approx(0.5, abs=0.1)
    assert sketch.Sketch.of_text("").resemblance(sketch.Sketch.of_text(None)) == 1.0 and sketch.Sketch.of_text("").resemblance(x) == 0.0
    assert sketch.Sketch.of_text("A b").resemblance(sketch.Sketch.of_text("a\n B")) == 1.0


def test_one_row_and_none(spark):
    df = frame(spark, [(4, "a b c d", "en", "x", 7)])
    (r,) = sketch.fingerprints(df).collect()
    assert (r.n_chars, r.near_next, r.edited_sha256) == (7, 1.0, hashlib.sha256(b"a b " + b"a b").hexdigest())
    assert sketch.fingerprints(df.limit(0)).count() == 0
    nulls = frame(spark, [(None, "a", "en", "x", 1), (None, "b", "en", "x", 1)])
    assert sorted(r.near_next for r in sketch.fingerprints(nulls).collect()) == [0.0, 0.0]
