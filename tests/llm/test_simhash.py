import random

import numpy as np
import pytest
import xxhash
from helpers import frame, odd_rows, prose
from pyspark.sql import functions as F

from canopy.llm import simhash
from canopy.llm.queries import op9_simhash


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            w += [word] if word else []
            word = ""
        else:
            word += c
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(prints, budget):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def component_ids(ids, prints, budget=2):
    least = {}
    roots = union(prints, budget)
    for r, d in zip(roots, ids, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(r) for r in roots]


def test_fingerprints(spark):
    rows = [*odd_rows(), (50, "İ É a A", "en", "a", 1), (51, "a b c d", "en", "a", 1)]
    found = sorted(((r.doc_id, r.fingerprint) for r in simhash.near_duplicates(frame(spark, rows, True)).collect()), key=repr)
    assert found == sorted(((r[0], f"{brute(r[1]):016x}") for r in rows), key=repr)


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_links_against_all_pairs(spark, budget):
    rng = random.Random(budget)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints):
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randint(1, budget + 2)):
                q ^= 1 << b
            prints.add(q)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {(r.a, r.b) for r in simhash.links(df, budget).collect()}
    wanted = {tuple(sorted((signed(p), signed(q)))) for p in prints for q in prints if p != q and (p ^ q).bit_count() <= budget}
    assert found == wanted and wanted or budget == 0


def test_ring_principle():
    rng = random.Random(1)
    for budget in (1, 2, 5):
        parts = simhash.segments(budget)
        assert sum(w for _, w in parts) == 64
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, budget)))
            bits = [(d >> f & ((1 << w) - 1)).bit_count() for f, w in parts]
            m = len(parts)
            assert any(all(sum(bits[(i + j) % m] for j in range(n)) <= n * budget // m for n in range(1, m + 1)) for i in range(m))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randint(0, 50), rng.randint(0, 50)) for _ in range(30)] + [(7, 7)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(20)]
    rows = [(i, rng.choice(prints) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0)) for i in range(200)] + [(None, prints[0]), (None, 12345)]
    chain = [7 ^ ((1 << 2 * k) - 1 << 10) for k in range(8)]
    rows += [(500 - k, c) for k, c in enumerate(chain)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(i, signed(p)) for i, p in rows], "doc_id long, fp long")
    got = df.join(simhash.classes(df), "fp").select("doc_id", "fp", "component_id").collect()
    want = component_ids([i for i, _ in rows], [p for _, p in rows])
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(((i, c) for (i, _), c in zip(rows, want, strict=True)), key=repr)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [brute(texts[d]) for d in ids]
    want = dict(zip(ids, component_ids(ids, prints), strict=True))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, sf).collect()} == {d: (f"{p:016x}", want[d]) for d, p in zip(ids, prints, strict=True)}


def test_empty(spark):
    df = frame(spark, odd_rows()).limit(0)
    assert simhash.near_duplicates(df).count() == 0


def test_long_text_in_parts():
    text = " ".join(str(i) for i in range(70_000))
    w = text.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(len(w) - 2)], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint_bits(text) & ((1 << 64) - 1) == want


def test_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "fp long")
    plan = simhash.links(df)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and F is not None
