import random
import zlib

import numpy as np
import pytest
from helpers import frame, odd_rows

from canopy.llm import packing, tokens
from canopy.llm.queries import op6_packing


def price(length, window):
    return min(window - length, (length.bit_count() - 1) * packing.CUT_COST)


def quadratic(at, cost, window):
    f = [0] + [float("inf")] * (len(at) - 1)
    for k in range(1, len(at)):
        for i in range(k):
            d = at[k] - at[i]
            if d <= window:
                last = price(d, window) if k == len(at) - 1 else window - d
                f[k] = min(f[k], f[i] + (cost[k] if k < len(at) - 1 else 0) + last)
    return f[-1]


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64])
    at, cost = [0], [0]
    for _ in range(rng.randint(1, 60)):
        at.append(at[-1] + rng.randint(1, window // 2))
        cost.append(rng.choice([0, 1, 12]))
    cost[-1] = 0
    cuts, best = packing.best_cuts(at, cost, window)
    assert best == quadratic(at, cost, window)
    assert cuts[0] == 0 and cuts[-1] == at[-1] and all(0 < b - a <= window for a, b in zip(cuts, cuts[1:], strict=False))


def test_points():
    ids = np.full(300, 9, dtype="<u4")
    ids[[10, 200]] = 7
    at, cost = packing.cut_points(ids, np.array([50, 300]), np.array([7], dtype="<u4"))
    points = dict(zip(at.tolist(), cost.tolist(), strict=True))
    assert points[0] == points[50] == points[300] == 0 and points[11] == points[201] == packing.SENTENCE_COST
    assert points[50 + packing.GRID] == packing.CUT_COST and np.diff(at).max() <= packing.GRID


def check(rows, texts, window=packing.WINDOW):
    own = tokens.Encoder(tokens.tokenizer_path())
    wanted = sorted(zlib.crc32(x) for x in (bytes(i) + b"\1\0\0\0" for i in own.encode(texts)))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        size = sum(p.length for p in pieces)
        assert 0 < size <= window
        padding += 0 if size.bit_count() == 1 else window - size
    return wanted, padding / (padding + sum(r.length for r in rows))


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_packing(spark, sf).collect()
    _, padding = check(rows, docs.values())
    assert padding < 0.02
    own = tokens.Encoder(tokens.tokenizer_path())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for d, packed in zip(docs, own.encode(docs.values()), strict=True):
        ids = packed + b"\1\0\0\0"
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        assert sum(p.length for p in pieces) == pieces[0].doc_tokens == len(ids) // 4
        assert all(p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in pieces)


def test_odd_rows(spark):
    df = frame(spark, odd_rows(), True)
    rows = packing.pack(df, block_tokens=3000).collect()
    check(rows, [])
    own = tokens.Encoder(tokens.tokenizer_path())
    assert sum(r.length for r in rows) == sum(len(x) // 4 + 1 for x in own.encode(r[1] for r in odd_rows()))
    assert [r.length for r in rows if r.doc_id == 4] == [1] and {r.ids_crc32 for r in rows if r.doc_id in (3, 4, 5)} == {zlib.crc32(b"\1\0\0\0")}
    assert packing.pack(df.limit(0)).count() == 0
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, packing.pack(df, block_tokens=3000).collect()), key=repr)
