import random
from collections import defaultdict

import duckdb
import pytest
from helpers import frame, odd_rows, prose, rows_of

from canopy.llm import mixing
from canopy.llm.queries import op10_mixing


def sainte_lague(votes, seats):
    won = defaultdict(int)
    for _ in range(seats):
        best = max((v for v in votes if votes[v] > 0), key=lambda k: (votes[k] / (2 * won[k] + 1), -k), default=None)
        if best is None:
            break
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(8))
def test_apportionment(spark, seed):
    rng = random.Random(seed)
    rows, wanted = [], {}
    for g in range(3):
        votes = {k: rng.choice([0.0, 1.0, rng.random() * 1000, 10.0 ** rng.randint(0, 4)]) for k in range(rng.randint(1, 12))}
        seats = rng.randint(0, 200)
        won = sainte_lague(votes, seats)
        rows += [(g, k, v, seats) for k, v in votes.items()]
        wanted |= {(g, k): won[k] for k in votes}
    found = mixing.apportion(spark.createDataFrame(rows, "g int, k int, v double, seats long"), ["g"], "k", "v", "seats")
    assert {(r.g, r.k): r.quota for r in found.collect()} == wanted


def shared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), list(names), dict.fromkeys(names, 0.0)
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > most * sizes[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 5, 100, 3000, 50_000]) for s in ["a", "b", "B", "é", "z", "src10", "src2", None][: rng.randint(1, 8)]}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    assert found == pytest.approx(shared(sizes))


def check(rows, sizes_by_source):
    for source, own in rows.items():
        total = sum(r.taken for r in own)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        assert abs(total - own[0].target) <= max(2 * mixing.BLOCK_WORDS, 0.02 * own[0].target), source
        assert own[0].source_size == sizes_by_source[source]


def test_query(spark, sf):
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op10_mixing(spark, sf).collect()
    by, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        by[docs[r.doc_id]].append(r)
        sizes[docs[r.doc_id]] += r.size
    check(by, sizes)
    assert rows_of(op10_mixing(spark, sf)) == sorted(map(tuple, found), key=repr)


def test_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = op10_mixing(spark, sf)
    assert rows_of(found) == sorted(duckdb.sql(mixing.oracle()).project(", ".join(found.columns)).fetchall(), key=repr)


def test_shards(spark):
    rows = [(i, prose(i, 30 + i % 50), "en", "hot" if i % 3 else f"s{i % 9}", 1) for i in range(600)]
    df = frame(spark, rows, True)
    found = mixing.mix(df, shard_words=2000)
    by, sizes = defaultdict(list), defaultdict(int)
    names = {r[0]: r[3] for r in rows}
    for r in found.collect():
        by[names[r.doc_id]].append(r)
        sizes[names[r.doc_id]] += r.size
    check(by, sizes)
    whole = sum(r.taken % r.size == 0 for own in by.values() for r in own)
    assert whole >= 0.9 * len(rows)


def test_many_empty_documents_spread(spark):
    rows = [(i, "", "en", "hot", 0) for i in range(300)] + [(1000 + i, prose(i, 30), "en", "b", 1) for i in range(30)]
    sizes = mixing.mix(frame(spark, rows), shard_rows=20)
    plan = {r.source: r.shards for r in mixing.targets(spark.createDataFrame([(r[3], len((r[1] or "").split())) for r in rows], "source string, size long"), shard_rows=20).collect()}
    assert plan == {"hot": 15, "b": 2} and {r.taken for r in sizes.where("doc_id < 1000").collect()} == {0}


def test_odd_rows(spark):
    df = frame(spark, odd_rows(), True)
    found = mixing.mix(df).collect()
    assert len(found) == len(odd_rows()) and {r.size for r in found if r.doc_id in (3, 4, 5)} == {0}
    out = mixing.blend(df)
    assert out.columns == df.columns and out.count() > 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.blend(df.limit(0)).count() == 0
    nothing = frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])
    assert {(r.target, r.taken) for r in mixing.mix(nothing).collect()} == {(0.0, 0)}


def test_blend_follows_the_mix(spark):
    rows = [(i, prose(i, 40 + i % 60), "en", f"s{i % 5}", 1) for i in range(400)]
    df = frame(spark, rows)
    taken = {r.doc_id: round(r.taken / r.size + 1e-9) for r in mixing.mix(df).collect()}
    times = defaultdict(int)
    for r in mixing.blend(df).collect():
        times[r.doc_id] += 1
    assert times == {d: n for d, n in taken.items() if n} and set(times.values()) <= {1, 2}


def test_plan_is_native(spark, sf):
    plan = op10_mixing(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_groups_of_shards(spark):
    """Quotas go to groups of shards first; with one group it is plain apportionment."""
    rows = [(i, prose(i, 20 + i % 60), "en", "hot" if i % 3 else f"s{i % 6}", 1) for i in range(500)]
    df, names = frame(spark, rows), {r[0]: r[3] for r in rows}
    for group in (1, 4, 1 << 12):
        by, sizes = defaultdict(list), defaultdict(int)
        for r in mixing.mix(df, shard_words=400, group_shards=group).collect():
            by[names[r.doc_id]].append(r)
            sizes[names[r.doc_id]] += r.size
        check(by, sizes)
    duckdb.register("documents", df.toPandas())
    found = mixing.mix(df, shard_words=400)
    assert rows_of(found) == sorted(duckdb.sql(mixing.oracle(shard_words=400)).project(", ".join(found.columns)).fetchall(), key=repr)
    duckdb.unregister("documents")


def test_clashing_prefix(spark):
    df = frame(spark, odd_rows()).withColumnsRenamed({"n_chars": "__mix_size", "lang": "__mix_"})
    out = mixing.blend(df)
    assert out.columns == df.columns and out.count() > 0
