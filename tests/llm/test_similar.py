import random

import pytest
from helpers import frame, odd_rows, prose

import corpus_pipeline
from canopy.llm import similar, simhash


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def near(a, b):
    return similar.similarity(similar.shingles(a), similar.shingles(b)) >= similar.SIMILAR


def planted():
    """Near copies whose three-word fingerprints differ in more than two bits, one large group of them, and texts that only share a passage."""
    texts = []
    for g in range(20):
        texts += [prose(g, 300), edited(prose(g, 300), g, 4), edited(prose(g, 300), 100 + g, 12)]
    texts += [edited(prose(50, 300), 1000 + i, 3) for i in range(40)]
    texts += [prose(60, 150) + " " + prose(200 + i, 60) for i in range(20)]
    random.Random(2).shuffle(texts)
    return texts


def wanted(rows):
    """Positions of the rows that stay: the first of each group that links connect, by id, null last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    sets, root = [similar.shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, i in enumerate(order):
        for j in order[:x]:
            if similar.similarity(sets[i], sets[j]) >= similar.SIMILAR:
                a, b = find(i), find(j)
                root[max(a, b, key=order.index)] = min(a, b, key=order.index)
    return {find(i) for i in order}


def test_groups_against_all_pairs(spark):
    texts = planted()
    df = frame(spark, [(i, t, "en", "a", i) for i, t in enumerate(texts)])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").select("doc_id").collect()}
    assert kept == wanted([(i, t) for i, t in enumerate(texts)])
    ids = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    missed = [i for i in ids if ids[i] == i]  # what SimHash alone keeps
    assert [(a, b) for a in missed for b in missed if a < b and near(texts[a], texts[b])]


def test_rounds_of_large_buckets(spark):
    """Texts that share most of their shingles, so that they meet in many buckets, but are no near copies, with a chain of links among them."""
    shared, texts = prose(70, 200), []
    for i in range(40):
        texts.append(shared + " " + prose(300 + i, 60))
    w = prose(71, 200).split()
    for i in range(12):  # each is near the next one only
        w = w[:]
        w[i * 15 : i * 15 + 12] = [f"link{i}x{k}" for k in range(12)]
        texts.append(" ".join(w))
    rows = [(1000 - i, t, "en", "a", i) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in similar.one_of_each(frame(spark, rows)).select("doc_id").collect()}
    assert kept == {rows[i][0] for i in wanted(rows)} and len(kept) < len(rows)


def test_prefix_pairs_against_all_pairs(spark):
    """No pair at 0.8 or more is lost, exact bounds and sets of one shingle included, and a common passage makes no pairs."""
    rng, own = random.Random(5), iter(range(1000, 10**6))
    sets = [{1}, {1}, set(range(4)), set(range(5)), set(range(10)), {*range(8), 98, 99}, {*range(8)}]
    for _ in range(30):
        core = [next(own) for _ in range(rng.randint(5, 60))]
        sets += [set(rng.sample(core, rng.randint(len(core) * 7 // 10, len(core)))) | {next(own) for _ in range(rng.randint(0, 4))} for _ in range(6)]
    passages = [set(range(100, 160)) | {next(own) for _ in range(16)} for _ in range(30)]
    labels = [i % 50 for i in range(len(sets))]
    texts = spark.createDataFrame([(i, len(s), 500 + i if i >= len(sets) else labels[i]) for i, s in enumerate(sets + passages)], "fp long, size int, label long")
    hashes = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets + passages)], "fp long, hashes array<long>")
    pairs = {tuple(r) for r in similar.prefix_pairs(texts, hashes).collect()}
    like = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and labels[i] != labels[j] and len(a & b) >= 0.8 * len(a | b)}
    assert len(like) > 30
    assert like <= pairs
    assert not [p for p in pairs if max(p) >= len(sets)]


def test_repeated_and_null_ids(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, b + " extra"), (9, c), (None, prose(4, 80)), (None, prose(4, 80)), (None, prose(5, 80)), (None, a)]
    df = frame(spark, [(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)])
    kept = sorted(((r.doc_id, r.text) for r in similar.one_of_each(df).collect()), key=repr)
    assert kept == sorted([(3, a), (5, b), (9, c), (None, prose(4, 80)), (None, prose(5, 80))], key=repr)


def test_bands_meet():
    met = 0
    for g in range(200):
        a, b = similar.shingles(prose(g, 200)), similar.shingles(edited(prose(g, 200), g, 4))
        met += bool(set(similar.bands(a).tolist()) & set(similar.bands(b).tolist()))
        assert not set(similar.bands(a).tolist()) & set(similar.bands(similar.shingles(prose(1000 + g, 200))).tolist())
    assert met == 200


def test_shingles():
    assert len(similar.shingles("a b c d e f")) == 2 and len(similar.shingles("A  b")) == 1
    assert similar.shingles("A  b").tolist() == similar.shingles("a b").tolist()
    assert len(similar.bands(similar.shingles(None))) == 0
    assert similar.similarity(similar.shingles("a b c d e f"), similar.shingles("a b c d e g")) == pytest.approx(1 / 3)


def test_odd_rows(spark):
    rows = [*odd_rows(), (30, prose(9, 300), "en", "a", 1), (31, prose(9, 300) + " ", "en", "a", 1)]
    df = frame(spark, rows, True)
    kept = similar.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 6, 7, 8, 9, 30, None], key=repr)
    assert similar.one_of_each(df.limit(0)).count() == 0
