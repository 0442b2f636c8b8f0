"""One document of each group of near copies, by the similarity of their word shingles.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of ``SIMILAR`` or more; a group is what links connect.  One row of
each group stays.

Candidates come in two ways.  SimHash fingerprints of the same shingles are
linked by the pigeonring filter (``simhash.links``).  That finds the closest
copies only: by the angle between sets at a similarity of 0.8 about 10 of 64
bits differ on average, and a budget that covers them has more than ten
segments of at most 6 bits, which are no keys for a join.  So the rest comes
from MinHash bands: texts that agree in all ``ROWS`` minima of one of ``BANDS``
bands meet in a bucket.  Pairs at a similarity of 0.8 share no bucket with
probability (1 - 0.8^5)^30 = 7e-6, closer pairs more rarely.  Every candidate
pair is checked exactly on the shingles' 64-bit hashes.

A bucket's first text is compared with all after it, then the first two of those
left.  Not compared are texts that are already known to be connected, and those
whose sizes, or whose shingles that no other text left has, rule a similarity
of 0.8 out.  Texts with the fewest such shingles come first, which are the
originals of edited copies.  What is left of the buckets is compared where a
prefix filter (``prefix_pairs``) lets a pair pass, which loses no link.  So a
group of n near copies, or n texts around a common passage, make a few pairs
for each, not n squared.

Defined results: texts with equal words (case of A-Z aside) are one, as are all
texts without words.  Of a group the row with the smallest id stays, null ids
last, then the text with the smallest hash; of equal rows one.  Rows are told
apart by id and text, so repeated ids with different texts are judged apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm import simhash
from canopy.llm.common import plain, plain_name, settle, small
from canopy.session import ship_code

SIMILAR = 0.8
SHINGLE_WORDS = 5
BANDS, ROWS = 30, 5
SEED = 42
#: Shingles hashed at a time, and texts given back at a time.
PART, TEXTS = 2048, 128
#: For rounding in bounds on counts.
SLACK = 1e-6
#: Small rows (keys, pairs, labels) in a partition.
PART_ROWS = 50_000


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a shorter text is one shingle, a text without words none."""
    return np.unique(simhash.shingle_hashes(text, shingle_words, seed))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A bucket's key for each band.  No shingles, no bucket."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    factors = _factors(2 * n * rows)
    turn, mix = factors[: n * rows], factors[n * rows :]
    least = np.full(n * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), PART):
        np.minimum(least, (turn[:, None] * hashes[None, a : a + PART]).min(axis=1), out=least)
    return (least * mix).reshape(n, rows).sum(axis=1, dtype=np.uint64).view(np.int64)


def _print(text: str | None) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(simhash.split_words(text)), SEED)).view(np.int64))


def marks(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """(fp, sim, size, bands) of each text: a hash of its words, its SimHash fingerprint, its number of distinct shingles and its buckets."""

    ship_code()

    @F.pandas_udf("fp long, sim long, size int, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for a in range(0, len(texts), TEXTS):
                some = texts.iloc[a : a + TEXTS]
                hashes = [simhash.shingle_hashes(x, shingle_words, SEED) for x in some]
                own = [np.unique(h) for h in hashes]
                yield pd.DataFrame({"fp": [_print(x) for x in some], "sim": [simhash.majority(h) for h in hashes], "size": [len(h) for h in own], "bands": [bands(h) for h in own]})

    return of(text)


def sets(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The distinct shingles' hashes of each text."""

    ship_code()

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for a in range(0, len(texts), TEXTS):
                yield pd.Series([shingles(x, shingle_words).view(np.int64) for x in texts.iloc[a : a + TEXTS]])

    return of(text)


def _compact(df: DataFrame) -> DataFrame:
    """A settled table of small rows in a partition for each ``PART_ROWS``, so that a shuffle of few rows makes few files."""
    df = settle(df)
    return df.coalesce(max(1, -(-df.count() // PART_ROWS)))


def _linked(pairs: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are near copies."""
    own = lambda side: hashes.select(F.col("fp").alias(side), F.col("hashes").alias("h" + side))
    both = F.size(F.array_intersect("ha", "hb"))
    near = both / (F.size("ha") + F.size("hb") - both) >= least
    return pairs.join(own("b"), "b").join(own("a"), "a").where(near).select("a", "b")


def fingerprint_pairs(nodes: DataFrame, budget: int = simhash.BUDGET) -> DataFrame:
    """Pairs (a < b) of texts ``fp``, each with the first of those that have its SimHash fingerprint and the first of a linked one."""
    first = _compact(nodes.groupBy("sim").agg(F.min("fp").alias("first")))
    equal = nodes.join(first, "sim").select(F.col("first").alias("a"), F.col("fp").alias("b")).where("a <> b")
    met = simhash.links(first.select(F.col("sim").alias("fp")), budget).groupBy("b").agg(F.min("a").alias("a"))
    end = lambda side: first.select(F.col("sim").alias(side), F.col("first").alias("f" + side))
    met = met.join(end("a"), "a").join(end("b"), "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    return equal.union(met).distinct()


def _spread(labels: DataFrame, edges: DataFrame, steps: int = 2) -> DataFrame:
    """(fp, label) for ends of edges: texts with one label are connected.

    Labels go ``steps`` links far at a time, so not all that are connected have
    one label yet; ``labels`` has what is known from fewer edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ends = both.select(F.col("a").alias("fp")).distinct()
    labels = ends.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    for _ in range(steps):
        near = both.join(labels, F.col("b") == F.col("fp")).select(F.col("a").alias("fp"), "label")
        labels = labels.union(near).groupBy("fp").agg(F.min("label").alias("label"))
    return labels


def groups(nodes: DataFrame, hashes_of: Callable[[DataFrame], DataFrame], least: float = SIMILAR) -> DataFrame:
    """(node, root) of the texts of ``nodes`` (fp, sim, size, bands) that have links.

    ``hashes_of`` gives the table (fp, hashes) for a table of ``fp``.
    """
    near = _compact(fingerprint_pairs(nodes))
    met = nodes.select(F.explode("bands").alias("key"), "fp", "size")
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = _compact(met.join(shared, "key"))
    hashes = settle(hashes_of(met.select("fp").union(near.select("a")).union(near.select("b")).distinct()))
    edges = _compact(_linked(near, hashes, least))
    labels = _compact(_spread(edges.select(F.col("a").alias("fp"), F.col("a").alias("label")).limit(0), edges))
    met = met.withColumn("alone", F.lit(0).cast("long"))
    for heads in (1, 2):
        rest = _compact(_apart(met.drop("label").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))))
        if rest.isEmpty():
            return _rooted(edges, labels)
        if heads == 2:
            rest = _compact(_apart(_hopeful(rest, hashes, least)))
        place = F.struct("alone", "fp")
        order = Window.partitionBy("key").orderBy("alone", "fp")
        first = rest.groupBy("key").agg(F.min_by(F.struct("fp", "size", "alone", "label"), place).alias("s")).select("key", "s.*")
        if heads > 1:
            first = rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= heads).drop("place")
        a = first.select("key", *[F.col(x).alias("a_" + x) for x in ("fp", "size", "alone", "label")])
        shared = F.least(F.col("a_size") - F.col("a_alone"), F.col("size") - F.col("alone"))
        fits = shared / (F.col("a_size") + F.col("size") - shared) >= least  # else they can't be so similar
        pairs = rest.join(a, "key").where(place > F.struct("a_alone", "a_fp")).where("a_label <> label").where(fits).select(F.col("a_fp").alias("a"), F.col("fp").alias("b")).distinct()
        edges = edges.union(_compact(_linked(pairs, hashes, least)))
        labels = _compact(_spread(labels, edges))
        met = rest.join(first.select("key", "fp"), ["key", "fp"], "left_anti")
    rest = _compact(_apart(met.drop("label").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))))
    if not rest.isEmpty():
        edges = edges.union(_compact(_linked(prefix_pairs(rest.select("fp", "size", "label").distinct(), hashes, least), hashes, least)))
        labels = _compact(_spread(labels, edges))
    return _rooted(edges, labels)


def prefix_pairs(texts: DataFrame, hashes: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Pairs (a < b) of ``texts`` (fp, size, label) with unlike labels, among them all whose similarity is ``least`` or more.

    Every text's shingles are put in one order, rare ones first.  If two sets
    have c shingles in common, then with the first of these c or more are left
    in either set, and c is least / (1 + least) of both sizes or more.  So they
    meet at a shingle near the start of both, which a frequent one seldom is:
    texts around a common passage have their own shingles before it.
    """
    own = hashes.join(texts, "fp").select("fp", "size", "label", F.explode("hashes").alias("h"))
    often = own.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    own = own.join(often, "h").withColumn("place", F.row_number().over(Window.partitionBy("fp").orderBy("n", "h")))
    own = own.withColumn("left", F.col("size") - F.col("place") + 1).where(F.col("left") >= least * F.col("size") - SLACK)
    own = _compact(own.where("x <> y").select("h", "fp", "size", "label", "left"))  # a shingle of one label makes no pair
    a, b = own.alias("a"), own.alias("b")
    enough = F.least("a.left", "b.left") >= least / (1 + least) * (F.col("a.size") + F.col("b.size")) - SLACK
    met = (F.col("a.h") == F.col("b.h")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.label") != F.col("b.label"))
    return a.join(b, met & enough).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def _rooted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, root) for the ends of edges: what links connect has one root.  Only labels that links still join are left to connect."""
    end = lambda side: labels.select(F.col("fp").alias(side), F.col("label").alias("l" + side))
    joined = _compact(edges.join(end("a"), "a").join(end("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if joined.isEmpty():
        return labels.select(F.col("fp").alias("node"), F.col("label").alias("root"))
    roots = simhash.components(joined).select(F.col("node").alias("label"), "root")
    return labels.join(roots, "label", "left").select(F.col("fp").alias("node"), F.coalesce("root", "label").alias("root"))


def _apart(told: DataFrame) -> DataFrame:
    """The rows of buckets in which not all have one label."""
    keys = told.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return told.join(keys, "key")


def _hopeful(rest: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """The rows that may still be linked to one of their bucket, with ``alone``: how many of a text's shingles no other text of ``rest`` has.

    With c shared shingles of n, the similarity to a text of at least m is at
    most c / (n + max(m, c) - c).
    """
    own = hashes.join(rest.select("fp").distinct(), "fp", "left_semi").select("fp", F.explode("hashes").alias("h"))
    alone = own.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp")).where("n = 1").groupBy("fp").agg(F.count(F.lit(1)).alias("alone"))
    rest = rest.drop("alone").join(alone, "fp", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    rest = rest.join(rest.groupBy("key").agg(F.min("size").alias("smallest")), "key")
    shared = F.col("size") - F.col("alone")
    return rest.where(shared / (F.col("size") + F.greatest("smallest", shared) - shared) >= least).drop("smallest")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILAR, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies."""
    bare = plain(docs)
    doc_id, text = plain_name(docs, doc_id), plain_name(docs, text)
    key = [F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row")]
    prints = settle(bare.select(*key, marks(F.col(text), shingle_words).alias("m")).select("doc_id", "row", "m.*"))
    keys = settle(prints.groupBy("fp", "doc_id", "row").agg(F.count(F.lit(1)).alias("n")))
    repeated = not keys.where("n > 1").isEmpty()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = settle(prints.groupBy("fp").agg(F.min(place).alias("place"), *[F.first(x).alias(x) for x in ("sim", "size", "bands")]))

    def hashes_of(some: DataFrame) -> DataFrame:
        picked = settle(nodes.join(some, "fp").select("fp", F.col("place.doc_id").alias("i"), F.col("place.row").alias("r")))
        picked = small(picked, picked.count())
        rows = bare.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
        rows = rows.join(picked, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r"))).select("fp", "text")
        found = rows.select("fp", sets(F.col("text"), shingle_words).alias("hashes"))
        return found.dropDuplicates(["fp"]) if repeated else found

    tied = groups(nodes, hashes_of, least)
    rooted = nodes.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "place", F.coalesce("root", "fp").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("place").alias("stay"))
    stays = rooted.join(stays, "root").select("fp", F.col("stay.doc_id").alias("i"), F.col("stay.row").alias("r"))
    stays = keys.join(stays, "fp")
    judged = settle(stays.select("doc_id", "row", "n", (F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r"))).alias("stays")).where("n > 1 OR NOT stays"))

    rows = bare.withColumns({"id": F.col(doc_id), "row": F.xxhash64(text)})
    met = lambda found: rows["id"].eqNullSafe(found["doc_id"]) & (rows["row"] == found["row"])
    out = rows.join(small(judged, judged.count()), met(judged), "left_anti")
    again = judged.where("stays")
    if not again.isEmpty():  # equal rows, of which one stays
        out = out.union(rows.join(again, met(again), "left_semi").dropDuplicates(["id", "row"]))
    return out.select(*bare.columns).toDF(*docs.columns)
