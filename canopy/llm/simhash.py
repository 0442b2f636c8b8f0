"""SimHash near-duplicates with a pigeonring filter.

A fingerprint has a bit for each of the 64 bits of the hashes of a document's
word shingles, set where over half the hashes have it.  Two fingerprints link
if at most ``budget`` bits differ.

The fingerprint is a ring of ``budget + 1`` segments.  By the pigeonring
principle, if two fingerprints differ in at most ``budget`` bits, then there is
a segment from which every chain of l consecutive segments differs in at most
l * budget / (budget + 1) bits, rounded down.  For l = 1 that is 0: the segment
agrees.  For l = 2 it is 1: so one half of the next segment agrees, too.  The
join key is therefore a segment and half of its successor, six keys to a
fingerprint at a budget of 2.  The chains of all lengths are then checked in
the join's condition, before the full Hamming distance.

Only distinct fingerprints are joined, so copies, however many, are one row.
Pairs come in no more than once for each key they share and are made distinct
after the check.  Components are found by alternating large and small stars on
checkpointed edges; nothing is collected.

Defined results: a text without words (null, empty or blank) has fingerprint
zero and is linked like any other.  Equal rows share a component.  Rows with a
null id take part and get their component's smallest id, which is null if no
member has an id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import settle
from canopy.session import ship_code

BITS = 64
BUDGET = 2
SHINGLE_WORDS = 3
SEED = 42


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each shingle of a text, in order; a shorter text is one shingle, a text without words none."""
    import xxhash

    found = split_words(text)
    if not found:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    k = min(shingle_words, len(found))
    starts = [0, *(ends[: len(found) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z and the six ASCII spaces


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number; 0 for no hashes."""
    count = np.zeros(BITS, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        count += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_bits(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    return majority(shingle_hashes(text, shingle_words, seed))


def simhash(text: Column, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """The fingerprint of each text as a long."""

    ship_code()

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_bits(x, shingle_words, seed) for x in texts], dtype="int64")

    return of(text)


def segments(budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of the ring."""
    cuts = [bits * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(first: int, width: int) -> int:
    value = ((1 << width) - 1) << first
    return value - (1 << 64) if value >= 1 << 63 else value


def ring_keys(fp: Column, budget: int) -> Column:
    """The join keys of a fingerprint: (start, half, the start segment's bits and the successor's half's bits)."""
    parts, keys = segments(budget), []
    for i, (first, width) in enumerate(parts):
        f2, w2 = parts[(i + 1) % len(parts)]
        for half, (f, w) in enumerate(((f2, w2 // 2), (f2 + w2 // 2, w2 - w2 // 2))):
            if budget == 0 and half:
                continue
            keys.append(F.struct(F.lit(2 * i + half).alias("slot"), fp.bitwiseAND(F.lit(_mask(first, width) | _mask(f, w)).cast("long")).alias("value")))
    return F.array(*keys)


def chain_holds(diff: Column, start: Column, budget: int) -> Column:
    """True where from the segment ``start`` every chain stays within its share of the budget.  ``diff``: the differing bits."""
    parts = segments(budget)
    m, out = len(parts), None
    for i in range(m):
        upto, holds = 0, F.lit(True)
        for length in range(1, m + 1):
            upto |= _mask(*parts[(i + length - 1) % m]) & ((1 << 64) - 1)
            signed = upto - (1 << 64) if upto >= 1 << 63 else upto
            holds = holds & (F.bit_count(diff.bitwiseAND(F.lit(signed).cast("long"))) <= length * budget // m)
        out = F.when(start == i, holds) if out is None else out.when(start == i, holds)
    return out


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Distinct pairs (a < b) of distinct fingerprints ``fp`` that differ in at most ``budget`` bits."""
    keyed = prints.select("fp", F.explode(ring_keys(F.col("fp"), budget)).alias("k")).select("fp", "k.slot", "k.value")
    left, right = keyed.alias("l"), keyed.alias("r")
    diff = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    near = chain_holds(diff, F.floor(F.col("l.slot") / 2), budget) & (F.bit_count(diff) <= budget)
    met = (F.col("l.value") == F.col("r.value")) & (F.col("l.slot") == F.col("r.slot")) & (F.col("l.fp") < F.col("r.fp"))
    return left.join(right, met & near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it is connected to.

    Each round hangs every node's larger neighbours, then its smaller ones, to
    the smallest neighbour, and is checkpointed.  The rounds end when they
    change nothing, which the number of edges and a sum of their hashes show,
    after about log2 of the longest path.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = settle(small)
        before, state = state, _state(e)
        if before == state:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order; two 64-bit hashes, so that unequal ones differ."""
    bits = [F.bit_xor(F.xxhash64("u", "v", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)).alias("n"), *bits).first())


def classes(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, component_id) for the rows (doc_id, fp): the smallest doc_id reachable over links of at most ``budget`` bits."""
    least = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(links(least.select("fp"), budget))
    joined = least.join(tied, least["fp"] == tied["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, its fingerprint as 16 hex digits, and component_id."""
    prints = settle(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text), shingle_words, seed).alias("fp")))
    found = prints.join(classes(prints, budget), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
