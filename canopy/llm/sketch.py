"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the ``k`` smallest distinct hashes of a set of shingles.  The
sketch of a union is made from the sketches of its parts; two sketches estimate
resemblance and containment, and one the number of distinct shingles.  With
fewer than ``k`` shingles all of these are exact.

Defined results: a text with fewer words than a shingle is one shingle of all
its words; one without words (null, empty, blank) has an empty sketch, which is
like another empty one (1.0) and unlike any other (0.0).  Equal texts have
equal sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.session import ship_code

K = 128
SHINGLE_WORDS = 5
SEED = 42
#: Documents between two boundaries of the successor search, and the most boundaries.
RUN_ROWS = 256
MOST_RUNS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """A hash for each run of ``shingle_words`` words; A-Z are lower-cased."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter((digest(w, seed) for w in found), dtype=np.uint64, count=len(found))
    k = min(shingle_words, len(h))
    if not k:
        return h
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = _mix(total) + h[i : len(h) - k + 1 + i]  # order matters: what came before is scrambled
    return _mix(total)


@dataclass(frozen=True)
class Sketch:
    """The smallest distinct hashes, ascending."""

    hashes: np.ndarray
    k: int = K

    @classmethod
    def of(cls, hashes: np.ndarray, k: int = K) -> Sketch:
        return cls(np.unique(hashes)[:k], k)

    @classmethod
    def of_text(cls, text: str | None, k: int = K, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> Sketch:
        return cls.of(shingle_hashes(text, shingle_words, seed), k)

    def merge(self, other: Sketch) -> Sketch:
        return Sketch.of(np.concatenate([self.hashes, other.hashes]), min(self.k, other.k))

    def resemblance(self, other: Sketch) -> float:
        """Shared shingles as a share of those in either."""
        both = self.merge(other).hashes
        if not len(both):
            return 1.0
        shared = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return float(np.isin(both, shared, assume_unique=True).sum() / len(both))

    def distinct(self) -> float:
        """The number of distinct shingles."""
        return float(len(self.hashes)) if len(self.hashes) < self.k else (self.k - 1) / (float(self.hashes[-1]) / 2.0**64)

    def containment(self, other: Sketch) -> float:
        """Shared shingles as a share of this sketch's own."""
        own = self.distinct()
        return min(1.0, self.resemblance(other) * self.merge(other).distinct() / own) if own else 1.0

    def text(self) -> str:
        return base64.b64encode(self.hashes.astype(">u8").tobytes()).decode()

    @classmethod
    def parse(cls, text: str, k: int = K) -> Sketch:
        return cls(np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64), k)


def edited(text: str, after: str) -> str:
    """The last half of ``text``, rounded down, replaced by as many characters of ``after`` as there are."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def runs(docs: DataFrame, doc_id: str, rows: int = RUN_ROWS, most: int = MOST_RUNS) -> list[int]:
    """Ids that cut the table into runs of about ``rows`` documents (more where ``most`` runs would not do), the smallest id first.

    Every eighth of the ids that a hash picks, so that the runs are of similar length; at most 8 ``most`` ids come to the driver.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("id")).where("id IS NOT NULL")
    shape = ids.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).first()
    if not shape["n"]:
        return [0]
    step = max(1, max(rows, shape["n"] // most) // 8)
    picked = ids.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).distinct()
    found = np.sort(picked.toArrow().column(0).to_numpy())
    return np.unique(np.append(found[7::8], shape["least"])).tolist()


def with_successor(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows (run, extra, doc_id, text), partitioned by run and sorted, in which each document is followed by its successor.

    The order is by ascending id, null first, then text.  The first documents of
    a run come again as ``extra`` at the end of the run before; the first of all
    come at the end of the last run.  One shuffle; no task gets more than its runs.
    """
    ship_code(docs.sparkSession)
    starts = np.array(runs(docs, doc_id, run_rows), dtype=np.int64)

    @F.arrow_udf("run int, first boolean")
    def place(ids: pa.Array) -> pa.Array:
        known = np.asarray(ids.is_valid())
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.maximum(np.searchsorted(starts, values, side="right") - 1, 0)
        at = np.where(known, at, 0).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(at), pa.array((starts[at] == values) | ~known)], names=["run", "first"])

    n = len(starts)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("at", place("doc_id"))
    own = F.struct(F.col("at.run").alias("run"), F.lit(False).alias("extra"))
    again = F.struct(F.pmod(F.col("at.run") - 1, F.lit(n)).alias("run"), F.lit(True).alias("extra"))
    rows = rows.withColumn("put", F.explode(F.when(F.col("at.first"), F.array(own, again)).otherwise(F.array(own))))
    rows = rows.select("put.run", "put.extra", "doc_id", "text")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(min(n, width), F.col("run") % min(n, width)).sortWithinPartitions("run", "extra", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, run_rows: int = RUN_ROWS) -> DataFrame:
    """Per row: its sketch, that of its edited text, and its likeness to that and to its successor.

    A task holds one document and its successor at a time.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            out: list[tuple] = []
            for where, extra, name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                t = t.as_py() or ""
                if held and held[0] == where and held[1] and extra:
                    continue  # only the first of the extra rows is a successor
                own = Sketch.of_text(t, k, shingle_words, seed)
                if held and held[0] == where and not held[1]:
                    changed = edited(held[3], t)
                    other = Sketch.of_text(changed, k, shingle_words, seed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[2], len(held[3]), digest, held[4].text(), other.text(), held[4].resemblance(other), held[4].resemblance(own)))
                held = (where, extra, name, t, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*out, strict=True))], names=names)

    return with_successor(docs, doc_id, text, run_rows).mapInArrow(run, schema)
