"""Confusion counts and what follows from them.

Counts of files add up; the intersection over union is the mean over files whose
union isn't empty; precision and recall are null where nothing can be divided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.raster import cross_dilate
from canopy.operators.spatial import knn_join

COUNTS = ("tp", "fn", "tn", "fp")


def confusion(truth: Column, prediction: Column) -> list[Column]:
    """tp, fn, tn, fp of two values that count as set where they aren't zero."""
    t, p = truth != 0, prediction != 0
    return [F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp")]


def ratio(top: Column, *rest: Column) -> Column:
    whole = top
    for r in rest:
        whole = whole + r
    return F.try_divide(top, whole)


def per_file(pixels: DataFrame, keys: Sequence[str], truth: str = "gt", prediction: str = "pred") -> DataFrame:
    c = pixels.groupBy(*keys).agg(*confusion(F.col(truth), F.col(prediction)))
    return c.withColumns({"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn")), "iou": ratio(F.col("tp"), F.col("fp"), F.col("fn"))})


def compare_masks(truth: DataFrame, prediction: DataFrame, keys: Sequence[str], dilation: int = 0, value: str = "value") -> DataFrame:
    """``per_file`` of two tables of pixels (keys, u, v, value), the prediction dilated ``dilation`` times by its 4 neighbours.

    A file that either side lacks, or whose pixels aren't at the same places on both
    sides, is an error that names it.  Values that aren't 0 count as set, without
    dilation negative ones too; a dilation takes only positive ones, as it makes a mask first.
    """
    at = [*keys, "u", "v"]
    p = cross_dilate(prediction, dilation, keys, value) if dilation else prediction
    both = truth.select(*at, F.col(value).alias("gt")).join(p.select(*at, F.col(value).alias("pred")), at, "full")
    odd = both.where("gt IS NULL OR pred IS NULL").select(*keys).distinct().limit(5).collect()
    if odd:
        raise ValueError(f"the masks have different shapes in {[tuple(r) for r in odd]}")
    return per_file(both, keys)


def merged(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sums of counts over files, with precision, recall and the mean IoU."""
    iou = ratio(F.col("tp"), F.col("fp"), F.col("fn"))
    out = files.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS], F.avg(iou).alias("miou"))
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn"))})


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of the left side that don't have exactly one match, with the number of matches."""
    n = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    return left.select(*keys).distinct().join(n, list(keys), "left").withColumn("matches", F.coalesce("matches", F.lit(0))).where("matches <> 1")


def require_matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    missing = unmatched(left, right, keys).limit(5).collect()
    if missing:
        raise ValueError(f"no single match for {[tuple(r) for r in missing]}")


def nearest_label_counts(source: DataFrame, target: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label, within the groups ``by``: tp, fp, fn, tn of source points against the label of their nearest target point.

    ``fp`` counts sources with the label whose nearest target has another.  The
    points are first counted by their pair of labels; a label's counts are sums
    over these.
    """
    near = knn_join(source, target, 1, by).groupBy(*by, F.col("label").alias("own"), F.col("t_label").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    same = F.coalesce(F.sum(F.when(F.col("own") == F.col("other"), F.col("n"))), F.lit(0))
    own = near.groupBy(*by, F.col("own").alias("label")).agg(F.sum("n").alias("has"), same.alias("both"))
    other = near.groupBy(*by, F.col("other").alias("label")).agg(F.sum("n").alias("gets"))
    total = near.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = labels.join(own, [*by, "label"], "left").join(other, [*by, "label"], "left")
    rows = rows.join(total, list(by), "left") if by else rows.join(F.broadcast(total))  # one row
    tp, fp, fn = zero("both"), zero("has") - zero("both"), zero("gets") - zero("both")
    return rows.select(*by, "label", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (zero("total") - tp - fp - fn).alias("tn"))


def labelled_iou(truth: DataFrame, prediction: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label of the truth, within the groups ``by``: IoU in either direction and their mean, null if either is."""
    labels = truth.select(*by, "label").distinct()
    iou = ratio(F.col("tp"), F.col("fp"), F.col("fn"))
    there = nearest_label_counts(truth, prediction, labels, by).select(*by, "label", *[F.col(c).alias(c) for c in COUNTS], iou.alias("iou_there"))
    back = nearest_label_counts(prediction, truth, labels, by).select(*by, "label", iou.alias("iou_back"))
    return there.join(back, [*by, "label"]).withColumn("miou", (F.col("iou_there") + F.col("iou_back")) / 2)
