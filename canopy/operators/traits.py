"""Directions of stems and organs, and the (angle, internode) sequences that follow from them.

A scan's tree or stem is solved whole in a grouped function; the sequence over
its organs is a window (``sequences.divergence``) where it comes from a tree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.graph import Adjacency, adjacency, hops
from canopy.operators.groups import per_group
from canopy.session import ship_code


def main_direction(points: np.ndarray, origin: np.ndarray | None = None) -> np.ndarray:
    """The unit vector along which points spread most about their mean or an origin."""
    centred = points - (points.mean(axis=0) if origin is None else origin)
    return np.linalg.svd(centred, full_matrices=False)[2][0]


def towards(reference: np.ndarray, v: np.ndarray) -> np.ndarray:
    return -v if v @ reference < 0 else v


def on_line(points: np.ndarray, direction: np.ndarray, through: np.ndarray) -> np.ndarray:
    """Points projected on a line."""
    return ((points - through) @ direction)[..., None] * direction + through


def within(at: dict[int, np.ndarray], nodes: Sequence[int], most: float) -> list[int]:
    """The first nodes of a path, up to the length ``most``."""
    kept, length = [], 0.0
    for k, n in enumerate(nodes):
        if k:
            length += float(np.linalg.norm(at[n] - at[nodes[k - 1]]))
        if length > most:
            break
        kept.append(n)
    return kept


def fruit_paths(g: Adjacency, at: dict[int, np.ndarray], fruit: set[int], start: int, most: float, least: float) -> list[list[int]]:
    """The parts of a fruit at a branching point, each ordered by hops from it; parts shorter than ``least`` are left out, the others end at ``most``.  The branching point comes first."""
    left, parts = set(fruit), []
    while left:
        seed = min(left)
        part = {seed, *(n for n in hops({a: {b: w for b, w in g[a].items() if b in fruit} for a in fruit}, seed))}
        left -= part
        inside = {a: {b: w for b, w in g[a].items() if b in part or b == start} for a in (*part, start)}
        reach = hops(inside, start)
        parts.append([start, *sorted(reach, key=lambda n: (reach[n], n))])
    length = lambda p: sum(float(np.linalg.norm(at[b] - at[a])) for a, b in zip(p, p[1:], strict=False))
    return [within(at, p, most) for p in parts if len(p) > 1 and length(p) >= least]


class Node(NamedTuple):
    """A node of a labelled tree."""

    id: int
    x: float
    y: float
    z: float
    labels: str | None
    fruit_id: int | None
    main_stem_id: int | None


def _parts(nodes: Sequence[Node]) -> tuple[dict[int, np.ndarray], list[int], list[Node], dict[int | None, list[int]]]:
    """Places of nodes, the stem in order, the branching points in order, and the nodes of each fruit by id."""
    at = {n.id: np.array([n.x, n.y, n.z]) for n in nodes}
    stem = [n.id for n in sorted((n for n in nodes if n.main_stem_id is not None), key=lambda n: n.main_stem_id)]
    branching = sorted((n for n in nodes if "node" in (n.labels or "") and n.fruit_id is not None), key=lambda n: n.fruit_id)
    fruits: dict[int | None, list[int]] = {}
    for n in sorted(nodes):
        if "fruit" in (n.labels or ""):
            fruits.setdefault(n.fruit_id, []).append(n.id)
    return at, stem, branching, fruits


def tree_directions(nodes: Sequence[Node], edges: Sequence[tuple[int, int]], most: float = 10.0, least: float = 10.0) -> list[tuple]:
    """For each fruit part: organ, its direction f, the stem's direction s, and the branching point b on the stem's line."""
    at, stem, branching, fruits = _parts(nodes)
    g = adjacency([(a, b, 1.0) for a, b in edges])
    place = {n: k for k, n in enumerate(stem)}
    rows: list[tuple] = []
    for b in branching:
        paths = fruit_paths(g, at, set(fruits.get(b.fruit_id, ())), b.id, most, least)
        if not paths:
            continue
        k = place[b.id]
        before = within(at, stem[:k][::-1], most)[::-1]
        points = np.array([at[n] for n in [*before, b.id, *within(at, stem[k:], most)]])  # the branching point counts twice
        if (points == points[0]).all():
            continue
        line = main_direction(points)
        flat = on_line(points, line, points.mean(axis=0))
        foot = on_line(at[b.id], line, flat.mean(axis=0))
        s = towards(flat[-1] - foot, main_direction(flat, foot))
        for path in paths:
            p = np.array([at[n] for n in path])
            rows.append((len(rows), *towards(p[-1] - foot, main_direction(p, foot)).tolist(), *s.tolist(), *foot.tolist()))
    return rows


def plane_directions(nodes: Sequence[Node], n_fruit: int = 5, n_stem: int = 5) -> list[tuple]:
    """The older way, from numbers of nodes: organ and stem directions within the plane fitted to the first ``n_fruit`` nodes of the fruit, by id, and ``n_stem // 2`` stem nodes on either side.

    The organ's direction leads from the branching point to the fruit's mean;
    the stem's is what is left of the plane's second axis, towards the next
    branching point.  The last branching point only serves as the next one.
    """
    at, stem, branching, fruits = _parts(nodes)
    place = {n: k for k, n in enumerate(stem)}
    rows: list[tuple] = []
    for b, after in zip(branching, branching[1:], strict=False):
        own = np.array([at[i] for i in fruits.get(b.fruit_id, ())])
        if len(own) < 2:
            continue
        k, half = place[b.id], n_stem // 2
        plane = np.vstack([own[:n_fruit], *[at[i][None] for i in stem[max(0, k - half) : k + half]]])
        u, v = np.linalg.svd(plane - plane.mean(axis=0), full_matrices=False)[2][:2]
        lean = own.mean(axis=0) - at[b.id]
        f = (lean @ u) * u + (lean @ v) * v
        size = np.linalg.norm(f)
        if not size:
            continue
        f = f / size
        s = towards(at[after.id] - at[b.id], v - (v @ f) * f)
        rows.append((len(rows), *f.tolist(), *s.tolist(), *at[b.id].tolist()))
    return rows


def directions(nodes: DataFrame, edges: DataFrame, by: Sequence[str], most: float = 10.0, least: float = 10.0, planes: bool = False) -> DataFrame:
    """``tree_directions`` of every labelled tree (or ``plane_directions``): nodes (by, id, x, y, z, labels, fruit_id, main_stem_id) and edges (by, src, dst)."""
    n = nodes.select(*by, F.lit(True).alias("is_node"), *[F.col(c).cast("long") for c in ("id", "fruit_id", "main_stem_id")], *[F.col(c).cast("double") for c in "xyz"], "labels")
    e = edges.select(*by, F.lit(False).alias("is_node"), F.col("src").cast("long").alias("id"), F.col("dst").cast("long").alias("fruit_id"))

    def solve(is_node, ids, fruit_ids, stem_ids, x, y, z, labels):
        own = [Node(*r) for k, *r in zip(is_node, ids, x, y, z, labels, fruit_ids, stem_ids, strict=True) if k]
        ends = [(a, b) for k, a, b in zip(is_node, ids, fruit_ids, strict=True) if not k]
        return plane_directions(own) if planes else tree_directions(own, ends, most, least)

    schema = ", ".join(["organ long"] + [f"{a}{x} double" for a in "fsb" for x in "xyz"])
    return per_group(n.unionByName(e, allowMissingColumns=True), by, solve, schema)


def stem_skeleton(points: np.ndarray, axis: int, step: float, k: int = 300, inverted: bool = False) -> np.ndarray:
    """Means of the ``k`` stem points nearest to a point that moves up an axis, unique, in order of the distance to the first."""
    at = points[points[:, axis].argmin()].copy()
    means = []
    for level in np.arange(points[:, axis].min(), points[:, axis].max(), step):
        at[axis] = level
        near = np.argsort(((points - at) ** 2).sum(axis=1), kind="stable")[:k]
        at = points[near].mean(axis=0)
        means.append(at.copy())
    if not means:
        return points.mean(axis=0, keepdims=True)
    unique = np.unique(np.array(means), axis=0)
    order = np.argsort(np.linalg.norm(unique - means[0], axis=1), kind="stable")
    return unique[order[::-1] if inverted else order]


def organ_features(points: np.ndarray, skeleton: np.ndarray) -> tuple[int, np.ndarray, float]:
    """The skeleton node nearest to an organ's base, the vector from base to tip, and the organ's width; from the box along its principal axes."""
    centre = points.mean(axis=0)
    axes = np.linalg.svd(points - centre, full_matrices=False)[2]
    inside = (points - centre) @ axes.T
    low, high = inside.min(axis=0), inside.max(axis=0)
    middle = (low + high) / 2
    ends = [centre + np.array([v, *middle[1:]]) @ axes for v in (low[0], high[0])]
    far = [np.linalg.norm(skeleton - e, axis=1) for e in ends]
    base = 0 if far[0].min() <= far[1].min() else 1
    return int(far[base].argmin()), ends[1 - base] - ends[base], float(high[1] - low[1]) if len(low) > 1 else 0.0


def organ_sequence(stem: np.ndarray, organs: Sequence[np.ndarray], axis: int = 2, step: float = 1.0, inverted: bool = False, min_size: float = 6.0, min_elongation: float = 2.0, k: int = 300) -> list[tuple[float, float]]:
    """(angle in radians, internode) between successive organs, anticlockwise, with the complement where the median is over half a turn."""
    skeleton = stem_skeleton(stem, axis, step, k, inverted)
    found = [organ_features(o, skeleton) for o in organs if len(o) > 1]
    kept = sorted((f for f in found if np.linalg.norm(f[1]) > min_size and f[2] > 0 and np.linalg.norm(f[1]) / f[2] > min_elongation), key=lambda f: f[0])
    out = []
    for (i, u, _), (j, v, _) in zip(kept, kept[1:], strict=False):
        if i != j:
            n = skeleton[j] - skeleton[i]
        elif i == len(skeleton) - 1:
            n = skeleton[i] - skeleton[i - 1]
        else:
            n = skeleton[i + 1] - skeleton[i]
        size = np.linalg.norm(n)
        n = n / size if size else np.eye(3)[axis]
        p, q = u - (u @ n) * n, v - (v @ n) * n
        p, q = p / (np.linalg.norm(p) or 1), q / (np.linalg.norm(q) or 1)
        out.append((math.atan2(np.cross(q, p) @ n, p @ q) % (2 * math.pi), float(np.linalg.norm(skeleton[j] - skeleton[i]))))
    if out and np.median([a for a, _ in out]) > math.pi:
        out = [(2 * math.pi - a, d) for a, d in out]
    return out


def organ_sequences(points: DataFrame, by: Sequence[str], stem_label: str = "stem", **params) -> DataFrame:
    """``organ_sequence`` of each scan's labelled points (by, organ, label, x, y, z): by, pos, angle, internode and their unit."""
    names, kinds = list(by), dict(points.dtypes)
    ship_code(points.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = lambda d: d[["x", "y", "z"]].to_numpy(dtype=float)
        is_stem = pdf["label"] == stem_label
        organs = [xyz(d) for _, d in pdf[~is_stem].sort_values("organ", kind="stable").groupby("organ")]
        rows = organ_sequence(xyz(pdf[is_stem]), organs, **params) if is_stem.any() else []
        out = pd.DataFrame([(i, a, d, "radian") for i, (a, d) in enumerate(rows)], columns=["pos", "angle", "internode", "unit"])
        for n in reversed(names):
            out.insert(0, n, pdf[n].iloc[0])
        return out

    schema = ", ".join([f"{n} {kinds[n]}" for n in names] + ["pos long, angle double, internode double, unit string"])
    return points.groupBy(*names).applyInPandas(run, schema)


def long_organs(organs: DataFrame, min_size: float, min_elongation: float, length: str = "length", width: str = "width") -> DataFrame:
    """Organs that are longer than a size and more elongated than a ratio."""
    return organs.where((F.col(length) > min_size) & (F.try_divide(F.col(length), F.col(width)) > min_elongation))


def ends_of_segments(edges: DataFrame, nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each edge as a segment x0 ... z1, for drawing."""
    end = lambda name, k: nodes.select(*by, F.col("id").alias(name), *[F.col(a).alias(f"{a}{k}") for a in "xyz"])
    return edges.join(end("src", 0), [*by, "src"]).join(end("dst", 1), [*by, "dst"])
