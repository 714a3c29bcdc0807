"""Convex hull of many points per key, in two levels.

Each task first keeps only the hull of the points it holds per key, so a key with a third of all
points reaches the second level as a few hundred corner points, not as its whole group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Points = list[tuple[float, float]]


def _hull(points: Iterable[tuple[float, float]]) -> Points:
    """Monotone chain, counter-clockwise, collinear points dropped."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq: Points) -> Points:
        out: Points = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def hull(points: DataFrame, key: str) -> DataFrame:
    """``points(key, x, y)`` -> hull corners ``(key, pos, x, y)``, counter-clockwise.

    Groups are formed by Spark and reach Python as lists of a batch, not one call per key.
    """
    kt = dict(points.dtypes)[key]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict = {}
            for k, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault(k, []).append((x, y))
            rows = [(k, *p) for k, g in groups.items() for p in _hull(g)]
            cols = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, batch.schema.types)], [key, "x", "y"])

    def corners(of: pa.Array) -> pa.Array:
        return pa.array([[{"x": x, "y": y} for x, y in _hull((p["x"], p["y"]) for p in g)] for g in of.to_pylist()], of.type)

    named = points.select(key, F.col("x").cast("double"), F.col("y").cast("double")).filter("x is not null and y is not null")
    partial = named.mapInArrow(local, f"{key} {kt}, x double, y double")
    whole = partial.groupBy(key).agg(F.collect_list(F.struct("x", "y")).alias("p"))
    ring = F.arrow_udf(corners, "array<struct<x:double,y:double>>")
    return whole.select(key, F.posexplode(ring("p")).alias("pos", "p")).select(key, "pos", "p.x", "p.y")


def box_corners(boxes: DataFrame, key: str) -> DataFrame:
    """Corner points of ``boxes(key, x0, y0, x1, y1)``."""
    c = ", ".join(f"named_struct('x', cast({x} as double), 'y', cast({y} as double))" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))
    return boxes.selectExpr(key, f"inline(array({c}))")
