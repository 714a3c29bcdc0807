"""Point in layer (C11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.session import spread

CELL = 16.0


def _cells(lo: str, hi: str) -> str:
    return f"sequence(cast(floor({lo} / {CELL}D) as bigint), cast(floor({hi} / {CELL}D) as bigint))"


def candidates(points: DataFrame, features: DataFrame) -> DataFrame:
    """Points with the features whose bounds hold them: an equi-join on grid cells, then the box."""
    f = features.withColumn("fb", F.expr(g.bounds("ring"))).filter("fb is not null")
    f = f.select("*", F.expr(f"explode({_cells('fb.xmin', 'fb.xmax')})").alias("_cx")).select(
        "*", F.expr(f"explode({_cells('fb.ymin', 'fb.ymax')})").alias("_cy")
    )
    p = points.withColumn("_cx", F.expr(f"cast(floor(px / {CELL}D) as bigint)")).withColumn(
        "_cy", F.expr(f"cast(floor(py / {CELL}D) as bigint)")
    )
    box = "px >= fb.xmin and px <= fb.xmax and py >= fb.ymin and py <= fb.ymax"
    return p.join(f, ["_cx", "_cy"]).filter(box).drop("_cx", "_cy", "fb")


def point_in_layer(points: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """First matching feature per point; the layers are placeholders, so confidence is always low."""
    hits = (
        candidates(points, features)
        .filter(g.pip("px", "py", "ring"))
        .groupBy(key)
        .agg(F.min_by(F.struct("pos", "props"), "pos").alias("hit"))
    )
    return points.join(spread(hits), key, "left").select(
        key, F.col("hit").isNotNull().alias("inside"), "hit.pos", "hit.props", F.lit("low").alias("confidence")
    )
