"""Confirmations, mutations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.session import spread

# Axis and direction of each named edge.
EDGE_AXES = {"north": ("y", 1), "south": ("y", -1), "east": ("x", 1), "west": ("x", -1)}


def needs_confirmation(rooms: DataFrame) -> DataFrame:
    """Rooms still to confirm, counted per model."""
    return rooms.groupBy("model_id").agg(F.count_if(F.col("confidence") == "low").alias("n_low"))


def auto_confirm(rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every room high; per model the number changed, for the assumptions note."""
    note = rooms.groupBy("model_id").agg(F.count_if(F.col("confidence") != "high").alias("n_auto")).filter("n_auto > 0")
    return rooms.withColumn("confidence", F.lit("high")), note


def confirm(rooms: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrected rooms, corrections without a room). The last correction of a room wins; an empty
    confidence means confirmed."""
    key = ["model_id", "level", "room_index"]
    c = corrections.withColumnRenamed("floor_level", "level")
    last = c.groupBy(*key).agg(F.max_by(F.struct("use", "confidence"), "seq").alias("c"))
    # A later correction without a use keeps the last use given.
    uses = c.filter("use is not null").groupBy(*key).agg(F.max_by("use", "seq").alias("c_use"))
    j = rooms.join(spread(last), key, "left").join(spread(uses), key, "left")
    out = j.withColumn("use", F.coalesce("c_use", "use")).withColumn(
        "confidence", F.expr("case when c is not null then coalesce(c.confidence, 'high') else confidence end")
    ).drop("c", "c_use")
    return out, corrections.join(spread(rooms.selectExpr("model_id", "level as floor_level", "room_index")), ["model_id", "floor_level", "room_index"], "left_anti")


def offset_edge(ring: str, edge: str, delta: str) -> str:
    """Push one side of a rectangle outward; N2 is the same with a negative delta."""
    axis, sign = EDGE_AXES[edge]
    coords = f"transform({ring}, np -> np.{axis})"
    extreme = f"array_max({coords})" if sign > 0 else f"array_min({coords})"
    moved = f"np.{axis} {'+' if sign > 0 else '-'} {delta}"
    x, y = (moved, "np.y") if axis == "x" else ("np.x", moved)
    return f"transform({ring}, np -> case when abs(np.{axis} - {extreme}) < 1e-6D then named_struct('x', {x}, 'y', {y}) else np end)"


def check_rectangles(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layers fit for mutation, failures with a reason). ``rings(sheet, layer, closed, points)``."""
    pts = "array_distinct(transform(points, rp -> named_struct('x', round(rp.x, 6), 'y', round(rp.y, 6))))"
    x = rings.filter("closed").withColumn("p", F.expr(pts)).selectExpr(
        "sheet", "layer", "points",
        "size(p) = 4 and size(array_distinct(transform(p, rq -> rq.x))) = 2 and size(array_distinct(transform(p, rq -> rq.y))) = 2 as rect",
    )
    a = x.groupBy("sheet", "layer").agg(F.count("*").alias("n"), F.first("points").alias("points"), F.bool_and("rect").alias("rect"))
    none = rings.select("sheet", "layer").distinct().join(spread(a.select("sheet", "layer")), ["sheet", "layer"], "left_anti")
    good = a.filter("n = 1 and rect").select("sheet", "layer", "points")
    bad = a.filter("n > 1 or not rect").selectExpr("sheet", "layer", "case when n > 1 then 'several closed rings' else 'not a rectangle' end as reason")
    return good, bad.unionByName(none.withColumn("reason", F.lit("no closed ring")))


def mutation_truth(rings: DataFrame, op: str, edge: str, delta: float, provenance: str = "synthetic") -> DataFrame:
    """Exact before / after facts. ``rings(case_id, points)``."""
    axis, sign = EDGE_AXES[edge]
    pick = "array_max" if sign > 0 else "array_min"
    d = delta if op == "offset_edge" else -delta
    x = rings.withColumn("after", F.expr(offset_edge("points", edge, f"({d!r}D)")))
    return x.selectExpr(
        "case_id", f"'{provenance}' as provenance", f"named_struct('op', '{op}', 'edge', '{edge}', 'delta_m', {delta!r}D) as mutation",
        "points as before_polygon", "after as after_polygon",
        f"{pick}(transform(points, tp -> tp.{axis})) as edge_before", f"{pick}(transform(after, tp -> tp.{axis})) as edge_after",
        f"{g.area('points')} as area_before", f"{g.area('after')} as area_after",
    ).withColumn("area_delta", F.expr("area_after - area_before"))


def eval_metrics(pred: DataFrame) -> DataFrame:
    """F16: counts, precision and recall per provenance, never pooled. ``pred(provenance, truth, predicted)``."""
    a = pred.groupBy("provenance").agg(
        F.count_if(F.expr("truth and predicted")).alias("tp"),
        F.count_if(F.expr("not truth and predicted")).alias("fp"),
        F.count_if(F.expr("truth and not predicted")).alias("fn"),
    )
    return a.withColumn("precision", F.expr("case when tp + fp > 0 then tp / (tp + fp) end")).withColumn("recall", F.expr("case when tp + fn > 0 then tp / (tp + fn) end"))


def evaluate_by_provenance(pred: DataFrame) -> DataFrame:
    """F16 plus a flag that says no real case stands behind the figures."""
    m = eval_metrics(pred)
    real = pred.agg(F.expr("count_if(provenance in ('real', 'mutated_real')) = 0").alias("no_real_cases"))
    return m.crossJoin(F.broadcast(real))
