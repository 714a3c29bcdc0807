"""From nested building-model documents to flat tables (A2, A3, A5) and measured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet import schemas as S
from parapet.functions import geometry as g


def _bad(cond: Column, reason: str) -> Column:
    return F.when(cond, F.lit(reason))


def _outside(col: Column, domain) -> Column:
    return col.isNull() | ~col.isin(*domain)


def _any(arr, ddl, pred) -> Column:
    return F.exists(F.coalesce(arr, F.array().cast(ddl)), pred)


def model_problems() -> Column:
    """Reasons a nested model is invalid; an empty array means valid."""

    def edges(pred):
        return _any(F.col("edges"), S.EDGES, pred)

    def floors(pred):
        return _any(F.col("floors"), S.FLOORS, pred)

    def rooms(pred):
        return floors(lambda f: _any(f["rooms"], S.ROOMS, pred))

    checks = [
        _bad(_outside(F.col("source"), S.SOURCES), "source"),
        _bad(F.col("jurisdiction").isNull(), "jurisdiction"),
        _bad(_outside(F.col("jurisdiction.authority"), S.AUTHORITIES), "jurisdiction.authority"),
        _bad(F.col("jurisdiction.rule_pack").isNull(), "jurisdiction.rule_pack"),
        _bad(edges(lambda e: _outside(e["role"], S.EDGE_ROLES) | e["line"].isNull() | e["faces_road"].isNull()), "edges"),
        _bad(floors(lambda f: f["level"].isNull() | f["is_stilt"].isNull() | f["footprint"].isNull()), "floors"),
        _bad(rooms(lambda r: _outside(r["use"], S.ROOM_USES)), "rooms.use"),
        _bad(rooms(lambda r: _outside(r["confidence"], S.CONFIDENCES)), "rooms.confidence"),
        _bad(
            rooms(lambda r: r["polygon"].isNull() | r["floor"].isNull() | r["openings_area_sqm"].isNull()),
            "rooms.required",
        ),
    ]
    return F.array_compact(F.array(*checks))


def validate(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2 on nested models: ``(ok, bad)``; ``bad`` carries ``reasons``."""
    tagged = models.withColumn("reasons", model_problems())
    return tagged.filter(F.size("reasons") == 0).drop("reasons"), tagged.filter(F.size("reasons") > 0)


def validate_rows(df: DataFrame, domains: dict[str, tuple], required: tuple = ()) -> DataFrame:
    """A2 on a flat table: every row with a ``reasons`` array (empty when valid)."""
    checks = [_bad(_outside(F.col(c), d), c) for c, d in domains.items()]
    checks += [_bad(F.col(c).isNull(), c) for c in required]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def normalise(models: DataFrame) -> dict[str, DataFrame]:
    """A3: one row per nested model -> plots, edges, floors, rooms, projections, courtyards.

    List positions are kept, since several checks take the first match in list order. All outputs
    are narrow: no shuffle.
    """
    m = models
    plots = m.select(
        "model_id",
        "source",
        "jurisdiction.authority",
        "jurisdiction.sector",
        "jurisdiction.plot_no",
        "jurisdiction.allotment_date",
        "jurisdiction.rule_pack",
        F.expr(g.from_pairs("plot_polygon")).alias("plot_polygon"),
        "plot_area_sqm",
        F.expr(g.from_pairs("zoned_area")).alias("zoned_area"),
        "mumty",
        F.coalesce("has_rwh", F.lit(False)).alias("has_rwh"),
        F.coalesce("tree_count", F.lit(0)).alias("tree_count"),
        F.coalesce("assumptions", F.array().cast("array<string>")).alias("assumptions"),
    )
    edges = m.select("model_id", F.posexplode("edges").alias("edge_pos", "e")).select(
        "model_id",
        "edge_pos",
        "e.role",
        F.expr(g.from_pairs("e.line")).alias("line"),
        "e.faces_road",
        "e.road_width_m",
    )
    fl = m.select("model_id", F.posexplode("floors").alias("floor_pos", "f"))
    floors = fl.select(
        "model_id",
        "floor_pos",
        "f.level",
        "f.is_stilt",
        F.expr(g.from_pairs("f.footprint")).alias("footprint"),
        "f.height_m",
        F.coalesce("f.footprint_is_upper_bound", F.lit(False)).alias("footprint_is_upper_bound"),
    )
    rooms = fl.select("model_id", "floor_pos", "f.level", F.posexplode("f.rooms").alias("room_index", "r")).select(
        "model_id",
        "floor_pos",
        "level",
        "room_index",
        "r.use",
        F.expr(g.from_pairs("r.polygon")).alias("polygon"),
        "r.openings_area_sqm",
        "r.confidence",
    )
    projections = m.select("model_id", F.posexplode("projections").alias("pos", "p")).select(
        "model_id", "pos", "p.type", "p.floor", F.expr(g.from_pairs("p.polygon")).alias("polygon")
    )
    courtyards = m.select("model_id", F.posexplode("courtyards").alias("pos", "c")).select(
        "model_id", "pos", F.expr(g.from_pairs("c")).alias("ring")
    )
    return {
        "plots": plots,
        "edges": edges,
        "floors": floors,
        "rooms": rooms,
        "projections": projections,
        "courtyards": courtyards,
    }


def resolve_pack(plots: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: attach ``pack`` to each plot: its named pack, else the only pack there is.

    Returns ``(resolved, unresolved)``. The pack list is one row per pack, so it is broadcast.
    """
    packs = rules.select("rule_pack").distinct()
    names = F.broadcast(packs.agg(F.collect_set("rule_pack").alias("packs")))
    tagged = plots.crossJoin(names).withColumn(
        "pack",
        F.when(F.array_contains("packs", F.col("rule_pack")), F.col("rule_pack")).when(
            F.size("packs") == 1, F.element_at("packs", 1)
        ),
    ).drop("packs")
    return tagged.filter("pack is not null"), tagged.filter("pack is null")


def measure_floors(floors: DataFrame) -> DataFrame:
    """Floors with ``area`` and ``b`` (bounds) computed once."""
    return floors.withColumn("area", F.expr(g.area("footprint"))).withColumn("b", F.expr(g.bounds("footprint")))


def measure_rings(df: DataFrame, ring: str) -> DataFrame:
    """Any ring table with ``area``, ``b`` and ``short_side`` computed once."""
    return (
        df.withColumn("area", F.expr(g.area(ring)))
        .withColumn("b", F.expr(g.bounds(ring)))
        .withColumn("short_side", F.expr(g.mrr_short(ring, "b", "area")))
    )
