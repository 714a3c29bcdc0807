"""The search that re-evaluates only what an edit changes, against the whole rule set on edited tables."""

import pytest
from conftest import box, model, room

from parapet.operators.normalise import normalise, validate
from parapet.operators import redo
from parapet.operators import repair as r
from parapet.plans import repair as plan
from parapet.plans.evaluate import evaluate
from parapet.session import cut_lineage
from parapet.sources.packs import read_packs
from parapet.sources.readers import read_models


def cases():
    fp, tall = box(0.5, 1.0, 11.0, 19.0), box(1.0, 3.0, 11.5, 17.5)
    rooms = [room(box(0.5, 1.0, 2.0, 19.0), "stair", 0, 0.0), room(box(2.0, 1.0, 11.0, 19.0), "bedroom", 0, 1.0)]
    low = [{**x, "floor": 1} for x in rooms]
    floors = [
        {"level": 0, "is_stilt": False, "footprint": fp, "height_m": 2.4, "rooms": rooms},
        {"level": 1, "is_stilt": False, "footprint": tall, "height_m": 3.0, "rooms": low},
        {"level": 1, "is_stilt": False, "footprint": fp, "height_m": None, "rooms": [room(fp, "kitchen", 1, 30.0)]},
        {"level": -1, "is_stilt": False, "footprint": box(0.0, 0.0, 12.5, 20.0), "height_m": 2.0, "rooms": []},
    ]
    proj = [{"type": "balcony", "floor": 1, "polygon": box(2, 0, 9, 2.5)}, {"type": "chajja", "floor": 0, "polygon": box(2, 0, 3, 0.5)}]
    court = [box(3, 3, 4, 4)]
    zone = box(1.5, 3.0, 11.0, 17.0)
    return [
        model(21, 12.5, 20.0, zone, floors, projections=proj, courtyards=court),
        model(22, 12.5, 20.0, zone, [{"level": 0, "is_stilt": False, "footprint": box(2.0, 3.5, 10.5, 17.2), "height_m": 3.2, "rooms": rooms}], projections=proj[:1]),
        model(23, 12.5, 20.0, None, [floors[0], {**floors[1], "is_stilt": True}], authority="CHANDIGARH"),
        model(24, 10.0, 30.0, zone, [{**floors[1], "footprint_is_upper_bound": True}], projections=proj),
    ]


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    import json

    folder = tmp_path_factory.mktemp("redo")
    for m in cases():
        (folder / f"{m['model_id']}.model.json").write_text(json.dumps(m))
    ok, _ = validate(read_models(spark, str(folder))[0])
    t = {k: cut_lineage(v) for k, v in normalise(ok).items()}
    rules = read_packs(spark)
    base = cut_lineage(evaluate(t, rules))
    return t, rules, base, base.filter("status = 'violation'")


def rows(df):
    return sorted((x.model_id, x.rule_id, x.cand_order, x.n_cleared, round(x.area_lost_sqm, 6)) for x in df.collect())


def test_incremental_search_equals_the_whole(searched):
    t, rules, base, v = searched
    cand = cut_lineage(r.edit_grid(v, t).withColumn("edit_id", redo.edit_id()))
    whole, edited = plan.evaluate_candidates(cand, t, rules)
    whole = cut_lineage(whole.select(*r.KEYS, "rule_id", "status"))

    # M9: the same candidates are accepted, with the same cost and number of rules cleared
    live = cand.join(edited["plots"].select(*r.KEYS), list(r.KEYS), "left_semi")
    want = r.accept(live, whole, base).join(r.area_lost(edited["floors"], t["floors"]), list(r.KEYS))
    found = plan.search(t, base, v, rules)
    assert rows(found) == rows(want)
    assert {x.op for x in cand.select("op").distinct().collect()} == set(redo.TOUCHES)
    assert {"shrink_wall", "trim_projection", "reclassify_room"} <= {x.op for x in found.select("op").distinct().collect()}

    # M8: what the whole finds of the kinds an edit touches and the part does not is a violation of the
    # unedited model; the part finds nothing that the whole does not
    edit = {(x.model_id, x.cand_seq): (x.edit_id, x.op) for x in cand.collect()}
    kinds = {x.rule_id: x.kind for x in rules.select("rule_id", "kind").distinct().collect()}
    by_whole, by_part, before = {}, {}, {}
    for x in whole.filter("status = 'violation'").collect():
        name, op = edit[x.model_id, x.cand_seq]
        if kinds[x.rule_id] in {k for ks in redo.TOUCHES[op] for k in ks}:
            by_whole.setdefault((x.model_id, name), set()).add(x.rule_id)
    for x in plan.reevaluated(t, base, v, rules).filter("status = 'violation'").collect():
        by_part.setdefault((x.model_id, x.edit_id), set()).add(x.rule_id)
    for x in v.select("model_id", "rule_id").distinct().collect():
        before.setdefault(x.model_id, set()).add(x.rule_id)
    for key in {*by_whole, *by_part}:
        assert by_part.get(key, set()) <= by_whole.get(key, set())
        assert by_whole.get(key, set()) - by_part.get(key, set()) <= before[key[0]]
