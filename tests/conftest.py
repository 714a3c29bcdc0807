import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from parapet.session import local_session

    s = local_session("4", memory="6g", partitions=4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


def box(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def edges(w, l):
    return [
        {"line": [[0, 0], [w, 0]], "faces_road": True, "road_width_m": 12.0, "role": "front"},
        {"line": [[0, l], [w, l]], "faces_road": False, "road_width_m": None, "role": "rear"},
        {"line": [[0, 0], [0, l]], "faces_road": False, "road_width_m": None, "role": "side_a"},
        {"line": [[w, 0], [w, l]], "faces_road": False, "road_width_m": None, "role": "side_b"},
    ]


def room(ring, use, floor, openings):
    return {"polygon": ring, "use": use, "floor": floor, "openings_area_sqm": openings, "confidence": "high"}


def model(model_id, w, l, zone, floors, authority="GMADA", **kw):
    return {
        "model_id": model_id,
        "source": "dxf",
        "jurisdiction": {"authority": authority, "sector": "70", "plot_no": str(model_id), "allotment_date": "2019-04-01", "rule_pack": "puda_building_rules_1996"},
        "plot_polygon": box(0, 0, w, l),
        "plot_area_sqm": w * l,
        "zoned_area": zone,
        "edges": edges(w, l),
        "floors": floors,
        "projections": [],
        "courtyards": [],
        "mumty": None,
        **kw,
    }


# Golden models 2 (rear setback) and 4 (stilt plus four), and the upper-bound pair.
def golden():
    rear = model(2, 12.5, 20.0, box(1.5, 3.0, 11.0, 17.0), [
        {"level": 0, "is_stilt": False, "footprint": box(2.0, 3.5, 10.5, 18.2), "height_m": 3.2,
         "rooms": [room(box(2.0, 3.5, 6.0, 8.5), "living", 0, 3.5), room(box(6.0, 14.0, 10.5, 18.2), "bedroom", 0, 2.0)]},
    ])
    fp = box(3.0, 5.0, 17.0, 19.0)
    stilt = model(4, 20.0, 25.0, box(2.0, 4.0, 18.0, 21.0), [
        {"level": 0, "is_stilt": True, "footprint": fp, "height_m": 2.4, "rooms": []},
        *[{"level": i, "is_stilt": False, "footprint": fp, "height_m": 3.0, "rooms": [room(fp, "other", i, 8.0)]} for i in range(1, 5)],
    ])
    wide = {"level": 0, "is_stilt": False, "footprint": box(1.0, 1.0, 19.0, 29.0), "height_m": 3.0, "rooms": []}
    firm = model(10, 20.0, 30.0, box(2.0, 2.0, 18.0, 28.0), [wide])
    loose = model(11, 20.0, 30.0, box(2.0, 2.0, 18.0, 28.0), [{**wide, "footprint_is_upper_bound": True}])
    nozone = model(5, 12.5, 20.0, None, [{**wide, "footprint": box(2.0, 3.5, 10.5, 16.0)}])
    lost = model(6, 12.5, 20.0, None, [], authority="UNKNOWN")
    return [rear, stilt, firm, loose, nozone, lost]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    import json

    from parapet.operators.normalise import normalise, validate
    from parapet.sources.readers import read_models

    folder = tmp_path_factory.mktemp("models")
    for m in golden():
        (folder / f"{m['model_id']}.model.json").write_text(json.dumps(m))
    (folder / "broken.model.json").write_text("{ not json")
    models, rejected = read_models(spark, str(folder))
    assert rejected.count() == 1
    ok, bad = validate(models)
    assert bad.count() == 0
    return normalise(ok)
