import pytest

from parapet.operators import sheets as s

# A 60 x 90 foot plot drawn at 32.808 points per metre.
SCALE = 32.808
FT = 0.3048


def test_scale_needs_both_axes(spark):
    w, h = 60 * FT * SCALE, 90 * FT * SCALE
    rect = spark.createDataFrame([(1, 0.0, 0.0, w, h), (2, 0.0, 0.0, w, h)], "sheet int, x0 double, y0 double, x1 double, y1 double")
    tok = [(1, 60 * FT, w / 2, -20.0), (1, 90 * FT, -20.0, h / 2), (1, 3.2, w / 2, h / 2), (2, 90 * FT, -20.0, h / 2)]
    got = {r.sheet: r.scale for r in s.verified_scale(rect, spark.createDataFrame(tok, "sheet int, m double, x double, y double")).collect()}
    assert set(got) == {1} and got[1] == pytest.approx(SCALE)


def test_bracket_equals_contiguous_run(spark):
    chain = [(1, i, float(v), 600.0 + i % 3, 10.0 * i) for i, v in enumerate([36, 120, 120, 120, 36])]
    other = [(1, 9, 396.0, 570.0, 25.0), (1, 10, 500.0, 560.0, 25.0)]
    df = spark.createDataFrame(chain + other, "sheet int, pos int, inches double, x double, y double")
    assert [r.height_m for r in s.bracket_height(df).collect()] == [pytest.approx(396 * 0.0254)]
    loose = spark.createDataFrame(chain + [(1, 9, 300.0, 570.0, 25.0)], "sheet int, pos int, inches double, x double, y double")
    assert s.bracket_height(loose).count() == 0


@pytest.mark.parametrize("dims,height,n", [([10.06, 3.0], 10.06, 1), ([9.0, 6.5, 1.5, 1.0], 9.0, 3), ([7.7, 6.5, 1.5], None, 0)])
def test_cad_heights(spark, dims, height, n):
    df = spark.createDataFrame([(1, m, 90.0, 0.0, 0.0, float(i)) for i, m in enumerate(dims)], "sheet int, measurement double, angle double, dx double, dy double, y double")
    got = s.dxf_height(df).collect()
    assert [(r.height_m, r.n_segments) for r in got] == ([] if height is None else [(height, n)])
