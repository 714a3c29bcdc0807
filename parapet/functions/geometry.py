"""Geometry expressions over rings, as Spark SQL text.

A ring is ``array<struct<x:double,y:double>>`` in metres, with or without the closing point. Every
function takes SQL expressions (usually column names) and returns a SQL expression for ``F.expr``
or ``selectExpr``: only built-in functions, no Python worker, and one call to the JVM however deep
the expression is. Axis-aligned rectangles (the usual case for plots, zones and rooms) take a short
arithmetic path, every other ring the general one; ``CASE`` evaluates only the branch it needs.
"""

from __future__ import annotations

RING = "array<struct<x:double,y:double>>"
EPS = "1e-9D"


def num(v) -> str:
    """Python number -> double literal; text passes through."""
    return v if isinstance(v, str) else f"{float(v)!r}D"


def point(x, y) -> str:
    return f"named_struct('x', cast({num(x)} as double), 'y', cast({num(y)} as double))"


def line(x0, y0, x1, y1) -> str:
    return f"array({point(x0, y0)}, {point(x1, y1)})"


def rect_ring(x0, y0, x1, y1) -> str:
    """Closed counter-clockwise rectangle."""
    return f"array({point(x0, y0)}, {point(x1, y0)}, {point(x1, y1)}, {point(x0, y1)}, {point(x0, y0)})"


def from_pairs(pairs: str) -> str:
    """``array<array<double>>`` as stored in JSON documents -> ring of structs."""
    return f"transform({pairs}, fp -> named_struct('x', try_element_at(fp, 1), 'y', try_element_at(fp, 2)))"


def ring_ok(ring: str) -> str:
    """At least three points, false for NULL."""
    return f"({ring} is not null and size({ring}) >= 3)"


#: points of a closed rectangle, by far the most frequent ring: written out, since Spark compiles plain
#: expressions but interprets ``aggregate`` step by step. The order of the operations is the same.
_USUAL = 5


def _usual(ring: str, plain: str, general: str) -> str:
    """``plain`` for rings of _USUAL points, where ``ring`` is a name and the text stays short."""
    named = ring.replace("_", "a").replace(".", "a").isalnum()
    return f"(case when size({ring}) = {_USUAL} then {plain} else {general} end)" if named else general


def signed_area(ring: str) -> str:
    n = f"size({ring})"
    at = [f"{ring}[{i % _USUAL}]" for i in range(_USUAL + 1)]
    plain = "((0D" + "".join(f" + {p}.x * {q}.y - {q}.x * {p}.y" for p, q in zip(at, at[1:], strict=False)) + ") / 2D)"
    return _usual(
        ring,
        plain,
        f"(aggregate(sequence(0, {n} - 1), 0D, (sa, si) -> sa + {ring}[si].x * {ring}[(si + 1) % {n}].y"
        f" - {ring}[(si + 1) % {n}].x * {ring}[si].y) / 2D)",
    )


def area(ring: str) -> str:
    """Shoelace area, NULL for an unusable ring."""
    return f"(case when {ring_ok(ring)} then abs({signed_area(ring)}) end)"


def bounds(ring: str) -> str:
    """D3: struct<xmin,ymin,xmax,ymax>, one pass over the ring."""
    zero = "named_struct('xmin', double('inf'), 'ymin', double('inf'), 'xmax', double('-inf'), 'ymax', double('-inf'))"
    step = (
        "(bb, bp) -> named_struct('xmin', least(bb.xmin, bp.x), 'ymin', least(bb.ymin, bp.y),"
        " 'xmax', greatest(bb.xmax, bp.x), 'ymax', greatest(bb.ymax, bp.y))"
    )
    of = lambda best, start, axis: f"{best}(double('{start}'), " + ", ".join(f"{ring}[{i}].{axis}" for i in range(_USUAL)) + ")"
    plain = f"named_struct('xmin', {of('least', 'inf', 'x')}, 'ymin', {of('least', 'inf', 'y')}, 'xmax', {of('greatest', '-inf', 'x')}, 'ymax', {of('greatest', '-inf', 'y')})"
    return f"(case when {ring_ok(ring)} then {_usual(ring, plain, f'aggregate({ring}, {zero}, {step})')} end)"


def width(b: str) -> str:
    return f"({b}.xmax - {b}.xmin)"


def depth(b: str) -> str:
    return f"({b}.ymax - {b}.ymin)"


def is_rect(ring: str, b: str | None = None, a: str | None = None) -> str:
    """Axis-aligned rectangle: at most four distinct vertices that fill their own bounds."""
    b, a = b or bounds(ring), a or area(ring)
    box = f"({width(b)} * {depth(b)})"
    return f"(size({ring}) <= 5 and {a} > 0 and abs({a} - {box}) <= {box} * 1e-12D)"


def centroid(ring: str) -> str:
    """Area-weighted centroid."""
    n = f"size({ring})"
    c = f"({ring}[ci].x * {ring}[(ci + 1) % {n}].y - {ring}[(ci + 1) % {n}].x * {ring}[ci].y)"
    return (
        f"(case when {ring_ok(ring)} then aggregate(sequence(0, {n} - 1), named_struct('s', 0D, 'cx', 0D, 'cy', 0D), (ca, ci) -> "
        f"named_struct('s', ca.s + {c}, 'cx', ca.cx + ({ring}[ci].x + {ring}[(ci + 1) % {n}].x) * {c},"
        f" 'cy', ca.cy + ({ring}[ci].y + {ring}[(ci + 1) % {n}].y) * {c}),"
        " ca -> case when ca.s <> 0 then named_struct('x', ca.cx / (ca.s * 3D), 'y', ca.cy / (ca.s * 3D)) end) end)"
    )


def _cross(o: str, a: str, b: str) -> str:
    return f"(({a}.x - {o}.x) * ({b}.y - {o}.y) - ({a}.y - {o}.y) * ({b}.x - {o}.x))"


def segments(ring: str, v: str = "gi") -> str:
    """Edges of a ring as array<struct<a:point,b:point>>, closing edge included."""
    n = f"size({ring})"
    return (
        f"filter(transform(sequence(0, {n} - 1), {v} -> named_struct('a', {ring}[{v}], 'b', {ring}[({v} + 1) % {n}])),"
        f" {v}f -> {v}f.a.x <> {v}f.b.x or {v}f.a.y <> {v}f.b.y)"
    )


def line_segments(ln: str) -> str:
    return f"transform(sequence(0, size({ln}) - 2), li -> named_struct('a', {ln}[li], 'b', {ln}[li + 1]))"


def _one_sided(segs: str, ring: str, sign: int) -> str:
    """Every vertex of a ring to the left (1) or right (-1) of every segment, or on it."""
    return f"forall({segs}, ke -> forall({ring}, kv -> {sign} * {_cross('ke.a', 'ke.b', 'kv')} >= -{EPS}))"


def is_convex(ring: str) -> str:
    s = segments(ring, "ki")
    left = f"forall({s}, ke -> forall({ring}, kv -> {_cross('ke.a', 'ke.b', 'kv')} >= -{EPS}))"
    right = f"forall({s}, ke -> forall({ring}, kv -> {_cross('ke.a', 'ke.b', 'kv')} <= {EPS}))"
    return f"({left} or {right})"


def on_boundary(px: str, py: str, ring: str, tol: str = EPS) -> str:
    dx, dy = "(os.b.x - os.a.x)", "(os.b.y - os.a.y)"
    return (
        f"exists({segments(ring, 'oi')}, os -> "
        f"abs({dx} * ({py} - os.a.y) - {dy} * ({px} - os.a.x)) <= sqrt({dx} * {dx} + {dy} * {dy}) * {tol}"
        f" and {px} >= least(os.a.x, os.b.x) - {tol} and {px} <= greatest(os.a.x, os.b.x) + {tol}"
        f" and {py} >= least(os.a.y, os.b.y) - {tol} and {py} <= greatest(os.a.y, os.b.y) + {tol})"
    )


def _crossings_odd(px: str, py: str, ring: str) -> str:
    at = f"cs.a.x + ({py} - cs.a.y) * (cs.b.x - cs.a.x) / (cs.b.y - cs.a.y)"
    return (
        f"aggregate({segments(ring, 'xi')}, false, (ck, cs) -> case when (cs.a.y > {py}) <> (cs.b.y > {py})"
        f" and {px} < {at} then not ck else ck end)"
    )


def pip(px: str, py: str, ring: str) -> str:
    """Strictly inside; points on the outline are outside."""
    return (
        f"(case when {ring_ok(ring)} and {px} is not null and {py} is not null then"
        f" not {on_boundary(px, py, ring, '0D')} and {_crossings_odd(px, py, ring)} else false end)"
    )


def _cut_params(s: str, t: str) -> str:
    """Positions along segment ``s`` (0..1) where segment ``t`` meets it."""
    dx, dy = f"({s}.b.x - {s}.a.x)", f"({s}.b.y - {s}.a.y)"
    ex, ey = f"({t}.b.x - {t}.a.x)", f"({t}.b.y - {t}.a.y)"
    gx, gy = f"({t}.a.x - {s}.a.x)", f"({t}.a.y - {s}.a.y)"
    den, sq = f"({dx} * {ey} - {dy} * {ex})", f"({dx} * {dx} + {dy} * {dy})"
    u, v = f"(({gx} * {ey} - {gy} * {ex}) / {den})", f"(({gx} * {dy} - {gy} * {dx}) / {den})"
    a = f"(({gx} * {dx} + {gy} * {dy}) / {sq})"
    b = f"((({t}.b.x - {s}.a.x) * {dx} + ({t}.b.y - {s}.a.y) * {dy}) / {sq})"
    return (
        f"(case when abs({den}) > 1e-15D then case when {v} >= -{EPS} and {v} <= 1 + {EPS} then array({u})"
        f" else cast(array() as array<double>) end else array({a}, {b}) end)"
    )


def _segment_inside(s: str, ring: str) -> str:
    """Segment covered by a ring: cut it at every meeting point and test each piece's middle."""
    cuts = f"filter(flatten(transform({segments(ring, 'wi')}, wt -> {_cut_params(s, 'wt')})), wu -> wu > 0 and wu < 1)"
    stops = f"array_sort(concat(array(0D, 1D), {cuts}))"
    px, py = f"({s}.a.x + wm * ({s}.b.x - {s}.a.x))", f"({s}.a.y + wm * ({s}.b.y - {s}.a.y))"
    mids = f"transform(array({stops}), ws -> transform(sequence(0, size(ws) - 2), wk -> (ws[wk] + ws[wk + 1]) / 2D))[0]"
    return f"forall({mids}, wm -> {on_boundary(px, py, ring)} or {_crossings_odd(px, py, ring)})"


def within(a: str, b: str, a_bounds: str | None = None, b_bounds: str | None = None, b_area: str | None = None) -> str:
    """Ring ``a`` inside ring ``b``, touching allowed. NULL if either ring is unusable."""
    ab, bb = a_bounds or bounds(a), b_bounds or bounds(b)
    in_box = f"({ab}.xmin >= {bb}.xmin and {ab}.ymin >= {bb}.ymin and {ab}.xmax <= {bb}.xmax and {ab}.ymax <= {bb}.ymax)"
    # a convex outer ring: every vertex on the inner side of every edge
    turned = f"transform(array({segments(b, 'ki')}), bs -> case when {_one_sided('bs', b, 1)} then {_one_sided('bs', a, 1)} when {_one_sided('bs', b, -1)} then {_one_sided('bs', a, -1)} end)[0]"
    general = f"forall({segments(a, 'ai')}, asg -> {_segment_inside('asg', b)})"
    return (
        f"(case when {ring_ok(a)} and {ring_ok(b)} then case when not {in_box} then false when {is_rect(b, bb, b_area)} then true"
        f" else coalesce({turned}, {general}) end end)"
    )


def _point_segment_sq(p: str, s: str) -> str:
    dx, dy = f"({s}.b.x - {s}.a.x)", f"({s}.b.y - {s}.a.y)"
    t = f"greatest(0D, least(1D, (({p}.x - {s}.a.x) * {dx} + ({p}.y - {s}.a.y) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    ex, ey = f"({p}.x - ({s}.a.x + {t} * {dx}))", f"({p}.y - ({s}.a.y + {t} * {dy}))"
    return f"({ex} * {ex} + {ey} * {ey})"


def line_poly_dist(ln: str, ring: str, b: str | None = None, a: str | None = None) -> str:
    """Distance from a polyline to a polygon, 0 when they touch or overlap."""
    b = b or bounds(ring)
    p, q = f"{ln}[0]", f"{ln}[1]"
    gap_x = f"greatest(0D, {b}.xmin - greatest({p}.x, {q}.x), least({p}.x, {q}.x) - {b}.xmax)"
    gap_y = f"greatest(0D, {b}.ymin - greatest({p}.y, {q}.y), least({p}.y, {q}.y) - {b}.ymax)"
    flat = f"(size({ln}) = 2 and ({p}.x = {q}.x or {p}.y = {q}.y))"
    meet = (
        f"({_cross('dt.a', 'dt.b', 'ds.a')} * {_cross('dt.a', 'dt.b', 'ds.b')} < 0 and "
        f"{_cross('ds.a', 'ds.b', 'dt.a')} * {_cross('ds.a', 'ds.b', 'dt.b')} < 0)"
    )
    pair = (
        f"case when {meet} then 0D else least({_point_segment_sq('ds.a', 'dt')}, {_point_segment_sq('ds.b', 'dt')},"
        f" {_point_segment_sq('dt.a', 'ds')}, {_point_segment_sq('dt.b', 'ds')}) end"
    )
    sq = f"array_min(transform({line_segments(ln)}, ds -> array_min(transform({segments(ring, 'di')}, dt -> {pair}))))"
    general = f"case when {_crossings_odd(p + '.x', p + '.y', ring)} then 0D else sqrt({sq}) end"
    return (
        f"(case when {ring_ok(ring)} and size({ln}) >= 2 then case when {flat} and {is_rect(ring, b, a)}"
        f" then sqrt({gap_x} * {gap_x} + {gap_y} * {gap_y}) else {general} end end)"
    )


def mrr_short(ring: str, b: str | None = None, a: str | None = None) -> str:
    """Short side of the minimum-area rotated rectangle (not the minimum width).

    The minimum rectangle has a side along a hull edge, so only vertex pairs with every other
    vertex on one side are tried; equal areas resolve to the smaller short side.
    """
    b, a = b or bounds(ring), a or area(ring)
    pairs = f"flatten(transform({ring}, mi -> transform({ring}, mj -> named_struct('a', mi, 'b', mj))))"
    edge = f"(me.a.x <> me.b.x or me.a.y <> me.b.y) and forall({ring}, mv -> {_cross('me.a', 'me.b', 'mv')} >= -1e-12D)"
    ux, uy = "(mb.b.x - mb.a.x)", "(mb.b.y - mb.a.y)"
    ln = f"sqrt({ux} * {ux} + {uy} * {uy})"
    along = f"transform({ring}, mv -> (mv.x * {ux} + mv.y * {uy}) / {ln})"
    across = f"transform({ring}, mv -> (mv.y * {ux} - mv.x * {uy}) / {ln})"
    s1, s2 = f"(array_max({along}) - array_min({along}))", f"(array_max({across}) - array_min({across}))"
    sides = f"transform(filter({pairs}, me -> {edge}), mb -> named_struct('p', {s1}, 'q', {s2}))"
    best = f"array_min(transform({sides}, ms -> named_struct('box', ms.p * ms.q, 'short', least(ms.p, ms.q)))).short"
    return (
        f"(case when {ring_ok(ring)} and {a} > 0 then case when {is_rect(ring, b, a)}"
        f" then least({width(b)}, {depth(b)}) else {best} end end)"
    )


def translate(ring: str, dx: str, dy: str) -> str:
    """D10."""
    return f"transform({ring}, tp -> named_struct('x', tp.x + {num(dx)}, 'y', tp.y + {num(dy)}))"


def is_closed(ring: str) -> str:
    return f"(element_at({ring}, 1).x = element_at({ring}, -1).x and element_at({ring}, 1).y = element_at({ring}, -1).y)"


def _open(ring: str) -> str:
    """Drop a repeated closing point."""
    return f"(case when size({ring}) > 1 and {is_closed(ring)} then slice({ring}, 1, size({ring}) - 1) else {ring} end)"


def _close(ring: str) -> str:
    return f"concat({ring}, slice({ring}, 1, 1))"


def _half_plane(acc: str, nx: str, ny: str, c: str) -> str:
    """Keep the part of the open convex ring ``acc`` where ``nx*x + ny*y >= c``."""
    n = f"size({acc})"
    p, q = f"{acc}[hi]", f"{acc}[(hi + 1) % {n}]"
    dp, dq = f"({nx} * {p}.x + {ny} * {p}.y - {c})", f"({nx} * {q}.x + {ny} * {q}.y - {c})"
    t = f"({dp} / ({dp} - {dq}))"
    cut = f"array(named_struct('x', {p}.x + {t} * ({q}.x - {p}.x), 'y', {p}.y + {t} * ({q}.y - {p}.y)))"
    keep, none = f"array({p})", f"cast(array() as {RING})"
    corner = (
        f"case when {dp} >= 0 then case when {dq} < 0 and {dp} > 0 then concat({keep}, {cut}) else {keep} end"
        f" when {dq} > 0 then {cut} else {none} end"
    )
    return f"case when {n} >= 3 then flatten(transform(sequence(0, {n} - 1), hi -> {corner})) else {none} end"


def clip_rect(ring: str, box: str) -> str:
    """Intersect a convex ring with a rectangle (struct<xmin,ymin,xmax,ymax>).

    An empty or degenerate result leaves the ring as it was; so does a ring that is not convex, which
    :func:`parapet.functions.polygons.clip_any` clips.
    """
    b = "cb"
    x0, y0 = f"greatest({b}.xmin, {box}.xmin)", f"greatest({b}.ymin, {box}.ymin)"
    x1, y1 = f"least({b}.xmax, {box}.xmax)", f"least({b}.ymax, {box}.ymax)"
    inside = f"({b}.xmin >= {box}.xmin and {b}.ymin >= {box}.ymin and {b}.xmax <= {box}.xmax and {b}.ymax <= {box}.ymax)"
    planes = (
        f"array(named_struct('nx', 1D, 'ny', 0D, 'c', {box}.xmin), named_struct('nx', -1D, 'ny', 0D, 'c', -{box}.xmax),"
        f" named_struct('nx', 0D, 'ny', 1D, 'c', {box}.ymin), named_struct('nx', 0D, 'ny', -1D, 'c', -{box}.ymax))"
    )
    cut = f"aggregate({planes}, {_open(ring)}, (ha, hp) -> {_half_plane('ha', 'hp.nx', 'hp.ny', 'hp.c')})"
    kept = f"transform(array({cut}), cc -> case when size(cc) >= 3 and {area('cc')} > 0 then {_close('cc')} else {ring} end)[0]"
    pick = (
        f"case when {inside} then {ring} when {is_rect(ring, b)} then case when {x1} > {x0} and {y1} > {y0} then"
        f" {rect_ring(x0, y0, x1, y1)} else {ring} end when not {is_convex(ring)} then {ring} else {kept} end"
    )
    return f"(case when not {ring_ok(ring)} then {ring} else transform(array({bounds(ring)}), cb -> {pick})[0] end)"


def inset(ring: str, d: str) -> str:
    """Mitred inward offset of a convex ring; NULL when it vanishes or is not convex (see
    :func:`parapet.functions.polygons.inset_any`)."""
    d = num(d)
    x0, y0, x1, y1 = f"(ib.xmin + {d})", f"(ib.ymin + {d})", f"(ib.xmax - {d})", f"(ib.ymax - {d})"
    turn = f"signum({signed_area(ring)})"
    ex, ey = "(hs.b.x - hs.a.x)", "(hs.b.y - hs.a.y)"
    ln = f"sqrt({ex} * {ex} + {ey} * {ey})"
    nx, ny = f"(-{ey} * {turn} / {ln})", f"({ex} * {turn} / {ln})"
    shave = _half_plane("ha", nx, ny, f"({nx} * hs.a.x + {ny} * hs.a.y + {d})")
    cut = f"aggregate({segments(ring, 'ii')}, {_open(ring)}, (ha, hs) -> {shave})"
    kept = f"transform(array({cut}), cc -> case when size(cc) >= 3 and {area('cc')} > 0 then {_close('cc')} end)[0]"
    pick = (
        f"case when {is_rect(ring, 'ib')} then case when {x0} < {x1} and {y0} < {y1} then {rect_ring(x0, y0, x1, y1)} end"
        f" when {is_convex(ring)} then {kept} end"
    )
    return f"(case when {ring_ok(ring)} then transform(array({bounds(ring)}), ib -> {pick})[0] end)"


def geom_type(ring: str) -> str:
    """GeoJSON type of a highlight ring; NULL for an empty one."""
    return (
        f"(case when {ring} is null or size({ring}) = 0 then null when size({ring}) = 1 then 'Point'"
        f" when size({ring}) = 2 then 'LineString' when {is_closed(ring)} and size({ring}) >= 4 then 'Polygon'"
        " else 'LineString' end)"
    )


def geometry_json(ring: str) -> str:
    """GeoJSON geometry text, or the text ``null``."""
    pts = f"transform({ring}, jp -> array(jp.x, jp.y))"
    coords = (
        f"case {geom_type(ring)} when 'Point' then to_json({pts}[0]) when 'LineString' then to_json({pts})"
        f" when 'Polygon' then to_json(array({pts})) end"
    )
    return f"""coalesce(concat('{{"type":"', {geom_type(ring)}, '","coordinates":', {coords}, '}}'), 'null')"""


def to_metres(box: str, origin_x: str, origin_y: str, pts_per_m: str) -> str:
    """Page rectangle (points, y down) -> ring in metres, y up, anchored on a plot corner."""
    return rect_ring(
        f"(({box}.xmin - {origin_x}) / {pts_per_m})",
        f"(({origin_y} - {box}.ymax) / {pts_per_m})",
        f"(({box}.xmax - {origin_x}) / {pts_per_m})",
        f"(({origin_y} - {box}.ymin) / {pts_per_m})",
    )
