"""Text, unit and colour expressions (J2-J13, J15, J18-J21, J25), as Spark SQL text.

Regular expressions use \\x27 and \\x22 for the foot and inch marks so that they fit any quoting.
"""

from __future__ import annotations

# Units.
M_PER_FOOT = "0.3048D"
M_PER_INCH = "0.0254D"
CAD_UNIT_TO_M = {1: 0.0254, 2: 0.3048, 4: 0.001, 5: 0.01, 6: 1.0, 10: 0.9144}
UI_UNIT_TO_M = {"m": 1.0, "ft": 0.3048, "yd": 0.9144}

# Dimension patterns.
FEET_INCHES = r"(\d+)\x27-(\d+)\x22"
FEET_INCHES_LOOSE = r"(\d+)\x27\s*-\s*(\d+)\x22"
FEET_ONLY = r"(\d+)\x27(?!\s*-?\s*\d*\s*\x22)"
NUMERIC_HINT = r"(?i)\d+(\.\d+)?\s*(%|per\s?cent|meter|metre|sq\.?\s?m|sqm|sq\.?\s?yd|storey|storeys)"
OCR_MIN_CHARS = 40

# Layer-name keywords, in matching order.
LAYER_CATEGORIES = (
    ("room_bedroom", ("mbr", "m-bed", "master")),
    ("room_bedroom", ("bdrm", "bed")),
    ("room_bath", ("toil", "wc", "bath")),
    ("room_kitchen", ("kit",)),
    ("room_living", ("liv", "drw", "lounge", "foyer")),
    ("room_stair", ("stair",)),
    ("room_garage", ("gar", "park")),
    ("room_store", ("stor",)),
    ("wall", ("wall",)),
    ("annotation", ("text", "annot", "dim", "note")),
)
# Room-label keywords with use and default size in metres, in matching order.
ROOM_LABELS = (
    (("MASTER", "MBR"), "bedroom", 4.0, 4.0),
    (("BED",), "bedroom", 3.5, 3.5),
    (("MAID",), "other", 2.5, 2.5),
    (("TOILET", "WC", "BATH"), "wc", 2.0, 1.5),
    (("KITCHEN",), "kitchen", 3.0, 2.5),
    (("LIVING", "DRAWING", "LOUNGE", "FOYER"), "living", 4.0, 3.5),
    (("DINING",), "other", 3.5, 3.0),
    (("STORE", "STORAGE", "LAUNDRY", "UTILITY"), "store", 2.0, 2.0),
    (("STAIR",), "stair", 2.5, 4.0),
    (("GARAGE", "PARKING", "CARPORT"), "garage", 5.0, 3.0),
    (("LIFT",), "other", 1.5, 1.5),
    (("UGSR",), "other", 2.0, 2.0),
)
NON_ROOM_LABELS = ("BACKYARD", "FRONTYARD", "GREEN", "PARKING HALL")
ROOM_LABEL_SHAPE = r"^[A-Z][A-Z /\-]{2,25}$"
# Sheet-role keywords, most specific first.
SHEET_ROLES = (
    ("basement", ("basement",)),
    ("stilt", ("stilt",)),
    ("ground", ("ground floor",)),
    ("first", ("first floor",)),
    ("second", ("second floor",)),
    ("third", ("third floor",)),
    ("fourth", ("fourth floor",)),
    ("elevation_front", ("front elevation",)),
    ("elevation_rear", ("rear elevation", "back elevation")),
    ("elevation_side", ("side elevation", "left elevation", "right elevation")),
    ("elevation", ("elevation",)),
    ("site", ("site plan",)),
    ("zoning", ("zoning plan", "zoning")),
    ("section", ("section",)),
)
# Title-block field patterns.
TITLE_FIELDS = {
    "sheet_title": r"(?i)TITLE\s*:-[ \t]*([^\n]*)",
    "date": r"(?i)DATE\s*:-[ \t]*([^\n]*)",
    "drawn_by": r"(?i)DRAWN\s*BY\s*:-[ \t]*([^\n]*)",
    "checked_by": r"(?i)CHECKED\s*BY\s*:-[ \t]*([^\n]*)",
    "client": r"(?i)CLIENT\s*:-[ \t]*([^\n]*)",
    "drawing_no": r"(?i)DRAWING\s*NO\s*:-[ \t]*([^\n]*)",
}
PLOT_NO = r"(?i)Plot\s*No\.?\s*(\S+)"
PHASE_SECTOR = r"(?i)(Phase|Sector)\s*[-:]?\s*(\S+)"
SECTOR_WINDOW = 60
# Display names of sheet roles.
ROLE_LABELS = {
    "basement": "Basement plan",
    "stilt": "Stilt plan",
    "ground": "Ground floor plan",
    "first": "First floor plan",
    "second": "Second floor plan",
    "third": "Third floor plan",
    "fourth": "Fourth floor plan",
    "site": "Site plan",
    "zoning": "Zoning plan",
    "section": "Section",
    "elevation": "Elevation",
    "elevation_front": "Front elevation",
    "elevation_rear": "Rear elevation",
    "elevation_side": "Side elevation",
}
# Colour thresholds per channel.
ACHROMATIC_SPREAD = 24
COLOUR_TOLERANCE = 40


def _any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


def feet_inches_all(col: str, pattern: str = FEET_INCHES) -> str:
    """Every N'-M" token in metres; twelve inches or more is a misread and dropped."""
    part = f"regexp_extract_all({col}, r'{pattern}', {{}})"
    pairs = f"zip_with({part.format(1)}, {part.format(2)}, (tf, ti) -> named_struct('f', cast(tf as double), 'i', cast(ti as double)))"
    return f"transform(filter({pairs}, tp -> tp.i < 12), tp -> (tp.f + tp.i / 12D) * {M_PER_FOOT})"


def feet_only_all(col: str) -> str:
    """Foot-only tokens in metres."""
    return f"transform(regexp_extract_all({col}, r'{FEET_ONLY}', 1), tf -> cast(tf as double) * {M_PER_FOOT})"


def dim_inches(col: str) -> str:
    """A whole token as inches, NULL when it is anything else."""
    t = f"trim({col})"
    get = lambda p, k: f"cast(regexp_extract({t}, r'{p}', {k}) as double)"
    fi, f, i = r"^(\d+)\x27-(\d+)\x22$", r"^(\d+)\x27$", r"^(\d+)\x22$"
    return (
        f"(case when {t} rlike r'{fi}' then {get(fi, 1)} * 12 + {get(fi, 2)} when {t} rlike r'{f}' then {get(f, 1)} * 12"
        f" when {t} rlike r'{i}' then {get(i, 1)} end)"
    )


def cad_unit_factor(code: str) -> str:
    """Metres per CAD drawing unit; an unknown code counts as metres."""
    return "(case " + " ".join(f"when {code} = {k} then {v!r}D" for k, v in CAD_UNIT_TO_M.items()) + " else 1D end)"


def cad_unit_known(code: str) -> str:
    return f"coalesce({code} in ({', '.join(map(str, CAD_UNIT_TO_M))}), false)"


def ui_unit_factor(unit: str) -> str:
    return "(case " + " ".join(f"when {unit} = '{k}' then {v!r}D" for k, v in UI_UNIT_TO_M.items()) + " else 1D end)"


def layer_category(col: str) -> str:
    """J6."""
    n = f"replace(lower(trim({col})), '_', '-')"
    return "(case " + " ".join(f"when {_any(n, ws)} then '{c}'" for c, ws in LAYER_CATEGORIES) + " else 'unknown' end)"


def room_use(col: str) -> str:
    """struct<use,w,h> of a room label; NULL for yards and text that is no room label."""
    t = f"trim({col})"
    arms = " ".join(
        f"when {_any(t, ws)} then named_struct('use', '{u}', 'w', {w!r}D, 'h', {h!r}D)" for ws, u, w, h in ROOM_LABELS
    )
    skip = ", ".join(f"'{x}'" for x in NON_ROOM_LABELS)
    return f"(case when {t} in ({skip}) or not {t} rlike r'{ROOM_LABEL_SHAPE}' then null {arms} end)"


def sheet_role(col: str) -> str:
    """J8."""
    return "(case " + " ".join(f"when {_any(f'lower({col})', ws)} then '{r}'" for r, ws in SHEET_ROLES) + " end)"


def guess_role(kind: str, title: str, text: str, name: str, layout: str) -> str:
    """struct<role,source>. PDF: title block, then page text. DXF: layout tab, else file name."""
    plain = lambda c: f"replace(replace({c}, '_', ' '), '-', ' ')"
    by_title, by_text = sheet_role(title), sheet_role(text)
    return (
        f"(case when {kind} = 'pdf' then case when {by_title} is not null then named_struct('role', {by_title}, 'source', 'title_block')"
        f" when {by_text} is not null then named_struct('role', {by_text}, 'source', 'page_text')"
        f" else named_struct('role', cast(null as string), 'source', 'title_block') end"
        f" when {kind} = 'dxf' and {layout} is not null then named_struct('role', {sheet_role(plain(layout))}, 'source', 'layout_name')"
        f" when {kind} = 'dxf' then named_struct('role', {sheet_role(plain(name))}, 'source', 'filename')"
        f" else named_struct('role', cast(null as string), 'source', 'filename') end)"
    )


def title_field(text: str, field: str) -> str:
    """A blank field stays NULL and never swallows the next line."""
    return f"nullif(trim(regexp_extract({text}, r'{TITLE_FIELDS[field]}', 1)), '')"


def plot_no(text: str) -> str:
    """J11."""
    return f"nullif(rtrim(',', regexp_extract({text}, r'{PLOT_NO}', 1)), '')"


def sector(text: str) -> str:
    """Phase/Sector only within the window right after the plot number."""
    hit = f"regexp_substr({text}, r'{PLOT_NO}')"
    window = f"substring({text}, regexp_instr({text}, r'{PLOT_NO}') + length({hit}), {SECTOR_WINDOW})"
    kind, val = f"regexp_extract({window}, r'{PHASE_SECTOR}', 1)", f"regexp_extract({window}, r'{PHASE_SECTOR}', 2)"
    return f"(case when {hit} is not null and {kind} <> '' then concat(initcap({kind}), '-', rtrim(',', {val})) end)"


def role_confirmed(title: str, text: str, keyword: str) -> str:
    """The title names the declared role, or failing that the page text does."""
    return f"(coalesce(contains(lower({title}), {keyword}), false) or coalesce(contains(lower({text}), {keyword}), false))"


def decode_ref(ref: str) -> str:
    """``file#layout=NAME`` -> struct<file,layout>."""
    parts = f"split({ref}, '#layout=', 2)"
    return f"named_struct('file', {parts}[0], 'layout', try_element_at({parts}, 2))"


def encode_ref(file: str, layout: str) -> str:
    return f"(case when {layout} is null then {file} else concat({file}, '#layout=', {layout}) end)"


def has_numeric(text: str) -> str:
    """J15."""
    return f"({text} rlike r'{NUMERIC_HINT}')"


def norm_key(text: str) -> str:
    """J18."""
    return f"regexp_replace(upper({text}), '[^A-Z0-9]', '')"


def ocr_required(text: str) -> str:
    """J19."""
    return f"(length(trim({text})) < {OCR_MIN_CHARS})"


def channel(colour: str, k: int) -> str:
    """0 red, 1 green, 2 blue of a packed colour."""
    return f"(shiftright(cast({colour} as int), {16 - 8 * k}) & 255)"


def achromatic(colour: str) -> str:
    rgb = ", ".join(channel(colour, k) for k in range(3))
    return f"(greatest({rgb}) - least({rgb}) < {ACHROMATIC_SPREAD})"


def colour_dist(a: str, b: str) -> str:
    return "greatest(" + ", ".join(f"abs({channel(a, k)} - {channel(b, k)})" for k in range(3)) + ")"


def is_vertical(angle: str, dx: str, dy: str) -> str:
    """Within 5 degrees of vertical; without an angle it comes from the two points."""
    a = f"coalesce({angle}, case when {dx} <> 0 or {dy} <> 0 then degrees(atan2({dy}, {dx})) end)"
    return f"coalesce(abs(pmod({a}, 180D) - 90D) <= 5D, false)"


def role_label(role: str) -> str:
    """J25."""
    named = lambda c: "case " + c + " " + " ".join(f"when '{k}' then '{v}'" for k, v in ROLE_LABELS.items()) + " end"
    base, num = f"regexp_replace({role}, '_[0-9]+$', '')", f"regexp_extract({role}, '_([0-9]+)$', 1)"
    plain = f"array_join(transform(split({role}, '_'), w -> concat(upper(left(w, 1)), substring(w, 2))), ' ')"
    return f"coalesce({named(role)}, case when {num} <> '' then concat({named(base)}, ' (', {num}, ')') end, {plain})"
