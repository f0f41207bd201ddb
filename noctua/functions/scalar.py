"""Column expressions: header values, names, dates, gates, scores and states.  All stay inside the JVM.

Missing values are NULL: NaN, infinities and empty strings become NULL where a function says that it cleans.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ------------------------------------------------------------------------------------------------------

#: Filter names after upper-casing and dropping all but letters and digits.
FILTER_ALIASES = {
    "H": "H", "HA": "H", "HII": "H", "HALPHA": "H", "HYDROGENALPHA": "H",
    "O": "O", "OIII": "O", "O3": "O", "OXYGENIII": "O",
    "S": "S", "SII": "S", "S2": "S",
    "L": "L", "LUM": "L", "LUMINANCE": "L",
    "R": "R", "RED": "R", "G": "G", "GREEN": "G", "B": "B", "BLUE": "B",
}
#: Folder names: HII is no alias here.
FOLDER_ALIASES = {k: v for k, v in FILTER_ALIASES.items() if k not in ("HII", "OXYGENIII")}
#: Folder names of a stacking run know the sulfur and oxygen words as well.
STACK_ALIASES = FOLDER_ALIASES | {"SULFURII": "S", "SULPHURII": "S", "OXYGENIII": "O"}
#: Substrings of file names in the order in which they are tried.
FILE_NAME_HINTS = [
    ("HYDROGENALPHA", "H"), ("HALPHA", "H"), ("HII", "H"), ("OXYGENIII", "O"), ("OIII", "O"), ("O3", "O"), ("SULFURII", "S"),
    ("SII", "S"), ("S2", "S"), ("LUMINANCE", "L"), ("LUM", "L"), ("RED", "R"), ("GREEN", "G"), ("BLUE", "B"),
]
FILTER_ORDER = ["L", "R", "G", "B", "H", "S", "O"]
ROLE_PRIORITY = {
    "reference_rank_1": 0, "reference_rank_2": 1, "reference_rank_3": 2, "score_median": 3, "score_p10": 4, "score_p25": 5,
    "score_p75": 6, "max_bgnoise": 7, "max_background": 8, "min_star_count": 9, "max_star_count": 10,
}
#: Name sanitizers: (characters kept, characters stripped from the ends, name for nothing).
SANITIZERS = {"label": ("A-Za-z0-9_.-", "_", "unknown"), "file": ("A-Za-z0-9._-", "._-", "unknown"), "stack": ("A-Za-z0-9._-", "._", "unknown"), "project": ("A-Za-z0-9_-", "_", "unnamed")}
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm")


def lookup(table: dict, key: Column) -> Column:
    """table[key], NULL for keys that it lacks."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


# --- cleaning (P14, P38) -----------------------------------------------------------------------------------------------


def finite(x: Column) -> Column:
    """X as a double; NULL where it is no number, NaN or infinite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def unquote(x: Column) -> Column:
    """Trimmed; a value in single quotes loses them, and doubled quotes inside become single ones."""
    t = F.trim(x)
    quoted = t.rlike("^'.*'$") & (F.length(t) >= 2)
    return F.when(quoted, F.trim(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'")))).otherwise(t)


# --- headers (P1, P2) --------------------------------------------------------------------------------------------------


def metadata_key(key: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(key)), "[^A-Z0-9:]", "")


def header_value(header: Column, *keys: str) -> Column:
    """The first of the keys (then aliases) that the header has: as written, in upper case, then by normalized key."""
    clean = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(header), lambda e: F.struct(metadata_key(e["key"]).alias("key"), F.element_at(F.filter(F.map_values(F.map_filter(header, lambda k, _: metadata_key(k) == metadata_key(e["key"]))), lambda _: F.lit(True)), 1).alias("value")))))
    return F.coalesce(*[c for k in keys for c in (header[k], header[k.upper()], clean[metadata_key(F.lit(k))])])


def first_number(header: Column, *keys: str, default: float | None = None) -> Column:
    """The first parsable finite number among the keys."""
    found = [finite(header_value(header, k)) for k in keys]
    return F.coalesce(*found, F.lit(default).cast("double"))


# --- filters (P3-P6) and names (P15, P18, P19) --------------------------------------------------------------------------


def filter_key(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9]", "")


def sanitize(x: Column, kind: str = "label") -> Column:
    """Runs of other characters become `_`; ends are stripped; nothing left gives the kind's default."""
    keep, ends, default = SANITIZERS[kind]
    y = F.regexp_replace(F.trim(x), f"[^{keep}]+", "_")
    if kind == "project":
        y = F.regexp_replace(y, "_+", "_")
    y = F.regexp_replace(y, f"^[{ends}]+|[{ends}]+$", "")
    return F.when(y == "", F.lit(default)).otherwise(y)


def canonical_filter(x: Column, aliases: dict[str, str] = FILTER_ALIASES, others: bool = True) -> Column:
    """The alias of a raw filter name, else (if others) the name made safe; NULL for nothing."""
    raw = F.when(F.trim(x) != "", F.trim(x))
    safe = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.coalesce(lookup(aliases, filter_key(raw)), F.when(safe != "", safe) if others else F.lit(None).cast("string"))


def filter_from_name(path: Column) -> tuple[Column, Column]:
    """(filter, hint) of a file name; the first of the ordered hints that its normalized stem contains."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    key, got, hint = filter_key(stem), F.lit(None).cast("string"), F.lit("NO_MATCH")
    for text, name in reversed(FILE_NAME_HINTS):
        got = F.when(key.contains(text), F.lit(name)).otherwise(got)
        hint = F.when(key.contains(text), F.lit(text)).otherwise(hint)
    return got, hint


def filter_chain(header: Column, path: Column, marker: Column) -> tuple[Column, Column]:
    """P5: (filter, lookup_status): of the header, else the file name, else the folder's marker, else failed."""
    own, named = canonical_filter(header), filter_from_name(path)[0]
    status = F.when(own.isNotNull(), "header").when(named.isNotNull(), "filename").when(marker.isNotNull(), "folder_marker").otherwise("failed")
    return F.coalesce(own, named, marker), status


def session_filter_id(x: Column, ids: dict[str, int]) -> Column:
    """Id of a filter name: exact, else by its first letter, else the id of H."""
    up = F.upper(F.trim(x))
    return F.coalesce(lookup(ids, up), lookup(ids, F.substring(up, 1, 1)), F.lit(ids["H"]))


def group_key(obj: Column, width: Column, height: Column, exposure: Column | None = None) -> Column:
    """Object and WxH, made safe; in a candidate key the exposure stands between them."""
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.concat_ws("_", sanitize(obj), size) if exposure is None else F.concat_ws("_", sanitize(obj), general(exposure), size)


def candidate_key(parent: Column, name: Column, exposure: Column, width: Column, height: Column) -> Column:
    """Parent folder, filter, exposure (1 where it is not a positive number) and WxH of a frame, made safe as one label."""
    t = finite(exposure)
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return sanitize(F.concat_ws("_", parent, name, general(F.when(t > 0, t).otherwise(1.0)), size))


def general(x: Column, digits: int = 8) -> Column:
    """A number with some significant digits and no zeros after the last of them: 300, 1500.5, 1e+10; NULL stays NULL."""
    text = F.format_string(f"%.{digits - 1}e", F.abs(x.cast("double")))
    e = F.substring_index(text, "e", -1).cast("int")
    all_digits = F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit(""))
    shown = F.when(all_digits.rlike("^0*$"), "0").otherwise(F.regexp_replace(all_digits, "0+$", ""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), shown)
    whole = F.rpad(shown, F.greatest(e + 1, F.length(shown)), "0")
    large = F.concat_ws(".", F.substring(whole, F.lit(1), e + 1), F.when(F.length(whole) > e + 1, F.substring(whole, e + 2, F.length(whole))))
    power = F.concat(F.concat_ws(".", F.substring(shown, 1, 1), F.when(F.length(shown) > 1, F.substring(shown, F.lit(2), F.length(shown)))), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
    plain = F.when((e < -4) | (e >= digits), power).when(e < 0, small).otherwise(large)
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), plain))


def content_name(*parts: Column, method: str = "sha1", digits: int = 16) -> Column:
    """A name from content: the first digits of a SHA-1 or SHA-256 over the parts, NUL between."""
    joined = F.concat_ws("\0", *[p.cast("string") for p in parts])
    return F.substring(F.sha1(joined) if method == "sha1" else F.sha2(joined, 256), 1, digits)


# --- paths (P8, P9, P37, P39) ------------------------------------------------------------------------------------------


def frame_kind(path: Column) -> Column:
    """Darkflat before light before flat before dark before bias, else other."""
    p = F.lower(path)
    return F.when(p.contains("darkflat") | p.contains("dark-flat"), "darkflat").when(p.contains("light"), "light").when(p.contains("flat"), "flat").when(p.contains("dark"), "dark").when(p.contains("bias"), "bias").otherwise("other")


def user_and_equipment(relative: Column, filter_name: Column) -> tuple[Column, Column]:
    """The first folder is the user; the second the equipment, or 'default' if there is none, or if it is the last
    folder and names the filter."""
    parts = F.split(relative, "/")
    folder = F.get(parts, F.lit(1))
    is_filter = (F.size(parts) == 3) & F.coalesce(lookup(FOLDER_ALIASES, filter_key(folder)) == filter_name, F.lit(False))
    user = F.get(parts, F.lit(0))
    return F.when(user == "", "unknown").otherwise(user), F.when((F.size(parts) <= 2) | is_filter, "default").otherwise(folder)


def burst_set(path: Column, start: int, end: Column | int, size: int = 21) -> tuple[Column, Column]:
    """(set, place in it) of a file numbered start to end; files outside, or after the last whole set, have neither."""
    n = F.regexp_extract(path, r"(\d+)\.[^.]*$", 1).try_cast("int")
    ok = (n >= start) & (n < start + F.floor((F.lit(end) - start + 1) / size) * size)
    return F.when(ok, F.floor((n - start) / size)), F.when(ok, F.pmod(n - start, F.lit(size)))


def dark_fields(name: Column) -> dict[str, Column]:
    """Numbers in the name of a master dark."""
    pattern = r"(?i)master_dark_MODE(-?\d+)_GAIN(-?\d+)_OFFSET(-?\d+)_EXPTIME(-?\d+)_TEMP(-?\d+)"
    return {k: F.regexp_extract(name, pattern, i + 1).try_cast("int") for i, k in enumerate(("mode", "gain", "offset", "exptime", "temp"))}


# --- time (P7, P13, P40) and angles (P16, P17, P28, P32) ------------------------------------------------------------------


def parse_date_obs(text: Column, date_only: bool = False) -> Column:
    """A UTC timestamp from ISO text with or without offset, and other usual forms; date-only text if asked for."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.regexp_replace(t, " ", "T")))
    plain = F.when(t.rlike(r"\d\d:\d\d"), F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]))
    return F.coalesce(zoned, plain, *([F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))] if date_only else []))


def month_key(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def months_ago(t: Column, now: Column) -> Column:
    """Calendar months between."""
    return (F.year(now) - F.year(t)) * 12 + F.month(now) - F.month(t)


def hms(seconds: Column) -> Column:
    """Whole seconds as hh:mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def sexagesimal(text: Column) -> Column:
    """P16: "d m s" (blanks, colons or unit letters between) as a number; the sign is that of the text, so "-00" counts."""
    pattern = r"^\s*([+-]?)\s*(\d+(?:\.\d*)?)(?:[\s:hd°]+(\d+(?:\.\d*)?))?(?:[\s:m']+(\d+(?:\.\d*)?))?"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("double"), F.lit(0.0))
    size = part(2) + part(3) / 60 + part(4) / 3600
    return F.when(F.regexp_extract(text, pattern, 2) != "", F.when(F.regexp_extract(text, pattern, 1) == "-", -size).otherwise(size))


def sexagesimal_text(x: Column) -> Column:
    """P16: "sdd mm ss.s", rounded to tenths of a second."""
    tenths = F.round(F.abs(x) * 36000).cast("long")
    sign = F.when((x < 0) & (tenths > 0), "-").otherwise("")
    return F.concat(sign, F.format_string("%02d %02d %04.1f", F.floor(tenths / 36000), F.floor(F.pmod(tenths, F.lit(36000)) / 600), F.pmod(tenths, F.lit(600)) / 10))


def pointing_error(d_ra_hours: Column, d_dec_degrees: Column) -> Column:
    """Arc seconds; without the cosine of the declination."""
    return F.hypot(d_ra_hours / 24 * 360 * 3600, d_dec_degrees * 3600)


def illumination(elongation: Column) -> Column:
    """Percent of the Moon's disc, elongation in radians."""
    return 50 * (1 - F.cos(elongation))


def hours_to_flip(ra: Column, lst: Column, pier_east: Column, flip_angle: float = 0.0) -> Column:
    """Hours until the mount has to flip, which it does at an hour angle of flip_angle hours; with the pier on the
    east it has just flipped and has 12 hours more.  Hour angles above 12 count as those before the meridian."""
    ha = F.when(lst - ra > 12, lst - ra - 24).otherwise(lst - ra)
    return F.when(pier_east, 12 + flip_angle - ha).otherwise(F.greatest(flip_angle - ha, F.lit(0.0)))


# --- gates (P10, P11, P33) and rounding (P12) -----------------------------------------------------------------------------


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def round_to(x: Column, step: float) -> Column:
    """To a multiple of step, halves to even."""
    return F.bround(x / step) * step


def exposure_gate(exposure: Column, least: float | None, most: float | None) -> Column:
    """P10: an unknown exposure passes."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (exposure >= least)
    if most is not None:
        ok = ok & (exposure <= most)
    return exposure.isNull() | ok


def moon_gate(altitude: Column, phase: Column, max_altitude: float | None = None, max_phase: float | None = None) -> Column:
    """One limit must hold; of two, either; unknown metrics fail; no limit passes."""
    tests = [F.coalesce(c <= m, F.lit(False)) for c, m in ((altitude, max_altitude), (phase, max_phase)) if m is not None]
    return tests[0] | tests[1] if len(tests) == 2 else tests[0] if tests else F.lit(True)


def refocus_due(age: Column, delta_t: Column, interval: float, threshold: float) -> Column:
    """Never focused (NULL age), too old, or too much warmer or colder."""
    return age.isNull() | (age > interval) | F.coalesce(F.abs(delta_t) >= threshold, F.lit(False))


def focus_position(slope: Column, temperature: Column, intercept: Column) -> Column:
    """Truncated toward zero."""
    return (slope * temperature + intercept).cast("int")


# --- scores (P20-P24) ---------------------------------------------------------------------------------------------------

EPS = 1e-12


def star_yield(stars: Column, noise: Column) -> Column:
    return F.when((stars > 0) & (noise > 0), stars / noise)


def stellar_contrast(flux: Column, noise: Column) -> Column:
    return F.when(noise > 0, flux / noise)


def sky_weighted_contrast(stars: Column, flux: Column, background: Column, noise: Column) -> Column:
    return F.when((noise > 0) & (flux > 0), F.log1p(F.greatest(stars, F.lit(0.0))) * flux / (noise * F.sqrt(F.greatest(background, F.lit(EPS)))))


def signed_power(x: Column, p: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), p)


def stellar_quality(stars: Column, flux: Column, background: Column, noise: Column) -> Column:
    return F.when((stars > 0) & (noise > 0), F.pow(stars, F.lit(0.75)) * signed_power(flux, F.lit(0.75)) / (F.sqrt(noise) * F.pow(F.greatest(background, F.lit(EPS)), F.lit(0.25))))


# --- pixels (P25, P26, P35, P36) -----------------------------------------------------------------------------------------


def is_normalized(p999: Column, median: Column, least: Column) -> Column:
    """P25: whether pixel values run from 0 to 1."""
    return (p999 <= 1.5) & (median <= 1) & (least >= -0.25)


def agreed_scale(a: Column, b: Column) -> Column:
    """P25: the scale (adu or normalized) of a pair's images, from is_normalized of each; NULL where they differ."""
    return F.when(a == b, F.when(a, "normalized").otherwise("adu"))


def to_counts(pixels: Column, least: Column, greatest: Column, scale: float = 65535.0) -> Column:
    """P25: values of an image that lies between -0.1 and 1.1, times `scale`; others as they are."""
    small = (least >= -0.1) & (greatest <= 1.1)
    return F.transform(pixels, lambda v: F.when(small, v.cast("double") * scale).otherwise(v.cast("double")))


def clip_unit(pixels: Column, scale: float = 65535.0) -> Column:
    """Pixel values over a scale, clipped to [0, 1]."""
    return F.transform(pixels, lambda v: F.least(F.greatest(v.cast("double") / scale, F.lit(0.0)), F.lit(1.0)))


def to_uint16(pixels: Column) -> Column:
    """Pixel values from [0, 1] to whole numbers from 0 to 65535, half to even; not finite: 0."""
    return F.transform(pixels, lambda v: F.coalesce(F.bround(F.least(F.greatest(finite(v), F.lit(0.0)), F.lit(1.0)) * 65535), F.lit(0.0)).cast("int"))


def unit_range(pixels: Column, low: Column, high: Column) -> Column:
    """Pixel values from [low, high] (an image's finite ends, kept with it) to [0, 1], clipped where the ends are
    equal; infinite: 1 and 0, no number: 0."""
    inside = lambda v: F.when(high > low, (v - low) / (high - low)).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    return F.transform(F.transform(pixels, lambda v: v.cast("double")), lambda v: F.when(v == float("inf"), 1.0).otherwise(F.coalesce(inside(finite(v)), F.lit(0.0))))


def chromaticity(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(x, y, Y) of linear sRGB in [0, 1]; x and y only where 0.2 <= Y <= 0.99."""
    big = [0.4124 * r + 0.3576 * g + 0.1805 * b, 0.2126 * r + 0.7152 * g + 0.0722 * b, 0.0193 * r + 0.1192 * g + 0.9505 * b]
    total, ok = big[0] + big[1] + big[2], (big[1] >= 0.2) & (big[1] <= 0.99)
    return F.when(ok, big[0] / total), F.when(ok, big[1] / total), big[1]


def log_stretch(x: Column, low: Column, high: Column) -> Column:
    """Logarithm of 1 + 1000 times the value above the least one, as a share of its range."""
    return F.when(high > low, F.log1p(1000 * (x - low)) / F.log1p(1000 * (high - low))).otherwise(0.0)


def clip_mask(x: Column, low: float = 0.01, high: float = 0.1) -> Column:
    """1 in the middle of [0, 1], falling to 0 over the lowest `low` and the highest `high`."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / low, (1 - x) / high))


# --- texts and states (P29-P31, P41) -----------------------------------------------------------------------------------


def message_text(content: Column, embeds: Column) -> Column:
    """Content, then title, description, field names and values, footer and author of each embed, a line each."""
    fields = lambda e: F.flatten(F.transform(F.coalesce(e["fields"], F.array().cast("array<struct<name:string,value:string>>")), lambda f: F.array(f["name"], f["value"])))
    lines = F.flatten(F.transform(F.coalesce(embeds, F.array()), lambda e: F.concat(F.array(e["title"], e["description"]), fields(e), F.array(e["footer"], e["author"]))))
    return F.trim(F.array_join(F.filter(F.concat(F.array(content), lines), lambda s: s.isNotNull() & (s != "")), "\n"))


def roof_state(text: Column) -> Column:
    """OPEN is tested before CLOSED; a text that has no "roof" is UNKNOWN."""
    t = F.lower(text)
    return F.when(~t.contains("roof"), "UNKNOWN").when(t.contains("open"), "OPEN").when(t.contains("closing") | t.contains("closed"), "CLOSED").otherwise("UNKNOWN")


def is_roof_text(text: Column) -> Column:
    t = F.lower(text)
    return t.contains("roof") & (t.contains("open") | t.contains("closing") | t.contains("closed"))


def weather_values(states: Column) -> Column:
    """Array of {Name, Value} as a map by lower-case name; nulls are left out, the first of a name stays."""
    good = F.filter(states, lambda s: s["Value"].isNotNull() & s["Name"].isNotNull())
    names = F.array_distinct(F.transform(good, lambda s: F.lower(s["Name"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(good, lambda s: F.lower(s["Name"]) == n), 1)["Value"]))


#: The weather conditions that count.
CONDITIONS = ["DewPoint", "Humidity", "SkyTemperature", "Temperature", "WindSpeed"]


def condition_count(states: Column) -> Column:
    """How many of the conditions an array of {Name, Value} has, whatever their case; other names do not count."""
    names = F.transform(F.filter(states, lambda s: s["Name"].isNotNull()), lambda s: F.lower(s["Name"]))
    return F.coalesce(F.size(F.array_intersect(names, F.array(*[F.lit(c.lower()) for c in CONDITIONS]))), F.lit(0))


def site_state(roof_ok: Column, roof_safe: Column, weather_count: Column) -> Column:
    """An unknown roof comes before an unsafe one, that before missing weather, else SAFE."""
    return F.when(~F.coalesce(roof_ok, F.lit(False)), "ROOF_UNKNOWN").when(~F.coalesce(roof_safe, F.lit(False)), "ROOF_UNSAFE").when(weather_count == 0, "WEATHER_UNAVAILABLE").otherwise("SAFE")


def primary_role(roles: Column, priority: dict[str, int] = ROLE_PRIORITY) -> Column:
    """The role with the smallest priority (99 for unknown ones), then by name."""
    ranked = F.transform(roles, lambda r: F.struct(F.coalesce(lookup(priority, r), F.lit(99)).alias("p"), r.alias("r")))
    return F.array_min(ranked)["r"]


def filter_rank(x: Column, order: list[str] = FILTER_ORDER) -> Column:
    """Place of a filter in the usual order, 99 for others."""
    return F.coalesce(lookup({f: i for i, f in enumerate(order)}, x), F.lit(99))
