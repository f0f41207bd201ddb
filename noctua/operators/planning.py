"""Night planning: altitudes over a time grid, eligibility windows, moonless runs and the choice of the next session.

Sun and Moon come from published low-precision series (about 0.01 degrees for the Sun, 0.3 for the Moon, without
parallax), in column arithmetic, so a grid of any size stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.scalar import illumination

# --- P27: places in the sky ------------------------------------------------------------------------------------------------


def days_2000(t: Column) -> Column:
    """Days since 2000-01-01 12:00 UTC."""
    return F.unix_micros(t.cast("timestamp")) / 86400e6 - 10957.5


def _equatorial(lon: Column, lat: Column, d: Column) -> tuple[Column, Column]:
    e = F.radians(23.439 - 0.0000004 * d)
    ra = F.atan2(F.sin(lon) * F.cos(e) - F.tan(lat) * F.sin(e), F.cos(lon))
    dec = F.asin(F.sin(lat) * F.cos(e) + F.cos(lat) * F.sin(e) * F.sin(lon))
    return F.pmod(F.degrees(ra), F.lit(360.0)), F.degrees(dec)


def sun_longitude(d: Column) -> Column:
    """Ecliptic longitude, degrees."""
    g = F.radians(357.528 + 0.9856003 * d)
    return F.pmod(280.460 + 0.9856474 * d + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g), F.lit(360.0))


def sun(t: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the Sun, degrees."""
    d = days_2000(t)
    return _equatorial(F.radians(sun_longitude(d)), F.lit(0.0), d)


def moon_ecliptic(d: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the Moon, degrees, by the main terms of its motion."""
    c = d / 36525
    sin = lambda a, b: F.sin(F.radians(a + b * c))
    lon = 218.32 + 481267.881 * c + 6.29 * sin(135.0, 477198.87) - 1.27 * sin(259.3, -413335.36) + 0.66 * sin(235.7, 890534.22) + 0.21 * sin(269.9, 954397.74) - 0.19 * sin(357.5, 35999.05) - 0.11 * sin(186.5, 966404.03)
    lat = 5.13 * sin(93.3, 483202.02) + 0.28 * sin(228.2, 960400.89) - 0.28 * sin(318.3, 6003.15) - 0.17 * sin(217.6, -407332.21)
    return F.pmod(lon, F.lit(360.0)), lat


def moon(t: Column) -> tuple[Column, Column]:
    d = days_2000(t)
    lon, lat = moon_ecliptic(d)
    return _equatorial(F.radians(lon), F.radians(lat), d)


def moon_illumination(t: Column) -> Column:
    """Percent of the disc, from the elongation of the Sun."""
    d = days_2000(t)
    lon, lat = moon_ecliptic(d)
    return illumination(F.acos(F.cos(F.radians(lat)) * F.cos(F.radians(lon - sun_longitude(d)))))


def sidereal_degrees(t: Column, longitude: Column) -> Column:
    """Local sidereal time; longitude east, degrees."""
    return F.pmod(280.46061837 + 360.98564736629 * days_2000(t) + longitude, F.lit(360.0))


def altitude(ra: Column, dec: Column, t: Column, latitude: Column, longitude: Column) -> Column:
    """Degrees above the horizon, without refraction."""
    h, d, b = F.radians(sidereal_degrees(t, longitude) - ra), F.radians(dec), F.radians(latitude)
    return F.degrees(F.asin(F.sin(b) * F.sin(d) + F.cos(b) * F.cos(d) * F.cos(h)))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees between two places, well conditioned for small ones."""
    a1, d1, a2, d2 = (F.radians(c) for c in (ra1, dec1, ra2, dec2))
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin((a2 - a1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def sky_context(frames: DataFrame, t: str, latitude: str, longitude: str, ra: str, dec: str) -> DataFrame:
    """moon_altitude, moon_illumination, moon_separation and object_altitude of each frame."""
    at, b, x = F.col(t), F.col(latitude), F.col(longitude)
    m_ra, m_dec = moon(at)
    return frames.withColumns({"moon_altitude": altitude(m_ra, m_dec, at, b, x), "moon_illumination": moon_illumination(at), "moon_separation": separation(m_ra, m_dec, F.col(ra), F.col(dec)), "object_altitude": altitude(F.col(ra), F.col(dec), at, b, x)})


# --- W9-W11, G42, G43, O5 --------------------------------------------------------------------------------------------------


def time_grid(nights: DataFrame, start: str, end: str, minutes: int = 5, margin: int = 60) -> DataFrame:
    """Steps t from start - margin to end + margin minutes, both ends included."""
    edge = F.make_dt_interval(mins=F.lit(margin))
    return nights.withColumn("t", F.explode(F.sequence(F.col(start) - edge, F.col(end) + edge, F.make_dt_interval(mins=F.lit(minutes)))))


def islands(rows: DataFrame, keys: list[str], order: list[str], ok: Column) -> DataFrame:
    """Rows where ok holds, with `island`, one number for each unbroken run of them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    x = x.withColumn("_new", (F.col("_ok") & ~F.coalesce(F.lag("_ok").over(w), F.lit(False))).cast("int"))
    return x.withColumn("island", F.sum("_new").over(w)).where("_ok").drop("_ok", "_new")


def eligibility(grid: DataFrame, keys: list[str], t: str, ok: Column) -> DataFrame:
    """Windows of consecutive good steps: keys, slot (from 1), first and last good step.  A window of one step has no
    length."""
    return islands(grid, keys, [t], ok).groupBy(*keys, F.col("island").alias("slot")).agg(F.min(t).alias("slot_start"), F.max(t).alias("slot_end"), F.count("*").alias("steps"))


def moonless_run(grid: DataFrame, keys: list[str], t: str, moon_altitude: str, dawn: str) -> DataFrame:
    """The longest run with the Moon below the horizon (strictly): run_start, run_end, seconds.

    A run that moonrise ends lasts to the step before; one that reaches the last step lasts to dawn; of equal ones the first counts."""
    last = F.max(t).over(Window.partitionBy(*keys))
    runs = islands(grid.withColumn("_last", last), keys, [t], F.col(moon_altitude) < 0).groupBy(*keys, "island").agg(F.min(t).alias("s"), F.max(t).alias("e"), F.first("_last").alias("_last"), F.first(dawn).alias("_dawn"))
    runs = runs.withColumn("e", F.when(F.col("e") == F.col("_last"), F.col("_dawn")).otherwise(F.col("e")))
    seconds = (F.unix_micros(F.col("e").cast("timestamp")) - F.unix_micros(F.col("s").cast("timestamp"))) / 1e6
    best = runs.groupBy(*keys).agg(F.max(F.struct(seconds.alias("d"), (-F.unix_micros(F.col("s").cast("timestamp"))).alias("o"), "s", "e")).alias("m"))
    return best.select(*keys, F.col("m.s").alias("run_start"), F.col("m.e").alias("run_end"), F.col("m.d").alias("seconds"))


def moonless_total(runs: DataFrame, keys: list[str], least: float = 3600.0) -> DataFrame:
    """Nights with a run of at least `least` seconds, and their seconds."""
    return runs.where(F.col("seconds") >= least).groupBy(*keys).agg(F.count("*").alias("nights"), F.sum("seconds").alias("seconds"))


def visible_hours(grid: DataFrame, keys: list[str], altitude_: str, minimum: float, hours: str) -> DataFrame:
    """Share of the night's steps above the minimum times its length."""
    return grid.groupBy(*keys).agg((F.avg((F.col(altitude_) > minimum).cast("double")) * F.first(hours)).alias("visible_hours"))


def rising_day(days: DataFrame, keys: list[str], day: str, altitude_: str, wanted: float) -> DataFrame:
    """The first day on which the altitude rises through the wanted one, else the day of the greatest altitude."""
    above = F.col(altitude_) - wanted
    before = F.lag(altitude_).over(Window.partitionBy(*keys).orderBy(day)) - wanted
    x = days.withColumn("_up", F.coalesce((before < 0) & (above >= 0), F.lit(False)))
    got = x.groupBy(*keys).agg(F.min(F.when(F.col("_up"), F.col(day))).alias("_first"), F.min_by(day, F.struct(-F.col(altitude_), F.col(day))).alias("_best"))
    return got.select(*keys, F.coalesce("_first", "_best").alias("day"), F.col("_first").isNotNull().alias("rises"))


def pick_next(sessions: DataFrame, slots: DataFrame, key: str, now: Column) -> DataFrame:
    """The session to run at an instant: of those with work left and a slot that ends after now (the first such slot
    counts, begun or not), the one whose slot ends first; then by priority, then by remaining work, then by key."""
    first = slots.where(F.col("slot_end") > now).groupBy(key).agg(F.min(F.struct("slot_start", "slot_end")).alias("m")).select(F.col(key).alias("_k"), F.col("m.slot_end").alias("slot_end"))
    return sessions.where((F.col("remaining") > 0) & ~F.col("complete")).join(first, F.col(key) == F.col("_k")).drop("_k").orderBy(F.asc_nulls_last("slot_end"), F.desc("priority"), F.desc("remaining"), key).limit(1)
