"""Column expressions for cleaning and geometry; all guarded for ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(x: Column) -> Column:
    """Text to a finite double, else null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def safe_long(x: Column) -> Column:
    """Via double, cut toward zero."""
    return safe_double(x).try_cast("long")


def to_bool(x: Column) -> Column:
    text = F.lower(F.trim(x))
    return F.when(text.isin("true", "1", "yes"), 1).when(text.isin("false", "0", "no"), 0)


def trial_label(x: Column) -> Column:
    """'T01', '1' or 1 to '1'; other text without its leading T as it is, null as ''."""
    text = F.regexp_replace(F.trim(F.coalesce(x.cast("string"), F.lit(""))), "^[Tt]", "")
    return F.coalesce(text.try_cast("int").cast("string"), text)


def normal_id(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), " -", "__")


def iso_time(ms: Column) -> Column:
    """UTC whatever the session's time zone."""
    at = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def filetime_ms(ticks: Column) -> Column:
    """100-ns ticks since 1601 (a long) to epoch milliseconds, by whole-number division."""
    return F.call_function("div", ticks, F.lit(10000)) - F.lit(11644473600000)


#: Screen rectangles of each role, first match wins: name, x1, y1, x2, y2 (closed).
AREAS = {
    "director": (("timer", 613, 8, 735, 65), ("map", 640, 166, 1120, 831), ("toolbar", 236, 0, 1018, 74)),
    "matcher": (("timer", 613, 8, 735, 65), ("map", 560, 166, 1040, 831), ("toolbar", 236, 0, 1365, 74)),
}


def area_of(x: Column, y: Column, role: Column, areas: dict = AREAS) -> Column:
    """Name of the area of a role's screen; unknown roles see the director's."""
    out = F.when(x.isNull() | y.isNull(), "missing")
    for who in sorted(areas, key=lambda who: who == "director"):
        own = F.lit(True) if who == "director" else role.eqNullSafe(F.lit(who))
        for name, x1, y1, x2, y2 in areas[who]:
            out = out.when(own & x.between(x1, x2) & y.between(y1, y2), name)
        out = out.when(own, "other")
    return out


def to_map(x: Column, y: Column, area=(100, 100, 300, 700), width: int = 651, height: int = 900) -> tuple[Column, Column]:
    x1, y1, x2, y2 = area
    return (x - x1) * width / (x2 - x1), (y - y1) * height / (y2 - y1)


def from_map(u: Column, v: Column, area=(100, 100, 300, 700), width: int = 651, height: int = 900) -> tuple[Column, Column]:
    x1, y1, x2, y2 = area
    return u * (x2 - x1) / width + x1, v * (y2 - y1) / height + y1


def mean_pupil(left: Column, right: Column) -> Column:
    """Mean of the positive eyes."""
    a, b = F.when(left > 0, left), F.when(right > 0, right)
    return F.coalesce((a + b) / 2, a, b)


def ibi(bpm: Column) -> Column:
    return F.when(bpm > 0, 60000 / bpm)


def shifted(t: Column, offset: Column) -> Column:
    """t + offset, rounded half to even; times that are no numbers stay as they are."""
    return F.when(offset == 0, t).otherwise(F.bround(t + offset).cast("long"))


def heading(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def plog2(p: Column) -> Column:
    return p * F.log2(p + 1e-12)


def corr(x: str, y: str) -> Column:
    """Pearson over a group; null where a variance is 0."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    sxy, sx, sy = F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sx > 1e-12) & (sy > 1e-12), sxy / (sx * sy))


def slope(y: Column, x: Column) -> Column:
    return F.when(F.var_pop(x) > 1e-12, F.covar_pop(y, x) / F.var_pop(x))
