"""Publication times of any shape to one instant (problem 3).

All formats form one regular expression with named groups. An Arrow-batched UDF matches a value
once, checks its components against the calendar and adds them up by integer day arithmetic to a
wall clock. Only values without a zone touch the zone database, in a built-in JVM expression.
"""

from __future__ import annotations

import re
import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.functions.civil import DAY_US
from kiteloom.plans.runtime import small_side

# Month names of the four languages, by month.
MONTHS = [
    ["january", "jan", "januar", "jänner", "enero", "ene"],
    ["february", "feb", "februar", "febrero"],
    ["march", "mar", "märz", "mrz", "marzo"],
    ["april", "apr", "abril", "abr"],
    ["may", "mai", "mayo"],
    ["june", "jun", "juni", "junio"],
    ["july", "jul", "juli", "julio"],
    ["august", "aug", "agosto", "ago"],
    ["september", "sept", "sep", "septiembre", "setiembre"],
    ["october", "oct", "oktober", "okt", "octubre"],
    ["november", "nov", "noviembre"],
    ["december", "dec", "dezember", "dez", "diciembre", "dic"],
]

# Zone abbreviations and their usual offset in minutes.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120,
    "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "sgt": 480, "hkt": 480,
    "awst": 480, "kst": 540, "jst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "brt": -180, "art": -180, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360,
    "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480,
    "hst": -600,
}

# Units of relative times in the four languages, in seconds.
UNIT_SECONDS = {
    1: ["s", "sec", "secs", "second", "seconds", "sekunde", "sekunden", "segundo", "segundos", "초"],
    60: ["min", "mins", "minute", "minutes", "minuten", "minuto", "minutos", "분"],
    3600: ["h", "hr", "hrs", "hour", "hours", "stunde", "stunden", "hora", "horas", "시간"],
    86400: ["d", "day", "days", "tag", "tage", "tagen", "día", "días", "dia", "dias", "일"],
    604800: ["week", "weeks", "woche", "wochen", "semana", "semanas", "주", "주일"],
    2592000: ["month", "months", "monat", "monate", "monaten", "mes", "meses", "개월", "달"],
    31536000: ["year", "years", "jahr", "jahre", "jahren", "año", "años", "년"],
}

_MONTH_RE = "|".join(sorted((n for names in MONTHS for n in names), key=len, reverse=True))
_ABBR_RE = "|".join(sorted(ZONE_MINUTES, key=len, reverse=True))
_ZONE_RE = rf"(?:(?:utc|gmt)?[+\-−]\d{{1,2}}(?::?\d{{2}})?|{_ABBR_RE})"
_WEEKDAY_RE = r"(?:[^\W\d_]{2,10}\.?,?\s+)"


def _clock(k: int) -> str:
    """Time of day, with seconds, fraction, half of the day and zone where given."""
    return (
        rf"(?P<a{k}>오전|오후)?\s*(?P<h{k}>\d{{1,2}})(?::(?P<n{k}>\d{{2}})(?::(?P<s{k}>\d{{2}})(?:[.,](?P<f{k}>\d{{1,9}})\d*)?)?"
        rf"(?:\s*(?P<p{k}>[ap]\.?\s?m\.?)(?![a-z]))?|시(?:\s*(?P<nn{k}>\d{{1,2}})분)?)(?:\s*uhr)?(?:\s*(?P<z{k}>{_ZONE_RE}))?"
    )


#: One alternative for each shape; the number ties a shape's groups together.
_SHAPES = {
    # year first: 2023-01-02T03:04:05.6Z, 2023/1/2, 2023. 1. 2., 2023년 1월 2일 오후 3:04
    1: rf"(?P<y1>\d{{4}})(?:-|/|\.\s*|년\s*)(?P<m1>\d{{1,2}})(?:-|/|\.\s*|월\s*)(?P<d1>\d{{1,2}})(?:\.|일)?(?:(?:t|,?\s+){_clock(1)})?",
    # compact: 20230104T225503Z
    2: rf"(?P<y2>\d{{4}})(?P<m2>\d{{2}})(?P<d2>\d{{2}})(?:t(?P<h2>\d{{2}})(?P<n2>\d{{2}})(?P<s2>\d{{2}})?(?:[.,](?P<f2>\d{{1,9}}))?(?P<z2>{_ZONE_RE})?)?",
    # day, month name, year: Tue, 03 Jan 2023 01:26:00 +0900; 15. Januar 2023; 15 de enero de 2023; 2 January
    3: rf"{_WEEKDAY_RE}?(?P<d3>\d{{1,2}})(?:\.|st|nd|rd|th)?(?:\s+|-)(?:de\s+)?(?P<b3>{_MONTH_RE})\.?(?:,?(?:\s+|-)(?:de\s+)?(?P<y3>\d{{4}}|\d{{2}})(?![\d:]))?(?:,?\s+(?:at\s+|um\s+|a las\s+)?{_clock(3)})?",
    # month name first: January 19th, 2023 at 5:28 AM; Jan 14
    4: rf"{_WEEKDAY_RE}?(?P<b4>{_MONTH_RE})\.?\s+(?P<d4>\d{{1,2}})(?:st|nd|rd|th)?(?![\d:])(?:,?\s+(?P<y4>\d{{4}})(?!\d|:))?(?:,?\s+(?:at\s+)?{_clock(4)})?",
    # dots, day first: 26.11.2024, 23:18 Uhr
    5: rf"(?P<d5>\d{{1,2}})\.\s?(?P<m5>\d{{1,2}})\.\s?(?P<y5>\d{{4}})(?:,?\s+{_clock(5)})?",
    # slashes, month first: 09/27/2025 5:26 AM
    6: rf"(?P<m6>\d{{1,2}})/(?P<d6>\d{{1,2}})/(?P<y6>\d{{4}})(?:,?\s+{_clock(6)})?",
    # month and day in Korean: 3월 4일
    7: rf"(?P<m7>\d{{1,2}})월\s*(?P<d7>\d{{1,2}})일(?:,?\s+{_clock(7)})?",
    # counts since 1970
    8: r"(?P<e8>\d{9,13})",
    # relative
    9: r"(?P<r9>\d{1,6})\s*(?P<u9>[^\W\d_]+)\s+(?:ago|전)",
    10: r"(?:vor|hace)\s+(?P<r10>\d{1,6})\s+(?P<u10>[^\W\d_]+)",
}
PATTERN = re.compile(
    r"[\s\u200b\ufeff]*(?:published(?:\s+on)?:?\s+|posted\s+on\s+)?(?:"
    + "|".join(f"(?P<shape{k}>{shape})" for k, shape in _SHAPES.items())
    + r")[\s\u200b\ufeff]*",
    re.IGNORECASE,
)
_GROUPS = {k: {n[: -len(str(k))]: n for n in PATTERN.groupindex if re.fullmatch(rf"[a-z]+{k}", n)} for k in _SHAPES}
_MONTH_OF = {name: i + 1 for i, names in enumerate(MONTHS) for name in names}
_UNIT_OF = {name: seconds for seconds, names in UNIT_SECONDS.items() for name in names}
_MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _lookup(key: Column, pairs: dict[str, int]) -> Column:
    """Value of a small fixed map, null where the key is missing."""
    flat = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def offset_micros(zone: Column) -> Column:
    """Offset of a zone text such as Z, KST, +0900, UTC+9; null where it is none."""
    z = F.lower(F.regexp_replace(F.trim(zone), "−", "-"))
    numeric = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    hh = F.regexp_extract(z, numeric, 2).try_cast("int")
    mm = F.coalesce(F.regexp_extract(z, numeric, 3).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(z, numeric, 1) == "-", -1).otherwise(1)
    minutes = F.when(
        z.rlike(numeric), F.when((hh <= 15) & (mm <= 59), sign * (hh * 60 + mm))
    ).otherwise(_lookup(z, ZONE_MINUTES))
    return minutes.cast("long") * 60_000_000


def zone_names(spark: SparkSession) -> DataFrame:
    """(zone_key, zone_id): the names of the zone database, keys in lower case; about 600 rows."""
    names = sorted(
        n for n in zoneinfo.available_timezones()
        if n not in ("localtime", "posixrules", "Factory") and not n.startswith(("posix/", "right/", "SystemV/"))
    )
    return spark.createDataFrame([(n.lower(), n) for n in names], "zone_key string, zone_id string")


def site_zones(sites: DataFrame) -> DataFrame:
    """One row per site: (zone_site, zone_fixed_us, zone_id, zone_known).

    Blank or null `tz` means UTC. Offsets lie east if positive. A text that names no zone gives
    zone_known = false. Repeated sites keep the first spelling in text order; null names are dropped.
    """
    tz = F.trim(F.regexp_replace(F.coalesce(F.col("tz"), F.lit("")), r"[\s ​﻿]+", " "))
    one = (
        sites.filter(F.col("name").isNotNull())
        .groupBy(F.col("name").alias("zone_site"))
        .agg(F.min(tz).alias("tz_text"))
    )
    names = F.broadcast(zone_names(sites.sparkSession))  # fixed size: the zone database
    joined = one.join(names, F.lower("tz_text") == F.col("zone_key"), "left")
    fixed = F.when(F.col("tz_text") == "", F.lit(0).cast("long")).otherwise(
        F.when(F.col("zone_id").isNull(), offset_micros(F.col("tz_text")))
    )
    return joined.select(
        "zone_site",
        fixed.alias("zone_fixed_us"),
        "zone_id",
        (fixed.isNotNull() | F.col("zone_id").isNotNull()).alias("zone_known"),
    )


def local_to_utc(local_us: Column, fixed_us: Column, zone_id: Column) -> Column:
    """Instant of a wall clock. A repeated time is the earlier one, a skipped one keeps the old offset."""
    by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone_id))
    return F.when(fixed_us.isNotNull(), local_us - fixed_us).when(zone_id.isNotNull(), by_zone)


def civil_days(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01, None where the calendar has no such date."""
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if not (1 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= _MONTH_DAYS[m - 1] + (m == 2 and leap)):
        return None
    y -= m <= 2
    day_of_year = ((m + 9) % 12 * 153 + 2) // 5 + d - 1
    return y * 365 + y // 4 - y // 100 + y // 400 + day_of_year - 719468


def zone_offset(text: str) -> int | None:
    """Microseconds east of UTC of a stated zone."""
    z = text.strip().lower().replace("\u2212", "-")
    if z in ZONE_MINUTES:
        return ZONE_MINUTES[z] * 60_000_000
    m = re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", z)
    if not m or int(m[2]) > 15 or int(m[3] or 0) > 59:
        return None
    return (int(m[2]) * 60 + int(m[3] or 0)) * 60_000_000 * (-1 if m[1] == "-" else 1)


def read_components(text: str, fetched_us: int | None):
    """(utc, wall clocks, offset, yearless) of one text: an instant, or wall clocks of which the first fitting one counts.

    The offset is None where the text states no zone. None where no shape fits or the date is impossible.
    """
    match = PATTERN.fullmatch(text)
    if match is None:
        return None
    k = int(next(n for n in _SHAPES if match[f"shape{n}"] is not None))
    got = {part: match[name] for part, name in _GROUPS[k].items() if match[name] is not None}
    if "e" in got:
        return int(got["e"]) * (1000 if len(got["e"]) >= 12 else 1_000_000), (), None, False
    if "r" in got:
        seconds = _UNIT_OF.get(got["u"].lower())
        return None if seconds is None or fetched_us is None else (fetched_us - int(got["r"]) * seconds * 1_000_000, (), None, False)
    month = int(got["m"]) if "m" in got else _MONTH_OF[got["b"].lower()]
    hour, minute, second = int(got.get("h", 0)), int(got.get("n", got.get("nn", 0))), int(got.get("s", 0))
    half = {"p": 12, "오후": 12, "a": 0, "오전": 0}.get(got["a"] if "a" in got else got.get("p", "")[:1].lower())
    if half is not None:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + half
    if hour > 23 or minute > 59 or second > 59:
        return None
    clock = ((hour * 60 + minute) * 60 + second) * 1_000_000 + int(got.get("f", "0").ljust(6, "0")[:6])
    offset = zone_offset(got["z"]) if "z" in got else None
    if "z" in got and offset is None:
        return None
    if "y" in got:
        year = int(got["y"])
        years = [year + (2000 if year < 70 else 1900) if len(got["y"]) == 2 else year]
    elif fetched_us is None:
        return None
    else:  # the latest such date at most a day after the fetch; February 29 may lie eight years back
        now = 1970 + fetched_us // (365.2425 * DAY_US)
        years = [int(now) + step for step in range(2, -10, -1)]
    days = [civil_days(y, month, int(got["d"])) for y in years]
    walls = tuple(d * DAY_US + clock for d in days if d is not None)
    if "y" not in got:
        walls = tuple(w for w in walls if w <= fetched_us + 2 * DAY_US)[:3]
    return (None, walls, offset, "y" not in got) if walls else None


COMPONENTS = "struct<utc:bigint,first:bigint,second:bigint,third:bigint,offset:bigint,limited:boolean>"


def components_batch(text: pd.Series, fetched_us: pd.Series) -> pd.DataFrame:
    rows = []
    for value, fetched in zip(text, fetched_us):
        got = read_components(value, None if pd.isna(fetched) else int(fetched)) if value is not None else None
        if got is None:
            rows.append((None, None, None, None, None, None))
            continue
        utc, walls, offset, dateless = got
        padded = (*walls, None, None, None)[:3]
        rows.append((utc, *padded, offset, dateless))
    columns = list(zip(*rows)) if rows else [()] * 6
    names = ["utc", "first", "second", "third", "offset"]
    out = pd.DataFrame({n: pd.array(c, dtype="Int64") for n, c in zip(names, columns)})
    out["limited"] = pd.array(columns[5], dtype="boolean")
    return out


def with_instant(df: DataFrame, raw: str, fetched_us: str, into: str = "utc_us") -> DataFrame:
    """Adds microseconds since 1970 UTC of the text `raw`; null where it fixes no instant.

    Needs the columns zone_fixed_us and zone_id of `attach_zones`. A date without year has up to three
    wall clocks, the latest first; the first one at most a day after the fetch counts.
    """
    keep = [F.col(c) for c in df.columns]
    read = df.withColumn("_c", F.pandas_udf(components_batch, COMPONENTS)(F.col(raw), F.col(fetched_us)))
    stated = F.col("_c.offset").isNotNull()
    fixed = F.when(stated, F.col("_c.offset")).otherwise(F.col("zone_fixed_us"))
    zone = F.when(~stated, F.col("zone_id"))
    at = [local_to_utc(F.col(f"_c.{name}"), fixed, zone) for name in ("first", "second", "third")]
    limit = F.col(fetched_us) + DAY_US
    chosen = F.coalesce(
        F.when(~F.col("_c.limited") | (at[0] <= limit), at[0]),
        F.when(at[1] <= limit, at[1]),
        F.when(at[2] <= limit, at[2]),
    )
    return read.select(*keep, F.coalesce(F.col("_c.utc"), chosen).alias(into))


def attach_zones(df: DataFrame, sites: DataFrame, site: str = "site") -> DataFrame:
    """Adds the zone columns of the row's site; a site that is not registered counts as UTC."""
    zones = small_side(site_zones(sites))
    joined = df.join(zones, df[site] == zones["zone_site"], "left").drop("zone_site")
    missing = F.col("zone_known").isNull()
    return joined.withColumn(
        "zone_fixed_us", F.when(missing, F.lit(0).cast("long")).otherwise(F.col("zone_fixed_us"))
    ).drop("zone_known")
