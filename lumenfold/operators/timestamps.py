"""Mixed timestamp spellings and zones brought to one instant.

Every spelling is a branch of one regular expression. A single ``regexp_replace`` turns a
text into its named components, calendar ranges are checked with integers, and the instant
is assembled from a day number, so no spelling is tried twice and nothing leaves the JVM.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import broadcast_if_small

#: English month names as they are abbreviated in the texts.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_BLANK = r"[\s\x00\x85\xA0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF]*"
_TIME = r"(?<{p}h>\d{{1,2}}):(?<{p}mi>\d{{2}})(?::(?<{p}s>\d{{2}})(?:[.,](?<{p}f>\d+))?)?"
_ZONE = r"(?:\s*(?<{p}off>[zZ]|(?i:UTC|GMT)?[+-]\d{{1,2}}(?::?\d{{2}})?)(?:\[[^\]]*\])?|\s*(?<{p}abbr>[A-Za-z]{{3,5}})|\s*\[(?<{p}iana>[^\]]+)\])?"
_MONTH = r"(?<{p}mon>[A-Za-z]{{3}})[A-Za-z]*\.?"

#: One branch for each family of spellings; named groups carry the branch's prefix.
BRANCHES = {
    # 2024:01:31 12:00:00, 2024-01-31T12:00:00.5+01:00[Europe/Berlin], 2024/1/31 9:05
    "y": r"(?<yy>\d{4})[:/-](?<ym>\d{1,2})[:/-](?<yd>\d{1,2})[Tt\s]\s*" + _TIME.format(p="y") + r"(?:\s*(?<yap>[aApP])\.?[mM]\.?)?" + _ZONE.format(p="y"),
    # 20240131_120000, 20240131T120000Z
    "c": r"(?<cy>\d{4})(?<cm>\d{2})(?<cd>\d{2})[_Tt\s-](?<ch>\d{2})(?<cmi>\d{2})(?<cs>\d{2})?(?:[.,](?<cf>\d+))?" + _ZONE.format(p="c"),
    # 31/01/2024 or 01/31/2024, by the device's order
    "l": r"(?<la>\d{1,2})/(?<lb>\d{1,2})/(?<ly>\d{4}),?[Tt\s]\s*" + _TIME.format(p="l") + r"(?:\s*(?<lap>[aApP])\.?[mM]\.?)?" + _ZONE.format(p="l"),
    # 31.01.2024, day first
    "d": r"(?<dd>\d{1,2})\.(?<dm>\d{1,2})\.(?<dy>\d{4}),?[Tt\s]\s*" + _TIME.format(p="d") + r"(?:\s*(?<dap>[aApP])\.?[mM]\.?)?" + _ZONE.format(p="d"),
    # Jan 31, 2024 9:05:00 pm
    "n": _MONTH.format(p="n") + r"\s+(?<nd>\d{1,2}),?\s+(?<ny>\d{4}),?\s+" + _TIME.format(p="n") + r"(?:\s*(?<nap>[aApP])\.?[mM]\.?)?" + _ZONE.format(p="n"),
    # Wed, 31 Jan 2024 09:05:00 +0100, 31 Jan 2024 09:05:00 CET
    "r": r"(?:[A-Za-z]{3,9},?\s+)?(?<rd>\d{1,2})\s+" + _MONTH.format(p="r") + r"\s+(?<ry>\d{4}),?\s+" + _TIME.format(p="r") + r"(?:\s*(?<rap>[aApP])\.?[mM]\.?)?" + _ZONE.format(p="r"),
    # seconds, milliseconds or microseconds since 1970
    "e": r"(?<en>-?\d{9,17})",
}
PATTERN = "^" + _BLANK + "(?:" + "|".join(BRANCHES.values()) + ")" + _BLANK + "$"

#: What each component is read from; at most one of the groups is filled.
_COMPONENTS = {
    "year": ("yy", "cy", "ly", "dy", "ny", "ry"),
    "month": ("ym", "cm", "dm"),
    "month_name": ("nmon", "rmon"),
    "day": ("yd", "cd", "dd", "nd", "rd"),
    "slash_a": ("la",),
    "slash_b": ("lb",),
    "hour": ("yh", "ch", "lh", "dh", "nh", "rh"),
    "minute": ("ymi", "cmi", "lmi", "dmi", "nmi", "rmi"),
    "second": ("ys", "cs", "ls", "ds", "ns", "rs"),
    "fraction": ("yf", "cf", "lf", "df", "nf", "rf"),
    "half": ("yap", "lap", "dap", "nap", "rap"),
    "offset": ("yoff", "coff", "loff", "doff", "noff", "roff"),
    "abbreviation": ("yabbr", "cabbr", "labbr", "dabbr", "nabbr", "rabbr"),
    "region": ("yiana", "ciana", "liana", "diana", "niana", "riana"),
    "epoch": ("en",),
}
_MARK = "\x01"
_REPLACEMENT = _MARK + _MARK.join("".join(f"${{{g}}}" for g in groups) for groups in _COMPONENTS.values())

_DAY_US = 86_400_000_000


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    y = F.when(month <= 2, year - 1).otherwise(year)
    era = F.floor(y / 400).cast("long")
    of_era = y - era * 400
    of_year = F.floor((F.lit(153) * F.when(month > 2, month - 3).otherwise(month + 9) + 2) / 5).cast("long") + day - 1
    return era * 146_097 + of_era * 365 + F.floor(of_era / 4).cast("long") - F.floor(of_era / 100).cast("long") + of_year - 719_468


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """Whether the three integers name a date of the years 1 to 9999."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce(year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= last), F.lit(False))


@lru_cache(maxsize=1)
def abbreviation_rows() -> tuple[tuple[str, str, list[tuple[int, int]]], ...]:
    """(zone, abbreviation, [(until, offset)..]) of every IANA zone, from 1970 to 2037.

    ``until`` is the last wall-clock second, counted from 1970, at which the zone meant
    ``offset`` by the abbreviation; beyond the last the last holds. Zones are probed twice a
    month and the ends found by halving. The table is bounded by the number of zones.
    """
    start = datetime(1970, 1, 1, tzinfo=timezone.utc)
    moments = [start + timedelta(days=15 * i) for i in range(68 * 24 + 24)]
    found = []
    for name in sorted(available_timezones()):
        zone = ZoneInfo(name)

        def meant(moment: datetime, zone: ZoneInfo = zone) -> tuple[str, int]:
            local = moment.astimezone(zone)
            return (local.tzname() or "").upper(), int(local.utcoffset().total_seconds())

        spans: dict[str, list[list]] = {}
        for moment in moments:
            short, offset = meant(moment)
            if short.isalpha():
                own = spans.setdefault(short, [])
                if own and own[-1][0] == offset:
                    own[-1][1] = moment
                else:
                    own.append([offset, moment])
        for short, own in spans.items():
            ends = []
            for offset, last in own[:-1]:
                low, high = last, last + timedelta(days=15)
                while high - low > timedelta(seconds=1):
                    middle = low + (high - low) / 2
                    low, high = (middle, high) if meant(middle) == (short, offset) else (low, middle)
                ends.append((int((low - start).total_seconds()) + offset, offset))
            found.append((name, short, [*ends, (2**53, own[-1][0])]))
    return tuple(found)


def _offset_seconds(text: Column) -> Column:
    """Seconds east of UTC of ``Z``, ``+h``, ``+hhmm``, ``+hh:mm`` or ``GMT+h:mm``; null out of range."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    short = F.length(digits) <= 2
    hours = F.when(short, digits).otherwise(F.regexp_replace(digits, "..$", ""))
    minutes = F.when(short, F.lit("0")).otherwise(F.right(digits, F.lit(2)))
    h, m = hours.try_cast("long"), minutes.try_cast("long")
    sign = F.when(text.contains("-"), -1).otherwise(1)
    return F.when(F.lower(text) == "z", F.lit(0).cast("long")).when((h <= 18) & (m <= 59), sign * (h * 3600 + m * 60))


def components(text: Column) -> Column:
    """The named components of a text as an array of strings, or an array of one element if no branch fits."""
    return F.split(F.regexp_replace(text, PATTERN, _REPLACEMENT), _MARK, -1)


def resolve_instants(df: DataFrame, text: str, zone: str, order: str, out: str = "captured_us") -> DataFrame:
    """``df`` with ``out``: the instant that column ``text`` names, in microseconds since 1970 UTC.

    ``zone`` names the column with the IANA zone of the clock, ``order`` the one with ``dmy``
    or ``mdy`` for dates with slashes (null: ``dmy``). A zone or offset in the text decides;
    an abbreviation is looked up among those of the clock zone (``UTC`` and ``GMT`` also
    elsewhere). A wall time that occurs twice is the first one, one that is skipped is read
    with the offset before the change. ``out`` is null where the text is null, empty, names
    no valid date and time of day, or needs a clock zone that is null or unknown. Every
    other column, and the number of rows, stay as they are.
    """
    taken = {c.lower() for c in df.columns}
    own = {k: f"__{k}" for k in ("parts", "wall", "off", "abbr", "iana", "epoch", "zone")}
    if taken & set(own.values()):
        raise ValueError("column names starting with __ are reserved")
    names = list(_COMPONENTS)
    part = lambda name: F.get(F.col(own["parts"]), F.lit(names.index(name) + 1))
    number = lambda name: part(name).try_cast("long")
    zones = sorted(available_timezones())

    month_first = F.lower(F.trim(F.col(order))) == "mdy"
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part("month_name")))
    slash = part("slash_a") != ""
    a, b = number("slash_a"), number("slash_b")
    month = F.when(slash, F.when(month_first, a).otherwise(b)).when(part("month_name") != "", named).otherwise(number("month"))
    day = F.when(slash, F.when(month_first, b).otherwise(a)).otherwise(number("day"))
    year, hour, minute = number("year"), number("hour"), number("minute")
    second = F.when(part("second") == "", F.lit(0)).otherwise(number("second"))
    micros = F.when(part("fraction") == "", F.lit(0)).otherwise(F.rpad(F.substring(part("fraction"), 1, 6), 6, "0").try_cast("long"))
    half = F.lower(part("half"))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    valid = valid_date(year, month, day) & (hour24 <= 23) & (minute <= 59) & (second <= 59)
    seconds = days_from_civil(year, month, day) * 86_400 + hour24 * 3600 + minute * 60 + second
    epoch = number("epoch")

    known = lambda c: F.when(c.isin(zones), c)
    parsed = (
        df.withColumn(own["parts"], components(F.col(text)))
        .withColumns(
            {
                own["wall"]: F.when(valid, seconds * 1_000_000 + micros),
                own["off"]: F.nullif(part("offset"), F.lit("")),
                own["abbr"]: F.nullif(F.upper(part("abbreviation")), F.lit("")),
                own["iana"]: known(part("region")),
                own["epoch"]: F.when(F.abs(epoch) < 100_000_000_000, epoch * 1_000_000).when(F.abs(epoch) < 100_000_000_000_000, epoch * 1000).otherwise(epoch),
                own["zone"]: known(F.trim(F.col(zone))),
            }
        )
        .drop(own["parts"])
    )
    spark = df.sparkSession
    table = spark.createDataFrame(list(abbreviation_rows()), "__z string, __a string, __spans array<struct<until: long, off: long>>")  # bounded by the IANA zones
    joined = parsed.join(F.broadcast(table), (F.col(own["zone"]) == F.col("__z")) & (F.col(own["abbr"]) == F.col("__a")), "left")
    fixed = F.when(F.col(own["off"]).isNotNull(), _offset_seconds(F.col(own["off"]))).otherwise(
        F.coalesce(F.get(F.filter("__spans", lambda e: e["until"] >= F.floor(F.col(own["wall"]) / 1_000_000)), F.lit(0))["off"], F.when(F.col(own["abbr"]).isin("UTC", "GMT", "UT"), F.lit(0).cast("long")))
    )
    wall = F.col(own["wall"])
    zoned = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), F.coalesce(own["iana"], own["zone"])))
    instant = F.when(F.col(own["off"]).isNotNull(), wall - fixed * 1_000_000).otherwise(F.coalesce(wall - fixed * 1_000_000, zoned))
    return joined.withColumn(out, F.coalesce(F.col(own["epoch"]), instant)).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def capture_instants(photo: DataFrame, device: DataFrame, trip: DataFrame) -> DataFrame:
    """(photo_id, captured_us): one row for each photo whose captured_at names a date and a time of day.

    The clock zone is the trip's host_zone where timestamp_source is ``mtime`` (case and
    blanks ignored), else the device's clock_zone. Repeated rows of a photo agree; were they
    to differ, the smallest instant counts. Rows with a null photo_id are left out, devices
    and trips listed twice count once.
    """
    rows = photo.select("photo_id", "trip_id", "device_id", "captured_at", "timestamp_source").where("photo_id is not null and captured_at is not null")
    clocks = device.groupBy("device_id").agg(F.min("clock_zone").alias("clock_zone"), F.min("date_order").alias("date_order"))
    hosts = trip.groupBy("trip_id").agg(F.min("host_zone").alias("host_zone"))
    by_file = F.lower(F.trim("timestamp_source")) == "mtime"
    # devices and trips are sent along if they are few, so the photos of a hot device stay where they are
    read = rows.join(broadcast_if_small(clocks, 100_000), "device_id", "left").join(broadcast_if_small(hosts, 200_000), "trip_id", "left").withColumn("wall_zone", F.when(by_file, F.col("host_zone")).otherwise(F.col("clock_zone")))
    found = resolve_instants(read, "captured_at", "wall_zone", "date_order").where("captured_us is not null")
    return found.groupBy("photo_id").agg(F.min("captured_us").alias("captured_us"))
