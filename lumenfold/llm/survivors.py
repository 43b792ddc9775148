"""One surviving record for each group of duplicates, chosen field by field.

Fields are unpivoted to long rows (group, field, normalised value, record). Spellings of one
value share its votes; the winner keeps the spelling of its record. Each row votes for its value with the trust in its source times the decay of its age; votes are summed per
value before anything is shuffled, ``max_by`` takes the winning value and the record that
carries it best, and the winners are pivoted back to one row. With ``half_life=None`` the
decay is total: a more trusted or, at equal trust, more recent record outvotes any number of
others, which is the rule of a strict order of preference.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.timestamps import valid_date


@dataclass(frozen=True)
class Field:
    """How a field is judged.

    ``value`` is null where unusable; ``trust`` is that in the source, which weighs a vote;
    ``prefer`` ranks values of equally trusted sources; ``recent`` prefers late records, and
    lets votes decay; ``same`` is equal for spellings of one value.
    """

    name: str
    value: Column
    trust: Column
    recent: bool = True
    same: Column | None = None
    prefer: Column | None = None


_ISO = r"^\s*(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?([zZ]|[+-]\d{2}(?::?\d{2})?)?\s*$"


def _iso_parts(text: Column) -> Column:
    """Year, month, day, hour, minute, second, fraction and zone of an ISO time as texts, missing ones empty."""
    return F.split(F.regexp_replace(text, _ISO, "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$7\x01$8"), "\x01", -1)


def valid_iso_time(text: Column) -> Column:
    """Whether a text is an ISO date with a time of day that exists in the calendar."""
    parts = _iso_parts(text)
    n = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    second = F.when(F.get(parts, F.lit(5)) == "", 0).otherwise(n(5))
    return F.coalesce((F.size(parts) == 8) & valid_date(n(0), n(1), n(2)) & (n(3) <= 23) & (n(4) <= 59) & (second <= 59), F.lit(False))


def iso_key(text: Column) -> Column:
    """One text for all spellings of an ISO time: its seconds, in UTC and marked Z if it names a zone, and its fraction."""
    parts = _iso_parts(text)
    part = lambda i: F.get(parts, F.lit(i))
    n = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    days = F.unix_date(F.concat_ws("-", part(0), part(1), part(2)).try_cast("date")).cast("long")
    zone = F.regexp_replace(part(7), ":", "")
    away = F.when(F.length(zone) > 1, (n(F.substring(zone, 2, 2)) * 3600 + n(F.substring(zone, 4, 2)) * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)).otherwise(0)
    seconds = days * 86_400 + n(part(3)) * 3600 + n(part(4)) * 60 + n(part(5)) - away
    return F.concat(seconds.cast("string"), F.lit("."), F.regexp_replace(part(6), "0+$", ""), F.when(zone == "", "").otherwise("Z"))


def stripped(text: Column) -> Column:
    """The text without white space around it, also other than blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def field_winners(records: DataFrame, group: Column, record_id: str, recorded_at: str, fields: Sequence[Field], half_life_days: float | None = None) -> DataFrame:
    """(group_key, n_records > 1, <field>_record_id, <field>_value, <field>_support): the winners of groups of two or more.

    Rows with a null group or record id are left out; a group counts if it has two distinct
    record ids. ``_record_id`` is -1 and ``_value`` null where no record has a usable value;
    ``_support`` is the share of the votes its value got. A null time is older than any.
    Ties go to the smallest record id. Groups of any size are aggregated before the shuffle.
    """
    at = F.unix_micros(F.col(recorded_at).cast("timestamp"))
    now = F.lit(0.0)
    decay = F.lit(1.0)
    if half_life_days is not None:
        age = (F.lit(4_102_444_800.0) - F.coalesce(at / 1e6, now)) / 86_400  # to a fixed day, so a result doesn't depend on the clock
        decay = F.pow(F.lit(2.0), -(age / half_life_days) + F.lit(28_000 / half_life_days))
    choice = lambda f: F.struct(
        F.lit(f.name).alias("field"), f.value.cast("string").alias("value"), F.when(f.value.isNotNull(), f.value if f.same is None else f.same).cast("string").alias("same"), f.trust.cast("double").alias("trust"), (F.lit(0.0) if f.prefer is None else f.prefer.cast("double")).alias("prefer"),
        (F.coalesce(at, F.lit(-(1 << 62))) if f.recent else F.lit(0).cast("long")).alias("recency"), (f.trust.cast("double") * decay if f.recent and half_life_days is not None else f.trust.cast("double")).alias("vote"),
    )
    rows = records.select(group.alias("group_key"), F.col(record_id).cast("long").alias("rid"), F.explode(F.array(*[choice(f) for f in fields])).alias("f")).where("group_key is not null and rid is not null")
    long = rows.select("group_key", "rid", "f.*")
    # the best record of a value: most trusted, then preferred, then latest, then of the smallest id
    rank = F.struct("trust", "prefer", "recency", (-F.col("rid")).alias("neg"), "value")
    usable = F.col("value").isNotNull()
    values = long.groupBy("group_key", "field", "same").agg(
        F.max(F.when(usable, rank)).alias("best"), F.sum(F.when(usable, F.col("vote"))).alias("votes"), F.min("rid").alias("low"), F.max("rid").alias("high")
    )
    strict = half_life_days is None
    score = F.struct("best") if strict else F.struct("votes", "best")
    chosen = values.groupBy("group_key", "field").agg(
        F.max_by(F.struct("best.value", (-F.col("best.neg")).alias("rid"), "votes"), F.when(F.col("best").isNotNull(), score)).alias("winner"), F.sum("votes").alias("all_votes"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    pick = lambda f, c: F.max(F.when(F.col("field") == f.name, c))
    columns = [
        c
        for f in fields
        for c in (
            F.coalesce(pick(f, F.col("winner.rid")), F.lit(-1)).alias(f"{f.name}_record_id"),
            pick(f, F.col("winner.value")).alias(f"{f.name}_value"),
            pick(f, F.col("winner.votes") / F.nullif(F.col("all_votes"), F.lit(0.0))).alias(f"{f.name}_support"),
        )
    ]
    return chosen.groupBy("group_key").agg(*columns, F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").drop("low", "high")


def member_fields() -> list[Field]:
    """The fields of a member record and how each is judged."""
    source = F.lower(stripped(F.col("timestamp_source")))
    trust = F.when(source == "exif", 3.0).when(source == "mtime", 2.0).otherwise(1.0)
    sharp = (F.col("blur_score") >= 0) & ~F.isnan("blur_score") & (F.col("blur_score") < float("inf"))
    return [
        Field("blur", F.when(sharp, F.col("blur_score")), F.lit(1.0), recent=False, prefer=F.when(sharp, F.col("blur_score"))),
        Field("captured", F.when(valid_iso_time(F.col("captured_at")), F.col("captured_at")), trust, same=iso_key(F.col("captured_at"))),
        Field("path", F.when(stripped(F.col("relative_path")) != "", F.col("relative_path")), F.lit(1.0), same=stripped(F.col("relative_path"))),
    ]


def surviving_members(records: DataFrame, half_life_days: float | None = None) -> DataFrame:
    """The survivor of each asset with several member records: the winning record and value of each field."""
    key = F.upper(stripped(F.col("asset_key")))
    return field_winners(records, F.when(key != "", key), "record_id", "recorded_at", member_fields(), half_life_days).withColumnRenamed("group_key", "asset_key")
