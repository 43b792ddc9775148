"""Scalar functions of the curation stages as columns; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.settings import Folders, QualityLimits, Settings


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Last suffix in lower case without its dot; '' if there is none or the name only starts with a dot."""
    return F.lower(F.regexp_extract(file_name(name), r"^.+\.([^.]+)$", 1))


def stem(name: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(name), r"(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    """The last suffix with its dot and its own case, or ''."""
    return F.regexp_extract(file_name(name), r"^.+(\.[^.]+)$", 1)


def classify(ext: Column, settings: Settings = Settings()) -> Column:
    """photo, non_photo or unsupported by extension; null counts as unsupported."""
    return F.when(ext.isin(*settings.photo_extensions), "photo").when(ext.isin(*settings.non_photo_extensions), "non_photo").otherwise("unsupported")


def exif_datetime(text: Column) -> Column:
    """``Y:M:D h:m:s`` as TIMESTAMP_NTZ, also with single digits and blanks around; null if it is no such time."""
    return F.try_to_timestamp(F.trim(text), F.lit("y:M:d H:m:s")).cast("timestamp_ntz")


def first_time(*candidates: tuple[Column, str]) -> tuple[Column, Column]:
    """The first time that is not null, and the name of its source."""
    time = F.coalesce(*[c for c, _ in candidates])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for c, name in candidates])
    return time, source


def day_name(index: Column, prefix: str = "day") -> Column:
    """``day01``: at least two digits, more if needed."""
    return F.format_string(prefix + "%02d", index)


def day_index(name: Column, prefix: str = "day") -> Column:
    """The number in a day's name, or null."""
    return F.regexp_extract(name, f"^{prefix}([0-9]+)$", 1).try_cast("int")


def numeric_suffix(identifier: Column, prefix: str) -> Column:
    """The number of ``cluster012`` or ``burst003``; an identifier of another form is an error."""
    digits = F.regexp_extract(identifier, f"^{prefix}([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"not a {prefix} id: "), F.coalesce(identifier, F.lit("null")))).cast("int"))


def orientation(width: Column, height: Column) -> Column:
    """landscape, portrait or square; null without both sides."""
    return F.when(width > height, "landscape").when(height > width, "portrait").when(width == height, "square")


def hamming(left: Column, right: Column) -> Column:
    """Bits in which two 64-bit values differ."""
    return F.bit_count(left.bitwiseXOR(right))


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once a row, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def dot(left: Column, right: Column) -> Column:
    """Sum of products of two arrays, in double."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 if a side has length zero, null if a side is null or the lengths differ."""
    same = left.isNotNull() & right.isNotNull() & (F.size(left) == F.size(right))
    return _given(norm(left) * norm(right), lambda both: F.when(same & (both == 0), 0.0).when(same, dot(left, right) / both))


def cosine_distance(left: Column, right: Column) -> Column:
    """One minus the cosine similarity."""
    return 1.0 - cosine(left, right)


def unit(vector: Column) -> Column:
    """The array scaled to length one; null if its length is zero. The length is taken once, not for each value."""
    return _given(norm(vector), lambda length: F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)))


def pixel_similarity(left: Column, right: Column) -> Column:
    """``max(0, 1 - mean |a - b| / 255)`` of two equally long pixel arrays; null if they aren't."""
    gap = F.aggregate(F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    n = F.size(left)
    return F.when((n == F.size(right)) & (n > 0), F.greatest(F.lit(0.0), 1.0 - gap / n / 255.0))


def difference_hash(pixels: Column, rows: int, cols: int) -> Column:
    """The bits ``right > left`` of a row-major grid, first pair first, as one BIGINT."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(cols - 2)), lambda c: F.when(F.get(pixels, r * cols + c + 1) > F.get(pixels, r * cols + c), 1).otherwise(0))))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))


def histogram(values: Column, bins: int = 8, top: int = 256) -> Column:
    """Shares of the values in equal bins over [0, top); all zero for an empty array."""
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(values, lambda v: F.floor(v * bins / top) == b)).cast("double"))
    return F.transform(each, lambda n: n / F.greatest(F.size(values), F.lit(1)))


def laplacian_variance(pixels: Column, rows: int, cols: int) -> Column:
    """Population variance of the four neighbours minus four times the centre, over inner pixels; 0 below 3 pixels a side."""
    if rows < 3 or cols < 3:
        return F.lit(0.0)
    at = lambda r, c: F.get(pixels, r * cols + c).cast("double")
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(rows - 2)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(cols - 2)), lambda c: at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c))))
    n = (rows - 2) * (cols - 2)
    mean = F.aggregate(inner, F.lit(0.0), lambda s, x: s + x) / n
    return F.aggregate(F.zip_with(inner, F.array_repeat(mean, n), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / n


def sub_grid(pixels: Column, cols: int, top: int, left: int, height: int, width: int) -> Column:
    """The row-major pixels of a rectangle of a grid."""
    return F.flatten(F.transform(F.sequence(F.lit(top), F.lit(top + height - 1)), lambda r: F.slice(pixels, r * cols + left + 1, F.lit(width))))


def mean_of_top(values: Column, k: int) -> Column:
    """Mean of the ``k`` greatest values of an array."""
    top = F.slice(F.reverse(F.array_sort(values)), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)


def quality_reasons(blur: Column, brightness: Column, bright_share: Column, corrupt: Column | None = None, limits: QualityLimits = QualityLimits()) -> Column:
    """Reasons for rejection in their order: corrupt alone, else blurry, too_dark, too_bright; a null metric gives none."""
    checks = F.array(F.when(blur < limits.blur_below, "blurry"), F.when(brightness < limits.dark_below, "too_dark"), F.when(bright_share > limits.bright_share_above, "too_bright"))
    reasons = F.array_compact(checks)
    return reasons if corrupt is None else F.when(corrupt, F.array(F.lit("corrupt"))).otherwise(reasons)


def route(reasons: Column, folders: Folders = Folders()) -> tuple[Column, Column]:
    """(destination_category, destination_subfolder) of a photo with these reasons; a corrupt one lands among non-photos."""
    corrupt = F.array_contains(reasons, "corrupt")
    category = F.when(F.size(reasons) == 0, "accepted").otherwise("rejected")
    return category, F.when(corrupt, folders.not_photo).when(F.size(reasons) > 0, folders.low_quality)


def destination(day: Column, category: Column, subfolder: Column, name: Column, folders: Folders = Folders()) -> Column:
    """Path below the root: the day itself, or its rejected folder."""
    below = F.when(category == "not_photo", folders.not_photo).when(category == "rejected", F.coalesce(subfolder, F.lit(folders.low_quality)))
    return F.concat_ws("/", day, F.when(below.isNotNull(), folders.rejected), below, name)


def in_reserved_folder(relative_path: Column, folders: Folders = Folders()) -> Column:
    """Whether a folder strictly between the day and the file is reserved."""
    parts = F.split(relative_path, "/")
    between = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    names = [folders.rejected, folders.low_quality, folders.not_photo, folders.duplicates, folders.chosen]
    return F.arrays_overlap(between, F.array(*map(F.lit, names)))


def survivor_name(cluster: Column, burst: Column, number: Column, name: Column) -> Column:
    """``c001_b002_003`` with the suffix the file had."""
    return F.concat(F.format_string("c%03d_b%03d_%03d", cluster, burst, number), suffix(name))
