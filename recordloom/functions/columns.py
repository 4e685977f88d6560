"""Scalar columns of the record inventory, all built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions of each category, in the order in which categories are tried.
CATEGORY_EXTENSIONS = {
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".heic", ".heif", ".tiff", ".svg", ".raw"),
    "video": (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp"),
    "audio": (".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a", ".wma"),
    "text": (".txt", ".md", ".rtf", ".doc", ".docx", ".pdf", ".csv", ".json", ".xml", ".log"),
    "application": (".exe", ".msi", ".dmg", ".pkg", ".app", ".apk", ".bat", ".cmd", ".ps1", ".sh", ".jar", ".iso"),
    "archive": (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz"),
}
OTHER = "other"
#: The folder that each category is organized into.
FOLDERS = {"image": "Images", "video": "Videos", "audio": "Audio", "text": "Documents", "application": "Other", "archive": "Other", "other": "Other"}
#: The months of each season.
SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(name: Column) -> Column:
    """From the last dot, unless it leads or ends the name; case kept."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(suffix(name)))


def extension(path: Column) -> Column:
    return F.lower(suffix(file_name(path)))


def normalize_extension(text: Column) -> Column:
    """Lower-cased with a leading dot; null or blank becomes empty."""
    cleaned = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when((cleaned == "") | cleaned.startswith("."), cleaned).otherwise(F.concat(F.lit("."), cleaned))


def normalized_extensions(texts: list[str | None] | None) -> list[str]:
    """The same on a caller's literal list, without empties and repeats."""
    cleaned = ((t or "").strip().lower() for t in texts or [])
    return list(dict.fromkeys(c if c.startswith(".") else "." + c for c in cleaned if c))


def _mapped(values: Mapping[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def classify(ext: Column) -> Column:
    by_extension = {e: category for category, own in reversed(CATEGORY_EXTENSIONS.items()) for e in own}
    return F.coalesce(_mapped(by_extension)[ext], F.lit(OTHER))


def folder_name(category: Column) -> Column:
    return _mapped(FOLDERS)[category]


def season(month: Column) -> Column:
    """Fails the query on a month outside 1 to 12; null stays null."""
    named = F.when(month.isNull(), F.lit(None).cast("string"))
    for name, months in SEASONS.items():
        named = named.when(month.isin(*months), F.lit(name))
    return named.otherwise(F.raise_error(F.concat(F.lit("Invalid month: "), month.cast("string"))).cast("string"))


def _hundredths(size: Column, bits: int) -> Column:
    """``size / 2**bits`` with two decimals, exact ties to even."""
    rest = size.bitwiseAND(F.lit((1 << bits) - 1)) * 100  # below 2**57
    cents, over, half = F.shiftright(rest, bits), rest.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(1 << (bits - 1))
    cents = cents + F.when((over > half) | ((over == half) & (cents % 2 == 1)), 1).otherwise(0)
    whole = F.shiftright(size, bits) + F.when(cents == 100, 1).otherwise(0)
    return F.format_string("%d.%02d", whole, cents % 100)


def format_size(size: Column) -> Column:
    """Bytes in steps of 1024 from B to PB; two decimals above B."""
    units = ["KB", "MB", "GB", "TB", "PB"]
    size = size.cast("long")
    text = F.when(size < 1024, F.format_string("%d B", size))
    for k, unit in enumerate(units, start=1):
        scaled = F.concat(_hundredths(size, 10 * k), F.lit(f" {unit}"))
        text = text.otherwise(scaled) if unit == units[-1] else text.when(size < 1024 ** (k + 1), scaled)
    return text


def local_time(utc: Column, zone: str = "UTC") -> Column:
    """Wall-clock time of a UTC timestamp in a declared zone; the session's zone is taken to be UTC."""
    return F.from_utc_timestamp(utc, zone)


def destination_folder(target: Column | str, category: Column, utc: Column, zone: str = "UTC") -> Column:
    target = F.lit(target) if isinstance(target, str) else target
    local = local_time(utc, zone)
    return F.concat_ws("/", target, folder_name(category), F.date_format(local, "yyyy"), F.date_format(local, "MM"))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; the bare name for a path outside it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.char_length(path))).otherwise(file_name(path))


def _clean(path: Column) -> Column:
    """Without repeated or trailing slashes and without ``.`` segments."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/+", "/"), "(?<=.)/$", "")


def paths_equal(left: Column, right: Column) -> Column:
    return _clean(left) == _clean(right)


def is_sub_path(path: Column, root: Column) -> Column:
    """Whether a path is ``root`` or below it."""
    return paths_equal(path, root) | _clean(path).startswith(F.concat(F.regexp_replace(_clean(root), "/$", ""), F.lit("/")))


def numbered_name(name: Column, number: Column) -> Column:
    """``stem (n).suffix``; the name itself for 0."""
    return F.when(number > 0, F.concat(stem(name), F.lit(" ("), number.cast("string"), F.lit(")"), suffix(name))).otherwise(name)


def fingerprint_key() -> tuple[Column, Column, Column]:
    """The three columns that identify a version of a record: path, size, time in microseconds."""
    return F.col("full_path"), F.col("size_bytes"), F.unix_micros("last_write_utc").alias("mtime_us")


def _shown(value: Column) -> Column:
    """A value as Python shows it: texts in quotes, with backslashes and line breaks escaped; a null is None."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\\", r"\\\\"), "\n", r"\\n")
    single = F.concat(F.lit("'"), F.regexp_replace(text, "'", r"\\'"), F.lit("'"))
    quoted = F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(single)
    kind = F.typeof(value)
    return F.when(value.isNull(), F.lit("None")).when(kind == "string", quoted).when(kind == "boolean", F.initcap(value.cast("string"))).otherwise(value.cast("string"))


def error_message(operation: Column | str, path: Column | None = None, context: Mapping[str, Column] | None = None, error: Column | None = None) -> Column:
    """``operation (path='...', key=value): error`` with the keys in order and text values in quotes; absent parts are left out."""
    operation = F.lit(operation) if isinstance(operation, str) else operation
    details = [] if path is None else [F.concat(F.lit("path='"), path, F.lit("'"))]
    details += [F.concat(F.lit(f"{key}="), _shown(value)) for key, value in sorted((context or {}).items())]
    text = F.concat(operation, F.lit(" ("), F.concat_ws(", ", *details), F.lit(")")) if details else operation
    return text if error is None else F.when(error.isNull(), text).otherwise(F.concat(text, F.lit(": "), error))
