"""Scan filters as one predicate, and the reason why a row fails it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.columns import file_name, normalized_extensions

#: Extensions whose records take part in the similarity search.
SIMILARITY_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tif", ".tiff", ".heic")
MAX_DISTANCE = 64


@dataclass(frozen=True)
class ScanFilter:
    """All bounds are inclusive; what is None or empty does not filter. ``exclude_system`` is accepted and does nothing."""

    include_extensions: list[str] = field(default_factory=list)
    exclude_extensions: list[str] = field(default_factory=list)
    min_size: int | None = None
    max_size: int | None = None
    from_utc: datetime | None = None
    to_utc: datetime | None = None
    exclude_hidden: bool = True
    exclude_system: bool = True

    def rules(self) -> list[tuple[str, Column]]:
        """(reason, predicate that a kept row meets), in the order in which reasons are given."""
        ext, size, time = F.col("extension"), F.col("size_bytes"), F.col("last_write_utc")
        included, excluded = normalized_extensions(self.include_extensions), normalized_extensions(self.exclude_extensions)
        rules: list[tuple[str, Column]] = []
        if included:
            rules.append(("extension not included", ext.isin(*included)))
        if excluded:
            rules.append(("extension excluded", ~ext.isin(*excluded)))
        if self.min_size is not None:
            rules.append(("too small", size >= self.min_size))
        if self.max_size is not None:
            rules.append(("too large", size <= self.max_size))
        if self.from_utc is not None:
            rules.append(("too old", time >= F.lit(self.from_utc)))
        if self.to_utc is not None:
            rules.append(("too new", time <= F.lit(self.to_utc)))
        if self.exclude_hidden:
            rules.append(("hidden", ~file_name(F.col("full_path")).startswith(".")))
        return rules

    def predicate(self) -> Column:
        return reduce(lambda a, b: a & b, (p for _, p in self.rules()), F.lit(True))

    def reject_reason(self) -> Column:
        """The first rule that a row fails (an unknown value fails), null for a kept row."""
        reason = F.lit(None).cast("string")
        for name, kept in reversed(self.rules()):
            reason = F.when(F.coalesce(kept, F.lit(False)), reason).otherwise(F.lit(name))
        return reason


def similarity_eligible() -> Column:
    return F.col("extension").isin(*SIMILARITY_EXTENSIONS)


def checked_distance(value: object) -> int:
    """A Hamming distance from 0 to 64; raises ValueError for anything else."""
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= MAX_DISTANCE:
        raise ValueError(f"a distance is a whole number from 0 to {MAX_DISTANCE}, not {value!r}")
    return value
