"""Pictures made of columns."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray_bitmap(pixels: Column, width: int, height: int) -> Column:
    """A BMP file of the first width times height numbers (0 to 255, row by row) of an array; null where there are fewer or other numbers."""
    padding = -3 * width % 4
    size = height * (3 * width + padding)
    head = struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0)
    lines = [F.lit(head.hex())]
    for row in reversed(range(height)):  # the format starts with the lowest row
        own = F.transform(F.slice(pixels, row * width + 1, width), lambda v: F.repeat(F.lpad(F.hex(v.cast("int")), 2, "0"), 3))
        lines.append(F.concat(F.array_join(own, ""), F.lit("00" * padding)))
    fits = (F.size(pixels) >= width * height) & F.forall(pixels, lambda v: v.between(0, 255))
    return F.when(fits, F.unhex(F.concat(*lines)))
