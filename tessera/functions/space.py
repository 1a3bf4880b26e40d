"""Unicode white space, the same in Python and in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points with the Unicode property White_Space.
_POINTS = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

WHITE_SPACE = "".join(map(chr, _POINTS))


def trimmed(c: Column) -> Column:
    """Without white space at both ends (Spark's plain trim takes the blank only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))
