"""All pairs between the members of two units, for units of any size.

A unit is a set of rows that are alike (copies of one text). What is compared are units; here the pairs of units that
were found are spread to the pairs of their members, which is the result itself. A unit of more than SIDE rows is cut
into parts by hash, and each task gets one part of either side, so no task sees more than about SIDE x SIDE pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 2_000


def expand(members: DataFrame, pairs: DataFrame, unit: list[str], keep: list[str], side: int = SIDE) -> DataFrame:
    """pairs(<unit>_a, <unit>_b, ...) with the columns ``keep`` of every member of either unit as <column>_a and <column>_b. ``members``: unit, keep."""
    sizes = members.groupBy(*unit).agg(F.ceil(F.count("*") / side).cast("int").alias("parts"))
    p = pairs
    for x in "ab":
        p = p.join(sizes.select(*(F.col(c).alias(f"{c}_{x}") for c in unit), F.col("parts").alias(f"parts_{x}")), [f"{c}_{x}" for c in unit])
    both = [f"{c}_{x}" for x in "ab" for c in unit]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = []
    for x, y in ("ab", "ba"):
        m = members.select(*(F.col(c).alias(f"{c}_{x}") for c in unit), *(F.col(c).alias(f"{c}_{x}") for c in keep))
        m = m.join(p.select(*both, "parts_a", "parts_b"), [f"{c}_{x}" for c in unit])
        part = F.pmod(F.xxhash64(*(f"{c}_{x}" for c in keep)), F.col(f"parts_{x}")).cast("int").alias(f"part_{x}")
        sides.append(m.select(*both, *(f"{c}_{x}" for c in keep), part, f"parts_{y}").withColumn(f"part_{y}", every(f"parts_{y}")).drop(f"parts_{y}"))
    joined = sides[0].join(sides[1], [*both, "part_a", "part_b"]).drop("part_a", "part_b")
    more = [c for c in pairs.columns if c not in both]
    return joined.join(pairs, both) if more else joined
