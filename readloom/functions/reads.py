"""Column functions on reads: flags, reference span, scaffolds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: names of scaffolds.
SCAFFOLD = r"^chrUn|_alt$|_random$"


def has(bit: int, flag: str | Column = "flag") -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(bit) != 0


def cigar_span(cigar: str | Column) -> Column:
    """Reference bases of a CIGAR: M, D, N, = and X."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    parts = F.regexp_extract_all(c, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def is_scaffold(chrom: str | Column = "chrom") -> Column:
    return (F.col(chrom) if isinstance(chrom, str) else chrom).rlike(SCAFFOLD)


def gcd_of(values: Column) -> Column:
    """Greatest common divisor of an array of longs (0 of none): Euclid's steps as a fold; 48 are enough for 32-bit numbers."""

    def gcd(a, b):
        start = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        steps = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
        return steps["a"]

    return F.aggregate(values, F.lit(0).cast("long"), gcd)
