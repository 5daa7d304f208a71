"""Integer sequences and fingerprints on 64-bit columns masked to 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: FNV-1a offset basis and prime (32 bits).
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
#: States in a run of a sequence.
_RUN = 64


def _low32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def xorshift(s: Column) -> Column:
    """Next state of the 32-bit xorshift generator with shifts 13, 17, 5."""
    s = s.bitwiseXOR(_low32(F.shiftleft(s, 13)))
    s = s.bitwiseXOR(F.shiftright(s, 17))
    return s.bitwiseXOR(_low32(F.shiftleft(s, 5)))


def random_sequence(seed: Column, n: int) -> Column:
    """Array of the first ``n`` states from a seed (0 counts as 1)."""
    start = F.when(_low32(seed) == 0, F.lit(1).cast("long")).otherwise(_low32(seed.cast("long")))
    if n <= 0:
        return F.array().cast("array<bigint>")
    # an array is copied when it grows: states are made in short runs, and only the list of runs grows long
    grow = lambda a, _: F.concat(a, F.transform(F.array(F.element_at(a, -1)), xorshift))
    run = lambda s: F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(_RUN)), F.array(s), grow), 2, _RUN)
    more = lambda a, _: F.concat(a, F.transform(F.array(F.element_at(F.element_at(a, -1), -1)), run))
    runs = F.aggregate(F.sequence(F.lit(1), F.lit(-(-n // _RUN))), F.array(F.array(start)), more)
    return F.slice(F.flatten(runs), 2, n)


def fnv1a(bytes_: Column, basis: int = FNV_BASIS) -> Column:
    """FNV-1a over an array of byte values."""
    step = lambda h, b: _low32(h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long"))
    return F.aggregate(bytes_, F.lit(basis).cast("long"), step)


def little_endian(v: Column, n: int = 4) -> Column:
    """The ``n`` low bytes of an integer, lowest first."""
    return F.array(*[F.shiftright(v.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(n)])
