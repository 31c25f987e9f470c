"""Numbers: sizes as text, guarded ratios, budgets and generators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
# Offsets that a read probe begins with, at borders of chunks and of 4 GiB.
BORDERS = (0, 262_143, 262_144, 4_294_967_295, 4_294_967_419, 8_589_934_591, 8_589_934_715)


def parse_size(text: Column) -> Column:
    """Bytes of 256K, 1MiB, 4g and the like: whole numbers, binary units; null for anything else."""
    upper = F.upper(F.trim(text))
    unit = F.regexp_extract(upper, r"^\+?([0-9]+)([KMG]?)I*B*\z", 2)
    number = F.regexp_extract(upper, r"^\+?([0-9]+)([KMG]?)I*B*\z", 1)
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(number != "", number.cast("long") * factor)


def human_bytes(n: Column) -> Column:
    """0 B, 512 B, 2 KiB, 1.50 MiB ...; Unavailable for null."""
    place = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.log(F.abs(n).cast("double")) / F.log(F.lit(1024.0)) + 1e-12))).cast("int")
    value = n / F.pow(F.lit(1024.0), place)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KiB", "MiB", "GiB", "TiB"))), place + 1)
    shown = F.when(place > 1, F.format_string("%.2f", value)).otherwise(F.format_string("%.0f", value))
    return F.when(n.isNull(), "Unavailable").when(n == 0, "0 B").otherwise(F.concat_ws(" ", shown, unit))


def savings(original: Column, optimized: Column) -> Column:
    """Percent saved; null where a size is unknown or there is nothing to save of."""
    return F.when(original > 0, (original - optimized) / original * 100)


def power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def divide_up(n: Column, by: int) -> Column:
    return F.floor((n + by - 1) / by)


def disk_budget(logical: Column, entries: Column, chunk: int, loose: bool, copies: int = 1) -> Column:
    """A cautious estimate of the bytes that packing needs: all data uncompressed, the smallest chunks,
    metadata a chunk and entry, and a reserve."""
    chunks = divide_up(logical, chunk // 4) + entries
    return (logical + chunks * (8192 if loose else 1024) + entries * 16384 + (64 << 20)) * copies


def xorshift(seed: int, n: int) -> list[int]:
    """The first n states of the 64-bit xorshift generator with shifts 13, 7, 17."""
    out = []
    for _ in range(n):
        seed ^= seed << 13 & MASK
        seed ^= seed >> 7
        seed ^= seed << 17 & MASK
        out.append(seed)
    return out


def xorshift_column(seed: int, n: Column) -> Column:
    """The n-th state as a signed number, by a fold: for any n without a table."""
    signed = seed - (1 << 64) if seed >> 63 else seed
    step = lambda s, _: _mix(_mix(_mix(s, F.shiftleft, 13), F.shiftrightunsigned, 7), F.shiftleft, 17)
    return F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(signed).cast("long"), step)


def _mix(s: Column, shift, by: int) -> Column:
    return s.bitwiseXOR(shift(s, by))


def probe_offset(i: Column, size: Column, draw: Column) -> Column:
    """The i-th offset of a read probe: first what lies at chunk and 4 GiB borders and at the file's end,
    where it is in the file, then a drawn one."""
    borders = F.array(*(F.lit(x).cast("long") for x in BORDERS), F.greatest(F.lit(0), size - 37), size, size + 1)
    border = F.get(borders, i.cast("int"))
    return F.when(border <= size + 1, border).otherwise(F.pmod(draw, F.greatest(F.lit(1), size)))
