"""Addresses and hierarchical names.

A name is a path of up to 7 components, 0 to 254, packed into a bigint, first component in the highest byte, each
stored plus one; the lowest byte stays 0. `ordered` maps names to bigints whose signed order is the names' order, so
that a subtree is a range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 7


def _long(x) -> Column:
    return F.lit(x).cast("long")


def name(*components: Column) -> Column:
    out = _long(0)
    for i, c in enumerate(components[:DEPTH]):
        out = out.bitwiseOR(F.when(c.isNull(), _long(0)).otherwise(F.shiftleft(c.cast("long") + 1, 56 - 8 * i)))
    return out


def byte(dn: Column, level: int) -> Column:
    return F.shiftrightunsigned(dn, 56 - 8 * level).bitwiseAND(_long(255))


def component(dn: Column, level: int) -> Column:
    b = byte(dn, level)
    return F.when(b > 0, b - 1)


def depth(dn: Column) -> Column:
    out = F.lit(DEPTH)
    for i in reversed(range(DEPTH)):
        out = F.when(byte(dn, i) == 0, F.lit(i)).otherwise(out)
    return out.cast("long")


def cut(dn: Column, levels: int) -> Column:
    """The ancestor of so many levels."""
    mask = ((1 << 8 * levels) - 1) << (64 - 8 * levels)
    return dn.bitwiseAND(_long(mask - (1 << 64) if mask >> 63 else mask))


def parent(dn: Column) -> Column:
    """Null for the root."""
    out = F.lit(None).cast("long")
    for d in range(1, DEPTH + 1):
        out = F.when(depth(dn) == d, cut(dn, d - 1)).otherwise(out)
    return out


def ancestors(dn: Column) -> Column:
    """From the parent upwards, without the root."""
    every = F.array(*(F.struct(_long(d).alias("d"), cut(dn, d).alias("dn")) for d in reversed(range(1, DEPTH))))
    own = depth(dn)
    return F.transform(F.filter(every, lambda x: x.d < own), lambda x: x.dn)


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether a's subtree holds b; the root's holds all."""
    out = F.lit(True)
    for d in range(1, DEPTH + 1):
        out = F.when(depth(a) == d, cut(b, d) == cut(a, d)).otherwise(out)
    return out


def common_depth(a: Column, b: Column) -> Column:
    out = F.lit(DEPTH)
    for i in reversed(range(DEPTH)):
        out = F.when((byte(a, i) != byte(b, i)) | (byte(a, i) == 0), F.lit(i)).otherwise(out)
    return out.cast("long")


def ordered(dn: Column) -> Column:
    return dn.bitwiseXOR(_long(-(1 << 63)))


def subtree(dn: int) -> tuple[int, int]:
    """Smallest and largest `ordered` value of a subtree, itself included."""
    dn &= (1 << 64) - 1
    own = next((i for i in range(DEPTH) if not dn >> (56 - 8 * i) & 255), DEPTH)
    return dn - (1 << 63), (dn | ((1 << (64 - 8 * own)) - 1)) - (1 << 63)


def zone(address: Column) -> Column:
    """surface (prefix 0x00-0x0F), fluid (0x10-0x7F), node (0x80-0xFF) of a 16-bit address."""
    prefix = F.shiftright(address, 8)
    return F.when(prefix < 16, "surface").when(prefix < 128, "fluid").otherwise("node")


def child(dn: Column, component: Column) -> Column:
    """The child of a name by its component; null below the deepest level."""
    out = F.lit(None).cast("long")
    for d in range(DEPTH):
        out = F.when(depth(dn) == d, dn.bitwiseOR(F.shiftleft(component.cast("long") + 1, 56 - 8 * d))).otherwise(out)
    return out


def last_below(dn: Column) -> Column:
    """The last name of a subtree: all ones below the name's own levels."""
    out = _long(-1)
    for d in range(1, DEPTH + 1):
        out = F.when(depth(dn) == d, dn.bitwiseOR(_long((1 << (64 - 8 * d)) - 1))).otherwise(out)
    return out
