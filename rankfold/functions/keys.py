"""Key expressions: 64-bit order keys of common types, bit lengths, Morton codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone; no session setting matters."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def signed(unsigned: Column) -> Column:
    """An order-keeping BIGINT of a DECIMAL(20,0) key below 2^64."""
    return (unsigned.cast("decimal(21,0)") - F.lit(1 << 63).cast("decimal(21,0)")).cast("long")


def bits(c: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(c == 0, 0).otherwise(F.length(F.bin(c.cast("long")))).cast("long")


def morton_code(axes: list[Column], width: int) -> Column:
    """Interleaved bits of two to four integers below 2^width, the first in the lowest places; width * axes < 64."""
    n, out = len(axes), None
    for k, c in enumerate(axes):
        c, bits_ = c.cast("long"), None
        for i in range(width):
            b = F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1)), i * n + k)
            bits_ = b if bits_ is None else bits_.bitwiseOR(b)
        out = bits_ if out is None else out.bitwiseOR(bits_)
    return out


def morton_axis(z: Column, axis: int, axes: int, width: int) -> Column:
    """The integer that a Morton code holds for one of its axes."""
    out = None
    for i in range(width):
        b = F.shiftleft(F.shiftright(z, i * axes + axis).bitwiseAND(F.lit(1)), i)
        out = b if out is None else out.bitwiseOR(b)
    return out


def _word_bits(axes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of an integer in each word of morton_words(): as many as fit a positive BIGINT, the highest first."""
    per = 63 // axes
    return [(at, min(per, 64 - at)) for at in reversed(range(0, 64, per))]


def morton_words(axes: list[Column]) -> Column:
    """Interleaved bits of two to four integers of any BIGINT value, the first in the lowest places: an array of codes.

    Arrays compare in the order of the whole code; negative integers follow the others.  A word is null if an integer is.
    Bits are set apart by reading binary digits as digits to the base 2^axes.
    """
    n, words = len(axes), []
    for at, width in _word_bits(n):
        word = None
        for k, c in enumerate(axes):
            digits = F.bin(F.shiftright(c.cast("long"), at).bitwiseAND(F.lit((1 << width) - 1)))
            b = F.shiftleft(F.conv(digits, 1 << n, 10).cast("long"), k)
            word = b if word is None else word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def morton_words_axis(words: Column, axis: int, axes: int) -> Column:
    """The integer that morton_words() hold for one of their axes."""
    out = None
    for i, (at, width) in enumerate(_word_bits(axes)):
        places = F.lit(sum(1 << j * axes for j in range(width)))
        digits = F.conv(F.shiftright(words[i], axis).bitwiseAND(places).cast("string"), 10, 1 << axes)
        b = F.shiftleft(F.conv(digits, 2, 10).cast("long"), at)
        out = b if out is None else out.bitwiseOR(b)
    return out


def unit(i: Column, seed: int) -> Column:
    """A number in (0, 1) for each non-negative integer: products modulo 2^32, the high half folded into the low one in between.

    Streams of different seeds are unlike; all steps are integer operations that any SQL engine has.
    """
    whole = F.lit(1 << 32)

    def folded(c: Column) -> Column:
        return c.bitwiseXOR(F.shiftright(c, 16))

    x = folded((F.pmod(i, F.lit(1 << 30)) * 2654435761 + seed * 1013904223) % whole)
    for _ in range(2):
        x = folded((x * 73244475) % whole)
    return (x + 0.5) / float(1 << 32)
