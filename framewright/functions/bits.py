"""Bit strings: fingerprints of 256 bits as four 64-bit words, their segments and distances.

FN-02 (bit step) and FN-03 of the inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 256
WORDS = ("w0", "w1", "w2", "w3")


def with_words(df: DataFrame, column: str) -> DataFrame:
    """Adds w0..w3, the 64-bit words of a hex fingerprint of 64 digits."""
    return df.withColumns(
        {
            w: F.conv(F.substring(column, 16 * i + 1, 16), 16, -10).cast("long")
            for i, w in enumerate(WORDS)
        }
    )


def bits_of(start: int, length: int) -> Column:
    """Bits start..start+length of the words as a number, first bit most significant."""
    word, at = divmod(start, 64)
    mask = F.lit((1 << length) - 1)
    end = at + length
    if end <= 64:
        return F.shiftrightunsigned(F.col(WORDS[word]), 64 - end).bitwiseAND(mask)
    over = end - 64
    high = F.shiftleft(F.col(WORDS[word]), over)
    low = F.shiftrightunsigned(F.col(WORDS[word + 1]), 64 - over)
    return high.bitwiseOR(low).bitwiseAND(mask)


def segments(parts: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(start, length) of `parts` segments that cover all bits."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def segment_array(parts: int) -> Column:
    """ARRAY<BIGINT> of the segments of w0..w3, each with its position in the high bits."""
    return F.array(
        *[
            F.lit(i << 56).cast("long").bitwiseOR(bits_of(s, n))
            for i, (s, n) in enumerate(segments(parts))
        ]
    )


def distance(a: str, b: str) -> Column:
    """Different bits of two rows' words, whose names have the prefixes a and b."""
    return sum(
        (F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in WORDS), F.lit(0)
    )


def gradient_bits(values: Column, width: int, height: int = 1) -> Column:
    """BIGINT of up to 64 bits: 1 where a value is larger than its right neighbour.

    values: row-major array of height rows with width + 1 values; first bit most significant.
    """
    if width * height > 64:
        raise ValueError("more than 64 bits: cut the rows into words")
    places = [r * (width + 1) + c for r in range(height) for c in range(width)]
    return F.aggregate(
        F.array(*[F.lit(p) for p in places]),
        F.lit(0).cast("long"),
        lambda acc, p: F.shiftleft(acc, 1).bitwiseOR(
            (F.element_at(values, p + 1) > F.element_at(values, p + 2)).cast("long")
        ),
    )


def gradient_words(values: Column, size: int = 16) -> list[Column]:
    """w0..w3 of a grey picture of size + 1 columns and size rows (16 x 16 bits)."""
    rows = size * size // 64 * (64 // size) // (size * size // 64)  # rows per word
    per_word = rows * (size + 1)
    return [
        gradient_bits(F.slice(values, 1 + w * per_word, per_word), size, rows).alias(WORDS[w])
        for w in range(size * size // 64)
    ]
