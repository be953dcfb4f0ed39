"""Reproducible sample, stable as data grows (problem 7): a Feistel permutation.

An image's identifier is a number: the 64 bits of transaction_id, then the bytes of image_id,
then one end byte, cut into words of 56 bits. Identifiers of one length form a fixed domain,
and an unbalanced Feistel network permutes it: the first word is mixed with a function of the
others, then each other word with a function of the first. Each half-round can be undone, so
different identifiers never meet. An identifier is selected if the first permuted word lies
under rate x 2^56. Nothing but identifier, seed and rate decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 14  # hex digits of a word of 56 bits
ROUNDS = 4


def identifier_words(transaction_id: Column, image_id: Column) -> Column:
    """ARRAY<BIGINT> of 56-bit words, another array for every identifier."""
    number = F.lpad(F.hex(transaction_id.cast("long")), 16, "0")
    digits = F.concat(number, F.hex(F.encode(image_id, "UTF-8")), F.lit("80"))
    count = F.ceil(F.length(digits) / DIGITS)
    padded = F.rpad(digits, count * DIGITS, F.lit("0"))
    return F.transform(
        F.sequence(F.lit(0), (count - 1).cast("int")),
        lambda i: _word(F.substring(padded, i * DIGITS + 1, F.lit(DIGITS))),
    )


def _word(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _mix(*parts: Column) -> Column:
    return _word(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS))


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row.

    A plain projection is merged into the ones that use it, and a filter on it is pushed below;
    either repeats the expression, here at each round twice. A generator is not merged.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def permuted(df: DataFrame, words: str, seed: int, name: str = "permuted") -> DataFrame:
    """Adds `name`: the first word of the permuted identifier in `words`."""
    kept = df.columns
    df = _bound(df, "_w", F.col(words))
    first, others = F.col("_w")[0], F.slice("_w", F.lit(2), F.size("_w"))
    for k in range(1, ROUNDS + 1):
        key = F.lit(f"{seed}:{k}")
        rest = F.array_join(others.cast("array<string>"), ",")
        df = _bound(df, f"_l{k}", first.bitwiseXOR(_mix(key, rest)))
        first = F.col(f"_l{k}")
        if k < ROUNDS:
            mix = lambda x, i, key=key, first=first: x.bitwiseXOR(
                _mix(key, i.cast("string"), first.cast("string"))
            )
            df = _bound(df, f"_r{k}", F.transform(others, _two(mix)))
            others = F.col(f"_r{k}")
    return df.select(*kept, first.alias(name))


def _two(f):
    """A function of exactly two arguments, as `transform` counts them."""
    return lambda x, i: f(x, i)


def stable_sample(images: DataFrame, rate: float, seed: int = 20) -> DataFrame:
    """(transaction_id, image_id, permuted) of the selected images, each once.

    A larger rate with the same seed selects a superset. Images with a NULL transaction_id or
    image_id are not known by both and never selected; an empty image_id is a name like
    others. Rate 0 selects none, rate 1 all.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    known = (
        images.select(F.col("transaction_id").cast("long").alias("transaction_id"), "image_id")
        .where("transaction_id IS NOT NULL AND image_id IS NOT NULL")
    )
    worded = _bound(
        known, "_words", identifier_words(F.col("transaction_id"), F.col("image_id"))
    )
    limit = int(rate * 2 ** (4 * DIGITS))
    # filtered before repetitions are removed: only the sample is shuffled
    return (
        permuted(worded, "_words", seed)
        .where(F.col("permuted") < F.lit(limit))
        .select("transaction_id", "image_id", "permuted")
        .distinct()
    )


def sql_stable_sample(rate: float, seed: int = 20) -> str:
    """The same in DuckDB's SQL."""
    word = lambda x: f"CAST('0x' || {x} AS BIGINT)"
    steps, source = [], "w"
    for k in range(1, ROUNDS + 1):
        f = word(f"md5('{seed}:{k}|' || array_to_string(r, ','))[1:{DIGITS}]")
        g = word(f"md5('{seed}:{k}|' || CAST(i AS VARCHAR) || '|' || CAST(l AS VARCHAR))[1:{DIGITS}]")
        steps.append(f"l{k} AS (SELECT t, i_, xor(l, {f}) AS l, r FROM {source})")
        steps.append(
            f"r{k} AS (SELECT t, i_, l, list_transform(range(len(r)), lambda i: xor(r[i + 1], {g})) AS r FROM l{k})"
        )
        source = f"r{k}"
    return f"""WITH ids AS (
  SELECT DISTINCT transaction_id AS t, image_id AS i_ FROM images WHERE transaction_id IS NOT NULL AND image_id IS NOT NULL),
d AS (SELECT t, i_, lpad(hex(t), 16, '0') || hex(i_) || '80' AS d FROM ids),
p AS (SELECT t, i_, rpad(d, CAST(ceil(len(d) / {DIGITS}.0) AS INT) * {DIGITS}, '0') AS d FROM d),
a AS (SELECT t, i_, list_transform(range(len(d) // {DIGITS}), lambda i: {word(f"d[i * {DIGITS} + 1 : i * {DIGITS} + {DIGITS}]")}) AS x FROM p),
w AS (SELECT t, i_, x[1] AS l, x[2:] AS r FROM a),
{", ".join(steps)}
SELECT t AS transaction_id, i_ AS image_id, l AS permuted FROM l{ROUNDS} WHERE l < {int(rate * 2 ** (4 * DIGITS))}"""
