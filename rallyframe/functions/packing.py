"""Fixed-width keys for arg-min and arg-max, so that they run as hash aggregates.

A struct as the ordering of ``min_by`` is no fixed-width buffer, and the engine then sorts the rows
of every group. Here the value and the row's number become one decimal in the same order: its
minimum is kept in place, and the number is read back from it. Whole rows are fetched afterwards.
"""

from pyspark.sql import functions as F

_ONE = 2**52
#: Numbers lie between -SHIFT and SHIFT; a missing number comes first.
SHIFT = 2**62


def ordered_bits(value):
    """A double as an integer in the same order, one to one (its IEEE bits); NaN is largest, as in the engine's order.

    Scaling by powers of two is exact, so only the exponent has to be found; the rounded logarithm
    may miss it by one and is put right by comparison.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("double")
    power = lambda k: F.pow(F.lit(2.0), k)
    above = F.when(size >= power(guess + 1), F.lit(1.0)).when(size < power(guess), F.lit(-1.0)).otherwise(F.lit(0.0))
    exponent = guess + above
    normal = ((exponent + 1023) * _ONE).cast("bigint") + ((size * power(-exponent)) * _ONE).cast("bigint") - _ONE
    tiny = (size * power(F.lit(1022.0)) * _ONE).cast("bigint")
    bits = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size < 2.0**-1022, tiny)
        .when(size == float("inf"), F.lit(2047 * _ONE).cast("bigint"))
        .otherwise(normal)
    )
    return F.when(F.isnan(value), F.lit(2047 * _ONE + 1).cast("bigint")).when(value < 0, -bits).otherwise(bits)


def packed(value, number):
    """One decimal(38) ordered by ``value`` (a double) and then by ``number`` (an integer); null where value is."""
    place = F.coalesce(number.cast("bigint") + F.lit(SHIFT), F.lit(0).cast("bigint"))
    wide = ordered_bits(value).cast("decimal(19,0)") * F.lit(str(2**63)).cast("decimal(19,0)")
    return (wide + place.cast("decimal(19,0)")).cast("decimal(38,0)")


def packed_number(key):
    """The number of a packed key."""
    place = F.pmod(key, F.lit(str(2**63)).cast("decimal(38,0)")).cast("bigint")
    return F.when(place != 0, place - F.lit(SHIFT))
