"""Exact sums and means of doubles, whatever their size and the order of the rows.

A double counts as the decimal number it is written as. *Plain* numbers (below
1e11 with at most four decimals, which is what the extracts hold) are summed
as decimals. Any other number is *wide*: its digits are added as whole numbers
in the bucket of its power of ten (eight powers share one), and the few buckets
of a group are put together at the end: carries upwards, then a long division
from the top. Whole numbers have one sum in any order, so the result has the
same bits over any number of partitions, and no digit is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 8                    # powers of ten in a bucket
LOWEST, HIGHEST = -44, 45   # buckets of the smallest digit and the largest sum of doubles
BASE = 10 ** STEP
PLAIN_BELOW = 1e11
_WHOLE = "decimal(38,0)"


def is_plain(x: Column) -> Column:
    """Whether a known number below 1e11 has at most four decimals (15 digits in all,
    so the decimal that gives the double back is the one it is written as)."""
    near = F.abs(x) < PLAIN_BELOW
    return near & (F.when(near, x).cast("decimal(18,4)").cast("double") == x)


def plain_part(x: Column) -> Column:
    return F.when(is_plain(x), x).cast("decimal(18,4)")


def is_wide(x: Column) -> Column:
    """A known number that is not plain. NaN and infinities are no scores: cleaning reads them as NULL."""
    return x.isNotNull() & ~F.coalesce(is_plain(x), F.lit(False))


def bucket_and_digits(x: Column) -> tuple[Column, Column]:
    """The bucket of a wide number and its signed digits as a whole number: x = digits * 10 ** (8 * bucket)."""
    text = F.split(F.abs(x).cast("string"), "E")
    mantissa = F.split(F.element_at(text, 1), r"\.")
    places = F.when(F.size(mantissa) > 1, F.length(F.element_at(mantissa, 2))).otherwise(0)
    power = F.coalesce(F.try_element_at(text, F.lit(2)).cast("int"), F.lit(0)) - places
    bucket = F.floor(power / STEP).cast("int")
    scaled = F.concat(F.array_join(mantissa, ""), F.repeat(F.lit("0"), power - bucket * STEP)).cast("decimal(28,0)")
    return bucket, scaled * F.signum(x).cast("int")


def _whole(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast(_WHOLE)


def _normal(values: Column, sign: Column, extra: Column) -> Column:
    """(carry, digits): ``sign`` times ``values`` (bucket -> whole number) plus ``extra`` in
    bucket 0 as digits 0 .. BASE - 1 from the lowest bucket up; a negative carry means a negative
    number. The inputs go along in the accumulator: what a lambda refers to outside is evaluated at each step."""
    def step(acc, b):
        total = _whole(acc["carry"] + F.coalesce(acc["values"][b] * acc["sign"], _whole(0)) + F.when(b == 0, acc["extra"]).otherwise(_whole(0)))
        digit = _whole(F.pmod(total, _whole(BASE)))
        return F.struct(_whole(F.call_function("div", total - digit, _whole(BASE))).alias("carry"), F.concat(acc["digits"], F.array(digit)).alias("digits"),
                        acc["values"].alias("values"), acc["sign"].alias("sign"), acc["extra"].alias("extra"))
    start = F.struct(_whole(0).alias("carry"), F.array().cast(f"array<{_WHOLE}>").alias("digits"), values.alias("values"),
                     sign.cast("int").alias("sign"), extra.alias("extra"))
    return F.aggregate(F.sequence(F.lit(LOWEST), F.lit(HIGHEST)), start, step)


def rounded_mean(buckets: Column, n: Column) -> Column:
    """round(sum / n, 2), half away from zero, as a double. ``buckets``: array of (bucket, whole number)."""
    doubled = F.map_from_entries(F.transform(buckets, lambda e: F.struct(e["bucket"], _whole(e["digits"].cast(_WHOLE) * 200))))
    sign = F.when(_normal(doubled, F.lit(1), _whole(0))["carry"] < 0, -1).otherwise(1)

    def divide(acc, digit):
        now = _whole(acc["rest"] * BASE + digit)
        q = _whole(F.call_function("div", now, acc["by"]))
        return F.struct(_whole(now - q * acc["by"]).alias("rest"), F.concat(acc["text"], F.lpad(q.cast("string"), STEP, "0")).alias("text"), acc["by"].alias("by"))

    def to_double(acc):  # 200 * |sum| + n, divided by 2 * n: cents, half up
        whole = F.slice(F.reverse(acc["digits"]), 1, HIGHEST + 1)  # from the highest bucket to bucket 0
        start = F.struct(_whole(0).alias("rest"), F.lit("").alias("text"), _whole(acc["extra"] * 2).alias("by"))
        cents = F.aggregate(whole, start, divide, lambda x: x["text"])
        return F.concat(F.when(acc["sign"] < 0, "-").otherwise(""), cents, F.lit("E-2")).cast("double") + 0.0

    full = _normal(doubled, sign, _whole(n))
    return F.element_at(F.transform(F.array(full), to_double), 1)


def exact_sum(buckets: Column) -> Column:
    """The sum as the double nearest to it."""
    values = F.map_from_entries(F.transform(buckets, lambda e: F.struct(e["bucket"], e["digits"].cast(_WHOLE))))
    sign = F.when(_normal(values, F.lit(1), _whole(0))["carry"] < 0, -1).otherwise(1)

    def to_double(acc):
        digits = F.array_join(F.transform(F.reverse(acc["digits"]), lambda d: F.lpad(d.cast("string"), STEP, "0")), "")
        return F.concat(F.when(acc["sign"] < 0, "-").otherwise(""), digits, F.lit(f"E{LOWEST * STEP}")).cast("double") + 0.0
    return F.element_at(F.transform(F.array(_normal(values, sign, _whole(0))), to_double), 1)


def with_plain_part(buckets: Column, plain_sum: Column) -> Column:
    """The buckets (NULL: none) and the sum of the plain numbers, which is whole in bucket -1."""
    units = _whole(F.coalesce(plain_sum, F.lit(0)).cast("decimal(38,8)") * 10 ** STEP)
    known = F.coalesce(buckets, F.array().cast(f"array<struct<bucket:int,digits:{_WHOLE}>>"))
    last = F.coalesce(F.get(F.filter(known, lambda e: e["bucket"] == -1), F.lit(0))["digits"], _whole(0))
    return F.concat(F.filter(known, lambda e: e["bucket"] != -1), F.array(F.struct(F.lit(-1).alias("bucket"), _whole(last + units).alias("digits"))))
