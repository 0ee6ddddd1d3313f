"""Column -> Column scalar functions used by cleaning and reporting.

All are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen. ANSI mode stays on: conversions use ``try_*`` forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions.exact import bucket_and_digits, exact_sum, is_wide, plain_part, rounded_mean, with_plain_part  # noqa: F401

# A decimal number with optional sign, fraction and exponent, surrounded by
# optional blanks. Anything else (tokens, thousands separators, hex, Inf, NaN,
# Java's 'd'/'f' suffixes that a bare cast would take) becomes NULL.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lenient_double(x) -> Column:
    """Text -> double; text that is not a number -> NULL."""
    x = _c(x)
    return F.when(x.rlike(NUMBER_PATTERN), F.trim(x).try_cast("double"))


def lenient_int(x) -> Column:
    """Text -> int, truncating toward zero; bad or out-of-range -> NULL."""
    return lenient_double(x).try_cast("int")


def null_if_token(x, token: str = S.NOT_APPLICABLE) -> Column:
    """A named missing-value token -> NULL."""
    return F.nullif(_c(x), F.lit(token))


def parse_mdy(x) -> Column:
    """Month/day/year text -> date; unparseable -> NULL.

    Separators ``/``, ``-``, ``.`` and month names are taken; a two-digit
    year is 20xx below the cutoff and 19xx from it on (Spark's ``yy`` alone
    would put every two-digit year in 20xx).

    The formats beside the first stand in an array, whose first date is taken:
    array functions keep the row's projection out of the one generated method of
    its stage. With all formats written out, that method passed the 8,000 bytes
    up to which the JVM compiles one, and every row was interpreted.
    """
    x = _c(x)
    first, *four = [F.try_to_date(x, p) for p in S.INPUT_DATE_FORMATS]
    two = F.transform(F.array(*[F.try_to_date(x, p) for p in S.INPUT_DATE_FORMATS_2DIGIT]), lambda d: F.when(
        F.year(d) >= 2000 + S.TWO_DIGIT_YEAR_CUTOFF, F.add_months(d, -1200)).otherwise(d))
    return F.coalesce(first, F.get(F.array_compact(F.concat(F.array(*four), two)), F.lit(0)))


def pad_zip(x, width: int = S.ZIP_WIDTH) -> Column:
    """Left-pad with zeros to ``width``; longer text is kept whole; a blank
    ZIP is missing (X5)."""
    x = _c(x)
    return (F.when(F.length(x) == 0, F.lit(None).cast("string"))
            .when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x))


def categorize(x) -> Column:
    """Free-text comparison -> category label, first rule wins, else NULL."""
    x = _c(x)
    out = None
    for needle, label in S.CATEGORY_RULES:
        cond = x.contains(needle)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def volume_tier(denominator, labels=S.VOLUME_LABELS_LONG) -> Column:
    """Denominator -> volume tier label."""
    d = _c(denominator)
    lo = None
    out = None
    for bound, label in zip(S.VOLUME_BOUNDS, labels):
        cond = d <= bound if lo is None else (d > lo) & (d <= bound)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
        lo = bound
    return out.otherwise(F.lit(labels[len(S.VOLUME_BOUNDS)]))


def is_readmission(measure_id) -> Column:
    """measure_id starts with one of the readmission prefixes."""
    m = _c(measure_id)
    cond = None
    for p in S.READMISSION_PREFIXES:
        c = m.startswith(p)
        cond = c if cond is None else cond | c
    return cond


def round_half_away(x, digits: int) -> Column:
    """Round half away from zero on the double value, no negative zero (X11).

    Written as sign * floor(|x| * 10^d + 0.5) / 10^d so that every step is a
    single IEEE operation and any engine gives the same bits.
    """
    x = _c(x)
    scale = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + 0.0


def mysql_share_percent(part, total) -> Column:
    """ROUND(part / total * 100, 1) with MySQL's integer-division semantics.

    MySQL divides two integers into a DECIMAL rounded half up to 4 places;
    the product with 100 then has 2 places and ROUND(.., 1) rounds half up
    again. Done in exact integer arithmetic; a zero total gives NULL.
    """
    p = _c(part).cast("long")
    t = _c(total).cast("long")
    k = int_div(p * 20000 + t, F.nullif(t * 2, F.lit(0).cast("long")))  # ratio * 10^4, half up
    r = int_div(k + 5, F.lit(10).cast("long"))                           # percentage, 1 place
    return r.cast("double") / 10.0


def half_even_share_percent(part, total, digits: int = 1) -> Column:
    """round(part / total * 100, digits), half to even, decided on the exact ratio."""
    p = _c(part).cast("long")
    t = F.nullif(_c(total).cast("long"), F.lit(0).cast("long"))
    scale = 10 ** digits
    num = p * (100 * scale)
    q = int_div(num, t)
    rem = num - q * t
    up = (rem * 2 > t) | ((rem * 2 == t) & (F.pmod(q, F.lit(2).cast("long")) == 1))
    return (q + F.when(up, 1).otherwise(0)).cast("double") / float(scale)


def int_div(a: Column, b: Column) -> Column:
    """SQL integral division ``a div b`` (NULL divisor -> NULL)."""
    return F.call_function("div", a, b)


def two_decimals(x) -> Column:
    """Fixed two-decimal text of a number, rounding half away from zero; NULL stays NULL."""
    return F.when(_c(x).isNotNull(), F.format_string("%.2f", _c(x)))


def thousands(x) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(_c(x), 0)
