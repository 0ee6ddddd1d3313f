"""The exact share helpers against independent Python arithmetic."""

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from carelens.functions import scalars as X

PAIRS = st.lists(st.tuples(st.integers(0, 10**9), st.integers(1, 10**9)), min_size=1, max_size=300)


def mysql_share(part: int, total: int) -> float:
    # integer / integer -> DECIMAL with 4 places (half up), * 100, ROUND(.., 1) half up
    q = (Decimal(part) / Decimal(total)).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)
    return float((q * 100).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


def half_even_share(part: int, total: int) -> float:
    x = Fraction(part * 1000, total)          # exact tenths of a percent
    return float(round(x)) / 10.0             # Fraction rounds half to even


def _spark_rows(spark, pairs, fn):
    pairs = [(p % (t + 1), t) for p, t in pairs]   # shares up to 100 %
    df = spark.createDataFrame(pairs, "p long, t long")
    return pairs, [r[0] for r in df.select(fn("p", "t")).collect()]


@settings(max_examples=8, deadline=None)
@given(PAIRS)
def test_mysql_share_matches_decimal_arithmetic(spark, pairs):
    pairs, got = _spark_rows(spark, pairs, X.mysql_share_percent)
    assert got == [mysql_share(p, t) for p, t in pairs]


@settings(max_examples=8, deadline=None)
@given(PAIRS)
def test_half_even_share_matches_exact_ratio(spark, pairs):
    pairs, got = _spark_rows(spark, pairs, lambda p, t: X.half_even_share_percent(p, t, 1))
    assert got == [half_even_share(p, t) for p, t in pairs]


NUMBERS = st.from_regex(r"\A\s{0,2}[+-]?([0-9]{1,12}\.?[0-9]{0,6}|\.[0-9]{1,6})([eE][+-]?[0-9]{1,2})?\s{0,2}\Z")
TEXTS = st.lists(st.one_of(NUMBERS, st.text(max_size=8)), min_size=1, max_size=200)


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_lenient_double_matches_python_float(spark, texts):
    import re
    # Java's \s is ASCII whitespace (as R's is); Python's would also take U+0085 etc.
    pattern = re.compile(X.NUMBER_PATTERN, re.ASCII)
    want = [float(t.strip(" \t\n\r\f\v")) if pattern.match(t) else None for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(X.lenient_double("x")).collect()]
    for t, g, w in zip(texts, got, want):
        if w is None:
            assert g is None, t
        else:
            assert g == w, t
