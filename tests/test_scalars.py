"""Edge rows for the scalar functions (FIXTURES.md section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions import scalars as X


def one_col(spark, values, fn, typ="string"):
    if typ == "double":
        values = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x")).alias("y")).collect()]


def test_numeric_tokens_are_null(spark):
    assert one_col(spark, ["Not Available", "", "1,234", "12d", "0x1A", "Inf", "NaN", None],
                   X.lenient_double) == [None] * 8


def test_numeric_ok(spark):
    assert one_col(spark, [" 12.5 ", "1e3", "-3.4", "+7", ".5", "3."], X.lenient_double) == \
        [12.5, 1000.0, -3.4, 7.0, 0.5, 3.0]


def test_int_truncates(spark):
    assert one_col(spark, ["12.7", "-12.7", "42", "99999999999", "x"], X.lenient_int) == \
        [12, -12, 42, None, None]


def test_not_applicable_then_int(spark):
    assert one_col(spark, ["Not Applicable", "5"], lambda c: X.lenient_int(X.null_if_token(c))) == [None, 5]


def test_date_forms(spark):
    got = one_col(spark, ["07-01-2021", "07.01.2021", "July 1, 2021", "Jul 1, 2021", "7/1/21",
                          "1/2/75", "12/31/68", "2021-07-01", "02/30/2021"], X.parse_mdy)
    assert got == [dt.date(2021, 7, 1)] * 5 + [dt.date(1975, 1, 2), dt.date(2068, 12, 31), None, None]


def test_dates(spark):
    assert one_col(spark, ["07/01/2021", "7/1/2021", "13/45/2020", "", None], X.parse_mdy) == \
        [dt.date(2021, 7, 1), dt.date(2021, 7, 1), None, None, None]


def test_zip_padding(spark):
    assert one_col(spark, ["501", "123456", None, "02134", ""], X.pad_zip) == \
        ["00501", "123456", None, "02134", None]


def test_category_order_and_case(spark):
    got = one_col(spark, ["No Different, Better", "Better Than", "Worse Than", "better than",
                          "Number of Cases Too Small", None], X.categorize)
    assert got == ["Average", "Better than National Average", "Worse than National Average",
                   None, None, None]


def test_tier_bounds(spark):
    got = one_col(spark, [100, 100.5, 500, 1000, 1000.5, 0], X.volume_tier, "double")
    assert got == [S.VOLUME_LABELS_LONG[i] for i in (0, 1, 1, 2, 3, 0)]
    got = one_col(spark, [100, 1000.5], lambda c: X.volume_tier(c, S.VOLUME_LABELS_SHORT), "double")
    assert got == ["Small", "Very Large"]


def test_readmission_prefix(spark):
    assert one_col(spark, ["READM_30_HF", "EDAC_30_PN_1", "OP_32_0", "readm_x", None],
                   X.is_readmission) == [True, True, False, False, None]


def test_round_half_away(spark):
    got = one_col(spark, [0.125, -0.125, 2.675, -0.001, 3.0, None], lambda c: X.round_half_away(c, 2),
                  "double")
    assert got == [0.13, -0.13, 2.68, 0.0, 3.0, None]
    # no negative zero
    assert str(got[3]) == "0.0"


def test_mysql_share(spark):
    df = spark.createDataFrame([(1234, 6000), (1, 3), (2, 3), (5, 0), (0, 7), (10329, 20000)],
                               "p long, t long")
    got = [r[0] for r in df.select(X.mysql_share_percent("p", "t")).collect()]
    # 10329/20000 = 0.51645 -> 0.5165 (4 places) -> 51.65 -> 51.7 (exact would give 51.6)
    assert got == [20.6, 33.3, 66.7, None, 0.0, 51.7]


def test_half_even_share(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (1, 3), (1, 0)], "p long, t long")
    got = [r[0] for r in df.select(X.half_even_share_percent("p", "t", 1)).collect()]
    # 12.5 -> 12.5 exact; 37.5 ; 33.33.. ; zero total
    assert got == [12.5, 37.5, 33.3, None]
    df = spark.createDataFrame([(1, 16), (3, 16)], "p long, t long")  # 6.25 -> 6.2, 18.75 -> 18.8
    assert [r[0] for r in df.select(X.half_even_share_percent("p", "t", 1)).collect()] == [6.2, 18.8]


def test_display_formats(spark):
    assert one_col(spark, [1234567.0, 5.0], X.thousands, "double") == ["1,234,567", "5"]
    assert one_col(spark, [3.2, -5.0, 2.675], X.two_decimals, "double") == ["3.20", "-5.00", "2.68"]


def test_dates_keep_the_rows_code_small(spark, sf001):
    # the JVM compiles no method above 8,000 bytes: the rows of one that large are interpreted
    from carelens.plans import load as L
    adaptive = spark.conf.get("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = L.fixture_visits(spark, sf001)._jdf.queryExecution().debug().codegenToSeq()
        sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8000


def test_all_date_forms(spark):
    texts = ["3/4/2020", "3-4-2020", "3.4.2020", "March 4, 2020", "Mar 4, 2020", "3/4/20", "3-4-20", "3.4.20", "3/4/69", "3-4-69", "2.29.96", "3-4.20", "4/3"]
    want = [dt.date(2020, 3, 4)] * 8 + [dt.date(1969, 3, 4)] * 2 + [dt.date(1996, 2, 29), None, None]
    assert one_col(spark, texts, X.parse_mdy) == want
