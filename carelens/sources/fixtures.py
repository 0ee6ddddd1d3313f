"""``raw_visits`` over the driver's TPC-H-like tables (FIXTURES.md section 3).

Mapping: facility = customer, state = nation, fact row = lineitem (through
orders), measure = line number. The result has the raw extract's 20 text
columns plus ``_src`` (the lineitem primary key packed into one long),
which only breaks ties between identical rows when ordering.

Join plan: orders is enriched with customer, then nation, so the
lineitem-sized side is shuffled once, on the order key; joining lineitem to
orders first would shuffle the lineitem-sized result again on the customer
key. The two fact-sized sides (lineitem, orders) are always sort-merge
joined: a static size estimate must not turn either into a broadcast, since
both grow with the data. ``customer`` and ``nation`` join without a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.sources.csv import write_csv

# Fixed values of the fixture mapping (FIXTURES.md section 3).
MEASURE_PREFIX_BY_LINE = {
    2: "READM_30_AMI_", 3: "EDAC_30_HF_", 4: "EDAC_30_PN_", 5: "OP_32_", 6: "READM_30_PN_",
}
OTHER_MEASURE_PREFIX = "OP_36_"
FIRST_LINE_MEASURE = ("READM_30_HF", "Heart failure return")
NOT_AVAILABLE = "Not Available"
COMPARED_TEXTS = {
    "small": "Number of Cases Too Small",
    "A": "Better Than the National Rate",
    "N": "No Different Than the National Rate",
    "else": "Worse Than the National Rate",
}
FOOTNOTE_TEXTS = [(1, "1, 7"), (3, "5")]  # (max quantity, footnote cell), else ''
SCORE_SHIFT_LINES = (3, 4)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def raw_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = load_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    enriched_orders = (orders
                       .join(cust, orders.o_custkey == cust.c_custkey)
                       .join(nation, F.col("c_nationkey") == nation.n_nationkey))
    j = li.hint("merge").join(enriched_orders, li.l_orderkey == enriched_orders.o_orderkey)

    line = F.col("l_linenumber")
    q = F.col("l_quantity")
    small = q <= 3
    part3 = _s(F.col("l_partkey") % 3)
    disc = F.round(F.col("l_discount") * 100).cast("int")

    prefix = F.lit(OTHER_MEASURE_PREFIX)
    for ln in sorted(MEASURE_PREFIX_BY_LINE, reverse=True):
        prefix = F.when(line == ln, F.lit(MEASURE_PREFIX_BY_LINE[ln])).otherwise(prefix)
    measure_id = F.when(line == 1, F.lit(FIRST_LINE_MEASURE[0])).otherwise(F.concat(prefix, part3))
    measure_name = F.when(line == 1, F.lit(FIRST_LINE_MEASURE[1])).otherwise(
        F.concat(F.lit("Measure "), _s(F.when(line == 6, 2).otherwise(line)), F.lit("-"), part3))
    compared = (F.when(small, COMPARED_TEXTS["small"])
                .when(F.col("l_returnflag") == "A", COMPARED_TEXTS["A"])
                .when(F.col("l_returnflag") == "N", COMPARED_TEXTS["N"])
                .otherwise(COMPARED_TEXTS["else"]))
    shift = F.when(line.isin(*SCORE_SHIFT_LINES), 5).otherwise(0)
    na = F.lit(NOT_AVAILABLE)
    open_line = F.col("l_linestatus") == "O"
    footnote = F.lit("")
    for max_q, text in reversed(FOOTNOTE_TEXTS):
        footnote = F.when(q <= max_q, F.lit(text)).otherwise(footnote)
    ship = F.col("l_shipdate")

    return j.select(
        F.lpad(_s(F.col("o_custkey")), 6, "0").alias("facility_id"),
        F.upper("c_name").alias("facility_name"),
        F.concat(_s(F.col("c_custkey")), F.lit(" MAIN ST")).alias("address"),
        F.concat(F.lit("CITY "), _s(F.col("c_nationkey"))).alias("city_town"),
        F.col("n_name").alias("state"),
        _s(F.col("c_custkey")).alias("zip_code"),
        F.col("c_mktsegment").alias("county_parish"),
        _s(F.col("l_orderkey")).alias("telephone_number"),
        measure_id.alias("measure_id"),
        measure_name.alias("measure_name"),
        compared.alias("compared_to_national"),
        F.when(small, na).otherwise(_s(q.cast("int") * 25)).alias("denominator"),
        F.when(small, na).otherwise(_s(disc - shift)).alias("score"),
        F.when(small, na).otherwise(_s(disc - 7)).alias("lower_estimate"),
        F.when(small, na).otherwise(_s(disc + 2)).alias("higher_estimate"),
        F.when(open_line, F.lit(S.NOT_APPLICABLE)).otherwise(_s(q.cast("int") * 10))
         .alias("number_of_patients"),
        F.when(open_line, F.lit(S.NOT_APPLICABLE)).otherwise(_s(q.cast("int")))
         .alias("number_of_patients_returned"),
        footnote.alias("footnote"),
        F.date_format(ship, "MM/dd/yyyy").alias("start_date"),
        F.date_format(ship + F.expr("INTERVAL 30 DAYS"), "MM/dd/yyyy").alias("end_date"),
        # the lineitem key (l_orderkey, l_linenumber) in one long; line numbers are 1..7
        (F.col("l_orderkey") * 8 + line).alias(S.SOURCE_ID),
    )


# Row order standing in for file order (FIXTURES.md, "Row order key").
ORDER_KEY = [
    "facility_id", "measure_id", "telephone_number", "denominator", "score",
    "number_of_patients_returned", "number_of_patients", "compared_to_national",
    "footnote", "start_date",
]

# Header of a raw extract file as published (display names, normalised on read).
EXTRACT_HEADER = [
    "Facility ID", "Facility Name", "Address", "City/Town", "State", "ZIP Code", "County/Parish",
    "Telephone Number", "Measure ID", "Measure Name", "Compared to National", "Denominator",
    "Score", "Lower Estimate", "Higher Estimate", "Number of Patients",
    "Number of Patients Returned", "Footnote", "Start Date", "End Date",
]

# Extracts arrive compressed: an eighth of the plain text on disk.
EXTRACT_COMPRESSION = "gzip"

# Variant parameters (FIXTURES.md, "Variants").
STATE_PARAM = "NATION_3"
PROFILE_PARAM = "CUSTOMER#000000001"
ORPHAN_MODULUS = 50
EXISTING_FOOTNOTE_IDS = [5]
SPLIT_YEAR = 1996
# Extract files by year, in path order: all rows, none of the files empty (sf0.01: 1995 to 2001).
FILE_YEARS = {"a": (1998, 1998), "b": (None, 1997), "c": (1999, None)}
# Files with unlike headers: years, and how the header differs.
MIXED_YEARS = {"swapped": (None, 1996), "added": (1997, 1997), "absent": (1998, 1998), "plain": (1999, None)}
MORE_FOOTNOTE_IDS = {11: 10, 12: 14, 13: 22, 14: 26, 15: 34}  # id: linked to every n-th fact


def facts_with_orphans(performance_data: DataFrame) -> DataFrame:
    """The fact plus a copy of every 50th row whose facility is unknown, so
    that inner joins to ``hospitals`` drop fact rows."""
    more = performance_data.filter(F.col("performance_id") % ORPHAN_MODULUS == 0)
    return performance_data.unionByName(more.withColumn("facility_id", F.concat(F.lit("?"), "facility_id")))


def facts_fractional(performance_data: DataFrame) -> DataFrame:
    """The fact with scores that have three decimals."""
    return performance_data.withColumn("score", F.col("score") + (F.col("performance_id") % 1000) / F.lit(1000.0))


def facts_wide_range(performance_data: DataFrame) -> DataFrame:
    """The fact with scores of very unlike sizes: 1e20 and -1e20 on some rows, 0.00001 on others."""
    k = F.col("performance_id") % 97
    return performance_data.withColumn("score", F.when(F.col("score").isNotNull(), F.when(k == 0, F.lit(1e20)).when(
        k == 1, F.lit(-1e20)).when(k < 40, F.lit(1e-5)).otherwise(F.col("score"))))


def more_links(performance_footnotes: DataFrame, performance_data: DataFrame) -> DataFrame:
    """The links plus links to further ids, which the footnotes table lacks."""
    for i, n in MORE_FOOTNOTE_IDS.items():
        performance_footnotes = performance_footnotes.union(
            performance_data.filter(F.col("performance_id") % n == 0).select("performance_id", F.lit(i).alias("footnote_id")))
    return performance_footnotes


def blank_parts(visits: DataFrame) -> DataFrame:
    """The visits with footnote cells that end in a blank part (``"5, "``)."""
    return visits.withColumn("footnote", F.when(F.col("footnote") == "5", "5, ").otherwise(F.col("footnote")))


def odd_text(visits: DataFrame) -> DataFrame:
    """The visits with addresses that hold outer blanks, quotes, a line break or nothing."""
    k = F.col("l") % 5
    out = visits.withColumn("l", F.length("facility_name") + F.col("zip_code").cast("int"))
    a = F.col("address")
    return out.withColumn("address", F.when(k == 0, F.concat(F.lit("  "), a, F.lit(" "))).when(
        k == 1, F.concat(F.lit('say "'), a, F.lit('", twice'))).when(k == 2, F.concat(a, F.lit("\nfloor 2"))).when(
        k == 3, F.lit("")).otherwise(a)).drop("l")


def between_years(raw: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """The raw rows that start in the years first to last (None: open)."""
    year = F.substring("start_date", 7, 4).cast("int")
    return raw.filter((year >= first if first else F.lit(True)) & (year <= last if last else F.lit(True)))


def ordered_extract(raw: DataFrame, path: str) -> None:
    """Write the rows as CSV files that are in row order by file name, over as many tasks as Spark deals out."""
    one = raw.repartitionByRange(*ORDER_KEY).sortWithinPartitions(*ORDER_KEY)
    write_csv(one.toDF(*EXTRACT_HEADER), path, compression=EXTRACT_COMPRESSION)


def mixed_extract(raw: DataFrame, path: str) -> None:
    """Write the rows as files with unlike headers: columns in reverse order, a
    column more, a column (County/Parish) less, and the published header."""
    for name, years in MIXED_YEARS.items():
        df = between_years(raw, *years).toDF(*EXTRACT_HEADER)
        if name == "swapped":
            df = df.select(*[F.col(f"`{c}`") for c in reversed(EXTRACT_HEADER)])
        if name == "added":
            df = df.select(F.lit("new, with a comma").alias("Survey Note"), "*", F.col("State").alias("state"))
        if name == "absent":
            df = df.drop("County/Parish")
        write_csv(df, f"{path}/{name}", compression=EXTRACT_COMPRESSION)


def halves(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The raw rows that start before SPLIT_YEAR, and the others."""
    early = F.substring("start_date", 7, 4).cast("int") < SPLIT_YEAR
    return raw.filter(early), raw.filter(~early)


def footnotes_partly_described(footnotes: DataFrame) -> DataFrame:
    """The footnotes table with a text for some ids only."""
    return footnotes.withColumn("footnote_text", F.when(
        F.col("footnote_id").isin(*EXISTING_FOOTNOTE_IDS), F.concat(F.lit("Footnote "), F.col("footnote_id").cast("string"))))


def footnotes_existing(footnotes: DataFrame) -> DataFrame:
    """A footnotes table that already holds only some ids."""
    return footnotes.filter(F.col("footnote_id").isin(*EXISTING_FOOTNOTE_IDS))


def performance_data_loaded(performance_data: DataFrame) -> DataFrame:
    """The fact as the reference has it after its CSV round trip: NULL category -> ''."""
    return performance_data.withColumn(
        "performance_category", F.coalesce(F.col("performance_category"), F.lit("")))
