"""Adaptive quality rules from mergeable quantile sketches (operator 5, DataFrame functions only).

Every text gets whole-number metrics. Their distributions are held per
language and source as log-linear count sketches: a value below 64 is its own
cell, a larger one keeps its six leading bits, so a quantile is read with a
relative error of at most 1/32. Sketches merge by adding counts: they are built
with map-side partial aggregation, and the sketch of a language, or of
everything, is the sum of its parts. Thresholds are the quartile fences of the
finest level with enough rows; they replace fixed cutoffs and are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: metric: (expression over the base columns, least spread of the quartiles, lower fence too)
METRICS = {
    "mean_word": ("1000 * word_chars div n_words", 250, True),
    "symbols": ("1000 * n_symbols div n_words", 20, False),
    "dup_lines": ("1000 * n_dup_lines div n_words", 20, False),
    "repeats": ("1000 * n_repeat_words div n_words", 60, False),
}
FENCE = 4
MIN_ROWS = 50


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed; written to the shared folder. (Left lazy, a filter
    on these columns would be pushed into the array functions and computed per word.)"""
    return stored(_statistics(docs), "quality_statistics")


def _statistics(docs: DataFrame) -> DataFrame:
    """Whole texts; null counts as empty. A repeated three-word window is found by
    sorting the windows' hashes with the window's number in the low bits (as
    many as the text needs): equal windows become neighbours, in n log n.
    """
    t = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    t = t.withColumn("_w", F.expr(f"regexp_extract_all(_t, r'{WORD}+', 0)"))
    t = t.withColumn("_l", F.expr(f"filter(split(_t, '\\n', -1), l -> rlike(l, r'{WORD}'))"))
    t = t.withColumn("n_words", F.size("_w").cast("long"))
    t = t.withColumn("_low", F.expr("shiftleft(1L, length(bin(n_words))) - 1L"))
    t = t.withColumn("_s", F.expr("""
        CASE WHEN n_words < 4 THEN cast(array() AS array<bigint>)
             ELSE sort_array(transform(sequence(0, cast(n_words AS int) - 3),
                  i -> (xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) & ~_low) | i)) END"""))
    t = t.withColumn("_r", F.expr("""
        filter(_s, (x, k) -> (x & ~_low) = (get(_s, k + 1) & ~_low) OR (x & ~_low) = (get(_s, k - 1) & ~_low))"""))
    return t.select(
        *(c for c in docs.columns if c != "text"), "n_words",
        F.expr("cast(length(array_join(_w, '')) AS bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(_t, '[#*$%&|<>]') AS bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) AS bigint)").alias("n_dup_lines"),
        F.expr("""cast(CASE WHEN size(_r) = 0 THEN 0 ELSE size(array_distinct(flatten(transform(_r,
                  x -> array(x & _low, (x & _low) + 1L, (x & _low) + 2L))))) END AS bigint)""").alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def cell(v: str) -> str:
    """The sketch cell of a non-negative whole number: its lower bound."""
    shift = f"(length(bin({v})) - 6)"
    return f"CASE WHEN {v} < 64 THEN {v} ELSE shiftleft(shiftright({v}, {shift}), {shift}) END"


def sketches(stats: DataFrame) -> DataFrame:
    """(level, lang, source, metric, cell, n): level 2 per language and source,
    level 1 per language, level 0 of everything. Rows that fail the base rules
    are left out: they would shift the thresholds of their group."""
    values = ", ".join(f"struct('{m}' AS metric, cast({e} AS bigint) AS v)" for m, (e, _, _) in METRICS.items())
    fine = stats.filter("not base_failed").select("lang", "source", F.explode(F.expr(f"array({values})")).alias("x")).select(
        "lang", "source", "x.metric", F.expr(cell("x.v")).alias("cell")).groupBy("lang", "source", "metric", "cell").agg(
        F.count("*").alias("n"))
    fine = stored(fine, "sketches")
    none = F.lit(None).cast("string")
    by_lang = fine.groupBy("lang", "metric", "cell").agg(F.sum("n").alias("n"))
    whole = fine.groupBy("metric", "cell").agg(F.sum("n").alias("n"))
    return fine.select(F.lit(2).alias("level"), "lang", "source", "metric", "cell", "n").unionByName(
        by_lang.select(F.lit(1).alias("level"), "lang", none.alias("source"), "metric", "cell", "n")).unionByName(
        whole.select(F.lit(0).alias("level"), none.alias("lang"), none.alias("source"), "metric", "cell", "n"))


def fences(cells: DataFrame) -> DataFrame:
    """(level, lang, source, metric, rows, lo, hi) from each sketch's quartiles.
    A sketch has a bounded number of cells, so its window is small."""
    group = Window.partitionBy("level", "lang", "source", "metric")
    spread = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, (_, s, _) in METRICS.items()) + " END"
    low = "metric IN (" + ", ".join(f"'{m}'" for m, (_, _, both) in METRICS.items() if both) + ")"
    ranked = cells.withColumn("rows", F.sum("n").over(group)).withColumn(
        "upto", F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    q = ranked.groupBy("level", "lang", "source", "metric", "rows").agg(
        F.expr("min(cell) FILTER (WHERE 4 * upto >= rows)").alias("q1"),
        F.expr("min(cell) FILTER (WHERE 4 * upto >= 3 * rows)").alias("q3"))
    reach = f"{FENCE} * greatest(q3 - q1, {spread})"
    return q.select("level", "lang", "source", "metric", "rows",
                    F.expr(f"CASE WHEN {low} THEN q1 - {reach} END").alias("lo"), F.expr(f"q3 + {reach}").alias("hi"))


def thresholds(cells: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, limits): per language and source one array of (metric, lo, hi)
    from the finest level with at least ``min_rows`` rows (else of everything)."""
    f = stored(fences(cells), "fences")
    pick = lambda level, tag: f.filter(F.col("level") == level).select(
        "lang", "source", "metric", F.col("rows").alias(f"rows{tag}"), F.struct("lo", "hi").alias(f"b{tag}"))
    fine, lang, whole = pick(2, "2"), pick(1, "1").drop("source"), pick(0, "0").drop("lang", "source")
    return fine.alias("f").join(lang.alias("l"), F.expr("f.lang <=> l.lang AND f.metric = l.metric")).join(
        whole.alias("w"), F.expr("f.metric = w.metric")).select(
        "f.lang", "f.source", "f.metric",
        F.expr(f"CASE WHEN rows2 >= {min_rows} THEN b2 WHEN rows1 >= {min_rows} THEN b1 ELSE b0 END").alias("b")).groupBy(
        "lang", "source").agg(*[F.expr(f"max(b) FILTER (WHERE metric = '{m}')").alias(m) for m in METRICS])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules).

    One row per row of ``docs (doc_id, text, lang, source)``; a null language
    or source is a group like any other, a null text counts as empty and fails
    the base rules, repeated rows get equal verdicts, other columns are
    ignored, and an empty table gives an empty result. ``kept`` is false for
    rows that fail the base rules or leave a fence of their group.
    """
    stats = base_statistics(docs.select("doc_id", "lang", "source", "text"))
    limits = thresholds(sketches(stats))
    out = ", ".join(
        f"CASE WHEN {e} > t.{m}.hi" + (f" OR {e} < t.{m}.lo" if both else "") + f" THEN '{m}' END"
        for m, (e, _, both) in METRICS.items())
    judged = stats.alias("d").join(limits.alias("t"), F.expr("d.lang <=> t.lang AND d.source <=> t.source"), "left").withColumn(
        "failed_rules", F.expr(f"CASE WHEN base_failed THEN cast(array('base') AS array<string>) ELSE array_compact(array({out})) END"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.expr("size(failed_rules) = 0").alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))
