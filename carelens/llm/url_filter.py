"""URL filters by rules and link-graph propagation (operator 7).

Rules decide the urls they fit; the rest is decided per host. Hosts of pages
that an allow rule fits are trusted seeds, hosts of blocked pages distrusted
seeds, each weighted by such pages. Over the host graph (distinct pages linking
from host to host) personalised PageRank spreads trust along the links and
distrust against them until next to nothing is left to spread and no new host
is reached; both run as one table, so an iteration is one join on the host and
one aggregation. A host is blocked if it has more distrust than
``margin`` times its trust.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import remove, store

BATCH = 6  # rounds between two writes of the ranks

RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: absolute links, and bare host names as browsers turn into links
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""
BARE = r"(?i)\b(www\.(?:[a-z0-9-]+\.)+[a-z]{2,})\b"


def _lower(col):
    """A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_urls(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` (after the first ``://``, lower-cased) and ``path`` (up to ``?``
    or ``#``); both are empty for a null url or one without ``://``."""
    t = pages.withColumn("_u", F.col("url"))
    t = t.withColumn("_r", F.expr("""CASE WHEN instr(_u, '://') > 0 THEN
        substring_index(substring_index(substr(_u, instr(_u, '://') + 3), '#', 1), '?', 1) ELSE '' END"""))
    t = t.withColumn("_h", F.expr("substring_index(_r, '/', 1)"))
    return t.withColumn("host", _lower(F.coalesce("_h", F.lit("")))).withColumn(
        "path", F.coalesce(F.expr("substr(_r, length(_h) + 1)"), F.lit(""))).drop("_u", "_r", "_h")


def fitting_rule(rules=RULES):
    """(rule, verdict) of the longest rule that fits host and path, as a struct column; null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest comes last and wins
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, n): host a has n pages that link to host b. A page counts a host once."""
    found = F.concat(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), F.regexp_extract_all("html", F.lit(BARE), F.lit(1)))
    hosts = F.array_distinct(F.transform(found, lambda x: _lower(F.regexp_extract(x, r"([^@]*)$", 1))))
    e = pages.filter("host != '' AND html IS NOT NULL").select(F.col("host").alias("a"), F.explode(hosts).alias("b"))
    return e.filter("b != '' AND a != b").groupBy("a", "b").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = 10,
              tolerance: float = 1e-9) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind of ``seeds (kind, host, weight)``.

    Kind ``trust`` follows the links a -> b, ``distrust`` goes from b to a.
    Seeds are scaled to sum 1 per kind; a host without links on passes nothing.
    ``rounds`` None: until the rank that can still spread is at most
    ``tolerance`` per kind and a batch of rounds has reached no new host, so
    every host linked with a seed over any distance has a rank.

    Each host holds its rank and the share of it that came in the last round,
    which alone is passed on; a link of a host to itself keeps the rank, so a
    round is one join and one aggregation. Ranks are written to the shared
    folder every ``BATCH`` rounds.
    """
    spark = links.sparkSession
    way = links.select(F.lit("trust").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), "n").union(
        links.select(F.lit("distrust").alias("kind"), F.col("b").alias("src"), F.col("a").alias("dst"), "n"))
    out = way.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    rank, old = store(seeds.join(total, "kind").filter("total > 0").select(
        "kind", "host", (F.col("weight") / F.col("total") * (1 - damping)).alias("rank")).withColumn("fresh", F.col("rank")), "host_ranks")
    hosts = way.select("kind", F.col("dst").alias("src")).union(rank.select("kind", F.col("host").alias("src"))).distinct()
    edges, _ = store(way.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total") * damping).alias("w")).union(
        hosts.select("kind", "src", F.col("src").alias("dst"), F.lit(None).cast("double").alias("w"))), "host_edges")
    done, reached = 0, None
    while rounds is None or done < rounds:
        n = BATCH if rounds is None else min(BATCH, rounds - done)
        for _ in range(n):
            passed = F.when(F.col("w").isNull(), 0.0).otherwise(F.col("fresh") * F.col("w"))
            rank = edges.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).filter("w IS NULL OR fresh > 0").select(
                "kind", F.col("dst").alias("host"), F.when(F.col("w").isNull(), F.col("rank")).otherwise(passed).alias("rank"),
                passed.alias("fresh")).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("fresh").alias("fresh"))
        done += n
        rank, path = store(rank, "host_ranks")
        remove(spark, old)
        old = path
        if rounds is None:
            now = {r["kind"]: (r["n"], r["fresh"]) for r in rank.groupBy("kind").agg(
                F.count("*").alias("n"), F.sum("fresh").alias("fresh")).collect()}
            left = max((f for _, f in now.values()), default=0.0) * damping / (1 - damping)
            count = sum(c for c, _ in now.values())
            if left <= tolerance and count == reached or not left:
                break
            reached = count
    # what still spreads stays where it is, as in the iteration from the seeds
    return rank.select("kind", "host", (F.col("rank") + F.col("fresh") * (damping / (1 - damping))).alias("rank"))


def judge_urls(pages: DataFrame, rules=RULES, margin: float = 1.0, damping: float = 0.85,
               rounds: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per row of ``pages (page_id, url, html)``.

    The longest fitting rule decides; a rule fits its host and all subdomains
    if the path starts with its path. Else the host decides: block if distrust
    > margin * trust, else allow. A null url or one without ``://`` has an empty
    host and path, fits no rule and is allowed. A null html has no links.
    Repeated rows count like others; other columns are ignored; an empty table
    gives an empty result.
    """
    t = split_urls(pages.select("page_id", "url", "html")).withColumn("_m", fitting_rule(rules))
    judged, _ = store(t.select("page_id", "host", "path", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("ruled")), "page_rules")
    links, _ = store(host_links(t.select("host", "html")), "host_links")
    seeds = judged.filter("ruled IS NOT NULL").groupBy(
        F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(
        F.count("*").alias("weight"))
    ranks = propagate(links, seeds, damping, rounds).groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"))
    zero = F.lit(0.0)
    return judged.join(ranks, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.coalesce("distrust", zero) > margin * F.coalesce("trust", zero), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
