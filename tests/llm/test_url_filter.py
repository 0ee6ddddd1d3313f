import duckdb
import numpy as np
import pytest

from carelens.llm import entry
from carelens.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)


def link(host):
    return f'<a href="https://{host}/x">y</a>'


def brute_ranks(edges, seeds, damping=0.85, rounds=10):
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    if not sum(seeds.values()):
        return {}
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        m[at[b], at[a]] = n
    total = m.sum(axis=0)
    m = m / np.where(total > 0, total, 1)
    s = np.array([seeds.get(h, 0) for h in hosts]) / sum(seeds.values())
    r = s
    for _ in range(rounds):
        r = damping * m @ r + (1 - damping) * s
    return dict(zip(hosts, r))


def test_propagation_equals_matrix_iteration(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 4, ("d", "c"): 1, ("e", "d"): 3}
    good, bad = {"a": 2, "e": 1}, {"c": 5}
    got = U.propagate(spark.createDataFrame([(*k, n) for k, n in edges.items()], "a string, b string, n long"),
                      spark.createDataFrame([("trust", h, n) for h, n in good.items()] + [("distrust", h, n) for h, n in bad.items()],
                                            "kind string, host string, weight long")).collect()
    got = {(r["kind"], r["host"]): r["rank"] for r in got}
    back = {(b, a): n for (a, b), n in edges.items()}
    for kind, e, s in (("trust", edges, good), ("distrust", back, bad)):
        for h, v in brute_ranks(e, s).items():
            assert got.get((kind, h), 0.0) == pytest.approx(v, abs=1e-12)


def test_converged_ranks_solve_the_linear_system(spark):
    """A chain of 40 hosts, a cycle that holds its rank and a branch, without a number of rounds."""
    edges = {(f"c{i}", f"c{i + 1}"): 1 for i in range(40)} | {("x", "y"): 2, ("y", "x"): 1, ("y", "c0"): 1, ("x", "z"): 1}
    seeds = {"x": 3, "c0": 1}
    hosts = sorted({h for e in edges for h in e})
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        m[at[b], at[a]] = n
    total = m.sum(axis=0)
    m = m / np.where(total > 0, total, 1)
    s = np.array([seeds.get(h, 0) for h in hosts]) / 4
    want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, 0.15 * s)
    got = U.propagate(spark.createDataFrame([(*k, n) for k, n in edges.items()], "a string, b string, n long"),
                      spark.createDataFrame([("trust", h, n) for h, n in seeds.items()], "kind string, host string, weight long"), rounds=None)
    got = {r["host"]: r["rank"] for r in got.collect()}
    assert set(got) == set(hosts) and np.allclose([got[h] for h in hosts], want, rtol=1e-6, atol=1e-9)


def test_hosts_far_from_every_seed_are_judged(spark):
    rows = [(0, "http://bad.com/de/1", None), (1, "http://h1.net/", link("bad.com"))] + [
        (i, f"http://h{i}.net/", link(f"h{i - 1}.net")) for i in range(2, 16)]
    got = {r["host"]: r for r in U.judge_urls(pages(spark, rows)).collect()}
    assert all(got[f"h{i}.net"]["verdict"] == "block" and got[f"h{i}.net"]["distrust"] > 0 for i in range(1, 16))


def test_urls_and_rules(spark):
    cases = [("HTTPS://WWW.Example.ORG/es/1?a#b", "www.example.org", "/es/1", "example.org/es/", "block"),
             ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
             ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
             ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
             ("http://example.org", "example.org", "", None, None), ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
             ("//a.com/fr/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
             ("a://b?c://d/e", "b", "", None, None), ("a://COM/de/x", "com", "/de/x", "com/de/", "block"), ("a://", "", "", None, "allow"),
             ("u://İ.com/fr/", "İ.com", "/fr/", "com/fr/", "allow"), ("u://a#b/c?d", "a", "", None, None)]
    got = {r["page_id"]: r for r in U.judge_urls(pages(spark, [(i, c[0], None) for i, c in enumerate(cases)])).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), cases[i]
        assert verdict in (None, r["verdict"])


def test_hosts_next_to_blocked_pages_are_blocked(spark):
    rows = [(1, "http://good.org/", link("fine.net")), (2, "http://bad.com/de/1", None), (3, "http://spam.net/", link("bad.com") * 3),
            (4, "http://fine.net/x", ""), (5, "http://spam.net/", "see www.bad.com now"), (6, "http://lone.net/", None),
            (None, "http://spam.net/", link("lone.net")), (6, "http://lone.net/", None), (7, "http://spam2.net/" + "x" * 50_000, link("SPAM.net"))]
    got = sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in U.judge_urls(pages(spark, rows)).collect())
    verdict = {h: v for _, h, v in got}
    assert len(got) == len(rows)
    assert verdict == {"good.org": "allow", "bad.com": "block", "spam.net": "block", "fine.net": "allow", "lone.net": "allow", "spam2.net": "block"}


def test_links_of_a_page(spark):
    html = """<a HREF='//X.com/a'><img src=http://u:p@y.org:80/b><a href="/rel"><a href="https://x.com">www.Z.example.net."""
    got = U.host_links(U.split_urls(pages(spark, [(1, "http://h.de/", html), (2, "http://h.de/", html)]))).collect()
    assert sorted(tuple(r) for r in got) == [("h.de", "www.z.example.net", 2), ("h.de", "x.com", 2), ("h.de", "y.org:80", 2)]


def test_empty(spark):
    assert U.judge_urls(pages(spark, [])).collect() == []


def test_rules_equal_sql(spark, sf001):
    """Host, path, rule and the verdicts of rules on the test table, by SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf001}/pages.parquet'")
    want = con.execute(r"""
        WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host,
                          regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
                                    ('com/fr/', 'allow'), ('com/de/', 'block')),
        m AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
              FROM p LEFT JOIN r ON ('.' || lower(host)) LIKE ('%.' || split_part(rule, '/', 1))
                                AND starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1)))
        SELECT page_id, lower(host), path, rule, verdict FROM m WHERE k = 1""").fetchall()
    got = {r["page_id"]: r for r in entry.op7_url_filters(spark, sf001).collect()}
    assert len(got) == len(want)
    for i, host, path, rule, verdict in want:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert verdict in (None, got[i]["verdict"])
