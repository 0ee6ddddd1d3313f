import re
from collections import Counter

import duckdb
import pytest

from carelens.llm import entry
from carelens.llm import quality_rules as Q


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def cell(v):
    s = v.bit_length() - 6
    return v if v < 64 else v >> s << s


def rows(prose):
    out = [(i, prose(i, 60 + i), "en" if i % 3 else "fr", "s1") for i in range(160)]
    out += [(300 + i, prose(i, 70) + " $%&" * (20 + i), "en", "s1") for i in range(4)]
    out += [(400, None, "en", "s1"), (401, "", None, None), (402, "a b c a b c a b c a", "en", "s1"), (403, "x\nx\n\n \ny\nx", "en", "s2"),
            (404, prose(1, 80), None, None), (404, prose(1, 80), None, None), (None, prose(2, 70), "xx", None), (405, "one two three " * 9000, "en", "s1"),
            (406, "ä é\tö\x0bü x x x", "en", "s1"), (407, "w", "en", "s1"), (408, "a b c", "en", "s1"), (409, prose(5, 25_000), "en", "s1"),
            (410, "word " * 3 + "supercalifragilistic" * 9 + " x" * 50, "en", "s1")]
    return out


def verdicts(data):
    """Verdicts by plain Python, from sorted lists of sketch cells."""
    stats = [(r, base(r[1])) for r in data]
    metric = lambda b: {"mean_word": 1000 * b[1] // b[0], "symbols": 1000 * b[2] // b[0], "dup_lines": 1000 * b[3] // b[0],
                        "repeats": 1000 * b[4] // b[0]}
    groups = {}
    for r, b in stats:
        if b[0] >= 50 and 100 * b[4] <= 50 * b[0]:
            for g in ((r[2], r[3]), (r[2],), ()):
                for m, v in metric(b).items():
                    groups.setdefault((g, m), []).append(cell(v))
    out = []
    for r, b in stats:
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        bad = []
        for m, v in ({} if failed else metric(b)).items():
            cells = next((sorted(groups[g, m]) for g in ((r[2], r[3]), (r[2],)) if len(groups[g, m]) >= Q.MIN_ROWS), sorted(groups[(), m]))
            q1, q3 = cells[-(-len(cells) // 4) - 1], cells[-(-3 * len(cells) // 4) - 1]
            reach = Q.FENCE * max(q3 - q1, Q.METRICS[m][1])
            if v > q3 + reach or (Q.METRICS[m][2] and v < q1 - reach):
                bad.append(m)
        out.append((r[0], *b, failed, not failed and not bad, "base" if failed else ",".join(bad)))
    return sorted(out, key=str)


def test_equals_brute_force(make_docs, prose):
    data = rows(prose)
    got = sorted((tuple(r) for r in Q.quality_verdicts(make_docs(data)).collect()), key=str)
    assert got == verdicts(data)
    assert sum(not r[-2] and not r[-3] for r in got) >= 4


def test_sketches_merge_by_adding(make_docs, prose):
    data = rows(prose)
    sketch = lambda part: {(r["level"], r["lang"], r["source"], r["metric"], r["cell"]): r["n"] for r in Q.sketches(
        Q.base_statistics(make_docs(part))).collect()}
    whole, a, b = sketch(data), sketch(data[::2]), sketch(data[1::2])
    assert Counter(a) + Counter(b) == Counter(whole)


def test_plan_has_no_python(spark, sf001):
    text = Q._statistics(entry.table(spark, sf001, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_empty_table(make_docs):
    assert Q.quality_verdicts(make_docs([])).collect() == []


def test_oracle(spark, sf001):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf001}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op5_quality_rules"]).df()
    got = entry.op5_quality_rules(spark, sf001).toPandas()[list(want.columns)]
    key = lambda f: sorted(map(tuple, f.itertuples(index=False)), key=str)
    assert key(got) == key(want)


@pytest.mark.parametrize("v", [0, 1, 63, 64, 65, 127, 128, 1000, 12345, 10 ** 9])
def test_cells_are_lower_bounds_of_small_error(spark, v):
    got = spark.sql(f"SELECT {Q.cell(f'{v}L')} AS c").first()["c"]
    assert got == cell(v) and got <= v <= got * 33 / 32
