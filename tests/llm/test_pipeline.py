import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_ngram_jaccard import brute as near_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Every stage's input and output on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        result = C.stored(stage(spark, docs, SF), f"test_{name}")
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_all_but_the_last_keep_the_columns(steps):
    for name, (docs, out) in list(steps.items())[:-1]:
        assert out.schema == docs.schema, name


def test_language_stage_keeps_clean_documents(spark, steps):
    docs, out = steps["language_id"]
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    n = docs.join(good, "doc_id", "left_semi").count()
    assert out.join(good, "doc_id", "left_semi").count() >= 0.99 * n
    assert out.filter("text IS NULL OR text = ''").count() == 0


def test_one_of_each_group_stays(steps):
    docs, out = steps["ngram_jaccard_join"]
    want = {g for _, _, g, _, _ in near_brute(rows(docs))}
    assert sorted(d for d, _ in rows(out)) == sorted(want)


def test_documents_with_an_item_go(spark, steps):
    docs, out = steps["benchmark_decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, squash = {d for d, _ in rows(out)}, lambda t: "".join(t.split()).lower()
    items = [squash(t) for t in items]
    hit = {d for d, t in rows(docs) if any(i in squash(t) for i in items)}
    assert not kept & hit and len(kept) >= 0.95 * (len(rows(docs)) - len(hit))


def test_the_mix_keeps_good_documents(spark, steps):
    docs, out = steps["target_mix"]
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")
    n = docs.join(good, "doc_id", "left_semi").count()
    assert out.join(good, "doc_id", "left_semi").select("doc_id").distinct().count() >= 0.97 * n
    assert set(rows(out)) <= set(rows(docs))


def test_tokens_of_every_document(steps):
    docs, out = steps["token_output"]
    tok, at = Tokenizer.from_file(C.TOKENIZER), 0
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in out.collect())
    assert [d for _, d, _ in got] == sorted(d for d, _ in rows(docs))
    texts = dict(rows(docs))
    for start, d, n in got:
        assert start == at and n == 1 + len(tok.encode(texts[d], add_special_tokens=False).ids)
        at += n


def test_stages_take_odd_rows(spark, make_docs, prose):
    odd = [(i, prose(i, 50)) for i in range(12)] + [(20, None), (21, ""), (None, prose(3, 50)), (3, prose(3, 50)), (22, "x" * 20_000)]
    for docs in (make_docs(odd), make_docs([])):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= 3 * docs.count(), name
        assert C.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_equals_the_stages(spark, steps):
    assert C.run(spark, SF).agg(F.count("*"), F.sum("n_tokens"), F.sum("ids_crc32")).first() == \
        steps["token_output"][1].agg(F.count("*"), F.sum("n_tokens"), F.sum("ids_crc32")).first()


def test_first_stage_keeps_columns_whose_names_clash(spark, sf001):
    import corpus_pipeline as P
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf001}/documents.parquet").withColumns(
        {"score": F.col("doc_id") * 3, "lang_pred": F.lit("mine"), "rejected": F.lit(7), "own_0": F.col("doc_id")})
    out = P.known_language(spark, docs, sf001)
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and all((r.score, r.lang_pred, r.rejected, r.own_0) == (3 * r.doc_id, "mine", 7, r.doc_id) for r in rows)
