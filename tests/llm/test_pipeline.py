"""The pipeline against its stages on their own, and planted cases."""

import hashlib
import random

import corpus_pipeline
from tenorlake.llm.queries import ORACLES, QUERIES

from .conftest import ODD
from .test_text_ops import slow_secrets


def test_stages_take_odd_rows_and_extra_columns(make, spark, sf_dir):
    for docs in (make([r[:2] for r in ODD]), make([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_planted_documents(make, spark, sf_dir):
    rng = random.Random(1)
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    clean = max((r.text for r in real if r.text and "|" not in r.text and r.text.count("!!") < 3 and len(set(r.text.split())) > 250), key=len)
    words = clean.split()
    leak = " ".join(words[:60]) + " " + bench + " " + " ".join(words[60:120])
    rows = [(10_000, clean), (10_001, clean + " extra"), (10_002, leak), (10_003, " ".join(rng.sample(words, 200)) + " token = abcdefghijkl1234"), (10_004, "buy!! " * 80)]
    out = corpus_pipeline.STAGES
    # the classifier learns from the labelled documents among those that it is given
    docs = make([(r.doc_id, r.text) for r in real if r.text != clean] + rows)
    for _, stage in out[:3]:
        docs = stage(spark, docs, sf_dir)
    kept = {r.doc_id for r in docs.filter("doc_id >= 10000").collect()}
    assert kept == {10_000, 10_003}
    assert "[assign]" in {r.doc_id: r for r in out[3][1](spark, docs, sf_dir).collect()}[10_003].text


def test_run_keeps_what_the_stages_keep(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * whole < len(rows) < whole and len({r.doc_id for r in rows}) == len(rows)


def test_secret_columns_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op10_secret_scan"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        base = slow_secrets(text or "")
        r = got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("checked")] == [f"{k}:{a}:{b}" for k, a, b in base]


def test_registry(spark, sf_dir):
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] and set(ORACLES) <= set(QUERIES)
    for name in ("op1_url_filter", "op8_ngram_perplexity", "op10_secret_scan"):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_run_takes_a_table_of_odd_rows(make, spark, labels_of, tmp_path):
    """The whole pipeline from files: nulls, repeated ids, blank and long texts, columns with names that the stages use."""
    rng = random.Random(3)
    good = [(100 + i, " ".join(rng.choice("river stone field cloud winter market letter garden".split()) + str(rng.randrange(400)) for _ in range(120))) for i in range(60)]
    bad = [(200 + i, "buy!! now!! " * rng.randrange(20, 90)) for i in range(40)]
    docs = make([r[:2] for r in ODD] + good + bad)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels_of([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad] + [(999, None, None), (None, 1, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in rows]
    assert {d for d, _ in good} <= set(ids) and len(ids) == len(set(ids)) and not {d for d, _ in bad} & set(ids)
    assert all(len(r.ids_sha256) == len(r.decoded_sha256) == 64 for r in rows)
