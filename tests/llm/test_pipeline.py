"""The pipeline beside plain Python on the smallest tables, and the registration of all queries."""

import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from clickloom.llm import decontaminate, mix, simhash, tokens, toxicity, work
from clickloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.compare import connect, difference
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = work.store(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10
    assert names["pipeline"] is corpus_pipeline.run and set(ORACLES) <= set(QUERIES)


def test_sql_agrees(spark):
    con = connect(SF)
    for key, sql in ORACLES.items():
        assert difference(QUERIES[key](spark, SF), con, sql) is None


def test_stages_keep_columns_and_effect(spark, stages):
    for name in ("toxicity", "near_dedup", "decontaminate", "mix"):
        assert stages[name].columns == stages["documents"].columns
    lexicon = toxicity.learn(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    run = lexicon.scorer()
    before = texts(stages["documents"])
    kept = {i for i, t in before.items() if run([t])[0][0] < toxicity.REJECT}
    assert set(texts(stages["toxicity"])) == kept

    ids = sorted(kept)
    root = plain_components([plain_fingerprint(before[i]) for i in ids])
    assert set(texts(stages["near_dedup"])) == {ids[r] for r in set(root)}

    bench = [decontaminate.reduce(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in texts(stages["near_dedup"]).items() if any(b in decontaminate.reduce(t) for b in bench)}
    left = set(texts(stages["decontaminate"]))
    assert leaks and not leaks & left and set(texts(stages["near_dedup"])) - leaks == left

    copies = {r.doc_id: r.copies for r in mix.mix(stages["decontaminate"]).collect()}
    mixed = Counter(r.doc_id for r in stages["mix"].select("doc_id").collect())
    assert mixed == {i: n for i, n in copies.items() if n}


def test_tokens_of_the_mix(stages):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = tokens.WordEncoder(f.read()).tokenizer
    want, start = [], 0
    for r in sorted(stages["mix"].collect(), key=lambda r: r.doc_id):
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = stages["token_ids"].select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_documents(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert simhash.RADIUS == 3
