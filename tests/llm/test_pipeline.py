import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as C  # noqa: E402

from hanga.llm import decontam, mixing, pii, toxicity  # noqa: E402
from hanga.llm.common import clean_shared, in_fold, read_table, shared_table  # noqa: E402
from hanga.llm.queries import MIX_SHARE, MIX_TARGETS, ORACLE_SQL, QUERIES  # noqa: E402
from test_simhash import slow_fingerprint, union  # noqa: E402
from llm_fixtures import hard_rows, make_docs, make_labels  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLE = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "pii_surrogates", "mixing"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_against_a_plain_version(spark):
    """Every stage's result against a straightforward version in Python."""
    docs = read_table(spark, SF, "documents")
    outs, now = [], docs
    for _, stage in C.STAGES:
        now = shared_table(stage(spark, now, SF), "stage")
        outs.append(now)
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert all(o.columns == TABLE for o in outs[:4])
    # 1 toxicity: sentence by sentence with the fitted model
    model = toxicity.train(docs, read_table(spark, SF, "labels"), ~in_fold("doc_id", 5, 0))
    import numpy as np
    table = model.scorer()
    calm = set()
    for i, r in rows.items():
        p = [1 / (1 + np.exp(-(sum(table[w] for w in ws) + model.bias))) for _, _, ws in toxicity.sentences(r["text"])]
        if 1 - np.prod([1 - x for x in p]) < 0.5:
            calm.add(i)
    assert {r["doc_id"] for r in outs[0].collect()} == calm
    # 2 near copies: all pairs of what is left
    fps = {i: slow_fingerprint(rows[i]["text"]) for i in calm}
    root = union([(a, b) for a in calm for b in calm if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], calm)
    firsts = {root[i] for i in calm}
    assert {r["doc_id"] for r in outs[1].collect()} == firsts
    # 3 benchmark items as plain word runs (all planted ones are exact)
    items = [" ".join(decontam.words_of(r["text"])) for r in read_table(spark, SF, "benchmark").collect()]
    clean = {i for i in firsts if not any(f" {x} " in f" {' '.join(decontam.words_of(rows[i]['text']))} " for x in items)}
    assert {r["doc_id"] for r in outs[2].collect()} == clean
    # 4 surrogates: nothing detected before is left, all else unchanged
    for r in outs[3].collect():
        old = rows[r["doc_id"]]["text"]
        hits = pii.detect(old)
        assert (r["text"] == old) == (not hits)
        assert all(old[a:b] not in r["text"] for a, b, _, _ in hits)
        assert r["n_chars"] == (len(r["text"]) if hits else rows[r["doc_id"]]["n_chars"])
    assert outs[3].count() == len(clean)
    # 5 the sample: drawn rows of the keep-all version
    every = mixing.sample_mix(outs[3], MIX_TARGETS, MIX_SHARE, keep_all=True)
    assert {r["doc_id"] for r in every.where("mix_drawn").collect()} == {r["doc_id"] for r in outs[4].collect()}
    # run() gives the same rows
    assert sorted(map(str, C.run(spark, SF).collect())) == sorted(map(str, outs[4].collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_hard_rows_go_through_every_stage(spark, make_docs, hard_rows, empty, tmp_path):
    docs = make_docs([] if empty else hard_rows, clash=True)
    for name in ("labels", "benchmark"):
        read_table(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    now = docs
    for _, stage in C.STAGES:
        now = shared_table(stage(spark, now, str(tmp_path)), "stage")
        assert set(docs.columns) <= set(now.columns)
    assert now.where(F.col("text") == "same row twice").count() <= 1
    if empty:
        assert now.count() == 0
    else:      # every row that is left is one of the input's, each text once
        left = [(r["doc_id"], r["text"]) for r in now.collect()]
        assert set(left) <= set(hard_rows) and len(set(left)) == len(left)


def test_shared_tables_are_cleaned(spark, make_docs):
    df = shared_table(make_docs([(1, "a")]), "gone")
    path = df.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    assert clean_shared(spark) > 0 and not os.path.exists(path)
