import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanga.llm import mixing as M
from hanga.llm.queries import MIX_SHARE, MIX_TARGETS
from llm_fixtures import hard_rows, make_docs, make_labels  # noqa: F401

TARGETS = {"source": {"a": 0.5, "b": 0.3, "other": 0.2}, "lang": {"en": 0.6, "de": 0.4},
           "topic": {"prose": 0.8, "table": 0.2}}


def test_rake_meets_every_marginal():
    rng = np.random.default_rng(1)
    cells = [(s, lang, t) for s in ("a", "b", "other") for lang in ("en", "de") for t in ("prose", "table")]
    tokens = rng.integers(10, 1000, len(cells)).astype(float)
    fitted, gaps = M.rake(cells, tokens, [TARGETS[m] for m in M.MARGINS])
    assert max(gaps) <= M.TOLERANCE
    assert fitted.sum() == pytest.approx(tokens.sum())
    for axis, name in enumerate(M.MARGINS):
        for k, share in TARGETS[name].items():
            got = sum(f for c, f in zip(cells, fitted, strict=True) if c[axis] == k) / tokens.sum()
            assert got == pytest.approx(share, abs=1e-9)


def test_rake_rescales_absent_categories_and_drops_untargeted():
    cells = [("a", "en", "prose"), ("zz", "en", "prose")]
    fitted, _ = M.rake(cells, np.array([10.0, 30.0]), [{"a": 0.5, "b": 0.5}, {"en": 1.0}, {"prose": 1.0}])
    assert fitted.tolist() == [40.0, 0.0]


def test_calibration_spends_the_budget():
    rng = np.random.default_rng(2)
    for budget in (0.0, 0.1, 0.5, 0.9, 2.0):
        t, w = rng.integers(1, 100, 30).astype(float), rng.exponential(1, 30)
        w[:3] = 0
        p = M.calibrate(t, w, budget * t.sum())
        assert ((p >= 0) & (p <= 1)).all() and (p[:3] == 0).all()
        want = min(budget * t.sum(), t[w > 0].sum())
        assert (p * t).sum() == pytest.approx(want)
        free = p[(p < 1) & (w > 0)] / w[(p < 1) & (w > 0)]
        assert len(free) < 2 or free.std() < 1e-9
    assert M.calibrate(np.zeros(0), np.zeros(0), 1.0).size == 0


def test_sample_follows_probabilities(spark, make_docs):
    rows = [(i, "word " * (5 + i % 20) + ("x | y" if i % 7 == 0 else ""), ("en", "de", "fr")[i % 3],
             ("a", "a", "a", "b", "c", None)[i % 6]) for i in range(6000)]
    docs = make_docs(rows, clash=True)
    got = M.sample_mix(docs, TARGETS, 0.3, keep_all=True).collect()
    assert len(got) == 6000
    tokens = np.array([r["mix_tokens"] for r in got], float)
    p = np.array([r["mix_probability"] for r in got])
    drawn = np.array([r["mix_drawn"] for r in got])
    assert (tokens * p).sum() == pytest.approx(0.3 * tokens.sum())
    assert abs((tokens * drawn).sum() / (tokens * p).sum() - 1) < 0.06
    fr = np.array([r["lang"] == "fr" for r in got])
    assert not drawn[fr].any()            # no target and no share for "other"
    de = np.array([r["lang"] == "de" for r in got])
    assert abs((tokens * drawn)[de].sum() / (tokens * drawn).sum() - 0.4) < 0.05
    kept = M.sample_mix(docs, TARGETS, 0.3)
    assert kept.count() == drawn.sum()
    assert kept.columns == [c for c in docs.columns if c != "mix_topic"] + \
        ["mix_topic", "mix_tokens", "mix_weight", "mix_probability"]


def test_hard_rows_and_empty_tables(spark, make_docs, hard_rows):
    docs = make_docs(hard_rows)
    got = M.sample_mix(docs, {"source": {"src0": 1.0}, "lang": {"en": 1.0}, "topic": {"prose": 1.0}}, 1.0,
                       keep_all=True).collect()
    assert len(got) == len(hard_rows)
    for r in got:
        n = len((r["text"] or "").encode().split())
        assert r["mix_tokens"] == n
        assert r["mix_drawn"] == (r["mix_probability"] == 1.0)
    assert M.sample_mix(make_docs([]), TARGETS, 0.5).count() == 0
    nulls = make_docs([(1, "a b", None, None), (1, "a b", None, None), (None, None, None, None)])
    two = M.sample_mix(nulls, {"source": {"other": 1.0}, "lang": {"other": 1.0}, "topic": {"prose": 1.0}}, 1.0)
    assert sorted(map(str, [r["doc_id"] for r in two.collect()])) == ["1", "1", "None"]   # a null text has its cell's


def test_targets_that_cannot_be_met_are_reported(spark, make_docs):
    """All of one source is of one language, so both marginals cannot be met."""
    cells = [("a", "en", "prose"), ("b", "de", "prose")]
    fitted, gaps = M.rake(cells, np.array([10.0, 30.0]),
                          [{"a": 0.5, "b": 0.5}, {"en": 0.9, "de": 0.1}, {"prose": 1.0}], 50)
    assert gaps == pytest.approx([0.4, 0.0, 0.0]) and fitted.sum() == pytest.approx(40.0)
    docs = make_docs([(1, "a b", "en", "a"), (2, "a b c", "de", "b")]).select(
        "source", "lang", F.lit("prose").alias("topic"), F.lit(3).alias("tokens"))
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}, "topic": {"prose": 1.0}}
    with pytest.warns(UserWarning, match="not met"):
        assert M.fit_mix(docs, targets, 0.5, 20).gaps["source"] > 0.3


def test_unlisted_sources_and_languages_are_drawn_by_the_query(spark, make_docs):
    """A hot source that no target lists, and null sources and languages."""
    kinds = [("hot", "en"), ("hot", None), (None, "pt"), (None, None), ("src3", None), ("src1", "en"),
             ("src2", "de"), ("src3", "fr"), ("src4", "es")]
    rows = [(i, f"w{i} " + "word " * 20, kinds[i % 9][1], kinds[i % 9][0]) for i in range(3600)]
    got = M.sample_mix(make_docs(rows), MIX_TARGETS, MIX_SHARE, keep_all=True).collect()
    assert all(r["mix_probability"] > 0 for r in got)
    drawn = {(r["source"], r["lang"]) for r in got if r["mix_drawn"]}
    assert drawn == set(kinds)


def test_factors_equal_the_fit_on_the_driver(spark):
    rng = np.random.default_rng(5)
    names = [(f"s{a}", f"l{b}", f"t{c}") for a in range(6) for b in range(4) for c in range(3)]
    names = [n for n in names if rng.random() < 0.7] + [("other", "l0", "t0")]
    rows = [(*n, int(rng.integers(1, 10_000))) for n in names]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {**{f"s{a}": 0.1 * (a + 1) for a in range(6)}, "unseen": 0.3},
               "lang": {f"l{b}": 0.25 for b in range(4)}, "topic": {"t0": 0.6, "t1": 0.3, "t2": 0.1}}
    for share in (0.0, 0.4, 0.9, 3.0):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            plain, table = M.fit_mix(cells, targets, share, 4), M.fit_factors(cells, targets, share, 4)
        got = {tuple(r[m] for m in M.MARGINS): r for r in table.joined(cells).collect()}
        for c, w, p in zip(plain.cells, plain.weight, plain.probability, strict=True):
            assert got[c]["mix_weight"] == pytest.approx(w, rel=1e-9)
            assert got[c]["mix_probability"] == pytest.approx(p, rel=1e-9, abs=1e-12)
        assert table.gaps == pytest.approx(plain.gaps, abs=1e-9)


def test_more_cells_than_the_limit(spark, make_docs, hard_rows):
    """Past the limit the same rows come from factors, without the cells on the driver."""
    rows = [(i, "word " * (1 + i % 9), ("en", "de")[i % 2], ("a", "b", "c")[i % 3]) for i in range(300)]
    rows += [(1000 + i, t, "de", "a") for i, (_, t) in enumerate(hard_rows)]
    rows += [(2000, "", "fr", "b"), (2001, None, "fr", "b"), (None, " ", None, None), (2002, "", "en", "a")]
    docs = make_docs(rows, clash=True)
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.3, "fr": 0.2}, "topic": {"prose": 1.0}}

    def drawn():
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = M.sample_mix(docs, targets, 0.4, 3, keep_all=True)
            return sorted((str(r["doc_id"]), str(r["text"])[:9], r["mix_tokens"], round(r["mix_weight"], 9),
                           round(r["mix_probability"], 9), r["mix_drawn"]) for r in got.collect())

    small = drawn()
    spark.conf.set("hanga.broadcast.maxBytes", "1")
    try:
        assert drawn() == small
    finally:
        spark.conf.unset("hanga.broadcast.maxBytes")
    assert len(small) == len(rows) and any(r[5] for r in small)


def test_targets_spanning_millions_of_cells_are_taken(spark, make_docs):
    big = {"source": {str(i): 1.0 for i in range(2000)}, "lang": {str(i): 1.0 for i in range(2000)},
           "topic": {"prose": 1.0}}
    docs = make_docs([(1, "a b", "7", "5"), (2, "a", "8", "5"), (3, "a", "xx", "5")])
    got = {r["doc_id"]: r["mix_probability"] for r in M.sample_mix(docs, big, 1.0, keep_all=True).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}
