"""Operators 2, 3, 5 and 6: definitions, held-out accuracy, hard inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hanga.llm import labelled, language, quality_pu, quality_trees, textstats, toxicity
from hanga.llm.common import in_fold
from llm_fixtures import hard_rows, make_docs, make_labels  # noqa: F401

GOOD = "the river ran past old stone houses while children played near quiet water every day".split()
BAD_WORDS = ["idiot", "scum", "moron"]


def sentence(rnd, words=GOOD, n=9):
    return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."


def prose(rnd, n=12):
    return " ".join(sentence(rnd) for _ in range(n))


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for d in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab# \n\t\x0b\x85é|\u3000", max_size=80))
def test_base_counts_match_definition(text):
    assert textstats.text_stats(text)[:5] == slow_base(text)


def test_base_counts_of_long_and_empty_texts():
    assert textstats.text_stats(None) == textstats.text_stats("") == [0] * len(textstats.NAMES)
    text = " ".join(f"w{i % 997}" for i in range(30000)) + "\nx\nx\n"
    assert textstats.text_stats(text)[:5] == slow_base(text)


# --- operator 3 ---------------------------------------------------------------

def toxic_corpus(n, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, toxic = prose(rnd), i % 5 == 0
        if toxic:
            parts = text.split(". ")
            for _ in range(2):
                parts.insert(rnd.randrange(len(parts)), "You are such a " + rnd.choice(BAD_WORDS))
            text = ". ".join(parts)
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out_accuracy_and_spans(spark, make_docs, make_labels):
    docs, labels = toxic_corpus(400)
    got = toxicity.classify(make_docs(docs, clash=True), make_labels(labels), ~in_fold("doc_id", 5, 0))
    rows = got.withColumn("held", in_fold("doc_id", 5, 0)).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in rows if r["held"]]
    assert len(held) > 40 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert [r["predicted"] for r in rows] == [int(r["score"] >= 0.5) for r in rows]
    for r in rows:
        spans = [r["text"][s["start"]:s["end"]] for s in r["offending"]]
        assert all(any(w in s for w in BAD_WORDS) for s in spans) and bool(spans) == bool(r["predicted"])


def test_toxicity_hard_rows_and_empty_tables(spark, make_docs, make_labels, hard_rows):
    docs, labels = toxic_corpus(100)
    model = toxicity.train(make_docs(docs), make_labels(labels + [(None, 1, 1), (3, None, None)]))
    hard = make_docs(hard_rows, clash=True)
    got = toxicity.score(hard, model).collect()
    assert len(got) == len(hard_rows)
    assert all(r["score"] == 0.0 and r["predicted"] == 0 and r["offending"] == []
               for r in got if not re.search(r"[^\W_]", r["text"] or ""))
    kept = toxicity.drop_toxic(hard, model)
    assert kept.columns == hard.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    none = toxicity.classify(make_docs([]), make_labels([]))
    assert none.count() == 0
    one_class = toxicity.classify(make_docs(docs[:3]), make_labels([(0, 1, 0)])).collect()
    assert all(r["predicted"] == 0 for r in one_class)


# --- operators 2 and 6 --------------------------------------------------------

def junk(rnd):
    kind = rnd.randrange(3)
    w = [rnd.choice(GOOD) for _ in range(90)]
    if kind == 0:
        return " ".join(x + "%%%" for x in w)
    if kind == 1:
        return " | ".join(w)
    return " ".join(w[i // 15] for i in range(90))


def quality_corpus(n, seed=2):
    rnd = random.Random(seed)
    rows = [(i, junk(rnd) if i % 4 == 0 else prose(rnd)) for i in range(n)]
    return rows, [(i, int(i % 4 != 0), 0) for i, _ in rows]


def test_pu_learns_from_positives_and_unlabelled_only(spark, make_docs, make_labels):
    docs, labels = quality_corpus(800)
    positives = [x for x in labels if x[1] == 1 and x[0] % 2]   # half of them, no negative at all
    got = quality_pu.classify(make_docs(docs, clash=True), make_labels(positives), ~in_fold("doc_id", 4, 2))
    rows = got.withColumn("held", in_fold("doc_id", 4, 2)).where("held").collect()
    good = [r["score"] for r in rows if r["doc_id"] % 4]
    bad = [r["score"] for r in rows if r["doc_id"] % 4 == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, 2000)
    for true in (0.3, 0.8):
        u = np.where(rng.random(4000) < true, rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000))
        assert abs(quality_pu.estimate_prior(p, u) - true) < 0.08


def test_pu_hard_rows_and_empty_tables(spark, make_docs, make_labels, hard_rows):
    docs = make_docs(hard_rows, clash=True)
    got = quality_pu.classify(docs, make_labels([(1, 1, 0), (None, 1, 0), (2, None, None)])).collect()
    assert len(got) == len(hard_rows) and all(0 <= r["score"] <= 1 for r in got)
    none = quality_pu.classify(docs, make_labels([])).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert quality_pu.classify(make_docs([]), make_labels([])).count() == 0


def test_trees_base_rules_and_held_out_accuracy(spark, make_docs, make_labels, hard_rows):
    docs, labels = quality_corpus(600, seed=4)
    got = quality_trees.filter_quality(make_docs(docs + hard_rows, clash=True),
                                       make_labels([x for x in labels if x[0] % 3]), rows=5000).collect()
    assert len(got) == len(docs) + len(hard_rows)
    for r in got:
        base = slow_base(r["text"])
        assert [r[n] for n in textstats.BASE] == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    held = [r for r in got[:len(docs)] if r["doc_id"] % 3 == 0 and not r["base_failed"]]
    assert np.mean([r["kept"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.97
    none = quality_trees.filter_quality(make_docs(docs), make_labels([])).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)
    assert quality_trees.filter_quality(make_docs([]), make_labels([])).count() == 0


def test_trees_match_recursive_scoring_and_are_monotonic():
    rng = np.random.default_rng(5)
    x = rng.random((800, 3))
    y = ((x[:, 0] - 0.5 * x[:, 1] ** 2 + 0.1 * rng.normal(size=800)) > 0.4).astype(float)
    trees = quality_trees.fit(x, y, names=("a", "b", "c"), monotone={"a": 1, "b": -1})

    def walk(node, row):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]
    want = [trees.start + sum(walk(r, row) for r in trees.root) for row in x[:50]]
    assert np.allclose(trees.logit(x[:50]), want)
    grid = np.linspace(-0.1, 1.1, 60)
    for j, sign in ((0, 1), (1, -1)):
        z = np.repeat(x[:40], 60, axis=0)
        z[:, j] = np.tile(grid, 40)
        step = np.diff(trees.logit(z).reshape(40, 60), axis=1) * sign
        assert (step >= -1e-12).all()
    assert np.mean((trees.logit(x) > 0) == (y > 0)) > 0.85


# --- operator 5 ---------------------------------------------------------------

LANGS = {"en": "the and with water house street morning people little again through",
         "de": "und der nicht wasser haus straße morgen leute kleine wieder durch",
         "ru": "и он не вода дом улица утро люди снова через маленький"}


def lang_text(rnd, lang, n=40):
    return " ".join(rnd.choice(LANGS[lang].split()) for _ in range(n))


def test_language_held_out_and_mixed_spans(spark, make_docs):
    rnd = random.Random(6)
    rows = [(i, lang_text(rnd, lang), lang) for i, lang in enumerate(["en", "de", "ru"] * 80)]
    mixed = lang_text(rnd, "en", 30) + " " + lang_text(rnd, "de", 50) + " " + lang_text(rnd, "ru", 20)
    rows += [(1000, mixed, None), (1001, "123 ... !!", "en"), (1002, None, "en"), (1003, "世界", None)]
    got = language.identify(make_docs(rows, clash=True), ~in_fold("doc_id", 4, 2))
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows[:240])
    m = by[1000]
    assert m["lang_pred"] == "de" and [s["lang"] for s in m["lang_spans"]] == ["en", "de", "ru"]
    cut = [s["start"] for s in m["lang_spans"]] + [m["lang_spans"][-1]["end"]]
    assert cut[0] == 0 and cut[-1] == len(mixed) and cut == sorted(cut)
    assert abs(cut[1] - len(mixed) * 0.27) < len(mixed) * 0.1
    for i in (1001, 1002):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["lang_spans"]) == ("und", 0.0, [])
    assert by[1003]["lang_pred"] == "de"   # no candidate: equal scores, first in the alphabet


def slow_viterbi(scores, penalty):
    best = None
    n, k = scores.shape
    def rec(t, last, value, path):
        nonlocal best
        if t == n:
            if best is None or value > best[0] + 1e-9:
                best = (value, path)
            return
        for j in range(k):
            rec(t + 1, j, value + scores[t, j] - (penalty if last is not None and j != last else 0), path + [j])
    rec(0, None, 0.0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_best_path_is_optimal(seed):
    rng = np.random.default_rng(seed)
    scores = -4 * rng.random((7, 3))
    scores[3:, 1] += rng.random() * 4
    path = language.best_path(scores, 2.0)
    value = scores[np.arange(7), path].sum() - 2.0 * (np.diff(path) != 0).sum()
    assert value == pytest.approx(slow_viterbi(scores, 2.0))


def test_constant_paths_of_many_texts():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 40, 200)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores = (-4 * rng.random((sizes.sum(), 3)) ** 3).astype(np.float32)
    top = language.constant_paths(scores, starts, 6.0)
    assert (top >= 0).any() and (top < 0).any()
    for a, n, k in zip(starts, sizes, top, strict=True):
        path = language.best_path(scores[a:a + n], 6.0)
        if k >= 0:
            assert (path == k).all()


def test_language_hard_rows_and_empty_tables(spark, make_docs, hard_rows):
    got = language.identify(make_docs(hard_rows, clash=True))
    assert got.count() == len(hard_rows)
    no_lang = [(i, t, None) for i, t in hard_rows]
    assert {r["lang_pred"] for r in language.identify(make_docs(no_lang)).collect()} == {"und"}
    assert language.identify(make_docs([])).count() == 0


def test_copies_do_not_thin_out_the_training_texts(spark, make_docs):
    """A language whose rows are mostly copies of one text keeps its others."""
    rows = [(i, "the same copied text", "en") for i in range(5000)]
    rows += [(5000 + i, f"other text number {i}", "en") for i in range(60)]
    rows += [(6000 + i, f"anderer text nummer {i}", "de") for i in range(60)]
    got = language.training_rows(make_docs(rows), None, rows=100)
    assert len(set(got)) == len(got) == 100
    assert [lang for _, lang in got].count("en") == 50


def test_scripts():
    assert [language.script_of(w) for w in ("abc", "мир", "κόσμος", "世界", "가", "1x", "שלום")] == \
        ["Latin", "Cyrillic", "Greek", "Han", "Hangul", "Latin", "Hebrew"]


@pytest.mark.parametrize("budget", [0, 1, 500, 5000, 10**9])
def test_samples_keep_to_their_bytes(spark, make_docs, make_labels, budget):
    """Greedy in hash order; whole texts only, long ones too."""
    docs = make_docs([(i, "ä" * (1 + i * i % 700)) for i in range(60)] + [(60, None), (None, "x")])
    labels = make_labels([(i, i % 2, None) for i in range(61)] + [(None, 1, 1)])
    order = [r["doc_id"] for r in docs.where("doc_id is not null").orderBy(F.xxhash64("doc_id")).collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    left, want = budget, []
    for i in order[:40]:
        if len(texts[i].encode()) <= left:
            left -= len(texts[i].encode())
            want.append(i)
    got = labelled.labelled_sample(docs, labels, "quality", 40, max_bytes=budget)
    assert got == [(texts[i], i % 2) for i in sorted(want, key=str)]
    others = quality_pu.unlabelled_sample(docs, 1000, max_bytes=budget)
    assert sum(len(t.encode()) for t in others) <= budget
    assert budget < 10**9 or sorted(others) == sorted([*texts.values()])


def test_unlabelled_sample_is_by_smallest_hash(spark, make_docs):
    docs = make_docs([(i % 150, f"text {i % 200}") for i in range(900)] + [(None, "n"), (None, None), (None, None)])
    want = [r["t"] for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct()
            .orderBy(F.xxhash64("doc_id", "t")).collect()]
    for rows in (5, 100, 5000):
        assert quality_pu.unlabelled_sample(docs.repartition(3), rows) == want[:rows]


def test_very_long_texts_reach_the_fits(spark, make_docs, make_labels):
    long_text = "schwer " * 40_000                        # 280,000 characters
    docs = make_docs([(1, long_text, "de"), (2, "easy words", "en")])
    labels = make_labels([(1, 1, 1), (2, 0, 0)])
    assert labelled.labelled_sample(docs, labels, "toxic", 10) == [(long_text, 1), ("easy words", 0)]
    assert (long_text, "de") in language.training_rows(docs, None)
