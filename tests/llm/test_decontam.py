import math
import random
from collections import Counter

import numpy as np
import pytest

from hanga.llm import decontam as D
from llm_fixtures import hard_rows, make_docs, make_labels  # noqa: F401


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def slow_leaks(text, items, min_similarity=0.8):
    """Best similarity over all windows of the item's size, no index, no prefilter."""
    words = D.words_of(text)
    total = len(items)
    df = Counter(w for _, t in items for w in set(D.words_of(t)))
    weights = {w: 1 + math.log(total / n) for w, n in df.items()}
    out = {}
    for item_id, t in items:
        iw = D.words_of(t)
        n = len(iw)
        if not iw or n > len(words):
            continue
        b = D.shingles_of(iw)
        own = {w: weights[w] for w in iw}
        sims = [D.similarity(D.shingles_of(words[i:i + n]), b, own, sum(own.values()) / len(own))
                for i in range(len(words) - n + 1)]
        if max(sims) >= min_similarity - 1e-9:
            out[item_id] = max(sims)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(12, 40)))) for i in range(12)]
    docs = []
    for d in range(40):
        parts = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        if d % 2:
            words = rnd.choice(items)[1].split()
            for _ in range(d % 3):     # up to two edits: some leaks, some not
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            at = rnd.randint(0, len(parts))
            parts[at:at] = words
        docs.append((d, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_all_windows(spark, make_docs, seed):
    docs, items = corpus(seed)
    got = D.find_leaks(make_docs(docs, clash=True), items_frame(spark, items)).collect()
    have = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    want = {(d, i): s for d, t in docs for i, s in slow_leaks(t, items).items()}
    assert have.keys() == want.keys() and len(want) >= 8
    assert all(have[k] == pytest.approx(want[k]) for k in want)
    for r in got:   # the reported window is the leak
        words = D.words_of(docs[r["doc_id"]][1])[r["first_word"]:r["first_word"] + r["n_words"]]
        item = D.words_of(dict(items)[r["item_id"]])
        assert len(words) == len(item)


def test_blocks_of_items_give_the_same_result(spark, make_docs):
    docs, items = corpus(3)
    frame, bench = make_docs(docs), items_frame(spark, items)
    whole = sorted(map(tuple, D.find_leaks(frame, bench).collect()))
    kept = sorted(r["doc_id"] for r in D.drop_leaks(frame, bench).collect())
    spark.conf.set("hanga.broadcast.maxBytes", "30000")
    try:
        assert len(list(D.item_blocks(bench, 30000))) > 1
        assert sorted(map(tuple, D.find_leaks(frame, bench).collect())) == whole
        assert sorted(r["doc_id"] for r in D.drop_leaks(frame, bench).collect()) == kept
    finally:
        spark.conf.unset("hanga.broadcast.maxBytes")


@pytest.mark.parametrize("radius", [0, 2, 7, D.RADIUS, 19])
def test_every_pair_within_the_radius_is_found(radius):
    rnd = random.Random(radius)
    prints = [rnd.getrandbits(64) for _ in range(60)] + [5, 5]
    asked = []
    for p in prints:
        for n in (0, radius, min(64, radius + 1), 30):
            q = p
            for bit in rnd.sample(range(64), n):
                q ^= 1 << bit
            asked.append(q)
    fp, items = np.array(asked, np.uint64), np.array(prints, np.uint64)
    got = set(zip(*(x.tolist() for x in D.near_pairs(fp, items, D.block_tables(items, radius), radius)),
                  strict=True))
    want = {(w, i) for w, a in enumerate(asked) for i, b in enumerate(prints) if (a ^ b).bit_count() <= radius}
    assert got == want and len(want) >= 2 * len(prints)
    shares = D._shares(radius)      # one bit more in every block would exceed the radius
    assert sum(s + 1 for s in shares) == radius + 1


def test_candidates_in_slices(monkeypatch):
    rnd = random.Random(6)
    items = np.array([rnd.getrandbits(64) for _ in range(40)] + [7] * 30, np.uint64)
    tables = D.block_tables(items, D.RADIUS)
    whole = [x.tolist() for x in D.near_pairs(items, items, tables, D.RADIUS)]
    monkeypatch.setattr(D, "PAIRS", 13)
    assert [x.tolist() for x in D.near_pairs(items, items, tables, D.RADIUS)] == whole
    none = D.near_pairs(np.zeros(0, np.uint64), items, tables, D.RADIUS)
    assert [len(x) for x in none] == [0, 0]


def test_blocks_select_few_and_find_edited_items():
    """Every window of every size looked up, no shingle prefilter: of unrelated
    items 4 % share a block, and windows with a plain 5-word similarity of 0.8
    are within the radius (recall at least 0.98)."""
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    hashes = D.WordHashes()

    def fingerprint(words):
        votes = D._votes(hashes.of(words)).sum(axis=0)
        return np.packbits(votes > 0, bitorder="little").view(np.uint64)[0]

    def jaccard(a, b):
        a, b = D.shingles_of(a), D.shingles_of(b)
        return sum((a & b).values()) / sum((a | b).values())

    items = [[rnd.choice(vocab) for _ in range(rnd.randint(14, 60))] for _ in range(300)]
    prints = np.array([fingerprint(w) for w in items], np.uint64)
    found = near = 0
    for i, words in enumerate(items):
        for _ in range(12):
            edited, n = list(words), rnd.randint(1, 6)
            at = rnd.choice([0, len(words) - n, rnd.randrange(len(words) - n)])   # clustered, often at an end
            edited[at:at + n] = [rnd.choice(vocab) for _ in range(n)]
            if jaccard(words, edited) >= 0.8:
                near += 1
                fp = np.array([fingerprint(edited)], np.uint64)
                got = D.near_pairs(fp, prints, D.block_tables(prints, D.RADIUS), D.RADIUS)[1]
                found += i in got.tolist()
    assert near > 400 and found / near >= 0.98
    fp = np.array([fingerprint([rnd.choice(vocab) for _ in range(30)]) for _ in range(200)], np.uint64)
    shared = np.zeros((len(fp), len(prints)), bool)
    for no, share in enumerate(D._shares(D.RADIUS)):
        shared |= np.bitwise_count(D._block(fp, no)[:, None] ^ D._block(prints, no)[None, :]) <= share
    assert shared.mean() < 0.06


def test_unknown_words_weigh_as_the_items_mean():
    """Items of the same frequent words: one unknown word among 60 leaves a plain
    similarity of 51 / 61, and the weighted one agrees."""
    rnd = random.Random(9)
    items = [(i, " ".join(rnd.sample([f"w{j}" for j in range(60)], 60))) for i in range(20)]
    index = D.build_index(items, {f"w{j}": 1.0 for j in range(60)})
    words = items[4][1].split()
    words[30] = "unknown"
    assert [(i, round(s, 6)) for i, s, *_ in D.leaks_in(" ".join(words), index)] == [(4, round(51 / 61, 6))]


def test_punctuation_case_and_short_items(spark, make_docs):
    items = [(1, "Alpha, beta! Gamma delta; epsilon zeta eta"), (2, "One two"), (3, "..."), (None, "a b c d e f"),
             (5, None), (6, "")]
    docs = [(10, "x ALPHA beta gamma (delta) epsilon zeta eta y"), (11, "say one, two"), (12, "one three two"),
            (13, "A b C d E f g"), (14, "alpha beta gamma")]
    got = {(r["doc_id"], r["item_id"]) for r in
           D.find_leaks(make_docs(docs), items_frame(spark, items)).collect()}
    assert got == {(10, 1), (11, 2), (13, None)}


def test_hard_rows_and_empty_tables(spark, make_docs, hard_rows):
    bench = items_frame(spark, [(1, "same row twice and some other words")])
    docs = make_docs(hard_rows + [(77, "here the same row twice and some other words again")] * 2, clash=True)
    assert sorted(r["doc_id"] for r in D.find_leaks(docs, bench).collect()) == [77, 77]
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(hard_rows)
    assert D.find_leaks(make_docs([]), bench).count() == 0
    assert D.find_leaks(docs, bench.limit(0)).count() == 0
    assert D.drop_leaks(docs, bench.limit(0)).count() == docs.count()


def test_documents_shorter_than_an_item(spark, make_docs):
    """A truncated item is a leak; every document is one window of what it has."""
    items = corpus(5)[1]
    total = len(items)
    df = Counter(w for _, t in items for w in set(D.words_of(t)))
    docs, want = [], {}
    for item_id, t in items:
        words = t.split()
        cuts = [words[:-1], words[1:], words[:-max(1, len(words) // 10)], words[:len(words) // 2], words[:4]]
        for part in cuts:
            d = len(docs)
            docs.append((d, " ".join(part)))
            for other, u in items:      # no index, no prefilter, no skip
                iw = u.split()
                n = min(len(iw), len(part))
                own = {w: 1 + math.log(total / df[w]) for w in iw}
                s = max(D.similarity(D.shingles_of(part[i:i + n]), D.shingles_of(iw), own, sum(own.values()) / len(own))
                        for i in range(len(part) - n + 1))
                if s >= D.MIN_SIMILARITY:
                    want[d, other] = s
    frame, bench = make_docs(docs), items_frame(spark, items)
    got = D.find_leaks(frame, bench).collect()
    have = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert have.keys() == want.keys() and len(want) >= 2 * len(items)
    assert all(have[k] == pytest.approx(want[k]) for k in want)
    assert all(r["first_word"] == 0 and r["n_words"] == len(docs[r["doc_id"]][1].split()) for r in got)
    assert {r["doc_id"] for r in D.drop_leaks(frame, bench).collect()} == \
        {d for d, _ in docs} - {d for d, _ in want}
