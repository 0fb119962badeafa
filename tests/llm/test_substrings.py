import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from hanga.llm import substrings as X
from llm_fixtures import hard_rows, make_docs, make_labels  # noqa: F401


def brute(texts, length):
    """(n_bytes, kept bytes, spans) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = [i for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(d), bytes(b for b, g in zip(d, gone, strict=True) if not g), len(spans)))
    return out


def check(make_docs, texts, length, gram, piece=4, ids=None):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    got = X.remove_repeats(make_docs(rows, clash=True), length, gram, piece).collect()
    have = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got), key=str)
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute(texts, length), strict=True)), key=str)
    assert have == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts_against_brute_force(spark, make_docs, seed):
    rnd = random.Random(seed)
    alphabet = "ab" if seed == 1 else "abcdé \n"
    passages = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(25):
        parts = [rnd.choice(passages) if rnd.random() < 0.6
                 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
                 for _ in range(rnd.randint(0, 5))]
        texts.append("".join(parts))
    check(make_docs, texts, 20, 10)


def test_periods_copies_and_hard_rows(spark, make_docs, hard_rows):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    texts = ["ab" * 60, "a" * 100, long, long, long[50:200] + "x" + long[10:60], "y" + long[:100],
             None, "", "short"] + [t for _, t in hard_rows if t is None or len(t) < 1000]
    check(make_docs, texts, 40, 20)


def test_null_and_repeated_ids(spark, make_docs):
    t = "".join(random.Random(8).choice("abcdefgh") for _ in range(120))
    check(make_docs, [t, t, t[:60], "z" * 5, t[30:90] + "q"], 30, 15, ids=[None, 4, 4, None, 9])
    assert X.remove_repeats(make_docs([])).count() == 0


def test_long_text_is_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(X, "_CHUNK", 100)
    data = np.frombuffer("".join(random.Random(2).choice("ab") for _ in range(1000)).encode(), np.uint8)
    anchor, first, last, *_ = X.blocks_of(data, 40, 20)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert covered.tolist() == list(range(1000 - 40 + 1))
    assert ((anchor >= last) & (anchor <= first + 20)).all()


def test_multikey_order_sorts_by_all_keys():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 3, 500) for _ in range(4)]
    order = X.multikey_order(keys)
    rows = list(zip(*(k[order].tolist() for k in keys), strict=True))
    assert rows == sorted(rows)
    assert len(X.multikey_order([np.zeros(0, np.int64)] * 3)) == 0


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 101).astype(np.uint64)
    got = X.sliding_min(x, 7)
    assert got.tolist() == [x[i:i + 7].min() for i in range(95)]


def test_digest_of_kept_bytes(spark, make_docs):
    from pyspark.sql import functions as F
    got = X.remove_repeats(make_docs([(1, "é" * 10)])).select(F.sha2("kept", 256).alias("h")).first()["h"]
    assert got == hashlib.sha256(("é" * 10).encode()).hexdigest()


def words(n, rule, seed):
    """The n-th step of a substitution (Thue-Morse, Fibonacci ...)."""
    for _ in range(n):
        seed = "".join(rule[c] for c in seed)
    return seed


def test_self_similar_texts_of_the_same_rolling_hash(spark, make_docs):
    """Thue-Morse orders of two tails have one polynomial hash modulo 2^64 for
    every odd multiplier; nothing of them repeats."""
    head = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(272))
    order = words(5, {"0": "01", "1": "10"}, "0")
    one = head + "".join({"0": "xlgi", "1": "ayhi"}[c] for c in order)
    two = head + "".join({"1": "xlgi", "0": "ayhi"}[c] for c in order)
    assert len(one) == len(two) == 400 and one != two
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in X.remove_repeats(make_docs([(1, one), (2, two)])).collect()}
    assert got == {1: one, 2: two}
    check(make_docs, [one, two, one + two, two], 400, 200)


def test_structured_texts_against_brute_force(spark, make_docs):
    thue = words(9, {"0": "01", "1": "10"}, "0")
    long = words(12, {"0": "01", "1": "10"}, "0")
    fib = words(13, {"a": "ab", "b": "a"}, "a")
    tribonacci = words(9, {"a": "ab", "b": "ac", "c": "a"}, "a")
    flipped = thue.translate(str.maketrans("01", "10"))
    texts = [thue, flipped, fib, fib[100:300], tribonacci, "abc" * 90, "x" * 200 + "y" + "x" * 150,
             thue[:200] + fib[:200], long[1000:1300], "z".join([thue[:70]] * 3)]
    for length, gram, piece in ((40, 20, 4), (64, 32, 16), (100, 30, 8)):
        check(make_docs, texts, length, gram, piece)


def brute_passages(texts, n):
    """Words covered by strings of n words that also start anywhere else."""
    places = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", (t or "").encode())] for t in texts]
    cut = [[(t or "").encode()[p[i][0]:p[i + n - 1][1]] for i in range(len(p) - n + 1)]
           for t, p in zip(texts, places, strict=True)]
    seen = Counter(w for c in cut for w in c)
    return [len({k for i, w in enumerate(c) if seen[w] > 1 for k in range(i, i + n)}) for c in cut]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_against_brute_force(spark, make_docs, hard_rows, seed):
    rnd = random.Random(seed)
    known = ["ab", "ba", "a", "é", "longerthansixteenbytes1", "longerthXnsixteenbytes1"][:2 if seed == 1 else 6]
    passages = [[rnd.choice(known) for _ in range(rnd.randint(12, 40))] for _ in range(6)]
    texts = [None, "", "  ", "ab " * 60, "x " * 30 + "y " + "x " * 30] + [t for _, t in hard_rows]
    for _ in range(25):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice(known) for _ in range(15)]
        texts.append(rnd.choice(["", " "]) + "".join(w + rnd.choice([" "] * 9 + ["\n"]) for w in words))
    texts = [t for t in texts if t is None or len(t) < 2000]
    got = X.remove_repeats(make_docs(list(enumerate(texts)), clash=True), 400, 200, passage_words=14).collect()
    have = {r["doc_id"]: sum(p["end"] - p["start"] for p in r["passages"]) for r in got}
    assert have == dict(enumerate(brute_passages(texts, 14)))
    assert any(have.values()) and not all(have.values())


def test_short_passages_are_reported_and_stay(spark, tmp_path, make_docs):
    """51 words under 400 bytes in two documents: no byte goes by contract, both
    are reported; 49 shared words and unshared texts are not."""
    from hanga.llm.queries import op8_suffix_dedup
    rnd = random.Random(4)

    def prose(n):
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    short, less = prose(51), prose(49)
    assert len(short) < 400
    texts = [f"{prose(70)} {short} {prose(30)}", f"{short} {prose(90)}", f"{prose(30)} {less} {prose(9)}",
             f"{prose(20)} {less}", prose(200), None]
    make_docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [rows[i]["n_passage_words"] for i in range(6)] == [51, 51, 0, 0, 0, 0]
    assert all(rows[i]["n_removed"] == 0 and rows[i]["text"] == (texts[i] or "") for i in range(6))


def test_words_in_chunks(monkeypatch):
    monkeypatch.setattr(X, "_CHUNK", 100)
    text = " ".join(random.Random(2).choice(["ab", "ba"]) for _ in range(1000))
    anchor, first, last, *_ = X.Words(np.frombuffer(text.encode(), np.uint8)).blocks(50)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert covered.tolist() == list(range(1000 - 50 + 1))
    assert ((anchor >= last) & (anchor <= first + 40)).all()


@pytest.mark.parametrize("words", [1, 10])
def test_passages_shorter_than_their_anchor_are_refused(make_docs, words):
    with pytest.raises(ValueError, match="passage_words"):
        X.remove_repeats(make_docs([]), passage_words=words)
