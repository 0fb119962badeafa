import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from hanga.llm import simhash as S
from hanga.llm.common import components, text_key
from llm_fixtures import hard_rows, make_docs, make_labels  # noqa: F401


def slow_fingerprint(text, k=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    votes = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(sh))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ \n\t\x0b  ß1", max_size=60))
def test_fingerprint_matches_definition(text):
    assert S.simhash64(text) == slow_fingerprint(text)


def test_fingerprint_long_and_empty():
    assert S.simhash64(None) == S.simhash64("") == S.simhash64(" \n") == 0
    text = " ".join(f"w{i}" for i in range(70000))  # more shingles than one vote block
    assert S.simhash64(text) == slow_fingerprint(text)


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(100, 160)] \
        + [(200, 201), (201, 202), (202, 200), (-5, 7000), (9, 9)]
    edges += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in
           components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union(edges, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(rnd, fp, most):
    for b in rnd.sample(range(64), rnd.randint(0, most)):
        fp ^= 1 << b
    return fp


def test_links_find_every_pair_within_the_radius(spark):
    """Chains of near fingerprints, one large cluster cut into salt groups."""
    rnd = random.Random(11)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        fps.add(near(rnd, f, 3))
        fps.add(near(rnd, f, 6))
    centre = rnd.getrandbits(64)
    fps |= {near(rnd, centre, 4) for _ in range(200)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r["a"], r["b"]) for r in S.hamming_links(df, unit=16).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in links)
    u = np.array(signed, np.int64).view(np.uint64)
    want = [(signed[i], signed[j]) for i in range(len(u))
            for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= 3) + i + 1]
    assert union(links, signed) == union(want, signed)


def test_components_of_documents_against_brute_force(spark, make_docs, hard_rows):
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = hard_rows + [(100 + i, " ".join(base * 20 + [f"t{i}"])) for i in range(12)] \
        + [(50, " ".join(base * 20 + ["t3"]))]
    got = S.simhash_components(make_docs(rows)).collect()
    assert len(got) == len(rows)
    fps = {slow_fingerprint(t) for _, t in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3]
    root = union(pairs, fps)
    ids = {}
    for i, t in rows:
        r = root[slow_fingerprint(t)]
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    want = sorted(((i, slow_fingerprint(t), ids.get(root[slow_fingerprint(t)])) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=str) == want


def test_near_dedup_keeps_one_row_of_each_component(spark, make_docs, hard_rows):
    docs = make_docs(hard_rows + [(90, "x y z"), (80, "X y Z"), (None, "x  y z")], clash=True)
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # empty-like texts and the null ones share fingerprint zero: id 1 is the smallest
    assert (1, None) in got and (2, "") not in got and (None, None) not in got
    assert (80, "X y Z") in got and (90, "x y z") not in got and (None, "x  y z") not in got
    assert got.count((7, "same row twice")) == 1 and (7, "same id, other text") in got
    assert (None, "no id but some words here") in got
    assert S.near_dedup(docs.limit(0)).count() == 0
    again = S.near_dedup(kept)
    assert again.count() == kept.count()
    assert kept.select(text_key()).count() == len(got)
