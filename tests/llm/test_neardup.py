import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from regolith.llm import graph
from regolith.llm import neardup as N


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(docs, per_cent=85):
    """doc id -> (set size, smallest id reachable), over all pairs that share a shingle."""
    sets = {k: shingle_set(t) for k, t in docs.items()}
    where, parent = defaultdict(list), {k: k for k in sets}
    for k, s in sets.items():
        shared = Counter(o for x in s for o in where[x])
        for o, both in shared.items():
            if 100 * both >= per_cent * (len(s) + len(sets[o]) - both):
                a, b = find(parent, k), find(parent, o)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(k)
    return {k: (len(s), find(parent, k)) for k, s in sets.items()}


def check(spark, docs, links):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, links=links).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute(docs, links.per_cent).items()}


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 50, 3000):
        assert (N.sketch(rng.integers(0, 2**63, n).astype(np.uint64)) != np.uint64(2**64 - 1)).all()
    errors = []
    for both, each in ((90, 5), (800, 100), (500, 500)):
        x = rng.integers(0, 2**63, both + 2 * each).astype(np.uint64)
        a, b = N.sketch(x[: both + each]), N.sketch(np.concatenate([x[:both], x[both + each :]]))
        same = both / (both + 2 * each)
        errors.append(abs((a == b).mean() - same))
        x, y = (np.unpackbits(N.sign_bits(c).view(np.uint8)).reshape(N.PLANES, N.BINS) for c in (a, b))
        errors.append(abs((x != y).any(0).mean() - (1 - same) * (1 - 0.5**N.PLANES)))
    assert max(errors) < 0.1


@pytest.mark.parametrize("links", [N.Links(), N.STAGE, N.Links(deviations=None)])
def test_groups_equal_brute_force(spark, links):
    r = random.Random(8)
    word = lambda: r.choice("abcdefghij") + str(r.randint(0, 60))
    docs, base = {}, [word() for _ in range(120)]
    for i in range(300):
        kind = r.random()
        words = list(base)
        if kind < 0.5:
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = word()
        elif kind < 0.6:
            words = words[: r.randint(1, 7)]
        else:
            words = [word() for _ in range(r.randint(1, 150))] + (base[:60] if r.random() < 0.5 else [])
        docs[i * 3] = " ".join(words)
    docs |= {901: "", 902: None, 903: "One two", 904: "one TWO", 905: "one", 906: " \n "}
    check(spark, docs, links)


def test_op5(spark, sf, sample):
    docs = {r.doc_id: r.text for r in sample.collect()}
    want = brute(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.op5_minhash_neardup(spark, sf).collect()}
    assert got == want


def test_all_links_of_a_larger_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    check(spark, docs, N.Links())


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, a, 1), (5, b, 2), (5, a, 3), (None, c, 4), (None, c + " x", 5), (None, b, 6), (9, "z", 7), (9, "z", 8), (7, "", 9), (7, "", 10), (None, None, 11)]
    got = N.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, _a int")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted(
        [(False, 2, a), (False, 5, b), (False, 9, "z"), (False, 7, ""), (False, 7, ""), (True, 0, "")] + [(r.doc_id is None, 0, r.text) for r in got if r.doc_id is None and r.text]
    )
    assert sum(r.doc_id is None and bool(r.text) for r in got) == 1


def test_odd_rows(documents, nothing):
    got = N.near_duplicates(documents).collect()
    assert len(got) == documents.count()
    by = {r.doc_id: r for r in got}
    assert (by[5].component_id, by[5].kept, by[0].component_id, by[0].n_shingles) == (4, False, 0, 0)
    assert not by[None].kept
    left = N.distinct_documents(documents)
    assert left.columns == documents.columns
    assert left.where("doc_id = 3").count() == 1 and left.where("doc_id = 5").count() == 0
    assert N.near_duplicates(nothing).count() == 0 and N.distinct_documents(nothing).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(5, i) for i in range(40)], [(1, 1), (2, 1), (1, 2), (9, 8), (8, 7)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}
    for u, v in edges:
        a, b = find(parent, u), find(parent, v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(parent, x) for u, v in edges if u != v for x in (u, v)}


def test_parity_marks_bound_the_difference():
    rng = np.random.default_rng(3)
    for both, each in ((170, 0), (170, 13), (170, 30), (9000, 900)):
        x = rng.integers(0, 2**63, both + 2 * each).astype(np.uint64)
        a, b = (np.unpackbits(N.parity_marks(s).view(np.uint8)) for s in (x[: both + each], np.concatenate([x[:both], x[both + each :]])))
        assert (a != b).sum() <= 2 * each
        assert both > 1000 or (a != b).sum() >= 1.8 * each


def test_a_large_group_just_below_the_threshold_gives_few_pairs(spark, monkeypatch):
    r, counts, write = random.Random(4), [], N.stored
    base = [f"w{r.randint(0, 9999)}" for _ in range(200)]
    docs = {}
    for i in range(200):  # two of them have about 0.81 of their shingles in common
        words = list(base)
        for at in r.sample(range(5, 195), 2):
            words[at] = f"own{r.randint(0, 9999)}"
        docs[i] = " ".join(words)

    def seen(df, tag):
        out = write(df, tag)
        if tag == "neardup-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(N, "stored", seen)
    check(spark, docs, N.Links())
    assert len(counts) == 2 and counts[1] < 1000
