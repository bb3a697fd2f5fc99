import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomscan.llm.components import components
from loomscan.llm.neardup import K, keep_one, least_matches, minima, near_duplicates, shingles, sketch
from loomscan.llm.quality import op1_quality_divergence  # noqa: F401

from helpers import SMALL


def shingle_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = low.encode().split()
    return {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))} if ws else set()


def brute(rows, width, percent):
    """(set size, component) of each row by comparing all pairs."""
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return {(i, len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))}


def varied(rng, n_groups):
    """Groups around a base text whose members differ by different amounts, so some pairs are just on either side."""
    rows = []
    for _ in range(n_groups):
        base = rng.choices(["w%d" % k for k in range(3000)], k=rng.randrange(1, 120))
        for _ in range(rng.choice([1, 2, 3, 8])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = "new%d" % rng.randrange(10**6)
            rows.append((len(rows) * 3 % 1009, " ".join(text)))
    return rows


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(make_docs, width, percent):
    rows = varied(random.Random(width), 60)
    got = near_duplicates(make_docs(rows), width=width, percent=percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_buckets_lose_no_links(make_docs):
    """Many texts share a long part, so they share bands, but only some are similar."""
    rng = random.Random(8)
    shared = ["s%d" % k for k in range(60)]
    rows = []
    for g in range(30):
        own = ["g%d_%d" % (g, k) for k in range(12)]
        for k in range(3):
            rows.append((len(rows), " ".join([*shared, *own[: 12 - k], "x%d" % rng.randrange(10**6)])))
    got = near_duplicates(make_docs(rows), width=5, percent=80).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 5, 80)


def hot_group(rng, n, base, changes):
    """Near copies of one text that resemble each other less than asked for, but for twins of them that differ in one word."""
    rows = []
    for _ in range(n):
        text = list(base)
        for place in rng.sample(range(len(text)), changes):
            text[place] = "new%d" % rng.randrange(40)
        twin = list(text)
        twin[rng.randrange(len(twin))] = "twin"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(twin))]
    return rows


@pytest.mark.parametrize("width, percent, changes", [(3, 85, 7), (5, 80, 6)])
def test_links_within_a_hot_group_of_near_copies(make_docs, monkeypatch, width, percent, changes):
    """The last pass has to find them, without listing the group's pairs."""
    from loomscan.llm import neardup

    rng, met, confirmed = random.Random(width), [], neardup._confirmed
    base = ["s%d" % k for k in range(150)]
    rows = [(10**6, " ".join(base)), *hot_group(rng, 150, base, changes)]
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, *rest: met.append((pairs.count(), confirmed(pairs, *rest))) or met[-1][1])
    monkeypatch.setattr(neardup, "BLOCK", 20)
    got = near_duplicates(make_docs(rows), width=width, percent=percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, width, percent)
    assert len(met) == 3 and 0 < met[2][0] < 3 * len(rows)


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = near_duplicates(docs, width=5, percent=80).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute([tuple(r) for r in docs.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def test_rows_that_share_an_id_are_documents_of_their_own(make_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = make_docs([(1, a, "first"), (1, b, "x"), (0, a, "x"), (2, b + " more", "x"), (5, c, "x"), (5, c, "x"), (None, c, "x"), (None, "only here", "x"), (None, "only here", "x"), (7, None, "x"), (7, None, "x")])
    kept = [(r["doc_id"], r["text"]) for r in keep_one(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(0, a), (1, b), (5, c), (None, "only here"), (7, None), (7, None)]))
    got = sorted({(str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}, key=str)
    assert got == sorted([("1", 26, 0), ("1", 26, 1), ("0", 26, 0), ("2", 27, 1), ("5", 26, 5), ("None", 26, 5), ("None", 1, None), ("7", 0, 7)], key=str)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbBé \n\t", max_size=60), st.integers(1, 5))
def test_shingles(text, width):
    assert len(shingles(text, width)) == len(shingle_set(text, width))


def test_estimate_is_corrected_for_collisions():
    rng = random.Random(1)
    a = ["a%d" % rng.randrange(10**9) for _ in range(2000)]
    for share in (0.0, 0.5, 0.9):
        b = a[: int(len(a) * share)] + ["b%d" % rng.randrange(10**9) for _ in range(len(a) - int(len(a) * share))]
        sa, sb = (shingles(" ".join(x), 1) for x in (a, b))
        low = [minima(s) for s in (sa, sb)]
        true = (low[0] == low[1]).mean()
        x = [sketch(s, 4)[1].view("uint64") for s in (sa, sb)]
        same = sum(((int(p) >> 2 * k) & 3) == ((int(q) >> 2 * k) & 3) for p, q in zip(*x) for k in range(32)) / K
        assert abs((same - 0.25) / 0.75 - true) < 0.2
    assert 0 < least_matches(80) < K


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
