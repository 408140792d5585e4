"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from strandloom.llm import common, components, exact_dedup, line_dedup, simhash

from odd import ODD


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split()) + str(rng.randrange(30)) for _ in range(n)]


def corpus(seed, n=80):
    """Texts with exact copies, near copies of many degrees and shared lines."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            out.append(rng.choice(out))
        elif out and kind < 0.5:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 1))
            out.append(" ".join(w))
        else:
            out.append(" ".join(words(rng, rng.randrange(3, 120))))
    return list(enumerate(out))


def groups(pairs, n):
    up = list(range(n))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- exact ---

@pytest.mark.parametrize("bits, probes", [(16, 2), (0, 1)])
def test_exact_equals_brute_force(docs, bits, probes):
    rows = corpus(1) + [(1000 + i, t) for i, t in ODD if i]
    got = exact_dedup.exact_duplicates(docs(rows), bits_per_row=bits, probes=probes).collect()
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    want = sorted((i, max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, got)) == want


def test_exact_null_ids_and_empty_table(docs):
    got = exact_dedup.exact_duplicates(docs([(None, "a"), (4, "a"), (None, "b")])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.kept) for r in got), key=repr) == sorted([(None, 4, False), (4, 4, True), (None, None, True)], key=repr)
    assert exact_dedup.exact_duplicates(docs([])).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs([(1, "a"), (2, "a")])).select("doc_id", "keep_id").collect() == [(2, "clash")]


# --- SimHash ---

def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_fingerprints_and_components(docs):
    rows = corpus(2) + [(1000 + i, t) for i, t in ODD if i]
    fps = [fingerprint(t) for _, t in rows]
    roots = groups([(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2], len(rows))
    least = defaultdict(lambda: 10**9)
    for (i, _), r in zip(rows, roots):
        least[r] = min(least[r], i)
    want = sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots))
    assert sorted(map(tuple, simhash.fingerprint_groups(docs(rows)).collect())) == want


def test_simhash_odd_input(docs):
    got = {r.doc_id: r for r in simhash.fingerprint_groups(docs(ODD)).collect()}
    assert got[1].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == got[3].component_id == 1
    assert got[6].component_id == 5 and got[None].component_id is None
    assert simhash.fingerprint_groups(docs([])).count() == 0


@pytest.mark.parametrize("radius, n", [(2, 300), (6, 200)])
def test_bk_forest_finds_all_neighbours(radius, n):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, np.uint64)
    fp = np.array([int(centres[i % 12]) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for i in range(n)], np.uint64)
    shard = np.arange(n) % 3
    got = set()
    for q, m in simhash.BKForest(shard, fp).search(np.arange(n), radius):
        got |= set(zip(q.tolist(), m.tolist()))
    want = {(a, b) for a in range(n) for b in range(n) if a != b and shard[a] == shard[b] and (int(fp[a]) ^ int(fp[b])).bit_count() <= radius}
    assert got == want


def test_crowded_shards_are_cut(docs, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 5)
    rows = corpus(4, 60)
    assert sorted(map(tuple, simhash.fingerprint_groups(docs(rows)).collect())) == sorted(
        map(tuple, simhash.fingerprint_groups(docs(rows)).collect()))
    same = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows)).collect()}
    monkeypatch.undo()
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows)).collect()} == same


def test_near_duplicates_equal_brute_force(docs):
    rows = corpus(5, 120)
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)})
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = dict(enumerate(groups(near, len(rows))))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows)).collect()} == want
    kept = simhash.drop_near_duplicates(docs(rows))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == docs(rows).columns


def test_near_duplicates_that_repeat_a_line(docs):
    rng = random.Random(8)
    rows = []
    for i in range(20):
        body, line = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (400, 12))
        rows += [(2 * i, f"{body}\n{line}"), (2 * i + 1, "\n".join([body, *[line] * 40]))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_duplicates_with_repeated_ids(docs):
    rng = random.Random(3)
    a, b, c = (" ".join(words(rng, 80)) for _ in range(3))
    near = lambda t: t + " more"
    rows = [(1, a), (5, b), (5, near(a)), (6, near(b)), (7, c), (7, c), (8, near(c))]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (6, 5), (7, 7), (7, 7), (8, 7)]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs(rows)).collect()) == [1, 5, 5, 7, 7]


def test_recall_of_near_duplicates(docs):
    """Pairs around a similarity of 0.8 and above, of many sizes, with a phrase repeated up to 29 times."""
    rng = random.Random(21)
    rows, near = [], []
    for i in range(250):
        n, times = rng.choice([12, 20, 40, 100, 400]), rng.randrange(1, 30)
        base = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        phrase = [f"p{rng.randrange(10**7)}" for _ in range(6)]
        other = list(base)
        for _ in range(rng.randrange(0, 1 + n // 60)):
            other[rng.randrange(n)] = f"x{rng.randrange(10**7)}"
        other += [f"e{rng.randrange(10**7)}" for _ in range(rng.randrange(0, 1 + n // 8))]
        pair = [" ".join(base + phrase * times), " ".join(other + phrase * rng.randrange(1, 30))]
        sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (p.split() for p in pair)]
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            near.append(i)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows)).collect()}
    found = [i for i in range(250) if got[2 * i + 1] == 2 * i]
    assert set(found) <= set(near) and len(near) > 60 and len(found) >= 0.97 * len(near)


def test_near_duplicates_odd_input(docs):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(ODD)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 1), (3, 1), (None, None), (5, 5), (6, 5), (6, 5), (7, 7), (8, 8)], key=repr)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- lines ---

def longest_runs(rows, least):
    """By the contract alone: lines of each suffix's longest prefix that has any earlier copy, by comparison with all earlier suffixes."""
    seqs = [(i, t.split("\n")) for i, t in sorted(rows)]
    starts = [(q, a) for _, q in seqs for a in range(len(q))]
    out, at = {}, 0
    for i, q in seqs:
        gone = set()
        for a in range(len(q)):
            n = 0
            for p, b in starts[:at]:
                m = 0
                while a + m < len(q) and b + m < len(p) and q[a + m] == p[b + m]:
                    m += 1
                n = max(n, m)
            at += 1
            if sum(len(x.split()) for x in q[a:a + n]) >= least:
                gone |= set(range(a, a + n))
        out[i] = sorted(gone)
    return out


@pytest.mark.parametrize("least", [1, 12, 50])
def test_lines_equal_brute_force(docs, least):
    rng = random.Random(6)
    pool = [" ".join(words(rng, rng.randrange(0, 14))) for _ in range(25)]
    rows = []
    for i in range(40):
        body = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            body[1:1] = other[a:a + rng.randrange(1, 9)]
        rows.append((i, "\n".join(body)))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(rows), min_words=least).collect()}
    want = longest_runs(rows, least)
    assert {i: list(r.removed) for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])


def test_lines_match_the_longest_earlier_copy(docs):
    a, b, c, x = (" ".join(f"{k}{i}" for i in range(20)) for k in "abcx")
    got = line_dedup.dedup_lines(docs([(1, f"{a}\n{b}\n{x}"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}")])).collect()
    assert {r.doc_id: list(r.removed) for r in got} == {1: [], 2: [], 3: [0, 1, 2]}


def test_lines_of_two_later_copies_behind_a_shorter_one(docs):
    a, b, c, w, x, y, z, q, r = (" ".join(f"{k}{i}" for i in range(20)) for k in "abcwxyzqr")
    rows = [(1, "\n".join([a, x, y, w])), (2, "\n".join([b, x, y, z, q])), (3, "\n".join([c, x, y, z, r]))]
    got = line_dedup.dedup_lines(docs(rows)).collect()
    assert {r.doc_id: list(r.removed) for r in got} == longest_runs(rows, 50) == {1: [], 2: [], 3: [1, 2, 3]}


def test_lines_with_a_shuffled_lookup(spark, docs, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(12)
    pool = [" ".join(words(rng, 9)) for _ in range(30)]
    rows = [(i, "\n".join(pool[(i * 7 + k) % 30] for k in range(4 + i % 9))) for i in range(60)]
    monkeypatch.setattr(line_dedup, "with_lookup", lambda df, table, key, rows, row_bytes: common.with_lookup(df, table, key, rows, row_bytes, limit=-1))
    df = line_dedup.dedup_lines(docs(rows))
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: list(r.removed) for r in df.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == longest_runs(rows, 50)


@pytest.mark.parametrize("seed", [1, 3, 4, 5, 6, 7])
def test_lines_equal_longest_runs(docs, seed):
    rng = random.Random(seed)
    pool = [" ".join(words(rng, rng.randrange(1, 9))) for _ in range(6)]
    long = [rng.choice(pool) for _ in range(40)]
    rows = []
    for i in range(50):
        start = rng.randrange(len(long))
        body = long[start:start + rng.randrange(1, 24)] + [rng.choice(pool) for _ in range(rng.randrange(3))]
        rows.append((i, "\n".join(body)))
    want = longest_runs(rows, 40)
    got = {r.doc_id: list(r.removed) for r in line_dedup.dedup_lines(docs(rows + rows[:3]), min_words=40).collect()}
    assert got == want


def test_lines_odd_input(docs):
    long_line = " ".join(f"w{i}" for i in range(60))
    rows = [*ODD, (20, f"{long_line}\nown line"), (21, f"first\n{long_line}"), (None, long_line)]
    df = line_dedup.dedup_lines(docs(rows))
    got = {r.doc_id: r for r in df.collect()}
    assert got[None] is not None and len(df.collect()) == len(rows)
    assert got[1].text == "" and got[20].n_removed == 1 and got[21].text == "first"  # the null id comes first
    assert line_dedup.dedup_lines(docs([])).count() == 0
