"""Work that must not grow with the square of the depth, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import interval as I
from strandloom.operators import reads as P

REGION = "contig string, start_pos long, end_pos long"


def regions(n, seed, longest, span=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        b = rng.randrange(span)
        out.append((i, rng.choice("ab"), b, b + rng.randrange(longest + 1)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, f"id long, {REGION}")


def overlaps(x, y):
    n = min(x[3], y[3]) - max(x[2], y[2])
    return x[1] == y[1] and (n > 0 or (n == 0 and (x[2] == x[3] or y[2] == y[3])))


def contains(x, y):
    return x[1] == y[1] and x[2] <= y[2] and y[3] <= x[3]


@pytest.mark.parametrize("relation, test", [("overlaps", overlaps), ("spanning", lambda x, y: overlaps(x, y) and contains(y, x)), ("contained", contains)])
@pytest.mark.parametrize("sizes", [(3, 25), (25, 3), (12, 12)])
def test_sums_over_partners(spark, relation, test, sizes):
    xs, ys = regions(150, 1, sizes[0]), regions(200, 2, sizes[1])
    got = I.sum_overlapped(frame(spark, xs), frame(spark, ys), {"n": F.lit(1), "total": F.col("id")}, relation=relation).collect()
    assert {r.id: (r.n, r.total) for r in got} == {x[0]: (sum(test(x, y) for y in ys), sum(y[0] for y in ys if test(x, y))) for x in xs}


def test_rows_without_a_region_stay(spark):
    x = frame(spark, [(1, None, 5, 9), (2, "a", None, 9), (3, "a", 5, 9)])
    y = frame(spark, [(7, "a", 4, 6), (8, None, 4, 6)])
    assert sorted((r.id, r.n) for r in I.count_overlapped(x, y).collect()) == [(1, 0), (2, 0), (3, 1)]
    assert sorted((r.id, r.n) for r in I.per_left(x, y, {"n": F.count("r")}).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_shared_items(spark):
    xs, ys = regions(120, 3, 8), regions(200, 4, 20)
    pairs = [(a, b) for a, b in zip(xs, sorted(xs, key=lambda r: r[2] * 37 % 101)) if a[1] == b[1]]
    kind = f"struct<id:long,{','.join(c.replace(' ', ':') for c in REGION.split(', '))}>"
    df = spark.createDataFrame(pairs, f"first {kind}, second {kind}")
    got = I.count_shared(df, frame(spark, ys), ["id"]).collect()
    assert sorted((r.first.id, r.second.id, r.n_shared) for r in got) == sorted((a[0], b[0], sum(overlaps(a, y) and overlaps(b, y) for y in ys)) for a, b in pairs)


@pytest.mark.parametrize("largest", [True, False])
def test_best_partner(spark, largest):
    xs, ys = regions(150, 5, 6), [(*y[:2], y[2] // 9 * 9, y[2] // 9 * 9 + (y[3] - y[2]) // 7 * 7) for y in regions(200, 6, 30)]
    size = lambda x, y: min(x[3], y[3]) - max(x[2], y[2])
    got = I.best_overlapped(frame(spark, xs), frame(spark, ys), {"best": F.col("r.id")}, largest=largest, ties=[F.col("r.id")]).collect()
    want = {x[0]: min(((-size(x, y) if largest else size(x, y), y[0]) for y in ys if overlaps(x, y)), default=(0, None))[1] for x in xs}
    assert {r.id: r.best for r in got} == want


def test_first_shared(spark):
    xs, ys = [(*x[:2], x[2] // 5 * 5, x[2] // 5 * 5 + 2) for x in regions(150, 7, 1)], regions(60, 8, 12)
    key = lambda x: (x[2], x[3], x[0])
    want = {a[0]: min(((key(b), b[0]) for b in xs if key(b) > key(a) and any(overlaps(a, y) and overlaps(b, y) for y in ys)), default=(0, None))[1] for a in xs}
    got = I.find_first_shared(frame(spark, xs), frame(spark, ys), "id").collect()
    assert {r.id: r.first_shared for r in got} == want


def test_deep_places(spark):
    """Thirty thousand sites and reads at one place: their pairs would be 900 million rows."""
    n = 30000
    sites = spark.range(n).selectExpr("id", "'a' contig", "100L start_pos", "103L end_pos")
    reads = spark.range(n).selectExpr("id", "'a' contig", "90L + id % 5 start_pos", "130L end_pos")
    shared = sites.select(F.struct("*").alias("first"), F.struct("*").alias("second"))
    assert I.count_overlapped(sites, reads).agg(F.min("n"), F.max("n")).first()[:] == (n, n)
    assert I.count_shared(shared, reads).agg(F.min("n_shared")).first()[0] == n
    assert I.best_overlapped(sites, reads, {"best": F.col("r.id")}, ties=[F.col("r.id")]).agg(F.max("best")).first()[0] == 0
    assert I.find_first_shared(sites, reads, "id").agg(F.sum(F.col("first_shared") - F.col("id"))).first()[0] == n - 1


@pytest.mark.parametrize("tile", [8, 4096])
def test_downsampling_over_tiles(spark, tile):
    rows = [(f"r{i}", "s", c, b, max(e, b + 1)) for i, c, b, e in regions(300, 9, 25)]
    df = spark.createDataFrame(rows, f"name string, sample string, {REGION}")
    got = {r.name for r in P.downsample(df, trigger=6, target=3, order=F.md5("name"), tile=tile).collect()}
    import hashlib

    order = sorted(rows, key=lambda r: hashlib.md5(r[0].encode()).hexdigest())
    depth = {}
    for r in rows:
        for p in range(r[3], r[4]):
            depth[r[2], p] = depth.get((r[2], p), 0) + 1
    hot, kept, seen = set(), set(), {}
    for c in "ab":  # runs of positions deeper than the target that reach the trigger
        run = []
        for p in range(200):
            if depth.get((c, p), 0) > 3:
                run.append(p)
            else:
                hot |= {(c, q) for q in run} if any(depth[c, q] > 6 for q in run) else set()
                run = []
    deep = [r for r in order if any((r[2], p) in hot for p in range(r[3], r[4]))]
    for r in deep:
        cells = [(r[2], p) for p in range(r[3], r[4])]
        if any(seen.get(c, 0) < 3 for c in cells):
            kept.add(r[0])
        for c in cells:
            seen[c] = seen.get(c, 0) + 1
    assert got == kept | ({r[0] for r in rows} - {r[0] for r in deep})


def test_reads_are_gathered_once_for_all_genotypes(spark):
    """Likelihoods of reads do not become rows by genotype before they are shuffled."""
    import math

    from strandloom.plans import genotypes as G

    rows = [(0, "s", f"r{i}", h, -float((i * (h + 2)) % 7)) for i in range(40) for h in range(3) if (i + h) % 11]
    lk = spark.createDataFrame(rows, "block_id long, sample string, read_id string, haplotype_id int, ln_p double")
    df = G.genotype_likelihoods(G.genotypes(lk, 2), lk)
    reads = {}
    for _, _, r, h, v in rows:
        reads.setdefault(r, {})[h] = v
    for row in df.collect():
        found = [[p[h] for h in row.haplotype_ids if h in p] for p in reads.values()]
        want = sum(math.log(sum(map(math.exp, vs)) / 2) for vs in found if vs)
        assert row.ln_likelihood == pytest.approx(want, abs=1e-9)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    by_read = [line for line in plan.splitlines() if "Aggregate [" in line and "read_id" in line]
    assert by_read and not any("haplotype_ids" in line for line in by_read)


def test_odds_beyond_a_double(spark):
    from strandloom.plans import genotypes as G

    schema = "block_id long, sample string, ln_evidence double"
    a, b = spark.createDataFrame([(0, "s", -10.0), (1, "s", -10.0), (2, "s", -720.0)], schema), spark.createDataFrame([(0, "s", -12.0), (1, "s", -900.0), (2, "s", -10.0)], schema)
    got = {r.block_id: r.mp for r in G.model_posterior(a, b).collect()}
    assert got[0] == pytest.approx(9.2371, abs=1e-4) and got[1] == float("inf") and got[2] == 0.0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ties_do_not_depend_on_the_order_of_rows(spark, parts):
    from strandloom.sources.text_formats import merge_records

    rows = [("a", 5, f"{i:03}", "A", ["G"], float(i)) for i in range(50)]
    df = spark.createDataFrame(rows[parts:] + rows[:parts], "contig string, start_pos long, id string, ref string, alt array<string>, qual double").repartition(parts)
    assert [r.id for r in merge_records([df, df], {"a": 0}).collect()] == ["000"]
    flags = "unmapped reverse".split()
    reads = spark.createDataFrame([("r", "s", "a", 10, 20 + i, "ACGT", [30, 30], [(20 + i - 10, "M")], 9, False, True) for i in (3, 0, 0, 2)],
                                  f"name string, sample string, {REGION}, seq string, quals array<smallint>, cigar array<struct<size:int,flag:string>>, mq smallint, {', '.join(f + ' boolean' for f in flags)}")
    reads = reads.withColumn("mate", F.lit(None).cast("struct<contig:string,begin:bigint,tlen:bigint,unmapped:boolean,reverse:boolean>")).withColumn("reverse", F.lit(False))
    assert [r.end_pos for r in P.remove_duplicates(reads.repartition(parts), policy="aggressive").collect()] == [20]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_reference_is_not_broadcast_by_its_statistics(spark):
    from strandloom.sources.text_formats import fetch_sequences

    ref = spark.createDataFrame([("a", 0, 0, "ACGT"), ("a", 1, 4, "TTTT")], "contig string, chunk int, chunk_start long, seq string")
    df = fetch_sequences(spark.createDataFrame([("a", 2, 6)], REGION), ref, chunk=4)
    assert [r.ref_seq for r in df.collect()] == ["GTTT"]
    assert "SortMergeJoin [contig" in plan_of(df)


def test_functions_of_every_row(spark):
    """Distribution functions without long folds: none in the plan, and the values of the standard library."""
    import math

    from strandloom.functions import numeric as N
    from strandloom.plans import candidates as K

    xs = [-9.5, -6.0, -3.9, -1.0, -0.3, 0.0, 0.2, 0.7, 2.5, 5.0, 8.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", N.normal_cdf(F.col("x")).alias("p"))
    assert "aggregate(" not in plan_of(df)
    for r in df.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-max(min(r.x, 9), -9) / math.sqrt(2)), rel=1e-13, abs=1e-300)
    obs = spark.createDataFrame([(3, 10), (0, 40), (None, 5)], "n_obs int, depth int").select(K.include_somatic(F.col("depth"), min_frequency=0.05).alias("kept"))
    assert "aggregate(" not in plan_of(obs)
    assert [r.kept for r in obs.collect()] == [True, False, None]


def test_costly_filters_come_last():
    names = sorted(P.DEFAULT, key=lambda n: P.COSTLY.index(n) + 1 if n in P.COSTLY else 0)
    assert names[0] not in P.COSTLY and names[-1] == "has_well_formed_cigar" and set(names) == set(P.DEFAULT)


def test_templates_are_paired_once(spark, sf_dir):
    from strandloom.plans.catalog import queries

    assert plan_of(queries()["template_masks"](spark, sf_dir)).count("Window [") == 1


def test_concordance_of_duplicates(spark):
    """A group of duplicates that shows one allele has 1, an even split 0, three to one what the entropy says; the least of a sample counts."""
    import math

    from strandloom.plans import measures as M

    calls = spark.createDataFrame([(1, "a", 10, 11, "A", ["G"], 50.0)], f"call_id long, {REGION}, ref string, alts array<string>, qual double")
    gts = spark.createDataFrame([(1, s, g) for s, g in (("one", [0, 1]), ("even", [0, 1]), ("most", [0, 1]), ("none", [0, 1]), ("ref", [0, 0]))], "call_id long, sample string, gt array<int>")
    rows = [("one", 1, 7, "x"), ("one", 1, 7, "y"), ("even", 0, 7, "x"), ("even", 1, 7, "y"), ("even", 1, 8, "z"), ("most", 1, 9, "x"), ("most", 1, 9, "y"), ("most", 1, 9, "z"), ("most", 0, 9, "w"),
            ("none", 1, None, "x"), ("ref", 0, 7, "x"), ("ref", 0, 7, "y")]
    support = spark.createDataFrame([(1, 10, 11, s, a, "AG"[a], 5, 15, "A" * 10, [30] * 10, [(10, "M")], 60, False, False, g, n) for s, a, g, n in rows],
                                    "call_id long, call_start long, call_end long, sample string, allele int, allele_seq string, read_start long, read_end long, seq string, quals array<smallint>, "
                                    "cigar array<struct<size:int,flag:string>>, mq int, reverse boolean, supplementary boolean, dup_group long, name string")
    got = {r.sample: r.DPC for r in M.evaluate(M.Facets(calls, gts, support=support), ["DPC"]).collect()}
    entropy = -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25))
    assert got == {"one": 1.0, "even": 0.0, "most": pytest.approx(1 - entropy), "none": None, "ref": None}


def test_pooled_measures_pair_no_reads(spark, sf_dir):
    from strandloom.plans.catalog import queries

    plan = queries()["call_measures_pooled"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" not in plan
