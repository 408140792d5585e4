"""Call records in and out, mutation and mixture models, haplotype trees, candidates of repeats, stored reads."""

import gzip
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import numeric as N
from strandloom.operators import reads as P
from strandloom.plans import callers as X
from strandloom.plans import csr
from strandloom.plans import genotypes as G
from strandloom.plans import haplotypes as H
from strandloom.plans import mixtures as Mx
from strandloom.plans import mutation as T
from strandloom.plans import phasing as Ph
from strandloom.sources import store
from strandloom.sources import text_formats as S
from test_callers import genome  # noqa: F401  (a fixture)
from test_reads import BASE

VCF = """##fileformat=VCFv4.3
##INFO=<ID=PP,Number=1,Type=Float,Description="x">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	a	b
c	11	.	A	G	50	q10	PP=7;SOMATIC	GT:GQ	0|1:40	0/0:3
c	21	v	AC	A,ACC	5	.	.	GT:GQ:PS	1|2:9:21	./.:.:.
d	5	.	T	C	90	PASS	PP=1.5	GT	1|1	0|1
"""


@pytest.fixture()
def vcf(tmp_path):
    path = tmp_path / "in.vcf"
    path.write_text(VCF)
    return str(path)


def written(path):
    texts = [gzip.decompress(p.read_bytes()).decode() for p in sorted(Path(path).glob("part-*"))]
    return [line for t in texts for line in t.splitlines()]


def test_records_are_filtered_anew(spark, vcf, tmp_path):
    out = str(tmp_path / "out")
    csr.filter_vcf(spark, vcf, out, {"c": 100, "d": 50}, soft="QUAL < 10 | GQ < 20", hard="PP < 2", annotations=["VL", "AC"])
    lines = written(out)
    assert any(x.startswith("##FILTER=<ID=q10") for x in lines) and any(x.startswith("##FORMAT=<ID=VL") for x in lines)
    rows = [x.split("\t") for x in lines if not x.startswith("#")]
    assert [(r[1], r[6], r[8]) for r in rows] == [("11", "PASS", "GT:AC:GQ:VL"), ("21", "GQ;q10", "GT:AC:GQ:PS:VL")]  # PP of the third is below 2
    assert rows[0][9:] == ["0|1:.,1:40:1", "0/0:.,0:3:1"] and rows[1][9:] == ["1|2:.,1,1:9:21:3", "./.:.:.:.:."]
    again = S.read_vcf(spark, out).orderBy("start_pos").collect()
    assert [list(r["filter"]) for r in again] == [[], ["GQ", "q10"]] and again[0].samples["a"].fmt["AC"] == [".", "1"]


def test_region_of_records(spark, vcf):
    assert [r.start_pos for r in S.read_vcf(spark, vcf, contig="c", begin=21, end=30).collect()] == [20]
    assert S.read_vcf(spark, vcf, contig="c", begin=11, end=20).count() == 0
    assert S.read_vcf(spark, vcf, contig="d").count() == 1


def test_double_pass(spark, vcf):
    records = S.read_vcf(spark, vcf)
    score = lambda f: f.withColumn("RFGQ", F.col("GQ")).withColumn("filter", F.when(F.col("GQ") < 20, F.array(F.lit("RF"))).otherwise(F.array().cast("array<string>")))
    got = {r.start_pos: (list(r["filter"]), r.info.get("RFGQ")) for r in csr.double_pass(records, ["QUAL", "GQ"], score).collect()}
    assert got[10][0] == [] and got[20] == (["RF"], ["9.0"]) and got[4][0] == ["RF"]


def test_forest_scores_calls(spark):
    from strandloom.plans.filters import ForestFilter, cluster_filter

    rng = random.Random(1)
    rows = [(i, "s", q + rng.random(), dp + rng.random(), float(y)) for i in range(120) for y in (i % 2,) for q, dp in [(50, 20) if y else (5, 3)]]
    df = spark.createDataFrame(rows, "call_id int, sample string, QUAL double, DP double, label double")
    got = ForestFilter(["QUAL", "DP"], trees=5).fit(df).transform(df).collect()
    assert all((r["filter"] == []) == (r.label == 1) for r in got)
    clusters = {(r.label, r.cluster) for r in cluster_filter(df.withColumn("NA", F.lit(-1.0)), ["QUAL", "DP", "NA"]).collect()}
    assert len(clusters) == 2


def test_mutation_between_haplotypes(spark):
    v = [[(10, 11, "A", "G"), (20, 22, "CA", ""), (30, 30, "", "TT")]]
    blocks = spark.createDataFrame([(1, "c", v[0])], "block_id int, contig string, variants array<struct<start_pos:bigint,end_pos:bigint,ref:string,alt:string>>")
    repeats = spark.createDataFrame([("c", 18, 28, 2)], "contig string, start_pos bigint, end_pos bigint, period int")
    costs = {r.allele_id: r.ln_p for r in T.allele_costs(blocks, repeats, snv_rate=1e-8, indel_rate=1e-9, extension=0.5).collect()}
    assert costs[0] == pytest.approx(math.log(1e-8)) and costs[2] == pytest.approx(math.log(1e-9) + math.log(0.5))
    assert costs[1] == pytest.approx(math.log(1e-9 * T.REPEAT_FACTORS[2][4]) + math.log(0.5))  # five periods of two bases
    haps = spark.createDataFrame([(1, 0, []), (1, 1, [0]), (1, 2, [0, 1])], "block_id int, haplotype_id int, allele_ids array<int>")
    t = T.transitions(haps, T.allele_costs(blocks, repeats, snv_rate=1e-8, indel_rate=1e-9))
    got = {(r.target, r.given): r.ln_p for r in t.collect()}
    assert got[0, 0] == 0 and got[1, 0] == got[0, 1] == pytest.approx(costs[0]) and got[2, 0] == pytest.approx(costs[0] + costs[1])
    lik = [("m", 0, 0), ("f", 0, 0), ("c", 0, 1)]
    rows = [(1, s, [a, b], 0.0 if (a, b) == (x, y) else -40.0) for s, x, y in lik for a in range(3) for b in range(a, 3)]
    df = spark.createDataFrame(rows, "block_id int, sample string, haplotype_ids array<int>, ln_likelihood double")
    joint = G.trio_posteriors(df, "m", "f", "c", transition=T.transition_map(t)).orderBy(F.desc("posterior")).first()
    assert list(joint.c) == [0, 1] and joint.is_denovo and list(joint.m) == [0, 0]  # 1e-8 beats a parent's misread genotype at e^-40


def test_mixture_bound_prefers_the_truth():
    rng = np.random.default_rng(1)
    ln = np.where(rng.random((200, 1)) < 0.8, [[-0.1, -8.0, -9.0]], [[-8.0, -0.1, -9.0]])
    one, _ = Mx.mixture_bound(ln[:, [0]], np.array([1.0]))
    two, post = Mx.mixture_bound(ln[:, [0, 1]], np.array([1.0, 1.0]), seeds=3)
    three, _ = Mx.mixture_bound(ln, np.ones(3), seeds=3)
    assert two > three > one and post[0] / post.sum() == pytest.approx(0.8, abs=0.1)
    bound, w = Mx.clustered_bound(ln, [np.array([0, 1]), np.array([2])], 1.0)
    assert w[0] > 0.99 and bound < two
    assert Mx.mixture_bound(ln[:0], np.ones(2))[0] == 0


def test_cancer_calls(genome):  # noqa: F811
    reads, reference, at = genome
    got = {r.start_pos: r for r in X.call_cancer(reads.where("sample <> 'dad'"), reference, normal="mum").collect() if r.alt}
    assert got[at["snv"]].call_type == "somatic" and got[at["snv"]].vaf == pytest.approx(0.5, abs=0.2)
    assert got[at["inherited"]].call_type == "germline" and all(0 <= r.p_cnv <= 1 for r in got.values())


def test_cell_calls(genome):  # noqa: F811
    reads, reference, at = genome
    twins = reads.where("sample = 'kid'")
    cells = twins.withColumn("sample", F.lit("c1")).unionByName(twins.withColumn("sample", F.lit("c2")))
    for name in ("c3", "c4"):  # one cell alone could as well have lost a haplotype
        cells = cells.unionByName(reads.where("sample = 'dad'").withColumn("sample", F.lit(name)))
    got = {(r["sample"], r.start_pos): r for r in X.call_cells(cells, reference).collect() if r.alt}
    assert {k for k in got if k[1] == at["snv"]} == {("c1", at["snv"]), ("c2", at["snv"])}
    assert got["c1", at["snv"]].cell_group == got["c2", at["snv"]].cell_group and sorted(got["c1", at["snv"]].gt) == [0, 1]


def test_haplotype_trees_keep_what_reads_show():
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    variants = [(p, p + 1, ref[p], other[ref[p]]) for p in range(20, 280, 8)]
    truth = {4, 5, 6, 7}
    alt = "".join(other[b] if i in {variants[v][0] for v in truth} else b for i, b in enumerate(ref))
    kmers = {s[i:i + 11]: 9 for s in (ref, alt) for i in range(len(s) - 10)}
    got = H.grow_haplotypes(ref, 0, variants, 16, kmers)
    assert got[0] == (ref, []) and got[1] == (alt, sorted(truth)) and len(got) == 16
    every = H.grow_haplotypes(ref[:70], 0, variants[:3], 100)
    assert len(every) == 8 and every[0][1] == [] and len({s for s, _ in every}) == 8
    deleted = H.grow_haplotypes("ACGTACGT", 0, [(2, 5, "GTA", ""), (4, 5, "A", "C")], 10)
    assert [u for _, u in deleted] == [[], [0], [1]]  # variants that overlap do not meet


def test_shortest_paths_come_in_order():
    edges = {"a": [(1.0, "b"), (0.5, "c")], "b": [(1.0, "z")], "c": [(1.0, "d"), (0.2, "b")], "d": [(0.1, "z")], "z": []}
    got = H.shortest_paths(lambda n: edges[n], edges["a"], {"z": 9}, 0, most=10, longest=10)
    assert [(round(c, 1), "".join(p)) for c, p in got] == [(1.6, "cdz"), (1.7, "cbz"), (2.0, "bz")]
    assert len(H.shortest_paths(lambda n: edges[n], edges["a"], {"z": 9}, 0, most=2, longest=10)) == 2


def test_replacements_in_repeats(spark):
    ref = "GG" + "CA" * 6 + "TT"
    reference = spark.createDataFrame([("c", 0, 0, ref)], "contig string, chunk int, chunk_start bigint, seq string")
    repeats = spark.createDataFrame([("c", 2, 14, 2)], "contig string, start_pos bigint, end_pos bigint, period int")
    rows = [(r, "c", p, p + 1, ref[p], "T") for r in (1, 2, 3) for p in ((4, 8) if r < 3 else (4,))] + [(4, "c", 15, 16, "T", "A")]
    snvs = spark.createDataFrame(rows, "read_id int, contig string, start_pos bigint, end_pos bigint, ref string, alt string")
    assert [tuple(r) for r in H.repeat_mnvs(snvs, repeats, reference).collect()] == [("c", 4, 9, "CACAC", "TACAT", 2)]


def test_phase_cliques(spark):
    q = {(0, 1): 9, (0, 2): 9, (1, 2): 7, (0, 3): 9, (1, 3): 2, (2, 3): 9, (0, 4): 1, (1, 4): 1, (2, 4): 9, (3, 4): 6}
    pairs = spark.createDataFrame([(0, "s", a, b, float(v)) for (a, b), v in q.items()], "block_id int, sample string, site_a bigint, site_b bigint, quality double")
    got = [(list(r.sites), r.quality) for r in Ph.phase_cliques(pairs).collect()]
    assert got == [([0, 1, 2], 7.0), ([3, 4], 6.0)]


def test_beta_intervals():
    lo, hi = N.beta_hdi(np.array([2.0, 30.0, 1.0]), np.array([8.0, 12.0, 5.0]), 0.9)
    assert N.incomplete_beta([2.0, 30.0, 1.0], [8.0, 12.0, 5.0], hi) - N.incomplete_beta([2.0, 30.0, 1.0], [8.0, 12.0, 5.0], lo) == pytest.approx([0.9] * 3)
    dens = lambda a, b, x: x ** (a - 1) * (1 - x) ** (b - 1)
    assert dens(2, 8, lo[0]) == pytest.approx(dens(2, 8, hi[0]), rel=1e-3) and lo[2] == pytest.approx(0, abs=1e-6)


def test_stored_reads_prune(spark, tmp_path):
    rows = [{**BASE, "name": f"r{i}", "sample": f"s{i % 3}", "contig": f"c{i % 2}", "start_pos": i * 10, "end_pos": i * 10 + 80} for i in range(200)]
    reads = spark.createDataFrame([tuple(r.values()) for r in rows], P.READ_SCHEMA)
    path = str(tmp_path / "reads")
    store.write_reads(reads, path, tile=1000)
    got = store.scan_reads(spark, path, contig="c1", begin=500, end=600, samples=["s1", "s2"], longest=100)
    assert {r.name for r in got.collect()} == {r["name"] for r in rows if r["contig"] == "c1" and r["sample"] != "s0" and r["start_pos"] < 600 and r["end_pos"] > 500}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = store.scan_reads(spark, path, contig="c1", begin=500, end=600, samples=["s1", "s2"], longest=100)._jdf.queryExecution().executedPlan().toString()
    folders = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "_contig" in folders and "_sample" in folders and "GreaterThan(start_pos,400)" in plan and "LessThan(start_pos,600)" in plan
    assert got.columns == reads.columns and store.scan_reads(spark, path).count() == 200
    seen = []
    assert store.first_reads(reads, lambda r: seen.append(r.name) or len(seen) < 5) == 5
    assert store.positions(reads, 7).count() == 7 and store.positions(reads).columns == ["contig", "start_pos", "end_pos"]
    gts = spark.createDataFrame([("s1",), ("x",)], "sample string")
    assert [r[0] for r in store.samples_in_both(reads, gts).collect()] == ["s1"]


def test_random_variants(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 300)], "contig string, size bigint")
    got = store.random_variants(spark, sizes, 400, seed=3)
    rows = got.collect()
    assert len(rows) == 400 and all(0 <= r.start_pos < {"a": 100, "b": 300}[r.contig] and r.alt in "ACGT" for r in rows)
    assert 60 < sum(r.contig == "a" for r in rows) < 140 and sorted(map(tuple, rows)) == sorted(map(tuple, store.random_variants(spark, sizes, 400, seed=3).collect()))


def test_alignment_files(spark, tmp_path):
    rows = [{**BASE, "name": f"r{i}", "contig": "c", "start_pos": 50 - i, "end_pos": 60 - i} for i in range(5)]
    reads = spark.createDataFrame([tuple(r.values()) for r in rows], P.READ_SCHEMA)
    S.write_sam(reads, str(tmp_path / "out"), {"c": 100}, header=["@RG\tID:g\tSM:x"])
    lines = written(tmp_path / "out")
    heads = [x for x in lines if x.startswith("@")]
    assert heads[:3] == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:c\tLN:100", "@RG\tID:g\tSM:x"]
    starts = [int(x.split("\t")[3]) for x in lines if not x.startswith("@")]
    assert starts == sorted(starts) and len(starts) == 5
