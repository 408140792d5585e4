"""Filter expressions, numeric functions, alleles, genotype models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import alleles as A
from strandloom.functions import cigar as C
from strandloom.functions import numeric as N
from strandloom.functions import sequences as S
from strandloom.operators import variants as V
from strandloom.plans import filters as X
from strandloom.plans import genotypes as G
from strandloom.plans import phasing as H


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_parse():
    cs = X.parse("QUAL < 10 | AF[1,2] >= 0.5 | MQ!=3")
    assert [(c.measure, c.op, c.target, c.params) for c in cs] == [("QUAL", "<", 10, ()), ("AF", ">=", 0.5, ("1", "2")), ("MQ", "!=", 3, ())]
    assert [c.key for c in cs] == ["q10", "AF", "MQ"]
    for bad in ("QUAL", "QUAL <", "< 10", "QUAL < ten", "QUAL << 3"):
        with pytest.raises(X.BadFilterExpression):
            X.parse(bad)
    for text in (X.GERMLINE, X.SOMATIC, X.DENOVO, X.REFCALL):
        assert len(X.parse(text)) == text.count("|") + 1


def test_missing_values_pass_and_arrays_need_all(spark):
    df = spark.createDataFrame([(1, 5.0, [1.0, 0.2]), (2, None, [0.9, None]), (3, 50.0, None)], "call_id int, QUAL double, AF array<double>")
    got = {r.call_id: r["filter"] for r in X.threshold_filter(df, "QUAL < 20 | AF < 0.5").collect()}
    assert got == {1: ["q20", "AF"], 2: [], 3: []}
    assert {r.call_id for r in X.threshold_filter(df, "", "AF < 0.5").collect()} == {2, 3}


def test_log_sum_exp(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, N.log_sum_exp(arr(math.log(0.5), math.log(0.5)))) == pytest.approx(0)
    assert value(spark, N.log_sum_exp(arr(0, 0))) == pytest.approx(math.log(2))
    assert value(spark, N.log_sum_exp(arr(float("-inf"), float("-inf")))) == float("-inf")


@pytest.mark.parametrize("a, b, x", [(1.5, 2.5, 0.3), (10.5, 0.5, 0.9), (30.0, 12.0, 0.5), (0.5, 0.5, 0.1)])
def test_beta_cdf(spark, a, b, x):
    n = 200_000  # midpoint rule after the substitution t = x s^2, which tames the pole at 0
    total = sum((t := x * ((i + 0.5) / n) ** 2) ** (a - 1) * (1 - t) ** (b - 1) * 2 * x * (i + 0.5) / n for i in range(n)) / n
    want = total / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    assert value(spark, N.beta_cdf(F.lit(a), F.lit(b), x)) == pytest.approx(want, rel=1e-4)


def test_fisher(spark):
    assert value(spark, N.fisher_exact(F.lit(3), F.lit(1), F.lit(1), F.lit(3))) == pytest.approx(0.4857142857, rel=1e-6)


def test_sequences(spark):
    assert value(spark, S.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert value(spark, S.canonical_motif(F.lit("GTC"))) == min("GTC", "TCG", "CGT", "GAC", "ACG", "CGA")
    assert value(spark, S.disambiguate(F.lit("ARN"))) == "AAN"


def test_trim_and_split(spark):
    assert tuple(value(spark, A.trim(F.lit(10), F.lit("ACGT"), F.lit("AGGT")))) == (11, 12, "C", "G")
    assert [tuple(v)[:1] + tuple(v)[2:] for v in value(spark, A.split_mnv(F.lit(5), F.lit("ACG"), F.lit("TCC")))] == [(5, "A", "T"), (7, "G", "C")]


def aligned_left(spark, start, ref, alt, before):
    cols = [F.lit(start), F.lit(ref), F.lit(alt), F.lit(before)]
    n = A.left_shift(cols[1], cols[2], cols[3])
    return tuple(value(spark, A.shifted_left(*cols, n)))


def test_left_align(spark):
    assert aligned_left(spark, 12, "CAG", "", "TTTCAGCAGCAG") == (3, 6, "CAG", "")
    assert aligned_left(spark, 12, "", "CAG", "TTTCAGCAGCAG") == (3, 3, "", "CAG")
    assert aligned_left(spark, 8, "CAA", "", "GGCAACAA") == (2, 5, "CAA", "")
    assert aligned_left(spark, 5, "A", "T", "ACGTA") == (5, 6, "A", "T")
    assert aligned_left(spark, 5, "AA", "AAA", "CCAAA") == (0, 2, "CC", "CCA")  # sizes stay, so common bases come along


def test_left_align_passes_windows(spark):
    ref = spark.createDataFrame([("1", 0, 0, "GC" + "CAG" * 200 + "TT")], "contig string, chunk int, chunk_start bigint, seq string")
    rows = [("1", 602, 602, "", "CAG"), ("1", 599, 602, "CAG", ""), ("1", 603, 604, "T", "G")]
    x = V.left_align(spark.createDataFrame(rows, "contig string, start_pos bigint, end_pos bigint, ref string, alt string"), ref, window=4)
    assert sorted(map(tuple, x.collect())) == [("1", 2, 2, "", "CAG"), ("1", 2, 5, "CAG", ""), ("1", 603, 604, "T", "G")]


@pytest.mark.parametrize("start, ref, alt, want", [
    (10, "G", "C", (10, 11, "G", "C")), (10, "GT", "CT", (10, 11, "G", "C")), (9, "TGT", "TCT", (10, 11, "G", "C")), (10, "GTGGA", "", (9, 15, "CGTGGA", "C")),
    (10, "", "GTGGA", (9, 10, "C", "CGTGGA")), (0, "", "GT", (0, 1, "A", "GTA")), (9, "TCGTGGA", "TC", (10, 16, "CGTGGA", "C")), (5, "AC", "GAC", (5, 6, "A", "GA"))])
def test_parsimony(spark, start, ref, alt, want):
    got = tuple(value(spark, A.make_parsimonious(F.lit(start), F.lit(ref), F.lit(alt), F.lit("C"), F.lit("A"))))
    assert got == want and value(spark, A.is_parsimonious(F.lit(got[2]), F.lit(got[3])))


def test_section_of_a_read(spark):
    ops = C.parse(F.lit("2S3M2I4M3D2M"))  # reference from 10: clip 10-11, 12-14, insertion before 15, 15-18, deleted 19-21, 22-23
    cut = lambda b, e: tuple(value(spark, C.section(ops, F.lit(10), F.lit(b), F.lit(e))))
    assert cut(10, 12) == (0, 2) and cut(14, 15) == (4, 3) and cut(15, 16) == (7, 1) and cut(15, 15) == (5, 2)
    assert cut(19, 22) == (11, 0) and cut(18, 23) == (10, 2) and cut(0, 100) == (0, 13)
    text = lambda b, e: value(spark, C.to_text(C.subregion(ops, F.lit(10), F.lit(b), F.lit(e))))
    assert text(10, 24) == "2S3M2I4M3D2M" and text(13, 17) == "2M2I2M" and text(20, 23) == "2D1M" and text(15, 15) == "2I" and text(15, 17) == "2M"


def test_beta_arrays(spark):
    a, b = np.array([1.0, 5, 30, 0.5]), np.array([1.0, 2, 12, 7.5])
    for x in (0.03, 0.25, 0.5, 0.97):
        one = [value(spark, N.beta_cdf(F.lit(float(p)), F.lit(float(q)), x)) for p, q in zip(a, b)]
        assert N.incomplete_beta(a, b, np.full(4, x)) == pytest.approx(one, abs=1e-10)
    rng = np.random.default_rng(1)
    for cell in ((1, 1, 1, 1), (9, 1, 1, 9), (30, 12, 20, 25)):
        x, y = rng.beta(*cell[:2], 400_000), rng.beta(*cell[2:], 400_000)
        assert N.beta_difference(np.array([cell], float))[0] == pytest.approx((abs(x - y) > 0.25).mean(), abs=0.012)
    df = spark.createDataFrame([([[1.0, 1.0], [9.0, 1.0], [1.0, 9.0]],), ([[2.0, 3.0]],), (None,)], "p array<array<double>>")
    got = [r[0] for r in df.select(N.largest_beta_difference(F.col("p"))).collect()]
    assert got[0] == pytest.approx(N.beta_difference(np.array([[1, 9, 9, 1.0]]))[0]) and got[1:] == [0.0, 0.0]
    cells = spark.createDataFrame([([[2.0, 3.0, 0.25, 0.75]],), ([],)], "c array<array<double>>")
    assert [list(r[0]) for r in cells.select(N.beta_cdfs(F.col("c"))).collect()][1] == []


@pytest.mark.parametrize("k, n", [(1, 4), (2, 10), (3, 20), (4, 35)])
def test_genotype_counts(spark, k, n):
    h = spark.createDataFrame([(0, i) for i in range(4)], "block_id int, haplotype_id int")
    assert G.genotypes(h, k).count() == n == G.genotype_count(4, k)
    with pytest.raises(Exception, match="too many haplotypes"):
        G.genotypes(h, k, limit=3).count()


def test_posteriors_sum_to_one_and_prefer_the_truth(spark):
    rows = [(0, "s", r, h, -0.1 if h == r % 2 else -9.0) for r in range(20) for h in range(3)]
    lk = spark.createDataFrame(rows, "block_id int, sample string, read_id int, haplotype_id int, ln_p double")
    gts = G.genotypes(lk, 2)
    post = G.individual_posteriors(G.genotype_likelihoods(gts, lk), gts.withColumn("ln_prior", F.lit(0.0)))
    assert sum(r.posterior for r in post.collect()) == pytest.approx(1)
    best = G.best_genotypes(post).first()
    assert list(best.haplotype_ids) == [0, 1] and best.gq > 20
    em = {tuple(r.haplotype_ids): r.posterior for r in G.population_em(lk, lk).collect()}
    assert sum(em.values()) == pytest.approx(1) and max(em, key=em.get) == (0, 1)
    weights = {r.haplotype_id: r.weight for r in G.clone_mixtures(lk).collect()}
    assert weights[0] == pytest.approx(0.5, abs=0.05) and weights[2] < 0.1


def test_trio_finds_inheritance(spark):
    lik = [("m", 0, 0), ("f", 1, 1), ("c", 0, 1)]
    rows = [(0, s, [a, b], 0.0 if (a, b) == (x, y) else -50.0) for s, x, y in lik for a in range(2) for b in range(a, 2)]
    df = spark.createDataFrame(rows, "block_id int, sample string, haplotype_ids array<int>, ln_likelihood double")
    best = G.trio_posteriors(df, "m", "f", "c").orderBy(F.desc("posterior")).first()
    assert list(best.c) == [0, 1] and not best.is_denovo and best.posterior > 0.99


def test_coalescent():
    assert G.coalescent_ln(0, 2, 0.001) == pytest.approx(math.log(1 / 1.001))
    assert G.coalescent_ln(3, 10, 0.5) < G.coalescent_ln(1, 10, 0.5) < 0


def test_assignment_and_support(spark):
    rows = [(0, "s", 1, 0, -1.0), (0, "s", 1, 1, -1.0), (0, "s", 2, 0, -1.0), (0, "s", 2, 1, -5.0)]
    lk = spark.createDataFrame(rows, "block_id int, sample string, read_id int, haplotype_id int, ln_p double")
    got = {r.read_id: (list(r.haplotype_ids), r.is_ambiguous) for r in H.assign_reads(lk).collect()}
    assert got == {1: ([0, 1], True), 2: ([0], False)}
    carriers = spark.createDataFrame([(0, 0, 7), (0, 1, 7), (0, 0, 8)], "block_id int, haplotype_id int, allele_id int")
    support = {(r.read_id, r.allele_id) for r in H.allele_support(H.assign_reads(lk), carriers).collect()}
    assert support == {(1, 7), (2, 7), (2, 8)}


def test_joint_quality(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 0.0), (2, 30.0), (3, 12.5)], "k int, q double")
    got = {r.k: r.j for r in df.groupBy("k").agg(X.joint_quality(F.col("q")).alias("j")).collect()}
    want = -10 * math.log10(1 - math.exp((math.log(1 - 0.1) + math.log(1 - 0.01)) / 2))
    assert got[1] == pytest.approx(want) and got[2] == 0 and got[3] == pytest.approx(12.5)
