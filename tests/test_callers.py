"""Alignment goldens, repeats, assembly and end-to-end calling on a small simulated genome."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import reads as P
from strandloom.plans import callers as X
from strandloom.plans import haplotypes as H
from strandloom.plans import likelihoods as L
from strandloom.streaming import pipeline as S
from test_reads import BASE


def costs(truth, target, opens, extend=1, prior=4, q=40):
    return L.align_costs(truth, [target], [np.full(len(target), float(q))], np.array(opens, float), extend, prior)[0]


def opens(n, at=None, base=90, low=70):
    out = [base] * n
    if at is not None:
        out[at] = low
    return out


@pytest.mark.parametrize("truth, target, gaps, want", [
    ("ACGTACGTACGTACGAAAA", "AAAA", opens(19, base=10), 0), ("ACGTACGTACGTACGAATA", "AAAA", opens(19), 40), ("ACGTACGAAGCTACGTACG", "CGGC", opens(19, 7), 71),
    ("CGAAGCACGTACGTACGTA", "CGGC", opens(19, 2), 71), ("CCCCACGTATATATATATATATGGGGACGT", "CCCCACGTGGGACGT", opens(30, 8), 84)])
def test_alignment_costs(truth, target, gaps, want):
    assert costs(truth, target, gaps) == want


def test_batched_alignment_equals_single():
    rng = random.Random(1)
    truth = "".join(rng.choice("ACGT") for _ in range(60))
    targets = [truth[i:i + n] for i, n in ((0, 10), (20, 33), (50, 10), (5, 0))] + ["ACGTTTGACA"]
    quals = [np.array([rng.randrange(5, 40) for _ in t], float) for t in targets]
    both = L.align_costs(truth, targets, quals, L.homopolymer_gap_open(truth, 45.0), 3.0)
    assert both.tolist() == [L.align_costs(truth, [t], [q], L.homopolymer_gap_open(truth, 45.0), 3.0)[0] for t, q in zip(targets, quals)]
    assert both[:4].tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("a, b, cigar, score", [("", "", "", 0), ("", "A", "1I", -8), ("A", "", "1D", -8), ("AAA", "ACA", "1=1X1=", 1), ("AAA", "AAAA", "1I3=", -2), ("AAA", "AA", "1D2=", -4)])
def test_global_alignment(a, b, cigar, score):
    assert L.global_align(a, b) == (cigar, score)


def test_mapping_quality_mixture(spark):
    got = spark.createDataFrame([(-2.0, 60), (-500.0, 20), (-3.0, 0)], "ln double, mq int").select(L.with_mapping_quality(F.col("ln"), F.col("mq"))).collect()
    assert got[0][0] == pytest.approx(-2.0, abs=1e-4) and got[1][0] == pytest.approx(np.log(0.01)) and got[2][0] == 0


def test_repeats(spark):
    assert H.tandem_repeats("GGACACACTTTTG") == [(0, 2, 1), (2, 8, 2), (8, 12, 1)]
    ref = spark.createDataFrame([("1", 0, 0, "GGACACA"), ("1", 1, 7, "CTTTTGA")], "contig string, chunk int, chunk_start long, seq string")
    got = sorted(tuple(r)[1:] for r in H.repeat_table(ref).collect())
    assert got == [(2, 8, 2), (8, 12, 1)]


def test_assembly():
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(120))
    alt = ref[:50] + ("A" if ref[50] != "A" else "C") + ref[51:80] + ref[84:]
    reads = [s[i:i + 60] for s in (ref, alt) for i in range(0, len(s) - 60, 3)]
    got = H.assemble(reads, ref, 15)
    built = {ref[:o] + a + ref[o + len(r):] for o, r, a in got}
    assert ref[:50] + alt[50] + ref[51:] in built and ref[:80] + ref[84:] in built
    assert H.assemble(reads, "A" * 80, 10) == []


def test_k_medoids():
    xs = [0, 1, 2, 50, 51, 52, 99]
    label = H.k_medoids([[abs(a - b) for b in xs] for a in xs], 3)
    assert len(set(label[:3])) == len(set(label[3:6])) == 1 and len(set(label)) == 3


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(600))
    snv, deletion, inherited = 150, 300, 450
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}

    def haplotype(*edits):
        """(sequence, cigar walk from a begin) of a haplotype with SNVs and deletions of three bases."""
        cells = [(i, ref[i]) for i in range(len(ref))]
        for kind, at in edits:
            cells = [(i, other[b] if kind == "snv" and i == at else b) for i, b in cells if not (kind == "del" and at <= i < at + 3)]
        return cells

    haps = {"mum": [haplotype(), haplotype(("snv", inherited))], "dad": [haplotype(), haplotype()],
            "kid": [haplotype(("snv", snv), ("del", deletion)), haplotype(("snv", inherited))]}
    rows = []
    for sample, pair in haps.items():
        for h, cells in enumerate(pair):
            for i in range(2 * h, len(cells) - 80, 4):
                part = cells[i:i + 80]
                cigar, run = [], 0
                for a, b in zip(part, part[1:]):
                    run += 1
                    if b[0] > a[0] + 1:
                        cigar += [(run, "M"), (b[0] - a[0] - 1, "D")]
                        run = 0
                cigar.append((run + 1, "M"))
                rows.append({**BASE, "name": f"{sample}{h}_{i}", "sample": sample, "contig": "c", "start_pos": part[0][0], "end_pos": part[-1][0] + 1,
                             "seq": "".join(b for _, b in part), "quals": [35] * 80, "cigar": cigar, "reverse": bool(i // 4 % 2)})
    reads = spark.createDataFrame([tuple(r.values()) for r in rows], P.READ_SCHEMA).cache()
    reference = spark.createDataFrame([("c", 0, 0, 0, ref)], "contig string, contig_order int, chunk int, chunk_start long, seq string")
    return reads, reference, {"snv": snv, "del": deletion, "inherited": inherited}


def sites(calls, sample=None):
    return {(r.start_pos, r.ref if len(r.ref) == 1 else "", r.alt): r for r in calls.collect() if sample in (None, r["sample"])}


def test_individual_calls(genome):
    reads, reference, at = genome
    calls = X.call_individual(reads.where("sample = 'kid'"), reference).cache()
    got = sites(calls)
    assert {k[0] for k in got} == {at["snv"], at["inherited"]} | {k[0] for k in got if k[2] == ""}
    deletions = [k for k in got if k[2] == ""]
    assert len(deletions) == 1 and abs(deletions[0][0] - at["del"]) <= 3
    assert all(sorted(r.gt) == [0, 1] and r.qual > 20 for r in got.values())
    assert X.call_individual(reads.where("sample = 'dad'"), reference).count() == 0


def test_population_and_trio_calls(genome):
    reads, reference, at = genome
    pop = X.call_population(reads, reference)
    assert {(r["sample"], r.start_pos) for r in pop.collect() if r.alt} == {("kid", at["snv"]), ("kid", at["inherited"]), ("mum", at["inherited"])}
    trio = {r.start_pos: r.call_type for r in X.call_trio(reads, reference, "mum", "dad", "kid").collect() if r.alt}
    assert trio == {at["snv"]: "denovo", at["inherited"]: "germline"}


def test_mixture_calls(genome):
    reads, reference, at = genome
    got = {r.start_pos: (r.call_type, r.frequency) for r in X.call_mixture(reads.where("sample <> 'dad'"), reference, normal="mum").collect() if r["sample"] == "kid" and r.alt}
    assert got[at["snv"]][0] == "somatic" and got[at["inherited"]][0] == "germline"
    assert all(f == pytest.approx(0.5, abs=0.1) for _, f in got.values())


def test_streams(spark, tmp_path, genome):
    reads, _, _ = genome
    reads.write.parquet(str(tmp_path / "in"))
    stream = S.binned_counts(S.filtered_reads(S.read_stream(spark, str(tmp_path / "in"))), 100)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    want = P.apply_filters(reads).count()
    assert spark.sql("SELECT sum(n_reads) AS n FROM bins").first().n == want
