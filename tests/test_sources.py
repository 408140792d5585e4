"""Text formats: parsing, round trips, malformed input."""

import pytest

from strandloom.sources import regions as G
from strandloom.sources import text_formats as T

SIZES = {"1": 500, "2": 1000, "HLA:01": 70}


@pytest.mark.parametrize("text, want", [("1", ("1", 0, 500)), ("1:100-200", ("1", 100, 200)), ("1:10", ("1", 10, 11)), ("1:10-10", ("1", 10, 10)), ("1:10-", ("1", 10, 500)),
                                        ("2:9,00-1,100", ("2", 900, 1000)), ("HLA:01:5-9", ("HLA:01", 5, 9)), ("HLA:01", ("HLA:01", 0, 70))])
def test_region_texts(text, want):
    assert G.parse_region(text, SIZES) == want


@pytest.mark.parametrize("text", ["", "3", "1:", "1:x", "1:-", "1:-10", "1:10-5", "1:10--20", "1::10", "1:1-2-3", "foo:1-2", "1:1o0", "-", ":", "1:100-2x", "1 :3"])
def test_malformed_regions(text):
    with pytest.raises(G.BadRegion):
        G.parse_region(text, SIZES)


def test_region_files(spark, tmp_path):
    p = tmp_path / "r.txt"
    p.write_text("1:100-200\n2\n\n1:7-\n2\t5\t9\n1:bad\n")
    got = G.read_region_file(spark, str(p), SIZES, strict=False).collect()
    assert sorted(map(tuple, got)) == [("1", 7, 500), ("1", 100, 200), ("2", 0, 1000), ("2", 5, 9)]
    with pytest.raises(Exception, match="malformed region"):
        G.read_region_file(spark, str(p), SIZES).collect()


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">a some text\nACGTAC\nGTN\n>b\nttt\n")
    ref = T.read_fasta(spark, str(p), chunk=4)
    assert sorted(map(tuple, T.contigs(ref).collect())) == [("a", 0, 9), ("b", 1, 3)]
    rows = [("a", 2, 7), ("a", 4, 4), ("b", 1, 5), ("a", 0, 9)]
    regions = spark.createDataFrame(rows, "contig string, start_pos long, end_pos long")
    got = {tuple(r)[:3]: r.ref_seq for r in T.fetch_sequences(regions, ref, chunk=4).collect()}
    assert got == {("a", 2, 7): "GTACG", ("a", 4, 4): "", ("b", 1, 5): "TTNN", ("a", 0, 9): "ACGTACGTN"}
    with pytest.raises(Exception, match="outside"):
        T.fetch_sequences(regions, ref, chunk=4, fill=False).collect()


def test_sam_round_trip(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "@RG\tID:g\tSM:s1", "r1\t99\t1\t101\t60\t2S6M\t=\t151\t58\tACGTACGT\tIIIIIIII\tBX:Z:bc\tRG:Z:g", "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\tRG:Z:g"]
    p = tmp_path / "x.sam"
    p.write_text("\n".join(lines) + "\n")
    df = T.read_sam(spark, str(p))
    r = df.where("name = 'r1'").first()
    assert (r["sample"], r.contig, r.start_pos, r.end_pos, r.barcode, r.mate.begin, r.reverse) == ("s1", "1", 98, 106, "bc", 150, False)
    assert list(r.quals) == [40] * 8
    assert sorted(x.line for x in T.sam_lines(df).collect()) == sorted(lines[2:])


def test_vcf_round_trip(spark, tmp_path):
    text = ("##fileformat=VCFv4.3\n##INFO=<ID=AC,Number=A,Type=Integer,Description=\"x\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
            "2\t5\t.\tAC\tA,*\t12.5\tPASS\tAC=1,2;DB\tGT:DP\t0|1:7\t2/2:.\n1\t9\tx\tG\tT\t.\tq10;MQ\t.\tGT:DP\t0/0:1\t.:3\n")
    p = tmp_path / "x.vcf"
    p.write_text(text)
    df = T.read_vcf(spark, str(p))
    r = df.where("contig = '2'").first()
    assert (r.start_pos, r.end_pos, list(r.alt), r.qual, r["filter"], r.info) == (4, 6, ["A", "*"], 12.5, [], {"AC": ["1", "2"], "DB": []})
    assert list(r.samples["s1"].gt) == [0, 1] and r.samples["s1"].phased and r.samples["s1"].fmt == {"DP": ["7"]}
    out = str(tmp_path / "out")
    T.write_vcf(df, out, ["s1", "s2"], {"1": 500, "2": 1000})
    again = T.read_vcf(spark, out)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))
    legacy = T.to_legacy_genotypes(df).where("contig = '2'").first()
    assert list(legacy.alt) == ["A"] and list(legacy.samples["s2"].gt) == [0, 0]


def test_small_tables(spark, tmp_path):
    ped = tmp_path / "x.ped"
    ped.write_text("f kid dad mum 1 0\nf dad 0 0 1 0\nf mum 0 0 2 0\n")
    assert [tuple(r) for r in T.trios(T.read_pedigree(spark, str(ped))).collect()] == [("kid", "mum", "dad")]
    pl = tmp_path / "p.txt"
    pl.write_text("MT=1\ns1:X=1\n")
    df = spark.createDataFrame([("s1", "X"), ("s2", "X"), ("s1", "MT")], "sample string, contig string")
    got = {(r["sample"], r.contig): r.ploidy for r in T.with_ploidy(df, T.read_ploidies(spark, str(pl))).collect()}
    assert got == {("s1", "X"): 1, ("s2", "X"): 2, ("s1", "MT"): 1}
    assert T.read_config("a = 1 # x\n# y\nb=2\n") == {"a": "1", "b": "2"}
    assert G.contig_range("2", "HLA:01", list(SIZES)) == ["2", "HLA:01"]
