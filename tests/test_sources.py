"""Files in and out."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cytoquill.operators import records
from cytoquill.operators import reads as read_ops
from cytoquill.params import CallParams, ReadFilter
from cytoquill.plans import jobs
from cytoquill.sources import alignments, fasta, sinks, tables
from tests.scenario import Scenario

CONTIGS = [("c1", 3000)]


def block(data: bytes) -> bytes:
    squeezer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeezer.compress(data) + squeezer.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_record(r: dict) -> bytes:
    import re

    ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])]
    codes = ["=ACMGRSVTWYHKDBN".index(b) for b in r["seq"]]
    packed = bytes((codes[i] << 4) | (codes[i + 1] if i + 1 < len(codes) else 0) for i in range(0, len(codes), 2))
    name = r["qname"].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", 0, r["pos"], len(name), r["mapq"], 0, len(ops), r["flag"], len(codes), 0, r["mate_pos"], r["tlen"])
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + bytes(r["qual"]) + b"RGZg1\0" + b"NMC\0"
    return struct.pack("<i", len(body)) + body


def write_bam(path, rows, size):
    header = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 3000)
    whole = header + b"".join(bam_record(r) for r in rows)
    with open(path, "wb") as f:
        for at in range(0, len(whole), size):
            f.write(block(whole[at : at + size]))
        f.write(block(b""))


@pytest.fixture(scope="module")
def scenario():
    return Scenario(seed=5, depth=6)


def key(rows):
    return sorted((r["qname"], r["flag"], r["pos"], r["cigar"], r["seq"], tuple(r["qual"])) for r in rows)


@pytest.mark.parametrize("size", [60_000, 777])
def test_bam_reads_records_across_blocks(spark, scenario, tmp_path, size):
    path = str(tmp_path / "x.bam")
    write_bam(path, scenario.reads, size)
    got = alignments.read_alignments(spark, path).collect()
    assert key(got) == key(scenario.reads)
    assert got[0]["tags"] == {"RG": "Z:g1", "NM": "i:0"} and got[0]["contig"] == "c1"


def test_sam_round_trip(spark, scenario, tmp_path):
    reads, _ = scenario.frames(spark)
    path = str(tmp_path / "out.sam")
    alignments.write_sam(reads, path, CONTIGS, "test")
    text = [r[0] for r in spark.read.text(path).collect()]
    assert sum(t.startswith("@") for t in text) == 3
    back = alignments.read_sam(spark, path).collect()
    assert key(back) == key(scenario.reads)
    assert back[0]["tags"]["RG"] == "Z:g1"


def test_required_tags(spark, scenario):
    reads, _ = scenario.frames(spark)
    count = lambda *tags: read_ops.select_reads(reads, ReadFilter(require_tags=tags)).count()
    n = len(scenario.reads)
    assert count(("RG", "g1")) == n and count(("NM", "0")) == n and count(("RG", "g1"), ("NM", "0")) == n
    assert count(("RG", "g2")) == 0 and count(("XX", "1")) == 0 and count(("NM", "x")) == 0


def test_fasta(spark, tmp_path):
    seq = "acgtNRYg" * 40
    path = tmp_path / "r.fa"
    lines = [seq[i : i + 60] for i in range(0, len(seq), 60)]
    path.write_text(">k1 words\n" + "\n".join(lines) + "\n")
    (tmp_path / "r.fa.fai").write_text(f"k1\t{len(seq)}\t10\t60\t61\n")
    spark.dataSource.register(fasta.FastaSource)
    chunks = spark.read.format("fasta").option("stretch", 50).load(str(path))
    assert chunks.rdd.getNumPartitions() == 7
    got = {r["pos"]: r["base"] for r in fasta.read_reference(spark, str(path)).collect()}
    assert "".join(got[i] for i in range(len(seq))) == seq.upper().replace("R", "N").replace("Y", "N")
    import gzip

    zipped = tmp_path / "r.fa.gz"
    zipped.write_bytes(gzip.compress(path.read_bytes()))
    assert {r["pos"]: r["base"] for r in fasta.read_reference(spark, str(zipped)).collect()} == got


def test_vcf_and_bed_round_trip(spark, tmp_path):
    line = ("c1", 9, 0, "C", ".", "18", "PASS", "AD=10;BQ=35.5778;DP=18;MQ=60;M5mC_Strands=4,8,6,0;CPG", "GT:GQ:DP:M5mC:DPM5mC:ADM5mC", "0/0:18:18:0.666667:12:8")
    second = ("c1", 10, 0, "G", ".", "36", "PASS", "AD=14;DP=18;M5mC_Strands=2,4,12,0;CPG", "GT:GQ:DP:M5mC", "0/0:36:18:0.666667")
    schema = "contig string, pos bigint, kind int, ref_text string, alt_text string, qual string, filter string, info string, format string, sample string"
    lines = spark.createDataFrame([second, line], schema)
    info, fmt = records.choose_fields()
    path = str(tmp_path / "o.vcf.gz")
    sinks.write_vcf(lines, path, CONTIGS, info, fmt, {"source": "test"})
    assert tables.vcf_contigs(spark, path) == CONTIGS
    back = tables.read_vcf(spark, path)
    assert {tuple(r) for r in back.collect()} == {line, second}
    rows = records.lines_to_bed(back)
    bed = str(tmp_path / "o.bed")
    sinks.write_bed(rows, bed, CONTIGS)
    text = [r[0] for r in spark.read.text(bed).collect()]
    assert text == [
        "#chr\tstart\tend\tname\tbeta_est\tstrand\tunmod\tmod\tno_snp\tsnp\tcoverage\tgenotype\tgt_p_score\tgt_conf_score\tcpg",
        "c1\t9\t10\t.\t0.67\t+\t4\t8\t6\t0\t18\tC/C\t18\t18\tREF",
        "c1\t10\t11\t.\t0.67\t-\t2\t4\t12\t0\t18\tG/G\t36\t36\tREF",
    ]
    calls = {r["pos"]: (r["call"], r["methylated"]) for r in records.bed_calls(tables.read_calls(spark, bed)).collect()}
    assert calls == {9: ("cpg", True), 10: ("cpg", True)}
    binary = str(tmp_path / "o.bcf")
    sinks.write_vcf(lines, binary, CONTIGS, info, fmt, {"source": "test"})
    assert tables.vcf_contigs(spark, binary) == CONTIGS
    assert tables.read_vcf(spark, binary).collect() == tables.read_vcf(spark, path).collect()


def test_intervals(spark, tmp_path):
    good = tmp_path / "i.bed"
    good.write_text("#c\ntrack x\nbrowser y\nc1\t5\t9\nc1\t7\t7\nc2\t0\t4\tname\n")
    assert sorted(map(tuple, tables.read_intervals(spark, str(good)).collect())) == [("c1", 5, 9), ("c2", 0, 4)]
    bad = tmp_path / "b.bed"
    bad.write_text("c1\t5\n")
    with pytest.raises(Exception, match="not an interval"):
        tables.read_intervals(spark, str(bad)).collect()
    got = tables.regions(spark, ["c1:3-8", f"@{good}"], CONTIGS)
    assert sorted(map(tuple, got.collect())) == [("c1", 2, 8), ("c1", 5, 9)]
    with pytest.raises(ValueError):
        tables.regions(spark, ["c9"], CONTIGS)


def test_jobs_on_reads(spark, scenario, tmp_path):
    reads, ref = scenario.frames(spark)
    rows = jobs.per_read(reads, ref).cache()
    by_read = {(r["read_id"], r["orientation"]): r for r in rows.collect()}
    assert by_read and all(r["num_cpg"] == len(r["mod_cpgs"]) + len(r["unmod_cpgs"]) + len(r["snp_cpgs"]) for r in by_read.values())
    for r in scenario.reads[:60]:
        row = by_read.get((r["qname"], "-" if r["flag"] & 16 else "+"))
        if row and r["cigar"] == "100M":
            for p in row["mod_cpgs"]:
                assert r["seq"][p] in "TA"
    path = str(tmp_path / "p.bed")
    from cytoquill.operators import perread

    sinks.write_bed(perread.as_text(rows), path, CONTIGS, perread.OUTPUT)
    again = tables.read_per_read(spark, path)
    assert again.count() == rows.count()
    report = jobs.quality_tables(again, ref)
    assert report["mbias"].where("beta between lower_ci and upper_ci").count() == report["mbias"].count() > 0
    assert report["vbias"].count() > 0
    bed = spark.createDataFrame(
        [("c1", p + d, p + d + 1, ".", "0.5", "+" if d == 0 else "-", 1, 1, 1, 0, 3, "C/C" if d == 0 else "G/G", 9.0, 9.0, "REF") for p in scenario.cpgs for d in (0, 1)],
        "chr string, start bigint, end bigint, name string, beta_est string, strand string, unmod bigint, mod bigint, no_snp bigint, snp bigint, coverage bigint, genotype string, gt_p_score double, gt_conf_score double, cpg string",
    )
    tagged = jobs.tag_reads(reads, ref, bed).where("mm is not null").collect()
    for r in tagged:
        assert r["mm"][:4] in ("C+m,", "G-m,") and len(r["ml"]) == len(r["mm"].split(",")) - 1
        assert sum(a != b for a, b in zip(r["seq"], r["new_seq"])) == len(r["ml"])
    legacy = jobs.tag_reads(reads, ref, bed, legacy=True).collect()
    assert all(len(r["xm"]) == len(r["seq"]) and set(r["xm"]) <= set("Zz.") for r in legacy)


def test_verify_report(spark):
    schema = "contig string, pos bigint, kind int, ref_text string, alt_text string, qual string, filter string, info string, format string, sample string"
    row = lambda p, ref, alt, flt="PASS", info="", level=".": ("c1", p, 0, ref, alt, "9", flt, info, "GT:M5mC", f"0/1:{level}")
    pred = spark.createDataFrame([row(1, "A", "T"), row(2, "C", "T,G", info="CPG"), row(3, "A", "<*>"), row(4, "A", "AT"), row(5, "C", ".", level="0.5", info="CPG"), row(6, "G", "A", "low_ml_score")], schema)
    truth = spark.createDataFrame([row(1, "A", "T"), row(2, "C", "G"), row(9, "GT", "G")], schema)
    comp = spark.createDataFrame([row(4, "A", "AT"), row(5, "C", ".", level="0.25")], schema)
    report = jobs.verify_report(pred, truth, comp)
    acc = {r["caller"]: r for r in report["accuracy"].collect()}
    assert (acc["pred"]["tp"], acc["pred"]["fp"], acc["pred"]["fn"]) == (2, 2, 1)
    assert acc["pred"]["precision"] == 0.5 and acc["comp"]["f1"] == 0.0
    cats = {r["category"]: r for r in report["categories"].collect()}
    assert cats["CpG"]["pred_n"] == 2 and cats["Insertion"]["pred_and_comp"] == 1
    levels = report["levels"].first()
    assert levels["n_compared"] == 1 and levels["mean_abs_diff"] == 0.25 and levels["pearson_r"] == 0.0
    assert "accuracy" in jobs.report_markdown(report)
    assert CallParams().ml_threshold == 0.4 and F is not None
