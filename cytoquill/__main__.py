"""Command line: `spark-submit -m cytoquill <job> ...` or `python -m cytoquill <job> ...`."""

from __future__ import annotations

import argparse
import sys

from cytoquill.params import CallParams, EndMask, ReadFilter
from cytoquill.session import build_session, cut_lineage


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cytoquill")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, reads: bool = True) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        if reads:
            p.add_argument("reads", help="BAM, SAM or parquet")
            p.add_argument("-r", "--reference", required=True, help="FASTA")
            p.add_argument("--min-mapq", type=int, default=1)
            p.add_argument("-f", "--include-flags", type=int, default=3)
            p.add_argument("-F", "--exclude-flags", type=int, default=3852)
            p.add_argument("--unpaired", action="store_true")
            p.add_argument("--require-tags", nargs="+", default=[], metavar="TAG=VALUE")
            p.add_argument("--guess-read-orientation", action="store_true")
            p.add_argument("-l", "--region", nargs="*", default=[], help="chr, chr:start-end, or @file; an indexed BAM is read only there")
        return p

    p = job("call")
    p.add_argument("--vcf")
    p.add_argument("--bed")
    p.add_argument("-o", "--output", help="kind by extension")
    p.add_argument("--model")
    p.add_argument("--cascade-model")
    p.add_argument("--untrained", action="store_true", help="without a model, score alts by their share of reads")
    p.add_argument("--rescue-soft-clip-cpg", action="store_true")
    p.add_argument("--m-max-coverage", type=int, default=1000)
    p.add_argument("--min-indel-ao", type=int, default=2)
    p.add_argument("--min-phase-quality", type=int, default=30)
    p.add_argument("--ml", type=float, default=0.4)
    p.add_argument("--min-baseq", type=int, default=10)
    p.add_argument("--max-coverage", type=int, default=1000)
    p.add_argument("--error-model", default="novaseq6000")
    p.add_argument("--nOT", default="0,0,0,0")
    p.add_argument("--nOB", default="0,0,0,0")
    p.add_argument("--keep-overlapping-reads", action="store_true")
    p.add_argument("--all", action="store_true")
    p.add_argument("--vcf-info-fields", nargs="+", metavar="FIELD", help="INFO fields that are written")
    p.add_argument("--vcf-format-fields", nargs="+", metavar="FIELD", help="FORMAT fields that are written")
    p.add_argument("--vcf-all-fields", action="store_true")
    p.add_argument("--segment-size", type=int, default=CallParams().phase_window, help="stretch whose median depth guards a phased site")
    p.add_argument("-c", "--cpgs-only", action="store_true")
    p = job("per-read")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--calls")
    p.add_argument("--max-read-length", type=int, default=200)
    p.add_argument("--count-clipped", action="store_true")
    p.add_argument("--exclude-ambiguous", action="store_true")
    p.add_argument("-A", "--all-reads", action="store_true")
    for mode in ("bam-standard", "bam-legacy"):
        p = job(mode)
        p.add_argument("--calls", required=True)
        p.add_argument("-o", "--output", required=True)
    p = job("convert", reads=False)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--include-empty", action="store_true")
    p = job("mbias", reads=False)
    p.add_argument("per_read")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-r", "--reference")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--reads", dest="alignments", help="reads of the table: off-target rates are reported too")
    p.add_argument("--model")
    p.add_argument("--untrained", action="store_true")
    p = job("train")
    p.add_argument("--truth", required=True)
    p.add_argument("--regions")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--trees", type=int, default=800)
    p.add_argument("--more-reads", nargs="*", default=[], help="further read sets over the same truth")
    p.add_argument("--first-model", help="train the second stage on what these models let through")
    p.add_argument("--features-out", help="folder for the feature rows, one table per model")
    p = job("verify", reads=False)
    p.add_argument("predictions")
    p.add_argument("--truth")
    p.add_argument("--competitor")
    p.add_argument("-l", "--region", nargs="*", default=[])
    p.add_argument("-o", "--output")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session()
    from cytoquill.operators import features, forest, perread, records, verify
    from cytoquill.operators.reads import parse_tag_requirement
    from cytoquill.plans import jobs
    from cytoquill.plans.calling import spans_of
    from cytoquill.sources import alignments, bcf, fasta, sinks, tables

    if hasattr(args, "reads"):
        contigs = fasta.contigs(spark, args.reference)
        region = tables.regions(spark, args.region, contigs) if args.region else None
        # What sources read: the region with a margin for the caller, exactly the region for jobs that go read by read.
        wide = spans_of(region) if region is not None else None
        exact = spans_of(region, margin=0) if region is not None and args.job != "call" else wide
        reads, ref = alignments.read_alignments(spark, args.reads, exact), fasta.read_reference(spark, args.reference, wide)
        keep = ReadFilter(args.include_flags, args.exclude_flags, args.unpaired, args.min_mapq, tuple(parse_tag_requirement(t) for t in args.require_tags))
    if args.job == "call":
        vcf, bed = args.vcf, args.bed
        if args.output:
            bed, vcf = (args.output, vcf) if is_bed(args.output) else (bed, args.output)
        params = CallParams(
            reads=keep, mask=EndMask(EndMask.parse(args.nOT), EndMask.parse(args.nOB)), min_baseq=args.min_baseq, max_coverage=args.max_coverage, ml_threshold=args.ml,
            error_model=args.error_model, all_positions=args.all, cpgs_only=args.cpgs_only, rescue_clips=args.rescue_soft_clip_cpg,
            m_max_coverage=args.m_max_coverage, min_indel_reads=args.min_indel_ao, min_switch_quality=args.min_phase_quality, phase_window=args.segment_size,
        )
        fields = (args.vcf_info_fields, args.vcf_format_fields, args.vcf_all_fields)
        jobs.run_call(spark, reads, ref, params, vcf, bed, args.model, args.cascade_model, contigs, fields, region=region, keep_overlaps=args.keep_overlapping_reads, guess_orientation=args.guess_read_orientation, untrained=args.untrained)
    elif args.job == "per-read":
        limited = ReadFilter(keep.include_flags, keep.exclude_flags, keep.unpaired, keep.min_mapq, keep.require_tags, args.max_read_length)
        rows = jobs.per_read(
            reads, ref, tables.read_calls(spark, args.calls) if args.calls else None, keep=limited, count_clipped=args.count_clipped, all_reads=args.all_reads,
            exclude_ambiguous=args.exclude_ambiguous, guess_orientation=args.guess_read_orientation,
        )
        sinks.write_bed(perread.as_text(rows), args.output, contigs, perread.OUTPUT)
    elif args.job.startswith("bam-"):
        tagged = jobs.tag_reads(reads, ref, tables.read_calls(spark, args.calls), args.job == "bam-legacy", keep)
        command = " ".join(sys.argv[1:])
        if args.output.endswith(".bam"):
            alignments.write_bam(alignments.with_written_tags(tagged), args.output, contigs, command)
        else:
            alignments.write_sam(tagged, args.output, contigs, command)
    elif args.job == "convert":
        lines = tables.read_vcf(spark, args.input)
        contigs = tables.vcf_contigs(spark, args.input)
        if is_bed(args.output):
            sinks.write_bed(records.lines_to_bed(lines, args.include_empty), args.output, contigs)
        else:
            body = tables.variant_lines(spark, args.input).where("value not like '#%'").withColumn("rank", sinks_rank(contigs))
            write = bcf.write_lines if args.output.endswith(".bcf") else sinks.write_lines
            write(body, tables_header(spark, args.input), args.output, ["rank", "value"])
    elif args.job == "mbias":
        ref = fasta.read_reference(spark, args.reference) if args.reference else None
        aligned = calls = None
        if args.alignments:
            if ref is None:
                raise ValueError("off-target rates need a reference")
            aligned = alignments.read_alignments(spark, args.alignments)
            calls = jobs.call(aligned, ref, CallParams(), forest.load(spark, args.model) if args.model else None, untrained=args.untrained)
        report = jobs.quality_tables(tables.read_per_read(spark, args.per_read), ref, aligned, calls, strict=args.strict)
        jobs.write_report(report, args.output)
        jobs.write_cutoffs(report["cutoff_lines"], f"{args.output}/cutoffs_by_contig")
    elif args.job == "train":
        confident = tables.read_intervals(spark, args.regions) if args.regions else None
        truth = records.variant_keys(tables.read_vcf(spark, args.truth))
        samples, params = [reads, *(alignments.read_alignments(spark, path) for path in args.more_reads)], CallParams(reads=keep)
        if args.first_model:
            rows = jobs.cascade_features(samples, ref, forest.load(spark, args.first_model), params, confident)
        else:
            rows = jobs.training_features(samples, ref, params, confident)
        rows = cut_lineage(rows)
        if args.features_out:
            labelled = verify.label_candidates(rows, truth)
            for name in forest.MODELS:
                forest.export_features(features.model_rows(labelled, name, ("label",)), name, f"{args.features_out}/{name}")
        models = forest.train_rows(rows, truth, forest.TrainParams(trees=args.trees))
        forest.save(models, args.output)
        forest.importances(models, spark).write.mode("overwrite").json(f"{args.output}/importances")
    elif args.job == "verify":
        if not args.truth and not args.competitor:
            raise ValueError("verify needs --truth, --competitor, or both")
        asked = spans_of(tables.regions(spark, args.region, tables.vcf_contigs(spark, args.predictions)), margin=0) if args.region else None
        load = lambda p: tables.read_vcf(spark, p, asked) if p else None
        report = jobs.verify_report(load(args.predictions), load(args.truth), load(args.competitor))
        print(jobs.report_markdown(report))
        if args.output:
            jobs.write_report(report, args.output)
            spark.createDataFrame([(jobs.report_html(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/html")
    return 0


def is_bed(path: str) -> bool:
    """Whether a path is named as a BED table."""
    return path.rstrip("/").lower().endswith((".bed", ".bed.gz"))


def sinks_rank(contigs: list[tuple[str, int]]):
    from pyspark.sql import functions as F

    order = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(contigs) for x in (n, i)])
    position = F.split("value", "\t")[1].try_cast("bigint")
    return F.struct(order[F.split("value", "\t")[0]].alias("contig"), position.alias("pos"))


def tables_header(spark, path: str) -> list[str]:
    """Header lines in file order: they are few and all in the first part of the file."""
    if path.endswith(".bcf"):
        from cytoquill.sources import bcf

        return bcf.header_lines(path)
    return [r[0] for r in spark.read.text(path).where("value like '#%'").collect()]


if __name__ == "__main__":
    raise SystemExit(main())
