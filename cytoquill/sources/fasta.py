"""Reference genomes: indexed FASTA as a Spark data source."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cytoquill.sources.lines import overlapping

CHUNK = 1 << 16


class _Slice(InputPartition):
    def __init__(self, contig: str | None, begin: int, end: int, entry: tuple[int, int, int] | None):
        self.contig, self.begin, self.end, self.entry = contig, begin, end, entry


def read_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """Rows of a .fai: contig, length, byte offset, bases per line, bytes per line."""
    with open(path) as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip()]
    return [(r[0], int(r[1]), int(r[2]), int(r[3]), int(r[4])) for r in rows]


class FastaReader(DataSourceReader):
    """With an index, one task per stretch of a contig; a compressed file is one stream."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.stretch = int(options.get("stretch", 16 << 20))

    def partitions(self) -> list[InputPartition]:
        if self.path.endswith(".gz"):
            return [_Slice(None, 0, 0, None)]
        return [
            _Slice(name, begin, min(begin + self.stretch, length), (offset, per_line, width))
            for name, length, offset, per_line, width in read_index(self.path + ".fai")
            for begin in range(0, length, self.stretch)
        ]

    def read(self, part: _Slice) -> Iterator[tuple]:
        if part.entry is None:
            yield from self._stream()
            return
        offset, per_line, width = part.entry
        at = lambda p: offset + p // per_line * width + p % per_line
        with open(self.path, "rb") as f:
            for begin in range(part.begin, part.end, CHUNK):
                end = min(begin + CHUNK, part.end)
                f.seek(at(begin))
                text = f.read(at(end - 1) + 1 - at(begin)).decode().replace("\r", "").replace("\n", "")
                yield part.contig, begin, text.upper()

    def _stream(self) -> Iterator[tuple]:
        contig, begin, held, size = None, 0, [], 0
        with gzip.open(self.path, "rt") as f:
            for line in f:
                line = line.rstrip("\r\n")
                if line.startswith(">"):
                    if held:
                        yield contig, begin, "".join(held).upper()
                    contig, begin, held, size = line[1:].split()[0], 0, [], 0
                    continue
                held.append(line)
                size += len(line)
                if size >= CHUNK:
                    yield contig, begin, "".join(held).upper()
                    begin, held, size = begin + size, [], 0
        if held:
            yield contig, begin, "".join(held).upper()


class FastaSource(DataSource):
    """Stretches of sequence: contig, 0-based start, upper-case bases."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "contig string, start bigint, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


def read_reference(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """ref(contig, pos, base) of a FASTA file; letters outside ACGT become N. With regions, only stretches that touch one are taken apart."""
    spark.dataSource.register(FastaSource)
    chunks = spark.read.format("fasta").load(path)
    chunks = overlapping(chunks.withColumn("_stop", F.col("start") + F.length("seq")), regions, "start", "_stop")
    bases = chunks.select("contig", "start", F.posexplode(F.split("seq", "")).alias("i", "b")).where("b <> ''")
    return bases.select(
        "contig", (F.col("start") + F.col("i")).alias("pos"), F.when(F.col("b").isin("A", "C", "G", "T"), F.col("b")).otherwise("N").alias("base")
    )


def contigs(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Contigs and lengths in name order, from the index if there is one."""
    if path.endswith(".gz"):
        ends = read_reference(spark, path).groupBy("contig").agg((F.max("pos") + 1).alias("n")).collect()
        return sorted((r["contig"], int(r["n"])) for r in ends)
    return sorted((name, length) for name, length, *_ in read_index(path + ".fai"))
