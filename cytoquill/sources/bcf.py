"""BCF, the binary form of variant files, as lines of text in and out.

A header's strings (filters, fields) and contigs are numbered by its lines; records name them by number and hold typed
values. Floats are 32 bit: text that such a number cannot hold comes back as the nearest one. A file is split at any
byte, like BAM, or read by regions through a .csi index. Writing gives a folder of a header, sorted parts and the end marker, which in the order of
their names are one valid file.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cytoquill.sources import bgzf

HEADER, ENDING = "00000-header", "zzzzz-end"
#: Lines handed on together.
LINES = 4_096
# Fixed values of the format: struct codes of integer types by number, missing value and end of a vector of each.
INTS = {1: ("b", -128, -127), 2: ("h", -32768, -32767), 3: ("i", -(1 << 31), -(1 << 31) + 1)}
FLOAT, CHAR = 5, 7
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002


class Dictionary:
    """Numbers and types of a header's names."""

    def __init__(self, text: str):
        self.text = text
        self.strings, self.contigs = {0: "PASS"}, {}
        self.types: dict[tuple[str, str], str] = {}
        self.samples: list[str] = []
        for line in text.splitlines():
            if line.startswith("#CHROM"):
                self.samples = line.split("\t")[9:]
            found = re.match(r"##(FILTER|INFO|FORMAT|contig)=<(.*)>", line)
            if not found:
                continue
            kind, body = found.groups()
            name = re.search(r"(?:^|,)ID=([^,]+)", body).group(1)
            number = re.search(r",IDX=(\d+)", body)
            target = self.contigs if kind == "contig" else self.strings
            if kind != "contig":
                declared = re.search(r",Type=(\w+)", body)
                self.types[kind, name] = declared.group(1) if declared else "Flag"
            if name not in target.values():
                target[int(number.group(1)) if number else max(target, default=-1) + 1] = name
        self.number = {name: i for i, name in self.strings.items()}
        self.contig_number = {name: i for i, name in self.contigs.items()}

    def of(self, name: str) -> int:
        if name not in self.number:
            raise ValueError(f"{name!r} is not declared in the header")
        return self.number[name]


def number_text(value: float) -> str:
    """Shortest of six digits, or what the 32-bit number needs."""
    short = f"{value:.6g}"
    return short if np.float32(short) == np.float32(value) else f"{value:.9g}"


def _descriptor(kind: int, length: int) -> bytes:
    return bytes([length << 4 | kind]) if length < 15 else bytes([0xF0 | kind]) + _ints([length])


def _int_kind(values: list[int | None]) -> int:
    real = [v for v in values if v is not None]
    low, high = min(real, default=0), max(real, default=0)
    return 1 if low >= -120 and high <= 127 else 2 if low >= -32760 and high <= 32767 else 3


def _ints(values: list[int | None]) -> bytes:
    kind = _int_kind(values)
    code, missing, _ = INTS[kind]
    return _descriptor(kind, len(values)) + struct.pack(f"<{len(values)}{code}", *(missing if v is None else v for v in values))


def _float_bits(text: str) -> int:
    if text == ".":
        return FLOAT_MISSING
    return struct.unpack("<I", struct.pack("<f", float(text)))[0]


def _string(text: str) -> bytes:
    raw = text.encode()
    return _descriptor(CHAR, len(raw)) + raw


def _value(kind: str, text: str) -> bytes:
    if kind == "Integer":
        return _ints([None if v == "." else int(v) for v in text.split(",")])
    if kind == "Float":
        values = [_float_bits(v) for v in text.split(",")]
        return _descriptor(FLOAT, len(values)) + struct.pack(f"<{len(values)}I", *values)
    return _string(text)


def _genotype(text: str) -> list[int]:
    out = []
    for separator, allele in re.findall(r"([|/]?)([^|/]+)", text):
        out.append(((0 if allele == "." else int(allele) + 1) << 1) | (separator == "|"))
    return out


def _samples(name: str, kind: str, values: list[str]) -> bytes:
    """One field of all samples: vectors of equal length, ended early where a sample has fewer values."""
    if name == "GT" or kind == "Integer":
        rows = [_genotype(v) for v in values] if name == "GT" else [[None if x == "." else int(x) for x in v.split(",")] for v in values]
        number = _int_kind([x for r in rows for x in r])
        code, missing, end = INTS[number]
        width = max(map(len, rows), default=0)
        flat = [missing if x is None else x for r in rows for x in [*r, *[end] * (width - len(r))]]
        return _descriptor(number, width) + struct.pack(f"<{len(flat)}{code}", *flat)
    if kind == "Float":
        rows = [[_float_bits(x) for x in v.split(",")] for v in values]
        width = max(map(len, rows), default=0)
        flat = [x for r in rows for x in [*r, *[FLOAT_END] * (width - len(r))]]
        return _descriptor(FLOAT, width) + struct.pack(f"<{len(flat)}I", *flat)
    raw = [v.encode() for v in values]
    width = max(map(len, raw), default=0)
    return _descriptor(CHAR, width) + b"".join(r.ljust(width, b"\0") for r in raw)


def encode_line(line: str, names: Dictionary) -> bytes:
    """A variant line as a record."""
    chrom, pos, ident, ref, alt, qual, filters, info, *rest = line.split("\t")
    if chrom not in names.contig_number:
        raise ValueError(f"contig {chrom!r} is not declared in the header")
    fields = [] if info == "." else [f.partition("=") for f in info.split(";") if f]
    alleles = [ref] + ([] if alt == "." else alt.split(","))
    end = next((int(v) for k, _, v in fields if k == "END" and v.isdigit()), None)
    span = len(ref) if end is None else end - int(pos) + 1
    keys = rest[0].split(":") if rest and rest[0] not in ("", ".") else []
    per = [s.split(":") for s in rest[1:]]
    shared = [
        struct.pack("<iiiI", names.contig_number[chrom], int(pos) - 1, span, _float_bits(qual)),
        struct.pack("<II", len(alleles) << 16 | len(fields), len(keys) << 24 | len(names.samples)),
        _descriptor(CHAR, 0) if ident == "." else _string(ident),
        *map(_string, alleles),
        _descriptor(0, 0) if filters == "." else _ints([names.of(f) for f in filters.split(";")]),
    ]
    for name, given, text in fields:
        shared.append(_ints([names.of(name)]))
        kind = names.types.get(("INFO", name), "String")
        shared.append(_value(kind, text) if given and kind != "Flag" else _descriptor(0, 0))
    each = []
    for i, name in enumerate(keys):
        values = [p[i] if i < len(p) else "." for p in per]
        each += [_ints([names.of(name)]), _samples(name, names.types.get(("FORMAT", name), "String"), values)]
    shared, each = b"".join(shared), b"".join(each)
    return struct.pack("<II", len(shared), len(each)) + shared + each


def _typed(raw: bytes, at: int) -> tuple[int, int, int]:
    """(type, length, offset of the values) of a descriptor."""
    kind, length = raw[at] & 15, raw[at] >> 4
    at += 1
    if length == 15:
        inner, _, at = _typed(raw, at)
        code = INTS[inner][0]
        (length,) = struct.unpack_from(f"<{code}", raw, at)
        at += struct.calcsize(code)
    return kind, length, at


def _read(raw: bytes, at: int, kind: int, length: int) -> tuple[list | str, int]:
    """Values of one vector: numbers with None for missing ones, or text; and what comes behind them."""
    if kind in INTS:
        code, missing, end = INTS[kind]
        values = struct.unpack_from(f"<{length}{code}", raw, at)
        return [None if v == missing else v for v in values if v != end], at + length * struct.calcsize(code)
    if kind == FLOAT:
        bits = struct.unpack_from(f"<{length}I", raw, at)
        floats = struct.unpack_from(f"<{length}f", raw, at)
        return [None if b == FLOAT_MISSING else v for b, v in zip(bits, floats, strict=True) if b != FLOAT_END], at + 4 * length
    return raw[at : at + length].rstrip(b"\0").decode(), at + length


def _text(values: list | str) -> str:
    if isinstance(values, str):
        return values or "."
    return ",".join("." if v is None else number_text(v) if isinstance(v, float) else str(v) for v in values) or "."


def decode_record(raw: bytes, names: Dictionary) -> str:
    """A record as a variant line."""
    shared, each = struct.unpack_from("<II", raw)
    chrom, pos, _, qual, counts, sizes = struct.unpack_from("<iiiIII", raw, 8)
    quality = "." if qual == FLOAT_MISSING else number_text(struct.unpack_from("<f", raw, 20)[0])
    at, out = 32, []
    for _ in range(1 + (counts >> 16)):
        kind, length, at = _typed(raw, at)
        value, at = _read(raw, at, CHAR, length)
        out.append(value or ".")
    kind, length, at = _typed(raw, at)
    filters, at = _read(raw, at, kind or 1, length)
    fields = []
    for _ in range(counts & 0xFFFF):
        kind, length, at = _typed(raw, at)
        (key,), at = _read(raw, at, kind, length)
        kind, length, at = _typed(raw, at)
        if kind == 0:
            fields.append(names.strings[key])
            continue
        value, at = _read(raw, at, kind, length)
        fields.append(f"{names.strings[key]}={_text(value)}")
    columns = [names.contigs[chrom], str(pos + 1), out[0], out[1], ",".join(out[2:]) or ".", quality, ";".join(names.strings[f] for f in filters) or ".", ";".join(fields) or "."]
    samples = sizes & 0xFFFFFF
    keys, per = [], [[] for _ in range(samples)]
    at = 8 + shared
    for _ in range(sizes >> 24):
        kind, length, at = _typed(raw, at)
        (key,), at = _read(raw, at, kind, length)
        keys.append(names.strings[key])
        kind, length, at = _typed(raw, at)
        for values in per:
            value, at = _read(raw, at, kind, length)
            values.append(_alleles(value) if keys[-1] == "GT" else _text(value))
    if samples:
        columns += [":".join(keys) or ".", *(":".join(v) or "." for v in per)]
    return "\t".join(columns)


def _alleles(values: list[int]) -> str:
    out = []
    for i, v in enumerate(values):
        out.append(("" if i == 0 else "|" if v & 1 else "/") + ("." if v >> 1 == 0 else str((v >> 1) - 1)))
    return "".join(out) or "."


def plausible(data: bytearray, at: int, names: Dictionary) -> int | None:
    """Where the record at `at` ends if it can be one; -1 if it cannot; None if the data end before that is known."""
    if at + 32 > len(data):
        return None
    shared, each, chrom, pos, span, _, counts, sizes = struct.unpack_from("<IIiiiIII", data, at)
    if shared < 24 or shared > 1 << 28 or each > 1 << 30 or chrom not in names.contigs or pos < -1 or span < 0:
        return -1
    if counts >> 16 < 1 or sizes & 0xFFFFFF != len(names.samples) or (sizes >> 24 == 0) != (each == 0):
        return -1
    return at + 8 + shared + each


def read_header(path: str) -> tuple[Dictionary, int]:
    """The names of a file and the virtual offset of its first record."""
    with bgzf.open_file(path) as f:
        stream = bgzf.Stream(f, 0)
        while stream.grow():
            if stream.data[:3] != b"BCF":
                raise ValueError(f"{path} is not a BCF file")
            if len(stream.data) < 9:
                continue
            (length,) = struct.unpack_from("<I", stream.data, 5)
            if len(stream.data) >= 9 + length:
                at = 9 + length
                if at == len(stream.data):
                    first = stream.where[-1][1] << 16 if stream.grow() else f.size() << 16
                else:
                    first = bgzf.spread_offsets(stream.where, [at])[0]
                return Dictionary(stream.data[9:at].rstrip(b"\0").decode()), first
    raise ValueError(f"the header of {path} is cut off")


@dataclass
class Part(InputPartition):
    path: str
    header: str
    begin: int
    end: int
    exact: bool

    def __post_init__(self):
        super().__init__(self.begin)


class BcfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        regions = options.get("regions")
        self.regions = json.loads(regions) if regions else None

    def partitions(self) -> list[InputPartition]:
        store, inner = bgzf.locate(self.path)
        if store.get_file_info(inner).type == bgzf.fs.FileType.Directory:
            found = sorted(i.path for i in store.get_file_info(bgzf.fs.FileSelector(inner)) if i.base_name.startswith("part-"))
            files, head = found, f"{inner}/{HEADER}"
        else:
            files, head = [self.path], self.path
        parts: list[InputPartition] = []
        for path in files:
            with bgzf.open_file(path) as f:
                total = f.size()
            if self.regions is not None and bgzf.exists(path + ".csi"):
                names, _ = read_header(head)
                index = bgzf.Index(path + ".csi")
                asked = bgzf.merge([s for c, start, end in self.regions if c in names.contig_number for s in index.stretches(names.contig_number[c], start, end)])
                parts += [Part(path, head, b, e, True) for b, e in bgzf.cut(asked, index.starts(), self.split_bytes)]
            else:
                parts += [Part(path, head, b, min(b + self.split_bytes, total), False) for b in range(0, total, self.split_bytes)]
        return parts or [Part(self.path, head, 0, 0, True)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.begin >= part.end:
            return
        names, first = read_header(part.header)
        with bgzf.open_file(part.path) as f:
            begin, stop = part.begin, part.end
            if not part.exact:
                stop = part.end << 16
                if part.begin == 0:
                    begin = first if part.header == part.path else 0
                else:
                    block = bgzf.first_block(f, part.begin)
                    begin = None if block is None or block >= part.end else bgzf.first_record(f, block, lambda data, at: plausible(data, at, names))
            if begin is None:
                return
            stream, lines = bgzf.Stream(f, begin), []
            at, more = stream.skip, stream.grow()
            while True:
                while more and (len(stream.data) < at + 8 or len(stream.data) < at + 8 + sum(struct.unpack_from("<II", stream.data, at))):
                    more = stream.grow()
                if len(stream.data) < at + 8 or bgzf.spread_offsets(stream.where, [at])[0] >= stop:
                    break
                after = at + 8 + sum(struct.unpack_from("<II", stream.data, at))
                lines.append(decode_record(bytes(stream.data[at:after]), names))
                at = after
                if len(lines) == LINES:
                    yield pa.RecordBatch.from_pydict({"value": lines})
                    lines = []
                if at > bgzf.FETCH:
                    stream.drop(at)
                    at = 0
            if lines:
                yield pa.RecordBatch.from_pydict({"value": lines})


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class BcfWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.header = options["path"], options["header"]

    def write(self, rows: Iterator) -> Written:
        store, inner = bgzf.locate(self.path)
        context, names = TaskContext.get(), Dictionary(self.header)
        store.create_dir(inner, recursive=True)
        name = f"{inner}/part-{context.partitionId():08d}-{context.taskAttemptId()}"
        held, out = bytearray(), None
        for (line,) in rows:
            held += encode_line(line, names)
            if len(held) >= 16 * bgzf.MOST:
                out = out or store.open_output_stream(name, compression=None)
                whole = len(held) // bgzf.MOST * bgzf.MOST
                out.write(bgzf.compress(bytes(held[:whole])))
                del held[:whole]
        if held:
            out = out or store.open_output_stream(name, compression=None)
            out.write(bgzf.compress(bytes(held)))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = bgzf.locate(self.path)
        store.create_dir(inner, recursive=True)
        names = {m.path.rsplit("/", 1)[1] for m in messages if m and m.path}
        for found in store.get_file_info(bgzf.fs.FileSelector(inner)):
            if found.base_name.startswith("part-") and found.base_name not in names:
                store.delete_file(found.path)
        raw = self.header.rstrip("\n").encode() + b"\n\0"
        for name, data in ((HEADER, bgzf.compress(b"BCF\2\2" + struct.pack("<I", len(raw)) + raw)), (ENDING, bgzf.END_OF_FILE)):
            with store.open_output_stream(f"{inner}/{name}", compression=None) as out:
                out.write(data)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = bgzf.locate(self.path)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


class BcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return BcfReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BcfWriter(self.options)


def header_lines(path: str) -> list[str]:
    """Header lines of a file or folder, without the numbers that only BCF knows."""
    store, inner = bgzf.locate(path)
    folder = store.get_file_info(inner).type == bgzf.fs.FileType.Directory
    names, _ = read_header(f"{inner}/{HEADER}" if folder else path)
    return [re.sub(r",IDX=\d+", "", line) for line in names.text.splitlines()]


def read_lines(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Records as variant lines (`value`), without the header."""
    spark.dataSource.register(BcfSource)
    reader = spark.read.format("bcf").option("split_bytes", split_bytes)
    if regions is not None:
        reader = reader.option("regions", json.dumps(regions))
    return reader.load(path)


def write_lines(rows: DataFrame, header: list[str], path: str, order: list[str]) -> None:
    """Write variant lines (`value`) in the order of the named columns."""
    rows.sparkSession.dataSource.register(BcfSource)
    ordered = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select("value")
    ordered.write.format("bcf").option("header", "\n".join(header)).mode("overwrite").save(path)
