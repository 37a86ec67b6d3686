"""Collocations of every language, counted by prefix-free parsing.

Texts are words and breaks between pieces. A window of three consecutive ones whose hash meets a condition is a trigger; texts are
cut at triggers, and each chunk runs on to the end of the trigger that follows, so neighbours overlap in three words.
Cuts depend on content alone: equal passages give equal chunks, whatever stands before them. The distinct chunks and how
often each occurs are the dictionary, a stored table.

Phrases are counted inside the dictionary's chunks only, weighted by their frequency. A phrase belongs to the chunk in
which it starts before the last three words; with at most four words it lies whole in that chunk, so phrases
in overlaps are counted once. Counting goes by length: phrases enter the shuffle only if the parts one shorter may be frequent
enough. That is looked up in a bitmap of the frequent ones, of at most 16 MB: it errs on the side of counting, so with
more phrases than it can tell apart the shuffle grows and the counts stay exact. Phrases are grouped by their text.

Defined results: NULL, empty and wordless texts hold no words; NULL lang counts as `und`; repeated rows count each; an
empty table gives an empty result. Only text and lang are read, so further columns cannot clash. Chunks without a
trigger for 4,096 words are cut there, so a very long text makes no long row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.llm.hashing import _SPOTS as SPOTS
from cytoquill.llm.hashing import hash_spans, mix, word_bounds
from cytoquill.llm.tables import cut_lineage, load_arrays, shared_arrays, stored

#: Words of a trigger, and so of an overlap.
TRIGGER = 3
LONGEST = TRIGGER + 1
#: One window in so many is a trigger.
SPACING = 24
#: Words of the longest chunk.
CHUNK = 4_096
#: Bytes of text that are parsed in one step.
PIECE = 4 << 20
#: Phrases must occur so often; and a phrase is dropped if one around it has this share (per cent) of its count.
LEAST, COVERED = 30, 80
#: Rows returned for a language.
BEST = 2_000
#: Bits of the largest bitmap of frequent phrases, as a power of two.
BITS = 27

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 0x09]] = True
_NEITHER = _BREAKS | _BLANKS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_ONLY_BLANK = np.zeros(256, bool)
_ONLY_BLANK[0x20] = True
#: A break between pieces, as a word of normalised text. No word can be equal to it.
BREAK = b"\n"
_BREAK_HASH = hash_spans(np.frombuffer(BREAK, np.uint8), np.array([0]), np.array([1]))[0]


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word but the last n - 1."""
    count = max(0, len(words) - n + 1)
    total = np.full(count, n, np.uint64)
    for j in range(n):
        total += words[j : j + count] * SPOTS[j]
    return mix(total)


def normalise(texts: list[bytes]) -> bytes:
    """Words and breaks of texts, A-Z lower-cased, with one blank between; texts are set apart by three breaks."""
    buffer = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    starts, ends = word_bounds(buffer, _NEITHER)
    # A break stands before the first word of a piece; the first word of a text has three.
    breaks = np.concatenate(([0], np.cumsum(_BREAKS[buffer])))
    text = np.searchsorted(text_ends, starts, side="right")
    new_piece = np.diff(breaks[starts], prepend=-1) > 0
    new_text = np.diff(text, prepend=-1) > 0
    extra = np.where(new_text, TRIGGER, new_piece) * 2
    sizes = ends - starts + 1 + extra
    out = np.full(int(sizes.sum()) + 2 * TRIGGER, 0x20, np.uint8)
    at = np.cumsum(sizes) - sizes
    length = ends - starts
    spread = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at + extra, length) + spread] = buffer[np.repeat(starts, length) + spread]
    for j in range(TRIGGER):
        out[(at + 2 * j)[extra > 2 * j]] = BREAK[0]
    out[len(out) - 2 * TRIGGER :: 2] = BREAK[0]
    return out.tobytes()[:-1]


def chunks(texts: list[bytes], spacing: int = SPACING) -> list[bytes]:
    """The chunks of texts, in order."""
    data = normalise(texts)
    buffer = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(buffer, _ONLY_BLANK)
    words = hash_spans(buffer, starts, ends)
    keys = _runs(words, TRIGGER)
    gap = _runs(np.full(TRIGGER, _BREAK_HASH), TRIGGER)[0]
    cuts = np.flatnonzero((keys % np.uint64(spacing) == 0) | (keys == gap))
    long = np.flatnonzero(np.diff(cuts) > CHUNK)
    if len(long):
        cuts = np.sort(np.concatenate([cuts, *(np.arange(cuts[i] + CHUNK, cuts[i + 1], CHUNK) for i in long)]))
    begin, end = starts[cuts[:-1]].tolist(), ends[cuts[1:] + TRIGGER - 1].tolist()
    return [data[b:e] for b, e in zip(begin, end, strict=True)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        for lang, texts in by_lang.items():
            at = np.cumsum([len(t) for t in texts]) // PIECE
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(at)) + 1):
                found = chunks([texts[i] for i in part])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()).view(pa.string())], ["lang", "chunk"])


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, times): the distinct chunks of all texts and how often each occurs."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    parsed = rows.mapInArrow(_parse, "lang string, chunk string")
    return stored(parsed.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("times")), "phrase-dictionary")


class Chunks:
    """Chunks of one language: word hashes, and the words at which a phrase may start."""

    def __init__(self, lang: str, held: list[bytes], times: np.ndarray):
        self.data = b" ".join(held)
        buffer = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = word_bounds(buffer, _ONLY_BLANK)
        words = hash_spans(buffer, self.starts, self.ends)
        offsets = np.cumsum([0] + [len(h) + 1 for h in held])
        bounds = np.searchsorted(self.starts, offsets)
        owned = np.ones(len(words), bool)
        for j in range(1, TRIGGER + 1):
            owned[bounds[1:] - j] = False
        self.times = np.repeat(times, np.diff(bounds))
        self.plain = words != _BREAK_HASH
        self.owned = owned & self.plain
        self.words = words + language(lang)

    def frequent(self, n: int, bitmap: np.ndarray) -> np.ndarray:
        """At which words a phrase of n words starts that may be frequent. Keys that straddle chunks are looked up in vain."""
        return look_up(bitmap, _runs(self.words, n))

    def count(self, starts: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray]:
        """Distinct phrases of n words at the given words, and their weighted counts."""
        keys = _runs(self.words, n)[starts] if n > 1 else self.words[starts]
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        if not len(first):
            return [], np.zeros(0, np.int64)
        at = starts[order[first]]
        return [self.data[b:e] for b, e in zip(self.starts[at].tolist(), self.ends[at + n - 1].tolist(), strict=True)], np.add.reduceat(self.times[starts[order]], first)


def language(lang: str) -> np.uint64:
    """What the hashes of a language's words are shifted by."""
    return hash_spans(np.frombuffer(b" " + lang.encode(), np.uint8), np.array([0]), np.array([len(lang.encode()) + 1]))[0]


def look_up(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def make_bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits of the keys of frequent phrases (lang, phrase). At most 2^21 words of 64 bits reach the driver."""
    bits = min(BITS, max(10, (64 * frequent.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase.encode("utf-8", "surrogatepass"))
            for lang, phrases in by_lang.items():
                buffer = np.frombuffer(b" ".join(phrases), np.uint8)
                words = hash_spans(buffer, *word_bounds(buffer, _ONLY_BLANK)) + language(lang)
                n = phrases[0].count(b" ") + 1
                keys = _runs(words, n)[::n] & np.uint64((1 << bits) - 1)
                masks = np.uint64(1) << (keys & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(6)).astype(np.int64)), pa.array(masks.view(np.int64))], ["word", "mask"])

    masks = frequent.select("lang", "phrase").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return bitmap


def _counted(parsed: DataFrame, pick: Callable[[Chunks], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """(lang, size, phrase, a) summed over the dictionary; `pick` gives the words at which phrases of a size start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.column("times").to_numpy()
            held = batch.column("chunk").cast(pa.binary())
            lang = batch.column("lang").dictionary_encode()
            codes = lang.indices.to_numpy()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                rows = np.flatnonzero(codes == code)
                part = Chunks(name, held.take(pa.array(rows)).to_pylist(), times[rows])
                for n, starts in pick(part):
                    phrases, counts = part.count(starts, n)
                    if phrases:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(phrases), pa.string()), pa.array(np.full(len(phrases), n, np.int32)), pa.array(phrases, pa.binary()).view(pa.string()), pa.array(counts)],
                            ["lang", "size", "phrase", "a"],
                        )

    rows = parsed.mapInArrow(run, "lang string, size int, phrase string, a bigint")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"))


def _words(part: Chunks) -> Iterator[tuple[int, np.ndarray]]:
    yield 1, np.flatnonzero(part.owned)


def _longer(sizes: list[int], name: str) -> Callable[[Chunks], Iterator[tuple[int, np.ndarray]]]:
    """Phrases all whose parts of the bitmap's length (the first of `sizes` less one) may be frequent."""

    def pick(part: Chunks) -> Iterator[tuple[int, np.ndarray]]:
        held = load_arrays(name)["bitmap"]
        base = sizes[0] - 1
        maybe = part.frequent(base, held)
        for n in sizes:
            count = max(0, len(part.words) - n + 1)
            ok = part.owned[:count].copy()
            for j in range(1, n):
                ok &= part.plain[j : j + count]
            for j in range(n - base + 1):
                ok &= maybe[j : j + count]
            yield n, np.flatnonzero(ok)

    return pick


def phrase_counts(parsed: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, size, phrase, a): all words of each language, and its phrases of 1 to 4 words with a >= least."""
    spark = parsed.sparkSession
    words = stored(_counted(parsed, _words), "word-counts")
    found = [words.where(F.col("a") >= least)]
    for sizes in ([2], list(range(3, LONGEST + 1))):
        bitmap = make_bitmap(found[-1])
        found.append(cut_lineage(_counted(parsed, _longer(sizes, shared_arrays(spark, "bitmap", bitmap=bitmap))).where(F.col("a") >= least)))
    return words.groupBy("lang").agg(F.sum("a").alias("n")), reduce(DataFrame.unionAll, found)


def _span(first: int, count: int):
    return F.array_join(F.slice("w", first, count), " ")


def rank(totals: DataFrame, counts: DataFrame, covered: int = COVERED, best: int = BEST) -> DataFrame:
    """Score phrases of 2 to 4 words by their weakest cut, drop those that longer ones cover, rank within the language."""
    split = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    f = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    # Every phrase with each of its cuts, joined with the counts of both parts.
    cut = split.select("lang", "size", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "size", "phrase", "a", "k", _span(1, F.col("k")).alias("head"), _span(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cut = cut.join(f.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"]).join(f.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"])
    score = F.expr("(CAST(a AS decimal(20,0)) * 2000000) div (CAST(l AS decimal(20,0)) + r)")
    weakest = cut.withColumn("score", score).groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # The largest count of a longer phrase around each.
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    around = split.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(F.expr(f"around IS NULL OR 100 * CAST(around AS decimal(20,0)) < {covered} * CAST(a AS decimal(20,0))"))
    order = Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `best` phrases of every language."""
    totals, counts = phrase_counts(dictionary(docs), least)
    return rank(totals, counts, covered, best)
