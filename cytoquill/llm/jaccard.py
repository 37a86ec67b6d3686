"""Exact Jaccard join of documents on distinct word n-grams, by vertical partitioning of the global n-gram order.

The order of all n-grams is that of their 64-bit hashes. It is cut into fragments, and a document's set falls into
one segment per fragment. Two sets whose similarity reaches the threshold differ in few n-grams; with more
fragments than possible differences one segment must be equal. So documents that share a segment are the
candidates, no frequencies are needed, and a passage that many documents share makes few candidates, because its
n-grams lie in segments with n-grams of the rest. The overlap of a candidate pair is then counted fragment by
fragment and summed.

Documents with equal sets are one class and only classes are joined. Links are wanted as components, so a segment that
many classes share is never expanded into all pairs: its members first meet one of them (the hub), and after
components are formed only those outside the segment's main component meet the others. Large segments that have classes in
common are one group for that, and it is done by blocks, which also count the overlaps and give out no more links than keep together what they link: rows stay in
proportion to the classes whatever a group looks like. No pair that could connect two components stays unchecked.

Defined results: NULL, empty and wordless texts have an empty set and are linked with nothing (their component is
their own doc_id); a text of fewer words than n is one n-gram, its whole sequence; repeated rows are separate rows of
the result; rows with a NULL doc_id are linked like others, but never name a component (a component of such rows alone has a NULL
name); an empty table gives an empty result; only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoquill.llm.components import components
from cytoquill.llm.hashing import mix, shingle_hashes, word_hashes
from cytoquill.llm.tables import columns, cut_lineage, maybe_broadcast, release

#: Sizes of sets are grouped into ranges, each so many times as wide as the one before; at least 1 / threshold.
RANGE = Fraction(14, 10)
#: Fragments in which the overlap of a candidate pair is counted.
FRAGMENTS = 8
#: Sets of at most this size have outlines (counts of a fragment stay below 256).
OUTLINED = 20_000
#: In segments of at most so many classes, pairs of different components are joined as rows; beyond, in blocks.
SMALL_SEGMENT = 32
#: Classes and n-grams of a block, on average.
CLASS_BLOCK, GRAM_BLOCK = 512, 2_000_000
#: In a block, overlaps of at most so many pairs are counted pair by pair; of more, as products of so many columns.
FEW_PAIRS, COLUMNS = 500, 2_048
#: Segments per task of the candidate search.
SEGMENTS_PER_TASK = 2_000_000


class Sizes:
    """Ranges of set sizes, and how sets of a range are cut at a threshold (per cent)."""

    def __init__(self, percent: int, most: int = 1 << 40):
        step = max(RANGE, Fraction(100, percent))
        ends = [1]
        while ends[-1] < most:
            ends.append(max(ends[-1] + 1, int(ends[-1] * step)))
        self.percent, self.ends = percent, np.array(ends, np.int64)

    def cuts(self, size: int) -> list[tuple[int, int, int]]:
        """(range, fragments, segments to give) of a set of this size: for its own range, and for the one below if
        sets there can reach the threshold with it.

        Sets x and y with 100 |x & y| >= p |x | y| differ in at most (100 - p) / (100 + p) * (|x| + |y|) n-grams.
        In a range that ends at u, with the larger set at most 100 u / p, that is at most d = (100 - p) u / p.
        Every difference spoils one fragment. In any order of segments that both sides know, here the largest first, one of
        the first d + 1 segments of x that hold anything is therefore equal in y, and among the first d + 1 of y too.
        """
        own = int(np.searchsorted(self.ends, size))
        out = []
        for r in (own, own - 1):
            if r >= 0 and 100 * int(self.ends[r]) >= self.percent * size:
                give = (100 - self.percent) * int(self.ends[r]) // self.percent + 1
                out.append((r, 2 * give + 1, give))
        return out


def gram_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    for first, last, words, bounds in word_hashes(texts):
        for i in range(last - first):
            yield np.unique(shingle_hashes(words[bounds[i] : bounds[i + 1]], n))


def class_of(grams: np.ndarray) -> int:
    """One 64-bit number for a set, a mixed sum over its elements; 0 for the empty set."""
    if not len(grams):
        return 0
    total = np.add.reduce(mix(grams ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(grams))
    return int(mix(np.array([total]))[0].view(np.int64)) or 1


def segments(grams: np.ndarray, sizes: Sizes) -> list[np.ndarray]:
    """Hashes of the segments that a set gives, under each range that concerns it.

    A set with too few segments that hold anything gives its single n-grams as well: two such sets share one of them.
    """
    out = []
    high, sums = grams >> np.uint64(32), np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams), dtype=np.uint64, out=sums[1:])
    for r, m, give in sizes.cuts(len(grams)):
        at = ((high * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        ends = np.append(starts[1:], len(grams))
        name = at[starts].astype(np.uint64) + np.uint64((r + 1) << 44)
        found = mix((sums[ends] - sums[starts]) ^ mix(name)) + (ends - starts).astype(np.uint64)
        out.append(found[np.argsort(starts - ends, kind="stable")[:give]])
        if len(found) < give:
            out.append(mix(grams ^ np.uint64((r + 1) << 44 | 1 << 43)))
    return out


def outline(grams: np.ndarray) -> bytes:
    """How many n-grams lie in each of 256 equal fragments of the order; for sets too large for that, nothing."""
    if len(grams) > OUTLINED:
        return b""
    return np.minimum(np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def document_classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, class (0: no words), outline; one row per row. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(g), class_of(g), outline(g)) for g in gram_sets(batch.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array([x[0] for x in found], pa.int64()),
                    "class": pa.array([x[1] for x in found], pa.int64()),
                    "outline": pa.array([x[2] for x in found], pa.binary()),
                }
            )

    return cut_lineage(columns(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_shingles bigint, class bigint, outline binary"))


@F.pandas_udf(T.LongType())
def most_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """An upper bound of the overlap of two sets: the smaller count of each fragment, summed. None known: a large number."""
    out = np.full(len(a), 1 << 62, np.int64)
    both = np.flatnonzero([len(x) == 256 and len(y) == 256 for x, y in zip(a, b, strict=True)])
    for at in range(0, len(both), 4096):
        rows = both[at : at + 4096]
        x, y = (np.frombuffer(b"".join(s.iloc[rows]), np.uint8).reshape(-1, 256) for s in (a, b))
        out[rows] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return pd.Series(out)


def shared_segments(docs: DataFrame, n: int, percent: int, total: int) -> DataFrame:
    """(segment, class) of all segments that at least two classes share. Stored."""
    sizes = Sizes(percent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this batch: copies of one set say nothing new
        for batch in batches:
            seen.clear()
            for at in range(0, batch.num_rows, 256):
                names, owners = [], []
                for grams in gram_sets(batch.column("text").slice(at, 256).to_pylist(), n):
                    own = class_of(grams)
                    if own in seen or not own:
                        continue
                    seen.add(own)
                    for found in segments(grams, sizes):
                        names.append(found)
                        owners.append(np.full(len(found), own, np.int64))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(owners))], ["segment", "class"])

    return keep_shared(columns(docs, text="string").mapInArrow(cut, "segment bigint, class bigint"), total)


def keep_shared(cuts: DataFrame, total: int) -> DataFrame:
    """The rows (segment, class), once each, of segments that hold at least two classes. Stored."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by segment and class: a row counts if a neighbour has its segment and another class.
        last = None  # segment, class, whether it was given out
        for batch in batches:
            s, c = (np.asarray(batch.column(i)) for i in (0, 1))
            if not len(s):
                continue
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
            if last is not None and last[0] == s[0] and last[1] == c[0]:
                new[0] = False
            s, c = s[new], c[new]
            if not len(s):
                continue
            same = s[1:] == s[:-1]
            give = np.zeros(len(s), bool)
            give[1:] |= same
            give[:-1] |= same
            if last is not None and last[0] == s[0]:
                give[0] = True
                if not last[2]:
                    yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["segment", "class"])
            last = (s[-1], c[-1], bool(give[-1]))
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(s[give]), pa.array(c[give])], ["segment", "class"])

    tasks = max(int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENTS_PER_TASK))
    dealt = cuts.repartition(tasks, "segment").sortWithinPartitions("segment", "class")
    return cut_lineage(dealt.mapInArrow(shared, "segment bigint, class bigint"))


def fragment_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int, fragments: int = FRAGMENTS) -> DataFrame:
    """(class, fragment, grams) of the wanted classes, from one document of each. Stored.

    Documents are found by doc_id, and those without one by their set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([i << (64 - fragments.bit_length() + 1) for i in range(1, fragments)], np.uint64)
        for batch in batches:
            owners = batch.column("class").to_pylist()
            for at in range(0, batch.num_rows, 64):
                rows: list[tuple[int, int, np.ndarray]] = []
                for own, grams in zip(owners[at : at + 64], gram_sets(batch.column("text").slice(at, 64).to_pylist(), n), strict=True):
                    found = class_of(grams)
                    if own is None and found or own == found:
                        rows += [(found, f, part.view(np.int64)) for f, part in enumerate(np.split(grams, np.searchsorted(grams, edges)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["class", "fragment", "grams"]
                )

    chosen = classes.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    text = columns(docs, doc_id="bigint", text="string")
    picked = text.join(maybe_broadcast(cut_lineage(chosen.where("doc_id IS NOT NULL"))), "doc_id").select("class", "text")
    kind = "class bigint, fragment int, grams array<bigint>"
    unnamed = text.where("doc_id IS NULL").select(F.lit(None).cast("bigint").alias("class"), "text").mapInArrow(run, kind)
    unnamed = unnamed.join(chosen.where("doc_id IS NULL"), "class", "left_semi")
    return cut_lineage(picked.mapInArrow(run, kind).unionAll(unnamed).dropDuplicates(["class", "fragment"]))


def count_overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The common n-grams of every pair (a, b): partial counts per fragment, summed."""
    left = sets.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = sets.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("grams_b"))

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")

    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", common("grams_a", "grams_b").alias("common"))
    return partial.groupBy("a", "b").agg(F.sum("common").alias("common"))


def _overlaps(x: list[np.ndarray], y: list[np.ndarray], may: np.ndarray) -> np.ndarray:
    """Common n-grams of the pairs of two groups of sets that `may` marks, fragment of the order by fragment, summed."""
    out = np.zeros(may.shape, np.int64)
    pairs = np.argwhere(may)
    if len(pairs) <= FEW_PAIRS:
        for i, j in pairs:
            out[i, j] = len(np.intersect1d(x[i], y[j], assume_unique=True))
        return out
    rows = [np.flatnonzero(may.any(axis=1 - side)) for side in (0, 1)]
    held = [np.concatenate([sets[i] for i in at]) for sets, at in zip((x, y), rows, strict=True)]
    owner = [np.repeat(np.arange(len(at)), [len(sets[i]) for i in at]) for sets, at in zip((x, y), rows, strict=True)]
    both = np.intersect1d(*held)
    place = [np.minimum(np.searchsorted(both, h), max(0, len(both) - 1)) for h in held]
    shared = [both[p] == h for p, h in zip(place, held, strict=True)] if len(both) else [np.zeros(len(h), bool) for h in held]
    order = [np.flatnonzero(s)[np.argsort(p[s], kind="stable")] for s, p in zip(shared, place, strict=True)]
    total = np.zeros((len(rows[0]), len(rows[1])), np.float64)
    for at in range(0, len(both), COLUMNS):
        parts = []
        for side in (0, 1):
            sorted_place = place[side][order[side]]
            pick = order[side][np.searchsorted(sorted_place, at) : np.searchsorted(sorted_place, at + COLUMNS)]
            part = np.zeros((len(rows[side]), min(COLUMNS, len(both) - at)), np.float32)
            part[owner[side][pick], place[side][pick] - at] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    out[np.ix_(*rows)] = np.rint(total).astype(np.int64)
    return out


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a matrix of links that keep together whatever links keep together."""
    edges, left = [], np.ones(link.shape[0], bool)
    fresh = np.ones(link.shape[1], bool)
    for start in range(link.shape[0]):
        if not left[start]:
            continue
        left[start] = False
        rows = np.array([start])
        while len(rows):
            columns = np.flatnonzero(link[rows].any(axis=0) & fresh)
            if not len(columns):
                break
            edges += list(zip(rows[link[rows][:, columns].argmax(axis=0)].tolist(), columns.tolist(), strict=True))
            fresh[columns] = False
            rows = np.flatnonzero(link[:, columns].any(axis=1) & left)
            edges += list(zip(rows.tolist(), columns[link[rows][:, columns].argmax(axis=1)].tolist(), strict=True))
            left[rows] = False
    return edges


def _cells(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """`rows`, once for every cell (group, lo, hi) that they take part in, with `first` and `second`: the sides of the cell they are on.

    A sheet holds the classes of a group of about one size, either those outside the main component or those in it, in blocks.
    Its blocks meet each other if they are outside, and those of the sheets of the same and the next sizes if one of the two is outside.
    A cell is an unordered pair of blocks, so no two blocks meet twice.
    """
    other = sheets.select("group", *[F.col(c).alias(f"{c}_2") for c in ("step", "guest", "sheet", "blocks")])
    near = sheets.join(other, "group").where((F.abs(F.col("step") - F.col("step_2")) <= 1) & (F.col("guest") | F.col("guest_2")))
    meets = near.groupBy("group", "sheet", "blocks").agg(F.collect_list(F.struct("sheet_2", "blocks_2")).alias("meets"))
    key = lambda sheet, block: F.shiftleft(sheet.cast("bigint"), 32) + block
    own = key(F.col("sheet"), F.pmod(F.xxhash64("class"), F.col("blocks")))
    theirs = F.flatten(F.transform("meets", lambda m: F.transform(F.sequence(F.lit(0).cast("bigint"), m["blocks_2"] - 1), lambda i: key(m["sheet_2"], i))))
    met = rows.join(meets, ["group", "sheet"]).select("group", "class", "component", "size", "outline", "grams", own.alias("own"), F.explode(theirs).alias("theirs"))
    sides = {"lo": F.least("own", "theirs"), "hi": F.greatest("own", "theirs"), "first": F.col("own") <= F.col("theirs"), "second": F.col("own") >= F.col("theirs")}
    return met.withColumns(sides).drop("own", "theirs")


def _grouped(mixed: DataFrame) -> DataFrame:
    """(class, component, group) of all classes: segments that have classes in common are one group.

    A class hangs on the smallest hub of its segments, so only hubs that have a class in common are linked.
    """
    hubs = mixed.groupBy("segment").agg(F.min("class").alias("hub"))
    held = mixed.join(hubs, "segment").groupBy("class").agg(F.first("component").alias("component"), F.min("hub").alias("hub"), F.collect_set("hub").alias("hubs"))
    held = cut_lineage(held)
    found = components(held.select(F.col("hub").alias("a"), F.explode("hubs").alias("b"))).select(F.col("vertex").alias("hub"), F.col("component").alias("group"))
    return held.join(found, "hub", "left").select("class", "component", F.coalesce("group", "hub").alias("group"))


def _links_in_blocks(mixed: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among classes that share large segments.

    Segments with a class in common are one group, so that each class is there once however many of them it is in. A
    group's classes are cut into blocks by size and by whether they are in its main component. In a pair of blocks, sizes and outlines rule most
    pairs out, the overlaps of the others are counted, and of the links only those leave it that keep together what it links.
    """
    thermometer = lambda x, t: (x >= t).astype(np.float32)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block[block["first"]], block[block["second"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        size_x, size_y = x["size"].to_numpy()[:, None], y["size"].to_numpy()[None, :]
        common = np.minimum(size_x, size_y)
        outlined = [np.array([len(o) == 256 for o in side["outline"]]) for side in (x, y)]
        u, v = (np.frombuffer(b"".join(side["outline"][known]), np.uint8).reshape(-1, 256) for side, known in zip((x, y), outlined, strict=True))
        if len(u) and len(v):
            bound = np.zeros((len(u), len(v)), np.float32)
            for t in range(1, int(min(u.max(), v.max())) + 1):
                bound += thermometer(u, t) @ thermometer(v, t).T
            at = np.ix_(*outlined)
            common[at] = np.minimum(common[at], np.rint(bound).astype(np.int64))
        may = 100 * common >= percent * (size_x + size_y - common)
        may &= x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]
        if block["lo"].iloc[0] == block["hi"].iloc[0]:
            may = np.triu(may, 1)  # a block with itself: each pair once
        common = _overlaps(*([np.asarray(g, np.int64) for g in side["grams"]] for side in (x, y)), may)
        edges = _forest(may & (100 * common >= percent * (size_x + size_y - common)))
        left, right = x["class"].to_numpy()[[i for i, _ in edges]], y["class"].to_numpy()[[j for _, j in edges]]
        return pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right)})

    placed = _grouped(mixed).join(members.select("class", "size", "outline"), "class")
    per = placed.groupBy("group", "component").agg(F.count(F.lit(1)).alias("held"))
    main = per.groupBy("group").agg(F.max_by("component", F.struct("held", "component")).alias("main"))
    # Sizes that differ by more than the threshold allows are two steps apart or more; steps are a little wider against rounding.
    step = F.floor(F.log("size") / math.log(1.001 * 100 / percent)).cast("int") if percent < 100 else F.col("size").cast("int")
    rows = placed.join(main, "group").join(sets, "class").withColumn("guest", F.col("component") != F.col("main")).withColumn("step", step)
    rows = cut_lineage(rows.withColumn("sheet", 2 * F.col("step") + F.col("guest").cast("int")).drop("main"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / CLASS_BLOCK), F.ceil(F.sum("size") / GRAM_BLOCK))
    sheets = cut_lineage(rows.groupBy("group", "step", "guest", "sheet").agg(blocks.alias("blocks")))
    release(mixed.sparkSession)
    return _cells(rows, sheets).groupBy("group", "lo", "hi").applyInPandas(run, "a bigint, b bigint").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, n: int, percent: int, shared: DataFrame | None = None) -> DataFrame:
    """Components of classes under direct links: (class, component), only classes that have a link. Stored.

    `shared` says which classes to compare: those with a (segment, class) row in common. Without it, the segments that
    miss no link are used.
    """
    spark = docs.sparkSession
    if shared is None:
        total = classes.agg(F.sum("n_shingles")).first()[0] or 0
        shared = shared_segments(docs, n, percent, 2 * total * (100 - percent) // percent)
    members = classes.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("outline").alias("outline"))
    members = cut_lineage(members.join(shared.select("class").distinct(), "class", "left_semi"))

    def side(name: str) -> DataFrame:
        return members.select(F.col("class").alias(name), F.col("size").alias(f"size_{name}"), F.col("outline").alias(f"outline_{name}"))

    def enough(common: Column) -> Column:
        return 100 * common >= percent * (F.col("size_a") + F.col("size_b") - common)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold. Sizes and outlines rule most others out before whole sets are moved."""
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        close = cut_lineage(sized.where(enough(F.least("size_a", "size_b"))).where(enough(F.least(most_common("outline_a", "outline_b"), "size_a", "size_b"))).select("a", "b", "size_a", "size_b"))
        wanted = close.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        sets = fragment_sets(docs, classes, wanted, n)
        joined = count_overlaps(close.select("a", "b"), sets).join(close, ["a", "b"])
        return cut_lineage(joined.where(enough(F.col("common"))).select("a", "b"))

    # First round: every class meets the smallest class of each segment it shares.
    hubs = shared.groupBy("segment").agg(F.min("class").alias("hub"))
    tried = cut_lineage(shared.join(hubs, "segment").where(F.col("class") != F.col("hub")).select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct())
    if tried.isEmpty():
        return spark.createDataFrame([], "class bigint, component bigint")
    release(spark)
    links = verified(tried)
    release(spark)
    found = components(links)
    release(spark)
    # Then: whatever is outside a segment's main component meets all classes of the segment in other components.
    placed = shared.join(found.select(F.col("vertex").alias("class"), "component"), "class", "left").select("segment", "class", F.coalesce("component", "class").alias("component"))
    per = placed.groupBy("segment", "component").agg(F.count(F.lit(1)).alias("held"))
    main = per.groupBy("segment").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.sum("held").alias("held_classes"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    mixed = cut_lineage(placed.join(main, "segment").select("segment", "class", "component", "main", "held_classes"))
    few = mixed.where(F.col("held_classes") <= SMALL_SEGMENT)
    outside = few.where("component <> main").select("segment", F.col("class").alias("x"), F.col("component").alias("cx"))
    inside = few.select("segment", F.col("class").alias("y"), F.col("component").alias("cy"))
    rest = outside.join(inside, "segment").where("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    rest = cut_lineage(rest.distinct().join(tried, ["a", "b"], "left_anti"))
    large = mixed.where(F.col("held_classes") > SMALL_SEGMENT)
    more = [verified(rest)] if not rest.isEmpty() else []
    release(spark)
    if not large.isEmpty():
        whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("fragment", "grams"))), lambda x: x["grams"]))
        sets = fragment_sets(docs, classes, large.select("class").distinct(), n).groupBy("class").agg(whole.alias("grams"))
        more.append(cut_lineage(_links_in_blocks(large, members, sets, percent)))
        release(spark)
    if more:
        links = reduce(DataFrame.unionAll, [links, *more])
        found = components(links)
        release(spark)
    return found.select(F.col("vertex").alias("class"), "component")


def jaccard_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    classes = document_classes(docs, n)
    return name_components(classes, link_classes(docs, classes, n, percent))


def name_components(classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, from the components of classes."""
    smallest = classes.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    named = smallest.join(found, "class", "left").select("class", F.coalesce("component", "class").alias("component"), "doc_id")
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    per_class = named.join(names, "component").select("class", "component_id")
    linked = classes.where("class <> 0").join(per_class, "class").select("doc_id", "n_shingles", "component_id")
    return linked.unionAll(classes.where("class = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """`docs` without the documents that are linked to one with a smaller doc_id; all columns as they are.

    Of rows that share a doc_id all stay or go; rows without words or without a doc_id stay.
    """
    found = jaccard_components(docs, n, percent)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
