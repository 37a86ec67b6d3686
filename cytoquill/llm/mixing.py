"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source is wanted `target / source_size` times. The whole part is taken as it is; the
fractions are rounded so that each stays right in expectation while the words of the source add up to its target:
two fractional documents meet, mass moves from one to the other at a constant number of words, in a random
direction, until one of them is 0 or 1, and the other goes on. Documents meet within small random blocks first,
the one left of each block meets those of other blocks, and so on up a tree; a level moves only what the level
below left over. A source ends within one document of its target, and that document is drawn at random.

Defined results: NULL and wordless texts have size 0 and are never taken; NULL is a source of its own, last in
order; a NULL doc_id is a value like any other; repeated rows are separate documents, each with its own copies;
an empty table gives an empty result; only doc_id, text and source are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.llm.hashing import WORD
from cytoquill.llm.tables import columns, cut_lineage, maybe_broadcast, unit

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST_COPIES = 3
#: Documents that meet in one block of the tree.
BLOCK = 48
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: its rank, words, non-empty documents and target. Reads (source, size); one row per source.

    Targets share all words by weight; none exceeds `most` times its source, and what lies above goes to the
    others by weight. With sources ordered by cap per weight that level is the largest of the levels that the
    running sums give.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("filled"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stats.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        by_fill.rowsBetween(0, Window.unboundedFollowing)
    )
    filled = ranked.withColumn("level", level)
    target = F.least("cap", F.col("weight") * F.max("level").over(everything))
    return filled.withColumn("target", target).select("source", "rank", "source_size", "filled", "target")


def _meet(carry: Column, x: Column, seed: str) -> Column:
    """Let two fractional documents meet: the (fraction, document) pairs afterwards, at least one of them whole."""
    ratio = x["size"] / carry["size"]
    held = F.struct(carry["frac"].alias("a"), x["frac"].alias("b"), F.least(1 - carry["frac"], x["frac"] * ratio).alias("up"), F.least(carry["frac"], (1 - x["frac"]) * ratio).alias("down"))

    def settle(v: Column) -> Column:
        rise = unit(F.lit(seed), carry["key"], x["key"]) * (v["up"] + v["down"]) < v["down"]
        a = F.when(rise, v["a"] + v["up"]).otherwise(v["a"] - v["down"])
        b = F.when(rise, v["b"] - v["up"] / ratio).otherwise(v["b"] + v["down"] / ratio)
        return F.struct(_snap(a).alias("a"), _snap(b).alias("b"))

    return F.transform(F.array(held), settle)[0]


def _snap(value: Column) -> Column:
    return F.when(value < _NEAR, 0.0).when(value > 1 - _NEAR, 1.0).otherwise(value)


def _fold(items: Column, seed: str) -> Column:
    """Fold a block of fractional documents: those that became whole, and the one left over (fraction 0: none)."""
    nobody = F.struct(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("key"), F.lit(0.0).alias("frac"))
    entry = lambda d, f: F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["key"].alias("key"), f.alias("frac"))
    start = F.struct(nobody.alias("left"), F.slice(F.array(nobody), 1, 0).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        left = acc["left"]

        def after(m: Column) -> Column:
            mine, other = entry(left, m["a"]), entry(x, m["b"])
            whole = lambda f: (f == 0.0) | (f == 1.0)
            return (
                F.when(whole(m["a"]) & whole(m["b"]), F.struct(nobody.alias("left"), F.concat(acc["done"], F.array(mine, other)).alias("done")))
                .when(whole(m["a"]), F.struct(other.alias("left"), F.concat(acc["done"], F.array(mine)).alias("done")))
                .otherwise(F.struct(mine.alias("left"), F.concat(acc["done"], F.array(other)).alias("done")))
            )

        first = F.struct(entry(x, x["frac"]).alias("left"), acc["done"].alias("done"))
        return F.when(left["frac"] == 0.0, first).otherwise(F.transform(F.array(_meet(left, x, seed)), after)[0])

    return F.aggregate(items, start, step)


def round_fractions(wanted: DataFrame, most_filled: int, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """Round (rank, filled, doc_id, size, key, frac) to frac 0 or 1, words kept per rank; returns rank, doc_id, size, frac.

    `filled` is the number of documents of the rank and `most_filled` the largest of them: they decide how many
    blocks and levels there are. Large documents meet first, so that what is left at the end is small.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("filled") / block))
    level = wanted.withColumn("block", F.pmod(F.col("key"), blocks))
    count, done, depth = max(1, -(-most_filled // block)), [], 0
    while True:
        entry = F.struct((-F.col("size")).alias("order"), "key", "doc_id", "size", "frac")
        folded = level.groupBy("rank", "block").agg(_fold(F.sort_array(F.collect_list(entry)), f"{seed}{depth}").alias("r"))
        folded = cut_lineage(folded.select("rank", "block", "r.left", "r.done"))
        done.append(folded.select("rank", F.explode("done").alias("d")).select("rank", "d.doc_id", "d.size", "d.frac"))
        left = folded.where(F.col("left.frac") > 0).select("rank", "block", "left.doc_id", "left.size", "left.key", "left.frac")
        if count == 1:
            drawn = F.when(unit(F.lit(seed), F.col("key")) < F.col("frac"), 1.0).otherwise(0.0)
            done.append(left.select("rank", "doc_id", "size", drawn.alias("frac")))
            break
        level, count, depth = left.withColumn("block", F.floor(F.col("block") / block)), -(-count // block), depth + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies."""
    text = columns(docs, doc_id="bigint", text="string", source="string")
    sizes = cut_lineage(text.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = cut_lineage(source_targets(sizes, weights, most))
    small = maybe_broadcast(targets)
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = sizes.alias("s").join(small.alias("t"), same).select("t.rank", "filled", "doc_id", "size", share.alias("share"))
    whole = F.floor(F.col("share") + _NEAR)
    frac = F.greatest(F.lit(0.0), F.col("share") - whole)
    wanted = wanted.withColumn("frac", F.when((frac < _NEAR) | (F.col("size") == 0), 0.0).otherwise(frac)).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    most_filled = targets.agg(F.max("filled")).first()[0] or 0
    rounded = round_fractions(wanted.where("frac > 0").select("rank", "filled", "doc_id", "size", "key", "frac"), most_filled, seed, block)
    rounded = wanted.where("frac = 0").select("rank", "doc_id", "size", "frac").unionAll(rounded)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + _NEAR)).otherwise(0)
    copies = F.when(F.col("size") > 0, share + F.col("frac")).otherwise(0).cast("bigint")
    return rounded.alias("r").join(small.alias("t"), F.col("r.rank") == F.col("t.rank")).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus: every row of `docs` as often as the mix takes it, with all its columns.

    Rows that share a doc_id are matched in order of size.
    """
    nth = lambda size: F.row_number().over(Window.partitionBy("mix_id").orderBy(size))
    rows = docs.withColumn("mix_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("mix_nth", nth(word_count(F.col("text"))))
    wants = mixed.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix_id"), "size", F.col("copies").alias("mix_copies"))
    wants = wants.withColumn("mix_nth", nth(F.col("size"))).where("mix_copies > 0").select("mix_id", "mix_nth", "mix_copies")
    taken = rows.join(wants, ["mix_id", "mix_nth"]).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return taken.select(*docs.columns)
