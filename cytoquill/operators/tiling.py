"""Ordered and interval operators that never put a whole contig into one task.

A window partitioned by contig would sort a third of a genome in a single task. Everything here works on
tiles of the coordinate axis instead: neighbour look-ups copy the few rows beside a tile edge into the next
tile, and running values are computed per tile and then shifted by one small per-tile carry table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 16


def with_tiles(df: DataFrame, pos: str = "pos", width: int = TILE, halo: int = 1) -> DataFrame:
    """Add `tile` and `is_core`; rows within `halo` of an edge are also copied to the tile across it."""
    if not 0 <= halo < width:
        raise ValueError(f"halo {halo} must be smaller than the tile width {width}")
    tiles = F.expr(f"sequence(({pos} - {halo}) div {width}, ({pos} + {halo}) div {width})")
    return df.withColumn("tile", F.explode(tiles)).withColumn("is_core", F.expr(f"tile = {pos} div {width}"))


def tile_window(keys: Sequence[str], pos: str = "pos") -> Window:
    return Window.partitionBy(*keys, "tile").orderBy(pos)


def core_only(df: DataFrame) -> DataFrame:
    return df.where("is_core").drop("tile", "is_core")


def neighbour(value: Column, offset: int, window: Window, pos: str = "pos") -> Column:
    """`value` at exactly `pos + offset`; a gap in the positions gives NULL."""
    if offset < 0:
        seen, at = F.lag(value, -offset), F.lag(F.col(pos), -offset)
    else:
        seen, at = F.lead(value, offset), F.lead(F.col(pos), offset)
    return F.when(at.over(window) == F.col(pos) + offset, seen.over(window))


def with_neighbours(
    df: DataFrame, values: dict[str, tuple[str, int]], keys: Sequence[str] = ("contig",), pos: str = "pos", width: int = TILE
) -> DataFrame:
    """Add `{name: (column, offset)}` read from true neighbours. Positions must be unique per key.

    Offsets beyond one step are only found across unbroken runs of positions, which is what a
    reference sequence is; for sparse tables use offsets of one.
    """
    reach = max(abs(offset) for _, offset in values.values())
    w = tile_window(keys, pos)
    tiled = with_tiles(df, pos, width, reach)
    return core_only(tiled.withColumns({name: neighbour(F.col(col), off, w, pos) for name, (col, off) in values.items()}))


def with_range_aggregates(
    df: DataFrame,
    aggregates: dict[str, Column],
    radius: int | None = None,
    keys: Sequence[str] = ("contig",),
    pos: str = "pos",
    width: int = TILE,
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """Aggregate over all rows within `radius` positions on either side, or within `span` = (from, to)."""
    low, high = span if span is not None else (-radius, radius)
    w = tile_window(keys, pos).rangeBetween(low, high)
    tiled = with_tiles(df, pos, width, max(abs(low), abs(high)))
    return core_only(tiled.withColumns({name: agg.over(w) for name, agg in aggregates.items()}))


def with_running(
    df: DataFrame,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    keys: Sequence[str] = ("contig",),
    pos: str = "pos",
    width: int = TILE,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums and maxima along `pos` per key, up to and including (or just before) each row.

    Positions must be unique per key. Two steps: within the tile, plus what all earlier tiles of the key
    add up to. The carry table has one row per occupied tile.
    """
    sums, maxima = sums or {}, maxima or {}
    tiled = df.withColumn("tile", F.expr(f"{pos} div {width}")).withColumns(
        {f"_v_{name}": value for name, value in {**sums, **maxima}.items()}
    )
    carry = tiled.groupBy(*keys, "tile").agg(
        *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_c_{n}") for n in maxima]
    )
    earlier = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        *keys,
        "tile",
        *[F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(earlier).alias(f"_o_{n}") for n in maxima],
    )
    here = Window.partitionBy(*keys, "tile").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = tiled.withColumns(
        {
            **{f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(here), F.lit(0)) for n in sums},
            **{f"_l_{n}": F.max(f"_v_{n}").over(here) for n in maxima},
        }
    )
    joined = local.join(carry, [*keys, "tile"])
    names = [*sums, *maxima]
    out = joined.withColumns(
        {
            **{n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums},
            **{n: F.greatest(F.col(f"_l_{n}"), F.col(f"_o_{n}")) for n in maxima},
        }
    )
    return out.drop("tile", *[f"_{p}_{n}" for p in "vol" for n in names])


def gap_chains(positions: DataFrame, gap: int, keys: Sequence[str] = ("contig",), pos: str = "pos", width: int = TILE) -> DataFrame:
    """Add `chain_start`: positions further apart than `gap` start a new chain. Positions must be unique."""
    tiled = with_tiles(positions, pos, width, gap)
    before = F.lag(pos).over(tile_window(keys, pos))
    started = core_only(
        tiled.withColumn("_start", F.when(before.isNull() | (F.col(pos) - before > gap), F.col(pos)))
    )
    return with_running(started, maxima={"chain_start": F.col("_start")}, keys=keys, pos=pos, width=width).drop("_start")


def merge_intervals(intervals: DataFrame, keys: Sequence[str] = ("contig",), width: int = TILE) -> DataFrame:
    """Union of half-open `start`/`end` intervals per key; overlapping or touching ones become one."""
    unique = intervals.where(F.col("end") > F.col("start")).groupBy(*keys, "start").agg(F.max("end").alias("end"))
    reach = with_running(unique, maxima={"_reach": F.col("end")}, keys=keys, pos="start", width=width, inclusive=False)
    opened = reach.withColumn(
        "_open", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start"))
    )
    island = with_running(opened, maxima={"_island": F.col("_open")}, keys=keys, pos="start", width=width)
    return island.groupBy(*keys, F.col("_island").alias("start")).agg(F.max("end").alias("end"))


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, how: str = "semi", keys: Sequence[str] = ("contig",), pos: str = "pos", width: int = 1 << 12
) -> DataFrame:
    """Points inside (`semi`) or outside (`anti`) any half-open interval, or `flag`ged with `inside`.

    Intervals are merged first, so a point meets at most one of them; the join is an equi-join on bins.
    """
    merged = merge_intervals(intervals, keys)
    binned = merged.withColumn("_bin", F.explode(F.expr(f"sequence(start div {width}, (end - 1) div {width})")))
    if how == "flag":
        hit = binned.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bin").alias("_b"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        left = points.withColumn("_bin", F.expr(f"{pos} div {width}"))
        on = (F.col("_b") == F.col("_bin")) & (F.col("_s") <= F.col(pos)) & (F.col(pos) < F.col("_e"))
        for k in keys:
            on = on & (F.col(f"_{k}") == F.col(k))
        joined = left.join(hit, on, "left")
        return joined.withColumn("inside", F.col("_s").isNotNull()).drop("_bin", "_b", "_s", "_e", *[f"_{k}" for k in keys])
    left, right = points.withColumn("_bin", F.expr(f"{pos} div {width}")).alias("p"), binned.alias("i")
    on = (F.col("p._bin") == F.col("i._bin")) & (F.col("i.start") <= F.col(f"p.{pos}")) & (F.col(f"p.{pos}") < F.col("i.end"))
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    return left.join(right, on, f"left_{how}").drop("_bin")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("contig",), width: int = 1 << 10, cover: bool = False
) -> DataFrame:
    """Pairs of rows whose half-open `l_start`/`l_end` and `r_start`/`r_end` overlap.

    With `cover`, the right interval must contain the left one. Each pair is found once: in the bin where
    the later of the two starts lies.
    """
    l_bin = F.explode(F.expr(f"sequence(l_start div {width}, greatest(l_end - 1, l_start) div {width})"))
    r_bin = F.explode(F.expr(f"sequence(r_start div {width}, greatest(r_end - 1, r_start) div {width})"))
    pairs = left.withColumn("_bin", l_bin).join(right.withColumn("_bin", r_bin), [*keys, "_bin"])
    test = "r_start <= l_start and l_end <= r_end" if cover else "l_start < r_end and r_start < l_end"
    return pairs.where(f"{test} and _bin = greatest(l_start, r_start) div {width}").drop("_bin")


def _with_sites(queries: DataFrame, sites: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Distinct positions of both tables, with `_site` set where there is a site."""
    return (
        queries.select(*keys, pos).withColumn("_site", F.lit(None).cast("bigint"))
        .unionByName(sites.select(*keys, pos).withColumn("_site", F.col(pos).cast("bigint")))
        .groupBy(*keys, pos).agg(F.max("_site").alias("_site"))
    )


def nearest_before(
    queries: DataFrame, sites: DataFrame, name: str, keys: Sequence[str] = ("contig",), pos: str = "pos", width: int = TILE
) -> DataFrame:
    """As-of join: the largest site position not after each query position, and NULL if there is none.

    `sites` holds unique positions; query positions may repeat, so the look-up runs on their distinct
    values and is joined back.
    """
    found = with_running(_with_sites(queries, sites, keys, pos), maxima={name: F.col("_site")}, keys=keys, pos=pos, width=width)
    return queries.join(found.select(*keys, pos, name), [*keys, pos], "left")


def sites_up_to(
    queries: DataFrame, sites: DataFrame, name: str, keys: Sequence[str] = ("contig",), pos: str = "pos", width: int = TILE
) -> DataFrame:
    """How many sites lie at or before each query position."""
    one = F.when(F.col("_site").isNotNull(), 1).otherwise(0)
    found = with_running(_with_sites(queries, sites, keys, pos), sums={name: one}, keys=keys, pos=pos, width=width)
    return queries.join(found.select(*keys, pos, name), [*keys, pos], "left")


def coverage_at(positions: DataFrame, intervals: DataFrame, depths: dict[str, Column], keys: Sequence[str] = ("contig",), width: int = TILE) -> DataFrame:
    """Add to every position how many half-open intervals cover it, once per named condition on the interval."""
    names = list(depths)
    ends = F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))
    )
    flagged = intervals.withColumns({f"_{n}": F.when(c, 1).otherwise(0) for n, c in depths.items()})
    events = flagged.withColumn("_e", F.explode(ends)).select(
        *keys, F.col("_e.pos").alias("pos"), F.lit(0).alias("_asked"), *[(F.col(f"_{n}") * F.col("_e.d")).alias(n) for n in names]
    )
    asked = positions.select(*keys, "pos", F.lit(1).alias("_asked"), *[F.lit(0).alias(n) for n in names])
    steps = events.unionByName(asked).groupBy(*keys, "pos").agg(F.max("_asked").alias("_asked"), *[F.sum(n).alias(f"_d_{n}") for n in names])
    running = with_running(steps, sums={n: F.col(f"_d_{n}") for n in names}, keys=keys, width=width).where("_asked = 1")
    return positions.join(running.select(*keys, "pos", *names), [*keys, "pos"])


def coverage_from_events(intervals: DataFrame, keys: Sequence[str] = ("contig",), width: int = TILE) -> DataFrame:
    """Depth at every position where it changes, from half-open intervals: +1 at a start, -1 at an end."""
    events = intervals.select(*keys, F.explode(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).cast("bigint").alias("delta")),
        F.struct(F.col("end").alias("pos"), F.lit(-1).cast("bigint").alias("delta")),
    )).alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.delta").alias("delta"))
    return with_running(events, sums={"depth": F.col("delta")}, keys=keys, width=width)
