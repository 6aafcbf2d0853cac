"""Ordered arithmetic per key that never puts a whole key into one task.

A sliding RANGE window re-reads its frame for every row and gathers a key in one task.
Here a key's time line is cut into tiles: totals per tile are added up first (their number is
bounded by time span / tile width), and only the rows inside one tile are ever sorted
together. Sums over a look-back are the difference of two running totals, so a window of 90
days costs the same as one of an hour. Money is summed in whole minor units, which makes the
differences exact and independent of row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .short_ids import packed, unpacked
from .skew import heavy_keys

MICROS = 1_000_000
HOUR, DAY = 3600, 86400
# Five minutes: an account with 10^10 rows a year has about 10^5 rows in a tile, and a year has
# about 10^5 tiles, so neither step meets a large group.
TILE_SECONDS = 300
KEY_ROWS = 100_000
KEY_LIMIT = 100_000  # at most so many keys are cut, which bounds the table that names them


def running_totals(events: DataFrame, keys: list[str], tile: Column, order: list[str],
                   measures: list[str], whole: bool = False) -> DataFrame:
    """Add `run_<m>`: the sum of measure m over all events of the key up to this position.

    Events that tie on `order` are counted together. `tile` must not decrease along the
    order. With `whole=True`, `all_<m>` carries the sum over the key.

    Only keys with more than `KEY_ROWS` events are cut into tiles; an ordinary key is one tile, so
    the table of tile totals has about one row a key.
    """
    busy = F.broadcast(heavy_keys(events, keys, KEY_ROWS, KEY_LIMIT))
    events = events.join(busy, keys, "left").withColumn(
        "_tile", F.when(F.col("_slices").isNotNull(), tile).otherwise(F.lit(0)).cast("bigint")).drop("_slices")
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("_tile")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)

    tiles = events.groupBy(*keys, "_tile").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    offsets = [F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_b_{m}") for m in measures]
    if whole:
        offsets += [F.sum(f"_t_{m}").over(everything).alias(f"all_{m}") for m in measures]
    tiles = tiles.select(*keys, "_tile", *offsets)

    local = events.withColumns({f"_r_{m}": F.sum(m).over(inside) for m in measures})
    joined = local.join(tiles, keys + ["_tile"])
    return joined.withColumns(
        {f"run_{m}": F.col(f"_r_{m}") + F.col(f"_b_{m}") for m in measures}
    ).drop("_tile", *[f"_r_{m}" for m in measures], *[f"_b_{m}" for m in measures])


def whole_tiles(at: Column, width: int) -> Column:
    """Floor division of whole numbers, without a detour through rounded doubles."""
    return ((at - F.pmod(at, F.lit(width))) / F.lit(width)).cast("bigint")


def time_tile(position: str, width_seconds: int) -> Column:
    """Positions count half microseconds; integer division never decreases along them."""
    return F.expr(f"{position} div {2 * MICROS * width_seconds}")


def rolling_sums(rows: DataFrame, key: str, ts: str, measures: dict[str, Column],
                 horizons: dict[str, int], tile_seconds: int = TILE_SECONDS) -> DataFrame:
    """Sums over (ts - horizon .. ts], both ends included, one row per (key, ts).

    Each instant becomes one data event, and per horizon one question that lies just before the
    look-back start. The rows of an ordinary key are shuffled once, before there are events: all
    later steps of the key stay in that task. Keys with more than `KEY_ROWS` rows are cut into tiles.
    """
    names = list(measures)
    present = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, F.unix_micros(ts).alias("_at"), *[c.alias(m) for m, c in measures.items()])
    ordinary, heavy = by_size(present, key)
    together = Window.partitionBy(key).orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = _rolled(ordinary, key, names, horizons, lambda events: events.select(
        key, "_at", "_slot", *[F.sum(m).over(together).alias(f"run_{m}") for m in names]))
    if heavy is not None:
        sums = sums.unionByName(_rolled(heavy, key, names, horizons, lambda events: running_totals(
            events, [key], time_tile("_pos", tile_seconds), ["_pos"], names)))
    return unpacked(sums, rows, key).withColumn(ts, F.timestamp_micros("_at")).drop("_at")


def by_size(rows: DataFrame, key: str, *also: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys, dealt to tasks by the key, and the rows of the keys too large for that, if there are
    any. Keys and the ids in `also` are `packed`."""
    ordinary, heavy = parted(packed(rows, key, *also), [key])
    return ordinary.repartition(key), heavy


def busy_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with too many rows for one task, as a small stored table; None where there are none, so that
    the plan holds no branch for them. Rows of the keys are counted once, right away."""
    busy = materialize(heavy_keys(rows, keys, KEY_ROWS, KEY_LIMIT).select(*keys), "busy")
    return None if busy.isEmpty() else busy


def parted(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys and of no key, and the rows of the keys of `busy_keys`, if there are any."""
    busy = busy_keys(rows, keys)
    if busy is None:
        return rows, None
    return tuple(rows.join(F.broadcast(busy), keys, how).select(*rows.columns) for how in ("left_anti", "left_semi"))


def _rolled(rows: DataFrame, key: str, names: list[str], horizons: dict[str, int], run) -> DataFrame:
    instants = rows.groupBy(key, "_at").agg(*[F.sum(m).alias(m) for m in names])
    marks = [F.struct(F.lit("").alias("slot"), (2 * F.col("_at") + 1).alias("pos"))]
    marks += [F.struct(F.lit(h).alias("slot"), (2 * (F.col("_at") - sec * MICROS)).alias("pos"))
              for h, sec in horizons.items()]
    events = (
        instants.withColumn("_m", F.explode(F.array(*marks)))
        .select(key, "_at", F.col("_m.slot").alias("_slot"), F.col("_m.pos").alias("_pos"),
                *[F.when(F.col("_m.slot") == "", F.col(m)).otherwise(F.lit(0)).alias(m) for m in names])
    )
    totals = run(events)
    at_slot = {(m, s): F.max(F.when(F.col("_slot") == s, F.col(f"run_{m}")))
               for m in names for s in ["", *horizons]}
    return totals.groupBy(key, "_at").agg(*[
        (at_slot[m, ""] - at_slot[m, h]).alias(f"{m}_{h}") for m in names for h in horizons
    ])


def rolling_distinct(rows: DataFrame, key: str, item: str, ts: str, horizon: int, name: str,
                     tile_seconds: int = TILE_SECONDS) -> DataFrame:
    """Number of distinct items in [ts - horizon, ts], one row per (key, ts)."""
    return rolling_distincts(rows, key, item, ts, {name: horizon}, tile_seconds)


def rolling_distincts(rows: DataFrame, key: str, item: str, ts: str, horizons: dict[str, int],
                      tile_seconds: int = TILE_SECONDS) -> DataFrame:
    """The same over several horizons, by the name of the column.

    An item stays visible for a horizon after each appearance. The count is the number of such
    spells begun minus the number already over. The rows of an ordinary key are shuffled once, for all horizons, and
    stay in that task. For keys with more than `KEY_ROWS` rows the spells are found by tiles.
    """
    present = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, F.col(item).alias("_item"), F.unix_micros(ts).alias("_at"))
    ordinary, heavy = by_size(present, key, "_item")
    counted = _distinct_near(ordinary, key, horizons)
    if heavy is not None:
        far = None
        for name, horizon in horizons.items():
            one = _distinct_tiled(heavy, key, horizon, tile_seconds).withColumnRenamed("n", name)
            far = one if far is None else far.join(one, [key, "_at"])
        counted = counted.unionByName(far)
    return unpacked(counted, rows, key).select(key, F.timestamp_micros("_at").alias(ts), *horizons)


def _distinct_near(present: DataFrame, key: str, horizons: dict[str, int]) -> DataFrame:
    """key, _at and a count per horizon, of rows that lie together by key."""
    widths = [horizon * MICROS for horizon in horizons.values()]
    seen = Window.partitionBy(key, "_item").orderBy("_at")
    at, known, no = F.col("_at"), F.col("_item").isNotNull(), F.lit(0).cast("bigint")
    marked = present.distinct().withColumns({
        "_since": at - F.lag("_at").over(seen), "_until": F.lead("_at").over(seen) - at})

    def change(position, by, ask, i=None):
        return F.struct(position.alias("pos"), F.lit(ask).alias("ask"), *[
            (no + by if k == i else no).alias(f"step{k}") for k in range(len(widths))])

    changes = [change(2 * at + 1, 0, True)]
    for i, width in enumerate(widths):
        changes += [F.when(known & F.coalesce(F.col("_since") > width, F.lit(True)), change(2 * at, 1, False, i)),
                    F.when(known & F.coalesce(F.col("_until") > width, F.lit(True)), change(2 * (at + width) + 2, -1, False, i))]
    steps = [f"step{i}" for i in range(len(widths))]
    changes = marked.select(key, F.explode(F.filter(F.array(*changes), lambda c: c.isNotNull())).alias("c")).groupBy(
        key, F.col("c.pos").alias("_pos")).agg(F.max("c.ask").alias("_ask"), *[F.sum(f"c.{n}").alias(n) for n in steps])
    so_far = Window.partitionBy(key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.withColumns({name: F.sum(n).over(so_far) for name, n in zip(horizons, steps)}).where("_ask").select(
        key, F.expr("(_pos - 1) div 2").alias("_at"), *horizons)


def _distinct_tiled(present: DataFrame, key: str, horizon: int, tile_seconds: int) -> DataFrame:
    """The same for keys of any size. Within a tile as wide as the horizon the spells of an item
    always join up, so first and last appearance per tile say it all."""
    spells = item_spells(present.withColumn("_ts", F.timestamp_micros("_at")), key, "_item", "_ts", horizon)
    changes = spells.select(key, F.explode(F.array(
        F.struct((2 * F.col("_from")).alias("pos"), F.lit(1).alias("step")),
        F.struct((2 * F.col("_until") + 2).alias("pos"), F.lit(-1).alias("step")),
    )).alias("c")).groupBy(key, F.col("c.pos").alias("_pos")).agg(F.sum("c.step").cast("bigint").alias("step"))
    asked = present.select(key, (2 * F.col("_at") + 1).alias("_pos")).distinct()
    events = changes.withColumn("_ask", F.lit(False)).unionByName(
        asked.withColumns({"step": F.lit(0).cast("bigint"), "_ask": F.lit(True)}))
    totals = running_totals(events, [key], time_tile("_pos", tile_seconds), ["_pos"], ["step"])
    return totals.where("_ask").select(key, F.expr("(_pos - 1) div 2").alias("_at"), F.col("run_step").alias("n"))


def item_spells(rows: DataFrame, key: str, item: str, ts: str, horizon: int) -> DataFrame:
    """Maximal spells during which an item was seen within the last `horizon` seconds."""
    width = horizon * MICROS
    per_tile = (
        rows.where(F.col(item).isNotNull())
        .select(key, item, F.unix_micros(ts).alias("_at"))
        .groupBy(key, item, whole_tiles(F.col("_at"), width).alias("_tile"))
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    )
    order = Window.partitionBy(key, item).orderBy("_tile")
    opened = per_tile.withColumns({
        "_opens": F.coalesce(F.col("_first") - F.lag("_last").over(order) > width, F.lit(True)),
        "_closes": F.coalesce(F.lead("_first").over(order) - F.col("_last") > width, F.lit(True)),
    }).where("_opens or _closes")
    # an opening tile is followed by its own closing tile, or is one itself
    paired = opened.withColumn("_until", F.when(F.col("_closes"), F.col("_last")).otherwise(
        F.lead("_last").over(order)))
    return paired.where("_opens").select(
        key, item, F.col("_first").alias("_from"), (F.col("_until") + width).alias("_until"))


def previous_instant(instants: DataFrame, key: str, at: str, payload: list[str],
                     tile_seconds: int = TILE_SECONDS) -> DataFrame:
    """Add `prev_<p>` from the latest strictly earlier instant of the same key.

    `instants` holds one row per (key, at). Inside a tile a lag finds it; the first row of a
    tile takes the last row of the previous non-empty tile.
    """
    packed = F.struct(F.col(at).alias("at"), *[F.col(p) for p in payload])
    rows = instants.withColumn("_tile", whole_tiles(F.unix_micros(at), tile_seconds * MICROS))
    last = rows.groupBy(key, "_tile").agg(F.max_by(packed, F.col(at)).alias("_l"))
    carried = last.withColumn("_carry", F.lag("_l").over(Window.partitionBy(key).orderBy("_tile"))).drop("_l")
    inside = Window.partitionBy(key, "_tile").orderBy(at)
    joined = rows.withColumn("_near", F.lag(packed).over(inside)).join(carried, [key, "_tile"])
    found = F.coalesce(F.col("_near"), F.col("_carry"))
    return joined.withColumn("_f", found).select(
        *instants.columns, F.col("_f.at").alias("prev_at"), *[F.col(f"_f.{p}").alias(f"prev_{p}") for p in payload])


def after_gap(rows: DataFrame, key: str, ts: str, row_id: str, gap_seconds: int) -> DataFrame:
    """key, at (microseconds), row_id of the rows that follow a silence longer than the gap; of rows of one instant
    the one with the smallest id, none last. Rows without a key or an instant follow nothing.

    In a tile as wide as the gap only the first row can follow such a silence, so one row per
    (key, tile) is compared with the tile before it.
    """
    width = gap_seconds * MICROS
    tiles = (
        rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .select(key, row_id, F.unix_micros(ts).alias("_at"))
        .groupBy(key, whole_tiles(F.col("_at"), width).alias("_tile"))
        .agg(F.min(F.struct("_at", F.col(row_id).isNull().alias("_none"), row_id)).alias("_first"), F.max("_at").alias("_last"))
    )
    silence = F.col("_first._at") - F.lag("_last").over(Window.partitionBy(key).orderBy("_tile"))
    return tiles.withColumn("_silence", silence).where(F.col("_silence") > width).select(
        key, F.col("_first._at").alias("at"), F.col(f"_first.{row_id}").alias(row_id))


def before_gap(rows: DataFrame, key: str, ts: str, row_id: str, gap_seconds: int) -> DataFrame:
    """Ids of rows that follow a silence longer than the gap."""
    return after_gap(rows, key, ts, row_id, gap_seconds).select(row_id)
