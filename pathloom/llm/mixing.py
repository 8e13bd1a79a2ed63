"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1. Its integral is the source's cumulative
token demand; a document's place in its source's token stream is looked up in the inverted demand and
gives the document's training position; documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.common import folded, running_sums, spread, stored, unfolded, word_count

#: Weights of the sources in the order of their names, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words to take, as a share of all words; passes over a source at most.
SHARE, PASSES = 1.5, 2
#: Knots (time, factor) of a source's schedule: its weight at a time is its weight times the factor between the knots.
FLAT = ((0.0, 1.0), (1.0, 1.0))
FALLING = ((0.0, 1.5), (1.0, 0.5))
RISING = ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0))
#: Schedules of the sources in the order of their names, null last, repeating.
SCHEDULES = (FALLING, RISING, FLAT)

Schedule = Sequence[tuple[float, float]]


def source_targets(docs: DataFrame, source: str = "source", size: str = "size", weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source: source, weight, source_size, target, turn (the source's place among the names, from 0).

    Targets share ``share`` of all sizes by weight; none is above ``passes`` times its source's size, and
    the excess goes to the others by weight. That is: target = min(cap, level * weight), the level being
    where the targets add up. Sources are put in the order of cap / weight; the level is that of the
    first source whose cap is not reached. Only sums per source meet in one task, not documents.
    """
    sums = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).cast("double").alias("_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    steps = F.array(*[F.lit(float(w)) for w in weights])
    rows = sums.withColumn("turn", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(steps, (F.col("turn") % len(weights) + 1).cast("int")))
    cap = F.lit(float(passes)) * F.col("_size")
    by_level = Window.orderBy(cap / F.col("weight"), F.col("_source").asc_nulls_last())
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        (F.lit(float(share)) * F.sum("_size").over(everything) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))).alias("_rest"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))).alias("_weights"),
        (cap / F.col("weight")).alias("_full"),
    )
    level = F.max(F.when(F.col("_rest") / F.col("_weights") <= F.col("_full"), F.col("_rest") / F.col("_weights"))).over(everything)
    return rows.select(F.col("_source").alias(source), "weight", F.col("_size").cast("long").alias("source_size"), F.least(cap, F.coalesce(level * F.col("weight"), cap)).alias("target"), "turn")


def _area(schedule: Schedule) -> float:
    return sum((t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(schedule, schedule[1:], strict=False))


def demand(time: Column, schedule: Schedule) -> Column:
    """The part (0 to 1) of its demand that a source with this schedule has had at a time: the integral of its weight."""
    out = F.lit(0.0)
    for (t0, f0), (t1, f1) in zip(schedule, schedule[1:], strict=False):
        dt = F.least(F.greatest(time - F.lit(t0), F.lit(0.0)), F.lit(t1 - t0))
        out = out + dt * (F.lit(f0) + dt * F.lit((f1 - f0) / (t1 - t0) / 2))
    return out / F.lit(_area(schedule))


def demand_inverse(part: Column, schedule: Schedule = FLAT) -> Column:
    """Time at which a source with this schedule has had ``part`` (0 to 1) of its demand.

    The schedule is linear between its knots, so the demand is quadratic there; each stretch of it is
    inverted in closed form.
    """
    total, done = _area(schedule), 0.0
    out = F.lit(float(schedule[-1][0]))
    stretches = []
    for (t0, f0), (t1, f1) in zip(schedule, schedule[1:], strict=False):
        want = F.greatest(part * F.lit(total) - F.lit(done), F.lit(0.0))
        slope = (f1 - f0) / (t1 - t0)
        if abs(slope) < 1e-12:
            time = F.lit(t0) + want / F.lit(max(f0, 1e-300))
        else:
            time = F.lit(t0) + (F.sqrt(F.greatest(F.lit(f0 * f0) + F.lit(2 * slope) * want, F.lit(0.0))) - F.lit(f0)) / F.lit(slope)
        done += (t1 - t0) * (f0 + f1) / 2
        stretches.append((done / total, F.least(time, F.lit(float(t1)))))
    for upto, time in reversed(stretches):
        out = F.when(part <= F.lit(upto), time).otherwise(out)
    return out


def assign(
    docs: DataFrame,
    source: str = "source",
    size: str = "size",
    key: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    schedules: Sequence[Schedule] = SCHEDULES,
    seed: int = 11,
) -> DataFrame:
    """The input's columns, and source_size, target, taken, positions and order.

    ``docs`` has one row per document with its size (null: 0) and no text. A source's documents stand in
    the order of a hash of their rows, pass after pass; those whose middle comes before the target are
    taken, so that what is taken is within half a document of the target. positions holds a training
    time for each pass that takes the document; order holds for each the part of all sources' demand that
    comes before that time. ``schedules`` are dealt to sources like the weights, by their place among the names. A
    document is taken at most ``passes`` times. Null sources are a source; documents of size 0 are
    taken once, at the place where they stand. Repeated rows (and rows with equal or null keys) are documents
    of their own; equal rows are folded while places are found, so that a row that is a third of all is no hot spot. An
    empty table gives no rows; input columns with the added names are replaced; reruns agree.
    """
    added = ("source_size", "target", "taken", "positions", "order")
    keep = [c for c in docs.columns if c not in added]
    if source not in keep or size not in keep or key not in keep:
        keep += [c for c in dict.fromkeys((source, size, key)) if c not in keep]
    rows = folded(docs.select(*[(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long") if c == size else F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(keep)]), "sized")
    at = {c: f"_c{i}" for i, c in enumerate(keep)}
    s, n, k = at[source], at[size], at[key]
    rows = rows.withColumn("_total", F.col(n) * F.col("_copies"))
    targets = source_targets(rows, s, "_total", weights, share, passes)
    others = [F.col(c) for i, c in enumerate(at.values()) if "map<" not in rows.schema[c].dataType.simpleString() and c != k]
    placed = rows.withColumn("_place", spread(F.col(k), F.lit(seed), *others))
    sums = running_sums(placed, [s], "_place", ["_total"], ties=[k, n])
    a, t = sums.alias("a"), F.broadcast(targets.select(F.col(s).alias("_s"), "weight", "source_size", "target", "turn")).alias("t") if _few(targets) else targets.select(F.col(s).alias("_s"), "weight", "source_size", "target", "turn").alias("t")
    joined = a.join(t, F.col(f"a.{s}").eqNullSafe(F.col("t._s"))).select(*at.values(), "_copies", "source_size", "target", "turn", F.col("before__total").alias("_before"))
    joined = unfolded(joined).withColumn("_before", F.col("_before") + F.col("_copy") * F.col(n))
    # the sources' demands by schedule: as many numbers as there are schedules
    shares = {int(r["x"]): float(r["w"] or 0) for r in targets.groupBy((F.col("turn") % len(schedules)).alias("x")).agg(F.sum("target").alias("w")).collect()}
    everything = sum(shares.values()) or 1.0
    turns, orders = [], []
    for i in range(passes):
        middle = F.col("_before") + F.lit(i) * F.col("source_size") + F.col(n) / 2
        part = F.coalesce(F.try_divide(middle, F.col("target")), F.lit(0.0))
        time = F.element_at(F.array(*[demand_inverse(part, x) for x in schedules]), (F.col("turn") % len(schedules) + 1).cast("int"))
        chosen = (middle < F.col("target")) if i else (middle < F.col("target")) | (F.col(n) == 0)
        turns.append(F.when(chosen & ((F.col(n) > 0) | F.lit(i == 0)), time))
    out = joined.withColumn("_positions", F.filter(F.array(*turns), lambda x: x.isNotNull()))
    before = F.transform("_positions", lambda x: sum((demand(x, schedule) * F.lit(shares.get(i, 0.0) / everything) for i, schedule in enumerate(schedules)), F.lit(0.0)))
    return out.select(*[F.col(x).alias(c) for c, x in at.items()], "source_size", "target", (F.size("_positions") * F.col(n)).cast("long").alias("taken"), F.col("_positions").alias("positions"), before.alias("order"))


def _few(targets: DataFrame) -> bool:
    return targets.limit(10_001).count() <= 10_000


def in_order(rows: DataFrame, position: str, order: str, *ties: str) -> DataFrame:
    """Rows range-partitioned and sorted by a position; rows without one come last in each partition.

    ``order`` is the part of all demand before the position, so that its equal parts are even ranges by
    construction: no sample is drawn, the input isn't computed twice, and reruns cut alike. Rows without a
    position are dealt out by a hash of the row.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    even = F.greatest(F.least(F.floor(F.col(order) * parts), F.lit(parts - 1)), F.lit(0))
    part = F.when(F.col(order).isNull(), F.pmod(F.xxhash64(*whole), F.lit(parts))).otherwise(even).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions(F.col(position).asc_nulls_last(), *ties)


def training_order(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and pass, range-sorted by position (partitions in order, rows in order within)."""
    names = [c for c in assigned.columns if c not in ("positions", "order", "position")]
    rows = assigned.select(*names, F.explode(F.arrays_zip("positions", "order")).alias("_x"))
    return in_order(rows.select(*names, F.col("_x.positions").alias("position"), F.col("_x.order").alias("_order")), "position", "_order", key).drop("_order")


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES, schedules: Sequence[Schedule] = SCHEDULES
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each pass, in training order.

    Repeated rows (same key, text and source) are taken or left together. Null texts are empty and taken once.
    Columns of any name are passed on as they are; an empty table gives no rows. The texts are joined to
    their positions once and then dealt out by position.
    """
    names = docs.columns
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("from"), own.alias("own"), word_count(F.col(text)).alias("words")).groupBy("key", "from", "own").agg(F.sum("words").alias("words"))
    plan = assign(sized, "from", "words", "key", weights, share, passes, schedules).where(F.size("positions") > 0)
    plan = stored(plan.select("key", "from", "own", F.arrays_zip("positions", "order").alias("turns")), "mix")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("key"), F.col(source).alias("from"), own.alias("own")).alias("d")
    p = plan.alias("p")
    same = F.col("d.key").eqNullSafe(F.col("p.key")) & F.col("d.from").eqNullSafe(F.col("p.from")) & (F.col("d.own") == F.col("p.own"))
    rows = d.join(p, same).select("d.row", F.col("d.key").alias("_key"), F.explode("p.turns").alias("_turn"))
    rows = rows.select("row", "_key", F.col("_turn.positions").alias("_position"), F.col("_turn.order").alias("_order"))
    return in_order(rows, "_position", "_order", "_key").select("row.*")
