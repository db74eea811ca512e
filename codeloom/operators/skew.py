"""Per-key work when a few keys hold most rows.

Rows are placed by sampled quantiles of (key, order), so a heavy key spreads over as many partitions as its share
of the rows asks for. Each partition works through its sorted rows alone; only the state at its two ends can
belong to a key that continues next door, and those few states (two per partition) are stitched afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import Scratch, partitions


#: Partial states that an input partition gathers before it passes them on, so that very many keys do not pile up.
HELD = 100_000


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """True where a row's key differs from the row above; nulls are equal to each other."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    if batch.num_rows:
        changed[0] = True
    return changed


def _key_at(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _combine(keys: list[str], order: str):
    """Partial states of one input partition: rows that meet there are counted before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]):
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            part = rows.group_by(keys).aggregate([(order, "count", pa.compute.CountOptions("all")), (order, "min"), (order, "max")])
            part = part.select([*keys, f"{order}_count", f"{order}_min", f"{order}_max"]).rename_columns([*keys, "n", "low", "high"])
            held = part if held is None else _merge(pa.concat_tables([held, part]), keys)
            if len(held) > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return run


def _merge(states: pa.Table, keys: list[str]) -> pa.Table:
    """One state per key, in the order in which the keys first come."""
    merged = states.group_by(keys, use_threads=False).aggregate([("n", "sum"), ("low", "min"), ("high", "max")])
    return merged.select([*keys, "n_sum", "low_min", "high_max"]).rename_columns([*keys, "n", "low", "high"])


def _fold(keys: list[str]):
    """One state per key of a sorted partition, marked where the key may continue in a neighbouring partition."""

    def run(batches: Iterable[pa.RecordBatch]):
        held: pa.Table | None = None
        first = True
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            states = _merge(rows if held is None else pa.concat_tables([held, rows]), keys)
            held, done = states.slice(max(0, len(states) - 1)), states.slice(0, max(0, len(states) - 1))
            if len(done):
                edge = np.zeros(len(done), dtype=bool)
                edge[0] = first
                first = False
                yield from done.append_column("edge", pa.array(edge)).to_batches()
        if held is not None and len(held):
            yield from held.append_column("edge", pa.array([True] * len(held))).to_batches()

    return run


def summarise_by_key(rows: DataFrame, keys: Sequence[str], order: str, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """Rows, smallest and largest ``order`` of each key: columns ``keys``, ``n`` (long), ``low``, ``high``.

    ``keys`` may not be named ``n``, ``low``, ``high`` or ``edge``. Null is a key of its own (as in GROUP BY); an ``order`` that is null counts in ``n`` but in neither end; an
    empty input gives no rows; repeated rows count each. Other columns of the input are not read. ``order`` is a long.

    Every input partition first folds its rows to one state per key it holds. The states are placed by sampled
    quantiles of (key, lowest order), which splits what is left of a heavy key, folded again in sorted order, and
    the states at partition ends are stitched; interior keys are finished where they are.
    """
    keys = list(keys)
    spark = rows.sparkSession
    parts = parts or partitions(spark)
    picked = rows.select(*keys, F.col(order).cast("long").alias("_order"))
    key_fields = [f for f in picked.schema.fields if f.name in keys]
    state = T.StructType([*key_fields, T.StructField("n", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    partial = picked.mapInArrow(_combine(keys, "_order"), state)
    placed = partial.repartitionByRange(parts, *keys, "low").sortWithinPartitions(*keys, "low")
    edge = T.StructType([*state.fields, T.StructField("edge", T.BooleanType())])
    folded = scratch.save(placed.mapInArrow(_fold(keys), edge))
    # Only a partition's first and last key can go on next door: at most two states per partition are merged here.
    ends = folded.where("edge").groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return folded.where("not edge").select(*ends.columns).unionByName(ends)


def heavy_keys(summary: DataFrame, total: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """The keys of a summary whose ``n`` is at least ``share`` of ``total.total`` (joined on the columns both have)."""
    on = [c for c in total.columns if c != "total" and c in keys]
    joined = summary.join(F.broadcast(total), on) if on else summary.crossJoin(F.broadcast(total))
    exact = Fraction(str(share))  # whole numbers, so that a key on exactly the share is heavy
    return joined.where((F.col("n") * exact.denominator >= F.col("total") * exact.numerator) & (F.col("total") > 0))


def _scan(keys: list[str], sums: list[str], fills: list[str]):
    def run(batches: Iterable[pa.RecordBatch]):
        pid = TaskContext.get().partitionId()
        last: tuple | None = None
        count, row = 0, 0
        total = dict.fromkeys(sums, 0)
        kept: dict[str, int | None] = dict.fromkeys(fills)
        first_run = True
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            starts = _starts(batch, keys)
            goes_on = last is not None and _key_at(batch, keys, 0) == last
            if last is not None and not goes_on:
                first_run = False
            run_no = np.cumsum(starts) - 1
            begin = np.flatnonzero(starts)
            index = np.arange(size)
            continued = (run_no == 0) & goes_on
            position = index - begin[run_no] + np.where(continued, count, 0)
            added = [pa.array(position)]
            for name in sums:
                values = batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
                before = np.concatenate([[0], np.cumsum(values)[:-1]])
                before = before - before[begin][run_no] + np.where(continued, total[name], 0)
                total[name] = int(before[-1] + values[-1])
                added.append(pa.array(before))
            for name in fills:
                valid = batch.column(name).is_valid().to_numpy(zero_copy_only=False)
                values = batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
                at = np.maximum.accumulate(np.where(valid, index, -1))
                inside = at >= begin[run_no]
                out = np.where(inside, values[np.maximum(at, 0)], 0)
                known = inside.copy()
                if kept[name] is not None:
                    out, known = np.where(continued & ~inside, kept[name], out), known | continued
                kept[name] = int(out[-1]) if known[-1] else None
                added.append(pa.array(out, mask=~known))
            added += [pa.array(np.full(size, pid)), pa.array(index + row), pa.array((run_no == 0) & first_run)]
            last, row, count = _key_at(batch, keys, size - 1), row + size, int(position[-1]) + 1
            if run_no[-1] > 0:
                first_run = False
            names = [*batch.schema.names, "_pos", *(f"_sum_{c}" for c in sums), *(f"_last_{c}" for c in fills), "_pid", "_row", "_edge"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return run


def range_scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scratch: Scratch,
    sums: Sequence[str] = (),
    fills: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Walks each key's rows in order without ever holding a key in one task.

    Adds ``_pos`` (position within the key, from 0), ``_sum_<c>`` for each of ``sums`` (sum of the rows before this
    one; null counts 0; longs) and ``_last_<c>`` for each of ``fills`` (latest non-null value up to and with this row;
    longs). Rows equal in key and order may take either place; give an order that is total where that matters. Nulls
    sort first and form a key. An empty input gives an empty result. Column names starting with ``_pos``, ``_sum_``,
    ``_last_``, ``_pid``, ``_row``, ``_edge`` are reserved.
    """
    keys, order, sums, fills = list(keys), list(order), list(sums), list(fills)
    spark = rows.sparkSession
    parts = parts or partitions(spark)
    long = T.LongType()
    added = [T.StructField("_pos", long), *(T.StructField(f"_sum_{c}", long) for c in sums), *(T.StructField(f"_last_{c}", long) for c in fills)]
    schema = T.StructType([*rows.schema.fields, *added, T.StructField("_pid", long), T.StructField("_row", long), T.StructField("_edge", T.BooleanType())])
    placed = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    local = scratch.save(placed.mapInArrow(_scan(keys, sums, fills), schema))
    state = [F.col("_pos").alias("_pos"), *(F.col(f"_sum_{c}") + F.coalesce(F.col(c), F.lit(0)) for c in sums), *(F.col(f"_last_{c}") for c in fills)]
    named = F.struct(*[F.col(k) for k in keys])
    ends = (
        local.groupBy("_pid")
        .agg(F.min_by(named, "_row").alias("head"), F.max_by(named, "_row").alias("tail"), F.max_by(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(state)]), "_row").alias("state"))
        .orderBy("_pid")
        .collect()
    )  # one row per partition
    carry_key, carry = None, None
    offsets = []
    for end in ends:
        same = carry is not None and end["head"] == carry_key
        offsets.append((end["_pid"], *(carry if same else [0] * (1 + len(sums)) + [None] * len(fills))))
        own = list(end["state"])
        own[0] += 1
        if same and end["head"] == end["tail"]:
            own = [a + b for a, b in zip(own[: 1 + len(sums)], carry)] + [b if a is None else a for a, b in zip(own[1 + len(sums) :], carry[1 + len(sums) :])]
        carry_key, carry = end["tail"], own
    names = ["_pos", *(f"_sum_{c}" for c in sums)]
    offset = spark.createDataFrame(offsets, T.StructType([T.StructField("_pid", long), *(T.StructField(f"_o{i}", long) for i in range(1 + len(sums) + len(fills)))]))
    joined = local.join(F.broadcast(offset), "_pid", "left")
    for i, name in enumerate(names):
        joined = joined.withColumn(name, F.col(name) + F.when(F.col("_edge"), F.col(f"_o{i}")).otherwise(0))
    for i, c in enumerate(fills, start=len(names)):
        joined = joined.withColumn(f"_last_{c}", F.coalesce(F.col(f"_last_{c}"), F.when(F.col("_edge"), F.col(f"_o{i}"))))
    return joined.select(*rows.columns, *[f.name for f in added])


def heavy_light_join(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (unique on ``key``), where the listed heavy keys of ``left`` are not shuffled.

    ``heavy`` is a bounded list (at most 1/share keys); their rows of ``right`` are broadcast, all others are joined
    by a shuffle. ``how``: inner, left, left_semi or left_anti. Null keys never match.
    """
    if not heavy:
        return left.join(right, key, how)
    is_heavy = F.col(key).isin(heavy)
    hot = left.where(is_heavy).join(F.broadcast(right.where(is_heavy)), key, how)
    rest = left.where(~F.coalesce(is_heavy, F.lit(False))).join(right.where(~is_heavy), key, how)
    return hot.unionByName(rest)
