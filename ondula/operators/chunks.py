"""Recordings in chunks: what a step does to a recording of any length, without a group that holds it.

A recording is cut by index into chunks of a fixed number of samples. Chunks are dealt like keys, so that one long recording spreads over the cluster as many short ones do, and
a task reads its chunks as one sorted stream. What a chunk must know of the others comes to it as rows of its own group that sort before its samples: copies of
the neighbours' samples (a halo), or a state that a pass over one small row for each chunk has carried along the recording (a scan).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ondula.functions import crests, kernels
from ondula.functions.carried import Filter

#: Samples of a chunk.
CHUNK = 1 << 16
#: Rows of an Arrow batch that a stream of groups gives back.
BATCH_ROWS = 1 << 14


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by its keys, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
        first = tuple(c[0].as_py() for c in columns)
        cuts = np.flatnonzero(changed).tolist()
        if held and first != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held).combine_chunks()
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def in_groups(frame: DataFrame, keys: tuple[str, ...], order: str, work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """work(group) of every group of the keys, its rows in order, as one stream for each task."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, rows = [], 0
        for group in whole_groups(batches, keys):
            out = work(group)
            if out is None or not out.num_rows:
                continue
            made.append(out)
            rows += out.num_rows
            if rows >= BATCH_ROWS:
                yield from pa.concat_tables(made).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)
                made, rows = [], 0
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)

    return frame.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(stream, schema)


def chunked(samples: DataFrame, size: int | None = None) -> DataFrame:
    return samples.withColumn("_chunk", F.floor(F.col("idx") / F.lit(size or CHUNK)).cast("long"))


def kind_of(frame: DataFrame, *names: str) -> str:
    """The columns as a schema string."""
    return ", ".join(f"`{n}` {frame.schema[n].dataType.simpleString()}" for n in names)


def doubles(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), float("nan")).to_numpy()


def scanned(samples: DataFrame, source: str, make: Callable[[float], Filter], size: int | None = None) -> DataFrame:
    """The samples with a column _y, a linear filter over whole recordings.

    Three passes: each chunk tells what it adds to a state; one small row for each chunk of a recording carries states along it; each chunk runs from its own state.
    """
    parts = chunked(samples, size)
    slim = parts.select("rec", "_chunk", "idx", "frequency", F.col(f"`{source}`").cast("double").alias("_x"))

    def tell(group: pa.Table) -> pa.Table:
        rate, start, x = group.column("frequency")[0].as_py(), group.column("idx")[0].as_py(), doubles(group.column("_x"))
        told = make(float(rate)).summary(start, x)
        return pa.table({"rec": group.column("rec")[:1], "_chunk": group.column("_chunk")[:1], "frequency": group.column("frequency")[:1], "start": pa.array([start], pa.int64()), "n": pa.array([len(x)], pa.int64()), "told": pa.array([told], pa.list_(pa.float64()))})

    told = in_groups(slim, ("rec", "_chunk"), "idx", tell, f"{kind_of(slim, 'rec', '_chunk', 'frequency')}, start long, n long, told array<double>")

    def carry(group: pa.Table) -> pa.Table:
        own = make(float(group.column("frequency")[0].as_py()))
        states = own.carried(group.column("start").to_pylist(), group.column("n").to_pylist(), [np.array(t) for t in group.column("told").to_pylist()])
        return pa.table({"rec": group.column("rec"), "_chunk": group.column("_chunk"), "_state": pa.array([s.tolist() for s in states], pa.list_(pa.float64()))})

    states = in_groups(told, ("rec",), "_chunk", carry, f"{kind_of(slim, 'rec', '_chunk')}, _state array<double>").withColumn("idx", F.lit(-1).cast(samples.schema["idx"].dataType))
    names = samples.columns

    def finish(group: pa.Table) -> pa.Table:
        own = group.slice(1)
        rate, start = own.column("frequency")[0].as_py(), own.column("idx")[0].as_py()
        y = make(float(rate)).finish(start, doubles(own.column(source)), np.array(group.column("_state")[0].as_py()))
        return own.select(names).append_column("_y", pa.array(y, pa.float64()))

    both = parts.unionByName(states, allowMissingColumns=True)
    return in_groups(both, ("rec", "_chunk"), "idx", finish, f"{kind_of(samples, *names)}, _y double")


def lent_edges(before: int, after: int, size: int) -> Column:
    """The chunks a sample belongs to or is lent to: those whose samples it is at most `before` ahead of or `after` behind."""
    own = F.col("_chunk")
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("idx") - after) / size)).cast("long"), F.floor((F.col("idx") + before) / size).cast("long"))
    inside = F.col("idx") % size
    return F.when((inside >= after) & (inside < size - before), F.array(own)).otherwise(reach)


def haloed(samples: DataFrame, source: str, before: int, after: int, work: Callable[[np.ndarray, float, tuple[bool, bool]], np.ndarray], size: int | None = None) -> DataFrame:
    """The samples with a column _y of work(values, rate, ends), which gets a chunk's values with up to `before` samples ahead of it and `after` behind it.

    ends tells whether the recording begins and ends with these values; a halo may reach over several chunks. work returns a value for each of its values.
    """
    size = size or CHUNK
    parts = chunked(samples, size).withColumn("_home", F.col("_chunk"))
    both = parts.withColumn("_chunk", F.explode(lent_edges(before, after, size)))
    names = samples.columns

    def finish(group: pa.Table) -> pa.Table | None:
        own = pc.equal(group.column("_home"), group.column("_chunk")).to_numpy()
        if not own.any():
            return None
        places = np.flatnonzero(own)
        ends = group.column("idx")[0].as_py() == 0, len(own) - 1 - places[-1] < after
        mine = group.filter(pa.array(own)).select(names)
        y = work(doubles(group.column(source)), float(mine.column("frequency")[0].as_py()), ends)
        return mine.append_column("_y", pa.array(np.asarray(y, float)[own], pa.float64()))

    return in_groups(both, ("rec", "_chunk"), "idx", finish, f"{kind_of(samples, *names)}, _y double")


def own_order() -> WindowSpec:
    """The samples of a chunk and those lent to it."""
    return Window.partitionBy("rec", "_chunk").orderBy("idx")


def joined_up(samples: DataFrame, fill: list[str], before: int, after: int, size: int | None = None) -> DataFrame:
    """The samples in chunks for windows over `own_order`, with lent edges (_own is false), the recording's length _n, and nulls of `fill` replaced by the last known value.

    One row for each chunk of a recording carries length and values along it; it comes to the chunk as a row before its samples.
    """
    size = size or CHUNK
    parts = chunked(samples, size)
    told = parts.groupBy("rec", "_chunk").agg(F.count(F.lit(1)).alias("_n"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(c) for c in fill])
    so_far = Window.partitionBy("rec").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("rec")
    states = told.select("rec", "_chunk", F.sum("_n").over(whole).alias("_n"), *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in fill]).withColumn("idx", F.lit(-1).cast(samples.schema["idx"].dataType))
    rows = parts.withColumn("_home", F.col("_chunk")).withColumn("_chunk", F.explode(lent_edges(before, after, size))).unionByName(states, allowMissingColumns=True)
    until = own_order().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.max("_n").over(until), **{c: F.last(c, ignorenulls=True).over(until) for c in fill}})
    return rows.filter("idx >= 0").withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home")


def _split(stack: crests.Walls) -> list[pa.Array]:
    """Heights and lows of walls, each as an array of one list."""
    return [pa.array([[w[k] for w in stack]], pa.list_(pa.float64())) for k in (0, 1)]


def _joined(row: dict, side: str) -> crests.Walls:
    return list(zip(row[f"{side}_heights"], row[f"{side}_lows"], strict=True))


_WALLS = ("left_heights", "left_lows", "right_heights", "right_lows")


def crested(samples: DataFrame, source: str, sign: float, prominence: bool, size: int | None = None, flats: bool = True) -> DataFrame:
    """The samples with a column _y: of a maximum (sign -1: minimum) its prominence, or infinity if that is not asked for; null for other samples, with flats off those of plateaus too.

    As `scanned`: chunks tell their borders and walls, one small row for each chunk of a recording carries them along it, and each chunk finds its own peaks.
    """
    parts = chunked(samples, size)
    slim = parts.select("rec", "_chunk", "idx", (F.col(f"`{source}`").cast("double") * sign).alias("_x"))
    lists = ", ".join(f"{w} array<double>" for w in _WALLS)

    def tell(group: pa.Table) -> pa.Table:
        t = crests.tell(doubles(group.column("_x")))
        walls = dict(zip(_WALLS, [*_split(t.left), *_split(t.right)], strict=True))
        rest = {"start": pa.array([group.column("idx")[0].as_py()], pa.int64()), "n": pa.array([group.num_rows], pa.int64()), "edges": pa.array([t.edges], pa.list_(pa.float64())), "rests": pa.array([[t.high, t.left_rest, t.right_rest]], pa.list_(pa.float64()))}
        return pa.table({"rec": group.column("rec")[:1], "_chunk": group.column("_chunk")[:1], **rest, **walls})

    told = in_groups(slim, ("rec", "_chunk"), "idx", tell, f"{kind_of(slim, 'rec', '_chunk')}, start long, n long, edges array<double>, rests array<double>, {lists}")

    def carry(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        got = crests.carry([r["start"] for r in rows], [r["n"] for r in rows], [crests.Told(r["edges"], r["rests"][0], _joined(r, "left"), r["rests"][1], _joined(r, "right"), r["rests"][2]) for r in rows], flats)
        walls = {w: pa.array([[x[k] for x in getattr(g, side)] for g in got], pa.list_(pa.float64())) for w, side, k in zip(_WALLS, ("left", "left", "right", "right"), (0, 1, 0, 1), strict=True)}
        return pa.table({"rec": group.column("rec"), "_chunk": group.column("_chunk"), "crests": pa.array([g.crests for g in got], pa.list_(pa.int64())), **walls})

    states = in_groups(told, ("rec",), "_chunk", carry, f"{kind_of(slim, 'rec', '_chunk')}, crests array<long>, {lists}")
    states = states.select("rec", "_chunk", F.struct("crests", *_WALLS).alias("_state"), F.lit(-1).cast(samples.schema["idx"].dataType).alias("idx"))
    names = samples.columns

    def finish(group: pa.Table) -> pa.Table:
        own, state = group.slice(1), group.column("_state")[0].as_py()
        got = crests.Carried(state["crests"], _joined(state, "left"), _joined(state, "right"))
        y = crests.crests(sign * doubles(own.column(source)), own.column("idx")[0].as_py(), got, prominence, flats)
        return own.select(names).append_column("_y", pa.array(y, pa.float64(), from_pandas=True))

    both = parts.unionByName(states, allowMissingColumns=True)
    return in_groups(both, ("rec", "_chunk"), "idx", finish, f"{kind_of(samples, *names)}, _y double")


def spaced(found: DataFrame, distance: int, size: int | None = None) -> DataFrame:
    """Of the rows (rec, idx, _h) those that stay when the highest goes first and removes all that are closer than `distance`.

    A row that is the highest within the distance stays and removes its neighbours, whatever else there is; chunks see that for themselves. What is open lies between two such
    rows, at least the distance from either, so that each such stretch is a group of its own.
    """
    size = max(size or CHUNK, 1)
    parts = chunked(found.select("rec", "idx", "_h"), size).withColumn("_home", F.col("_chunk"))
    both = parts.withColumn("_chunk", F.explode(lent_edges(2 * distance, 2 * distance, size)))
    kind = kind_of(found, "rec")

    def settle(group: pa.Table) -> pa.Table:
        places = group.column("idx").to_numpy()
        status = crests.dominant(places, group.column("_h").to_numpy(), distance)
        own = pc.equal(group.column("_home"), group.column("_chunk"))
        rows = group.append_column("_status", pa.array(status, pa.int64())).append_column("_top", pa.array(np.where(status == 1, places, 0), pa.int64(), mask=status != 1))
        return rows.select(["rec", "idx", "_h", "_status", "_top"]).filter(own)

    settled = in_groups(both, ("rec", "_chunk"), "idx", settle, f"{kind}, idx long, _h double, _status long, _top long").filter("_status <> 0")
    stretches = joined_up(settled, ["_top"], 0, 0, size).filter("_own")

    def choose(group: pa.Table) -> pa.Table:
        free = group.filter(pc.equal(group.column("_status"), -1))
        keep = kernels.apart(free.column("idx").to_numpy(), free.column("_h").to_numpy(), distance)
        return free.select(["rec", "idx"]).filter(pa.array(keep))

    free = stretches.filter("_status = -1").withColumn("_top", F.coalesce("_top", F.lit(-1)))
    chosen = in_groups(free, ("rec", "_top"), "idx", choose, f"{kind}, idx long")
    return settled.filter("_status = 1").select("rec", "idx").unionByName(chosen)
