"""Trees that fit into a task, many at a time: groups of whole trees as Arrow tables, folds on their arrays.

A task gets all rows of its trees one after another and works on some thousands of them at once, so there is
one exchange and no overhead for a tree. Trees of more than ``GROUP`` nodes are not for this module.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Nodes of the largest tree that one task takes as a whole.
GROUP = 200_000
#: Rows that are worked on at once, and more where a group has more.
CHUNK = 30_000
_KINDS = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean"}


def starts_of(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Row numbers at which the key changes, 0 first."""
    if not t.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        a = t[k].combine_chunks()
        a, b = a.slice(1), a.slice(0, len(a) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = CHUNK) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts) of whole groups, about ``rows`` rows at a time, of batches in which groups lie together."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, rows
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < limit:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = starts_of(t, keys)
        if at[-1]:
            yield t.slice(0, at[-1]).combine_chunks(), at[:-1]
        held = t.slice(at[-1]).to_batches()
        size = t.num_rows - int(at[-1])
        limit = max(rows, 2 * size)  # a long group is not looked through again for every batch
    if size:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts_of(t, keys)


def in_groups(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fn: Callable[[pa.Table, np.ndarray], pa.Table | Iterator[pa.Table]], schema: str | StructType, rows: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """``fn(table, starts)`` over whole groups of equal ``keys`` whose rows are in ``order``; it returns a table of ``schema``, or some.

    With ``tasks`` the groups are spread over so many tasks, for work that takes long for its bytes.
    """
    d = df.repartition(tasks, *keys) if tasks else df
    # the window brings a group's rows together, and needs no exchange where they are; other windows may move above it, hence the sort
    placed = d.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole(batches, keys, rows):
            out = fn(t, starts)
            for part in [out] if isinstance(out, pa.Table) else out:
                yield from part.to_batches()

    return placed.mapInArrow(run, schema)


def spread(df: DataFrame) -> int:
    """Tasks for work that takes long for its bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbers(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().to_numpy(zero_copy_only=False)


def with_nulls(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether null)."""
    a = t[name].combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    null = a.is_null().to_numpy(zero_copy_only=False)
    return (a.fill_null(False if pa.types.is_boolean(a.type) else 0) if null.any() else a).to_numpy(zero_copy_only=False), null


def parent_rows(starts: np.ndarray, ids: np.ndarray, up: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Row number of the node named by ``up`` in the same tree, -1 where there is none. Ids rise within a tree."""
    n = len(ids)
    tree = np.repeat(np.arange(len(starts), dtype=np.int64), np.diff(np.append(starts, n)))
    key = (tree << 32) + (ids.astype(np.int64) + 2**31)
    want = (tree << 32) + (up.astype(np.int64) + 2**31)
    at = np.minimum(np.searchsorted(key, want), max(n - 1, 0))
    return np.where(none | (key[at] != want), -1, at) if n else at


_Value = tuple[np.ndarray, np.ndarray]


def _join(how: str, a: _Value, b: _Value) -> _Value:
    """As ``topology._JOIN`` on (values, nulls): a is nearer to the node."""
    (x, p), (y, q) = a, b
    if how == "sum":
        return x + y, p | q
    if how in ("max", "min"):
        return np.where(p, y, np.where(q, x, np.maximum(x, y) if how == "max" else np.fmin(x, y))), p & q
    if how == "or":
        yes = (x & ~p) | (y & ~q)
        return yes, ~yes & (p | q)
    if how == "and":
        no = (~x & ~p) | (~y & ~q)
        return ~no, ~no & (p | q)
    if how == "first":
        return np.where(p, y, x), p & q
    return np.where(q, x, y), p & q  # last


def climbed(starts: np.ndarray, up: np.ndarray, values: dict[str, tuple[_Value, str]]) -> tuple[np.ndarray, dict[str, _Value]]:
    """Folds from every row over its way along ``up``: (row where the way ends, -1 on a cycle; folds)."""
    n = len(up)
    anc, top = up.copy(), np.arange(n)
    out = {k: v for k, (v, _) in values.items()}
    rounds = int(np.diff(np.append(starts, n)).max(initial=1) - 1).bit_length()
    live = np.flatnonzero(anc >= 0)
    for _ in range(rounds):
        if not len(live):
            break
        to = anc[live]
        for k, (_, how) in values.items():
            v, null = out[k]
            nv, nn = _join(how, (v[live], null[live]), (v[to], null[to]))
            v, null = v.copy(), null.copy()
            v[live], null[live] = nv, nn
            out[k] = v, null
        top[live], anc[live] = top[to], anc[to]
        live = live[anc[live] >= 0]
    top[live] = -1
    return top, out


def gathered(starts: np.ndarray, up: np.ndarray, values: dict[str, tuple[_Value, str]]) -> dict[str, _Value]:
    """Folds over the rows below every row, itself included; nulls below are left out."""
    n = len(up)
    one = np.where(up >= 0, 1, 0)
    top, d = climbed(starts, up, {"d": ((one, np.zeros(n, bool)), "sum")})
    depth = np.where(top >= 0, d["d"][0], 0)
    order = np.argsort(depth, kind="stable")
    ends = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[ends[k] : ends[k + 1]] for k in range(len(ends) - 2, 0, -1)]
    out = {}
    for k, ((v, null), how) in values.items():
        if how == "sum":
            acc = np.where(null, 0, v)
            for rows in levels:
                np.add.at(acc, up[rows], acc[rows])
            out[k] = acc, null
        elif how in ("or", "and"):
            # true (false) anywhere decides
            hit = (v if how == "or" else ~v) & ~null
            for rows in levels:
                hit[up[rows[hit[rows]]]] = True
            out[k] = (hit if how == "or" else ~hit), null & ~hit
        else:
            acc, some = v.copy(), ~null
            f = np.maximum if how == "max" else np.fmin
            for rows in levels:
                rows = rows[some[rows]]
                first = ~some[up[rows]]
                acc[up[rows[first]]] = acc[rows[first]]
                some[up[rows]] = True
                f.at(acc, up[rows], acc[rows])
            out[k] = acc, ~some
    return out


def can(state: DataFrame, values: dict[str, tuple[Column, str]]) -> bool:
    """Whether arrays can hold the ids and the values of a fold."""
    kinds = dict(state.dtypes)
    return kinds["id"] in ("tinyint", "smallint", "int") and kinds["_anc"] in ("tinyint", "smallint", "int") and all(kinds[n] in _KINDS and how != "concat" for n, (_, how) in values.items())


def large_trees(nodes: DataFrame) -> DataFrame | None:
    """(tree_id) of the trees of more than ``GROUP`` nodes, None if there are none."""
    large = nodes.groupBy("tree_id").count().where(F.col("count") > GROUP).select("tree_id")
    found = [r[0] for r in large.limit(1001).collect()]
    if not found:
        return None
    return nodes.sparkSession.createDataFrame([(x,) for x in found], large.schema) if len(found) <= 1000 else large


def fold(state: DataFrame, values: dict[str, str], up: bool) -> DataFrame:
    """state with the folds in place of the values, and ``top`` when folding upwards.

    state: (tree_id, id, _anc, <values>, ...); _anc is null where a way ends.
    """
    kinds = {f.name: f.dataType for f in state.schema}
    schema = StructType()
    for f in state.schema:
        if f.name != "_anc":
            # a sum of integers over a subtree is long, as Spark's is
            wide = not up and values.get(f.name) == "sum" and f.dataType.typeName() in ("byte", "short", "integer")
            schema = schema.add(f.name, "long" if wide else "double" if not up and values.get(f.name) == "sum" and f.dataType.typeName() == "float" else f.dataType)
    if up:
        schema = schema.add("top", kinds["id"])
    names = schema.fieldNames()

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        ids = numbers(t, "id")
        anc, none = with_nulls(t, "_anc")
        gone = t["tree_id"].is_null().to_numpy() | none if t["tree_id"].null_count else none
        par = parent_rows(starts, ids, anc, gone)
        vs = {}
        for k, how in values.items():
            v, null = with_nulls(t, k)
            vs[k] = ((v.astype(np.int64) if how == "sum" and v.dtype.kind == "i" else v.astype(np.float64) if how == "sum" and v.dtype.kind == "f" else v), null), how
        cols = {c: t[c] for c in names if c in t.column_names}
        if up:
            top, out = climbed(starts, par, vs)
            cols["top"] = pa.array(ids[np.maximum(top, 0)] if len(ids) else ids, t["id"].type, mask=top < 0)
        else:
            out = gathered(starts, par, vs)
        for k, (v, null) in out.items():
            kind = t[k].type
            if not up and values[k] == "sum":
                kind = pa.int64() if pa.types.is_integer(kind) else pa.float64()
            cols[k] = pa.array(v, mask=null).cast(kind)
        return pa.table([cols[c] for c in names], names)

    return in_groups(state, ("tree_id",), ("id",), run, schema)
