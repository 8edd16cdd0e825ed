"""Vectors scored against a stated set of exemplars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veilworks.sources.shared import cut
from veilworks.sources.tables import spread

#: Bytes of a block of vectors, and how many blocks are broadcast; more meet the rows' blocks by a product.
BLOCK, BROADCAST_BLOCKS = 1 << 20, 64
#: Exemplars and negatives that a scorer may have, since each row meets each of them.
MOST = 1_000_000
#: Rows whose similarities a task holds at a time.
ROWS = 256
TOP = 3


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (width, n, data, the other columns as lists) of rows (v, ...), those of one block of one width: -1 for a vector that is null or holds a null."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        v = batch.column("v")
        inner = v.flatten()
        holes = np.concatenate([[0], np.cumsum(np.asarray(inner.is_null()), dtype=np.int64)])
        sizes = np.asarray(pc.fill_null(pc.list_value_length(v), 0), np.int64)
        ends = np.cumsum(sizes)
        width = np.where(np.asarray(v.is_valid()) & (holes[ends] == holes[ends - sizes]), sizes, -1)
        values = np.asarray(pc.fill_null(inner, 0.0), np.float64)
        others = [c for c in batch.schema.names if c != "v"]
        groups = rows.select([c for c in others if c != "vec_id"]).append_column("width", pa.array(width)).append_column("__row", pa.array(np.arange(len(width))))
        for group in groups.group_by([c for c in groups.column_names if c != "__row"]).aggregate([("__row", "list")]).to_pylist():
            at, w = np.array(group["__row_list"]), group["width"]
            each = max(1, BLOCK // (8 * max(w, 8)))
            for k in range(0, len(at), each):
                own = at[k : k + each]
                data = values[(ends[own] - sizes[own])[:, None] + np.arange(max(w, 0))].tobytes()
                columns = {"width": pa.array([w], pa.int32()), "n": pa.array([len(own)], pa.int32()), "data": pa.array([data], pa.binary())}
                for c in others:
                    columns[c] = pa.array([batch.column(c).take(pa.array(own)).to_pylist()], pa.list_(batch.schema.field(c).type)) if c == "vec_id" else pa.array([group[c]], batch.schema.field(c).type)
                yield pa.RecordBatch.from_pydict(columns)


def _tops(key: pa.DataType, label: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each row of a pair of blocks the TOP highest similarities with the other block's vectors, each added up in the order of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                n, w, m = r["n"], r["width"], r["k_n"]
                best = np.zeros((n, 0))
                if w == r["k_width"] >= 0:
                    a, b = np.frombuffer(r["data"]).reshape(n, w), np.frombuffer(r["k_data"]).reshape(m, w)
                    most = 1 if r["negative"] else TOP
                    best = np.concatenate([_highest(a[k : k + ROWS], b, most) for k in range(0, n, ROWS)])
                sizes = np.arange(n + 1, dtype=np.int32) * best.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["pack"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(r["vec_id"], key), pa.array([r["negative"]] * n), pa.array([r["label"]] * n, label), pa.ListArray.from_arrays(pa.array(sizes), pa.array(best.ravel()))],
                    ["pack", "at", "vec_id", "negative", "label", "vs"],
                )

    return run


def _highest(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The highest similarities of each of a with those of b; which they are is told by a product of matrices, what they are by sums in order."""
    with np.errstate(all="ignore"):
        near = a @ b.T
        at = np.argpartition(near, len(b) - most, axis=1)[:, -most:] if len(b) > most else np.broadcast_to(np.arange(len(b)), near.shape)
        chosen, out = b[at], np.zeros(at.shape)
        for j in range(a.shape[1]):
            out += a[:, None, j] * chosen[:, :, j]
    return out


def scored(rows: DataFrame, exemplars: DataFrame, negatives: DataFrame) -> DataFrame:
    """(vec_id, guess, score) of rows (vec_id, v): the label whose TOP most similar exemplars (label, v) are so on average, ties to the smaller, less the highest similarity of negatives (v).

    Blocks of rows meet blocks of exemplars, and each row's highest similarities are merged over blocks;
    rows may be of any number, and more than MOST of either of the others are an error. Similarities are scalar products in doubles; those
    with a null vector, one that holds a null or one of another length are null and take no part. Without
    negatives nothing is taken off; without exemplars there are no rows. A row is a row also where vec_id
    repeats.
    """
    for side in (exemplars, negatives):
        if side.limit(MOST + 1).count() > MOST:
            raise ValueError(f"more than {MOST} exemplars or negatives")
    key, label = dict(rows.dtypes)["vec_id"], dict(exemplars.dtypes)["label"]
    block = "width int, n int, data binary"
    packs = cut(spread(rows.select("vec_id", "v")).mapInArrow(_packed, f"{block}, vec_id array<{key}>").withColumn("pack", F.monotonically_increasing_id()))
    stated = exemplars.select("label", "v", F.lit(False).alias("negative")).unionByName(negatives.select(F.lit(None).cast(label).alias("label"), "v", F.lit(True).alias("negative")))
    known = cut(stated.repartition("negative", "label").mapInArrow(_packed, f"{block}, label {label}, negative boolean"))
    known = known.withColumnsRenamed({"width": "k_width", "n": "k_n", "data": "k_data"})
    met = spread(packs).crossJoin(F.broadcast(known) if known.count() <= BROADCAST_BLOCKS else known)
    kinds = [to_arrow_type(df.schema[c].dataType) for df, c in ((rows, "vec_id"), (exemplars, "label"))]
    tops = met.mapInArrow(_tops(*kinds), f"pack long, at int, vec_id {key}, negative boolean, label {label}, vs array<double>")
    each = tops.groupBy("pack", "at", "vec_id", "negative", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("vs")), asc=False), 1, TOP).alias("vs"))
    mean = F.when(F.size("vs") > 0, F.aggregate("vs", F.lit(0.0), lambda t, x: t + x) / F.size("vs"))
    each = each.select("pack", "at", "vec_id", "negative", F.get("vs", F.lit(0)).alias("first"), F.struct(F.round(mean, 9).alias("top"), (-F.col("label")).alias("guess")).alias("of"))
    best = each.groupBy("pack", "at", "vec_id").agg(F.max(F.when(~F.col("negative"), F.col("of"))).alias("best"), F.coalesce(F.max(F.when(F.col("negative"), F.col("first"))), F.lit(0.0)).alias("most"))
    return best.where("best is not null").select("vec_id", (-F.col("best.guess")).alias("guess"), F.round(F.col("best.top") - F.col("most"), 6).alias("score"))
