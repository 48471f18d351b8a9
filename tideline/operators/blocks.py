"""Long channels in blocks: samples packed as arrays, and scans that no task does for a whole channel.

A scan has two levels. Blocks of rows are summed up, each in its own group; the small table of blocks
is scanned in order, a row for each block; what it gives is carried back into the rows of the
blocks. Blocks follow from the samples' numbers where these are even, else from sampled range
partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.files import written

#: Samples of a block.
BLOCK = 65_536


def block_of(size: int = BLOCK) -> Column:
    return F.floor(F.col("sample_ix") / size).cast("long")


def beside(rows: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of an aggregate. That is written first, so that Spark knows its size when it plans the join."""
    return rows.join(written(small), [*keys])


def as_list(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))


def as_lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def as_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = pa.chunked_array([c.flatten() for c in column.chunks], pa.float64()).to_numpy()
    return flat.reshape(len(column), -1)


def packed(samples: DataFrame, size: int = BLOCK, halo: int = 0) -> DataFrame:
    """A row for each shot, channel and block: sample_ix, t and value as arrays by number.

    A block has the samples from block * size on, ``size`` and ``halo`` more; the halo is also in the
    next block.
    """
    if halo > size:
        raise ValueError("the halo is longer than a block")
    kinds = dict(samples.dtypes)
    own = block_of(size)
    both = F.when(F.col("sample_ix") - own * size < halo, F.array(own - 1, own)).otherwise(F.array(own)) if halo else F.array(own)
    rows = samples.select("shot", "ch_ix", F.col("sample_ix").cast("long"), F.col("t").cast("double"), F.col("value").cast("double"), F.explode(both).alias("block"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = table["sample_ix"].to_numpy()
        order = np.argsort(at, kind="stable")
        lists = {c: as_list(table[c].to_numpy()[order], k) for c, k in (("sample_ix", pa.int64()), ("t", pa.float64()), ("value", pa.float64()))}
        return pa.table({"shot": pa.array([key[0].as_py()], key[0].type), "ch_ix": pa.array([key[1].as_py()], key[1].type), "block": pa.array([key[2].as_py()], pa.int64()), **lists})

    return rows.groupBy("shot", "ch_ix", "block").applyInArrow(run, f"shot {kinds['shot']}, ch_ix {kinds['ch_ix']}, block long, sample_ix array<long>, t array<double>, value array<double>").where("block >= 0")


def arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The rows of a list column, without copies."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def prefix_sums(rows: DataFrame, keys: tuple[str, ...], block: str, order: tuple, **sums: Column) -> DataFrame:
    """Rows with running sums, their own value included: within each block by a window, before it from the table of blocks."""
    totals = rows.groupBy(*keys, block).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, block, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in sums])
    so_far = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = beside(rows, carried, *keys, block)
    out = out.select("*", *[F.sum(c).over(so_far).alias(f"__inside_{n}") for n, c in sums.items()])
    out = out.select("*", *[(F.col(f"__before_{n}") + F.coalesce(F.col(f"__inside_{n}"), F.lit(0))).alias(n) for n in sums])
    return out.drop(*[f"__{p}_{n}" for p in ("before", "inside") for n in sums])


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``__block``, the number of a range of the order of columns, written to the shared folder.

    The ranges come from a sample and are about equally long, however the values lie; rows that are equal in all
    of ``order`` are in one.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).withColumn("__block", F.spark_partition_id().cast("long")))


def numbered(rows: DataFrame, *order: str, name: str = "place", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows with dense places from 0 in the order of columns (within ``keys``); no window reaches over more than a range of the rows."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    spread = ranged(tied, *keys, *order, "__tie")
    scanned = prefix_sums(spread.withColumn("__all", F.lit(0)), keys or ("__all",), "__block", (*order, "__tie"), __place=F.lit(1))
    return scanned.withColumn(name, F.col("__place").cast("long") - 1).drop("__all", "__tie", "__block", "__place")


def neighbours(rows: DataFrame, keys: tuple[str, ...], at: str, second: str, known: Column) -> DataFrame:
    """Rows with lo and hi: the last known value (not null) up to each row and the first one from it on, by ``at``; of equal ones the smaller ``second`` is first for both.

    Ranges of the rows are windows of their own. The table of ranges has the last and the first
    known value of each, which reach into the ranges behind and before that have none.
    """
    spread = ranged(rows.withColumn("__known", known), *keys, at, second)
    place = F.when(F.col("__known").isNotNull(), F.struct(at, second))
    ends = spread.groupBy(*keys, "__block").agg(F.max_by("__known", place).alias("__last"), F.min_by("__known", place).alias("__first"))
    w = Window.partitionBy(*keys)
    carried = ends.select(
        *keys, "__block", F.last("__last", ignorenulls=True).over(w.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.last("__first", ignorenulls=True).over(w.orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("__behind"),
    )
    inside = Window.partitionBy(*keys, "__block")
    up, down = (F.last("__known", ignorenulls=True).over(inside.orderBy(*o)) for o in ((F.col(at), F.col(second)), (F.col(at).desc(), F.col(second))))
    out = beside(spread, carried, *keys, "__block").withColumn("lo", up).withColumn("hi", down)
    return out.withColumn("lo", F.coalesce("lo", "__before")).withColumn("hi", F.coalesce("hi", "__behind")).drop("__block", "__before", "__behind", "__known")
