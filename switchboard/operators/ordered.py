"""Row order inside a key without one task per key.

Calls are sequences, and one call may hold a large share of all rows.  Ordered
operators therefore never put a whole key into one window partition: a key is
cut into blocks of consecutive rows, windows run per (key, block), and what a
block needs from the blocks before it is passed on separately:

* ``with_halo`` repeats the last ``n`` rows before a block in front of it, for
  operators that look back a fixed number of rows (previous row, rolling mean);
* windows over one summary row per block (``earlier_blocks``) fold the blocks before it, for running
  totals.

Both only move one small summary row per block between blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
BLOCK = "_block"
HALO = "_halo"


def has_long_keys(df: DataFrame, seq: str, size: int = BLOCK_ROWS) -> bool:
    """Whether any row lies beyond the first block.

    One cheap probe: the comparison reaches the scan, so parquet row groups
    without such rows are skipped by their statistics.
    """
    return not df.where(F.col(seq) >= size).select(seq).limit(1).isEmpty()


def cut(df: DataFrame, seq: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Adds the block number of a dense integer sequence (turn number, id)."""
    return df.withColumn(BLOCK, F.floor(F.col(seq) / F.lit(size)).cast("bigint"))


def cut_time(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Adds the block number of a time column."""
    return df.withColumn(BLOCK, F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("bigint"))


def window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def running(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
              payload: Sequence[str]) -> DataFrame:
    """Rows plus, before each later block, the ``n`` rows preceding it.

    Repeated rows carry ``_halo = true`` and only ``payload`` and the order
    columns; drop them after the window has run.
    """
    newest = Window.partitionBy(*keys, BLOCK).orderBy(*[F.col(c).desc() for c in order])
    kept = list(dict.fromkeys([*order, *payload]))
    tails = (df.select(*keys, BLOCK, *kept)
             .withColumn("_rank", F.row_number().over(newest))
             .where(F.col("_rank") <= n))
    per_key = Window.partitionBy(*keys).orderBy(BLOCK, *order)
    before = per_key.rowsBetween(-n, -1)
    first_of_block = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order)) == 1
    halo = (tails.withColumn("_before", F.collect_list(F.struct(*kept)).over(before))
            .withColumn("_first", first_of_block)
            .where("_first and size(_before) > 0")
            .select(*keys, BLOCK, F.inline("_before"))
            .withColumn(HALO, F.lit(True)))
    return df.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)


def earlier_blocks(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def sequence_rows(df: DataFrame, keys: Sequence[str], seq: str, look_back: int,
                  payload: Sequence[str], long_keys: bool | None = None,
                  size: int = BLOCK_ROWS) -> DataFrame:
    """``df`` cut into blocks with a halo, or one block per key if none is longer.

    Below ``size`` rows per key a window partition is bounded as it is, and no
    further pass over the data is needed.
    """
    if long_keys is None:
        long_keys = has_long_keys(df, seq, size)
    if not long_keys:
        return df.withColumns({BLOCK: F.lit(0).cast("bigint"), HALO: F.lit(False)})
    return with_halo(cut(df, seq, size), keys, [seq], look_back, payload)
