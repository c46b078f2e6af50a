"""Ordered scans that never put one key's whole history in one task.

A table is keyed by ``keys`` and ordered by a 0-based bar ordinal ``idx``. Rows are
grouped into blocks of a fixed number of bars, so the unit of work is (key, block):

* bounded frames (lags, rolling windows) copy the last rows of a block into the
  next one (``halo``), compute inside the block, and drop the copies (``own``);
* unbounded frames (fill, running product, running peak) are computed inside the
  block and combined with a carry taken from a table of one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlight.session import sized

BLOCK_ROWS_CONF = "spark.barlight.blockRows"
DEFAULT_BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Blocks:
    """How one table is cut into (key, block) groups."""

    rows: int
    keys: tuple[str, ...] = ("symbol",)
    idx: str = "idx"

    @classmethod
    def of(cls, df: DataFrame, *keys: str) -> "Blocks":
        rows = int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))
        return cls(rows, keys or ("symbol",))

    @property
    def number(self) -> Column:
        return F.floor(F.col(self.idx) / self.rows)

    def mark(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_blk", self.number)

    def halo(self, df: DataFrame, back: int, ahead: int = 0) -> DataFrame:
        """Give every block the ``back`` rows before it and the ``ahead`` rows after it."""
        first = F.floor(F.greatest(F.col(self.idx) - ahead, F.lit(0)) / self.rows)
        last = F.floor((F.col(self.idx) + back) / self.rows)
        return df.withColumn("_blk", F.explode(F.sequence(first, last)))

    def own(self, df: DataFrame) -> DataFrame:
        """Drop the copied rows again."""
        return df.where(F.col("_blk") == self.number)

    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_blk").orderBy(self.idx)

    def last(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-n, -1)

    @property
    def prefix(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def suffix(self) -> WindowSpec:
        """Rows after the current one, to the end of the block, nearest last.

        Written as a growing frame over the reversed order: a frame that shrinks towards
        the end would be summed anew for every row.
        """
        back = Window.partitionBy(*self.keys, "_blk").orderBy(F.col(self.idx).desc())
        return back.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def earlier_blocks(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)

    @property
    def later_blocks(self) -> WindowSpec:
        """Blocks after the current one, nearest last."""
        back = Window.partitionBy(*self.keys).orderBy(F.col("_blk").desc())
        return back.rowsBetween(Window.unboundedPreceding, -1)

    def carry(self, df: DataFrame, totals: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
        """Join to each row values taken from the other blocks of its key.

        ``totals`` are aggregates per block; ``carries`` are windows over the small
        table of blocks. ``df`` must hold ``_blk``.
        """
        table = df.groupBy(*self.keys, "_blk").agg(*[c.alias(name) for name, c in totals.items()])
        table = table.select(*self.keys, "_blk", *[c.alias(name) for name, c in carries.items()])
        return df.join(table, [*self.keys, "_blk"])


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str | Column] = ("date",),
    chunk: Column | None = None,
    out: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row in its key: position in its day plus rows of earlier days.

    ``total`` names a further column with the row count of the key.
    """
    chunk = F.to_date("date") if chunk is None else chunk
    rows = df.withColumn("_chunk", chunk)
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    starts = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), *counted)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        rows.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_chunk"])
        .withColumn(out, (F.col("_start") + F.col("_pos")).cast("long"))
        .drop("_chunk", "_pos", "_start")
    )


def forward_fill(df: DataFrame, columns: Sequence[str], blocks: Blocks) -> DataFrame:
    """Replace nulls by the last earlier non-null value of the same key."""
    df = blocks.mark(df)
    seen = {
        f"_l_{c}": F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(blocks.idx))) for c in columns
    }
    carried = {f"_c_{c}": F.last(f"_l_{c}", ignorenulls=True).over(blocks.earlier_blocks) for c in columns}
    df = blocks.carry(df, seen, carried)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(blocks.prefix), F.col(f"_c_{c}")) for c in columns}
    return df.withColumns(filled).drop("_blk", *[f"_c_{c}" for c in columns])


def running_product(df: DataFrame, factor: Column, out: str, blocks: Blocks) -> DataFrame:
    """Product of ``factor`` from the first row of the key to this one."""
    df = blocks.mark(df).withColumn("_f", factor)
    carried = {"_c": F.product("_p").over(blocks.earlier_blocks)}
    df = blocks.carry(df, {"_p": F.product("_f")}, carried)
    value = F.coalesce(F.col("_c"), F.lit(1.0)) * F.product("_f").over(blocks.prefix)
    return df.withColumn(out, value).drop("_blk", "_f", "_c")


def running_peak(df: DataFrame, value: str, out: str, blocks: Blocks) -> DataFrame:
    """Largest ``value`` from the first row of the key to this one."""
    df = blocks.mark(df)
    carried = {"_c": F.max("_m").over(blocks.earlier_blocks)}
    df = blocks.carry(df, {"_m": F.max(value)}, carried)
    return df.withColumn(out, F.greatest(F.max(value).over(blocks.prefix), F.col("_c"))).drop("_blk", "_c")


def later_total(df: DataFrame, value: str, out: str, blocks: Blocks) -> DataFrame:
    """Sum of ``value`` over the rows after this one."""
    df = blocks.mark(df)
    carried = {"_c": F.sum("_s").over(blocks.later_blocks)}
    df = blocks.carry(df, {"_s": F.sum(value)}, carried)
    local = F.coalesce(F.sum(value).over(blocks.suffix), F.lit(0.0))
    return df.withColumn(out, local + F.coalesce(F.col("_c"), F.lit(0.0))).drop("_blk", "_c")


def row_chunk(df: DataFrame, size: int, out: str = "chunk", idx: str = "idx") -> DataFrame:
    """Number of the fixed-length run of rows a row falls in."""
    return df.withColumn(out, F.floor(F.col(idx) / size).cast("long"))


def evenly_spaced(idx: Column, total: Column, points: int) -> Column:
    """True for the rows at the truncated positions of ``points`` even steps from first to last."""
    if points < 2:
        return idx == 0
    step = (total - 1) / F.lit(float(points - 1))
    nearest = F.least(F.ceil(F.try_divide(idx, step)), F.lit(points - 1))
    hit = F.when(nearest == points - 1, total - 1).otherwise(F.floor(nearest * step))
    previous = F.floor(F.greatest(nearest - 1, F.lit(0)) * step)
    following = F.when(nearest + 1 >= points - 1, total - 1).otherwise(F.floor((nearest + 1) * step))
    return (total <= points) | (hit == idx) | (previous == idx) | (following == idx)


def thin(df: DataFrame, points: int, keys: Sequence[str] = ("symbol",), idx: str = "idx") -> DataFrame:
    """Keep ``points`` evenly spaced rows per key, first and last included.

    ``idx`` must run from 0 without holes, so the row count of a key is its largest
    ``idx`` plus one.
    """
    totals = sized(df.groupBy(*keys).agg((F.max(idx) + 1).alias("_total")))
    return df.join(totals, list(keys)).where(evenly_spaced(F.col(idx), F.col("_total"), points)).drop("_total")


def stride(df: DataFrame, max_points: int, keys: Sequence[str] = ("symbol",), idx: str = "idx") -> DataFrame:
    """Keep every k-th row, k = rows div max_points; all rows when there are no more than that."""
    totals = sized(df.groupBy(*keys).agg((F.max(idx) + 1).alias("_total")))
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / max_points))
    keep = (F.col("_total") <= max_points) | (F.col(idx) % step == 0)
    return df.join(totals, list(keys)).where(keep).drop("_total")
