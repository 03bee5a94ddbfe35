"""Windows over pieces of a key, and ranks of values within trailing windows of any length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.session import ship


def in_pieces(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], back_us: int, width_us: int, time: str = "interval_start", key: str = "symbol") -> DataFrame:
    """``compute(rows)``, where a row's result depends on no row of its key more than ``back_us`` before it.

    Each key's time is cut into pieces of ``width_us``. A piece gets the rows that it can see before it, and takes the key's place: whatever
    windows ``compute`` has by ``key`` are windows of a piece, so a busy key is as many tasks as it has pieces. ``compute``
    must keep all columns. Rows that a piece only sees are dropped at the end.
    """
    at = F.unix_micros(time)
    piece, last = F.floor(at / F.lit(width_us)), F.floor((at + back_us) / F.lit(width_us))
    dealt = rows.withColumn("_piece", F.explode(F.coalesce(F.sequence(piece, last), F.array(piece)))).withColumn("_own", F.col("_piece").eqNullSafe(piece))
    out = compute(dealt.withColumn(key, F.struct(F.col(key).alias("key"), "_piece"))).where("_own")
    return out.withColumn(key, F.col(key)["key"]).drop("_piece", "_own")


def visible_counts(rows: DataFrame, window_us: int, time: str = "event_time", key: str = "symbol", width_us: int | None = None) -> DataFrame:
    """Adds ``n_visible``: the key's rows in ``(t - window, t]`` at each row's time.

    The rows up to the one time less those up to the other: two counts that only grow, so a row costs the same however many a window
    holds. Keys are cut into pieces of time, four windows wide by default. Rows without a time see each other.
    """

    def compute(piece: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy("_us")
        upto = lambda us: F.count("*").over(w.rangeBetween(Window.unboundedPreceding, us))
        return piece.withColumn("n_visible", upto(0) - F.when(F.col("_us").isNull(), 0).otherwise(upto(-window_us)))

    return in_pieces(rows.withColumn("_us", F.unix_micros(time)), compute, window_us, width_us or 4 * window_us, time, key).drop("_us")


class Wavelet:
    """Ranks as bits, the highest first: each level has, for each place, how many zeros stand before it, and is then parted by its bit.

    Counting the values below some value in a span follows the span's ends through the levels. All spans go
    down together, so a count costs the logarithm of the number of values, however long its span is.
    """

    def __init__(self, ranks: np.ndarray):
        self.levels = []
        self.top = max(1, int(ranks.max(initial=0)).bit_length())
        for b in reversed(range(self.top)):
            bit = (ranks >> b) & 1
            self.levels.append((b, np.concatenate([[0], np.cumsum(1 - bit)])))
            ranks = np.concatenate([ranks[bit == 0], ranks[bit == 1]])

    def less(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many ranks in each ``[low, high)`` are below ``than``, one number for each span."""
        out = np.zeros(len(low), np.int64)
        beyond = than >= 1 << self.top
        out[beyond] = (high - low)[beyond]
        for b, zeros in self.levels:
            l, h = zeros[low], zeros[high]
            one = ((than >> b) & 1) == 1
            out += np.where(one & ~beyond, h - l, 0)
            n = zeros[-1]
            low, high = np.where(one, n + low - l, l), np.where(one, n + high - h, h)
        return out


def trailing_ranks(rows: DataFrame, by: Sequence[str], order: Sequence[str], x: str, spans: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds ``_size, _n, _less, _equal``: of each row's window its rows, its values, and how many are less than or equal to the row's own.

    ``spans(rows)`` gives each row's window as places in the group's rows, which come in order. ``_less`` and ``_equal`` of
    a null mean nothing. A group is one task's, so cut busy keys into pieces first (``in_pieces``).
    """
    ship(rows.sparkSession)
    sort = [(c, "ascending") for c in order]

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(sort)
        values = rows.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = ~np.isnan(values)
        low, high = spans(rows)
        before = np.concatenate([[0], np.cumsum(known)])
        low, high, all_ = before[low], before[high], high - low  # places among the values
        ranks = np.searchsorted(np.unique(values[known]), values)
        tree = Wavelet(ranks[known])
        less = tree.less(low, high, ranks)
        found = {"_size": all_, "_n": high - low, "_less": less, "_equal": tree.less(low, high, ranks + 1) - less}
        for name, column in found.items():
            rows = rows.append_column(name, pa.array(column, pa.int64()))
        return rows

    more = [StructField(n, LongType()) for n in ("_size", "_n", "_less", "_equal")]
    return rows.groupBy(*by).applyInArrow(count, StructType([*rows.schema.fields, *more]))
