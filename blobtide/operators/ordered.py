"""Windows over a global row order, without collecting all rows into one task.

A window without partition keys would run as a single task. Here the order keys are range-partitioned
instead: Spark samples them, so pieces are of similar size also when a third of the rows share one
time. The sorted pieces are written to a scratch table once, which fixes the numbering whatever
happens to an executor later. Only one row per piece (at most one per shuffle partition) is ever
gathered to add up piece counts and sums.

The input runs once: it is stored with a row id before the range partitioning samples it. Only the
order keys, the id and the values of the window are ordered and stored again; the other columns are
joined back by the id. A table that has no other columns is ordered as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blobtide.operators.rows import quoted
from blobtide.scratch import materialize

PIECE, AT, ROW, BLOCK, ROW_ID = "_piece", "_at", "_row", "_block", "_row_id"

# monotonically_increasing_id(): partition number above 33 bits of in-partition position
_POSITION_BITS = 33
_POSITION_MASK = (1 << _POSITION_BITS) - 1

ROWS_PER_BLOCK = 16_384


def sorted_pieces(
    df: DataFrame, order_by: Sequence[str], keep: Sequence[str] | None = None
) -> DataFrame:
    """`df` in global order, stored in pieces: adds the piece number and position in it.

    `order_by` should be a total order. Range partitioning reads `df` twice, so pass a stored frame.
    With `keep` the pieces only hold those columns.
    """
    order = [quoted(c).asc_nulls_first() for c in order_by]
    position = F.col("_position")
    stored = materialize(
        df.select(*[quoted(c) for c in dict.fromkeys([*order_by, *(df.columns if keep is None else keep)])])
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            *[quoted(c) for c in (df.columns if keep is None else keep)],
            F.monotonically_increasing_id().alias("_position"),
        ),
        "ordered",
    )
    return stored.withColumns(
        {
            PIECE: F.shiftright(position, _POSITION_BITS),
            AT: position.bitwiseAND(F.lit(_POSITION_MASK)),
        }
    ).drop("_position")


def with_row_id(df: DataFrame) -> DataFrame:
    """`df` stored, with an id per row that stays the same for every reader."""
    return materialize(df.withColumn(ROW_ID, F.monotonically_increasing_id()), "rows")


def _ranked(
    df: DataFrame, order_by: Sequence[str], values: Sequence[str], stored: bool
) -> tuple[DataFrame | None, DataFrame]:
    """The rows to join back by id, and the pieces with the values. A narrow table has no such rows."""
    if set(df.columns) <= {*order_by, *values}:
        return None, sorted_pieces(df if stored else materialize(df, "rows"), order_by)
    rows = with_row_id(df)
    return rows, sorted_pieces(rows, order_by, [ROW_ID, *values])


def _joined_back(rows: DataFrame | None, ranked: DataFrame, columns: Sequence[str], new: Sequence[str]) -> DataFrame:
    """The columns of the input and the new ones."""
    if rows is not None:
        ranked = rows.join(ranked.select(ROW_ID, *[quoted(c) for c in new]), ROW_ID)
    return ranked.select(*[quoted(c) for c in [*columns, *new]])


def _before_piece(totals: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exclusive running sums over pieces; `totals` has one row per piece."""
    earlier = Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        PIECE,
        *[
            F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(new)
            for c, new in columns.items()
        ],
    )


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with `_row`, the 0-based position in the global order."""
    totals = pieces.groupBy(PIECE).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _before_piece(totals, {"_rows": "_offset"})
    # offsets has one row per range partition, so its size is bounded by the partition count
    return (
        pieces.join(F.broadcast(offsets), PIECE)
        .withColumn(ROW, F.col("_offset") + F.col(AT))
        .drop(PIECE, AT, "_offset")
    )


def number_rows(df: DataFrame, order_by: Sequence[str], stored: bool = False) -> DataFrame:
    """Add `_row`, the 0-based position of each row in the global order."""
    rows, pieces = _ranked(df, order_by, [], stored)
    return _joined_back(rows, _numbered(pieces), df.columns, [ROW])


def after_first(rows: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """`rows`, from `with_row_id`, without the first `n` of the global order.

    The first rows are a top-n, of which only the ids are kept: every task sends at most `n` rows,
    and nothing is range-partitioned. `n` should be small.
    """
    order = [quoted(c).asc_nulls_first() for c in order_by]
    first = rows.orderBy(*order, ROW_ID).limit(n).select(ROW_ID).collect()
    return rows.where(~F.col(ROW_ID).isin([r[ROW_ID] for r in first])) if first else rows


def rolling_mean(
    df: DataFrame,
    order_by: Sequence[str],
    values: dict[str, str],
    n: int,
    min_periods: int | None = None,
    block_rows: int = ROWS_PER_BLOCK,
    ordered: bool = False,
) -> DataFrame:
    """Mean over the last `n` rows of the global order, as new columns `values[old] = new`.

    NULLs are skipped; the result is NULL with fewer than `min_periods` (default `n`) values.
    Rows are cut into blocks of `block_rows` by position. The last n-1 rows of a block are also
    sent to the next one, so every window is complete inside one block. With `ordered` the result
    is in global order: positions tell the partition of each row, without sampling or a global sort.
    """
    min_periods = n if min_periods is None else min_periods
    block_rows = max(block_rows, n)
    block = F.call_function("div", F.col(ROW), F.lit(block_rows))
    tail = F.col(ROW) % block_rows >= block_rows - (n - 1)
    homes = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    rows, pieces = _ranked(df, order_by, list(values), stored=False)
    window = Window.partitionBy(BLOCK).orderBy(ROW).rowsBetween(-(n - 1), 0)
    means = {
        new: F.when(
            F.count(quoted(old)).over(window) >= min_periods,
            F.avg(quoted(old)).over(window),
        )
        for old, new in values.items()
    }
    rolled = (
        _numbered(pieces)
        .withColumn(BLOCK, F.explode(homes))
        .withColumns(means)
        .where(F.col(BLOCK) == block)
    )
    result = _joined_back(rows, rolled, df.columns, [*values.values(), *([ROW] if ordered else [])])
    if not ordered:
        return result
    total = max(pieces.count(), 1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col(ROW) / F.lit(-(-total // parts))).cast("int")
    return result.repartitionById(parts, part).sortWithinPartitions(ROW).drop(ROW)


def cumulative_sum(
    df: DataFrame, order_by: Sequence[str], columns: dict[str, str], stored: bool = False
) -> DataFrame:
    """Running sums over the global order, as new columns `columns[old] = new`.

    A NULL adds nothing and stays NULL. Runs inside each piece, plus the sum of all pieces
    before it. `stored` says that `df` is cheap to read twice.
    """
    rows, pieces = _ranked(df, order_by, list(columns), stored)
    sums = {old: f"_total_{i}" for i, old in enumerate(columns)}
    totals = pieces.groupBy(PIECE).agg(
        *[F.sum(quoted(old)).alias(total) for old, total in sums.items()]
    )
    offsets = _before_piece(totals, {t: f"_before{t}" for t in sums.values()})
    window = (
        Window.partitionBy(PIECE)
        .orderBy(AT)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = {
        new: F.when(
            quoted(old).isNotNull(),
            F.sum(quoted(old)).over(window) + F.col(f"_before{sums[old]}"),
        )
        for old, new in columns.items()
    }
    # one row per range partition, as in number_rows
    summed = pieces.join(F.broadcast(offsets), PIECE).withColumns(running)
    return _joined_back(rows, summed, df.columns, list(columns.values()))
