"""The row at a position of an order, found by counting instead of sorting.

A bounded sample of the order's keys gives boundaries; one pass counts the rows between them and at
them, in partial sums of a fixed size. The stretch that holds the position is looked at again in the
same way until it is one value or a few thousand rows. Each round takes two passes over the keys and
leaves a few hundredths of a percent to a percent of the rows, so some four rounds serve any table. Nothing is shuffled or written
but the sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.refs import col, order_columns, tie_break

SAMPLE = 2000  # rows of keys that the driver sees in a round
CUTS = 15  # boundaries over the whole stretch, and as many near the place looked for
FEW = 10_000  # rows that are put in order to find one of them

_SIMPLE = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)


@dataclass(frozen=True)
class Key:
    """A sort key: nulls come last unless ``nulls_first``."""

    column: Column
    kind: T.DataType
    ascending: bool
    nulls_first: bool = False

    def bound(self, value) -> Column:
        return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast(self.kind)

    def before(self, value) -> Column:
        if value is None:
            return F.lit(False) if self.nulls_first else self.column.isNotNull()
        smaller = self.column < self.bound(value) if self.ascending else self.column > self.bound(value)
        return F.coalesce(smaller, F.lit(self.nulls_first))

    def equal(self, value) -> Column:
        return self.column.isNull() if value is None else self.column.eqNullSafe(self.bound(value))

    @property
    def order(self) -> Column:
        if self.nulls_first:
            return self.column.asc_nulls_first() if self.ascending else self.column.desc_nulls_first()
        return self.column.asc_nulls_last() if self.ascending else self.column.desc_nulls_last()


def order_keys(df: DataFrame, order_by: Sequence, reverse: bool = False) -> list[Key] | None:
    """The keys of ``total_order``, or None if one of them is of a kind without plain literals."""
    named = order_columns(order_by)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not all(isinstance(kinds.get(name), _SIMPLE) for name, _ in named):
        return None
    keys = [Key(col(name), kinds[name], ascending != reverse, reverse) for name, ascending in named]
    ties = tie_break(df, [name for name, _ in named])
    return keys if ties is None else [*keys, Key(ties, T.LongType(), not reverse)]


def before(keys: list[Key], bound: Sequence) -> Column:
    """Whether a row comes before the bound."""
    found = F.lit(False)
    for key, value in reversed(list(zip(keys, bound))):
        found = key.before(value) | (key.equal(value) & found)
    return found


def equal(keys: list[Key], bound: Sequence) -> Column:
    found = F.lit(True)
    for key, value in zip(keys, bound):
        found = found & key.equal(value)
    return found


def stretch(keys: list[Key], bounds: list[tuple]) -> Column:
    """2i between the bounds i - 1 and i, 2i + 1 at bound i; a search by halves."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        upper = F.when(equal(keys, bounds[middle]), F.lit(2 * middle + 1)).otherwise(search(middle + 1, high))
        return F.when(before(keys, bounds[middle]), search(low, middle)).otherwise(upper)

    return search(0, len(bounds))


def sample_keys(df: DataFrame, keys: list[Key], size: int = SAMPLE) -> list[tuple]:
    """Keys of so many rows drawn at random, the same in each run, in order. One pass, no shuffle but of these."""
    names = [f"__key{i}" for i in range(len(keys))]
    drawn = df.select(*[k.column.alias(n) for n, k in zip(names, keys)], F.monotonically_increasing_id().alias("__row"))
    drawn = drawn.orderBy(F.xxhash64("__row"), "__row").limit(size).drop("__row")
    placed = [Key(F.col(n), k.kind, k.ascending, k.nulls_first) for n, k in zip(names, keys)]
    return [tuple(r) for r in drawn.orderBy(*[k.order for k in placed]).collect()]


def _bounds(sample: list[tuple], share: float) -> list[tuple]:
    """Sample rows evenly over the whole and, within a few deviations, around the share looked for."""
    n = len(sample)
    places = {i * n // (CUTS + 1) for i in range(1, CUTS + 1)}
    spread = 4 * (max(share * (1 - share), 1 / n) / n) ** 0.5
    places |= {int((share + spread * (2 * i / (CUTS - 1) - 1)) * n) for i in range(CUTS)}
    chosen = [sample[i] for i in sorted(places) if 0 <= i < n]
    return [b for i, b in enumerate(chosen) if i == 0 or b != chosen[i - 1]]


@dataclass(frozen=True)
class Place:
    """The keys of the row at a position, and how many rows come before it or are its equals."""

    bound: tuple
    before: int
    equal: int


def row_at(df: DataFrame, keys: list[Key], position: int) -> Place | None:
    """The row at the 0-based position, or None beyond the end. ``df`` is read several times."""
    rest, skipped, size = df, 0, df.count()
    if not 0 <= position < size:
        return None
    while size > FEW:
        bounds = _bounds(sample_keys(rest, keys), (position - skipped) / size)
        counts = dict(rest.groupBy(stretch(keys, bounds).alias("s")).agg(F.count(F.lit(1))).collect())
        at = 0
        while skipped + counts.get(at, 0) <= position:
            skipped += counts.get(at, 0)
            at += 1
        size = counts[at]
        if at % 2:
            return Place(bounds[at // 2], skipped, size)
        if at < 2 * len(bounds):
            rest = rest.where(before(keys, bounds[at // 2]))
        if at:
            rest = rest.where(~before(keys, bounds[at // 2 - 1]) & ~equal(keys, bounds[at // 2 - 1]))
    names = [k.column.alias(f"__key{i}") for i, k in enumerate(keys)]
    bound = tuple(rest.orderBy(*[k.order for k in keys]).offset(position - skipped).limit(1).select(*names).first())
    below, same = rest.agg(F.count_if(before(keys, bound)), F.count_if(equal(keys, bound))).first()
    return Place(bound, skipped + below, same)


def first_rows(df: DataFrame, keys: list[Key], n: int) -> DataFrame:
    """The first ``n`` rows of the order, in no order. A filter by the n-th row's keys; only if that row
    has more equals (rows alike in all columns) than are wanted, these are cut by a limit."""
    place = row_at(df, keys, n - 1)
    if place is None:
        return df if n > 0 else df.limit(0)
    if place.before + place.equal <= n:
        return df.where(before(keys, place.bound) | equal(keys, place.bound))
    return df.where(before(keys, place.bound)).union(df.where(equal(keys, place.bound)).limit(n - place.before))
