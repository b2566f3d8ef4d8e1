"""Running sums, folds, averages, ranks and order statistics of groups of any size.

A window over a group puts the group into one task. Here rows are dealt by ranges of (group, order) instead, so that
a group of any size lies in as many tasks as it needs; a block is what a range has of a group. Sums inside a block
are a window over the block, and what comes before a block is a window over block totals, one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut, fresh

#: Block totals up to which they are broadcast.
SMALL = 200_000


def blocks(df: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, str]:
    """``df``, computed once, and the name of a new column: the range that a row lies in, ascending in (by, order). Rows
    of one order lie together.

    Ranges are found from a sample, which is a pass of its own: rows are stored before it, so that what made them is not
    done again, and after it, so that all later steps see the same ranges. Pass rows without their texts.
    """
    name = fresh(df, "_block")
    return cut(cut(df).repartitionByRange(*by, *order).withColumn(name, F.spark_partition_id())), name


def prefix_sums(df: DataFrame, sums: dict[str, Column | str], by: list[str], order: list[str], block: str | None = None) -> DataFrame:
    """``df`` with, for each name in ``sums``, the total of its value over the rows of the group before this one.

    Null values count 0; rows that tie in the order are summed in some order. ``block`` names the column where ``df``
    comes from ``blocks``; else that is done here.
    """
    rows, given = (df, block) if block else blocks(df, by, order)
    inside = Window.partitionBy(*by, given).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy(given).rowsBetween(Window.unboundedPreceding, -1)
    value = {name: F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)) for name, v in sums.items()}
    base = {name: fresh(rows, f"_base_{name}") for name in sums}
    totals = rows.groupBy(*by, given).agg(*(F.sum(v).alias(base[name]) for name, v in value.items()))
    bases = cut(totals.select(*by, given, *(F.coalesce(F.sum(base[n]).over(earlier), F.lit(0)).alias(base[n]) for n in sums)))
    bases = F.broadcast(bases) if bases.count() <= SMALL else bases
    local = rows.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(name) for name, v in value.items()))
    # Groups can be null: the keys of the join are equal then too.
    renamed = bases.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, given)), *base.values())
    same = [local[c].eqNullSafe(renamed[f"_of_{c}"]) for c in (*by, given)]
    joined = local.join(renamed, same)
    out = joined.withColumns({name: F.col(name) + F.col(base[name]) for name in sums}).drop(*base.values(), *(f"_of_{c}" for c in (*by, given)))
    return out if block else out.drop(given)


class _Block:
    """The rows of a block in their order: sums before and after each, and where folds that begin in it lead.

    A fold begins at a place: a row, or the end, which is the next block's first row. It is named by the sum before its
    first row, which is what its limit counts from.
    """

    def __init__(self, before: np.ndarray, after: np.ndarray, limit: int):
        self.after, self.limit, self.n = after, limit, len(after)
        self.starts = np.append(before, after[-1])
        close = np.searchsorted(after, self.starts + limit)  # the first row at which the sum suffices
        self.next = np.where(close < self.n, close + 1, np.arange(self.n + 1))  # a fold that stays open stays where it is

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For a fold that begins at each place: the fold that is open at the block's end, and how many close before, worked
        out for all places at once by doubling steps."""
        at, closed = self.next, (self.next != np.arange(self.n + 1)).astype(np.int64)
        while (at[at] != at).any():
            at, closed = at[at], closed + closed[at]
        return self.starts[at], closed

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What becomes of a fold that comes in, as a step function of the sum at which it may close: (up to which sum, fold
        open at the end, folds closed). A fold that comes in closes within the first ``limit`` of the block, or not at all."""
        opened, closed = self.ends()
        last = min(int(np.searchsorted(self.after, self.starts[0] + self.limit)) + 1, self.n)
        opened, closed = opened[1 : last + 1], closed[1 : last + 1] + 1  # it closes with a row, and one begins after that
        step = np.flatnonzero(np.append((opened[1:] != opened[:-1]) | (closed[1:] != closed[:-1]), True))
        return self.after[step], opened[step], closed[step]

    def parts(self, opened: int) -> np.ndarray:
        """For each row, how many folds have begun in the block, ``opened`` being the one that comes in."""
        begun, at = [], int(np.searchsorted(self.after, opened + self.limit)) + 1
        while at < self.n:
            begun.append(at)
            at = int(self.next[at]) if self.next[at] > at else self.n
        return np.searchsorted(begun, np.arange(self.n), side="right")


def fold(df: DataFrame, size: str, limit: int, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``part``: rows of a group fill a part in order; it closes with the row at which its sum reaches ``limit``.

    The sum starts again at each close, which no window can say. Each block of a group tells what becomes of a fold that
    comes in, as a step function; one lookup a block chains these for the group; then each block numbers its own rows.
    Groups of one block, most as a rule, need only the last. Sizes must not be negative; null ones count 0.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    rows, block = blocks(df, by, order)
    amount, keys, given = F.coalesce(F.col(size), F.lit(0)).cast("long"), [*by, block], df.columns
    sums = cut(prefix_sums(rows, {"_before": amount}, by, order, block))
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def sorted_(frame: pd.DataFrame) -> tuple[pd.DataFrame, _Block]:
        after = frame["_before"] + frame[size].fillna(0).astype(np.int64)
        frame = frame.assign(_after=after).sort_values(["_before", "_after"], kind="stable")
        return frame, _Block(frame["_before"].to_numpy(np.int64), frame["_after"].to_numpy(np.int64), limit)

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        frame, own = sorted_(frame)
        upto, opened, closed = (x.tolist() for x in own.steps())
        return pd.DataFrame({c: frame[c].iloc[:1].to_list() for c in keys} | {"base": [int(own.starts[0])], "upto": [upto], "opened": [opened], "closed": [closed]})

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(block, kind="stable")
        opened, part, out = int(frame["base"].iloc[0]), 0, []
        for r in frame[["upto", "opened", "closed"]].itertuples(index=False):
            out.append((opened, part))
            at = int(np.searchsorted(r.upto, opened + limit))
            if at < len(r.upto):
                opened, part = int(r.opened[at]), part + int(r.closed[at])
        return frame[keys].assign(opened=[o for o, _ in out], first=[p for _, p in out])

    def numbered(frame: pd.DataFrame) -> pd.DataFrame:
        frame, own = sorted_(frame)
        part = int(frame["first"].iloc[0]) + own.parts(int(frame["opened"].iloc[0]))
        return frame.assign(part=part.astype(np.int32))[[*given, "part"]]

    several = cut(sums.groupBy(*by).agg(F.min(block).alias("_lo"), F.max(block).alias("_hi")).where("_lo < _hi").select(*(F.col(c).alias(f"_of_{c}") for c in by)))
    if several.isEmpty():
        return _numbered(sums.withColumns({"opened": F.lit(0).cast("long"), "first": F.lit(0).cast("long")}), keys, kinds, given, numbered)
    long = sums.join(several, [sums[c].eqNullSafe(several[f"_of_{c}"]) for c in by], "left_semi").select(*keys, size, "_before")
    tables = long.groupBy(*keys).applyInPandas(told, f"{head}, base long, upto array<long>, opened array<long>, closed array<long>")
    entries = cut(tables.groupBy(*by).applyInPandas(chained, f"{head}, opened long, first long"))
    entries = F.broadcast(entries) if entries.count() <= SMALL else entries
    entries = entries.select(*(F.col(c).alias(f"_of_{c}") for c in keys), "opened", "first")
    joined = sums.join(entries, [sums[c].eqNullSafe(entries[f"_of_{c}"]) for c in keys], "left")
    joined = joined.select(*sums.columns, F.coalesce("opened", F.lit(0)).alias("opened"), F.coalesce("first", F.lit(0)).alias("first"))
    return _numbered(joined, keys, kinds, given, numbered)


def _numbered(rows: DataFrame, keys: list[str], kinds: dict[str, str], given: list[str], number: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return rows.groupBy(*keys).applyInPandas(number, ", ".join(f"`{c}` {kinds[c]}" for c in given) + ", part int")


def ranks(df: DataFrame, by: list[str], value: str, name: str = "before") -> DataFrame:
    """``df`` with how many rows of the group have a smaller value, nulls being the smallest. Equal values are counted before
    they are summed, so ties of any number are one row in the scan."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    before = prefix_sums(counts, {name: "_k"}, by, [value]).select(*(F.col(c).alias(f"_of_{c}") for c in (*by, value)), name)
    return df.join(before, [df[c].eqNullSafe(before[f"_of_{c}"]) for c in (*by, value)]).drop(*(f"_of_{c}" for c in (*by, value)))


def kth(df: DataFrame, by: list[str], value: str, share: float, places: dict[str, Callable[[Column], Column]], accuracy: int = 10_000) -> DataFrame:
    """Per group ``n``, the count of values that are not null, and for each name the value at a place of the ascending order,
    from 0, that ``places`` works out from ``n`` and that lies about ``share`` of the way.

    A mergeable sketch brackets the place by two values of the group with few others between them; the rows below are
    counted and those between are counted by value, so only some 6 / ``accuracy`` of a group meet in one task. Groups
    of ``accuracy`` rows or fewer are taken as they are. A place outside its bracket is an error, never a near value.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = [max(share - 3 / accuracy, 0.0), min(share + 3 / accuracy, 1.0)]
    about = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", ends, accuracy).alias("_p"))
    end = lambda i, whole: F.when((F.col("n") <= accuracy) | F.lit(ends[i] == float(i)), F.col(whole)).otherwise(F.col("_p")[i])
    about = cut(about.select(*by, "n", end(0, "_lo").alias("_lo"), end(1, "_hi").alias("_hi")))
    about = F.broadcast(about) if about.count() <= SMALL else about
    renamed = about.select(*(F.col(c).alias(f"_of_{c}") for c in by), "n", "_lo", "_hi")
    met = known.join(renamed, [known[c].eqNullSafe(renamed[f"_of_{c}"]) for c in by]).drop(*(f"_of_{c}" for c in by))
    # Rows below the bracket are one value, a null; the others keep theirs.
    counts = met.where("_v <= _hi").select(*by, "n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).groupBy(*by, "n", "_v").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("_upto", upto)
    picks = [F.min(F.when(F.col("_upto") > place(F.col("n")), F.struct("_upto", "_v"))).alias(name) for name, place in places.items()]
    found = placed.groupBy(*by, "n").agg(*picks)
    missed = F.raise_error(F.lit("a place lies outside its bracket"))
    checked = [F.when(F.col(name)["_v"].isNotNull(), F.col(name)["_v"]).otherwise(missed.cast(df.schema[value].dataType)).alias(name) for name in places]
    return found.select(*by, "n", *checked)


def ema(df: DataFrame, value: str, decay: float, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``ema``, the exponential moving average of each group in order; the first is the first value.

    An average is its block's own, begun at 0, plus what comes into the block times a power of ``decay``; what comes in
    is chained over the last averages of blocks, one row a block. Values must not be null.
    """
    rows, block = blocks(df, by, order)
    keys, given = [*by, block], df.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def own(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        frame = frame.sort_values(order, kind="stable")
        x = frame[value].to_numpy(np.float64)
        # With a 0 before them, pandas averages from 0; powers of the decay tell what is left of what came in.
        local = pd.Series(np.append(0.0, x)).ewm(alpha=1 - decay, adjust=False).mean().to_numpy()[1:]
        return frame, local, decay ** np.arange(1, len(x) + 1)

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        frame, local, power = own(frame)
        return pd.DataFrame({c: frame[c].iloc[:1].to_list() for c in keys} | {"first": [float(frame[value].iloc[0])], "last": [local[-1]], "power": [power[-1]]})

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(block, kind="stable")
        carry, out = float(frame["first"].iloc[0]), []  # as if the first value had always been the average
        for last, power in zip(frame["last"], frame["power"], strict=True):
            out.append(carry)
            carry = last + power * carry
        return frame[keys].assign(carry=out)

    def averaged(frame: pd.DataFrame) -> pd.DataFrame:
        frame, local, power = own(frame)
        return frame.assign(ema=local + power * frame["carry"].to_numpy())[[*given, "ema"]]

    head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    summary = rows.groupBy(*keys).applyInPandas(told, f"{head}, first double, last double, power double")
    carries = cut(summary.groupBy(*by).applyInPandas(chained, f"{head}, carry double"))
    carries = F.broadcast(carries) if carries.count() <= SMALL else carries
    renamed = carries.select(*(F.col(c).alias(f"_of_{c}") for c in keys), "carry")
    joined = rows.join(renamed, [rows[c].eqNullSafe(renamed[f"_of_{c}"]) for c in keys]).drop(*(f"_of_{c}" for c in keys))
    return joined.groupBy(*keys).applyInPandas(averaged, ", ".join(f"`{c}` {kinds[c]}" for c in given) + ", ema double")
