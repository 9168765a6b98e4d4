"""Penalised change points of daily series, found exactly by a best-first search of a range tree for each end day.

A series is cut into segments of at least ``MIN_DAYS`` days; a segment of n days with sum S and sum of squares Q costs
``n * floor(1000 * ln(V))`` with ``V = 1 + floor((n*Q - S*S) / (n*n))``, a cut costs ``PENALTY``. The best prefix that ends
at a day is the best prefix before its last segment plus that segment, so each end day looks for the best start.

Starts are the leaves of a range tree of fanout ``WIDTH``. A block of starts has a lower bound: the least prefix cost within
it, plus the cost of the shortest possible segment whose squared error is that of the segment from the block's last start
(squared errors only grow as a segment gets longer) spread over the longest one. Blocks are opened in the order of their
bounds until no unopened block can hold a better or a tied start. Costs and numbers of segments are compared as one
integer, so that ties fall to fewer segments, then to the earlier start of the last segment, and so on backwards.

Spark sums days, gathers each series (one number a day) and deals the series out; a task searches the series of a batch side
by side with array operations, ``CELLS`` days at a time. All arithmetic is in integers: 64 bits where a bound on n*Q shows
that they suffice, Python's integers elsewhere.

Edge cases: rows with null value or time take no part; repeated rows add up; a null key is a series of its own; a series of
fewer than ``MIN_DAYS`` days is one segment; empty tables give no rows; other columns are ignored. One series is searched by
one task, whose memory grows with its days, not with its rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PENALTY = 20_000
MIN_DAYS = 7
WIDTH = 4  # starts in a block, and blocks in a block of the next level
TOP = 16  # blocks of the uppermost level, at most
CELLS = 1 << 18  # days of all series that are searched side by side, padding included
NEVER = np.int64(1) << np.int64(62)

SEGMENT = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"

_log_milli = np.frompyfunc(lambda v: math.floor(1000 * math.log(v)), 1, 1)


def _milli(v: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(v)) for positive integers of any size."""
    if v.dtype == object:
        return _log_milli(v).astype(np.int64)
    return np.floor(1000 * np.log(v.astype(np.float64))).astype(np.int64)


class Batch:
    """Series of daily totals that are searched side by side. ``totals``: a list of one-dimensional integer arrays."""

    def __init__(self, totals: list[np.ndarray], penalty: int, min_days: int):
        self.penalty, self.min_days = penalty, min_days
        self.n = np.array([len(x) for x in totals])
        longest = int(self.n.max())
        # the largest of n*Q and S*S over the whole series bounds every product below
        wide = any(len(x) ** 2 * float(np.abs(x).max(initial=0)) ** 2 >= 2.0**61 for x in totals)
        kind = object if wide else np.int64
        x = np.zeros((len(totals), longest), kind)
        for i, t in enumerate(totals):
            x[i, : len(t)] = t
        zero = np.zeros((len(totals), 1), kind)
        self.sums = np.hstack([zero, np.cumsum(x, 1)])
        self.squares = np.hstack([zero, np.cumsum(x * x, 1)])
        self.unit = longest + 2  # one unit of cost in keys; below it, the number of segments
        self.key = np.full((len(totals), longest + 1), NEVER)  # of the best prefix, by its length
        self.start = np.zeros((len(totals), longest + 1), np.int64)  # of its last segment
        self.widths = [WIDTH]
        while -(-(longest + 1) // self.widths[-1]) > TOP:
            self.widths.append(self.widths[-1] * WIDTH)
        self.least = [np.full((len(totals), -(-(longest + 1) // w)), NEVER) for w in self.widths]
        self.opened = 0  # blocks opened so far

    def _put(self, rows: np.ndarray, at: int, keys: np.ndarray) -> None:
        self.key[rows, at] = keys
        for w, least in zip(self.widths, self.least):
            least[rows, at // w] = np.minimum(least[rows, at // w], keys)

    def spread(self, rows, s, e):
        n = e - s
        total, squares = self.sums[rows, e] - self.sums[rows, s], self.squares[rows, e] - self.squares[rows, s]
        return 1 + (n * squares - total * total) // (n * n)

    def _keys(self, rows, s, e):
        """Keys of the prefixes of length e whose last segment begins at s."""
        before = self.key[rows, s]
        cost = (e - s) * _milli(self.spread(rows, s, e))
        return np.where(before < NEVER, before + (cost + self.penalty) * self.unit + 1, NEVER)

    def _bounds(self, level: int, rows, block, e: int):
        """No start of the block gives a smaller key."""
        w = self.widths[level]
        last = np.minimum((block + 1) * w - 1, e - self.min_days)
        shortest, longest = e - last, e - block * w
        fits = block * w <= e - self.min_days
        last, shortest = np.where(fits, last, 0), np.where(fits, shortest, e)
        longest = np.where(fits, longest, e)
        total, squares = self.sums[rows, e] - self.sums[rows, last], self.squares[rows, e] - self.squares[rows, last]
        v = 1 + (shortest * squares - total * total) // (shortest * longest)
        least = self.least[level][rows, np.minimum(block, self.least[level].shape[1] - 1)]
        return np.where(fits & (least < NEVER), least + (shortest * _milli(v) + self.penalty) * self.unit + 1, NEVER)

    def _search(self, rows: np.ndarray, e: int) -> None:
        """Best last segments of the prefixes of length e."""
        top = len(self.widths) - 1
        blocks = np.arange((e - self.min_days) // self.widths[top] + 1)
        bound = self._bounds(top, rows[:, None], blocks[None, :], e)
        block = np.broadcast_to(blocks, bound.shape).copy()
        level = np.full(bound.shape, top, np.int8)
        best, start = np.full(len(rows), NEVER), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))  # of rows; bound, block and level have a line for each of these
        steps = np.arange(WIDTH)
        while len(open_):
            line = np.arange(len(open_))
            at = bound.argmin(1)
            low = bound[line, at]
            go = (low <= best[open_]) & (low < NEVER)
            if not go.all():
                open_, bound, block, level, at = open_[go], bound[go], block[go], level[go], at[go]
                if not len(open_):
                    break
                line = np.arange(len(open_))
            self.opened += len(open_)
            b, l = block[line, at], level[line, at]
            bound[line, at] = NEVER
            leaf = l == 0
            if leaf.any():
                own = open_[leaf]
                s = b[leaf, None] * WIDTH + steps
                fits = s <= e - self.min_days
                r = rows[own][:, None]
                keys = np.where(fits, self._keys(r, np.where(fits, s, 0), e), NEVER)
                first = keys.argmin(1)  # the smallest start of those with the least key
                k, s = keys[np.arange(len(own)), first], s[np.arange(len(own)), first]
                better = (k < best[own]) | (k == best[own]) & (s < start[own])
                best[own[better]], start[own[better]] = k[better], s[better]
            if not leaf.all():
                inner = np.flatnonzero(~leaf)
                wider = np.full((len(open_), WIDTH), NEVER)
                inside, below = np.zeros((len(open_), WIDTH), np.int64), np.zeros((len(open_), WIDTH), np.int8)
                for lv in np.unique(l[inner]):
                    i = inner[l[inner] == lv]
                    inside[i], below[i] = b[i, None] * WIDTH + steps, lv - 1
                    wider[i] = self._bounds(int(lv) - 1, rows[open_[i]][:, None], inside[i], e)
                bound, block, level = np.hstack([bound, wider]), np.hstack([block, inside]), np.hstack([level, below])
        self._put(rows, e, best)
        self.start[rows, e] = start

    def segments(self) -> list[list[tuple[int, int]]]:
        """(start, end) of each series' segments."""
        everyone = np.arange(len(self.n))
        self._put(everyone, 0, np.full(len(everyone), -self.penalty * self.unit))
        for e in range(self.min_days, int(self.n.max()) + 1):
            self._search(np.flatnonzero(self.n >= e), e)
        out = []
        for i, n in enumerate(self.n.tolist()):
            cuts, e = [], n
            while e > 0:
                s = int(self.start[i, e]) if n >= self.min_days else 0
                cuts.append((s, e))
                e = s
            out.append(cuts[::-1])
        return out


def _batches(lengths: np.ndarray):
    """Indices of series of similar length, at most CELLS days together, padding included, or one longer series."""
    order = np.argsort(lengths, kind="stable")[::-1]
    i = 0
    while i < len(order):
        j = i + max(1, CELLS // int(lengths[order[i]]))
        yield order[i:j]
        i = j


def search(firsts: list[int], totals: list[np.ndarray], penalty: int = PENALTY, min_days: int = MIN_DAYS):
    """Rows of SEGMENT with the number of their series in front."""
    for own in _batches(np.array([len(x) for x in totals])):
        batch = Batch([totals[i] for i in own], penalty, min_days)
        for k, cuts in enumerate(batch.segments()):
            rows = []
            for s, e in cuts:
                v = int(batch.spread(np.array([k]), np.array([s]), np.array([e]))[0])
                rows.append((s, e, int(batch.sums[k, e] - batch.sums[k, s]), v, (e - s) * math.floor(1000 * math.log(v))))
            best = sum(r[4] for r in rows) + penalty * (len(rows) - 1)
            for no, (s, e, total, v, cost) in enumerate(rows, 1):
                yield int(own[k]), no, firsts[own[k]] + s, e - s, total, v, cost, len(rows), best


def change_points(rows: DataFrame, key: str, at: Column, value: Column, penalty: int = PENALTY, min_days: int = MIN_DAYS) -> DataFrame:
    """Segments of the daily sums of ``value`` for each ``key``; ``at`` is a date or a timestamp."""
    taken = rows.select(F.col(key).alias("_key"), F.unix_date(at.cast("date")).alias("_day"), value.cast("long").alias("_value"))
    daily = taken.where(F.col("_day").isNotNull() & F.col("_value").isNotNull()).groupBy("_key", "_day").agg(F.sum("_value").alias("_total"))
    series = daily.groupBy("_key").agg(F.collect_list(F.struct("_day", "_total")).alias("_days"))
    key_type = series.schema["_key"]
    schema = StructType([key_type, *StructType.fromDDL(SEGMENT).fields])

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            ends = lists.offsets.to_numpy(zero_copy_only=False)
            flat = lists.values
            days, amounts = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False)
            firsts, totals = [], []
            for i in range(b.num_rows):
                d, v = days[ends[i] : ends[i + 1]], amounts[ends[i] : ends[i + 1]]
                first = int(d.min())
                x = np.zeros(int(d.max()) - first + 1, np.int64)
                x[d - first] = v
                firsts.append(first)
                totals.append(x)
            found = list(zip(*search(firsts, totals, penalty, min_days)))
            kinds = [pa.int32()] + [pa.int64()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(found[0], pa.int64())), *[pa.array(v, t) for v, t in zip(found[1:], kinds)]], names=schema.names)

    return series.mapInArrow(cut, schema).withColumnRenamed("_key", key)


def op11_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of what each vendor shipped and customers kept, by day."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where(F.col("flag") == "kept")
    return change_points(lines, "vendor_id", F.col("shipped_at"), F.col("quantity"))
