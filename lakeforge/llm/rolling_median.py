"""Exact rolling medians and median deviations of many series, by persistent segment trees over ranks.

A series is cut into blocks of time, of one window or of several where rows are few. The task of a block holds the rows
of the block, and as its halo those of the window before it. A segment tree over the ranks of its values is kept persistent: inserting a value makes one
new node a level and shares the rest, so each moment has a version. A window is the difference of two versions:

* the median is found by one descent from both roots at once,
* the median deviation by bisecting the radius: of the values nearest to the median, so many lie below it.

The versions are flat arrays, one entry an insertion and level, and all windows of a task descend together.

A task's memory is about 300 bytes a row of the block and its halo. Where a series has more than `dense_rows` rows a
window, blocks are a fraction of the window, so that a block has fewer, and the halo is the block one window earlier;
what lies in between is in all windows of the block and comes as counts by distinct value, inserted before the block's
own rows. Only one number, the most rows of a series a window, goes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

#: Cents beyond this are taken as this: 5 times a doubled median of differences fits into 64 bits.
MOST = 10**17
#: Windows that descend together.
SLICE = 8192
_OLD, _BETWEEN, _OWN = 0, 1, 2


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's zone if it has none."""
    at = F.col(name)
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(at.cast("timestamp"))
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT"):
        return F.unix_micros(at.cast("timestamp"))
    since = at - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since)
    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")).cast("long") * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def hundredths(value: Column) -> Column:
    """floor(100 * value + 0.5); none for null, NaN and infinite values."""
    value = value.cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.least(F.greatest(F.floor(100 * value + 0.5), F.lit(-MOST)), F.lit(MOST)))


class PersistentTree:
    """Versions of a segment tree over ranks 0 to 2^levels - 1: version v has the first v values, with their weights.

    Entry p of a level is a node's version; 0 is the empty node. Nodes lie one after the other, each one's versions in
    order of insertion: the first child's versions of a node that starts at s are s + 1, s + 2, ..., and so are found
    by counting.
    """

    def __init__(self, ranks: np.ndarray, weights: np.ndarray):
        n = len(ranks)
        self.levels = max(1, int(ranks.max()).bit_length()) if n else 0
        self.total = np.concatenate([[0], np.cumsum(weights)])
        #: By level and version: the first child's weight, and both children's versions, one after the other.
        self.weight: list[np.ndarray] = []
        self.child: list[np.ndarray] = []
        kind = np.int64 if n and self.total[-1] >= 2**31 else np.int32
        plain = bool(n) and self.total[-1] == n
        ranks, weights = ranks.astype(np.int32), weights.astype(kind)
        place, start = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        since = np.zeros(n + 1, kind)

        def counted(x: np.ndarray) -> np.ndarray:
            """Sums since the node's start."""
            np.cumsum(x, out=since[1:])
            return since[1:] - since[start]

        for level in range(self.levels):
            left = ((ranks >> (self.levels - 1 - level)) & 1) == 0
            lefts = counted(left)
            rights = place - start + 1 - lefts
            last = np.flatnonzero(np.concatenate([start[1:] != start[:-1], [True]]))
            second_at = start + np.repeat(lefts[last], np.diff(last, prepend=-1))
            child = np.zeros(2 * (n + 1), np.int32)
            np.multiply(start + lefts, lefts > 0, out=child[1 : n + 1], casting="unsafe")
            np.multiply(second_at + rights, rights > 0, out=child[n + 2 :], casting="unsafe")
            heavy = np.zeros(n + 1, kind)
            heavy[1:] = lefts if plain else counted(np.where(left, weights, 0))
            self.weight.append(heavy)
            self.child.append(child)
            to = np.where(left, child[1 : n + 1], child[n + 2 :]) - 1
            begins = np.where(left, start, second_at)
            ranks, start, was = np.empty_like(ranks), np.empty_like(start), ranks
            ranks[to], start[to] = was, begins
            if not plain:
                was, weights = weights, np.empty_like(weights)
                weights[to] = was
        #: Of the lowest level's entries.
        self.ranks = np.concatenate([[0], ranks])

    def select(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rank of the k-th value, from 0, of what version `high` has beyond version `low`."""
        u, v, k = high, low, k.astype(np.int64)
        for heavy, child in zip(self.weight, self.child, strict=True):
            there = heavy.take(u)
            there -= heavy.take(v)
            right = k >= there
            k -= there * right
            beyond = right * (len(child) // 2)
            u, v = child.take(u + beyond), child.take(v + beyond)
        return self.ranks[u]


def medians(tree: PersistentTree, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The doubled median of each window, and that of the distances of the doubled values from it. No window is empty.

    Windows that follow each other should be near each other: the radius of one is looked for first where that of a
    neighbour was.
    """
    n = tree.total[high] - tree.total[low]
    a = (n - 1) // 2
    count = len(n)
    every = np.arange(count)
    at = lambda rows, k: values[tree.select(low[rows], high[rows], k)]
    median2 = at(every, a)
    even = np.flatnonzero(n % 2 == 0)
    upper = median2.copy()
    upper[even] = at(even, a[even] + 1)
    median2 = median2 + upper
    none = np.iinfo(np.int64).max

    def distances(rows: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the i-th value from the median down, and of the (a - i)-th up; none there: beyond all."""
        m, down, up = median2[rows], a[rows] - i, 2 * a[rows] + 1 - i
        below, above = np.flatnonzero(down >= 0), np.flatnonzero(up < n[rows])
        x = at(np.concatenate([rows[below], rows[above]]), np.concatenate([down[below], up[above]]))
        one, two = np.full(len(rows), none), np.full(len(rows), none)
        one[below], two[above] = m[below] - 2 * x[: len(below)], 2 * x[len(below) :] - m[above]
        return one, two

    # of the a + 1 nearest values, `least` lie down; at `least` the value down is not nearer than the last one up
    least, most = np.maximum(0, 2 * (a + 1) - n), a + 1
    floor_, top = least.copy(), most.copy()
    inner, outer = np.full((2, count), -1, np.int64), np.full((2, count), none)

    def search(rows: np.ndarray, guess: np.ndarray) -> None:
        """Steps away from the guess, each twice as long, and then bisects."""
        step, turned, last = 1, np.zeros(len(rows), bool), np.zeros(len(rows), np.int8)
        going = least[rows] < most[rows]
        rows, guess, turned, last = rows[going], guess[going], turned[going], last[going]
        while len(rows):
            lo, hi = least[rows], most[rows]
            mid = np.where(turned, (lo + hi) // 2, np.where(last == 0, guess, np.where(last > 0, lo + step - 1, hi - step)))
            mid = np.clip(mid, lo, hi - 1)
            down, up = distances(rows, mid)
            more = down < up
            # at mid, the value down and the last one up; these are next to the radius once no more probes follow
            yes, no = rows[more], rows[~more]
            least[yes], most[no] = mid[more] + 1, mid[~more]
            inner[0, yes], outer[1, yes] = down[more], up[more]
            outer[0, no], inner[1, no] = down[~more], up[~more]
            turned |= (last != 0) & ((last > 0) != more)
            last = np.where(more, 1, -1).astype(np.int8)
            step *= 2
            going = least[rows] < most[rows]
            rows, guess, turned, last = rows[going], guess[going], turned[going], last[going]

    some = every[::16]
    search(some, (a[some] + 1) // 2)
    rest = np.flatnonzero(every % 16 != 0)
    near = np.minimum(rest // 16, len(some) - 1)
    search(rest, least[some][near] + (a[rest] - a[some][near]) // 2)
    # what no probe has seen: the radius lies at an end of its range
    for edge, i in (((least == floor_) & (least > 0), least - 1), ((least == top), least)):
        rows = np.flatnonzero(edge)
        if len(rows):
            down, up = distances(rows, i[rows])
            if i is least:
                outer[0, rows], inner[1, rows] = down, up
            else:
                inner[0, rows], outer[1, rows] = down, up
    open_ = np.flatnonzero((least == floor_) & (least == 0))
    if len(open_):  # nothing lies down: the next one up is the (a + 1)-th
        up = a[open_] * 2 + 2
        there = up < n[open_]
        outer[1, open_[there]] = 2 * at(open_[there], up[there]) - median2[open_[there]]
    inner = np.where([least > 0, least < a + 1], inner, -1).max(axis=0)
    outer = outer.min(axis=0)
    return median2, inner + np.where(n % 2 == 1, inner, outer)


def _block(window: int, least: int, kind: pa.Schema):
    """What a task does with a block's rows."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: np.asarray(table[c].fill_null(0))
        role, at, cents, weight, known = get("role"), get("at"), get("cents"), get("weight"), np.asarray(table["cents"].is_valid())
        own = np.flatnonzero(role == _OWN)
        own = own[np.argsort(at[own])]
        if not len(own):
            return kind.empty_table()
        # inserted: the halo by time, what lies between, the block's own rows by time
        points = np.flatnonzero(known)
        points = points[np.lexsort((at[points], role[points]))]
        inner = role[points]
        olds, held = np.count_nonzero(inner == _OLD), np.count_nonzero(inner != _OWN)
        values, ranks = np.unique(cents[points], return_inverse=True)
        tree = PersistentTree(ranks, weight[points])
        gone = np.searchsorted(at[points[held:]], at[own] - window, "left")
        low = np.where(gone > 0, held + gone, np.searchsorted(at[points[:olds]], at[own] - window, "left"))
        high = held + np.searchsorted(at[points[held:]], at[own], "right")
        n = tree.total[high] - tree.total[low]
        median2, mad4 = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        full = np.flatnonzero(n >= max(least, 1))
        for k in range(0, len(full), SLICE):
            part = full[k : k + SLICE]
            median2[part], mad4[part] = medians(tree, values, low[part], high[part])
        far = 2 * np.abs(2 * cents[own] - median2) > 5 * mad4
        few = n < max(least, 1)
        rows = table.take(pa.array(own))
        return pa.table([rows["id"], rows["series"], pa.array(n), pa.array(median2, mask=few), pa.array(mad4, mask=few), pa.array(far, mask=few | ~known[own])], schema=kind)

    return run


def rolling_medians(df: DataFrame, minutes: int = 360, least: int = 5, id_col: str = "click_id", time_col: str = "ts", series_col: str = "kind", value_col: str = "value", block_rows: int = 1 << 12, dense_rows: int = 1 << 17) -> DataFrame:
    """For each id its series and, over its window, `n`, `median2`, `mad4` and `far`.

    The window of a row: the values of its series with a time of at least its own minus `minutes` and at most its own.
    n counts the window's values, in hundredths (`hundredths`); median2 is the sum of the two middle ones, or twice the
    only middle one; mad4 the same of |2 * value - median2|; far says that 2 * |2 * own - median2| > 5 * mad4. With
    fewer than `least` values the last three are null, and far is null without an own value.

    Rows without a time take no part. Null is a series, and an id. An id with several rows counts once, with the
    least (time, series, value), nulls first. Equal times are in each other's windows. An empty table gives no rows;
    other columns, whatever their names, are dropped.
    """
    window = minutes * 60_000_000
    rows = df.where(F.col(time_col).isNotNull()).select(F.col(id_col).alias("id"), F.struct(micros(df, time_col).alias("at"), F.col(series_col).alias("series"), hundredths(F.col(value_col)).alias("cents")).alias("row"))
    block = lambda size: F.expr(f"(at - pmod(at, {size})) div {size}")
    most = rows.select("row.*").groupBy("series", block(window)).count().agg(F.max("count")).first()[0] or 0
    parts = 1  # of a window
    while most > parts * dense_rows and window % (2 * parts) == 0:
        parts *= 2
    size = window * max(3, block_rows // max(most, 1)) if parts == 1 else window // parts
    rows = rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*").withColumn("block", block(size))
    one = F.lit(1).cast("long")
    own, old = F.struct(F.col("block"), F.lit(_OWN).alias("role")), F.struct((F.col("block") + parts).alias("block"), F.lit(_OLD).alias("role"))
    late = F.expr(f"pmod(at, {size})") >= size - window  # within a window of the next block, or all of a shorter one
    twice = F.explode(F.when(late & F.col("cents").isNotNull(), F.array(own, old)).otherwise(F.array(own))).alias("to")
    dealt = rows.select("id", "series", "at", "cents", one.alias("weight"), twice).select("to.*", "id", "series", "at", "cents", "weight")
    if parts > 1:
        counts = rows.where(F.col("cents").isNotNull()).groupBy("series", "block", "cents").agg(F.count("*").alias("weight"))
        between = counts.withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("block") + parts - 1))).groupBy("series", "block", "cents").agg(F.sum("weight").alias("weight"))
        dealt = dealt.unionByName(between.withColumn("role", F.lit(_BETWEEN)), allowMissingColumns=True)
    types = {"id": df.schema[id_col].dataType, "series": df.schema[series_col].dataType}
    ddl = ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", n long, median2 long, mad4 long, far boolean"
    empty = df.sparkSession.createDataFrame([], ddl)
    out = dealt.groupBy("series", "block").applyInArrow(_block(window, least, empty.toArrow().schema), empty.schema)
    return out.withColumnsRenamed({"id": id_col, "series": series_col})


def oracle() -> str:
    """DuckDB SQL for the rows over `clicks`; its windows are evaluated row by row."""
    return """
    WITH clean AS (
      SELECT click_id, kind, ts, CAST(floor(100 * value + 0.5) AS BIGINT) AS cents FROM clicks WHERE ts IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, kind NULLS FIRST, floor(100 * value + 0.5) NULLS FIRST) = 1
    ), seen AS (
      SELECT *, count(cents) OVER w AS n, CAST(2 * median(cents) OVER w AS BIGINT) AS median2, CAST(4 * mad(cents) OVER w AS BIGINT) AS mad4
      FROM clean WINDOW w AS (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 360 MINUTE PRECEDING AND CURRENT ROW)
    )
    SELECT click_id, kind, n, CASE WHEN n >= 5 THEN median2 END AS median2, CASE WHEN n >= 5 THEN mad4 END AS mad4,
      CASE WHEN n >= 5 THEN 2 * abs(2 * cents - median2) > 5 * mad4 END AS far
    FROM seen
    """
