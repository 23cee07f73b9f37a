"""How many intervals are open at each moment, and how high that has been, by a distributed Fenwick join.

Starts and ends become deltas, summed by key and moment before they are shuffled. A delta updates the cells of a
Fenwick tree over the key's moments (the position rounded up to each power of two), a moment is exploded into its prefix
cells (the position rounded down to each power of two); an equi-join brings the two together and the sum over a
moment's cells is its prefix sum. Running highs come from a second tree whose cells hold maxima instead of sums, and a
moment's rank among its key's moments (one more sum) finds the next moment by an equality.

The tree is cut into tiers, the lowest of `TIER` bits and those above of `UPPER`. A block of 2**TIER positions has a tree
of its own; what lies before the block comes from the tree over blocks, which is built in the same way from the blocks'
totals. It goes into the block's cells 1, 2, 4, 8 ..., of which every prefix has exactly one, its largest, and into cell 0
for a prefix that ends there. So no cell is asked for by more than 2**UPPER rows, however many its key has, and the
upper tiers get fewer rows by a factor of 2**TIER. In the lowest tier the cells 3, 5, 7 ... would hold one position and be
asked for by it alone; a row has that value itself. No key is gathered in a task, and nothing
is broadcast but what is small by Spark's own threshold.

Defined cases: an interval without a key or a start or whose end is not after it takes no part; without an end it stays
open. A null amount is 0. Equal rows count each. Moments at which starts and ends cancel out in count and amount are
no moments. Positions may be negative. Columns besides the named ones are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

TIER, UPPER = 6, 12
Fold = Callable[[str], Column]


def rounded(at: Column, up: bool, bits: int, skip: bool) -> Column:
    """at, from 1 to 2**bits, rounded to each power of two up to 2**bits: upwards the cells that a delta at `at` updates,
    downwards those that make up the prefix that ends there. With `skip` a number that is odd and not 1 is left out.
    """
    step = lambda k: F.shiftleft(F.shiftright(at + ((1 << k) - 1 if up else 0), k), k)
    own = F.when((at % 2 == 0) | (at == 1), at).otherwise(step(1)) if skip else at
    return F.array_remove(F.array_distinct(F.array(own, *(step(k) for k in range(1, bits + 1)))), 0)


def prefixes(rows: DataFrame, keys: list[str], at: str, name: str, folds: dict[str, Fold], span: int, whole: bool = True) -> DataFrame:
    """(keys, name, one column a fold): the parts, some rows each, that fold to the value over all rows of the same keys whose
    position is at most `at`, or below it if not `whole`; a row that has none before it has no part.

    rows: one a key and position, positions from 0 to span - 1; `name` tells a key's rows apart.
    """
    bits = TIER if whole else UPPER
    size, place = 1 << bits, [*keys, "_block", "_cell"]
    block, slot = F.shiftright(at, bits).alias("_block"), F.col(at).bitwiseAND(size - 1)
    updates = rows.select(*keys, block, F.explode(rounded(slot + 1, True, bits, whole)).alias("_cell"), *folds)
    if span > size:
        totals = rows.groupBy(*keys, block).agg(*(f(c).alias(c) for c, f in folds.items()))
        before = prefixes(totals, keys, "_block", "_block", folds, (span + size - 1) >> bits, whole=False).groupBy(*keys, "_block").agg(*(f(c).alias(c) for c, f in folds.items()))
        updates = updates.unionByName(before.withColumn("_cell", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, *(1 << k for k in range(bits + 1))))))))
    cells = updates.groupBy(*place).agg(*(f(c).alias(c) for c, f in folds.items()))
    end = slot + int(whole)
    own_cells = F.when(end == 0, F.array(F.lit(0).cast("long"))).otherwise(rounded(end, False, bits, whole))
    asked = rows.select(*keys, F.col(name).alias("_name"), block, F.explode(own_cells).alias("_cell"))
    met = asked.join(cells.hint("shuffle_hash"), place).select(*keys, F.col("_name").alias(name), *folds)
    # A whole prefix that ends at an odd number lacks the cell of the row itself.
    return met.unionByName(rows.where((end % 2 == 1) & (end > 1)).select(*keys, name, *folds)) if whole else met


def deltas(intervals: DataFrame, key: str, start: str, end: str, amount: str, every: object = None) -> DataFrame:
    """(key, moment, d_open, d_amount), one row a key and moment at which something changes. With `every`, what changes over
    all keys comes besides, as that key.
    """
    fine = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    value = F.coalesce(amount, F.lit(0)).cast("long")
    ends = F.array(F.struct(F.col(start).cast("long").alias("moment"), F.lit(1).cast("long").alias("d_open"), value.alias("d_amount")), F.struct(F.col(end).cast("long").alias("moment"), F.lit(-1).cast("long").alias("d_open"), (-value).alias("d_amount")))
    each = fine.select(F.col(key).alias("key"), F.inline(ends)).where("moment is not null")
    sums = [F.sum(c).alias(c) for c in ("d_open", "d_amount")]
    found = each.groupBy("key", "moment").agg(*sums)
    if every is not None:
        found = found.unionByName(found.groupBy("moment").agg(*sums).withColumn("key", F.lit(every).cast(intervals.schema[key].dataType)))
    return found.where("d_open <> 0 or d_amount <> 0")


def sweep(intervals: DataFrame, key: str, start: str, end: str, amount: str, unit: int = 1, every: object = None) -> DataFrame:
    """(key, moment, next_moment, n_open, amount, high_open, is_peak): a row a key and moment that changes n_open or amount.

    start and end are whole numbers, multiples of unit. n_open and amount hold from moment until next_moment (null: for ever);
    high_open is the key's largest n_open so far, is_peak says that n_open equals its largest of all. With `every`, a
    value that no key has, all intervals count once more for that key.
    """
    changed = stored(deltas(intervals, key, start, end, amount, every), "deltas")
    least, most = changed.agg(F.min("moment"), F.max("moment")).head()
    span = 1 if least is None else (most - least) // unit + 1
    position = F.expr(f"(moment - {least or 0}L) div {unit}")
    placed = changed.select("key", position.alias("at"), F.col("d_open").alias("n_open"), F.col("d_amount").alias("amount"), F.lit(1).cast("long").alias("rank"))
    sums = {c: F.sum for c in ("n_open", "amount", "rank")}
    open_ = stored(prefixes(placed, ["key"], "at", "at", sums, span).groupBy("key", "at").agg(*(f(c).alias(c) for c, f in sums.items())), "open")
    # A row's own values, the moment of the row that follows it and the parts of its high meet in one aggregation by rank.
    moment, empty = (F.col("at") * unit + (least or 0)).cast("long"), F.lit(None).cast("long")
    own = open_.select("key", "rank", moment.alias("moment"), empty.alias("next_moment"), "n_open", "amount", empty.alias("high_open"))
    after = open_.where("rank > 1").select("key", F.col("rank") - 1, empty, moment, empty, empty, empty)
    highs = prefixes(open_, ["key"], "at", "rank", {"n_open": F.max}, span).select("key", "rank", empty, empty, empty, empty, "n_open")
    rows = own.union(after).union(highs).groupBy("key", "rank").agg(*(F.max(c).alias(c) for c in own.columns[2:]))
    peaks = open_.groupBy(F.col("key").alias("_of")).agg(F.max("n_open").alias("_peak"))
    return rows.join(peaks, F.col("key") == F.col("_of")).select("key", "moment", "next_moment", "n_open", "amount", "high_open", (F.col("n_open") == F.col("_peak")).alias("is_peak"))


MINUTE, WEEK = 60, 7 * 86_400
NOWHERE, EVERYWHERE = -1, -2


def seconds(column: str) -> Column:
    """UTC seconds since 1970 of a timestamp without a zone, rounded down to minutes."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")
    return ((micros - F.pmod(micros, F.lit(MINUTE * 1_000_000))) / 1_000_000).cast("long")


def open_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation_id, start, end, cents) of each sale, for its client's nation. Of a client_id's rows the largest nation_id counts."""
    lines = table(spark, sf_dir, "sale_lines").where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg(F.max("shipped_at").alias("shipped_at"))
    # A table of its own, so that the planner can split the sales of a client that has very many.
    clients = stored(table(spark, sf_dir, "clients").where("client_id is not null").groupBy("client_id").agg(F.max("nation_id").alias("nation_id")), "clients")
    sales = table(spark, sf_dir, "sales").where("sold_at is not null").select("sale_id", "client_id", seconds("sold_at").alias("start"), F.coalesce(F.floor(F.col("total") * 100 + 0.5), F.lit(0).cast("long")).alias("cents"))
    timed = sales.join(lines, "sale_id", "left").select("client_id", "start", (seconds("shipped_at") + WEEK).alias("end"), "cents").where("end is null or end > start")
    return timed.join(clients, "client_id", "left").select(F.coalesce("nation_id", F.lit(NOWHERE)).alias("nation_id"), "start", "end", "cents")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = sweep(open_sales(spark, sf_dir), "nation_id", "start", "end", "cents", MINUTE, every=EVERYWHERE)
    return swept.select(F.col("key").alias("nation_id"), F.col("moment").alias("from_s"), F.col("next_moment").alias("to_s"), "n_open", F.col("amount").alias("open_cents"), "high_open", "is_peak")
