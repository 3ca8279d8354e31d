"""Ranges of document ids with nearly equal bytes.

Bytes are counted in bins of ids, and bins that hold too many are counted
again in finer ones.  An id that alone holds more than a range (null ids, or
one id that a third of all rows repeat) gets ranges of its own, to which its
rows are dealt by a second key.  Only counts come to the driver: some for
each range.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.arrow import small_table
from sievelight.plans.staging import stage

#: Bytes of texts in a range, about, the most ranges, and bins for each range.
RANGE_BYTES, MOST_RANGES, BINS_A_RANGE = 64 << 20, 50_000, 4
#: What a row counts beside its text.
ROW_BYTES = 64


def _bins(rows: DataFrame, shift: int, within: list[int] | None, above: int) -> dict[int, int]:
    """Bytes by ``id >> shift``, of all ids or of those whose ``id >> above`` is one of ``within``."""
    if within is not None:
        own = small_table(rows.sparkSession, [(w,) for w in within], "__w long")
        rows = rows.join(F.broadcast(own), F.shiftright("id", above) == F.col("__w"))
    counted = rows.groupBy(F.shiftright("id", shift).alias("bin")).agg(F.sum("size").alias("size"))
    return {r.bin: r["size"] for r in counted.collect()}


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, size`` of all rows, written once: texts are read for their lengths alone."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES
    return stage(docs.select(F.col(id_col).cast("long").alias("id"), size.alias("size")), "row-sizes")


def plan_ranges(rows: DataFrame, least: int, range_bytes: int = RANGE_BYTES, most: int = MOST_RANGES) -> tuple[DataFrame | None, DataFrame | None, int, int]:
    """Where the rows of ``id, size`` go: edges by bin, ranges of hot ids, the shift that makes bins, and how many ranges there are.

    There are ``least`` ranges or as many as their bytes call for, up to
    ``most``; beyond that ranges grow.
    """
    spark = rows.sparkSession
    low, high, total = rows.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    if total is None:
        return None, None, 0, 0
    ranges = min(most, max(least, -(-total // range_bytes)))
    share = max(1, total / ranges)
    # ids with more than a range of bytes in several rows: at most as many as there are ranges
    hot = rows.groupBy("id").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > share) & (F.col("n") > 1)).collect()
    parts = {r.id: -(-r["size"] // int(share + 1)) for r in hot}
    cold = rows.where(~F.coalesce(F.col("id").isin([k for k in parts if k is not None]), F.lit(False)) & F.col("id").isNotNull())
    some = {k: v for k, v in parts.items() if k is not None}
    null_rows = rows.where("id is null").agg(F.sum("size")).first()[0]
    next_, edges, own = 0, [], []  # edges: the first id and the number of each range, in order
    if null_rows is not None:
        next_ = parts.get(None, 1)
        own.append((None, 0, next_))
    shift = 0
    if low is not None:
        while (high >> shift) - (low >> shift) >= ranges * BINS_A_RANGE:
            shift += 1
        leaves = {(b << shift, shift): n for b, n in _bins(cold, shift, None, 0).items()}
        at = shift
        while at:
            heavy = [b >> at for (b, s), n in leaves.items() if s == at and n > 2 * share]
            if not heavy:
                break
            finer = max(0, at - 10)
            leaves = {k: n for k, n in leaves.items() if not (k[1] == at and n > 2 * share)}
            leaves |= {(b << finer, finer): n for b, n in _bins(cold, finer, heavy, at).items()}
            at = finer
        order = sorted([(b, 0, n) for (b, _), n in leaves.items()] + [(k, 1, n) for k, n in some.items()])
        held = None  # bytes of the range that is open
        for first, is_hot, n in order:
            if is_hot:
                own.append((first, next_, n))
                # what follows the hot id, maybe in the same bin, follows its ranges
                edges.append((first + 1, next_ + n))
                next_, held = next_ + n + 1, 0
                continue
            if held is None or held and held + n > share:
                edges.append((first, next_))
                next_, held = next_ + 1, 0
            held += n
    firsts = [f for f, _ in edges]
    by_bin: dict[int, list] = {}
    for f, b in edges:
        by_bin.setdefault(f >> shift, []).append((f, b))
    table = []
    if low is not None:
        # bins without an edge take the range that is open where they begin
        for b in range(low >> shift, (high >> shift) + 1):
            before = bisect_right(firsts, b << shift) - 1
            start = [(b << shift, edges[max(0, before)][1])] if edges else []
            table.append((b, start + [e for e in by_bin.get(b, []) if e[0] > b << shift]))
    table = [(b, [{"first": f, "range": r} for f, r in e]) for b, e in table]
    bins = small_table(spark, table, "bin long, edges array<struct<first: long, range: int>>")
    hot_ids = small_table(spark, own, "h_id long, h_first int, h_n int")
    return bins, hot_ids, shift, next_


def place_rows(rows: DataFrame, plan, second: Column, name: str = "bucket") -> DataFrame:
    """``rows`` with the number of the range of each, in order of ids, null ids first.

    ``second`` is a long, spread evenly over its values, that orders the rows
    of an id with ranges of its own.
    """
    bins, hot, shift, _ = plan
    rows = rows.withColumn("__bin", F.shiftright("id", shift))
    # a row for each bin: BINS_A_RANGE * MOST_RANGES at most
    rows = rows.join(F.broadcast(bins.select(F.col("bin").alias("__bin"), "edges")), "__bin", "left")
    inside = F.element_at(F.filter("edges", lambda e: e["first"] <= F.col("id")), -1)["range"]
    rows = rows.join(F.broadcast(hot), F.col("id").eqNullSafe(F.col("h_id")), "left")
    # the highest 31 bits of the second key, as a share of the hot id's ranges
    share = F.shiftright((F.shiftright(second, 33) + (1 << 30)) * F.col("h_n"), 31).cast("int")
    return rows.withColumn(name, F.when(F.col("h_n").isNotNull(), F.col("h_first") + share).otherwise(inside)).drop("__bin", "edges", "h_id", "h_first", "h_n")
