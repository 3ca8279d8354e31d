"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by a hash of their text.  Splitters between the shards are
found by counting the exact bytes below candidate keys: every round counts
the bins of each splitter's open interval, keeps the bin in which its target
lies, and stops when that bin holds less than the tolerance.  Only counts
move; rows are exchanged once, when their place is known.

Equal texts have equal keys and so stay in one shard.  A group of copies too
large to be a rounding error of a splitter is placed whole by its size before
the splitters are searched, and a group larger than a whole shard, which no
single shard can hold, is spread over all of them.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.plans.staging import stage

KEY_SPACE = 1 << 63
#: Candidate keys a splitter and round.
PROBES = 1024
#: Share of a shard by which a splitter may be off.
TOLERANCE = 0.001
#: A group of equal texts above this share of a shard is placed by its size;
#: there are at most shards / HEAVY of them.
HEAVY = 0.002
#: A text above this share of all rows, and in at least so many, has its rows told apart by their own numbers.
MANY, MANY_ROWS = 0.001, 1_000
#: Rows of a shard that one task numbers.
ROWS_A_BUCKET, LEAST_BUCKETS = 1_000_000, 16


def _positive(key: Column) -> Column:
    return F.shiftrightunsigned(key, 1)


def _pack(groups: list[tuple[int, int]], shards: int, share: float) -> tuple[list[tuple[int, int]], list[float]]:
    """Largest group first, each to the emptiest shard: ``(key, shard)``, and what room is left."""
    room = [(-share, s) for s in range(shards)]
    placed = []
    for size, key in sorted(((b, k) for k, b in groups), reverse=True):
        left, s = heapq.heappop(room)
        placed.append((key, s))
        heapq.heappush(room, (left + size, s))
    rest = [0.0] * shards
    for left, s in room:
        rest[s] = max(0.0, -left)
    return placed, rest


def find_splitters(
    rows: DataFrame, targets: list[float], slack: float, position: str = "pos", size: str = "size", probes: int = PROBES
) -> list[int]:
    """Keys below which ``rows`` have ``targets`` bytes, each within ``slack``."""
    # of each splitter: the open interval, the bytes below it and those inside it
    state = [[0, KEY_SPACE, 0, None] for _ in targets]
    while open_ := sorted({(lo, hi) for lo, hi, _, inside in state if (inside is None or inside > slack) and hi - lo > 1}):
        steps = [-(-(hi - lo) // probes) for lo, hi in open_]
        which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, ((lo, hi), step) in enumerate(zip(open_, steps)):
            inside = (F.col(position) >= lo) & (F.col(position) <= hi - 1)
            which = F.when(inside, i).otherwise(which)
            bin_ = F.when(inside, F.expr(f"({position} - {lo}L) div {step}L")).otherwise(bin_)
        counted = rows.select(which.alias("i"), bin_.alias("bin"), size).where(F.col("i").isNotNull())
        bins: dict[int, dict[int, int]] = {}
        for r in counted.groupBy("i", "bin").agg(F.sum(size).alias("n")).collect():  # probes a splitter at most
            bins.setdefault(r.i, {})[r.bin] = r.n
        for k, target in enumerate(targets):
            lo, hi, below, _ = state[k]
            if (lo, hi) not in open_:
                continue
            i = open_.index((lo, hi))
            at = below
            for b in range(probes):
                n = bins.get(i, {}).get(b, 0)
                end = min(hi, lo + (b + 1) * steps[i])
                if at + n >= target or end >= hi:
                    state[k] = [lo + b * steps[i], end, at, n]
                    break
                at += n
    return [lo if abs(below - t) <= abs(below + (n or 0) - t) else hi for (lo, hi, below, n), t in zip(state, targets)]


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for every row.

    ``size`` is the UTF-8 bytes of the text (null: none) plus one, ``slot``
    numbers the rows of a shard from 0 without gaps, in hash order.  Null
    texts are one group of equal texts, apart from empty ones; null and
    repeated ids keep their rows; rows of a text that very many rows have are
    in the order of their places in the table; an empty table gives no rows;
    other columns are ignored.
    """
    text, id_ = F.col(text_col), F.col(id_col)
    rows = docs.select(
        id_.alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        _positive(F.xxhash64(text)).alias("key"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = stage(rows, "shard-keys")
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    share = (total or 0) / shards

    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    many = max(MANY_ROWS, (n_rows or 0) * MANY)
    groups = groups.where((F.col("bytes") > HEAVY * share) | (F.col("n") > many)).collect()  # at most shards / HEAVY + 1 / MANY
    heavy = [(r.key, r.bytes) for r in groups if r.bytes > HEAVY * share]
    spread = [k for k, b in heavy if b > share]
    placed, room = _pack([(k, b) for k, b in heavy if b <= share], shards, share)
    where = dict(placed)
    marks = [(r.key, where.get(r.key), r.key in spread, r.n > many) for r in groups]
    marks = docs.sparkSession.createDataFrame(marks, "key long, placed int, spread boolean, many boolean")
    rows = rows.join(F.broadcast(marks), "key", "left")
    row_hash = F.xxhash64("key", "id", F.when(F.col("id").isNull() | F.col("many"), F.col("uid")))
    rows = rows.withColumn("pos", F.when(F.col("spread"), _positive(row_hash)).otherwise(F.col("key")))

    light = total - sum(b for k, b in heavy if b <= share) if total else 0
    targets, at, scale = [], 0.0, light / (sum(room) or 1)
    for r in room[:-1]:
        at += r * scale
        targets.append(at)
    splitters = find_splitters(rows.where("placed is null"), targets, tolerance * share) if total else []
    shard = F.lit(0)
    for s in splitters:
        shard = shard + F.when(F.col("pos") >= s, 1).otherwise(0) if s < KEY_SPACE else shard
    buckets = max(LEAST_BUCKETS, math.ceil((n_rows or 0) / shards / ROWS_A_BUCKET))
    rows = rows.select(
        "id", "size", "crc", "uid",
        F.coalesce("placed", shard).cast("int").alias("shard"),
        row_hash.alias("order"),
    ).withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)).cast("int"))

    # the rows before each bucket of a shard: shards * buckets counts
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("order", "id", "uid")
    return (
        rows.join(F.broadcast(counts), ["shard", "bucket"])
        .withColumn("slot", F.col("before") + F.row_number().over(inside) - 1)
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))
    )
