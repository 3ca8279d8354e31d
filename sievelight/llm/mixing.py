"""Mixing sources to target weights.

Each source gets a target number of words by its weight.  A source's target
is met by complete epochs first and then by a weighted sample of its
documents without replacement (Efraimidis and Spirakis): every document draws
an exponential key divided by its quality weight, and documents are taken in
order of their keys until the target is reached.

A source may hold a third of all rows, so its keys are never sorted in one
task.  What a source takes is all that stands before one cut in that order.
The cut is found by sums of sizes over ranges of keys, refined around the
target until a range has few rows, and only those are sorted.  The cuts are
one row a source; they go to the documents, and no text moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.rows import fresh
from sievelight.plans.sizing import BROADCAST_ROWS, is_small, join_groups, without
from sievelight.plans.staging import discard, stage

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Rows of a source that one task sorts, about.
ROWS_A_RANGE = 20_000
#: Bits of a place that count for ranges, and bits by which a round refines them.
PLACE_BITS, ROUND_BITS = 52, 10
#: Shares of a repeated row that are numbered by themselves.
SHARES = 256


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    The sources share ``share`` times all sizes by weight; what would go
    beyond ``most`` times a source's size is shared again among the others.
    With sources in order of size per weight, one is at its limit as long as
    the level that the rest would get, were all before it at theirs, reaches
    its own limit.
    """
    name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") - 1) % len(weights) + 1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("n", F.row_number().over(name)).withColumn("weight", weight)
    per = per.withColumn("cap", F.col("source_size") * float(most))
    all_, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weigh = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weigh)
    per = per.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True)
    level = level.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def draw(seed: int, id_: Column, digest: Column, nth: Column) -> Column:
    """A number between 0 and 1, neither of them, that depends on the seed, the row and its number among equal ones alone."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null")), digest, nth.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)


@dataclass(frozen=True)
class Mix:
    """What a mix takes: of each source (``cuts``) so many epochs and all that stands before its cut.

    ``repeats`` names the rows that are equal in id, text and source to others,
    which are told apart by their number; ``weights`` is the quality by id.
    """

    cuts: DataFrame
    repeats: DataFrame
    weights: DataFrame | None
    seed: int
    id_col: str
    text_col: str
    source_col: str
    broadcast_rows: int


#: Names of the columns that rows get while they are mixed.
OWN = ("m_id", "m_source", "m_hash", "m_digest", "m_nth", "m_place", "m_size")


def _named(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` as one struct ``m_row`` beside what the mix needs of it."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row"),
        F.col(id_col).alias("m_id"), F.col(source_col).alias("m_source"), F.xxhash64(text_col).alias("m_hash"),
        F.coalesce(F.md5(text_col), F.lit("null")).alias("m_digest"),
    )


def _repeated() -> Column:
    same_id, same_source = (F.col(f"m_{c}").eqNullSafe(F.col(f"r_{c}")) for c in ("id", "source"))
    return same_id & same_source & (F.col("m_hash") == F.col("r_hash"))


def _numbered(rows: DataFrame, repeats: DataFrame, broadcast_rows: int) -> DataFrame:
    """Rows with ``m_nth``: 0, but for repeated ones, which are numbered.

    Repeated rows are written with a number of their own and dealt to shares
    by it, so that one row that makes up a third of the table is counted in
    many tasks.
    """
    first = F.lit(0).cast("long").alias("m_nth")
    if repeats.isEmpty():
        return rows.select("*", first)
    some = rows.join(F.broadcast(repeats) if is_small(repeats, broadcast_rows) else repeats, _repeated(), "left_semi")
    some = some.withColumn("m_uid", F.monotonically_increasing_id())
    some = stage(some, "mix-repeats").withColumn("m_share", F.pmod(F.xxhash64("m_uid"), F.lit(SHARES)).cast("int"))
    key = ["m_id", "m_source", "m_hash"]
    sums = some.groupBy(*key, "m_share").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("m_share").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "m_share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("m_before"))
    some = join_groups(some, stage(sums, "mix-shares"), [*key, "m_share"], broadcast_rows=broadcast_rows)
    inside = Window.partitionBy(*key, "m_share").orderBy("m_uid")
    some = some.withColumn("m_nth", F.col("m_before") + F.row_number().over(inside) - 1).drop("m_uid", "m_share", "m_before")
    return without(rows, repeats, _repeated(), broadcast_rows).select("*", first).unionByName(some)


def _placed(rows: DataFrame, weights: DataFrame | None, seed: int, broadcast_rows: int) -> DataFrame:
    """Rows with ``m_place``: the logarithm of the key -ln(u) / weight, which keeps its order for weights of any size."""
    weight = F.lit(1.0)
    if weights is not None:
        rows, weight = join_groups(rows, weights, ["m_id"], "left", broadcast_rows=broadcast_rows), F.coalesce("m_weight", F.lit(1.0))
    u = draw(seed, F.col("m_id"), F.col("m_digest"), F.col("m_nth"))
    return rows.withColumn("m_place", F.log(-F.log(u)) - F.log(weight)).drop("m_weight", "m_digest")


def _position() -> Column:
    """The place as an integer of ``PLACE_BITS`` bits: no logarithm of a double is beyond 1024."""
    return F.floor((F.col("m_place") + 1024.0) * F.lit(2.0 ** (PLACE_BITS - 11))).cast("long")


def _order() -> Column:
    return F.struct("m_place", "m_id", "m_hash", "m_nth")


def _taken() -> Column:
    """How often the mix holds a row beside its source's cut."""
    at, low = _position(), F.col("c_low")
    before = at < low
    inside = (at >= low) & (at < low + F.col("c_width")) & F.col("c_last").isNotNull() & (_order() <= F.col("c_last"))
    return (F.col("c_epochs") + F.when(before | inside, 1).otherwise(0)).cast("long")


def plan_mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_a_range: int = ROWS_A_RANGE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[Mix, DataFrame]:
    """The mix, and its rows (see ``mix_sources``) with the columns of ``OWN``."""
    named = _named(docs.select(id_col, text_col, source_col), id_col, text_col, source_col)
    size = F.coalesce(F.regexp_count(F.col("m_row")[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    rows = stage(named.withColumn("m_size", size).drop("m_row"), "mix-sizes")
    repeats = rows.groupBy("m_id", "m_source", "m_hash").agg(F.count("*").alias("n")).where("n > 1")
    repeats = stage(repeats.select(*[F.col(f"m_{c}").alias(f"r_{c}") for c in ("id", "source", "hash")]), "mix-repeated")
    if quality is not None:
        quality = stage(quality.select(F.col(id_col).alias("m_id"), F.col("weight").alias("m_weight")).where("m_id is not null"), "mix-weights")
    sizes = rows
    rows = stage(_placed(_numbered(rows, repeats, broadcast_rows), quality, seed, broadcast_rows), "mix-places")
    discard(sizes)

    targets = source_targets(rows.select(F.col("m_source").alias("source"), F.col("m_size").alias("size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("c_epochs", epochs).withColumn("rest", F.col("target") - F.col("c_epochs") * F.col("source_size"))
    targets = stage(targets.withColumnRenamed("source", "m_source"), "mix-targets")

    # of each source the range that holds its cut: the place it begins at, its width, and the words before it
    state = targets.select("m_source", "rest", F.lit(0).cast("long").alias("c_low"), F.lit(0).cast("long").alias("c_before"), F.lit(0).cast("long").alias("n"))
    bits, first = PLACE_BITS, True
    while bits and (first or state.where(F.col("n") > rows_a_range).limit(1).count()):
        width, bits, first = 1 << bits, max(0, bits - ROUND_BITS), False
        inside = join_groups(rows, state.select("m_source", "c_low"), ["m_source"], broadcast_rows=broadcast_rows)
        at = _position()
        inside = inside.where((at >= F.col("c_low")) & (at < F.col("c_low") + width))
        bins = inside.groupBy("m_source", F.shiftright(at, bits).alias("bin")).agg(F.sum("m_size").alias("size"), F.count("*").alias("n"))
        bins = join_groups(stage(bins, "mix-bins"), state.drop("n"), ["m_source"], broadcast_rows=broadcast_rows)
        so_far = Window.partitionBy("m_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("c_before") + F.coalesce(F.sum("size").over(so_far), F.lit(0)))
        # the last range that begins before the target; where none does, nothing is taken
        at_cut = bins.where("before < rest").groupBy("m_source", "rest").agg(F.max_by(F.struct("bin", "before", "n"), "bin").alias("b"))
        state = stage(at_cut.select("m_source", "rest", F.shiftleft(F.col("b.bin"), bits).alias("c_low"), F.col("b.before").alias("c_before"), "b.n"), "mix-state")
    width = 1 << bits

    near = join_groups(rows, state.select("m_source", "rest", "c_low", "c_before"), ["m_source"], broadcast_rows=broadcast_rows)
    near = near.where((_position() >= F.col("c_low")) & (_position() < F.col("c_low") + width))
    order = Window.partitionBy("m_source").orderBy("m_place", "m_id", "m_hash", "m_nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("c_before") + F.coalesce(F.sum("m_size").over(order), F.lit(0))
    near = near.withColumn("fits", before + F.col("m_size") / 2 <= F.col("rest"))
    last = near.groupBy("m_source").agg(F.max(F.when(F.col("fits"), _order())).alias("c_last"))
    cuts = targets.join(state.select(F.col("m_source").alias("s"), "c_low"), F.col("m_source").eqNullSafe(F.col("s")), "left").drop("s")
    cuts = cuts.join(last.withColumnRenamed("m_source", "l"), F.col("m_source").eqNullSafe(F.col("l")), "left").drop("l")
    cuts = cuts.select("m_source", "source_size", "target", "c_epochs", F.coalesce("c_low", F.lit(0)).alias("c_low"), F.lit(width).cast("long").alias("c_width"), "c_last")
    mix = Mix(stage(cuts, "mix-cuts"), repeats, quality, seed, id_col, text_col, source_col, broadcast_rows)
    return mix, rows


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``id_col, source, text_hash, size, source_size, target, copies, taken`` for every row.

    ``copies`` says how often the mix holds the document, ``taken`` is that
    times its size.  ``quality`` has positive weights by ``id_col`` (column
    ``weight``; one row an id); a document without one weighs 1, and so does
    one without an id.  Documents come whole: the last one of a source is in
    if at least half of it fits.  A null text has no words; null sources are
    one source, the last; null and repeated ids keep their rows, and rows
    equal in id, text and source draw a key each; an empty table gives no rows; other
    columns are ignored.  Reruns agree.
    """
    mix, rows = plan_mix(docs, quality, id_col=id_col, source_col=source_col, **options)
    found = join_groups(rows, mix.cuts, ["m_source"], broadcast_rows=mix.broadcast_rows).withColumn("copies", _taken())
    return found.select(
        F.col("m_id").alias(id_col), F.col("m_source").alias(source_col), F.col("m_hash").alias("text_hash"), F.col("m_size").alias("size"),
        "source_size", "target", "copies", (F.col("copies") * F.col("m_size")).alias("taken"),
    )


def apply_mix(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs``, each as often as the mix holds it.

    The cuts go to the rows, which stay where they are.  Rows equal in id, text
    and source are numbered anew, so which of them comes more often is open
    where they differ in other columns.
    """
    rows = _named(docs, mix.id_col, mix.text_col, mix.source_col)
    rows = _placed(_numbered(rows, mix.repeats, mix.broadcast_rows), mix.weights, mix.seed, mix.broadcast_rows)
    rows = join_groups(rows, mix.cuts, ["m_source"], broadcast_rows=mix.broadcast_rows).withColumn("m_copies", _taken().cast("int"))
    rows = rows.where("m_copies > 0").select("m_row", F.explode(F.sequence(F.lit(1), F.col("m_copies"))))
    return rows.select(*[F.col("m_row")[c].alias(c) for c in docs.columns])


def oracle(weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> str:
    """``mix_sources`` in SQL over ``documents``, weighed by ``labels``."""
    pick = "CASE (n - 1) % {} {} END".format(len(weights), " ".join(f"WHEN {k} THEN CAST({w} AS DOUBLE)" for k, w in enumerate(weights)))
    return f"""
WITH q AS (SELECT doc_id, pow(2.0, 2 * avg(quality) - 1) AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING avg(quality) IS NOT NULL),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(md5(text), 'null') AS digest,
             row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS nth FROM documents),
u AS (SELECT d.*, coalesce(weight, 1.0) AS weight,
             (CAST('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), digest, nth)), 1, 13) AS BIGINT) + 0.5) * pow(2.0, -52) AS u
      FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
p AS (SELECT *, ln(-ln(u)) - ln(weight) AS place FROM u),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM p GROUP BY source),
w AS (SELECT *, {pick} AS w, source_size * {float(most)} AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {float(share)} - coalesce(sum(cap) OVER o, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, struct_pack(a := cap / w, b := n)) FROM l WHERE cap > level * w) AS open_level FROM l),
t AS (SELECT source, source_size, CASE WHEN cap > level * w THEN open_level * w ELSE cap END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT p.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY place, p.doc_id NULLS FIRST, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source),
k AS (SELECT *, epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM k"""
