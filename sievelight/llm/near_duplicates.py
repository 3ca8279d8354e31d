"""Similarity join on word shingles with Bayesian pruning.

1. One pass over the texts gives each document a digest of its words, its
   MinHash signature and the band keys of it.  Documents with the same words
   are one class from here on, so copies are never expanded.
2. Classes that share a band are candidates.  Each class lives with the
   largest band that it shares, or the largest that a neighbour there lives
   with, in a chunk of bounded size; two chunks make a block if any band has
   classes of both.  So every candidate pair meets in one block, and classes
   that long chains of bands connect make no blocks.
3. Inside a block signatures are compared some values at a time.  A pair is
   dropped as soon as its posterior probability of reaching the threshold
   (uniform prior) falls below the tolerance.  Classes with a pair left are put
   into smaller blocks of those pairs, only they have their texts fetched, and
   the pairs are verified on the exact shingle sets.
4. Blocks return sums of links and a spanning forest, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.arrow import bound_batches, slices
from sievelight.llm.components import connected_components
from sievelight.llm.encoding import forget_encoders
from sievelight.llm.hashing import U64, WORD_BASE, batches, mix, shingle_hashes, word_hashes
from sievelight.llm.rows import drop_rows, fresh, same_row
from sievelight.plans.sizing import BROADCAST_ROWS, is_small, join_groups, without
from sievelight.plans.staging import discard, stage

SHINGLE, THRESHOLD = 5, 0.8
#: 25 bands of 5 values: a pair at 0.8 shares one with probability 0.99995.
BANDS, ROWS = 25, 5
SIGNATURE = 128
#: Values compared before each pruning.
STEPS = (16, 32, 64, 96, 128)
TOLERANCE = 1e-6
#: Classes a side of a block of signatures, compared so many at a time.
BLOCK, TILE = 256, 256
#: Classes and words a side of a block of texts.
TEXTS, TEXT_WORDS = 128, 1 << 20


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 1 << 32, SIGNATURE, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SIGNATURE, np.uint32)


def signatures(shingles: np.ndarray, offsets: np.ndarray, n: int = SIGNATURE) -> np.ndarray:
    """MinHash values, a row a text; a text without words has the greatest values."""
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        low = (shingles >> U64(32)).astype(np.uint32)
        starts = offsets[some]
        times, plus = _permutations()
        for k in range(n):
            values = low * times[k]
            values ^= values >> np.uint32(15)
            values += plus[k]
            values *= np.uint32(0x2C1B3C6D)
            out[some, k] = np.minimum.reduceat(values, starts)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(signature), bands), U64)
    for b in range(bands):
        key = np.full(len(signature), (b + 1) * WORD_BASE % (1 << 64), U64)
        for r in range(rows):
            key = mix(key + signature[:, b * rows + r].astype(U64))
        keys[:, b] = key
    return keys.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``n`` with which a pair may still reach the threshold.

    After m equal values of n the posterior is Beta(m + 1, n - m + 1), and it
    lies above t as often as n + 1 throws of a coin of probability t show at
    most m heads.
    """
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def _digest(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    for batch in slices(batches_, 1):
        texts = batch.column(1).to_pylist()
        h1, h2 = np.zeros(len(texts), U64), np.zeros(len(texts), U64)
        n_words = np.zeros(len(texts), np.int64)
        keys, signs = np.zeros((len(texts), BANDS), np.int64), np.zeros((len(texts), SIGNATURE), "<u4")
        for a, b in batches(texts):
            words, at = word_hashes(texts[a:b])
            n_words[a:b] = np.diff(at)
            place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
            some = np.flatnonzero(np.diff(at))
            if len(some):
                # two digests of the row of words: each word is mixed with its place
                for out, salt in ((h1, 0x9E3779B97F4A7C15), (h2, 0xC2B2AE3D27D4EB4F)):
                    mixed = mix(words + (place.astype(U64) + U64(1)) * U64(salt))
                    out[a + some] = np.add.reduceat(mixed, at[some], dtype=U64)
            shingles, offsets = shingle_hashes(words, at, SHINGLE)
            signs[a:b] = signatures(shingles, offsets)
            keys[a:b] = band_keys(signs[a:b])
        flat = pa.array(keys.reshape(-1), pa.int64())
        offsets = pa.array(np.arange(0, len(texts) * BANDS + 1, BANDS), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2), *(pa.array(x.view(np.int64), pa.int64()) for x in (h1, h2)), pa.array(n_words),
                pa.ListArray.from_arrays(offsets, flat), pa.array([r.tobytes() for r in signs], pa.binary()),
            ],
            names=["id", "text_hash", "h1", "h2", "n_words", "bands", "signature"],
        )


def _blocks(batches_: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """The rows of each block, of rows sorted by their first four columns, the first two of which name it; equal ones are one."""
    held: list[tuple] = []
    for batch in slices(batches_, column):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            if not held or held[-1][:4] != row[:4]:
                held.append(row)
    if held:
        yield held


def prune(signs: np.ndarray, side: np.ndarray, cross: bool, threshold: float, tolerance: float = TOLERANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices i < j of the pairs that may still reach the threshold, for some rows at a time.

    ``cross`` leaves out the pairs of one side.  The first step looks at all
    pairs of a tile, the later ones at those that are left.
    """
    n, columns = len(signs), np.ascontiguousarray(signs.T)
    for start in range(0, n, TILE):
        end = min(n, start + TILE)
        matches = np.zeros((end - start, n), np.int16)
        for column in columns[: STEPS[0]]:
            matches += column[start:end, None] == column[None, :]
        keep = matches >= least_matches(STEPS[0], threshold, tolerance)
        keep &= np.arange(start, end)[:, None] < np.arange(n)[None, :]
        if cross:
            keep &= side[start:end, None] != side[None, :]
        i, j = np.nonzero(keep)
        same, done = matches[i, j].astype(np.int64), STEPS[0]
        i += start
        for step in STEPS[1:]:
            same = same + (signs[i, done:step] == signs[j, done:step]).sum(1)
            keep = same >= least_matches(step, threshold, tolerance)
            i, j, same, done = i[keep], j[keep], same[keep], step
        if len(i):
            yield i, j


def _signs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Signatures and sides of a block's rows, and whether only pairs across sides count."""
    signs = np.frombuffer(b"".join(r[4] for r in rows), "<u4").reshape(len(rows), SIGNATURE)
    return signs, np.array([r[2] for r in rows]), bool(rows[0][1])


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """Join the labels of linked indices (``i`` in order) in place; the pairs that do so are a spanning forest."""
    cuts = np.flatnonzero(np.diff(i)) + 1
    for own, others in zip(i[np.r_[0, cuts]] if len(i) else (), np.split(j, cuts)):
        met, first = np.unique(labels[others], return_index=True)
        new = met != labels[own]
        if new.any():
            labels[np.isin(labels, met[new])] = labels[own]
            yield from ((int(own), int(others[k])) for k in first[new])


def _survivors(threshold: float, texts: int, batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows of ``a, b, side, uid, signature, n_words`` the blocks of texts of the pairs that pruning leaves.

    Rows of ``key, cross, side, uid``: a block's key, whether only pairs
    across its two sides count, the side of a class and the class.
    """
    made: list[tuple] = []
    for rows in _blocks(batches_, 4):
        signs, side, cross = _signs([(r[0], r[0] != r[1], *r[2:]) for r in rows])
        labels, pairs = np.arange(len(rows)), []
        for i, j in prune(signs, side, cross, threshold):
            for _ in _join(labels, i, j):
                pass
            pairs.append((i, j))
        if not pairs:
            continue
        left = np.unique(np.concatenate([x for p in pairs for x in p]))
        # classes that are alike stand together, then in the order of their sides
        left = left[np.lexsort((left, side[left], labels[left]))]
        group, groups, held, words = np.full(len(rows), -1), 0, 0, 0
        for k, at in enumerate(left.tolist()):
            n = rows[at][5]
            if held and (held >= texts or words + n > TEXT_WORDS or cross and side[at] != side[left[k - 1]]):
                groups, held, words = groups + 1, 0, 0
            group[at], held, words = groups, held + 1, words + n
        met = np.unique(np.concatenate([group[i] * len(rows) + group[j] for i, j in pairs] + [group[j] * len(rows) + group[i] for i, j in pairs]))
        inside: dict[int, list[int]] = {}
        for at in left.tolist():
            inside.setdefault(int(group[at]), []).append(rows[at][3])
        for x, y in zip((met // len(rows)).tolist(), (met % len(rows)).tolist()):
            if x <= y:
                key = hash((rows[0][0], rows[0][1], x, y))
                made.extend((key, int(x != y), 0, u) for u in inside[x])
                made.extend((key, 1, 1, u) for u in inside[y] if x != y)
        if len(made) > 50_000:
            yield _longs(zip(*made), ("key", "across", "side", "uid"))
            made = []
    yield _longs(zip(*made) if made else [[]] * 4, ("key", "across", "side", "uid"))


def _longs(columns, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=list(names))


def _verify(threshold: float, batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``key, across, side, uid, signature, copies, text``; rows of ``kind, x, y`` out.

    Kind 0: class ``x`` has ``y`` linked documents in this block; kind 1: an
    edge of the block's spanning forest.
    """
    made: list[list] = [[], [], []]
    for rows in _blocks(batches_, 6):
        for out, new in zip(made, _block(rows, threshold)):
            out.extend(new)
        if len(made[0]) > 10_000:
            yield _longs(made, ("kind", "x", "y"))
            made = [[], [], []]
    yield _longs(made, ("kind", "x", "y"))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct shingles of each text."""
    sets: list[np.ndarray] = []
    for a, b in batches(texts):
        shingles, offsets = shingle_hashes(*word_hashes(texts[a:b]), SHINGLE)
        sets.extend(np.unique(shingles[s:e]) for s, e in zip(offsets, offsets[1:]))
    return sets


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    if len(i) < 200:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    cuts = np.searchsorted(where, np.arange(0, len(every) + width, width))
    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
        part = np.zeros((len(sets), width), np.float32)
        part[owner[s:e], where[s:e] - k * width] = 1
        both += part @ part.T
    return both[i, j].astype(np.int64)


def similar_pairs(sets: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float):
    """Of the pairs of indices those whose exact Jaccard similarity reaches the threshold."""
    # a smaller set than the threshold allows cannot match
    keep = np.minimum(sizes[i], sizes[j]) >= np.maximum(1, threshold * np.maximum(sizes[i], sizes[j]) - 1e-9)
    i, j = i[keep], j[keep]
    both = _intersections(sets, i, j) if len(i) else np.zeros(0, np.int64)
    keep = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    return i[keep], j[keep]


def _block(rows: list[tuple], threshold: float) -> tuple[list, list, list]:
    _, _, _, uids, _, copies, texts = zip(*rows)
    weight, links, labels, forest = np.array(copies), np.zeros(len(rows)), np.arange(len(rows)), []
    sets = shingle_sets(list(texts))
    sizes = np.array([len(s) for s in sets])
    for i, j in prune(*_signs(rows), threshold):
        i, j = similar_pairs(sets, sizes, i, j, threshold)
        links += np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        forest.extend(_join(labels, i, j))
    some = np.flatnonzero(links)
    kinds = [0] * len(some) + [1] * len(forest)
    x = [uids[k] for k in some] + [uids[a] for a, _ in forest]
    y = [int(links[k]) for k in some] + [uids[b] for _, b in forest]
    return kinds, x, y


def candidate_blocks(reps: DataFrame, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``a, b, side, uid``: which classes of ``uid, bands`` meet in which block.

    ``a`` and ``b`` are chunks (the same one for the pairs within a chunk) and
    ``side`` is the chunk that the class is of.  A band of m classes makes
    blocks of the chunks that they live in, not pairs of them.
    """
    banded = reps.select("uid", F.explode("bands").alias("band"))
    shared = stage(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-bands")
    banded = stage(banded.join(F.broadcast(shared) if is_small(shared, broadcast_rows) else shared, "band"), "near-shared")
    # a class has the largest band that it shares, and lives with the largest that a class of that band has
    own = stage(banded.groupBy("uid").agg(F.max(F.struct("n", "band")).alias("own")).select("uid", "own.n", "own.band"), "near-own")
    near = banded.select("uid", F.col("band").alias("of")).join(own, "uid").groupBy("of").agg(F.max(F.struct("n", "band")).alias("home"))
    near = stage(near.select(F.col("of").alias("band"), F.col("home.band").alias("home")), "near-neighbours")
    homes = stage(join_groups(own, near, ["band"], broadcast_rows=broadcast_rows).select("uid", "home"), "near-homes")
    sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / block).alias("chunks"))
    lived = join_groups(homes, sizes, ["home"], broadcast_rows=broadcast_rows)
    members = stage(lived.select("uid", F.xxhash64("home", F.pmod(F.xxhash64("uid"), F.col("chunks"))).alias("chunk")), "near-chunks")
    places = stage(banded.select("band", "uid").join(members, "uid").select("band", "chunk").distinct(), "near-places")
    # chunks that a band has in common; most bands lie in one chunk alone
    several = places.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    places = stage(places.join(several, "band"), "near-several")
    left, right = (places.select("band", F.col("chunk").alias(c)) for c in "ab")
    across = left.join(right, "band").where("a < b").select("a", "b").distinct()
    within = members.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1")
    within = within.select(F.col("chunk").alias("a"), F.col("chunk").alias("b"))
    pairs = stage(across.unionAll(within), "near-pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("side"))
    met = stage(sides.join(members, F.col("side") == F.col("chunk")).select("a", "b", "side", "uid"), "near-met")
    discard(shared, banded, own, near, homes, members, places, pairs)
    return met


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    texts_a_side: int = TEXTS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``id_col, text_hash, class_id, copy_id, n_links, class_key`` for every row of ``docs``.

    ``class_id`` is the least id of the documents that links connect with
    this one, ``copy_id`` the least id of those with the same words, and
    ``n_links`` the number of other documents whose similarity is at least
    ``threshold``.  ``text_hash`` tells rows with one id apart.  Classes may
    have one ``class_id`` if ids repeat or are null; ``class_key`` tells them
    apart (its values hold for this result only).  Ids are integers, or texts
    that hold some.

    A document without words (null, empty, only marks) has no links and the
    class of its own id.  Repeated rows are copies of each other; null ids
    count as the least; an empty table gives no rows; other columns are
    ignored.  A pair is missed only if no band brings it together (0.00005 at
    the threshold), or if pruning drops it (``TOLERANCE``).
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    schema = "id long, text_hash long, h1 long, h2 long, n_words long, bands array<long>, signature binary"
    base = stage(texts.mapInArrow(_digest, schema).withColumn("uid", F.monotonically_increasing_id()), "near-digests")

    # classes of equal words; the least row stands for its class
    classes = base.where("n_words > 0").groupBy("h1", "h2").agg(
        F.min("uid").alias("rep"), F.count("*").alias("copies"), _least_id("id").alias("copy_id")
    )
    classes = stage(classes, "near-classes")
    reps = base.join(classes.select(F.col("rep").alias("uid"), "copies"), "uid")
    reps = stage(reps.select("uid", "copies", "id", "text_hash", "bands"), "near-reps")

    n_parts = max(64, 2 * docs.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions())

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(n_parts, *by).sortWithinPartitions(*by, "side", "uid")

    met = candidate_blocks(reps, block, broadcast_rows)
    signs = _only(base.select("uid", "signature", "n_words"), met.select(F.col("uid").alias("met")).distinct(), F.col("uid") == F.col("met"), broadcast_rows)
    compared = dealt(met.join(signs, "uid").select("a", "b", "side", "uid", "signature", "n_words"), "a", "b")
    left = stage(compared.mapInArrow(partial(_survivors, threshold, texts_a_side), "key long, across long, side long, uid long"), "near-left")
    wanted = stage(left.join(reps.drop("bands"), "uid").join(signs.drop("n_words"), "uid"), "near-wanted")
    # texts of the survivors alone move, one of those equal in id and text
    same = lambda i, h: F.col("id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(h))
    kept = wanted.select(F.col("id").alias("w_id"), F.col("text_hash").alias("w_hash")).distinct()
    kept_texts = _only(texts, kept, same("w_id", "w_hash"), broadcast_rows).dropDuplicates(["id", "text_hash"])
    wanted = wanted.withColumnsRenamed({"id": "w_id", "text_hash": "w_hash"})
    with_text = dealt(kept_texts.join(wanted, same("w_id", "w_hash")).select("key", "across", "side", "uid", "signature", "copies", "text"), "key", "across")
    found = stage(with_text.mapInArrow(partial(_verify, threshold), "kind long, x long, y long"), "near-links")
    discard(met, left, reps)

    links = found.where("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("links"))
    joined = connected_components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    joined = joined.select(F.col("node").alias("rep"), "component")
    whole = classes.join(joined, "rep", "left").join(links, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    whole = stage(whole, "near-linked")
    least = whole.groupBy("component").agg(_least_id("copy_id").alias("class_id"))
    whole = join_groups(whole, least, ["component"], broadcast_rows=broadcast_rows).select(
        "h1", "h2", "class_id", "copy_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.col("component").alias("class_key"),
    )
    whole = stage(whole, "near-whole")
    # keys are the least uid of a class, and a row without words is a class of its own
    rows = base.select("id", "text_hash", "n_words", "h1", "h2", "uid")
    with_words = rows.where("n_words > 0").join(whole, ["h1", "h2"])
    without = rows.where("n_words = 0").select("*", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.col("uid").alias("class_key"))
    columns = [F.col("id").alias(id_col), "text_hash", "class_id", "copy_id", "n_links", "class_key"]
    return with_words.select(*columns).unionAll(without.select(*columns))


def _only(rows: DataFrame, wanted: DataFrame, same: Column, broadcast_rows: int) -> DataFrame:
    """The rows that ``same`` pairs with one of ``wanted``; they stay where they are if those are few."""
    wanted = stage(wanted, "near-only")
    return rows.join(F.broadcast(wanted) if is_small(wanted, broadcast_rows) else wanted, same, "left_semi")


def _least_id(column: str) -> Column:
    """The least value of a group; a null is the least of all."""
    return F.when(F.count(column) == F.count("*"), F.min(column))


def keep_first_of_class(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of ``found``: that of the least id.

    Null ids count as the least, and of several texts with that id the one of
    the least hash stays.  Classes that share an id, or have none, keep a row
    each.  Of repeated rows (equal in id and text, with words or without) one
    stays.
    """
    found = found.select(F.col(id_col).alias("id"), "text_hash", "class_key")
    # rows equal in id and text are one from here on
    rows = found.groupBy("id", "text_hash").agg(F.min("class_key").alias("class_key"), F.count("*").alias("n"))
    rows = stage(rows, "near-found")
    first = rows.groupBy("class_key").agg(F.min(F.struct("id", "text_hash", "n")).alias("first"))
    i, h = fresh(docs, "__id"), fresh(docs, "__hash")
    first = stage(first.select(F.col("first.id").alias(i), F.col("first.text_hash").alias(h), F.col("first.n").alias("n")), "near-first")
    # all rows but the first of each class go
    same = F.col("id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(h))
    gone = rows.join(first, same, "left_anti").select(F.col("id").alias(id_col), "text_hash")
    kept = drop_rows(docs, gone, id_col, text_col)
    # repeated rows among those that stay
    twice = stage(first.where("n > 1").select(i, h), "near-twice")
    if twice.isEmpty():
        return kept
    row = same_row(kept, id_col, text_col, i, h)
    once = kept.join(twice, row, "left_semi").dropDuplicates([id_col, text_col])
    return without(kept, twice, row).unionByName(once)
