"""Benchmark decontamination by spaced seeds.

A seed is a mask over a few neighbouring words; the positions that it leaves
out may differ.  Every mask is hashed at every word of every benchmark item
and of every document, and the two tables of hashes are joined.  Equal hashes
lay the two texts over one another, and the overlap is verified word by word:
it counts if a stretch of at least ``least`` words (or the whole item, if that
is shorter) agrees in at least ``identity`` of its words.  The masks are
chosen so that no such stretch of 13 to 25 words escapes all of them, wherever
its substitutions stand.  A longer one can be cut in two of at least 13 words,
and one of the two counts as well, so none of any length escapes.

The benchmark is a table like any other: its seeds, its words and the hits
stay distributed.  Documents send only hashes that pass a filter over the
benchmark's seeds, whose size is bounded; a full filter lets more through and
loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.arrow import bound_batches, slices
from sievelight.llm.hashing import U64, WORD_BASE, batches, mix, word_hashes
from sievelight.llm.rows import drop_rows
from sievelight.plans.sizing import BROADCAST_ROWS, is_small, join_groups
from sievelight.plans.staging import discard, stage

#: Positions that count.  Together they find every stretch of LEAST words and more in which IDENTITY of them agree.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7), (0, 1, 2, 5, 9, 11), (0, 1, 2, 4, 5, 6))
LEAST, IDENTITY = 13, 0.8
#: Least and most bits of the filter, as powers of two, and how many a seed gets in between.
FILTER_BITS, BITS_A_SEED = (16, 27), 16
#: Hits of a document, about, for which its text is read once more; a window of it is cut for each.
HITS_A_TEXT = 20_000


def masks_for(n_words: int, least: int = LEAST, identity: float = IDENTITY) -> tuple[tuple[int, ...], ...]:
    """Masks that find an item: an item shorter than ``least`` has one plain run of words.

    With s substitutions allowed in n words, one of the s + 1 runs between
    them has at least (n - s) / (s + 1) words.  That is not always least for
    the shortest stretch, so all lengths count that cannot be cut in two.
    """
    if n_words >= least and least == LEAST and identity == IDENTITY:
        return MASKS
    runs = []
    for n in range(min(n_words, least), min(n_words, 2 * least - 1) + 1):
        wrong = int(n * (1 - identity) + 1e-9)
        runs.append(-(-(n - wrong) // (wrong + 1)))
    return (tuple(range(min(runs))),)


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the mask laid on each word; as many as fit into the row of words."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, U64)
    salt = U64(sum((p + 1) * 0x1000193 ** (k + 1) for k, p in enumerate(mask)) % (1 << 64))
    total = np.full(n, salt, U64)
    for p in mask:
        total += words[p : p + n] * U64(pow(WORD_BASE, p + 1, 1 << 64))
    return mix(total)


def overlap(text: np.ndarray, item: np.ndarray, shift: int, least: int = LEAST, identity: float = IDENTITY) -> tuple[int, int, int, int] | None:
    """Longest stretch that counts where word ``p`` of the item lies on word ``p + shift`` of the text.

    Returns the start in the text, the start in the item, the length and the
    words that agree.  With one point for a word that agrees and ``identity /
    (1 - identity)`` off for one that does not, a stretch counts if its sum is
    not negative.
    """
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    need = min(least, len(item))
    if hi - lo < need:
        return None
    same = text[lo + shift : hi + shift] == item[lo:hi]
    points = np.where(same, 1 - identity, -identity)
    sums = np.concatenate([[0.0], np.cumsum(points)])
    # a stretch neither begins nor ends with a word that differs
    lowest = np.minimum.accumulate(np.where(same, sums[:-1], np.inf))
    ends = np.flatnonzero(same) + 1
    if not len(ends):
        return None
    starts = np.searchsorted(-lowest, -(sums[ends] + 1e-9), side="left")
    longest = int(np.argmax(ends - starts))
    begin, end = int(starts[longest]), int(ends[longest])
    if end - begin < need:
        # trimmed below the least length: the untrimmed stretch of a short item counts
        if not (len(item) <= least and len(ends) >= identity * len(item) - 1e-9):
            return None
        begin, end = int(ends[0]) - 1, int(ends[-1])
    return lo + shift + begin, lo + begin, end - begin, int(same[begin:end].sum())


def _list(values: list[np.ndarray]) -> pa.Array:
    """A column of lists of hashes."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, U64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _words(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item, words`` of the items with words."""
    for batch in slices(batches_, 1):
        words, at = word_hashes(batch.column(1).to_pylist())
        some = np.flatnonzero(np.diff(at))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), _list([words[at[k] : at[k + 1]] for k in some])], names=["item", "words"])


def _item_seeds(least: int, identity: float, batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``seed, no, at, mask`` of every place of every item."""
    for batch in batches_:
        for no, words in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words.values.to_numpy().view(U64)
            for mask in masks_for(len(words), least, identity):
                found = seeds(words, mask).view(np.int64)
                at, label = pa.array(np.arange(len(found))), ",".join(map(str, mask))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), no)), at, pa.array([label] * len(found), pa.string())], names=["seed", "no", "at", "mask"]
                )


def _doc_seeds(held, batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, text_hash, seed, place`` of the places of documents whose seed passes the filter."""
    masks, sieve = held.value
    bits = U64(8 * len(sieve) - 1)
    for batch in slices(batches_, 1):
        texts = batch.column(1).to_pylist()
        for a, b in batches(texts):
            words, offsets = word_hashes(texts[a:b])
            for mask in masks:
                found = seeds(words, mask)
                at = found & bits
                place = np.flatnonzero(sieve[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & np.uint8(1))
                doc = np.searchsorted(offsets, place, side="right") - 1
                inside = place + mask[-1] < offsets[doc + 1]  # a seed of one text alone
                place, doc = place[inside], doc[inside]
                if len(place):
                    row = pa.array(a + doc)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), batch.column(2).take(row), pa.array(found[place].view(np.int64)), pa.array(place - offsets[doc])],
                        names=["id", "text_hash", "seed", "place"],
                    )


def _cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of ``id, text, text_hash, shifts, items, sizes`` a window of hashed words for each hit."""
    names = ["id", "text_hash", "no", "shift", "from", "window"]
    for batch in slices(batches_, 1):
        ids, hashes = batch.column(0), batch.column(2)
        rows, windows, held = [], [], 0
        for k, text in enumerate(batch.column(1)):
            words, _ = word_hashes([text.as_py()])
            for shift, no, n in zip(*(batch.column(c)[k].as_py() for c in (3, 4, 5))):
                start = max(0, shift)
                windows.append(words[start : max(start, shift + n)])
                rows.append((k, no, shift, start))
                held += len(windows[-1])
                if held > 1 << 19:
                    yield _windows(ids, hashes, rows, windows, names)
                    rows, windows, held = [], [], 0
        if rows:
            yield _windows(ids, hashes, rows, windows, names)


def _windows(ids, hashes, rows, windows, names) -> pa.RecordBatch:
    k, *rest = zip(*rows)
    k = pa.array(k)
    return pa.RecordBatch.from_arrays([ids.take(k), hashes.take(k), *(pa.array(c, pa.int64()) for c in rest), _list(windows)], names=names)


def _verify(least: int, identity: float, batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of ``id, text_hash, item, shift, from, window, words`` the overlaps that count."""
    names = ["id", "text_hash", "item", "doc_start", "item_start", "n_words", "n_equal"]
    for batch in batches_:
        keep, made = [], []
        for k, (shift, start, window, words) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), batch.column(6))):
            found = overlap(window.values.to_numpy(), words.values.to_numpy(), shift - start, least, identity)
            if found:
                keep.append(k)
                made.append((found[0] + start, *found[1:]))
        columns = zip(*made) if made else [[]] * 4
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *(pa.array(list(c), pa.int64()) for c in columns)], names=names)


def _filter(index: DataFrame, n_seeds: int) -> np.ndarray:
    """A bitmap over the lowest bits of all seeds; its size is bounded whatever their number."""
    least, most = FILTER_BITS
    bits = min(most, max(least, (n_seeds * BITS_A_SEED).bit_length()))
    # one row for each 32 bits that are in use
    rows = index.select(F.expr(f"shiftright(seed & {(1 << bits) - 1}L, 5)").alias("k"), F.expr("shiftleft(1L, cast(seed & 31L as int))").alias("b"))
    rows = rows.groupBy("k").agg(F.bit_or("b").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 5), "<u4")
    out[rows.column("k").to_numpy()] = rows.column("v").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = LEAST,
    identity: float = IDENTITY,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row for each document and benchmark item that overlap.

    ``id_col, text_hash, item_col, doc_start, item_start, n_words, n_equal``
    describe the overlap with the most equal words (places count words from 0;
    of equal ones the first in the document, then in the item); ``text_hash``
    tells rows with one id apart, and rows equal in id and text give one
    result.  Ids are integers, or texts that hold some.  Null texts and items,
    and those without words, overlap with nothing; null and repeated ids keep
    their rows, and items of one id count as one; empty tables give no rows;
    other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    known = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    known = known.mapInArrow(_words, "item long, words array<long>").withColumn("no", F.monotonically_increasing_id())
    known = stage(known, "benchmark-words")
    index = known.select("no", "words").mapInArrow(partial(_item_seeds, least, identity), "seed long, no long, at long, mask string")
    index = stage(index, "benchmark-seeds")
    used = index.groupBy("mask").agg(F.count("*").alias("n")).collect()  # the masks are a few
    masks = tuple(sorted(tuple(map(int, r["mask"].split(","))) for r in used))
    sieve = spark.sparkContext.broadcast((masks, _filter(index, sum(r.n for r in used))))

    met = texts.mapInArrow(partial(_doc_seeds, sieve), "id long, text_hash long, seed long, place long")
    few = is_small(index, broadcast_rows)
    # beside many seeds the documents' hashes are written, so that both sides come from exchanges that Spark can split
    hits = met.join(F.broadcast(index), "seed") if few else stage(met, "seeds-met").join(index, "seed")
    hits = hits.select("id", "text_hash", "no", (F.col("place") - F.col("at")).alias("shift")).distinct()
    hits = stage(join_groups(stage(hits, "seed-hits"), known.select("no", "item", F.size("words").alias("n")), ["no"], broadcast_rows=broadcast_rows), "hits")

    # every hit gets its window of the document; the hits of a document come in shares of bounded size
    shares = hits.groupBy("id", "text_hash").agg(F.ceil(F.count("*") / HITS_A_TEXT).alias("shares"))
    dealt = join_groups(hits, shares, ["id", "text_hash"], broadcast_rows=broadcast_rows)
    lists = dealt.groupBy("id", "text_hash", F.pmod(F.xxhash64("no", "shift"), F.col("shares")).alias("share"))
    lists = lists.agg(F.collect_list(F.struct("shift", "no", "n")).alias("h"))
    lists = stage(lists.select(F.col("id").alias("h_id"), F.col("text_hash").alias("h_hash"), "h.shift", "h.no", "h.n"), "hit-lists")
    keys = stage(lists.select(F.col("h_id").alias("k_id"), F.col("h_hash").alias("k_hash")).distinct(), "hit-texts")
    same = lambda i, h: F.col("id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(h))
    found = texts.join(F.broadcast(keys) if is_small(keys, broadcast_rows) else keys, same("k_id", "k_hash"), "left_semi").dropDuplicates(["id", "text_hash"])
    found = found.join(lists, same("h_id", "h_hash")).select("id", "text", "text_hash", "shift", "no", "n")
    cut = found.mapInArrow(_cut, "id long, text_hash long, no long, shift long, from long, window array<long>")
    cut = stage(cut, "hit-windows")
    laid = join_groups(cut, known, ["no"], broadcast_rows=broadcast_rows).select("id", "text_hash", "item", "shift", "from", "window", "words")
    schema = "id long, text_hash long, item long, doc_start long, item_start long, n_words long, n_equal long"
    counted = laid.mapInArrow(partial(_verify, least, identity), schema)
    best = F.struct((-F.col("n_equal")).alias("e"), "doc_start", "item_start", F.col("n_words").alias("n"))
    counted = counted.groupBy("id", "text_hash", "item").agg(F.min(best).alias("b"))
    counted = stage(counted.select("id", "text_hash", "item", "b.doc_start", "b.item_start", F.col("b.n").alias("n_words"), (-F.col("b.e")).alias("n_equal")), "overlaps")
    discard(index, hits, lists, keys, cut, known)
    return counted.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item."""
    return drop_rows(docs, find_overlaps(docs, benchmark, id_col, text_col), id_col, text_col)


def _word_list(text: str) -> str:
    return f"[x FOR x IN string_split_regex(lower({text}), '[\\x00-/:-@\\[-^`{{-\\x7f]+') IF x <> '']"


def oracle() -> str:
    """The same in SQL over ``documents`` and ``benchmark``, for items of 13 words and more.

    Seeds are lists of words there, and every stretch between two equal words
    of an overlap is counted.
    """
    one = []
    for k, mask in enumerate(MASKS):
        seed = "[" + ", ".join(f"w[p + {at}]" for at in mask) + "]"
        one.append(f"SELECT *, {k} AS m, unnest([struct_pack(p := p, s := {seed}) FOR p IN range(1, len(w) - {mask[-1]} + 1)]) AS u FROM {{}}")
    both = lambda table: " UNION ALL ".join(x.format(table) for x in one)
    return f"""
WITH d AS (SELECT doc_id, {_word_list("text")} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_word_list("text")} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, m, u.p AS p, u.s AS s FROM ({both("d")})),
bs AS (SELECT item_id, m, u.p AS p, u.s AS s FROM ({both("b")})),
h AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS shift FROM ds JOIN bs ON ds.m = bs.m AND ds.s = bs.s),
l AS (SELECT doc_id, item_id, shift, greatest(1, 1 - shift) AS lo, least(len(b.w), len(d.w) - shift) AS hi, d.w AS dw, b.w AS bw
      FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
e AS (SELECT doc_id, item_id, shift, [p FOR p IN range(lo, hi + 1) IF dw[p + shift] = bw[p]] AS e FROM l),
x AS (SELECT doc_id, item_id, shift, e, unnest(range(1, len(e) + 1)) AS i FROM e),
y AS (SELECT doc_id, item_id, shift, e, i, unnest(range(i, len(e) + 1)) AS j FROM x),
z AS (SELECT doc_id, item_id, shift, e[i] AS p, e[j] - e[i] + 1 AS n, j - i + 1 AS q FROM y
      WHERE e[j] - e[i] + 1 >= {LEAST} AND 5 * (j - i + 1) >= 4 * (e[j] - e[i] + 1)),
longest AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY n DESC, p) AS k FROM z),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY q DESC, p + shift, p) AS r FROM longest WHERE k = 1)
SELECT doc_id, item_id, p + shift - 1 AS doc_start, p - 1 AS item_start, n AS n_words, q AS n_equal FROM best WHERE r = 1"""
