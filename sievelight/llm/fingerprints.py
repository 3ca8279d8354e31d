"""Homomorphic multiset fingerprints of documents.

A document is a multiset of paragraphs (its lines that are not blank).  Every
paragraph is hashed to a wide vector, and a document's fingerprint is the sum
of its paragraphs' vectors modulo 2**32 in each lane.  So the order of
paragraphs does not matter, and a paragraph is inserted or deleted by adding
or subtracting its vector.

The vector has two parts.  The first lanes are a cryptographic hash of the
paragraph: two documents agree in them when they hold the same paragraphs.
The others are a sketch of the paragraph's word triples, each adding one or
minus one to one lane, which is just as additive; the cosine of two such sums
estimates how much of their wording two documents share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.arrow import bound_batches, slices
from sievelight.llm.hashing import batches, shingle_hashes, word_hashes
from sievelight.llm.ranges import place_rows, plan_ranges, sized
from sievelight.plans.staging import discard, stage

EXACT_LANES, SKETCH_LANES = 16, 256
LANES = EXACT_LANES + SKETCH_LANES
#: Words of a sketched run.
RUN = 3
#: Ranges of documents, at least; more as their bytes call for it.
LEAST_RANGES = 64


def paragraphs(text: str | None) -> list[str]:
    return [p for p in (text or "").split("\n") if p.strip()]


def paragraph_vectors(found: list[str]) -> np.ndarray:
    """One row of ``LANES`` unsigned 32-bit lanes a paragraph (a text without line breaks)."""
    return np.concatenate([np.zeros((0, LANES), np.uint32), fingerprints(found)])


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One row a text: the sum of its paragraphs' vectors modulo 2**32."""
    out = np.zeros((len(texts), LANES), np.uint32)
    for a, b in batches(texts):
        found = [paragraphs(t) for t in texts[a:b]]
        owner = np.repeat(np.arange(a, b), [len(f) for f in found])
        flat = [p for f in found for p in f]
        if flat:
            exact = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=4 * EXACT_LANES).digest() for p in flat)
            lanes = np.frombuffer(exact, "<u4").reshape(len(flat), EXACT_LANES)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[first], :EXACT_LANES] = np.add.reduceat(lanes, first, axis=0, dtype=np.uint32)
            # the sketch of a sum is the sum of the sketches: shingles stay inside paragraphs
            hashes, offsets = shingle_hashes(*word_hashes(flat), k=RUN)
            text_of = np.repeat(owner - a, np.diff(offsets))
            lane = (hashes & np.uint64(SKETCH_LANES - 1)).astype(np.int64)
            sign = 1.0 - 2.0 * ((hashes >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
            sums = np.bincount(text_of * SKETCH_LANES + lane, weights=sign, minlength=(b - a) * SKETCH_LANES)
            out[a:b, EXACT_LANES:] = sums.reshape(b - a, SKETCH_LANES).astype(np.int64).astype(np.uint32)
    return out


def insert(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint + paragraph_vectors([paragraph])[0]


def delete(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint - paragraph_vectors([paragraph])[0]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of wording, 0 to 1, by row: 1 for equal fingerprints, 0 beside an empty one."""
    a = left[:, EXACT_LANES:].astype(np.int32).astype(np.float64)
    b = right[:, EXACT_LANES:].astype(np.int32).astype(np.float64)
    norms = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.divide((a * b).sum(1), norms, out=np.zeros(len(a)), where=norms > 0)
    return np.where((left == right).all(1), 1.0, np.clip(cosine, 0.0, 1.0))


def to_text(rows: np.ndarray) -> list[str]:
    return [base64.b64encode(r.astype("<u4").tobytes()).decode() for r in rows]


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4").astype(np.uint32)


def _compare(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``bucket, ahead, id, text`` in order; each is compared with the row behind it.

    The last row of a bucket is the first document of the next one (or, at
    the end, of all) and only looked at.
    """
    held: list[tuple] = []
    size = 0

    def rows():
        for batch in slices(batches_, 3):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for row in rows():
        held.append(row)
        size += len(row[3] or "") + 1
        if len(held) > 1 and (size > 1 << 20 or len(held) > 4096):
            yield from _pairs(held)
            held, size = held[-1:], len(held[-1][3] or "") + 1
    if len(held) > 1:
        yield from _pairs(held)


def _pairs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    now = [(a, b) for a, b in zip(held, held[1:]) if not a[1] and a[0] == b[0]]
    if not now:
        return
    ids = [a[2] for a, _ in now]
    texts, nexts, edited = [], [], []
    for a, b in now:
        text, next_ = a[3] or "", b[3] or ""
        half = len(text) // 2
        texts.append(text)
        nexts.append(next_)
        edited.append(text[: len(text) - half] + next_[:half])
    own, other, new = fingerprints(texts), fingerprints(nexts), fingerprints(edited)
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    columns = (
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(to_text(own)),
        pa.array(to_text(new)), pa.array(likeness(own, new)), pa.array(likeness(own, other)),
    )
    yield pa.RecordBatch.from_arrays(list(columns), names=[f.split()[0] for f in _SCHEMA.split(", ")])


_SCHEMA = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int = LEAST_RANGES) -> DataFrame:
    """Fingerprints of all texts and of edited ones, with their likeness.

    A text is edited by replacing its last half with the beginning of the
    next document in descending order of ids (after the last: the first).
    Null texts are empty; of equal ids the text of the greater ``xxhash64``
    comes first; a null id comes last; a single document is its own next;
    other columns are ignored.  Ids are integers, or texts that hold some.

    Documents move once, to the range of ids that holds them; ranges have
    nearly equal bytes, and an id with very many texts has several.  Each
    range also gets the first document of the range behind it.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sizes = sized(docs, id_col, text_col)
    plan = plan_ranges(sizes, ranges)
    discard(sizes)
    n = plan[-1]
    if not n:
        return spark.createDataFrame([], _SCHEMA).withColumnRenamed("id", id_col)
    # ranges count up as ids go down
    rows = place_rows(rows, plan, F.col("hash")).withColumn("bucket", F.lit(n - 1) - F.col("bucket"))
    # the first document of each range: a row a range
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("id", "hash")).alias("head")).orderBy("bucket").collect()
    heads = [(r["head"].id, r["head"]["hash"], firsts[k - 1].bucket) for k, r in enumerate(firsts)]  # the first of all follows the last
    heads = spark.createDataFrame(heads, "h_id long, h_hash long, before int")
    head_rows = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("h_id")) & (F.col("hash") == F.col("h_hash")))
    head_rows = stage(head_rows.groupBy("before", "id", "hash").agg(F.min("text").alias("text")), "range-heads")
    ahead = head_rows.select(F.col("before").alias("bucket"), F.lit(True).alias("ahead"), "id", "text", "hash")
    all_rows = rows.select("bucket", F.lit(False).alias("ahead"), "id", "text", "hash").unionByName(ahead)
    placed = all_rows.repartitionById(n, F.col("bucket"))
    placed = placed.sortWithinPartitions("bucket", "ahead", F.col("id").desc_nulls_last(), F.col("hash").desc(), "text").drop("hash")
    return placed.mapInArrow(_compare, _SCHEMA).withColumnRenamed("id", id_col)
