"""Token ids in length-delimited binary records with an offset index.

A data file is a row of frames::

    length u64 | masked checksum of the length u32 | payload | masked checksum of the payload u32

and a payload is ``id i64 | flags u8 | token ids`` (flag 1: the id is null).
All integers are little-endian; the ids have two bytes where the vocabulary
fits, else four.  Beside it lies an index with, for every record, the offset
of its frame, the number of ids before it in the file, and its number of ids,
so a reader can take records in any order.  ``manifest.json`` names the files
in order of the document ids and is written last: a folder without it is no
finished output, and files of lost or doubled task attempts are not in it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.arrow import bound_batches, slices, small_table
from sievelight.llm.encoding import encoder
from sievelight.llm.ranges import place_rows, plan_ranges, sized
from sievelight.plans.staging import discard

#: Frames are checked by CRC-32, rotated and shifted so that a checksum of
#: data that holds checksums stays sound.
MASK_DELTA = 0xA282EAD8
HEAD, TAIL, LEAD = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB")
INDEX = np.dtype([("offset", "<u8"), ("start", "<u8"), ("n_ids", "<u4")])
LEAST_FILES = 48


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(data: bytes, offset: int) -> tuple[bytes, int]:
    """The payload at ``offset`` and the offset behind its frame."""
    length, check = HEAD.unpack_from(data, offset)
    if masked(data[offset : offset + 8]) != check:
        raise ValueError(f"bad length checksum at {offset}")
    start = offset + HEAD.size
    payload = bytes(data[start : start + length])
    if len(payload) != length or TAIL.unpack_from(data, start + length)[0] != masked(payload):
        raise ValueError(f"bad payload checksum at {offset}")
    return payload, start + length + TAIL.size


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _encode(path: str, end_id: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, id, ids): the bucket is the file that a document belongs to."""
    enc = encoder(path)
    end = b"" if end_id is None else int(end_id).to_bytes(enc.width, "little")
    for batch in slices(batches, 1):
        made = [enc.encode(t.as_py()) + end for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(made, pa.binary())], names=["bucket", "id", "ids"])


def _write(folder: str, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, root = _filesystem(folder)
    out, index, bucket, name = None, [], None, ""
    offset = start = 0
    done = []

    def close():
        nonlocal out
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(np.array(index, dtype=INDEX).tobytes())
        done.append((bucket, name, len(index), start, offset))
        out = None

    for batch in slices(batches, 2):
        for b, key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket or out is None:
                close()
                bucket, index, offset, start = b, [], 0, 0
                name = f"part-{b:06d}-{uuid.uuid4().hex[:8]}"
                out = fs.open_output_stream(f"{root}/{name}.rec")
            framed = frame(LEAD.pack(key or 0, key is None) + ids)
            out.write(framed)
            index.append((offset, start, len(ids) // width))
            offset += len(framed)
            start += len(ids) // width
    close()
    if done:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*done)], names=["bucket", "name", "n_docs", "n_ids", "n_bytes"]
        )


def write_records(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
) -> dict:
    """Encode every whole text and write it in ascending id order; returns the manifest.

    A null text is empty (only the end id); a null id comes first; rows with
    one id stand together, in no stated order, and in several files where they
    are many; an empty table gives a manifest without files; other columns are
    ignored.  Ids are integers, or texts that hold some.  Files have nearly
    equal bytes of text.  Texts are encoded where they are read and only ids
    move, once, to the file they belong to.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sizes = sized(docs, id_col, text_col)
    plan = plan_ranges(sizes, files or LEAST_FILES)
    width = encoder(tokenizer_path).width
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    parts = []
    if plan[-1]:
        # equal rows of one id are spread as well
        placed = place_rows(rows, plan, F.xxhash64("text", F.monotonically_increasing_id())).select("id", "text", "bucket")
        encoded = placed.mapInArrow(partial(_encode, tokenizer_path, end_id), "bucket int, id long, ids binary")
        placed = encoded.repartitionById(plan[-1], F.col("bucket")).sortWithinPartitions("bucket", "id", "ids")
        parts = placed.mapInArrow(partial(_write, folder, width), "bucket long, name string, n_docs long, n_ids long, n_bytes long").collect()
    discard(sizes)
    manifest = {"format": "framed-token-ids", "width": width, "end_id": end_id, "files": []}
    start = 0
    for p in sorted(parts):
        manifest["files"].append({"name": p.name, "n_docs": p.n_docs, "n_ids": p.n_ids, "n_bytes": p.n_bytes, "start": start})
        start += p.n_ids
    manifest["n_ids"] = start
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, root = _filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def records_of(folder: str, name: str, width: int, order: np.ndarray | None = None) -> Iterator[tuple]:
    """``(id, ids before it in the file, raw ids)`` of one file, in file order or in ``order``."""
    fs, root = _filesystem(folder)
    with fs.open_input_stream(f"{root}/{name}.idx") as f:
        index = np.frombuffer(f.read(), dtype=INDEX)
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        if order is None:
            ends = [*index["offset"][1:].tolist(), f.size()]
        else:
            index, ends = index[order], None
        for k, (offset, start, n_ids) in enumerate(index.tolist()):
            # in order, frames follow one another and the stream needs no seek
            if ends is not None:
                data = f.read(ends[k] - offset)
            else:
                f.seek(offset)
                data = f.read(HEAD.size + LEAD.size + n_ids * width + TAIL.size)
            payload, _ = unframe(data, 0)
            key, null = LEAD.unpack_from(payload)
            ids = payload[LEAD.size :]
            if len(ids) != n_ids * width:
                raise ValueError(f"index and record differ in {name}")
            yield None if null else key, start, ids


def _read(folder: str, width: int, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, held = [], 0
            for key, start, ids in records_of(folder, name, width):
                wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                rows.append((key, base + start, len(wide), zlib.crc32(wide.tobytes()) if digest else wide))
                held += 0 if digest else wide.nbytes
                if len(rows) >= 10_000 or held > 32 << 20:
                    yield _batch(rows, digest)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, digest)


def _batch(rows: list, digest: bool) -> pa.RecordBatch:
    keys, starts, n, last = zip(*rows)
    made = pa.array(last, pa.int64()) if digest else pa.array([x.tolist() for x in last], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), made],
        names=["id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
    )


def read_records(spark: SparkSession, folder: str, digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Records of a finished folder, every frame checked: ``id_col, start, n_tokens`` and ``ids``.

    ``start`` counts the ids of all records before this one in the whole
    output.  With ``digest`` the ids come as ``ids_crc32``, the unsigned
    CRC-32 of them as little-endian unsigned 32-bit integers.
    """
    manifest = read_manifest(folder)
    last = "ids_crc32 long" if digest else "ids array<long>"
    schema = f"id long, start long, n_tokens long, {last}"
    files = [(f["name"], f["start"]) for f in manifest["files"]]
    if not files:
        out = small_table(spark, [], schema)
    else:
        named = small_table(spark, files, "name string, base long").repartition(min(len(files), 10_000))
        out = named.mapInArrow(partial(_read, folder, manifest["width"], digest), schema)
    return out.withColumnRenamed("id", id_col)
