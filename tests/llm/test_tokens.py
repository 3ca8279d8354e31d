import struct
import weakref
import zlib
from functools import partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from sievelight.llm import near_duplicates, quality, token_counts, token_records  # noqa: E402
from sievelight.llm.encoding import PieceEncoder, encoder  # noqa: E402
from sievelight.llm.ranges import plan_ranges, sized  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = PieceEncoder(PATH)
TEXTS = st.lists(
    st.sampled_from([*"abZ \n\t1,.!|'é漢Ω½Ⅷ-_", " ", " ", "\x1c", "\x85", " ", " ", "<|endoftext|>", " the", "'s", "It's", "\r\n"]), max_size=40
).map("".join)


@settings(max_examples=2000, deadline=None)
@given(TEXTS)
def test_pieces_give_the_ids_of_the_whole(text):
    whole = ENCODER.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == whole
    assert ENCODER.count(text) == len(whole)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_whole(name):
    enc = PieceEncoder(public_tokenizers.path(name))
    text = "Hello  World, it's <|endoftext|> here\n"
    lib = enc.library
    want = lib.encode(text, add_special_tokens=False).ids if name.endswith("json") else lib.encode(text)
    assert enc.count(text) == len(want)


def expected(rows):
    lib = ENCODER.library
    return sorted(((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in rows), key=repr)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_counts(spark, odd_docs, broadcast_rows):
    got = token_counts.count_tokens(odd_docs, PATH, broadcast_rows=broadcast_rows).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == expected(odd_docs.collect())
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_counts_are_kept(spark, odd_docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = token_counts.count_tokens(odd_docs.where("doc_id < 5"), PATH, cache).count()
    n = spark.read.parquet(cache).count()
    token_counts.count_tokens(odd_docs, PATH, cache).collect()
    digests = odd_docs.selectExpr("sha2(coalesce(text, ''), 256) d").distinct().count()
    assert first == 5 and n < digests == spark.read.parquet(cache).count()  # only misses were appended


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_only_distinct_misses_are_encoded(spark, tmp_path, broadcast_rows):
    """What is appended is what the encoder was asked for: one row a digest, whatever ids repeat."""
    one, two = "a text that comes very often", "another one"
    rows = [(None, one)] * 40 + [(7, one)] * 30 + [(None, two)] * 20 + [(3, two), (3, "third"), (4, "third"), (5, None), (6, ""), (8, "alone")]
    docs, cache = spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/cache"
    for extra in ([], [(9, one), (9, "late"), (None, "late"), (None, "late")]):
        more = docs.unionByName(spark.createDataFrame(extra, docs.schema)) if extra else docs
        got = token_counts.count_tokens(more, PATH, cache, broadcast_rows=broadcast_rows)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=repr) == expected(more.collect())
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == 6


def test_no_documents(spark, no_docs, tmp_path):
    assert token_counts.count_tokens(no_docs, PATH).count() == 0
    token_records.write_records(no_docs, f"file://{tmp_path}/r", PATH)
    assert token_records.read_records(spark, f"file://{tmp_path}/r").count() == 0


def test_records(spark, odd_docs, tmp_path):
    folder = f"file://{tmp_path}/records"
    manifest = token_records.write_records(odd_docs, folder, PATH, files=3)
    rows = token_records.read_records(spark, folder).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    want = sorted((str(r.doc_id), ENCODER.library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()] and manifest["n_ids"] == sum(r.n_tokens for r in rows)
    digests = {r.start: r.ids_crc32 for r in token_records.read_records(spark, folder, digest=True).collect()}
    assert digests == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    part = max(manifest["files"], key=lambda f: f["n_docs"])
    plain = list(token_records.records_of(folder, part["name"], manifest["width"]))
    order = np.arange(len(plain))[::-1]
    assert list(token_records.records_of(folder, part["name"], manifest["width"], order)) == plain[::-1]


def test_records_of_hot_ids(spark, tmp_path):
    """Rows of one id, equal ones among them, and rows without an id come in several files, in order of ids."""
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"some words {k % 50}") for k in range(300)]
    folder = f"file://{tmp_path}/hot"
    manifest = token_records.write_records(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, files=12)
    assert max(f["n_docs"] for f in manifest["files"]) < 80 and sum(f["n_docs"] for f in manifest["files"]) == 300
    got = token_records.read_records(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((str(i), ENCODER.library.encode(t, add_special_tokens=False).ids + [0]) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want


def test_tables_of_the_driver_start_no_python(spark, odd_docs, tmp_path):
    """Ranges, hot ids and names of files are no RDDs of Python objects, with rows or without."""
    for docs, label in ((odd_docs, "some"), (odd_docs.limit(0), "none")):
        folder = f"file://{tmp_path}/{label}"
        token_records.write_records(docs, folder, PATH, files=3)
        bins, hot, *_ = plan_ranges(sized(docs, "doc_id", "text"), 3)
        for df in (bins, hot, token_records.read_records(spark, folder, digest=True)):
            plan = "LocalRelation" if df is None else df._jdf.queryExecution().analyzed().toString()
            assert "LocalRelation" in plan and "LogicalRDD" not in plan and "ExternalRDD" not in plan
        assert token_records.read_records(spark, folder).count() == docs.count()


def test_other_work_frees_the_encoder():
    """A worker that scores or compares texts gives up the encoder of the task before, and the texts get the same ids later."""
    model = SimpleNamespace(value=quality.fit(np.zeros((0, quality.FEATURES)), np.zeros(0)))
    texts = pa.RecordBatch.from_pydict({"id": [1], "text": ["some words here and there"], "text_hash": [2], "host": ["a"], "path": ["b"]})
    scored = pa.RecordBatch.from_pydict({"text": ["some words"], "y": [1.0], "h": [3]})
    for work, batch in ((quality._featurise, scored), (partial(quality._score, model), texts), (near_duplicates._digest, texts.select([0, 1, 2]))):
        kept = weakref.ref(encoder(PATH))
        before = kept().encode("some words again, some words")
        assert sum(b.num_rows for b in work(iter([batch]))) == 1
        assert kept() is None and encoder(PATH).encode("some words again, some words") == before


def test_damage_is_seen():
    data = bytearray(token_records.frame(b"payload"))
    assert token_records.unframe(data, 0) == (b"payload", len(data))
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises((ValueError, struct.error)):
            token_records.unframe(bytes(bad), 0)
