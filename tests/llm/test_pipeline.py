"""Every stage of the pipeline against a plain version of it, on that stage's own input."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_documents import brute_scores

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from sievelight.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and result of each stage, written and read again."""
    folder, made = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        made.append((docs, out))
        docs = out
    return made


def oracle(docs, sql):
    con = duckdb.connect()
    given = docs.toArrow()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    for t in ("benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con.execute(sql).fetchall()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token records"]
    for docs, out in steps[:4]:
        assert out.dtypes == docs.dtypes


def test_rejected_documents_go(spark, steps):
    docs, out = steps[0]
    model = queries.quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {i for i, *_, keep in brute_scores(docs, model) if keep}
    assert {str(r.doc_id) for r in out.collect()} == keep and 0 < len(keep) < docs.count()
    assert rows(out) == Counter({r: n for r, n in rows(docs).items() if str(r[0]) in keep})


def test_one_of_each_group_stays(steps):
    docs, out = steps[1]
    found = oracle(docs, queries._OP2_SQL)
    assert {r.doc_id for r in out.collect()} == {c for _, c, *_ in found} and out.count() < docs.count()
    assert not rows(out) - rows(docs)


def test_documents_with_passages_go(steps):
    docs, out = steps[2]
    found = {i for i, *_ in oracle(docs, queries.ORACLE_SQL["op3_decontamination"])}
    assert found and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - found
    assert not rows(out) - rows(docs)


def test_sources_are_mixed(steps):
    docs, out = steps[3]
    copies = {r[0]: r[5] for r in oracle(docs, queries.ORACLE_SQL["op6_mix"])}
    assert rows(out) == Counter({r: n * copies[r[0]] for r, n in rows(docs).items() if copies[r[0]]})


def test_records_hold_the_ids(steps):
    from tokenizers import Tokenizer

    docs, out = steps[4]
    lib = Tokenizer.from_file(queries.vocabulary())
    got = out.orderBy("start").collect()
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
