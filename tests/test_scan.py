"""Sources, engines, reports and streams on small inputs."""

import json
import random
import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from sievelight.functions.text import entropy, is_high_entropy, lines_of, mask_key, redact
from sievelight.model import FINDING_COLUMNS, severity_order
from sievelight.operators import dependencies, line_rules, merge, model_review, python_ast
from sievelight.plans import corpora, queries, report, staging
from sievelight.plans.scan import Options, as_files, engines, register_engine, scan
from sievelight.plans.scan import report as report_of
from sievelight.sources import tree
from sievelight.sources.config import Config, ScanDefaults, load_config, save_config
from sievelight.sources.rules import AUTH, EXTENDED, JS, SECRETS, Rule, load_yaml_rules
from sievelight.streaming.incremental import scan_batches, watch_lines


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first().y


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "\n", "a\r\nb\rc\x0bd\x0ce\x85f g\n\n"])
def test_lines(spark, text):
    assert one(spark, text, lines_of(F.col("x"))) == text.splitlines()


def test_scalars(spark):
    assert one(spark, "", entropy(F.col("x"))) == 0.0 and one(spark, "aabb", entropy(F.col("x"))) == 1.0
    assert one(spark, "0123456789abcdef", is_high_entropy(F.col("x"))) is False
    assert one(spark, "k='abcdEFGHijklMNOPqrst'", redact(F.col("x"))) == "k='abcd***qrst'"
    assert one(spark, "k='abcdEFGHijklMNOPqrs'", redact(F.col("x"))) == "k='abcdEFGHijklMNOPqrs'"
    assert one(spark, "12345678", mask_key(F.col("x"))) == "•" * 8 and one(spark, "1234567890", mask_key(F.col("x"))) == "1234••7890"
    assert one(spark, "odd", severity_order(F.col("x"))) == 4


def test_each_secret_format(spark):
    names = {r.code: r.name for r in SECRETS}
    hits = corpora.SECRET_LINES
    assert set(hits) == set(names)
    files = as_files(spark.createDataFrame([(k, "\n".join(v)) for k, v in hits.items()], "path string, content string"), F.col("path"), "content")
    found = line_rules.match_rules(line_rules.explode_lines(files), SECRETS, "secrets").collect()
    assert {(f.file, f.title, f.line_start) for f in found} >= {(k, names[k], 1) for k in hits}
    assert not {(f.file, f.title) for f in found if f.line_start == 2} & {(k, names[k]) for k in hits}


def test_random_literal(spark):
    files = as_files(spark.createDataFrame([("a.py", 'x = "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY"\ny = "' + "ab" * 20 + '"\n')], "path string, content string"), F.col("path"), "content")
    assert [(f.line_start, f.title) for f in line_rules.secret_findings(files).collect()] == [(1, "High-Entropy String Literal")]


def test_look_ahead_rules_of_the_extended_pack(spark):
    ahead = [r for r in EXTENDED if "(?!" in r.pattern]
    text = "exec(user)\nexec('x')\nyaml.load(f)\nyaml.load(f, Loader=SafeLoader)\nres.cookie(a)\n"
    files = as_files(spark.createDataFrame([("a.py", text)], "path string, content string"), F.col("path"), "content")
    lines = {(f.title, f.line_start) for f in line_rules.extended_findings(files, ahead).collect()}
    assert ("Unsafe exec() with dynamic argument", 1) in lines and ("Unsafe exec() with dynamic argument", 2) not in lines
    assert ("yaml.load without SafeLoader", 3) in lines


def test_extended_pack_has_every_rule(spark):
    found = {(f.file, f.line_start, f.title) for f in queries.QUERIES["extended_pack"](spark, "").collect()}
    files = {**corpora.AUTH, **corpora.PYTHON}
    skip = re.compile(queries.CODE_SKIP)
    lines = [(path, k, line) for path, text in files.items() for k, line in enumerate(text.split("\n"), 1) if not skip.search(line)]
    assert found == {(path, k, r.title) for path, k, line in lines for r in EXTENDED if re.search(r.pattern, line)}
    ahead = {(k, title.split()[0] if "yaml" in title else title.split()[1]) for path, k, title in found if path == "p/a.py" and ("exec()" in title or "yaml" in title)}
    assert ahead == {(4, "exec()"), (15, "yaml.load"), (17, "yaml.load")}


def test_re2_twins_of_the_extended_pack():
    """The twins need no look-ahead and match the same lines."""
    rng = random.Random(4)
    parts = {
        "PY002": ["exec", "exec(", "(", ")", " ", "'", '"', "a", "f"],
        "PY009": ["yaml.load(", "yaml.load (", "SafeLoader", "S", "Safe", "SafeLoade", "SafeLoad", "r", " ", ")", "a", "aS"],
        "AY8": ["res.cookie(", "set_cookie(", "secure", "httpOnly", ")", " ", "a"],
    }
    ahead = [r for r in EXTENDED if "(?!" in r.pattern]
    assert {r.code for r in ahead} == set(parts)
    con = duckdb.connect()
    for r in ahead:
        lines = ["".join(rng.choices(parts[r.code], k=rng.randint(1, 12))) for _ in range(20_000)]
        same = con.execute("SELECT [regexp_matches(x, $2) FOR x IN $1]", [lines, r.re2]).fetchone()[0]
        want = [bool(re.search(r.pattern, x)) for x in lines]
        assert same == want and 0.05 < sum(want) / len(want) < 0.95



def test_syntax_tree_corners():
    assert python_ast.scan("def broken(:") == [] and python_ast.scan("") == [] and python_ast.scan("\0") == []
    assert python_ast.scan("(" * 5000 + ")" * 5000) == []
    assert [h[2] for h in python_ast.scan("a.pwd = other = 'longenough1'")] == ["Hardcoded Credential in Variable `pwd`"]
    assert python_ast.scan("try:\n    x\nexcept (Exception, OSError):\n    pass\n") == []
    assert [h[0] for h in python_ast.scan("try:\n    x\nexcept:\n    ...\n")] == [3]
    # a test that the library cannot print takes no other finding with it
    chain = " + ".join(f"n{i}" for i in range(3000))
    assert {h[0] for h in python_ast.scan(f"eval(x)\nassert {chain}\nhashlib.md5(b)\n")} == {1, 3}


@pytest.fixture
def source(tmp_path):
    for path, content in {
        "app/__init__.py": b"eval(x)\n", "app/a.py": b"password = 'hunter2hunter2'\n", "node_modules/x.js": b"eval(x)", ".hidden": b"x", ".env.json": b"{}",
        "out/b.py": b"eval(x)", "big.py": b"#" * 2000, "bin.dat": b"\x7fELF123", "zeros": b"\0" * 40, "bad.txt": b"caf\xe9", ".gitignore": b"# c\nout/\n*.log\n",
        "x.log": b"1", "empty.txt": b"",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    return tmp_path


def test_source_tree(spark, source):
    rows = {r.path: r for r in tree.read_tree(spark, str(source), max_file_size_kb=1).collect()}
    assert set(rows) == {"app/__init__.py", "app/a.py", ".env.json", "bad.txt", "empty.txt"}
    assert rows["bad.txt"].content == "caf" and rows["app/a.py"].language == "python" and rows["empty.txt"].language is None
    assert "out/b.py" in {r.path for r in tree.read_tree(spark, str(source), respect_ignore="false").collect()}
    assert [r.path for r in tree.read_tree(spark, str(source / "app/a.py")).collect()] == ["a.py"]
    assert {r.path for r in tree.read_tree(spark, f"file://{source}", max_file_size_kb=1).collect()} == set(rows)
    parts = tree._Reader({"path": str(source), "partition_bytes": 4096, "max_file_size_kb": "9"}).partitions()
    assert len(parts) == len({p for part in parts for p in part.paths}) and tree._Reader({"path": str(source / "none")}).partitions()[0].paths == []
    assert all(tree.is_binary(m + b"text") for m in tree.MAGIC + tree.MORE_MAGIC) and not tree.is_binary(b"text")


def test_whole_scan(spark, source, tmp_path):
    made = report.Report("abcd1234", str(source), datetime(2024, 1, 2), scan(tree.read_tree(spark, str(source))), 5, 1.5, ["secrets"])
    found = made.findings.collect()
    assert {(f.file, f.cwe) for f in found} == {("app/__init__.py", "CWE-78"), ("app/a.py", "CWE-798")}
    out = tmp_path / "report.json"
    report.write_json(made, str(out))
    data = json.loads(out.read_text())
    assert list(data) == ["scan_id", "target_path", "timestamp", "duration_seconds", "files_scanned", "scanners_used", "summary", "findings"]
    assert data["summary"]["total"] == len(found) == len(data["findings"]) and list(data["findings"][0]) == FINDING_COLUMNS
    assert report.read_json(spark, str(out)).count() == len(found) and report.read_json(spark, str(tmp_path / "none.json")) is None
    (prompt,) = report.write_prompts(made, str(tmp_path / "p"))
    assert "`app/a.py`" in open(prompt).read() and "TOTAL" in report.terminal(made)
    empty = report.Report("x", "y", datetime(2024, 1, 2), made.findings.limit(0))
    report.write_json(empty, str(out))
    assert json.loads(out.read_text())["findings"] == [] and report.write_prompts(empty, str(tmp_path / "q")) == []


def test_written_reports_come_back(spark, tmp_path):
    files = corpora.files(spark, corpora.JS)
    made = report_of(files, "src", Options(), now=datetime(2024, 1, 2, 3, 4))
    out = tmp_path / "a" / "last.json"
    assert report.cache(made, str(out)) and not report.cache(made, "/proc/none/last.json")
    back = report.read_report(spark, str(out))
    assert (back.scan_id, back.target, back.timestamp, back.files_scanned, back.scanners) == (made.scan_id, "src", made.timestamp, made.files_scanned, made.scanners)
    assert back.seconds == made.seconds > 0 and report.summary(back.findings).first() == report.summary(made.findings).first()
    first, again = (report.write_prompts(r, str(tmp_path / n)) for r, n in ((made, "p"), (back, "q")))
    assert [open(p).read() for p in first] == [open(p).read() for p in again] and report.write_prompts_of(spark, str(out), str(tmp_path / "r"))
    for bad in ("{", '{"findings": [{"id": "x"}]}', '{"findings": [{"id": 5, "severity": "ODD"}]}', ""):
        out.write_text(bad)
        assert report.read_report(spark, str(out)) is None and report.write_prompts_of(spark, str(out), str(tmp_path / "s")) == []
    text = report.terminal(made)
    assert text.index("\na.js") < text.index("\nb.tsx") and "(javascript)" in text and "fix: " in text and "CRITICAL" in text and "█" in text
    assert "No findings." in report.terminal(report.Report("x", "y", datetime(2024, 1, 2), made.findings.limit(0)))


def test_no_engines(spark):
    files = corpora.files(spark, corpora.JS)
    assert scan(files, Options(deps=True)).count() == 0
    assert report_of(files.limit(0), "x").scanners == []


def test_shared_folder_is_needed_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "yarn", "a"

    with pytest.raises(ValueError):
        staging.shared_dir(Cluster)


def test_settings(tmp_path):
    path = str(tmp_path / "c" / "config.toml")
    assert load_config(path) is None
    made = Config("ollama", 'a "b"\\c', None, ScanDefaults(deep=True))
    save_config(made, path)
    assert load_config(path) == made
    for bad in ('provider = "none"\nmodel = "m"', 'provider = "groq"', 'provider = "groq"\nmodel = 1', "[", 'provider = "groq"\nmodel = "m"\n[scan_defaults]\ndeep = 1'):
        (tmp_path / "c" / "config.toml").write_text(bad)
        assert load_config(path) is None, bad


def test_version_order(spark):
    ordered = ["1.0.dev1", "1.0a1", "1.0-alpha.2", "1.0b1", "1.0rc1", "1.0", "v1.0.1", "1.0.1.post1", "1.2", "1.10", "2.0.0+build", "10"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(ordered)], "k int, v string").withColumn("key", dependencies.version_key(F.col("v")))
    assert [r.v for r in rows.orderBy("key").collect()] == ordered
    same = spark.createDataFrame([("1", "v1.0.0")], "a string, b string")
    assert same.select(dependencies.version_key(F.col("a")) == dependencies.version_key(F.col("b"))).first()[0]


def test_what_rules_need():
    rng = random.Random(7)
    for r in SECRETS + JS + AUTH + EXTENDED:
        assert r.needs, r.code
    texts = [x for pair in corpora.SECRET_LINES.values() for x in pair] + [x for c in (corpora.JS, corpora.AUTH, corpora.PYTHON) for t in c.values() for x in t.split("\n")]
    for r in SECRETS + JS + AUTH + EXTENDED:
        for line in texts + ["".join(rng.sample(x.swapcase(), len(x))) for x in texts]:
            if re.search(r.pattern, line):
                assert any(x in (line.lower() if any_case else line) for x, any_case in r.needs), (r.code, line)
    assert Rule("js-extra", "A", "n", "[a-z]+", "HIGH", "", "", 0.5).needs is None


def test_long_prompts_are_packed(spark, tmp_path):
    base = line_rules.js_findings(corpora.files(spark, corpora.JS))
    copies = F.explode(F.sequence(F.lit(1), F.lit(8)))
    many = base.withColumn("k", copies).withColumn("file", F.concat("file", F.lit("."), F.col("k").cast("string"))).drop("k")
    made = report.Report("s", "t", datetime(2024, 1, 2), many)
    paths = report.write_prompts(made, str(tmp_path))
    texts = [open(p).read() for p in paths]
    assert len(paths) > 1 and all(len(t) <= report.CHUNK_CHARS for t in texts)
    assert f"(Part 2 of {len(paths)})" in texts[1] and "Verification Checklist" in texts[-1] and "Verification Checklist" not in texts[0]
    assert list(report.pack(iter([10, 10, 50, 1]), 5, 30)) == [1, 1, 2, 3]


def test_modes(spark):
    assert list(engines(Options(secrets=True, api=True))) == ["secrets"] and list(engines(Options(bypass=True))) == ["auth_bypass"]
    assert "llm_logic" in engines(Options(complete=str)) and "extended" in engines(Options(extended=True))
    register_engine("own", lambda files: line_rules.js_findings(files))
    try:
        assert "own" in engines(Options())
    finally:
        from sievelight.plans import scan as module

        module._extra.clear()


def test_first_of_equal_ids_stays(spark):
    base = line_rules.js_findings(corpora.files(spark, corpora.JS)).limit(1)
    later = base.withColumn("emit_ord", F.col("emit_ord") + 1).withColumn("description", F.lit("later"))
    (kept,) = merge.distinct_first(later.unionByName(base)).collect()
    assert kept.description != "later"


def test_model_review(spark):
    def answer(prompt: str) -> str:
        if "b.tsx" in prompt:
            raise RuntimeError("no answer")
        return '[{"title": "T", "line_start": 2}]'

    found = model_review.parse_responses(model_review.responses(corpora.files(spark, corpora.JS), answer))
    assert {(f.file, f.title, f.line_start) for f in found.collect()} == {("src/a.js", "T", 2)}
    long_ = as_files(spark.createDataFrame([("a.py", "x" * 9000)], "path string, content string"), F.col("path"), "content")
    assert model_review.prompts(long_).first().prompt.endswith("x" + model_review.CUT)


def test_yaml_rules(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("rules:\n  - {id: A, name: n, pattern: 'x', severity: HIGH}\n  - {id: B, name: n, pattern: '(', severity: HIGH}\n")
    assert [r.code for r in load_yaml_rules(str(tmp_path / "r.yaml"))] == ["A"] and load_yaml_rules(str(tmp_path / "none.yaml")) == []


def test_stream_equals_batch(spark, tmp_path):
    files = corpora.files(spark, corpora.JS, corpora.AUTH)
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    scan_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect()}
    assert got == {r.id for r in scan(files).select("id").collect()}
    timed = stream.withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    query = watch_lines(timed, "at").writeStream.format("memory").queryName("watched").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    query.awaitTermination()
    assert spark.table("watched").count() == line_rules.match_rules(line_rules.explode_lines(files), SECRETS, "secrets").count()
