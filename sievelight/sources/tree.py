"""Source trees as a table of files: ``spark.read.format("source_tree")``.

Spark's own file sources leave out names that begin with a dot or an
underscore.  This one prunes skipped directories while it walks, tests sizes
before it reads, and deals the files out to partitions of nearly equal bytes.
The root is a local path or the URI of any file system that ``pyarrow.fs``
knows, and must be reachable by every executor.  Folders are listed on the
driver, many at a time; it holds a path and a size of each file and never its
content.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievelight.functions.paths import LANGUAGES, SKIP_DIRS, ignore_regex
from sievelight.model import FILES

IGNORE_FILES = (".gitignore", ".sievelightignore")
# How binary files begin.
MAGIC = (
    b"\x89PNG", b"GIF8", b"\xff\xd8\xff", b"PK\x03\x04", b"\x7fELF", b"MZ", b"\xca\xfe\xba\xbe", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf",
)
#: The last of them as little-endian machines write it.
MORE_MAGIC = (b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe")
SNIFFED, MOST_CONTROL = 512, 0.10
#: Bytes of files that a partition reads, about, what each file counts beside its size, and folders listed at a time.
PARTITION_BYTES, FILE_COST, LISTED = 128 << 20, 4096, 32


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root.rstrip("/") or "/"


def ignore_patterns(root: str) -> list[str]:
    fs, base = file_system(root)
    found = []
    for name in IGNORE_FILES:
        try:
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                found += [line.strip() for line in f.read().decode("utf-8", "ignore").splitlines()]
        except OSError:
            continue
    return [p for p in found if p and not p.startswith("#")]


def is_binary(head: bytes) -> bool:
    """Known beginnings, or more than a tenth of bytes below 8."""
    head = head[:SNIFFED]
    return head.startswith(MAGIC + MORE_MAGIC) or bool(head) and sum(b < 8 for b in head) / len(head) > MOST_CONTROL


def suffix(name: str) -> str:
    return m[1] if (m := re.search(r".(\.[^./]+)$", name)) else ""


def walk(root: str, patterns: list[str], max_kb: int) -> Iterator[tuple[str, int]]:
    """Relative path and size of the files to read; a root that is a file is that file."""
    fs, base = file_system(root)
    top = fs.get_file_info(base)
    if top.type == pafs.FileType.File:
        yield top.base_name, top.size
        return
    ignored = re.compile(regex) if (regex := ignore_regex(patterns)) else None

    def listed(folder: str) -> list[pafs.FileInfo]:
        try:
            return fs.get_file_info(pafs.FileSelector(folder))
        except OSError:
            return []

    folders = [base]
    with ThreadPoolExecutor(LISTED) as pool:
        while folders:
            level, folders = folders, []
            for infos in pool.map(listed, level):
                for info in infos:
                    name = info.base_name
                    if info.type == pafs.FileType.Directory:
                        if name not in SKIP_DIRS and not name.endswith(".egg-info"):
                            folders.append(info.path)
                        continue
                    rel = info.path[len(base.rstrip("/")) + 1 :]
                    hidden = any(p.startswith(".") for p in rel.split("/")) and suffix(name) not in LANGUAGES
                    if info.type != pafs.FileType.File or hidden or (ignored and ignored.search(rel)):
                        continue
                    if info.size <= max_kb * 1024:
                        yield rel, info.size


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.max_kb = int(options.get("max_file_size_kb", 1000))
        self.ignore = str(options.get("respect_ignore", "true")).lower() == "true"
        self.parts = int(options.get("partitions", 0))
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[_Part]:
        patterns = ignore_patterns(self.root) if self.ignore else []
        files = sorted(((s, p) for p, s in walk(self.root, patterns, self.max_kb)), reverse=True)
        total = sum(s + FILE_COST for s, _ in files)
        # a small tree still gets some partitions to work on it at once
        heap = [(0, k) for k in range(self.parts or max(16, -(-total // self.bytes)))]
        dealt: list[list[str]] = [[] for _ in heap]
        for size, path in files:
            held, k = heapq.heappop(heap)
            dealt[k].append(path)
            heapq.heappush(heap, (held + size + FILE_COST, k))
        return [_Part(sorted(p)) for p in dealt if p] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FILES.split(", ")]
        fs, base = file_system(self.root)
        single = fs.get_file_info(base).type == pafs.FileType.File
        for at in range(0, len(partition.paths), 200):
            rows = []
            for rel in partition.paths[at : at + 200]:
                try:
                    with fs.open_input_stream(base if single else f"{base}/{rel}", compression=None) as f:
                        data = f.read()
                except OSError:
                    continue
                if not is_binary(data):
                    name = rel.rsplit("/", 1)[-1]
                    rows.append((rel, name, suffix(name), len(data), data.decode("utf-8", "ignore"), LANGUAGES.get(suffix(name).lower())))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)


class SourceTree(DataSource):
    """Options: ``path`` (load), ``max_file_size_kb``, ``respect_ignore``, ``partition_bytes``, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, **options):
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**options).load(root)
