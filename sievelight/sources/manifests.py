"""Dependencies of manifests, each parser a DataFrame expression.

All give ``path, ecosystem, package, version, line_no, ord``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import explode_lines, lines_of

NAME = r"[A-Za-z0-9_\-\.]+"
#: Manifest names and the ecosystem of what they name.
ECOSYSTEMS = {"requirements.txt": "PyPI", "package.json": "npm", "go.mod": "Go", "Pipfile": "PyPI", "pyproject.toml": "PyPI"}


def _deps(rows: DataFrame, ecosystem: str, package: Column, version: Column, ord_: Column | None = None) -> DataFrame:
    order = F.col("line_no").cast("long") if ord_ is None else ord_.cast("long")
    return rows.select("path", F.lit(ecosystem).alias("ecosystem"), package.alias("package"), version.alias("version"), F.col("line_no").cast("int").alias("line_no"), order.alias("ord"))


def _by_pattern(rows: DataFrame, line: str, pattern: str, ecosystem: str, version=lambda v: v) -> DataFrame:
    rows = rows.where(F.col(line).rlike(pattern))
    return _deps(rows, ecosystem, F.regexp_extract(line, pattern, 1), version(F.regexp_extract(line, pattern, 2)))


def _trimmed(files: DataFrame) -> DataFrame:
    return explode_lines(files).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def requirements(files: DataFrame) -> DataFrame:
    """The first specifier of each line; options, comments and extras name nothing."""
    rows = _trimmed(files).where(~F.col("line").rlike(r"^(?:$|#|-r|--)"))
    return _by_pattern(rows, "line", rf"^({NAME})\s*(?:==|>=|<=|~=|!=|>|<)\s*([^\s;#,]+)", "PyPI")


def package_json(files: DataFrame) -> DataFrame:
    """Both sections; a package stands on the first line that quotes its name, else on the first."""
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.select("path", lines_of(F.col("content")).alias("lines"), parsed.alias("m"))
    parts = []
    for k, section in enumerate(("dependencies", "devDependencies")):
        part = rows.select("path", "lines", F.posexplode(F.map_entries(f"m.{section}")).alias("pos", "e"))
        parts.append(part.select("path", "lines", F.col("e.key").alias("package"), F.col("e.value").alias("raw"), (F.col("pos") + k * 1_000_000).alias("ord")))
    rows = reduce(DataFrame.unionAll, parts)
    quoted = F.concat(F.lit('"'), F.col("package"), F.lit('"'))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, quoted)), True)
    rows = rows.withColumn("line_no", F.greatest(at, F.lit(1)))
    return _deps(rows, "npm", F.col("package"), F.trim(F.regexp_replace("raw", r"[\^~>=<]", "")), F.col("ord"))


def go_mod(files: DataFrame) -> DataFrame:
    """Indented lines of a require block."""
    return _by_pattern(explode_lines(files), "line", r"^\s+([A-Za-z0-9_\-\./]+)\s+v([^\s/]+)", "Go")


def _inside(rows: DataFrame, mark: Column) -> DataFrame:
    """Rows whose last mark before or at them is 1; rows that open a section are not inside."""
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mark", mark)
    return rows.withColumn("state", F.last("mark", ignorenulls=True).over(so_far)).where("state = 1 and coalesce(mark, 0) <> 1")


def pipfile(files: DataFrame) -> DataFrame:
    line = F.col("line")
    mark = F.when(line.isin("[packages]", "[dev-packages]"), 1).when(line.startswith("["), 0)
    number = lambda v: F.when(F.regexp_replace(v, r"[^0-9\.]", "") == "", "*").otherwise(F.regexp_replace(v, r"[^0-9\.]", ""))
    return _by_pattern(_inside(_trimmed(files), mark), "line", rf"^({NAME})\s*=\s*[\"']?([^\"']+)[\"']?", "PyPI", number)


def pyproject(files: DataFrame) -> DataFrame:
    line = F.col("line")
    mark = F.when(line == "dependencies = [", 1).when(line.startswith("]"), 0)
    pattern = rf"^['\"]\s*({NAME})\s*(?:[>=<~!]+)\s*([^'\"]+)"
    return _by_pattern(_inside(_trimmed(files), mark), "line", pattern, "PyPI", F.trim)


PARSERS = {"requirements.txt": requirements, "package.json": package_json, "go.mod": go_mod, "Pipfile": pipfile, "pyproject.toml": pyproject}


def dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of every manifest among the files."""
    return reduce(DataFrame.unionByName, [parse(files.where(F.col("name") == name)) for name, parse in PARSERS.items()])
