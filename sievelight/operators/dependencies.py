"""Known vulnerabilities of dependencies, from a table of advisories.

An advisory names one version, or (its ``version`` is null) lists versions and
ranges.  A range is a row of events, each the version from which a package is
affected, the one that mends it, or the last one affected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.model import finding
from sievelight.plans.sizing import join_groups
from sievelight.sources.manifests import dependencies

ADVISORY = (
    "ecosystem string, package string, version string, ord int, id string, aliases array<string>, summary string, "
    "severity array<struct<score: string>>, affected array<struct<ranges: array<struct<events: array<"
    "struct<introduced: string, fixed: string, last_affected: string>>>>, versions: array<string>>>"
)
#: Numbers of a release that are compared.
RELEASE_PARTS = 6
# What a version is called before its release, and after it.
PHASES = (("post|rev", 1), ("rc|pre|preview|c", -1), ("beta|b", -2), ("alpha|a", -3), ("dev|snapshot", -4))
#: Versions that name no version.
UNPINNED = ("", "*", "latest")


def cvss(severity: Column) -> Column:
    """The first decimal number of any score, as it stands."""
    numbers = F.transform(severity, lambda s: F.regexp_extract(F.coalesce(s["score"], F.lit("")), r"(\d+\.\d+)", 1))
    return F.get(F.filter(numbers, lambda n: n != ""), 0).cast("double")


def severity_of(score: Column) -> Column:
    return F.when(score.isNull(), "HIGH").when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def fix_version(affected: Column) -> Column:
    """The first fix of each range; the last range's counts."""
    ranges = F.flatten(F.transform(F.coalesce(affected, F.array()), lambda a: F.coalesce(a["ranges"], F.array())))
    fixes = F.transform(ranges, lambda r: F.get(F.filter(F.transform(r["events"], lambda e: e["fixed"]), lambda x: x.isNotNull()), 0))
    return F.coalesce(F.try_element_at(F.filter(fixes, lambda x: x.isNotNull()), F.lit(-1)), F.lit("latest"))


def version_key(version: Column) -> Column:
    """An array that orders versions: the release's numbers, the phase, the phase's own numbers.

    ``v`` in front, build metadata and trailing zeros do not count.  What
    stands behind the release and has no known name comes before it in
    ecosystems that write it with a hyphen, so it counts as an alpha.
    """
    bare = F.regexp_replace(F.lower(F.trim(version)), r"^v|\+.*$", "")
    release = F.regexp_extract(bare, r"^(?:\d+!)?(\d+(?:\.\d+)*)", 1)
    rest = F.substr(bare, F.length(F.regexp_extract(bare, r"^(?:\d+!)?\d+(?:\.\d+)*", 0)) + 1)
    # numbers too long for a long are dates or hashes; their first digits order them well enough
    numbers = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.substring(n, 1, 18).cast("long"))
    padded = F.slice(F.concat(numbers(release), F.array_repeat(F.lit(0).cast("long"), RELEASE_PARTS)), 1, RELEASE_PARTS)
    phase = F.when(F.regexp_replace(rest, r"[.\-_]", "") == "", 0)
    for names, place in PHASES:
        phase = phase.when(rest.rlike(rf"^[.\-_]?(?:{names})(?![a-z])"), place)
    return F.concat(padded, F.array(phase.otherwise(-3).cast("long")), numbers(rest))


def in_ranges(version: Column, affected: Column) -> Column:
    """Whether a version is listed, or lies in one of the ranges."""
    own = version_key(version)
    listed = F.exists(F.coalesce(affected, F.array()), lambda a: F.array_contains(F.coalesce(a["versions"], F.array().cast("array<string>")), version))
    ranges = F.flatten(F.transform(F.coalesce(affected, F.array()), lambda a: F.coalesce(a["ranges"], F.array())))

    def event(e: Column) -> Column:
        # of equal versions the one that opens a range comes last: it opens a new one
        kind = F.when(e["introduced"].isNotNull(), 2).when(e["fixed"].isNotNull(), 1).otherwise(0)
        at = F.coalesce(e["introduced"], e["fixed"], e["last_affected"])
        return F.struct(F.when(at == "0", F.array(F.lit(-1).cast("long"))).otherwise(version_key(at)).alias("key"), kind.alias("kind"))

    def open_(state: Column, e: Column) -> Column:
        after = F.when(e["kind"] == 2, F.lit(True)).otherwise(F.lit(False))
        reached = F.when(e["kind"] == 0, e["key"] < own).otherwise(e["key"] <= own)
        return F.when(reached, after).otherwise(state)

    inside = lambda r: F.aggregate(F.array_sort(F.transform(F.coalesce(r["events"], F.array()), event)), F.lit(False), open_)
    return listed | F.exists(ranges, inside)


def matched(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each dependency with its advisories, in order; unpinned ones have none.

    The advisories are broadcast where they are few.  Beyond that those of
    the most named packages are: one may stand in a third of all manifests.
    """
    deps = deps.where(~F.col("version").isin(*UNPINNED))
    known = advisories.withColumnsRenamed({"ord": "vuln_ord", "version": "vuln_version"})
    out = join_groups(deps, known, ["ecosystem", "package"])
    exact = F.col("vuln_version") == F.col("version")
    out = out.where(F.when(F.col("vuln_version").isNotNull(), exact).otherwise(in_ranges(F.col("version"), F.col("affected"))))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    cves = F.filter(aliases, lambda a: a.startswith("CVE-"))
    own = F.col("id").startswith("CVE-") & ~F.array_contains(cves, F.col("id"))
    out = out.withColumn("cves", F.when(own, F.concat(F.array("id"), cves)).otherwise(cves)).withColumn("aliases", aliases)
    out = out.withColumns({"score": cvss(F.col("severity")), "fix": fix_version(F.col("affected"))})
    names = F.when(F.size("cves") == 0, F.array("id")).otherwise(F.col("cves"))
    return out.withColumn("keys", F.transform(names, lambda n: F.concat(F.col("package"), F.lit("@"), F.col("version"), F.lit("::"), n)))


def first_reports(rows: DataFrame) -> DataFrame:
    """Of the advisories of a manifest those that name nothing which an earlier kept one named.

    The fold is greedy and depends on order, so it runs over each manifest's
    own advisories, a small ordered array.
    """
    fields = ["package", "version", "line_no", "ord", "vuln_ord", "id", "aliases", "summary", "score", "fix", "cves", "keys"]
    ordered = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "vuln_ord", F.struct(*fields).alias("v")))).alias("vs"))
    vs = F.transform("vs", lambda x: x["v"])
    empty = F.struct(F.array().cast("array<string>").alias("seen"), F.slice(vs, 1, 0).alias("kept"))

    def step(acc: Column, v: Column) -> Column:
        new = ~F.arrays_overlap(acc["seen"], v["keys"])
        return F.struct(
            F.when(new, F.array_union(acc["seen"], v["keys"])).otherwise(acc["seen"]).alias("seen"),
            F.when(new, F.concat(acc["kept"], F.array(v))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = ordered.select("path", F.explode(F.aggregate(vs, empty, step, lambda acc: acc["kept"])).alias("v"))
    return kept.select("path", "v.*")


def dependency_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    rows = first_reports(matched(dependencies(files), advisories))
    shown = F.when(F.size("cves") == 0, F.col("id")).otherwise(F.array_join(F.slice("cves", 1, 2), ", "))
    key = F.concat(F.col("package"), F.lit("_"), F.coalesce(F.get("cves", F.lit(0)), F.col("id")))
    ids = F.array_join(F.concat(F.array("id"), F.slice("aliases", 1, 3)), ", ")
    text = F.concat(F.lit("`"), F.col("package"), F.lit("` "), F.col("version"), F.lit(": "), F.coalesce("summary", F.lit("No description available.")), F.lit(" ("), ids, F.lit(")."))
    return rows.select(*finding(
        "dependency", severity_of(F.col("score")), F.lit("CWE-1035"), F.col("path"), F.col("line_no"), key,
        F.concat(F.lit("Vulnerable Dependency — "), F.col("package"), F.lit(" "), F.col("version"), F.lit(" ("), shown, F.lit(")")), text,
        F.concat(F.lit("Upgrade to `"), F.col("fix"), F.lit("` or later.")), F.lit(0.95), F.concat(F.col("package"), F.lit("=="), F.col("version")),
        F.col("ord") * 10_000 + F.col("vuln_ord"),
    ))
