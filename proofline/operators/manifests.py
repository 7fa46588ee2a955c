"""Declared packages in dependency manifests.

Every parser turns one file's text into an array of packages inside its row, keeps the packages the
catalog knows and drops repeats there, so no format needs a shuffle. Files are expected to have
passed the size limit of the inventory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import evidence as E
from proofline.functions import paths
from proofline.functions.lookup import column, lookup, text_array
from proofline.functions.text import package_name, valid_json

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
PACKAGE = "array<struct<key:string,package:string,version:string,detail:string>>"


def _package(key: Column, package: Column, version: Column | None = None, detail: Column | None = None) -> Column:
    def text(value: Column | None) -> Column:
        return (F.lit(None) if value is None else value).cast("string")

    return F.struct(key.alias("key"), package.alias("package"), text(version).alias("version"), text(detail).alias("detail"))


def _known(packages: Column, ecosystem: str, catalog: Sequence[tuple], match: Callable[[Column], Column] | None = None) -> Column:
    """Catalog packages only, the first entry of each key."""
    names = text_array([p for e, p, _ in catalog if e == ecosystem])
    looked_up = match or (lambda p: p["key"])
    kept = F.filter(packages, lambda p: F.array_contains(names, looked_up(p)))
    keys = F.transform(kept, lambda p: p["key"])
    return F.filter(kept, lambda p, i: F.array_position(keys, p["key"]) == i + 1)


def _lines(content: Column) -> Column:
    return F.split(content, LINE_BREAK)


def requirements(content: Column | str, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> Column:
    lines = F.filter(
        F.transform(_lines(column(content)), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("-")
    )
    return _known(F.transform(lines, lambda s: _package(package_name(s), package_name(s))), "pypi", catalog)


def pom(content: Column | str, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> Column:
    """Direct dependencies by group; the key is ``group:artifact``. Unsafe declarations yield null."""
    content = column(content)
    schema = "dependencies struct<dependency:array<struct<groupId:string,artifactId:string>>>"
    parsed = F.from_xml(F.when(~unsafe_xml(content), content), schema, {"rowTag": "project", "mode": "PERMISSIVE"})
    declared = F.coalesce(parsed["dependencies"]["dependency"], F.array().cast("array<struct<groupId:string,artifactId:string>>"))
    named = F.filter(declared, lambda d: (F.coalesce(F.trim(d["groupId"]), F.lit("")) != "") & (F.coalesce(F.trim(d["artifactId"]), F.lit("")) != ""))
    packages = F.transform(named, lambda d: _package(
        F.concat(F.lower(F.trim(d["groupId"])), F.lit(":"), F.trim(d["artifactId"])), F.lower(F.trim(d["groupId"])),
        None, F.trim(d["artifactId"]),
    ))
    return _known(packages, "maven", catalog, lambda p: p["package"])


def unsafe_xml(content: Column) -> Column:
    return F.coalesce(content.rlike("(?i)<!DOCTYPE|<!ENTITY"), F.lit(False))


def package_lock(content: Column | str, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> Column:
    """Entries of ``packages``, then those of ``dependencies`` that are not in it."""
    content = column(content)
    parsed = F.from_json(content, "lockfileVersion string, packages map<string,string>, dependencies map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    first = F.coalesce(parsed["packages"], empty)
    second = F.map_filter(F.coalesce(parsed["dependencies"], empty), lambda k, v: ~F.map_contains_key(first, k))
    entries = F.filter(F.concat(F.map_entries(first), F.map_entries(second)), lambda e: e["key"] != "")
    packages = F.transform(entries, lambda e: _package(
        package_name(e["key"]), package_name(e["key"]), F.coalesce(F.get_json_object(e["value"], "$.version"), F.lit("")),
        parsed["lockfileVersion"],
    ))
    return _known(packages, "npm", catalog)


def gemfile_lock(content: Column | str, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> Column:
    names = F.filter(
        F.transform(_lines(column(content)), lambda s: F.regexp_extract(s, r"^\s+([A-Za-z0-9_.-]+)\s*\(", 1)), lambda n: n != ""
    )
    return _known(F.transform(names, lambda n: _package(
        F.regexp_replace(F.lower(n), r"[-_.]+", "-"), F.regexp_replace(F.lower(n), r"[-_.]+", "-"))), "gem", catalog)


def go_sum(content: Column | str, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> Column:
    """Modules by exact name, else by the normalised last segment of the name."""
    fields = F.filter(F.transform(_lines(column(content)), lambda s: F.split(F.trim(s), r"\s+")), lambda f: F.size(f) >= 2)
    names = text_array([p for e, p, _ in catalog if e == "go"])
    modules = F.transform(fields, lambda f: F.element_at(f, 1))
    return _known(F.transform(modules, lambda m: _package(
        F.when(F.array_contains(names, F.lower(m)), F.lower(m)).otherwise(package_name(m)), m)), "go", catalog)


def cargo_lock(content: Column | str, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> Column:
    blocks = F.slice(F.split(column(content), r"(?m)^\s*\[\[package\]\]\s*$"), 2, 2_000_000_000)
    packages = F.transform(blocks, lambda b: _package(
        package_name(F.regexp_extract(b, r'(?m)^\s*name\s*=\s*"([^"]*)"', 1)),
        F.regexp_extract(b, r'(?m)^\s*name\s*=\s*"([^"]*)"', 1), F.regexp_extract(b, r'(?m)^\s*version\s*=\s*"([^"]*)"', 1),
    ))
    return _known(packages, "cargo", catalog)


PARSERS: dict[str, tuple[str, Callable[..., Column]]] = {
    "requirements.txt": ("pypi", requirements), "pom.xml": ("maven", pom), "package-lock.json": ("npm", package_lock),
    "Gemfile.lock": ("gem", gemfile_lock), "go.sum": ("go", go_sum), "Cargo.lock": ("cargo", cargo_lock),
}


def declared_packages(files: DataFrame, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> DataFrame:
    """Catalog packages of every manifest in (path, content), each once per file."""
    name = paths.file_name("path")
    ecosystem, packages = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast(PACKAGE))
    for file, (group, parse) in PARSERS.items():
        ecosystem, packages = ecosystem.when(name == file, group), packages.when(name == file, parse("content", catalog))
    rows = files.where(name.isin(*PARSERS)).select("path", ecosystem.alias("ecosystem"), F.explode(packages).alias("p"))
    return rows.select(
        "path", "ecosystem", F.when(F.col("ecosystem") == "maven", F.col("p.package")).otherwise(F.col("p.key")).alias("package"),
        F.col("p.package").alias("declared"), "p.version", "p.detail",
    )


#: A line of a Cargo.lock that gives a key a value, and one whose value is well formed (arrays may go on below).
CARGO_KEY = r"""^\s*("[^"]*"|[\w-]+)\s*="""
CARGO_LINE = r"""^\s*("[^"]*"|[\w-]+)\s*=\s*("([^"\\]|\\.)*"|'[^']*'|\"{3}.*|'{3}.*|\[.*|\{.*|[+-]?\d[\w.:+-]*|true|false)\s*(#.*)?$"""


def broken_cargo(content: Column) -> Column:
    """Whether some line that sets a key has no well-formed value."""
    return F.exists(F.split(content, r"\r?\n"), lambda line: line.rlike(CARGO_KEY) & ~line.rlike(CARGO_LINE))


def manifest_failures(files: DataFrame) -> DataFrame:
    """Manifests that cannot be read as their format."""
    name = paths.file_name("path")
    bad_json = (name == "package-lock.json") & ~valid_json("content")
    # A well-formed document repeats its root's closing tag at the end.
    root = F.regexp_extract("content", r"^\s*(?:<\?[^>]*\?>\s*|<!--[\s\S]*?-->\s*)*<([A-Za-z_][\w.:-]*)", 1)
    closed = F.when(root != "", F.rtrim(F.regexp_replace("content", r"\s+$", "")).endswith(F.concat(F.lit("</"), root, F.lit(">"))))
    parsed = F.from_xml("content", "modelVersion string, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    is_pom = name == "pom.xml"
    crossed = F.when(is_pom, parsed)["_bad"].isNotNull()
    bad_xml = is_pom & (unsafe_xml(F.col("content")) | ~F.coalesce(closed, F.lit(False)) | crossed)
    bad_cargo = (name == "Cargo.lock") & F.coalesce(broken_cargo(F.col("content")), F.lit(False))
    bad = F.col("content").isNull() | bad_json | bad_xml | bad_cargo
    return files.where(name.isin(*PARSERS) & bad).select("path", F.lit("parse_error").alias("reason"))


def expand_packages(packages: DataFrame, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> DataFrame:
    """Algorithms each (ecosystem, package) provides, through a literal catalog rather than a join."""
    cells: list[Column] = []
    for ecosystem, package, provided in catalog:
        cells += [F.lit(f"{ecosystem}:{package}"), F.array(*[
            F.struct(F.lit(a).alias("algorithm"), F.lit(c).alias("category")) for a, c in provided])]
    provided = F.try_element_at(F.create_map(*cells), F.concat_ws(":", "ecosystem", "package"))
    return packages.withColumn("_p", F.explode(provided)).select(*packages.columns, "_p.algorithm", "_p.category")


def evidence(files: DataFrame, catalog: Sequence[tuple] = C.PACKAGE_CATALOG) -> DataFrame:
    rows = expand_packages(declared_packages(files, catalog), catalog)
    details = F.map_filter(F.create_map(
        F.lit("manifest"), F.col("path"), F.lit("package"), F.col("declared"), F.lit("version"), F.col("version"),
        F.lit("artifactId"), F.when(F.col("ecosystem") == "maven", F.col("detail"))), lambda k, v: v.isNotNull())
    return rows.select(
        F.col("path").alias("location"), "algorithm", "category", F.lit("dep").alias("source"),
        F.lit("declared_capability").alias("evidence_kind"),
        lookup(C.USAGE_BY_CATEGORY, "category", F.col("category")).alias("usage_raw"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(None).cast("int").alias("column_start"),
        F.lit(None).cast("int").alias("column_end"), F.lit(None).cast("int").alias("key_size"),
        F.col("declared").alias("library"), F.lit("").alias("protocol"), F.lit(C.PACKAGE_CONFIDENCE).alias("confidence"),
        F.lit("dep-v1").alias("parser_version"), E.confidence_note(F.lit("dep"), F.lit("declared_capability")).alias("confidence_note"),
        details.alias("details"),
    )
