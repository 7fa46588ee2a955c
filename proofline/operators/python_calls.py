"""Import and call facts from Python source, and the catalogs that turn them into evidence.

The per-file helper only resolves names with the standard ``ast`` module and reports plain facts.
What a fact means is decided in Spark against the catalogs.
"""

from __future__ import annotations

import ast
import json
from collections import ChainMap
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import evidence as E
from proofline.functions import paths
from proofline.functions.lookup import literal_map, lookup

FACT = "path string, kind string, name string, args string, line int, column int, line_end int, column_end int, node string"
FACT_TYPES = {field.split()[0]: pa.int32() if field.endswith(" int") else pa.string() for field in FACT.split(", ")}
#: Facts a task holds before it hands them back.
PART_ROWS = 10_000
ARGUMENTS = "map<string,struct<literal:string,ref:string,attr:string>>"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _parameters(arguments: ast.arguments) -> list[str]:
    listed = [*arguments.posonlyargs, *arguments.args, *arguments.kwonlyargs, arguments.vararg, arguments.kwarg]
    return [a.arg for a in listed if a is not None]


def _local_names(body: list[ast.AST]) -> set[str]:
    """Names a function body binds itself; nested scopes keep theirs."""
    names: set[str] = set()
    waiting = list(body)
    while waiting:
        node = waiting.pop()
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            names.add(node.name)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            whole = isinstance(node, ast.ImportFrom)
            names |= {a.asname or (a.name if whole else a.name.split(".")[0]) for a in node.names}
        elif isinstance(node, ast.Name):
            if not isinstance(node.ctx, ast.Load):
                names.add(node.id)
        elif not isinstance(node, (ast.Lambda, *COMPREHENSIONS)):
            waiting.extend(ast.iter_child_nodes(node))
    return names


def _qualified(node: ast.AST, scope: ChainMap) -> str:
    """Dotted name behind an expression through the imports in scope; empty when unknown or shadowed."""
    tail: list[str] = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    root = scope.get(node.id) if isinstance(node, ast.Name) else None
    return ".".join([root, *reversed(tail)]) if root else ""


def _argument(node: ast.AST, scope: ChainMap) -> dict:
    literal = node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None
    attribute = node.attr if isinstance(node, ast.Attribute) else None
    return {"literal": literal, "ref": _qualified(node, scope) or None, "attr": attribute}


def _visit(node: ast.AST, scope: ChainMap) -> Iterator[tuple]:
    inner, order = scope, list(ast.iter_child_nodes(node))
    match node:
        case ast.Import():
            for a in node.names:
                scope[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                yield "import", a.name, "", node.lineno, 1, node.lineno, 1, "Import"
        case ast.ImportFrom() if node.module is None or node.level:
            scope.update({a.asname or a.name: None for a in node.names})
        case ast.ImportFrom():
            yield "import", node.module, "", node.lineno, 1, node.lineno, 1, "ImportFrom"
            for a in node.names:
                scope[a.asname or a.name] = f"{node.module}.{a.name}"
                yield "import", f"{node.module}.{a.name}", "", node.lineno, 1, node.lineno, 1, "ImportFrom"
        case ast.Name(ctx=ast.Store() | ast.Del()):
            scope[node.id] = None
        case ast.Attribute(ctx=ast.Store() | ast.Del()):
            root = node.value
            while isinstance(root, ast.Attribute):
                root = root.value
            if isinstance(root, ast.Name):
                scope[root.id] = None
        case ast.Assign():
            order = [node.value, *node.targets]
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.Lambda():
            # Decorators and defaults run outside; parameters and local names hide imports inside.
            outside = [*node.args.defaults, *[d for d in node.args.kw_defaults if d is not None]]
            body = [node.body] if isinstance(node, ast.Lambda) else node.body
            if not isinstance(node, ast.Lambda):
                outside = [*node.decorator_list, *outside]
            for value in outside:
                yield from _visit(value, scope)
            hidden = set(_parameters(node.args))
            if not isinstance(node, ast.Lambda):
                scope[node.name] = None
                hidden |= _local_names(body)
            inner, order = scope.new_child(dict.fromkeys(hidden)), body
        case ast.ClassDef():
            scope[node.name] = None
            inner = scope.new_child()
        case ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp():
            inner = scope.new_child()
            order = [part for g in node.generators for part in (g.iter, g.target, *g.ifs)]
            order += [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
        case ast.Call():
            name = _qualified(node.func, scope)
            if name:
                given = {str(i): a for i, a in enumerate(node.args)} | {k.arg: k.value for k in node.keywords if k.arg}
                rendered = json.dumps({k: _argument(v, scope) for k, v in given.items()})
                last = max(n.lineno for n in ast.walk(node) if hasattr(n, "lineno"))
                yield "call", name, rendered, node.lineno, node.col_offset, last, node.end_col_offset, "Call"
    for child in order:
        yield from _visit(child, inner)


def file_facts(source: str | None) -> list[tuple]:
    """Facts of one file; a file that cannot be parsed yields one ``error`` fact and nothing else."""
    try:
        return list(_visit(ast.parse(source or ""), ChainMap()))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return [("error", type(problem).__name__, "", None, None, None, None, "")]


def _facts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of files (path, content) in parts of PART_ROWS. One file's text is taken out of a batch at a time."""
    for batch in batches:
        names, contents = batch.columns
        rows = ((names[i].as_py(), *fact) for i in range(batch.num_rows) for fact in file_facts(contents[i].as_py()))
        while part := list(islice(rows, PART_ROWS)):
            columns = [pa.array(cells, kind) for cells, kind in zip(zip(*part), FACT_TYPES.values())]
            yield pa.RecordBatch.from_arrays(columns, names=list(FACT_TYPES))


def facts(files: DataFrame) -> DataFrame:
    """Import, call and error facts of every Python file in (path, content)."""
    python = files.where(paths.extension("path") == ".py").select("path", "content")
    return python.mapInArrow(_facts_of, FACT)


def classify_facts(rows: DataFrame) -> DataFrame:
    """Imports and calls with algorithm, category, usage and digest; facts of no interest are dropped."""
    name, is_import = F.col("name"), F.col("kind") == "import"
    imported = lookup(dict(C.IMPORT_CATALOG), name)
    calls = rows.where("kind in ('import', 'call')").withColumn("_a", F.from_json("args", ARGUMENTS))
    digests = literal_map(C.DIGEST_NAMES)

    def argument(*keys: str) -> Column:
        return F.coalesce(*[F.try_element_at("_a", F.lit(k)) for k in keys])

    def spelled(value: Column) -> Column:
        return F.replace(F.lower(value), F.lit("-"), F.lit(""))

    hashlib_name = F.when(name.startswith("hashlib."), F.substr(name, F.lit(9)))
    selected = F.coalesce(spelled(argument("0", "name")["literal"]), hashlib_name)
    hash_name = F.when(hashlib_name == "new", selected).otherwise(hashlib_name)
    hazmat_name = F.when(
        name.startswith("cryptography.hazmat.primitives.hashes."), F.lower(F.element_at(F.split(name, r"\."), -1))
    )
    digest = F.try_element_at(digests, F.coalesce(hash_name, hazmat_name))
    is_hmac = name.isin("hmac.new", "hmac.digest")
    chosen = argument("2", "digestmod", "digest")
    hmac_digest = F.coalesce(
        F.try_element_at(digests, spelled(chosen["literal"])),
        F.try_element_at(digests, F.when(chosen["literal"].isNull() & chosen["ref"].startswith("hashlib."), F.substr(chosen["ref"], F.lit(9)))),
    )
    is_aes = (name.endswith(".AES.new") | (name == "AES.new")) & (
        F.coalesce(F.try_element_at("_a", F.lit("1"))["attr"].isin(*C.AES_MODES), F.lit(False))
        | F.coalesce(F.try_element_at("_a", F.lit("mode"))["attr"].isin(*C.AES_MODES), F.lit(False))
    )
    listed = {n: i for i, n in enumerate(("algorithm", "category", "usage_raw"), 1)}
    catalog = {k: lookup({row[0]: row[i] for row in C.CALL_CATALOG}, name) for k, i in listed.items()}
    pbkdf2 = hash_name == "pbkdf2_hmac"
    is_digest = hashlib_name.isNotNull() | hazmat_name.isNotNull()

    def pick(kdf: str, hashed: Column | str, mac: str, aes: str, field: str) -> Column:
        known = {"algorithm": imported, "category": E.category(imported)}.get(field, F.lit(None).cast("string"))
        return (
            F.when(is_import, known).when(pbkdf2, kdf).when(is_digest, hashed).when(is_hmac, mac)
            .when(catalog["algorithm"].isNotNull(), catalog[field]).when(is_aes, aes)
        )

    found = calls.withColumns({
        "algorithm": pick("PBKDF2", digest, "HMAC", "AES", "algorithm"),
        "category": pick("kdf", "hash", "mac", "encryption", "category"),
        "usage_raw": pick("key_derivation", "hashing", "unknown", "encryption", "usage_raw"),
        "digest_algorithm": F.when(is_hmac, hmac_digest),
    })
    return found.where("algorithm is not null").drop("_a")


def evidence(rows: DataFrame) -> DataFrame:
    """Evidence of imports (a declared capability) and of calls (an observed operation), in one pass over the facts."""
    is_import = F.col("kind") == "import"
    kind = F.when(is_import, "declared_capability").otherwise("observed_operation")
    found = classify_facts(rows)
    details = F.map_filter(
        F.create_map(
            F.when(is_import, "import").otherwise("call"), F.col("name"), F.lit("node_type"), F.when(is_import, F.col("node")),
            F.lit("digest_algorithm"), F.col("digest_algorithm"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return found.select(
        F.col("path").alias("location"), "algorithm", "category", F.lit("ast").alias("source"),
        kind.alias("evidence_kind"), "usage_raw",
        F.col("line").alias("line_start"), "line_end", F.col("column").alias("column_start"), "column_end",
        F.lit(None).cast("int").alias("key_size"), F.lit("").alias("library"), F.lit("").alias("protocol"),
        F.when(is_import, C.IMPORT_CONFIDENCE).otherwise(C.CALL_CONFIDENCE).alias("confidence"),
        F.lit("ast-v3").alias("parser_version"), E.confidence_note(F.lit("ast"), kind).alias("confidence_note"), details.alias("details"),
    )


def import_evidence(rows: DataFrame) -> DataFrame:
    return evidence(rows.where("kind = 'import'"))


def call_evidence(rows: DataFrame) -> DataFrame:
    return evidence(rows.where("kind = 'call'"))


def parse_failures(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'error'").select("path", F.lit("parse_error").alias("reason"))
