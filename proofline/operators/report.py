"""Reports over scored findings. ``id`` names the column that breaks ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import scoring as S
from proofline.functions.lookup import column
from proofline.operators.ordering import global_rank, page

ASSET_SEARCH = ("algorithm", "category", "location", "library", "protocol", "usage")
REPORT_SEARCH = ("algorithm", "location", "category", "usage")
PROPERTY_SPACE = "inventory"


def resolve_scan(jobs: DataFrame, scan_id: int | None = None) -> DataFrame:
    """The completed job asked for, or the newest completed one. Empty when there is none."""
    completed = jobs.where("status = 'completed'")
    if scan_id is not None:
        return completed.where(F.col("id") == scan_id)
    return completed.orderBy(F.col("id").desc()).limit(1)


def contains_any(text: str | None, columns: Sequence[str], escape: bool = True) -> Column:
    """Case-insensitive contains over columns. Without ``escape``, ``%`` and ``_`` are wildcards."""
    text = (text or "").strip()
    if not text:
        return F.lit(True)
    if escape:
        needle = text.lower()
        tests = [F.contains(F.lower(F.col(c)), F.lit(needle)) for c in columns]
    else:
        tests = [F.col(c).ilike(f"%{text}%") for c in columns]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return F.coalesce(found, F.lit(False))


def filter_assets(found: DataFrame, search: str | None = None, risk: str | None = None, quantum: bool | None = None) -> DataFrame:
    rows = found.where(contains_any(search, ASSET_SEARCH))
    if risk is not None:
        rows = rows.where(F.col("priority_label") == risk)
    if quantum is not None:
        rows = rows.where(F.col("quantum_vulnerable") == F.lit(quantum))
    return rows


def search_report(found: DataFrame, search: str | None = None, risk: str | None = None) -> DataFrame:
    rows = found.where(contains_any(search, REPORT_SEARCH, escape=False))
    return rows if risk is None else rows.where(F.col("priority_label") == risk)


def sort_order(mode: str = "priority", id_column: str = "finding_id") -> list[Column]:
    first = {
        "confidence": F.col("confidence").desc(), "algorithm": F.col("algorithm").asc(),
    }.get(mode, F.col("priority_score").desc())
    return [first, F.col(id_column).desc()]


def bill_order(id_column: str = "finding_id") -> list[Column]:
    return [F.col("algorithm").asc(), F.col("location").asc(), F.col(id_column).asc()]


def rank_order(id_column: str = "finding_id") -> list[Column]:
    return [F.col("priority_score").desc(), *bill_order(id_column)]


def list_assets(found: DataFrame, mode: str = "priority", offset: int = 0, limit: int = 50, by_rank: bool = False) -> DataFrame:
    return page(found, sort_order(mode), offset, limit, by_rank)


def page_totals(found: DataFrame, condition: Column) -> DataFrame:
    """Total and filtered row counts in one pass."""
    return found.agg(F.count(F.lit(1)).alias("total"), F.count_if(condition).alias("filtered"))


def select_assets(found: DataFrame, ids: DataFrame, id_column: str = "finding_id") -> DataFrame:
    """Only the listed ids; other filters do not apply."""
    return found.join(ids.select(id_column).distinct(), id_column, "left_semi")


# --- bill of materials ------------------------------------------------------------------------------


def bill_components(found: DataFrame, space: str = PROPERTY_SPACE, id_column: str = "finding_id") -> DataFrame:
    """One component per finding with its non-empty properties, all values as text."""
    held = {
        "asset:id": "finding_id", "category": "category", "usage": "usage", "evidence-kind": "evidence_kind",
        "parser-version": "parser_version", "evidence-quality": "evidence_quality", "confirmed-use": "confirmed_use",
        "capability-only": "capability_only", "operation-anchor": "operation_anchor",
        "context-conflicts": "context_conflicts", "location": "location", "library": "library", "protocol": "protocol",
        "key-size": "key_size", "evidence:sources": "sources", "confidence": "confidence",
        "quantum-vulnerable": "quantum_vulnerable", "risk-score": "priority_score", "risk-label": "priority_label",
        "migration-recommendation": "pqc_candidate",
    }
    types = dict(found.dtypes)
    cells = []
    for name, source in held.items():
        if source not in types:
            continue
        kind = types[source]
        value = F.col(source)
        if kind.startswith(("array", "map")):
            text = F.when(F.size(value) > 0, F.to_json(value))
        else:
            text = F.nullif(value.cast("string"), F.lit(""))
        cells.append(F.struct(F.lit(f"{space}:{name}").alias("name"), text.alias("value")))
    properties = F.filter(F.array(*cells), lambda p: p["value"].isNotNull())
    return found.select(
        F.lit("library").alias("type"), F.concat(F.lit(f"{space}:asset:"), id_column).alias("bom-ref"),
        F.col("algorithm").alias("name"), properties.alias("properties"),
    )


def attach_context_conflicts(found: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Adds ``context_conflicts`` (field to sorted distinct values) for findings that have any.

    ``conflicts`` holds distinct (finding_id, field, value), so a cell has as many entries as the
    finding has different library names, protocols or key sizes, however much evidence it has.
    """
    fields = conflicts.groupBy("finding_id", "field").agg(F.array_sort(F.collect_list("value")).alias("values"))
    maps = fields.groupBy("finding_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "values")))).alias("context_conflicts")
    )
    return found.join(maps, "finding_id", "left")


def bill_documents(components: DataFrame) -> DataFrame:
    return components.select(F.to_json(F.struct("type", "bom-ref", "name", "properties")).alias("component"))


def bill_header(job: DataFrame, space: str = PROPERTY_SPACE, tool: str = "proofline") -> DataFrame:
    """CycloneDX 1.6 envelope of one scan; the serial number is a name-based (version 5) UUID."""
    url_namespace = "6ba7b8119dad11d180b400c04fd430c8"
    seed = F.concat(F.unhex(F.lit(url_namespace)), F.encode(F.concat(F.lit(f"{space}:scan:"), F.col("id").cast("string")), "utf-8"))
    digest = F.sha1(seed)
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    serial = F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )
    properties = F.array(
        F.struct(F.lit(f"{space}:scan:id").alias("name"), F.col("id").cast("string").alias("value")),
        F.struct(F.lit(f"{space}:repository:path").alias("name"), F.col("repo_path").alias("value")),
        F.struct(F.lit(f"{space}:scan:coverage-percent").alias("name"), F.col("coverage_pct").cast("string").alias("value")),
    )
    tools = F.struct(F.array(F.struct(
        F.lit("application").alias("type"), F.lit(tool).alias("name"), F.lit("1.0.0").alias("version"))).alias("components"))
    return job.select(
        F.lit("https://cyclonedx.org/schema/bom-1.6.schema.json").alias("$schema"),
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"),
        F.concat(F.lit("urn:uuid:"), serial).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(tools.alias("tools"), properties.alias("properties")).alias("metadata"),
    )


PROPERTY = "array<struct<name:string,value:string>>"
DOCUMENT = f"struct<type:string,name:string,properties:{PROPERTY}>"
BILL_TOP = ("bomFormat", "specVersion", "version", "metadata", "components")


def bill_errors(documents: DataFrame, column_name: str = "document") -> DataFrame:
    """Structural errors of bill documents, one row per error.

    A key counts as missing when it is absent; a component's position is its index in the list.
    """
    text = column(column_name)
    parsed = documents.withColumn("_p", F.from_json(text, f"components array<{DOCUMENT}>"))
    keys = F.json_object_keys(text)
    top = parsed.select(
        "doc_id", F.explode(F.array_compact(F.array(*[
            F.when(~F.coalesce(F.array_contains(keys, k), F.lit(False)), F.lit(f"missing top-level key '{k}'")) for k in BILL_TOP
        ]))).alias("error"),
    )
    listed = parsed.select("doc_id", "_p.components")
    not_list = listed.where("components is null").select("doc_id", F.lit("'components' must be a list").alias("error"))
    each = listed.select("doc_id", F.posexplode("components").alias("i", "c"))
    fields = each.select("doc_id", F.explode(F.array_compact(F.array(*[
        F.when(F.col("c")[k].isNull(), F.format_string(f"component[%d] missing '{k}'", F.col("i"))) for k in ("type", "name")
    ]))).alias("error"))
    inner = each.select("doc_id", "i", F.posexplode("c.properties").alias("j", "p")).select(
        "doc_id", F.explode(F.array_compact(F.array(*[
            F.when(F.col("p")[k].isNull(), F.format_string(f"component[%d].property[%d] missing '{k}'", F.col("i"), F.col("j")))
            for k in ("name", "value")
        ]))).alias("error"))
    return top.unionByName(not_list).unionByName(fields).unionByName(inner)


# --- risk report and dashboard ---------------------------------------------------------------------


def risk_summary(found: DataFrame) -> DataFrame:
    """Totals and label distribution in one row and one pass."""
    return found.agg(
        F.count(F.lit(1)).alias("assets"), F.count_if("quantum_vulnerable").alias("quantum_vulnerable"),
        F.count_if("conflict").alias("conflicts"),
        *[F.count_if(F.col("priority_label") == label).alias(label.lower()) for label in C.RISK_LABELS],
    )


def migration_priorities(found: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of the ranked report with its rank; the window sees that page only."""
    rows = page(found, rank_order(), offset, limit)
    nth = F.row_number().over(Window.orderBy(*rank_order()))
    return rows.select(
        (nth + offset).alias("rank"), "finding_id", "algorithm", "usage", "operation_anchor", "location",
        F.col("priority_score").alias("score"), F.col("priority_label").alias("label"), "confidence",
        S.band("confidence").alias("confidence_band"),
        S.band_description(S.band("confidence")).alias("confidence_interpretation"),
        F.col("risk_reasons").alias("reasons"), F.col("pqc_candidate").alias("recommendation"),
        F.col("hybrid_recommended").alias("hybrid"),
    )


def report_lines(found: DataFrame) -> DataFrame:
    """The complete ranked text report, one numbered line per finding."""
    ranked = global_rank(found, rank_order(), "rank")
    return ranked.select("rank", F.concat_ws(
        " | ", F.concat(F.lit("P"), F.col("rank").cast("string")),
        F.concat("priority_label", F.lit(" "), F.col("priority_score").cast("string"), F.lit("/100")),
        F.concat("algorithm", F.lit(" ("), "usage", F.lit(")")), "location", "operation_anchor", "pqc_candidate",
    ).alias("line"))


def dashboard_summary(found: DataFrame) -> DataFrame:
    label = F.coalesce("priority_label", F.lit("LOW"))
    return found.agg(
        F.count(F.lit(1)).alias("total_assets"), F.count_if(label.isin("CRITICAL", "HIGH")).alias("high_risk_count"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
        *[F.count_if(label == name).alias(f"{name.lower()}_count") for name in C.RISK_LABELS],
        F.count_if("quantum_vulnerable").alias("quantum_vulnerable_count"), F.count_if("conflict").alias("conflict_count"),
        F.count_if("confirmed_use").alias("confirmed_use_count"), F.count_if("capability_only").alias("capability_only_count"),
    )


def confidence_histogram(found: DataFrame) -> DataFrame:
    """Five right-closed buckets of the clamped confidence, as columns."""
    value = S.clamp(F.coalesce("confidence", F.lit(0.0)))
    bounds = [(0.2, "c_0_20"), (0.4, "c_21_40"), (0.6, "c_41_60"), (0.8, "c_61_80")]
    cells, low = [], None
    for high, name in bounds:
        inside = value <= high if low is None else (value > low) & (value <= high)
        cells.append(F.count_if(inside).alias(name))
        low = high
    return found.agg(*cells, F.count_if(value > low).alias("c_81_100"))


def attention_list(found: DataFrame, limit: int = C.ATTENTION_LIMIT) -> DataFrame:
    """Top rows of three short lists, each finding once, highest priority first."""
    order = sort_order("priority")
    lists = [
        found.where("priority_label = 'CRITICAL'"), found.where("priority_label = 'HIGH'"), found.where("quantum_vulnerable"),
    ]
    merged = None
    for turn, rows in enumerate(lists):
        top = rows.orderBy(*order).limit(limit).withColumn("_list", F.lit(turn))
        merged = top if merged is None else merged.unionByName(top)
    first = merged.groupBy("finding_id").agg(F.min("_list").alias("_list"))
    distinct = merged.join(first, ["finding_id", "_list"], "left_semi")
    return distinct.orderBy(F.col("priority_score").desc(), "_list", F.col("finding_id").desc()).limit(limit).drop("_list")


# --- evidence graph ----------------------------------------------------------------------------------


def evidence_graph(found: DataFrame, finding: str | None = None, id_column: str = "finding_id",
                   assets: int = C.GRAPH_ASSET_LIMIT, nodes: int = C.GRAPH_NODE_LIMIT,
                   edges: int = C.GRAPH_EDGE_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and truncation of the bounded interactive graph.

    The asset limit is applied first, by a top-k; every later window runs over that many assets. A
    source adds one node and one edge, and is left out once either limit is reached.
    """
    rows = found if finding is None else found.where(F.col(id_column) == finding)
    total = rows.agg(F.count(F.lit(1)).alias("total_assets"))
    nth = F.row_number().over(Window.orderBy(id_column))
    kept = rows.orderBy(id_column).limit(assets).withColumn("_asset", nth)
    upper = F.transform("sources", lambda s: F.upper(s))
    # The first spelling of each upper-case label stands for it.
    labels = F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("sources") - 1, F.lit(0))), lambda i: F.struct(
            i.alias("at"), F.get("sources", i).alias("source"), F.get(upper, i).alias("label"))),
        lambda e: e["label"].isNotNull() & (F.array_position(upper, e["label"]) == e["at"] + 1),
    )
    sized = kept.withColumn("_labels", labels)
    before = Window.orderBy("_asset").rowsBetween(Window.unboundedPreceding, -1)
    # Room left for sources when an asset's turn comes; an asset node is added while any node is free.
    spread = sized.withColumn("_sources_before", F.coalesce(F.sum(F.size("_labels")).over(before), F.lit(0)))
    used = F.least(F.col("_sources_before"), F.lit(edges))
    # Nodes before this asset: earlier assets plus the sources they could place.
    taken = F.least(F.lit(nodes), F.col("_asset") - 1 + used)
    shown = spread.where(taken < nodes)
    asset_nodes = shown.select(
        F.concat(F.lit("asset:"), id_column).alias("id"), F.lit("asset").alias("type"),
        F.concat("algorithm", F.lit(" ("), "usage", F.lit(")")).alias("label"), F.col(id_column).alias("asset_id"),
        "operation_anchor", "confidence", "priority_score", "priority_label", "quantum_vulnerable",
    )
    expanded = shown.select(id_column, "_asset", "_sources_before", F.posexplode("_labels").alias("_i", "_e")).withColumn(
        "_nth", F.col("_sources_before") + F.col("_i") + 1
    )
    fits = expanded.where((F.col("_nth") <= edges) & (F.col("_asset") + F.col("_nth") <= nodes))
    node_id = F.concat(F.lit("source:"), id_column, F.lit(":"), F.col("_e.source"))
    source_nodes = fits.select(
        node_id.alias("id"), F.lit("evidence").alias("type"), F.col("_e.label").alias("label"), F.col(id_column).alias("asset_id")
    )
    edge_rows = fits.select(
        node_id.alias("source"), F.concat(F.lit("asset:"), id_column).alias("target"), F.lit("supports").alias("relation")
    )
    node_rows = asset_nodes.unionByName(source_nodes, allowMissingColumns=True)
    counted = (
        total.unionByName(asset_nodes.agg(F.count(F.lit(1)).alias("returned_assets")), allowMissingColumns=True)
        .unionByName(fits.agg(F.count(F.lit(1)).alias("returned_edges")), allowMissingColumns=True)
        .unionByName(expanded.agg(
            F.max("_nth").alias("last_source"),
            F.max(F.col("_asset") + F.least(F.col("_nth") - 1, F.lit(edges)) >= nodes).alias("node_full"),
        ), allowMissingColumns=True)
        .unionByName(spread.agg(F.count(F.lit(1)).alias("eligible")), allowMissingColumns=True)
    )
    flat = counted.agg(*[F.max(c).alias(c) for c in counted.columns])
    node_full = F.coalesce(F.col("node_full"), F.lit(False)) | (F.col("eligible") > F.col("returned_assets"))
    reasons = F.array_compact(F.array(
        F.when(F.col("total_assets") > assets, F.lit("asset_limit")), F.when(node_full, F.lit("node_limit")),
        F.when((F.col("returned_edges") >= edges) & (F.col("last_source") > edges), F.lit("edge_limit")),
    ))
    truncation = flat.select(
        "total_assets", "returned_assets", (F.col("returned_assets") + F.col("returned_edges")).alias("returned_nodes"),
        "returned_edges", reasons.alias("reasons"), (F.size(reasons) > 0).alias("truncated"),
    )
    return node_rows, edge_rows, truncation


# --- table checks -------------------------------------------------------------------------------------

ASSET_TYPES = {
    "algorithm": "string", "category": "string", "location": "string", "confidence": "double", "conflict": "boolean",
    "quantum_vulnerable": "boolean", "priority_score": "int", "priority_label": "string", "pqc_candidate": "string",
    "business_criticality": "string", "usage": "string", "library": "string", "protocol": "string", "key_size": "int",
    "data_sensitivity": "string", "data_lifetime_years": "int", "migration_time_years": "int",
    "threat_horizon_years": "int", "exposure": "string", "migration_effort": "string", "hybrid_recommended": "boolean",
    "finding_id": "string", "evidence_kind": "string", "evidence_quality": "string", "confirmed_use": "boolean",
    "capability_only": "boolean",
}


def schema_errors(found: DataFrame, expected: dict[str, str] | None = None) -> list[str]:
    """Columns that are missing or have another type; reads no data."""
    expected = ASSET_TYPES if expected is None else expected
    actual = dict(found.dtypes)
    return [
        f"{name}: expected {kind}, got {actual.get(name, 'missing')}" for name, kind in expected.items() if actual.get(name) != kind
    ]


def row_errors(found: DataFrame) -> DataFrame:
    """Adds ``errors``: required values, enumerations and ranges that do not hold."""
    names = [n for n in ASSET_TYPES if n != "key_size" and n in found.columns]
    required = [F.when(F.col(n).isNull(), F.lit(f"missing:{n}")) for n in names]

    def outside(name: str, allowed: Sequence[str]) -> Column:
        return F.when(~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), F.lit(f"value:{name}"))

    ranges = [
        F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), F.lit("range:confidence")),
        F.when(~F.coalesce(F.col("priority_score").between(0, 100), F.lit(False)), F.lit("range:priority_score")),
    ]
    return found.withColumn("errors", F.array_compact(F.array(
        *required, outside("priority_label", C.RISK_LABELS), outside("exposure", C.EXPOSURES),
        outside("migration_effort", C.LEVELS), outside("business_criticality", C.LEVELS), *ranges,
    )))
