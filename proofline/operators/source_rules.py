"""Rule scan of source text: mask, split into statements, match folded rules.

The per-file helper only masks comments and strings, splits statements and follows dynamic regions:
work that depends on everything before it in the file. Matching and every guard run in Spark over the
exploded statements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline import catalogs as C
from proofline.functions import evidence as E
from proofline.functions import paths
from proofline.functions.lookup import literal_map, text_array

QUOTED = r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\])*'"
TOKENS = r'"""[\s\S]*?"""|`(?:\\.|[^`\\])*`|' + QUOTED + r"|//[^\n]*|/\*[\s\S]*?\*/"
SELECTOR = re.compile(C.SELECTOR_CALLS)
#: More characters than any call of SELECTOR_CALLS can have before its literal, blanks not counted: the longest has 29.
SELECTOR_REACH = 160
STATEMENT = "path string, extension string, line int, column int, text string, dynamic boolean"
STATEMENT_TYPES = {"line": pa.int32(), "column": pa.int32(), "text": pa.string(), "dynamic": pa.bool_()}
#: Bytes of statements a task holds before it hands them back, and what one statement weighs beside its text.
PART_BYTES, ROW_BYTES = 4 << 20, 256


def _before(characters: list[str], at: int) -> str:
    """The last SELECTOR_REACH characters before a place, with each run of blanks (also of blanked comments) as one."""
    found: list[str] = []
    solid = 0
    while at and solid < SELECTOR_REACH:
        at -= 1
        if not characters[at].isspace():
            found.append(characters[at])
            solid += 1
        elif not found or found[-1] != " ":
            found.append(" ")
    return "".join(reversed(found))


def mask(text: str, extension: str) -> str:
    """Blank out comments and literals, keeping line breaks and literals that select an algorithm."""
    tokens = TOKENS + r"|#[^\n]*" if extension == ".py" else TOKENS
    characters = list(text)
    for token in re.finditer(tokens, text):
        start, end = token.span()
        selects = text[start] in "\"'" and not text.startswith('"""', start) and SELECTOR.search(_before(characters, start))
        if not selects:
            characters[start:end] = [c if c in "\n\r" else " " for c in characters[start:end]]
    return "".join(characters)


def split_statements(text: str) -> Iterator[tuple[int, int, str]]:
    """(line, column, statement): lines, cut at semicolons outside quotes."""
    for number, line in enumerate(text.splitlines(), 1):
        stops = [m.start() for m in re.finditer(QUOTED + "|;", line) if m[0] == ";"]
        starts = [0] + [s + 1 for s in stops]
        for start, stop in zip(starts, [*stops, len(line)]):
            yield number, start, line[start:stop]


def marked_statements(content: str | None, extension: str) -> Iterator[dict]:
    """Statements with a flag for those inside a dynamic region, where calls are resolved at run time."""
    depth = 0
    for line, column, text in split_statements(mask(content or "", extension)):
        dynamic = depth > 0 or any(marker in text for marker in C.DYNAMIC_MARKERS)
        if dynamic:
            depth = max(0, depth + text.count("(") - text.count(")"))
        yield {"line": line, "column": column, "text": text, "dynamic": dynamic}


def _split_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statements of files (path, extension, content), handed back in parts of bounded size, within a file too."""
    for batch in batches:
        files, rows, size = [], [], 0

        def part() -> pa.RecordBatch:
            place = pa.array(files, pa.int32())
            columns = [pa.array([row[name] for row in rows], kind) for name, kind in STATEMENT_TYPES.items()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(place), batch.column(1).take(place), *columns], names=["path", "extension", *STATEMENT_TYPES])

        for place in range(batch.num_rows):
            for row in marked_statements(batch.column(2)[place].as_py(), batch.column(1)[place].as_py()):
                files.append(place)
                rows.append(row)
                size += len(row["text"]) + ROW_BYTES
                if size >= PART_BYTES:
                    yield part()
                    files, rows, size = [], [], 0
        if rows:
            yield part()


@F.pandas_udf(T.StringType())
def masked_text(content: pd.Series, extension: pd.Series) -> pd.Series:
    """Masked file text, for inspection."""
    return pd.Series([mask(c or "", e) for c, e in zip(content, extension)], dtype=object)


def statements(files: DataFrame) -> DataFrame:
    """One row per statement of every routed source file: path, extension, line, column, text, dynamic."""
    extensions = sorted({ext for ext, _, parser in C.EXTENSION_ROUTES if parser == "source_rules"})
    sources = files.select("path", "content", paths.extension("path").alias("extension")).where(
        F.col("extension").isin(*extensions)
    )
    return sources.select("path", "extension", "content").mapInArrow(_split_files, STATEMENT)


def folded(patterns: Sequence[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def marked(lowered: Column, marks: Sequence[str]) -> Column:
    """Whether lower-case text holds one of the marks: plain substring tests, far cheaper than patterns."""
    found = lowered.contains(marks[0])
    for mark in marks[1:]:
        found = found | lowered.contains(mark)
    return found


def may_match(lowered: Column, pack: Sequence[tuple] = C.RULE_PACK, marks: dict = C.RULE_MARKS) -> Column:
    """False only where no rule can match; most lines end here. Rules without marks are always tried."""
    names = [name for name, _, _ in pack]
    if any(name not in marks for name in names):
        return F.lit(True)
    every = sorted({m for n in names for m in marks[n]}, key=lambda m: (len(m), m))
    needed = [m for i, m in enumerate(every) if not any(shorter in m for shorter in every[:i])]
    # Masked comments leave lines of blanks, most lines of many files: one test in place of one per mark.
    return lowered.rlike(r"\S") & marked(lowered, needed)


def matched_algorithms(text: Column, lowered: Column, is_java: Column, pack: Sequence[tuple] = C.RULE_PACK,
                       java: dict = C.JAVA_HASH_RULES, marks: dict = C.RULE_MARKS) -> Column:
    """Algorithms whose folded rule matches, in pack order. The patterns are literals, so no join is needed."""
    cells = []
    for name, group, patterns in pack:
        test = text.rlike(folded(patterns))
        if group == "hash":
            own = text.rlike(folded(java[name])) if name in java else F.lit(False)
            test = F.when(is_java, own).otherwise(test)
        if name in marks:
            test = marked(lowered, marks[name]) & test
        cells.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*cells))


def candidates(rows: DataFrame, text: str) -> DataFrame:
    """Rows that some rule may match, with their lower-case text in ``_lower``."""
    return rows.withColumn("_lower", F.lower(text)).where(may_match(F.col("_lower")))


def first_pattern(text: Column, algorithm: Column, is_java: Column, pack: Sequence[tuple] = C.RULE_PACK,
                  java: dict = C.JAVA_HASH_RULES) -> Column:
    """The first pattern of the algorithm that matches; evaluated on hits only."""
    def table(rules: dict) -> Column:
        cells: list[Column] = []
        for name, patterns in rules.items():
            cells += [F.lit(name), text_array(patterns)]
        return F.create_map(*cells)

    general = F.try_element_at(table({n: p for n, _, p in pack}), algorithm)
    patterns = F.when(is_java, F.coalesce(F.try_element_at(table(java), algorithm), general)).otherwise(general)
    return F.try_element_at(F.filter(patterns, lambda p: F.rlike(text, F.concat(F.lit("(?i)"), p))), F.lit(1))


def is_named_constant(text: Column, algorithm: Column, names: Sequence[str]) -> Column:
    """Assignment to a constant named after the algorithm whose value does not name it."""
    spelled = {n: C.NAMED_CONSTANT % {"name": re.escape(n).replace(r"\-", "[_-]?")} for n in names}
    return F.rlike(text, F.try_element_at(literal_map(spelled), algorithm))


def is_java_declaration(text: Column) -> Column:
    value = F.trim(text)
    return (
        value.rlike(C.JAVA_DECLARATION) | value.rlike(C.JAVA_DIGEST_CONSTRUCTOR)
        | value.rlike(C.JAVA_INTERFACE_METHOD) | value.rlike(C.JAVA_NESTED_MAC)
    )


def scan_statements(rows: DataFrame, pack: Sequence[tuple] = C.RULE_PACK) -> DataFrame:
    """Hits per (path, line, column, algorithm) with the first matching pattern, after every guard."""
    text, algorithm = F.col("text"), F.col("algorithm")
    is_java, is_python = F.col("extension") == ".java", F.col("extension") == ".py"
    live = rows.where(~F.col("dynamic")).withColumn("_lower", F.lower(text)).where(may_match(F.col("_lower"), pack))
    live = live.where(~(is_java & text.rlike(C.JAVA_FIELD)))
    named = live.withColumn("algorithm", F.explode(matched_algorithms(text, F.col("_lower"), is_java, pack))).drop("_lower")
    named = named.withColumn("category", E.category(algorithm))
    is_hash = F.col("category") == "hash"
    kept = named.where(
        ~is_named_constant(text, algorithm, [n for n, _, _ in pack])
        & ~(is_python & (is_hash | (algorithm == "HMAC")))
        & ~(is_java & is_hash & (~text.contains("(") | is_java_declaration(text)))
    )
    return kept.withColumn("pattern", first_pattern(text, algorithm, is_java, pack))


def evidence(files: DataFrame) -> DataFrame:
    """Rule evidence of a files table (path, content)."""
    hits = scan_statements(statements(files))
    usage = E.usage_from_line("text", "algorithm")
    rule_id = F.concat(F.lit("crypto."), F.replace(F.lower("algorithm"), F.lit("-"), F.lit("_")))
    matched = F.regexp_substr("text", F.concat(F.lit("(?i)"), F.col("pattern")))
    return hits.select(
        F.col("path").alias("location"), "algorithm", "category", F.lit("rule").alias("source"),
        F.lit("observed_operation").alias("evidence_kind"), usage.alias("usage_raw"),
        F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.col("column").alias("column_start"),
        (F.col("column") + F.length(matched)).alias("column_end"),
        E.key_size_from_line("text", "algorithm").alias("key_size"), E.library_from_line("text").alias("library"),
        E.protocol_from_usage(usage).alias("protocol"), F.lit(C.RULE_CONFIDENCE).alias("confidence"),
        F.lit("rule-v1").alias("parser_version"), E.confidence_note(F.lit("rule"), F.lit("observed_operation")).alias("confidence_note"),
        F.create_map(F.lit("rule_id"), rule_id, F.lit("pattern"), F.col("pattern")).alias("details"),
    )
