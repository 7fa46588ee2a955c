from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a small documents table from (doc_id, text[, lang, source]) rows."""

    def build(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), *extra) for r in rows]
        schema = SCHEMA + "".join(f", `{name}` string" for name in extra)
        return spark.createDataFrame(full, schema)

    return build
