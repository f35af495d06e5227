from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text) or longer rows, with clashing extra columns."""

    def build(rows, extra=True):
        full = [(*r, *("en", "s", len(r[1] or ""))[len(r) - 2 :]) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("score", "id", "key", "_rank", "spans", "h", "th", "block", "epoch", "slot", "kept", "media", "a"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return build
