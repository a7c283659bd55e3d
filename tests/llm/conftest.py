from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from awkward import ROWS  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents of every awkward kind, with columns named like the operators' own."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in ROWS]
    return spark.createDataFrame(
        rows,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        "position int, component_id string, text_hash int",
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
