"""Registered queries against their SQL twins, for those that take little time."""

import numbers
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from gristmill.plans import registry

DATA = Path("/root/testdata/sf0.001")


def plain(frame, columns):
    def value(x):
        if x is None or (not isinstance(x, (str, bool)) and pd.isna(x)):
            return None
        return float(x) if isinstance(x, numbers.Number) and not isinstance(x, bool) else x

    return sorted(repr([value(x) for x in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["clean_text", "token_estimate", "text_quality", "html_to_text", "query_terms", "vector_topk", "guaranteed_seats", "divergence_detect", "checklist_route", "citation_check", "citation_report", "prompt_text", "paragraph_blocks", "used_sources", "seed_selection", "page_report", "source_stats"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.sql(f"create view {f.stem} as select * from '{f}'")
    ours, theirs = registry.queries()[name](spark, str(DATA)).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and plain(ours, columns) == plain(theirs, columns)
