"""Info texts of tables with many rows, as pandas prints them."""

import io

import pandas as pd
import pytest

from loomtab.operators import stats as D


@pytest.mark.parametrize("rows", [99_999, 100_000, 1_690_785, 1_690_786])
def test_counts_are_never_cut(spark, rows):
    made = D.info_text(spark.range(rows).selectExpr("id", "id * 0.5D AS half")).first()["info"]
    out = io.StringIO()
    pd.DataFrame({"id": range(rows), "half": [0.5] * rows}).info(buf=out, memory_usage=False)
    assert made == out.getvalue().rstrip("\n")
