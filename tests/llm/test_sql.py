"""Corpus queries against their SQL, on small tables."""

import numpy as np
import pandas as pd
import pytest

from tracelens.llm.queries import ORACLE_SQL, QUERIES


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, data, name):
    got, want = tidy(QUERIES[name](spark, data).toPandas()), tidy(duck.sql(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        if pd.api.types.is_float_dtype(want[c]):
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=2e-3), c
        else:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
