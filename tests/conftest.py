import os
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from ablatrix.session import session

    options = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = session("tests", **options)
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def oracle():
    """Run SQL over the tables of a folder in DuckDB."""
    import duckdb

    def run(sf_dir, sql):
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        return con.sql(sql).df()

    return run


def comparable(df):
    """Rows as sorted tuples of text, numbers to six decimals."""

    def show(v):
        if pd.isna(v):
            return ""
        if isinstance(v, float):  # also whole numbers, where pandas keeps a column with missing ones as floats
            return "0" if abs(v) < 5e-7 else f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple(show(v) for v in row) for row in df[columns].astype(object).itertuples(index=False, name=None))
