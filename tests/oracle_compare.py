"""Results of a query and of its SQL as sorted rows of text."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def shown(value) -> str:
    if value is None or not isinstance(value, (list, tuple, dict)) and pd.isna(value):
        return "NULL"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) or type(value).__module__ == "numpy" and not isinstance(value, bool) and str(value) not in ("True", "False") else str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(shown(v) for v in row) for row in frame.itertuples(index=False, name=None))
