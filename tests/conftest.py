import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.codegen.wholeStage", "false")  # small inputs: compiling costs more than it saves
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in sorted(Path(SMALL).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    """Values as both engines would print them."""
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def same_rows(df, relation) -> None:
    """Asserts that a DataFrame and a DuckDB result hold the same rows, in any order."""
    columns = sorted(df.columns)
    theirs = [d[0] for d in relation.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    other = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert ours == other
