"""The pN_found queries with whole-stage code generation on, as outside the tests, against SQL or a property of the result."""

import __spark_entry__ as entry
import pytest
from beatloom.llm import queries as Q
from conftest import same_rows


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p6_found", "p7_found", "p9_found", "p10_found"])
def test_found(spark, duck, sf_dir, name):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        df = entry.queries()[name](spark, sf_dir)
        if name in Q.ORACLES:
            same_rows(df, duck.execute(Q.ORACLES[name]))
        else:
            rows = [tuple(r) for r in df.collect()]
            assert rows and len(rows) == len(set(rows))
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_the_other_queries_run(spark, sf_dir):
    for name in sorted(Q.QUERIES.keys() - {"p2_found", "p3_found", "p6_found", "p7_found", "p9_found", "p10_found"}):
        assert entry.queries()[name](spark, sf_dir).columns, name
        entry.queries()[name](spark, sf_dir).count()


def test_paragraphs_query(spark, duck, sf_dir):
    same_rows(entry.queries()["p3_paragraphs"](spark, sf_dir), duck.execute(Q.ORACLES["p3_paragraphs"]))
