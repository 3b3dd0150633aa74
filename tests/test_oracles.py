"""Every core query against its SQL counterpart on the smallest data."""

import __spark_entry__ as entry
import pytest
from beatloom.plans import preparation, production, studio
from conftest import same_rows

CORE = {**studio.ORACLES, **production.ORACLES, **preparation.ORACLES}


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_rows(spark, duck, sf_dir, name):
    same_rows(entry.queries()[name](spark, sf_dir), duck.execute(CORE[name]))


def test_every_query_runs(spark, sf_dir):
    """Those without a counterpart; the others run above."""
    for name in sorted({*studio.QUERIES, *production.QUERIES, *preparation.QUERIES} - CORE.keys()):
        assert entry.queries()[name](spark, sf_dir).count() > 0, name


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found"])
def test_with_the_plans_of_production(spark, duck, sf_dir, name):
    """Whole-stage code generation on, as outside the tests."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        same_rows(entry.queries()[name](spark, sf_dir), duck.execute(CORE[name]))
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
