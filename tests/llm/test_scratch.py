import os

import pytest

from tessera.llm.minhash import near_duplicates
from tessera.llm.scratch import materialize, settled, shared_folder

from .helpers import ODD, frame


def tables(spark):
    folder = shared_folder(spark).removeprefix("file://") + "/tessera"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_operators_leave_only_their_result(spark):
    before = tables(spark)
    rows = near_duplicates(frame(spark, ODD))
    assert [x.split("-")[0] for x in tables(spark) - before] == ["near_duplicates"]
    assert rows.count() == len(ODD)


def test_tables_of_inner_operators_and_of_failed_ones_go(spark):
    @settled
    def inner():
        return materialize(spark.range(3), "inner_table")

    @settled
    def outer():
        return inner().selectExpr("id + 1 AS id")

    @settled
    def fails():
        materialize(spark.range(3), "lost")
        raise ValueError

    before = tables(spark)
    assert sorted(r.id for r in outer().collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        fails()
    assert [x.split("-")[0] for x in tables(spark) - before] == ["outer"]


def test_settings_are_as_before(spark):
    keys = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in keys]
    materialize(spark.range(2), "any")
    assert [spark.conf.get(k) for k in keys] == before
