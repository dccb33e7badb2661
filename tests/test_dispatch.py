"""Analyses side by side: one fails while it runs, one is cancelled, the others go on; the log tells."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from ventara.operators import dispatch as ops




def test_failed_and_cancelled_analyses_stand_alone(spark, tmp_path):
    run = ops.Dispatch(spark, workers=4)
    builds = {
        "good": lambda: spark.range(5),
        "bad while it runs": lambda: spark.range(3).select(F.raise_error(F.lit("broken row")).alias("v")),
        "bad at once": lambda: spark.range(3).select("nothing"),
        "long": lambda: spark.range(400, numPartitions=400).select(F.expr("reflect('java.lang.Thread', 'sleep', cast(300 as bigint))").alias("v")),
        "also good": lambda: spark.range(7),
    }
    timer = threading.Timer(3.0, run.cancel, ("long",))
    timer.start()
    start = time.monotonic()
    found = run.run(builds)
    timer.join()
    assert [o.name for o in found.values()] == list(builds)
    assert {n: o.status for n, o in found.items()} == {"good": "ok", "bad while it runs": "failed", "bad at once": "failed", "long": "cancelled", "also good": "ok"}
    assert time.monotonic() - start < 60
    assert found["good"].rows == 5 and found["also good"].frame.count() == 7 and "broken row" in found["bad while it runs"].error
    ops.log_run(spark, str(tmp_path / "log"), run.run_id, found, {"channel": ["a"]}, {"sales": 1.5})
    other = ops.Dispatch(spark)
    ops.log_run(spark, str(tmp_path / "log"), other.run_id, other.run({"good": lambda: spark.range(2)}))
    log = ops.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 6
    rows = ops.list_runs(log).collect()
    assert [(r.run_id, r.analyses, r.ok, r.failed, r.cancelled, r.rows) for r in rows] == [(other.run_id, 1, 1, 0, 0, 2), (run.run_id, 5, 2, 2, 1, 12)]
    assert rows[1].filters == '{"channel": ["a"]}' and rows[1].summary == '{"sales": 1.5}' and ops.list_runs(log, 1).count() == 1


def test_an_analysis_cancelled_before_it_starts(spark):
    run = ops.Dispatch(spark, workers=1)
    run.cancel("later")
    assert run.run({"first": lambda: spark.range(1), "later": lambda: spark.range(1)})["later"].status == "cancelled"
    assert run.run({}) == {}


def test_all_analyses_of_a_fact(spark, sf_dir):
    from checks.fixtures import fact

    found = ops.run_analyses(fact(spark, sf_dir))
    assert {o.status for o in found.values()} == {"ok"} and len(found) == 10


@pytest.mark.parametrize("key", ["rowVersion", "rowversion"])
def test_both_spellings_of_the_version(spark, tmp_path, key):
    from ventara.sources import erp

    (tmp_path / "p.json").write_text('{"idPersonal":"7","desPersonal":"a","idFuerzaVentas":"3","%s":"v1"}\n\n{"idPersonal":"7","desPersonal":"z"}\n' % key)
    (row,) = erp.erp_staff(erp.read_erp_json(spark, str(tmp_path), erp.text_schema(erp.STAFF_FIELDS))).collect()
    assert (row.row_version, row.sales_force_key, row.seller_name, row.source) == ("v1", "3", "a", "ERP")
