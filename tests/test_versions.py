"""Versioned tables: what a writer that stops at any step leaves, merged reads, counts, and periods from the manifest."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ventara.sources import store
from ventara.sources.versions import ConcurrentWrite, Versioned

LINES = "date date, client_key string, invoice string, line_key string, product_key string, seller_key string, channel string, amount decimal(18,4), quantity decimal(18,4)"


def lines(spark, *rows):
    return spark.createDataFrame([(d, c, "i", k, "p", "s", "ch", Decimal(str(a)), Decimal(1)) for d, c, k, a in rows], LINES)


def day(m, d):
    return date(2024, m, d)


def stored(spark, path):
    return sorted((r.date, r.client_key, r.line_key, float(r.amount)) for r in store.read_sales(spark, path).collect())


class Stop(Exception):
    pass


def _stopping(monkeypatch, step, after):
    """The step raises, before or after it has done its work."""
    if step == "_files.create":  # a draft that is left unfinished
        plain = Versioned.commit

        def commit(self, *args):
            made = self._files.create(self._at(f"{self.path}/_manifest/.draft-x"), False)
            made.close()
            raise Stop

        monkeypatch.setattr(Versioned, "commit", commit)
        return
    plain = getattr(Versioned, step)

    def stop(self, *args, **kw):
        if after:
            plain(self, *args, **kw)
        raise Stop

    monkeypatch.setattr(Versioned, step, stop)


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step", ["_files.create", "_publish", "commit", "sweep", "log", "write"])
def test_readers_see_all_of_a_sync_or_nothing(spark, tmp_path, monkeypatch, step, after):
    path, log = str(tmp_path / "sales"), str(tmp_path / "log")
    store.sync_range(spark, path, lines(spark, (day(1, 10), "a", "1", 5), (day(2, 3), "b", "2", 6), (day(3, 1), "c", "3", 7)), day(1, 1), day(3, 31), full_detail=True)
    old = stored(spark, path)
    fresh = lines(spark, (day(1, 20), "d", "4", 1), (day(2, 20), "e", "5", 2))
    new = [(day(1, 10), "a", "1", 5.0), (day(1, 20), "d", "4", 1.0), (day(2, 20), "e", "5", 2.0), (day(3, 1), "c", "3", 7.0)]
    with monkeypatch.context() as patch:
        if step in ("log", "write"):
            name = {"log": "append_run", "write": "_write_months"}[step]
            plain = getattr(store, name)

            def stop(*args, **kw):
                if after:
                    plain(*args, **kw)
                raise Stop

            patch.setattr(store, name, stop)
        else:
            _stopping(patch, step, after)
        with pytest.raises(Stop):
            store.sync_range(spark, path, fresh, day(1, 15), day(2, 29), log, full_detail=True)
    assert stored(spark, path) in (old, new)
    assert (stored(spark, path) == new) == (step in ("sweep", "log") or step in ("_publish", "commit") and after)
    store.sync_range(spark, path, fresh, day(1, 15), day(2, 29), log, full_detail=True)
    assert stored(spark, path) == new
    table = Versioned(spark, path)
    table.sweep(keep=1, age=-10.0)
    assert stored(spark, path) == new
    assert {n for n in table._names(path) if n.startswith("run=")} == {f.split("/")[0] for f in table.current().folders()} and len(table._names(path + "/_manifest")) == 1


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step", ["_files.create", "_publish", "commit", "sweep"])
def test_readers_see_all_of_a_master_or_nothing(spark, tmp_path, monkeypatch, step, after):
    path = str(tmp_path / "articles")
    frame = lambda *rows: spark.createDataFrame(list(rows), "product_key string, brand string")
    read = lambda: sorted(tuple(r) for r in store.read_master(spark, path).collect())
    store.write_master(frame(("1", "a"), ("2", "b")), path, "product_key")
    with monkeypatch.context() as patch:
        _stopping(patch, step, after)
        with pytest.raises(Stop):
            store.write_master(frame(("2", "B")), path, "product_key")
    assert read() in ([("1", "a"), ("2", "b")], [("1", "a"), ("2", "B")])
    store.write_master(frame(("2", "B")), path, "product_key")
    assert read() == [("1", "a"), ("2", "B")]


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Versioned(spark, path)
    first = table.commit(table.current(), {}, {"n": 1})
    with pytest.raises(ConcurrentWrite):
        table.commit(type(first)(), {}, {"n": 2})
    assert table.current().run == {"n": 1} and table._names(path + "/_manifest") == ["v000000000001.json"]


def test_merged_lines(spark, tmp_path):
    path = str(tmp_path / "sales")
    store.sync_range(spark, path, lines(spark, (day(1, 10), "a", "1", 5), (day(1, 11), "b", "2", 6), (day(1, 20), "c", "3", 7), (day(2, 1), "d", "4", 8)), day(1, 1), day(2, 29), full_detail=True)
    base = Versioned(spark, path).current()
    store.merge_lines(spark, path, lines(spark, (day(1, 11), "b", "2", 1), (day(1, 11), "b", "2", 2), (day(1, 12), "n", "9", 4), (day(3, 1), "m", "8", 1)))
    assert stored(spark, path) == [(day(1, 10), "a", "1", 5.0), (day(1, 11), "b", "2", 3.0), (day(1, 12), "n", "9", 4.0), (day(1, 20), "c", "3", 7.0), (day(2, 1), "d", "4", 8.0), (day(3, 1), "m", "8", 1.0)]
    now = Versioned(spark, path).current()
    assert now.parts["2024-01"][0] == base.parts["2024-01"][0] and len(now.parts["2024-01"]) == 2 and now.parts["2024-02"] == base.parts["2024-02"]  # no month was rewritten
    store.merge_lines(spark, path, lines(spark, (day(1, 11), "b", "2", 9)), day(1, 11), day(1, 20))  # the batch lacks n and c
    want = [(day(1, 10), "a", "1", 5.0), (day(1, 11), "b", "2", 9.0), (day(2, 1), "d", "4", 8.0), (day(3, 1), "m", "8", 1.0)]
    assert stored(spark, path) == want
    assert [float(r.amount) for r in store.scan_range(spark, path, day(1, 11), day(1, 15)).collect()] == [9.0]
    assert store.merge_months(spark, path) == ["2024-01"] and stored(spark, path) == want and store.merge_months(spark, path) == []
    store.merge_lines(spark, path, lines(spark, (day(4, 1), "x", "1", 1)), day(2, 1), day(2, 10))  # nothing in the range: its days are emptied
    assert stored(spark, path) == [r for r in want if r[0].month != 2]


@pytest.mark.parametrize("limit", [0, store.BROADCAST_LINES])
def test_deltas_are_read_with_and_without_broadcast(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(store, "BROADCAST_LINES", limit)
    path = str(tmp_path / "sales")
    for k in range(3):
        store.merge_lines(spark, path, lines(spark, *[(day(1, 1 + d), "a", str(d), k) for d in range(k, 4)]))
    assert [(r[2], r[3]) for r in stored(spark, path)] == [("0", 0.0), ("1", 1.0), ("2", 2.0), ("3", 2.0)]
    store.merge_lines(spark, path, lines(spark))
    assert len(stored(spark, path)) == 4


def test_compacted_lines_merge_by_their_document(spark, tmp_path):
    path = str(tmp_path / "sales")
    store.sync_range(spark, path, lines(spark, (day(1, 1), "a", "1", 1), (day(1, 1), "b", "2", 2)), day(1, 1), day(1, 31))
    store.merge_lines(spark, path, lines(spark, (day(1, 1), "a", "7", 5)), full_detail=False)
    assert sorted((r.client_key, float(r.amount)) for r in store.read_sales(spark, path).collect()) == [("a", 5.0), ("b", 2.0)]


def test_counts_of_chunks_and_ranges(spark, tmp_path):
    path, log = str(tmp_path / "sales"), str(tmp_path / "log")
    rows = lines(spark, (day(1, 1), "a", "1", 1), (day(1, 1), "a", "1", 2), (day(1, 9), "", "2", 2), (day(2, 20), "b", "3", 4), (day(3, 30), "c", "4", 1))
    run, chunks = store.sync_ranges(spark, path, rows, [(day(1, 1), day(1, 15)), (day(2, 15), day(2, 29))], log, full_detail=True, chunk_days=8, valid=F.col("client_key") != "")
    assert [(c["chunk_start"].day, c["chunk_end"].day, c["rows_read"], c["rows_valid"], c["rows_stored"]) for c in chunks] == [(1, 8, 2, 2, 1), (9, 15, 1, 0, 1), (15, 22, 1, 1, 1), (23, 29, 0, 0, 0)]
    assert run["records_received"] == 4 and spark.read.schema(store.RUN_SCHEMA).parquet(log).count() == 2
    assert [tuple(r) for r in store.period_statistics(spark, path).orderBy("month").collect()] == [("2024-01", 2, day(1, 1), day(1, 9)), ("2024-02", 1, day(2, 20), day(2, 20))]
    assert Versioned(spark, path).current().span() == (day(1, 1), day(2, 20))
    status = store.stored_status(spark, path)
    assert tuple(status.first()) == (3, day(1, 1), day(2, 20), True) and not status.inputFiles()
    assert tuple(store.stored_status(spark, str(tmp_path / "none")).first()) == (0, None, None, False)
    store.sync_ranges(spark, path, lines(spark, (day(1, 12), "z", "1", 1)), [(day(1, 9), day(1, 9)), (day(1, 12), day(1, 13))], full_detail=True)
    assert [(r[0].day, r[1]) for r in stored(spark, path)] == [(1, "a"), (12, "z"), (20, "b")]


def test_a_range_outside_the_store_is_told_without_a_job(spark, tmp_path):
    path = str(tmp_path / "sales")
    with pytest.raises(ValueError):
        store.scan_range(spark, path, day(1, 1), day(1, 2))
    store.sync_range(spark, path, lines(spark, (day(1, 1), "a", "1", 1)), day(1, 1), day(1, 31))
    with pytest.raises(ValueError):
        store.scan_range(spark, path, day(1, 2), day(1, 20))
    with pytest.raises(RuntimeError):
        store.sync_range(spark, str(tmp_path / "other"), lines(spark), day(1, 1), day(1, 2))
    assert stored(spark, str(tmp_path / "other")) == []
