import pytest

from sitemigrate.sources import site_log
from sitemigrate.sources.site import KEYS, SCHEMAS, SiteTables
from sitemigrate.sources.site_log import SiteLog


def terms(spark, rows):
    return spark.createDataFrame([(i, "category", f"t{i}", "x" * 40, 0) for i in rows], SCHEMAS["terms"])


def ids(spark, rows):
    return spark.createDataFrame([("e", "post", str(k), v) for k, v in rows], SCHEMAS["id_map"])


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def test_a_commit_writes_what_is_new(spark, tmp_path):
    log = SiteLog(spark, f"file://{tmp_path}/site")
    assert log.versions() == [] and log.read().terms.count() == 0
    assert log.commit({"terms": terms(spark, range(20_000))}, 1)
    first = size(tmp_path)
    assert log.commit({"terms": terms(spark, [20_000])}, 2)
    assert size(tmp_path) - first < first / 5
    assert log.read(1).terms.count() == 20_000 and log.read().terms.count() == 20_001
    assert not log.commit({"terms": terms(spark, [1])}, 2) and log.read().terms.count() == 20_001


def test_replaced_rows_and_merged_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(site_log, "FANOUT", 3)
    log, expected = SiteLog(spark, f"file://{tmp_path}/site"), {}
    for version in range(1, 12):
        rows = [(k, version) for k in range(version % 4, version + 3)]
        old = ids(spark, [(k, 0) for k, _ in rows if k in expected])
        log.commit({"id_map": ids(spark, rows), "terms": terms(spark, [version])}, version, {"id_map": old.select(*KEYS["id_map"])})
        expected |= dict(rows)
        got = [(int(r["old_key"]), r["new_id"]) for r in log.read().id_map.collect()]
        assert sorted(got) == sorted(expected.items())
    assert len([p for p in log.pieces() if p.table == "terms"]) < 6 and max(p.level for p in log.pieces()) == 2
    assert sorted(r["term_id"] for r in log.read(5).terms.collect()) == [1, 2, 3, 4, 5]
    gone = log.expire()
    assert gone and log.versions() == [11] and sorted(int(r["old_key"]) for r in log.read().id_map.collect()) == sorted(expected)
    assert not any((tmp_path / path.rpartition("/site/")[2]).exists() for path in gone)


def test_a_commit_that_fails_half_way_is_run_again(spark, tmp_path, monkeypatch):
    log = SiteLog(spark, f"file://{tmp_path}/site")
    log.commit({"terms": terms(spark, [1])}, 0)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(SiteLog, "_publish", fail)
        with pytest.raises(OSError, match="lost"):
            log.commit({"terms": terms(spark, [2, 3])}, 1)
    assert log.versions() == [0] and log.read().terms.count() == 1
    assert log.commit({"terms": terms(spark, [2, 3])}, 1) and log.read().terms.count() == 3
    assert SiteTables.empty(spark).changed({"terms": terms(spark, [7])}, {}).terms.count() == 1


def test_keys_of_replaced_rows_are_not_sent_whole(spark, tmp_path):
    log = SiteLog(spark, f"file://{tmp_path}/site")
    log.commit({"id_map": ids(spark, [(k, k) for k in range(50)])}, 1)
    log.commit({"id_map": ids(spark, [(k, k + 100) for k in range(40)])}, 2, {"id_map": ids(spark, [(k, 0) for k in range(40)]).select(*KEYS["id_map"])})
    now = log.read().id_map
    assert "BroadcastHashJoin" not in now._jdf.queryExecution().executedPlan().toString()
    assert sorted(int(r["new_id"]) for r in now.collect()) == [*range(40, 50), *range(100, 140)]
