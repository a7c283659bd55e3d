"""Bar files, calendar and Parquet stages."""

from __future__ import annotations

import datetime as dt
import subprocess
import sys

import pytest

from termlab.operators import contracts, quality
from termlab.plans import jobs
from termlab.sources import tables
from termlab.sources.bars import fill_symbols, read_bars
from termlab.sources.calendar import read_expiry_calendar

HEADER = "symbol,timestamp,tradingDay,close"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture
def bar_tree(tmp_path):
    root = tmp_path / "bars"
    # 14:55 Chicago is 20:55 UTC in winter and 19:55 UTC in summer.
    write(
        root / "a" / "one.csv",
        HEADER,
        "VIF24,2023-12-01 20:50:00,2023-12-01,14.0",
        "VIF24,2023-12-01 21:00:00,2023-12-01,15.0",  # equally far, later: loses
        "VIF24,junk,2023-12-01,99.0",
        "VIF24,2023-12-04 20:54:00,2023-12-04,16.0",
        "VIF24,2023-12-04 20:57:00,2023-12-04,17.0",
        "VIF24,2023-12-05 20:55:00,not-a-day,1.0",
        "VIF24,2024-01-17 20:55:00,2024-01-17,18.0",  # expiry day
        "VIF24,2024-01-18 20:55:00,2024-01-18,18.0",  # after it
    )
    write(
        root / "b" / "vin24.csv",  # other column order, extra column, no symbols
        "close,venue,symbol,tradingDay,timestamp",
        '20.0,"x, y",,2024-06-03,2024-06-03 19:55:00',
        "21.0,z,,2024-06-03,2024-06-03 20:55:00",
    )
    write(root / "c" / "two.csv", HEADER, "VIF24,2023-12-01 20:55:00,2023-12-01,77.0")  # later path loses
    write(root / "d" / "bad.csv", "symbol,timestamp,tradingDay", "VIF24,2023-12-06 20:55:00,2023-12-06")
    write(root / "d" / "notes.txt", "not a bar file")
    return str(root)


@pytest.fixture
def expiries(tmp_path):
    path = tmp_path / "expiries.txt"
    path.write_text("10 January 2024\n\n  17 January 2024\n17 July 2024\n")
    return str(path)


def test_calendar_last_line_wins(spark, expiries):
    rows = {(r.exp_year, r.exp_month): r.expiry for r in read_expiry_calendar(spark, expiries).collect()}
    assert rows == {(2024, 1): dt.date(2024, 1, 17), (2024, 7): dt.date(2024, 7, 17)}


def test_term_structure_from_files(spark, bar_tree, expiries):
    bars = read_bars(spark, bar_tree)
    term = contracts.term_structure(bars, read_expiry_calendar(spark, expiries))
    got = {(r.symbol, r.tradingDay): (r.close, r.ttm_days) for r in term.collect()}
    assert got == {
        ("VIF24", dt.date(2023, 12, 1)): (14.0, 47),
        ("VIF24", dt.date(2023, 12, 4)): (16.0, 44),
        ("VIN24", dt.date(2024, 6, 3)): (20.0, 44),
    }
    one = quality.bar_quality(contracts.parse_bars(bars)).collect()[0]
    assert (one.n_bars, one.n_bad_time, one.n_bad_day, one.n_no_symbol) == (11, 1, 1, 0)


def test_fast_pick_is_equal_when_times_are_unique(spark, bar_tree):
    bars = contracts.parse_bars(read_bars(spark, bar_tree))
    keys = ["file_path"]
    assert sorted(contracts.pick_nearest(bars, keys).collect(), key=str) == sorted(
        contracts.pick_nearest(bars, keys, unique_times=True).collect(), key=str
    )


def test_single_layout_and_missing_files(spark, tmp_path):
    write(tmp_path / "x" / "1.csv", HEADER, "VIF24,2023-12-01 20:55:00,2023-12-01,1.5")
    write(tmp_path / "x" / "y" / "2.csv", HEADER, "VIG24,2023-12-01 20:55:00,2023-12-01,2.5")
    assert sorted(r.close for r in read_bars(spark, str(tmp_path / "x")).collect()) == [1.5, 2.5]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        read_bars(spark, str(tmp_path / "empty"))


def test_symbol_that_cannot_be_inferred(spark, tmp_path):
    write(tmp_path / "z" / "plain.csv", HEADER, ",2023-12-01 20:55:00,2023-12-01,1.5")
    bars = read_bars(spark, str(tmp_path / "z"))
    assert fill_symbols(bars).collect()[0].symbol is None
    with pytest.raises(Exception, match="no symbol can be found"):
        fill_symbols(bars, strict=True).collect()


def test_a_partly_filled_file_invents_no_contract(spark, tmp_path):
    write(
        tmp_path / "p" / "vin24.csv",
        HEADER,
        "VIF24,2023-12-01 20:55:00,2023-12-01,1.5",
        ",2023-12-02 20:55:00,2023-12-02,2.5",
    )
    bars = read_bars(spark, str(tmp_path / "p"))
    rows = sorted(fill_symbols(bars).collect(), key=lambda r: r.close)
    assert [r.symbol for r in rows] == ["VIF24", None]
    with pytest.raises(Exception, match="no symbol can be found"):
        fill_symbols(bars, strict=True).collect()


def test_the_bar_tree_is_read_once(spark, bar_tree, expiries):
    """By the job that picks, in one scan of lines; names are looked up among the picked rows."""
    picked = contracts.pick_nearest(contracts.parse_bars(read_bars(spark, bar_tree)), ["file_path"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "BroadcastHashJoin [_key" in plan
    term = contracts.term_structure(read_bars(spark, bar_tree), read_expiry_calendar(spark, expiries))
    plan = term._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "FileScan text" in x and "bars" in x]
    assert not lines and "FileScan parquet" in plan


def test_scratch_is_shared_and_cleared(spark):
    root = tables.scratch_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_times_do_not_depend_on_the_session_zone(spark, bar_tree):
    expected = sorted(contracts.pick_nearest(contracts.parse_bars(read_bars(spark, bar_tree))).collect(), key=str)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(contracts.pick_nearest(contracts.parse_bars(read_bars(spark, bar_tree))).collect(), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r.symbol, r.tradingDay, r.close) for r in got] == [(r.symbol, r.tradingDay, r.close) for r in expected]


def test_scratch_on_a_local_disk_is_refused_on_a_cluster():
    assert tables.scratch_base("hdfs://n/c/", "file:/w", "yarn") == "hdfs://n/c"
    assert tables.scratch_base(None, "s3a://b/w", "yarn") == "s3a://b/w"
    assert tables.scratch_base(None, "file:/w", "local[4]") == "file:/w"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077", "k8s://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.scratch_base(None, "file:/w", master)


def test_what_a_session_staged_goes_when_it_ends(tmp_path):
    code = f"""
from termlab.session import build_session
from termlab.sources.tables import scratch_root, stage
spark = build_session("ends", "local[1]", 1, {{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r}}})
assert stage(spark.range(3), "three").count() == 3
import os
assert os.path.isdir(scratch_root(spark))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=jobs.__file__.rsplit("/termlab/", 1)[0], timeout=120)
    assert not list(tmp_path.glob("termlab-*"))


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b"):
        tables.require_columns(spark.range(1), ["id", "b"])


def test_stage_uses_the_shared_folder(spark):
    path = tables.scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert tables.stage(spark.range(5), "five").count() == 5


def test_price_job(spark, tmp_path, bar_tree, expiries):
    out = str(tmp_path / "out")
    jobs.run_prices(spark, bar_tree, expiries, out)
    prices = spark.read.parquet(f"{out}/synthetic_prices").orderBy("tradingDay").collect()
    assert [(r.tradingDay.isoformat(), r.px_30d, r.px_180d) for r in prices] == [
        ("2023-12-01", 14.0, 14.0),
        ("2023-12-04", 16.0, 16.0),
        ("2024-06-03", 20.0, 20.0),
    ]


def test_two_curves_equal_their_single_runs(spark, tmp_path, expiries):
    for curve, shift in (("one", 0.0), ("two", 5.0)):
        for symbol, close in (("VIF24", 14.0), ("VIN24", 20.0)):
            write(
                tmp_path / "bars" / curve / f"{symbol}.csv",
                HEADER,
                f"{symbol},2023-12-01 20:55:00,2023-12-01,{close + shift}",
                f"{symbol},2023-12-04 20:55:00,2023-12-04,{close + shift + 1}",
            )
    jobs.run_prices(spark, str(tmp_path / "bars"), expiries, str(tmp_path / "all"), keys=["curve_id"])
    together = spark.read.parquet(str(tmp_path / "all" / "synthetic_prices"))
    for curve in ("one", "two"):
        jobs.run_prices(spark, str(tmp_path / "bars" / curve), expiries, str(tmp_path / curve))
        alone = spark.read.parquet(str(tmp_path / curve / "synthetic_prices")).orderBy("tradingDay").collect()
        mine = together.where(f"curve_id = '{curve}'").drop("curve_id").orderBy("tradingDay").collect()
        assert [r.asDict() for r in mine] == [r.asDict() for r in alone] and len(mine) == 2


def test_month_filter_prunes_partitions(spark, tmp_path, bar_tree, expiries):
    out = str(tmp_path / "out")
    jobs.build_term_structure(spark, bar_tree, expiries, out)
    rows = jobs._read_contracts(spark, f"{out}/term_structure", dt.date(2024, 1, 1))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and rows.count() == 1
