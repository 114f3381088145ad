import time

import numpy as np
import pytest

from tidewatch.sources import live, sinks


def test_pace():
    p = live.Pace(first=5, every=10)
    assert [p.due(t) for t in (-1, 0, 0.9, 1, 4.9, 5, 14.9, 15, 25.1)] == [0, 0, 0, 1, 4, 5, 5, 6, 7]
    assert p.at(np.arange(8)).tolist() == [1000, 2000, 3000, 4000, 5000, 15000, 25000, 35000]
    r = live.Pace(rate=4, events=6)
    assert [r.due(t) for t in (0, 0.25, 1, 100)] == [0, 1, 4, 6]
    for pace in (p, r):
        assert all(pace.due(t / 1000) == n + 1 for n, t in enumerate(pace.at(np.arange(6)).tolist()))
    with pytest.raises(ValueError, match="rate"):
        live.Pace()


def test_goes_on_after_a_restart(spark, tmp_path):
    """The same events as in one go, none twice and none missing."""
    out, kept, start = str(tmp_path / "out"), str(tmp_path / "kept"), time.time() - 40
    seen = []
    for _ in range(3):
        sinks.files(live.key_range_stream(spark, 25, keys=7, parallelism=2, start=start), out, kept, once=True).awaitTermination()
        rows = spark.read.parquet(out).collect()
        seen.append(len(rows))
        time.sleep(0.2)
    assert seen[0] >= 2000 and seen == sorted(set(seen))
    for part in (0, 1):
        own = sorted((r for r in rows if r["part"] == part), key=lambda r: r["n"])
        assert [r["n"] for r in own] == list(range(len(own)))
        assert all(r["key"] == (r["n"] + 1) % 7 and r["src_address"] == f"172.16.100.{r['n'] % 255}" and r["occur_time"] == int(start * 1000) + -(-(r["n"] + 1) * 1000 // 25) for r in own)


def test_script_and_end(spark, tmp_path):
    sinks.files(live.periodic_stream(spark, start=time.time() - 27), str(tmp_path / "a"), str(tmp_path / "b"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 7
    sinks.files(live.key_range_stream(spark, 1000, events=50, start=time.time() - 27), str(tmp_path / "c"), str(tmp_path / "d"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "c")).count() == 50
