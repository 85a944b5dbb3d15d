"""Source files, baselines, policies, view writing and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from sinkwell import __main__ as cli
from sinkwell.plans.views import VIEWS, write_views
from sinkwell.sources import files
from sinkwell.sources.stored import shared_dir, stored
from sinkwell.streaming.generations import Generations


def test_source_files_are_filtered(spark, tmp_path):
    for name in ("src/a.tsx", "src/b.d.ts", "src/c.test.ts", "node_modules/x/d.ts", "src/deep/e.js", "src/f.cjs", "styled-system/g.ts", "lib/.solid/h.ts", "tests/i.ts", "j.mts", "README.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"line one of {name}\nline two\n")
    rows = {r.path: r.text for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["src/a.tsx", "src/deep/e.js", "src/f.cjs", "tests/i.ts"] and rows["src/a.tsx"].count("\n") == 2
    assert "src/c.test.ts" in {r.path for r in files.read_sources(spark, str(tmp_path), tests=True).collect()}


@pytest.mark.parametrize(("before", "worse"), [(0.0, True), (0.9, False)])
def test_baseline(spark, tmp_path, before, worse):
    p = tmp_path / "base.json"
    p.write_text(json.dumps({"analysisVersion": 1, "sinks": [{"file": "a", "scores": {"burden": before}}]}))
    current = spark.createDataFrame([(0.4,), (0.5,)], "burden double")
    assert files.regressed(current, files.read_baseline(spark, str(p))).first().regressed is worse


def test_policy_is_strict(spark):
    assert files.read_policy(spark, '{"version": 1, "exclude": ["a/**"], "include": []}') == (["a/**"], [])
    for bad in ('{"version": 2}', '{"version": 1, "other": []}', "not json"):
        with pytest.raises(Exception):  # noqa: B017
            files.read_policy(spark, bad)


def test_views_are_written(spark, small, tmp_path):
    assert write_views(spark, small, str(tmp_path / "out"), ["fan-in", "junctions"]) == ["fan-in", "junctions"]
    assert spark.read.json(str(tmp_path / "out")).select("view").distinct().count() == 2
    for name, view in VIEWS.items():
        assert view(spark, small).columns, name


def test_command_line(spark, small, tmp_path, capsys):
    assert cli.main(["--data", small, "--view", "junctions", "--max-items", "3"]) == 0
    assert "junctions" in capsys.readouterr().out
    p = tmp_path / "base.json"
    p.write_text(json.dumps({"sinks": [{"scores": {"burden": 0.0}}]}))
    assert cli.main(["--data", small, "--view", "fan-in", "--out", str(tmp_path / "o"), "--baseline", str(p)]) == 1
    with pytest.raises(SystemExit):
        cli.arguments(["--data", small, "--max-items", "0"])


def test_generations_and_store(spark, tmp_path):
    g = Generations(spark, "t", str(tmp_path))
    assert g.read() is None
    g.publish(spark.range(3), 0)
    g.publish(spark.range(5), 1)
    assert g.read().count() == 5 and g.read(0) is None and g.read(1).count() == 5
    kept = stored(spark.range(4).withColumn("x", F.lit("a")), "t")
    assert kept.count() == 4 and kept.inputFiles()[0].split("file:")[-1].lstrip("/").startswith(shared_dir(spark).split("file:")[-1].lstrip("/"))


def test_the_last_good_generation_outlives_its_writer(spark, tmp_path):
    root = str(tmp_path)
    assert Generations(spark, "g", root).publish(spark.range(3)) == 1
    reader = Generations(spark.newSession(), "g", root)
    broken = spark.range(4).withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        Generations(spark.newSession(), "g", root).publish(broken)
    assert reader.current == 1 and reader.read().count() == 3
    with reader.pinned() as rows:
        assert Generations(spark, "g", root).publish(spark.range(7)) == 2
        assert rows.count() == 3 and reader.current == 2 and reader.read(1) is not None
    assert reader.prune() == [1] and reader.read(1) is None and reader.read().count() == 7
    names = [p.name for p in (tmp_path / "g").iterdir() if p.name.startswith(("pin", "draft"))]
    assert names == []


def test_writers_that_meet_take_numbers_of_their_own(spark, tmp_path, monkeypatch):
    first, second = Generations(spark, "m", str(tmp_path)), Generations(spark, "m", str(tmp_path))
    first.publish(spark.range(1), keep=9)
    monkeypatch.setattr(Generations, "current", property(lambda self: None))  # both believe to be the first
    assert second.publish(spark.range(2), keep=9) == 2
    assert second.publish(spark.range(5), number=2, keep=9) == 2
    monkeypatch.undo()
    assert first.current == 2 and first.read().count() == 2 and first.read(1).count() == 1
    assert first.publish(spark.range(9), number=2) == 2 and first.read().count() == 2
    left = [p.name for p in (tmp_path / "m").iterdir() if p.name.startswith(("data", "draft"))]
    assert first.prune(1, stale=0) == [1] and len(left) > 2
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith(("data", "draft"))]) == 1
