"""Frames of many small files and of split ones."""

from __future__ import annotations

import os

from strandlab.sources import frames


def read(spark, path):
    got = {}
    for r in frames.read_frames(spark, path).collect():
        got.setdefault(os.path.basename(os.path.dirname(r["seq_id"])), []).append((r["t"], r["x"]))
    return {k: sorted(v) for k, v in got.items()}


def wrote(tmp_path, sizes):
    want = {}
    for i, n in enumerate(sizes):
        (tmp_path / f"k={i}").mkdir()
        lines = [f" {i} {t}.5 " for t in range(n)]
        (tmp_path / f"k={i}" / "a.txt").write_text("\n\n".join(lines) + "\n")  # empty lines are no frames
        want |= {f"k={i}": [(t, [float(i), t + 0.5]) for t in range(n)]} if n else {}
    return want


def test_whole_files_meet_no_shuffle(spark, tmp_path, monkeypatch):
    want = wrote(tmp_path, [3, 0, 1, 25_000, 7])  # the long one is more than an Arrow batch
    monkeypatch.setattr(frames, "dense_index", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert read(spark, str(tmp_path)) == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 20


def test_split_files_are_put_together(spark, tmp_path):
    want = wrote(tmp_path, [5, 900, 2, 40])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert read(spark, str(tmp_path)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    wrote(tmp_path, [1] * 80)
    tracker = spark.sparkContext.statusTracker()
    known = set(tracker.getJobIdsForGroup(None))
    frames._listed(spark, str(tmp_path))
    tasks = [tracker.getStageInfo(s).numTasks for j in set(tracker.getJobIdsForGroup(None)) - known for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= frames.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert spark.conf.get(frames.LISTING) == "10000"


def test_lines_are_one_file_a_key(spark, tmp_path):
    rows = [(k, t, None if t == 3 else f"{k} {t}") for t in range(6) for k in (7, 12, None)]
    frames.write_lines(spark.createDataFrame(rows, "k long, t long, line string").repartition(4), "k", "line", f"file://{tmp_path}/out", 3, ["t"])
    found = {d.name: [(f.name, f.read_text()) for f in d.iterdir()] for d in (tmp_path / "out").iterdir()}
    want = lambda k: "".join("\n" if t == 3 else f"{k} {t}\n" for t in range(6))
    assert found == {f"k={'__HIVE_DEFAULT_PARTITION__' if k is None else k}": [("part-0.txt", want(k))] for k in (7, 12, None)}
