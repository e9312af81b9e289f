"""Paths and text sources on small literals."""

from strandlab.sources import instances, paths


def test_digit_corpus_paths(spark):
    rows = [("C:\\db\\TRAIN\\MAN\\AE\\1A.WAV",), ("db/test/woman/bc/z3o9b.raw",), ("db/test/robot/bc/1a.raw",), (None,)]
    got = {r["path"]: r for r in paths.parse_digit_corpus(spark.createDataFrame(rows, "path string")).collect()}
    first = got["C:\\db\\TRAIN\\MAN\\AE\\1A.WAV"]
    assert (first["usage"], first["speaker_type"], first["speaker_id"], first["digits"], first["production"], first["extension"]) == ("train", "man", "ae", "1", "a", "wav")
    assert got["db/test/woman/bc/z3o9b.raw"]["digits"] == "z3o9" and got["db/test/woman/bc/z3o9b.raw"]["valid"]
    assert not got["db/test/robot/bc/1a.raw"]["valid"] and got["db/test/robot/bc/1a.raw"]["usage"] is None
    assert not got[None]["valid"]


def test_label_is_the_first_directory(spark, tmp_path):
    for label in ("up", "down"):
        (tmp_path / "root" / label).mkdir(parents=True)
        (tmp_path / "root" / label / "a.txt").write_text("1 2\n3 4\n")
    got = paths.read_labelled_text(spark, str(tmp_path / "root")).select("label", "value").collect()
    assert sorted(map(tuple, got)) == [("down", "1 2"), ("down", "3 4"), ("up", "1 2"), ("up", "3 4")]


def test_names_file_lists_the_classes(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "x int, label string")
    instances.write_delimited(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "names")).first()["value"] == "a, b"
    assert spark.read.csv(str(tmp_path / "out" / "data"), nullValue="?").count() == 3


def test_names_are_made_safe(spark):
    df = spark.createDataFrame([("1-a b",), ("x/y",)], "`2col` string")
    out = instances.sanitize_nominals(df, ["2col"])
    assert out.columns == ["N2col"] and sorted(r[0] for r in out.collect()) == ["V1RaRb", "xRy"]
