"""Named text files, and scans that keep errors as rows."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from pointloom.sources import clouds, files


def test_named_files_appear_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.range(5000).select(F.concat(F.lit("c/scan_"), F.col("id") % 3, F.lit("_segmented.txt")).alias("file"), F.col("id").alias("k"), F.format_string("%d é", "id").alias("value"))
    files.write_named(df.repartition(7), root, "file", ["k"])
    assert sorted(os.listdir(root)) == ["c"] and sorted(os.listdir(f"{root}/c")) == [f"scan_{i}_segmented.txt" for i in range(3)]
    for i in range(3):
        assert open(f"{root}/c/scan_{i}_segmented.txt", encoding="utf-8").read() == "".join(f"{k} é\n" for k in range(i, 5000, 3))
    files.write_named(df.where("k % 3 = 1 AND k < 10"), root, "file", ["k"])  # replaced; the others stay
    assert open(f"{root}/c/scan_1_segmented.txt").read().count("\n") == 3 and len(os.listdir(f"{root}/c")) == 3


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    root = str(tmp_path / "out")
    spark.dataSource.register(files.NamedText)
    two = spark.range(10).select(F.lit("same.txt").alias("name"), F.col("id").cast("string").alias("value")).repartition(2)
    with pytest.raises(Exception, match="several partitions"):
        two.write.format("named_text").option("path", root).mode("append").save()
    bad = spark.range(100).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), "id", F.when(F.col("id") < 99, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("broken row"))).alias("value"))
    with pytest.raises(Exception, match="broken row"):
        files.write_named(bad, root, "file", ["id"])
    assert [f for _, _, fs in os.walk(root) for f in fs] == []


@pytest.fixture()
def tree(tmp_path):
    def put(path, data):
        p = tmp_path / "data" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    good = b"".join(b"%d 0 0 1 2 3\n" % i for i in range(900))
    put("Area_1/hall/Annotations/wall_1.txt", good)
    put("Area_1/hall/Annotations/chair_1.txt", good[:400] + b"\xff\xfe oops\n" + good[400:])
    put("Area_1/hall/Annotations/door_1.txt.gz", gzip.compress(good))
    put("Area_1/hall/Annotations/floor_1.txt.gz", gzip.compress(good)[:-900])
    put("Area_1/hall/Annotations/sofa_1.txt.gz", b"no gzip at all")
    put("Area_1/hall/Annotations/empty_1.txt", b"")
    put("Area_1/hall/Annotations/table_1.txt", "1 2 3 4 5 6\r\n7 8 9 1 2 3".encode())
    put("Area_2/hall/Annotations/wall_1.txt", good)
    put("Area_1/hall/notes.md", b"nothing")
    return str(tmp_path / "data")


def test_errors_are_rows_and_numbers_stay(spark, tree):
    lines = files.read_checked(spark, tree, ["Area_1"], split_bytes=1000).cache()
    short = F.element_at(F.split("file_path", "/"), -1)
    got = {r.f: (r.n, r.first_line) for r in files.unreadable(lines).select(short.alias("f"), F.col("n_errors").alias("n"), "first_line").collect()}
    assert set(got) == {"chair_1.txt", "floor_1.txt.gz", "sofa_1.txt.gz"} and got["sofa_1.txt.gz"] == (1, 0)
    n = open(f"{tree}/Area_1/hall/Annotations/chair_1.txt", "rb").read()[:400].count(b"\n")
    assert got["chair_1.txt"][1] in (n, n + 1) and got["floor_1.txt.gz"][0] == 1
    for name in ("wall_1.txt", "door_1.txt.gz"):
        mine = lines.where(short == name)
        assert mine.count() == 900 and mine.where(F.split("value", " ")[0].cast("long") != F.col("line_no")).count() == 0
    after = lines.where((short == "chair_1.txt") & (F.col("line_no") > n + 1)).where(F.split("value", " ")[0].cast("long") == F.col("line_no") - 1)
    assert after.count() >= 900 - n - 2
    kept = files.readable(lines)
    assert {r.f for r in kept.select(short.alias("f")).distinct().collect()} == {"wall_1.txt", "door_1.txt.gz", "table_1.txt"}
    assert [r.value for r in kept.where(short == "table_1.txt").orderBy("line_no").collect()] == ["1 2 3 4 5 6", "7 8 9 1 2 3"]
    points = clouds.labelled_points(kept.where(~F.col("file_path").endswith("gz")))
    assert points.groupBy("label").count().count() == 2 and points.count() == 902


def test_areas_are_chosen_before_files_are_listed(tree):
    pieces = files.CheckedReader(tree, 1000, ["Area_2", "Area_9"]).partitions()
    assert {p.area for p in pieces} == {"Area_2"} and len(pieces) > 5
    assert {p.area for p in files.CheckedReader(tree, 1000, None).partitions()} == {"Area_1", "Area_2"}


def test_small_pieces_share_tasks(spark, tmp_path):
    """Many pieces are few tasks, and every line has the number and the error that it has in a piece of its own."""
    folder = tmp_path / "data" / "Area_1" / "hall" / "Annotations"
    folder.mkdir(parents=True)
    lines = [("%d " % i) * (i % 7) for i in range(4000)]
    (folder / "wall_1.txt").write_bytes("\r\n".join(lines).encode())
    (folder / "door_1.txt").write_bytes(b"a\n\xff\nb\n" * 40)
    root = str(tmp_path / "data")
    packs = files.CheckedReader(root, 10, None).partitions()
    runs = [r for p in packs for r in p.runs if r.path.endswith("wall_1.txt")]
    size = (folder / "wall_1.txt").stat().st_size
    assert len(packs) < 300 < size // 10 and runs[0].begin == 0 and runs[-1].end == size
    assert all(a.end == b.begin == 10 * b.no for a, b in zip(runs, runs[1:], strict=False))
    got = files.read_checked(spark, root, split_bytes=10).where("file_path LIKE '%wall_1.txt'").orderBy("line_no").collect()
    assert [(r.line_no, r.value, r.error) for r in got] == [(i, v, None) for i, v in enumerate(lines)]
    bad = files.read_checked(spark, root, split_bytes=10).where("error IS NOT NULL").collect()
    assert sorted(r.line_no for r in bad) == list(range(1, 120, 3))


def test_every_piece_of_a_lost_file_is_an_error(tmp_path):
    reader = files.CheckedReader(str(tmp_path), 10, None)
    rows = [r for b in reader.read(files.Pack("Area_1", [files.Run(str(tmp_path / "lost.txt"), 3, 30, 65)])) for r in b.to_pylist()]
    assert [(r["split"], r["line"], r["value"]) for r in rows] == [(k, 0, None) for k in (3, 4, 5, 6)] and all("Error" in r["error"] for r in rows)
