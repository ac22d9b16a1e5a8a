"""The frame files' data source, the sinks that write through it, and the stream that publishes frames once."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from scanweave import catalogue
from scanweave.plans.tables import staged
from scanweave.sources import frames as fr
from scanweave.sources import scans
from scanweave.streaming.publish import publish, publish_batch, published

SF = "/root/testdata/sf0.001"


def coloured(spark, frames=6, n=40):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(np.round(rng.normal(0, 9, (frames * n, 3)) * 8) / 8, columns=["x", "y", "z"]).assign(frame_id=np.repeat(np.arange(frames), n), k=np.tile(np.arange(n), frames), r=1.0, g=2.0, b=255.0)
    return pdf, spark.createDataFrame(pdf, "x double, y double, z double, frame_id int, k long, r double, g double, b double")


def reader(folder, kind="xyzrgb", size=1 << 20):
    return fr.FrameReader(folder, kind, StructType.fromDDL("frame_id int, k bigint, x double"), size)


def test_six_floats_round_trip_and_only_wanted_files_are_opened(spark, tmp_path):
    pdf, df = coloured(spark)
    folder = str(tmp_path / "six")
    fr.write_frame_files(df.repartition(5), folder, "xyzrgb")
    assert sorted(os.listdir(folder)) == [f"{k}.bin" for k in range(6)]
    back = scans.read_coloured_scans(spark, folder).toPandas().sort_values(["frame_id", "k"])
    assert (back[["frame_id", "k", "x", "y", "z", "r", "g", "b"]].to_numpy(float) == pdf[["frame_id", "k", "x", "y", "z", "r", "g", "b"]].to_numpy(float)).all()
    # a file that cannot be opened: it does not matter as long as its frame is not asked for
    os.replace(f"{folder}/5.bin", f"{folder}/55.bin")
    os.symlink(f"{folder}/nowhere.bin", f"{folder}/5.bin")
    some = scans.read_coloured_scans(spark, folder)
    assert some.where("frame_id < 3 and x > 0").count() == int(((pdf.frame_id < 3) & (pdf.x > 0)).sum())
    assert "frame_id" not in some.where("frame_id between 1 and 2 and k >= 0")._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].split("Filter")[-1]


def test_filters_choose_files(tmp_path):
    for k in (1, 2, 30, 4):
        (tmp_path / f"{k}.bin").write_bytes(b"\0" * 24 * k)
    (tmp_path / "note.txt").write_text("")
    name = ("frame_id",)
    for pushed, want in (([GreaterThan(name, 2)], [4, 30]), ([GreaterThanOrEqual(name, 2), LessThan(name, 30)], [2, 4]), ([In(name, (1, 30, 7))], [1, 30]), ([EqualTo(name, 4)], [4]), ([LessThanOrEqual(name, 1)], [1]), ([EqualTo(name, 3)], []), ([], [1, 2, 4, 30])):
        r = reader(str(tmp_path))
        assert list(r.pushFilters([*pushed, IsNotNull(name), IsNotNull(("x",)), EqualTo(("x",), 1.0)])) == [IsNotNull(("x",)), EqualTo(("x",), 1.0)]
        assert [f for p in r.partitions() for f, _ in p.files] == want
    sizes = [[f for f, _ in p.files] for p in reader(str(tmp_path), size=100).partitions()]
    assert sizes == [[1, 2], [4], [30]]
    with pytest.raises(ValueError):
        fr.FrameSource({"path": "p", "kind": "other"}).kind


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    _, df = coloured(spark)
    folder = str(tmp_path / "out")
    fr.write_frame_files(df.where("frame_id < 2"), folder, "xyzrgb")
    before = {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(folder)}
    broken = df.withColumn("x", F.when((F.col("frame_id") == 4) & (F.col("k") == 39), F.raise_error(F.lit("broken"))).otherwise(F.col("x") + 1))
    with pytest.raises(Exception, match="broken"):
        fr.write_frame_files(broken, folder, "xyzrgb")
    assert {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(folder)} == before
    # a frame in two tasks, and rows of a frame that do not stand together
    with pytest.raises(Exception, match="two tasks"):
        df.where("frame_id = 3").repartition(2, "k").select("frame_id", "x", "y", "z", "r", "g", "b").write.format("frames").option("kind", "xyzrgb").mode("append").save(folder)
    with pytest.raises(Exception, match="stand together"):
        df.coalesce(1).sortWithinPartitions("k").select("frame_id", "x", "y", "z", "r", "g", "b").write.format("frames").option("kind", "xyzrgb").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["0.bin", "1.bin"]
    fr.write_frame_files(df.where("frame_id = 5"), folder, "xyzrgb", overwrite=True)
    assert os.listdir(folder) == ["5.bin"]


def test_labels_clouds_and_empty_files(spark, tmp_path):
    labels = spark.createDataFrame([(0, 0, 40 | 300 << 16), (0, 1, 252), (1, 0, 1)], "frame_id int, k long, label long")
    fr.write_frame_files(labels, str(tmp_path / "l"), "label")
    assert sorted(map(tuple, fr.frames(spark, str(tmp_path / "l"), "label").collect())) == [(0, 0, 40 | 300 << 16), (0, 1, 252), (1, 0, 1)]
    (tmp_path / "l/2.label").write_bytes(b"")
    assert fr.frames(spark, str(tmp_path / "l"), "label").count() == 3
    pdf, df = coloured(spark, 2)
    assert scans.write_coloured(df, str(tmp_path / "c")) == 2
    back = fr.frames(spark, str(tmp_path / "c"), "cloud", fields="x,r,b,none")
    assert {tuple(r) for r in back.select("r", "b", "none").distinct().collect()} == {(1.0, 255.0, None)} and back.count() == len(pdf)


def test_a_file_without_a_partner_is_a_frame_of_its_own(spark, tmp_path):
    _, df = coloured(spark, 3)
    scans.write_coloured(df.withColumn("frame_id", F.col("frame_id") * 10), str(tmp_path / "c"))
    got = scans.merged_pairs(spark, str(tmp_path / "c")).groupBy("frame_id").agg(F.count("*").alias("n"), F.max("intensity").alias("i")).collect()
    assert {(r.frame_id, r.n, r.i) for r in got} == {(0, 80, 0.0), (1, 40, 0.0)}


def lzf_literals(body: bytes) -> bytes:
    return b"".join(bytes([len(body[i : i + 32]) - 1]) + body[i : i + 32] for i in range(0, len(body), 32))


def test_counted_and_compressed_clouds():
    head = "FIELDS x n y\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 3 1\nPOINTS 2\nDATA {}\n"
    a = np.arange(10, dtype="<f4").reshape(2, 5)
    names, values = scans.parse_cloud(head.format("binary").encode() + a.tobytes())
    assert names == ["x", "n", "n_1", "n_2", "y"] and (values == a).all()
    body = a[:, :1].tobytes() + a[:, 1:4].tobytes() + a[:, 4:].tobytes()
    packed = lzf_literals(body)
    names, values = scans.parse_cloud(head.format("binary_compressed").encode() + np.array([len(packed), len(body)], "<u4").tobytes() + packed)
    assert (values == a).all()
    assert scans.parse_cloud(head.format("ascii").encode() + b"0 1 2 3 4\n5 6 7\n")[1].tolist() == [[0, 1, 2, 3, 4]]
    # "ab", then nine bytes from two back, which overlap what they make
    assert scans.unpacked(bytes([1]) + b"ab" + bytes([(7 << 5), 0, 1]), 11) == b"abababababa"
    with pytest.raises(ValueError):
        scans.unpacked(bytes([1]) + b"ab", 3)
    with pytest.raises(ValueError):
        scans.unpacked(bytes([32, 5]), 3)


def test_stage_times_of_a_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\t2\t3\t4\t5\t6\t7\t8\t9\t10\t11\t99\n")
    got = {(r.stage, r.frame): r.seconds for r in scans.read_times(spark, str(tmp_path / "t.txt")).collect()}
    want = {(("pre_process", "segment", "recognise")[p % 3], p // 3): p + 1.0 for p in range(9)} | {("track", 0): 10.0, ("track", 1): 11.0}
    assert got == want
    assert scans.decoded_times(spark.createDataFrame([("a", ""), ("b", "1\t2")], "key string, value string"), "key").count() == 0


def test_a_restarted_stream_publishes_each_frame_once(spark, tmp_path):
    pdf, df = coloured(spark)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.where("frame_id < 3").repartition(1).write.parquet(source)
    stream = lambda: publish(spark.readStream.schema(df.schema).parquet(source), out, state, "cloud", ("x", "y", "z", "r", "g", "b"), once=True)
    stream().awaitTermination(120)
    files = lambda: {f: os.stat(f"{out}/{f}").st_mtime_ns for f in os.listdir(out) if f.endswith(".pcd")}
    first = files()
    assert sorted(first) == ["0.pcd", "1.pcd", "2.pcd"] and published(out) == {0}
    # as if the driver had died before it wrote that the batch was done: the batch runs again and finds its entry
    for f in os.listdir(f"{state}/commits"):
        os.remove(f"{state}/commits/{f}")
    df.where("frame_id >= 3").repartition(1).write.mode("append").parquet(source)
    stream().awaitTermination(120)
    assert {f: t for f, t in files().items() if f in first} == first and sorted(files()) == [f"{k}.pcd" for k in range(6)] and published(out) == {0, 1}
    assert fr.frames(spark, out, "cloud", fields="x,y,z,r,g,b").count() == len(pdf)
    # a batch that died between its files and its entry writes the same files again
    again = publish_batch(out, "cloud", ("x", "y", "z", "r", "g", "b"))
    again(df.where("frame_id = 0"), 2)
    assert (len(files()), published(out)) == (6, {0, 1, 2})


def test_staged_tables_follow_their_files(spark, tmp_path):
    folder = str(tmp_path / "lineitem.parquet")
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    items.limit(1000).write.parquet(folder)
    count = lambda: sum(r["n"] for r in catalogue.coarse_class(spark, str(tmp_path)).collect())
    assert count() == 1000
    items.limit(3000).write.mode("overwrite").parquet(folder)
    assert count() == 3000
    made = []
    for _ in range(2):
        staged("test", spark.read.parquet(folder), lambda: made.append(1) or spark.range(3))
    assert made == [1]
