"""Formats are read back as they were written."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import cameras, formats
from canopy.plans import tasks
from canopy.sources import arrays, filesets, meshes, ply, sfm
from canopy.streaming import watch


def test_ply_ascii_and_binary(spark, tmp_path):
    head = "element vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_bytes(("ply\nformat ascii 1.0\n" + head + "0 0 0\n1 0 0\n0 1.5 0\n3 0 1 2\n").encode())
    body = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1.5, 0) + struct.pack("<B3i", 3, 0, 1, 2)
    (tmp_path / "b.ply").write_bytes(("ply\nformat binary_little_endian 1.0\n" + head).encode() + body)
    v = ply.read(spark, str(tmp_path))
    assert v.count() == 6 and v.where("vid = 2").agg(F.sum("y")).first()[0] == 3.0
    assert [list(r.idx) for r in ply.read(spark, str(tmp_path), "face").collect()] == [[0, 1, 2]] * 2


def test_ply_written(spark, tmp_path):
    p = spark.createDataFrame([(0.5, 1.25, -2.0), (3.0, 0.1, 1e-9)], "x double, y double, z double").coalesce(1)
    ply.write_cloud(p, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.txt")).read_bytes()
    assert [(r["x"], r["y"], r["z"]) for r in ply.parse(text)["vertex"]] == [(0.5, 1.25, -2.0), (3.0, 0.1, 1e-9)]


def test_volumes(spark, tmp_path):
    v = np.zeros((3, 4, 5))
    v[1, 2, 3] = 7
    np.save(tmp_path / "one.npy", v)
    out = io.BytesIO()
    np.savez(out, stem=v, leaf=2 * v)
    (tmp_path / "two.npz").write_bytes(out.getvalue())
    rows = {(r.label, r.i, r.j, r.k, r.value) for r in arrays.read(spark, str(tmp_path)).collect()}
    assert rows == {(None, 1, 2, 3, 7.0), ("stem", 1, 2, 3, 7.0), ("leaf", 1, 2, 3, 14.0)}


def test_models(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 1, 2, 640, 480, 500.0, 320.0, 240.0, 0.1))
    image = struct.pack("<Qi4d3di", 1, 7, 1, 0, 0, 0, 1.0, 2.0, 3.0, 1) + b"00007_rgb.jpg\0" + struct.pack("<Qddq", 1, 10.0, 20.0, 5)
    (tmp_path / "images.bin").write_bytes(image)
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<QQdddBBBdQ2i", 1, 5, 1.0, 2.0, 3.0, 255, 0, 51, 0.5, 1, 7, 0))
    c = sfm.read_cameras(spark, str(tmp_path)).first()
    assert (c.camera_id, c.model, c.width, list(c.params)) == (1, "SIMPLE_RADIAL", 640, [500.0, 320.0, 240.0, 0.1])
    i = sfm.read_images(spark, str(tmp_path)).first()
    assert (i.image_id, i.name, list(i.rotmat[0]), list(i.tvec), list(i.point3d_ids)) == (7, "00007_rgb.jpg", [1.0, 0.0, 0.0], [1.0, 2.0, 3.0], [5])
    p = sfm.read_points(spark, str(tmp_path)).select("x", *sfm.colours()).first()
    assert tuple(p) == pytest.approx((1.0, 1.0, 0.0, 0.2))


def test_obj_and_json(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nusemtl stem\nf 1 2 3 4\nusemtl leaf\nf 1/1 2/2 3/3\n")
    v, t = meshes.read_obj(spark, str(tmp_path))
    assert v.count() == 4
    assert {(r.material, r.a, r.b, r.c) for r in t.collect()} == {("stem", 1, 2, 3), ("stem", 1, 3, 4), ("leaf", 1, 2, 3)}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.json").write_text('{"points": [[0, 0, 0], [1, 2, 3]], "lines": [[0, 1]]}')
    n, e = meshes.read_skeletons(spark, str(tmp_path / "s"))
    assert n.count() == 2 and [(r.src, r.dst) for r in e.collect()] == [(0, 1)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "m.json").write_text('{"angles": [1.5, 2.5], "internodes": [10, 20]}')
    assert {(r.pos, r.angle, r.internode) for r in meshes.read_measures(spark, str(tmp_path / "m")).collect()} == {(0, 1.5, 10.0), (1, 2.5, 20.0)}


def test_filesets(spark):
    f = spark.createDataFrame([("Masks_1", 1), ("Masks__raw", 2), ("camera_model", 3)], "fileset string, ord int")
    assert filesets.one_of_task(f, "IntrinsicCalibration").ord == 3
    with pytest.raises(ValueError, match="more than one"):
        filesets.one_of_task(f, "Masks")
    with pytest.raises(ValueError, match="no fileset"):
        filesets.one_of_task(f, "Voxels")


def test_formats(spark):
    d = spark.createDataFrame([(0,), (1024,), (300000,), (5,)], "n long")
    assert [r.s for r in d.select(formats.byte_size(F.col("n")).alias("s")).collect()] == ["0octets", "1.0 Ko", "292.97 Ko", "5.0 octets"]
    assert d.select(formats.byte_size(F.col("n"), formats.BYTES).alias("s")).collect()[2].s == "292.97 KB"
    p = spark.createDataFrame([([], [1, 2])], "a array<int>, b array<int>").select(formats.json_value(F.col("a")).alias("a"), formats.json_value(F.col("b")).alias("b")).first()
    assert tuple(p) == ("None", "[1,2]")


def test_camera_forms(spark):
    d = spark.createDataFrame([("SIMPLE_RADIAL", [500.0, 1.0, 2.0, 0.05])], "m string, p array<double>").select(cameras.to_opencv(F.col("m"), F.col("p")).alias("p"))
    r = d.select("p", cameras.csv(F.col("p")).alias("csv"), cameras.camera_matrix(F.col("p")).alias("k"), cameras.pretty(F.col("p")[4]).alias("t"), cameras.distortion(F.col("p")).alias("d")).first()
    assert list(r.p) == [500.0, 500.0, 1.0, 2.0, 0.05, 0.05, 0.0, 0.0]
    assert r.csv == "500.0,500.0,1.0,2.0,0.05,0.05,0.0,0.0" and [list(x) for x in r.k] == [[500, 0, 1], [0, 500, 2], [0, 0, 1]]
    assert r.t == "5.00e-02" and r.d[0] == pytest.approx(0.05)


def test_tasks(spark, tmp_path):
    reg, calls = tasks.Registry(), []

    @reg.task("Numbers", n=3)
    def numbers(spark, inputs, n):
        calls.append("Numbers")
        return spark.range(n)

    @reg.task("Doubled", ("Numbers",))
    def doubled(spark, inputs):
        calls.append("Doubled")
        return inputs["Numbers"].select((F.col("id") * 2).alias("id"))

    config = tasks.read_config('[Numbers]\nn = 5\nquery = \'{"channel": "rgb"}\'\n[StructureFromMotion]\nintrinsic_calibration_scan_id = "c1"\nextrinsic_calibration_scan_id = ""\n')
    assert config["Numbers"]["query"] == {"channel": "rgb"} and tasks.calibration_scans(config) == ["c1"]
    store = f"file://{tmp_path}"
    assert reg.run(spark, "Doubled", config, store).count() == 5
    assert reg.run(spark, "Doubled", config, store).count() == 5
    assert calls == ["Numbers", "Doubled"]
    assert tasks.differing({"a": 1, "b": 2}, {"a": 1, "c": 3}) == ["b", "c"]


def test_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").repartition(3)
    e.write.parquet(str(tmp_path / "in"))
    q = watch.watch(watch.event_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "c"), str(tmp_path / "out"), "event_id", lambda b: b.groupBy("event_type").count())
    q.awaitTermination(120)
    total = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0]
    assert total == e.count()
    w = watch.windowed_counts(watch.event_stream(spark, str(tmp_path / "in")))
    assert w.isStreaming and w.columns == ["start", "event_type", "n", "mean"]
