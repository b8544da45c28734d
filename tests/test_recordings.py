import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.sources import files, recordings

POINTS = "seq_id string, frame int, joint int, x double, y double, z double"


def stack(df, shape, cols="xyz"):
    out = np.full((*shape, len(cols)), np.nan)
    for r in df.collect():
        out[r.frame, r.joint] = [np.nan if r[c] is None else r[c] for c in cols]
    return out


def test_a_hundred_recordings_round_trip(spark, tmp_path):
    rnd = np.random.RandomState(1)
    arrays = {f"take {k}/ä%" if k % 10 == 3 else f"take-{k}": rnd.randn(rnd.randint(1, 12), 3, 3) for k in range(100)}
    for a in arrays.values():
        a[rnd.rand(*a.shape[:2]) < 0.1] = np.nan
        a[-1, 0] = 1.0
    rows = [(s, f, j, *[None if np.isnan(v) else float(v) for v in a[f, j]]) for s, a in arrays.items() for f in range(len(a)) for j in range(3)]
    points = spark.createDataFrame(rows, POINTS).repartition(7)
    recordings.write_recordings(points, str(tmp_path / "out"), 3)
    written = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(written) == 100 and all(n.endswith(".npy") for n in written)
    assert np.load(tmp_path / "out" / "take-0.npy") == pytest.approx(arrays["take-0"], nan_ok=True)
    back = recordings.read_recordings(spark, str(tmp_path / "out"), slab=5)
    value = lambda r: (r.seq_id, r.frame, r.joint, r.x, r.y, r.z)
    assert sorted(map(value, back.collect()), key=repr) == sorted(rows, key=repr)
    some = back.where("seq_id in ('take-5', 'take-8') and frame >= 2 and frame < 4")
    assert sorted(map(value, some.collect()), key=repr) == sorted((r for r in rows if r[0] in ("take-5", "take-8") and 2 <= r[1] < 4), key=repr)
    assert back.where("seq_id = 'none'").count() == 0
    recordings.write_recordings(points.where("seq_id = 'take-1'"), str(tmp_path / "out"), 3, overwrite=False)
    assert len(list((tmp_path / "out").iterdir())) == 100
    recordings.write_recordings(points.where("seq_id = 'take-1'"), str(tmp_path / "out"), 3)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["take-1.npy"]


def test_pushed_filters_leave_out_files_and_slabs(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    for name, n in (("a", 20), ("b", 20), ("c", 3)):
        np.save(tmp_path / f"{name}.npy", np.zeros((n, 2, 3)))
    reader = recordings.RecordingsReader({"path": f"file://{tmp_path}", "slab": "5"})
    assert len(reader.partitions()) == 9
    given = [In(("seq_id",), ("a", "c")), GreaterThan(("frame",), 6), LessThanOrEqual(("frame",), 12)]
    assert list(reader.pushFilters(given)) == given  # Spark still filters rows
    assert [(p.seq_id, p.start, p.end) for p in reader.partitions()] == [("a", 5, 10), ("a", 10, 13)]
    list(reader.pushFilters([EqualTo(("seq_id",), "b")]))
    assert [p.file for p in reader.partitions()] == [""]


def test_frames_left_out_and_failed_writes(spark, tmp_path):
    recordings.write_recordings(spark.createDataFrame([("a", 3, 1, 1.0, 2.0, 3.0), ("a", 5, 0, None, 2.0, 3.0)], POINTS), str(tmp_path / "o"), 2)
    a = np.load(tmp_path / "o" / "a.npy")
    assert a.shape == (6, 2, 3) and a[3, 1].tolist() == [1, 2, 3] and np.isnan(a[:3]).all() and np.isnan(a[4]).all() and np.isnan(a[5, 0, 0])
    with pytest.raises(Exception, match="index 9"):  # a joint that the layout lacks
        recordings.write_recordings(spark.createDataFrame([("a", 0, 9, 1.0, 2.0, 3.0)], POINTS), str(tmp_path / "o"), 2)
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["a.npy"]


def test_outputs_of_recordings(spark, tmp_path):
    rnd = np.random.RandomState(2)
    two, three, err = rnd.rand(2, 4, 3, 2), rnd.rand(4, 3, 3), rnd.rand(4, 3)
    three[1, 2] = np.nan
    for name in ("one", "other"):
        (tmp_path / name / "output_data").mkdir(parents=True)
    np.save(tmp_path / "one" / "output_data" / recordings.FILES["2d"], two)
    np.save(tmp_path / "one" / recordings.FILES["2d"], two * 9)  # the output folder's counts
    np.save(tmp_path / "one" / "output_data" / recordings.FILES["3d"], three)
    np.save(tmp_path / "one" / "output_data" / recordings.FILES["reprojection"], err)
    np.save(tmp_path / "other" / recordings.FILES["2d"], two[:1])
    np.save(tmp_path / "other" / recordings.FILES["3d"], three)  # not in its place
    (tmp_path / "other" / "output_data" / recordings.FILES["reprojection"]).write_bytes(b"no array")
    found = {(r.recording.rsplit("/", 1)[1], r.kind): r.path for r in recordings.find_outputs(spark, str(tmp_path)).collect()}
    assert found.keys() == {("one", "2d"), ("one", "3d"), ("one", "reprojection"), ("other", "2d"), ("other", "reprojection")}
    assert "output_data" in found["one", "2d"]
    read = lambda kind, name: recordings.read_outputs(spark, str(tmp_path), kind).where(F.col("recording").endswith("/" + name))
    assert stack(read("3d", "one"), (4, 3)) == pytest.approx(three, nan_ok=True)
    assert stack(read("reprojection", "one"), (4, 3), ["err"])[..., 0] == pytest.approx(err)
    assert stack(read("2d", "one").where("cam = 1"), (4, 3), "uv") == pytest.approx(two[1])
    assert read("2d", "other").agg(F.max("cam")).first()[0] == 0
    assert read("3d", "other").count() == 0 and read("reprojection", "other").count() == 0


def test_calibrations_are_probed_in_order(spark, tmp_path):
    k, p = np.diag([500.0, 501, 1]), np.arange(24.0).reshape(2, 3, 4)

    def cams(folder):
        return [tuple(r) for r in recordings.find_calibration(spark, str(folder)).orderBy("cam").collect()]

    (tmp_path / "sub" / "calibration").mkdir(parents=True)
    assert cams(tmp_path / "sub") == []
    (tmp_path / "sub" / "calibration" / "calibration.json").write_text(json.dumps({"camera_matrices": [k.tolist()], "image_sizes": [[480, 640]], "camera_names": ["left"]}))
    assert cams(tmp_path / "sub") == [(0, "left", k.ravel().tolist(), None, 640, 480)]
    (tmp_path / "sub" / "camera_calibration.json").write_text(json.dumps({"cameras": {"a": {"projection_matrix": p[0].tolist()}, "b": {"camera_matrix": k.tolist(), "image_size": [1, 2]}}}))
    assert cams(tmp_path / "sub") == [(0, "a", None, p[0].ravel().tolist(), None, None), (1, "b", k.ravel().tolist(), None, 2, 1)]
    np.save(tmp_path / "sub" / "calibration_data.npy", p)
    np.save(tmp_path / "sub" / "camera_matrices.npy", k)
    assert cams(tmp_path / "sub") == [(0, "camera_0", k.ravel().tolist(), p[0].ravel().tolist(), None, None), (1, "camera_1", None, p[1].ravel().tolist(), None, None)]
    (tmp_path / "sub" / "camera_calibration.toml").write_text(f"[cameras.x]\ncamera_matrix={k.tolist()}\nimage_size=[10, 20]\n")
    assert cams(tmp_path / "sub") == [(0, "x", k.ravel().tolist(), None, 20, 10)]


def test_world_calibration_markers_and_reports(spark, tmp_path):
    r, t = np.linalg.qr(np.random.RandomState(3).randn(3, 3))[0], np.array([1.0, 2, 3])
    k = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]])
    tw = np.vstack([np.column_stack([r, t]), [0, 0, 0, 1]])
    (tmp_path / "c.json").write_text(json.dumps({"cameras": {"b": {"Tw": tw.tolist(), "K": k.tolist(), "dist_coeffs": [0.1, 0, 0, 0, 0]}, "a": {"Tw": np.eye(4).tolist(), "K": k.tolist(), "dist_coeffs": []}}}))
    a, b = recordings.read_world_calibration(spark, str(tmp_path / "c.json")).orderBy("cam").collect()
    assert (a.name, b.name, b.dist) == ("a", "b", [0.1, 0, 0, 0, 0]) and b.p == pytest.approx((k @ tw[:3]).ravel()) and a.p == pytest.approx((k @ np.eye(4)[:3]).ravel())
    assert sorted(map(tuple, recordings.read_actor_markers(spark, "marker_size_mm: 5\nactors:\n  anna: 7\n  ben: 9\n").collect())) == [("anna", 7), ("ben", 9)]
    assert sorted(map(tuple, recordings.read_actor_markers(spark, None).collect())) == [("actor_0", 0), ("actor_1", 1)]
    recordings.write_report(spark.sql("select 1 as n, interval 2 days as i, array(1.5D) as a"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().asDict()["a"] == [1.5]
    recordings.write_coverage_csv(spark.createDataFrame([(0.0, 1.0, 2), (0.5, 1.0, 3), (0.5, 0.0, 1)], "x double, z double, n_cams long"), str(tmp_path / "h"))
    lines = next((tmp_path / "h").glob("*.csv")).read_text().splitlines()
    assert lines == ["z,0.0,0.5", "0.0,0,1", "1.0,2,3"]


@pytest.mark.parametrize("n", [3, 17, 20, 200])
def test_detector_output_as_133_points(spark, n):
    kpts, scores = [[float(k), float(k) + 0.5] for k in range(n)], [k / 1000 for k in range(n)]
    got = {r.joint: (r.x, r.y, r.score) for r in recordings.to_133(spark.createDataFrame([(5, kpts, scores)], "frame int, kpts array<array<double>>, scores array<double>")).collect()}
    want = {j: (None, None, 0.0) for j in range(133)}
    for k in range(n):
        j = k if k < 17 else k + 8
        if j < 133:
            want[j] = (k, k + 0.5, k / 1000)
    assert got == want


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_of_every_width(width):
    wanted = np.array([0, 5, -7, 100, -100, 3])
    raw = b"".join((int(v) + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for v in wanted)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, width, 8000, 0, "NONE", "NONE"))
        w.writeframes(raw)
    rate, x = files.pcm(out.getvalue())
    assert rate == 8000 and x == pytest.approx(wanted / 100)
