"""Whole folders of recordings: finding and reading their arrays on any file system, writing an array for each sequence.

Reading goes through Spark's own file source (one file a row), so any store that Spark reads will do. Writing is a data
source whose tasks each write the sequences they hold, frame by frame; it needs a folder that all executors share.
"""

from __future__ import annotations

import contextlib
import glob
import io
import json
import os
import posixpath
import re
import shutil
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# The folder of a recording's outputs and the names of its arrays.
OUTPUTS = "output_data"
FILES = {
    "2d": "2dData_numCams_numFrames_numTrackedPoints_pixelXY.npy",
    "3d": "3dData_numFrames_numTrackedPoints_spatialXYZ.npy",
    "reprojection": "3dData_numFrames_numTrackedPoints_reprojectionError.npy",
}
#: What the arrays' axes are, and the columns that their last one (if any) becomes.
AXES = {"2d": (["cam", "frame", "joint"], ["u", "v"]), "3d": (["frame", "joint"], ["x", "y", "z"]), "reprojection": (["frame", "joint"], ["err"])}
#: Values handed to Spark at a time.
SLAB = 1 << 18


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def find_outputs(spark: SparkSession, root: str) -> DataFrame:
    """(recording, kind, path, bytes) of the arrays under ``root``: those in a recording's output folder, and 2-D data beside it.

    Where a recording has 2-D data in both places, the output folder's counts. File contents are not read.
    """
    kind = F.create_map(*[F.lit(x) for k, name in FILES.items() for x in (name, k)])
    found = _files(spark, root, "{" + ",".join(FILES.values()) + "}").select("path", F.col("length").alias("bytes"))
    found = found.withColumn("kind", kind[F.element_at(F.split("path", "/"), -1)]).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    inside = F.col("folder").endswith("/" + OUTPUTS)
    found = found.where(inside | (F.col("kind") == "2d")).withColumns({"recording": F.when(inside, F.regexp_replace("folder", f"/{OUTPUTS}$", "")).otherwise(F.col("folder")), "beside": ~inside})
    return found.groupBy("recording", "kind").agg(F.min_by(F.struct("path", "bytes"), F.struct("beside", "path")).alias("f")).select("recording", "kind", "f.path", "f.bytes")


def _rows(array: np.ndarray, axes: list[str], values: list[str]):
    """Columns of an array, some frames at a time; NaN becomes null."""
    shape = array.shape[: len(axes)]
    step = max(1, SLAB // max(1, int(np.prod(shape[1:]))))
    for a in range(0, shape[0], step):
        part = np.asarray(array[a : a + step], float).reshape(-1, len(values))
        at = np.unravel_index(np.arange(len(part)), (min(step, shape[0] - a), *shape[1:]))
        cols = [pa.array((i + (a if k == 0 else 0)).astype(np.int32)) for k, i in enumerate(at)]
        yield cols + [pa.array(np.nan_to_num(part[:, d]), mask=np.isnan(part[:, d])) for d in range(len(values))]


def read_outputs(spark: SparkSession, root: str, kind: str = "3d") -> DataFrame:
    """The arrays of one kind under ``root``: (recording, [cam,] frame, joint, and u, v or x, y, z or err).

    A recording without the array has no rows, nor has one whose file can't be read as such an array. A task reads whole files.
    """
    axes, values = AXES[kind]
    # Keyed by the file, so that its content stays with the scan.
    chosen = find_outputs(spark, root).where(F.col("kind") == kind).select("recording", "path")
    content = _files(spark, root, FILES[kind]).select("path", "content").join(chosen, "path")
    schema = "recording string, " + ", ".join(f"{a} int" for a in axes) + ", " + ", ".join(f"{v} double" for v in values)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("recording"), b.column("content"), strict=True):
                try:
                    array = np.load(io.BytesIO(data.as_py()), allow_pickle=False)
                except (ValueError, EOFError, OSError):
                    continue
                if array.ndim != len(axes) + (len(values) > 1) or (len(values) > 1 and array.shape[-1] < len(values)):
                    continue
                array = array[..., : len(values)] if len(values) > 1 else array
                for cols in _rows(array, axes, values):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(cols[0]), pa.string()), *cols], ["recording", *axes, *values])

    return content.select("recording", "content").mapInArrow(run, schema)


# ---- an array for each sequence ----


class RecordingsDataSource(DataSource):
    """``format("recordings")``: a folder with a (frames, joints, 3) array for each sequence, named by it.

    Rows are (seq_id string, frame int, joint int, x, y, z double). Options: path, joints (for writing), slab (frames of a
    read partition). Filters on seq_id and frame leave out files and slabs before any is read, where Spark hands them on
    (``spark.sql.python.filterPushdown.enabled``). The folder must be open to all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return "seq_id string, frame int, joint int, x double, y double, z double"

    def reader(self, schema) -> DataSourceReader:
        return RecordingsReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecordingsWriter(self.options, overwrite)


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _safe(seq_id: str) -> str:
    """A file name for a sequence: other than plain characters as %xx."""
    return re.sub(r"[^A-Za-z0-9_-]", lambda m: "".join(f"%{b:02x}" for b in m[0].encode()), seq_id)


def _named(file: str) -> str:
    return re.sub(r"((%[0-9a-f]{2})+)", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), os.path.basename(file).removesuffix(".npy"))


@dataclass
class Part(InputPartition):
    file: str
    seq_id: str
    start: int
    end: int


class RecordingsReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.slab = _local(options["path"]), int(options.get("slab", 4096))
        self.only: set[str] | None = None
        self.low, self.high = 0, 2**31

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column == "seq_id" and isinstance(f, (EqualTo, In)):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = given if self.only is None else self.only & given
            elif column == "frame" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, int(f.value) + (not isinstance(f, LessThan)))
            yield f  # whole frames and files only are left out here; Spark filters the rows

    def partitions(self):
        out = []
        for file in sorted(glob.glob(os.path.join(glob.escape(self.root), "*.npy"))):
            if self.only is None or _named(file) in self.only:
                n = np.load(file, mmap_mode="r").shape[0]
                out += [Part(file, _named(file), a, min(a + self.slab, n, self.high)) for a in range(0, n, self.slab) if a < self.high and a + self.slab > self.low]
        return out or [Part("", "", 0, 0)]

    def read(self, part: Part):
        if not part.file:
            return
        array = np.load(part.file, mmap_mode="r")[part.start : part.end]
        for cols in _rows(array, ["frame", "joint"], ["x", "y", "z"]):
            cols[0] = pa.array(cols[0].to_numpy() + np.int32(part.start))
            yield pa.RecordBatch.from_arrays([pa.array([part.seq_id] * len(cols[0]), pa.string()), *cols], ["seq_id", "frame", "joint", "x", "y", "z"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


#: Bytes kept for an array's header, which is written last, when the number of frames is known.
HEADER = 128


class _Growing:
    """An array file that grows by frames in order; frames that are left out are missing."""

    def __init__(self, path: str, joints: int):
        self.path, self.joints, self.frames = path, joints, 0
        self.file = open(path, "wb")  # noqa: SIM115
        self.file.write(b" " * HEADER)
        self.row = np.full((joints, 3), np.nan)
        self.at: int | None = None

    def add(self, frame: np.ndarray, joint: np.ndarray, xyz: np.ndarray) -> None:
        for f in np.unique(frame):
            if f != self.at:
                self._next(int(f))
            own = frame == f
            self.row[joint[own]] = xyz[own]

    def _next(self, f: int | None) -> None:
        if self.at is not None:
            self.file.write(self.row.tobytes())
            self.frames += 1
        self.row[:] = np.nan
        if f is not None:
            while self.frames < f:
                self.file.write(self.row.tobytes())
                self.frames += 1
        self.at = f

    def close(self) -> None:
        self._next(None)
        head = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({self.frames}, {self.joints}, 3), }}"
        self.file.seek(0)
        self.file.write(b"\x93NUMPY\x01\x00" + (HEADER - 10).to_bytes(2, "little") + head.ljust(HEADER - 11).encode("latin1") + b"\n")
        self.file.close()


class RecordingsWriter(DataSourceArrowWriter):
    """Tasks write to a folder of their own; the commit moves the files of the tasks that count to their place."""

    def __init__(self, options, overwrite: bool):
        self.root, self.joints, self.overwrite = _local(options["path"]), int(options["joints"]), overwrite
        self.work = os.path.join(self.root, f"_work-{uuid.uuid4().hex}")

    def write(self, iterator) -> Written:
        own = os.path.join(self.work, uuid.uuid4().hex)
        os.makedirs(own)
        done, now, name = [], None, None
        for b in iterator:
            seq = b.column(b.schema.get_field_index("seq_id")).to_numpy(zero_copy_only=False).astype(object)
            frame, joint = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("frame", "joint"))
            xyz = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "xyz"], 1).astype(float)
            cuts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else []
            for a, e in zip(cuts, [*cuts[1:], len(seq)], strict=True):
                if seq[a] != name:
                    if now:
                        now.close()
                    name = seq[a]
                    if any(os.path.basename(f) == _safe(str(name)) + ".npy" for f in done):
                        raise ValueError(f"rows of sequence {name} do not lie together")
                    done.append(os.path.join(own, _safe(str(name)) + ".npy"))
                    now = _Growing(done[-1], self.joints)
                now.add(frame[a:e], joint[a:e], xyz[a:e])
        if now:
            now.close()
        return Written(done)

    def commit(self, messages) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [os.path.basename(f) for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a sequence came in several partitions")
        os.makedirs(self.root, exist_ok=True)
        if self.overwrite:
            for old in glob.glob(os.path.join(glob.escape(self.root), "*.npy")):
                os.remove(old)
        for f in files:
            os.replace(f, os.path.join(self.root, os.path.basename(f)))
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


def write_recordings(points: DataFrame, path: str, joints: int, overwrite: bool = True) -> None:
    """An array for each sequence of points (seq_id, frame, joint, x, y, z) under ``path``. Each is written by one task as its
    frames come, sorted by Spark; none passes through the driver."""
    spark = points.sparkSession
    spark.dataSource.register(RecordingsDataSource)
    rows = points.select(F.col("seq_id").cast("string").alias("seq_id"), "frame", "joint", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    rows.repartition("seq_id").sortWithinPartitions("seq_id", "frame", "joint").write.format("recordings").option("joints", joints).mode("overwrite" if overwrite else "append").save(path)


def read_recordings(spark: SparkSession, path: str, slab: int = 4096) -> DataFrame:
    """The points of all arrays that ``write_recordings`` wrote under ``path``."""
    spark.dataSource.register(RecordingsDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("recordings").option("slab", slab).load(path)


# ---- calibrations, markers, reports ----

CAMERA = "cam int, name string, k array<double>, p array<double>, width int, height int"


def _calibration(files: dict[str, bytes]) -> list[tuple] | None:
    """The first calibration that a folder's files (name to content) give: TOML, then arrays, then JSON. Pickles are not read."""
    import tomllib

    def of_cameras(cams: dict):
        flat = lambda c, key: np.array(c[key], float).ravel().tolist() if key in c else None
        size = lambda c: (c.get("image_size") or [None, None])[:2]
        rows = [(i, name, flat(c, "camera_matrix"), flat(c, "projection_matrix"), size(c)[1], size(c)[0]) for i, (name, c) in enumerate(cams.items())]
        return rows if any(r[2] or r[3] for r in rows) else None

    with contextlib.suppress(KeyError, ValueError, AttributeError):
        found = of_cameras(tomllib.loads(files["camera_calibration.toml"].decode())["cameras"])
        if found:
            return found
    k = p = None
    for name in ("calibration_data.npy", "camera_intrinsics.npy", "camera_matrices.npy", "projection_matrices.npy"):
        with contextlib.suppress(KeyError, ValueError):
            a = np.load(io.BytesIO(files[name]), allow_pickle=False).astype(float)
            a = a if a.ndim == 3 else a[None]
            if a.shape[1:] == (3, 4) and name in ("projection_matrices.npy", "calibration_data.npy"):
                p = a
            elif a.shape[1:] == (3, 3) and name != "projection_matrices.npy":
                k = a
    if k is not None or p is not None:
        n = max(len(x) for x in (k, p) if x is not None)
        at = lambda a, i: a[i].ravel().tolist() if a is not None and i < len(a) else None
        return [(i, f"camera_{i}", at(k, i), at(p, i), None, None) for i in range(n)]
    for name in ("camera_calibration.json", "calibration.json"):
        with contextlib.suppress(KeyError, ValueError, AttributeError):
            data = json.loads(files[name])
            if isinstance(data.get("cameras"), dict) and data["cameras"]:
                found = of_cameras(data["cameras"])
            else:
                names = data.get("camera_names") or [f"camera_{i}" for i in range(len(data["camera_matrices"]))]
                lists = {"camera_matrix": data["camera_matrices"], "projection_matrix": data.get("projection_matrices", []), "image_size": data.get("image_sizes", [])}
                found = of_cameras({n: {key: v[i] for key, v in lists.items() if i < len(v)} for i, n in enumerate(names)})
            if found:
                return found
    return None


def find_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """(cam, name, k, p, width, height) of the calibration that a recording's folder holds, in itself or else in its calibration
    folders; empty where there is none. Image sizes are (height, width). The files are a few small ones of known names.
    """
    names = ["camera_calibration.toml", "calibration_data.npy", "camera_intrinsics.npy", "camera_matrices.npy", "projection_matrices.npy", "camera_calibration.json", "calibration.json"]
    by_folder: dict[str, dict[str, bytes]] = {}
    for r in _files(spark, folder, "{" + ",".join(names) + "}").where(F.col("length") < 10_000_000).select("path", "content").collect():
        at, name = posixpath.split(re.sub("^[a-z]+:/*", "/", r.path))
        by_folder.setdefault(at, {})[name] = bytes(r.content)
    root = re.sub("^[a-z]+:/*", "/", folder).rstrip("/")

    def probe(at: str, depth: int = 0) -> list[tuple] | None:
        found = _calibration(by_folder.get(at, {}))
        for sub in ("calibration", "calibration_data", "camera_calibration") if found is None and depth < 8 else ():
            found = found or probe(f"{at}/{sub}", depth + 1)
        return found

    return spark.createDataFrame(probe(root) or [], CAMERA)


def read_world_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(cam, name, k, rt, p, dist) of JSON {cameras: {name: {Tw 4x4, K 3x3, dist_coeffs}}}, cameras in order of their names."""
    schema = "cameras map<string, struct<Tw array<array<double>>, K array<array<double>>, dist_coeffs array<double>>>"
    cams = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("cameras").alias("name", "c"))
    k, rt = F.flatten("c.K"), F.flatten(F.slice("c.Tw", 1, 3))
    product = F.array(*[sum(F.get(F.col("k"), F.lit(3 * r + i)) * F.get(F.col("rt"), F.lit(4 * i + c)) for i in range(3)) for r in range(3) for c in range(4)])
    named = cams.select("name", k.alias("k"), rt.alias("rt"), F.col("c.dist_coeffs").alias("dist")).withColumn("p", product)
    order = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode(F.array_sort(F.map_keys("cameras"))).alias("cam", "name"))  # cameras are a handful
    return named.join(F.broadcast(order), "name").select("cam", "name", "k", "rt", "p", "dist")


def read_actor_markers(spark: SparkSession, text: str | None) -> DataFrame:
    """(actor, marker) of a YAML text with a mapping ``actors``; without a text two actors with markers 0 and 1."""
    import yaml

    config = yaml.safe_load(text) if text else {"actors": {"actor_0": 0, "actor_1": 1}}
    return spark.createDataFrame([(str(a), int(m)) for a, m in ((config or {}).get("actors") or {}).items()], "actor string, marker int")


def write_report(report: DataFrame, path: str) -> None:
    """Rows of a report as JSON lines; what JSON has no type for is written as text."""
    plain = ("string", "boolean", "double", "float", "int", "bigint", "smallint", "tinyint", "date", "timestamp")
    kept = [F.col(f"`{c}`") if t in plain or t.startswith(("array", "struct", "map", "decimal")) else F.col(f"`{c}`").cast("string").alias(c) for c, t in report.dtypes]
    report.select(*kept).write.mode("overwrite").json(path)


def write_coverage_csv(heatmap: DataFrame, path: str) -> None:
    """A coverage heat map (x, z, n_cams) as a table with a row for each z and a column for each x; cells without a camera are 0."""
    xs = [r.x for r in heatmap.select("x").distinct().orderBy("x").collect()]  # as many as a row has columns
    wide = heatmap.groupBy("z").pivot("x", xs).agg(F.max("n_cams")).fillna(0)
    wide.orderBy("z").coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_133(detections: DataFrame) -> DataFrame:
    """Detections (keys, kpts array of (x, y), scores) as points (keys, joint, x, y, score) of the 133-point layout.

    The first 17 keep their place, further ones follow from 25 on, what does not fit is left out; points that the detector
    lacks are missing with score 0.
    """
    keys = [c for c in detections.columns if c not in ("kpts", "scores")]
    n = F.least(F.size("kpts"), F.size("scores"))
    place = F.when(F.col("joint") < 17, F.col("joint")).when(F.col("joint") >= 25, F.col("joint") - 8)
    spread = detections.withColumn("joint", F.explode(F.sequence(F.lit(0), F.lit(132)))).withColumns({"__n": n, "__at": place})
    there = F.col("__at") < F.col("__n")
    xy = lambda d: F.when(there & (F.size(F.get("kpts", F.col("__at"))) >= 2), F.get(F.get("kpts", F.col("__at")), F.lit(d))).cast("double")
    return spread.select(*keys, "joint", xy(0).alias("x"), xy(1).alias("y"), F.when(there, F.get("scores", F.col("__at"))).otherwise(0.0).cast("double").alias("score"))
