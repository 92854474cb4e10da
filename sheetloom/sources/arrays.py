"""NumPy archives as tables: ``.npz`` and ``.npy`` files read by whole arrays, and written one file a sheet."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYPOINT
from ..shared import open_fs

#: Columns of the ``keypoints`` array, in order.
FIELDS = ("x", "y", "size", "angle", "response", "octave", "class_id")
COLUMNS = [c.split()[0] for c in KEYPOINT.split(", ")]
NAME = r"map_(.+)_([a-z0-9]+)_descriptors\.npz$"


def load(data: bytes) -> dict[str, np.ndarray] | None:
    """The arrays of an archive, or of one file under the name ``array``; None if it is neither, is broken or holds objects."""
    try:
        found = np.load(io.BytesIO(data), allow_pickle=False)
        return {k: found[k] for k in found.files} if hasattr(found, "files") else {"array": found}
    except Exception:  # numpy, zip and zlib raise errors of their own kinds
        return None


def keypoints_npz(spark: SparkSession, path: str) -> DataFrame:
    """Keypoints of archives named ``map_<sheet>_<detector>_descriptors.npz``, which hold ``keypoints`` (n x 7) and ``descriptors`` (n x d); kp_id counts from 0.

    Files that do not load, or whose two arrays don't fit, have no rows; further arrays are left aside.
    """

    def rows(batches):
        for b in batches:
            for sheet, detector, content in zip(b["map_num"], b["detector"], b["content"], strict=True):
                a = load(content)
                k, d = (a.get("keypoints"), a.get("descriptors")) if a else (None, None)
                if k is None or d is None or k.ndim != 2 or d.ndim != 2 or k.shape[1] != len(FIELDS) or len(k) != len(d) or not len(k):
                    continue
                out = pd.DataFrame(k.astype(np.float32), columns=list(FIELDS)).astype({"octave": "int32", "class_id": "int32"})
                yield out.assign(map_num=sheet, detector=detector, kp_id=np.arange(len(k), dtype=np.int32), descriptor=list(d.astype(np.float32)))[COLUMNS]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(F.regexp_extract(name, NAME, 1).alias("map_num"), F.regexp_extract(name, NAME, 2).alias("detector"), "content").where("map_num <> ''")
    return named.mapInPandas(rows, KEYPOINT)


def write_keypoints_npz(keypoints: DataFrame, path: str) -> DataFrame:
    """One archive for each sheet and detector in the folder ``path``, in order of kp_id: map_num, detector, file, n. A sheet without keypoints has no file.

    A file appears whole under its own name, by renaming, so a repeated task replaces it by the same one. A task holds one sheet's keypoints. Rows without a
    sheet, detector or descriptor are left out; descriptors of a sheet have one length.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("kp_id", kind="stable")
        sheet, detector = pdf["map_num"].iloc[0], pdf["detector"].iloc[0]
        out = io.BytesIO()
        np.savez_compressed(out, keypoints=pdf[list(FIELDS)].to_numpy(np.float32), descriptors=np.stack(pdf["descriptor"].tolist()).astype(np.float32))
        fs, at = open_fs(path)
        name = f"map_{sheet}_{detector.lower()}_descriptors.npz"
        beside = f"{at}/.{name}.{uuid.uuid4().hex}"
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(beside) as f:
            f.write(out.getvalue())
        fs.move(beside, f"{at}/{name}")
        return pd.DataFrame({"map_num": [sheet], "detector": [detector], "file": [name], "n": [len(pdf)]})

    known = keypoints.select(*COLUMNS).where("map_num is not null and detector is not null and descriptor is not null")
    return known.groupBy("map_num", "detector").applyInPandas(write, "map_num string, detector string, file string, n long")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """Every array of ``.npy`` and ``.npz`` files: file, name, shape, kind and its values in order as doubles, by rows of the first axis (row, values).

    Arrays of no axis have one row; arrays of text, of complex numbers or of objects, and files that do not load, have none.
    """

    def rows(batches):
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                for name, a in (load(content) or {}).items():
                    if a.dtype.kind not in "biuf" or a.ndim and not len(a):
                        continue
                    flat = a.reshape(len(a), int(np.prod(a.shape[1:]))) if a.ndim else a.reshape(1, 1)
                    kind = a.dtype.name
                    yield pd.DataFrame({"file": file, "name": name, "shape": [list(a.shape)] * len(flat), "kind": kind, "row": np.arange(len(flat)), "values": list(flat.astype(float))}, columns=["file", "name", "shape", "kind", "row", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(rows, "file string, name string, shape array<long>, kind string, row long, values array<double>")
