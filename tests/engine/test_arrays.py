"""NumPy archives: round trips, foreign and broken files."""

from __future__ import annotations

import numpy as np
import pytest

from sheetloom.schemas import KEYPOINT
from sheetloom.sources import arrays


def test_keypoints_round_trip_and_archives_load_with_numpy(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(m, d, k, *map(float, rng.normal(size=5).astype(np.float32)), k % 3, -1, rng.normal(size=8).astype(np.float32).tolist()) for m, d, n in (("44", "sift", 40), ("a b_é", "sift", 1), ("44", "surf", 3)) for k in range(n)]
    df = spark.createDataFrame(rows + [(None, "sift", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, 0, [1.0]), ("9", "sift", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, 0, None)], KEYPOINT).repartition(3)
    folder = tmp_path / "keypoints"
    for _ in range(2):  # written again, the same files
        made = arrays.write_keypoints_npz(df, str(folder)).collect()
        assert {(r.file, r.n) for r in made} == {("map_44_sift_descriptors.npz", 40), ("map_a b_é_sift_descriptors.npz", 1), ("map_44_surf_descriptors.npz", 3)}
        assert len(list(folder.iterdir())) == 3
    assert sorted(map(tuple, arrays.keypoints_npz(spark, str(folder)).collect())) == sorted(rows)
    with np.load(folder / "map_44_sift_descriptors.npz") as a:
        assert a["keypoints"].shape == (40, 7) and a["keypoints"].dtype == a["descriptors"].dtype == np.float32 and a["descriptors"].shape == (40, 8)


def test_foreign_and_broken_files(spark, tmp_path):
    np.savez(tmp_path / "map_1_sift_descriptors.npz", keypoints=np.ones((2, 7)), descriptors=np.ones((3, 4)))
    np.savez(tmp_path / "map_2_sift_descriptors.npz", keypoints=np.ones((2, 7)), descriptors=np.ones((2, 4)), more=np.arange(3))
    np.savez(tmp_path / "map_3_sift_descriptors.npz", keypoints=np.zeros((0, 7)), descriptors=np.zeros((0, 4)))
    np.savez(tmp_path / "map_4_sift_descriptors.npz", keypoints=np.array([{"a": 1}], object), descriptors=np.ones((1, 1)))
    (tmp_path / "map_5_sift_descriptors.npz").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "map_6_sift_descriptors.npz").write_bytes(b"")
    np.savez(tmp_path / "other.npz", keypoints=np.ones((2, 7)), descriptors=np.ones((2, 4)))
    assert [(r.map_num, r.kp_id) for r in arrays.keypoints_npz(spark, str(tmp_path)).orderBy("kp_id").collect()] == [("2", 0), ("2", 1)]
    np.save(tmp_path / "h.npy", np.arange(9, dtype=np.int16).reshape(3, 3))
    np.save(tmp_path / "t.npy", np.array(["text"]))
    np.save(tmp_path / "s.npy", np.float32(2.5))
    got = {(r.file.rsplit("/", 1)[1], r.name, r.row): (r.shape, r.kind, r["values"]) for r in arrays.arrays(spark, str(tmp_path)).collect()}
    assert got["h.npy", "array", 2] == ([3, 3], "int16", [6.0, 7.0, 8.0]) and got["s.npy", "array", 0] == ([], "float32", [2.5])
    assert got["map_2_sift_descriptors.npz", "more", 1] == ([3], "int64", [1.0]) and not any(k[0] == "t.npy" for k in got)
    assert got["map_1_sift_descriptors.npz", "keypoints", 1][2] == pytest.approx([1.0] * 7)
