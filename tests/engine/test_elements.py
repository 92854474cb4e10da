"""One JSON document in byte ranges of any size against json.loads."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.sources import elements, readers


def awkward(rng):
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "中", "a", "\n", " "]) for _ in range(rng.randrange(9)))
    kinds = [lambda: text(), lambda: rng.randrange(10**6), lambda: None, lambda: [text(), [1, {}]], lambda: {text(): {"x": [text()]}, "\\": []}]
    return rng.choice(kinds)()


def plain(df):
    return [(r.key, json.loads(r.value)) for r in df.orderBy("at").collect()]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_items_entries_and_lists_under_a_key(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    items = [awkward(rng) for _ in range(25)]
    entries = {f"k\"{k}\\": awkward(rng) for k in range(25)}
    docs = {
        "list": (items, None), "object": (entries, None), "within": ({"first": {"annotations": [9]}, "annotations": items, "tail,]": "]", "last": [[1]]}, "annotations"),
        "missing": ({"a": 1}, "annotations"), "not a list": ({"annotations": {"a": 1}}, "annotations"), "empty list": ({"annotations": []}, "annotations"), "empty": ({}, None),
    }
    for name, (doc, key) in docs.items() if chunk != 7 else list(docs.items())[:3]:
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])), encoding="utf-8")
        df = elements.elements(spark, str(path), key, chunk)
        want = [(k, v) for k, v in doc.items()] if key is None and isinstance(doc, dict) else [(None, v) for v in (doc if key is None else doc.get(key, []) if isinstance(doc.get(key, []), list) else [])]
        assert plain(df) == want, name
    assert elements.elements(spark, str(path), None, chunk).count() == len(doc)


def test_scan_carries_strings_and_escapes_across_ranges():
    data = json.dumps({"a\\\\": ['\\"{', "\\"], "b": "]]"}).encode()
    whole = elements.scan(data)
    for cut in range(len(data)):
        run = len(data[:cut]) - len(data[:cut].rstrip(b"\\"))
        left = elements.scan(data[:cut]) if cut else None
        inside, depth = (left.quotes % 2 == 1, int(left.depth[-1])) if cut else (False, 0)
        right = elements.scan(data[cut:], run % 2 == 1, inside, depth)
        assert (right.depth == whole.depth[cut:]).all() and (right.outside == whole.outside[cut:]).all()


def test_a_large_annotated_set_is_read_by_several_tasks(spark, tmp_path):
    images = [{"id": k, "file_name": f"{k}.png", "width": 5, "height": 6, "source_map": "1"} for k in range(300)]
    notes = [{"id": k, "image_id": k % 300, "category_id": 1, "segmentation": [[0.0, 1.5, float(k)]], "area": k / 2, "bbox": [1, 2, 3, 4], "iscrowd": 0} for k in range(2000)]
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"info": {"annotations": "no"}, "images": images, "annotations": notes}))
    whole, split = readers.coco(spark, str(path), "train"), readers.coco_elements(spark, str(path), "train", 1 << 14)
    assert split[1].rdd.getNumPartitions() > 10 and split[1].select(F.spark_partition_id()).distinct().count() > 10
    for a, b in zip(whole, split, strict=True):
        assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
