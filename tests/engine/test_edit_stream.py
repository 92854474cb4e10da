"""Edit sessions as a stream, with restarts, against the batch fold and a plain replay."""

from __future__ import annotations

import json
import random

import pytest

from sheetloom.streaming import cache, edits


def events(n, seed, ops=("add", "add", "add", "undo", "delete")):
    rng = random.Random(seed)
    return [{"map_num": rng.choice("abb"), "seq": k, "op": rng.choice(ops), "id": rng.randrange(12), "x": float(k), "y": -float(k)} for k in range(n)]


def feed(folder, rows, name):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def standing(spark, at):
    return {(r.map_num, r.id): (r.seq, r.x, r.y) for r in edits.standing_rows(spark, str(at / "table")).collect()}


def run(spark, at):
    edits.run_edit_stream(spark, str(at / "log"), str(at / "table"), str(at / "checkpoint"))


def test_a_restarted_stream_leaves_what_the_fold_leaves(spark, tmp_path):
    rows = events(300, 1)
    for k, (a, b) in enumerate(((0, 90), (90, 91), (91, 300))):
        feed(tmp_path / "log", rows[a:b], f"part{k}")
        run(spark, tmp_path)
    run(spark, tmp_path)  # nothing new
    folded = cache.fold_edits(spark.createDataFrame([tuple(r.values()) for r in rows], edits.EVENT), ["map_num"]).collect()
    want = {(r.map_num, r.id): (r.seq, r.x, r.y) for r in folded}
    assert want and standing(spark, tmp_path) == want


def test_pending_clicks_and_repeats(spark, tmp_path):
    e = lambda seq, op, id_=None, x=None, y=None: {"map_num": "a", "seq": seq, "op": op, "id": id_, "x": x, "y": y}
    first = [e(1, "confirm", 5), e(2, "click", None, 1.0, 2.0), e(3, "click", None, 3.0, 4.0), e(4, "confirm", 5), e(5, "confirm", 6), e(6, "click", None, 7.0, 8.0)]
    feed(tmp_path / "log", first, "one")
    run(spark, tmp_path)
    assert standing(spark, tmp_path) == {("a", 5): (4, 3.0, 4.0)}
    # the pending place of the first run is confirmed in the second; the repeated events change nothing
    feed(tmp_path / "log", [*first, e(7, "confirm", 7), e(8, "click", None, 9.0, 9.0), e(9, "cancel"), e(10, "confirm", 8), e(11, "add", 5, 0.5, 0.5)], "two")
    run(spark, tmp_path)
    assert standing(spark, tmp_path) == {("a", 5): (11, 0.5, 0.5), ("a", 7): (7, 7.0, 8.0)}
    feed(tmp_path / "log", [e(12, "undo"), e(13, "undo"), e(14, "delete", 5), e(15, "undo"), e(16, "undo"), e(17, None, 1), e(None, "add", 2)], "three")
    run(spark, tmp_path)
    assert standing(spark, tmp_path) == {}


class Held:
    """A state variable in memory that counts what is written."""

    def __init__(self):
        self.held, self.written = {}, 0

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key], self.written = value, self.written + sum(len(str(v)) for v in value)

    def removeKey(self, key):
        self.held.pop(key, None)

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value

    def clear(self):
        self.held.clear()


@pytest.mark.parametrize("parts", [1, 7])
def test_a_row_put_often_costs_no_more_than_many_rows(parts, monkeypatch):
    """what is written follows the events, not the square of how often a row is put; pages that are put aside come back."""
    import pandas as pd

    monkeypatch.setattr(edits, "PAGE", 8, raising=False)
    monkeypatch.setattr(edits, "PAGES", 3, raising=False)
    session, names = edits.EditSession(), ("position", "pending", "stack", "standing", "deleted")
    for name in names:
        setattr(session, name, Held())
    rng, n = random.Random(3), 3000
    # rows go up, all the way down and up again
    ops = ["add"] * 1000 + ["undo"] * 900 + [rng.choice(("add", "add", "undo", "delete")) for _ in range(n - 1900)]
    rows = pd.DataFrame({"map_num": "a", "seq": range(n), "op": ops, "id": [rng.randrange(3) for _ in range(n)], "x": [float(k) for k in range(n)], "y": 0.0})
    got = {}
    for k in range(parts):
        part = rows.iloc[k * n // parts : (k + 1) * n // parts]
        for r in pd.concat(session.handleInputRows(("a",), iter([part]), None)).itertuples():
            got[r.id] = (r.seq, r.x) if r.alive else None
    stack, gone = [], {}
    for r in rows.itertuples():
        if r.op == "add":
            stack.append((r.id, r.seq, r.x))
        elif r.op == "undo" and stack:
            stack.pop()
        elif r.op == "delete":
            gone[r.id] = r.seq
    top = {i: (s, x) for i, s, x in stack}
    assert got == {i: top[i] if i in top and top[i][0] > gone.get(i, -1) else None for i in got}
    assert sum(getattr(session, name).written for name in names) < 200 * n
