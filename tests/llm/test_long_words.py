"""Texts without spaces are scored by all their characters (op7_quality)."""

from __future__ import annotations

import numpy as np
import pytest

from sheetloom.llm import quality


def test_middle_of_a_long_word_counts(monkeypatch):
    table = np.random.default_rng(3).random(quality.BUCKETS).astype(np.float32)
    a, b = ("天地" * 15 + middle * 400 + "玄黄" * 15 for middle in ("宇宙", "洪荒"))
    scorer = quality.Scorer(table, 0.0)
    got = scorer.scores([a, b])
    assert got[0] != got[1]
    assert not scorer.known
    ids, owner = quality.subwords([a])
    assert len(ids) == 1 + (len(a) + 2 - 2) + (len(a) + 2 - 3)
    monkeypatch.setattr(quality, "PIECE", 100)
    assert quality.Scorer(table, 0.0).scores([a, b]) == pytest.approx(got)
