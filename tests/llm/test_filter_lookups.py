"""Lookups in a segment of the log-frequency filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from panelstats.llm import lm


@pytest.fixture
def rng():
    return np.random.default_rng(5)


def test_questions_to_a_segment_are_looked_up_together(monkeypatch, rng):
    keys = [lm.keys_of(rng.integers(0, 1 << 63, 50).astype(np.uint64)) for _ in range(40)]
    bits = [lm.segment_bits(np.concatenate(keys[s::2][:5]), np.full(250, 3)) for s in (0, 1)]
    rows = [(s, None, bits[s].tobytes()) if b < 0 else (s, b, lm.packed(keys[2 * b + s])) for s in (0, 1) for b in range(-1, 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()),
                                                                       strict=True)], names=["segment", "block", "data"])
    whole, calls = lm.segment_levels, []
    monkeypatch.setattr(lm, "segment_levels", lambda b, k: calls.append(len(k)) or whole(b, k))
    got = {(r["segment"], r["block"]): r["levels"] for out in lm.answer(iter([batch.slice(0, 30), batch.slice(30)]))
           for r in out.to_pylist()}
    assert len(calls) == 3 and sum(calls) == 2000  # a run of a segment in a batch, not a block
    for (s, b), levels in got.items():
        assert levels == whole(bits[s], keys[2 * b + s]).tobytes()
    assert len(got) == 40
