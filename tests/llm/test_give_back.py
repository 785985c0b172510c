"""Memory that a task's Python worker has freed goes back when the task ends."""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
import pytest

from estatelens.llm import jaccard, language, packing, repeats, words


def test_rows_pass_and_memory_is_given_back_even_after_an_error(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1))
    assert list(words.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and calls == [1]

    def broken(batches):
        yield next(batches)
        raise ValueError("x")

    got = words.tidy(broken)(iter([1, 2]))
    assert next(got) == 1
    with pytest.raises(ValueError):
        next(got)
    assert calls == [1, 1]


def test_freed_memory_leaves_the_process():
    def anonymous():
        return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon"))

    held = [pa.array(np.arange(4000)) for _ in range(2000)] + [bytearray(20000) for _ in range(3000)]
    last = bytearray(20000)
    full = anonymous()
    del held
    words.give_back()
    assert anonymous() < full - 60_000 and last


@pytest.mark.parametrize("module", [repeats, language, jaccard, packing])
def test_every_scan_of_texts_gives_back(module):
    text = inspect.getsource(module)
    assert "mapInArrow(tidy(" in text and "mapInArrow(run" not in text
