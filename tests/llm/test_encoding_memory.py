"""What a task holds while it encodes and decodes does not grow with its batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import sentencepiece_fst


@pytest.fixture(scope="module")
def machine():
    with open(sentencepiece_fst.default_model(), "rb") as file:
        return sentencepiece_fst.compile_model(file.read())


@pytest.fixture(scope="module")
def column():
    rng = np.random.default_rng(9)
    words = np.array(["".join(rng.choice(list("etaoinshrdlu"), n)) for n in rng.integers(2, 11, 20_000)])
    return pa.array([" ".join(rng.choice(words, 350)) for _ in range(4_000)], pa.string())


def walk(machine, column):
    """Ids of all texts, and how many of them decode to their text."""
    ids, same = [], 0
    for low, high, found, bounds in sentencepiece_fst._coded(machine, column):
        ids += [found[a:b] for a, b in zip(bounds, bounds[1:])]
        same += sum(a == b for a, b in zip(machine.decode_texts(found, bounds), column.slice(low, high - low).to_pylist()))
    return ids, same


def test_batches_are_encoded_and_decoded_in_bounded_memory(machine, column):
    machine.encode("warm")
    tracemalloc.start()
    for low, high, ids, bounds in sentencepiece_fst._coded(machine, column):
        machine.decode_texts(ids, bounds)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48e6


def test_slices_and_ranges_of_any_size_give_the_same_ids(machine, column, monkeypatch):
    some = pa.array([*column.slice(0, 60).to_pylist(), None, "", " ", "日本 été\n💩", "x" * 5_000], pa.string())
    ids, same = walk(machine, some)
    assert same == len(some) - 1 and sum(map(len, ids)) > 10_000  # null is no text
    for size, cells, ranges in ((1 << 24, 1 << 22, 1 << 24), (700, 100, 3)):
        monkeypatch.setattr(sentencepiece_fst, "SLICE", size)
        monkeypatch.setattr(sentencepiece_fst, "CELLS", cells)
        monkeypatch.setattr(sentencepiece_fst, "RANGES", ranges)
        again, same = walk(machine, some)
        assert same == len(some) - 1 and all(np.array_equal(a, b) for a, b in zip(ids, again, strict=True))
