import random

import numpy as np
import pyarrow as pa
import pytest

from driftspark.llm import words


def split(text, lower):
    data = (text or "").encode()
    return (bytes(x + 32 if 65 <= x <= 90 else x for x in data) if lower else data).split()


@pytest.mark.parametrize("step", [16, 50, 1 << 20])
@pytest.mark.parametrize("lower", [False, True])
def test_word_hashes_are_of_the_words(monkeypatch, step, lower):
    monkeypatch.setattr(words, "STEP", step)
    rng, seen = random.Random(step), {}
    for _ in range(60):
        texts = [rng.choice([None, "", " ", "a\tb", "x" * rng.randint(1, 120),
                             " ".join("".join(rng.choice("abAé\n") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 60)))])
                 for _ in range(rng.randint(1, 20))]
        want = [split(t, lower) for t in texts]
        hashes, counts = [], []
        for _, _, data, offsets in words.slices(pa.array(texts, pa.string()), size=200, rows=7):
            h, c = words.text_hashes(data, offsets, lower)
            hashes.append(h)
            counts.append(c)
        assert np.concatenate(counts).tolist() == [len(w) for w in want]
        for word, value in zip((w for ws in want for w in ws), np.concatenate(hashes).tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_ngrams():
    column = pa.array(["skip", "a b c", None, "a b"]).slice(1)
    (lo, hi, data, offsets), = words.slices(column)
    h, counts = words.text_hashes(data, offsets)
    grams, row, pos = words.ngrams(h, counts, 2)
    assert (lo, hi, counts.tolist(), row.tolist(), pos.tolist()) == (0, 3, [3, 0, 2], [0, 0, 2], [0, 1, 0])
    assert grams[0] == grams[2] != grams[1]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    more = rng.integers(0, 1 << 30, 17).astype(np.uint32)
    got = words.unpack(words.pack(values, more, np.zeros(0, np.int64)))
    assert (got[0] == values).all() and (got[1] == more).all() and len(got[2]) == 0
    bounds = words.by_block(values, 7, 64)
    assert bounds[0][1] == 0 and bounds[-1][2] == 1000 and all(a[2] == b[1] for a, b in zip(bounds, bounds[1:]))
