"""The filter of repeated keys, task side, against a count of the places."""

from collections import defaultdict

import numpy as np
import pytest

from loomspark.llm import batch, repeats


def _bits(parts, owners):
    told = [repeats._tell([repeats.places(k)], [o] if owners else []) for k, o in parts]
    found = np.zeros((repeats._RANGES, repeats._SPAN // 8), np.uint8)
    for b in repeats._merge(iter(told)):
        for r, bits in zip(b.column("range").to_pylist(), b.column("bits").to_pylist(), strict=True):
            found[r] = np.frombuffer(repeats.zlib.decompress(bits), np.uint8)
    return found.ravel()


@pytest.mark.parametrize("owners", [False, True])
def test_places_met_again(owners):
    rng = np.random.default_rng(3)
    pool = batch.random_values(300, 5)
    parts = [(pool[rng.integers(0, 300, 100)], rng.integers(0, 3, 100).astype(np.uint16) * np.uint16(32767)) for _ in range(4)]
    met = defaultdict(list)
    for keys, own in parts:
        for at, o in zip(repeats.places(keys).tolist(), own.tolist(), strict=True):
            met[at].append(o)
    want = [len(set(met[at]) if owners else met[at]) > 1 for at in repeats.places(pool).tolist()]
    assert repeats.may_repeat(_bits(parts, owners), pool).tolist() == want
    assert 0 < sum(want) < 300
