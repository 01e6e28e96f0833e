from __future__ import annotations

import random

import numpy as np
import pytest

from textloom.llm import exchange as module
from textloom.llm.common import Workspace, ship
from textloom.llm.exchange import add, codes_of, exchange, pack_keys, pack_values, unpack_keys, unpack_values


def test_keys_and_values_round_trip():
    rng = np.random.default_rng(2)
    for bits, n in ((40, 1), (56, 1000), (60, 5)):
        keys = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64))
        assert (unpack_keys(pack_keys(keys)) == keys).all()
        values = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        assert (unpack_values(pack_values(values), n) == values).all()


@pytest.mark.parametrize("steps", [1, 2])
def test_every_pack_learns_the_sums(spark, monkeypatch, steps):
    ship(spark)
    if steps == 2:
        monkeypatch.setattr(module, "RANGES", 4)
        monkeypatch.setattr(module, "GROUP", 3)
    rng = random.Random(1)
    held = {p: {rng.randrange(200) << 12: rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))} for p in range(17)}
    total: dict = {}
    for own in held.values():
        for k, v in own.items():
            total[k] = total.get(k, 0) + v
    packs = spark.createDataFrame([(p,) for p in held], "pack long").repartition(5)

    def send(batches):
        for batch in batches:
            for p in batch.column("pack").to_pylist():
                keys = np.array(sorted(held[p]), np.uint64)
                if len(keys):
                    yield p, keys, np.array([held[p][int(k)] for k in keys], np.uint64)

    out = exchange(packs, send, 20, 10, 30, add, lambda total: np.minimum(total, 255), Workspace(spark, "test"))
    got = {r["sender"]: codes_of([x.asDict() for x in r["codes"]]).tolist() for r in out.collect()}
    assert got == {p: [total[k] for k in sorted(own)] for p, own in held.items() if own}
