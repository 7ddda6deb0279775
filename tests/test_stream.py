"""The stream of pieces against whole sequences."""

import random

import pandas as pd
import pytest

from siftwave.operators.schemes import get_scheme, sample
from siftwave.streaming.sampler import STORE, Cutter, sample_stream

SCHEMA = "seq_id long, at long, data binary"


class State:
    """A value and timers in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return self.timers

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


@pytest.mark.parametrize("seed", range(30))
def test_cutter(seed):
    """Chunks cover each window once, with the letters that a table's chunks have, and state stays small."""
    r = random.Random(seed)
    text = bytes(r.randrange(4) for _ in range(r.choice([0, 3, 9, 40, 300])))
    l, chunk, at = r.choice([1, 2, 9, 30]), r.choice([1, 4, 256]), 0
    cutter, state, windows = Cutter(l, chunk, r.choice([0, 50])), State(), []
    cutter.init(state)
    while at < len(text):
        to = min(len(text), at + r.choice([1, 2, 7, 100]))
        middle, back = r.randint(at, to), max(0, at - r.choice([0, 0, 3]))
        pieces = [(middle, text[middle:to]), (back, text[back:middle]), (0, text[: min(5, at)])]
        for df in cutter.handleInputRows((7,), iter([pd.DataFrame([(7, a, x) for a, x in pieces], columns=["seq_id", "at", "data"])]), state):
            for x in df.itertuples():
                assert x.lead == (x.start > 0) and x.count <= chunk and x.data == text[x.start - x.lead : x.start + x.count + l - 1]
                windows += range(x.start, x.start + x.count)
        at = to
        assert len(state.value[0]) <= l and len(state.timers) == (1 if cutter.idle else 0)
    assert windows == list(range(len(text) - l + 1))
    with pytest.raises(ValueError, match="missing"):
        list(cutter.handleInputRows((7,), iter([pd.DataFrame([(7, len(text) + 1, b"x")], columns=["seq_id", "at", "data"])]), state))
    list(cutter.handleExpiredTimer((7,), state, None))
    assert not state.exists()


@pytest.mark.parametrize(("name", "p"), [("AntiLex", {}), ("BdAnchor", {"r": 1}), ("Random", {"mod": 1, "r": 2})])
def test_stream(spark, tmp_path, name, p):
    """Pieces of any size, some of them twice, in batches and over a restart, sample what the whole does."""
    spark.conf.set(*STORE)
    r = random.Random(1)
    whole = [(i, bytes(r.randrange(4) for _ in range(200))) for i in range(2)]
    cuts, scheme = [0, 3, 51, 130, 200], get_scheme(name, **p)
    for run in (cuts[:3], cuts[2:]):
        for a, b in zip(run, run[1:], strict=False):
            rows = [(i, max(a - 2, 0), bytearray(t[max(a - 2, 0) : b])) for i, t in whole]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pieces = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = sample_stream(pieces, scheme, 8, 4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    seqs = spark.createDataFrame([(i, bytearray(t)) for i, t in whole], "seq_id long, bytes binary")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(sample(seqs, scheme, 8, 4).collect())
