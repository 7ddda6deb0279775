"""Quality cutoffs that junk can't switch off."""

import pytest

from siftwave.llm import quality

from .test_native import low, native

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("share", [6, 20])
def test_junk_cannot_move_cutoffs(spark, share):
    rows = [(i, " ".join(f"w{i}x{j}{'%%%' if bad else ''}" for j in range(40)), "en", "a") for i in range(400) for bad in [i * 100 < share * 400]]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in quality.judge(df).collect() if r.kept}
    assert kept == {i for i in range(400) if i * 100 >= share * 400}


def test_cutoffs_by_hand(spark):
    """Against sorted values: tightening below the fixed floors, loosening where a source has a wide spread, and the limit."""
    values = {"plain": [0] * 200, "tables": [i * 25 for i in range(200)], "bars": [0] * 120 + [9_000] * 80}
    rows = [("en", s, False, v, v, 500 + v // 100) for s, vs in values.items() for v in vs] + [("en", "small", False, 7, 7, 7), ("en", "gone", True, 9, 9, 9)]
    df = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, symbols long, dup_lines long, length long")
    got = {r.source: r for r in quality.cutoffs(df).collect()}
    for m in quality.MEASURES:
        col = ("symbols", "dup_lines", "length").index(m.name) + 3
        for s in ("plain", "tables", "bars", "small"):
            own = sorted(low(r[col]) for r in rows if not r[2] and (r[1] == s or s == "small"))
            at = lambda q, own=own: own[-(-len(own) * q // 1000) - 1]
            free = at(500) + quality.TIMES * max(at(750) - at(500), m.spread)
            assert got[s][f"{m.name}_cutoff"] == (free if m.most is None else min(free, m.most)), (s, m.name)
    assert got["plain"].symbols_cutoff < 7_500 < got["tables"].symbols_cutoff and got["bars"].dup_lines_cutoff == 8_000


def test_robust_is_native_and_empty(spark, docs, empty):
    assert len(native(quality.judge(docs))) == docs.count() and quality.judge(empty).collect() == []
