import corpus_pipeline as P
from siftwave.llm import minhash, mixing

from . import test_minhash, test_native, test_substring
from .conftest import SCHEMA, key


def test_stages(spark, docs, corpus, tmp_path):
    """Each stage against brute force over its own input; ids are made distinct here."""
    rows = [(i, r[1], r[2], r[3], r[4]) for i, r in enumerate(corpus)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, next(r[1] for r in corpus if r[1] and 60 < len(r[1].split()) < 200)), (2, "one two three")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "mix"]
    for name, stage in P.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        before = [tuple(r) for r in now.collect()]
        if name == "quality":
            assert {r.doc_id for r in got.collect()} == {r[0] for r, k in zip(before, test_native.verdicts(before), strict=True) if k}
        elif name == "near_dedup":
            assert {r.doc_id for r in got.collect()} == {r[0] for r in test_minhash.brute(before, 5) if r[3]}
        elif name == "substring_dedup":
            import hashlib

            sha = {r[0]: (r[2], r[3]) for r in test_substring.brute(before)}
            for r in got.collect():
                gone, h = sha[r.doc_id]
                assert not gone or (hashlib.sha256(r.text.encode()).hexdigest() == h and r.n_chars == len(r.text))
        elif name == "decontaminate":
            assert {r.doc_id for r in got.collect()} == {r[0] for r in test_native.contamination(before, items) if not r[-1]}
        else:
            assert got.count() == len(before)
        if name != "mix":
            assert got.columns == now.columns
            now = got
