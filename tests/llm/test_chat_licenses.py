"""Perspective rotation and licence scans, on odd rows and against the SQL."""

import duckdb
import pandas as pd
import pytest

from siftwave.llm import chat, licenses

from .conftest import key
from .test_native import native

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi é"), (1, 2, "bob", "yo\n"), (1, 3, "ann", ""), (1, 3, "ann", ""), (1, 700, "bob", "late"),
    *((4, i * 255 // 299, "ann" if i % 2 else "bob", f"said {i}") for i in range(300)), (4, 300, "ann", "on"), (4, 600, "system", "again"), (4, 1300, "ann", "end"),
    (2, 0, "system", "alone"), (None, 0, None, "x"), (None, None, "ann", None), (3, 5, "ann", "w " * 50_000), (3, -1, "cy", "before"), (3, 5, "ann", "tie"),
]


def test_rotation(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, speaker string")
    out = chat.rotate(df)
    for r in out.collect():
        assert sum(e - s for s, e in r.spans) == r.mask_chars
        assert all(r.text[s - len(chat.ASSISTANT) : s] == chat.ASSISTANT and r.text[s:e].endswith(chat.END) for s, e in r.spans)
    got = {(r.conv_id, r.speaker, r.part): r.text for r in out.collect()}
    assert got[1, "bob", 0] == "<|system|>\nbe kind<|end|>\n<|user:ann|>\nhi é<|end|>\n<|assistant|>\nyo\n<|end|>\n<|user:ann|>\n<|end|>\n<|user:ann|>\n<|end|>\n"
    # the context and the turns before are carried over
    assert got[1, "bob", 2] == got[1, "bob", 0] + "<|assistant|>\nlate<|end|>\n"
    assert next(r for r in out.collect() if (r.conv_id, r.speaker, r.part) == (1, "bob", 2)).mask_chars == len("late<|end|>\n")
    # of a long part the last turns alone, and of a part of context none
    assert got[4, "ann", 1].count("<|assistant|>") + got[4, "ann", 1].count("<|user:bob|>") == chat.OVERLAP + 1 and "said 283" not in got[4, "ann", 1] and got[4, "ann", 1].index("said 284") < got[4, "ann", 1].index("said 299")
    assert got[4, "bob", 5].startswith("<|system|>\nagain<|end|>\n<|user:ann|>\nend")
    assert (2, "system", 0) not in got and (1, "ann", 2) in got and (None, "unknown", 0) in got
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(TURNS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    expected = con.execute(chat.OP2_SQL).fetchall()
    import hashlib

    own = [(r.conv_id, r.speaker, r.part, r.n_turns, hashlib.sha256(r.text.encode()).hexdigest(), ",".join(f"{s}-{e}" for s, e in r.spans), r.mask_chars) for r in out.collect()]
    assert sorted(own, key=key) == sorted(expected, key=key)
    native(out)
    assert chat.rotate(df.limit(0)).collect() == []


S = licenses.SENTENCES
TEXTS = [
    None, "", S["mit-released"], "x\n  licensed UNDER cc by-nc 4.0\ny", f"a. {S['mit-permission']}\n\n{S['mit-notice']} end", S["mit-notice"], S["mit-permission"].replace(" sell", "\nsell"),
    "\n".join([S["bsd-redistribution"], "other", S["bsd-binary"], S["bsd-endorse"]]), f"{S['apache2']}\n{S['gpl3-work']}", "word " * 100_000 + "\n" + S["apache2"], "é" + S["apache2"],
]


def test_licences(spark):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "z"), (None, TEXTS[2], "z"), (2, TEXTS[8], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence string")
    out = licenses.scan(df)
    got = native(out)
    assert {r[0]: r[4] for r in got if r[0] not in (None, 2)} == {0: None, 1: None, 3: "CC-BY-NC-4.0", 4: "MIT", 5: None, 6: None, 7: "BSD-3-Clause", 8: "GPL-3.0", 9: "Apache-2.0", 10: "Apache-2.0"}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "licence"]).astype({"doc_id": "Int64"}))
    expected = con.execute(licenses.SCAN_SQL).fetchall()
    flat = [(i, ",".join(a), ",".join(b), ",".join(c), d) for i, a, b, c, d in got]
    assert sorted(flat, key=key) == sorted(expected, key=key)
    assert licenses.scan(df.limit(0)).collect() == [] and not any(r.licence for r in licenses.scan(df, rules=()).collect())
