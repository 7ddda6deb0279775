"""Licence texts as files have them: wrapped, with blank lines and in comments."""

import textwrap

from siftwave.llm import licenses
from siftwave.llm.license_table import ALL_RULES, ALL_SENTENCES, HEADERS, SPDX
from siftwave.llm.license_texts import known_units, scan_texts

from .test_native import native

S = licenses.SENTENCES
wrap = lambda t, by="": textwrap.fill(t, 60, initial_indent=by, subsequent_indent=by, break_on_hyphens=False)
MIT = f"MIT License\n\nCopyright (c) 2020 X\n\n{wrap(S['mit-permission'])}\n\n{wrap(S['mit-notice'])}\n\nTHE SOFTWARE IS PROVIDED"
GPL = f"prog does things\nCopyright (C) 2020 X\n\n{wrap(S['gpl-redistribute'])}\n\n{wrap('This program is distributed in the hope that it will be useful.')}"
BSD = f"Copyright (c) 2020, X\nAll rights reserved.\n\nRedistribution and use are permitted provided that the following conditions are met:\n\n{wrap('1. ' + S['bsd-redistribution'])}\n\n{wrap('2. ' + S['bsd-binary'])}\n"
APACHE = f"Licensed under the Apache License, Version 2.0 (the \"License\");\n{S['apache2-may-not']}.\n{S['apache2-copy']}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{wrap(S['apache2-as-is'])}"
comment = lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\ncode();"


def test_wrapped(spark):
    texts = [MIT, GPL, BSD, BSD + "\n" + wrap("3. " + S["bsd-endorse"]), APACHE, comment(MIT), comment(GPL), comment(APACHE), MIT.replace("\n", "\r\n")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[4] for r in native(scan_texts(df))}
    assert got == {0: "MIT", 1: "GPL-3.0", 2: "BSD-2-Clause", 3: "BSD-3-Clause", 4: "Apache-2.0", 5: "MIT", 6: "GPL-3.0", 7: "Apache-2.0", 8: "MIT"}


def test_units_of_a_sentence_stand_side_by_side(spark):
    gpl = S["gpl-redistribute"].split(": ")
    rows = [(1, f"{gpl[0]}. Not so. {gpl[1]}"), (2, "SPDX-License-Identifier: Other-1.0\n\nWe like this.\n\nMIT\n\n"), (3, "// SPDX-License-Identifier: MIT\nx = 1"), (None, GPL), (5, None), (6, ""), (1, MIT)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.licence or "") for r in scan_texts(df).collect())
    assert got == [("1", ""), ("1", "MIT"), ("2", ""), ("3", "MIT"), ("5", ""), ("6", ""), ("None", "GPL-3.0")]
    assert scan_texts(df.limit(0)).collect() == [] and not any(r.licence for r in scan_texts(df, rules=()).collect())


def test_common_licences(spark):
    """Headers wrapped, SPDX lines and notices that grant nothing; those of op4_license_scan are unknown to most of them."""
    rows = [(f"{i}", f"Notice\n\n{wrap(s, '# ')}\n\nrest", licence) for i, (licence, s) in HEADERS.items()]
    rows += [(x, f"# SPDX-License-Identifier: {x}\nimport x", licence) for licence, xs in SPDX.items() for x in xs]
    rows += [("reserved", "Copyright 2021 X.\nAll rights reserved.\nMore text", "LicenseRef-All-Rights-Reserved"), ("none", "no rights at all.", None), ("grant", "x. Released under the Mozilla Public License 2.0. y", "MPL-2.0")]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    assert {r.doc_id: r.licence for r in scan_texts(df).collect()} == {i: licence for i, _, licence in rows}


def test_no_two_licences_share_a_sentence():
    for view in (0, 1):
        of, seen = known_units(ALL_SENTENCES, view)[1], {}
        for r in ALL_RULES:
            assert seen.setdefault(tuple(tuple(of[s]) for s in r.sentences), r.licence) == r.licence
