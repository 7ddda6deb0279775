"""The table of known sentences and rules for op4_license_scan: headers, grants and SPDX lines of common licences."""

from __future__ import annotations

from .licenses import RULES, SENTENCES, Rule

_GNU = "{0}{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."

#: Headers by identifier, and the licence that each of them means.
HEADERS = {
    "gpl2-redistribute": ("GPL-2.0", _GNU.format("This program is free software", ";", "General Public License", ";", "2")),
    "gpl3-redistribute-semicolon": ("GPL-3.0", _GNU.format("This program is free software", ";", "General Public License", ";", "3")),
    "lgpl2-redistribute": ("LGPL-2.0", _GNU.format("This library is free software", ";", "Library General Public License", ";", "2")),
    "lgpl21-redistribute": ("LGPL-2.1", _GNU.format("This library is free software", ";", "Lesser General Public License", ";", "2.1")),
    "lgpl3-redistribute": ("LGPL-3.0", _GNU.format("This program is free software", ":", "Lesser General Public License", ",", "3")),
    "lgpl3-library": ("LGPL-3.0", _GNU.format("This library is free software", ":", "Lesser General Public License", ",", "3")),
    "agpl3-redistribute": ("AGPL-3.0", _GNU.format("This program is free software", ":", "Affero General Public License", ",", "3")),
    "mpl2-subject": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "isc-permission": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "isc-permission-and": ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0bsd-permission": ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "unlicense-free": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "cc0-dedicated": ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    "epl2-available": ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    "epl2-available-slash": ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    "epl1-available": ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "bsl1-distributed": ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
}

#: Names in grants, by licence.
NAMES = {
    "MIT": ("MIT License", "MIT license (MIT)"), "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"), "ISC": ("ISC License",), "Unlicense": ("Unlicense",), "0BSD": ("BSD Zero Clause License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"), "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License, version 2"), "GPL-3.0": ("GNU General Public License v3.0", "GNU General Public License, version 3"), "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"), "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
GRANTS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This work is licensed under {}.", "This project is licensed under the {}.", "This software is licensed under the {}.")

#: What follows SPDX-License-Identifier, by licence.
_ENDINGS = ("{}", "{}-only", "{}-or-later")
SPDX = {x: (x,) for x in ("MIT", "Apache-2.0", "ISC", "0BSD", "Unlicense", "CC0-1.0", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")}
SPDX |= {x: tuple(e.format(x) for e in _ENDINGS) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}

#: The last rule: a notice that grants nothing.
RESERVED = Rule("LicenseRef-All-Rights-Reserved", ("all-rights-reserved",))


def _table() -> tuple[dict[str, str], tuple[Rule, ...]]:
    """Sentences and rules: those of licenses.SENTENCES first, then headers, grants and SPDX lines, and RESERVED at the end."""
    more = [(i, licence, s) for i, (licence, s) in HEADERS.items()]
    more += [(f"grant-{licence.lower()}-{i}-{j}", licence, g.format(n)) for licence, names in NAMES.items() for i, n in enumerate(names) for j, g in enumerate(GRANTS)]
    more += [(f"spdx-line-{x.lower()}", licence, f"SPDX-License-Identifier: {x}") for licence, xs in SPDX.items() for x in xs]
    sentences = SENTENCES | {i: s for i, _, s in more} | {"all-rights-reserved": "All rights reserved."}
    return sentences, (*RULES, *(Rule(licence, (i,)) for i, licence, _ in more), RESERVED)


ALL_SENTENCES, ALL_RULES = _table()
