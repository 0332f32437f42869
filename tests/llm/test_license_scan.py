import re

import pytest
from gradelake.llm import license_scan as L

APACHE = 'Licensed under the Apache License, Version 2.0 (the "License")'
TEXTS = [
    ("Released under the MIT License.", "mit", "MIT"),
    ("Intro. Released under the MIT license!\nAll rights reserved.", "mit,reserved", "MIT,All-rights-reserved"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted.\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products.", "bsd-grant,bsd-endorse", "BSD-3-Clause"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "bsd-grant", "BSD-2-Clause"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License; either version 3 of the License, or (at your option) any later version.", "free-software,gpl-terms,gpl3-later", "GPL-3.0-or-later"),
    ("ALL RIGHTS RESERVED. all rights reserved.", "reserved,reserved", "All-rights-reserved"),
    ("nothing here", "", ""),
    ("", "", ""),
    (None, "", ""),
]


def brute(text):
    """Sentences by position, rules by scanning lists."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ids = []
    for part in re.split(r"[\n\r;]+|[.!?:]+(?:[ \t\n\x0b\f\r]+|$)", low):
        clean = re.sub("[^a-z0-9]+", " ", part).strip()
        if clean in L.SENTENCES:
            ids.append(L.SENTENCES[clean])
    left, found = list(ids), []
    for name, rule in L.RULES:
        i, hit = 0, False
        while i + len(rule) <= len(left):
            if left[i : i + len(rule)] == rule:
                left[i : i + len(rule)] = [None]
                hit = True
            i += 1
        if hit and name not in found:
            found.append(name)
    return ",".join(ids), ",".join(found)


def test_stated_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in L.license_scan(df).collect()}
    for i, (text, ids, names) in enumerate(TEXTS):
        assert got[i] == (ids, names), text
        assert got[i] == brute(text)


@pytest.mark.parametrize("end", [". ", "!\n", ";", "\r\n", ": "])
def test_sentence_ends(spark, end):
    text = end.join(["All rights reserved", "Released under the MIT License", "x"])
    r = L.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["sentence_ids"], r["licenses"]) == brute(text) == ("reserved,mit", "MIT,All-rights-reserved")


APACHE_HEADER = """Copyright 2020 The Authors
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT_TEXT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD2_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3_END = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2_HEADER = GPL3_HEADER.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")


LGPL_HEADER = GPL2_HEADER.replace("This program is free", "This library is free").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
AGPL_HEADER = GPL3_HEADER.replace("GNU General", "GNU Affero General")
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
EPL_HEADER = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""


def test_published_texts_wrapped_and_unwrapped(spark):
    texts = [
        (LGPL_HEADER, "LGPL-2.1-or-later"), (AGPL_HEADER, "AGPL-3.0-or-later"), (MPL_HEADER, "MPL-2.0"), (ISC_TEXT, "ISC"), (UNLICENSE_TEXT, "Unlicense"), (EPL_HEADER, "EPL-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        (APACHE_HEADER, "Apache-2.0"), (MIT_TEXT, "MIT"), (BSD2_TEXT, "BSD-2-Clause"), (BSD2_TEXT + BSD3_END.format("the copyright holder"), "BSD-3-Clause"),
        (BSD2_TEXT + BSD3_END.format("the University of Somewhere"), "BSD-3-Clause"), (GPL3_HEADER, "GPL-3.0-or-later"), (GPL2_HEADER, "GPL-2.0-or-later"),
    ]
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "\n".join("# " + x for x in t.split("\n")), lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */\nint x;\n"]
    unwrap = lambda t: re.sub(r"(?<!\n)\n(?!\n)", " ", t)
    rows = [(i, shape(t)) for i, (t, _) in enumerate(texts) for shape in shapes] + [(i, unwrap(t)) for i, (t, _) in enumerate(texts) if i != 7]
    for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["licenses"] == texts[r["doc_id"]][1], (r, rows)
    ids = {r["doc_id"]: r["sentence_ids"] for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ids[7] == "apache2,compliance,obtain,asis-law" and ids[8] == "mit-grant,nowarranty"
