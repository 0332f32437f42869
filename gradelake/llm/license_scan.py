"""Licences in texts: known sentences to identifiers, identifier sequences to rules (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known licence sentences after normalisation (lower case, letters and digits only, single spaces) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2",
    "you may not use this file except in compliance with the license": "compliance",
    "you may obtain a copy of the license at": "obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "asis-law",
    "released under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied": "nowarranty",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "this program is free software": "free-software",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-endorse",
    "licensed under cc by nc 4 0": "ccbync4",
    "licensed under cc by 4 0": "ccby4",
    "licensed under cc by sa 4 0": "ccbysa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4",
    "all rights reserved": "reserved",
    "this library is free software": "free-software",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl-terms",
    "either version 2 1 of the license or at your option any later version": "gpl21-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-waiver",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution": "epl2",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "boost",
    "use modification and distribution are subject to the boost software license version 1 0": "boost",
    "spdx license identifier": "spdx",
}
#: Identifiers that stand after an SPDX tag.
TAGS = [
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "Unlicense", "EPL-2.0", "Zlib", "BSL-1.0", "0BSD", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
]
SENTENCES |= {" ".join(t.lower().replace("-", " ").replace(".", " ").split()): f"tag-{t}" for t in TAGS}
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_GNU = {"gpl": "", "lgpl": "lesser ", "agpl": "affero "}
_VERSIONS = {"gpl2-later": "2", "gpl21-later": "2 1", "gpl3-later": "3"}
_OBTAIN = "you may obtain a copy of the license at"
_ASIS = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
_NOWARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
_ENDORSE = "contributors may be used to endorse or promote products derived from this software without specific prior written permission"
#: Whole sentences of the licences as published, and the identifiers that each stands for (the SQL knows the sentences above only).
WHOLE = {
    "licensed under the apache license version 2 0 the license": "apache2",
    f"{_OBTAIN} http www apache org licenses license 2 0": "obtain",
    f"{_OBTAIN} https www apache org licenses license 2 0": "obtain",
    _ASIS: "asis-law",
    f"{_ASIS} either express or implied": "asis-law",
    _MIT: "mit-grant",
    f"{_NOWARRANTY} noninfringement": "nowarranty",
    f"{_NOWARRANTY} non infringement": "nowarranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    f"neither the name of the copyright holder nor the names of its {_ENDORSE}": "bsd-endorse",
}
for _id, _word in _GNU.items():
    _terms = f"you can redistribute it and or modify it under the terms of the gnu {_word}general public license as published by the free software foundation"
    WHOLE[_terms] = f"{_id}-terms"
    WHOLE |= {f"{_terms} either version {v} of the license or at your option any later version": f"{_id}-terms|{later}" for later, v in _VERSIONS.items()}
#: The endorsement clause names its holder.
_HOLDER = "^(?:3 )?neither the name of [a-z0-9 ]{1,200}? nor the names of (?:its|their|any|other|the) contributors"
#: Ordered rules: the first that fits a place wins over later ones.  A rule is a sequence of sentence identifiers that follow each other, other sentences left out.
RULES = [
    *[(t, ["spdx", f"tag-{t}"]) for t in TAGS],
    ("Apache-2.0", ["apache2", "compliance", "obtain", "asis-law"]),
    ("Apache-2.0", ["apache2"]),
    ("MIT", ["mit", "mit-grant", "nowarranty"]),
    ("MIT", ["mit-grant", "nowarranty"]),
    ("MIT", ["mit"]),
    ("GPL-3.0-or-later", ["free-software", "gpl-terms", "gpl3-later"]),
    ("GPL-2.0-or-later", ["free-software", "gpl-terms", "gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl2-later"]),
    ("LGPL-3.0-or-later", ["free-software", "lgpl-terms", "gpl3-later"]),
    ("LGPL-2.1-or-later", ["free-software", "lgpl-terms", "gpl21-later"]),
    ("AGPL-3.0-or-later", ["free-software", "agpl-terms", "gpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "gpl3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "gpl21-later"]),
    ("AGPL-3.0-or-later", ["agpl-terms", "gpl3-later"]),
    ("GPL-3.0-only", ["gpl3"]),
    ("MPL-2.0", ["mpl-terms", "mpl2-copy"]),
    ("EPL-2.0", ["epl2"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["zero-grant"]),
    ("Unlicense", ["unlicense", "unlicense-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("CC-BY-NC-4.0", ["ccbync4"]),
    ("CC-BY-SA-4.0", ["ccbysa4"]),
    ("CC-BY-4.0", ["ccby4"]),
    ("All-rights-reserved", ["reserved"]),
]
#: A sentence ends at a line break, ';', or at one of '.!?:' before white space or the end of the text.
_ENDS = r"[\n\r;]+|[.!?:]+(\s+|$)"
#: A wrapped sentence goes on over single line breaks: it ends at a line without letters and digits, or as above.
_WRAPPED_ENDS = r";+|[.!?:]+(\s+|$)|(?>\r\n|\r|\n)(?>[^a-z0-9\r\n;]*)(?>\r\n|\r|\n)"
#: A copyright line stands alone.
_COPYRIGHT = r"(?m)^([^a-z0-9\r\n]*copyright[^\r\n]*)(?>\r\n|\r|\n)"


def _known(part: Column) -> Column:
    """The identifiers of a normalised sentence, or null."""
    table_ = F.create_map(*[F.lit(x) for pair in (SENTENCES | WHOLE).items() for x in pair])
    clean = F.trim(F.regexp_replace(part, "[^a-z0-9]+", " "))
    holder = F.regexp_replace(clean, _HOLDER, "neither the name of the copyright holder nor the names of its contributors")
    return F.try_element_at(table_, F.when(F.contains(clean, F.lit("neither the name of")), holder).otherwise(clean))


def _sequence(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; what is no known sentence over its line breaks is read line by line."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(F.regexp_replace(low, _COPYRIGHT, "$1\n\n"), _WRAPPED_ENDS, -1)
    lines = lambda x: F.array_compact(F.transform(F.split(x, r"[\r\n]+", -1), _known))
    ids = F.flatten(F.transform(parts, lambda x: F.coalesce(F.split(_known(x), r"\|", -1), lines(x))))
    return F.flatten(F.transform(ids, lambda x: F.split(x, r"\|", -1)))


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per input row: doc_id, n_sentences (known ones), sentence_ids and licenses (comma-joined, in order of rules).

    Each rule takes the places where its sequence stands and removes them, so a
    longer rule keeps a shorter one from matching again.  A null or empty text has no
    sentences and an empty list; repeated rows each get their row; other columns are
    not read; an empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sequence(F.coalesce("text", F.lit(""))).alias("ids"))
    d = d.withColumn("left", F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|")))
    for i, (_, ids) in enumerate(RULES):
        want = "|" + "|".join(ids) + "|"
        d = d.withColumn(f"hit{i}", F.contains("left", F.lit(want))).withColumn("left", F.replace(F.replace("left", F.lit(want), F.lit("||")), F.lit(want), F.lit("||")))
    names = F.array_distinct(F.filter(F.array(*[F.when(F.col(f"hit{i}"), F.lit(name)) for i, (name, _) in enumerate(RULES)]), lambda x: x.isNotNull()))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(names, ",").alias("licenses"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
    steps, last = [], "seq"
    for i, (_, ids) in enumerate(RULES):
        want = "|" + "|".join(ids) + "|"
        steps.append(f"s{i} AS (SELECT * EXCLUDE (rest), contains(rest, '{want}') AS hit{i}, replace(replace(rest, '{want}', '||'), '{want}', '||') AS rest FROM {last})")
        last = f"s{i}"
    names = ", ".join(f"CASE WHEN hit{i} THEN '{n}' END" for i, (n, _) in enumerate(RULES))
    order = list(dict.fromkeys(n for n, _ in RULES))
    rank = "MAP {" + ", ".join(f"'{n}': {i}" for i, n in enumerate(order)) + "}"
    return f"""
WITH parts AS (SELECT doc_id, list_filter(list_transform(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ENDS}'),
    lambda x: ({known})[trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids FROM documents),
seq AS (SELECT doc_id, ids, '|' || array_to_string(ids, '|') || '|' AS rest FROM parts),
{", ".join(steps)}
SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct([{names}]), 'ASC', 'NULLS LAST', lambda a, b: 0), ','), '') AS licenses FROM {last}
""".replace("list_sort(list_distinct([" + names + "]), 'ASC', 'NULLS LAST', lambda a, b: 0)", f"list_transform(list_sort(list_transform(list_distinct([{names}]), lambda x: ({rank})[x])), lambda x: (map_keys({rank}))[x + 1])")


ORACLE = _oracle()
