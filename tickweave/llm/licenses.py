"""License scans by patience alignment (operator 3).

A template and a stretch of text are aligned as patience diff aligns files: words that occur once in
both are anchors, the longest increasing subsequence of the anchors' positions stays, and every gap
between neighbouring anchors is aligned the same way, recursively; equal words at a gap's two ends
are matched first. Coverage is the share of the template's words that found a partner; a stretch is
reported from ``coverage`` on when it holds the license's name and version (``DECIDING``).

Stretches: a text can only cover a template when it holds that share of its distinct words, which
rules out nearly all pairs by one set intersection. For the others, windows of the template's length
(plus slack) start at each template word of the text, so two copies of a notice are two finds. Each
text is scanned whole and where it lies; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import documents, map_arrow, text_chunks

#: Public notices and license texts, by id; of the long texts their openings (``-text``).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version.""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
        License, or (at your option) any later version.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or
        (at your option) any later version.""",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-notice": "Released under the BSD License.",
    "ISC-notice": "Released under the ISC License.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0""",
    "CC0-1.0-notice": "Released under CC0 1.0 Universal.",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0": """This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.""",
    "CC-BY-NC-4.0": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.""",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0": """This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International
        License.""",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0": """This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International
        License.""",
    "GPL-2.0-text": """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.,
        51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute
        verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most
        software are designed to take away your freedom to share and change it. By contrast, the GNU General
        Public License is intended to guarantee your freedom to share and change free software--to make sure the
        software is free for all its""",
    "GPL-3.0-text": """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.
        <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license
        document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft
        license for software and other kinds of works. The licenses for most software and other practical works
        are designed to take away your freedom to share and change the works. By contrast, the GNU General
        Public License is intended to guarantee your freedom to""",
    "LGPL-2.1-text": """GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software
        Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to
        copy and distribute verbatim copies of this license document, but changing it is not allowed. [This is
        the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public
        License, version 2, hence the version number 2.1.] Preamble The licenses for most software are designed
        to take away your freedom to share and""",
    "LGPL-3.0-text": """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation,
        Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license
        document, but changing it is not allowed. This version of the GNU Lesser General Public License
        incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by
        the additional permissions listed below. 0. Additional Definitions. As used herein, "this License"
        refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL""",
    "MPL-2.0-text": """Mozilla Public License Version 2.0 ================================== 1. Definitions -------------- 1.1.
        "Contributor" means each individual or legal entity that creates, contributes to the creation of, or
        owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others
        (if any) used by a Contributor and that particular Contributor's Contribution. 1.3. "Contribution" means
        Covered Software of a particular Contributor. 1.4. "Covered Software" means Source Code Form to which
        the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code
        Form, and Modifications of such""",
    "Apache-2.0-text": """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,
        REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use,
        reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall
        mean the copyright owner or entity authorized by the copyright owner that is granting the License.
        "Legal Entity" shall mean the union of the acting entity and all other entities that control, are
        controlled by, or are under common control with that entity. For the purposes of this definition,""",
}
#: What a find must hold besides its coverage: of each list one phrase, word for word and without a gap
#: (the license's name and version), so that a neighbour's notice never counts.
DECIDING = {
    "AGPL-3.0": [["gnu affero general public license"], ["version 3", "v3", "v 3", "license 3"]],
    "AGPL-3.0-notice": [["gnu affero general public license"], ["version 3", "v3", "v 3", "license 3"]],
    "Apache-2.0": [["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache license v2 0", "apache license v 2 0"]],
    "Apache-2.0-notice": [["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache license v2 0", "apache license v 2 0"]],
    "Apache-2.0-text": [["apache license version 2 0"]],
    "BSD-notice": [["bsd"]],
    "CC-BY-4.0": [["creative commons attribution 4 0"]],
    "CC-BY-4.0-notice": [["cc by 4 0"]],
    "CC-BY-NC-4.0": [["creative commons attribution noncommercial 4 0"]],
    "CC-BY-NC-4.0-notice": [["cc by nc 4 0"]],
    "CC-BY-NC-ND-4.0": [["creative commons attribution noncommercial noderivatives 4 0"]],
    "CC-BY-NC-ND-4.0-notice": [["cc by nc nd 4 0"]],
    "CC-BY-NC-SA-4.0": [["creative commons attribution noncommercial sharealike 4 0"]],
    "CC-BY-NC-SA-4.0-notice": [["cc by nc sa 4 0"]],
    "CC-BY-ND-4.0": [["creative commons attribution noderivatives 4 0"]],
    "CC-BY-ND-4.0-notice": [["cc by nd 4 0"]],
    "CC-BY-SA-4.0": [["creative commons attribution sharealike 4 0"]],
    "CC-BY-SA-4.0-notice": [["cc by sa 4 0"]],
    "CC0-1.0-notice": [["cc0"]],
    "EPL-2.0": [["eclipse public license"], ["license version 2 0", "license 2 0", "license v 2 0", "license v2 0"]],
    "EPL-2.0-notice": [["eclipse public license"], ["license version 2 0", "license 2 0", "license v 2 0", "license v2 0"]],
    "GPL-2.0": [["gnu general public license"], ["version 2", "v2", "v 2", "license 2"]],
    "GPL-2.0-notice": [["gnu general public license"], ["version 2", "v2", "v 2", "license 2"]],
    "GPL-2.0-text": [["gnu general public license"], ["version 2", "v2", "v 2", "license 2"]],
    "GPL-3.0": [["gnu general public license"], ["version 3", "v3", "v 3", "license 3"]],
    "GPL-3.0-notice": [["gnu general public license"], ["version 3", "v3", "v 3", "license 3"]],
    "GPL-3.0-text": [["gnu general public license"], ["version 3", "v3", "v 3", "license 3"]],
    "ISC-notice": [["isc"]],
    "LGPL-2.1": [["gnu lesser general public license"], ["version 2 1", "v2 1", "v 2 1", "license 2 1"]],
    "LGPL-2.1-notice": [["gnu lesser general public license"], ["version 2 1", "v2 1", "v 2 1", "license 2 1"]],
    "LGPL-2.1-text": [["gnu lesser general public license"], ["version 2 1", "v2 1", "v 2 1", "license 2 1"]],
    "LGPL-3.0": [["gnu lesser general public license"], ["version 3", "v3", "v 3", "license 3"]],
    "LGPL-3.0-notice": [["gnu lesser general public license"], ["version 3", "v3", "v 3", "license 3"]],
    "LGPL-3.0-text": [["gnu lesser general public license"], ["version 3", "v3", "v 3", "license 3"]],
    "MIT-notice": [["mit"]],
    "MPL-2.0": [["mozilla public license"], ["license version 2 0", "license 2 0", "license v 2 0", "license v2 0"]],
    "MPL-2.0-notice": [["mozilla public license"], ["license version 2 0", "license 2 0", "license v 2 0", "license v2 0"]],
    "MPL-2.0-text": [["mozilla public license"], ["license version 2 0", "license 2 0", "license v 2 0", "license v2 0"]],
}
COVERAGE = 0.75
SLACK = 1.5
WORD = re.compile(rb"[a-z0-9]+|[\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles, back links)."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[pile], last[pile] = v, i
        back[i] = last[pile - 1] if pile else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Patience alignment of two word lists: matched index pairs, increasing in both. Gaps wait on a
    list instead of the call stack, so long texts need no deep recursion."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b]
        if not anchors:
            continue  # nothing is unique in both: patience leaves the gap
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        pairs += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(ends, ends[1:], strict=False)]
    return sorted(pairs)


def decides(words: list[bytes], phrases: list[list[list[bytes]]]) -> bool:
    """Whether of each list a phrase lies in ``words`` without a gap."""
    line = b" %s " % b" ".join(words)
    return all(any(b" %s " % b" ".join(p) in line for p in some) for some in phrases)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, deciding: dict[str, list[list[str]]] = DECIDING):
        self.coverage = coverage
        self.templates = [(name, words, set(words), [[words_of(p) for p in some] for some in deciding.get(name, [])])
                          for name, t in sorted(templates.items()) if (words := words_of(t))]

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, coverage) of every stretch, by template and position."""
        words = words_of(text)
        have = set(words)
        out = []
        for name, template, distinct, phrases in self.templates:
            # each absent distinct word leaves at least one template word unmatched
            need = math.ceil(self.coverage * len(template) - 1e-9)
            if len(template) - len(distinct - have) < need:
                continue
            width = max(len(template) + 1, math.ceil(SLACK * len(template)))
            hits = [i for i, w in enumerate(words) if w in distinct]
            k = 0
            while k < len(hits):
                start = hits[k]
                if bisect_right(hits, start + width - 1) - k >= need:
                    pairs = align(template, words[start:start + width])
                    first, end = (start + pairs[0][1], start + pairs[-1][1] + 1) if pairs else (start, start)
                    # a version may stand in words the template does not have, just behind
                    if len(pairs) >= need and decides(words[first:end + 3], phrases):
                        out.append((name, first, end, len(pairs) / len(template)))
                        k = bisect_left(hits, end)
                        continue
                k += 1
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(id, license, coverage, n_found, spans), one row per input row. ``license`` is the find with the
    highest coverage (of equals the longest, then the first in the text; null without one); spans are
    ``template:first_word:end_word`` in order of the template's name. Null and empty texts find
    nothing; repeated rows each get their row; other columns are not read."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    scanner = Scanner(templates or TEMPLATES, coverage)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for start, part in text_chunks(batch.column(1).to_pylist()):
                found = [scanner.find(t) for t in part]
                best = [min(f, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])) if f else None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), pa.array([b and b[0] for b in best], pa.string()),
                     pa.array([b and b[3] for b in best], pa.float64()), pa.array([len(f) for f in found], pa.int64()),
                     pa.array([",".join(f"{n}:{a}:{b}" for n, a, b, _ in f) for f in found])],
                    ["id", "license", "coverage", "n_found", "spans"])

    schema = f"id {dict(rows.dtypes)['id']}, license string, coverage double, n_found long, spans string"
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
