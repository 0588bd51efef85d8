"""Licence scan by sentence rules: sentences are normalised and mapped to the identifiers of known licence sentences; sequences of identifiers are matched
against ordered licence rules.

All of it happens within a row, with columns and SQL functions only: nothing is shuffled, so a hot source or a group of copies is no one task's work. A text
with none of a few word stems, one of which each known sentence has, is not cut into sentences at all.

Notices stand on lines of their own, long licence texts are wrapped. Each text is therefore cut twice: at ends of lines, and with the lines of a paragraph
joined; what either way gives counts.
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of licences as they follow "licensed under the", normalised.
NAMES = {
    "mit license": "MIT",
    "mit no attribution license": "MIT-0",
    "apache license version 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache 2.0 license": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu lesser general public license version 2.1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "gnu free documentation license version 1.3": "GFDL-1.3",
    "mozilla public license version 1.1": "MPL-1.1",
    "mozilla public license version 2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0",
    "eclipse public license version 1.0": "EPL-1.0",
    "eclipse public license version 2.0": "EPL-2.0",
    "eclipse public license 2.0": "EPL-2.0",
    "european union public license version 1.2": "EUPL-1.2",
    "common development and distribution license version 1.0": "CDDL-1.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "boost software license version 1.0": "BSL-1.0",
    "isc license": "ISC",
    "zlib license": "Zlib",
    "postgresql license": "PostgreSQL",
    "artistic license 2.0": "Artistic-2.0",
    "sil open font license version 1.1": "OFL-1.1",
    "microsoft public license": "MS-PL",
    "cc0 1.0": "CC0-1.0",
    "cc by 4.0": "CC-BY-4.0",
    "cc by sa 4.0": "CC-BY-SA-4.0",
    "cc by nc 4.0": "CC-BY-NC-4.0",
    "cc by nd 4.0": "CC-BY-ND-4.0",
    "cc by nc sa 4.0": "CC-BY-NC-SA-4.0",
    "cc by nc nd 4.0": "CC-BY-NC-ND-4.0",
    "cc by sa 3.0": "CC-BY-SA-3.0",
    "creative commons attribution 4.0 international license": "CC-BY-4.0",
    "creative commons attribution sharealike 4.0 international license": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4.0 international license": "CC-BY-NC-4.0",
}

_MIT_RIGHTS = "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_LATER = "as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."

#: Sentences of licence texts and notices in their original wording, by identifier. One that the operator cuts has its parts numbered.
SENTENCES = {
    "mit-grant": f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software {_MIT_RIGHTS}, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit0-grant": f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software {_MIT_RIGHTS}.',
    "x11-name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "json-good": "The Software shall be used for Good, not Evil.",
    "ncsa-grant": f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software {_MIT_RIGHTS}, subject to the following conditions:',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib-thanks": "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-notice": "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "fsfap-grant": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved.",
    "artistic-notice": "This is free software, licensed under: The Artistic License 2.0.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License " + _LATER.format(",", "2"),
    "gpl2-later-cut": "you can redistribute it and/or modify it under the terms of the GNU General Public License " + _LATER.format(";", "2"),
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-only-cut": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License " + _LATER.format(",", "3"),
    "gpl3-later-cut": "you can redistribute it and/or modify it under the terms of the GNU General Public License " + _LATER.format(";", "3"),
    "lgpl21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _LATER.format(",", "2.1"),
    "lgpl21-later-cut": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _LATER.format(";", "2.1"),
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _LATER.format(",", "3"),
    "lgpl3-later-cut": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _LATER.format(";", "3"),
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + _LATER.format(",", "3"),
    "agpl3-later-cut": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + _LATER.format(";", "3"),
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "lgpl-copy": "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl11-notice": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl-notice": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "unlicense-head": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-warranty": "This software is distributed without any warranty.",
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}

#: Rules in the order in which they are tried, longer ones first: identifiers that follow each other, "?" after those that may lack, and the licence they are.
RULES = (
    ("mit-grant mit-notice json-good mit-warranty? mit-liability?", "JSON"),
    ("mit-grant mit-notice mit-warranty? mit-liability? x11-name", "X11"),
    ("mit-grant mit-notice mit-warranty? mit-liability?", "MIT"),
    ("mit0-grant mit-warranty? mit-liability?", "MIT-0"),
    ("isc-old mit-warranty mit-liability? x11-name", "curl"),
    ("isc-grant isc-warranty? isc-liability?", "ISC"),
    ("isc-old isc-warranty isc-liability?", "ISC"),
    ("0bsd-grant isc-warranty? isc-liability?", "0BSD"),
    ("ncsa-grant bsd-source? bsd-binary?", "NCSA"),
    ("bsd-grant bsd-source bsd-binary bsd-advert bsd-endorse bsd-warranty? bsd-liability?", "BSD-4-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-endorse bsd-warranty? bsd-liability?", "BSD-3-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-warranty? bsd-liability?", "BSD-2-Clause"),
    ("zlib-warranty zlib-liability zlib-grant zlib-origin? zlib-thanks? zlib-altered? zlib-notice?", "Zlib"),
    ("bsl-grant bsl-notice?", "BSL-1.0"),
    ("postgresql-grant", "PostgreSQL"),
    ("fsfap-grant", "FSFAP"),
    ("artistic-notice", "Artistic-2.0"),
    ("apache-head apache-comply? apache-copy? apache-url? apache-warranty? apache-see?", "Apache-2.0"),
    ("gpl2-later gpl-hope? gpl-details? gpl-copy?", "GPL-2.0-or-later"),
    ("gpl2-later-cut gpl-hope? gpl-details? gpl-copy?", "GPL-2.0-or-later"),
    ("gpl2-only gpl-hope? gpl-details? gpl-copy?", "GPL-2.0-only"),
    ("gpl2-only-cut gpl-hope? gpl-details? gpl-copy?", "GPL-2.0-only"),
    ("gpl3-later gpl-hope? gpl-details? gpl-copy?", "GPL-3.0-or-later"),
    ("gpl3-later-cut gpl-hope? gpl-details? gpl-copy?", "GPL-3.0-or-later"),
    ("lgpl21-later lgpl-hope? lgpl-details? lgpl-copy?", "LGPL-2.1-or-later"),
    ("lgpl21-later-cut lgpl-hope? lgpl-details? lgpl-copy?", "LGPL-2.1-or-later"),
    ("lgpl3-later lgpl-hope? lgpl-details? lgpl-copy?", "LGPL-3.0-or-later"),
    ("lgpl3-later-cut lgpl-hope? lgpl-details? lgpl-copy?", "LGPL-3.0-or-later"),
    ("agpl3-later gpl-hope? agpl-details? agpl-copy?", "AGPL-3.0-or-later"),
    ("agpl3-later-cut gpl-hope? agpl-details? agpl-copy?", "AGPL-3.0-or-later"),
    ("mpl2-notice mpl2-copy?", "MPL-2.0"),
    ("mpl11-notice apache-comply?", "MPL-1.1"),
    ("epl1-notice", "EPL-1.0"),
    ("epl2-notice", "EPL-2.0"),
    ("cddl-notice apache-comply?", "CDDL-1.0"),
    ("unlicense-head unlicense-grant?", "Unlicense"),
    ("cc0-notice cc0-warranty?", "CC0-1.0"),
    ("ofl-notice", "OFL-1.1"),
)

#: Licences whose tags say which versions, and other licences by tag alone.
VERSIONED = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
TAGS = (*[f"{spdx}-{which}" for spdx in VERSIONED for which in ("only", "or-later")], *sorted({spdx for _, spdx in RULES} - set(NAMES.values())))

#: Titles of licence texts, normalised, with their dates where they have such.
TITLES = {
    "mit license": "MIT",
    "the mit license": "MIT",
    "the mit license mit": "MIT",
    "apache license version 2.0 january 2004": "Apache-2.0",
    "apache license version 2.0 january 2004 www.apache.org licenses": "Apache-2.0",
    "gnu general public license version 2 june 1991": "GPL-2.0",
    "gnu general public license version 3 29 june 2007": "GPL-3.0",
    "gnu lesser general public license version 2.1 february 1999": "LGPL-2.1",
    "gnu lesser general public license version 3 29 june 2007": "LGPL-3.0",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3.0",
    "mozilla public license version 2.0": "MPL-2.0",
    "eclipse public license v 2.0": "EPL-2.0",
    "isc license": "ISC",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "boost software license version 1.0 august 17th 2003": "BSL-1.0",
}

#: Each known sentence has one of these. None has white space in it, which texts may wrap.
STEMS = ("licens", "licenc", "permi", "distribut", "warrant", "copyright", "unencumbered", "spdx", "liab", "software", "profits")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Normalising, in this order: marks of comments at the beginning of lines, quotes, then all ASCII but letters, digits and ends of sentences.
LEADERS = r"\n[ \t]*[/*#;%>!|-]+"
SPELLING = (("licence", "license"), ("https://", ""), ("http://", ""), ("spdx-license-identifier:", "spdx "), ("-or-later", " orlater"), *[(f"{x.lower()}+", f"{x.lower()} orlater") for x in VERSIONED])
OTHER = r"[\x00-\x09\x0B-\x20\x22-\x2D\x2F\x3C-\x3E\x40-\x60\x7B-\x7F“”‘’«»]+"
PARAGRAPH = r"\n *\n"
ENDS = r"[.!?:;]+( |\x01|$)"
#: Owners' names, which may look like the end of a sentence, and what is put for them.
OWNERS = (
    (r"neither the name of [^?!\n\x01]{1,100}? nor the names of its contributors", "neither the name of owner nor the names of its contributors"),
    (r"this software is provided by [^?!\n\x01]{1,100}? as is and any", "this software is provided by owner as is and any"),
    (r"in no event shall [^?!\n\x01]{1,100}? be liable for any direct", "in no event shall owner be liable for any direct"),
    (r"the name of [^?!\n\x01]{1,100}? shall not be used in advertising", "the name of owner shall not be used in advertising"),
    (r"prior written authorization (?:from|of) [^.?!\n\x01]{1,100}", "prior written authorization of owner"),
)
#: In a sentence the forms of a grant.
GRANT = r"^(?:(?:this|the) [a-z]+ (?:is|are) )?(?:dual )?(?:licensed|released|distributed|published|available|provided) under (?:the terms of )?(?:the |a )?"
#: In a grant: how a choice of licences begins, and how later versions are allowed.
CHOICE, LATER = r"^(?:either )?(?:of )?(?:the |a )?", r" or (?:at your option )?(?:any )?later(?: version)?"
#: Sentences that may stand between those of a rule.
IGNORED = r"^(?:.{0,3}|(?:c )?copyright .*|all rights reserved|this product includes software developed by .*)$"


def cut(text: str) -> list[str]:
    """The normalised sentences of a sentence of a licence, as ``scanned`` cuts them; those that may be anywhere are left out."""
    plain = re.sub(LEADERS, "\n", "\n" + text.translate(str.maketrans(UPPER, LOWER)))
    for a, b in SPELLING:
        plain = plain.replace(a, b)
    plain = re.sub(r"[ \n]+", " ", re.sub(OTHER, " ", plain))
    for a, b in OWNERS:
        plain = re.sub(a, b, plain)
    sentences = [re.sub(GRANT, "licensed under ", x.strip(" ")) for x in re.sub(ENDS, "\x01", plain).split("\x01")]
    return [x for x in sentences if not re.search(IGNORED, x)]


@cache
def parts() -> dict[str, list[str]]:
    """The identifiers of each of ``SENTENCES``: its own, or one for each part."""
    return {i: [i] if len(cut(text)) == 1 else [f"{i}.{n}" for n in range(1, len(cut(text)) + 1)] for i, text in SENTENCES.items()}


@cache
def known() -> dict[str, str]:
    """All known sentences and their identifiers: the texts above, and a grant of each licence by its name or its SPDX identifier. Of equal parts the first counts."""
    found: dict[str, str] = {}
    for i, text in SENTENCES.items():
        for part, sentence in zip(parts()[i], cut(text)):
            found.setdefault(sentence, part)
    grants = {f"licensed under {name}": f"is-{spdx}" for name, spdx in NAMES.items()}
    tags = {_tag(spdx): f"is-{spdx}" for spdx in (*NAMES.values(), *TAGS)}
    return {title: f"is-{spdx}" for title, spdx in TITLES.items()} | grants | tags | found


def _tag(spdx: str) -> str:
    return f"spdx {spdx.lower().replace('-or-later', ' orlater').replace('-', ' ')}"


@cache
def tagged() -> dict[str, str]:
    """The licences of tags, as they stand in an expression, and the old tags of versioned ones."""
    return {_tag(spdx).removeprefix("spdx "): spdx for spdx in (*NAMES.values(), *TAGS)}


@cache
def granted() -> dict[str, str]:
    """Names of licences in a grant, longer ones first, and with later versions before without."""
    later = {f"{name} orlater": f"{spdx}-or-later" for name, spdx in NAMES.items() if spdx in VERSIONED}
    return dict(sorted((later | NAMES).items(), key=lambda x: (-len(x[0]), x[0])))


def _literal(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _marks(licenses: Column) -> Column:
    """An identifier for each licence, a dash for nulls."""
    return F.array_join(F.transform(licenses, lambda x: F.coalesce(F.concat(F.lit("<is-"), x, F.lit(">")), F.lit("-"))), "")


def _expression(s: Column) -> Column:
    """The licences of a tag's expression, whichever way it joins them; exceptions after "with" go."""
    return _marks(F.transform(F.split(F.substring(s, F.lit(6), F.length(s)), " (?:or|and) "), lambda x: _literal(tagged())[F.split_part(x, F.lit(" with "), F.lit(1))]))


def _grant(s: Column) -> Column:
    """The licences that a grant names at its beginning or in a choice, what follows the names aside."""
    names = F.array(*map(F.lit, granted()))
    named = lambda x: F.get(F.filter(names, lambda n: F.startswith(F.concat(x, F.lit(" ")), F.concat(n, F.lit(" ")))), F.lit(0))
    rest = F.regexp_replace(F.regexp_replace(F.substring(s, F.lit(16), F.length(s)), LATER, " orlater"), CHOICE, "")
    found = F.filter(F.transform(F.split(rest, " or (?:the |a )?"), named), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, _marks(F.transform(found, lambda x: _literal(granted())[x]))).otherwise("-")


def rules() -> list[tuple[str, str]]:
    """Each rule as a pattern on sequences, and the licence."""
    same = lambda i: "".join(f"<{known()[x]}>" for x in cut(SENTENCES[i]))
    pattern = lambda word: f"(?:{same(word[:-1])})?" if word.endswith("?") else same(word)
    return [("".join(map(pattern, words.split())), spdx) for words, spdx in RULES]


def _sentences(plain: Column, joined: bool) -> Column:
    """The normalised sentences of a normalised text: of its lines, or of its paragraphs with the lines joined."""
    cut = F.regexp_replace(plain, PARAGRAPH, "\x01") if joined else F.translate(plain, "\n", "\x01")
    cut = F.regexp_replace(cut, r"[ \n]+", " ")
    for a, b in OWNERS:
        cut = F.regexp_replace(cut, a, b)
    return F.transform(F.split(F.regexp_replace(cut, ENDS, "\x01"), "\x01"), lambda s: F.regexp_replace(F.trim(s), GRANT, "licensed under "))


def _sequence(sentences: Column, table: dict[str, str]) -> Column:
    """``<id>`` for each known sentence, for each licence of a tag's expression and of a grant, a dash for others; sentences that may be anywhere are left out."""
    lookup = _literal(table)
    known_ = lambda s: F.concat(F.lit("<"), lookup[s], F.lit(">"))
    ids = F.transform(
        sentences,
        lambda s: F.when(s.isin(*table), known_(s)).when(s.rlike(IGNORED), "").when(s.startswith("spdx "), _expression(s)).when(s.startswith("licensed under "), _grant(s)).otherwise("-"),
    )
    return F.regexp_replace(F.array_join(ids, ""), "-+", "-")


def _matched(sequence: Column) -> Column:
    """The sequence with what each rule matches, in their order, put as ``{licence}``; last the grants by name or tag."""
    each = reduce(lambda s, r: F.regexp_replace(s, r[0], f"{{{r[1]}}}"), rules(), sequence)
    return F.regexp_replace(F.when(F.contains(sequence, F.lit("<")), each).otherwise(sequence), "<is-([^>]*)>", r"{$1}")


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, licenses, n_known, sequence, leftover``.

    ``licenses`` are the sorted distinct licences of the rules that match, ``n_known`` the number of known licence sentences, ``sequence`` what the rules
    make of the identifiers in the text's order (``{licence}``, ``<identifier>`` of a sentence no rule took, a dash for other
    sentences unless there are no others, nothing for copyright lines and those of up to three characters, such as numbering), ``leftover`` the
    identifiers no rule took. Null and empty texts have no sentences. Rows are judged one by one, so ties, repeated rows and null ids don't matter;
    columns other than ``doc_id`` and ``text`` are ignored. Long texts are scanned whole; an empty table gives an empty result.
    """
    table = known()
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    may = reduce(Column.__or__, [F.contains("low", F.lit(stem)) for stem in STEMS])
    plain = F.regexp_replace(F.concat(F.lit("\n"), F.when(may, F.translate("low", "\r", "")).otherwise("")), LEADERS, "\n")
    for a, b in SPELLING:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    plain = F.regexp_replace(plain, OTHER, " ")
    rows = docs.select("doc_id", low.alias("low")).select("doc_id", plain.alias("plain"))
    rows = rows.select("doc_id", *[_sequence(_sentences(F.col("plain"), j), table).alias(f"s{j:d}") for j in (False, True)])
    rows = rows.select("doc_id", "s0", "s1", _matched(F.col("s0")).alias("m0"), _matched(F.col("s1")).alias("m1"))
    found = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{([^}]*)\}"), 1))
    ids = lambda c: F.size(F.regexp_extract_all(c, F.lit("<[^>]*>"), 0))
    better = F.when(F.size(found("m1")) > F.size(found("m0")), F.lit(1)).when(F.size(found("m1")) < F.size(found("m0")), F.lit(0)).otherwise((ids("s1") > ids("s0")).cast("int"))
    rows = rows.select("doc_id", F.array_sort(F.array_union(found("m0"), found("m1"))).alias("licenses"), better.alias("better"), "s0", "s1", "m0", "m1")
    sequence = F.when(F.col("better") == 1, F.col("m1")).otherwise(F.col("m0"))
    sequence = F.when((F.greatest(ids("s0"), ids("s1")) == 0) & (sequence == "-"), "").otherwise(sequence)
    return rows.select("doc_id", "licenses", F.greatest(ids("s0"), ids("s1")).cast("long").alias("n_known"), sequence.alias("sequence"), F.regexp_extract_all(sequence, F.lit("<([^>]*)>"), 1).alias("leftover"))


def oracle_sql() -> str:
    """``scanned`` in DuckDB SQL, over all texts and with a join to the table of known sentences in place of stems and look-up."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    plain = "text_low"
    for a, b in SPELLING:
        plain = f"replace({plain}, {quoted(a)}, {quoted(b)})"
    values = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in known().items())
    matched, owned = "seq", "regexp_replace(t, '[ \\n]+', ' ', 'g')"
    for pattern, spdx in rules():
        matched = f"regexp_replace({matched}, {quoted(pattern)}, {quoted('{' + spdx + '}')}, 'g')"
    for pattern, put in OWNERS:
        owned = f"regexp_replace({owned}, {quoted(pattern)}, {quoted(put)}, 'g')"
    tags, names = ("MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in t.items()) + "}" for t in (tagged(), granted()))
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
lows AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
led AS (SELECT r, doc_id, regexp_replace(chr(10) || replace(low, chr(13), ''), {quoted(LEADERS)}, chr(10), 'g') AS text_low FROM lows),
plain AS (SELECT r, doc_id, regexp_replace({plain}, {quoted(OTHER)}, ' ', 'g') AS t FROM led),
ways AS (SELECT r, doc_id, 0 AS way, replace(t, chr(10), chr(1)) AS t FROM plain UNION ALL SELECT r, doc_id, 1, regexp_replace(t, {quoted(PARAGRAPH)}, chr(1), 'g') FROM plain),
owned AS (SELECT r, doc_id, way, {owned} AS t FROM ways),
cut AS (SELECT r, doc_id, way, string_split(regexp_replace(t, {quoted(ENDS)}, chr(1), 'g'), chr(1)) AS list FROM owned),
each AS (SELECT r, doc_id, way, unnest(list) AS s, unnest(range(len(list))) AS i FROM cut),
sentences AS (SELECT r, doc_id, way, i, regexp_replace(trim(s, ' '), {quoted(GRANT)}, 'licensed under ') AS s FROM each),
named AS (SELECT r, doc_id, way, i, CASE WHEN id IS NOT NULL THEN '<' || id || '>' WHEN regexp_matches(s, {quoted(IGNORED)}) THEN ''
  WHEN starts_with(s, 'spdx ') THEN array_to_string(list_transform(string_split_regex(substr(s, 6), ' (?:or|and) '), lambda x: coalesce('<is-' || {tags}[split_part(x, ' with ', 1)] || '>', '-')), '')
  WHEN starts_with(s, 'licensed under ') THEN coalesce(nullif(array_to_string(list_transform(string_split_regex(regexp_replace(regexp_replace(substr(s, 16), {quoted(LATER)}, ' orlater', 'g'), {quoted(CHOICE)}, ''), ' or (?:the |a )?'),
    lambda x: coalesce('<is-' || {names}[list_filter(map_keys({names}), lambda n: starts_with(x || ' ', n || ' '))[1]] || '>', '')), ''), ''), '-') ELSE '-' END AS mark FROM sentences LEFT JOIN known ON s = sentence),
raw AS (SELECT r, doc_id, way, sum(length(mark) - length(replace(mark, '<', '')))::BIGINT AS n, regexp_replace(string_agg(mark, '' ORDER BY i), '-+', '-', 'g') AS seq FROM named GROUP BY r, doc_id, way),
done AS (SELECT r, doc_id, way, n, regexp_replace({matched}, '<is-([^>]*)>', '{{\\1}}', 'g') AS m FROM raw),
found AS (SELECT *, list_distinct(regexp_extract_all(m, '\\{{([^}}]*)\\}}', 1)) AS l FROM done)
SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(l)))), ',') AS licenses, max(n) AS n_known,
       CASE WHEN max(n) = 0 AND arg_max(m, (len(l), n, 1 - way)) = '-' THEN '' ELSE arg_max(m, (len(l), n, 1 - way)) END AS sequence,
       array_to_string(regexp_extract_all(arg_max(m, (len(l), n, 1 - way)), '<([^>]*)>', 1), ',') AS leftover
FROM found GROUP BY r, doc_id"""
