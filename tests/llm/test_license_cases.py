"""Notices as they are written, with the licences expected of them; the operator and its SQL agree."""

import duckdb

from glosswright.llm import licenses

CASES = {
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "// SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "GPL-2.0",
    "/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) */": "GPL-2.0-only,MIT",
    "# SPDX-License-Identifier: LGPL-2.1+ AND MIT": "LGPL-2.1-or-later,MIT",
    "SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
    "SPDX-License-Identifier: GPL-3.0+": "GPL-3.0-or-later",
    "SPDX-License-Identifier: GPL-3.0-or-later OR Foo-1.0": "GPL-3.0-or-later",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR BSD-3-Clause": "BSD-3-Clause,GPL-2.0-or-later",
    "SPDX-License-Identifier: Foo-1.0": "",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
    "Licensed under the GNU General Public License, version 2 or any later version.": "GPL-2.0-or-later",
    "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under the terms of nothing in particular.": "",
    "MIT License\n\nCopyright (c) 2020 Somebody\n": "MIT",
    "The MIT License (MIT)\n": "MIT",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n": "GPL-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n": "GPL-3.0",
    "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n": "LGPL-3.0",
    "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n": "AGPL-3.0",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n": "Apache-2.0",
    "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n": "MPL-2.0",
    "The licence of this text is a matter of taste.": "",
    "My MIT License is old": "",
}


def test_notices(spark):
    rows = list(enumerate(CASES))
    docs = spark.createDataFrame([*rows, (99, None), (99, "")], "doc_id long, text string")
    got = {(x.doc_id, ",".join(x.licenses), x.n_known, x.sequence, ",".join(x.leftover)) for x in licenses.scanned(docs).collect()}
    assert {(i, found) for i, found, *_ in got} == {(i, CASES[t]) for i, t in rows} | {(99, "")}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert set(con.sql(licenses.oracle_sql()).fetchall()) == got
