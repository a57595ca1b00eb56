"""Operator 7 [native]: licence texts by the digest of their canonical form.

A text's canonical form is lower-cased, without copyright lines and "all rights
reserved", with equivalent spellings made one, and without anything but digits
and letters. Whole texts are joined to the known licences by the SHA-256 of that
form. Lines that name a licence are joined in the same way to the known notices.
The known table is fixed and small, so it is broadcast; nothing else is shuffled
but the notices found.

Null texts are empty. An empty canonical form matches nothing. Rows that share
an id have the notices of all of them. Empty tables give no rows.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licence_texts as texts

NO_ID = -(2**63)

# Public licence texts and notices, as published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: (licence, text): whole texts.
LICENCES = [
    ("MIT", _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC_GRANT + _ISC_KEEP + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + _ISC_KEEP + _ISC_END),
    ("0BSD", _ISC_GRANT + "." + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_HEADER),
    ("Artistic-1.0-Perl", texts.ARTISTIC_1_0),
    ("BSD-3-Clause", texts.BSD_REGENTS),
    ("CC0-1.0", texts.CC0_1_0),
    ("GFDL-1.2", texts.GFDL_1_2),
    ("GFDL-1.3", texts.GFDL_1_3),
    ("LGPL-3.0", texts.LGPL_3_0),
    ("MPL-1.1", texts.MPL_1_1),
    ("MPL-2.0", texts.MPL_2_0),
]
_END = "END OF TERMS AND CONDITIONS"
for _name, _text in [("Apache-2.0", texts.APACHE_2_0), ("GPL-1.0", texts.GPL_1_0), ("GPL-2.0", texts.GPL_2_0), ("GPL-3.0", texts.GPL_3_0), ("LGPL-2.0", texts.LGPL_2_0), ("LGPL-2.1", texts.LGPL_2_1)]:
    LICENCES += [(_name, _text), (_name, _text[:_text.index(_END) + len(_END)])]  # with and without the advice on how to apply it
#: (licence, line): notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]
#: (licence, further SPDX ids, names in a sentence): GNU licences have one name here, whether later versions are allowed or not.
NAMES = [
    ("Apache-1.1", [], ["the Apache License, Version 1.1", "the Apache Software License, Version 1.1"]),
    ("Apache-2.0", [], ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"]),
    ("MIT", [], ["the MIT License", "the MIT Licence (MIT)"]),
    ("MIT-0", [], ["the MIT No Attribution License"]),
    ("ISC", [], ["the ISC License"]),
    ("0BSD", [], ["the Zero-Clause BSD License", "the 0BSD License", "the BSD Zero Clause License"]),
    ("BSD-2-Clause", [], ["the BSD 2-Clause License", "the Simplified BSD License", "the 2-Clause BSD License"]),
    ("BSD-3-Clause", [], ["the BSD 3-Clause License", "the New BSD License", "the 3-Clause BSD License", "the Modified BSD License"]),
    ("BSD-4-Clause", [], ["the BSD 4-Clause License"]),
    ("Zlib", [], ["the zlib License"]),
    ("BSL-1.0", [], ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"]),
    ("Unlicense", [], ["the Unlicense"]),
    ("WTFPL", [], []),
    ("Artistic-1.0-Perl", [], ["the Artistic License"]),
    ("Artistic-2.0", [], ["the Artistic License 2.0", "the Artistic License, Version 2.0"]),
    ("EPL-1.0", [], ["the Eclipse Public License 1.0", "the Eclipse Public License, Version 1.0"]),
    ("EPL-2.0", [], ["the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0"]),
    ("EUPL-1.2", [], ["the European Union Public Licence 1.2", "the EUPL 1.2"]),
    ("MPL-1.1", [], ["the Mozilla Public License 1.1", "the Mozilla Public License, Version 1.1"]),
    ("MPL-2.0", ["MPL-2.0-no-copyleft-exception"], ["the Mozilla Public License 2.0", "the Mozilla Public License, Version 2.0", "the Mozilla Public License, v. 2.0"]),
    ("CC0-1.0", [], ["CC0 1.0", "CC0 1.0 Universal"]),
]
for _kind, _full, _versions in [("GPL", "General Public License", ["1.0", "2.0", "3.0"]), ("LGPL", "Library General Public License", ["2.0"]), ("LGPL", "Lesser General Public License", ["2.1", "3.0"]), ("AGPL", "Affero General Public License", ["3.0"]), ("GFDL", "Free Documentation License", ["1.1", "1.2", "1.3"])]:
    for _v in _versions:
        _short = _v.removesuffix(".0")
        _said = [f"the GNU {_full}{x}" for _n in dict.fromkeys([_short, _v]) for x in (f", version {_n}", f" version {_n}", f" v{_n}", f", version {_n} or later", f", version {_n} only")]
        NAMES.append((f"{_kind}-{_v}", [f"{_kind}-{_v}-only", f"{_kind}-{_v}-or-later"], [*_said, f"the {_kind}v{_short}", f"the GNU {_kind}v{_short}"]))
for _kind, _full in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]:
    for _v in ["3.0", "4.0"]:
        _port = "Unported" if _v == "3.0" else "International"
        NAMES.append((f"CC-{_kind}-{_v}", [], [f"CC {_kind} {_v}", f"a Creative Commons {_full} {_v} {_port} License", f"the Creative Commons {_full} {_v} {_port} License", f"Creative Commons {_full} {_v} {_port}"]))
for _name, _ids, _said in NAMES:
    NOTICES += [(_name, f"SPDX-License-Identifier: {x}") for x in (_name, *_ids)]
    NOTICES += [(_name, f"{x} under {y}.") for y in _said for x in ("Licensed", "Released", "Distributed", "This work is licensed", "This project is licensed", "This software is licensed", "This program is licensed", "This file is licensed")]
#: (pattern, replacement) in this order; both sides of a join go through them, so a rule may be coarse.
RULES = [
    (r"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|[0-9]{4}|by )|\(c\)|©)[^\n]*", "\n"),
    (r"all rights reserved", ""),
    (r"licenc", "licens"),
    (r"(artef)act", "artifact"),
    (r"([a-z])is(e|ed|es|ing|ation)([\x00-\x2F\x3A-\x60\x7B-\x7F]|$)", "$1iz$2$3"),
    (r"([a-z]{2})our(s|ed|able|ite|)([\x00-\x2F\x3A-\x60\x7B-\x7F]|$)", "$1or$2$3"),
    (r"judgement", "judgment"),
    (r"acknowledgement", "acknowledgment"),
    (r"(off|def)ence", "$1ense"),
    (r"catalogue", "catalog"),
    (r"programme", "program"),
    (r"whilst", "while"),
    (r"fulfill", "fulfil"),
    (r"https://", "http://"),
    (r"copyright owner", "copyright holder"),
    (r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ""),
]


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return out


def _known(spark: SparkSession, rows: list[tuple[str, str]], name: str) -> DataFrame:
    each = F.explode(F.from_json(F.lit(json.dumps([{name: licence, "text": text} for licence, text in rows])), f"array<struct<{name}:string,text:string>>"))
    return spark.range(1).select(each.alias("x")).select(F.col(f"x.{name}"), F.sha2(canonical(F.col("x.text")), 256).alias("digest")).distinct()


def scan(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: doc_id, canonical_sha256, licence (null if none), notices (array<string>, sorted)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(column), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    whole = rows.select("id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    whole = whole.join(F.broadcast(_known(spark, LICENCES, "licence")), "digest", "left")
    lines = rows.where(F.lower("text").contains("licen")).select("id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.lower("line").contains("licen"))
    found = lines.select("id", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(F.broadcast(_known(spark, NOTICES, "notice")), "digest")
    by_doc = found.groupBy("id").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    out = whole.join(by_doc, "id", "left")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("digest").alias("canonical_sha256"), "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def _sql_canonical(text: str) -> str:
    out, quote = f"lower({text})", "'"
    for pattern, to in RULES:
        pattern, to = pattern.replace("'", "''"), to.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', {'chr(10)' if to == chr(10) else quote + to + quote}, 'g')"
    return out


def _sql_known(rows: list[tuple[str, str]], name: str) -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in rows)
    return f"select distinct name as {name}, sha256({_sql_canonical('t')}) as digest from (values {values}) as v(name, t)"


def oracle_sql() -> str:
    return f"""
with whole as (select doc_id, sha256({_sql_canonical("coalesce(text, '')")}) as digest from documents),
known as ({_sql_known(LICENCES, 'licence')}), notes as ({_sql_known(NOTICES, 'notice')}),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
found as (select doc_id, string_agg(distinct notice, ',' order by notice) as notices from (select doc_id, sha256({_sql_canonical('line')}) as digest from lines where contains(lower(line), 'licen')) join notes using (digest) group by doc_id)
select w.doc_id, w.digest as canonical_sha256, known.licence as licence, coalesce(found.notices, '') as notices
from whole w left join known using (digest) left join found on w.doc_id = found.doc_id
"""
