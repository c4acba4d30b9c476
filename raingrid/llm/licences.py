"""Licences in documents: known sentences by identifier, then ordered rules over the identifiers. DataFrame functions only.

A text is cut into sentences in two ways, since a licence may be one line among others or wrapped over many:
at line ends and sentence ends, and at sentence ends and blank lines alone. A sentence is compared in lower
case with only letters and digits, by equality. A rule is a list of identifiers that must follow one another
in the sequence of sentences of one way of cutting. Rules for permissive licences, whose texts are lists of conditions, ask that no unknown
sentence stands between theirs: one more condition makes another licence. Other rules pass over unknown
sentences. A row is told by itself, without a shuffle or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, as they are cut and compared (lower case, other signs as one
# space). A sentence ends at a colon or semicolon before white space too, and at the point of "v. 2.0".
SENTENCES: dict[str, str] = {
    "mit_notice": "released under the mit license",
    "mit_notice_licensed": "licensed under the mit license",
    "mit_notice_this": "this project is licensed under the mit license",
    "mit_title": "mit license",
    "mit_the_title": "the mit license",
    "mit_title_paren": "the mit license mit",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_nor_names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_as_is": "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "json_good": "the software shall be used for good not evil",
    "gpl2_only_terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gnu_version_2": "version 2 of the license",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache_notice": "licensed under the apache license version 2 0",
    "apache_notice_the": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_copy_url": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl2_notice": "this work is licensed under the gnu general public license version 2",
    "gpl_see": "see the gnu general public license for more details",
    "lgpl_see": "see the gnu lesser general public license for more details",
    "agpl_see": "see the gnu affero general public license for more details",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "ccbync_notice": "licensed under cc by nc 4 0",
    "ccbyncsa_notice": "licensed under cc by nc sa 4 0",
    "ccbysa_notice": "licensed under cc by sa 4 0",
    "ccby_notice": "licensed under cc by 4 0",
    "ccbynd_notice": "licensed under cc by nd 4 0",
    "ccby_long": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa_long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync_long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0_long": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "rights_reserved": "all rights reserved",
    "apache_title": "apache license",
    "apache_version": "version 2 0 january 2004",
    "apache_title_block": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache_terms": "terms and conditions for use reproduction and distribution",
    "zero_bsd_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "boost_notice": "distributed under the boost software license version 1 0",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_origin": "the origin of this software must not be misrepresented",
    "zlib_claim": "you must not claim that you wrote the original software",
    "zlib_thanks": "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    "zlib_altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib_notice": "this notice may not be removed or altered from any source distribution",
    "epl1_notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl2_notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2_notice_http": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "epl1_title": "eclipse public license v 1 0",
    "epl2_title": "eclipse public license v 2 0",
    "epl_terms": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "wtfpl_title": "do what the fuck you want to public license",
    "wtfpl_terms": "terms and conditions for copying distribution and modification",
    "wtfpl_grant": "you just do what the fuck you want to",
    "gpl_title": "gnu general public license",
    "lgpl_title": "gnu lesser general public license",
    "agpl_title": "gnu affero general public license",
    "gnu_2_june_1991": "version 2 june 1991",
    "gnu_2_1_february_1999": "version 2 1 february 1999",
    "gnu_3_29_june_2007": "version 3 29 june 2007",
    "gnu_3_19_november_2007": "version 3 19 november 2007",
    "mpl_title": "mozilla public license version 2 0",
    "mpl_contributor": "means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "mpl_subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl_copy_https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "spdx": "spdx license identifier",
    **{f"gnu_free_{k}": f"this {k} is free software" for k in ("program", "library")},
    **{f"gnu_hope_{k}": f"this {k} is distributed in the hope that it will be useful but without any warranty" for k in ("program", "library")},
    **{
        f"{k}_terms{mark}": f"you can redistribute it and or modify it under the terms of the gnu {name}general public license as published by the free software foundation{end}"
        for k, name in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero "))
        for mark, end in (("", ""), *((f"_{v.replace(' ', '_')}", f" either version {v} of the license or at your option any later version") for v in ("2", "2 1", "3")))
    },
    **{f"gnu_either_{v.replace(' ', '_')}": f"either version {v} of the license or at your option any later version" for v in ("2", "2 1", "3")},
    "gnu_implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
}

# How sentences with a holder's name between begin and end. A name with a point ("Inc.") ends the sentence.
SLOTS: dict[str, tuple[str, str]] = {
    "bsd_names": ("neither the name of ", " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd_neither": ("neither the name of ", ""),
    "bsd_warranty": ("this software is provided by ", " as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    "bsd_provided_by": ("this software is provided by ", ""),
    "bsd_as_is": ("and ", " as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    "bsd_product": ("this product includes software developed by ", ""),
}

# Identifiers of the SPDX list, told where they follow "SPDX-License-Identifier:".
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
]
SENTENCES |= {f"spdx_{k.lower()}": k.lower().replace("-", " ").replace(".", " ") for k in SPDX}

# For each rule the licence it tells and the sentences that must follow one another, in order.
RULES: list[tuple[str, list[str]]] = [
    ("0BSD", ["zero_bsd_grant", "isc_warranty"]),
    ("AGPL-3.0", ["agpl_title", "gnu_3_19_november_2007"]),
    ("Apache-2.0", ["apache_notice"]),
    ("Apache-2.0", ["apache_notice_the", "apache_comply"]),
    ("Apache-2.0", ["apache_comply", "apache_unless", "apache_see"]),
    ("Apache-2.0", ["apache_title", "apache_version", "apache_terms"]),
    ("Apache-2.0", ["apache_title_block", "apache_terms"]),
    *((name, ["bsd_grant", "bsd_source", "bsd_binary", *more, *warranty])
      for name, more in (
          ("BSD-2-Clause", []), ("BSD-3-Clause", ["bsd_names"]), ("BSD-3-Clause", ["bsd_neither", "bsd_nor_names"]),
          ("BSD-4-Clause", ["bsd_advert", "bsd_product", "bsd_names"]), ("BSD-4-Clause", ["bsd_advert", "bsd_product", "bsd_neither", "bsd_nor_names"]))
      for warranty in (["bsd_warranty"], ["bsd_provided_by", "bsd_as_is"])),
    ("BSL-1.0", ["boost_grant"]),
    ("BSL-1.0", ["boost_notice"]),
    ("CC-BY-4.0", ["ccby_long"]),
    ("CC-BY-4.0", ["ccby_notice"]),
    ("CC-BY-NC-4.0", ["ccbync_long"]),
    ("CC-BY-NC-4.0", ["ccbync_notice"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa_notice"]),
    ("CC-BY-ND-4.0", ["ccbynd_notice"]),
    ("CC-BY-SA-4.0", ["ccbysa_long"]),
    ("CC-BY-SA-4.0", ["ccbysa_notice"]),
    ("CC0-1.0", ["cc0_long"]),
    ("EPL-1.0", ["epl1_notice"]),
    ("EPL-1.0", ["epl1_title", "epl_terms"]),
    ("EPL-2.0", ["epl2_notice"]),
    ("EPL-2.0", ["epl2_notice_http"]),
    ("EPL-2.0", ["epl2_title", "epl_terms"]),
    ("GPL-2.0-only", ["gpl2_only_terms"]),
    ("GPL-2.0-only", ["gpl_terms", "gnu_version_2"]),
    ("GPL-2.0", ["gpl2_notice"]),
    ("GPL-2.0", ["gpl_title", "gnu_2_june_1991"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("GPL-3.0", ["gpl_title", "gnu_3_29_june_2007"]),
    *((name, [f"gnu_free_{what}", *terms, f"gnu_hope_{what}", "gnu_implied", f"{k}_see"])
      for name, k, v in (("GPL-2.0-or-later", "gpl", "2"), ("GPL-3.0-or-later", "gpl", "3"), ("AGPL-3.0-or-later", "agpl", "3"), ("LGPL-2.1-or-later", "lgpl", "2_1"), ("LGPL-3.0-or-later", "lgpl", "3"))
      for what in ("program", "library")
      for terms in ([f"{k}_terms_{v}"], [f"{k}_terms", f"gnu_either_{v}"])),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("JSON", ["mit_grant", "mit_condition", "json_good", "mit_warranty", "mit_liability"]),
    ("LGPL-2.1", ["lgpl_title", "gnu_2_1_february_1999"]),
    ("LGPL-3.0", ["lgpl_title", "gnu_3_29_june_2007"]),
    ("MIT", ["mit_grant", "mit_condition", "mit_warranty", "mit_liability"]),
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_notice_licensed"]),
    ("MIT", ["mit_notice_this"]),
    *(("MPL-2.0", ["mpl_subject", copy]) for copy in ("mpl_copy", "mpl_copy_https")),
    ("MPL-2.0", ["mpl_title", "mpl_contributor"]),
    ("Unlicense", ["unlicense_free", "unlicense_anyone"]),
    ("WTFPL", ["wtfpl_title", "wtfpl_terms", "wtfpl_grant"]),
    ("Zlib", ["zlib_as_is", "zlib_liable", "zlib_grant", "zlib_origin", "zlib_claim", "zlib_thanks", "zlib_altered", "zlib_notice"]),
    *((k, ["spdx", f"spdx_{k.lower()}"]) for k in SPDX),
]

#: Licences whose rules of several sentences allow no other sentence between.
PERMISSIVE = {"0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "JSON", "MIT", "Zlib"}
UNKNOWN = "?"
_SPACE = r"[ \t\r\n]"


#: Marks for the end of a line alone and of a sentence, in lower-cased text, which has no such letters of its own; and the signs between them and a.
_LINE, _END, _SIGNS = "Y", "Z", "[\\]^_`"


def _sentences(plain: Column) -> Column:
    """An identifier for each sentence of a text of letters, digits, single spaces and marks of ends, in order; ``UNKNOWN`` for others, none for those that only number a clause."""
    names = F.create_map(*(F.lit(x) for k, s in SENTENCES.items() for x in (s, k)))

    def told(x: Column) -> Column:
        own = F.trim(x)
        out = F.when(own.isin(*SENTENCES.values()), F.element_at(names, own))
        for name, (opening, end) in SLOTS.items():
            out = out.when(own.startswith(opening) & own.endswith(end), name)
        return out.when(~own.rlike("^([0-9]+|[a-z]|[ivx]+)?$"), UNKNOWN)

    return F.array_compact(F.transform(F.split(plain, _END), told))


def licence_scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, licences, sentences)``, a row for each row.

    ``licences`` are the licences that rules tell, sorted, each once, with a comma between (empty: none);
    ``sentences`` counts the known sentences, by the way of cutting that finds more. Null and empty texts have
    none. A control character 1 ends a sentence. Every row is told by its own text alone: rows that repeat an id, and rows with a null one, too. Other
    columns are not looked at.
    """
    ends = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), rf"([.!?:;]){_SPACE}+", "$1\n\n")
    marked = F.regexp_replace(ends, rf"\n{_SPACE}*\n", _END)
    # signs become spaces first: a class of two ranges is matched several times faster than one of three
    signs = F.translate(marked, "\r\n\u0001" + _SIGNS, _LINE * 2 + _END + " " * len(_SIGNS))
    plain = docs.select("doc_id", F.regexp_replace(signs, f"[^0-9{_LINE}-z]+", " ").alias("plain"))
    cut = plain.select(
        "doc_id", _sentences(F.translate("plain", _LINE, _END)).alias("by_line"), _sentences(F.regexp_replace("plain", f"[ {_LINE}]+", " ")).alias("by_paragraph")
    )
    # a comma on each side of each identifier; rules can't reach from one way of cutting to the other
    whole = F.concat(F.lit(","), F.array_join("by_line", ","), F.lit(",;,"), F.array_join("by_paragraph", ","), F.lit(","))
    known = [F.array_remove(c, UNKNOWN) for c in ("by_line", "by_paragraph")]
    sequence = F.concat(F.lit(","), F.array_join(known[0], ","), F.lit(",;,"), F.array_join(known[1], ","), F.lit(","))
    most = F.greatest(*(F.size(c) for c in known))
    told = F.array(*(F.when(F.contains("whole" if name in PERMISSIVE and len(rule) > 1 else "sequence", F.lit(f",{','.join(rule)},")), F.lit(name)) for name, rule in RULES))
    return cut.select("doc_id", most.cast("long").alias("sentences"), sequence.alias("sequence"), whole.alias("whole")).select(
        "doc_id", F.when(F.col("sentences") > 0, F.array_join(F.array_sort(F.array_distinct(F.array_compact(told))), ",")).otherwise("").alias("licences"), "sentences"
    )


def op3_sentence_rules(spark, sf_dir: str) -> DataFrame:
    """The licences of all ``documents``."""
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The rules once more, as patterns over sequences of identifiers, written apart from RULES. In those of the first list an unknown sentence counts.
_STRICT_SQL = """
('0BSD', 'zero_bsd_grant,isc_warranty'), ('ISC', 'isc_grant,isc_warranty'),
('BSD-2-Clause', 'bsd_grant,bsd_source,bsd_binary,(bsd_warranty|bsd_provided_by,bsd_as_is)'),
('BSD-3-Clause', 'bsd_grant,bsd_source,bsd_binary,(bsd_names|bsd_neither,bsd_nor_names),(bsd_warranty|bsd_provided_by,bsd_as_is)'),
('BSD-4-Clause', 'bsd_grant,bsd_source,bsd_binary,bsd_advert,bsd_product,(bsd_names|bsd_neither,bsd_nor_names),(bsd_warranty|bsd_provided_by,bsd_as_is)'),
('MIT', 'mit_grant,mit_condition,mit_warranty,mit_liability'), ('JSON', 'mit_grant,mit_condition,json_good,mit_warranty,mit_liability'),
('Zlib', 'zlib_as_is,zlib_liable,zlib_grant,zlib_origin,zlib_claim,zlib_thanks,zlib_altered,zlib_notice')
"""
_LOOSE_SQL = """
('MIT', 'mit_notice(_licensed|_this)?'), ('WTFPL', 'wtfpl_title,wtfpl_terms,wtfpl_grant'), ('Unlicense', 'unlicense_free,unlicense_anyone'),
('Apache-2.0', 'apache_notice'), ('Apache-2.0', 'apache_notice_the,apache_comply'), ('Apache-2.0', 'apache_comply,apache_unless,apache_see'), ('Apache-2.0', '(apache_title,apache_version|apache_title_block),apache_terms'),
('BSL-1.0', 'boost_(grant|notice)'), ('CC0-1.0', 'cc0_long'), ('CC-BY-4.0', 'ccby_(long|notice)'), ('CC-BY-NC-4.0', 'ccbync_(long|notice)'), ('CC-BY-SA-4.0', 'ccbysa_(long|notice)'),
('CC-BY-NC-SA-4.0', 'ccbyncsa_notice'), ('CC-BY-ND-4.0', 'ccbynd_notice'),
('EPL-1.0', 'epl1_notice|epl1_title,epl_terms'), ('EPL-2.0', 'epl2_notice(_http)?|epl2_title,epl_terms'), ('MPL-2.0', 'mpl_subject,mpl_copy(_https)?|mpl_title,mpl_contributor'),
('GPL-2.0', 'gpl2_notice|gpl_title,gnu_2_june_1991'), ('GPL-3.0', 'gpl3_notice|gpl_title,gnu_3_29_june_2007'), ('GPL-2.0-only', 'gpl2_only_terms|gpl_terms,gnu_version_2'),
('LGPL-2.1', 'lgpl_title,gnu_2_1_february_1999'), ('LGPL-3.0', 'lgpl_title,gnu_3_29_june_2007'), ('AGPL-3.0', 'agpl_title,gnu_3_19_november_2007'),
('GPL-2.0-or-later', 'gnu_free_program,gpl_terms(_|,gnu_either_)2,gnu_hope_program,gnu_implied,gpl_see'), ('GPL-2.0-or-later', 'gnu_free_library,gpl_terms(_|,gnu_either_)2,gnu_hope_library,gnu_implied,gpl_see'),
('GPL-3.0-or-later', 'gnu_free_program,gpl_terms(_|,gnu_either_)3,gnu_hope_program,gnu_implied,gpl_see'), ('GPL-3.0-or-later', 'gnu_free_library,gpl_terms(_|,gnu_either_)3,gnu_hope_library,gnu_implied,gpl_see'),
('AGPL-3.0-or-later', 'gnu_free_program,agpl_terms(_|,gnu_either_)3,gnu_hope_program,gnu_implied,agpl_see'), ('AGPL-3.0-or-later', 'gnu_free_library,agpl_terms(_|,gnu_either_)3,gnu_hope_library,gnu_implied,agpl_see'),
('LGPL-2.1-or-later', 'gnu_free_program,lgpl_terms(_|,gnu_either_)2_1,gnu_hope_program,gnu_implied,lgpl_see'), ('LGPL-2.1-or-later', 'gnu_free_library,lgpl_terms(_|,gnu_either_)2_1,gnu_hope_library,gnu_implied,lgpl_see'),
('LGPL-3.0-or-later', 'gnu_free_program,lgpl_terms(_|,gnu_either_)3,gnu_hope_program,gnu_implied,lgpl_see'), ('LGPL-3.0-or-later', 'gnu_free_library,lgpl_terms(_|,gnu_either_)3,gnu_hope_library,gnu_implied,lgpl_see')
"""


def oracle() -> str:
    known = ", ".join(f"('{s}', '{k}')" for k, s in SENTENCES.items())
    spdx = ", ".join(f"('{n}', 'spdx,spdx_{n.lower()}')" for n in SPDX)
    slots = " ".join(f"WHEN plain LIKE '{a}%{b}' THEN '{k}'" for k, (a, b) in SLOTS.items())
    return rf"""
WITH known(plain, sentence) AS (VALUES {known}),
strict(licence, pattern) AS (VALUES {_STRICT_SQL}),
loose(licence, pattern) AS (VALUES {_LOOSE_SQL}, {spdx}),
e AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(coalesce(text, ''), '([.!?:;])[ 	
]+', '' || chr(10) || chr(10), 'g') AS t FROM documents),
ways AS (
  SELECT rid, 0 AS way, string_split(replace(replace(t, chr(13), chr(10)), chr(1), chr(10)), chr(10)) AS parts FROM e
  UNION ALL
  SELECT rid, 1, string_split(regexp_replace(t, '
[ 	
]*
', chr(1), 'g'), chr(1)) FROM e
),
parts AS (SELECT rid, way, generate_subscripts(parts, 1) AS place, unnest(parts) AS part FROM ways),
plains AS (SELECT rid, way, place, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS plain FROM parts),
found AS (
  SELECT rid, way, place, coalesce(sentence, CASE {slots} ELSE '?' END) AS sentence
  FROM plains LEFT JOIN known USING (plain) WHERE NOT regexp_full_match(plain, '([0-9]+|[a-z]|[ivx]+)?')
),
seq AS (
  SELECT rid, way, ',' || string_agg(sentence, ',' ORDER BY place) || ',' AS whole, ',' || string_agg(sentence, ',' ORDER BY place) FILTER (sentence <> '?') || ',' AS s,
         count(*) FILTER (sentence <> '?') AS n
  FROM found GROUP BY rid, way HAVING count(*) FILTER (sentence <> '?') > 0
),
told AS (
  SELECT DISTINCT rid, licence FROM seq JOIN strict ON regexp_matches(whole, ',(' || pattern || '),')
  UNION
  SELECT DISTINCT rid, licence FROM seq JOIN loose ON regexp_matches(s, ',(' || pattern || '),')
),
names AS (SELECT rid, string_agg(licence, ',' ORDER BY licence) AS licences FROM told GROUP BY rid),
most AS (SELECT rid, max(n) AS sentences FROM seq GROUP BY rid)
SELECT d.doc_id, coalesce(names.licences, '') AS licences, CAST(coalesce(most.sentences, 0) AS BIGINT) AS sentences
FROM e d LEFT JOIN names ON d.rid = names.rid LEFT JOIN most ON d.rid = most.rid
"""


ORACLE = oracle()
