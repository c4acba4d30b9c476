"""Each operator against a plain version on small tables, and on nulls, empty and long texts, repeats, empty tables and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from raingrid.llm import decontaminate, language, licences, minhash, packing, quality, sharding, toxicity, vectors, warc
from raingrid.llm.common import connected_components, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, component_id long, block long, rep long, digest string, shard int, length long, plain string, grade int"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang]) with columns of names that operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, 0.5, True, 9, 9, 9, "d", 9, 9, "p", 0) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


ODD = [(900, None), (901, ""), (902, "   \t\n"), (903, "one"), (904, words(30_000, 1)), (905, "ümläut ß ☃"), (906, "MIT License\r\n\r\nx\x00y"), (None, "no id at all here now")]


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- components


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.choice([0, 20, 50]))] + ([(100 + k, 101 + k) for k in range(12)] if seed else [])
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or any(x in f for f in edges if f[0] != f[1])}


# --- near duplicates


def plain_duplicates(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in ids}


def mutated(base, k, rng):
    w = base.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = "zz" + str(rng.randrange(1000))
    return " ".join(w)


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = words(rng.choice([6, 20, 80]), 100 + g)
        rows += [(10 * g + k + 1, mutated(base, rng.randint(0, 4), rng).upper() if k % 3 == 0 else mutated(base, rng.randint(0, 4), rng)) for k in range(9)]
    rows += [(500, "a b c"), (501, "A  b\tc"), (502, "a b"), (503, "x y z"), *[r for r in ODD if r[0]]]
    got = table(minhash.near_duplicates(documents(spark, [*rows, ODD[-1], (903, "one")])))
    want = plain_duplicates(rows)
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in want} == want
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in want)
    assert got[None]["component_id"] is None and not got[None]["kept"]


def test_near_duplicates_of_a_dense_group(spark):
    """Copies of copies, at all distances from one base: links that no star has are found by blocks."""
    rng = random.Random(8)
    base = words(60, 77)
    rows = [(k, mutated(base, rng.choice([1, 2, 3, 4]), rng)) for k in range(1, 260)]
    got = table(minhash.near_duplicates(documents(spark, rows)))
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in got} == plain_duplicates(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []
    assert [r["kept"] for r in minhash.near_duplicates(documents(spark, [(1, None)])).collect()] == [True]


def test_densified_bins_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    for size, both in ((8, 6), (40, 30), (400, 300)):
        values = []
        for _ in range(200):
            x = rng.permutation(np.unique(rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64) * np.uint64(2)))
            a, b = minhash.one_permutation([np.sort(x[:size]), np.sort(x[size - both :])])
            values.append((a == b).mean())
        assert abs(np.mean(values) - both / (2 * size - both)) < 0.03


# --- sharding


def test_shards(spark):
    rng = random.Random(2)
    rows = [(k, words(rng.randint(1, 60), rng.randrange(150))) for k in range(1, 400)] + [(1000 + k, "hot copy") for k in range(200)] + ODD
    got = sharding.shard_by_bytes(documents(spark, rows), 5).collect()
    assert len(got) == len(rows)
    by_text, sizes = {}, collections.Counter()
    texts = dict(rows)
    for r in got:
        text = texts[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 8 and r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        assert by_text.setdefault(text, r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    largest = max(sum(r["size"] for r in got if texts[r["doc_id"]] == t) for t in set(texts.values()))
    rest = [v for s, v in sizes.items() if s != by_text[words(30_000, 1)]]
    assert max(sizes.values()) == largest and max(rest) - min(rest) <= 16
    assert sharding.shard_by_bytes(documents(spark, []), 5).collect() == []


@pytest.mark.parametrize("parts", [2, 3, 24])
def test_differencing_is_a_partition(parts):
    rng = random.Random(parts)
    own = [[rng.randint(0, 1000) for _ in range(parts)] for _ in range(40)]
    sums = [0] * parts
    for v, p in zip(own, sharding.differencing(own, parts), strict=True):
        assert sorted(p) == list(range(parts))
        for a, b in zip(v, p, strict=True):
            sums[b] += a
    assert max(sums) - min(sums) < 400
    assert sharding.differencing([], parts) == []


def test_differencing_textbook():
    """8, 7, 6, 5, 4 in two parts: the classic differences leave 2."""
    places = sharding.differencing([[8], [7], [6], [5], [4]], 2)
    sums = [sum(v for v, (p,) in zip((8, 7, 6, 5, 4), places, strict=True) if p == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2


def plain_differencing(sizes, parts):
    """Karmarkar-Karp by its definition: lists of sums with trailing zeros, the two of largest spread added in opposite order."""
    held = [sorted([v] + [0] * (parts - 1), reverse=True) for v in sizes]
    while len(held) > 1:
        held.sort(key=lambda x: x[0] - x[-1])
        a, b = held.pop(), held.pop()
        held.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return held[0]


@pytest.mark.parametrize("parts", [2, 3, 7])
def test_differencing_against_its_definition(spark, parts):
    rng = random.Random(40 + parts)
    for _ in range(20):
        sizes = rng.sample(range(1, 10**6), rng.randint(1, 40))  # distinct, so that spreads hardly tie
        sums = [0] * parts
        for v, (p,) in zip(sizes, sharding.differencing([[v] for v in sizes], parts), strict=True):
            sums[p] += v
        assert sorted(sums, reverse=True) == plain_differencing(sizes, parts)
    # the operator over so few groups that they are one cell
    rows = [(k, "x" * n) for k, n in enumerate(rng.sample(range(1, 5000), 30))] + [(100 + k, "twice") for k in range(2)]
    sums = collections.Counter()
    for r in sharding.shard_by_bytes(documents(spark, rows), parts).collect():
        sums[r["shard"]] += r["size"]
    groups = collections.Counter()
    for _, t in rows:
        groups[t] += len(t) + 8
    assert sorted((sums[k] for k in range(parts)), reverse=True) == plain_differencing(list(groups.values()), parts)


# --- licences

MIT = """The MIT License

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
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licences(spark):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore."),
        (2, MIT),
        (3, "a table row\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
        (4, "Unless required, nothing. See the License for the specific language governing permissions and limitations under the License."),
        (5, "the mit license released under"),
        (1, "Some prose here.\nReleased under the MIT License.\nMore."),
        *ODD,
    ]
    got = licences.licence_scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    told = {r["doc_id"]: r["licences"] for r in got}
    assert (told[1], told[2], told[3], told[4], told[5]) == ("MIT", "MIT", "Apache-2.0,CC-BY-NC-4.0", "", "")
    assert told[900] == told[901] == told[904] == told[None] == ""
    # order matters: the same sentences the other way round are no licence
    turned = MIT.split("\n\n")
    assert table(licences.licence_scan(documents(spark, [(1, "\n\n".join([turned[0], turned[3], turned[2], turned[1]]))])))[1]["licences"] == ""
    assert licences.licence_scan(documents(spark, [])).collect() == []


def gnu(what, sign, licence, version):
    return (
        f"This {what} is free software{sign} you can redistribute it and/or modify\nit under the terms of the GNU {licence} as published by\nthe Free Software Foundation{';' if sign == ';' else ','} either version {version} of the License, or\n(at your option) any later version.\n\n"
        f"This {what} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n{'GNU ' + licence} for more details.\n"
    )


def test_licences_of_standard_notices(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    notices = {
        gnu("program", ":", "General Public License", "3"): "GPL-3.0-or-later",
        gnu("program", ";", "General Public License", "2"): "GPL-2.0-or-later",
        gnu("program", ":", "Affero General Public License", "3"): "AGPL-3.0-or-later",
        gnu("library", ";", "Lesser General Public License", "2.1"): "LGPL-2.1-or-later",
        gnu("program", ":", "Lesser General Public License", "3"): "LGPL-3.0-or-later",
        mpl: "MPL-2.0",
        mpl.replace("http:", "https:"): "MPL-2.0",
    }
    rows = [(k, v) for k, n in enumerate(notices) for v in [n]] + [(100 + k, "/*\n" + "\n".join(f" * {x}".rstrip() for x in n.splitlines()) + "\n */") for k, n in enumerate(notices)]
    got = table(licences.licence_scan(documents(spark, rows)))
    want = list(notices.values())
    assert [got[k]["licences"] for k in range(len(want))] == want
    one_line = [(k, " ".join(n.split())) for k, n in enumerate(notices)]
    assert [r["licences"] for r in sorted(licences.licence_scan(documents(spark, one_line)).collect(), key=lambda r: r["doc_id"])] == want
    # a notice without its first half tells no version
    assert table(licences.licence_scan(documents(spark, [(1, list(notices)[0].split("\n\n")[1])])))[1]["licences"] == ""
    assert [got[100 + k]["licences"] for k in range(len(want))] == want


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""


def test_every_rule_is_reached_by_the_cut(spark):
    """Each rule's sentences one after the other give its licence, an unknown one between only where the rule passes over such; in another order a rule of several doesn't."""
    said = licences.SENTENCES | {k: f"{a}the group{b}" for k, (a, b) in licences.SLOTS.items()}
    strict = [name in licences.PERMISSIVE and len(rule) > 1 for name, rule in licences.RULES]
    rows = [(k, ". \n".join(x for r in rule for x in ((said[r],) if strict[k] else (said[r], "some other words"))) + ".") for k, (_, rule) in enumerate(licences.RULES)]
    rows += [(2000 + k, ". \n".join(x for r in rule for x in (said[r], "some other words")) + ".") for k, (_, rule) in enumerate(licences.RULES) if strict[k]]
    rows += [(1000 + k, ". \n".join(said[r] for r in rule[1:] + rule[:1]) + ".") for k, (_, rule) in enumerate(licences.RULES) if len(rule) > 1]
    got = table(licences.licence_scan(documents(spark, rows)))
    for k, (name, rule) in enumerate(licences.RULES):
        assert name in got[k]["licences"].split(","), (name, rule)
        if len(rule) > 1:
            assert name not in got[1000 + k]["licences"].split(","), (name, rule)
        if strict[k]:
            assert name not in got[2000 + k]["licences"].split(","), (name, rule)


BSD = """Copyright (c) 2020, Example Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
NAMES = """
{k}. Neither the name of {holder} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ADVERT = """
3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
   This product includes software developed by the Example Group.
"""
ALL = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"


def test_one_more_condition_is_another_licence(spark):
    mit = "\n".join(licences.SENTENCES[k] + "." for k in ("mit_grant", "mit_condition", "mit_warranty", "mit_liability"))
    rows = {
        "BSD-2-Clause": BSD.format(more="", who=ALL),
        "BSD-3-Clause": BSD.format(more=NAMES.format(k=3, holder="Example Inc."), who=ALL),
        "BSD-3-Clause ": BSD.format(more=NAMES.format(k=3, holder="the Example Group"), who="EXAMPLE INC. AND CONTRIBUTORS"),
        "BSD-4-Clause": BSD.format(more=ADVERT + NAMES.format(k=4, holder="Example Inc."), who=ALL),
        "": BSD.format(more="\n3. You must send a postcard to the author.\n", who=ALL),
        "MIT": mit,
        "JSON": mit.replace("\nthe software is provided", "\nThe Software shall be used for Good, not Evil.\nthe software is provided"),
        " ": mit.replace("\nthe software is provided", "\nThe Software shall not be used on Mondays.\nthe software is provided"),
        "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "GPL-2.0-only ": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; version 2 of the License.",
    }
    df = licences.licence_scan(documents(spark, [(k, t) for k, t in enumerate(rows.values())]))
    got = {r["doc_id"]: r["licences"] for r in df.collect()}
    assert [got[k] for k in range(len(rows))] == [name.strip() for name in rows]
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_licence_texts_and_identifiers(spark):
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
    epl = 'Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION\n'
    texts = {ZLIB: "Zlib", " ".join(ZLIB.split()): "Zlib", apache: "Apache-2.0", gpl: "GPL-3.0", epl: "EPL-2.0", "# SPDX-License-Identifier: BSD-3-Clause\nimport x": "BSD-3-Clause", "// SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1-only", "spdx mit\nmit": ""}
    got = table(licences.licence_scan(documents(spark, list(enumerate(texts)))))
    assert [got[k]["licences"] for k in range(len(texts))] == list(texts.values())


def test_licences_row_by_row(spark):
    """Rows of one id, and of none, are told by their own text; the SQL agrees."""
    import duckdb

    rows = [(4, "nothing"), (4, MIT), (4, "Licensed under CC BY 4.0."), (None, "nothing"), (None, MIT), (4, MIT), (5, "x\u0001MIT License\u0001y"), (6, "All rights reserved."), *ODD]
    df = documents(spark, rows)
    plan = licences.licence_scan(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Generate", "Python", "Arrow", "Pandas"))
    got = sorted((tuple(r) for r in licences.licence_scan(df).collect()), key=str)
    assert [r for r in got if r[0] == 4] == [(4, "", 0), (4, "CC-BY-4.0", 1), (4, "MIT", 5), (4, "MIT", 5)]
    assert [r[1:] for r in got if r[0] is None] == [("", 0), ("", 0), ("MIT", 5)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(c.sql(licences.ORACLE).fetchall(), key=str) == got


# --- decontamination


def plain_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_against_all_alignments():
    rng = random.Random(5)
    stock = ["the", "tion", "ererth", "an", "ons", "ea", "hathe", "wh", "for", "ingly"]
    say = lambda n: " ".join(rng.choice(stock) + rng.choice(stock) for _ in range(n))
    for _ in range(60):
        item = say(rng.randint(2, 12))
        s = list(item)
        for _ in range(rng.randint(0, max(1, len(item) // 10))):
            q = rng.randrange(len(s))
            kind = rng.random()
            s[q : q + (kind >= 0.4)] = rng.choice("abcé") if kind < 0.7 else ""
        text = decontaminate.normalise(f"{say(15)} {''.join(s)} {say(15)}")
        index = decontaminate.benchmark_index([(1, item)])
        found = decontaminate.search(index, [text, "x"])
        least = plain_edits(item, text)
        assert bool(found[0]) == (least <= index.patterns[0].edits) and not found[1]
        if found[0]:
            _, edits, start, stop = found[0][0]
            assert edits == least == plain_edits(item, text[start:stop])


def test_passages_in_documents(spark):
    item = words(40, 9)
    changed = item[:50] + "Q" + item[51:120] + item[122:]
    rows = [(1, f"before\n{item.upper()}  after"), (2, f"x {changed} y"), (3, words(200, 10)), (4, item[: len(item) // 2]), (5, f"{words(30_000, 4)} {item}"), *ODD]
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, "zzq", 1), (None, "zz", 1), (11, words(400, 12), 1)], "item_id long, text string, start long")
    got = decontaminate.find_passages(documents(spark, rows), bench).collect()
    texts = dict(rows)
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 7), (2, 7), (5, 7)}
    assert decontaminate.normalise(texts[1][[r for r in got if r["doc_id"] == 1][0]["start"] : [r for r in got if r["doc_id"] == 1][0]["stop"]]) == item
    long = decontaminate.find_passages(documents(spark, [(1, words(400, 12)[300:1500])]), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in long] == [(1, 11)]
    assert decontaminate.find_passages(documents(spark, []), bench).collect() == []
    assert decontaminate.find_passages(documents(spark, rows), bench.limit(0)).collect() == []


def test_excerpts_of_longer_items(spark):
    items = {1: words(95, 21)[:460], 2: words(400, 22), 3: words(30, 23)}
    enough = decontaminate.PASSAGE + decontaminate.STRIDE - 1
    rows = [(10 * k + j, f"{words(60, 30 + k)} {t[at : at + enough + 60].strip()} {words(60, 40 + k)}") for k, t in items.items() if k < 3 for j, at in enumerate((0, 37, len(t) // 3, len(t) - enough - 60))]
    rows += [(100, f"{words(50, 51)} {items[1]} x"), (101, f"{words(50, 52)} {items[1][100:200]} {words(50, 53)}"), (102, items[3][: len(items[3]) // 2])]
    got = decontaminate.find_passages(documents(spark, rows), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i // 10) for i, _ in rows if i < 100} | {(100, 1)}
    # an item that stands there whole is told whole, not by a window
    (whole,) = [r for r in got if r["doc_id"] == 100]
    assert dict(rows)[100][whole["start"] : whole["stop"]] == decontaminate.normalise(items[1]) and whole["edits"] == 0


def test_items_with_a_shared_opening_take_bounded_time():
    """Every item that begins alike is a candidate wherever a document has that beginning; they are aligned at once."""
    import time

    opening = words(14, 70)[:57]
    items = [(k, f"{opening} {words(rng_words, 700 + k)}") for k in range(200) for rng_words in [8 + k % 20]]
    index = decontaminate.benchmark_index(items)
    s = decontaminate.normalise(items[3][1])
    changed = s[:70] + "#" + s[71:80] + s[81:]
    text = decontaminate.normalise(" ".join(f"{opening} {words(3, 900 + k)}" for k in range(80)) + f" {changed} " + items[17][1])
    began = time.perf_counter()
    found = decontaminate.search(index, [text])
    assert time.perf_counter() - began < 4
    # plain: the items found are those with a place within their edits
    want = {k for k, t in items if k in (3, 17) or plain_edits(decontaminate.normalise(t), text[-700:]) <= index.patterns[k].edits}
    assert {3, 17} <= {i for i, *_ in found[0]} and {i: e for i, e, _, _ in found[0]}[3] == 2
    for item, edits, start, stop in found[0]:
        assert edits == plain_edits(decontaminate.normalise(dict(items)[item]), text[start:stop]) <= index.patterns[item].edits
    assert want <= {i for i, *_ in found[0]}


def test_passages_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    items = [(k, words(20, 50 + k)) for k in range(8)]
    rows = [(k, f"{words(9, k)} {t}") for k, t in items]
    got = decontaminate.find_passages(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k, _ in items}


def test_blocks_of_the_benchmark_change_no_row(spark, monkeypatch):
    items = [(k, words(20, 50 + k)) for k in range(5)] + [(1, words(80, 70)), (2, "qqq"), (3, words(20, 50)), (2, words(90, 71))]
    both = f"{items[0][1]} x {items[5][1][:260]} qqq {items[1][1]}"
    rows = [(None, f"a {items[0][1]}"), (None, f"b {items[0][1]} {items[1][1]}"), (5, both), (5, both), (5, items[4][1]), (6, f"{items[8][1][:250]} qqq"), (7, None), (8, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_passages(documents(spark, rows), table).collect()), key=str)
    assert len(whole) > 10 and sum(r[0] is None for r in whole) >= 3
    for chars in (40, 300, 700):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        assert sorted(map(tuple, decontaminate.find_passages(documents(spark, rows), table).collect()), key=str) == whole


# --- packing


def plain_best_two(counts, capacity):
    left, out = dict(counts), []
    there = lambda: sorted((x for x, n in left.items() if n > 0), reverse=True)
    while there():
        own, gap = [], capacity
        while fits := [x for x in there() if x <= gap]:
            own.append(fits[0])
            left[fits[0]] -= 1
            gap -= fits[0]
        if gap and len(own) > 1:
            pairs = [(x + y, x, y) for x in there() for y in there() if y <= x and (x != y or left[x] > 1) and own[-1] < x + y <= gap + own[-1]]
            if pairs:
                _, x, y = max(pairs)
                left[own[-1]] += 1
                own[-1:] = [x, y]
                left[x] -= 1
                left[y] -= 1
        out.append(own)
    return out


def test_bins_planned_at_once_are_the_bins_one_by_one():
    rng = random.Random(0)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        assert [b for b, n in packing.best_two_fit(counts, capacity) for _ in range(n)] == plain_best_two(counts, capacity)


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.word_tokenizer())
    rows = [(k, words(k % 70, k)) for k in range(1, 200)] + ODD + [(903, "one")]
    got = packing.pack(documents(spark, rows), packing.word_tokenizer(), 64).collect()
    want = []
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=key) == sorted(want, key=key)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    assert len(by) <= 1.02 * sum(r["length"] for r in got) / 64 + 1
    assert packing.pack(documents(spark, []), packing.word_tokenizer(), 64).collect() == []


def test_word_tokens_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(packing.word_tokenizer()), packing.WordTokens(packing.word_tokenizer())
    rng = random.Random(1)
    letters = "aAbB.,'!sStT J̌ǰΣς éÉÿŸȳ\x1c\x85 \xa0\n\t19中文İẞﬁ​ʼn_"
    for _ in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", " don't stop", " É.", " x..", "Éa!,"])
        assert own.encode([s])[0].tolist() == whole.encode(s, add_special_tokens=False).ids


def test_words_are_kept_from_task_to_task(monkeypatch):
    import pyarrow as pa

    made, path = [], packing.word_tokenizer()

    class Counted(packing.WordTokens):
        def __init__(self, path):
            made.append(path)
            super().__init__(path)

    monkeypatch.setattr(packing, "WordTokens", Counted)
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["Nolvaq nolvaq, BREZIL", None])], ["doc_id", "text"])
    first, second = ([b.to_pylist() for b in packing._cut(path, 64)(iter([batch]))] for _ in range(2))
    assert first == second and len(made) <= 1


def test_parts_of_words_are_bounded(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KEPT_PARTS", 7)
    whole, own, rng = Tokenizer.from_file(packing.word_tokenizer()), packing.WordTokens(packing.word_tokenizer()), random.Random(2)
    stems = ["".join(rng.choice("abdeéñßÿơ") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    for _ in range(60):
        s = " ".join(rng.choice([str.upper, str.title, str])(rng.choice(stems)) + rng.choice(["", "", "!", "...", "#*"]) for _ in range(12))
        assert own.encode([s])[0].tolist() == whole.encode(s, add_special_tokens=False).ids
        assert len(own.parts) <= 7 and len(own.older) <= 7


# --- archives


def test_archives(spark):
    import base64

    pages = [(k, f"http://x/{k}", f"<html>{words(40, k % 30)}</html>") for k in range(120)] + [(500, None, None), (501, "u", ""), (502, "a\nb", "ü☃"), (503, "l", "x" * 300_000), (None, "n", "only here"), (504, "same", "<p>twice</p>"), (504, "same", "<p>twice</p>")]
    df = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, size int")
    written = warc.write_archives(df, scratch(spark, "warc"))
    got = warc.read_archives(written).collect()
    assert len(got) == len(pages)
    html = {p[0]: (p[2] or "").encode() for p in pages}
    chosen = {}
    for k, _, h in pages:
        if k is not None:
            chosen[h or ""] = max(chosen.get(h or "", -1), k)
    for r in got:
        body = html[r["page_id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = chosen.get(body.decode(), None)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))
    # each reference names one record, which has the payload
    records = {r["record_id"]: r for r in got}
    assert len(records) == len(got) and any(r["refers_to_record"] for r in got)
    for r in got:
        if r["record_type"] == "revisit":
            assert (target := records[r["refers_to_record"]])["record_type"] == "response" and target["payload_digest"] == r["payload_digest"] and target["page_id"] == r["refers_to"]
    least = warc.read_archives(warc.write_archives(df, scratch(spark, "warc"), least_bytes=10_000)).collect()
    assert {r["record_type"] for r in least} == {"response"}
    assert warc.read_archives(warc.write_archives(df.limit(0), scratch(spark, "warc"))).collect() == []


def test_archive_records_stand_alone(spark):
    import struct

    import zstandard

    pages = spark.createDataFrame([(k, f"u{k}", words(60, k)) for k in range(80)], "page_id long, url string, html string")
    row = warc.write_archives(pages, scratch(spark, "warc")).filter("page_id = 17").first()
    system, name = warc._open(row["path"])
    data = system.open_input_stream(name, compression=None).read()
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    unpack = zstandard.ZstdDecompressor(dict_data=warc._dictionary(data[8 : 8 + n]))
    record = warc.parse_record(unpack.decompress(data[row["offset"] : row["offset"] + row["length"]]))
    assert record["body"] == words(60, 17).encode() and record["warc-type"] == "response"


# --- vectors


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(k, [float(v) for v in (base[k % 60] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])).astype(np.float32)], int(k % 3 == 0)) for k in range(600)]
    rows += [(700 + k, rows[0][1], rows[0][2]) for k in range(50)]
    rows += [(800, None, 1), (801, [], 1), (802, [0.0] * 16, 1), (803, [float("nan")] * 16, 1), (804, [None] * 16, 1), (805, [float("inf")] + [1.0] * 15, 1), (806, rows[0][1], None), (807, [1.0] * 4, 1), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep int, list int")
    got = table(vectors.near_vectors(df), "vec_id")
    good = [r for r in rows if r[0] is not None and r[0] < 800]
    e = np.array([r[1] for r in good], np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    labels, ids = np.array([r[2] for r in good]), np.array([r[0] for r in good])
    linked = (e @ e.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    low = ids.copy()
    for _ in range(40):
        low = np.minimum(low, np.where(linked, low[None, :], 10**9).min(axis=1))
    found = np.array([got[i]["n_links"] for i in ids])
    assert found.sum() >= 0.999 * linked.sum() and (found <= linked.sum(1)).all()
    if (found == linked.sum(1)).all():
        assert [got[i]["component_id"] for i in ids] == low.tolist()
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(800, 808))
    assert got[None]["n_links"] == 0 and not got[None]["kept"]
    assert len(got) == len(rows)
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_vectors_of_dense_groups_with_a_border_between(spark):
    rng = np.random.default_rng(8)
    size, dim = 400, 64
    for cosine in (0.94, 0.96):
        centre = np.zeros((2, dim))
        centre[:, 0], centre[0, 1], centre[1, 1] = np.sqrt((1 + cosine) / 2), np.sqrt((1 - cosine) / 2), -np.sqrt((1 - cosine) / 2)
        e = (centre.repeat(size, axis=0) + rng.normal(size=(2 * size, dim)) * 0.002).astype(np.float32)
        x = e.astype(np.float64) / np.linalg.norm(e.astype(np.float64), axis=1, keepdims=True)
        # two lists: k-means has a centroid on each group
        index = vectors.Index(x, 2)
        own = vectors._nearest(x, index.coarse)
        probes = index.probes(x, own)[np.arange(2 * size)[:, None], own[None, :]]
        linked = x @ x.T >= 0.93
        assert not (linked & ~probes & ~probes.T).any() and (own[:size] != own[size:]).all()
        got = table(vectors.near_vectors(spark.createDataFrame([(k, v, 1) for k, v in enumerate(e.tolist())], "vec_id long, embedding array<float>, label int")), "vec_id")
        assert [got[k]["n_links"] for k in range(2 * size)] == (linked.sum(1) - 1).tolist()
        assert {r["component_id"] for r in got.values()} == {0}


def plain_vectors(rows, least=0.93):
    """Links and component of each row ``(vec_id, vector, label)`` in order, by all pairs of equal label and width."""
    n = len(rows)
    links, low = np.zeros(n, int), [r[0] for r in rows]
    pairs = []
    for a in range(n):
        for b in range(a + 1, n):
            x, y = (np.array(rows[k][1], np.float32).astype(np.float64) for k in (a, b))
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= least * np.sqrt((x @ x) * (y @ y)):
                pairs.append((a, b))
    for _ in range(n):
        before = list(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return sorted(zip((r[0] for r in rows), links.tolist(), low, strict=True))


def test_vectors_of_several_widths_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    rows = []
    for width in (3, 4, 16):
        base = rng.normal(size=(8, width))
        rows += [(len(rows) + k, (base[k % 8] + rng.normal(size=width) * 0.1).astype(np.float32).tolist(), k % 2) for k in range(60)]
    # ids that are there again with another vector, with the same one, and with another label or width
    rows += [(5, rows[9][1], rows[9][2]), (5, rows[100][1], 1), (7, rows[7][1], rows[7][2]), (200, rows[100][1], 1), (5, rows[9][1], 1 - rows[9][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for least_width_rows in (0, 2_048):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, least_width_rows=least_width_rows).collect())
        assert got == plain_vectors(rows)


def test_vectors_of_large_groups_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(12, 8))
    rows = [(k, (base[k % 12] + rng.normal(size=8) * rng.choice([0.05, 0.3])).astype(np.float32).tolist(), k % 2) for k in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain_vectors(rows)
    for least_width_rows in (0, 2_048):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, split_rows=40, part_rows=16, least_width_rows=least_width_rows).collect())
        assert got == want


def test_table_distances_bound_true_distances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.Index(x, 6)
    own, codes, lost = index.encode(x)
    for at in range(6):
        mine = own == at
        far = np.sqrt(((x[:50, None] - x[mine][None]) ** 2).sum(2))
        assert (np.abs(index.table_distances(x[:50], at, codes[mine]) - far) <= lost[mine][None] + 1e-9).all()


# --- classifiers


def test_language(spark):
    stock = {"en": ["the", "thing", "with", "ation"], "de": ["der", "schön", "über", "keit"], "fr": ["le", "été", "eaux", "où"]}
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(stock[x]) + rng.choice(stock[x]) for _ in range(20)), x) for k in range(400) for x in [rng.choice(list(stock))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, rows[0][1], None), (None, rows[0][1], "en"), (1004, words(30_000, 2), None)]
    docs = documents(spark, rows)
    got = language.language_id(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [(by[i]["lang_pred"], x) for i, _, x in rows[:400] if by[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and len(held) > 50
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows[:400])
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == rows[0][2]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.language_id(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_temperature_is_fitted():
    rng = np.random.default_rng(2)
    model = language.LanguageModel(["a", "b"], np.ones(1 << language.BITS))
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    model.calibrate(np.stack((np.zeros(4000), 3 * z), axis=1), y)
    assert abs(model.temperature - 3) < 0.4


def test_ftrl_against_a_plain_version():
    """Each weight by the formulas of follow-the-regularised-leader, one number at a time."""
    rng = np.random.default_rng(5)
    idf = rng.uniform(1, 3, 6)
    model = language.LanguageModel(["a", "b", "c"], idf)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, k):
        if abs(z[i, k]) <= language.L1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * language.L1) / ((language.BETA + n[i, k] ** 0.5) / language.ALPHA + language.L2)

    for _ in range(60):
        places = np.sort(rng.choice(6, rng.integers(1, 6), replace=False))
        counts, label = rng.integers(1, 9, len(places)), int(rng.integers(3))
        model.learn(places, counts, label)
        x = {int(i): (1 + np.log(c)) * idf[i] for i, c in zip(places, counts, strict=True)}
        norm = sum(v * v for v in x.values()) ** 0.5
        x = {i: v / norm for i, v in x.items()} | {6: 1.0}
        scores = [sum(weight(i, k) * v for i, v in x.items()) for k in range(3)]
        p = np.exp(scores) / np.exp(scores).sum()
        old = {(i, k): weight(i, k) for i in x for k in range(3)}
        for i, v in x.items():
            for k in range(3):
                g = v * (p[k] - (k == label))
                z[i, k] += g - ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / language.ALPHA * old[i, k]
                n[i, k] += g * g
    model.close()
    assert np.allclose(model.w, [[weight(i, k) for k in range(3)] for i in range(7)]) and (model.w == 0).any() and (model.w != 0).any()


def test_ngram_counts_against_a_plain_count():
    import pyarrow as pa

    from raingrid.llm import textkit

    own = ["Aber", None, "", "ß☃x", words(200, 5), "aa" * 40, "b"] * 3
    place = {}
    for start, end, told, doc, at, count in textkit.ngram_counts(pa.array(own), (1, 2, 3), 15, lower=True):
        assert told == [t or "" for t in own[start:end]]
        for k in range(end - start):
            text = (own[start + k] or "").lower()
            want = collections.Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))
            got = dict(zip(at[doc == k].tolist(), count[doc == k].tolist(), strict=True))
            # equal n-grams have one place, and the counts of a place are those of its n-grams
            for gram in want:
                if gram not in place:
                    (_, _, _, _, one, c), *_ = textkit.ngram_counts(pa.array([gram]), (len(gram),), 15, lower=True)
                    place[gram] = int(one[0])
            by = collections.Counter()
            for gram, n in want.items():
                by[place[gram]] += n
            assert got == dict(by)


def test_only_unicode_letters_are_letters():
    import pyarrow as pa

    model = language.LanguageModel(["x"], np.ones(1 << language.BITS)).close()
    names, scores = model.predict(pa.array(["²½", "Ⅷ①", "١٢", "_-!", "5 km", "ʰ", "中", None, ""]))
    assert names == ["und"] * 4 + ["x"] * 3 + ["und"] * 2 and [s for s, n in zip(scores, names, strict=True) if n == "und"] == [0.0] * 6


def slope(loss, at, step=1e-6):
    """The gradient of a function of a vector, by central differences."""
    out = np.zeros(len(at))
    for k in range(len(at)):
        e = np.zeros(len(at))
        e[k] = step
        out[k] = (loss(at + e) - loss(at - e)) / (2 * step)
    return out


def test_ordinal_fit_against_numerical_gradients(monkeypatch):
    """The first steps of the fit, with the gradient of the plain weighted likelihood by differences."""
    from raingrid.llm.sampling import Rows

    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5)).astype(np.float32).astype(float)
    grade, weight = rng.integers(0, 4, 40), rng.uniform(0.5, 2, 40)
    monkeypatch.setattr(quality, "ROUNDS", 4)
    model = quality.Ordinal(4, 5)
    start = model.thresholds.copy()
    model.fit(Rows.of_lists([np.arange(5)] * 40, list(x), 5), grade, weight)

    def thresholds(s):
        return s[0] + np.concatenate(([0], np.cumsum(np.exp(s[1:]))))

    def loss(v):
        t = np.concatenate(([-np.inf], thresholds(v[5:]), [np.inf]))
        z = x @ v[:5]
        p = 1 / (1 + np.exp(t[grade] - z)) - 1 / (1 + np.exp(t[grade + 1] - z))
        return -(weight / weight.sum() * np.log(p)).sum() + quality.L2 / 2 * (v[:5] ** 2).sum()

    v = np.concatenate((np.zeros(5), start[:1], np.log(np.diff(start))))
    first, second = np.zeros(8), np.zeros(8)
    for t in range(1, 5):
        g = slope(loss, v)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        v = v - quality.RATE * np.where(np.arange(8) < 5, 4, 1) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(model.w, v[:5], atol=1e-4) and np.allclose(model.thresholds, thresholds(v[5:]), atol=1e-4)


def test_toxicity_fit_against_numerical_gradients(monkeypatch):
    """The first steps of the fit, with the gradient of the plain loss (with swapped texts written out) by differences."""
    import pyarrow as pa

    from raingrid.llm.sampling import Rows

    texts = [f"{a} {b} {c}" for a in ("muslim", "jewish", "tree") for b in ("vile", "nice") for c in ("cat", "dog", "sun")]
    label = np.array([int("vile" in t) for t in texts], float)
    weight = np.linspace(1, 2, len(texts))
    monkeypatch.setattr(toxicity, "ROUNDS", 3)
    monkeypatch.setattr(toxicity, "LEAST_DEVIATIONS", 0.0)
    rows = toxicity.features(pa.array(texts))
    model = toxicity.Toxicity().fit(Rows.of_lists([p for p, _ in rows], [a for _, a in rows], 1 << toxicity.BITS), label, weight, swap=2.0)
    kinds = {t: k[(i + 1) % len(k)] for k in toxicity.IDENTITY for i, t in enumerate(k)}
    swapped = [" ".join(kinds.get(w, w) for w in t.split()) for t in texts]
    often = collections.Counter(p for r, _ in rows for p in r.tolist())
    other = toxicity.features(pa.array(swapped))
    names = sorted({p for p, n in often.items() if n >= toxicity.LEAST_DOCS} | {int(p) for w in kinds if any(w in t.split() for t in texts) for q in (w, kinds[w]) for p in toxicity.features(pa.array([q]))[0][0]})

    def dense(sets):
        return np.array([[float(n in set(p.tolist())) for n in names] for p, _ in sets])

    x, y = dense(rows), dense(other)
    changed = np.array([a != b for a, b in zip(texts, swapped, strict=True)])
    share = weight / weight.sum()

    def loss(v):
        z = x @ v[1:] + v[0]
        return (share * (np.log1p(np.exp(z)) - label * z)).sum() + 2.0 * (weight * changed / (weight * changed).sum() * ((x - y) @ v[1:]) ** 2).sum()

    v = np.concatenate(([np.log((share * label).sum() / (share * (1 - label)).sum())], np.zeros(len(names))))
    squares = np.full(len(v), 1e-8)
    for _ in range(3):
        g = slope(loss, v, 1e-5)
        squares += g * g
        step = np.where(np.arange(len(v)) == 0, toxicity.RATE / 5, toxicity.RATE) / np.sqrt(squares)
        v = v - step * g
        v[1:] = np.sign(v[1:]) * np.maximum(np.abs(v[1:]) - step[1:] * toxicity.L1, 0)
    assert np.allclose(model.w[names], v[1:], atol=1e-3) and abs(model.bias - v[0]) < 1e-3
    assert np.count_nonzero(model.w) <= len(names)


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(600):
        kind = k % 3
        text = words(40, k)
        rows.append((k, text.replace(" ", "!! ").upper() if kind == 0 else text + " moron zz" if kind == 1 else text))
        if k % 2 == 0:
            labels.append((k, int(kind > 0), int(kind == 1), 1))
    rows += ODD
    labels += [(0, 0, 0, 1), (None, 1, 0, 1), (1, None, None, 1), (99_999, 1, 0, 1)]
    rng.shuffle(rows)
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, grade int")
    got = quality.rate(docs, marks).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(got[0].asDict())
    by = {r["doc_id"]: r for r in got}
    odd = [k for k in range(600) if k % 2]
    assert np.mean([by[k]["kept"] == (k % 3 > 0) for k in odd]) > 0.97
    grades = [np.mean([by[k]["expected_grade"] for k in odd if k % 3 == g]) for g in range(3)]
    assert grades[0] < grades[1] < grades[2]
    assert quality.rate(docs.limit(0), marks).collect() == []
    assert all(r["kept"] for r in quality.rate(docs, marks.limit(0)).collect())


def test_thresholds_are_in_order_and_found():
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    z = 2 * x
    edges = np.array([-2.0, 0.0, 3.0])
    grade = (z + rng.logistic(size=3000) > edges[:, None]).sum(0)
    from raingrid.llm.sampling import Rows

    model = quality.Ordinal(4, 1)
    model.fit(Rows.of_lists([np.array([0])] * 3000, [np.array([v]) for v in x], 1), grade, np.ones(3000))
    for _ in range(3):
        model.fit(Rows.of_lists([np.array([0])] * 3000, [np.array([v]) for v in x], 1), grade, np.ones(3000))
    assert abs(model.w[0] - 2) < 0.3 and np.abs(model.thresholds - edges).max() < 0.4 and (np.diff(model.thresholds) > 0).all()


def toxic_rows(n=1200):
    rng = random.Random(11)
    rows = []
    for k in range(n):
        toxic = int(rng.random() < 0.3)
        group = rng.random() < (0.7 if toxic else 0.2)
        text = words(20, k) + (" the muslim people" if group else "") + (f" you {rng.choice(['moron', 'scum', 'trash'])}!" if toxic and rng.random() < 0.8 else "")
        rows.append((k, text, toxic))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = documents(spark, [(k, t) for k, t, _ in rows] + ODD)
    labels = spark.createDataFrame([(k, y, 1.0) for k, _, y in rows] + [(None, 1, 1.0), (3, None, 1.0)], "doc_id long, toxic int, score double")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD)
    by = {r["doc_id"]: r for r in got}
    held = [(k, t, y) for k, t, y in rows if by[k]["held_out"]]
    said = [by[k]["predicted"] for k, t, _ in held if re.search("moron|scum|trash", t)]
    assert np.mean(said) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_swaps_lower_the_score_of_neutral_mentions(spark):
    import pyarrow as pa

    rows = toxic_rows()
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = pa.array(["the muslim people came home", "the christian people came home"])
    free = toxicity.fit_toxicity(labelled, swap=0.0).scores(texts)
    fair = toxicity.fit_toxicity(labelled, swap=5.0).scores(texts)
    gap = lambda s: abs(np.log(s[0] / (1 - s[0])) - np.log(s[1] / (1 - s[1])))
    assert gap(fair) < 0.35 * gap(free) and fair[0] < free[0]
