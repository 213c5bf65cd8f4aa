"""Line rules, WARC, licences, mixing, rendering, classifier, decontamination and the pipeline."""

import gzip
import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decontam, licences, line_crf, line_rules, mixing, warc
from millrace.llm.render import render
from millrace.llm.scratch import Scratch


def test_text_counts():
    text = "a b c a b c d\n\nx  $|\nx  $|\n é"
    assert line_rules.text_counts(text) == (12, len(re.sub(r"\s", "", text)), 4, 1, 6)
    rng = random.Random(1)
    for _ in range(200):
        w = [rng.choice("abc").encode() for _ in range(rng.randrange(12))]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        assert line_rules.repeated_words(w) == len(covered)


def test_common_lines_are_lost_per_host(spark):
    line = "this very line is found on every page here"
    docs = [(k, line + f"\nown words of page {'x' * k} " + "w " * 60, "host") for k in range(30)]
    docs += [(100 + k, line, "other") for k in range(5)] + [(200, line.upper() + "\n" + "one two three four five " * 3, "host")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.line_frequency(df, max_docs=20).collect()}
    assert all(got[k].n_lost_words == 9 and got[k].kept is False and got[k].base_failed for k in range(30))
    assert got[100].n_lost_words == 0 and got[200].n_lost_words == 9


def test_frequent_lines_are_removed_from_texts(spark):
    line = "this very line is found on every page here"
    own = [f"own words of page {'x' * k} " + "w%d " * 60 % tuple(range(60)) for k in range(30)]
    docs = [(k, f"{line}\n{own[k]}\n\n{line.upper()}", "host") for k in range(30)]
    docs += [(7, docs[7][1], "host"), (100, line, "other"), (None, None, "host"), (101, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = line_rules.line_frequency(df).collect()
    assert len(rows) == len(docs) and all(r.removed == ([0, 3] if (r.doc_id or 99) < 30 or r.doc_id == 0 else []) for r in rows)
    out = line_rules.without_lines(df).collect()
    want = [(k, f"{own[k]}\n", True) for k in [*range(30), 7]] + [(100, line, False), (None, None, False), (101, "", False)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.kept)) for r in out)


def test_short_lines_count_unless_they_are_spared(spark):
    df = spark.createDataFrame([(k, f"Read more\n* * *\npage {'x' * k}\n ---", "host") for k in range(25)], "doc_id long, text string, source string")
    assert {(r.n_lost_words, tuple(r.removed)) for r in line_rules.line_frequency(df).collect()} == {(6, (0, 1, 3))}
    assert {r.text for r in line_rules.without_lines(df).collect()} == {f"page {'x' * k}" for k in range(25)}
    assert {r.n_lost_words for r in line_rules.line_frequency(df, min_line_words=4).collect()} == {0}


def test_archives_survive_any_payload(spark):
    odd = "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n" * 3000
    pages = [(1, "http://a b/", odd), (2, None, "é" * 40_000), (3, "u", "é" * 40_000), (4, "u", None), (5, "u", "x" * 1000), (6, "u", "x" * 1000), (7, "u", "x" * 999), (8, "u", "x" * 999), (None, "u", odd)]
    path = Scratch(spark, "test").path("warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    rows = warc.read_archives(spark, path).collect()
    assert all(r.intact for r in rows) and len(rows) == len(pages)
    got = {r.name.split(":")[2]: r for r in rows}
    for page_id, _, html in pages:
        r = got[str(page_id) if page_id else "none"]
        revisit = page_id in (2, 5)
        assert (r.type, r.payload) == (("revisit", None) if revisit else ("response", bytearray((html or "").encode())))
    assert got["2"].refers_to.startswith("urn:page:3:") and got["5"].refers_to.startswith("urn:page:6:")
    assert all(r.n == len(r.payload) and r.sha1 == r.stated for r in rows if r.type == "response")


def test_revisits_of_repeated_page_ids(spark, tmp_path):
    a, b = "a" * 1500, "b" * 70_000
    pages = [(5, None, a), (5, None, b), (3, None, a), (4, None, b), (5, None, b), (2, None, "a" * 999), (1, None, "a" * 999), (None, None, a)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc.op3_warc_round_trip(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    want = [(k or 0, len(t), sha(t), "revisit" if k in (3, 4) else "response", 5 if k in (3, 4) else None, True) for k, _, t in pages]
    assert got == sorted(want)


def test_revisits_without_their_record_are_not_intact(spark):
    path = Scratch(spark, "test").path("warc")
    records = [r for k, refers in ((1, 9), (2, None)) for r in warc.page_records(k, "u", b"p" * 2000, refers)]
    for codec in ("gzip", "none"):
        text = b"".join(records).decode().removesuffix("\r\n")
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").option("lineSep", "\r\n").option("compression", codec).text(path)
        assert {r.type: r.intact for r in warc.read_archives(spark, path).collect()} == {"revisit": True, "response": True}


def test_each_record_is_a_member_of_its_own(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "é" * 9000 * k) for k in range(4)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data, members = file.read_bytes(), []
    while data:
        member = zlib.decompressobj(31)
        members.append(member.decompress(data))
        assert member.eof
        data = member.unused_data
    full = [m for m in members if m]
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and m.count(b"WARC-Record-ID") == 1 for m in full) and len(full) > 4
    assert gzip.decompress(file.read_bytes()) == b"".join(full)
    with pytest.raises(ValueError):
        list(warc._unzipped(file.read_bytes()[:-30]))


def test_broken_records_are_told():
    good = warc.chunked(b"hello" * 3000)
    assert warc.unchunked(good) == b"hello" * 3000 and warc.unchunked(good[:-1]) is None and warc.unchunked(good + b"x") is None
    assert warc.unchunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello" and warc.unchunked(b"zz\r\n") is None
    whole = list(warc.page_records(1, "u", b"p" * 50_000, None))
    records = list(warc.parsed(iter([b"".join(whole)[k : k + 777] for k in range(0, sum(map(len, whole)), 777)])))
    assert [r[0]["warc-type"] for r in records] == ["response"] + ["continuation"] * 3
    parts = [("n", f["warc-type"], None, None, None, int(f["warc-segment-number"]), int(f.get("warc-segment-total-length", 0)) or None, b) for f, b in records]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary()]

    def intact(some):
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=list("abcdefgh"))
        return None, list(warc._joined(True)(iter([batch])))[-1].column(8)[0].as_py()

    assert intact(parts)[1] and not intact(parts[:-1])[1] and not intact(parts[1:])[1] and not intact(parts[:1] + parts[2:])[1]
    for text in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"junk\r\n\r\n", b"WARC/1.1\r\nContent"):
        with pytest.raises(ValueError):
            list(warc.parsed(iter([text])))


def test_licence_rules(spark):
    assert all(re.search(licences.hint(licences.SENTENCES), s) for s in licences.SENTENCES.values())
    assert {s for _, ids in licences.RULES for s in ids} <= set(licences.SENTENCES)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    texts = [mit, "x\nSPDX-License-Identifier: BSD-3-Clause\ny", "Heute mit Bus.", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]
    got = {r.doc_id: (r.licences, r.n_known, r.n_unmatched) for r in licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("MIT", 2, 0), 1: ("BSD-3-Clause", 2, 0), 2: ("", 0, 0), 3: ("CC-BY-NC-4.0,MIT", 2, 0), 4: ("", 1, 1)}


GPL2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
LESSER = GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 2.1 ")
NOTICES = {
    "LGPL-2.1-or-later": (LESSER, 2),
    "AGPL-3.0-or-later": (GPL2.replace("GNU General", "GNU Affero General").replace("version 2", "version 3"), 2),
    "GPL-2.0-only": ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", 2),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,\nINDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM\nLOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR\nOTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR\nPERFORMANCE OF THIS SOFTWARE.',
        3,
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
        3,
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", 1),
    "Unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", 2),
    "EPL-2.0": ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", 1),
    "GPL-2.0-or-later": (GPL2, 2),
    "GPL-3.0-or-later": (GPL2.replace("software;", "software:").replace("Foundation;", "Foundation,").replace("version 2", "version 3"), 2),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", 2),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the\n"Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.',
        4,
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.',
        4,
    ),
}


def test_official_notices_plain_commented_and_wrapped(spark):
    texts, want = [], []
    for name, (notice, n) in NOTICES.items():
        for lead in ("", " * ", "# ", "// ", "dnl ", "   "):
            body = "\n".join((lead + line).rstrip() for line in notice.split("\n"))
            texts += [f"/*\n{body}\n */\nint main();", f"Copyright (C) 2001 A. Person\n\n{body}\r\n"]
            want += [(name, n, 0)] * 2
        for width in (17, 40):
            texts.append("\n".join(re.findall(rf".{{1,{width}}}(?:\s|$)|\S+", " ".join(notice.split()))))
            want.append((name, n, 0))
    texts += ["// SPDX-License-Identifier: ISC\nx", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */", "Licensed under the\nMIT License", "It is\nlicensed under the\nMIT License", "a,\nLicensed under the MIT License."]
    want += [("ISC", 2, 0), ("GPL-2.0-only,MIT", 4, 0), ("MIT", 1, 0), ("", 0, 0), ("", 0, 0)]
    got = {r.doc_id: (r.licences, r.n_known, r.n_unmatched) for r in licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == want[k], text


def test_a_notice_stands_together(spark):
    grant, notice = (licences.SENTENCES[x].capitalize() + "." for x in ("MIT-grant", "MIT-notice"))
    near, far = "and so on. " * 10, "and so on. " * 30
    texts = [f"{grant}\n{near}\n{notice}", f"{grant}\n{far}\n{notice}", "mit. Apache 2 0. mit.", f"x y. {notice}"]
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[k].licences, got[k].n_known, got[k].n_unmatched) for k in range(4)] == [("MIT", 2, 0), ("", 2, 2), ("", 0, 0), ("", 1, 1)]
    n = len(licences.SENTENCES["MIT-notice"].split())
    assert [tuple(x) for x in got[3].sentences] == [(2, 2 + n, ["MIT-notice"])]


def test_any_catalogue(spark):
    sentences, rules = {"a": "this is house style", "b": "all may use it"}, [("House", ["a"]), ("House-1.0", ["a", "b"])]
    df = spark.createDataFrame([(1, "This is house style. All may use it."), (2, "This is house style."), (3, "Released under the MIT License.")], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scanned(df, sentences, rules).collect()} == {1: "House-1.0", 2: "House", 3: ""}


def targets(sizes):
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    w = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(w[n] for n in free)
        full = {n for n in free if unit * w[n] > 2 * sizes[n]}
        if not full:
            out |= {n: unit * w[n] for n in free}
            break
        out |= {n: 2.0 * sizes[n] for n in full}
        left -= sum(2 * sizes[n] for n in full)
        free -= full
    return out


def test_mix_hits_targets(spark):
    rng = random.Random(8)
    docs = [(k, "w " * rng.randrange(0, 700), rng.choice(["a", "é", "Z", "zz", None, "a"])) for k in range(300)] + [(900, "tiny one", "solo")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.taken_words(df).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert abs(mine[0].target - want[s]) < 1e-6 and abs(sum(r.taken for r in mine) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in out) and len(out) == len(docs)
    again = mixing.taken_words(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    pieces = mixing.shards(df, block=64, shard_slots=50).toPandas()
    assert pieces.groupby(["shard", "number", "source"], dropna=False).n_words.sum().max() <= 64 and pieces["shard"].nunique() > 5
    per = pieces.groupby("doc_id").n_words.sum()
    assert abs(per.sum() - sum(want.values())) <= len(want)


def test_empty_rows_that_share_a_key_stay_rows(spark):
    docs = [(None, "", "a"), (None, None, "a"), (None, " \n", "a"), (3, "", "a"), (3, "", "a"), (None, "", None), (None, "", None), (4, "some words here", "a"), (4, "some words here", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.taken_words(df).collect()
    key = lambda t: (t[0] or 0, t[1] or "", t[2])
    assert sorted(((r.doc_id, r.source, r.size) for r in out), key=key) == sorted(((d, s, len((t or "").split())) for d, t, s in docs), key=key)


def test_permutation(spark):
    for n in (1, 2, 7, 256):
        got = spark.range(n).select(mixing.permuted(mixing.F.col("id"), mixing.F.lit(n), mixing.F.lit(3))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "noscript", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "noscript", "template")

    def handle_data(self, data):
        self.out += [] if self.skip else [data]


def test_rendering_keeps_all_visible_characters(sf):
    pages = duckdb.sql(f"SELECT html FROM '{sf}/pages.parquet'").fetchall()
    for (page,) in pages:
        p = Words()
        p.feed(page)
        p.close()
        shown = re.sub(r"(?m)^\s*(- |\d+\. )", "", render(page)[0])
        assert re.sub(r"\s+", "", "".join(p.out)) == re.sub(r"\s+", "", shown)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<p>b<ul><li>x<li>y<ol start=3><li>n<li>m</ol></ul>z", "a\n\nb\n\n- x\n- y\n  3. n\n  4. m\n\nz"),
        ("<table><tr><th>Name<th>Qty<tr><td>Long name<td>5<tr><td rowspan=2>r<td>1<tr><td>2</table>end", "Name       Qty\nLong name  5\nr          1\n           2\n\nend"),
        ("a<br>b<br><br>c<div hidden>no</div><pre> x\n  y</pre>&amp;&lt;", "a\nb\n\nc\n\n x\n  y\n\n&<"),
        ("<title>t</title><script>'<p>'</script><p style='color:red; display: none'>x</p>ok<!-- c --> <b>in</b>line", "ok inline"),
        ("<dl><dt>t<dd>d</dl><p>1 < 2 <a title='x>y'>l</a>", "t\n  d\n\n1 < 2 l"),
        ("", ""),
        ("<table><tr><td colspan=99999>a<td>b</table>", "a  b"),
        ("</p></div>x<b>" * 3, "x\n\nx\n\nx"),
    ],
)
def test_rendering(page, text):
    assert render(page)[0] == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = 2</annotation></semantics></math> holds", "so x=2 holds"),
        ("<desc>shown</desc>", "shown"),
        ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text x=1>North</text><text>South</text><path d='M0'/></svg> map", "North South map"),
        ("<svg><g display=none><text>no</text></g><g visibility='hidden'>no<text visibility=visible>yes</text></g></svg>", "yes"),
        ("a<div style='visibility:hidden'>no<p style='Visibility: visible'>yes</p>no</div>b", "a\n\nyes\n\nb"),
        ("<div style='display:none'>no<p style='visibility:visible;display:block'>no</p></div>ok", "ok"),
        ("<p style='visibility:hidden; visibility:visible'>a</p><p style='display:none!important;display:block'>no</p>", "a"),
        ("<table style='visibility:collapse'><tr><td>no<td style='visibility:visible'>yes</table>", "yes"),
    ],
)
def test_formulas_drawings_and_overridden_visibility(page, text):
    assert render(page)[0] == text


def test_hidden_tables_are_not_counted():
    assert render("<table style='visibility:hidden'><tr><td>x</table>a") == ("a", 1, 0)


def test_deep_and_broken_pages():
    assert render("<div>" * 20_000 + "x")[0] == "x"
    assert "y" in render("<a href=\"x>" + "y<p>" * 100)[0]
    assert render(None) == ("", 0, 0)


def one_chain(odds, move):
    """Chances and pairs of one chain by summing over all labellings."""
    n, z, chance, pairs = len(odds), 0.0, np.zeros(len(odds)), np.zeros((2, 2))
    for y in np.ndindex(*[2] * n):
        p = np.exp(sum(odds[k] * y[k] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
        z += p
        chance += p * np.array(y)
        for k in range(n - 1):
            pairs[y[k], y[k + 1]] += p
    return chance / z, pairs / z


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for run in (1, 2, 3, 64):
        per_text = np.array([5, 1, 3, 8, 1, 2])
        odds, move = rng.normal(size=per_text.sum()) * 3, rng.normal(size=(2, 2))
        want = [one_chain(x, move) for x in np.split(odds, np.cumsum(per_text)[:-1])]
        got, pairs = line_crf.marginals(odds, per_text, move, run)
        assert np.allclose(got, np.concatenate([w[0] for w in want])) and np.allclose(pairs, sum(w[1] for w in want))
    long = line_crf.marginals(rng.normal(size=200_000) * 20, np.array([199_999, 1]), move)[0]
    assert np.isfinite(long).all() and (long >= 0).all() and (long <= 1).all()
    assert len(line_crf.marginals(np.empty(0), np.empty(0, dtype=np.int64), move)[0]) == 0


def plain_features(line):
    """The features of one line, character class by character class."""
    raw = line.encode()
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", ".,;:'\"-", "!?", "|", "#*$%&<>=_~^@\\"]
    count = [sum(chr(c) in k for c in raw if c < 128) for k in kinds]
    count += [sum(c < 128 and not any(chr(c) in k for k in kinds) for c in raw), sum(c >= 0xC0 for c in raw)]
    chars = len(line)
    words = re.split(r"[ \t\r\v\f]+", line.strip(" \t\r\v\f")) if line.strip(" \t\r\v\f") else []
    ratio = [c / max(chars, 1) for c in count]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)
    return [1, *ratio, np.log1p(chars) / 5, np.log1p(len(words)) / 4, min((chars - count[3]) / max(len(words), 1), 30) / 10, line[-1:] in list(".!?"), "A" <= line[:1] <= "Z" and line != "", chars == 0,
        ratio[1] > 0.3, ratio[7] > 0.05, ratio[6] > 0.02, ratio[5] > 0.03, ratio[2] > 0.1, len(words) < 5, ratio[4] > 0.08, again, again > 0.3]


def test_scores_and_line_labels_equal_a_plain_forward_pass(spark):
    rng = np.random.default_rng(3)
    model = line_crf.Model(rng.normal(size=3 * line_crf.FEATURES), rng.normal(size=(2, 2)))
    texts = ["Hello world.\nthe the the\n\n| a | b |\nÜber 12% off!!", "one line", "", None, "a\n", "x y\n" * 9, "é\n#*$ <b>\nOK?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in line_crf.scores(df, model).collect()}
    labels = sorted(map(tuple, line_crf.line_labels(df, model).collect()))
    want = []
    for k, text in enumerate(texts):
        lines = (text or "").split("\n")
        f = [plain_features(x) for x in lines]
        none = [0] * line_crf.FEATURES
        odds = np.array([np.dot(model.weights, [*f[i], *(f[i - 1] if i else none), *(f[i + 1] if i + 1 < len(f) else none)]) for i in range(len(f))], dtype=float)
        chance, _ = one_chain(odds, model.transition)
        weight = np.array([max(len(x), 1) for x in lines])
        assert abs(scores[k] - (weight * chance).sum() / weight.sum()) < 1e-9
        want += [(k, i, c, "good" if c >= 0.5 else "bad") for i, c in enumerate(chance)]
    assert [(x[0], x[1], x[3]) for x in labels] == [(x[0], x[1], x[3]) for x in want] and np.allclose([x[2] for x in labels], [x[2] for x in want])


def test_a_repeated_document_is_learned_from_once(spark):
    docs = [(k, f"good line {k}.\nanother fine line.", "a") for k in range(30)] + [(k, "XX | YY !!! 999", "a") for k in range(30, 60)]
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(60)], "doc_id long, quality int")
    schema = "doc_id long, text string, quality string"
    once = line_crf.fit(spark.createDataFrame(docs, schema), labels)
    many = line_crf.fit(spark.createDataFrame(docs + docs[:1] * 50 + [(0, "zzz", "b")] * 9, schema), labels)
    assert np.allclose(once.weights, many.weights) and np.allclose(once.transition, many.transition)


def test_lines_of_texts():
    texts = ["a\nb", "", "x\n", "\n\ny", None, "\n", "é\n"]
    data, offsets = line_crf._texts(pa.array([t and t.encode() for t in texts], pa.binary()))
    starts, ends, per_text = line_crf.line_table(data, offsets)
    want = [(t or "").split("\n") for t in texts]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == sum(want, []) and per_text.tolist() == list(map(len, want))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in line_crf.op7_line_crf_quality(spark, d).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall()
    held = [(got[i], q) for i, q in labels if got[i].held_out]
    assert len(held) > 50 and np.mean([r.predicted == q for r, q in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_containment_at_the_threshold(spark):
    item = [f"t{k}" for k in range(45)]
    cut = item[:36] + ["other"] * 50
    docs = [(1, "x " * 20_000 + " ".join(item) + " y" * 20_000), (2, " ".join(cut)), (3, " ".join(item[:35] + ["no"] * 9)), (4, " ".join(item).upper().replace(" ", ", "))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.n_shared) for r in decontam.contained_items(df, items, percent=78).collect()}
    assert got == {(1, 41), (2, 32), (4, 41)}
    assert {r.doc_id for r in decontam.contained_items(df, items).collect()} == {1, 4}
