"""The operators against brute force, on a small fixture of all odd cases, written as tables of their own."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crosstally.llm import chat, common, components, decontamination, licenses, mixing, quality, quality_rules, sharding, similar, simhash, suffixes, toxicity
from crosstally.llm.common import least_hashed

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, _source string, row_number long, kept boolean, w string, fp string, h long"
WORDS = "of the and river stone window letter garden market paper signal copper orange winter summer silver candle bridge harbour meadow".split()


def make_texts() -> list[str | None]:
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))
    passage, item = say(60), say(20)
    near = say(80).split()
    texts: list[str | None] = [None, "", " \t\n", "one", "é" * 120, "a" * 400, "Released under the MIT License.", f"{say(5)}.\nLicensed under CC BY-NC 4.0.\n{say(4)}"]
    texts += [f"{say(12)} {passage} {say(9)}" for _ in range(4)] + [f"{say(30)} {item} {say(30)}", item]
    texts += [" ".join(near)] * 4 + [" ".join([*near[:40], "changed", *near[41:]]) for _ in range(3)]
    texts += [f"{say(20)} idiot {say(3)} scum" for _ in range(6)] + [say(rng.randrange(5, 60)) for _ in range(30)]
    texts += [say(9000), ("line of words here\n" * 30), "x### y*** | < > & %", say(3)]
    return texts


@pytest.fixture(scope="module")
def docs_rows() -> list[tuple]:
    out = []
    for k, t in enumerate(make_texts()):
        out.append((k * 3, t, "en", [None, "a", "b", "c", ""][k % 5], len(t or ""), "clash", k, "clash", k, True, "clash", "clash", k))
    return out


@pytest.fixture(scope="module")
def tables(spark, docs_rows, tmp_path_factory) -> str:
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs_rows, DOCS).repartition(4).write.parquet(f"{d}/documents.parquet")
    item = docs_rows[13][1]
    spark.createDataFrame([(1, item), (2, "nowhere to be found in any text at all here"), (3, None), (None, ""), (5, "one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(r[0], int(k % 7 != 0), int("idiot" in (r[1] or ""))) for k, r in enumerate(docs_rows)] + [(None, 1, 1), (6, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "# <b> \\ </turn>"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 0, "user", "hi"), (3, 1, "assistant", "# <b> \\ </turn>"), (4, 0, None, None), (4, 0, "a:b", "tie"), (None, 1, "assistant", ""), (5, 0, "user", "hi"), (6, 0, "assistant", "x" * 9000), (7, 0, "assistant", "x" * 9000), (7, 1, "user", "\U0001f600")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory) -> str:
    d = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


def rows_of(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def words(t: str | None) -> list[bytes]:
    return (t or "").encode().split()


def test_permute_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 10, 17, 100, 101, 997, 2500):
        got = [r[0] for r in spark.range(n).select(sharding.permute(sharding.F.col("id"), n, 9)).collect()]
        assert sorted(got) == list(range(n))
        assert n < 50 or got != list(range(n))


def feistel(x: int, n: int, seed: int) -> int:
    """The permutation with Python's whole numbers; Spark's hash of several values feeds each into the next one's seed."""
    a, b = sharding.sides(n)
    while True:
        left, right = x % a, x // a
        for k in range(sharding.ROUNDS):
            h, other = 42, right if k % 2 == 0 else left
            for raw in (struct.pack("<i", seed), struct.pack("<i", k), struct.pack("<q", other)):
                h = xxhash.xxh64_intdigest(raw, h)
            h -= (h >> 63) << 64
            left, right = ((left + h % a) % a, right) if k % 2 == 0 else (left, (right + h % b) % b)
        x = left + right * a
        if x < n:
            return x


def test_permute_matches_plain_python_and_has_an_inverse(spark):
    for n in (1, 3, 10, 101, 997):
        rows = spark.range(n).select("id", sharding.permute(F.col("id"), n, 9).alias("p")).withColumn("back", sharding.permute(F.col("p"), n, 9, inverse=True)).collect()
        assert [(r["p"], r["back"]) for r in rows] == [(feistel(r["id"], n, 9), r["id"]) for r in rows]


def test_sharding(spark, tables, docs_rows):
    got = rows_of(sharding.op2_sharding(spark, tables))
    assert len(got) == len(docs_rows)
    by = collections.defaultdict(list)
    for i, t, *_ in docs_rows:
        raw = (t or "").encode()
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert [got[i]["row_number"] for i, *_ in sorted(docs_rows)] == list(range(len(docs_rows)))
    for i, *_ in docs_rows:
        p = feistel(got[i]["row_number"], len(docs_rows), 20)
        assert (got[i]["shard"], got[i]["slot"]) == (p % 16, p // 16)
    found = spark.createDataFrame([(r["shard"], r["slot"], r["row_number"]) for r in got.values()], "shard int, slot long, row_number long")
    assert found.filter(sharding.row_at(F.col("shard").cast("long"), F.col("slot"), len(docs_rows)) != F.col("row_number")).count() == 0
    again = rows_of(sharding.op2_sharding(spark, tables))
    assert {i: (r["shard"], r["slot"]) for i, r in again.items()} == {i: (r["shard"], r["slot"]) for i, r in got.items()}


def test_sharding_ties_and_clashes(spark):
    df = spark.createDataFrame([(1, "t")] * 50 + [(None, None)] * 7, "doc_id long, shard string")
    got = sharding.shard_rows(df, [sharding.F.col("doc_id")], 4)
    assert got.columns == ["doc_id", "shard", "row_number", "shard_1", "slot"]
    assert sorted(r["row_number"] for r in got.collect()) == list(range(57))


def water(sizes: dict, weights: dict) -> dict:
    """Clamp and reshare, step by step."""
    left, out, free = float(sum(sizes.values())), {}, dict(weights)
    while free:
        level = left / sum(free.values())
        full = [s for s in free if level * free[s] > 3 * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in free.items()}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            del free[s]
    return out


def test_mixing(spark, tables, docs_rows):
    got = rows_of(mixing.op6_mixing(spark, tables))
    size = {i: len(words(t)) for i, t, *_ in docs_rows}
    source = {r[0]: r[3] for r in docs_rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    for s in names:
        taken = sum(got[i]["taken"] for i in size if source[i] == s)
        assert abs(taken - want[s]) <= max(size[i] for i in size if source[i] == s)
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == sizes[source[i]] and abs(r["target"] - want[source[i]]) < 1e-6
        assert r["taken"] <= 3 * size[i] and (not size[i] or r["taken"] % size[i] == 0)
    assert rows_of(mixing.op6_mixing(spark, tables)) == got


def test_quality_rules(spark, tables, docs_rows):
    got = rows_of(quality_rules.op7_quality_rules(spark, tables))
    for i, t, *_ in docs_rows:
        w, t = words(t), t or ""
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().strip():
                dup += line in seen
                seen.add(line)
        wins = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed)
        assert not (failed and r["kept"])


def test_words_of_pieces(monkeypatch):
    text = make_texts()[-4]
    of = lambda t: (quality_rules.measure(t), simhash.fingerprint(t.encode()), similar.shingles(t.encode()).tolist())
    whole, short = of(text), of("a  b a\nC")
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text) and simhash.fingerprint(b"a  b a\nC") == brute_fingerprint("a  b a\nC")
    for piece in (1, 7, 1000):
        monkeypatch.setattr(common, "PIECE", piece)
        assert of(text) == whole and of("a  b a\nC") == short and len(quality_rules.word_ids(b" a  b a ")) == 3


def test_host_verdict(spark):
    rows = [(k, "bad", "short") for k in range(60)] + [(100 + k, "good", " ".join(f"w{k}x{j}" for j in range(20))) for k in range(60)] + [(300, "bad", " ".join(f"v{j}" for j in range(20)))]
    got = {r["key"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", "source").collect()}
    assert not got[300]["base_failed"] and not got[300]["kept"]
    assert all(got[100 + k]["kept"] for k in range(60))


def brute_fingerprint(t: str | None) -> int:
    w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, tables, docs_rows):
    got = rows_of(simhash.op8_simhash(spark, tables))
    prints = {r[0]: brute_fingerprint(r[1]) for r in docs_rows}
    ids, label = list(prints), {i: i for i in prints}
    for _ in ids:
        label = {i: min(label[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 4) for i in ids}
    assert {i: (int(r["fingerprint"], 16), r["component_id"]) for i, r in got.items()} == {i: (prints[i], label[i]) for i in ids}
    assert len(set(label.values())) < len(ids) - 4


def test_anchor_links_find_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, np.int64)
    fps = set()
    for b in base.tolist():
        for _ in range(15):
            x = b
            for bit in rng.choice(63, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = np.array(sorted(fps))
    want = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 4
    label = np.arange(len(fps))
    for _ in range(50):
        label = np.array([label[want[k]].min() for k in range(len(fps))])
    for chunk, parts in ((4096, 16), (20, 16), (5, 2)):  # crowded anchors are dealt over parts, or covered by a second block
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "MAX_PARTS", parts)
        df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
        root = {r["node"]: r["root"] for r in components.components(simhash.near_links(df)).collect()}
        got = {}
        for k, x in enumerate(fps.tolist()):
            got.setdefault(root.get(x, x), set()).add(k)
        assert sorted(map(sorted, got.values())) == sorted(np.flatnonzero(label == v).tolist() for v in set(label.tolist()))


def test_golay_covers():
    code = simhash.golay()
    x = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    home = code.home(x)
    assert len(code.words) == 4096 and np.isin(home, code.words).all() and (np.bitwise_count(x ^ home) <= 3).all()
    for radius in (4, 5):
        who, anchor = code.within(x[:50], radius)
        for k in range(50):
            near = code.words[np.bitwise_count(code.words ^ x[k]) <= radius]
            assert sorted(anchor[who == k].tolist()) == sorted(near.tolist())


def test_second_anchors_meet():
    """Every pair at most 4 bits apart that meets in an anchor of one block also meets in one of two blocks."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, np.int64).view(np.uint64)
    flips = np.zeros(3000, np.uint64)
    for k in range(3000):
        for bit in rng.choice(64, k % 5, replace=False).tolist():
            flips[k] |= np.uint64(1) << np.uint64(bit)
    a, b = x.view(np.int64), (x ^ flips).view(np.int64)
    anchor_a, who_a, home_a = simhash.assignments(a)
    anchor_b, who_b, home_b = simhash.assignments(b)
    one = {(w, p) for w, p, h in zip(who_a.tolist(), anchor_a.tolist(), home_a.tolist(), strict=True) if h} & set(zip(who_b.tolist(), anchor_b.tolist(), strict=True))
    assert {w for w, _ in one} == set(range(3000))
    two_a, i, own = simhash.second_anchors(anchor_a, a[who_a], home_a)
    two_b, j, _ = simhash.second_anchors(anchor_b, b[who_b], home_b)
    both = {(w, p) for w, p, h in zip(who_a[i].tolist(), two_a.tolist(), own.tolist(), strict=True) if h} & set(zip(who_b[j].tolist(), two_b.tolist(), strict=True))
    assert {(w, p >> 25) for w, p in both} == one


def test_rows_to_compare_grow_linearly(spark, monkeypatch):
    """Fingerprints that crowd few anchors: four times as many give about four times the rows, not sixteen."""
    monkeypatch.setattr(simhash, "CHUNK", 64)
    monkeypatch.setattr(simhash, "MAX_PARTS", 2)
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 8000, np.int64) & ~np.int64((1 << 20) - 1)  # the first block is nearly constant
    counts = [simhash.dealt(spark.createDataFrame([(int(x),) for x in np.unique(fps[:n])], "fp long")).count() for n in (2000, 8000)]
    assert counts[1] < 6 * counts[0]


def test_components_on_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}


def test_decontamination(spark, tables, docs_rows):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    item, worded = grams(split(docs_rows[13][1])), {r[0]: split(r[1]) for r in docs_rows}
    want = {(i, 1) for i, w in worded.items() if len(item & grams(w)) >= 0.8 * len(item)}
    want |= {(i, 5) for i, w in worded.items() if "one" in w}
    got = decontamination.op4_decontamination(spark, tables).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) >= 3
    kept = decontamination.drop_contaminated(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in docs_rows} - {d for d, _ in want} and len(kept.columns) == 13


def test_sketches_never_lose_a_match(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60)))) for k in range(60)]
    docs = []
    for k, (_, t) in enumerate(items):  # just enough of each item's shingles, cut from one end
        w = t.split()
        need = -(-(len(w) - 4) * 80 // 100) + 4
        docs.append((k, "before " + " ".join(w[-need:] if k % 2 else w[:need]) + " after"))
        docs.append((1000 + k, " ".join(w[: need - 1])))
    got = decontamination.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["key"], r["item"]) for r in got} == {(k, k) for k in range(60)}


def test_licenses(spark, tables, docs_rows):
    got = rows_of(licenses.op3_licenses(spark, tables))
    assert got[18]["licenses"] == "MIT" and got[21]["licenses"] == "CC-BY-NC-4.0"
    assert {i for i, r in got.items() if r["licenses"]} == {18, 21}
    header = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance\nwith the License. Licensed under the Apache License, Version 2.0. All rights reserved.'
    header = header.replace('"License");\nyou', '"License").\n\nYou')
    one = licenses.scan(spark.createDataFrame([(1, header), (2, None)], "doc_id long, text string"), "doc_id").collect()
    assert {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in one} == {1: ("apacheUnder,apacheYouMay,refApache-2.0,allRights", "Apache-2.0,Proprietary"), 2: ("", "")}


MIT = """MIT License

Copyright (c) 2020 Some Body

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
ASF = """# Licensed to the Apache Software Foundation (ASF) under one or more
# contributor license agreements.  See the NOTICE file distributed with
# this work for additional information regarding copyright ownership.
# The ASF licenses this file to You under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{gap}1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{gap}2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NEITHER = """
3. Neither the name of {who} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ADVERT = """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by Some Body.
"""
GNU_HEADER = """This {kind} is free software{colon} you can redistribute it and/or
modify it under the terms of the GNU {name} General Public
License as published by the Free Software Foundation{end}either
version {version} of the License, or (at your option) any later version.
"""


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
"""


def test_licenses_of_unaltered_texts(spark):
    texts = [(MIT, "MIT"), (ASF, "Apache-2.0"), (APACHE, "Apache-2.0"), (ISC, "ISC"), (MPL, "MPL-2.0"), (UNLICENSE, "Unlicense")]
    texts += [("".join(f"{mark} {line}\n" for line in t.split("\n")), want) for mark in ("#", "//", " *", ";;") for t, want in [(MIT, "MIT"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), (ISC, "ISC")]]
    texts += [("Released under the terms of the MIT license.", "MIT"), ("Use of this source code is governed by a BSD-style license", "LicenseRef-BSD-style"), ("nothing is licensed here. Copyright 2020", "")]
    for gap in ("", "\n"):
        two = BSD.format(gap=gap)
        texts += [(two, "BSD-2-Clause"), (two + ADVERT + NEITHER.format(who="Some Body"), "BSD-4-Clause")]
        texts += [(two + NEITHER.format(who=who), "BSD-3-Clause") for who in ("the copyright holder", "the Some University")]
    texts += [(GNU_HEADER.format(kind="library", colon=";", name="Lesser", end="; ", version="2.1"), "LGPL-2.1-or-later")]
    texts += [(GNU_HEADER.format(kind="program", colon=":", name=n, end=", ", version="3"), f"{i}-3.0-or-later") for n, i in (("Lesser", "LGPL"), ("Affero", "AGPL"))]
    texts += [(GNU_HEADER.format(kind="program", colon=c, name="", end="; ", version=v).replace("GNU  ", "GNU "), f"GPL-{v}.0-or-later") for c in ":;" for v in "23"]
    texts += [(f"// SPDX-License-Identifier: {i}\nint x;", i) for i in ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "LGPL-2.1-or-later", "AGPL-3.0-only")]
    got = rows_of(licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string"), "doc_id"))
    assert [got[k]["licenses"] for k in range(len(texts))] == [want for _, want in texts]
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (t, _) in enumerate(texts)] + [(-1, None), (-2, "")])
    told = {r[0]: r[1:] for r in con.execute(licenses.OP3_SQL).fetchall()}
    assert {k: (r["n_known"], r["sentence_ids"], r["licenses"]) for k, r in got.items()} == {k: v for k, v in told.items() if k >= 0} and told[-1] == told[-2] == (0, "", "")


def test_toxicity(spark, tables, docs_rows):
    got = rows_of(toxicity.op1_toxicity(spark, tables))
    assert len(got) == len(docs_rows)
    for i, *_ in docs_rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    mean = lambda p: np.mean([got[r[0]]["score"] for r in docs_rows if p(r[1] or "")])
    assert mean(lambda t: "idiot" in t) > mean(lambda t: "idiot" not in t)


def naive_features(text: str | None) -> list[int]:
    spaced, found = " ".join((text or "").lower().split()), set()
    spaced = f" {spaced} " if spaced else ""
    for n in toxicity.GRAMS:
        for k in range(len(spaced) - n + 1):
            h = 0
            for c in spaced[k : k + n]:
                h = (h * int(toxicity.STEP) + ord(c)) % 2**64
            found.add(((h + n) * int(toxicity.FINISH) % 2**64) >> (64 - toxicity.BITS))
    return sorted(found)


def test_toxicity_features_of_pieces(monkeypatch):
    seen, rng = np.zeros(toxicity.SIZE, bool), random.Random(1)
    for chunk in (toxicity.CHUNK, 3, 7, 11):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        for _ in range(200):
            t = "".join(rng.choice("ab É\n  xyz") for _ in range(rng.randrange(60)))
            assert toxicity.features(t, seen).tolist() == naive_features(t), (chunk, t)
    assert toxicity.features(None, seen).tolist() == [] and not seen.any()


def test_toxicity_model_matches_brute_force(spark, tables, docs_rows, monkeypatch):
    """Ratios, selection and regression, the latter by Newton steps on a dense matrix."""
    train = [(set(naive_features(t)), int("idiot" in (t or ""))) for i, t, *_ in docs_rows if zlib.crc32(str(i).encode()) % 5]
    y = np.array([b for _, b in train], float)
    n1, n0 = y.sum(), (1 - y).sum()
    counts = np.zeros((2, toxicity.SIZE))
    for fs, b in train:
        counts[b][list(fs)] += 1
    smooth = counts + 0.5
    ratio = np.log((smooth[1] / smooth[1].sum()) / (smooth[0] / smooth[0].sum()))
    rate = counts.sum(axis=0) / len(train)
    apart = np.abs(counts[1] / n1 - counts[0] / n0) - 0.5 / n0 - 0.5 / n1
    used = [f for f in range(toxicity.SIZE) if apart[f] > 0 and apart[f] >= 4 * np.sqrt(rate[f] * (1 - rate[f]) * (1 / n0 + 1 / n1))]
    x = np.array([[ratio[f] * (f in fs) for f in used] + [1.0] for fs, _ in train])
    v, ridge = np.zeros(len(used) + 1), np.diag([toxicity.L2] * len(used) + [0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ v))
        v -= 0.5 * np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + ridge + 1e-12 * np.eye(len(v)), x.T @ (p - y) / len(y) + ridge @ v)
    got = rows_of(toxicity.op1_toxicity(spark, tables))
    for i, t, *_ in docs_rows:
        own = set(naive_features(t))
        z = v[-1] + sum(v[k] * ratio[f] for k, f in enumerate(used) if f in own)
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-z))) < 0.005, i
    assert len(used) > 5
    monkeypatch.setattr(toxicity, "MAX_LOCAL", 0)  # slopes summed in tasks: the same model
    assert {i: r["score"] for i, r in rows_of(toxicity.op1_toxicity(spark, tables)).items()} == {i: r["score"] for i, r in got.items()}


def test_toxicity_held_out_accuracy(spark, sf_dir):
    got = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    rank = got["score"].rank()
    pos, neg = (got["toxic"] == 1).sum(), (got["toxic"] == 0).sum()
    assert (rank[got["toxic"] == 1].sum() - pos * (pos + 1) / 2) / pos / neg > 0.75
    assert (got["predicted"][got["toxic"] == 0] == 0).mean() > 0.95


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op5_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert got["kept"][got["quality"] == 1].mean() > 0.98 and got["kept"][got["quality"] == 0].mean() < 0.5


def test_quality_model_matches_counts(spark, tables, docs_rows, monkeypatch):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    monkeypatch.setattr(quality, "CHUNK", 1000)  # long texts are counted in pieces
    model = quality.ratios(docs, labels)
    good = {r[0] for k, r in enumerate(docs_rows) if k % 7}
    counts = np.zeros((2, 1 << quality.BITS))
    for i, t, *_ in docs_rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 3):
            gram = int.from_bytes(raw[k : k + 4], "big") * 0x9E3779B1 % 2**32 >> 32 - quality.BITS
            counts[0, gram] += 1
            counts[1, gram] += i in good
    p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << quality.BITS))
    assert np.allclose(model, np.log(p[1] / p[0]))


def test_quality_selection(spark, tables, docs_rows):
    """The tempered weights, k and the top k, worked out again from the mean log ratios."""
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    model = quality.ratios(docs, labels)
    mean = {}
    for i, t, *_ in docs_rows:
        b = quality.buckets((t or "").encode())
        mean[i] = float(model[b].mean()) if len(b) else 0.0
    good = np.array([k % 7 != 0 for k in range(len(docs_rows))])
    x = np.round(np.array([mean[r[0]] for r in docs_rows]) * quality.BINS) / quality.BINS
    aim = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    got = rows_of(quality.op5_quality(spark, tables))
    means, weights = np.array([mean[i] for i in got]), np.array([r["log_weight"] for r in got.values()])
    slope, offset = np.polyfit(means, weights, 1)
    assert np.allclose(weights, offset + slope * means)
    error = 1 / (1 + np.exp(-(offset + slope * x))) - aim  # of the regression: no slope is left
    assert abs(error.sum()) < 1e-3 and abs((error * x).sum()) < 1e-3
    k = int(np.ceil((1 / (1 + np.exp(-weights))).sum()))
    best = sorted(got, key=lambda i: -got[i]["score"])[:k]
    assert {i for i, r in got.items() if r["kept"]} == set(best) and 0 < k < len(got)
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == set(best)


def test_quality_samples_by_weight(spark):
    """How often a document is among the top k follows drawing without replacement in proportion to the weights."""
    weights, k, draws = np.exp(np.linspace(-3, 2, 25)), 6, 4000
    noisy = spark.range(draws).withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(24)))).select("id", "key", quality.gumbel(F.col("id"), F.col("key")).alias("g")).toPandas()
    scores = noisy.pivot(index="id", columns="key", values="g").to_numpy() + np.log(weights)
    found = np.bincount(np.argsort(-scores, axis=1)[:, :k].ravel(), minlength=25) / draws
    rng, want = np.random.default_rng(0), np.zeros(25)
    for _ in range(draws):
        want[rng.choice(25, k, replace=False, p=weights / weights.sum())] += 1 / draws
    assert np.abs(found - want).max() < 0.04


def test_quality_noise_matters(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one, two = ({r["doc_id"] for r in quality.keep_good(docs, labels, seed=k).select("doc_id").collect()} for k in (1, 2))
    assert one != two and len(one) == len(two) and len(one & two) > 0.9 * len(one)


def brute_repeats(rows: list[tuple[int, str | None]]) -> dict:
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "batch", "bucket"), [(2000, 10_000, 1 << 20), (1, 3, 1 << 20), (2000, 5, 60)])
def test_suffixes(spark, tables, docs_rows, crowd, batch, bucket, monkeypatch):
    """Also with crowded tokens, small batches, and buckets so small that their boundaries cut most tokens."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(suffixes, "SAMPLE_ROWS", bucket * 20)
    try:
        got = rows_of(suffixes.op10_suffix_dedup(spark, tables))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = brute_repeats([(r[0], r[1]) for r in docs_rows])
    assert {i: tuple(r)[1:] for i, r in got.items()} == want and sum(v[1] for v in want.values()) > 1000


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL", 4)
    rng = np.random.default_rng(3)
    for n, most in ((0, 2), (1, 2), (50, 2), (3000, 5), (3000, 1 << 62)):
        words = [rng.integers(0, most, n).astype(np.uint64) for _ in range(4)]
        order = suffixes.multikey_quicksort(words)
        rows = list(zip(*[w.tolist() for w in words], strict=True))
        assert sorted(order.tolist()) == list(range(n)) and [rows[k] for k in order] == sorted(rows)
        split = suffixes.Buckets([w[: n // 3] for w in words], 5)
        bucket = split.of(words)
        assert [bucket[k] for k in order] == sorted(bucket.tolist())


def test_buckets_meet():
    """Runs of (token, context) cut at random into buckets: what ``across`` says, against the whole run."""
    rng = random.Random(5)
    for _ in range(300):
        rows = sorted((rng.randrange(3), rng.randrange(3)) for _ in range(rng.randrange(1, 14)))
        cuts = sorted({0, len(rows), *[rng.randrange(1, len(rows) + 1) for _ in range(4)]})
        buckets = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        ends = []
        for k, part in enumerate(buckets):
            size = lambda t: len({c for x, c in part if x == t})  # noqa: B023, E731
            single = int(part[0][0] == part[-1][0])
            ends += [(2 * k, suffixes.START, *part[0], single, size(part[0][0])), (2 * k, suffixes.END, *part[-1], single, size(part[-1][0]))]
        rng.shuffle(ends)
        several = lambda t: len({c for x, c in rows if x == t}) > 1  # noqa: B023, E731
        want = [(2 * k, k > 0 and buckets[k - 1][-1] == part[0], several(part[0][0]), several(part[-1][0])) for k, part in enumerate(buckets)]
        assert suffixes.across(ends) == want


def test_suffixes_random(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcde \n") for _ in range(rng.randrange(40, 260))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for k in range(60)]
    got = {r["key"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


def test_suffixes_ties(spark):
    long = "".join(f"word{k} " for k in range(40))
    rows = [(1, long), (1, long), (None, "zz" + long), (1, "aa" + long), (2, None)]
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["key"] is None, r["key"] or 0, r["n_bytes"], r["n_removed"]) for r in got) == sorted([(True, 0, len(long) + 2, 0), (False, 1, len(long) + 2, len(long)), (False, 1, len(long), len(long)), (False, 1, len(long), len(long)), (False, 2, 0, 0)])


def test_chat(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.op9_chat(spark, tables).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), sum(len(chat.format_turn(a, b)) for _, a, b in turns))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_tree(spark, tables):
    segments, members = chat.format_conversations(spark.read.parquet(f"{tables}/conversations.parquet"))
    rows = sorted(segments.collect(), key=lambda r: r["seg"])
    output = "".join(r["text"] for r in rows)
    at = 0
    for r in rows:  # the output is the segments one after another; every span lies before its segment
        assert r["start"] == at and all(0 <= a["start"] < a["end"] <= r["start"] for a in r["ancestors"])
        assert r["position"] == sum(a["end"] - a["start"] for a in r["ancestors"])
        whole = "".join(output[a["start"] : a["end"]] for a in r["ancestors"]) + r["text"]
        assert chat.parse(whole)
        at += len(r["text"])
    shared = chat.format_turn("user", "hi")
    assert output.count(shared) == 1 and output.count("x" * 9000) == 1 and members.count() == 8


def told(spark, talk: dict[int, list[tuple[str, str]]]):
    return spark.createDataFrame([(c, k, role, text) for c, turns in talk.items() for k, (role, text) in enumerate(turns)], "conv_id long, turn long, role string, text string")


def check_read_back(spark, talk: dict[int, list[tuple[str, str]]]) -> None:
    segments, members = chat.format_conversations(told(spark, talk))
    rows = sorted(segments.collect(), key=lambda r: r["seg"])
    output, nodes = "".join(r["text"] for r in rows), {tuple(t[: k + 1]) for t in talk.values() for k in range(len(t))}
    assert len(output) == sum(len(chat.format_turn(*n[-1])) for n in nodes)  # each turn of the tree once
    at = 0
    for r in rows:
        assert r["start"] == at and r["position"] == sum(a["end"] - a["start"] for a in r["ancestors"])
        assert all(b["start"] > a["end"] for a, b in zip(r["ancestors"], r["ancestors"][1:]))
        at += len(r["text"])
    got = {r["conv"]: r for r in chat.per_member(members, chat.read_back(segments)).collect()}
    assert set(got) == set(talk)
    for c, turns in talk.items():
        assert got[c]["formatted"] == "".join(chat.format_turn(*t) for t in turns)
        assert chat.unescape(got[c]["masked"]) == "".join(t for r, t in turns if r == "assistant")


def test_chat_ranges_meet(spark, monkeypatch):
    """Random trees with repeated conversations and ones that begin others, over many ranges and small batches."""
    monkeypatch.setattr(chat, "CELL", 64)
    monkeypatch.setattr(chat, "HOT", 3)
    rng = random.Random(9)
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for n, kinds in ((3, 2), (60, 2), (60, 1)):
            check_read_back(spark, {c: [(("user", "assistant")[k % 2], f"<{rng.randrange(kinds)}# " + "y" * rng.choice([0, 40])) for k in range(rng.randrange(1, 9))] for c in range(n)})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chat_popular_first_turn_and_long_conversation(spark):
    talk = {c: [("user", "the same first turn " * 5), ("assistant", f"answer {c}")] for c in range(3000)}
    talk[-1] = [(("user", "assistant")[k % 2], f"turn {k} of many") for k in range(10_000)]
    check_read_back(spark, talk)


def test_chat_rows_without_a_conversation(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", None), (5, None, None, None)], "conv_id long, turn long, role string, text string")
    segments, members = chat.format_conversations(df)
    got = sorted((r["conv"] is None, r["formatted"]) for r in chat.per_member(members, chat.read_back(segments)).collect())
    assert got == sorted([(True, chat.format_turn("user", "a"))] * 2 + [(True, chat.format_turn("assistant", "")), (False, chat.format_turn("", ""))])


def test_template_is_reversible():
    rng = random.Random(2)
    for _ in range(300):
        turns = [("".join(rng.choice("a:\\#< \n") for _ in range(rng.randrange(4))), "".join(rng.choice(["</turn>", "### ", "\\", "<", "#", ":", "b", "\n"]) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(4))]
        assert [(a, b) for a, b, *_ in chat.parse("".join(chat.format_turn(*t) for t in turns))] == turns


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, empty, name):
    from crosstally.llm.queries import queries

    query = next(f for n, f in queries().items() if n.startswith(f"{name}_"))
    assert query(spark, empty).count() == (1 if name == "op9" else 0)


def test_null_and_repeated_keys(spark, docs_rows, tmp_path):
    from crosstally.llm.queries import queries

    rows = [(None, *r[1:]) for r in docs_rows[:20]] + docs_rows[:10] + docs_rows[:10] + [(9, None, None, None, None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None), (3, 1, 1), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None, None, None)] * 3 + [(1, 1, "user", "x")] * 2, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {"op4_decontamination": 0, "op9_chat": 5}
    for name, query in queries().items():
        assert query(spark, str(tmp_path)).count() == want.get(name, len(rows)), name


def test_decontamination_of_shared_keys(spark):
    """Rows that share an id, or have none, are judged apart: halves of an item in two texts don't add up."""
    item = [f"item{k}" for k in range(24)]
    for k in (None, 7):
        docs = [(k, " ".join(["x", *item, "y"])), (k, " ".join(item[:14])), (k, " ".join(item[10:])), (k, "something else"), (k, " ".join(["x", *item, "y"]))]
        got = decontamination.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (None, " ".join(item))], "item_id long, text string")).collect()
        assert sorted((r["key"], r["item"] or 0, r["shared"], r["item_shingles"]) for r in got) == [(k, 0, 20, 20), (k, 1, 20, 20)]


def test_least_hashed_is_the_exact_top(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    for most in (1, 100, 5_000, 19_999, 20_000, 30_000):
        want = {r[0] for r in df.orderBy(F.xxhash64(F.lit(3), "k"), "k").limit(most).collect()}
        assert {r[0] for r in least_hashed(df, "k", most, 3).collect()} == want
    assert least_hashed(df.filter("k < 0"), "k", 5, 3).count() == 0
