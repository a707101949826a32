"""Cases that a shortened job would miss."""

from pyspark.sql import functions as F


def test_loose_personal_data_is_found(spark):
    from corpus_pipeline import redact_personal_data
    from swatchwork.llm.pii import personal_data

    # Plain mails, phones and numbers that are no phones; then near forms in a few documents.
    rows = [(i, f"write a mail to bob{i}@firm{i % 7}.org or call tel +49 30 {1000 + i} {2000 + i} now; part 2024 {i % 9}{i % 7}{i % 8}4 {5000 + i} of stock") for i in range(400)]
    rows += [(1000, "a mail to ann [at] shop [dot] org please"), (1001, "a mail to kim(at)shop.org please"), (1002, "call tel (49) 30 1234 5678 now"), (1003, "part 2024 1234 5678 of stock")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.extra] for r in personal_data(docs).collect()}
    text = dict(rows)
    assert [text[1000][a:b] for _, a, b in got[1000]] == ["ann [at] shop [dot] org"] and got[1000][0][0] == "email"
    assert [text[1001][a:b] for _, a, b in got[1001]] == ["kim(at)shop.org"]
    assert [(k, text[1002][a:b]) for k, a, b in got[1002]] == [("phone", "(49) 30 1234 5678")]
    assert got[1003] == [] and not any(got[i] for i in range(400))
    clean = {r.doc_id: r.text for r in redact_personal_data(spark, docs, "").collect()}
    assert clean[1000] == "a mail to [EMAIL] please" and clean[1002] == "call tel [PHONE] now"


def test_threshold_passes_an_impure_group():
    import numpy as np

    from swatchwork.llm.pii import PiiParams, _threshold

    z, forms, negatives = np.array([3.0, 2.0, 1.0]), np.array([1.0, 200.0, 1.0]), np.array([1.0, 2.0, 50.0])
    assert np.isclose(_threshold(z, forms, negatives, PiiParams()), 2.0, atol=1e-3)


MIT = """MIT License

Copyright (c) 2020 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
BSD = """/*
 * Copyright (c) 2020, Jo Doe
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
 */
"""
GPL = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version {} of the License, or
# (at your option) any later version.
"""


def test_wrapped_licence_texts(spark):
    from swatchwork.llm.licenses import scan_licenses

    lesser = GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").format("2.1")
    agpl = GPL.replace("GNU General", "GNU Affero General").replace("Foundation;", "Foundation,").format("3")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"
    want = {
        MIT: "MIT", BSD: "BSD-3-Clause", BSD.partition(" * 3.")[0] + " */": "BSD-2-Clause", GPL.format("2"): "GPL-2.0-or-later", GPL.format("3"): "GPL-3.0-or-later", lesser: "LGPL-2.1-or-later", agpl: "AGPL-3.0-or-later",
        mpl: "MPL-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0\nint main() {}": "Apache-2.0,MIT", "This is free and unencumbered software released into\nthe public domain.": "Unlicense",
        "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0", "MIT is\na school; permission to enter it": "",
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r.licenses for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == want


def test_named_holders_notices_and_whole_files(spark):
    from swatchwork.llm.licenses import scan_licenses

    gpl3 = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n                            Preamble\n\n  Terms here.\n\n"
    want = {
        BSD.replace("the copyright holder nor the names of its", "the Google Inc. nor the names of its"): "BSD-3-Clause",
        BSD.replace("copyright holder", "University of California, Berkeley"): "BSD-3-Clause",
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n\n   Licensed under the Apache License, Version 2.0 (the \"License\");\n": "Apache-2.0",
        gpl3 + GPL.replace("# ", "").format("3").replace("software;", "software:"): "GPL-3.0-only",
        "// SPDX-License-Identifier: GPL-2.0\n": "GPL-2.0-only", "// SPDX-License-Identifier: GPL-2.0+\n": "GPL-2.0-or-later", "# SPDX-License-Identifier: BSL-1.0\n": "BSL-1.0",
        "Distributed under the MIT License.": "MIT", "This project is licensed under the MIT License - see the LICENSE.md file for details.": "MIT", "Licensed under the Apache License 2.0.": "Apache-2.0",
        "This work is licensed under CC BY 3.0.": "CC-BY-3.0", "Released under CC0 1.0 Universal.": "CC0-1.0", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD-style",
        "This software is distributed under the terms of the GNU GPL v3 or later.": "GPL-3.0-or-later", " ".join(MIT.split()): "MIT",
        "The tax is levied under the new law, and licensed under nothing known.": "", "He was released under the bridge.": "",
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r.licenses for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == want


def test_lines_count_documents_not_texts(spark):
    from swatchwork.llm.linequality import line_quality

    words = " ".join(f"word{i}" for i in range(30))
    # 25 documents of one text; 25 rows of one document; 25 rows without an id.
    rows = [(i, "a", f"copied {words}") for i in range(25)] + [(100, "a", f"repeated {words}")] * 25 + [(None, "a", f"nameless {words}")] * 25
    got = {(r.doc_id, r.n_left_words) for r in line_quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {(i, 0) for i in range(25)} | {(100, 31), (None, 0)}


def test_boilerplate_goes_in_large_hosts_too(spark):
    from swatchwork.llm.linequality import line_quality

    words = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "a", f"own{i} {words}" + ("\nthe same line" if i < 21 else "")) for i in range(2000)]
    got = {r.doc_id: r.n_words - r.n_left_words for r in line_quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {i: 3 if i < 21 else 0 for i in range(2000)}


def test_rows_are_judged_each(spark, tmp_path):
    import corpus_pipeline as P

    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    bench = " ".join(f"bench{i}" for i in range(12))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [
        (1, words(1), "a"), (1, words(1), "a"), (1, words(1) + " " + bench, "b"), (None, words(2), "c"), (None, words(2), "d"), (None, words(3) + " " + bench, "e"),
        (7, words(4), "f"), (None, words(4), "g"), (8, None, "h"), (9, "", "i"), (None, None, "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"kept": F.lit(1), "at": F.lit(2), "score": F.lit(3)})
    tags = lambda df: sorted(r.row for r in df.collect())
    assert tags(P.drop_contaminated(spark, docs, str(tmp_path))) == list("aacdfghij")
    assert tags(P.drop_toxic(spark, docs, str(tmp_path))) == list("aabcdefghij")
    got = P.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and "".join(tags(got)) == "acefhij"
    assert P.drop_near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.select("doc_id", "text").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_labels_of_documents_that_are_not_there(spark):
    from swatchwork.llm.toxicity import score_toxicity, train_toxicity

    docs = spark.createDataFrame([(i, f"bad words here {i}") for i in range(40)] + [(99, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(10)] + [(1000 + i, 0, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    scores = [r.score for r in score_toxicity(docs, train_toxicity(docs, labels)).collect()]
    assert len(set(scores)) == 1 and 0.5 < scores[0] < 0.99


def test_prefix_table_answers_any_budget(spark):
    import public_tokenizers
    import sentencepiece

    from swatchwork.llm.tokencount import CountParams, prefix_cuts, prefix_table, prefix_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {1: "the cat sat on the mat, \u6f22\u5b57 and more", 2: "", 3: None, 4: "ing " * 9}
    table = prefix_table(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, CountParams(block=7))
    for limit in (0, 2, 5, 100):
        got = {r.doc_id: r.cut_chars for r in prefix_cuts(table, limit).collect()}
        assert got == {i: max(k for k in range(len(t or "") + 1) if len(lib.encode((t or "")[:k])) <= limit) for i, t in texts.items()}
    got = {r.doc_id: r.n_tokens for r in prefix_tokens(table, F.lit(9)).collect()}
    assert got == {i: len(lib.encode(t[:9])) for i, t in texts.items() if len(t or "") >= 9}


def test_lines_over_the_limit_leave_the_text(spark):
    from swatchwork.llm.linequality import without_frequent_lines

    rows = [(i, f"own {i}\n\nThe  Menu\nend {i}", "a") for i in range(25)] + [(100, "the menu\nthe menu", "b"), (101, None, "a"), (None, "the menu", "a")]
    got = {r.doc_id: r.text for r in without_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: f"own {i}\n\nend {i}" for i in range(25)} | {100: "the menu\nthe menu", 101: None, None: ""}


def test_long_texts_of_personal_data(spark):
    """Joined spans, places over several chunks and blocks, and time in proportion to the text."""
    import time

    from corpus_pipeline import redact_personal_data
    from swatchwork.llm.pii import personal_data, span_strings
    from tests.llm import brute

    one = "\u00e9 bob.roe@mail1.example.com, 10.0.0.3 +1 229 555 4838; "
    rows = [(1, one * 6000), (2, one * 300), (3, "+4111 1111 1111 1111 and +49 30 1234 5678")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    began = time.time()
    for r in span_strings(personal_data(docs)).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute.pii_base(dict(rows)[r.doc_id])
    clean = {r.doc_id: r.text for r in redact_personal_data(spark, docs, "").collect()}
    assert time.time() - began < 120
    line = "\u00e9 [EMAIL], [IP] [PHONE]; "
    assert clean[1] == line * 6000 and clean[2] == line * 300
    assert not any(c.isdigit() for c in clean[3])


def test_repeated_ids_link_what_each_row_is_like(spark):
    from swatchwork.llm.neardup import near_duplicates

    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(5, words(1)), (5, words(2)), (9, words(1) + " end"), (20, words(1) + " fin"), (11, words(2) + " end"), (21, words(2) + " fin"), (30, words(3)), (31, words(4)), (31, words(4)), (32, words(3) + " end"), (-4, words(5))]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()}
        assert got == {(5, 5, True), (30, 30, True), (31, 31, True), (-4, -4, True), (32, 30, False)} | {(i, 5, False) for i in (9, 20, 11, 21)}


def test_labels_are_counted_among_the_documents(spark):
    """With many labels of other documents the sample stays whole."""
    from swatchwork.llm.toxicity import score_toxicity, train_toxicity

    rows = [(i, f"number {i} is {'a vile rotten wretch' if i % 5 == 0 else 'a plain kind person'} of town {i % 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    there = [(i, 0, int(i % 5 == 0)) for i in range(200)]
    for labels in (there, there + [(10_000 + i, 0, 1) for i in range(20_000)]):
        model = train_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert {r.doc_id for r in score_toxicity(docs, model).filter("predicted = 1").collect()} == {i for i in range(0, 200, 5)}


def test_scores_are_sums_over_ngrams(spark):
    """Features, log-count ratios and scores against plain Python over the same rows."""
    import math
    import zlib

    import numpy as np

    from swatchwork.llm.toxicity import ToxicityParams, _ngrams, score_toxicity, train_toxicity

    rows = [(i, f"text {i % 3} {'vile rotten' if i % 4 == 0 else 'plain kind'} \u00c9t\u00e9 {i % 5}") for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    p = ToxicityParams()
    model = train_toxicity(docs, labels, p)
    grams = lambda t: set(np.concatenate([np.unique(g) for g in _ngrams(t or "", p.lengths)] or [np.zeros(0, np.uint64)]).tolist())
    text = lambda t: f" {(t or '').lower()} "
    assert all(len(grams(t)) == len({text(t)[i : i + n] for n in p.lengths for i in range(len(text(t)) - n + 1)}) for _, t in rows), "keys stand for n-grams"
    train = [(t, i % 4 == 0) for i, t in rows[:120] if zlib.crc32(str(i).encode()) % 5]
    held = lambda toxic, key: sum(key in grams(t) for t, y in train if y == toxic)
    n1, n0 = sum(y for _, y in train), sum(not y for _, y in train)
    assert len(model.keys) and all(held(True, int(k)) >= p.least_docs for k in model.keys)
    # A weight is the ratio times a learned factor, so n-grams of equal ratio in the same rows have equal weights.
    ratio = {k: math.log((held(True, k) + 1) / (n1 + 2)) - math.log((held(False, k) + 1) / (n0 + 2)) for k in model.keys.tolist()}
    assert all(w == 0 for k, w in zip(model.keys.tolist(), model.weights) if ratio[k] == 0)
    alike = {}
    for k, w in zip(model.keys.tolist(), model.weights):
        alike.setdefault(tuple(k in grams(t) for t, _ in train), set()).add(round(w, 9))
    assert all(len(v) == 1 for v in alike.values())
    want = {i: 1 / (1 + math.exp(-(model.bias + sum(w for k, w in zip(model.keys.tolist(), model.weights) if k in grams(t))))) for i, t in rows}
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert all(abs(got[i].score - want[i]) < 1e-9 and got[i].predicted == int(want[i] >= 0.5) for i, _ in rows)


def test_random_event_logs_fold_like_a_loop(spark):
    import random

    from swatchwork.llm.chat import fold_events

    rng = random.Random(12)
    log = [(c, s, rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete"]), rng.randint(1, 4), rng.choice([None, "user", "assistant"]), rng.choice([None, "a", "b ", "c\n"])) for c in range(40) for s in range(rng.randint(1, 30))]
    log = [e for e in log if rng.random() < 0.9]
    want = {}
    for c, s, kind, m, role, text in log:
        have = want.setdefault((c, m), {"role": None, "text": "", "gone": False})
        have["role"] = have["role"] if have["role"] is not None else role
        if kind == "delta":
            have["text"] += text or ""
        else:
            have["text"] = (text or "") if kind in ("message", "edit") else ""
            have["gone"] = kind == "delete"
    got = {(r.conv_id, r.message): (r.role, r.text) for r in fold_events(spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string").repartition(4)).collect()}
    assert got == {k: (v["role"] or "", v["text"]) for k, v in want.items() if not v["gone"]}


def test_loose_forms_in_number(spark):
    """A corpus of mostly loose forms and as many numbers of other kinds: recall and precision on planted spans,
    also where few base spans are there to learn from."""
    import random

    from swatchwork.llm.pii import personal_data

    rng = random.Random(20)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k - 1)) + "7"
    base = [f"reach bob{i}@firm{i % 5}.org or +1 (2{n(2)}) 5{n(2)}-4{n(3)} now" for i in range(25)]
    loose = [f"reach anna{i} [at] example{i % 9} [dot] org or (2{n(2)}) 3{n(2)}-1{n(3)} now" for i in range(150)]
    other = [f"{w} {v} of it" for i in range(60) for w, v in (("order", f"4{n(2)} 5{n(2)} 6{n(3)}"), ("since", f"2{n(1)}21-04-{10 + i % 18}"), ("costs", f"12 345 678"), ("see", f"version [at] line 4"), ("code", n(11)))]
    texts = base + loose + other
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.extra] for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    planted = range(25, 175)
    hits = sum(("email", texts[i].split(" or ")[0].removeprefix("reach ")) in got[i] for i in planted) + sum(("phone", texts[i].split(" or ")[1].removesuffix(" now")) in got[i] for i in planted)
    all_ = sum(map(len, got.values()))
    assert hits >= 0.95 * 300 and hits >= 0.95 * all_
    assert all_ > 0 and not any(got[i] for i in range(25))
