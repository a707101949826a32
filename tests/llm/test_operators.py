"""Operators on hand-made edge cases and against plain Python versions."""

import random
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "The cat\u00a0sat.\nThe cat\u00a0sat.\n\nEnd"), (6, "x " * 30_000), (7, "plain " * 9), (8, "plain " * 9),
    (9, "\U0001f600 \u00e9\u0301 \ufb01 <|endoftext|> [INST] \x00\x1c"), (10, "a" * 5000), (11, "Mail bob.roe@mail1.example.com, 4111 1111 1111 1111, +1 (229) 555-4838, 10.0.0.300 10.0.0.3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge texts, a repeated row, a null id, and extra columns with names that operators use inside."""
    rows = [*ODD, ODD[6], (None, "nobody knows this text at all")]
    cols = {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("x"), "row": F.lit(1), "key": F.lit(2), "rank": F.lit(3), "component": F.lit(4), "host": F.lit("h"), "base": F.lit(5)}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(cols)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def everything(spark, docs):
    """All operators on one table of documents."""
    from swatchwork.llm import decontam, licenses, linequality, neardup, packing, pii, tokencount, toxicity

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "plain plain"), (2, None), (3, "")], "item_id long, text string")
    return {
        "licenses": licenses.scan_licenses(docs), "toxicity": toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)),
        "packing": packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")), "lines": linequality.line_quality(docs), "near": neardup.near_duplicates(docs),
        "tokens": tokencount.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")), "leaks": decontam.decontaminate(docs, bench), "pii": pii.span_strings(pii.personal_data(docs)),
    }


def test_odd_rows_keep_their_place(spark, odd):
    for name, df in everything(spark, odd).items():
        got = by_id(df)
        assert set(got) == {*range(1, 12), None}, name
        assert name == "packing" or (len(got[7]) == 2 and len(got[1]) == 1), name


def test_empty_tables(spark, odd):
    for name, df in everything(spark, odd.limit(0)).items():
        assert df.count() == 0, name


def test_near_duplicates_of_odd_rows(odd):
    from swatchwork.llm.neardup import near_duplicates

    got = by_id(near_duplicates(odd))
    assert got[8][0].component_id == 7 and not got[8][0].kept and got[7][0].kept
    assert all(got[i][0].n_shingles == 0 and got[i][0].component_id == i for i in (1, 2, 3))
    assert got[None][0].component_id is None and got[None][0].kept


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 40, 80]))]
        for _ in range(rng.choice([1, 2, 6, 30])):
            words = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.01, 0.04, 0.1]) else w for w in base]
            rows.append((len(rows), " ".join(words)))
    from swatchwork.llm.neardup import NearDupParams, near_duplicates

    want = brute.components(rows)
    for p in (NearDupParams(), NearDupParams(block=4)):
        got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
        assert got == want


def test_decontamination_like_brute_force(spark):
    from swatchwork.llm.decontam import DecontamParams, decontaminate

    rng = random.Random(1)
    vocab = ["the", "of", "Cat", "a1", "\u00e9t\u00e9", "x"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12]))) for i in range(6)] + [(90, None), (91, "?")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)] + [(99, None)]
    for p in (DecontamParams(window=4), DecontamParams(window=4, pass_windows=1)):
        got = by_id(decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), p))
        for i, t in docs:
            n, hit, found = brute.leaks(t, items, 4)
            r = got[i][0]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)


def test_personal_data_like_brute_force(spark):
    from swatchwork.llm.pii import personal_data, span_strings

    rng = random.Random(5)
    letters = "0123456789" * 2 + " -.+()@ab_%\u017f\u00e9\U0001f600\n,"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(500)] + ODD + [(900, "a@b.c_d@e.f a@b.c@d.e x@y..z@w.q 1.2.3.4.5.6.7.8")]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    for r in span_strings(personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute.pii_base(rows[r.doc_id][1])


def test_redaction(spark):
    from corpus_pipeline import redact_personal_data

    docs = spark.createDataFrame([(1, "to bob@x.org, +1 229 555 4838 \u00e9!", 5), (2, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in redact_personal_data(spark, docs, SF).collect()}
    assert got[1].text == "to [EMAIL], [PHONE] \u00e9!" and got[1].n_chars == len(got[1].text) and got[2].text is None


def test_prefix_counts_of_every_prefix():
    import sentencepiece

    from swatchwork.llm.tokencount import prefix_counter

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), prefix_counter(path), random.Random(2)
    bits = ["the", "an", " ", "  ", "\n", "\u00e9", "\u6f22", "\U0001f600", "12", "tion", ",", "\u2581", "\t", "http://", "ing"]
    for _ in range(150):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        counts = [len(lib.encode(t[:k])) for k in range(len(t) + 1)]
        assert own.prefix_counts(t).tolist() == counts
        for limit in (1, 3, 8):
            assert own.count_and_cut(t, limit) == (counts[-1], max(k for k, c in enumerate(counts) if c <= limit))


def test_packing_is_whole_and_gapless(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from swatchwork.llm.packing import pack

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 100_000))
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, seqs = by_id(pack(docs, public_tokenizers.path("word_bpe_49k.json"))), defaultdict(list)
    total = 0
    for r in docs.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        pieces = sorted(got[r.doc_id], key=lambda p: p.piece)
        assert [(p.start, p.length, p.ids_crc32) for p in pieces] == [(s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
        for p in pieces:
            seqs[p.sequence_id].append((p.offset, p.length))
    for spans in seqs.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(seqs) <= -(-total // 4096) * 1.03 + 1


def test_toxicity_on_held_out_rows(spark):
    from swatchwork.llm.toxicity import score_toxicity, train_toxicity

    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    scored = score_toxicity(docs, train_toxicity(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert scored.score.between(0, 1).all()
    assert (scored.predicted == scored.toxic).mean() > 0.97
    assert scored[scored.toxic == 1].predicted.mean() > 0.8 and scored[scored.toxic == 0].predicted.mean() < 0.01


def test_line_quality_removes_boilerplate(spark):
    from swatchwork.llm.linequality import line_quality

    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    menu = "Home about contact and many other words of one menu line on every page of this site today again now here"
    rows = [(i, menu + "\n" + (fresh(60) if i < 40 else "short end"), "a") for i in range(50)] + [(100 + i, fresh(60), "b") for i in range(5)] + [(200 + i, "same text " + menu + "\n" + menu.upper(), "c") for i in range(60)]
    got = {r.doc_id: r for r in line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept for i in [*range(40), *range(100, 105)])
    assert not any(got[i].kept or got[i].base_failed for i in range(40, 50))
    assert all(got[200 + i].n_left_words == 0 for i in range(60)), "copies of one text count each"


def test_license_rules_in_order(spark):
    from swatchwork.llm.licenses import scan_licenses

    rows = [
        (1, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"),
        (2, "Released under the MIT License.\nfoo bar.\nLicensed under CC BY-NC 4.0."), (3, "nothing about it"),
    ]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].licenses, got[1].n_known) == ("Apache-2.0", 3)
    assert got[2].licenses == "CC-BY-NC-4.0,MIT" and got[3].licenses == ""


def test_urls_with_nested_rules(spark):
    from swatchwork.llm.urlrules import UrlParams, judge_urls

    rng = random.Random(8)
    rules = [("com", "/", "block"), ("example.com", "/en/", "allow"), ("a.example.com", "/en/7", "block"), ("com", "/en/77777", "allow"), ("example.co", "/", "block"), ("org", "", "block")]
    hosts = ["com", "example.com", "EXAMPLE.com", "a.example.com", "b.a.example.com", "xexample.com", "example.co", "example.com.", "x.org", ".org", "net", "a\x01b.com", ""]
    urls = [f"{rng.choice(['http', 'x'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/7?q", "/en/77777#f", "/en/777771", "?a", "#/en/7")] + [None, "", "com/en/7", "a://b://c", "h\nx://com/\nen"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"key": F.lit(1), "depth": F.lit(2), "host": F.lit("z")})
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for r in judge_urls(pages, table, UrlParams(lanes=3)).collect():
        url = urls[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = sorted((-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fits[0][1] if fits else None, fits[0][2] if fits else "allow"), url
    assert {r.verdict for r in judge_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), table).count() == 0


def test_urls_by_the_contract_rules(spark, tmp_path):
    """The contract's list, written out here: each rule's word, in the query and in its SQL."""
    import duckdb

    from swatchwork.llm.entry import QUERIES, SQL

    urls = {
        "x://com/en/1": ("com/en/", "block"), "x://a.example.com/en/7": ("example.com/en/7", "allow"), "x://example.com/en/8": ("com/en/", "block"), "x://net/de/1": ("net/de/", "allow"),
        "x://b.net/de/8": ("net/de/", "allow"), "x://EXAMPLE.net/de/8?q": ("example.net/de/8", "block"), "x://example.net/de/7": ("net/de/", "allow"), "x://w.org/es/": ("org/es/", "block"), "x://w.org/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op6_url_rules"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    twin = {page: (rule, verdict) for page, rule, verdict in db.sql(f"SELECT page_id, rule, verdict FROM ({SQL['op6_url_rules']})").fetchall()}
    assert got == twin == dict(enumerate(urls.values()))


def test_chat_round_trip_and_events(spark):
    from swatchwork.llm import chat

    said = "\\### Assistant: </turn> ok &lt; <turn x>\n"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", said), (2, 0, "assistant", None), (2, None, None, "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (3, 2 * len(said)) and got[2].n_turns == 2 and got[2].loss_chars == 0 and got[None].n_turns == 1
    assert chat.chat_digests(df.limit(0)).count() == 0
    log = [
        (1, 1, "message", 1, "user", "Hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "He"), (1, 4, "delta", 2, None, "llo"), (1, 5, "edit", 1, None, "Hi!"),
        (1, 6, "regenerate", 2, None, None), (1, 7, "delta", 2, None, "Good day"), (1, 8, "message", 3, "user", "bye"), (1, 9, "delete", 3, None, None),
    ]
    folded = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string"))
    assert sorted((r.message, r.role, r.text) for r in folded.collect()) == [(1, "user", "Hi!"), (2, "assistant", "Good day")]


def test_sql_twins(spark):
    from swatchwork.llm import entry
    from tests.oracle import duck, same

    con = duck(SF)
    for name, sql in entry.SQL.items():
        same(entry.QUERIES[name](spark, SF), con, sql)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = P.drop_contaminated(spark, P.drop_near_duplicates(spark, docs, SF), SF)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    parts = brute.components(rows)
    want = {i for i, t in rows if parts[i] == i and not brute.leaks(t, items)[1]}
    assert {r.doc_id for r in kept.collect()} == want
    assert P.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pattern_fit_is_optimal_or_says_so():
    import numpy as np

    from swatchwork.llm.packing import nnls

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, (12, 30)).astype(float), rng.integers(1, 50, 12).astype(float)
    x = nnls(a, b)
    gain = a.T @ (b - a @ x)
    # At the optimum nothing gains by growing, and what is used can't gain by any change.
    assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max() < 1e-6
    with pytest.warns(UserWarning, match="ended after 1 rounds"):
        assert (nnls(a, b, rounds=1) >= 0).all()
