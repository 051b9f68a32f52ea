"""Every operator against brute force on a small fixture with the awkward cases in it."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dyadica.llm import QUERIES
from dyadica.llm import exact, licences, mixing, packing, sharding, simhash, substrings, toxicity, urls, vectors

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, kept string, _text string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PASSAGE = "a passage of some length that several of these documents share between them"
ROWS = [
    (1, "same  text\there", "en", "a", "x", "y"), (2, "same text here", "en", "a", None, None),
    (3, None, "en", "b", None, None), (4, "", None, None, None, None), (5, LONG, "en", "a", None, None),
    (6, "head one " + PASSAGE + " tail one", "de", "b", None, None),
    (7, "other " + PASSAGE + " and an end", "de", None, None, None),
    (8, PASSAGE + PASSAGE, "de", "a", None, None), (9, "same text here", "en", "a", None, None),
    (9, "same text here", "en", "a", None, None), (None, "same text here", "en", "c", None, None),
    (11, "çà été  naïve\n\nline \n two", "fr", "c", None, None), (12, LONG + " more", "en", "b", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def test_exact(docs, none):
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(plain(t or ""), []).append(i)
    want = []
    for i, t, *_ in ROWS:
        ids = groups[plain(t or "")]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(plain(t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact.exact_groups(docs).collect()]
    assert Counter(got) == Counter(want)
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 5, 6, 7, 8, 11, 12]
    assert exact.exact_groups(none).count() == 0


def test_drop_exact_duplicates_by_row(spark):
    rows = [(1, "a  b"), (1, "a b"), (2, "a b"), (None, "n"), (None, "n"), (3, "c"), (3, "d"), (4, "d"), (None, "d"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in left.collect())
    assert got == Counter([(1, "a b"), (None, "n"), (3, "c"), (3, "d"), (5, "")])


def test_targets(spark):
    rows = [("a", 10), ("b", 1000), ("c", 500), (None, 100), ("d", 0)]
    sizes = spark.createDataFrame(rows, "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    size, weight = dict(rows), dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, free = {}, set(size)
    while True:
        rest = 1.5 * sum(size.values()) - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * size[s]}
        if not over:
            break
        want |= {s: 2 * size[s] for s in over}
        free -= over
    want |= share
    assert got == pytest.approx(want)


def test_mixing(docs, none):
    sizes, goals, pieces = mixing.mix_pieces(docs, block=16, shard_slots=50)
    target = {r["source"]: (r["quota"], r["source_size"]) for r in goals.collect()}
    rows = pieces.collect()
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["to_word"] - r["from_word"]
    assert {s: taken[s] for s in target} == {s: q for s, (q, _) in target.items()}
    seen = Counter((r["row"], r["epoch"], w) for r in rows for w in range(r["from_word"], r["to_word"]))
    assert max(seen.values()) == 1 and {r["epoch"] for r in rows} <= {0, 1}
    shards = {(r["source"], r["slot"]): r["shard"] for r in rows}
    assert len(set(shards.values())) > 10
    mixed = mixing.mixed_documents(docs.where("doc_id <> 9"), block=16)
    assert mixed.columns == docs.columns
    words = Counter(w for r in mixed.collect() for w in r["text"].split())
    assert max(words.values()) <= 2 * max(Counter(w for _, t, *_ in ROWS for w in (t or "").split()).values())
    assert mixing.mixed_documents(none).count() == 0


def test_mixed_documents_by_row(spark):
    """Null ids take part, and rows that repeat an id with another text do not cut each other."""
    rows = [r[:5] + (str(n),) for n, r in enumerate([*ROWS, (11, " ".join(f"own{i}" for i in range(300)), "en", "c", None, None),
                                                     (None, " ".join(f"none{i}" for i in range(90)), "en", "a", None, None)])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    _, goals, pieces = mixing.mix_pieces(docs, block=16)
    quota = {r["source"]: r["quota"] for r in goals.collect() if r["quota"]}
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    got, taken, by_row = mixed.collect(), Counter(), {}
    for r in got:
        words = r["text"].split()
        taken[r["source"]] += len(words)
        by_row.setdefault(int(r["_text"]), Counter()).update(words)
    assert taken == quota
    for n, words in by_row.items():
        own = Counter((rows[n][1] or "").split())
        assert all(k <= 2 * own[w] for w, k in words.items())
    assert {10, 13, 14} <= set(by_row)
    assert max(Counter(r["_text"] for r in got).values()) <= 2


def test_substrings(docs, none):
    first, want = {}, []
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        b, key = (t or "").encode(), float("inf") if i is None else i
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p:p + 50], key) < key:
                cover[p:p + 50] = b"\1" * 50
        left = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(bool(k) for k, _ in itertools.groupby(cover))
        want.append((i, len(b), sum(cover), spans, hashlib.sha256(left).hexdigest()))
    got = [tuple(r) for r in substrings.repeated_substrings(docs).drop("kept").collect()]
    assert Counter(got) == Counter(want) and sum(w[2] for w in want) > len(LONG)
    alone = substrings.repeated_substrings(docs, crowded=0).drop("kept").collect()  # every string on its own
    assert Counter(tuple(r) for r in alone) == Counter(want)
    assert substrings.repeated_substrings(none).count() == 0


@pytest.mark.parametrize("chunk", [1, 500, 1 << 20])
def test_string_minima(chunk):
    rng = np.random.default_rng(2)
    shared = [bytes(rng.integers(97, 110, 32, dtype=np.uint8)) for _ in range(4)]
    segments = {(a, bytes(rng.integers(97, 99, 1 + a, dtype=np.uint8)) + shared[a] + bytes(rng.integers(97, 99, 18, dtype=np.uint8)) + b"ends"[:a])
                for a in range(4) for _ in range(200)} | {(9, b"x" * 60)}
    segments = sorted(segments)
    least = rng.permutation(len(segments))
    want: dict = {}
    for (a, s), d in zip(segments, least):
        for i in range(len(s) - 49):
            want[a, s[i:i + 50]] = min(int(d), want.get((a, s[i:i + 50]), 10 ** 9))
    minima, base = substrings.string_minima([a.to_bytes(4, "little") + s for a, s in segments], least, chunk)
    for k, (a, s) in enumerate(segments):
        assert minima[base[k]:base[k + 1]].tolist() == [want[a, s[i:i + 50]] for i in range(len(s) - 49)]


def test_intervals():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.tile(rng.integers(1, 4, 70), 3), rng.integers(1, 3, 300), [0]]).astype(np.int16)
    order, interval = substrings.classes(text)
    prefixes = {}
    for row, at in enumerate(order):
        if at + 50 < len(text):
            prefixes.setdefault(text[at:at + 50].tobytes(), set()).add(int(interval[row]))
    shared = Counter(text[at:at + 50].tobytes() for at in order if at + 50 < len(text))
    for prefix, names in prefixes.items():
        assert len(names) == 1 and (names == {-1}) == (shared[prefix] == 1)


def test_urls(spark):
    given = [(1, "https://A.Net/x"), (2, "http://sub.example.net/en/a?q"), (3, "x://example.net"), (4, None), (5, "no url"),
             (6, "http://example.com/de/#a"), (7, "http://badexample.com/de/"), (8, "http://a.org/fr/1"), (8, "http://a.org/fr/1"), (9, "")]
    pages = spark.createDataFrame([(*g, "h", "r") for g in given], "page_id long, url string, html string, rule string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages).collect())
    assert got == Counter([
        (1, "a.net", "/x", "net/", "block"), (2, "sub.example.net", "/en/a", "example.net/en/", "allow"),
        (3, "example.net", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "example.com", "/de/", "example.com/de/", "block"), (7, "badexample.com", "/de/", None, "allow"),
        (8, "a.org", "/fr/1", "org/fr/", "allow"), (8, "a.org", "/fr/1", "org/fr/", "allow"), (9, "", "", None, "allow")])
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    hosts = [f"h{i}.site{i % 97}.test" for i in range(5000)]
    rules = [("block", h, "/") for h in hosts[::7]]
    pages = spark.createDataFrame([(h, "/a") for h in hosts], "host string, path string")
    cascade = urls.build_cascade(pages, rules)
    listed = {h + "/" for _, h, _ in rules}
    assert all((k in cascade) == (k in listed) for h in hosts for k in urls.candidates(h, "/a", [1]))


def test_shards(docs, none):
    rows = sharding.kd_shards(docs, 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.kd_shards(none, 4).count() == 0


def test_shards_are_even(spark):
    rows = [(i, "x" * (50 + i * 37 % 400), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8)
    held = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(held) == 8 and max(held) < 1.02 * min(held)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("cell", [4096, 2])
def test_simhash(spark, docs, none, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    got = {r["doc_id"]: (r["fp"] % 2 ** 64, r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    value = {i: fingerprint(t) for i, t, *_ in ROWS}
    ids = [i for i in value if i is not None]
    linked = [(a, b) for a in ids for b in ids if bin(value[a] ^ value[b]).count("1") <= 2]
    root = brute_components(ids, linked)
    assert all(got[i] == (value[i], root[i]) for i in ids)
    assert got[None][1] == root[2]
    assert simhash.simhash_groups(none).count() == 0


def test_drop_near_duplicates_by_row(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcde"}
    rows = [(1, text["a"], "stays"), (None, text["a"], "goes"), (None, text["b"], "stays"),  # a null id in a group, one alone
            (5, text["a"], "goes"), (5, text["c"], "stays"), (6, text["c"], "goes"),  # 5 names one group, is a copy in another
            (7, text["d"], "one of d"), (7, text["d"] + "\n", "one of d"), (8, text["d"], "goes"),
            (None, text["e"], "one of e"), (None, text["e"], "one of e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r["fp"] for r in left.collect()) == Counter({"stays": 3, "one of d": 1, "one of e": 1})


@pytest.mark.parametrize("cell", [4096, 3])
def test_simhash_cells_lose_no_pair(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (12, 2))}
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    dealt = simhash._dealt(nodes)
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = dealt.join(sizes, "cell").cache()
    edges = simhash._links(shared.where(F.col("n") <= cell), 2).unionByName(
        simhash._links(simhash._dealt_again(shared.where(F.col("n") > cell)), 2))
    got = brute_components(signed, [(r["u"], r["v"]) for r in edges.collect()])
    want = brute_components(signed, [(a, b) for a, b in itertools.combinations(signed, 2)
                                     if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2])
    assert got == want


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    near = np.repeat(base[:12], 5, axis=0) + rng.normal(size=(60, 32)) * 0.12
    found = np.concatenate([base, near, base[:3]]).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(found)]
    odd = [(900, None), (901, [0.0] * 32), (902, [None] + [1.0] * 31), (903, [float("nan")] * 32), (904, [1.0])]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows + odd], "vec_id long, embedding array<double>, label int, kept string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.vector_links(frame).collect()}
    unit = found / np.linalg.norm(found, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    root = brute_components(range(len(rows)), [(i, j) for i, j in zip(*np.nonzero(close))])
    exact_ = sum(got[i] == (close[i].sum(), root[i], root[i] == i) for i in range(len(rows)))
    assert sum(got[i][0] for i in range(len(rows))) >= 0.95 * close.sum() and exact_ >= 0.9 * len(rows)
    assert all(got[i][0] <= close[i].sum() for i in range(len(rows)))
    assert all(got[i] == (0, i, True) for i, _ in odd)
    assert vectors.vector_links(frame.limit(0)).count() == 0


def test_crowded_cell_loses_no_link():
    """2048 vectors in one cell, a thousand pairs just above the threshold: only the count may lose one in a thousand."""
    rng = np.random.default_rng(6)
    base, other = rng.normal(size=(2, 1024, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    unit = np.concatenate([base, 0.9001 * base + np.sqrt(1 - 0.9001 ** 2) * other])
    found = {(int(a), int(b)) for x, y in vectors._pairs(unit, unit, vectors.calibrated(64, 100_000, 0.9)) for a, b in zip(x, y)}
    links = unit @ unit.T >= 0.9
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(links))}
    print(len(found), len(want))
    assert found <= want and len(found) >= 0.997 * len(want)


def test_folding():
    assert toxicity.fold("You IDIOT!!! 1d10t іdіоt ídiot idiot$$$ 2024 a1b") == " you idiot idiot idiot idiot idiot aib "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("  \n") == " "


def test_toxicity(spark, none):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(200)]
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for i in range(1200):
        body = rng.choice(words, 40).tolist()
        bad = i % 5 == 0
        if bad:
            for at in rng.integers(0, 40, 3):
                body[at] = ["vileful", "vilest", "v1l3ness"][at % 3]
        elif i % 7 == 0:
            body[3:5] = ["vilest", "parody"]
        texts.append((i, " ".join(body), "x"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*texts, (5000, None, "x"), (5001, "", "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn_lexicon(docs, known)
    score = {r[0]: r[1] for r in docs.select("doc_id", toxicity.toxicity(model)).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((score[i] >= 0.3) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert any("parody" in e for e in model.exceptions)
    assert score[5000] == score[5001] < 0.3
    left = {r["doc_id"] for r in toxicity.drop_toxic(docs, known).collect()}
    assert {5000, 5001} <= left and sum(i in left for i in range(0, 1200, 5)) < 12
    empty = toxicity.learn_lexicon(none, known.limit(0))
    assert empty.curve is None and none.select(toxicity.toxicity(empty)).count() == 0


def test_licences(spark):
    corpus = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    planted = spark.createDataFrame([
        (9001, "Some words.\nReleased under the MIT License.\nMore words"), (9002, None), (9003, ""),
        (9004, "Licensed under the Apache License, Version 2.0."), (9005, "a license to fish in the river is sold here")], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(corpus.unionByName(planted)).collect()}
    assert (got[9001], got[9002], got[9003], got[9004], got[9005]) == ("mit", None, None, "apache", None)


NOTICES = [
    ("proprietary", "All rights reserved."), ("proprietary", "Copyright 2020 Acme Inc. All rights reserved."),
    ("proprietary", "Reproduction without permission\nis prohibited."), ("apache", "Apache License 2.0"),
    ("apache", "Licensed under the Apache\nLicense, Version 2.0"), ("mit", "The MIT License (MIT)"),
    ("mit", "Permission is hereby granted, free of charge,\nto any person obtaining a\ncopy of this software"),
    ("gpl", "released under the GNU GPL version 2"), ("bsd", "BSD 3-Clause License"), ("cc-by", "CC BY 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify\n"
            "it under the terms of the GNU General Public License as published by"),
    ("bsd", "Redistribution and use in source and binary\nforms, with or without modification, are permitted"),
    ("cc-by-nc", "CC BY-NC 4.0"), ("cc-by-nc", "licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons\nAttribution 4.0 International License"), ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License"),
    ("cc0", "CC0 1.0 Universal"), ("cc0", "Dedicated to the public\ndomain under CC0 1.0"), ("mpl", "Mozilla Public License 2.0"),
    ("mpl", "This Source Code Form is subject to the\nterms of the Mozilla Public License, v. 2.0"),
]


def test_short_and_wrapped_licences(spark):
    corpus = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = [(90_000 + i, f"Some plain words stand here\n{text}\nand others follow after it") for i, (_, text) in enumerate(NOTICES)]
    rows += [(91_000, "All rights reserved.\n\nplain\nAll rights reserved."), (91_001, "the rights of all are reserved here"),
             (91_002, "All rights\n\nreserved"), (None, "CC BY 4.0"), (91_003, "a"), (91_003, "MIT\nThe MIT License (MIT)")]
    found = licences.licence_scan(corpus.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    got = Counter((r["doc_id"], r["licences"], r["n_licence_lines"]) for r in found if r["doc_id"] is None or r["doc_id"] >= 90_000)
    # Two of the three lines of MIT's permission hold enough of it, and the fewest count.
    want = Counter((90_000 + i, family, min(2, text.count("\n") + 1)) for i, (family, text) in enumerate(NOTICES))
    assert got == want + Counter([(91_000, "proprietary", 2), (91_001, None, 0), (91_002, None, 0), (None, "cc-by", 1),
                                  (91_003, None, 0), (91_003, "mit", 1)])


def test_licences_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    notice = F.regexp_extract("line", "(All rights reserved|MIT License|Apache License|CC BY-NC|GNU General)", 1)
    names = {"All rights reserved": "proprietary", "MIT License": "mit", "Apache License": "apache", "CC BY-NC": "cc-by-nc", "GNU General": "gpl"}
    want = Counter((r["doc_id"], names[r["n"]]) for r in lines.select("doc_id", notice.alias("n")).where("n <> ''").collect())
    got = {r["doc_id"]: (r["licences"].split(","), r["n_licence_lines"])
           for r in licences.licence_scan(docs).where("licences is not null").collect()}
    assert {(d, f) for d, (families, _) in got.items() for f in families} == set(want)
    assert sum(n for _, n in got.values()) == sum(want.values()) == 328


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer
    tokens = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for i, t, *_ in ROWS:
        want[i] = np.array(tokens.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    rows = packing.pack(docs, windows=2, fan_in=2).collect()
    ends = Counter()
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
        ends[r["doc_id"]] += r["length"]
    assert all(ends[i] == len(want[i]) * Counter(r[0] for r in ROWS)[i] for i in want)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 2048 and sum(n < 2048 for n in sequences.values()) <= 2
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "x \n\n y\t z ", "it's 12,5%&&& naïve", "<|endoftext|> a", "\u00a0 a\u2003b", "end \n"])
def test_encoder(text):
    from array import array
    encoder = packing.Encoder(packing.tokenizer_path())
    assert array("I", encoder.encode([text])[0]).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, FOLDER)
        if name != "packing":
            assert rows.columns == docs.columns
        docs = rows.cache()
    assert docs.count() > 0
    assert all(f"op{n}_" in " ".join(QUERIES) for n in range(1, 11))
