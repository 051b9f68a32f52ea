"""Licence scans against plain loops over lines with the trained weights."""

import math

import pytest

from dyadica.llm import licences
from dyadica.llm.licences import CLASSES, CONFIRM, TEMPLATES, plain_grams, plain_pairs, plain_words

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, line string, words string, family string"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(corpus):
    return licences.train(corpus)


def smallest_runs(lines, at, end, family):
    """Every run of lines, every template; a run counts if no run inside it confirms the template too."""
    out = set()
    for t in TEMPLATES[family]:
        pairs = set(plain_pairs(plain_words(t)))
        fits = []
        for size in range(1, min(end - at + 1, 40) + 1):
            for low in range(at, end - size + 2):
                words = [w for line in lines[low:low + size] for w in line]
                if any(low <= a and b < low + size for a, b in fits):
                    continue
                if len(pairs & {" ".join(words[i:i + 2]) for i in range(len(words) - 1)}) >= CONFIRM * len(pairs) - 1e-9:
                    fits.append((low, low + size - 1))
        out |= {i for a, b in fits for i in range(a, b + 1)}
    return out


def plain_scan(text, model):
    """(families, lines, probability, similarity) of one text: every unit of every family, every template."""
    lines = [plain_words(x) for x in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    grams = [{g for g in plain_grams(" ".join(w)) if g in model.weights} for w in lines]
    families, counted, best, share = set(), set(), None, None
    for k, family in enumerate(CLASSES):
        if not k:
            continue
        speaking = [any(family in model.speaks_for(g) for g in found) for found in grams]
        at = 0
        while at < len(lines):
            if not speaking[at]:
                at += 1
                continue
            end = at
            while end + 1 < len(lines) and speaking[end + 1]:
                end += 1
            held = set().union(*grams[at:end + 1])
            raw = [v + sum(model.weights[g][c] for g in held) for c, v in enumerate(model.intercepts)]
            p = math.exp(raw[0] - max(raw)) / sum(math.exp(r - max(raw)) for r in raw)
            words = [w for line in lines[at:end + 1] for w in line]
            pairs = {" ".join(words[i:i + 2]) for i in range(len(words) - 1)}
            fit = max(len(pairs & set(plain_pairs(plain_words(t)))) / len(plain_pairs(plain_words(t))) for t in TEMPLATES[family])
            if raw.index(max(raw)) == k and p <= model.cutoff and fit >= CONFIRM:
                families.add(family)
                best, share = max(best or 0, 1 - p), max(share or 0, fit)
                counted |= smallest_runs(lines, at, end, family)
            at = end + 1
    return ",".join(sorted(families)) or None, len(counted), best, share


LONG = "\n".join(f"plain words of line {i} in the file" for i in range(4000))
TEXTS = [None, "", "\n\n", "All rights reserved.", "\r\nCC BY 4.0\rMIT\r\n", "The MIT License (MIT)\n\nThe MIT License (MIT)",
         "Apache\nLicense\n2.0", "released under the\nMIT\nLicense", LONG + "\nReleased under the MIT License.\n" + LONG,
         "licensed under the Apache License, Version 2.0 or the MIT license", "GNU GPL\nCC0 1.0\nCC BY-SA 4.0", "license " * 3000,
         "LICENSED UNDER THE BSD 3-CLAUSE LICENSE", "a licence to fish", "public\ndomain\nunder\nCC0\n1.0", "permission is hereby"]
TEXTS += ["prose before\n" + t + "\nprose of the day" for texts in TEMPLATES.values() for t in texts]
TEXTS += ["\n".join([" ".join(t.split()[:3]), " ".join(t.split()[3:6]), " ".join(t.split()[6:])]) for texts in TEMPLATES.values() for t in texts if len(t.split()) > 6]
TEXTS += ["\n".join(t.split()) for texts in TEMPLATES.values() for t in texts if len(t.split()) > 9]  # a word a line: over ten lines


def test_scan_equals_plain_loops(spark, corpus, model):
    texts = TEXTS + [r["text"] for r in corpus.collect()]
    rows = [(i, t, "r", "l", "w", "f") for i, t in enumerate(texts)] + [(3, TEXTS[4], "r", "l", "w", "f"), (None, TEXTS[3], "r", "l", "w", "f")]
    found = licences.licence_scan(spark.createDataFrame(rows, SCHEMA).repartition(5), model=model).collect()
    assert len(found) == len(rows)
    want = sorted(((i, *plain_scan(t, model)) for i, t, *_ in rows), key=str)
    got = sorted((tuple(r) for r in found), key=str)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3:] == (None, None) or g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=1e-9), (g, w)


def test_every_template_is_found_whole_and_clipped_and_wrapped(model):
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            for form in (text, text.upper(), f"Copyright 2021 Someone. {text}", " ".join(words[:-1]) if len(words) > 5 else text):
                assert family in (plain_scan(form, model)[0] or ""), form
    clean = ["the rights of all are reserved here", "a license to fish in the river", "general public of the city", "this is free", "version 2.0 of the plan"]
    assert [plain_scan(t, model)[0] for t in clean] == [None] * len(clean)


def test_model_is_bounded_and_sparse(model):
    assert set(model.weights) <= set(licences.vocabulary()) and 0 < len(model.weights) < len(licences.vocabulary())
    assert model.cutoff <= 0.5 and all(len(w) == len(CLASSES) for w in model.weights.values())
    for gram in model.weights:
        if model.speaks_for(gram):
            assert set(gram.split(" ")) & set(model.triggers())


def test_empty_corpus(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert licences.licence_scan(none).collect() == []


def test_training_counts_every_line_of_the_corpus(spark):
    rows = [(i, "\n".join(["The  License, of", "", f"plain text x{i}", *["more of the same"] * 5, "Released under the MIT License"])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {(tuple(r["grams"]), r["half"]): r["n"] for r in licences.gram_sets(docs).collect()}
    assert sum(sets.values()) == 8 * 4000
    known = set(licences.vocabulary())
    assert {grams for grams, _ in sets} == {tuple(sorted(plain_grams(line) & known)) for line in rows[0][1].split("\n") if line}
    model = licences.train(docs)
    assert (model.common["license"], model.common["of"], model.common["mit"]) == (8000, 24000, 4000)
