"""Spelling variants against brute force: every pair of words, every chain of forms."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

from dyadica.llm import spelling

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n string, key string, x string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    letters = "abÀéß×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words += [w[:i] + c + w[i + j:] for w in words[:30] for i, c, j in [(rng.randrange(len(w)), rng.choice(letters + "é"), rng.randint(0, 1))]]
    words += ["a" * 6, "a" * 7, "a" * 8, "aabbb", "aaabbb", "UPPER", "Upper", "upper", "Àéèß", "ÀÉÈßß", "àéèßß"]
    texts = [(i, ", ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=300))) for i in range(12)]
    texts += [(None, "upper upper, UPPER"), (3, texts[3][1]), (3, texts[4][1]), (90, None), (91, ""), (92, "x1 y2 ..."),
              (93, "chain " * 3 + "chains " * 6 + "chainss " * 12 + "chainsss " * 24 + "chainssss " * 48),
              (94, ("tiersb " + "tiersa ") * 8 + "tiers " * 4), (95, "y" * 5000 + " " + ("z" * 3000 + "q ") * 3 + ("z" * 3000 + " ") * 9)]
    return texts


def test_groups(spark, rows):
    docs = spark.createDataFrame([(i, t, "w", "n", None, "x") for i, t in rows], SCHEMA).repartition(4)
    counts = plain_counts(rows)
    found = got(spelling.spelling_groups(spelling.word_counts(docs)))
    assert len(found) == len(counts) and set(found) == plain_groups(counts)
    by_word = {r[0]: r for r in found}
    assert by_word["chain"][2] == "chainssss" and by_word["tiers"][1] == "tiersa"


def test_near_words_lists_every_pair_once(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(200)}
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    found = [(r["word"], r["near"]) for r in spelling.near_words(table).collect()]
    assert sorted(found) == sorted((a, b) for a, b in itertools.permutations(words, 2) if one_edit(a, b))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert got(spelling.spelling_groups(spelling.word_counts(docs))) == []


def test_query_equals_sql(spark):
    assert compare(spelling.op11_spelling(spark, FOLDER), connect(FOLDER), spelling.OP11_SQL) is None


def test_plan_has_no_cross_join(spark):
    words = spark.range(100).select(F.concat(F.lit("words"), F.col("id").cast("string")).alias("word"), F.lit(3).cast("long").alias("n"))
    plan = spelling.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
