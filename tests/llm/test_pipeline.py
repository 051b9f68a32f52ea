"""The pipeline's stages one after the other, each against brute force over all that the one before kept."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, fingerprint, plain

import corpus_pipeline
from dyadica.llm import packing, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with copies, near copies, toxic rows, null and repeated ids, null and empty texts, a clashing column."""
    path = f"file://{tmp_path_factory.mktemp('pipeline')}"
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    long = [r for r in rows if r["text"] and len(r["text"].split()) > 200][:6]
    bad = [r["text"] for r in docs.join(known.where("toxic = 1"), "doc_id").orderBy("doc_id").limit(4).collect()]
    more = []
    for n, r in enumerate(long):
        words = r["text"].split()
        near = " ".join([*words[:90], "changed", *words[91:]])
        more += [(5000 + n, r["text"]), (None if n % 2 else 5100 + n, "  ".join(words)), (5200 + n, near), (r["doc_id"], near + " and on")]
    more += [(5300 + n, t) for n, t in enumerate(bad)] + [(None, bad[0]), (None, None), (5400, None), (5401, ""), (5402, " \n"), (None, "alone here"), (5403, "alone  here")]
    rows += [{"doc_id": i, "text": t, "lang": None, "source": "planted" if n % 3 else None, "n_chars": None} for n, (i, t) in enumerate(more)]
    table = spark.createDataFrame(rows, docs.schema).withColumn("exact_row", F.lit("own"))
    table.repartition(3).write.parquet(f"{path}/documents.parquet")
    known.write.parquet(f"{path}/labels.parquet")
    return path


def naive_score(lexicon, text):
    folded, hits, spared = toxicity.fold(text), {}, []

    def places(entry):
        at = folded.find(entry)
        while at >= 0:
            yield at
            at = folded.find(entry, at + 1)

    for entry, weight in lexicon.weights.items():
        for at in places(entry):
            hits[at] = max(weight, hits.get(at, 0.0))
    for phrase in lexicon.exceptions:
        spared += [(at, at + len(phrase)) for at in places(phrase)]
    left = [w for at, w in hits.items() if not any(low <= at < high for low, high in spared) and w > 0]
    total, words = sum(left), max(folded.count(" ") - 1, 0)
    x = [1.0, math.log1p(total), math.log1p(100 * total / (words + 20)), math.log1p(len(left))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(lexicon.curve, x))))


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def check_toxicity(spark, before, after, folder):
    lexicon = toxicity.learn_lexicon(before["df"],
                                     spark.read.parquet(f"{folder}/labels.parquet"))
    assert lexicon.weights and lexicon.curve
    want = Counter((r["doc_id"], r["text"]) for r in before["rows"] if naive_score(lexicon, r["text"]) < 0.3)
    assert Counter((r["doc_id"], r["text"]) for r in after["rows"]) == want
    assert 4 <= len(before["rows"]) - len(after["rows"]) < len(before["rows"]) / 4


def check_exact(spark, before, after, folder):
    groups = {}
    for r in before["rows"]:
        groups.setdefault(plain(r["text"] or ""), []).append(r["doc_id"])
    assert Counter((r["doc_id"], plain(r["text"] or "")) for r in after["rows"]) == Counter((least(ids), t) for t, ids in groups.items())
    assert len(before["rows"]) - len(after["rows"]) >= 8


def check_simhash(spark, before, after, folder):
    value = [fingerprint(r["text"]) for r in before["rows"]]
    near = [(a, b) for a in range(len(value)) for b in range(a) if (value[a] ^ value[b]).bit_count() <= 2]
    groups = {}
    for at, root in brute_components(range(len(value)), near).items():
        groups.setdefault(root, []).append(before["rows"][at])
    kept = Counter((r["doc_id"], r["text"]) for r in after["rows"])
    assert sum(kept.values()) == len(groups) < len(before["rows"])
    for group in groups.values():
        mine = [(r["doc_id"], r["text"]) for r in group if r["doc_id"] == least(x["doc_id"] for x in group)]
        assert any(kept[m] for m in mine)


def check_mixing(spark, before, after, folder):
    size, own, taken, times = Counter(), {}, Counter(), Counter()
    for r in before["rows"]:
        words = (r["text"] or "").split()
        size[r["source"]] += len(words)
        own.setdefault(r["doc_id"], Counter()).update(words)
    got = {}
    for r in after["rows"]:
        words = r["text"].split()
        taken[r["source"]] += len(words)
        got.setdefault(r["doc_id"], Counter()).update(words)
        times[r["doc_id"]] += 1
    for i, words in got.items():
        assert all(n <= 2 * own[i][w] for w, n in words.items())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, want, free = dict(zip(order, [5, 2, 1] * len(order))), {}, set(order)
    while True:
        rest = 1.5 * sum(size.values()) - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * size[s]}
        if not over:
            break
        want |= {s: 2 * size[s] for s in over}
        free -= over
    want |= share
    assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in order)
    assert max(r["n_chars"] - len(r["text"]) for r in after["rows"]) == min(r["n_chars"] - len(r["text"]) for r in after["rows"]) == 0


def check_packing(spark, before, after, folder):
    from tokenizers import Tokenizer
    tokens = Tokenizer.from_file(packing.tokenizer_path())
    wanted, pieces, sequences = {}, {}, {}
    for r in before["rows"]:
        ids = np.array(tokens.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        wanted.setdefault(r["doc_id"], []).append(ids)
    for r in after["rows"]:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(wanted)
    for i, texts in wanted.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, texts))
        held = Counter()
        for r in pieces[i]:
            at = slice(r["start"], r["start"] + r["length"])
            assert any(len(t) == r["doc_tokens"] and zlib.crc32(t[at].tobytes()) == r["ids_crc32"] for t in texts)
            held.update((r["doc_tokens"], k) for k in range(at.start, at.stop))
        assert held == Counter((len(t), k) for t in texts for k in range(len(t)))
    for spans in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048
    full = sum(sum(n for _, n in spans) for spans in sequences.values())
    assert len(sequences) <= full / 2048 + 65


CHECKS = {"toxicity": check_toxicity, "exact_dedup": check_exact, "simhash_dedup": check_simhash, "mixing": check_mixing, "packing": check_packing}


def test_every_stage_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == list(CHECKS)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{name}")
        after = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert name == "packing" or after.columns == docs.columns
        CHECKS[name](spark, {"df": docs, "rows": rows_of(docs)}, {"df": after, "rows": rows_of(after)}, folder)
        docs = after
    whole = rows_of(corpus_pipeline.run(spark, folder))
    key = lambda rows: Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert key(whole) == key(rows_of(docs))


def test_nothing_in_nothing_out(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
