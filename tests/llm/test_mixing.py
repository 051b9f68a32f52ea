"""The mix's plan: what grows with the corpus is never broadcast."""

import pytest

from dyadica.llm import mixing


@pytest.fixture
def docs(spark):
    rows = [(i, f"s{i % 3}", "w " * (40 + i % 7)) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def _broadcast_generators(plan):
    """Broadcasts of the plan above rows that were exploded: their number follows the corpus, not the plan's estimate."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            for below in lines[i + 1:]:
                start = len(below) - len(below.lstrip(" :+-*0123456789()"))
                if start <= depth:
                    break
                found += [line] * ("Generate" in below or "Range" in below)
    return found


def test_slots_and_draws_are_not_broadcast(docs, monkeypatch):
    plans, real = [], mixing.pinned
    monkeypatch.setattr(mixing, "pinned", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    _, _, pieces = mixing.mix_pieces(docs, block=16, shard_slots=8)
    plans.append(pieces._jdf.queryExecution().executedPlan().toString())
    assert sum("Generate" in plan for plan in plans) >= 2
    assert [line for plan in plans for line in _broadcast_generators(plan)] == []
    assert pieces.groupBy().agg({"to_word": "count"}).first()[0] > 300
