"""Mixing: the flow against a brute-force search, and what a mix keeps to."""

import itertools
import random

import pytest

from canopyq.llm import mixing


def brute(patterns, quotas, repeats):
    """The most tokens and then the least repetition cost, over all whole-number flows."""
    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for flow in itertools.product(*[range(patterns[p] * repeats[s] + 1) for p, s in arcs]):
        used = {p: sum(x for x, (q, _) in zip(flow, arcs, strict=True) if q == p) for p in patterns}
        if any(used[p] > patterns[p] * max(repeats[s] for s in p) for p in patterns):
            continue
        if any(sum(x for x, (_, t) in zip(flow, arcs, strict=True) if t == s) > quotas[s] for s in quotas):
            continue
        cost = sum(k // patterns[p] for p in patterns for k in range(used[p]))
        best = max(best, (sum(flow), -cost))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest_of_the_greatest(seed):
    rng = random.Random(seed)
    patterns = {("a",): rng.randint(1, 3), ("b",): rng.randint(1, 2), ("a", "b"): rng.randint(1, 2)}
    quotas, repeats = {"a": rng.randint(0, 6), "b": rng.randint(0, 6)}, {"a": rng.randint(1, 2), "b": rng.randint(1, 2)}
    taken = mixing.route(patterns, quotas, repeats)
    used = {p: sum(x for (q, _), x in taken.items() if q == p) for p in patterns}
    cost = sum(k // patterns[p] for p in patterns for k in range(used[p]))
    assert (sum(taken.values()), -cost) == brute(patterns, quotas, repeats)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        source = rng.choices(["big", "small", "rare", "other", None], [60, 20, 2, 10, 2])[0]
        text = rng.choice([None, "", "shared text of two sources"]) if k % 17 == 0 else f"text {k} " * rng.randint(1, 30)
        rows.append((k, text, source, 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("rare", 0.15, 2), ("absent", 0.05, 9)], "source string, target_share double, max_repeats int")
    return docs, targets, rows


def test_mix(made):
    docs, targets, rows = made
    selected, report = mixing.mix(docs, targets)
    chosen, lines = selected.collect(), {r.source: r for r in report.collect()}
    caps = {"big": 1, "small": 3, "rare": 2}
    assert all(1 <= r.uses <= caps[r.source] for r in chosen)
    assert len({(r.doc_id, r.source) for r in chosen}) == len(chosen)
    of = {k: (t, s) for k, t, s, _ in rows}
    assert all(of[r.doc_id][1] == r.source and of[r.doc_id][0] for r in chosen)
    for s, line in lines.items():
        assert line.actual_tokens == sum(r.n_tokens * r.uses for r in chosen if r.source == s)
        assert line.actual_tokens <= line.quota_tokens + 400  # a text more at each end
    assert lines["absent"].actual_tokens == 0 and not lines["absent"].reached
    assert abs(sum(r.actual_share for r in lines.values()) - 1) < 1e-9
    assert {(r.doc_id, r.uses) for r in mixing.mix(docs, targets)[0].collect()} == {(r.doc_id, r.uses) for r in chosen}
    assert {(r.doc_id, r.uses) for r in mixing.mix(docs, targets, seed=2)[0].collect()} != {(r.doc_id, r.uses) for r in chosen}


def test_empty_tables(made):
    docs, targets, _ = made
    selected, report = mixing.mix(docs.limit(0), targets)
    assert selected.collect() == [] and {r.actual_tokens for r in report.collect()} == {0}
    assert mixing.mix(docs, targets.limit(0))[1].collect() == []


def test_bad_targets(made, spark):
    docs, targets, _ = made
    with pytest.raises(ValueError, match="twice"):
        mixing.mix(docs, targets.unionByName(targets))
    odd = spark.createDataFrame([("big", None, None), (None, 0.5, 1), ("small", -1.0, 2)], targets.schema)
    assert {r.actual_tokens for r in mixing.mix(docs, odd)[1].collect()} == {0}


def test_more_than_64_sources(spark):
    docs = spark.createDataFrame([(k, f"text number {k}", f"s{k}") for k in range(70)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(f"s{k}", 1 / 70, 2) for k in range(70)], "source string, target_share double, max_repeats int")
    selected, report = mixing.mix(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert len(got) == 70 and all(r.reached for r in got.values()) and {r.source for r in selected.collect()} == set(got)
