"""Packing by quotas against a plain sequential deficit round-robin, and the mixture of every window."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sequential(totals, weights, window, least):
    """Tokens that each queue serves in each round, by credit that grows a round at a time; dry queues leave their share to the others."""
    names = [*sorted(k for k in totals if weights[k] > 0), *sorted(k for k in totals if weights[k] == 0)]
    heads = [k for k in names if weights[k] > 0]
    tail = sum(totals[k] for k in names if weights[k] == 0)
    speed = {k: Fraction(weights[k]) if weights[k] else Fraction(totals[k], tail) for k in names}
    every = {k: max(1, -(-least // (speed[k] * window))) for k in names}
    credit, served, out, r = dict.fromkeys(names, Fraction(0)), dict.fromkeys(names, 0), [], 0
    while sum(served.values()) < sum(totals.values()):
        turn = {}
        last = (r + 1) * window >= sum(totals.values())
        left = Fraction(window)
        while left > 0:  # credit of this round, shared out among those that have credit to grow
            active = [k for k in heads if credit[k] < totals[k]] or [k for k in names if k not in heads and credit[k] < totals[k]]
            if not active:
                break
            pace = sum(speed[k] for k in active)
            step = min(left / pace, *((totals[k] - credit[k]) / speed[k] for k in active))
            for k in active:
                credit[k] += speed[k] * step
            left -= step * pace
        for i, k in enumerate(names):
            if last:
                due = totals[k]
            elif (r + 1 + i % every[k]) % every[k] == 0:
                due = int(credit[k])
            else:
                due = served[k]
            turn[k], served[k] = max(0, due - served[k]), max(due, served[k])
        out.append(turn)
        r += 1
    return out


@pytest.mark.parametrize(
    ("totals", "weights", "window", "least"),
    [
        ({"a": 1000, "b": 3000, "c": 17}, {"a": 0.25, "b": 0.5, "c": 0.25}, 64, 8),
        ({"a": 999, "b": 37, "c": 500}, {"a": 0.5, "b": 0.5, "c": 0.0}, 32, 4),
        ({"a": 5, "b": 4096}, {"a": 0.015625, "b": 0.984375}, 128, 16),
        ({"x": 1}, {"x": 1.0}, 2048, 32),
    ],
)
def test_rounds_equal_a_sequential_round_robin(totals, weights, window, least):
    plan = packing.Plan.of(totals, weights, window, least)
    expected = sequential(totals, weights, window, least)
    assert plan.rounds == len(expected)
    rng, at = np.random.default_rng(1), 0
    stream = {}
    for turn in expected:
        for k in plan.names:
            stream[k] = [*stream.get(k, []), *range(at, at + turn[k])]
            at += turn[k]
    for q, k in enumerate(plan.names):
        cuts = np.unique([0, totals[k], *rng.integers(0, totals[k] + 1, 20)])
        sizes = np.diff(cuts)
        of, start, length, place, rounds = plan.pieces(np.full(len(sizes), q), cuts[:-1], sizes)
        got = [p + i for n, p in zip(length.tolist(), place.tolist(), strict=True) for i in range(n)]
        assert got == stream[k]
        assert all(sum(expected[r][k] for r in range(rr + 1)) >= cuts[o] + s + n for o, s, n, rr in zip(of, start, length, rounds, strict=True))


def test_weights_are_defined():
    share = lambda totals, weights: dict(zip((p := packing.Plan.of(totals, weights, 64)).names, p.weights.tolist(), strict=True))
    assert share({"a": 1, "b": 3}, None) == {"a": 0.25, "b": 0.75}
    assert share({"a": 1, "b": 3, "c": 1}, {"b": 0.5, "gone": 9.0}) == {"a": 0.25, "b": 0.5, "c": 0.25}
    assert share({"a": 1, "b": 3, "c": 6}, {"a": 3.0, "b": 1.0}) == {"a": 0.75, "b": 0.25, "c": 1.0}, "c comes after the others"
    assert share({"x": 2, "y": 2}, {"x": 0.0, "y": 0.0}) == {"x": 0.5, "y": 0.5}
    assert share({"x": 2}, {"x": 0.0}) == {"x": 1.0}
    for bad in (-0.1, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="weight"):
            packing.Plan.of({"x": 1}, {"x": bad}, 64)


def distances(pieces, target, window):
    """Total variation between each full window's mixture and the target."""
    mix = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        mix[p.sequence_id][p.queue] += p.length
    return {s: sum(abs(m.get(k, 0) / window - target[k]) for k in target) / 2 for s, m in mix.items() if sum(m.values()) == window}


def test_every_window_holds_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs.repartition(5), PATH).select("doc_id", "start", "length", "doc_tokens", "queue", "sequence_id", "offset").collect()
    total = defaultdict(int)
    for p in pieces:
        total[p.queue] += p.length
    every = sum(total.values())
    found = distances(pieces, {k: n / every for k, n in total.items()}, packing.SEQUENCE)
    assert len(found) == every // packing.SEQUENCE and max(found.values()) < 0.01
    place = sorted((p.sequence_id * packing.SEQUENCE + p.offset, p.length) for p in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(place, place[1:], strict=False)) and place[0][0] == 0
    ends = defaultdict(list)
    for p in pieces:
        ends[p.doc_id].append((p.start, p.length, p.doc_tokens))
    for rows in ends.values():
        rows.sort()
        assert rows[0][0] == 0 and rows[-1][0] + rows[-1][1] == rows[-1][2] and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_given_weights_and_clashing_columns(spark):
    rows = [(i, "word " * 50, "en", "big" if i % 4 else "small", 250) for i in range(400)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None)], "part long, text string, run string, ids string, n long")
    pieces = packing.pack(docs, PATH, id_col="part", source_col="ids", sequence=512, weights={"small": 0.5, "big": 0.5}).collect()
    early = distances(pieces, {"small": 0.5, "big": 0.5}, 512)
    assert max(v for k, v in early.items() if k < 16) < 0.01
    assert sum(p.length for p in pieces) == 401 * 51 + 1 and pieces[0].asDict().keys() >= {"part", "start"}


def test_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    docs = spark.createDataFrame([(i, "word " * (5 + i), "en", f"s{i % 9}", 0) for i in range(60)], SCHEMA).repartition(4)
    pieces = packing.pack(docs, PATH, sequence=64).collect()
    assert {p.queue for p in pieces} >= {"other sources"} and len({p.queue for p in pieces}) == 4
    place = sorted((p.sequence_id * 64 + p.offset, p.length) for p in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(place, place[1:], strict=False))
    assert sum(p.length for p in pieces) == sum(6 + i for i in range(60))


def window_distances(totals, window=2048):
    """Total variation of each full window of the whole stream, by the plan alone."""
    plan = packing.Plan.of(totals, None, window)
    stream = np.full(plan.total, -1, np.int32)
    for q, k in enumerate(plan.names):
        _, _, length, at, _ = plan.pieces(np.array([q]), np.array([0]), np.array([totals[k]]))
        for a, n in zip(at.tolist(), length.tolist(), strict=True):
            stream[a : a + n] = q
    assert (stream >= 0).all()
    target = np.array([totals[k] for k in plan.names]) / plan.total
    return [abs(np.bincount(stream[w : w + window], minlength=len(target)) / window - target).sum() / 2 for w in range(0, plan.total - window + 1, window)]


@pytest.mark.parametrize("sizes", [[2000] * 65, [400] * 200, [40000 // (i + 1) for i in range(200)]])
def test_windows_of_many_sources_hold_the_mixture(sizes):
    """All full windows: to within 0.01 and a token a queue."""
    found = window_distances({f"s{i:03d}": n for i, n in enumerate(sizes)})
    assert len(found) > 30 and max(found) < 0.01 + len(sizes) / 2048 and np.mean(found) < 0.01 + len(sizes) / 4096


def test_weights_count_for_sources_beyond_the_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    docs = spark.createDataFrame([(i, "word " * (20 if i % 9 else 60), "en", f"s{i % 9}", 0) for i in range(300)], SCHEMA).repartition(4)
    pieces = packing.pack(docs, PATH, sequence=64, weights={"s5": 0.25}).collect()
    assert "s5" in {p.queue for p in pieces} and len({p.queue for p in pieces}) == 5
    early = [p for p in pieces if p.sequence_id < 20]
    assert abs(sum(p.length for p in early if p.queue == "s5") / sum(p.length for p in early) - 0.25) < 0.02
