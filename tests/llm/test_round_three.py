"""Decontamination, the filter audit and periodic runs against brute force, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import decontamination, filter_audit, periodic_runs

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words(text="Ab1 c-D é Σx\x7f_{z}"):
    assert [w.decode() for w in decontamination.words_of(text.encode())] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def brute_leaks(docs, items, window=10):
    pattern, wanted = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", []
    for item, text in items:
        w = re.findall(pattern, lower(text))
        n = min(window, len(w))
        wanted += [(str("" if item is None else item), tuple(w[j : j + n]), w, j) for j in range(len(w) - n + 1 if w else 0)]
    by = defaultdict(list)
    for x in wanted:
        by[x[1]].append(x)
    out = []
    for doc, text in docs:
        w, hit, held, far = re.findall(pattern, lower(text)), set(), set(), 0
        for i in range(len(w)):
            for n in {len(k) for k in by}:
                for item, _, iw, j in by.get(tuple(w[i : i + n]), ()):
                    hit |= set(range(i, i + n))
                    held.add(item)
                    t = 0
                    while i + t < len(w) and j + t < len(iw) and w[i + t] == iw[j + t]:
                        t += 1
                    far = max(far, t)
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit), far))
    return sorted(out, key=str)


def leaky(seed=0, n=120):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(12)] + ["É", "x1"]
    text = lambda a, b: " ".join(rng.choice(pool) for _ in range(rng.randint(a, b)))
    items = [(i, text(3, 40)) for i in range(14)] + [(None, "only These"), (7, ""), (8, None), (9, "alone"), (3, text(12, 12))]
    items += [items[0], (99, items[1][1])]
    docs = []
    for i in range(n):
        t = text(0, 60)
        if i % 3 == 0:
            cut = items[rng.randrange(14)][1].split()
            t += " unknown; " + ",".join(cut[rng.randrange(3) :]).upper() + " unknown " + text(0, 5)
        docs.append((i, t, "en"))
    return [*docs, docs[0], docs[3], (None, docs[3][1], None), (n, None, "en"), (n + 1, "", "en"), (n + 2, " ".join(["w1 w2"] * 4000) + " " + docs[0][1], "en")], items


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_leaks_against_brute_force(spark, monkeypatch, slice_bytes):
    rows, items = leaky()
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "SLICE_BYTES", slice_bytes)
    found = decontamination.scan(docs, bench, ["doc_id", "lang"], slice_bytes=slice_bytes).collect()
    got = sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans), r.longest.length if r.longest else 0) for r in found], key=str)
    expected = brute_leaks([(d, t) for d, t, _ in rows], items)
    assert got == expected
    if slice_bytes > 1000:
        assert sorted(map(tuple, decontamination.report(docs, bench).collect()), key=str) == expected
    texts, whole = {d: t for d, t, _ in rows}, defaultdict(list)
    for item, text in items:
        whole[str("" if item is None else item)].append([w.decode() for w in decontamination.words_of((text or "").encode())])
    for r in found:
        if r.longest:
            own = [w.decode() for w in decontamination.words_of(texts[r.doc_id].encode())]
            m = r.longest
            assert own[m.word : m.word + m.length] in [w[m.item_word : m.item_word + m.length] for w in whole[m.item]]


def test_a_shard_that_ends_with_its_first_suffix():
    """Suffixes that are no longer looked at are not read beyond the end of the shard."""
    items = decontamination.Items([("1", [b"a", b"b"] * 6), ("2", [b"c"] * 12)], 10)
    docs = [items.numbered(w) for w in ([b"c"] * 11, [b"b", b"a"] * 6, [b"a"])]
    assert [(s, i) for s, i, _ in items.search(docs)] == [([(0, 11)], {"2"}), ([(0, 12)], {"1"}), ([], set())]


def test_decontaminate_keeps_clean_rows_as_they_are(spark):
    rows, items = leaky(1)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n_words int, spans string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = Counter(str(d) for d, *_, hit, _ in brute_leaks([(d, t) for d, t, _ in rows], items) if not hit)
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and Counter(str(r.doc_id) for r in left.collect()) == clean
    with pytest.raises(ValueError):
        decontamination.scan(docs, bench, ["doc_id", "Spans"])
    empty, nothing = docs.where("false"), bench.where("false")
    assert decontamination.report(empty, bench).count() == 0 and decontamination.decontaminate(docs, nothing).count() == len(rows)
    assert {r.n_hit for r in decontamination.report(docs, nothing).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), min_size=1, max_size=6), st.integers(2, 21))
def test_suffixes_are_in_order(texts, bits):
    ids = np.array([x for t in texts for x in [*t, 0]], np.uint32)
    index = decontamination.Index(ids, max(3, bits))
    suffix = lambda p: ids[p : index.end[p]].tolist()
    order = [suffix(p) for p in index.sa]
    assert order == sorted(order) and sorted(index.sa) == np.flatnonzero(ids).tolist()


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        parts[lang or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part, own in parts.items():
        shapley = Counter()
        lines = []
        for o in map("".join, permutations("ABCDE")):
            for s, f in enumerate(o):
                gone = set(o[:s])
                here = [x for x in own if f in x[0] and not x[0] & gone]
                shapley[f] += len(here)
                lines.append((f, [part, o, s + 1, sum(not x[0] & {*gone, f} for x in own), len(here), sum(f in x[0] for x in own) - len(here), sum(x[0] == {f} for x in own), sum(x[1] for x in here), sum(x[2] for x in here)]))
        out += [(*line, shapley[f]) for f, line in lines]
    return sorted(out)


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    pieces = ["word " * 150, " ".join(f"w{i}" for i in range(220)), "ABC DEF " * 40, "a #1 $2\x0bb\tc", "", "plain text"]
    texts = ["".join(rng.sample(pieces, rng.randint(1, 3))) for _ in range(40)] + [None, "", " \t\x0c", "É" * 300, "x\x1cy z " * 30, "w " * 50000]
    rows = [(rng.randrange(150), rng.choice(texts), rng.choice(["en", "fr", "", None])) for _ in range(250)]
    rows += [(None, "plain text", "en"), (None, None, None), rows[0], rows[0], (-5, texts[0], "solo")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "E") for r in rows], SCHEMA + ", n int, E string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit_documents(docs, marks).collect()))
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit_documents(docs.where("false"), marks).count() == 0
    assert {r.good_lost for r in filter_audit.audit_documents(docs, marks.where("false")).collect()} == {0}


def test_audit_of_other_filters(spark):
    """Three filters; the CUBE stands over counted rows, not over the documents."""
    counts = spark.createDataFrame([("p", True, False, False, 3, 1), ("p", True, True, False, 2, 2), ("p", False, False, False, 5, 0)], "part string, x boolean, y boolean, z boolean, n long, w long")
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit(counts, ["x", "y", "z"], {"w": "w_lost"}).collect()}
    assert len(rows) == 18 and rows["xyz", 1].removed == 5 and rows["yxz", 1].removed == 2 and rows["yxz", 2].removed == 3 and rows["zyx", 3].w_lost == 1
    assert rows["xyz", 2].redundant == 2 and rows["xyz", 1].unique_fails == 3 and rows["xyz", 1].shapley == 3 * 5 + 3 * 3
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "abcdefgh", {})


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            seg = w[s : s + size]
            if size >= max(6, 4 * q) and not any(seg[d:] == seg[: size - d] for d in range(1, q)):
                out.append((s, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), min_size=1, max_size=4), st.integers(0, 40), st.integers(1, 9))
def test_runs_of_a_shard(texts, a, p):
    texts = [[str(w[a + (i - a) % p] if a + p <= len(w) and i >= a else x).encode() for i, x in enumerate(w)] for w in texts]
    assert periodic_runs._shard(texts) == [brute_runs(w) for w in texts]


def brute_report(doc, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    if doc is not None and w:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest(), len(w))


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d e f"]) for _ in range(rng.randint(0, 80))), "en") for i in range(200)]
    rows += [(i, " ".join(f"w{j}" for j in range(rng.randint(1, 90))), "en") for i in range(200, 400)]
    rows += [(None, "z " * 30, None), (500, None, "en"), (501, "", "en"), (502, " \t\x0b", "en"), rows[7], rows[7], (503, "x\x1cy   x\x1cy   " * 9, "en"), (504, "long line here " * 3000 + "end", "en")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = periodic_runs.report(periodic_runs.detect(periodic_runs.with_planted_periods(docs))).collect()
    small = [r for r in rows if r[0] != 504]
    assert sorted([tuple(r) for r in got if r.doc_id != 504], key=str) == sorted([brute_report(d, t) for d, t, _ in small], key=str)
    assert sum(r.n_runs for r in got) > 40
    plain = {r.doc_id: r for r in periodic_runs.detect(docs).collect()}
    assert [tuple(x) for x in plain[504].runs] == [(0, 9000, 3)] and plain[504].collapsed == "long line here end"
    assert periodic_runs.report(periodic_runs.detect(docs.where("false"))).count() == 0


def test_collapse_keeps_other_rows(spark):
    docs = spark.createDataFrame([(1, "a  b", 4, "r"), (2, "a b a b a b a b c", 17, None), (None, None, None, None)], "doc_id long, text string, n_chars int, runs string")
    got = {r.doc_id: tuple(r) for r in periodic_runs.collapse(docs, length_col="n_chars").collect()}
    assert got == {1: (1, "a  b", 4, "r"), 2: (2, "a b c", 5, None), None: (None, None, None, None)}
    with pytest.raises(ValueError):
        periodic_runs.detect(docs, ["runs"])
