"""Examples, sequences, fingerprints and redaction against brute force, also where columns have names that operators use themselves."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import chat, fingerprints, media, secret_scan, shared, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def test_examples_of_all_conversations(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = {(r.conv_id, r.example): (r.context, r.target) for r in chat.materialise(chat.expand(turns)).collect()}
    convs = defaultdict(list)
    for r in turns.collect():
        convs[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    expected = {}
    for c, rows in convs.items():
        before, example = "", 0
        for _, role, text in sorted(rows):
            escaped = [x.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;") for x in (role, text)]
            head = f"<|role|>{escaped[0]}<|text|>"
            if role == "assistant":
                expected[c, example] = (before + head, escaped[1])
                example += 1
            before += f"{head}{escaped[1]}<|end|>\n"
    assert got == expected and len(got) > 20


def test_a_long_conversation_and_clashing_columns(spark):
    long = "word [x] " * 30000
    rows = [(1, 0, "user", long, 1, "p"), (1, 1, "assistant", long, 2, "p"), (1, 1, "assistant", long, 2, "p")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at long, piece string")
    (got,) = chat.read_back(chat.expand(turns)).collect()
    assert (got.n_turns, got.n_examples, got.loss_chars) == (3, 2, 2 * len(long)) and got.loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()


def test_sequences_of_pages(spark):
    png = media.to_png(b"a" * 192)
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    facts = media.read_back(spark.createDataFrame([("00", png), ("00", png)], "digest string, media binary"))
    ours = '<p>one</p><img src="media:sha256:00" alt="x"><p>two</p><figure><img src="media:sha256:ff"><img src="media:sha256:00"><figcaption>both</figcaption></figure>'
    more = spark.createDataFrame([(-1, "u", ours), (-1, "u", ours), (-2, "u", None), (None, "u", "")], pages.schema)
    got = media.interleaved(pages.unionByName(more), facts, "page_id").collect()
    assert len(got) == pages.count() + 4
    texts = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        if r.page_id == -1:
            assert [(x.position, x.kind, x.text or x.digest, x.caption, x.media.media_bytes if x.media else None) for x in r["items"]] == [(0, "text", "one", None, None), (1, "media", "00", "x", len(png)), (2, "text", "two", None, None), (3, "media", "ff", "both", None), (4, "media", "00", "both", len(png))]
        elif r.page_id in texts:
            plain = media.parse(texts[r.page_id])
            assert [(x.position, x.kind, x.text, x.src, x.caption) for x in r["items"]] == [(x["position"], x["kind"], x["text"], x["src"], x["caption"]) for x in plain]
        else:
            assert r["items"] == []
    words = sum(len(x.text.split()) for r in got for x in r["items"] if x.text)
    assert words > 1000, "texts of real pages are read"


def _xxhash64(spark, terms):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", F.xxhash64("t").alias("a")).withColumn("b", F.xxhash64("a")).collect()
    return {r.t: (r.a & (2**64 - 1)) << 64 | (r.b & (2**64 - 1)) for r in rows}


def test_simhash_bits_and_likeness_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).unionByName(spark.createDataFrame([(1000, None, None, None, None), (1001, "...", None, None, None)], SCHEMA), allowMissingColumns=True)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    terms = {i: {t for t in ["", *re.split(r"[^\w]+|_+", x.lower())]} for i, x in texts.items()}
    hashes = _xxhash64(spark, {t for ts in terms.values() for t in ts})

    def brute(i):
        weights = {t: min(16, len(t)) for t in terms[i]}
        whole = sum(weights.values())
        return sum(1 << b for b in range(128) if 2 * sum(w for t, w in weights.items() if hashes[t] >> b & 1) > whole)

    got = {r.doc_id: r for r in fingerprints.with_edits(docs).collect()}
    same = sum(int(got[i].fingerprint, 16) == brute(i) for i in texts)
    assert same == len(texts)
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        apart = (int(got[i].fingerprint, 16) ^ int(got[j].fingerprint, 16)).bit_count()
        assert got[i].near_next == pytest.approx(max(0, math.cos(apart * math.pi / 128)) if apart else 1.0, abs=1e-12)
    for i in ids:
        if i % 20 == 0:
            assert got[i].n_within == sum((int(got[i].fingerprint, 16) ^ int(got[j].fingerprint, 16)).bit_count() <= 3 for j in ids)


@pytest.mark.parametrize(("radius", "crowded"), [(3, 4), (5, 2), (3, 64), (1, 1)])
def test_crowded_blocks_lose_nothing(spark, radius, crowded):
    rng = np.random.default_rng(radius)
    base = int(rng.integers(0, 2**62)) << 64 | int(rng.integers(0, 2**62))
    cloud = {base ^ sum(1 << int(b) for b in rng.choice(128, rng.integers(0, 5), replace=False)) for _ in range(150)}
    split = lambda x: tuple(y - (1 << 64) if y >> 63 else y for y in (x >> 64, x & (2**64 - 1)))
    rows = sorted(cloud)
    table = spark.createDataFrame([split(x) for x in rows], "hi long, lo long")
    asked = rows[::7]
    got = {(r.q_hi, r.q_lo): r.n_within for r in fingerprints.within_radius(table, spark.createDataFrame([split(x) for x in asked], "hi long, lo long"), radius, crowded).collect()}
    assert got == {split(q): sum((q ^ x).bit_count() <= radius for x in rows) for q in asked}


def test_next_documents_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_ROWS", 3)
    monkeypatch.setattr(fingerprints, "CELLS", 5)
    rng = np.random.default_rng(1)
    ids = [*range(30), 10**12, 10**12 + 7, -5, None, None]
    rows = [(i, "".join(rng.choice(list("ab c"), rng.integers(0, 20)))) for i in ids] + [(7, "zz"), (7, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = Counter()
    for (i, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        expected[i, hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprints.with_edits(docs).collect()) == expected


def brute_redaction(rows):
    """Texts with live values replaced, by plain loops over Python's own patterns."""
    kinds = [(k, re.compile(p.replace("\\x20", " ")), g, n) for k, p, g, n in secret_scan.PATTERNS]
    owners, sides, found = defaultdict(set), defaultdict(lambda: (set(), set())), []
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip(" ")
    for i, (_, text, _, source, _) in enumerate(rows):
        for k, p, g, n in kinds:
            for m in p.finditer(text or ""):
                v = m[g]
                if len(v) >= n:
                    a, b = m.end() - len(v), m.end()
                    found.append((i, k, v, a, b))
                    owners[v].add(source)
                    sides[v][0].add(norm(text[max(0, a - 32) : a]))
                    sides[v][1].add(norm(text[b : b + 32]))

    def entropy(v):
        return -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())

    cuts = defaultdict(list)
    for i, k, v, a, b in found:
        varied = len(set(v)) >= 8
        looks = (len(v) >= 16 and varied and re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or (k == "assign" and entropy(v) >= 3) or (k in ("access", "known") and varied)
        if looks and not re.search(secret_scan.PLACEHOLDERS, v) and min(len(owners[v]), *map(len, sides[v])) <= 2:
            cuts[i].append((a, b))
    out = []
    for i, (_, text, *_) in enumerate(rows):
        for a, b in sorted(cuts[i], reverse=True):
            text = text[:a] + "[SECRET]" + text[b:]
        out.append(text)
    return out


def test_redaction_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789"), n))
    common = draw(24)
    rows = [(i, t, "en", f"s{i % 6}", len(t)) for i, t in enumerate([*(f"{draw(40)} secret: {draw(20)} {draw(40)}" for _ in range(20)), *(f"{draw(40)} token={common} {draw(40)}" for _ in range(12)), *("same words before it and token=" + "Zq8Rt5" * 3 + "x1y2 the same after it" for _ in range(9)), "password = changeme12345678", "no secrets", ""])]
    rows.append((99, "one key " * 3000 + "".join(f"api_key={draw(20)} gap " for _ in range(600)), "en", "s1", 0))
    rows.append((100, None, None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    names = {"lang": "judged", "n_chars": "_cuts", "source": "row"}
    named = docs.withColumnsRenamed(names).selectExpr("*", "1 AS spans", "2 AS owner", "3 AS `kept`", "4 AS hash")
    got = {r.doc_id: r for r in secret_scan.redact(named, length_col="_cuts", owner=shared.column("row"), repo=shared.column("row")).collect()}
    assert len(got) == len(rows)
    for (i, old, *_), text in zip(rows, brute_redaction(rows), strict=True):
        assert got[i].text == text and (text is None or text == old or got[i]["_cuts"] == len(text))
    assert sum(got[i].text != t for i, t, *_ in rows) > 25
    report = secret_scan.report(named, owner=shared.column("row"), repo=shared.column("row")).collect()
    assert len(report) == len(rows)


def test_ownership_counts(spark):
    rows = [("h", o, r) for o, r in (("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"), (None, None), (None, None))]
    (got,) = secret_scan.ownership(spark.createDataFrame(rows, "hash string, owner string, repo string")).collect()
    assert (got.n_owners, got.n_repos, got.n_seen) == (3, 4, 6)


def test_accepted_rows_with_any_columns(spark):
    rows = [(i, "vile awful" if i % 5 == 0 else f"fine w{'abcdefgh'[i % 8]}", "x", 0.5, True) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, scored string, p_toxic double, toxic boolean")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    chain = toxicity.train_on(docs, labels, {"toxic": "toxic = 1"})
    kept = toxicity.accepted(docs, chain)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 5] and kept.columns == docs.columns
    with pytest.raises(ValueError, match="names of scores"):
        toxicity.score(docs, chain)
    twice = toxicity.train_on(docs.union(docs).repartition(7), labels, {"toxic": "toxic = 1"})
    assert len(twice.out_of_fold) == 600


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared._workspace(Session())
