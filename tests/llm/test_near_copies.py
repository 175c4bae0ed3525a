"""Near copies in the pipeline: what similarity 0.8 over five words reaches, against brute force."""

import itertools

import numpy as np

from gridloom.llm import jaccard_dedup, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(texts):
    """Smallest place of each component of texts whose sets are as similar as 0.8; empty ones are alike."""
    sets, group = [_set(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return sorted(set(group))


def _edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(10**9)}"
    return " ".join(out)


def test_the_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(12)]
    texts = [None, "", "one two", "One  two", *[" ".join(b) for b in base], *[_edited(rng, b, n) for b in base for n in (1, 3, 20)]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    stage = corpus_pipeline.STAGES[1][1]
    kept = stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == _kept(texts) and kept.columns == docs.columns
    apart = [bin((simhash_dedup.fingerprint(" ".join(b)) ^ simhash_dedup.fingerprint(texts[16 + 3 * i + 1])) & (2**64 - 1)).count("1") for i, b in enumerate(base)]
    assert max(apart) > simhash_dedup.RADIUS, "some of these are out of the reach of op10's radius"
    assert stage(spark, docs.limit(0), "").count() == 0


def test_crowded_buckets_lose_no_component(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in range(150)]
    texts = [_edited(rng, base, n) for n in rng.integers(1, 9, 150)]
    rows = [(jaccard_dedup.node_of(w), t, bytes(jaccard_dedup.minima(jaccard_dedup.shingles(w)).tobytes())) for t in texts if (w := jaccard_dedup.words_of(t))]
    nodes = jaccard_dedup.save(spark.createDataFrame(rows, "node long, text string, minima binary"), "nodes")
    found = {(r.a, r.b) for r in jaccard_dedup.links(nodes.drop("text"), nodes.drop("minima"), crowded=8, neighbours=1).collect()}
    group = {x: x for x, _, _ in rows}
    for a, b in found:
        group = {k: group[a] if v == group[b] else v for k, v in group.items()}
    assert len(set(group.values())) == len(_kept(texts)) and len(found) < 150 * 149 / 4


def test_the_pipeline_takes_the_links_of_simhash_fingerprints(spark):
    """A text that is one line many times over, with other words at the end: fingerprints within op10's radius, few shingles in common."""
    import corpus_pipeline

    line = "alpha beta gamma delta epsilon zeta eta "
    ends = [" ".join(f"{x}{i}" for i in range(5)) for x in "uvw"]
    texts = [line * 400 + e for e in ends] + [" ".join(f"other{i}" for i in range(30)), ends[0]]
    fps = [simhash_dedup.majority(jaccard_dedup.shingles(jaccard_dedup.words_of(t))) for t in texts]
    near = [[bin((a ^ b) & (2**64 - 1)).count("1") <= simhash_dedup.RADIUS for b in fps] for a in fps]
    assert all(all(row[:3]) for row in near[:3]) and not any(any(row[3:]) for row in near[:3]) and len(_kept(texts)) == 5
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()) == [0, 3, 4]
