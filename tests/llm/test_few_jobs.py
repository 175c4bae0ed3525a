"""What stages of the pipeline take of the driver: a few jobs for what is gathered there, and no automaton."""

import numpy as np
import public_tokenizers

from gridloom.llm import bpe, jaccard_dedup


def test_the_filter_of_hashes_is_gathered_by_a_few_jobs(spark):
    hashes = [0, 0, 1, -1, 2**63 - 1, -(2**63), *np.random.default_rng(4).integers(-(2**63), 2**63, 500).tolist()]
    nodes = spark.createDataFrame([(h,) for h in hashes], "node long").distinct()
    texts = spark.createDataFrame([("one two",), ("three",), (None,)], "text string")
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("61", "false"), strict=True):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few jobs", "few jobs")
        found = jaccard_dedup._sets(nodes, texts, 5).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.node for r in found] == [0]  # the empty text's
    assert len(jobs) < 20  # 61 and more when partitions were fetched one by one


def test_the_filter_holds_the_leading_bits_of_every_hash(spark):
    hashes = [0, 1, -1, 2**63 - 1, -(2**63), *np.random.default_rng(5).integers(-(2**63), 2**63, 300).tolist()]
    filled = jaccard_dedup._filled(spark.createDataFrame([(h,) for h in hashes], "h long")).view(np.uint64)
    high = {(h % 2**64) >> (64 - jaccard_dedup.FILTER_BITS) for h in hashes}
    assert {int(at) * 64 + b for at in np.flatnonzero(filled) for b in range(64) if int(filled[at]) >> b & 1} == high
    assert not jaccard_dedup._filled(spark.createDataFrame([], "h long")).any()


def test_packing_makes_no_automaton_on_the_driver(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    expected = vars(bpe.light(bpe.vocabulary(path)))
    bpe.vocabulary.cache_clear()

    def never(*_):
        raise AssertionError("the automaton isn't needed")

    monkeypatch.setattr(bpe, "SuffixAutomaton", never)
    try:
        assert vars(bpe.share(spark, path, whole=False).value[1]) == expected
    finally:
        bpe.vocabulary.cache_clear()
