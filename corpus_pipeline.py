"""A corpus pipeline of four operators of gridloom.llm: what a stage keeps is written as Parquet and is the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import jaccard_dedup, packing, secret_scan, toxicity
from gridloom.llm.queries import CATEGORIES, VOCABULARY
from gridloom.llm.shared import discard, save, scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones among them, doesn't reject."""
    chain = toxicity.train_on(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.accepted(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints within op10's radius or pairs of similarity 0.8, both over five words, connect, that with the smallest id."""
    return jaccard_dedup.drop_similar(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials of few owners replaced and n_chars set anew where they were."""
    return secret_scan.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, each source in proportion."""
    return packing.with_digests(packing.pack(docs, public_tokenizers.path(VOCABULARY)))


#: Folders that the latest stage over a sf_dir has made for itself.
_scratch: dict[str, list[str]] = {}


def _after(stage: Callable, first: bool = False) -> Callable:
    """The stage; what the stage before it saved for itself goes first, unless docs still reads it: then that stage's result wasn't written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = [] if first else _scratch.pop(sf_dir, [])
        names = [folder.rpartition("/")[2] for folder in left]
        if left and not any(f"/{n}/" in file for file in docs.inputFiles() for n in names):
            discard(spark, left)
            left = []
        with scratch() as made:
            out = stage(spark, docs, sf_dir)
        _scratch[sf_dir] = left + made
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


STAGES = [("toxicity", _after(reject_toxic, first=True)), ("near_dedup", _after(drop_near_duplicates)), ("secret_scan", _after(redact_secrets)), ("packing", _after(pack))]

#: Trained models, fingerprints and tokens can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    discard(spark, _scratch.pop(sf_dir, []))
    return docs
