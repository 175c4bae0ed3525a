"""SimHash near-duplicates: a byte-position inverted index with count filtering, exact at Hamming radius 2.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits share at least six of them,
so they share all four bytes of at least one of the six pairs of double bytes. The index posts each distinct fingerprint
under those six composite positional keys; in each posting list the shared bytes of a pair are tallied, pairs under six are
dropped, and the rest are verified bit by bit.

Posting lists of over POSTING_PAIRS fingerprints (clouds of near copies) are not paired. There each fingerprint is posted
again under itself and under each flip of one of the 32 bits outside the list's key: two of them differ in at most two bits
if and only if they meet under such a key, and at most 33 meet under one. So nothing is capped, and no step is quadratic.

Exact copies share a fingerprint and are one node. Null texts count as empty; empty texts have fingerprint zero and link like
any other. A null id takes part, and its group's id is the smallest id that isn't null.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import connected_components
from gridloom.llm.shared import map_batches, save, unused

RADIUS, SHARED_BYTES, SHINGLE, SEED = 2, 6, 3, 42
#: The longest posting list that is paired directly.
POSTING_PAIRS = 64
#: The four double bytes of a fingerprint, two at a time.
PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes: the bits that over half of them have; 0 of none."""
    votes, hashes = np.zeros(64, np.int64), hashes.astype("<u8", copy=False)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.dtype("<i8"))[0])


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the whole text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, k = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.dtype("<u8"), n)
    return majority(hashes)


def with_fingerprints(docs: DataFrame, text_col: str, into: str, keep: list[str]) -> DataFrame:
    """The columns keep of docs and into, the fingerprint (long)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_fingerprinted"))

    def make():
        def one(batch):
            texts = batch.column(len(keep)).to_pylist()
            return {c: batch.column(i) for i, c in enumerate(keep)} | {into: [fingerprint(t) for t in texts]}

        return one

    return map_batches(source, make, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{into}` bigint"]))


def _double_byte(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(65535))


def shared_bytes(x: Column, y: Column) -> Column:
    """The tally: positional bytes that two fingerprints share."""
    apart = x.bitwiseXOR(y)
    return sum((F.when(F.shiftrightunsigned(apart, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp (long). Returns (a, b): edges that connect exactly what pairs within the radius connect."""
    posted = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.shiftleft(_double_byte("fp", i), 16).bitwiseOR(_double_byte("fp", j)).alias("key")) for t, (i, j) in enumerate(PAIRS)])).alias("k")).select("fp", "k.t", "k.key")
    posted = save(posted, "postings")
    lengths = posted.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = posted.join(lengths, ["t", "key"])
    lists = met.where(F.col("n") <= POSTING_PAIRS).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    heads = lists.select("fps", F.posexplode("fps").alias("i", "a"))
    pairs = heads.select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
    near = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= SHARED_BYTES).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    free = F.create_map(*[x for t, p in enumerate(PAIRS) for x in (F.lit(t), F.array(*[F.lit(16 * g + b) for g in range(4) if g not in p for b in range(16)]))])
    crowded = met.where(F.col("n") > POSTING_PAIRS).select("fp", "t").repartition(F.col("fp"))
    flips = F.concat(F.array("fp"), F.transform(free[F.col("t")], lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    middles = crowded.select("fp", "t", F.explode(flips).alias("middle"))
    stars = middles.groupBy("t", "middle").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).where("a <> b")
    return near.select("a", "b").unionByName(stars).distinct()


def _classes(marked: DataFrame, fp: str, doc_id: Column) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of a saved table."""
    nodes = save(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("smallest")), "nodes")
    roots = connected_components(links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return save(placed.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, fingerprint (long) and component_id, the smallest id reachable over links."""
    marked = save(with_fingerprints(docs, text_col, "fp", [id_col]), "fingerprints")
    classes = _classes(marked, "fp", F.col(f"`{id_col}`"))
    return marked.join(classes, "fp").select(F.col(f"`{id_col}`"), F.col("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (nulls last), of repeated rows one."""
    fp, row = unused(docs, "fp"), unused(docs, "row")
    marked = save(with_fingerprints(docs.withColumn(row, F.monotonically_increasing_id()), text_col, fp, [*docs.columns, row]), "marked")
    slim = marked.select(F.col(fp).alias("_f"), F.col(f"`{id_col}`").alias("_id"), F.col(row).alias("_row"))
    classes = _classes(marked, fp, F.col(f"`{id_col}`")).select(F.col("fp").alias("_f"), F.col("root").alias("_c"))
    kept = slim.join(classes, "_f").groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("least")).select(F.col("least._row").alias("__kept"))
    return marked.join(kept, F.col(row) == F.col("__kept"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
