"""Near-duplicates by SimHash fingerprints and by the Jaccard similarity of word shingles.

Fingerprints over the same shingles go through op10's index of byte positions with its tally and its verification bit by bit,
whose links hold as they are. They reach few texts of similarity 0.8, so a positional index of minima picks more candidates,
which whole shingle sets confirm. All links make the components.

For the second index a text's fingerprint is 64 minima of its shingles, one for each position. As with the SimHash index, composite positions are
keys (16 bands of four), the positions that a pair shares are tallied, pairs under a minimum are dropped, and the rest are
verified. Minima of a text of similarity 0.8 meet in some band with a chance of 0.9998, while its SimHash bits differ in
ten of 64 on average, more than eight bytes can guarantee a match for. Texts of the same words are one node, so exact copies
never make pairs.

Buckets of over CROWDED nodes take two passes, and none is ever gathered into one task. In the first, nodes are sorted by
ranges and each is paired with the NEIGHBOURS after it in an order that differs by band, which joins a group of near copies
to a few components. In the second, nodes outside a bucket's largest component are compared with all its nodes of other
components, BLOCK against BLOCK in a task; only the links leave it. So no pair that could change the components is left out.

Null texts count as empty; empty texts are one node without shingles, and shorter texts than a shingle are one shingle. Other
columns of the documents, whatever their names, are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import simhash_dedup
from gridloom.llm.components import connected_components
from gridloom.llm.shared import column, map_batches, save, slices, unused

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 16, 4
#: Pairs whose share of agreeing minima is less than the similarity by more than this, four deviations, are dropped.
SLACK = 0.2
#: The longest bucket whose nodes are paired with each other at once.
CROWDED, NEIGHBOURS = 64, 4
#: Nodes of a crowded bucket on either side of a comparison in one task.
BLOCK = 256
#: Bits of a hash of the nodes that a filter tells apart; a fixed 2 MB.
FILTER_BITS = 24
_DRAWN = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), np.uint64)
_FACTORS, _SHIFTS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def node_of(words: list[bytes]) -> int:
    """Signed 64-bit hash of all words; 0 if there are none."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words), SEED)).view(np.int64)) if words else 0


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """A hash of each k words, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    line, k = b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of the functions, 32 bits."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), 1024):
        mixed = hashes[at : at + 1024, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, (mixed >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return least


def similarity(a: bytes, b: bytes) -> float:
    """Of two sorted sets of shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, raw (a hash of the text as it is), node, its SimHash fp and its minima (null if the text has no words), for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = column(text_col).cast("string")

    def make():
        def one(batch):
            read = [words_of(t) for t in batch.column(2).to_pylist()]
            hashes = [shingles(w, shingle) for w in read]
            return {"id": batch.column(0), "raw": batch.column(1), "node": [node_of(w) for w in read], "fp": [simhash_dedup.majority(h) for h in hashes], "minima": [minima(h).tobytes() if len(h) else None for h in hashes]}

        return one

    return map_batches(docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("raw"), text.alias("text")), make, f"id {kind}, raw bigint, node bigint, fp bigint, minima binary")


def _keys(nodes: DataFrame) -> DataFrame:
    """node, t (the band) and key, for each node that has minima."""

    def make():
        def one(batch):
            rows = [(x, m) for x, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if m is not None]
            width = 4 * ROWS
            keys = [int(np.uint64(xxhash.xxh3_64_intdigest(m[width * t : width * (t + 1)])).view(np.int64)) for _, m in rows for t in range(BANDS)]
            return {"node": [x for x, _ in rows for _ in range(BANDS)], "t": [*range(BANDS)] * len(rows), "key": keys}

        return one

    return map_batches(nodes.select("node", "minima"), make, "node bigint, t int, key bigint")


def _met(nodes: np.ndarray, least: np.ndarray, i: int, to: slice, least_agree: int) -> np.ndarray:
    """The nodes of a slice that agree with node i in as many positions."""
    return nodes[to][(least[to] == least[i]).sum(axis=1) >= least_agree]


def _paired(lists: DataFrame, least_agree: int) -> DataFrame:
    """lists: members of a bucket, CROWDED at most. Pairs (a, b) whose minima agree often enough."""

    def make():
        def one(batch):
            out: dict[str, list] = {"a": [], "b": []}
            for members in batch.column(0).to_pylist():
                nodes = np.array([m["node"] for m in members], np.int64)
                least = np.frombuffer(b"".join(m["minima"] for m in members), np.uint32).reshape(len(members), -1)
                for i in range(len(nodes) - 1):
                    found = _met(nodes, least, i, slice(i + 1, None), least_agree)
                    out["a"] += np.minimum(found, nodes[i]).tolist()
                    out["b"] += np.maximum(found, nodes[i]).tolist()
            return out

        return one

    return map_batches(lists, make, "a bigint, b bigint")


def _neighbours(rows: DataFrame, least_agree: int, neighbours: int) -> DataFrame:
    """rows: t, key, node, minima. Pairs of a node and one of the next few of its bucket in a mixed order; ranges of the order are tasks of their own."""
    mixed = F.xxhash64("node", "t")
    ordered = rows.withColumn("mixed", mixed).repartitionByRange("t", "key", "mixed").sortWithinPartitions("t", "key", "mixed").select("t", "key", "node", "minima")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple] = []
        for batch in slices(batches):
            whole = tail + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            nodes = np.array([r[2] for r in whole], np.int64)
            least = np.frombuffer(b"".join(r[3] for r in whole), np.uint32).reshape(len(whole), -1)
            buckets = np.array([[r[0], r[1]] for r in whole], np.int64)
            a, b = [], []
            for d in range(1, neighbours + 1):
                i = np.arange(max(0, len(tail) - d), len(whole) - d)
                i = i[(buckets[i] == buckets[i + d]).all(axis=1) & ((least[i] == least[i + d]).sum(axis=1) >= least_agree)] if len(i) else i
                a += np.minimum(nodes[i], nodes[i + d]).tolist()
                b += np.maximum(nodes[i], nodes[i + d]).tolist()
            tail = whole[-neighbours:]
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    return ordered.mapInArrow(run, "a bigint, b bigint")


def _rest(rows: DataFrame, texts: DataFrame, least: float, shingle: int, least_agree: int, block: int) -> DataFrame:
    """rows: saved t, key, node, minima, root of crowded buckets. Links (a, b) between nodes of different roots, one of them outside its bucket's largest root."""
    sizes = rows.groupBy("t", "key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("t", "key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n")
    rows = save(rows.join(largest, ["t", "key"]), "rest")
    sets = _sets(rows.select("node").distinct(), texts, shingle)
    parts = lambda n: F.ceil(n / block).cast("int")
    side = lambda n, name: F.pmod(F.xxhash64(F.lit(name), "node"), parts(n)).cast("int")
    whole, few = F.col("n"), F.col("n") - F.col("most")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    kept = ["t", "key", "node", "root", "minima"]
    asked = rows.where("root <> largest").select(*kept, F.lit(0).alias("role"), side(few, "asked").alias("x"), every(whole).alias("y"))
    told = rows.select(*kept, F.lit(1).alias("role"), every(few).alias("x"), side(whole, "told").alias("y"))
    task = ["t", "key", "x", "y"]
    met = asked.unionByName(told).join(sets, "node").repartition(*task).sortWithinPartitions(*task, "role").select(*task, "role", "node", "root", "minima", "set")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, roots, sets, sketches, stack = None, [], [], [], [], None
        for batch in slices(batches):
            found: list[tuple[int, int]] = []
            for *place, role, node, root, sketch, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    at, nodes, roots, sets, sketches, stack = place, [], [], [], [], None
                if role == 0:
                    nodes.append(node)
                    roots.append(root)
                    sets.append(own)
                    sketches.append(np.frombuffer(sketch, np.uint32))
                elif nodes:
                    stack = (np.array(sketches), np.array(roots)) if stack is None else stack
                    near = ((stack[0] == np.frombuffer(sketch, np.uint32)).sum(axis=1) >= least_agree) & (stack[1] != root)
                    found += [(min(node, nodes[i]), max(node, nodes[i])) for i in np.flatnonzero(near).tolist() if similarity(sets[i], own) >= least]
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [x for _, x in found]}, schema=schema)

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _bits(hashes: DataFrame) -> DataFrame:
    """hashes: h (long). at and bits: a bit for the first FILTER_BITS of each; 2**(FILTER_BITS - 6) rows at most."""
    high = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    return hashes.select(F.shiftright(high, 6).cast("int").alias("at"), _bit(high).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))


def _filled(hashes: DataFrame) -> np.ndarray:
    """_bits of hashes as an array of 2 MB, the same for any input. Gathered as Arrow in one go: an iterator over partitions is a job for each of them."""
    got = _bits(hashes).toArrow()  # 2**(FILTER_BITS - 6) rows of 12 bytes at most
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    filled[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return filled


def _bit(high: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), high.bitwiseAND(F.lit(63)).cast("int"))


def _sets(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """nodes: distinct node; texts: text. Saved node and set (sorted distinct shingles) of those nodes. Of other texts, only a few of the same leading bits leave their task."""
    shared = nodes.sparkSession.sparkContext.broadcast(_filled(nodes.select(F.col("node").alias("h"))))

    def make():
        bits = shared.value

        def one(batch):
            read = [words_of(t) for t in batch.column(0).to_pylist()]
            found = np.array([node_of(w) for w in read], np.int64)
            high = found.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            some = np.flatnonzero(bits[(high >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (high & np.uint64(63)) & np.uint64(1)).tolist()
            return {"node": found[some].tolist(), "set": [np.unique(shingles(read[i], shingle)).tobytes() for i in some]}

        return one

    sets = map_batches(texts.select("text"), make, "node bigint, set binary")
    return save(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")), "sets")


def _confirmed(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """pairs: saved (a, b). Those whose shingle sets are as similar as least."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, shingle)
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def make():
        def one(batch):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            kept = [i for i in range(len(a)) if similarity(x[i], y[i]) >= least]
            return {"a": [a[i] for i in kept], "b": [b[i] for i in kept]}

        return one

    return map_batches(met.select("a", "b", "x", "y"), make, "a bigint, b bigint")


def links(nodes: DataFrame, texts: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, crowded: int = CROWDED, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """nodes: saved distinct node and minima; texts: text. Confirmed pairs (a, b) that connect what all similar pairs of the buckets connect."""
    posted = save(_keys(nodes), "postings")
    lengths = posted.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = save(posted.join(lengths, ["t", "key"]).join(nodes, "node"), "buckets")
    agree = int(np.ceil(BANDS * ROWS * (least - SLACK)))
    few, many = buckets.where(F.col("n") <= crowded), buckets.where(F.col("n") > crowded).drop("n")
    lists = few.groupBy("t", "key").agg(F.collect_list(F.struct("node", "minima")).alias("members")).select("members")
    pairs = save(_paired(lists, agree).unionByName(_neighbours(many, agree, neighbours)).distinct(), "pairs")
    found = save(_confirmed(pairs, texts, least, shingle), "links")
    if many.isEmpty():
        return found
    roots = connected_components(found).withColumnRenamed("id", "node")
    rest = save(many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "crowded")
    return found.unionByName(save(_rest(rest, texts, least, shingle, agree, block), "links"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """nodes: saved node and fp. Links (a, b) of nodes whose fingerprints op10's operator links, one node standing for each fingerprint."""
    leads = save(nodes.groupBy("fp").agg(F.min("node").alias("a")), "leads")
    same = nodes.join(leads, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    near = simhash_dedup.links(leads.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    ends = near.join(leads.withColumnRenamed("fp", "x"), "x").join(leads.select(F.col("fp").alias("y"), F.col("a").alias("b")), "y")
    return same.unionByName(ends.select("a", "b"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component of texts within op10's radius or as similar as least: that with the smallest id (nulls last), of repeated rows one.

    docs is read again for the sets of candidates and for the result, so it must be the same each time, as a saved table is.
    Rows without a copy pass as they are read; only those that a fixed filter of the copies' hashes lets through are shuffled.
    """
    marked = save(_marked(docs, id_col, text_col, shingle), "marked")
    nodes = save(marked.groupBy("node").agg(F.first("minima").alias("minima"), F.first("fp").alias("fp")), "nodes")
    text = column(text_col).cast("string")
    found = links(nodes.drop("fp"), docs.select(text.alias("text")), least, shingle).unionByName(_by_fingerprint(nodes.drop("minima")))
    roots = connected_components(found).select(F.col("id").alias("node"), "root")
    placed = marked.select("id", "raw", "node").join(roots, "node", "left").select("id", "raw", F.coalesce("root", "node").alias("c"))
    leads = placed.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "raw")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    copies = placed.join(leads, "c").groupBy("id", "raw").agg(F.bool_or((F.col("id").eqNullSafe(F.col("lead.id"))) & (F.col("raw") == F.col("lead.raw"))).alias("leads"))
    copies = save(copies, "copies")

    raw, at, high, bits, own, leading, place = [unused(docs, n) for n in ("raw", "at", "high", "bits", "id", "leads", "place")]
    hashed = docs.withColumns({raw: F.xxhash64(text)}).withColumn(high, F.shiftrightunsigned(raw, 64 - FILTER_BITS)).withColumn(at, F.shiftright(high, 6).cast("int"))
    fixed = F.broadcast(_bits(copies.select(F.col("raw").alias("h"))).withColumnsRenamed({"at": at, "bits": bits}))  # 2**18 rows at most
    tested = hashed.join(fixed, at, "left")
    copied = F.coalesce(F.col(bits).bitwiseAND(_bit(F.col(high))), F.lit(0)) != 0
    known = copies.withColumnsRenamed({"id": own, "raw": f"{raw}_", "leads": leading})
    some = tested.where(copied).join(known, (F.col(raw) == F.col(f"{raw}_")) & column(id_col).eqNullSafe(F.col(own)), "left").where(F.coalesce(F.col(leading), F.lit(True)))
    first = F.row_number().over(Window.partitionBy(raw, column(id_col)).orderBy(raw))
    some = some.withColumn(place, first).where((F.col(place) == 1) | F.col(leading).isNull())
    keep = [column(c) for c in docs.columns]
    return tested.where(~copied).select(*keep).unionByName(some.select(*keep))
