"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens: its documents one after another. A round is a window's worth of tokens. In each round a
queue's credit grows by its target share of the window; it serves the whole tokens that the credit covers, cutting documents
where needed, and keeps the rest, its deficit, for the next round, across windows and partitions. A queue whose share is
under a token saves its credit for several rounds; such queues' turns are spread over the rounds. (Whoever doesn't want pieces of a
few tokens has every queue save up `least`; windows then hold the mixture only on average.) A queue that runs dry leaves its share
to the others in proportion. Rounds follow one another, the queues of a round in turn, as one stream that is cut every 2048
tokens: all sequences are full but the last, and each holds every source in proportion up to a token or two.

Sources beyond the MAX_QUEUES with most tokens, unless they have a weight of their own, share one queue, in the order of the
tasks that read them: each of those has less than half a token of a window.

No pass over the windows is needed: with P(v) the tokens that all queues have served when each has had credit for v tokens
of weight one, P is a line between the points where a queue runs dry, and round r ends where P is 2048 * r. So what a queue
has served by then follows from its weight and total, and so does the place of any token in the stream. A document
needs only the tokens before it in its queue: those of earlier partitions, a sum for each partition and queue, and those of
its own partition, which the task that encodes it counts. The ids are written once and never shuffled.

Weights: sources with a given weight have that share. If the weights of the sources there are add up to less than 1, the
others share what is left in proportion to their tokens; else the weights are scaled to 1 and the others have weight 0.
A source of weight 0 is served when those with a weight have run dry. Weights of sources that aren't there mean nothing; a
negative or infinite one is an error. Without weights every source has its part of all tokens.

Null sources count as the empty source, null texts as empty. Every document has at least the end token, so repeated and empty
rows are packed like any other. Other columns of the documents are not read, whatever their names. Empty tables give no pieces.
The ids are the tokenizers library's: each distinct word that a batch adds goes through it once, and a worker remembers it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.bpe import encoder, forget_encoders, library_packed, share
from gridloom.llm.shared import column, map_batches, save

SEQUENCE, END_ID = 2048, 1
#: A queue's credit grows until it covers so many tokens before it serves.
LEAST = 1
#: Sources with a queue of their own, those with the most tokens, beside those with a given weight; the others share one. Figures of so many reach the driver.
MAX_QUEUES = 4096
#: Sums of partitions and queues that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_SUMS = 1_000_000
#: Cells of a table of rounds and queues that a task holds at a time, and bytes of ids in one batch that it returns.
CELLS, OUT_BYTES = 1 << 18, 4 << 20


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int = END_ID) -> DataFrame:
    """Saved: doc, source, part (the task), run (tokens before it of its source in its part), n (tokens with the end token), ids (16-bit where all ids of the vocabulary fit, else 32-bit)."""
    shared, kind = share(docs.sparkSession, path, whole=False), docs.schema[id_col].dataType.simpleString()
    narrow = max(end_id, *shared.value[1].names) < 65536
    kind_of_id = "<u2" if narrow else "<u4"
    end = np.array([end_id], kind_of_id).tobytes()
    rows = docs.select(column(id_col).alias("doc"), F.coalesce(column(source_col).cast("string"), F.lit("")).alias("source"), column(text_col).cast("string").alias("text"))

    def make():
        e, part, served = encoder(shared, library_packed, kind_of_id), TaskContext.get().partitionId(), Counter()

        def one(batch):
            ids = [x + end for x in e.encode_batch(batch.column(2).to_pylist())]
            sizes, runs = [len(x) // len(end) for x in ids], []
            for source, n in zip(batch.column(1).to_pylist(), sizes, strict=True):
                runs.append(served[source])
                served[source] += n
            return {"doc": batch.column(0), "source": batch.column(1), "part": [part] * len(ids), "run": runs, "n": sizes, "ids": ids}

        return one

    return save(map_batches(rows, make, f"doc {kind}, source string, part bigint, run bigint, n bigint, ids binary"), "tokens")


@dataclass
class Plan:
    """The queues, and what each has served at the end of any round."""

    names: list[str]
    totals: np.ndarray
    weights: np.ndarray  # of those with a weight; they come first
    every: np.ndarray  # rounds between a queue's turns
    window: int

    @classmethod
    def of(cls, totals: dict[str, int], weights: dict[str, float] | None, window: int, least: int = LEAST) -> Plan:
        given = {k: float(v) for k, v in (weights or {}).items()}
        if any(not 0 <= v < math.inf for v in given.values()):
            raise ValueError("a weight is a number from 0 on")
        given = {k: v for k, v in given.items() if k in totals}
        named, rest = sum(given.values()), sum(n for k, n in totals.items() if k not in given)
        if named < 1 and rest:
            share = given | {k: (1 - named) * n / rest for k, n in totals.items() if k not in given}
        else:
            share = {k: given.get(k, 0.0) / named if named else 0.0 for k in totals}
        first = sorted(k for k in totals if share[k] > 0)
        last = sorted(k for k in totals if share[k] <= 0)
        # Those without a weight are served after the rest, each in proportion to its tokens.
        names = first + last
        sizes = np.array([totals[k] for k in names], np.int64)
        speed = np.array([share[k] for k in first] + [totals[k] / max(1, sum(totals[x] for x in last)) for k in last])
        turns = np.maximum(1, np.ceil(least / np.maximum(speed * window, 1e-9))).astype(np.int64)
        return cls(names, sizes, speed, turns, window)._knots(len(first))

    def _knots(self, first: int) -> Plan:
        """dry: the credit at which each queue is empty; credit and served: P's corners."""
        self.start = np.zeros(len(self.names))
        dry = self.totals[:first] / self.weights[:first]
        after = float(dry.max()) if first else 0.0
        self.start[first:] = after
        self.dry = np.concatenate((dry, after + self.totals[first:] / self.weights[first:]))
        self.credit = np.unique(np.concatenate(([0.0], self.start, self.dry)))
        speed = np.array([self.weights[(self.start <= a) & (self.dry > a)].sum() for a in self.credit[:-1]])
        self.served = np.concatenate(([0.0], np.cumsum(speed * np.diff(self.credit))))
        self.slope = 1 / speed
        self.total = int(self.totals.sum())
        self.rounds = -(-self.total // self.window)
        return self

    def credit_at(self, rounds: np.ndarray) -> np.ndarray:
        x = np.minimum(rounds * float(self.window), self.served[-1])
        j = np.clip(np.searchsorted(self.served, x, "right") - 1, 0, len(self.slope) - 1)
        return np.clip(self.credit[j] + (x - self.served[j]) * self.slope[j], self.credit[j], self.credit[j + 1])

    def served_by(self, rounds: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """Tokens that the queues have served before the rounds begin; the arrays are broadcast against each other."""
        every = self.every[queues]
        turn = np.maximum(0, (rounds + queues % every) // every * every - queues % every)
        v = self.credit_at(turn) - self.start[queues]
        some = np.floor(np.maximum(v, 0) * self.weights[queues]).astype(np.int64)
        whole = (v >= self.dry[queues] - self.start[queues]) | (rounds >= self.rounds)
        return np.where(whole, self.totals[queues], np.minimum(some, self.totals[queues]))

    def round_near(self, queues: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """About the round in which a queue serves a token."""
        return (np.interp(self.start[queues] + tokens / self.weights[queues], self.credit, self.served) // self.window).astype(np.int64)

    def pieces(self, queues: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents of n tokens, before of their queue ahead of them: the document, start, length, place in the stream and round of each slice, in order."""
        slack = self.every[queues] + 2
        lo = np.maximum(0, self.round_near(queues, before) - slack)
        hi = np.minimum(self.rounds, self.round_near(queues, before + sizes) + slack) + 1
        doc = np.repeat(np.arange(len(sizes)), hi - lo)
        rounds = np.arange(len(doc)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[doc]
        q, b, e = queues[doc], before[doc], before[doc] + sizes[doc]
        here, then = self.served_by(rounds, q), self.served_by(rounds + 1, q)
        start, end = np.maximum(b, here), np.minimum(e, then)
        kept = np.flatnonzero(end > start)
        doc, rounds, q, start, end, here = (x[kept] for x in (doc, rounds, q, start, end, here))
        at = self.ahead(rounds, q) + start - here
        return doc, start - before[doc], end - start, at, rounds

    def ahead(self, rounds: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """Where in the stream a queue's slice of a round begins."""
        every, out = np.arange(len(self.names)), np.empty(len(rounds), np.int64)
        distinct, inverse = np.unique(rounds, return_inverse=True)
        order, step = np.argsort(inverse, kind="stable"), max(1, CELLS // len(every))
        edges = np.searchsorted(inverse[order], np.arange(0, len(distinct) + step, step))
        for i in range(len(edges) - 1):
            some, mine = distinct[i * step : (i + 1) * step], order[edges[i] : edges[i + 1]]
            here, then = (np.concatenate((np.zeros((len(some), 1), np.int64), np.cumsum(self.served_by(r[:, None], every[None, :]), axis=1)), axis=1) for r in (some, some + 1))
            row, q = inverse[mine] - i * step, queues[mine]
            out[mine] = then[row, q] + here[row, -1] - here[row, q]
        return out


def _queues(tokens: DataFrame, named: Collection[str]) -> tuple[DataFrame, dict[str, int]]:
    """Sums by part and source with the queue of the source, saved; and the queues' totals. named: sources with a given weight."""
    sums = save(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "sums")
    whole = sums.groupBy("source").agg(F.sum("n").alias("n"))
    given = F.col("source").isin(list(named)) if named else F.lit(False)
    totals = whole.where(~given).orderBy(F.desc("n"), "source").limit(MAX_QUEUES + 1).collect()
    own = {r["source"]: r["n"] for r in [*totals[:MAX_QUEUES], *(whole.where(given).collect() if named else [])]}
    if len(totals) <= MAX_QUEUES:
        return sums.withColumn("queue", F.col("source")), own
    # Rare sources are served one after another in a queue of their own, whose name no source has.
    other = "other sources"
    while other in own:
        other += "_"
    whole = sums.agg(F.sum("n")).first()[0]
    return sums.withColumn("queue", F.when(F.col("source").isin(list(own)), F.col("source")).otherwise(other)), own | {other: whole - sum(own.values())}


def placed(tokens: DataFrame, named: Collection[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """tokens with queue and before, the tokens of the queue ahead of the row; and the queues' totals."""
    sums, totals = _queues(tokens, named)
    earlier = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part and source
    bases = save(sums.select("part", "source", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    side = F.broadcast(bases) if bases.count() <= MAX_BROADCAST_SUMS else bases.hint("merge")
    return tokens.join(side, ["part", "source"]).withColumn("before", F.col("base") + F.col("run")), totals


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, least: int = LEAST) -> DataFrame:
    """Pieces: id_col, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset, queue, round, sequence_tokens, padded_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    tokens, totals = placed(tokenized(docs, path, id_col, text_col, source_col, end_id), list(weights or ()))
    shared = docs.sparkSession.sparkContext.broadcast(Plan.of(totals, weights, sequence, least) if totals else None)  # MAX_QUEUES + 1 rows and those of the given weights

    def make():
        forget_encoders()
        plan = shared.value
        place, names = {k: i for i, k in enumerate(plan.names)} if plan else {}, np.array(plan.names, object) if plan else None

        def one(batch) -> Iterator[dict[str, list]]:
            queues = np.array([place[k] for k in batch.column(1).to_pylist()], np.int64)
            before, sizes = (np.array(batch.column(i).to_pylist(), np.int64) for i in (2, 3))
            ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for x, n in zip(batch.column(4).to_pylist(), sizes.tolist(), strict=True)]
            ends, at = np.cumsum(4 * sizes), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - 4 * sizes[at] + OUT_BYTES, "right")))
                yield cut(batch.column(0).slice(at, to - at), queues[at:to], before[at:to], sizes[at:to], np.concatenate(ids[at:to]).astype("<u4"))
                at = to

        def cut(doc, queues, before, sizes, ids) -> dict[str, list]:
            of, start, length, at, rounds = plan.pieces(queues, before, sizes)
            first = at // sequence
            parts = (at + length - 1) // sequence - first + 1
            whole = np.repeat(np.arange(len(of)), parts)
            sid = first[whole] + np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)
            left = np.maximum(at[whole], sid * sequence)
            right = np.minimum(at[whole] + length[whole], (sid + 1) * sequence)
            of, start, size = of[whole], start[whole] + left - at[whole], right - left
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(4 * size))).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])  # pieces of a document follow one another
            full = np.where(sid == plan.total // sequence, plan.total % sequence, sequence)
            return {id_col: doc.take(pa.array(of)), "start": start, "length": size, "ids": data, "doc_tokens": sizes[of], "sequence_id": sid, "offset": left - sid * sequence, "queue": names[queues[of]].tolist(), "round": rounds[whole], "sequence_tokens": full, "padded_tokens": np.where(full & (full - 1) == 0, full, sequence)}

        return one

    return map_batches(tokens.select("doc", "queue", "before", "n", "ids"), make, f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, queue string, round bigint, sequence_tokens bigint, padded_tokens bigint")


def with_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """ids_crc32 (unsigned) in place of ids."""
    rest = [c for c in pieces.columns if c not in ("ids", id_col, "start", "length")]
    return pieces.select(column(id_col), "start", "length", F.crc32("ids").alias("ids_crc32"), *rest)


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
