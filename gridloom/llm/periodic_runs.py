"""Runs of periodic words, by the linear method for tandem repeats of Gusfield and Stoye, over the words of a shard at once.

A run is a stretch of words with smallest period q, of at least four periods and six words, that can't be extended.

1. Suffixes are ranked by their first 1, 2, 4, ... words; the ranks of each length are kept, so the common extension of two
   places, forward or backward, is found in as many steps. The last ranks order the suffixes: the suffix tree is their
   array with the lengths that neighbours share, a node being an interval of it.
2. LZ blocks: each is the longest stretch that also begins earlier. Squares around a block's start, of a period up to the
   block before it, or up to it and the next block, extended both ways, cover the leftmost occurrence of every square.
3. Suffix-link walks: from the first square of such a stretch one word on at a time, as far as it goes or for one period.
   Each square's locus in the tree (the interval of suffixes that begin with it) is marked; these are the whole vocabulary.
4. The suffixes of all marked loci are the occurrences of all squares; those of one period at consecutive words merge into runs.
   Only squares of primitive roots are marked, so a period is the smallest one and occurrences are few.

Words are numbered by their first place in their own text, so no match crosses two texts and a shard is one long text.

Before that, texts without any run are set aside by a condition that each run meets: of its words after the first period,
at least three periods of them in a row, each has occurred at most a period before. For periods in [2^(t-1)+1, 2^t] a text
must hold a stretch of 3(2^(t-1)+1) words that occurred at most 2^t before (five for period 1).

Null texts count as empty; texts without words have no runs and collapse to the empty string. Repeated rows are rows of
their own; an empty table gives no row. Columns kept may have any name but runs, n_words and collapsed. A task holds the words of a
shard of SHARD_WORDS words or of the longest text, some 500 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from gridloom.llm.shared import column, slices, unused

LEAST_PERIODS, LEAST_WORDS = 4, 6
SHARD_WORDS = 1 << 18
#: What detect() adds.
FOUND = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


class Ranks:
    """Ranks of the suffixes of t by their first 2^level words, for each level until all differ."""

    def __init__(self, t: np.ndarray):
        n = self.n = len(t)
        counts = np.bincount(t, minlength=n)
        rank = np.append((np.cumsum(counts) - counts)[t], -1)
        self.levels, tied, reach = [rank.astype(np.int32)], np.flatnonzero(counts[t] > 1), 1
        while len(tied):
            beyond = tied + reach
            key = rank[tied] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n)], -1) + 1
            order = np.argsort(key)
            tied, key = tied[order], key[order]
            old = rank[tied]
            at = np.arange(len(tied))
            groups, same = np.ones(len(tied), bool), np.ones(len(tied), bool)
            groups[1:], same[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
            head, start = np.flatnonzero(groups)[np.cumsum(groups) - 1], np.flatnonzero(same)[np.cumsum(same) - 1]
            rank = rank.copy()
            rank[tied] = old + start - head
            self.levels.append(rank.astype(np.int32))
            alone = same & np.append(same[1:], True)
            tied, reach = tied[~alone[at]], reach * 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank[:n]] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from two different places on are the same."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.levels))):
            step = (self.levels[level][i] == self.levels[level][j]).astype(np.int64) << level
            i, j, length = i + step, j + step, length + step
        return length

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before two different places are the same."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.levels))):
            inside = np.minimum(i, j) >= 1 << level
            a, b = np.where(inside, i - (1 << level), 0), np.where(inside, j - (1 << level), 0)
            step = (inside & (self.levels[level][a] == self.levels[level][b])).astype(np.int64) << level
            i, j, length = i - step, j - step, length + step
        return length


class Nearest:
    """The nearest value below a bound, to the left or right, by minima of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.n, self.least, reach = len(values), [values.astype(np.int32)], 1
        while 2 * reach <= self.n:
            self.least.append(np.minimum(self.least[-1][:-reach], self.least[-1][reach:]))
            reach *= 2

    def left(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The last place up to `at` whose value is less; -1 if there is none."""
        at = at.copy()
        for level in reversed(range(len(self.least))):
            start = at - (1 << level) + 1
            at = np.where((start >= 0) & (self.least[level][np.clip(start, 0, len(self.least[level]) - 1)] >= below), at - (1 << level), at)
        return at

    def right(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The first place from `at` on whose value is less; their number if there is none."""
        at = at.copy()
        for level in reversed(range(len(self.least))):
            inside = at + (1 << level) <= self.n
            at = np.where(inside & (self.least[level][np.clip(at, 0, len(self.least[level]) - 1)] >= below), at + (1 << level), at)
        return at


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(n) items: whose it is, and its number there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def blocks(r: Ranks) -> np.ndarray:
    """Starts of the LZ blocks, and the end."""
    n, sa = r.n, r.suffixes
    near, places = Nearest(sa), np.arange(n)
    longest = np.zeros(n, np.int64)
    before, after = near.left(places, sa), near.right(places, sa)  # suffixes on either side that begin earlier in the text
    for other, there in ((before, before >= 0), (after, after < n)):
        longest[sa[there]] = np.maximum(longest[sa[there]], r.forward(sa[there], sa[other[there]]))
    jump, at, out = np.maximum(longest, 1).tolist(), 0, []
    while at < n:
        out.append(at)
        at += jump[at]
    return np.array([*out, n], np.int64)


def _primitive(r: Ranks, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the squares' roots are no powers themselves: no period of the square divides its root by a prime."""
    top = int(period.max(initial=1)) + 1
    least = np.arange(top)
    for p in range(2, int(top**0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, top, p)] = p
    good, rest = np.ones(len(period), bool), period.copy()
    while (rest > 1).any():
        shorter = period // least[rest]
        todo = good & (rest > 1)
        good[todo] = r.forward(start[todo], (start + shorter)[todo]) < (2 * period - shorter)[todo]
        rest = rest // np.maximum(least[rest], 1)
    return good


def covering(r: Ranks, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of stretches of squares with primitive roots, around the starts of LZ blocks; all leftmost squares are in one."""
    b = blocks(r)
    size = np.diff(b)
    of, k = _spread(size[:-1])  # a square whose right half holds the start of the next block
    x, period = b[1:-1][of] - k - 1, k + 1
    of, k = _spread(size + np.append(size[1:], 0))  # one whose left half holds the start of this block
    x, period = np.append(x, b[:-1][of]), np.append(period, k + 1)
    inside = x + period < r.n
    x, period = x[inside], period[inside]
    same = t[x] == t[x + period]
    x, period = x[same], period[same]
    ahead, behind = r.forward(x, x + period), r.backward(x, x + period)
    found = ahead + behind >= period
    stretches = np.unique(np.stack([x - behind, x + period + ahead, period])[:, found], axis=1)
    start, end, period = stretches
    good = _primitive(r, start, period)
    return start[good], end[good], period[good]


def runs_of(t: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period. t: words as numbers below its length, the same for the same word."""
    none = np.zeros((3, 0), np.int64)
    if len(t) < LEAST_WORDS:
        return none
    r = Ranks(t)
    start, end, period = covering(r, t)
    if not len(start):
        return none
    sa = r.suffixes
    shared = np.append(0, r.forward(sa[:-1], sa[1:]))
    near = Nearest(shared)
    of, step = _spread(np.minimum(period, end - start - 2 * period + 1))  # the walks
    root, rank = period[of], r.levels[-1][start[of] + step].astype(np.int64)
    low, high = near.left(rank, 2 * root), near.right(np.minimum(rank + 1, r.n), 2 * root)
    low, root, high = np.unique(np.stack([low, root, high]), axis=1)
    of, step = _spread(high - low)
    met = np.unique(root[of] * (r.n + 1) + sa[low[of] + step])  # squares by root, then place
    first = np.flatnonzero(np.diff(met, prepend=-2) != 1)
    last = np.append(first[1:], len(met)) - 1
    period, start = met[first] // (r.n + 1), met[first] % (r.n + 1)
    length = met[last] % (r.n + 1) + 2 * period - start
    enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    found = np.stack([start, length, period])[:, enough]
    return found[:, np.lexsort((found[2], found[0]))]


def may_have_runs(t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text of a shard whether it may have a run; see above. starts: where the texts begin, none of them empty."""
    n = len(t)
    order = np.sort(t * n + np.arange(n)) % max(n, 1)
    gap = np.full(n, n + 1)
    same = t[order[1:]] == t[order[:-1]]
    gap[order[1:][same]] = np.diff(order)[same]
    out = np.zeros(len(starts), bool)
    broken, level = np.arange(n), 0
    while len(broken) and (1 << level) <= n:
        broken = broken[gap[broken] > 1 << level]
        least = LEAST_WORDS - 1 if level == 0 else (LEAST_PERIODS - 1) * ((1 << level >> 1) + 1)
        long_ = broken[np.diff(broken, append=n) > least]
        out[np.searchsorted(starts, long_, "right") - 1] = True
        level += 1
    return out


def _shard(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    own = [i for i, words in enumerate(texts) if len(words) >= LEAST_WORDS]
    if not own:
        return out
    sizes = np.array([len(texts[i]) for i in own])
    starts = np.cumsum(sizes) - sizes
    t = np.concatenate([np.fromiter(map({}.setdefault, texts[i], count(s)), np.int64, n) for i, s, n in zip(own, starts.tolist(), sizes.tolist(), strict=True)])
    chosen = np.flatnonzero(may_have_runs(t, starts))
    if not len(chosen):
        return out
    moved = np.cumsum(sizes[chosen]) - sizes[chosen]
    t = np.concatenate([t[starts[c] : starts[c] + sizes[c]] - starts[c] + m for c, m in zip(chosen.tolist(), moved.tolist(), strict=True)])
    start, length, period = runs_of(t)
    of = np.searchsorted(moved, start, "right") - 1
    for d, s, n, q in zip(of.tolist(), (start - moved[of]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[own[chosen[d]]].append((s, n, q))
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the runs or in their first periods, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    out = np.cumsum(change)[:-1] == 0
    return b" ".join([w for w, keep in zip(words, out.tolist(), strict=True) if keep])


def _detected(docs: DataFrame, keep: Sequence[str], names: dict[str, str], text_col: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    text = unused(docs, "read")
    rows = docs.select(*[column(c) for c in keep], column(text_col).cast("string").cast("binary").alias(text))
    schema = rows.drop(text).schema
    for own, name in names.items():
        schema = schema.add(name, DataType.fromDDL(FOUND[own]))
    out = to_arrow_schema(schema)

    def told(parts: list[pa.RecordBatch], texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = _shard(texts)
        own = {
            "n_words": pa.array([len(w) for w in texts], pa.int64()), "collapsed": pa.array([_kept(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string()),
            "runs": pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], out.field(names["runs"]).type),
        }
        table = pa.Table.from_batches(parts).drop_columns([text])
        for c, name in names.items():
            table = table.append_column(out.field(name), [own[c]])
        return table.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        texts: list[list[bytes]] = []
        size = 0
        for part in slices(batches):
            if part.num_rows:
                parts.append(part)
                texts += [(t or b"").split() for t in part.column(len(keep)).to_pylist()]  # of bytes: ASCII white space only
                size += sum(map(len, texts[-part.num_rows :]))
            if size >= SHARD_WORDS:
                yield told(parts, texts)
                parts, texts, size = [], [], 0
        if parts:
            yield told(parts, texts)

    return rows.mapInArrow(run, schema)


def detect(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """For each row of docs its columns keep, n_words, runs (start and length in words, by start, then period) and collapsed:
    the words that no run holds after its first period, joined by single spaces."""
    if clash := {c.lower() for c in keep} & set(FOUND):
        raise ValueError(f"columns {sorted(clash)} are named as results; rename them")
    return _detected(docs, keep, {c: c for c in FOUND}, text_col)


def collapse(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the text of rows that have runs collapsed (and length_col set to its code points); other rows stay as they are."""
    names = {c: unused(docs, c) for c in FOUND}
    found = _detected(docs, docs.columns, names, text_col)
    has, short = F.size(column(names["runs"])) > 0, column(names["collapsed"])
    new = {text_col: short} | ({length_col: F.length(short)} if length_col else {})
    return found.select(*[F.when(has, new[c]).otherwise(column(c)).cast(docs.schema[c].dataType).alias(c) if c in new else column(c) for c in docs.columns])


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From detect(): the number of runs, the one of most periods (ties: smallest start, then period), and digests."""
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    rows = found.withColumn("best", F.aggregate("runs", F.lit(None).cast(kind), more))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return rows.select(
        column(id_col), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, the texts of a tenth of the ids made periodic from a word on; by crc32 of the id, h, and g = h / 10.

    Where h ends in 0 and the text has n > 0 words, each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    """
    text = column(text_col).cast("string")
    h = F.crc32(column(id_col).cast("string").cast("binary"))
    rows = docs.select(column(id_col), text.alias("text"), h.alias("h"))
    hit = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), "")))
    hit = hit.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    hit = hit.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int"))).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    made = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return hit.select(column(id_col), F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
