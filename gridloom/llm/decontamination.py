"""Benchmark decontamination: suffix arrays over shards of the training words, in which every suffix of the test items is searched.

A shard is what one task reads of the documents until SHARD_WORDS words have come together. Its words are numbers of the
test items' vocabulary (0: in no item), its suffix array orders the suffixes that begin with a word of an item, each up to
the first word of none, since no match goes on beyond. A test suffix is looked up by binary search, some words at a time as
they fit 64 bits, for the range of suffixes that begin with its window: all locations of the window in the shard. Where a
window occurs, the words from there are looked up in the items' own suffix array for the longest verbatim match.

Nothing is shuffled: a document's result is complete within its task. The items reach the tasks in slices of at most
SLICE_BYTES of text, counted before they are sent; if there are several, the documents pass them one after another, and
what is known of a document goes with it.

Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case. A window is `window` consecutive
words of an item, or all of an item that has fewer; items without words have none. Null texts have no words. Repeated rows
are rows of their own; items that repeat an id count once. A null item_id is listed as an empty string. Empty tables give no
row, or documents without hits. Columns of the documents may have any names in decontaminate(); scan() refuses to keep a
column that is named as one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from gridloom.llm.shared import column, save, slices, unused

WINDOW = 10
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Text of the items that are sent to the tasks at once.
SLICE_BYTES = 16 << 20
#: What scan() adds, in this order.
FOUND = {"n_words": "bigint", "spans": "array<struct<start:bigint,end:bigint>>", "items": "array<string>", "longest": "struct<length:bigint,word:bigint,item:string,item_word:bigint>"}
_BYTES = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


class Index:
    """Sorted suffixes of numbered words. ids: numbers, 0 where a suffix ends; bits: of a number."""

    def __init__(self, ids: np.ndarray, bits: int):
        self.ids, self.bits, self.step = ids, bits, 64 // bits
        n = len(ids)
        self.end = np.minimum.accumulate(np.where(ids == 0, np.arange(n), n)[::-1])[::-1]
        self.key = np.zeros(n + 1, np.uint64)  # of the next `step` words, as far as the suffix goes
        alive = np.ones(n, bool)
        for t in range(self.step):
            x = np.zeros(n, np.uint64)
            x[: max(0, n - t)] = ids[t:]
            alive &= x > 0
            self.key[:n] = (self.key[:n] << np.uint64(bits)) | np.where(alive, x, np.uint64(0))
        self.sa = self._sorted(np.flatnonzero(ids))
        self.first = self.key[self.sa]

    def _sorted(self, at: np.ndarray) -> np.ndarray:
        """By keys first; then what is still tied is sorted by the ranks that follow, twice as far each time."""
        sa = at[np.argsort(self.key[at])]
        rank, n = np.zeros(len(self.ids) + 1, np.int64), len(self.ids) + 1
        k = self.key[sa]
        new = np.ones(len(sa), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.flatnonzero(new)[np.cumsum(new) - 1] if len(sa) else np.zeros(0, np.int64)
        rank[sa] = group + 1
        tied, depth = np.arange(len(sa)), self.step
        while len(tied):
            g = group[tied]
            same = np.zeros(len(tied) + 1, bool)
            same[1:-1] = g[1:] == g[:-1]
            tied = tied[(same[1:] | same[:-1]) & (self.end[sa[tied]] - sa[tied] >= depth)]
            if not len(tied):
                break
            p, g = sa[tied], group[tied]
            key = g * n + rank[p + depth]
            order = np.argsort(key)
            p, key = p[order], key[order]
            new = np.ones(len(p), bool)
            new[1:] = key[1:] != key[:-1]
            sa[tied] = p
            group[tied] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
            rank[p] = group[tied] + 1
            depth *= 2
        return sa

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, skip: int, key: np.ndarray, right: bool) -> np.ndarray:
        """Where keys belong among those of suffixes lo to hi, after skip words that all of them share."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            there = self.key[np.where(open_, self.sa[np.where(open_, mid, 0)] + skip, 0)]
            up = open_ & ((there <= key) if right else (there < key))
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        return lo

    def ranges(self, of: Index, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of another index, from `at` on and so many: the range of sorted suffixes that begin with them."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.sa))
        todo, skip = np.flatnonzero(length > 0), 0
        while len(todo):
            m = np.minimum(length[todo] - skip, self.step)
            rest = (np.uint64(1) << ((self.step - m) * self.bits).astype(np.uint64)) - np.uint64(1)
            low = of.key[at[todo] + skip] & ~rest
            if skip:
                lo[todo], hi[todo] = self._bisect(lo[todo], hi[todo], skip, low, False), self._bisect(lo[todo], hi[todo], skip, low | rest, True)
            else:
                lo[todo], hi[todo] = np.searchsorted(self.first, low), np.searchsorted(self.first, low | rest, "right")
            skip += self.step
            todo = todo[(lo[todo] < hi[todo]) & (length[todo] > skip)]
        return lo, hi

    def longest(self, of: Index, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For suffixes of another index: the length of the longest match in this one, and where."""
        length, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.sa))
        todo, skip = np.arange(len(at)) if len(self.sa) else np.zeros(0, np.int64), 0
        while len(todo):
            key = of.key[at[todo] + skip]
            left, right = self._bisect(lo[todo], hi[todo], skip, key, False), self._bisect(lo[todo], hi[todo], skip, key, True)
            for near in (left - 1, left):
                inside = (near >= lo[todo]) & (near < hi[todo])
                p = self.sa[np.where(inside, near, 0)]
                there, shared = self.key[p + np.where(inside, skip, 0)], np.zeros(len(todo), np.int64)
                for m in range(1, self.step + 1):
                    cut = np.uint64((self.step - m) * self.bits)
                    word = (key >> cut) & np.uint64((1 << self.bits) - 1)
                    shared += (word > 0) & ((there >> cut) == (key >> cut))
                better = inside & (skip + shared > length[todo])
                length[todo[better]], place[todo[better]] = (skip + shared)[better], p[better]
            full = (left < right) & (length[todo] == skip + self.step)
            lo[todo], hi[todo] = left, right
            todo, skip = todo[full], skip + self.step
        return length, place


class Items:
    """A slice of the test items: their vocabulary, their sorted suffixes, and their distinct windows with the items of each."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int):
        items = [x for x in items if x[1]]
        self.numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        ids = [np.array([*[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], 0], np.uint32) for _, words in items]
        self.starts = np.cumsum([0, *map(len, ids)])[:-1]
        self.bits = max(4, len(self.numbers).bit_length())
        self.index = index = Index(np.concatenate(ids) if ids else np.zeros(0, np.uint32), self.bits)
        own = np.repeat(np.array([min(window, len(x) - 1) for x in ids], np.int64), [len(x) for x in ids])
        own = np.where(np.arange(len(own)) + own <= index.end, own, 0)  # of the window at each place, 0 where there is none
        at, first, classes, n = [], [], [], 0
        for length in np.unique(own[own > 0]).tolist():  # windows that are the same are neighbours among the sorted suffixes
            p = index.sa[own[index.sa] == length]
            new = np.zeros(len(p), bool)
            new[:1] = True
            for skip in range(0, length, index.step):
                rest = np.uint64((1 << max(0, index.step - (length - skip)) * self.bits) - 1)
                key = index.key[p + skip] & ~rest
                new[1:] |= key[1:] != key[:-1]
            at.append(p)
            first.append(p[new])
            classes.append(np.cumsum(new) - 1 + n)
            n += int(new.sum())
        self.at = np.concatenate([np.zeros(0, np.int64), *first])
        self.length = own[self.at]
        held = np.searchsorted(self.starts, np.concatenate([np.zeros(0, np.int64), *at]), "right") - 1
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *classes]) * max(1, len(items)) + held)
        self.holders = pairs % max(1, len(items))
        self.held_from = np.searchsorted(pairs // max(1, len(items)), np.arange(n + 1))

    def holding(self, windows: list[int]) -> set[str]:
        """Ids of the items that have any of the windows."""
        return {self.names[i] for w in windows for i in self.holders[self.held_from[w] : self.held_from[w + 1]].tolist()}

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers and a 0 at the end."""
        return np.fromiter(map(self.numbers.get, [*words, b""], repeat(0)), np.uint32, len(words) + 1)

    def search(self, docs: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], set[str], tuple | None]]:
        """For each document: merged spans of hit words, the items whose windows occur, and (length, word, item, word of the item)."""
        out: list[tuple[list[tuple[int, int]], set[str], tuple | None]] = [([], set(), None) for _ in docs]
        shard = Index(np.concatenate(docs), self.bits)
        lo, hi = shard.ranges(self.index, self.at, self.length)
        n = hi - lo
        if not n.sum():
            return out
        which = np.repeat(np.arange(len(n)), n)
        at = shard.sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        size = len(shard.ids) + 1
        hit = np.cumsum(np.bincount(at, minlength=size) - np.bincount(at + self.length[which], minlength=size)) > 0
        starts = np.cumsum([0, *map(len, docs)])[:-1]
        edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
        for a, b, d in zip(edges[::2].tolist(), edges[1::2].tolist(), (np.searchsorted(starts, edges[::2], "right") - 1).tolist(), strict=True):
            out[d][0].append((a - int(starts[d]), b - int(starts[d])))
        met = np.unique((np.searchsorted(starts, at, "right") - 1) * len(n) + which)
        cuts = [0, *(np.flatnonzero(np.diff(met // len(n))) + 1).tolist(), len(met)]
        seen: dict[bytes, set[str]] = {}
        for a, b in pairwise(cuts):
            windows = met[a:b] % len(n)
            key = windows.tobytes()
            if key not in seen:
                seen[key] = self.holding(windows.tolist())
            out[int(met[a]) // len(n)][1].update(seen[key])
        at = np.unique(at)
        length, place = self.index.longest(shard, at)
        doc = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((at, -length, doc))
        for i in order[np.diff(doc[order], prepend=-1) > 0].tolist():
            item = int(np.searchsorted(self.starts, place[i], "right")) - 1
            d = int(doc[i])
            out[d] = (*out[d][:2], (int(length[i]), int(at[i] - starts[d]), self.names[item], int(place[i] - self.starts[item])))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, text: str, keep: Sequence[str], names: dict[str, str], items, before: bool) -> DataFrame:
    """One slice of items against all documents. docs: text (binary), keep and, if before, what earlier slices have found."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {f.name: f.dataType for f in docs.schema}
    held = [text, *keep]
    schema = docs.select(*[column(c) for c in held]).schema
    for own, name in names.items():
        schema = schema.add(name, kinds[name] if before else DataType.fromDDL(FOUND[own]))
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = items.value
        parts: list[pa.RecordBatch] = []
        shard: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            found = tests.search(shard)
            if before:
                was = list(zip(*[rows.column(names[c]).to_pylist() for c in ("spans", "items", "longest")], strict=True))
                found = [(_merged([*s, *[(x["start"], x["end"]) for x in ws]]), i | set(wi), max([x for x in (m, wm and (wm["length"], wm["word"], wm["item"], wm["item_word"])) if x], key=lambda x: (x[0], -x[1]), default=None)) for (s, i, m), (ws, wi, wm) in zip(found, was, strict=True)]
            own = {
                "n_words": [len(x) - 1 for x in shard], "spans": [[{"start": a, "end": b} for a, b in s] for s, _, _ in found], "items": [sorted(i) for _, i, _ in found],
                "longest": [m and dict(zip(("length", "word", "item", "item_word"), m, strict=True)) for _, _, m in found],
            }
            for c, name in names.items():
                rows = rows.drop_columns([name]) if before else rows
                rows = rows.append_column(out.field(name), [pa.array(own[c], out.field(name).type)])
            return rows.combine_chunks().to_batches()[0]

        size = 0
        for part in slices(batches):
            if not part.num_rows:
                continue
            parts.append(part)
            for t in part.column(0).to_pylist():
                shard.append(tests.numbered(words_of(t)))
                size += len(shard[-1])
            if size >= SHARD_WORDS:
                yield told()
                parts, shard, size = [], [], 0
        if parts:
            yield told()

    order = [*held, *names.values()] if before else held
    return docs.select(*[column(c) for c in order]).mapInArrow(run, schema)


def _slices(benchmark: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, so many bytes of text at a time: they are dealt by hash into ever more slices until each is small, or one item."""
    items = save(benchmark.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"), column(text_col).cast("binary").alias("text")).where("text IS NOT NULL").distinct(), "items")
    n = 1
    while True:
        slice_ = F.pmod(F.xxhash64("id", "text"), F.lit(n))
        most = items.groupBy(slice_.alias("s")).agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).where(f"n > 1 AND size > {slice_bytes}")
        if most.isEmpty():
            break
        n *= 2
    for s in range(n):
        yield [(r.id, words_of(bytes(r.text))) for r in items.where(slice_ == s).orderBy("id", "text").toLocalIterator()]


def _scanned(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], names: dict[str, str], text_col: str, item_col: str, item_text: str, window: int, slice_bytes: int) -> DataFrame:
    spark, text = docs.sparkSession, unused(docs, "scanned")
    rows, before = docs.select(column(text_col).cast("string").cast("binary").alias(text), *[column(c) for c in keep]), False
    for items in _slices(benchmark, item_col, item_text, slice_bytes):
        if before:
            rows = save(rows, "scanned")
        rows, before = _pass(rows, text, keep, names, spark.sparkContext.broadcast(Items(items, window)), before), True
    return rows.select(*[column(c) for c in [*keep, *names.values()]])


def scan(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """For each row of docs its columns keep, n_words, spans (words hit by any window, merged), items (ids whose windows occur) and
    longest: the longest verbatim match that a hit begins, with its place in the document and in an item; null without hits."""
    if clash := {c.lower() for c in keep} & set(FOUND):
        raise ValueError(f"columns {sorted(clash)} are named as results; rename them")
    return _scanned(docs, benchmark, keep, {c: c for c in FOUND}, text_col, item_col, item_text, window, slice_bytes)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document: how much of it is hit, by how many items, and the longest match."""
    found = scan(docs, benchmark, [id_col])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.concat_ws(",", "items")
    return found.select(column(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.coalesce("longest.length", F.lit(0)).alias("longest_match"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_hit: float = 0.0, **options: object) -> DataFrame:
    """docs without the rows of whose words more than the share most_hit is hit."""
    names = {c: unused(docs, c) for c in FOUND}
    found = _scanned(docs, benchmark, docs.columns, names, text_col, **{"item_col": "item_id", "item_text": "text", "window": WINDOW, "slice_bytes": SLICE_BYTES} | options)
    hit = F.aggregate(column(names["spans"]), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.where(hit <= most_hit * column(names["n_words"])).select(*[column(c) for c in docs.columns])
