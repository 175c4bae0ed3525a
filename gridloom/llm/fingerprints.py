"""Document fingerprints: 128-bit SimHash over weighted terms, and search within a Hamming radius. DataFrame functions only.

The terms are a text's distinct lower-case runs of letters and digits; a term weighs its length, 16 at most. Two 64-bit hashes
of each term vote on the bits with its weight. The votes of two bits, 32 apart, are added up in one long, so 64 sums do for
128 bits; a term count that could overflow a half, over 2**28, doesn't fit into a string. A bit is one if more than half of
the weight votes for it. Likeness is the cosine that the differing bits estimate, 0 where it is negative.

Search: for a radius r a fingerprint is cut into r + 1 blocks. Two that differ in at most r bits agree in a block, so r + 1
tables, each a permutation that leads with another block, hold all candidates; a pair is judged only in the first table in
which it meets. Entries of a block that over CROWDED distinct fingerprints share are posted again under the block and each of
r + 1 parts of the other bits: two within the radius agree in one of those too. Equal fingerprints are one entry with a count.

Null texts count as empty; texts without terms have fingerprint zero. Ids are numbers; documents are in order of their id, nulls first, and
repeated ids in the order of their texts; the last one's next document is the first. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import column, save, with_row_id

MAX_WEIGHT, RADIUS, BITS = 16, 3, 128
#: Rows of a range of ids, about, and cells of equal width whose counts say into how many ranges each is cut.
PART_ROWS, CELLS = 2048, 4096
#: Distinct fingerprints of a block from which on it is cut again.
CROWDED = 64
HALVES = 0x0000000100000001


def _terms(text: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(text), r"[^\p{L}\p{N}]+")))


def simhash(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts: keys and text. One row for each of the keys, which must be distinct: keys, hi and lo (long)."""
    each = texts.select(*keys, F.explode(_terms(F.col("text"))).alias("term"))
    hashed = each.select(*keys, F.least(F.length("term"), F.lit(MAX_WEIGHT)).cast("long").alias("w"), F.xxhash64("term").alias("h0")).withColumn("h1", F.xxhash64("h0"))
    votes = [F.sum(F.shiftrightunsigned(f"h{j}", k).bitwiseAND(F.lit(HALVES)) * F.col("w")).alias(f"v{j}_{k}") for j in (0, 1) for k in range(32)]
    summed = hashed.groupBy(*keys).agg(F.sum("w").alias("all"), *votes)

    def bits(j: int) -> Column:
        ones = [(half, k) for k in range(32) for half in (0, 1)]
        lane = {0: lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)), 1: lambda c: F.shiftrightunsigned(c, 32)}
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(lane[half](F.col(f"v{j}_{k}")) * 2 > F.col("all"), F.lit(_signed(1 << (k + 32 * half)))).otherwise(F.lit(0)) for half, k in ones])

    return summed.select(*keys, bits(0).cast("long").alias("hi"), bits(1).cast("long").alias("lo"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def written(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: str, lo: str, other_hi: str, other_lo: str) -> Column:
    return F.bit_count(F.col(hi).bitwiseXOR(F.col(other_hi))) + F.bit_count(F.col(lo).bitwiseXOR(F.col(other_lo)))


def likeness(bits_apart: Column) -> Column:
    return F.when(bits_apart == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(bits_apart * (3.141592653589793 / BITS))))


def _bits(hi: Column, lo: Column, at: int, n: int) -> Column:
    """Bits at..at+n of the 128, n at most 64, as a long."""
    if at >= 64:
        return _bits(lo, lo, at - 64, n)
    if at + n <= 64:
        whole = F.shiftrightunsigned(hi, 64 - at - n)
        return whole if n == 64 else whole.bitwiseAND(F.lit((1 << n) - 1))
    left, right = 64 - at, at + n - 64
    return F.shiftleft(hi.bitwiseAND(F.lit(_signed((1 << left) - 1))), right).bitwiseOR(F.shiftrightunsigned(lo, 64 - right))


def _cuts(first: int, last: int, n: int) -> list[tuple[int, int]]:
    edges = [first + (last - first) * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _blocks(hi: Column, lo: Column, radius: int = RADIUS) -> list[Column]:
    return [_bits(hi, lo, at, n) for at, n in _cuts(0, BITS, radius + 1)]


def _parts(hi: Column, lo: Column, block: int, radius: int) -> list[Column]:
    """The bits outside a block, in radius + 1 parts, each a hash of two pieces at most."""
    at, n = _cuts(0, BITS, radius + 1)[block]
    out = []
    for a, size in _cuts(0, BITS - n, radius + 1):
        before, after = (a, min(size, max(0, at - a))), (max(a, at) + n, size - min(size, max(0, at - a)))
        out.append(F.xxhash64(*[_bits(hi, lo, *x) for x in (before, after) if x[1] > 0]))
    return out


def _first_equal(left: list[Column], right: list[Column]) -> Column:
    same = list(zip(left, right, strict=True))
    return reduce(lambda rest, i: F.when(same[i][0] == same[i][1], F.lit(i)).otherwise(rest), range(len(same) - 1, -1, -1), F.lit(len(same)))


def within_radius(all_fps: DataFrame, queries: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """all_fps: hi, lo; queries: hi, lo (rows may repeat). For each distinct query: n_within, the rows of all_fps within the radius (1 to 15 bits)."""
    if not 1 <= radius <= 15:
        raise ValueError("a radius is from 1 to 15 bits")
    table = lambda: F.posexplode(F.array(*_blocks(F.col("hi"), F.col("lo"), radius))).alias("t", "block")
    entries = save(all_fps.groupBy("hi", "lo").agg(F.count("*").alias("n")).select("hi", "lo", "n", table()), "entries")
    asked = queries.select("hi", "lo").distinct().select("hi", "lo", table())
    full = save(entries.groupBy("t", "block").agg(F.count("*").alias("m")).where(F.col("m") > crowded).select("t", "block", F.lit(True).alias("full")), "crowded")

    def posted(rows: DataFrame) -> DataFrame:
        """part: -1 in a block of few fingerprints; in a crowded one a row for each part."""
        rows = rows.join(full, ["t", "block"], "left")
        parts = F.array(*[F.array(*_parts(F.col("hi"), F.col("lo"), b, radius)) for b in range(radius + 1)])[F.col("t")]
        few = rows.where("full IS NULL").drop("full").withColumns({"part": F.lit(-1), "piece": F.lit(0).cast("long")})
        return few.unionByName(rows.where("full").drop("full").select("*", F.posexplode(parts).alias("part", "piece")))

    met = posted(asked).withColumnsRenamed({"hi": "q_hi", "lo": "q_lo"}).join(posted(entries), ["t", "block", "part", "piece"])
    q, e = (F.col("q_hi"), F.col("q_lo")), (F.col("hi"), F.col("lo"))
    once = F.col("t") == _first_equal(_blocks(*q, radius), _blocks(*e, radius))
    part = reduce(lambda rest, b: F.when(F.col("t") == b, _first_equal(_parts(*q, b, radius), _parts(*e, b, radius))).otherwise(rest), range(radius + 1), F.lit(-2))
    near = met.where(distance("q_hi", "q_lo", "hi", "lo") <= radius).where(once).where((F.col("part") == -1) | (F.col("part") == part))
    return near.groupBy("q_hi", "q_lo").agg(F.sum("n").alias("n_within"))


def _in_parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and _part, a range of ids, as many as the rows ask for; ids in a null range come first.

    The ids' span is cut into CELLS cells of equal width, whose counts reach the driver, and each cell into as many ranges of
    equal width as it has rows for.
    """
    rows = docs.select(column(id_col).alias("_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    x = F.col("_id").cast("double")
    low, high = rows.agg(F.min(x), F.max(x)).first()
    if low is None or low == high:
        return rows.withColumn("_part", F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    scaled = (x - F.lit(low)) / F.lit((high - low) / CELLS)
    cell = F.least(F.lit(CELLS - 1), F.floor(scaled)).cast("int")
    counts = {r["cell"]: r["n"] for r in rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    cuts = [max(1, -(-counts.get(i, 0) // PART_ROWS)) for i in range(CELLS)]
    first = [0]
    for c in cuts:
        first.append(first[-1] + c)
    of = lambda values: F.element_at(F.lit(values), cell + 1)
    inside = F.floor((scaled - cell) * of(cuts)).cast("long")
    part = of(first[:-1]) + F.least(F.greatest(inside, F.lit(0)), of(cuts) - 1)
    return rows.withColumn("_part", F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(part).cast("long"))


def _successors(parts: DataFrame) -> DataFrame:
    """parts: distinct _part. _part and then: the next part that has rows; of the last, the first. A few bytes for each part."""
    order = Window.orderBy("_part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.select("_part", F.coalesce(F.lead("_part").over(order), F.first("_part").over(whole)).alias("then"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, hi and lo, for each row of docs."""
    rows = with_row_id(docs.select(column(id_col).alias("_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text")), "_row")
    return simhash(rows, ["_row", "_id"]).drop("_row").withColumnRenamed("_id", id_col)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """For each row: id_col, n_chars, edited_sha256, the fingerprints of the text and of its edited text, and how alike they are to each other and to the next one's.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many of the next document's first.
    n_within, for ids divisible by 20: the rows, itself included, whose fingerprints are within the radius of its own. Other
    columns of docs are not read.
    """
    rows = _in_parts(docs, id_col, text_col)
    order = Window.partitionBy("_part").orderBy("_id", "text")  # rows of the same id and text are alike
    placed = rows.select("_part", "_id", "text", F.row_number().over(order).alias("_rank"), F.lead("text").over(order).alias("_next"))
    firsts = rows.groupBy("_part").agg(F.min(F.struct("_id", "text")).alias("first")).select(F.col("_part").alias("then"), F.col("first.text").alias("after"))
    successors = save(_successors(rows.select("_part").distinct()), "successors")
    last = placed.where(F.col("_next").isNull()).join(successors, "_part").join(firsts, "then").select("_part", "_id", "text", "_rank", F.col("after").alias("_next"))  # one row for each part
    placed = placed.where(F.col("_next").isNotNull()).unionByName(last)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))
    placed = placed.select("_part", "_rank", "_id", n.cast("long").alias("n"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), edited.alias("text")))).alias("x"))
    keys = ["_part", "_rank", "_id", "n", "which", "sha"]
    prints = simhash(placed.select("_part", "_rank", "_id", "n", "x.which", F.when(F.col("x.which") == 1, F.sha2("x.text", 256)).alias("sha"), "x.text"), keys)
    one = save(prints.groupBy("_part", "_rank", "_id", "n").agg(F.max("sha").alias("sha"), *[F.max(F.when(F.col("which") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("hi", "lo")]), "fingerprints")
    ahead = one.where("_rank = 1").select(F.col("_part").alias("then"), F.struct("hi0", "lo0").alias("after")).join(successors, "then").select("_part", "after")
    one = one.join(ahead, "_part").withColumn("_n", F.coalesce(F.lead(F.struct("hi0", "lo0")).over(Window.partitionBy("_part").orderBy("_rank")), "after")).withColumns({"hi2": F.col("_n.hi0"), "lo2": F.col("_n.lo0")})
    asked = F.col("_id") % 20 == 0
    found = within_radius(one.select(F.col("hi0").alias("hi"), F.col("lo0").alias("lo")), one.where(asked).select(F.col("hi0").alias("hi"), F.col("lo0").alias("lo")), radius)
    n_within = F.when(asked, F.coalesce("n_within", F.lit(0)))
    return (
        one.join(found, (F.col("hi0") == F.col("q_hi")) & (F.col("lo0") == F.col("q_lo")), "left")
        .select(
            F.col("_id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), written("hi0", "lo0").alias("fingerprint"), written("hi1", "lo1").alias("edited_fingerprint"),
            likeness(distance("hi0", "lo0", "hi1", "lo1")).alias("near_edited"), likeness(distance("hi0", "lo0", "hi2", "lo2")).alias("near_next"), n_within.alias("n_within"),
        )
    )
