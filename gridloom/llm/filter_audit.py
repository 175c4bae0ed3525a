"""How quality filters interact: survivors of every subset of filters from one CUBE, and what each order of them removes at each step.

Each filter is a failure flag of a document. Rows are counted by their flags first, so the CUBE over the flags and the part
expands a few hundred rows a part and never the documents. A grouping row whose selected flags are all false holds the
survivors of that subset of filters. A step of an order is a pair of subsets, before and after its filter; the pairs are
joined once and the orders look them up.

Null texts count as empty, null parts as the empty string; empty texts have no words. A row with a null id fails as a copy
never, and no other row is a copy of it; it has no labels. Of repeated ids the rows are counted one by one, with the labels
that any row of labels gives them. An empty table has no part and no row. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import column, save

#: Filters whose orders are all listed: 5,040 orders of seven.
MOST_FILTERS = 7
#: Fixed values of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
CAPITALS = "".join(map(chr, range(65, 91)))


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides. words: its words."""
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows counted by part and flags A to E (E: a copy of a smaller id's text), with the sums good and toxic of their labels.

    Repeated rows are counted together before anything is shuffled, and first copies are found by a minimum for each digest,
    so a text that a third of all rows share is a row for each task. The join that marks first copies is by id and digest.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    read = docs.select(column(id_col).alias("id"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), ""))
    flags = text_filters(F.col("text"), F.col("words"))
    rows = read.select("id", "part", F.when(F.col("id").isNotNull(), F.unhex(F.sha2("text", 256))).alias("digest"), *[c.alias(f) for f, c in flags.items()])
    rows = save(rows.groupBy("id", "part", "digest", *flags).agg(F.count("*").alias("n")), "flagged")
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(column(id_col).isNotNull()).groupBy(column(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    met = rows.join(marks, "id", "left").join(first, ["id", "digest"], "left")
    met = met.select("part", *flags, (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"), "n", *[(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(name) for c, name in (("q", "good"), ("t", "toxic"))])
    return met.groupBy("part", *flags, "E").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def survivors(counts: DataFrame, filters: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """part, subset (bit i: filter i is applied) and the sums over rows that fail none of the subset's filters; zeros included."""
    m = len(filters)
    cubed = counts.cube(*filters, "part").agg(*[F.sum(c).alias(c) for c in sums], F.grouping_id().alias("left_out"))
    # grouping_id has a bit for each column, the last one's lowest, set where it is left out.
    subset = sum(((1 - F.shiftright("left_out", m - i).bitwiseAND(F.lit(1))) * F.lit(1 << i) for i in range(m)), F.lit(0))
    passing = cubed.where(F.col("left_out").bitwiseAND(F.lit(1)) == 0)
    for f in filters:
        passing = passing.where(~F.coalesce(F.col(f), F.lit(False)))
    found = passing.select("part", subset.cast("int").alias("subset"), *sums)
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])


def audit(counts: DataFrame, filters: Sequence[str], lost: Mapping[str, str]) -> DataFrame:
    """A row for each part, order of the filters and step. counts: part, the flags, n and sums; lost: sum to its column.

    kept and removed at the step, redundant (fails its filter, was removed earlier), unique_fails (fails its filter alone),
    and shapley (what its filter removes, over all orders, added up).
    """
    m = len(filters)
    if m > MOST_FILTERS:
        raise ValueError(f"all orders of {m} filters; {MOST_FILTERS} at most")
    sums = ["n", *lost]
    alive = survivors(counts, filters, sums)
    before = alive.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_b") for c in sums], F.explode(F.array(*[F.lit(i) for i in range(m)])).alias("f"))
    before = before.where(F.expr("(before >> f) & 1 = 0")).withColumn("after", F.expr("before | (1 << f)"))
    after = alive.select("part", F.col("subset").alias("after"), *sums)
    pairs = before.join(after, ["part", "after"]).select("part", "before", "f", F.col("n").alias("kept"), *[(F.col(f"{c}_b") - F.col(c)).alias(f"{c}_lost") for c in sums])
    orders_of = F.array(*[F.lit(math.factorial(s) * math.factorial(m - 1 - s)) for s in range(m)])[F.bit_count("before")]
    alone = F.col("before") == F.lit((1 << m) - 1) - F.expr("1 << f")
    whole = pairs.groupBy("part", "f").agg(F.max(F.when(F.col("before") == 0, F.col("n_lost"))).alias("fails"), F.max(F.when(alone, F.col("n_lost"))).alias("unique_fails"), F.sum(F.col("n_lost") * orders_of).alias("shapley"))
    steps = [("".join(filters[i] for i in o), s + 1, sum(1 << i for i in o[:s]), f) for o in permutations(range(m)) for s, f in enumerate(o)]
    listed = F.broadcast(counts.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, f int"))  # a row for each step of each order
    out = pairs.join(whole, ["part", "f"]).join(listed, ["before", "f"])
    return out.select("part", "filter_order", "step", "kept", F.col("n_lost").alias("removed"), (F.col("fails") - F.col("n_lost")).alias("redundant"), "unique_fails", *[F.col(f"{c}_lost").alias(name) for c, name in lost.items()], "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents, by part."""
    return audit(flagged(docs, labels), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
