"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own, a row: all turns before it are its context, and only its reply is
trainable. An example's context is the slice [0, context_chars) of its conversation's formatted text, its target the slice
[context_chars, context_chars + loss_chars). The formatted text is written once, a piece for each turn, so a conversation
of n turns takes n pieces and its examples and not n * n / 2; materialise() writes whole contexts out where that is wanted.

A turn is written as <|role|>role<|text|>text<|end|> and a newline. In roles and texts, & becomes &amp;, < becomes &lt; and
[ becomes &#91;, so no control string of this or another template is left in them, and unescaping gives the text again.

Turns are in order of turn (nulls first), role and text. Null texts and roles count as empty; a null conversation id is one
conversation. A conversation without assistant turns has no example. Repeated rows are turns of their own. Other columns of the
turns are not read. One conversation is read by one task in order, a turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import column, slices

#: Fixed values of the template.
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>\n"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
TRAINED = "assistant"


def escape(c: Column) -> Column:
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(s: str) -> str:
    for plain, written in reversed(ESCAPES):
        s = s.replace(written, plain)
    return s


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pieces and examples. A piece: conv, place (0, 1, ...), piece (the formatted turn), at (where it starts). An example, at the place of its reply: conv, place, example (0, 1, ...), context_turns, context_chars, loss_chars."""
    rows = turns.select(column(conv).alias("conv"), column(turn).alias("turn"), F.coalesce(column(role).cast("string"), F.lit("")).alias("role"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    head, body = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT)), escape(F.col("text"))
    rows = rows.withColumn("head", F.length(head).cast("long")).withColumn("body", F.length(body).cast("long")).withColumn("piece", F.concat(head, body, F.lit(END)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reply = F.col("role") == TRAINED
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long"))
    rows = rows.withColumn("example", F.coalesce(F.sum(reply.cast("int")).over(before), F.lit(0)).cast("int"))
    none = F.lit(None)
    piece = F.struct(none.cast("int").alias("example"), F.col("piece"), F.col("at"), none.cast("int").alias("context_turns"), none.cast("long").alias("context_chars"), none.cast("long").alias("loss_chars"))
    example = F.struct("example", none.cast("string").alias("piece"), none.cast("long").alias("at"), F.col("place").alias("context_turns"), (F.col("at") + F.col("head")).alias("context_chars"), F.col("body").alias("loss_chars"))
    return rows.select("conv", "place", F.explode(F.when(reply, F.array(piece, example)).otherwise(F.array(piece))).alias("x")).select(F.col("conv").alias(conv), "place", "x.*")


def materialise(expanded: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, example, context, target: the examples written out. Its output grows with the square of a conversation's length."""
    so_far = Window.partitionBy(column(conv)).orderBy("place", F.col("example").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = expanded.withColumn("all", F.array_join(F.collect_list("piece").over(so_far), "")).where(F.col("example").isNotNull())
    return joined.select(column(conv), "example", F.substring("all", F.lit(1), F.col("context_chars").cast("int")).alias("context"), F.substring("all", (F.col("context_chars") + 1).cast("int"), F.col("loss_chars").cast("int")).alias("target"))


READ = re.compile(re.escape(ROLE) + r"([^<]*)" + re.escape(TEXT) + r"([^<]*)" + re.escape(END))


def read_back(expanded: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples: turns parsed from the pieces, replies read through each example's own slice and mask.

    A conversation passes through one task in order; the task holds one slice of rows, the last piece and running digests.
    """
    kind = expanded.schema[conv].dataType
    rows = expanded.select(column(conv).alias("conv"), "piece", "at", "example", "context_turns", "context_chars", "loss_chars", "place")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "place", F.col("example").isNotNull())
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([pa.field(conv, to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, state, last, start = object(), None, "", 0

        def closed() -> list:
            n, turns, loss, hashed, chars, examples = state
            return [this, n, turns.hexdigest(), loss, hashed.hexdigest(), chars, examples]

        for batch in slices(batches):
            done = []
            for name, piece, at, example, turns, context, size in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if state is None or name != this:
                    if state is not None:
                        done.append(closed())
                    this, state = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if example is None:
                    found = READ.fullmatch(piece)
                    if not found or at != state[4]:
                        raise ValueError(f"conversation {name}: a piece can't be read back")
                    state[0] += 1
                    state[1].update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode("utf-8", "surrogatepass"))
                    state[4] += len(piece)
                    last, start = piece, at
                else:
                    head = last[: context - start]
                    if example != state[5] or turns != state[0] - 1 or head != f"{ROLE}{TRAINED}{TEXT}":
                        raise ValueError(f"conversation {name}: an example doesn't end at its reply")
                    target = unescape(last[context - start : context - start + size])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
                    state[5] += 1
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)), schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, [[x] for x in closed()], strict=True)), schema=schema)

    return ordered.mapInArrow(run, f"`{conv}` {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint")
