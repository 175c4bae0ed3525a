"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Every text is matched against fixed patterns. The values found are candidates: their hashes are counted over distinct
repositories and owners of the whole corpus, first by (hash, owner, repository), then by (hash, owner), then by hash, so a
value that a third of the rows carry is aggregated before each shuffle. A candidate that looks live (no placeholder word; long,
of many different characters, letters and digits mixed, or an assigned value of enough entropy, or of a known prefix) and
belongs to few owners is live; one that more owners carry is a widely copied example. The live values add spans of kind
live to those of the patterns. Redaction counts owners over distinct contexts: a value between the same neighbours, on one
side at least, in many sources is one leak that was copied with its passage, and goes.

Null texts count as empty. A null owner or repository counts as one of its own. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import column, save, unused, with_row_id

#: Kind, pattern, group that holds the value, least length of the value.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("known", r"(?<![A-Za-z0-9_])(?:gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0, 12),
]
BASE = ("assign", "access", "hex")
RANK = {kind: i for i, kind in enumerate([*(p[0] for p in PATTERNS), "live"])}
#: Words that mark a placeholder.
PLACEHOLDERS = "(?i)example|sample|dummy|changeme|placeholder|your_|xxxx|12345678|00000000"
#: A value of more owners than this is a widely copied example.
MAX_OWNERS = 2
MIN_LIVE_LENGTH, MIN_DISTINCT_CHARS = 16, 8
#: Bits a character of an assigned value that looks random, letters only or shorter than MIN_LIVE_LENGTH as it may be.
MIN_ENTROPY = 3.0
#: Spans of one value that count as many, and values of which there can be so many.
HOT_SPANS, HOT_VALUES = 10_000, 1000
#: Code points on each side of a value that make its context.
CONTEXT = 32
#: Matches whose lengths are added up one by one; sums of so many are added up before them.
BLOCK = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string,value_start:int,value:string>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern in a text, as code points. Where a match starts follows from the lengths of the gaps and matches before it.

    Running lengths of all but the last step of BLOCK matches are added up once, so work grows as the matches, not their square.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    parts = F.arrays_zip(hits.alias("h"), values.alias("v"), F.slice(gaps, 1, F.size(hits)).alias("g"))
    sized = F.transform(parts, lambda x: F.struct((F.length(x["g"]) + F.length(x["h"])).alias("n"), F.length(x["h"]).alias("h"), x["v"].alias("v")))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x["n"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sized) - 1) / BLOCK).cast("int")), lambda i: F.slice(sized, i * BLOCK + 1, F.lit(BLOCK)))
    ahead = F.transform(blocks, add)

    def placed(block: Column, i: Column) -> Column:
        base = F.aggregate(F.slice(ahead, F.lit(1), i), F.lit(0), lambda acc, x: acc + x)

        def span(x: Column, j: Column) -> Column:
            end = base + add(F.slice(block, F.lit(1), j + 1))
            return F.struct((end - x["h"]).alias("start"), F.lit(RANK[kind]).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), (end - F.length(x["v"])).alias("value_start"), x["v"].alias("value"))

        return F.transform(block, span)

    found = F.filter(F.flatten(F.transform(blocks, placed)), lambda s: F.length(s["value"]) >= least)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _whole(text_col: str) -> Column:
    return F.coalesce(column(text_col).cast("string"), F.lit(""))


def find_spans(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs with an array of the patterns' spans, by start, then kind."""
    return docs.withColumn(into, F.array_sort(F.concat(*[_spans(_whole(text_col), *p) for p in PATTERNS])))


def entropy(value: Column) -> Column:
    """Bits a character, by the value's own counts."""
    n = F.length(value).cast("double")
    counts = F.transform(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double"))
    return F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + k * F.log2(k)) / n


def looks_live(value: Column, kind: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT_CHARS
    mixed = (F.length(value) >= MIN_LIVE_LENGTH) & varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return (mixed | (kind == "assign") & (entropy(value) >= MIN_ENTROPY) | kind.isin("access", "known") & varied) & ~value.rlike(PLACEHOLDERS)


def ownership(found: DataFrame) -> DataFrame:
    """found: hash, owner, repo. One row for each hash: n_owners, n_repos, n_seen."""
    repos = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_seen"))


def _contexts(each: DataFrame) -> DataFrame:
    """each: hash, left and right. One row for each hash: n_contexts, its distinct neighbours on the side that has fewer."""
    left, right = (each.groupBy("hash", side).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias(f"n_{side}")) for side in ("left", "right"))
    return left.join(right, "hash").select("hash", F.least("n_left", "n_right").alias("n_contexts"))


def _judged(rows: DataFrame, max_owners: int, contexts: bool = False) -> DataFrame:
    """rows: row, spans, owner, repo, saved; with contexts sides, for each span. Returns (row, judged) for rows that have spans; judged adds n_owners, n_repos and live.

    The counts of values that many spans hold, HOT_VALUES at most, are broadcast; those of the others are joined by a shuffle.
    """
    sides = F.col("sides") if contexts else F.transform("spans", lambda s: F.struct(F.lit(0).alias("left"), F.lit(0).alias("right")))
    each = rows.where(F.size("spans") > 0).select("row", "owner", "repo", F.explode(F.zip_with("spans", sides, lambda s, x: F.struct(s.alias("s"), x.alias("x")))).alias("e"))
    each = each.select("row", "owner", "repo", F.col("e.s").alias("s"), F.col("e.x.left").alias("left"), F.col("e.x.right").alias("right"), F.sha2(F.col("e.s.value"), 256).alias("hash"))
    counts = ownership(each.select("hash", "owner", "repo"))
    counts = counts.join(_contexts(each), "hash") if contexts else counts
    counts = save(counts, "ownership")
    few = F.least("n_owners", "n_contexts") if contexts else F.col("n_owners")
    live = (few <= max_owners) & looks_live(F.col("s.value"), F.col("s.kind"))
    seen = counts.agg(F.sum("n_seen")).first()[0] or 0
    hot = F.col("n_seen") > max(HOT_SPANS, seen // HOT_VALUES)  # so there are HOT_VALUES of them at most
    known = each.join(F.broadcast(counts.where(hot).select("hash", F.lit(True).alias("hot"))), "hash", "left")
    known = known.where("hot").drop("hot").join(F.broadcast(counts.where(hot)), "hash").unionByName(known.where("hot IS NULL").drop("hot").join(counts.where(~hot), "hash"))
    return known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.end", "s.kind", "s.value_start", "s.value", "n_owners", "n_repos", live.alias("live")))).alias("judged"))


def _owners(owner: Column | None, repo: Column | None) -> tuple[Column, Column]:
    owner = column("source") if owner is None else owner
    repo = F.struct(column("source"), column("lang")) if repo is None else repo
    return owner.cast("string").alias("owner"), repo.cast("string").alias("repo")


def scan(docs: DataFrame, text_col: str = "text", owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all but the text if not given) and secrets: an array of the spans with n_owners, n_repos and live.

    owner and repo are columns of docs; the source, and the source with the language, if not given. A column of keep may
    have any name but secrets. The spans that meet in one task are those of one text.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    spans = unused(docs, "spans")
    kept = F.struct(*[column(c) for c in keep]).alias("kept") if keep else F.lit(0).alias("kept")
    rows = with_row_id(find_spans(docs, text_col, spans).select(kept, F.col(spans).alias("spans"), *_owners(owner, repo)), "row")
    rows = save(rows, "spans")
    with_any = rows.where(F.size("spans") > 0).join(_judged(rows, max_owners), "row")
    out = [F.col("kept").getField(c).alias(c) for c in keep]
    with_any = with_any.select(*out, F.col("judged").alias("secrets"))
    kind = with_any.schema["secrets"].dataType.simpleString()
    return with_any.unionByName(rows.where(F.size("spans") == 0).select(*out, F.from_json(F.lit("[]"), kind).alias("secrets")))


def _merged(judged: Column) -> Column:
    """Value spans of live secrets, overlapping ones made one, by start."""
    values = F.array_sort(F.transform(F.filter(judged, lambda s: s["live"]), lambda s: F.struct(s["value_start"].alias("start"), s["end"].alias("end"))))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(values, none, step)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, mark: str = "[SECRET]") -> DataFrame:
    """docs with each live value replaced by mark, and length_col, if given, set anew; examples that many owners carry in different contexts and all other text stay.

    Rows in which no pattern matches pass as they are read, so docs must be the same when read again, as a saved table is.
    Only the others are saved and joined. Columns may have any names.
    """
    matching = reduce(lambda a, b: a | b, [F.regexp_like(_whole(text_col), F.lit(p[1])) for p in PATTERNS])
    spans = unused(docs, "spans")
    hits = find_spans(docs.where(matching), text_col, spans)
    found = hits.select(F.struct(*[column(c) for c in docs.columns]).alias("doc"), _whole(text_col).alias("text"), F.col(spans).alias("spans"), *_owners(owner, repo))
    found = save(with_row_id(found, "row"), "found")
    side = lambda start, end: F.xxhash64(F.trim(F.regexp_replace(F.lower(F.substring("text", start + 1, end - start)), r"\s+", " ")))
    sides = F.transform("spans", lambda s: F.struct(side(F.greatest(s["value_start"] - CONTEXT, F.lit(0)), s["value_start"]).alias("left"), side(s["end"], s["end"] + CONTEXT).alias("right")))
    judged = _judged(found.select("row", "spans", sides.alias("sides"), "owner", "repo"), max_owners, contexts=True)
    judged = judged.where(F.exists("judged", lambda s: s["live"]))
    hit = found.join(judged, "row", "left").withColumn("cuts", _merged("judged"))
    kept = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("cuts", lambda s: s["end"])), F.concat(F.transform("cuts", lambda s: s["start"]), F.array(F.length("text"))), lambda a, b: F.substring("text", a + 1, b - a))
    hit = hit.withColumn("clean", F.array_join(kept, mark))
    live = F.col("judged").isNotNull()
    new = {text_col: F.when(live, F.col("clean")).otherwise(F.col("doc").getField(text_col))}
    if length_col:
        new[length_col] = F.when(live, F.length("clean")).otherwise(F.col("doc").getField(length_col)).cast(docs.schema[length_col].dataType)
    hit = hit.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
    return docs.where(~matching).unionByName(hit)


def _is(kind: str):
    return lambda x: x["kind"] == kind


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, digests, and how many secrets are live or examples."""
    s = F.col("secrets")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    live = F.array_distinct(F.transform(F.filter(s, lambda x: x["live"]), lambda x: F.struct(x["value_start"].alias("start"), F.lit(RANK["live"]).alias("rank"), x["end"].alias("end"), F.lit("live").alias("kind"))))
    plain = F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    count = lambda test: F.size(F.filter(s, test)).cast("long")
    return scan(docs, keep=[id_col], **options).select(
        column(id_col), *[count(_is(k)).alias(f"n_{k}") for k in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.array_sort(F.concat(plain, live))).alias("spans"),
        F.size(live).cast("long").alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"), F.coalesce(F.array_max(F.transform(s, lambda x: x["n_owners"])), F.lit(0)).alias("max_owners"))
