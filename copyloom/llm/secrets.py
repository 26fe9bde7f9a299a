r"""Secret scans with linked credential parts, in DataFrame functions only.

Patterns are matched leftmost and without overlaps, each on its own. Places come from splitting a text at the matches of a
pattern: the lengths of gaps and matches, summed up, are the starts and ends. The sums run over exploded rows, so that
their cost is linear in the number of matches. The rows of a document that has none never leave the scan.

Base findings, always reported: `assign` (a value of 12 or more characters given to a secret's name), `access` (key ids of
18 or more characters), `hex` (16 or more digits).

Weak candidates are reported only when a complementary part is in scope, that is at most `SCOPE` characters away:
  `weak`     a value of 6 to 11 characters given to a secret's name, with an identifier or an endpoint in scope;
  `ident`    a user, account or client name given by assignment, with a secret (assign, hex or weak) in scope;
  `endpoint` an address with a scheme, with a secret in scope.
Identifiers are access and ident. The join of intervals takes two running values over a document's spans in order: the
furthest end so far and the next start to come, for each kind of part. No pairs are formed.

Nulls and edge cases: a null or empty text has no spans; repeated rows and null ids are kept apart by a row number;
overlapping spans of different kinds are all reported; an empty table gives an empty result; further columns pass through
`redact` and are ignored by `scan`. A document's spans must fit in a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyloom.session import cut

# Patterns, with the groups around what is found and its value. Fixed values.
QUOTE = "[\"']?"
GIVEN = QUOTE + r"\x20*[:=]\x20*" + QUOTE
PATTERNS = {
    "assign": "((?i:password|passwd|secret|token|api_?key)" + GIVEN + "([A-Za-z0-9+/_.=-]+))",
    "access": "(AKIA([A-Z0-9]{14,}))",
    "hex": "(([0-9a-f]{16,}))",
    "ident": "((?i:user(?:name)?|login|account|client_?id|key_?id)" + GIVEN + "([A-Za-z0-9_.@-]{3,}))",
    "endpoint": r"((?:https?|wss?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://([A-Za-z0-9._~:/?#@!$&()*+,;=%\[\]-]+))",
}
KINDS = ("assign", "access", "hex", "weak", "ident", "endpoint")
MIN_SECRET = 12
MIN_WEAK = 6
SCOPE = 200
MASK = "[REDACTED]"


def _matches(kind: str, pattern: str) -> Column:
    """array<struct<kind, i, gap, len, value>>: for each match the characters before it since the last one, its own, and
    those of its value."""
    text = F.col("text")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length)
    item = lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), x["0"].alias("gap"), x["1"].alias("len"), x["2"].alias("value")
    )
    found = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("0"), whole.alias("1"), value.alias("2")), item)
    return F.when(text.rlike(pattern), found)


def _scanned(docs: DataFrame) -> DataFrame:
    """`docs` with `found`, all matches of all patterns or null, and a row number; written once, so the numbers stay."""
    nothing = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,value:int>>")
    found = F.concat(*(F.coalesce(_matches(k, p), nothing) for k, p in PATTERNS.items()))
    rows = docs.withColumn("found", found).withColumn("row_number", F.monotonically_increasing_id())
    return cut(rows.withColumn("found", F.when(F.size("found") > 0, F.col("found"))))


def _candidates(scanned: DataFrame) -> DataFrame:
    """row_number, kind, start, stop of all matches that count as base findings or weak candidates."""
    rows = scanned.where("found is not null").select("row_number", "found").repartition("row_number")
    rows = rows.select("row_number", F.inline("found"))
    along = W.partitionBy("row_number", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(along)).withColumn("start", F.col("stop") - F.col("len"))
    kind = F.when((F.col("kind") == "assign") & (F.col("value") < MIN_SECRET), F.lit("weak")).otherwise(F.col("kind"))
    rows = rows.where((F.col("kind") != "assign") | (F.col("value") >= MIN_WEAK))
    return rows.select("row_number", kind.alias("kind"), "start", "stop")


def _linked(candidates: DataFrame, scope: int) -> DataFrame:
    """Base findings, and weak candidates with a complementary part in scope."""
    order = W.partitionBy("row_number").orderBy("start", "stop", "kind")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)

    def in_scope(*kinds: str) -> Column:
        part = F.col("kind").isin(*kinds)
        furthest = F.max(F.when(part, F.col("stop"))).over(before)
        coming = F.min(F.when(part, F.col("start"))).over(after)
        return F.coalesce(furthest >= F.col("start") - scope, F.lit(False)) | F.coalesce(coming <= F.col("stop") + scope, F.lit(False))

    rows = candidates.withColumns(
        {
            "identified": in_scope("access", "ident"),
            "secret": in_scope("assign", "hex", "weak"),
            "addressed": in_scope("endpoint"),
        }
    )
    keep = (
        F.col("kind").isin("assign", "access", "hex")
        | ((F.col("kind") == "weak") & (F.col("identified") | F.col("addressed")))
        | (F.col("kind").isin("ident", "endpoint") & F.col("secret"))
    )
    return rows.where(keep).select("row_number", "kind", "start", "stop")


def _spans_of(scanned: DataFrame, scope: int) -> DataFrame:
    """row_number and spans: array<struct<start, kind_no, kind, stop>> in order of start and kind."""
    number = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    span = F.struct("start", number.alias("kind_no"), "kind", "stop")
    return _linked(_candidates(scanned), scope).groupBy("row_number").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document; spans are kind:start:stop, comma-joined."""
    scanned = _scanned(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    scanned = scanned.select("doc_id", "found", "row_number")
    rows = scanned.join(_spans_of(scanned, scope), "row_number", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_no:bigint,kind:string,stop:bigint>>"))
    rows = rows.select("doc_id", spans.alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] <= 3)
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """`docs` with every reported span replaced by `mask`, spans that overlap or touch by one; n_chars, if there, counts anew.

    Documents without candidates are passed on without a shuffle.
    """
    scanned = _scanned(docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = scanned.where("found is not null").select("row_number", "row", "text")
    spans = _linked(_candidates(scanned), scope)
    order = W.partitionBy("row_number").orderBy("start", "stop")
    so_far = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("run", F.sum(F.when(so_far >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("row_number", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    from_ = F.coalesce(F.lag("stop").over(W.partitionBy("row_number").orderBy("start")), F.lit(0))
    runs = runs.withColumn("from", from_).groupBy("row_number")
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("from", "start", "stop"))).alias("runs"))
    kept = F.transform("runs", lambda r: F.concat(F.substring("text", r["from"] + 1, r["start"] - r["from"]), F.lit(mask)))
    rest = F.substring("text", F.element_at("runs", -1)["stop"] + 1, F.length("text"))
    rows = rows.join(runs, "row_number", "left")
    rows = rows.withColumn("text", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), rest)))
    names = [c for c in docs.columns]
    changed = {"text": F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.col("text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    masked = rows.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))
    return scanned.where("found is null").select("row.*").unionByName(masked)
