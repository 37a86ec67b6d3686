"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Three patterns give the base spans of a text. The value of each match is hashed, and over the whole corpus every
hash is counted by distinct repositories (documents) and owners (sources): a value that many owners carry is a
copied example, one that a single owner carries and that looks random is a live credential, and its value gets a
span of its own of kind `live`.

`redact` masks more than the live ones: all values of few owners, relative to the number of owners.

Positions are code points. Spark's functions give the matches of a pattern and the pieces between them; running
lengths of both give the positions.

Defined results: NULL is an empty text, without spans; a NULL source counts as one owner; repeated rows are
separate rows of the result, but one repository; an empty table gives an empty result; only doc_id, text and source
are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.tables import columns, cut_lineage

# The base patterns. Runs too short to count are never tried where the result is the same; a value of
# `assign` must be matched whole before it may be dropped, because the text it covers is not searched again.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "live")

# The next three judge the `live` spans of op9, as its SQL defines them. `redact` does not use them.
#: A value that more owners than this carry is a copied example.
LIVE_OWNERS = 1
#: A value found in more repositories than this is a copied example too.
LIVE_REPOSITORIES = 20
#: A live-looking value has at least so many distinct characters, and a digit.
LIVE_CHARACTERS = 6
#: For masking, a value is a copied example only if more owners than this and more than this share of all carry it.
FEW_OWNERS, FEW_SHARE = 2, 0.05

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value_start:bigint,value:string>>"


def _spans(text: Column, pattern: str, kind: int, head: str | None = None) -> Column:
    """Matches of a pattern with their positions; the value is what follows `head`, or all of the match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin, match = acc["at"] + F.length(pair["gap"]), pair["match"]
        value = F.regexp_replace(match, head, "") if head else match
        end = begin + F.length(match)
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (end - F.length(value)).alias("value_start"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span).cast(_SPAN)).alias("out"))

    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans of a text, ordered by start and kind."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, 0, ASSIGN_HEAD), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return F.sort_array(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, source, found (base spans). Stored, with a row number for joining back."""
    rows = columns(docs, doc_id="bigint", text="string", source="string").select("doc_id", "source", base_spans(F.col("text")).alias("found"))
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct repositories and owners, and whether it is live. Reads doc_id, source, hash, value.

    Counts go through (hash, repository) and (hash, owner) sums that combine before the shuffle, so a value that a
    third of all rows carry reaches a task as one row per repository at most.
    """
    by_owner = found.groupBy("hash", "source").agg(F.first("value").alias("value")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.first("value").alias("value"))
    by_repository = found.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    varied = F.size(F.array_distinct(F.split("value", ""))) >= LIVE_CHARACTERS
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES) & varied & F.col("value").rlike("[0-9]")
    return by_owner.join(by_repository, "hash").select("hash", "repositories", "owners", live.alias("live"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, and spans (start, kind, end, value_start, value, repositories, owners, live)."""
    rows = scan(docs)
    digest = F.sha2(F.col("s.value"), 256)
    found = rows.where(F.size("found") > 0).select("row", "doc_id", "source", F.explode("found").alias("s")).select("row", "doc_id", "source", "s", digest.alias("hash"), F.col("s.value").alias("value"))
    judged = found.select("row", "doc_id", "s", "hash").join(ownership(found), "hash")
    span = F.struct("s.start", "s.kind", "s.end", "s.value_start", "s.value", "repositories", "owners", "live")
    with_spans = judged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans"))
    kind = with_spans.schema["spans"].dataType
    without = rows.where(F.size("found") == 0).select("row", "doc_id", F.array().cast(kind).alias("spans"))
    return with_spans.unionByName(without)


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts per kind, the hash of the base spans, and all spans as text."""
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["value_start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    base = F.sort_array(F.transform("spans", bare))
    every = F.sort_array(F.concat(base, F.array_distinct(live)))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(every, text)).alias("spans"),
        F.size(live).cast("bigint").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("bigint").alias("n_example"),
    )


def _masked(text: Column, ranges: Column, mark: str) -> Column:
    """A text with `mark` in place of ranges of code points (start, end); ranges that overlap are one."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def join(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))).cast(kind))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > r["start"]), longer).otherwise(F.concat(done, F.array(r).cast(kind)))

    merged = F.aggregate(F.sort_array(ranges), F.array().cast(kind), join)
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda r: r["end"]))
    starts = F.concat(F.transform(merged, lambda r: r["start"]), F.array(F.length(text).cast("bigint")))
    return F.array_join(F.zip_with(ends, starts, lambda e, s: F.substring(text, (e + 1).cast("int"), (s - e).cast("int"))), mark)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with the values of credentials of few owners replaced by `mark`; all other columns as they are, n_chars updated.

    Copied examples stay in the text: values spread over more than FEW_OWNERS owners and FEW_SHARE of all owners. How
    often an owner repeats a value and how it is spelled do not matter. The spread is taken over the whole corpus and
    joined back by document; a text is only rebuilt where it holds such a value.
    """
    found = find_secrets(docs)
    owners = columns(docs, source="string").select("source").distinct().count()
    few = F.col("s.owners") <= F.lit(max(FEW_OWNERS, FEW_SHARE * owners))
    hits = found.select("doc_id", F.explode("spans").alias("s")).where(few).select("doc_id", "s.value").distinct()
    hits = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("value"), asc=False).alias("secret_values"))
    joined = docs.alias("d").join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")), "left")
    # The scan of a text gives the same spans again; those with such a value are masked, and nothing else of the text.
    hit = F.filter(base_spans(F.col("d.text")), lambda s: F.array_contains("h.secret_values", s["value"]))
    replaced = _masked(F.col("d.text"), F.transform(hit, lambda s: F.struct(s["value_start"].alias("start"), s["end"].alias("end"))), mark)
    text = F.when(F.col("h.secret_values").isNotNull(), replaced).otherwise(F.col("d.text"))
    out = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in docs.columns else {})
    return joined.select(*(out[c].alias(c) if c in out else F.col(f"d.{c}") for c in docs.columns))
