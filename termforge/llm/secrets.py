"""Secret scans with corpus-wide ownership frequency.

find_candidates() finds spans of credential-like strings in every whole text, kind by
kind, leftmost and non-overlapping. ownership() counts, for each candidate's hash, the
distinct repositories and owners that hold it: a value that several owners carry is a
copied example, one that a single owner has is taken for a live credential of theirs.
scan() joins that verdict back; redact() cuts the live ones out of the texts.

DataFrame functions only. Java's split gives the stretches between the matches that
regexp_extract_all gives, so positions (code points, end exclusive, and bytes beside
them) are running sums of lengths. These are made block by block, and a text is cut by
bytes, so that work grows with a text's length however many matches it holds. A hot value
is reduced to one row for each owner and repository before it is counted, and texts never
meet a shuffle in scan().

Null text is empty; null owners and repositories count as one unknown each. Repeated
rows give repeated results. An empty table gives no rows; other columns are ignored by
scan() and kept by redact(), whatever their names. redact() keeps null texts null, and
takes a table without source as one of unknown owners.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, stored

#: kind, pattern, its least length, the group that is measured, and words one of which every match holds.
#: The patterns of the first three kinds are fixed values; the others are added by this scan.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]+", 20, 0, ("akia",)),
    ("hex", r"[0-9a-f]{24,}", 24, 0, ()),  # the same matches as [0-9a-f]+ of 24 or more, without the short ones
    ("vcs", r"gh[pousr]_[A-Za-z0-9]+", 30, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0, ("eyj",)),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", 60, 0, ("private key",)),
    ("bearer", r"(?i)bearer\x20+([A-Za-z0-9+/_.=~-]+)", 20, 1, ("bearer",)),
)
BASE = ("assign", "access", "hex")
#: From so many distinct owners on, a value is a copied example.
COPIED_OWNERS = 3
SPAN = "array<struct<begin:int,order:int,kind:string,end:int,value:string,at:int,to:int>>"
#: Values whose running sums are made at once.
BLOCK = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each value what join makes of 0 and those before it, and of all at the end."""
    grow = lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))
    zero = F.lit(0)

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, join))
        starts = F.aggregate(sums, F.array(zero), grow)
        within = lambda starts: F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.element_at(starts, i + 1)), grow), 1, F.size(b)))
        return _let(starts, lambda starts: F.concat(F.flatten(within(starts)), F.array(F.element_at(starts, -1))))

    return _let(values, lambda v: _let(F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda i: F.slice(v, i, BLOCK))).otherwise(F.array().cast("array<array<int>>")), of_blocks))


def _kind_spans(text: Column, order: int, kind: str, pattern: str, least: int, group: int) -> Column:
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"))

    def spans(pairs: Column) -> Column:
        # Running sums of gaps and matches in turn: each match's begin and end.
        sums = lambda measure: _running(F.flatten(F.transform(pairs, lambda x: F.array(measure(x["gap"]), F.coalesce(measure(x["whole"]), F.lit(0))))), lambda a, b: a + b)
        place = F.struct(sums(F.length).alias("chars"), sums(F.octet_length).alias("bytes"))

        def span(place: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                # The match alone has the same groups: the patterns don't look around.
                value = F.regexp_extract(x["whole"], pattern, group) if group else x["whole"]
                chars, bytes_ = place["chars"], place["bytes"]
                at = 2 * i + 2
                return F.struct(F.element_at(chars, at).alias("begin"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), F.element_at(chars, at + 1).alias("end"), value.alias("value"), F.element_at(bytes_, at).alias("at"), F.element_at(bytes_, at + 1).alias("to"))

            return F.filter(F.transform(pairs, one), lambda s: F.length(s["value"]) >= least)

        return _let(place, span)

    return _let(pairs, spans).cast(SPAN)


def candidate_spans(text: Column) -> Column:
    """All kinds' spans of a text, ordered by begin and kind. A kind whose words the text
    doesn't hold isn't searched."""
    lower = F.lower(text)
    found = []
    for order, (kind, pattern, least, group, words) in enumerate(KINDS):
        spans = _kind_spans(text, order, kind, pattern, least, group)
        holds = reduce(lambda a, b: a | b, [lower.contains(w) for w in words]) if words else text.rlike(pattern)
        found.append(F.when(holds, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*found))


def find_candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, repository, owner, spans: a row a document; the texts are read here, once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), candidate_spans(text).alias("spans"))


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """hash, repositories, owners, copied: a row for each distinct candidate value."""
    each = found.select("repository", "owner", F.explode("spans.value").alias("value")).select("repository", "owner", F.sha2(F.col("value").cast("binary"), 256).alias("hash")).distinct()
    per_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    # A repository of several owners counts once for each of them.
    return per_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners")).withColumn("copied", F.col("owners") >= copied_owners)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def verdicts(found: DataFrame) -> DataFrame:
    """_row, live, copied, holders: for each row with candidates, the live spans, the number
    of copied ones, and the most owners that any of its values has."""
    each = found.where(F.size("spans") > 0).select("_row", F.explode("spans").alias("span")).withColumn("hash", F.sha2(F.col("span.value").cast("binary"), 256))
    # A table of its own, so that the join meets plain shuffles, of which Spark splits a hot value's.
    known = each.join(stored(few(ownership(found)), "secrets-owners"), "hash")
    live = F.array_sort(F.collect_list(F.when(~F.col("copied"), F.struct("span.at", "span.to"))))
    return known.groupBy("_row").agg(live.alias("live"), F.sum(F.col("copied").cast("long")).alias("n_copied"), F.max("owners").alias("most_owners"))


def _numbered(docs: DataFrame) -> DataFrame:
    """Stored once, so that the row numbers hold and the texts aren't searched again."""
    return stored(find_candidates(docs).withColumn("_row", F.monotonically_increasing_id()), "secrets")


def scan(docs: DataFrame) -> DataFrame:
    """A row a document: counts and spans of all kinds, and how many values are live or copied."""
    found = _numbered(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    known = verdicts(found).withColumnRenamed("_row", "_of")
    return found.join(known, F.col("_row") == F.col("_of"), "left").select(
        "doc_id",
        *[count(kind) for kind in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
    )


def _cut(text: Column, live: Column, mark: str) -> Column:
    """The text without the live spans (at, to: bytes, ascending), each replaced by a mark;
    overlapping spans are replaced as one."""

    def pieces(raw: Column, done: Column) -> Column:
        # done: how far the spans before each one reach.
        def piece(s: Column, i: Column) -> Column:
            before = F.element_at(done, i + 1)
            return F.when(s["at"] >= before, F.concat(F.substring(raw, before + 1, s["at"] - before).cast("string"), F.lit(mark))).otherwise(F.lit(""))

        end = F.element_at(done, -1)
        return F.concat(F.array_join(F.transform(live, piece), ""), F.substring(raw, end + 1, F.octet_length(raw) - end).cast("string"))

    done = _running(F.transform(live, lambda s: s["to"]), lambda a, b: F.greatest(a, b))
    return _let(text.cast("binary"), lambda raw: _let(done, lambda done: pieces(raw, done)))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the live credentials cut out of text (and n_chars, if there, made to fit).

    Only documents that hold candidates go through the join; the rest pass as they are.
    """
    own = F.struct(*docs.columns).alias("doc")
    marked = docs.select(own, candidate_spans(F.coalesce(F.col("text"), F.lit(""))).alias("spans"))
    clean = marked.where(F.size("spans") == 0).select("doc.*")
    held = stored(marked.where(F.size("spans") > 0).withColumn("_row", F.monotonically_increasing_id()), "secrets-held")
    owner = F.col("doc.source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    found = held.select("_row", F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")).alias("repository"), F.coalesce(owner, F.lit("")).alias("owner"), "spans")
    known = verdicts(found).select(F.col("_row").alias("_of"), "live")
    cut = F.when(F.size("live") > 0, _cut(F.col("doc.text"), F.col("live"), mark)).otherwise(F.col("doc.text"))
    joined = held.join(known, F.col("_row") == F.col("_of"), "left").select("doc", cut.alias("cut"))
    put = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return clean.unionByName(joined.select(*[put[c].cast(docs.schema[c].dataType).alias(c) if c in put else F.col(f"doc.{c}") for c in docs.columns]))


def _sql() -> str:
    """The same scan for DuckDB: spans from split and extracted matches, kind by kind."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, owner, {order} AS ord, '{kind}' AS kind, {least} AS least, regexp_split_to_array(x, {quoted(pattern)}) AS g, "
        f"regexp_extract_all(x, {quoted(pattern)}, 0) AS w, regexp_extract_all(x, {quoted(pattern)}, {group}) AS p FROM t WHERE regexp_matches(x, {quoted(pattern)})"
        for order, (kind, pattern, least, group, _) in enumerate(KINDS)
    )
    count = ", ".join(f"coalesce(CAST(count(*) FILTER (WHERE kind = '{kind}') AS BIGINT), 0) AS n_{kind}" for kind in BASE)
    base = ", ".join(f"'{kind}'" for kind in BASE)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS x FROM documents),
m AS ({kinds}),
placed AS (SELECT *, unnest(range(len(w))) AS i FROM m),
s AS (SELECT doc_id, owner, ord, kind, w[i + 1] AS whole, p[i + 1] AS value,
        CAST(list_sum(list_transform(g[1:i + 1], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:i], lambda y: length(y))), 0) AS BIGINT) AS b
      FROM placed WHERE length(p[i + 1]) >= least),
o AS (SELECT value, count(DISTINCT owner) AS owners FROM s GROUP BY value),
d AS (SELECT doc_id, {count},
        coalesce(string_agg(kind || ':' || b || ':' || (b + length(whole)), ',' ORDER BY b, ord) FILTER (WHERE kind IN ({base})), '') AS told,
        string_agg(kind || ':' || b || ':' || (b + length(whole)), ',' ORDER BY b, ord) AS spans,
        count(*) FILTER (WHERE owners < {COPIED_OWNERS}) AS n_live, count(*) FILTER (WHERE owners >= {COPIED_OWNERS}) AS n_copied, max(owners) AS most_owners
      FROM s JOIN o USING (value) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(told, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners
FROM documents LEFT JOIN d USING (doc_id)
"""


SQL = _sql()
