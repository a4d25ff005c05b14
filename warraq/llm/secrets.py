"""Secret scans by corpus-wide ownership frequency.

Candidates are found by patterns with their spans (code points, end exclusive).
The hash of each candidate's value is counted over the distinct repositories and
owners that hold it: a value that many owners share is a copied example, one of
few owners looks live. DataFrame functions only: texts are read once, and only the
documents' candidates are shuffled.

Defined results: a null text is empty; null repositories and owners count as one
each; repeated rows (same id, repository and text) each get the same result; an
empty table gives an empty table; other columns of the table are ignored by
``scan`` and kept untouched by ``redact``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, join_hot, saved

#: Fixed values: (kind, pattern, a literal that every match holds or None, group with the secret, its least length).
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", None, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", "AKIA", 0, 16),
    ("hex", r"[0-9a-f]{32,}", None, 0, 32),
)
ADDED = (
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ", 0, 0),
    ("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36,}", "_", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", "-----BEGIN ", 0, 0),
)
#: Rows and spans of live secrets (some 50 bytes each) that are broadcast to the texts; beyond that the rows with candidates are shuffled.
SMALL = 500_000
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,hash:string>>"


def spans_of_kind(text: Column, rank: int, kind: str, pattern: str, literal: str | None, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of one kind: array of (start, rank, end, kind, hash of the secret).

    ``split`` gives what lies between matches; the lengths of both kinds of piece
    add up to the places of the matches.
    """
    quoted = F.lit(pattern)
    matches = F.regexp_extract_all(text, quoted, F.lit(0))
    secrets = F.regexp_extract_all(text, quoted, F.lit(group))
    gaps = F.split(text, pattern, -1)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.sha2(x["secret"], 256).alias("hash"))
        return F.struct(end.alias("at"), F.when(F.length(x["secret"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    zipped = F.zip_with(F.arrays_zip(matches.alias("match"), secrets.alias("secret")), F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(g.alias("gap"), m["match"].alias("match"), m["secret"].alias("secret")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(zipped, start, add, lambda acc: acc["found"])
    test = text.rlike(pattern) if literal is None else text.contains(literal) & text.rlike(pattern)
    return F.when(test, found).otherwise(F.array().cast(SPAN))


def all_spans(text: Column) -> Column:
    """The spans of all kinds, by start, then in the order of the kinds."""
    spans = F.array_sort(F.concat(*(spans_of_kind(text, k, *x) for k, x in enumerate(BASE + ADDED))))
    return F.when(hinted(text), spans).otherwise(F.array().cast(SPAN))


def hinted(text: Column) -> Column:
    """False only where ``text`` has no span of any kind: cheap tests, most of them of bytes.

    What assigns has a separator after the end of one of the names and before eight
    characters; of 32 hex digits in a row, 16 fill one of the text's blocks of 16.
    """
    assigned = (text.contains(":") | text.contains("=")) & text.rlike(r"[dtnyDTNY][\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}")
    tests = [text.contains(x[2]) & text.rlike(x[1]) if len(x[2]) == 1 else text.contains(x[2]) for x in BASE + ADDED if x[2] is not None]
    return functools.reduce(Column.__or__, [*tests, assigned, text.rlike(r"(?s)\A(?:.{16})*?[0-9a-f]{16}")])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str) -> DataFrame:
    """(doc_id, repository, owner, row_key, spans): one narrow pass over the texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{repository_col}`").alias("repository"), F.col(f"`{owner_col}`").alias("owner"), text.alias("text"))
    return rows.select("doc_id", "repository", "owner", F.xxhash64("doc_id", "repository", "owner", "text").alias("row_key"), all_spans(F.col("text")).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners, n_rows) of every candidate's value; pairs are summed before each shuffle."""
    held = F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"])))
    pairs = found.select(held.alias("hash"), F.xxhash64("repository").alias("r"), F.xxhash64("owner").alias("o"))
    pairs = pairs.groupBy("hash", "r", "o").agg(F.count("*").alias("c"))
    by_owner = pairs.groupBy("hash", "o").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    # a repository has one owner, so that pairs are repositories
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("c").alias("n_rows"))


def live_rows(found: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """(row_key, live): the hashes of each row's candidates that look live."""
    known = saved(ownership(found), "secret-owners")
    live = known.where((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)).select("hash")
    rows = found.select("row_key", F.explode("spans").alias("s")).select("row_key", F.col("s.hash").alias("hash"))
    # an example copied widely, or a secret that one owner holds in many rows, comes into no task by itself
    rows = join_hot(rows, live, "hash", "left_semi", known.where(F.col("n_rows") > HOT).select("hash"))
    return rows.groupBy("row_key").agg(F.collect_set("hash").alias("live"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "source",
    owner_col: str = "source",
    max_owners: int = 2,
    max_repositories: int = 4,
) -> DataFrame:
    """(doc_id, spans, live): all spans of each row, and those that look live, as arrays of (start, rank, end, kind, hash)."""
    found = saved(candidates(docs, id_col, text_col, repository_col, owner_col), "secret-spans")
    some = found.where(F.size("spans") > 0)
    rows = some.join(live_rows(some, max_owners, max_repositories), "row_key", "left")
    held = F.filter("spans", lambda s: F.array_contains(F.coalesce(F.col("live"), F.array().cast("array<string>")), s["hash"]))
    # rows without a candidate stay where they are
    return rows.select("doc_id", "spans", held.alias("live")).unionByName(found.where(F.size("spans") == 0).select("doc_id", "spans", F.col("spans").alias("live")))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span (by start; they may overlap) replaced by [SECRET]."""

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("[SECRET]"))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "source",
    owner_col: str = "source",
    chars_col: str | None = "n_chars",
    max_owners: int = 2,
    max_repositories: int = 4,
) -> DataFrame:
    """``docs`` with live-looking secrets replaced by [SECRET]; ``chars_col``, if it is there, counts the new text's code points.

    Verdicts are broadcast to the texts; if they are too many, rows that may have a
    candidate meet them by a shuffle, and the others stay where they are.
    """
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = saved(candidates(docs, id_col, text_col, repository_col, owner_col).where(F.size("spans") > 0), "secret-spans")
    verdicts = found.select("row_key", "spans").dropDuplicates(["row_key"]).join(live_rows(found, max_owners, max_repositories), "row_key")
    live = F.transform(F.filter("spans", lambda s: F.array_contains("live", s["hash"])), lambda s: F.struct(s["start"], s["end"]))
    verdicts = saved(verdicts.select("row_key", live.alias("live")).where(F.size("live") > 0), "secret-verdicts")
    size = verdicts.agg(F.sum(1 + F.size("live"))).first()[0] or 0
    row = F.col("row")
    key = F.xxhash64(row.getField(id_col), row.getField(repository_col), row.getField(owner_col), text)
    new = F.when(F.size("live") > 0, redacted(text, F.col("live"))).otherwise(row.getField(text_col))
    changed = row.withField(f"`{text_col}`", new)
    if chars_col in docs.columns:
        n = F.when(F.size("live") > 0, F.length(new)).otherwise(row.getField(chars_col))
        changed = changed.withField(f"`{chars_col}`", n.cast(docs.schema[chars_col].dataType))
    small = size <= SMALL
    some = whole if small else whole.where(hinted(text))
    met = some.withColumn("row_key", key).join(F.broadcast(verdicts) if small else verdicts, "row_key", "left").select(changed.alias("row"))
    return (met if small else met.unionByName(whole.where(~hinted(text)))).select("row.*")
