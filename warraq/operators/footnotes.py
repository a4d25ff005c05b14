"""Repair of footnote references over the lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.shared import saved
from .ranges import Ranges, ranged

ARABIC_NUMERALS = "٠١٢٣٤٥٦٧٨٩"
#: What text recognition takes the digits 1, 9, 0, 5 and 7 for.
CONFUSED, MEANT = "19.OV", "١٩٠٥٧"


def has_invalid_footnotes(col: Column | str) -> Column:
    """Whether a text has an empty reference or one of confused characters."""
    return P.text(col).rlike(P.INVALID_REFERENCE)


def to_number(reference: Column) -> Column:
    """The number of a reference such as (١٢); 0 if it is none."""
    digits = F.translate(F.regexp_replace(reference, "[()]", ""), ARABIC_NUMERALS, "0123456789")
    return F.coalesce(F.try_to_number(digits, F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint"))


def to_reference(number: Column) -> Column:
    """A number as a reference in Arabic-Indic digits."""
    return F.concat(F.lit("("), F.translate(number.cast("string"), "0123456789", ARABIC_NUMERALS), F.lit(")"))


def _pieces(x: Column, pattern: str) -> tuple[Column, Column]:
    return F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def convert_confused(x: Column, pattern: str = P.OCR_REFERENCE) -> Column:
    """Confused characters become digits inside their references, those that match ``pattern``."""
    gaps, found = _pieces(x, pattern)
    meant = F.transform(found, lambda r: F.translate(r, CONFUSED, MEANT))
    return F.array_join(F.flatten(F.zip_with(gaps, meant, lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), "")


def references(x: Column, is_footnote: Column) -> Column:
    """All references of a body line, or the one that begins a footnote line."""
    leading = F.regexp_extract(x, f"^{P.REFERENCE}", 0)
    return F.when(is_footnote, F.filter(F.array(leading), lambda r: r != "")).otherwise(F.regexp_extract_all(x, F.lit(P.REFERENCE), F.lit(0)))


def needs_correction(lines: DataFrame, doc_col: str = "doc_id", text_col: str = "text", footnote_col: str = "is_footnote") -> DataFrame:
    """(doc_col, needed): whether a document has an invalid reference, or references on one side that the other lacks.

    References are reduced to distinct ones before they meet, so that a document's
    lines are never gathered.
    """
    x, note = P.text(F.col(f"`{text_col}`")), F.coalesce(F.col(f"`{footnote_col}`"), F.lit(False))
    found = lines.select(F.col(f"`{doc_col}`").alias("doc"), has_invalid_footnotes(x).cast("int").alias("bad"), note.alias("note"), F.explode_outer(references(convert_confused(x), note)).alias("ref"))
    sides = found.groupBy("doc", "ref").agg(F.max("bad").alias("bad"), F.min("note").alias("low"), F.max("note").alias("high"))
    lone = F.col("ref").isNotNull() & (F.col("low") == F.col("high"))
    return sides.groupBy("doc").agg((F.max(F.greatest(F.col("bad"), lone.cast("int"))) == 1).alias("needed")).select(F.col("doc").alias(doc_col), "needed")


def correct_references(lines: DataFrame, doc_col: str = "doc_id", line_col: str = "line_no", text_col: str = "text", footnote_col: str = "is_footnote") -> DataFrame:
    """``lines`` with ``text_col`` repaired; all other columns pass through.

    Empty references take, in order, the numbers that only the other side has, and
    then new numbers after the largest of the document. Documents that have neither
    an invalid reference nor one without its partner stay as they are.

    Both queues are tables: a reference has its place among those that its side
    lacks, an empty reference its number among those of its side, and they meet where
    these are equal. Places and numbers are running sums over ranges of lines, so that
    a document is on as many tasks as it has ranges. Lines of equal ``line_col`` stand
    in any order; null documents are one.
    """
    row, key = F.struct(*(F.col(f"`{c}`") for c in lines.columns)), F.col(f"`{doc_col}`")
    raw = P.text(F.col(f"`{text_col}`"))
    base = lines.select(row.alias("row"), F.coalesce(key.cast("string"), F.lit("")).alias("doc"), key.isNull().alias("nameless"), F.col(f"`{line_col}`").alias("line"), raw.alias("raw"), F.coalesce(F.col(f"`{footnote_col}`"), F.lit(False)).alias("note"))
    base = base.withColumn("clean", convert_confused(F.col("raw"))).withColumn("refs", references(F.col("clean"), F.col("note")))
    base = base.withColumn("gaps", F.split("clean", r"\(\)", -1)).withColumn("holes", (F.size("gaps") - 1).cast("bigint"))
    doc = ["doc", "nameless"]
    laid = ranged(base, doc, ["line"], "lines")

    each = laid.rows.select(*doc, "note", "line", F.posexplode("refs").alias("k", "ref")).groupBy(*doc, "ref", "note").agg(F.min(F.struct("line", "k")).alias("first"))
    sides = each.groupBy(*doc, "ref").agg(F.count("*").alias("sides"), F.first("note").alias("note"), F.first("first").alias("first"))
    sides = saved(sides, "references")
    # what only one side has waits for the empty references of the other
    lone = sides.where("sides = 1").select(*doc, (~F.col("note")).alias("note"), "ref", "first.line", "first.k")
    queue = ranged(lone, [*doc, "note"], ["line", "k"], "queues").along(sums={"place": F.lit(1)}).select(*doc, "note", "place", "ref")
    waiting = queue.groupBy(*doc).agg(F.sum((~F.col("note")).cast("bigint")).alias("for_body"), F.sum(F.col("note").cast("bigint")).alias("for_foot"))
    largest = sides.groupBy(*doc).agg(F.max(to_number(F.col("ref"))).alias("largest"))
    invalid = laid.rows.groupBy(*doc).agg(F.max(has_invalid_footnotes("raw").cast("int")).alias("invalid"))
    facts = invalid.join(waiting, doc, "left").join(largest, doc, "left").select(*doc, "invalid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("for_body", "for_foot", "largest")))

    own = F.col("holes")
    counted = laid.along(sums={"n": F.lit(1), "body_before": F.when(F.col("note"), 0).otherwise(own), "foot_before": F.when(F.col("note"), own).otherwise(0)}, facts=facts)
    counted = counted.withColumn("before", F.when(F.col("note"), F.col("foot_before")).otherwise(F.col("body_before"))).withColumn("size", F.when(F.col("note"), F.col("for_foot")).otherwise(F.col("for_body")))
    needed = (F.col("invalid") == 1) | (F.col("for_body") + F.col("for_foot") > 0)
    # empty references beyond their side's queue take new numbers, counted over both sides
    extra = F.greatest(F.lit(0), F.least(own, F.col("before") + own - F.col("size")))
    counted = counted.select(*doc, "n", "line", "part", "row", "note", "gaps", "holes", "before", "size", "largest", needed.alias("needed"), extra.alias("extra"))
    placed = Ranges(saved(counted, "counted"), tuple(doc), ("n",))
    placed = saved(placed.along(sums={"extra_before": F.col("extra")}), "placed")

    taken = F.col("size") - F.col("before")
    holes = placed.where("needed and holes > 0").select(*doc, "n", "note", F.explode(F.sequence(F.lit(0), F.col("holes").cast("int") - 1)).alias("k"), "before", "largest", "extra_before", taken.alias("taken"))
    holes = holes.withColumn("place", F.col("before") + F.col("k")).join(queue, [*doc, "note", "place"], "left")
    fresh = to_reference(F.col("largest") + F.col("extra_before") + 1 + F.col("k") - F.greatest(F.col("taken"), F.lit(0)))
    fills = holes.groupBy(*doc, "n").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("ref", fresh).alias("fill")))).alias("fills"))
    filled = placed.join(fills, [*doc, "n"], "left").withColumn("fills", F.coalesce(F.transform("fills", lambda f: f["fill"]), F.array().cast("array<string>")))
    repaired = F.array_join(F.flatten(F.zip_with("gaps", "fills", lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), "")
    new = F.when(F.col("needed"), repaired).otherwise(F.col("row").getField(text_col))
    return filled.select("row", new.alias("new")).select(*(F.col("new").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in lines.columns))
