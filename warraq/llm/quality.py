"""Quality rules as a ledger of bit masks.

``measure`` reads every text once and keeps its measurements; ``ledger`` evaluates
every rule once on them and stores the failures as bits of one number. A policy is
a version and a set of rules; applying it, or asking what each rule does within
it, is arithmetic on the bits and reads no text again.

Defined results: a null text has no words; repeated rows are judged each by
itself; an empty table gives an empty ledger; columns of the table other than the
two named are ignored by ``measure`` and kept untouched by ``keep_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SPACE, documents_view, lean

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_capitals")


def measurements(text: str) -> tuple[int, ...]:
    """The numbers named in MEASURES. Words are runs of other characters than the six of WORD_SPACE."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WORD_SPACE))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(WORD_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    covered = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            first: dict = {}
            twice = bytearray(len(windows))
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    twice[i] = twice[j] = 1
            end = 0
            for i, t in enumerate(twice):
                if t:
                    covered += i + 5 - max(i, end)
                    end = i + 5
    capitals = sum(1 for w in words if len(w) > 1 and w.isupper())
    return n, chars, sum(map(text.count, SYMBOLS)), dup, covered, lines, text.count("!!"), capitals


@dataclass(frozen=True)
class Rule:
    """A named condition under which a document fails, on the measurements; its place in the list is its bit."""

    name: str
    fails: Column


def default_rules() -> list[Rule]:
    """The rules, in the order of their bits: two base rules, then those of the method."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 10),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("repeated_lines", 2 * c("n_dup_lines") > c("n_lines")),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        Rule("capitals", 2 * c("n_capitals") > c("n_words")),
        Rule("shouting", 5 * c("n_shouts") > c("n_words")),
    ]


#: Versions of the policy: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals", "shouting"),
}


def mask(policy: str, rules: list[Rule] | None = None) -> int:
    """The bits of the rules of a policy."""
    bit = {r.name: 1 << k for k, r in enumerate(rules or default_rules())}
    return sum(bit[name] for name in POLICIES[policy])


def _measure(batches):
    for batch in batches:
        rows = list(zip(*map(measurements, batch.column(1).to_pylist()), strict=True)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in rows)], ["doc_id", *MEASURES])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the MEASURES), one row for each row."""
    texts = documents_view(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def failure_bits(rules: list[Rule]) -> Column:
    """One number with the bit of each rule that fails."""
    bits = F.lit(0).cast("bigint")
    for k, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the MEASURES, failure_bits)."""
    return measure(docs, id_col, text_col).withColumn("failure_bits", failure_bits(rules or default_rules()))


def passes(policy: str, rules: list[Rule] | None = None, bits: str = "failure_bits") -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col(bits).bitwiseAND(mask(policy, rules)) == 0


def ablation(entries: DataFrame, policy: str, rules: list[Rule] | None = None) -> DataFrame:
    """(rule, n_fail, n_fail_alone, n_kept_without): what each rule of a policy does, from the bits alone.

    The ledger is first summed by its distinct masks, of which there are few
    whatever its length; a policy without a rule is the mask without its bit.
    """
    rules = rules or default_rules()
    whole = mask(policy, rules)
    sums = entries.groupBy(F.col("failure_bits").bitwiseAND(whole).alias("bits")).agg(F.count("*").alias("n"))
    own = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("bigint").alias("bit")) for k, r in enumerate(rules) if r.name in POLICIES[policy]))
    each = sums.select("bits", "n", F.inline(own))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        count(F.col("bits") == F.col("bit")).alias("n_fail_alone"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def keep_documents(docs: DataFrame, policy: str = "v1", rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged whatever their names.

    Row and ledger entry stay together in one pass: the row is carried as a struct.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    entries = docs.select(whole, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([entries.schema["row"], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    @lean
    def run(batches):
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            values = list(zip(*map(measurements, batch.column(1).to_pylist()), strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in values)], ["row", *MEASURES])

    measured = entries.mapInArrow(run, schema)
    return measured.withColumn("failure_bits", failure_bits(rules or default_rules())).where(passes(policy, rules)).select("row.*")
