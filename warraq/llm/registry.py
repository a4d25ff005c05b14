"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .urls import BLOCKED_WORDS

#: Files of public tokenizers; a deployment can point the operators elsewhere.
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_50K = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN, digests=True)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), BPE_50K)


#: The rules of the contract.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import UrlRule, judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), [UrlRule(*r) for r in URL_RULES])


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_path
    from .rans import read_token_files, write_token_files

    out = shared_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), out, BPE_50K)
    return read_token_files(spark, out, digests=True)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, joined, scan

    found = scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    # by a function of the span alone: a second parameter would be its index
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of_kind(x[0]).alias(f"n_{x[0]}") for x in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), joined(F.col("live")).alias("live_spans"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, num=9, den=10).drop("row_key")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import ledger, mask, passes

    entries = ledger(_table(spark, sf_dir, "documents"))
    base = F.col("failure_bits").bitwiseAND(mask("base")) != 0
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return entries.select("doc_id", *measured, base.alias("base_failed"), passes("v1").alias("kept"), "failure_bits")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeat_digests

    return repeat_digests(_table(spark, sf_dir, "documents")).drop("spans")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked_documents

    return ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import fill_in_middle, restored

    out = fill_in_middle(_table(spark, sf_dir, "documents"), rate=90, spm=20, seed=1)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_packing": op2_packing,
    "op3_url_filters": op3_url_filters,
    "op4_media_columns": op4_media_columns,
    "op5_token_files": op5_token_files,
    "op6_secret_scans": op6_secret_scans,
    "op7_html_text": op7_html_text,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_repeats": op10_repeats,
    "op11_ranked_search": op11_ranked_search,
    "op12_near_vectors": op12_near_vectors,
    "op13_fill_in_middle": op13_fill_in_middle,
}
URL_SQL = f"""with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p),
r(action, rule) as (values {", ".join(map(repr, URL_RULES))}),
m as (select page_id, max(struct_pack(n := length(rule), rule := rule, action := action)) as best from h join r
 on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, instr(rule, '/'))) group by page_id)
select page_id, host, path, best.rule as rule, coalesce(best.action, case when regexp_matches(host || path, '(?i)(^|[^A-Za-z0-9])({"|".join(BLOCKED_WORDS)})($|[^A-Za-z0-9])') then 'block' else 'allow' end) as verdict
from h left join m using (page_id)"""

QUALITY_SQL = r"""with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as dup from (select doc_id, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
g as (select doc_id, i, array_to_string(ws[i : i + 4], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) > 4)),
c as (select doc_id, count(distinct i + j) as covered from (select doc_id, i from g qualify count(*) over (partition by doc_id, k) > 1), range(5) r(j) group by doc_id),
m as (select doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
 coalesce(dup, 0) as n_dup_lines, coalesce(covered, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, (length(t) - length(replace(t, '!!', ''))) // 2 as shouts,
 len(list_filter(ws, lambda x: strlen(x) > 1 and regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*$'))) as capitals from w left join l using (doc_id) left join c using (doc_id)),
b as (select *, (n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (10 * n_symbols > n_words)::int + 8 * (2 * n_dup_lines > n_lines)::int
 + 16 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::int + 32 * (2 * capitals > n_words)::int + 64 * (5 * shouts > n_words)::int as failure_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 as base_failed, failure_bits = 0 as kept, failure_bits::bigint as failure_bits from b"""

MIDDLE_SQL = """with t as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select doc_id, t, u, len(u) as n, [('0x' || substr(h, 8 * k + 1, 8))::bigint for k in range(4)] as h from t),
c as (select doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
 case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1 : a], '') as pre, array_to_string(u[a + 1 : b], '') as mid, array_to_string(u[b + 1 : n], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
 sha256(case form when 'plain' then t when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p"""

RANKED_SQL = r"""with d as (select row_number() over () as r, doc_id, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for x in regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')] as ts from documents),
q as (select distinct item_id, text, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for x in regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')] as ts from benchmark),
s as (select count(*)::bigint as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
p as (select r, term, count(*)::bigint as tf from (select r, unnest(ts) as term from d) group by r, term),
w as (select term, floor(1000 * ln((2.0::double * n + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by term, n),
t as (select item_id, text, unnest(ts) as term from q),
f as (select r, doc_id, 75 + (25 * len(ts) * n) // l as m from d, s where len(ts) > 0),
x as (select item_id, text, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from t join p using (term) join w using (term) join f using (r) group by item_id, text, doc_id, r)
select item_id, row_number() over (partition by item_id, text order by score desc, doc_id)::int as rank, doc_id, score from x where score > 0 qualify rank <= 20"""

ORACLE_SQL: dict[str, str] = {"op3_url_filters": URL_SQL, "op9_quality_rules": QUALITY_SQL, "op11_ranked_search": RANKED_SQL, "op13_fill_in_middle": MIDDLE_SQL}
