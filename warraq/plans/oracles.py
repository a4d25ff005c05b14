"""DuckDB's SQL of queries that take more than an expression: folds, counters and recursion.

Edit distances in that SQL count bytes, so that texts are first mapped to one byte a
character; the tables' letters and marks are all in the map.
"""

from __future__ import annotations

LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
#: Other characters of the tables' texts, and a byte for each that lower-case texts do not hold.
OTHER = "أؤ٠١٢٣٤٥٦٧٨٩¬éèêëàâáäùûüúôöóîïíçñßœ¿¡"
OTHER_BYTES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(1, 9), *range(14, 32)])))[: len(OTHER)]


def in_bytes(x: str) -> str:
    return f"translate({x}, '{ARABIC}{OTHER}', '{LATIN}{OTHER_BYTES}')"


def similarity_sql(a: str, b: str) -> str:
    """Similarity of two normalised texts of one byte a character."""
    most = f"greatest(length({a}), length({b}), 1)"
    return f"(({most} - levenshtein({a}, {b}))::double / {most})"


def batch_sql(arabic: str, clean: str) -> str:
    """``clean`` is the SQL of line ``l`` normalised."""
    return f"select doc_id, array_to_string(list_transform(string_split({arabic}, chr(10)), lambda l: {clean}), chr(10)) as clean from documents"


#: Counts the errors of a stack of brackets; the fold's state is of its elements' type.
BRACKETS_SQL = r"""with b as (select page_id, regexp_extract_all(translate(html, '<>', '(['), '[«»(){}\[\]]') as cs, (length(html) - length(replace(html, '"', ''))) % 2 as odd from pages),
f as (select page_id, odd, list_reduce(list_transform(cs, lambda c: {'c': c, 'st': '', 'n': 0}), lambda a, x: case
  when contains('«([{', x.c) then {'c': '', 'st': a.st || x.c, 'n': a.n}
  when a.st = '' then {'c': '', 'st': '', 'n': a.n + 1}
  else {'c': '', 'st': left(a.st, -1), 'n': a.n + case when translate(right(a.st, 1), '«([{', '»)]}') = x.c then 0 else 2 end} end, {'c': '', 'st': '', 'n': 0}) as s from b)
select page_id, (coalesce(s.n + length(s.st), 0) + odd)::bigint as n_errors, coalesce(s.n + length(s.st), 0) + odd = 0 as is_balanced from f"""

_ERROR, _MARK = "struct(i bigint, c varchar, r varchar, t varchar)[]", "struct(c varchar, i bigint)[]"
UNBALANCED_SQL = rf"""with l as (select doc_id, unnest(string_split(translate(coalesce(text, ''), '|*%', '()['), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents),
s as (select doc_id, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as begin from l),
m as (select doc_id, begin, line, list_filter(list_transform(string_split(line, ''), lambda c, i: {{'c': c, 'i': (i - 1)::bigint}}), lambda s: s.c <> '' and contains('«»(){{}}[]', s.c)) as ms from s where length(line) > 10),
f as (select doc_id, begin, list_reduce(list_transform(ms, lambda m: {{'m': m, 'st': []::{_MARK}, 'e': []::{_ERROR}}}), lambda a, x: case
  when contains('«([{{', x.m.c) then {{'m': x.m, 'st': list_append(a.st, x.m), 'e': a.e}}
  when len(a.st) = 0 then {{'m': x.m, 'st': a.st, 'e': list_append(a.e, {{'i': x.m.i, 'c': x.m.c, 'r': 'unmatched', 't': 'bracket'}})}}
  when translate(a.st[-1].c, '«([{{', '»)]}}') = x.m.c then {{'m': x.m, 'st': a.st[:-2], 'e': a.e}}
  else {{'m': x.m, 'st': a.st[:-2], 'e': list_concat(a.e, [{{'i': a.st[-1].i, 'c': a.st[-1].c, 'r': 'mismatched', 't': 'bracket'}}, {{'i': x.m.i, 'c': x.m.c, 'r': 'mismatched', 't': 'bracket'}}])}} end,
  {{'m': {{'c': '', 'i': 0::bigint}}, 'st': []::{_MARK}, 'e': []::{_ERROR}}}) as s from m where len(ms) > 0),
e as (select doc_id, begin, unnest(list_concat(s.e, list_transform(s.st, lambda m: {{'i': m.i, 'c': m.c, 'r': 'unclosed', 't': 'bracket'}}))) as e from f
 union all select doc_id, begin, {{'i': length(line) - instr(reverse(line), '"'), 'c': '"', 'r': 'unmatched', 't': 'quote'}} from m where (length(line) - length(replace(line, '"', ''))) % 2 = 1)
select doc_id, begin + e.i as absolute_index, e.c as "char", e.r as reason, e.t as "type" from e"""


def similar_sql(a: str, b: str) -> str:
    """``a`` and ``b`` are the SQL of two normalised texts of ``part``."""
    return f"""with n as materialized (select p_partkey, {in_bytes(a)} as a, {in_bytes(b)} as b from part), s as (select *, {similarity_sql("a", "b")} as v from n)
select p_partkey, v >= 0.5 as similar, case when a = b then 2 when v >= 0.5 then 1 else -2 end as score from s"""


def pattern_counts_sql(x: str, arabic: str, white: str) -> str:
    """``x`` is the text's SQL; ``arabic`` and ``white`` are the insides of RE2 classes."""
    digits, ref, confused = "0-9٠-٩", r"\([٠-٩]+\)", r"\([.1OV9]+\)"
    patterns = {
        "arabic_characters": f"[{arabic}]",
        "arabic_digits": f"[{digits}]+",
        "arabic_footnote_reference": f"^{ref}",
        "arabic_letters_and_digits": rf"[{digits}\x{{621}}-\x{{63a}}\x{{641}}-\x{{64a}}]+",
        "arabic_punctuation_and_whitespace": rf"[{white}\x{{60c}}\x{{61b}}\x{{61f}}\x{{6d4}}]+",
        "arabic_reference": ref,
        "footnote_embedded": rf"\([{digits}]+\)",
        "footnote_standalone": rf"^\(?[{digits}]+\)?[،.]?$",
        "invalid_reference": rf"\(\)|{confused}",
        "ocr_confused_footnote_reference": f"^{confused}",
        "ocr_confused_reference": confused,
        "whitespace": f"[{white}]+",
    }
    one = " union all ".join(f"select doc_id, '{n}' as pattern, len(regexp_extract_all(x, '{p}')) as n from t" for n, p in patterns.items())
    return f"with t as materialized (select doc_id, {x} as x from documents) {one}"


REPAIR_SQL = r"""with l as (select conv_id, turn, role = 'assistant' as n, case turn % 3 when 0 then '()' when 1 then '(٢)' else '(9)' end as m, text from conversations),
x as (select conv_id, turn, n, case when n then m || ' ' || text else text || ' ' || m || ' ()' end as t from l),
c as materialized (select *, replace(t, '(9)', '(٩)') as k from x),
u as (select conv_id, n, turn, unnest(case when n then regexp_extract_all(k, '^\([٠-٩]+\)') else regexp_extract_all(k, '\([٠-٩]+\)') end) as ref,
 generate_subscripts(case when n then regexp_extract_all(k, '^\([٠-٩]+\)') else regexp_extract_all(k, '\([٠-٩]+\)') end, 1) as pos from c),
r as materialized (select conv_id, n, ref, min({'turn': turn, 'pos': pos}) as first from u group by all),
q as (select a.conv_id, not a.n as n, a.ref, a.first from r a anti join r b on a.conv_id = b.conv_id and a.ref = b.ref and a.n <> b.n),
queue as materialized (select conv_id, n, list(ref order by first) as refs from q group by all),
d as materialized (select conv_id, bool_or(regexp_matches(t, '\(\)|\([.1OV9]+\)')) as bad from c group by all),
top as (select conv_id, max(translate(ref, '٠١٢٣٤٥٦٧٨٩()', '0123456789')::bigint) as top from r group by all),
h as materialized (select conv_id, turn, n, string_split(k, '()') as parts from c),
g as (select conv_id, turn, n, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as i from h),
o as (select *, case when i > 0 then count(*) filter (where i > 0) over (partition by conv_id, n order by turn, i) end as own from g),
s as (select o.*, coalesce(len(refs), 0) as size, refs[own] as due from o left join queue using (conv_id, n)),
f as (select *, count(*) filter (where own > size) over (partition by conv_id order by turn, i) as fresh from s),
w as (select conv_id, turn, string_agg(case when i = 0 then '' when own <= size then due else '(' || translate((coalesce(top, 0) + fresh)::varchar, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ')' end || part, '' order by i) as new from f left join top using (conv_id) group by all)
select c.conv_id, c.turn, case when d.bad or exists (select 1 from queue where queue.conv_id = c.conv_id) then w.new else c.t end as text, c.n as is_footnote from c join w using (conv_id, turn) join d using (conv_id)"""


def segments_sql(clean) -> str:
    """``clean(x)`` is the SQL of a text normalised for search."""
    norm = lambda x: in_bytes(clean(x))
    return f"""with recursive t as materialized (select conv_id, turn, translate(lower(text), '{LATIN}', '{ARABIC}') as x from conversations),
v as (select conv_id, turn, x, (length(x) // 2)::int as h from t),
d as materialized (select conv_id, list(x order by turn) as ts, flatten(list([substr(x, h + 1), substr(x, 1, h)] order by turn)) as ss from v group by all),
step as (select conv_id, 0 as k, 0 as cur, []::varchar[] as "out" from d
 union all select conv_id, k + 1, cur + case act when 'two' then 2 when 'none' then 0 else 1 end,
  case act when 'none' then "out" when 'skip' then "out" when 'two' then list_append("out", case when {similarity_sql("ng", "nf")} >= {similarity_sql("ng", "nb")} then here || ' ' || nxt else nxt || ' ' || here end) else list_append("out", here) end
 from (select *, case when cur >= n then 'none' when goal = '' then 'one' when {similarity_sql("ng", "nh")} >= 0.6 then case when here = '' then 'skip' else 'one' end when here = '' then 'none' when nxt = '' then 'one' else 'two' end as act
 from (select *, {norm("goal")} as ng, {norm("here")} as nh, {norm("here || ' ' || nxt")} as nf, {norm("nxt || ' ' || here")} as nb
 from (select step.*, coalesce(ts[k + 1], '') as goal, coalesce(ss[cur + 1], '') as here, coalesce(ss[cur + 2], '') as nxt, len(ss) as n from step join d using (conv_id) where k < len(ts))))),
last as (select conv_id, list_concat("out", ss[cur + 1 :]) as "out" from step join d using (conv_id) where k = len(ts))
select conv_id, generate_subscripts("out", 1) - 1 as pos, unnest("out") as line from last"""


def align_sql(rows: str, clean, symbol: str | None = None) -> str:
    """Common tables of the alignment of the token lists ``xs`` and ``ys`` of ``rows`` (conv_id, turn, xs, ys): ``pair`` (conv_id, turn, pos, a, b).

    A row of the matrix is a step of the recursion and a fold over the tokens of ``ys``.
    """
    norm = lambda x: f"list_transform({x}, lambda t: {in_bytes(clean('t'))})"
    soft = similarity_sql("y", "nx[i + 1]") + " >= 0.6"
    if symbol:
        soft = f"ys[k] = '{symbol}' or xs[i + 1] = '{symbol}' or {soft}"
    both, up, left = "up[x.j] + sc[x.j]", "up[x.j + 1] - 1", "a.s[-1] - 1"
    best = f"greatest({both}, {up}, {left})"
    return f"""with recursive r0 as materialized ({rows}), r as materialized (select *, {norm("xs")} as nx, {norm("ys")} as ny from r0),
m(conv_id, turn, i, up, steps) as (select conv_id, turn, 0, list_transform(range(0, len(ys) + 1), lambda j: (-j)::int), []::varchar[] from r
 union all select conv_id, turn, i + 1, res.s, list_append(steps, res.t) from (select conv_id, turn, i, steps, list_reduce(list_transform(range(1, len(ny) + 1), lambda j: {{'j': j, 's': []::int[], 't': ''}}), lambda a, x:
  {{'j': x.j, 's': list_append(a.s, ({best})::int), 't': a.t || case when {both} = {best} then 'd' when {up} = {best} then 'u' else 'l' end}}, {{'j': 0::bigint, 's': [up[1] - 1], 't': ''}}) as res
 from (select m.*, nx, ny, list_transform(ny, lambda y, k: case when y = nx[i + 1] then 2 when {soft} then 1 else -2 end) as sc from m join r using (conv_id, turn) where i < len(xs)))),
done as materialized (select m.conv_id, m.turn, steps, xs, ys from m join r using (conv_id, turn) where i = len(xs)),
w(conv_id, turn, i, j, pos, a, b) as (select conv_id, turn, len(xs), len(ys), 0, null::varchar, null::varchar from done
 union all select conv_id, turn, i - (st in ('d', 'u'))::int, j - (st in ('d', 'l'))::int, pos - 1, case when st in ('d', 'u') then xs[i] end, case when st in ('d', 'l') then ys[j] end
 from (select w.*, xs, ys, case when i = 0 then 'l' when j = 0 then 'u' else substr(steps[i], j, 1) end as st from w join done using (conv_id, turn) where i > 0 or j > 0)),
pair as materialized (select conv_id, turn, row_number() over (partition by conv_id, turn order by pos) - 1 as pos, a, b from w where pos < 0)"""


def tokens_sql(clean) -> str:
    """``clean(x)`` is the SQL of a text normalised for search."""
    x = f"string_split(translate(lower(text), '{LATIN}', '{ARABIC}'), ' ')"
    return align_sql(f"select conv_id, turn, {x} as xs, list_filter({x}, lambda w, i: (i - 1) % 5 <> 3) as ys from conversations", clean) + " select * from pair"


def typos_sql(clean, white: str, changed: tuple[str, str], symbol: str) -> str:
    """The repair of each turn by a reading of it with ``changed`` letters and a symbol at its end."""
    split = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(replace({x}, '{symbol}', ' {symbol} '), '[{white}]+', ' ', 'g'), ' '), lambda t: t <> '')"
    x = f"translate(lower(text), '{LATIN}', '{ARABIC}')"
    rows = f"select conv_id, turn, {split(x)} as xs, {split(f"replace({x}, '{changed[0]}', '{changed[1]}') || ' {symbol}'")} as ys from conversations"
    held, alone = r"\([0-9٠-٩]+\)", r"^\(?[0-9٠-٩]+\)?[،.]?$"
    digits = lambda t: f"regexp_extract({t}, '[0-9٠-٩]+')"
    shorter = "case when length(a) <= length(b) then a else b end"
    same = f"{digits('k[-1].t')} = {digits('x.h.t')}"
    k, at = lambda x: x.replace("k[", "a.k["), "a.k[-1].t"
    return (
        align_sql(rows, clean, symbol)
        + rf""", p as (select *, {in_bytes(clean("a"))} as na, {in_bytes(clean("b"))} as nb, regexp_matches(a, '{held}') as ha, regexp_matches(b, '{held}') as hb, regexp_matches(a, '{alone}') as sa, regexp_matches(b, '{alone}') as sb from pair),
c as (select conv_id, turn, pos, case when a is null then [b] when b is null or na = nb then [a] when ha and hb then [{shorter}] when ha then [a] when hb then [b]
 when sa and sb then [{shorter}] when sa then [a, b] when sb then [b, a] when a = '{symbol}' or b = '{symbol}' then ['{symbol}'] when {similarity_sql("na", "nb")} > 0.6 then [a] else [b] end as ts from p),
t as (select conv_id, turn, list_transform(flatten(list(ts order by pos)), lambda t: {{'t': t, 'n': {in_bytes(clean("t"))}}}) as hs from c group by all),
f as (select conv_id, turn, list_reduce(list_transform(hs, lambda h: {{'h': h, 'k': [h]}}), lambda a, x: {{'h': x.h, 'k': case
 when {similarity_sql("a.k[-1].n", "x.h.n")} >= 0.8 then case when length(x.h.t) < length({at}) then list_append(a.k[:-2], x.h) else a.k end
 when regexp_matches({at}, '{alone}') and regexp_matches(x.h.t, '{held}') and {k(same)} then list_append(a.k[:-2], x.h)
 when regexp_matches({at}, '{held}') and regexp_matches(x.h.t, '{alone}') and {k(same)} then a.k else list_append(a.k, x.h) end}}).k as ks from t)
select conv_id, turn, array_to_string(list_transform(ks, lambda h: h.t), ' ') as fixed from f"""
    )


def fuzzy_sql(pages: str, excerpts: str) -> str:
    """Common tables of the page search; ``pages`` (book_id, page, text) and ``excerpts`` (book_id, excerpt_id, text) are the SQL of normalised tables.

    ``exact`` has the pages of exact hits, ``near`` the verified candidates. Twelve
    neighbours suffice: pages are longer than a few characters.
    """
    cum = lambda side: f"coalesce(list_sum(list_transform({side}[: j - 1], lambda t: length(t))), 0)"
    # neighbours count up to the first empty page
    until = lambda side: f"range(1, coalesce(list_position({side}, ''), len({side}) + 1))"
    return f"""with book as materialized (select book_id, page, {in_bytes("text")} as text, row_number() over (partition by book_id order by page) - 1 as idx from {pages}),
ex as materialized (select book_id, excerpt_id, {in_bytes("text")} as pattern from {excerpts}),
ctx as materialized (select *, coalesce(list(text) over (partition by book_id order by idx rows between 1 following and 12 following), []::varchar[]) as ahead,
 coalesce(list_reverse(list(text) over (partition by book_id order by idx rows between 12 preceding and 1 preceding)), []::varchar[]) as back from book),
pat as materialized (select distinct book_id, pattern from ex where pattern <> ''),
exact as materialized (select pat.book_id, pattern, idx, page from pat join ctx on pat.book_id = ctx.book_id and instr(text || ' ' || array_to_string(ahead, ' '), pattern) between 1 and length(text)),
eg as materialized (select book_id, pattern, substr(pattern, i::int, 4) as gram, min(i) - 1 as offs from (select *, unnest(range(1, length(pattern) - 2)) as i from pat anti join exact using (book_id, pattern) where length(pattern) >= 4) group by all),
texts as materialized (select book_id, idx, page, text, false as seam from book union all
 select book_id, idx, page, right(text, 512) || ' ' || left(nxt, 512), true from (select *, lead(text) over (partition by book_id order by idx) as nxt from book) where nxt is not null),
post as materialized (select * from (select book_id, idx, page, seam, i - 1 as pos, substr(text, i::int, 4) as gram from (select *, unnest(range(1, length(text) - 2)) as i from texts where length(text) >= 4)) semi join eg using (book_id, gram)),
freq as (select book_id, gram, count(*) as n from post group by all),
seeds as materialized (select *, row_number() over (partition by book_id, pattern order by n, offs) as seed from eg join freq using (book_id, gram) qualify seed <= 5),
cand as materialized (select book_id, pattern, idx, page, greatest(0, pos - offs) as start, seam, min({{'s': seed, 'm': seam, 'i': idx, 'p': pos}}) as o from post join seeds using (book_id, gram)
 where pos - offs >= -floor(length(pattern) * 0.25) group by all),
ranked as (select *, row_number() over (partition by book_id, pattern order by o) as rnk from cand qualify rnk <= 40),
w0 as (select r.*, t.text as base, length(t.text) as size, length(pattern) as n, greatest(3, ceil(length(pattern) * 0.1))::int as most from ranked r join texts t using (book_id, idx, seam) where t.text <> ''),
w1 as (select *, least(most, greatest(6, ceil(n * 0.12)))::int as spare from w0),
w2 as (select *, n + spare as want, start - spare // 2 as b from w1),
w3 as (select *, not seam and b + want > size as to_end, not seam and b < 0 as from_start, greatest(0, b) as f from w2),
w4 as (select *, (most + case when to_end or from_start or seam then least(80, ceil(n * 0.08)) else least(2, greatest(1, ceil(n * 0.005))) end)::int as acceptance, least(200, greatest(0, size - f)) as cut from w3),
w5 as materialized (select *, 0 as tail, 0 as head from w4 union all select *, cut, 0 from w4 where to_end and cut > 0 union all select *, 0, least(200, -b) from w4 where from_start),
w6 as (select w5.*, ahead, case when from_start then -b - head else 0 end as need, back from w5 join ctx using (book_id, idx)),
w7 as (select *, list_reverse(list_filter(list_transform({until("back")}, lambda j: right(back[j], greatest(0, need - {cum("back")})::int)), lambda t: t <> '')) as pieces from w6),
w8 as (select *, case when need > 0 and len(pieces) > 0 then array_to_string(pieces, ' ') || ' ' else '' end as pre from w7),
w9 as (select * exclude (need), pre || substr(base, (f + 1)::int, greatest(0, least(size - tail, f + want - length(pre)) - f)::int) as win from w8),
w10 as (select *, case when to_end or from_start then want - length(win) else 0 end as need from w9),
w11 as (select *, win || array_to_string(list_transform({until("ahead")}, lambda j: case when need - {cum("ahead")} > 0 then ' ' || left(ahead[j], (need - {cum("ahead")})::int) else '' end), '') as whole from w10),
near as materialized (select book_id, pattern, idx, page, start, seam, rnk, acceptance, min(levenshtein(pattern, whole)) as dist from w11 where whole <> '' group by all having dist <= acceptance)"""


FUZZY_BEST = """ select ex.book_id, excerpt_id, coalesce(e.page, b.page) as page from ex left join (select book_id, pattern, arg_min(page, idx) as page from exact group by all) e using (book_id, pattern)
 left join (select book_id, pattern, page from near qualify row_number() over (partition by book_id, pattern order by dist, case when dist = 0 then rnk else idx end, idx) = 1) b using (book_id, pattern)"""

FUZZY_ALL = """, best as (select book_id, pattern, idx, page, seam, 1 - dist / acceptance as score from near qualify row_number() over (partition by book_id, pattern, idx order by 1 - dist / acceptance desc, rnk) = 1),
hits as (select book_id, pattern, list({'idx': idx, 'seam': seam, 'score': score, 'page': page} order by idx) as hs from best group by all),
fold as (select book_id, pattern, list_reduce(list_transform(hs, lambda h: {'h': h, 'k': [h]}), lambda a, x: {'h': x.h, 'k': case when not (a.k[-1].seam and x.h.seam and a.k[-1].idx + 1 = x.h.idx) then list_append(a.k, x.h)
 when x.h.score > a.k[-1].score then list_append(a.k[:-2], x.h) else a.k end}).k as ks from hits),
kept as (select book_id, pattern, list_filter(ks, lambda h: not (h.seam and len(list_filter(ks, lambda o: o.idx = h.idx + 1 and not o.seam and o.score >= h.score)) > 0)) as ks from fold),
flat as (select book_id, pattern, unnest(ks) as h from kept),
ranks as (select book_id, pattern, h.page as page, row_number() over (partition by book_id, pattern order by -h.score, h.idx) - 1 as rank from flat
 union all select book_id, pattern, page, row_number() over (partition by book_id, pattern order by idx) - 1 from exact)
select book_id, excerpt_id, rank, page from ex join ranks using (book_id, pattern)"""
