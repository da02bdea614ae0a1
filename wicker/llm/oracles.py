"""SQL for DuckDB with the results of those queries that it can express."""

from __future__ import annotations

from wicker.llm import preference, quality

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _crc_table() -> str:
    """The table of CRC-32, from its polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(f"{x}::bigint")
    return f"[{', '.join(out)}]"


SHARDING = f"""
with b as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
l as (select doc_id, strlen(text) + 1 as size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint) as bytes from b),
s as (select doc_id, size, xor(list_reduce(list_concat([4294967295::bigint], bytes), lambda c, x: xor(c >> 8, {_crc_table()}[1 + (xor(c, x) & 255)])), 4294967295) as text_crc32 from l),
p as (select *, sum(size) over (order by doc_id nulls first, size, text_crc32 rows unbounded preceding) - size as before, sum(size) over () as whole, row_number() over (order by doc_id nulls first, size, text_crc32) as n from s),
c as (select *, least(7, ((2 * before + size) * 8) // (2 * whole))::int as shard from p)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard, (n - min(n) over (partition by shard))::bigint as slot, null::int as grown_shard from c
"""


def quality_rules(rules: tuple[quality.Rule, ...] = quality.RULES, risk: float = 0.02, error: float = 0.05) -> str:
    """Counts by lists, repeated windows by groups, cutoffs by the binomial sum itself; ids must be unique."""
    grid = ", ".join(f"('{r.name}', {i}, {c}::double)" for r in rules for i, c in enumerate(r.cutoffs))
    score = "case rule " + " ".join(f"when '{r.name}' then {r.score}" for r in rules) + " end"
    p = risk / len(rules)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p}))))"
    failed = " or ".join(f"coalesce({r.score} >= (select min(cutoff) from cutoffs x where x.stratum = f.stratum and x.rule = '{r.name}'), false)" for r in rules)
    return rf"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, {_WORDS.format('t')} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) as g from w),
rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from win join (select doc_id, g from win group by 1, 2 having count(*) > 1) using (doc_id, g)) group by 1),
f as (select doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from w left join rep using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
good as (select b.* from b join (select doc_id, min(quality) as q from labels group by 1) using (doc_id) where q = 1 and not base_failed),
grid as (select * from (values {grid}) as g(rule, step, cutoff)),
held as (select stratum, rule, step, cutoff, count(*) as n, count(*) filter ({score} >= cutoff) as k from good, grid group by all),
tested as (select *, (case when n * {p} > k then least(1.0, {tail}) else 1.0 end) <= {error} / ((select count(distinct stratum) from good) * {len(rules)}) as passed from held),
clean as (select *, bool_and(passed) over (partition by stratum, rule order by step) as clean from tested),
cutoffs as (select stratum, rule, min(cutoff) as cutoff from clean where clean group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({failed}) as kept from b f
"""


def _shown(role: str, text: str) -> str:
    return f"'{preference.OPEN}' || {role} || '|>' || chr(10) || {text} || '{preference.END}' || chr(10)"


PREFERENCE = f"""
with t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from (select distinct conv_id, turn, role, text from conversations where conv_id is not null)),
l as (select conv_id, max(pos) as last, arg_max(text, pos) as reply from t where role = 'assistant' group by 1),
c as (select t.conv_id, pos, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text from t join l using (conv_id) where pos <= last),
r as (select c.* from c join l using (conv_id) where pos < last union all select a.conv_id, a.last, 'assistant', replace(coalesce(b.reply, ''), '<|', '< |') from l a join l b on b.conv_id = xor(a.conv_id, 1)),
x as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.pos, r.pos) as pos, coalesce(c.role = r.role and c.text = r.text, false) as same from c full join r on c.conv_id = r.conv_id and c.pos = r.pos),
p as (select conv_id, count(*) filter (same) as n from (select *, bool_and(same) over (partition by conv_id order by pos) as same_ from x) where same_ group by 1),
n as (select conv_id, coalesce(p.n, 0) as n from l left join p using (conv_id)),
sides as (select 'c' as side, * from c union all select 'r', * from r),
parts as (select s.*, n.n, {_shown('role', 'text')} as shown, length(role) + {len(preference.OPEN + preference.CLOSE)} as head, length(text) + {len(preference.END)} as body from sides s join n using (conv_id)),
rest as (select *, sum(length(shown)) over (partition by conv_id, side order by pos rows unbounded preceding) - length(shown) as begin_ from parts where pos > n)
select n.conv_id, n.n::bigint as n_prompt_turns,
 coalesce((select string_agg(shown, '' order by pos) from parts q where q.conv_id = n.conv_id and side = 'c' and pos <= q.n), '') as prompt,
 coalesce((select string_agg(shown, '' order by pos) from rest q where q.conv_id = n.conv_id and side = 'c'), '') as chosen,
 coalesce((select string_agg(shown, '' order by pos) from rest q where q.conv_id = n.conv_id and side = 'r'), '') as rejected,
 coalesce((select string_agg((begin_ + head)::bigint || '-' || (begin_ + head + body)::bigint, ',' order by pos) from rest q where q.conv_id = n.conv_id and side = 'c' and role = 'assistant'), '') as chosen_mask,
 coalesce((select string_agg((begin_ + head)::bigint || '-' || (begin_ + head + body)::bigint, ',' order by pos) from rest q where q.conv_id = n.conv_id and side = 'r' and role = 'assistant'), '') as rejected_mask
from n
"""

ORACLES = {"op3_sharding": SHARDING, "op5_preference": PREFERENCE, "op8_quality_rules": quality_rules()}
