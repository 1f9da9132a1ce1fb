"""The same results as DuckDB SQL, where SQL can express them."""

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

SOURCE_MIX = r"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as o,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
totals as (select source, sum(size)::bigint as words from sized group by source),
ranked as (
  select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w,
         3 * words as cap from totals),
tried as (
  select *, sum(words) over () - coalesce(sum(cap) over a, 0) as rest,
         sum(w) over () - coalesce(sum(w) over a, 0) as open
  from ranked
  window a as (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
full_ as (select *, rest * w > cap * open as is_full from tried),
targets as (
  select source, words,
         case when is_full then cap::double else
           (w * (sum(words) over () - sum(case when is_full then cap else 0 end) over ()))::bigint::double
           / (sum(case when is_full then 0 else w end) over ())::bigint::double end as target
  from full_),
placed as (
  select s.doc_id, s.size, t.words, t.target,
         coalesce(sum(s.size) over (partition by s.source order by s.o, s.size, s.doc_id
           rows between unbounded preceding and 1 preceding), 0)::bigint as b
  from sized s join targets t on s.source is not distinct from t.source),
counted as (
  select *, case when words > 0 then floor(target / words)::bigint else 0 end as e from placed)
select doc_id, size, words as source_size, target,
       ((e + case when size > 0 and 2 * b + size <= 2 * (target - e * words) then 1 else 0 end) * size)::bigint as taken
from counted
"""

LINE_DEDUP = rf"""
with lines as (
  select doc_id, pos, line, trim(translate(line, {UPPER}, {LOWER}), {BLANKS}) as k from (
    select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
common as (select k from lines where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(c.k)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.k is null), '')) as kept_sha256
from lines left join common c on lines.k = c.k group by doc_id
"""

# A marker character takes two characters, and a turn of role r and text t takes len(r) + len(t) + 9.
CHAT_FORMAT = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, 9 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g'))
         + length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) as chars from said)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""

QUALITY_RULES = rf"""
with docs as (
  select doc_id, source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, generate_subscripts(w, 1) as p, unnest(w) as x from docs),
windows as (
  select doc_id, p, count(*) over (partition by doc_id, a, b, c) as n from (
    select doc_id, p, x as a, lead(x) over o as b, lead(x, 2) over o as c
    from words window o as (partition by doc_id order by p)) where c is not null),
covered as (
  select doc_id, count(distinct q) as n from (
    select doc_id, p + unnest([0, 1, 2]) as q from windows where n > 1) group by doc_id),
lines as (
  select doc_id, source, text, pos, line,
         array_to_string(regexp_extract_all(translate(line, {UPPER}, {LOWER}), '[^\x20\x09-\x0D]+'), ' ') as k,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from (select doc_id, source, text, generate_subscripts(l, 1) as pos, unnest(l) as line
        from (select *, string_split(text, chr(10)) as l from docs)) where regexp_matches(line, '[^\x20\x09-\x0D]')),
repeats as (
  select doc_id, sum(case when r > 1 then 1 else 0 end) as n from (
    select doc_id, row_number() over (partition by doc_id, line order by pos) as r from lines) group by doc_id),
common as (select source, k from lines group by source, k having count(distinct text) > 100),
removed as (
  select doc_id, sum(n) as n from lines join common on lines.k = common.k
    and lines.source is not distinct from common.source group by doc_id),
base as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(r.n, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
         coalesce(m.n, 0) as lost
  from docs d left join repeats r using (doc_id) left join covered c using (doc_id) left join removed m using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - lost >= 0.3 * n_words as kept
from judged
"""

FILTER_AUDIT = r"""
with recursive docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
marked as (
  select d.doc_id, part,
         case when len(w) < 200 then 1 else 0 end
         + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
         + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 4 else 0 end
         + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
         + case when d.doc_id > min(d.doc_id) over (partition by text) then 16 else 0 end as mask,
         coalesce(quality, 0) as good, coalesce(toxic, 0) as toxic
  from docs d left join (
    select doc_id, max((quality = 1)::int) as quality, max((toxic = 1)::int) as toxic
    from labels group by doc_id) l on d.doc_id = l.doc_id),
cells as (
  select part, mask, count(*)::bigint as n, sum(good)::bigint as g, sum(toxic)::bigint as t
  from marked group by part, mask),
orders(filter_order, applied, bit, step) as (
  select '', 0, 0, 0
  union all
  select filter_order || chr(65 + i::int), applied + bit, (1 << i)::int, step + 1
  from orders, range(5) r(i) where ((applied + bit) & (1 << i)::int) = 0),
steps as (
  select part, filter_order, step, bit,
         coalesce(sum(n) filter ((mask & (applied + bit)) = 0), 0)::bigint as kept,
         coalesce(sum(n) filter ((mask & bit) != 0 and (mask & applied) = 0), 0)::bigint as removed,
         coalesce(sum(n) filter ((mask & bit) != 0 and (mask & applied) != 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
         coalesce(sum(g) filter ((mask & bit) != 0 and (mask & applied) = 0), 0)::bigint as good_lost,
         coalesce(sum(t) filter ((mask & bit) != 0 and (mask & applied) = 0), 0)::bigint as toxic_lost
  from orders, cells where step > 0 group by part, filter_order, step, bit)
select f.part, f.filter_order, s.step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by f.part, bit))::bigint as shapley
from (select part, filter_order from steps where step = 5) f
join steps s on f.part = s.part and substr(f.filter_order, 1, s.step) = s.filter_order
"""

ORACLES: dict[str, str] = {
    "op3_source_mix": SOURCE_MIX,
    "op4_quality_rules": QUALITY_RULES,
    "op8_line_dedup": LINE_DEDUP,
    "op9_chat_format": CHAT_FORMAT,
    "op13_filter_audit": FILTER_AUDIT,
}
