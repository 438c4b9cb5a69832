"""Queries over records whose schema drifts (problem 6)."""

from __future__ import annotations

from lodestone.operators import drift
from lodestone.plans.registry import query
from lodestone.tables import load


_BASE = """with recursive files as (select feed_id, file_id, row_number() over (partition by feed_id order by min(file_seq), file_id) as no from run_records where file_id is not null group by 1, 2),
r as (select f.feed_id, f.no, json_extract_string(x.raw_json, '$.document_id') as doc, x.raw_json as j from run_records x join files f on f.feed_id = x.feed_id and f.file_id = x.file_id where json_valid(x.raw_json) and json_type(x.raw_json) = 'OBJECT'),
v as (select r.feed_id, r.no, r.doc, substr(t.fullkey, 3) as path, case t.type when 'BOOLEAN' then 'boolean' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'HUGEINT' then 'integer' when 'DOUBLE' then 'decimal' when 'VARCHAR' then 'string' when 'ARRAY' then 'array' end as kind, t.value::varchar as value
from r, json_tree(r.j) t where t.type <> 'OBJECT' and not contains(t.fullkey, '[')),
p as (select feed_id, no, path, max(kind) as kind from v group by all),
come as (select * from p where no > 1 and not exists (select 1 from p q where q.feed_id = p.feed_id and q.no = p.no - 1 and q.path = p.path)),
gone as (select p.feed_id, p.no + 1 as no, p.path, p.kind from p join files f on f.feed_id = p.feed_id and f.no = p.no + 1 where not exists (select 1 from p q where q.feed_id = p.feed_id and q.no = p.no + 1 and q.path = p.path)),
o as (select feed_id, no, doc, path, max(case when kind is not null then value end) as value from v where doc is not null group by all),
docs as (select distinct feed_id, no, doc from v where doc is not null), shared as (select a.* from docs a join docs b on b.feed_id = a.feed_id and b.no = a.no - 1 and b.doc = a.doc),
ren as (select c.feed_id, c.no, c.path, g.path as former from come c join gone g on g.feed_id = c.feed_id and g.no = c.no and g.kind = c.kind join shared b on b.feed_id = c.feed_id and b.no = c.no
left join o n on n.feed_id = c.feed_id and n.no = c.no and n.doc = b.doc and n.path = c.path left join o w on w.feed_id = c.feed_id and w.no = c.no - 1 and w.doc = b.doc and w.path = g.path
group by all having bool_and(n.value is not distinct from w.value) and count(n.value) > 0)"""

_FOUND = (
    _BASE
    + """,
a as (select feed_id, no, path as field_path, former as former_path, 'renamed' as change from ren
union all select feed_id, no, path, '', 'added' from come where (feed_id, no, path) not in (select feed_id, no, path from ren)
union all select feed_id, no, path, '', 'removed' from gone where (feed_id, no, path) not in (select feed_id, no, former from ren)
union all select p.feed_id, p.no, p.path, '', 'type_changed' from p join p q on q.feed_id = p.feed_id and q.no = p.no - 1 and q.path = p.path where p.kind <> q.kind)
select distinct f.file_id, field_path, former_path, change from a join files f on f.feed_id = a.feed_id and f.no = a.no"""
)

_VALUES = (
    _BASE
    + """,
step as (select p.feed_id, p.no, p.path, p.kind, coalesce(q.path, f.former) as up from p left join p q on q.feed_id = p.feed_id and q.no = p.no - 1 and q.path = p.path
left join (select feed_id, no, path, min(former) as former from ren group by all) f on f.feed_id = p.feed_id and f.no = p.no and f.path = p.path),
chain as (select feed_id, no, path, kind, no as root_no, path as root from step where up is null
union all select s.feed_id, s.no, s.path, s.kind, c.root_no, c.root from step s join chain c on c.feed_id = s.feed_id and c.no = s.no - 1 and c.path = s.up),
names as (select path, count(distinct case when no = 1 then feed_id end) as begins, count(*) as files from chain group by path),
called as (select feed_id, root_no, root, first(path order by begins desc, files desc, path) as target, count(distinct path) = 1 as alone from chain join names using (path) group by all),
others as (select c.path, min(k.target) as theirs from chain c join called k using (feed_id, root_no, root) where not k.alone group by c.path having count(distinct k.target) = 1 and min(k.target) <> c.path),
alias as (select c.feed_id, c.no, c.path, c.kind, case when k.alone then coalesce(o.theirs, k.target) else k.target end as target from chain c join called k using (feed_id, root_no, root) left join others o using (path)),
kinds as (select target, case kind when 'decimal' then 'integer' else kind end as kind, sum((kind is not null)::int) as n, bool_or(coalesce(kind = 'decimal', false)) as dec from alias group by all),
cols as (select a.target, coalesce(k.kind, 'string') as kind, replace('f_' || a.target, '.', '_') as name from (select target, count(distinct feed_id) as feeds from alias group by 1) a
join (select target, case when arg_max(kind, (n, kind)) = 'integer' and arg_max(dec, (n, kind)) then 'decimal' else arg_max(kind, (n, kind)) end as kind from kinds group by 1) k using (target) where feeds >= 0.1 * (select count(distinct feed_id) from alias)),
shown as (select target, kind, case when row_number() over (partition by name order by target) = 1 then name else name || '_' || row_number() over (partition by name order by target) end as name from cols),
cell as (select x.raw_id, substr(t.fullkey, 3) as path, t.type as type, json_extract_string(t.value, '$') as bare, f.feed_id, f.no
from run_records x join files f on f.feed_id = x.feed_id and f.file_id = x.file_id, json_tree(x.raw_json) t where json_valid(x.raw_json) and json_type(x.raw_json) = 'OBJECT' and t.type not in ('OBJECT', 'NULL') and not contains(t.fullkey, '[')),
told as (select c.*, a.target, s.name, s.kind, case
when s.kind = 'string' then null when s.kind = 'boolean' and lower(trim(bare)) in ('true', 't', 'yes', 'y', '1', '1.0') then 1.0
when s.kind = 'boolean' and lower(trim(bare)) in ('false', 'f', 'no', 'n', '0', '0.0') then 0.0
when s.kind = 'integer' and type <> 'BOOLEAN' and try_cast(bare as double) = floor(try_cast(bare as double)) then try_cast(bare as double)
when s.kind = 'decimal' and type <> 'BOOLEAN' then try_cast(bare as double) end as number
from cell c join alias a on a.feed_id = c.feed_id and a.no = c.no and a.path = c.path left join shown s using (target)),
ranked as (select *, name is not null and (kind = 'string' or number is not null) as fits, row_number() over (partition by raw_id, target, name is not null and (kind = 'string' or number is not null) order by path <> target, path) as k from told)
select raw_id, case when fits and k = 1 then name else path end as field, fits and k = 1 as is_column, case when fits and k = 1 then number end as number, case when not (fits and k = 1) or kind = 'string' then bare end as text from ranked"""
)


@query(_FOUND)
def p6_found(spark, folder):
    """The changes of fields from file to file."""
    return drift.changes(load(spark, folder, "run_records")).select("file_id", "field_path", "former_path", "change").distinct()


@query(_VALUES)
def p6_values(spark, folder):
    """The consistent table as one row for each value."""
    return drift.long_values(drift.consistent_table(load(spark, folder, "run_records")))


@query()
def p6_table(spark, folder):
    """All records in one consistent table."""
    return drift.consistent_table(load(spark, folder, "run_records"))
