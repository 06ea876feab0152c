"""Queries of the data problems 1 to 5 and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators import changelog, delivery, drift, history, nested
from lodeline.session import read_table


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return nested.documents_of(read_table(spark, root, "raw_source_event"), read_table(spark, root, "dlq"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return nested.p1_found(read_table(spark, root, "raw_source_event"), read_table(spark, root, "dlq"))


def p1_schema_graph(spark: SparkSession, root: str) -> DataFrame:
    return nested.schema_graph(_documents(spark, root))


def p1_tables(spark: SparkSession, root: str) -> DataFrame:
    documents = _documents(spark, root)
    return nested.flat_rows(documents, nested.tabled_types(nested.schema_graph(documents))).withColumn("attributes", F.to_json("attributes"))


def p1_refused(spark: SparkSession, root: str) -> DataFrame:
    return nested.refused(_documents(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return drift.p2_found(read_table(spark, root, "normalized_change"), read_table(spark, root, "monitored_table"))


def p2_unified(spark: SparkSession, root: str) -> DataFrame:
    rows = drift.unified(read_table(spark, root, "normalized_change"), read_table(spark, root, "monitored_table"))
    return rows.withColumn("fields", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return changelog.p3_found(read_table(spark, root, "normalized_change"), read_table(spark, root, "monitored_table"))


def p3_rows(spark: SparkSession, root: str) -> DataFrame:
    return changelog.current_rows(read_table(spark, root, "normalized_change"), read_table(spark, root, "monitored_table"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return delivery.p4_found(read_table(spark, root, "raw_source_event"), read_table(spark, root, "dlq"))


def p4_once(spark: SparkSession, root: str) -> DataFrame:
    raw = delivery.once_raw(read_table(spark, root, "raw_source_event").select("delivery_id", "topic", "stream_id", "received_at"))
    dlq = delivery.once_dlq(read_table(spark, root, "dlq").select("delivery_id", "event_id", "source_engine", "offset_key", "payload_hash", "last_seen"))
    return raw.select(F.lit("raw_source_event").alias("source_table"), "delivery_id").unionByName(dlq.select(F.lit("dlq").alias("source_table"), "delivery_id"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return history.p5_found(read_table(spark, root, "normalized_change"), read_table(spark, root, "monitored_table"), read_table(spark, root, "users"))


VERSIONED = ["status", "email", "display_name"]


def p5_versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions of users and beneficiaries by status, email and display name together, from both sources."""
    changes, monitored = read_table(spark, root, "normalized_change"), read_table(spark, root, "monitored_table")
    seen = history.observations_of_changes(changes, monitored, ["users", "beneficiaries"], VERSIONED)
    return history.versions(seen.unionByName(history.observations_of_snapshots(read_table(spark, root, "users"), "users", "id", VERSIONED)), VERSIONED)


QUERIES = {
    "p1_found": p1_found, "p1_schema_graph": p1_schema_graph, "p1_tables": p1_tables, "p1_refused": p1_refused,
    "p2_found": p2_found, "p2_unified": p2_unified,
    "p3_found": p3_found, "p3_rows": p3_rows,
    "p4_found": p4_found, "p4_once": p4_once,
    "p5_found": p5_found, "p5_versions": p5_versions,
}

_LISTS = ", ".join(f"'{n}'" for n in nested.LIST_MEMBERS)

#: JSON text inside a JSON string, as often as it is wrapped (three times at most in any document).
_INNER = "case when json_type({0}) = 'VARCHAR' then try_cast({0} ->> '$' as json) else {0} end"

_DOCUMENTS = f"""
texts as (
  select 'raw_source_event' as source_table, delivery_id, value_json as text from raw_source_event
  union all select 'dlq', delivery_id, original_payload from dlq),
once as (select *, try_cast(text as json) as v from texts),
outer_ as (select *, {_INNER.format(_INNER.format('v'))} as d from once),
docs as (
  select source_table, delivery_id, text, case when json_type(d) = 'OBJECT' and json_exists(d, '$.schema') and json_exists(d, '$.payload')
    then {_INNER.format(_INNER.format("json_extract(d, '$.payload')"))} else d end as doc from outer_)"""

_NODES = f"""{_DOCUMENTS},
-- every object and list: its type, path, the type above and the nearest object above that is an element
nodes as (
  select source_table, delivery_id, '$' as type, '' as path, '' as element, false as listed, doc as value from docs where json_type(doc) in ('OBJECT', 'ARRAY')
  union all
  select source_table, delivery_id, c.type, c.path, case when n.listed and json_type(n.value) = 'OBJECT' then n.path else n.element end, c.listed, c.value
  from nodes n, lateral (
    select case when json_type(x) = 'ARRAY' then n.type || '[]' else n.type end as type, n.path || '[' || (i - 1) || ']' as path, true as listed, x as value
    from (select unnest(json_extract(n.value, '$[*]')) as x, generate_subscripts(json_extract(n.value, '$[*]'), 1) as i) where json_type(n.value) = 'ARRAY'
    union all
    select k, case when n.path = '' then k else n.path || '.' || k end, false,
      case when k in ({_LISTS}) then case when json_type(y) = 'OBJECT' then json_array(y) when json_type(y) = 'ARRAY' then y else x end else x end
    from (select k, x, {_INNER.format(_INNER.format('x'))} as y from (select k, json_extract(n.value, '$."' || k || '"') as x from (select unnest(json_keys(n.value)) as k) where json_type(n.value) = 'OBJECT'))) c
  where json_type(c.value) in ('OBJECT', 'ARRAY'))"""

_P1 = f"""
with recursive {_NODES}
select source_table, delivery_id, path as node_path, element as parent_path from nodes where listed and json_type(value) = 'OBJECT'
"""

_P1_REFUSED = f"""
with {_DOCUMENTS}
select source_table, delivery_id, case when text is null then 'null' when trim(text, E' \\t\\r\\n') = '' then 'blank' else 'invalid' end as reason from docs where doc is null
"""

_P1_GRAPH = f"""
with recursive {_NODES},
members as (
  select n.source_table, n.type as parent_type, m.k as type,
    case when m.k in ({_LISTS}) and json_type(m.y) in ('OBJECT', 'ARRAY') then 'list' when json_type(m.x) = 'ARRAY' then 'list' when json_type(m.x) = 'OBJECT' then 'object' else 'value' end as kind
  from nodes n, lateral (select k, x, {_INNER.format(_INNER.format('x'))} as y from (select k, json_extract(n.value, '$."' || k || '"') as x from (select unnest(json_keys(n.value)) as k))) m where json_type(n.value) = 'OBJECT'
  union all
  select source_table, type[:-3], type, 'list' from nodes where listed and json_type(value) = 'ARRAY')
select source_table, parent_type, type, kind, count(*) as occurrences from members group by all
"""

_OBJECT = r"regexp_replace(regexp_replace(lower(trim(object_name)), '[`\"\[\]]', '', 'g'), '^.*\.', '')"
_FILE = r"cast(regexp_extract(binlog_file, '(\d+)\s*$', 1) as bigint)"


def _key(image: str) -> str:
    """The key as SQL over monitored_table's pk_columns, joined as pk."""
    return f"(select string_agg(json_extract_string({image}, '$.\"' || trim(c.name) || '\"'), '|' order by c.i) from (select unnest(string_split(pk, ',')) as name, generate_subscripts(string_split(pk, ','), 1) as i) c)"


_CHANGES = f"""
changes as (
  select * from (
    select n.*, {_OBJECT} as object, {_FILE} as file_no from normalized_change n)
  qualify row_number() over (partition by db_id, file_no, binlog_pos, row_no order by change_id) = 1),
keyed as (
  select c.*, {_key('before_image')} as old_key, {_key('after_image')} as new_key
  from (select c.*, m.pk_columns as pk from changes c join monitored_table m on m.object_name = c.object) c)"""

_P3 = f"""
with {_CHANGES},
steps as (
  select db_id, object, old_key as row_key, false as writes, file_no, binlog_pos, row_no, 0 as step, binlog_file from keyed where operation in ('UPDATE', 'DELETE')
  union all
  select db_id, object, new_key, true, file_no, binlog_pos, row_no, 1, binlog_file from keyed where operation in ('INSERT', 'UPDATE')),
last as (
  select * from steps where row_key is not null
  qualify row_number() over (partition by db_id, object, row_key order by file_no desc, binlog_pos desc, row_no desc, step desc) = 1)
select l.db_id, l.object as object_name, l.row_key, l.binlog_file, l.binlog_pos, l.row_no
from last l
where l.writes and not exists (
  select 1 from changes t where t.operation = 'TRUNCATE' and t.db_id = l.db_id and t.object = l.object
    and (t.file_no, t.binlog_pos, t.row_no) > (l.file_no, l.binlog_pos, l.row_no))
"""

_P3_ROWS = f"""
with image_of as (
  select db_id, {_FILE} as file_no, binlog_pos, row_no, arg_min(after_image, change_id) as image from normalized_change where operation in ('INSERT', 'UPDATE') group by all)
select p.*, i.image from ({_P3}) p join image_of i on i.db_id = p.db_id and i.file_no = cast(regexp_extract(p.binlog_file, '(\\d+)\\s*$', 1) as bigint) and i.binlog_pos = p.binlog_pos and i.row_no = p.row_no
"""

_ITEM = """
coalesce('dlq-' || nullif(regexp_replace(regexp_replace(lower(event_id), '\\s+', '', 'g'), '^dlq-', ''), ''),
  'dlq-' || left(sha256(coalesce(source_engine, '') || '|' || coalesce(offset_key, '') || '|sha256:' || regexp_replace(regexp_replace(lower(payload_hash), '\\s+', '', 'g'), '^sha256:', '')), 32))"""

_RANKED = f"""
with raw as (
  select delivery_id, row_number() over (
    partition by topic, split_part(bare, '-', 1)::hugeint, coalesce(nullif(split_part(bare, '-', 2), ''), '0')::hugeint
    order by received_at nulls last, delivery_id) as n
  from (select *, regexp_replace(stream_id, '\\s+', '', 'g') as bare from raw_source_event where trim(stream_id) <> '')),
dead as (
  select delivery_id, row_number() over (partition by item order by last_seen desc nulls last, delivery_id desc) as n
  from (select *, {_ITEM} as item from dlq) where item is not null)
"""

_P4 = _RANKED + """
select 'raw_source_event' as source_table, delivery_id from raw where n > 1
union all select 'dlq', delivery_id from dead where n > 1
"""

_P4_ONCE = _RANKED + """
select 'raw_source_event' as source_table, delivery_id from raw_source_event where delivery_id not in (select delivery_id from raw where n > 1)
union all select 'dlq', delivery_id from dlq where delivery_id not in (select delivery_id from dead where n > 1)
"""

_BARE = r"regexp_replace(lower({}), '^\s+|\s+$', '', 'g')"

_P5 = f"""
with {_CHANGES},
seen as (
  select db_id, object, coalesce(new_key, old_key) as entity_id, file_no, binlog_pos, row_no, epoch_ms(commit_ts) as ts, operation = 'DELETE' as ends,
    {_BARE.format("json_extract_string(after_image, '$.status')")} as value, before_image is not null as had, {_BARE.format("json_extract_string(before_image, '$.status')")} as before
  from keyed where object in ('users', 'beneficiaries') and operation in ('INSERT', 'UPDATE', 'DELETE')),
linked as (
  select *, row_number() over w as n, lag(ends) over w as prev_ends, lag(value) over w as prev_value from seen
  window w as (partition by db_id, object, entity_id order by file_no, binlog_pos, row_no)),
state as (
  select *, case when n = 1 then had else not prev_ends end as alive, case when n = 1 then before else prev_value end as was from linked),
points as (
  select db_id, object, entity_id, file_no, binlog_pos, row_no, 0 as step, -1 as ts, true as opens from state where n = 1 and had
  union all select db_id, object, entity_id, file_no, binlog_pos, row_no, 1, ts, false from state where ends and alive
  union all select db_id, object, entity_id, file_no, binlog_pos, row_no, 1, ts, true from state where not ends and (not alive or was is distinct from value)),
spans as (
  select db_id, object, entity_id, ts, opens, lead(ts, 1, -1) over (partition by db_id, object, entity_id order by file_no, binlog_pos, row_no, step) as until from points),
shots as (
  select db_id, id, snapshot_ts, {_BARE.format('status')} as value from users
  where id is not null and db_id is not null and snapshot_ts is not null
  qualify row_number() over (partition by db_id, id, snapshot_ts order by loaded_at desc nulls last, {_BARE.format('status')} desc nulls last) = 1),
starts as (
  select db_id, id, epoch_ms(snapshot_ts) as ts from shots where value is not null
  qualify lag(value) over (partition by db_id, id order by snapshot_ts) is distinct from value)
select 'changes' as origin, db_id, object as object_name, entity_id, ts as valid_from_ms, until as valid_to_ms from spans where opens
union all
select 'snapshots', db_id, 'users', cast(id as varchar), ts, lead(ts, 1, -1) over (partition by db_id, id order by ts) from starts
"""

_FIELDS = f"""
images as (
  select change_id, db_id, {_OBJECT} as object, {_FILE} as file_no, binlog_file, after_image from normalized_change where after_image is not null),
cells as (
  select i.*, k.name, json_extract(after_image, '$."' || k.name || '"') as value
  from images i, lateral (select unnest(json_keys(after_image)) as name) k),
typed as (
  select *, case json_type(value) when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind from cells),
fields as (
  select db_id, object, file_no, name, string_agg(distinct kind, '/' order by kind) as kinds from typed group by all),
versions as (
  select db_id, object, file_no, min(binlog_file) as binlog_file, lag(file_no) over (partition by db_id, object order by file_no) as prev_no from images group by db_id, object, file_no),
lost as (
  select v.*, f.name from versions v join fields f on f.db_id = v.db_id and f.object = v.object and f.file_no = v.prev_no
  where not exists (select 1 from fields g where g.db_id = v.db_id and g.object = v.object and g.file_no = v.file_no and g.name = f.name)),
new as (
  select v.*, f.name from versions v join fields f on f.db_id = v.db_id and f.object = v.object and f.file_no = v.file_no
  where v.prev_no is not null and not exists (select 1 from fields g where g.db_id = v.db_id and g.object = v.object and g.file_no = v.prev_no and g.name = f.name)),
pairs as (select l.db_id, l.object, l.file_no, l.name as lost, n.name as new from lost l join new n on n.db_id = l.db_id and n.object = l.object and n.file_no = l.file_no),
-- every value a row of such an object was ever written with
written as (
  select distinct t.db_id, t.object, t.file_no, t.name, t.value::varchar as value, {_key('after_image')} as row_key
  from (select t.*, m.pk_columns as pk from typed t join monitored_table m on m.object_name = t.object
    where t.kind is not null and (t.db_id, t.object, t.name) in (select (db_id, object, lost) from pairs union all select (db_id, object, new) from pairs)) t),
rows as (
  select p.db_id, p.object, p.file_no, p.lost, p.new, count(distinct a.row_key) as kept
  from pairs p
  join written a on a.db_id = p.db_id and a.object = p.object and a.name = p.lost and a.file_no < p.file_no
  join written b on b.db_id = p.db_id and b.object = p.object and b.name = p.new and b.file_no >= p.file_no and b.row_key = a.row_key and b.value = a.value
  group by all),
best as (
  select * from rows
  qualify row_number() over (partition by db_id, object, file_no, lost order by kept desc, new) = 1
    and row_number() over (partition by db_id, object, file_no, new order by kept desc, lost) = 1)"""

_P2 = f"""
with {_FIELDS}
select b.db_id, b.object as object_name, v.binlog_file, 'renamed' as change_kind, b.new as field_name, b.lost as old_name from best b join versions v on v.db_id = b.db_id and v.object = b.object and v.file_no = b.file_no
union all
select l.db_id, l.object, l.binlog_file, 'removed', l.name, '' from lost l where not exists (select 1 from best b where b.db_id = l.db_id and b.object = l.object and b.file_no = l.file_no and b.lost = l.name)
union all
select l.db_id, l.object, l.binlog_file, 'added', l.name, '' from new l where not exists (select 1 from best b where b.db_id = l.db_id and b.object = l.object and b.file_no = l.file_no and b.new = l.name)
union all
select v.db_id, v.object, v.binlog_file, 'retyped', f.name, '' from versions v
  join fields f on f.db_id = v.db_id and f.object = v.object and f.file_no = v.file_no
  join fields g on g.db_id = v.db_id and g.object = v.object and g.file_no = v.prev_no and g.name = f.name
where f.kinds <> g.kinds
"""

_P2_UNIFIED = f"""
with recursive {_FIELDS},
named as (
  select db_id, object, file_no, name, file_no as at_no, name as latest from fields
  union all
  select n.db_id, n.object, n.file_no, n.name, b.file_no, b.new from named n join best b on b.db_id = n.db_id and b.object = n.object and b.lost = n.latest and b.file_no > n.at_no
    and not exists (select 1 from best c where c.db_id = b.db_id and c.object = b.object and c.lost = b.lost and c.file_no > n.at_no and c.file_no < b.file_no)),
latest as (select db_id, object, file_no, name, arg_max(latest, at_no) as latest from named group by all),
moved as (
  select t.change_id, l.latest, t.value, l.latest = t.name as own from typed t join latest l on l.db_id = t.db_id and l.object = t.object and l.file_no = t.file_no and l.name = t.name where t.kind is not null),
one as (select * from moved m qualify own or not bool_or(own) over (partition by change_id, latest))
select i.change_id, i.db_id, i.object as object_name, i.binlog_file,
  (select '{{' || coalesce(string_agg(to_json(latest) || ':' || to_json(value ->> '$'), ',' order by latest), '') || '}}' from one o where o.change_id = i.change_id) as fields
from images i
"""

_STATE = lambda image: ", ".join(f"""{n} := {_BARE.format(f"json_extract_string({image}, '$.{n}')")}""" for n in VERSIONED)
_SHOT = ", ".join(f"{_BARE.format(n)} as {n}" for n in VERSIONED)
_HELD = ", ".join(f"last_value({n} ignore nulls) over w as {n}" for n in VERSIONED)
_NAMES = ", ".join(VERSIONED)

_P5_VERSIONS = f"""
with {_CHANGES},
seen as (
  select db_id, object, coalesce(new_key, old_key) as entity_id, file_no, binlog_pos, row_no, epoch_ms(commit_ts) as ts, operation = 'DELETE' as ends,
    struct_pack({_STATE('after_image')}) as value, before_image is not null as had, struct_pack({_STATE('before_image')}) as before
  from keyed where object in ('users', 'beneficiaries') and operation in ('INSERT', 'UPDATE', 'DELETE')),
linked as (
  select *, row_number() over w as n, lag(ends) over w as prev_ends, lag(value) over w as prev_value from seen
  window w as (partition by db_id, object, entity_id order by file_no, binlog_pos, row_no)),
state as (
  select *, case when n = 1 then had else not prev_ends end as alive, case when n = 1 then before else prev_value end as was from linked),
points as (
  select db_id, object, entity_id, file_no, binlog_pos, row_no, 0 as step, -1 as ts, true as opens, before as value from state where n = 1 and had
  union all select db_id, object, entity_id, file_no, binlog_pos, row_no, 1, ts, false, null from state where ends and alive
  union all select db_id, object, entity_id, file_no, binlog_pos, row_no, 1, ts, true, value from state where not ends and (not alive or was is distinct from value)),
spans as (
  select *, lead(ts, 1, -1) over (partition by db_id, object, entity_id order by file_no, binlog_pos, row_no, step) as until from points),
shots as (
  select db_id, id, snapshot_ts, {_SHOT} from users where id is not null and db_id is not null and snapshot_ts is not null
  qualify row_number() over (partition by db_id, id, snapshot_ts order by loaded_at desc nulls last, {", ".join(_BARE.format(n) + " desc nulls last" for n in VERSIONED)}) = 1),
held as (select db_id, id, snapshot_ts, {_HELD} from shots window w as (partition by db_id, id order by snapshot_ts rows between unbounded preceding and current row)),
starts as (
  select *, epoch_ms(snapshot_ts) as ts from held where coalesce({_NAMES}) is not null
  window w as (partition by db_id, id order by snapshot_ts)
  qualify row_number() over w = 1 or lag(row({_NAMES})) over w is distinct from row({_NAMES}))
select 'changes' as origin, db_id, object as object_name, entity_id, {", ".join("value." + n for n in VERSIONED)}, ts as valid_from_ms, until as valid_to_ms from spans where opens
union all
select 'snapshots', db_id, 'users', cast(id as varchar), {_NAMES}, ts, lead(ts, 1, -1) over (partition by db_id, id order by ts) from starts
"""

ORACLES = {"p1_found": _P1, "p1_schema_graph": _P1_GRAPH, "p1_refused": _P1_REFUSED, "p2_found": _P2, "p2_unified": _P2_UNIFIED, "p3_found": _P3, "p3_rows": _P3_ROWS, "p4_found": _P4, "p4_once": _P4_ONCE, "p5_found": _P5, "p5_versions": _P5_VERSIONS}
