"""Queries on stored files and raw lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from triloom.functions.vocab import NODE_TYPES
from triloom.operators import compact, rejects
from triloom.session import table


def p1_found(spark, d):
    files = table(spark, d, "graph_files")
    return compact.left_out(files, compact.compact(files))


def p1_packed(spark, d):
    return compact.compact(table(spark, d, "graph_files")).read().select("file_no", "path", "func", "n_bytes", "body")


def p1_manifest(spark, d):
    # how rows are spread over files depends on sizes and settings; the totals don't
    return compact.compact(table(spark, d, "graph_files")).manifest.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.max("longest").alias("longest"))


def p6_found(spark, d):
    return rejects.rejected(rejects.check_node_lines(table(spark, d, "node_lines"))).select("line_id")


def p6_rejects(spark, d):
    return rejects.rejected(rejects.check_node_lines(table(spark, d, "node_lines"))).select("line_id", "nodes_path", "line_no", "reason", "n_columns", "cell")


def p6_nodes(spark, d):
    return rejects.valid_nodes(rejects.check_node_lines(table(spark, d, "node_lines")))


def p6_summary(spark, d):
    checked = rejects.check_node_lines(table(spark, d, "node_lines"))
    return checked.groupBy("nodes_path").agg(F.count("*").alias("n_lines"), F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))


QUERIES = {f.__name__: f for f in (p1_found, p1_packed, p1_manifest, p6_found, p6_rejects, p6_nodes, p6_summary)}

_UP = r"'(^|/)([^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\./', '\1'"
PATH_SQL = r"regexp_replace(replace(path, '\', '/'), '/+', '/', 'g')"
for _ in range(6):
    PATH_SQL = rf"regexp_replace({PATH_SQL}, '(^|/)(\./)+', '\1', 'g')"
    PATH_SQL = f"regexp_replace({PATH_SQL}, {_UP})"
_KEYS = rf"with k as (select file_no, path, func, n_bytes, {PATH_SQL} as p, regexp_replace(func, '^\s+|\s+$', '', 'g') as f, body from graph_files), m as (select p, f, body, min(file_no) as keep from k group by p, f, body)"
_F = '(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*)?'
_TYPES = ", ".join(f"'{t}'" for t in NODE_TYPES)
LINES_SQL = rf"""with l as (select line_id, nodes_path, regexp_replace(line, '\r$', '') as s from node_lines where line_no is distinct from 1),
q as (select *, regexp_full_match(s, '(?s){_F}(\t{_F}){{5}}') as six from l),
c as (select line_id, nodes_path, six, regexp_extract_all('	' || s, '(?s)\t({_F})', 1) as c from q),
u as (select line_id, nodes_path, six, list_transform(c, lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) as c from c),
v as (select line_id, nodes_path, coalesce(six and regexp_full_match(c[2], '[0-9]+') and c[3] in ({_TYPES}) and not regexp_matches(c[4], '[\x{{FFFD}}\x00-\x08\x0a-\x1f\x7f]')
  and regexp_full_match(c[5], '([0-9]+:[0-9]+:[0-9]+:[0-9]+)?') and regexp_full_match(c[6], '[0-9]*'), false) as ok from u)
"""
SQL = {
    "p1_found": _KEYS + " select file_no from k join m on k.p = m.p and k.f is not distinct from m.f and k.body = m.body where file_no > keep",
    "p1_packed": _KEYS + " select file_no, path, func, n_bytes, k.body from k join m on k.p = m.p and k.f is not distinct from m.f and k.body = m.body where file_no = keep",
    "p1_manifest": _KEYS + " select count(*) as n_rows, sum(coalesce(strlen(k.body), 0))::bigint as n_bytes, max(coalesce(strlen(k.body), 0)) as longest from k join m on k.p = m.p and k.f is not distinct from m.f and k.body = m.body where file_no = keep",
    "p6_nodes": LINES_SQL + "select u.line_id, u.nodes_path, n.line_no, c[1] as command, try_cast(c[2] as bigint) as node_key, c[3] as type, c[4] as code, c[5] as location, try_cast(nullif(c[6], '') as bigint) as function_id from u join v on v.line_id = u.line_id join node_lines n on n.line_id = u.line_id where ok",
    "p6_rejects": LINES_SQL.replace("as six from l", f"as six, regexp_full_match(s, '(?s){_F}(\\t{_F})*') as sound from l") + """, e as (select q.line_id, q.nodes_path, n.line_no, q.s, q.sound, q.six, c, case when q.s is null then 'null line' when not q.sound then 'quoting' when not q.six then 'columns'
    when not regexp_full_match(c[2], '[0-9]+') then 'key' when c[3] not in (""" + _TYPES + """) then 'type' when regexp_matches(c[4], '[\\x{FFFD}\\x00-\\x08\\x0a-\\x1f\\x7f]') then 'code'
    when not regexp_full_match(c[5], '([0-9]+:[0-9]+:[0-9]+:[0-9]+)?') then 'location' when not regexp_full_match(c[6], '[0-9]*') then 'function_id' end as reason
  from q left join u on u.line_id = q.line_id left join node_lines n on n.line_id = q.line_id)
select line_id, nodes_path, line_no, reason, case when reason in ('null line', 'quoting') then 0 when reason = 'columns' then len(c) else 6 end as n_columns,
  case reason when 'quoting' then s when 'columns' then s when 'key' then c[2] when 'type' then c[3] when 'code' then c[4] when 'location' then c[5] when 'function_id' then c[6] end as cell from e where reason is not null""",
    "p6_found": LINES_SQL + "select line_id from v where not ok",
    "p6_summary": LINES_SQL + "select nodes_path, count(*) as n_lines, count(*) filter (where not ok) as n_rejected from v group by nodes_path",
}
