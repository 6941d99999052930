"""Graphs made of the test tables, defined once as a plan and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.plans.files import PATH_SQL
from triloom.session import table


def code_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes (fn_id, node_id, type, code, seq) of each function, and edges to the next node (FLOWS_TO), to the one after it
    (REACHES), and a parallel one to the next node if that is a symbol (USE)."""
    raw = table(spark, d, "nodes").where("fn_id is not null and node_id is not null")
    n = raw.groupBy("fn_id", "node_id").agg(F.max(F.coalesce("type", F.lit(""))).alias("type"), F.max(F.coalesce("code", F.lit(""))).alias("code"))
    w = Window.partitionBy("fn_id").orderBy(F.col("node_id").cast("long"), "node_id")
    n = n.withColumn("seq", F.row_number().over(w))
    step = n.select("fn_id", F.col("node_id").alias("src"), *[F.lead("node_id", k).over(w).alias(f"n{k}") for k in (1, 2)], F.lead("type").over(w).alias("t1"))
    use = F.when(F.col("t1") == "Symbol", F.col("n1"))
    ends = F.array(*[F.struct(x.alias("dst"), F.lit(r).alias("rel")) for x, r in ((F.col("n1"), "FLOWS_TO"), (F.col("n2"), "REACHES"), (use, "USE"))])
    e = step.select("fn_id", "src", F.inline(ends)).where("dst is not null")
    return n, e


GRAPH_SQL = """
gn as (select fn_id, node_id, max(coalesce(type, '')) as type, max(coalesce(code, '')) as code from nodes where fn_id is not null and node_id is not null group by fn_id, node_id),
gs as (select *, row_number() over (partition by fn_id order by node_id::bigint, node_id) as seq from gn),
gl as (select fn_id, node_id as src, lead(node_id) over w as n1, lead(node_id, 2) over w as n2, lead(type) over w as t1 from gn window w as (partition by fn_id order by node_id::bigint, node_id)),
ge as (select fn_id, src, n1 as dst, 'FLOWS_TO' as rel from gl where n1 is not null union all select fn_id, src, n2, 'REACHES' from gl where n2 is not null
  union all select fn_id, src, n1, 'USE' from gl where t1 = 'Symbol'),
g1 as (select fn_id, src, dst, min(rel) as rel from ge group by fn_id, src, dst)"""


def token_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes of each document: its tokens between white space, with a type by form and length; edges to the next and the one after."""
    words = table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("fn_id"), F.posexplode(F.split("text", r"[ \n\r\t]+")).alias("seq", "code")).where("code <> ''")
    kind = F.when(F.col("code").rlike("^[0-9]+"), "Number").when(F.col("code").rlike("[.,;:!?]$"), "Stop").when(F.length("code") <= 3, "Short").when(F.length("code") <= 6, "Mid").otherwise("Long")
    n = words.select("fn_id", F.col("seq").cast("string").alias("node_id"), kind.alias("type"), "code", "seq")
    w = Window.partitionBy("fn_id").orderBy("seq")
    step = n.select("fn_id", F.col("node_id").alias("src"), F.col("type").alias("type1"), F.col("code").alias("code1"), *[F.lead(F.struct("node_id", "type", "code"), k).over(w).alias(f"n{k}") for k in (1, 2)])
    ends = F.array(F.struct(F.col("n1").alias("x"), F.lit("FLOWS_TO").alias("rel")), F.struct(F.col("n2").alias("x"), F.lit("REACHES").alias("rel")))
    e = step.select("fn_id", "src", "type1", "code1", F.inline(ends)).where("x is not null").select("fn_id", "src", F.col("x.node_id").alias("dst"), "rel", "type1", "code1", F.col("x.type").alias("type2"), F.col("x.code").alias("code2"))
    return n, e


TOKEN_SQL = r"""
tw as (select doc_id::varchar as fn_id, unnest(string_split_regex(text, '[ \n\r\t]+')) as code, generate_subscripts(string_split_regex(text, '[ \n\r\t]+'), 1) as seq from documents where doc_id is not null),
tn as (select fn_id, seq, code, case when regexp_matches(code, '^[0-9]+') then 'Number' when regexp_matches(code, '[.,;:!?]$') then 'Stop' when length(code) <= 3 then 'Short' when length(code) <= 6 then 'Mid' else 'Long' end as type from tw where code <> ''),
tl as (select fn_id, seq, type, code, lead(type) over w as t1, lead(code) over w as c1, lead(type, 2) over w as t2, lead(code, 2) over w as c2 from tn window w as (partition by fn_id order by seq)),
te as (select fn_id, type as type1, code as code1, 'FLOWS_TO' as rel, t1 as type2, c1 as code2 from tl where t1 is not null union all select fn_id, type, code, 'REACHES', t2, c2 from tl where t2 is not null)"""

_AT = "string_split(p, '/')"
TARGET_SQL = f"""
tg0 as (select fn_id, code, {PATH_SQL} as p, row_number() over (partition by fn_id order by loaded_at desc nulls last, path desc, code desc nulls last) as r from funcs where fn_id is not null and path is not null),
tg as (select fn_id, {_AT}[-7] as repo, {_AT}[-6] as cve, {_AT}[-5] as role, {_AT}[-4] as hsh, {_AT}[-3] as file, regexp_replace({_AT}[-1], '\\.gpickle$', '') as func,
  try_cast(string_split({_AT}[-4], '_')[2] as bigint) as epoch, p as path, code from tg0 where r = 1),
sv as (select repo, cve, hsh, file, func, min(fn_id) as v_id from tg where role = 'vuln' group by all),
sp as (select repo, cve, hsh, file, func, min(fn_id) as p_id from tg where role = 'patch' group by all),
sig as (select v_id as sig_id, sv.repo, sv.cve, sv.hsh, sv.file, sv.func, v_id, p_id from sv join sp on sv.repo = sp.repo and sv.cve = sp.cve and sv.hsh = sp.hsh and sv.file = sp.file and sv.func = sp.func)"""
PARTS_SQL = """
tr as (select distinct fn_id, a, rel, b from triples where fn_id is not null and a is not null and rel is not null and b is not null),
pa as (select sig_id, a, rel, b, bool_or(fn_id = v_id) as v, bool_or(fn_id = p_id) as p from sig join tr on fn_id = v_id or fn_id = p_id group by sig_id, a, rel, b),
pt as (select sig_id, case when v and p then 'cvg' when v then 'pvg' else 'nvg' end as part, a, rel, b from pa),
ok as (select sig_id from pt group by sig_id having count(distinct part) = 3),
ap as (select * from pt where sig_id in (select sig_id from ok)),
sz as (select sig_id, count(*) filter (where part = 'cvg') as nc, count(*) filter (where part = 'pvg') as np, count(*) filter (where part = 'nvg') as nn from ap group by sig_id)"""
SCORE_SQL = """
sc as (select m.sig_id, target_id, 100.0::double * c / nc as cvg, 100.0::double * p / np as pvg, 100.0::double * n / nn as nvg
  from (select sig_id, fn_id as target_id, count(*) filter (where part = 'cvg') as c, count(*) filter (where part = 'pvg') as p, count(*) filter (where part = 'nvg') as n
    from ap join tr on ap.a = tr.a and ap.rel = tr.rel and ap.b = tr.b group by sig_id, fn_id) m join sz on sz.sig_id = m.sig_id),
hs as (select * from sc where cvg > 50 and pvg > 50 and nvg < 50),
he as (select * from sc where cvg >= 25 and pvg >= 60 and pvg > nvg)"""
LABEL_SQL = """
lb as (select row_number() over (partition by cve order by repo) as line_no, case when length(repo) % 2 = 0 then 'TP' else 'FP' end as verdict, cve, '/' || repo || '/' as path_part from (select distinct cve, repo from tg))"""
VERDICT_SQL = """
vr as (select fn_id as target_id, he.sig_id, path, role,
  case when he.sig_id is null then case when contains(path, '/patch/') or contains(path, '/after/') then 'TN' else 'FN' end
    when contains(path, sig.cve) and (contains(path, '/vuln/') or contains(path, '/before/')) then 'TP'
    when contains(path, sig.cve) and (contains(path, '/patch/') or contains(path, '/after/')) then 'FP'
    when tg.func = sig.func and tg.epoch < try_cast(string_split(sig.hsh, '_')[2] as bigint) then 'TP'
    else coalesce((select case when arg_min(verdict, line_no) = 'TP' then 'TP' when count(*) > 0 then 'FP' end from lb where lb.cve = sig.cve and contains(tg.path, lb.path_part)), 'UNK') end as verdict
  from tg left join he on he.target_id = tg.fn_id left join sig on sig.sig_id = he.sig_id)"""


def labels(tg: DataFrame) -> DataFrame:
    """Stand-in for manual labels: for each CVE and repo a verdict that follows from the repo's name."""
    pairs = tg.select("cve", "repo").distinct()
    order = F.row_number().over(Window.partitionBy("cve").orderBy("repo"))  # labels of one CVE are compared with each other only
    return pairs.select(order.alias("line_no"), F.when(F.length("repo") % 2 == 0, "TP").otherwise("FP").alias("verdict"), "cve", F.concat(F.lit("/"), "repo", F.lit("/")).alias("path_part"))
