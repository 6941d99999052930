"""The queries of this subpackage over the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.llm import chunking, frequency, leakage, mixture, neardup, overlap, syntax, vectors
from triloom.session import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    triples = frequency.term_frequency(table(spark, d, "triples"), "fn_id", ["a", "b"]).select(F.lit("triples").alias("field"), "*")
    nodes = frequency.term_frequency(table(spark, d, "nodes"), "fn_id", ["type"], empty=False).select(F.lit("nodes").alias("field"), "*")
    return triples.unionByName(nodes)


def p2_found(spark, d):
    return _terms(spark, d).where("mark is not null").select("field", "term")


def p2_terms(spark, d):
    return _terms(spark, d)


def p3_found(spark, d):
    return neardup.near_duplicates(table(spark, d, "triples"), t=0.7)


def p3_groups(spark, d):
    return neardup.near_duplicate_groups(table(spark, d, "triples"), t=0.7)


def p4_found(spark, d):
    return vectors.neighbour_pairs(vectors.nearest_neighbours(table(spark, d, "vectors")))


def p4_neighbours(spark, d):
    return vectors.nearest_neighbours(table(spark, d, "vectors"))


def _alike(spark, d):
    return overlap.alike(table(spark, d, "triples"), table(spark, d, "funcs"))


def p5_found(spark, d):
    return overlap.pairs(_alike(spark, d)).select("fn_a", "fn_b")


def p5_report(spark, d):
    return overlap.overlap_report(_alike(spark, d), table(spark, d, "funcs"))


def p5_overlaps(spark, d):
    return overlap.overlaps(_alike(spark, d))


def p5_classes(spark, d):
    # without the fractions, which follow from hashes, but with what must hold for them
    sound = [F.col(f"overlap_{x}").between(0, F.col("both") / F.col(f"n_{x}") + 1e-9) for x in "ab"]
    rows = overlap.overlaps(_alike(spark, d)).select("fn_a", "fn_b", "n_a", "n_b", "both", (sound[0] & sound[1]).alias("sound"))
    swap = F.col("fn_a") > F.col("fn_b")
    return rows.select(*[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("fn", "n") for x, y in (("a", "b"), ("b", "a"))], "both", "sound").distinct()


def p7_found(spark, d):
    return syntax.check_sources(table(spark, d, "vuln_patch_src_db")).where("invalid").select("src_id")


def p7_files(spark, d):
    return syntax.check_sources(table(spark, d, "vuln_patch_src_db"))


def p7_rates(spark, d):
    return syntax.error_rates(syntax.check_sources(table(spark, d, "vuln_patch_src_db")))


def p7_json(spark, d):
    return syntax.check_sources(table(spark, d, "vuln_patch_src_db")).where("language = 'json' and invalid is not null").select("src_id", "invalid")


def p8_found(spark, d):
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("kind = 'exact'").select("doc_id", "item_id")


def p8_leaks(spark, d):
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[1].where("short").select("source")


def p9_shares(spark, d):
    return mixture.shares(mixture.mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[1])


def p9_sequence(spark, d):
    return mixture.ordered(mixture.mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[0])


def p9_checks(spark, d):
    """For each source what follows from its documents, and whether the sequence keeps to it: no document in a round twice or beyond its
    repeats, positions within 0 and 1, and as many tokens as asked for or there are, to the length of one document.
    A source without documents has none to place."""
    weights = table(spark, d, "source_weights")
    sequence, report = mixture.mix(table(spark, d, "documents"), weights)
    used = sequence.groupBy("source", "doc_id", "round").agg(F.count("*").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.max("n_tokens").alias("size"))
    per = used.groupBy("source").agg(F.max("n").alias("n"), F.max("round").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"))
    rows = report.join(weights.select("source", "max_repeats"), "source").join(per, "source", "left")
    least = F.least(F.col("demand_tokens"), F.col("tokens") * F.col("max_repeats"))
    sound = (F.col("n") == 1) & (F.col("last") < F.col("max_repeats")) & F.col("lo").between(0, 1) & F.col("hi").between(0, 1) & (F.col("placed_tokens") >= least) & (F.col("placed_tokens") < least + F.col("size") + 1)
    return rows.select("source", "target_permille", "tokens", "short", F.when(F.col("n").isNull(), least == 0).otherwise(sound).alias("sound"))


def p10_checks(spark, d):
    """For each split text whether its pieces make it up, keep the limit and share what they must."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    rows = chunking.split_texts(table(spark, d, "documents")).join(docs, "doc_id")
    good = (F.col("text") == F.expr("substring(body, int(start) + 1, int(stop - start))")) & (F.col("n_tokens") <= 900) & (F.col("n_overlap") == F.when(F.col("piece_no") == 0, 0).otherwise(60)) & (F.col("start") <= F.col("core_start"))
    per = rows.groupBy("doc_id").agg(F.bool_and(good).alias("good"), F.sum(F.col("stop") - F.col("core_start")).alias("held"), F.min("core_start").alias("lo"), F.max("stop").alias("hi"), F.count("*").alias("n"), F.max("n_pieces").alias("n_pieces"), F.max(F.length("body")).cast("long").alias("n_chars"))
    whole = F.col("good") & (F.col("held") == F.col("n_chars")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_chars")) & (F.col("n") == F.col("n_pieces"))
    return per.select("doc_id", "n_chars", whole.alias("whole"))


def p10_found(spark, d):
    # the second piece of a text is there if and only if the text was split
    return chunking.split_texts(table(spark, d, "documents"), with_text=False).where("piece_no = 1").select("doc_id")


def p10_pieces(spark, d):
    return chunking.split_texts(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p2_found, p2_terms, p3_found, p3_groups, p4_found, p4_neighbours, p5_found, p5_report, p5_overlaps, p5_classes, p7_found, p7_files, p7_rates, p7_json, p8_found, p8_leaks, p9_found, p9_shares, p9_sequence, p9_checks, p10_found, p10_pieces, p10_checks)
    return {f.__name__: f for f in own}


_TERMS = """
with v as (select 'triples' as field, fn_id, a as term from triples union all select 'triples', fn_id, b from triples
  union all select 'nodes', fn_id, nullif(type, '') from nodes),
n as (select 'triples' as field, count(distinct fn_id) as n from triples union all select 'nodes', count(distinct fn_id) from nodes),
c as (select field, term, count(*) as n_occurrences, count(distinct fn_id) as n_records from v where term is not null and fn_id is not null group by field, term),
t as (select c.field, term, n_occurrences, n_records,
  case when n_records <= 2 then 'rare' when 4 * n_records > n.n then 'common' end as mark from c join n on n.field = c.field)
"""
_PAIRS = """
with s as (select distinct fn_id, a, rel, b from triples where fn_id is not null and a is not null and rel is not null and b is not null),
z as (select fn_id, count(*) as n from s group by fn_id),
i as (select x.fn_id as fn_a, y.fn_id as fn_b, count(*) as n from s x join s y on x.a = y.a and x.rel = y.rel and x.b = y.b and x.fn_id < y.fn_id group by x.fn_id, y.fn_id),
p as (select fn_a, fn_b, i.n * 1.0::double / (za.n + zb.n - i.n) as j from i join z za on za.fn_id = fn_a join z zb on zb.fn_id = fn_b)
"""
_GROUPS = """,
e as (select fn_a as a, fn_b as b, j from p where j >= 0.7 - 1e-12 union all select fn_b, fn_a, j from p where j >= 0.7 - 1e-12),
c as (select z.fn_id, least(z.fn_id, coalesce(min(b) filter (where j = 1), z.fn_id)) as class_rep, 1 + count(b) filter (where j = 1) as n_copies from z left join e on a = z.fn_id group by z.fn_id),
l as (select x.class_rep, count(distinct y.class_rep) as n from e join c x on x.fn_id = a join c y on y.fn_id = b where x.class_rep <> y.class_rep group by x.class_rep),
t as (select fn_id as node, fn_id as seen from z union select t.node, e.b from t join e on e.a = t.seen),
g as (select node, min(seen) as group_rep from t group by node)
select c.fn_id, c.class_rep, n_copies, coalesce(l.n, 0) as n_links, group_rep from c left join l on l.class_rep = c.class_rep join g on g.node = c.fn_id
"""
_ROLES = r""",
r as (select distinct fn_id, case when role in ('vuln', 'patch') then 'train' when role in ('before', 'after') then 'eval' end as split
  from (select fn_id, regexp_extract(replace(path, '\', '/'), '([^/]+)/+[0-9a-fA-F]+_[0-9]+/+[^/]+/+graph/', 1) as role from funcs)),
f as (select distinct fn_a, fn_b, ra.split as split_a, rb.split as split_b from p join r ra on ra.fn_id = fn_a join r rb on rb.fn_id = fn_b where j >= 0.9 - 1e-12 and ra.split <> rb.split)
"""
_NEAREST = """
with v as (select fn_id, min(vec) as vec from vectors where vec is not null and len(vec) = 79 group by fn_id),
d as (select x.fn_id as f, y.fn_id as g, list_sum(list_transform(list_zip(x.vec, y.vec), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as d from v x join v y on x.fn_id <> y.fn_id),
k as (select f, g, d, row_number() over (partition by f order by d, g) as r from d)
"""
_TOKENS = r"length(regexp_replace(regexp_replace(regexp_replace({}, '[\pL\pN_]+', 'a', 'g'), '[^\pL\pN_\s\x{{85}}\x{{A0}}]+', 'b', 'g'), '[\s\x{{85}}\x{{A0}}]+', '', 'g'))"
_SUMS = f"""
with t as (select w.source, w.target_permille, w.max_repeats, coalesce(sum({_TOKENS.format('d.text')}), 0)::bigint as tokens
  from source_weights w left join documents d on lower(trim(d.source, ' ')) = lower(trim(w.source, ' ')) group by all)
"""
_WORDS = r"""
with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda x: x <> '') as w from documents),
i as (select item_id, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda x: x <> '') as w from eval_items),
di as (select doc_id, unnest(range(1, len(w) - 11)) as k, w from d where len(w) >= 13),
ii as (select item_id, unnest(range(1, len(w) - 11)) as k, w from i where len(w) >= 13),
g as (select distinct item_id, array_to_string(list_slice(w, k, k + 12), ' ') as t from ii)
select distinct doc_id, item_id from (select doc_id, array_to_string(list_slice(w, k, k + 12), ' ') as t from di) join g using (t)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _TERMS + "select field, term from t where mark is not null",
        "p2_terms": _TERMS + "select field, term, n_occurrences, n_records, mark from t",
        "p3_found": _PAIRS + "select fn_a, fn_b from p where j >= 0.7 - 1e-12",
        "p3_groups": _PAIRS.replace("with s as", "with recursive s as") + _GROUPS,
        "p4_found": _NEAREST + "select distinct least(f, g) as fn_a, greatest(f, g) as fn_b from k where r <= 5",
        "p4_neighbours": _NEAREST + "select f as fn_id, g as neighbour, d::bigint as d2, r as rank from k where r <= 5",
        "p5_found": _PAIRS + _ROLES + "select distinct fn_a, fn_b from f",
        "p5_report": _PAIRS + _ROLES + ", x as (select fn_a as fn_id, split_a as split, fn_b as other from f union all select fn_b, split_b, fn_a from f) select split, repo, count(distinct fn_id) as n_records, count(*) as n_pairs from x join (select distinct fn_id, repo from funcs) using (fn_id) group by split, repo",
        "p5_classes": _PAIRS + _ROLES + """, q as (select fn_id, 1 as k from r where split is not null group by fn_id), eq as (select z.fn_id, least(z.fn_id, coalesce(min(o), z.fn_id)) as rep from z join q using (fn_id) left join (select fn_a as s, fn_b as o from p where j = 1 union all select fn_b, fn_a from p where j = 1) e on e.s = z.fn_id and e.o in (select fn_id from q) group by z.fn_id),
g as (select distinct least(x.rep, y.rep) as fn_a, greatest(x.rep, y.rep) as fn_b from f join eq x on x.fn_id = f.fn_a join eq y on y.fn_id = f.fn_b where x.rep <> y.rep)
select g.fn_a, g.fn_b, za.n as n_a, zb.n as n_b, i.n as "both", true as sound from g join z za on za.fn_id = g.fn_a join z zb on zb.fn_id = g.fn_b join i on i.fn_a = g.fn_a and i.fn_b = g.fn_b""",
        "p7_json": "select src_id, not json_valid(content) as invalid from vuln_patch_src_db where content is not null and lower(regexp_extract(curr_file, '[.][^./]*$')) = '.json'",
        "p8_found": _WORDS,
        "p9_found": _SUMS + "select source from t where max_repeats * tokens * 1000 < target_permille * (select sum(tokens) from t)",
        "p9_checks": _SUMS + "select source, target_permille::bigint as target_permille, tokens, max_repeats * tokens * 1000 < target_permille * (select sum(tokens) from t) as short, true as sound from t",
        "p10_checks": f"select doc_id, length(text) as n_chars, true as whole from documents where {_TOKENS.format('text')} > 900",
        "p10_found": f"select doc_id from documents where {_TOKENS.format('text')} > 900",
    }
