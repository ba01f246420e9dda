"""Queries of likeness of code, search by vectors, packs of rules and named questions, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import code, packs, select
from stratagraph.plans import views as v
from stratagraph.plans.views import with_views as sql
from stratagraph.queries import lookups, relations
from stratagraph.queries.registry import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add


def _functions(t):
    return v.nodes(t, "id", "project_id", "type").where("type in ('function', 'method')").select("id").join(t("cas_node").where("source.raw is not null").groupBy("id").agg(F.max("source.raw").alias("raw")), "id")


add("minhash_signatures", lambda t: code.signatures(_functions(t), "id", "raw").select("id", F.size("sketch").alias("hashes"), F.array_min("sketch").alias("least")))
add("clone_report", lambda t: code.clones(_functions(t), "id", "raw"))
add("node_vectors", lambda t: code.embedded(v.nodes(t, "id", "name", "qualified_name", "description").select("id", F.concat_ws(" ", "name", "qualified_name", "description").alias("text")), "id", "text").select("id", F.size("embedding").alias("width")))


def semantic(t, query: str = "resolve the ledger"):
    n = v.nodes(t, "id", "name", "qualified_name", "description").select("id", "name", F.concat_ws(" ", "name", "qualified_name", "description").alias("text"))
    words = [w for w in query.lower().split() if len(w) > 2]
    hits = F.size(F.array_intersect(F.array(*map(F.lit, words)), fx.search_tokens(F.col("text"))))
    from pyspark.sql import Window as W

    lexical = n.select("id", hits.alias("hits")).where("hits > 0").orderBy(F.col("hits").desc(), "id").limit(60)
    ranked = lexical.withColumn("rank", F.row_number().over(W.orderBy(F.col("hits").desc(), "id")) - 1)  # at most 60 rows
    return code.semantic_search(code.embedded(n, "id", "text"), ranked, query, "id")


add("semantic_search", semantic)


def _similar_to(t, limit=10):
    """The units most like the most called one: .3 for its type, .2 for its parent, .2 per shared tag, .1 per shared word; the best 10, of these those above .2."""
    target = F.broadcast(v.nodes(t, "id", "name", "type", "parent", "tags").join(v.calls(t).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")), "id").orderBy(F.col("n").desc(), "id").limit(1).select(F.col("id").alias("t_id"), F.col("type").alias("t_type"), F.col("parent").alias("t_parent"), F.coalesce("tags", F.array()).alias("t_tags"), fx.search_tokens(F.col("name")).alias("t_words")))  # one row
    n = v.nodes(t, "id", "name", "type", "parent", "tags").join(target, (F.col("type") == F.col("t_type")) & (F.col("id") != F.col("t_id")))
    shared = lambda a, b: F.size(F.array_intersect(F.array_distinct(a), b))
    score = F.lit(0.3) + F.when(F.col("parent") == F.col("t_parent"), 0.2).otherwise(0.0) + F.lit(0.2) * shared(F.coalesce("tags", F.array()), F.col("t_tags")) + F.lit(0.1) * shared(fx.search_tokens(F.col("name")), F.col("t_words"))
    first = select.page(n.select("id", F.round(score, 6).alias("score")), [F.col("score").desc(), "id"], limit)
    return first.where("score > 0.2").select("id", F.least(F.col("score"), F.lit(1.0)).alias("score"), F.when(F.col("score") > 0.7, "extract").when(F.col("score") > 0.4, "copy pattern").otherwise("reference").alias("advice"))


_TOKENS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-./]', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
add(
    "similar_code",
    _similar_to,
    sql(
        f"""WITH h AS (SELECT target AS id FROM calls JOIN (SELECT DISTINCT id FROM nodes) n ON n.id = target GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), x AS (SELECT n.* FROM nodes n JOIN h USING (id)),
        s AS (SELECT n.id, round(0.3::DOUBLE + CASE WHEN n.parent = x.parent THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE * len(list_intersect(list_distinct(coalesce(n.tags, [])), list_distinct(coalesce(x.tags, [])))) + 0.1::DOUBLE * len(list_intersect(list_distinct({_TOKENS.format('n.name')}), list_distinct({_TOKENS.format('x.name')}))), 6) AS score FROM nodes n, x WHERE n.type = x.type AND n.id <> x.id),
        f AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 10) SELECT id, least(score, 1.0::DOUBLE) AS score, CASE WHEN score > 0.7 THEN 'extract' WHEN score > 0.4 THEN 'copy pattern' ELSE 'reference' END AS advice FROM f WHERE score > 0.2""",
        "nodes",
        "calls",
    ),
)

PACKS = [
    {"name": "python-units", "language": "python", "applies_when": {"file": ".py"}, "rules": [{"name": "functions", "pattern": r"def (\w+)\((\w*)", "emit": [{"kind": "entity", "name": "$1", "detail": "first $2"}]}, {"name": "imports", "pattern": r"from (\w+) import (\w+)", "emit": [{"kind": "edge", "name": "$1.$2", "detail": "import"}]}]},
    {"name": "go-units", "language": "go", "applies_when": {"import": "package "}, "rules": [{"name": "methods", "pattern": r"func \(s \*(\w+)\) (\w+)\(", "emit": [{"kind": "binding", "name": "$1.$2", "detail": "method"}]}]},
    {"name": "cobol-units", "language": "cobol", "applies_when": {"file": ".cbl"}, "rules": [{"name": "divisions", "pattern": r"(\w+) DIVISION", "emit": [{"kind": "role", "name": "$1"}]}]},
]


def _facts(t):
    files = t("in_flight_diff_file")
    return packs.facts(files, packs.applying(packs.rules_of(t.spark, PACKS), files), "diff_id")


_LANG = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"
add(
    "pack_facts",
    _facts,
    rf"""WITH m AS (
      SELECT diff_id, 'python-units' AS pack, 'functions' AS rule, 'entity' AS kind, regexp_extract(x, 'def (\w+)\((\w*)', 1) AS name, 'first ' || regexp_extract(x, 'def (\w+)\((\w*)', 2) AS detail FROM (SELECT diff_id, unnest(regexp_extract_all(content, 'def (\w+)\((\w*)')) AS x FROM in_flight_diff_file WHERE {_LANG} = 'py')
      UNION ALL SELECT diff_id, 'python-units', 'imports', 'edge', regexp_extract(x, 'from (\w+) import (\w+)', 1) || '.' || regexp_extract(x, 'from (\w+) import (\w+)', 2), 'import' FROM (SELECT diff_id, unnest(regexp_extract_all(content, 'from (\w+) import (\w+)')) AS x FROM in_flight_diff_file WHERE {_LANG} = 'py')
      UNION ALL SELECT diff_id, 'go-units', 'methods', 'binding', regexp_extract(x, 'func \(s \*(\w+)\) (\w+)\(', 1) || '.' || regexp_extract(x, 'func \(s \*(\w+)\) (\w+)\(', 2), 'method' FROM (SELECT diff_id, unnest(regexp_extract_all(content, 'func \(s \*(\w+)\) (\w+)\(')) AS x FROM in_flight_diff_file WHERE {_LANG} = 'go'))
    SELECT *, count(*) AS times FROM m GROUP BY ALL""",
)
add(
    "packs_that_apply",
    lambda t: packs.applying(packs.rules_of(t.spark, PACKS), t("in_flight_diff_file")).groupBy("pack").agg(F.count("*").alias("rules")),
    "SELECT 'python-units' AS pack, 2 AS rules WHERE EXISTS (SELECT 1 FROM in_flight_diff_file WHERE ends_with(path, '.py')) UNION ALL SELECT 'go-units', 1 WHERE EXISTS (SELECT 1 FROM in_flight_diff_file WHERE contains(content, 'package '))",
)


def _relation_kind(raw):
    """What an attribute's declaration says of a relation: its kind, target and inverse, for the common mapping styles."""
    kind = F.lower(F.regexp_extract(raw, r"(?i)\b(one[_-]?to[_-]?one|one[_-]?to[_-]?many|many[_-]?to[_-]?one|many[_-]?to[_-]?many|belongs[_-]?to|has[_-]?many|has[_-]?one|foreign[_-]?key)\b", 1))
    plain = F.regexp_replace(kind, "[_-]", "")
    shape = F.create_map(*(F.lit(x) for p in {"onetoone": "1:1", "onetomany": "1:N", "manytoone": "N:1", "manytomany": "N:M", "belongsto": "N:1", "hasmany": "1:N", "hasone": "1:1", "foreignkey": "N:1"}.items() for x in p))
    target = F.regexp_extract(raw, r"(?i)(?:=>\s*|\(\s*['\":]?|:\s*)([A-Z]\w*)", 1)
    inverse = F.regexp_extract(raw, r"(?i)(?:mapped_?by|inverse_?of|back_populates|related_name)\s*[=:]\s*['\":]?(\w+)", 1)
    return plain, shape[plain], F.nullif(target, F.lit("")), F.nullif(inverse, F.lit(""))


def _relations(t):
    kinds = F.element_at(F.array(*map(F.lit, ("@OneToMany(mappedBy = 'owner') List<", "belongs_to :", "models.ForeignKey('", "has_many :", "@ManyToMany(() => "))), (F.pmod(F.xxhash64("name"), F.lit(5)) + 1).cast("int"))
    raw = F.concat(kinds, F.col("name"), F.lit("')"))
    n = v.nodes(t, "id", "name", "type").where("type = 'class' and name is not null").select("id", raw.alias("raw"))
    plain, cardinality, target, inverse = _relation_kind(F.col("raw"))
    return n.select("id", plain.alias("kind"), cardinality.alias("cardinality"), target.alias("target"), inverse.alias("inverse"))


add("relation_declarations", _relations)

#: Named questions and the queries they are made of.
ANSWERS = {"mastery": ["summary_counts", "library_summary", "seam_inventory", "entity_accessors", "tests_of_target", "fan_in_out"], "risk": ["change_risk_rank", "hot_spots", "dead_code", "file_churn"], "runtime": ["route_metrics", "impact_stats", "operational_priorities", "unmatched_hints"]}


def answer(t, name: str) -> DataFrame:
    """Sections of a named question: section, rows and confidence, which is .9 for an answer and .4 for an empty one; gaps lie under .8."""
    known = {**lookups.QUERIES, **relations.QUERIES}
    parts = [known[q](t.spark, t.root).agg(F.count("*").alias("rows")).select(F.lit(q).alias("section"), "rows") for q in ANSWERS[name]]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("confidence", F.when(F.col("rows") > 0, 0.9).otherwise(0.4))


for _name in ANSWERS:
    _known = {**lookups.SQL, **relations.SQL}
    add(f"answer_{_name}", lambda t, n=_name: answer(t, n), " UNION ALL ".join(f"SELECT '{q}' AS section, rows, CASE WHEN rows > 0 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM (SELECT count(*) AS rows FROM ({_known[q]}) x)" for q in ANSWERS[_name]))
