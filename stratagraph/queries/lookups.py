"""Queries of projections, filters, search, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import select, similar
from stratagraph.plans import views as v
from stratagraph.plans.views import with_views as sql
from stratagraph.queries.registry import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add

# -- projections and filters ---------------------------------------------------
add("node_detail", lambda t: select.neighbourhood(v.nodes(t).select("id", "name", "type", "file", "parent"), v.edges(t, "source", "target")),
    sql("""SELECT n.id, n.name, n.type, n.file, n.parent, coalesce(i.edges_in, 0) AS edges_in, coalesce(i.sources, 0) AS sources, coalesce(o.edges_out, 0) AS edges_out, coalesce(o.targets, 0) AS targets FROM nodes n
        LEFT JOIN (SELECT target AS id, count(*) AS edges_in, count(DISTINCT source) AS sources FROM edges WHERE target IS NOT NULL GROUP BY 1) i USING (id)
        LEFT JOIN (SELECT source AS id, count(*) AS edges_out, count(DISTINCT target) AS targets FROM edges GROUP BY 1) o USING (id)""", "nodes", "edges"))

def _file_nodes(t):
    """The nodes of the file that has most of them."""
    n = v.nodes(t, "id", "name", "file", "line").where("file is not null")
    largest = F.broadcast(n.groupBy("file").agg(F.count("*").alias("k")).orderBy(F.col("k").desc(), "file").limit(1).select("file"))  # one row
    return n.join(largest, "file").select("id", "name", "file", "line")


add("file_nodes", _file_nodes, sql("SELECT id, name, file, line FROM nodes WHERE file = (SELECT file FROM nodes WHERE file IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, file LIMIT 1)", "nodes"))


def _file_edges(t):
    inside = v.nodes(t).where("file is not null").select("id", "file")
    e = v.edges(t, "source", "target", "type").select(F.col("id").alias("edge_id"), "source", "target", "type")
    a = e.join(inside.select(F.col("id").alias("source"), "file"), "source")
    return a.join(inside.select(F.col("id").alias("target"), "file"), ["target", "file"]).groupBy("file").agg(F.count("*").alias("edges"))


add("file_internal_edges", _file_edges, sql("SELECT a.file, count(*) AS edges FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id AND a.file = b.file GROUP BY a.file", "nodes", "edges"))
add("entry_points_page", lambda t: select.page(v.nodes(t).where("is_exported").select("id", "name", "type"), ["id"], 50, 10), sql("SELECT id, name, type FROM nodes WHERE is_exported ORDER BY id LIMIT 50 OFFSET 10", "nodes"))
add("exit_points_page", lambda t: select.page_with_more(v.edges(t, "source", "target", "category").where("category = 'data'").select("id", "source", "target"), ["id"], 50), sql("SELECT id, source, target, (SELECT count(*) FROM edges WHERE category = 'data') > 50 AS truncated FROM edges WHERE category = 'data' ORDER BY id LIMIT 50", "edges"))
add("route_table", lambda t: v.observations(t).where("path is not null and upper(method) = upper('get')").select(fx.normal_route(F.col("path")).alias("route")).groupBy("route").agg(F.count("*").alias("n")),
    sql(r"""SELECT route, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '[?#].*', ''), '/[0-9]+(/[0-9]+)(/|$)', '/:param\1\2', 'g'), '/[0-9]+(/|$)', '/:param\1', 'g'), '(.)/$', '\1') AS route FROM obs WHERE path IS NOT NULL AND upper(method) = 'GET') GROUP BY 1""", "obs"))
add("seam_counts", lambda t: v.edges(t, "type", "category").groupBy("type").pivot("category", ["behaviour", "data", "structure"]).agg(F.count("id")).na.fill(0), sql("SELECT type, count(*) FILTER (WHERE category = 'behaviour') AS behaviour, count(*) FILTER (WHERE category = 'data') AS data, count(*) FILTER (WHERE category = 'structure') AS structure FROM edges GROUP BY type", "edges"))
add("analysis_facts", lambda t: v.nodes(t).where("type = 'function' and category = 'domain' and level >= 2").select("id", "type", "category", "level"), sql("SELECT id, type, category, level FROM nodes WHERE type = 'function' AND category = 'domain' AND level >= 2", "nodes"))
add("invariant_filter", lambda t: v.nodes(t).where(F.contains(F.lower(F.concat_ws(" ", "name", "description", F.concat_ws(" ", "tags"))), F.lit("ledger"))).select("id"), sql("SELECT id FROM nodes WHERE contains(lower(concat_ws(' ', name, description, array_to_string(tags, ' '))), 'ledger')", "nodes"))
add("role_breakdown", lambda t: select.breakdown(v.nodes(t), "category"), sql("SELECT coalesce(category, 'unknown') AS category, count(*) AS n FROM nodes GROUP BY 1", "nodes"))
add("library_summary", lambda t: t("shared_node").where("lower(name) like '%er%' or lower(category) like '%data%'").groupBy("library").agg(F.count("*").alias("units"), F.count_distinct("category").alias("categories"), F.min("name").alias("first_name")),
    "SELECT library, count(*) AS units, count(DISTINCT category) AS categories, min(name) AS first_name FROM shared_node WHERE lower(name) LIKE '%er%' OR lower(category) LIKE '%data%' GROUP BY library")
_sev = lambda: F.when(F.col("cyclomatic") > 20, 0).when(F.col("cyclomatic") > 10, 1).when(F.col("cyclomatic") > 5, 2).otherwise(3)
add("coverage_gaps_ranked", lambda t: select.page(v.nodes(t).where("not coalesce(is_test, false)").select("id", "cyclomatic", _sev().alias("severity_rank")), ["severity_rank", "id"], 100), sql("SELECT id, cyclomatic, CASE WHEN cyclomatic > 20 THEN 0 WHEN cyclomatic > 10 THEN 1 WHEN cyclomatic > 5 THEN 2 ELSE 3 END AS severity_rank FROM nodes WHERE NOT coalesce(is_test, false) ORDER BY severity_rank, id LIMIT 100", "nodes"))
add("coverage_gaps_by_kind", lambda t: v.nodes(t).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("cyclomatic") > 10).alias("complex")), sql("SELECT type, count(*) AS n, count(*) FILTER (WHERE cyclomatic > 10) AS complex FROM nodes GROUP BY type", "nodes"))
add("best_status_per_entry", lambda t: v.observations(t).where("match_id is not null").groupBy("match_id").agg(F.max_by("match_status", F.struct(F.when(F.col("match_status") == "matched", 3).when(F.col("match_status") == "partial", 2).otherwise(1), F.col("match_status"))).alias("best_status"), F.count("*").alias("n")),
    sql("SELECT match_id, arg_max(match_status, (CASE match_status WHEN 'matched' THEN 3 WHEN 'partial' THEN 2 ELSE 1 END, match_status)) AS best_status, count(*) AS n FROM obs WHERE match_id IS NOT NULL GROUP BY match_id", "obs"))


def _level_slice(t):
    paged = select.page(v.nodes(t).where("level = 2").select("id"), ["id"], 200)
    e = v.edges(t, "source", "target").where("target is not null").select("id", "source", "target")
    return e.join(paged.select(F.col("id").alias("source")), "source", "left_semi").join(paged.select(F.col("id").alias("target")), "target", "left_semi").select("id", "source", "target")


add("level_slice", _level_slice, sql("WITH p AS (SELECT id FROM nodes WHERE level = 2 ORDER BY id LIMIT 200) SELECT id, source, target FROM edges WHERE source IN (SELECT id FROM p) AND target IN (SELECT id FROM p)", "nodes", "edges"))
add("level_definitions", lambda t: v.nodes(t).groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("type").alias("types")), sql("SELECT level, count(*) AS n, count(DISTINCT type) AS types FROM nodes GROUP BY level", "nodes"))
add("pattern_instances", lambda t: v.nodes(t).select("id", F.posexplode("tags").alias("pos", "tag")).groupBy("tag").agg(F.count("*").alias("instances"), F.min("id").alias("first_id")), sql("SELECT tag, count(*) AS instances, min(id) AS first_id FROM (SELECT id, unnest(tags) AS tag FROM nodes) GROUP BY tag", "nodes"))
add("comments_by_scope", lambda t: v.nodes(t).where("description is not null and description <> ''").select("id", "file", "line", F.when(F.lower("description").rlike("todo|fixme|hack"), "todo").otherwise("note").alias("kind")), sql("SELECT id, file, line, CASE WHEN regexp_matches(lower(description), 'todo|fixme|hack') THEN 'todo' ELSE 'note' END AS kind FROM nodes WHERE description IS NOT NULL AND description <> ''", "nodes"))
add("error_contracts", lambda t: v.nodes(t).select("id", F.explode("throws").alias("error")).groupBy("error").agg(F.count("*").alias("declared"), F.count_distinct("id").alias("nodes")), sql("SELECT error, count(*) AS declared, count(DISTINCT id) AS nodes FROM (SELECT id, unnest(throws) AS error FROM nodes) GROUP BY error", "nodes"))
add("configuration_nodes", lambda t: v.nodes(t).where("regexp_like(lower(name), 'config|registry|setting') or regexp_like(lower(file), 'config|registry|setting')").select("id", "name", "file"), sql("SELECT id, name, file FROM nodes WHERE regexp_matches(lower(name), 'config|registry|setting') OR regexp_matches(lower(file), 'config|registry|setting')", "nodes"))
add("primary_product", lambda t: v.nodes(t).where(fx.in_primary_product(F.col("file"), F.col("name"), F.col("is_test"), F.col("is_generated"))).groupBy("project_id").agg(F.count("*").alias("n")),
    sql(rf"""SELECT project_id, count(*) AS n FROM (SELECT *, lower(replace(coalesce(nullif(file, ''), name, ''), '\', '/')) AS p FROM nodes) WHERE NOT (coalesce(is_test, false) OR coalesce(is_generated, false)
        OR regexp_matches(p, '(^|/)({fx.OUTSIDE_DIRECTORIES})(/|$)') OR regexp_matches(p, '\.({fx.OUTSIDE_SUFFIXES})\.[a-z0-9]+$') OR regexp_matches(p, '^legacy/')) GROUP BY project_id""", "nodes"))
add("runtime_links_status", lambda t: v.observations(t).groupBy(F.coalesce("match_status", F.lit("none")).alias("match_status")).agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("targets")), sql("SELECT coalesce(match_status, 'none') AS match_status, count(*) AS n, count(DISTINCT match_id) AS targets FROM obs GROUP BY 1", "obs"))
add("tenant_visibility", lambda t: t("in_flight_diff_file").where(F.col("workspace_id").eqNullSafe(F.lit("ws-meridian")) & F.col("agent_id").eqNullSafe(F.lit(None).cast("string"))).select("diff_id"), "SELECT diff_id FROM in_flight_diff_file WHERE workspace_id = 'ws-meridian' AND agent_id IS NULL")


def _path_compatible(t):
    """Spellings of paths in flight beside the other paths that likely name the same file: equal when cleaned, or one the end of the other."""
    paths = t("in_flight_diff_file").where("path is not null").select("path").distinct().withColumn("base", fx.base_name(F.col("path")))
    pairs = paths.join(paths.withColumnRenamed("path", "other"), "base").where("path <> other")
    return pairs.where(fx.paths_compatible(F.col("path"), F.col("other"))).select("path", "other")


add("path_compatible_files", _path_compatible, r"""WITH p AS (SELECT DISTINCT path, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS x FROM in_flight_diff_file WHERE path IS NOT NULL)
    SELECT a.path, b.path AS other FROM p a JOIN p b ON a.path <> b.path AND (a.x = b.x OR ends_with(a.x, '/' || b.x) OR ends_with(b.x, '/' || a.x))""")

# -- search --------------------------------------------------------------------
_WORDS = ["ledger", "resolve"]
_SEARCH_SQL = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-./]', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"


def _lexical(t, text: str = _WORDS[0]):
    n = v.nodes(t).select("id", "name", "qualified_name", "description", "type")
    words = fx.search_tokens(F.col("name"))
    query = F.lit(text)
    hit = F.contains(F.lower("name"), query) | F.coalesce(F.contains(F.lower("qualified_name"), query), F.lit(False)) | F.coalesce(F.contains(F.lower("description"), query), F.lit(False))
    rank = F.when(F.lower("name") == query, 0).when(F.startswith(F.lower("name"), query), 1).when(F.contains(F.lower("name"), query), 2).otherwise(3)
    overlap = F.size(F.array_intersect(words, F.array(*map(F.lit, _WORDS))))
    ranked = n.select("id", "name", F.when(hit, 0).otherwise(1).alias("tier"), F.when(hit, rank).otherwise(-overlap).alias("rank"), overlap.alias("overlap")).where("tier = 0 or overlap > 0")
    return select.page(ranked, ["tier", "rank", "id"], 100)


add("lexical_search", _lexical, sql("SELECT id, name, tier, CASE WHEN tier = 0 THEN r ELSE -overlap END AS rank, overlap FROM (SELECT id, name, CASE WHEN contains(lower(name), 'ledger') OR coalesce(contains(lower(qualified_name), 'ledger'), false) OR coalesce(contains(lower(description), 'ledger'), false) THEN 0 ELSE 1 END AS tier, CASE WHEN lower(name) = 'ledger' THEN 0 WHEN starts_with(lower(name), 'ledger') THEN 1 WHEN contains(lower(name), 'ledger') THEN 2 ELSE 3 END AS r, len(list_intersect(" + _SEARCH_SQL.format("name") + ", ['ledger', 'resolve'])) AS overlap FROM nodes) WHERE tier = 0 OR overlap > 0 ORDER BY tier, rank, id LIMIT 100", "nodes"))
add("search_tokens", lambda t: v.nodes(t).select(F.explode(fx.search_tokens(F.col("name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), sql("SELECT token, count(*) AS n FROM (SELECT unnest(" + _SEARCH_SQL.format("name") + ") AS token FROM nodes) GROUP BY token", "nodes"))


def word_boundary(t, *words: str):
    """Nodes with words that hold all given ones."""
    return v.nodes(t, "id", "name").where(fx.words_in_name(fx.camel_words(F.col("name")), list(words))).select("id")


add("word_boundary_match", lambda t: word_boundary(t, "ledg"), sql("SELECT id FROM nodes WHERE len(list_filter(regexp_extract_all(name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: contains(lower(w), 'ledg'))) > 0", "nodes"))


def _postings(t):
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 2, F.lit(1))), lambda i: F.lower(F.substring("name", i, F.lit(3))))
    return v.nodes(t).where("length(name) >= 3").select("id", F.explode(F.array_distinct(grams)).alias("gram"))


add("trigram_postings", lambda t: _postings(t).groupBy("gram").agg(F.count("*").alias("postings"), F.min("id").alias("first_id")), sql("SELECT gram, count(*) AS postings, min(id) AS first_id FROM (SELECT id, unnest(list_distinct(list_transform(range(1, len(name) - 1), lambda i: lower(substring(name, i, 3))))) AS gram FROM nodes WHERE len(name) >= 3) GROUP BY gram", "nodes"))


def trigram_search(t, query: str):
    """Nodes whose names hold a text, found by the postings of all its runs of three signs; shorter texts have none and are compared directly."""
    text = query.lower()
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    names = v.nodes(t, "id", "name")
    held = names.where(F.contains(F.lower("name"), F.lit(text)))
    if not grams:
        return held
    hits = _postings(t).where(F.col("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    return held.join(hits.select("id"), "id", "left_semi").select("id", "name")


add("trigram_search", lambda t: trigram_search(t, "ledger"), sql("SELECT id, name FROM nodes WHERE contains(lower(name), 'ledger')", "nodes"))
add("posting_shards", lambda t: v.nodes(t).select(F.pmod(fx.fnv1a(F.lower("name")), F.lit(64)).cast("int").alias("shard")).groupBy("shard").agg(F.count("*").alias("n")))


def name_tiers(t, query: str, word: str):
    """3 for the name itself, 2 for names that hold it, 1 for names with a word, else 0."""
    name = F.lower("name")
    tier = F.when(name == query, 3).when(F.contains(name, F.lit(query)), 2).when(F.array_contains(fx.search_tokens(F.col("name")), word), 1).otherwise(0)
    return v.nodes(t, "id", "name").select("id", tier.alias("tier"))


add("name_tier", lambda t: name_tiers(t, "ledger", "resolve"), sql("SELECT id, CASE WHEN lower(name) = 'ledger' THEN 3 WHEN contains(lower(name), 'ledger') THEN 2 WHEN list_contains(" + _SEARCH_SQL.format("name") + ", 'resolve') THEN 1 ELSE 0 END AS tier FROM nodes", "nodes"))
add("token_coverage", lambda t: v.nodes(t).select("id", fx.coverage(fx.search_tokens(F.col("name")), _WORDS).alias("coverage")), sql("SELECT id, len(list_intersect(" + _SEARCH_SQL.format("name") + ", ['ledger', 'resolve'])) / 2.0 AS coverage FROM nodes", "nodes"))
_dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


add("vector_top_k", lambda t: similar.cosine_top(t("embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20), "SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE place <= 20")


def _quantised(t):
    scale = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    e = t("embeddings").withColumn("largest", scale).where("largest > 0")
    codes = F.transform("embedding", lambda x: F.least(F.greatest(fx.half_up(x.cast("double") / F.col("largest") * 127), F.lit(-127)), F.lit(127)).cast("int"))
    return e.select("vec_id", F.round("largest", 6).alias("scale"), codes.alias("codes"))


add("quantise", _quantised, "SELECT vec_id, round(s, 6) AS scale, list_transform(embedding::DOUBLE[], lambda x: CAST(least(greatest(floor(x / s * 127 + 0.5), -127), 127) AS INTEGER)) AS codes FROM (SELECT vec_id, embedding, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS s FROM embeddings) WHERE s > 0")


def _fused(t):
    ranked = lambda df, order: df.orderBy(*order).limit(60).withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)
    n = v.nodes(t).select("id", "name", F.length("name").alias("len"), "cyclomatic").where("contains(lower(name), 'er')")
    a = ranked(n.select("id", "len"), ["len", "id"]).select("id", F.col("rank").alias("rank_a"))
    b = ranked(n.where("cyclomatic is not null").select("id", "cyclomatic"), [F.col("cyclomatic").desc(), "id"]).select("id", F.col("rank").alias("rank_b"))
    term = lambda c: F.coalesce(F.lit(1.0) / (F.lit(61) + F.col(c)), F.lit(0.0))
    both = a.join(b, "id", "full").select("id", (term("rank_a") + term("rank_b")).alias("rrf"))
    top = both.withColumn("score", F.round(F.col("rrf") / F.max("rrf").over(W.partitionBy()), 6))
    return select.page(top.select("id", "score"), [F.col("score").desc(), "id"], 25)


add("rank_fusion", _fused, sql("""WITH n AS (SELECT id, name, len(name) AS l, cyclomatic FROM nodes WHERE contains(lower(name), 'er')),
    a AS (SELECT id, row_number() OVER (ORDER BY l, id) - 1 AS r FROM n QUALIFY r < 60), b AS (SELECT id, row_number() OVER (ORDER BY cyclomatic DESC, id) - 1 AS r FROM n WHERE cyclomatic IS NOT NULL QUALIFY r < 60),
    f AS (SELECT coalesce(a.id, b.id) AS id, coalesce(1.0::DOUBLE / (61 + a.r), 0) + coalesce(1.0::DOUBLE / (61 + b.r), 0) AS rrf FROM a FULL JOIN b ON a.id = b.id)
    SELECT id, round(rrf / (SELECT max(rrf) FROM f), 6) AS score FROM f ORDER BY score DESC, id LIMIT 25""", "nodes"))
add("embedding_document", lambda t: v.nodes(t).select("id", F.substring(F.sha2(F.concat_ws("\n", "type", "qualified_name", "parent", F.concat_ws(" ", "tags"), "description"), 256), 1, 16).alias("doc_hash")), sql("SELECT id, substring(sha256(concat_ws(chr(10), type, qualified_name, parent, array_to_string(coalesce(tags, []), ' '), description)), 1, 16) AS doc_hash FROM nodes", "nodes"))


def _shingles(t):
    masked = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z_]+|[0-9]+|[^\sa-z0-9_]"), F.lit(0)), lambda w: F.when(w.rlike("^[0-9]+$"), "$n").otherwise(w))
    grams = F.when(F.size(masked) < 3, F.array(F.concat_ws(" ", masked))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(masked) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(masked, i, F.lit(3)))))
    return t("documents").where("text is not null").select("doc_id", F.size(F.array_distinct(grams)).alias("shingles"))


add("shingle_counts", _shingles)
add("usage_examples", lambda t: v.edges(t).where("type = 'calls' and target is not null").join(v.nodes(t).where("not coalesce(is_test, false)").select(F.col("id").alias("source"), F.col("type").alias("caller_type")), "source").groupBy("target", "caller_type").agg(F.count("*").alias("uses"), F.min("source").alias("first_caller")), sql("SELECT e.target, n.type AS caller_type, count(*) AS uses, min(e.source) AS first_caller FROM edges e JOIN nodes n ON e.source = n.id WHERE e.type = 'calls' AND e.target IS NOT NULL AND NOT coalesce(n.is_test, false) GROUP BY 1, 2", "nodes", "edges"))
add("pattern_examples", lambda t: select.top_per_key(v.nodes(t).select("id", F.explode("tags").alias("tag")).distinct(), ["tag"], [F.col("id")], 3), sql("SELECT id, tag, row_number() OVER (PARTITION BY tag ORDER BY id) AS rank FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM nodes) QUALIFY rank <= 3", "nodes"))


def _risk_rank(t):
    """Units by the risk of changing them. 400, 300, 200, 100 by complexity over 20, 10, 5; 10 for many parameters, 5 for errors thrown, 15 for what is no test."""
    level = F.when(F.col("cyclomatic") > 20, 400).when(F.col("cyclomatic") > 10, 300).when(F.col("cyclomatic") > 5, 200).otherwise(100)
    factors = F.array(F.when(F.col("parameters") > 4, 10).otherwise(0), F.when(F.size("throws") > 0, 5).otherwise(0))
    score = level + F.aggregate(factors, F.lit(0), lambda a, x: a + x) + F.when(~F.coalesce("is_test", F.lit(True)), 15).otherwise(0)
    return select.page(v.nodes(t).select("id", score.alias("rank")), [F.col("rank").desc(), "id"], 100)


add("change_risk_rank", _risk_rank, sql("SELECT id, CASE WHEN cyclomatic > 20 THEN 400 WHEN cyclomatic > 10 THEN 300 WHEN cyclomatic > 5 THEN 200 ELSE 100 END + CASE WHEN parameters > 4 THEN 10 ELSE 0 END + CASE WHEN len(throws) > 0 THEN 5 ELSE 0 END + CASE WHEN NOT coalesce(is_test, true) THEN 15 ELSE 0 END AS rank FROM nodes ORDER BY rank DESC, id LIMIT 100", "nodes"))
add("shared_components", lambda t: v.edge_rows(t).where("target is not null").groupBy("target").agg(F.count_distinct("source").alias("usage_count")).where("usage_count >= 2").orderBy(F.col("usage_count").desc(), "target").limit(50), sql("SELECT target, count(DISTINCT source) AS usage_count FROM edges WHERE target IS NOT NULL GROUP BY target HAVING count(DISTINCT source) >= 2 ORDER BY usage_count DESC, target LIMIT 50", "edges"))

# -- windows, sets, scalars ----------------------------------------------------
add("percentile_below", lambda t: select.percentile_below(v.nodes(t).where("cyclomatic is not null").select("id", "cyclomatic"), "cyclomatic"), sql("SELECT id, cyclomatic, CAST(floor(100 * (rank() OVER (ORDER BY cyclomatic) - 1) / count(*) OVER ()) AS INTEGER) AS percentile FROM nodes WHERE cyclomatic IS NOT NULL", "nodes"))


def _min_max(t):
    n = v.nodes(t).where("cyclomatic is not null").select("id", "cyclomatic")
    bounds = F.broadcast(n.agg(F.min("cyclomatic").alias("lo"), F.max("cyclomatic").alias("hi")))  # one row
    return n.join(bounds).select("id", F.round((F.col("cyclomatic") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1), 6).alias("scaled"))


add("min_max_scaling", _min_max, sql("SELECT id, round((cyclomatic - min(cyclomatic) OVER ()) / CASE WHEN max(cyclomatic) OVER () > min(cyclomatic) OVER () THEN (max(cyclomatic) OVER () - min(cyclomatic) OVER ())::DOUBLE ELSE 1 END, 6) AS scaled FROM nodes WHERE cyclomatic IS NOT NULL", "nodes"))
add("latest_per_key", lambda t: v.claims(t).groupBy("claim_id").agg(F.max_by(F.struct("seq", "status", "heartbeat"), "seq").alias("r")).select("claim_id", "r.*"), sql("SELECT claim_id, seq, status, heartbeat FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY seq DESC) = 1", "claims"))
add("latest_heartbeat", lambda t: select.first_per_key(v.claims(t).select("claim_id", "heartbeat", "seq"), ["claim_id"], [F.col("heartbeat").desc(), F.col("seq")]), sql("SELECT claim_id, heartbeat, seq FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY heartbeat DESC, seq) = 1", "claims"))
add("first_per_key", lambda t: select.first_per_key(v.observations(t).where("event_id is not null").select("event_id", "id", "recorded_at"), ["event_id"], [F.col("recorded_at"), F.col("id")]), sql("SELECT event_id, id, recorded_at FROM obs WHERE event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY recorded_at, id) = 1", "obs"))
add("set_difference", lambda t: v.nodes(t).select(F.explode("tags").alias("tag")).distinct().exceptAll(t("shared_node").select("category").distinct()), sql("SELECT tag FROM (SELECT DISTINCT unnest(tags) AS tag FROM nodes) EXCEPT SELECT category FROM shared_node", "nodes"))
add("set_intersection", lambda t: v.nodes(t).select(fx.entity_key(F.col("name")).alias("key")).intersect(t("shared_node").select(fx.entity_key(F.col("name")).alias("key"))), sql("SELECT regexp_replace(regexp_replace(lower(name), '^entity_', ''), '[^a-z0-9]', '', 'g') AS key FROM nodes INTERSECT SELECT regexp_replace(regexp_replace(lower(name), '^entity_', ''), '[^a-z0-9]', '', 'g') FROM shared_node", "nodes"))
add("ranked_union", lambda t: v.nodes(t).where("type = 'class'").select(F.lit(0).alias("tier"), "id").unionByName(v.nodes(t).where("type = 'function'").select(F.lit(1).alias("tier"), "id")).orderBy("tier", "id").limit(120), sql("SELECT 0 AS tier, id FROM nodes WHERE type = 'class' UNION ALL SELECT 1, id FROM nodes WHERE type = 'function' ORDER BY tier, id LIMIT 120", "nodes"))
add("entity_keys", lambda t: v.nodes(t).select("id", fx.entity_key(F.col("name")).alias("key"), fx.role_text(F.coalesce(F.col("qualified_name"), F.lit(""))).alias("role")), sql("SELECT id, regexp_replace(regexp_replace(lower(name), '^entity_', ''), '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace(lower(coalesce(qualified_name, '')), '[^a-z0-9]+', ' ', 'g')) AS role FROM nodes", "nodes"))
add("naming_styles", lambda t: v.nodes(t).groupBy(fx.naming_style(F.col("name")).alias("style")).agg(F.count("*").alias("n")), sql("SELECT CASE WHEN regexp_matches(name, '^[a-z]+(?:[A-Z][a-z0-9]*)+$') THEN 'camel' WHEN regexp_matches(name, '^(?:[A-Z][a-z0-9]*)+$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z0-9]+(?:_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(name, '^[a-z0-9]+(?:-[a-z0-9]+)+$') THEN 'kebab' ELSE 'other' END AS style, count(*) AS n FROM nodes GROUP BY 1", "nodes"))
add("languages", lambda t: t("in_flight_diff_file").groupBy(F.coalesce(fx.language_of(F.col("path")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("n")), "SELECT coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in fx.LANGUAGES.items()) + "}, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)))[1], 'unknown') AS language, count(*) AS n FROM in_flight_diff_file GROUP BY 1")
add("route_shapes", lambda t: v.observations(t).where("path is not null").groupBy(fx.route_shape(F.col("path")).alias("shape")).agg(F.count("*").alias("n")), sql(r"SELECT '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(path, '[?#].*', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(:|\{|\[|\*|<|\$)') OR regexp_matches(s, '^[0-9]+$') THEN '{}' ELSE lower(s) END), '/') AS shape, count(*) AS n FROM obs WHERE path IS NOT NULL GROUP BY 1", "obs"))
add("timestamp_validity", lambda t: v.observations(t).join(t("observation").select("id", F.col("event.timestamp").alias("raw")), "id").select("id", F.coalesce(F.try_to_timestamp("raw", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.col("recorded_at")).alias("at")), sql("SELECT o.id, coalesce(CASE WHEN regexp_matches(o.event.timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$') THEN try_strptime(o.event.timestamp, '%Y-%m-%dT%H:%M:%SZ') END, o.recorded_at) AS at FROM observation o", "obs"))
add("observation_ids", lambda t: v.observations(t).select("id", F.sha2(F.concat_ws("|", "project_path", "event_id"), 256).alias("stable_id")), sql("SELECT id, sha256(concat_ws('|', project_path, event_id)) AS stable_id FROM obs", "obs"))
add("token_estimates", lambda t: v.nodes(t).select("id", fx.token_estimate(F.coalesce("description", F.lit(""))).alias("tokens")), sql("SELECT id, CAST(ceil(len(coalesce(description, '')) / 4.0) AS BIGINT) AS tokens FROM nodes", "nodes"))
