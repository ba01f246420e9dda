"""SQL for queries of other modules that need recursion or JSON, or that are said quite differently in SQL."""

from __future__ import annotations

from stratagraph.functions import text as fx
from stratagraph.plans.views import with_views as sql
from stratagraph.queries.behaviour import fsql
from stratagraph.queries.relations import _PAIRS_SQL

QUERIES: dict = {}

_IDS = "ids AS (SELECT source AS id FROM calls UNION SELECT target FROM calls)"
_CLOSURE = f"{_IDS}, closure(a, b) AS (SELECT id, id FROM ids UNION SELECT x.a, c.target FROM closure x JOIN calls c ON c.source = x.b)"
_STRONG = f"{_CLOSURE}, strong AS (SELECT x.a AS id, min(x.b) AS component FROM closure x JOIN closure y ON y.a = x.b AND y.b = x.a GROUP BY 1)"
_STYLE = "CASE WHEN regexp_full_match({0}, '[a-z]+(?:[A-Z][a-z0-9]*)+') THEN 'camel' WHEN regexp_full_match({0}, '(?:[A-Z][a-z0-9]*)+') THEN 'pascal' WHEN regexp_full_match({0}, '[a-z0-9]+(?:_[a-z0-9]+)+') THEN 'snake' WHEN regexp_full_match({0}, '[a-z0-9]+(?:-[a-z0-9]+)+') THEN 'kebab' ELSE 'other' END"
_LANGUAGE = r"coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in fx.LANGUAGES.items()) + r"}, lower(regexp_extract(file, '\.([A-Za-z0-9]+)$', 1)))[1], '?')"
_BASE = r"regexp_replace(string_split(regexp_replace(replace(file, '\', '/'), '^(\./)+', ''), '/')[-1], '\..*$', '')"

SQL = {
    "components": sql(
        f"WITH {_IDS}, near(a, b) AS (SELECT source, target FROM calls UNION SELECT target, source FROM calls), walk(id, other) AS (SELECT id, id FROM ids UNION SELECT w.id, n.b FROM walk w JOIN near n ON n.a = w.other) SELECT id, min(other) AS component FROM walk GROUP BY 1",
        "calls",
        recursive=True,
    ),
    "strong_components": sql(f"WITH {_STRONG} SELECT id, component FROM strong", "calls", recursive=True),
    "terminality": sql(
        f"""WITH {_STRONG}, steps AS (SELECT DISTINCT a.component AS source, b.component AS target FROM calls c JOIN strong a ON a.id = c.source JOIN strong b ON b.id = c.target WHERE a.component <> b.component),
        up(component, d) AS (SELECT DISTINCT component, 0 FROM strong WHERE component NOT IN (SELECT source FROM steps) UNION SELECT s.source, u.d + 1 FROM up u JOIN steps s ON s.target = u.component WHERE u.d < 200)
        SELECT s.id, s.component, min(d) AS distance FROM strong s JOIN up u USING (component) GROUP BY 1, 2""",
        "calls",
        recursive=True,
    ),
    "flow_continuations": fsql(" SELECT source AS record, target AS next_record FROM links"),
    "flow_summary": fsql(" SELECT record_id, count(*) AS steps, max(len(string_split(step_path, '.'))) AS depth, count(*) FILTER (WHERE node_id IS NULL) AS unresolved FROM steps GROUP BY 1"),
    "concept_index": fsql(" SELECT node_id, count(DISTINCT record_id) AS flows FROM steps WHERE node_id IS NOT NULL GROUP BY 1"),
    "security_boundaries": fsql(" SELECT mechanism, count(DISTINCT record_id) AS flows, count(DISTINCT name) AS names FROM bounds GROUP BY 1"),
    "flow_effects_rollup": fsql(" SELECT effect, count(*) AS n, count(DISTINCT entity) AS entities FROM effects GROUP BY 1"),
    "semantic_coverage": fsql(" SELECT project_id, count(*) AS nodes, count(*) FILTER (WHERE id IN (SELECT node_id FROM steps WHERE node_id IS NOT NULL)) AS mapped FROM nodes GROUP BY 1", "nodes"),
    "breaking_changes": f"""WITH {_PAIRS_SQL}, f AS (SELECT project_id, snapshot_no, id, CAST(to_json(list_transform(signature.parameters, lambda p: p.type)) AS VARCHAR) AS sig, signature.return_type AS returns FROM cas_node WHERE metadata.is_exported),
        a AS (SELECT p.project_id, p.snapshot_no, p.before, f.id, max(sig) AS sig, max(returns) AS returns FROM pairs p JOIN f ON f.project_id = p.project_id AND f.snapshot_no = p.before GROUP BY ALL),
        b AS (SELECT p.project_id, p.snapshot_no, p.before, f.id, max(sig) AS sig, max(returns) AS returns FROM pairs p JOIN f ON f.project_id = p.project_id AND f.snapshot_no = p.snapshot_no GROUP BY ALL)
        SELECT * FROM (SELECT a.project_id, a.snapshot_no, a.before, a.id, CASE WHEN b.id IS NULL THEN 'removed' WHEN a.sig IS DISTINCT FROM b.sig THEN 'signature' WHEN a.returns IS DISTINCT FROM b.returns THEN 'type-change' END AS kind FROM a LEFT JOIN b ON a.project_id = b.project_id AND a.snapshot_no = b.snapshot_no AND a.before = b.before AND a.id = b.id) WHERE kind IS NOT NULL""",
    "conformance_shapes": sql(
        f"WITH c AS (SELECT {_LANGUAGE} AS language, {_STYLE.format(_BASE)} AS shape, count(*) AS n FROM nodes WHERE file IS NOT NULL GROUP BY 1, 2) SELECT language, shape, n, round(n / sum(n) OVER (PARTITION BY language)::DOUBLE, 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, shape) = 1",
        "nodes",
    ),
    "shingle_counts": r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z_]+|[0-9]+|[^\sa-z0-9_]'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '$n' ELSE x END) AS w FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(CASE WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS INTEGER) AS shingles FROM w""",
    "posting_shards": sql(
        "SELECT CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split(lower(name), ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 64 AS INTEGER) AS shard, count(*) AS n FROM nodes GROUP BY 1",
        "nodes",
    ),
}
