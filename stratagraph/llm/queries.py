"""Queries of the problems for training data and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.catalog import Catalog
from stratagraph.llm import credentials, encoding, mixing, neighbours, provenance, quantiles, truncation
from stratagraph.session import durable


def _q(build):
    return lambda spark, root: build(Catalog(spark, root))


def _weights(t: Catalog, counted):
    return mixing.weighted(mixing.source_tokens(counted, t("mix_target")))


def _mix(t: Catalog):
    counted = durable(mixing.document_tokens(t("documents")))
    weights = durable(_weights(t, counted))
    return mixing.realise(counted, weights), weights


FIELDS = ["patch", "content"]

QUERIES = {
    "p1_found": _q(lambda t: credentials.find_secrets(t("in_flight_diff_file"), "diff_id", FIELDS).select("diff_id", "field", "line_no").distinct()),
    "p1_redacted": _q(lambda t: credentials.redact_secrets(t("in_flight_diff_file"), "diff_id", FIELDS)),
    "p3_found": _q(lambda t: provenance.not_hand_written(t("in_flight_diff_file")).select("diff_id").distinct()),
    "p3_reasons": _q(lambda t: provenance.not_hand_written(t("in_flight_diff_file"))),
    "p5_found": _q(lambda t: neighbours.nearest_pairs(t("node_embeddings"))),
    "p6_found": _q(lambda t: quantiles.path_percentiles(t("observation")).where("p95 > 1000").select("method", "path")),
    "p6_percentiles": _q(lambda t: quantiles.path_percentiles(t("observation"))),
    "p6_daily": _q(lambda t: quantiles.percentiles(quantiles.daily_sketches(t("observation")), ["day", "method", "path"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})),
    "p8_ids": _q(lambda t: encoding.encode_texts(t("documents"), "doc_id", "text")),
    "p9_found": _q(lambda t: _weights(t, mixing.document_tokens(t("documents"))).where("short").select("source")),
    "p9_weights": _q(lambda t: _weights(t, mixing.document_tokens(t("documents")))),
    "p9_mix": _q(lambda t: _mix(t)[0]),
    "p9_order": _q(lambda t: mixing.in_order(*_mix(t))),
    "p10_found": _q(lambda t: truncation.cut_texts(t("documents")).where("cut").select("doc_id").distinct()),
    "p10_shares": _q(lambda t: truncation.cut_shares(truncation.cut_texts(t("documents")))),
    "p9_shares": _q(lambda t: mixing.reached_shares(*_mix(t))),
}

_EVENTS = r"""
WITH e AS (SELECT event.event_id AS event_id, upper(trim(event.method)) AS method, event.duration_ms AS d, CAST(recorded_at AS DATE) AS day,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(event.path, '\?.*', ''), '/$', ''), '/[0-9]+(/[0-9]+)(/|$)', '/:id\1\2', 'g'), '/[0-9]+(/|$)', '/:id\1', 'g') AS path
  FROM observation),
once AS (SELECT method, path, d, day FROM e WHERE method IS NOT NULL AND path IS NOT NULL AND d >= 0 AND NOT isnan(d)
  QUALIFY event_id IS NULL OR row_number() OVER (PARTITION BY event_id ORDER BY method, path, d, day) = 1)
"""

SQL = {
    # At the scale of the SQL check every group has fewer events than the sketch keeps, so its percentiles are exact.
    "p6_percentiles": _EVENTS + "SELECT method, path, count(*) AS count, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99 FROM once GROUP BY method, path",
    "p6_daily": _EVENTS + "SELECT day, method, path, count(*) AS count, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99 FROM once GROUP BY day, method, path",
    "p6_found": _EVENTS + "SELECT method, path FROM once GROUP BY ALL HAVING quantile_disc(d, 0.95) > 1000",
}
