"""Queries of evidence's independence: near-identical texts and bursts of a community."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import opportunity, similar
from .catalog import _FOLD, query, table


@query(f"""
WITH RECURSIVE f AS (SELECT doc_id, string_split({_FOLD}, ' ') AS w FROM documents WHERE {_FOLD} <> ''),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM f)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (run) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * shared >= 4 * (x.n + y.n)),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.other)
SELECT id AS doc_id, min(other) AS group_id FROM reach GROUP BY 1""")
def q_near_text_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents grouped by near-identical texts: runs of five words, a similarity of 0.8 or more, or a chain of such."""
    docs = table(spark, d, "documents")
    return opportunity.independence_groups(docs.select("doc_id"), "doc_id", {}, more=similar.near_text_links(docs, "doc_id", "text"))


@query("""
WITH o AS (SELECT event_id, event_type, ts, ts - lag(ts) OVER w > INTERVAL 20 MINUTES AS starts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
s AS (SELECT *, count_if(coalesce(starts, false)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM o)
SELECT event_id, min(event_id) OVER (PARTITION BY event_type, burst) AS group_id FROM s""")
def q_burst_groups(spark: SparkSession, d: str) -> DataFrame:
    """Events of one type that follow each other within twenty minutes."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return opportunity.independence_groups(events, "event_id", {}, ("event_type", "ts", "20 MINUTES")).select("event_id", "group_id")
