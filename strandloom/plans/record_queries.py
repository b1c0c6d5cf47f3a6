"""Registered queries of the general record operators (hierarchies, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import hierarchy as hi
from strandloom.operators import nested
from strandloom.runtime import table


def _tree(spark: SparkSession, d: str, paths: bool = False) -> DataFrame:
    return hi.hierarchy(hi.child_links(table(spark, d, "dendrogram_nodes"), table(spark, d, "parent_index")), paths=paths)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("node_id", "root_id", "depth", "state")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its full path as text, its number of descendants and the cycle-closing mark."""
    return _tree(spark, d, paths=True).select(
        "node_id",
        F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"),
        F.when(F.col("state") == "rooted", F.col("n_descendants")).alias("n_descendants"),
        "closes_cycle",
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All nodes below every node whose id is divisible by 100 (the stated query set)."""
    return hi.descendants(_tree(spark, d), lambda node: node % 100 == 0)


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    """All nodes below every node, on and below cycles too, as intervals of a pre-order
    (see :func:`strandloom.operators.hierarchy.intervals`)."""
    return hi.intervals(hi.child_links(table(spark, d, "dendrogram_nodes"), table(spark, d, "parent_index")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "branch_pools"), nested.NAMED, attributes=False).select(
        "pool_id", "branch_id", "entity", "parent_key", "item_key"
    )


def p3_variants(spark: SparkSession, d: str) -> DataFrame:
    """How often each shape of each entity was met."""
    return nested.variant_counts(nested.flatten(table(spark, d, "branch_pools")))


def typed_table(entity: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.subtype_table(nested.flatten(table(spark, d, "branch_pools"), [entity]), entity).drop("variant")

    query.__name__ = "p3_scores" if entity == "local_score" else f"p3_{entity}_table"
    query.__doc__ = f"The typed subtype table of {entity}."
    return query


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_intervals, p3_found, p3_variants, *map(typed_table, nested.SUBTYPES))}

_LINKS = """
dn AS (SELECT DISTINCT node_id, left_id, right_id FROM (
         SELECT *, rank() OVER (PARTITION BY node_id ORDER BY exported_at DESC NULLS LAST) AS r
         FROM dendrogram_nodes WHERE node_id IS NOT NULL) WHERE r = 1),
pi AS (SELECT DISTINCT node_id, parent_by_node FROM (
         SELECT *, rank() OVER (PARTITION BY node_id ORDER BY exported_at DESC NULLS LAST) AS r
         FROM parent_index WHERE node_id IS NOT NULL) WHERE r = 1),
nodes AS (SELECT node_id FROM dn UNION SELECT node_id FROM pi),
raw AS (SELECT left_id AS child, node_id AS parent FROM dn UNION SELECT right_id, node_id FROM dn
        UNION SELECT node_id, parent_by_node FROM pi),
links AS (SELECT child, min(parent) AS parent FROM raw
          WHERE child IN (SELECT node_id FROM nodes) AND parent IN (SELECT node_id FROM nodes) GROUP BY child),
rooted AS (SELECT node_id, node_id AS root_id, 0 AS depth, CAST(node_id AS VARCHAR) AS path
           FROM nodes WHERE node_id NOT IN (SELECT child FROM links)
           UNION ALL
           SELECT l.child, r.root_id, r.depth + 1, r.path || '/' || CAST(l.child AS VARCHAR)
           FROM rooted r JOIN links l ON l.parent = r.node_id),
stuck AS (SELECT child, parent FROM links WHERE child NOT IN (SELECT node_id FROM rooted)),
walk AS (SELECT child AS node_id, parent AS anc FROM stuck
         UNION SELECT w.node_id, s.parent FROM walk w JOIN stuck s ON s.child = w.anc),
cyc AS (SELECT node_id FROM walk WHERE node_id = anc)
"""



def _open(value: str) -> str:
    """SQL of a JSON value; of one that is a text, what the text encodes if that is an object or list."""
    text = f"trim({value}->>'$', E' \\t\\n\\r')"
    return (
        f"CASE WHEN json_type({value}) = 'VARCHAR' AND left({text}, 1) IN ('{{', '[') AND right({text}, 1) IN ('}}', ']') "
        f"AND json_valid({text}) THEN {text}::JSON ELSE {value} END"
    )


def _records(name: str, source: str, column: str, key: str, marks: list[str]) -> str:
    """CTEs of the records that ``column`` of ``source`` holds, as (keys of source, key, v)."""
    marked = " OR ".join(f"json_exists({name}_o.j, '$.{m}')" for m in marks)
    return f"""
{name}_o AS (SELECT * EXCLUDE ({column}), {_open(column)} AS j FROM {source}),
{name}_r AS (
  SELECT * EXCLUDE (j), NULL AS k, unnest(json_extract(j, '$[*]')) AS raw FROM {name}_o WHERE json_type(j) = 'ARRAY'
  UNION ALL SELECT * EXCLUDE (j), NULL, j FROM {name}_o WHERE json_type(j) = 'OBJECT' AND ({marked})
  UNION ALL SELECT * EXCLUDE (j, u), u, json_extract(j, '$."' || u || '"')
    FROM (SELECT *, unnest(json_keys(j)) AS u FROM {name}_o WHERE json_type(j) = 'OBJECT' AND NOT ({marked}))),
{name}_v AS (SELECT * EXCLUDE (raw), {_open('raw')} AS v FROM {name}_r),
{name} AS (SELECT * EXCLUDE (k, v), coalesce(v->>'$.{key}', k) AS key, v FROM {name}_v WHERE json_type(v) = 'OBJECT' AND coalesce(v->>'$.{key}', k) IS NOT NULL)"""


def _texts(name: str, source: str, field: str) -> str:
    """CTEs of the texts in a field of the records of ``source``: (pool_id, b, key, item, position)."""
    return f"""
{name}_o AS (SELECT pool_id, b, key, {_open("(v->'$." + field + "')")} AS j FROM {source}),
{name}_l AS (SELECT pool_id, b, key, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN [] WHEN 'NULL' THEN [] ELSE [j] END AS js
  FROM {name}_o WHERE j IS NOT NULL),
{name}_f AS (SELECT pool_id, b, key, list_filter(js, lambda x: json_type(x) NOT IN ('NULL', 'OBJECT') AND trim(x->>'$', E' \\t\\n\\r') <> '') AS js FROM {name}_l),
{name} AS (SELECT pool_id, b, key, unnest(js)->>'$' AS item, generate_subscripts(js, 1) - 1 AS position FROM {name}_f)"""


_POOLS = f"""
pool AS (SELECT pool_id, branches::JSON AS raw FROM (
           SELECT pool_id, arg_max(branches, (coalesce(received_at, TIMESTAMP '0001-01-01'), coalesce(branches, ''))) AS branches
           FROM branch_pools WHERE pool_id IS NOT NULL GROUP BY pool_id) WHERE json_valid(branches)),
opened AS (SELECT pool_id, {_open('raw')} AS j FROM pool),
held AS (SELECT pool_id, CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.branches') AND NOT json_exists(j, '$.branch_id') THEN j->'$.branches' ELSE j END AS j0 FROM opened),
{_records("br", "held", "j0", "branch_id", ["branch_id", "actor_step", "verifier_step", "local_score", "observation"])},
parts AS (SELECT pool_id, key AS b, v, {_open("(v->'$.actor_step')")} AS actor, {_open("(v->'$.verifier_step')")} AS verifier,
            {_open("(v->'$.local_score')")} AS score, {_open("(v->'$.observation')")} AS seen FROM br),
steps AS (SELECT *, {_open("(actor->'$.tool_action')")} AS call, {_open("(verifier->'$.updated_state')")} AS st,
            {_open("(verifier->'$.updated_interpretation')")} AS read, {_open("(score->'$.score_metadata')")} AS meta FROM parts),
calls AS (SELECT pool_id, b, call->>'$.call_id' AS key, call AS v FROM steps WHERE json_type(call) = 'OBJECT' AND call->>'$.call_id' IS NOT NULL),
g_in AS (SELECT pool_id, b, st->'$.predicted_groups' AS x FROM steps), {_records("gr", "g_in", "x", "group_id", ["group_id"])},
e_in AS (SELECT pool_id, b, st->'$.evidence_log' AS x FROM steps), {_records("ev", "e_in", "x", "evidence_id", ["evidence_id"])},
l_in AS (SELECT pool_id, b, st->'$.mechanistic_labels' AS x FROM steps), {_records("la", "l_in", "x", "label_name", ["label_name"])},
{_texts("gg", "gr", "gene_ids")}, {_texts("eg", "ev", "supporting_gene_ids")}, {_texts("le", "la", "evidence_ids")}
"""


def _entries(source: str, value: str, key: str) -> str:
    """SQL of the free entries of an object, with the keys of ``source``."""
    return f"""SELECT pool_id, b AS branch_id, {key} AS parent_key, u AS item_key, j FROM (
      SELECT pool_id, b, {key}, u, json_extract(o, '$."' || u || '"') AS j FROM (
        SELECT *, unnest(json_keys(o)) AS u FROM (SELECT *, {_open(value)} AS o FROM {source}) WHERE json_type(o) = 'OBJECT'))"""


_ENTRY = "CASE WHEN json_type(j) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN (j->>'$')::DOUBLE END AS number, CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j)::BIGINT END AS n_items"
_ENTRIES = {"tool_argument": ("calls", "(v->'$.arguments')", "key"), "score_weight": ("steps", "(meta->'$.weights')", "b")}
_DOUBLE = "try_cast({0}->>'$.{1}' AS DOUBLE) AS {1}"


def _typed(entity: str) -> str:
    """SQL of a typed table."""
    plain = {
        "branch": "SELECT pool_id, b AS branch_id, pool_id::VARCHAR AS parent_key, b AS item_key, verifier->>'$.continuation_decision' AS decision, read->>'$.mechanistic_claim' AS claim, seen->>'$.status' AS status, try_cast(st->>'$.remaining_budget' AS BIGINT) AS remaining_budget, actor->>'$.reasoning_text' AS reasoning_text FROM steps",
        "tool_action": "SELECT pool_id, b AS branch_id, b AS parent_key, key AS item_key, v->>'$.tool_name' AS tool_name FROM calls",
        "local_score": f"SELECT pool_id, b AS branch_id, b AS parent_key, b AS item_key, {', '.join(_DOUBLE.format('score', k) for k in ('schema_score', 'complex_membership_delta', 'total_score', 'normalized_score'))}, try_cast(meta->>'$.schema_valid' AS BOOLEAN) AS schema_valid FROM steps WHERE json_type(score) <> 'NULL'",
        "group": "SELECT pool_id, b AS branch_id, b AS parent_key, key AS item_key, v->>'$.rationale' AS rationale FROM gr",
        "evidence": "SELECT pool_id, b AS branch_id, b AS parent_key, key AS item_key, v->>'$.source_type' AS source_type, v->>'$.summary' AS summary FROM ev",
        "label": "SELECT pool_id, b AS branch_id, b AS parent_key, key AS item_key, v->>'$.label_source' AS label_source FROM la",
    }
    lists = {"group_gene": "gg", "evidence_gene": "eg", "label_evidence": "le"}
    if entity in plain:
        return plain[entity]
    if entity in lists:
        return f"SELECT pool_id, b AS branch_id, key AS parent_key, item AS item_key, min(position)::BIGINT AS position FROM {lists[entity]} GROUP BY ALL"
    of = entity.removesuffix("_item")
    entries = _entries(*_ENTRIES[of])
    if of == entity:
        return f"SELECT pool_id, branch_id, parent_key, item_key, CASE WHEN json_type(j) <> 'ARRAY' THEN j->>'$' END AS value, {_ENTRY} FROM ({entries}) WHERE json_type(j) <> 'NULL'"
    return f"""SELECT pool_id, branch_id, name AS parent_key, item AS item_key, min(position)::BIGINT AS position FROM (
      SELECT pool_id, branch_id, item_key AS name, unnest(json_extract_string(j, '$[*]')) AS item, unnest(range(json_array_length(j)::BIGINT)) AS position
      FROM ({entries}) WHERE json_type(j) = 'ARRAY') WHERE trim(item) <> '' GROUP BY ALL"""


ORACLE = {
    "p3_found": f"WITH {_POOLS} " + " UNION ".join(f"SELECT pool_id, branch_id, '{e}' AS entity, parent_key, item_key FROM ({_typed(e)})" for e in nested.NAMED),
    **{typed_table(e).__name__: f"WITH {_POOLS} SELECT DISTINCT * FROM ({_typed(e)})" for e in nested.SUBTYPES},
    "p1_found": f"""
WITH RECURSIVE {_LINKS}
SELECT node_id, root_id, depth, 'rooted' AS state FROM rooted
UNION ALL
SELECT w.node_id, min(w.anc) AS root_id, -1 AS depth,
       CASE WHEN w.node_id IN (SELECT node_id FROM cyc) THEN 'on_cycle' ELSE 'below_cycle' END AS state
FROM walk w WHERE w.anc IN (SELECT node_id FROM cyc) GROUP BY w.node_id
""",
    "p1_descendants": f"""
WITH RECURSIVE {_LINKS},
down AS (SELECT parent AS node_id, child AS descendant_id, 1 AS distance FROM links
         WHERE parent IN (SELECT node_id FROM rooted) AND parent % 100 = 0
         UNION ALL SELECT d.node_id, l.child, d.distance + 1 FROM down d JOIN links l ON l.parent = d.descendant_id)
SELECT node_id, descendant_id, distance FROM down
""",
    "p1_paths": f"""
WITH RECURSIVE {_LINKS},
top AS (SELECT w.node_id, min(w.anc) AS root_id FROM walk w WHERE w.anc IN (SELECT node_id FROM cyc) GROUP BY w.node_id),
shut AS (SELECT s.parent AS node_id FROM stuck s JOIN top t ON t.node_id = s.child
         WHERE s.child = t.root_id AND s.child IN (SELECT node_id FROM cyc)),
size AS (SELECT a.node_id, count(*) - 1 AS n FROM rooted a JOIN rooted b
         ON b.root_id = a.root_id AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY a.node_id)
SELECT r.node_id, r.path, s.n AS n_descendants, FALSE AS closes_cycle FROM rooted r JOIN size s USING (node_id)
UNION ALL
SELECT child, '' AS path, NULL, child IN (SELECT node_id FROM shut) FROM stuck
""",
}
