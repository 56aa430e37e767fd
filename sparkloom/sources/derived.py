"""The code graph that is derived from the test tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sparkloom.session import stored

VIEWS = {
    "g_base": r"""
SELECT p_partkey AS pk, p_type, p_size AS start_line,
  CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'class' WHEN 2 THEN 'method' WHEN 4 THEN 'variable'
       WHEN 5 THEN 'import' WHEN 7 THEN 'constant' ELSE 'function' END AS kind,
  CASE WHEN p_partkey % 7 = 0 THEN '_' ELSE '' END ||
  CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_')
       ELSE upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2)
         || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) END AS name,
  lower(replace(p_brand, '#', '_')) || '/' || lower(p_type)
    || CASE WHEN p_size % 5 = 0 THEN '_test' ELSE '' END
    || CASE p_type WHEN 'ECONOMY' THEN '.py' WHEN 'STANDARD' THEN '.ts' WHEN 'PROMO' THEN '.go'
                   WHEN 'MEDIUM' THEN '.java' WHEN 'SMALL' THEN '.rs' ELSE '.c' END AS file_path,
  CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'STANDARD' THEN 'typescript' WHEN 'PROMO' THEN 'go'
              WHEN 'MEDIUM' THEN 'java' WHEN 'SMALL' THEN 'rust' ELSE 'c' END AS language
FROM part
""",
    "g_sym": r"""
SELECT kind || ':' || file_path || '::' || name || '#' || CAST(pk AS STRING) AS id, pk, kind, name,
       CASE WHEN kind = 'import' THEN module || '.' || name ELSE file_path || '::' || name END AS qualified_name,
       file_path, language, start_line, start_line + CAST(pk % 40 AS INT) AS end_line,
       pk % 3 = 0 AS is_exported
FROM (SELECT b.pk, b.kind, coalesce(d.name, b.name) AS name, b.file_path, b.language, b.start_line,
             regexp_replace(replace(coalesce(d.file_path, b.file_path), '/', '.'), '[.][^.]*$', '') AS module
      FROM g_base b LEFT JOIN g_base d ON b.kind = 'import' AND d.pk = b.pk + 1)
""",
    "g_files": r"""
SELECT file_path AS path, language, CAST(count(*) + 1 AS BIGINT) AS node_count, md5(file_path) AS content_hash
FROM g_sym GROUP BY file_path, language
""",
    "g_nodes": r"""
SELECT id, kind, name, qualified_name, file_path, language, start_line, end_line, is_exported FROM g_sym
UNION ALL
SELECT 'file:' || path, 'file', split_part(path, '/', 2), path, path, language, 1, 100, false FROM g_files
""",
    "g_raw": r"""
SELECT s, t, line, rf, ls, q FROM (
  SELECT l_partkey AS s,
         lead(l_partkey) OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t,
         l_linenumber AS line, l_returnflag AS rf, l_linestatus AS ls, l_quantity AS q
  FROM lineitem)
WHERE t IS NOT NULL
""",
    "g_edges": r"""
SELECT a.id AS source, b.id AS target,
       CASE r.rf WHEN 'A' THEN 'calls' WHEN 'R' THEN 'references' ELSE 'imports' END AS kind, r.line AS line
FROM g_raw r JOIN g_sym a ON a.pk = r.s JOIN g_sym b ON b.pk = r.t WHERE r.q <= 5
UNION ALL
SELECT a.id, b.id, CASE r.ls WHEN 'F' THEN 'extends' ELSE 'implements' END, r.line
FROM g_raw r JOIN g_sym a ON a.pk = r.s JOIN g_sym b ON b.pk = r.t
WHERE r.q > 8 AND r.q <= 20 AND a.kind = 'class' AND b.kind = 'class' AND r.s <> r.t
UNION ALL
SELECT 'file:' || file_path, id, 'contains', CAST(NULL AS INT) FROM g_sym
UNION ALL
SELECT 'file:' || file_path, id, 'exports', CAST(NULL AS INT) FROM g_sym WHERE pk % 11 = 0
""",
    "g_refs": r"""
SELECT a.id AS from_node_id, a.file_path AS file_path, r.line AS line, 'call' AS reference_kind,
       CASE r.line % 3 WHEN 0 THEN 'obj.' || b.name WHEN 1 THEN b.name
            ELSE CASE WHEN r.s % 5 = 0 THEN 'ext_' || b.name ELSE b.name END END AS reference_name
FROM g_raw r JOIN g_sym a ON a.pk = r.s JOIN g_sym b ON b.pk = r.t WHERE r.q > 5 AND r.q <= 8
UNION ALL
SELECT id, file_path, start_line, 'imports', regexp_replace(qualified_name, '[.][^.]*$', '')
FROM g_sym WHERE kind = 'import'
UNION ALL
SELECT f.from_id, i.file_path, i.start_line, 'call', i.name
FROM g_sym i JOIN (SELECT file_path, min(id) AS from_id FROM g_sym WHERE kind <> 'import' GROUP BY file_path) f
  ON f.file_path = i.file_path
WHERE i.kind = 'import'
""",
    "g_changes": r"""
SELECT event_id, ts, 'proj_' || CAST(user_id AS STRING) || '/f' || CAST(event_id % 20 AS STRING) || '.py' AS path,
       CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'modified' END AS change_type
FROM events
""",
}
TABLES = {"g_base": ["part"], "g_raw": ["lineitem"], "g_changes": ["events"]}
NEEDS = {
    "g_base": [],
    "g_sym": ["g_base"],
    "g_files": ["g_base", "g_sym"],
    "g_nodes": ["g_base", "g_sym", "g_files"],
    "g_raw": [],
    "g_edges": ["g_base", "g_sym", "g_raw"],
    "g_refs": ["g_base", "g_sym", "g_raw"],
    "g_changes": [],
}


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH clause that defines the named views and what they need."""
    wanted = {x for n in names for x in (*NEEDS[n], n)}
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted)


@dataclass(frozen=True)
class Derived:
    """Access to the derived tables of one folder; nodes, edges and references are made once, as a graph store has them."""

    spark: SparkSession
    folder: str
    made: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql, seen = with_views(name) + f"\nSELECT * FROM {name}", {}
        for n in (*NEEDS[name], name):
            for t in TABLES.get(n, []):
                seen[t] = self.table(t)
        for t, df in seen.items():
            df.createOrReplaceTempView(t)
        return self.spark.sql(sql)

    def once(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = stored(self.view(name), name)
        return self.made[name]

    sym = property(lambda self: self.view("g_sym"))
    nodes = property(lambda self: self.once("g_nodes"))
    edges = property(lambda self: self.once("g_edges"))
    files = property(lambda self: self.view("g_files"))
    refs = property(lambda self: self.once("g_refs"))
    changes = property(lambda self: self.view("g_changes"))
