"""Queries over the section hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators.hierarchy import descendants, hierarchy
from vellumspark.tables import current_rows, load


def current_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(load(spark, sf_dir, "sections"), ["doc_id", "section_id"], "detected_at", ["parent_id", "level"])


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(current_sections(spark, sf_dir), ["doc_id"], "section_id", "parent_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections on or below a circle of parents, or with a level that differs from their depth."""
    levels = current_sections(spark, sf_dir).select("doc_id", "section_id", "level")
    wrong = F.col("circle").isNotNull() | (F.col("level") != F.col("depth"))
    return section_tree(spark, sf_dir).join(levels, ["doc_id", "section_id"]).where(wrong).select("doc_id", "section_id")


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section with its root, depth, path, number of sections below it, and where it stands to circles."""
    tree = section_tree(spark, sf_dir)
    return tree.select("doc_id", "section_id", F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"), (F.col("last") - F.col("first")).alias("n_below"), "circle")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a section and one below it."""
    return descendants(section_tree(spark, sf_dir), ["doc_id"], "section_id")


QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants}

_TREE = r"""
WITH RECURSIVE cur AS (
  SELECT doc_id, section_id, parent_id, level FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY detected_at DESC NULLS LAST, parent_id NULLS LAST, level NULLS LAST) AS rn FROM sections)
  WHERE rn = 1 AND section_id IS NOT NULL),
names AS (SELECT doc_id, lower(trim(section_id, e' \t\n\r')) AS k, min(section_id) AS id FROM cur GROUP BY ALL),
link AS (SELECT c.doc_id, c.section_id, c.level, n.id AS parent FROM cur c LEFT JOIN names n ON n.doc_id = c.doc_id AND n.k = lower(trim(c.parent_id, e' \t\n\r'))),
tree AS (
  SELECT doc_id, section_id, level, section_id AS root_id, 1::BIGINT AS depth, [section_id] AS path FROM link WHERE parent IS NULL
  UNION ALL
  SELECT l.doc_id, l.section_id, l.level, t.root_id, t.depth + 1, list_append(t.path, l.section_id) FROM link l JOIN tree t ON l.doc_id = t.doc_id AND l.parent = t.section_id),
walk AS (
  SELECT l.doc_id, l.section_id, l.parent AS up FROM link l ANTI JOIN tree t ON l.doc_id = t.doc_id AND l.section_id = t.section_id
  UNION
  SELECT w.doc_id, w.section_id, l.parent FROM walk w JOIN link l ON l.doc_id = w.doc_id AND l.section_id = w.up),
astray AS (SELECT doc_id, section_id, CASE WHEN bool_or(up = section_id) THEN 'on' ELSE 'below' END AS circle FROM walk GROUP BY ALL),
pairs AS (SELECT doc_id, unnest(path[:-2]) AS ancestor, section_id AS descendant, path FROM tree WHERE depth > 1)
"""

ORACLES = {
    "p2_found": _TREE + "SELECT doc_id, section_id FROM tree WHERE level <> depth UNION SELECT doc_id, section_id FROM astray",
    "p2_hierarchy": _TREE
    + """SELECT t.doc_id, t.section_id, root_id, depth, array_to_string(path, '/') AS path, (SELECT count(*) FROM pairs p WHERE p.doc_id = t.doc_id AND p.ancestor = t.section_id) AS n_below, NULL::VARCHAR AS circle FROM tree t
    UNION ALL SELECT doc_id, section_id, NULL, NULL, NULL, NULL, circle FROM astray""",
    "p2_descendants": _TREE + "SELECT doc_id, ancestor, descendant, (len(path) - list_position(path, ancestor))::BIGINT AS distance FROM pairs",
}
