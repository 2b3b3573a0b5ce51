"""Removal of passages repeated line for line: overlapping windows of three consecutive lines.

A line counts if it holds a word; blank lines are no part of a window, and stay. Each run of three counted lines of a
document is hashed; a hash found more than once anywhere keeps its first occurrence (smallest document id, then text
hash, then place), and the lines of all later occurrences go, overlapping occurrences merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.llm.common import free_name, materialize


def _windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (id, text_hash, key, at): at holds the places of a window's lines among all lines of the text."""
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda line, i: F.struct(i.alias("i"), F.trim(line, F.lit(" \t\u000b\f\r")).alias("line")))
    counted = F.filter(lines, lambda x: x["line"] != "")
    at = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), counted.alias("counted")).filter(F.size("counted") >= size)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("counted") - size),
        lambda k: F.struct(
            F.unhex(F.md5(F.concat_ws("\n", F.transform(F.slice("counted", k + 1, size), lambda x: x["line"])))).alias("key"),
            F.transform(F.slice("counted", k + 1, size), lambda x: x["i"]).alias("at"),
        ),
    )
    return at.select("id", "text_hash", F.explode(windows).alias("w")).select("id", "text_hash", "w.key", "w.at")


def repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """The lines to remove: (id, text_hash, removed: sorted places of lines), for documents that lose any.

    Windows are written once to the shared folder. A window that fills a third of the table is counted before the
    shuffle, and both sides of the join that finds later occurrences are plain scans, which Spark splits when skewed.
    """
    windows = materialize(spark, _windows(docs, id_col, text_col, size), "windows")
    place = F.struct("id", "text_hash", F.col("at")[0].alias("at"))
    repeated = windows.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    repeated = materialize(spark, repeated, "repeated")
    later = windows.join(repeated, "key").filter(~place.eqNullSafe(F.col("first")))
    return later.select("id", "text_hash", F.explode("at").alias("at")).groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("removed"))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and with ``n_lines`` and ``n_removed`` (long).

    A null text stays null with no lines; an empty text has one line. Rows that repeat both id and text are one document:
    each keeps or loses the same lines. Rows with null ids come first in the order. Other columns pass through; those
    named ``n_lines`` or ``n_removed`` are replaced.
    """
    own_hash, id_, hash_, removed = (free_name(docs, name) for name in ("own_hash", "id", "text_hash", "removed"))
    gone = repeated_lines(spark, docs, id_col, text_col, size).withColumnsRenamed({"id": id_, "text_hash": hash_, "removed": removed})
    rows = docs.withColumn(own_hash, F.xxhash64(text_col))
    joined = rows.join(gone, rows[id_col].eqNullSafe(gone[id_]) & (rows[own_hash] == gone[hash_]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    counts = {
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.coalesce(F.size(removed), F.lit(0)).cast("long"),
    }
    columns = [c for c in docs.columns if c not in counts]
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in columns), *(x.alias(n) for n, x in counts.items()))


#: DuckDB SQL for the query ``op3``: the same windows, compared by their lines instead of a hash.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), counted AS (
  SELECT doc_id, text, i, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
         row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS k
  FROM lines WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), windows AS (
  SELECT doc_id, text, i, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS key,
         [i, lead(i, 1) OVER w, lead(i, 2) OVER w] AS places
  FROM counted WINDOW w AS (PARTITION BY doc_id, text ORDER BY k)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM windows WHERE key IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, text, unnest(places) AS i FROM ranked WHERE r > 1
), kept AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS new_text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i
  GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.new_text AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
