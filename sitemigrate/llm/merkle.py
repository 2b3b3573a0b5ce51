"""A Merkle manifest of a dataset: every row's leaf and proof, worked out by partitions that swap roots like a butterfly.

Leaves of a group (a language) ascend by id and are cut into aligned partitions of ``FANOUT ** BLOCK_LEVELS`` leaves. Each
partition hashes its own subtree; then partitions swap roots round by round. In round r the partitions whose numbers differ
in digit r only (base ``FANOUT``) send each other the roots they have reached, and each of them hashes the parent itself.
So every partition hashes all its ancestors, keeps the siblings it was sent, and ends with its whole upper proof: nothing
is handed down again, and no task sees more than ``FANOUT`` roots at once. Above the groups the same rounds go on over the
groups' subroots.

Where a tree isn't full, a node with fewer partitions than its neighbours sends its root to their further members too (its
partitions take turns), so that each of them is sent one root from every sibling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemigrate.llm.common import ascii_lower, free_name, materialize, n_partitions


FANOUT = 8
#: Levels that a partition hashes alone: 512 leaves.
BLOCK_LEVELS = 3
STEP = "struct<before:string,after:string>"


def leaf_hash(columns: Sequence[Column | str]) -> Column:
    """Lower-case hex SHA-256 of the values: ``-`` for null, else the UTF-8 byte count, a colon and the value."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*(field(F.col(c) if isinstance(c, str) else c) for c in columns)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings (see ``manifest``) lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_hash(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _runs(nodes: list[str]) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(nodes), FANOUT)]


def _subtree(leaves: list[str], whole: bool, height: int) -> list[list[str]]:
    """All levels of a partition: up to one node where it holds the ``whole`` group, else ``height`` above the leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1 if whole else len(levels) <= height:
        levels.append(_runs(levels[-1]))
    return levels


def _in_order(spark: SparkSession, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in ``order``, with ``part`` and the row's number in its part (``row``)."""
    n = n_partitions(spark)
    placed = df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    numbered = placed.withColumn("place", F.monotonically_increasing_id())
    return materialize(spark, numbered.select("*", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("row")).drop("place"), name)


def _groups(spark: SparkSession, sizes: DataFrame, size: int) -> DataFrame:
    """(group, n, no, blocks): the groups numbered in their order; ``sizes`` has (group, part, n)."""
    totals = sizes.groupBy("group").agg(F.sum("n").alias("n"))
    placed = _in_order(spark, totals, ["group"], "groups")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number for each partition
    before = F.array(*(F.lit(sum(counts.get(k, 0) for k in range(part))).cast("long") for part in range(max(counts, default=0) + 1)))
    return placed.select("group", "n", (F.element_at(before, F.col("part").cast("int") + 1) + F.col("row")).alias("no"), F.ceil(F.col("n") / size).cast("long").alias("blocks"))


def _group_rounds(spark: SparkSession, groups: DataFrame) -> tuple[DataFrame, int]:
    """The groups with what they do in each round above them: ``swaps`` (lane, units of the node, lanes of the swap).

    A unit is a partition. The units below a node of the upper tree are its lanes; a swap has as many lanes as its largest
    node has units.
    """
    n = groups.count()
    state = groups.withColumns({"lane": F.lit(0).cast("long"), "units": F.col("blocks"), "swaps": F.array().cast("array<struct<lane:bigint,units:bigint,lanes:bigint>>")})
    rounds = 0
    while FANOUT**rounds < n:
        node = F.floor(F.col("no") / FANOUT**rounds)
        nodes = state.groupBy(node.alias("node")).agg(F.first("units").alias("units"))
        members = nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("swap")).agg(F.collect_list(F.struct("node", "units")).alias("members"))
        joined = state.join(members, F.floor(F.col("no") / FANOUT ** (rounds + 1)) == F.col("swap"))
        total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["units"])
        step = F.struct("lane", "units", F.array_max(F.transform("members", lambda x: x["units"])).alias("lanes"))
        earlier = total(F.filter("members", lambda x: x["node"] < node))
        joined = joined.withColumns({"swaps": F.concat("swaps", F.array(step)), "lane": F.col("lane") + earlier, "units": total(F.col("members"))})
        state = materialize(spark, joined.drop("swap", "members"), "rounds")
        rounds += 1
    return state.drop("lane", "units"), rounds


def _swap(units: DataFrame, level: Column, position: Column, swap: Column, lane: Column, own: Column, lanes: Column, active: Column) -> DataFrame:
    """One round: each active unit sends its node to its lane, and turns by turn to lanes that its node lacks.

    A lane gathers at most one node for each position of the run. Units hash the parent and add their siblings to the proof.
    """
    fields = [c for c in units.columns if c not in ("node", "proof")]
    sent = units.filter(active).select(
        level.alias("__level"), swap.alias("__swap"), F.explode(F.sequence(lane, lanes - 1, own)).alias("__lane"), lane.alias("__home"), position.alias("at"), "node", F.struct(*fields, "proof").alias("unit"),
    )
    mine = F.when(F.col("__lane") == F.col("__home"), F.struct("at", "unit"))
    met = sent.groupBy("__level", "__swap", "__lane").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("run"), F.collect_list(mine).alias("home"))
    each = met.select("run", F.inline("home"))
    side = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")
    step = F.struct(side(lambda x: x["at"] < F.col("at")).alias("before"), side(lambda x: x["at"] > F.col("at")).alias("after"))
    parent = F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), ""), 256)
    done = each.select(*(F.col("unit")[c].alias(c) for c in fields), parent.alias("node"), F.concat(F.col("unit.proof"), F.array(step)).alias("proof"))
    return done.unionByName(units.filter(~active).select(*done.columns))


def manifest(spark: SparkSession, docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", carry: Sequence[str] = (), block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per input row: ``id_col``, ``group_col``, the ``carry`` columns, ``leaf``, ``subroot``, ``root`` and ``proof``.

    ``proof`` lists, from the leaf's level to the root, the siblings of the node on the path: those before and those after
    it, digests joined. Rows of a group ascend by id, null ids first, equal ids by their leaves; a null group comes first
    and is a group of its own, the empty string another. An empty table gives no rows. Only the columns named are read, and
    texts stay where they are: rows travel as digests. A group that holds all rows spreads over its partitions.
    """
    size = FANOUT**block_levels
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("group"), F.unhex(leaf_hash(columns)).alias("leaf"), F.struct(F.lit(0).alias("none"), *carry).alias("carry"))
    leaves = materialize(spark, leaves, "leaves")
    placed = _in_order(spark, leaves, ["group", "id", "leaf"], "ordered")
    sizes = materialize(spark, placed.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")), "sizes")
    groups, rounds = _group_rounds(spark, _groups(spark, sizes, size))
    groups = materialize(spark, groups, "groups")
    so_far = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("group").alias("g"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first")).alias("shift"))
    numbers = groups.select(F.col("group").alias("g"), "no", F.col("n").alias("n_group"))
    starts = starts.join(numbers, starts["g"].eqNullSafe(numbers["g"])).select(starts["g"], "p", "shift", "no", "n_group")
    at = placed.join(starts, placed["group"].eqNullSafe(starts["g"]) & (placed["part"] == starts["p"])).withColumn("place", F.col("row") + F.col("shift"))
    rows = at.select("no", F.floor(F.col("place") / size).alias("block"), F.col("place").cast("long").alias("place"), (F.col("n_group") <= size).alias("whole"), "id", "group", "leaf", "carry")
    rows = materialize(spark, rows, "rows")
    units = rows.select("no", "block", "place", "whole", "leaf").groupBy("no", "block").applyInArrow(_block_root(block_levels), "no long, block long, node string")
    uppers = _upper(spark, units, groups, rounds)
    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("group", T.StringType()), T.StructField("carry", rows.schema["carry"].dataType), *T.StructType.fromDDL(f"leaf string, subroot string, root string, proof array<{STEP}>").fields])
    proofs = rows.groupBy("no", "block").cogroup(uppers.groupBy("no", "block")).applyInArrow(_proofs(block_levels), kind)
    return proofs.select(F.col("id").alias(id_col), *([F.col("group").alias(group_col)] if group_col != id_col else []), *(F.col("carry")[c].alias(c) for c in carry), "leaf", "subroot", "root", "proof")


def _upper(spark: SparkSession, units: DataFrame, groups: DataFrame, rounds: int) -> DataFrame:
    """(no, block, subroot, root, proof) of each partition, after all rounds."""
    units = units.join(groups.select("no", "blocks", "swaps"), "no").withColumn("proof", F.array().cast(f"array<{STEP}>")).withColumn("subroot", F.lit(None).cast("string"))
    units = materialize(spark, units, "units")
    most = groups.agg(F.max("blocks")).first()[0] or 0
    r = 0
    while FANOUT**r < most:  # rounds within groups
        below, block = FANOUT**r, F.col("block")
        node = F.floor(block / below)
        first = node * below
        own = F.least(F.lit(below), F.col("blocks") - first)
        lanes = F.least(F.lit(below), F.col("blocks") - F.floor(node / FANOUT) * FANOUT * below)
        units = materialize(spark, _swap(units, F.col("no"), node % FANOUT, F.floor(node / FANOUT), block % below, own, lanes, F.col("blocks") > below), "units")
        r += 1
    units = units.withColumn("subroot", F.col("node"))
    for r in range(rounds):  # rounds over the groups
        swap = F.element_at("swaps", r + 1)
        node = F.floor(F.col("no") / FANOUT**r)
        units = materialize(spark, _swap(units, F.lit(-1).cast("long"), node % FANOUT, F.floor(node / FANOUT), swap["lane"] + F.col("block"), swap["units"], swap["lanes"], F.lit(True)), "units")
    return units.select("no", "block", "subroot", F.col("node").alias("root"), F.col("proof").alias("upper"))


def _sorted_leaves(table: pa.Table) -> tuple[pa.Table, list[str], bool]:
    table = table.sort_by("place").combine_chunks()
    return table, [x.hex() for x in table.column("leaf").to_pylist()], table.column("whole")[0].as_py()


def _block_root(height: int):
    def run(table: pa.Table) -> pa.Table:
        _, leaves, whole = _sorted_leaves(table)
        return pa.table({"no": table.column("no").slice(0, 1), "block": table.column("block").slice(0, 1), "node": pa.array([_subtree(leaves, whole, height)[-1][0]])})

    return run


def _proofs(height: int):
    """Rows of one partition with their proofs: the siblings below its root, then its upper proof."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, leaves, whole = _sorted_leaves(left)
        upper = right.slice(0, 1).to_pylist()[0]
        before, after, picks = [], [], []
        place = np.arange(len(leaves))
        for nodes in _subtree(leaves, whole, height)[:-1]:
            picks.append(place + len(before))
            for i in range(len(nodes)):
                start = i - i % FANOUT
                before.append("".join(nodes[start:i]))
                after.append("".join(nodes[i + 1 : start + FANOUT]))
            place = place // FANOUT
        for step in upper["upper"]:
            picks.append(np.full(len(leaves), len(before)))
            before.append(step["before"])
            after.append(step["after"])
        flat = pa.array(np.stack(picks, axis=1).ravel() if picks else np.zeros(0, np.int64))
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()).take(flat), pa.array(after, pa.string()).take(flat)], ["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1) * len(picks), pa.int32()), steps)
        same = lambda x: pa.array([x] * len(leaves), pa.string())
        return pa.table({"id": rows.column("id"), "group": rows.column("group"), "carry": rows.column("carry"), "leaf": pa.array(leaves), "subroot": same(upper["subroot"]), "root": same(upper["root"]), "proof": proof})

    return run


def audit(spark: SparkSession, docs: DataFrame, tampered: Column, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The manifest of ``docs``, each row's proof folded again from the row as it is now.

    ``tampered`` is the text a row has now. Adds ``folded_root`` and ``verified`` (it equals the root).
    """
    name = free_name(docs, "leaf_now")
    now = [tampered if c == text_col else F.col(c) for c in columns]
    changed = ~tampered.eqNullSafe(F.col(text_col))
    own = docs.withColumn(name, F.when(changed, F.unhex(leaf_hash(now))))
    rows = manifest(spark, own, columns, id_col, group_col, carry=[name])
    folded = rows.withColumn("folded_root", fold(F.coalesce(F.lower(F.hex(name)), "leaf"), F.col("proof"))).drop(name)
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_third(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text of the fixed test of a manifest: A-Z in lower case where 3 divides the CRC of the id's decimal form."""
    return F.when(F.crc32(F.col(id_col).cast("string")) % 3 == 0, ascii_lower(text_col)).otherwise(F.col(text_col))


#: DuckDB SQL for the query ``op13``: the tree level by level, and each path folded along it.
ORACLE_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, lang, source, n_chars, text,
         xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
                     lambda k: [(256 + ascii(substr(doc_id::VARCHAR, k::INT, 1)))::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda c, x: CASE WHEN x >= 256 THEN xor(c, x - 256) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) % 3 = 0 AS tampered
  FROM documents
), fields AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text_now
  FROM raw
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text_now) || ':' || text_now, '-')) AS leaf_now
  FROM fields
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM leaves
), inner_tree AS (
  SELECT g, 0 AS level, i, leaf AS node, n FROM ranked
  UNION ALL
  SELECT g, level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM inner_tree WHERE n > 1 GROUP BY g, level, i // 8
), tops AS (
  SELECT g, max(level) AS height, arg_max(node, level) AS subroot FROM inner_tree GROUP BY g
), outer_tree AS (
  SELECT 0 AS level, g AS i, subroot AS node, (SELECT count(*) FROM tops) AS n FROM tops
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM outer_tree WHERE n > 1 GROUP BY level, i // 8
), inner_path AS (
  SELECT g, i AS leaf_i, 0 AS level, i, leaf_now AS node, '' AS proof, n FROM ranked
  UNION ALL
  SELECT p.g, p.leaf_i, any_value(p.level) + 1, any_value(p.i) // 8, sha256(string_agg(CASE WHEN t.i = p.i THEN p.node ELSE t.node END, '' ORDER BY t.i)),
         any_value(p.proof) || coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (WHERE t.i <> p.i), ''), (any_value(p.n) + 7) // 8
  FROM inner_path p JOIN inner_tree t ON t.g = p.g AND t.level = p.level AND t.i // 8 = p.i // 8
  WHERE p.n > 1 GROUP BY p.g, p.leaf_i
), whole_path AS (
  SELECT g, leaf_i, 0 AS level, g AS i, node, proof, (SELECT count(*) FROM tops) AS n FROM inner_path WHERE n = 1
  UNION ALL
  SELECT p.g, p.leaf_i, any_value(p.level) + 1, any_value(p.i) // 8, sha256(string_agg(CASE WHEN t.i = p.i THEN p.node ELSE t.node END, '' ORDER BY t.i)),
         any_value(p.proof) || coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (WHERE t.i <> p.i), ''), (any_value(p.n) + 7) // 8
  FROM whole_path p JOIN outer_tree t ON t.level = p.level AND t.i // 8 = p.i // 8
  WHERE p.n > 1 GROUP BY p.g, p.leaf_i
), root AS (SELECT node AS root FROM outer_tree WHERE n = 1)
SELECT r.doc_id, r.leaf, s.subroot, root.root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = root.root AS verified
FROM ranked r JOIN tops s ON s.g = r.g JOIN whole_path w ON w.g = r.g AND w.leaf_i = r.i AND w.n = 1, root
"""
