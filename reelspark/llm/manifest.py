"""Merkle manifests of datasets.

Each row is a leaf: the SHA-256 of its fields. Within a group, leaves stand in order of id; every eight
neighbours (the last run may be shorter) become one parent, level by level, until one node is left.
The groups' nodes go on in the same way to one root.

Aligned blocks of 512 leaves keep each level as one string of hex digests, 64 letters a node. Fixed-width
substrings of a level are hashed to the next one, and what stands beside a node in its run, left and
right, are its siblings. The blocks' own nodes are the leaves of the next round, so that no group, whatever its
size, meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import in_order, lower_ascii, materialise, read_table

#: The fields of a leaf in their order, and nodes that become one parent.
FIELDS, FAN = ("doc_id", "source", "lang", "n_chars", "text"), 8
#: Letters of a digest, and levels that one block climbs.
HEX, LEVELS = 64, 3
BLOCK = FAN**LEVELS
RUN = FAN * HEX


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 (lower-case hex) of fields one after another: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    as_text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text]).cast("binary"), 256)


def folded(node: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings (left, right) on each level lead to."""
    return F.aggregate(siblings, node, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]).cast("binary"), 256))


def proof_of(siblings: Column) -> Column:
    """All siblings one after another, level by level, left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


def _runs(level: str) -> Column:
    return F.expr(f"transform(sequence(0, cast((length({level}) - 1) div {RUN} AS int)), r -> substring({level}, r * {RUN} + 1, {RUN}))")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, n, block, items, h, r0, r1, r2, top): the blocks of ``nodes`` (g, n, pos, node, own), their runs on each level and their last node.

    n is how many nodes the whole group has, h the levels that a block of it climbs.
    """
    blocks = nodes.groupBy("g", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", "own"))).alias("items"))
    height = reduce(lambda out, k: F.when(F.col("n") <= FAN**k, k).otherwise(out), reversed(range(LEVELS)), F.lit(LEVELS))
    blocks = blocks.withColumn("h", height).withColumn("l0", F.array_join("items.node", ""))
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"r{k}", F.when(F.col("h") > k, _runs(f"l{k}")))
        blocks = blocks.withColumn(f"l{k + 1}", F.when(F.col("h") > k, F.array_join(F.transform(f"r{k}", lambda run: F.sha2(run.cast("binary"), 256)), "")))
    return blocks.select("g", "n", "block", "items", "h", *[f"r{k}" for k in range(LEVELS)], F.coalesce(*[f"l{k}" for k in reversed(range(LEVELS + 1))]).alias("top"))


def _siblings(k: int) -> str:
    """SQL of the siblings on level ``k`` of the item ``i`` of a block."""
    run, at = f"r{k}[i div {FAN ** (k + 1)}]", f"(i div {FAN**k}) % {FAN} * {HEX}"
    return f"named_struct('left', substring({run}, 1, cast({at} AS int)), 'right', substring({run}, cast({at} + {HEX + 1} AS int)))"


def _up(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes``, then the last nodes of their blocks, and so on; in the end (g, top), one node a group.

    ``most`` is the largest group's count of nodes. Each round leaves one node in 512.
    """
    rounds = [nodes]
    while True:
        ends = _blocks(rounds[-1]).select("g", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("block").alias("pos"), F.col("top").alias("node"), F.lit(None).cast("boolean").alias("own"))
        rounds.append(materialise(ends))
        if most <= BLOCK:
            rounds[-1] = rounds[-1].select("g", F.col("node").alias("top"))
            return rounds
        most = -(-most // BLOCK)


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, pos, own, node, siblings, top, root) of every node of the first round: its siblings on each level up to the root.

    ``above`` (g, above, top, root) has the siblings of each group's last node.
    """
    above = above.withColumn("block", F.lit(0).cast("long"))
    here = ", ".join(_siblings(k) for k in range(LEVELS))
    items = F.expr(f"transform(items, (x, i) -> named_struct('pos', x.pos, 'own', x.own, 'node', x.node, 'siblings', concat(slice(array({here}), 1, h), above)))")
    for nodes in reversed(rounds[:-1]):
        blocks = _blocks(nodes).drop("top").join(materialise(above), ["g", "block"])
        out = blocks.select("g", "top", "root", F.explode(items).alias("x")).select("g", "x.pos", "x.own", "x.node", "x.siblings", "top", "root")
        above = out.select("g", F.col("pos").alias("block"), F.col("siblings").alias("above"), "top", "root")
    return out


def manifest(documents: DataFrame, fields: tuple[str, ...] = FIELDS, group_column: str = "lang", id_column: str = "doc_id", carried: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, leaf, siblings, subroot, root, and what is ``carried``) of every row.

    ``siblings`` has a struct (left, right) for each level from the leaf to the root: the digests that
    stand beside the node in its run. ``carried`` are columns worked out of the given ones in the scan
    that makes the leaves.

    Groups are ordered by their names (null first), leaves by id (null first), rows with equal ids by
    their digest; so repeated rows are leaves of their own, and equal ones can't be told apart. Null
    fields, empty and very long texts are values like others. An empty table has no leaves and no
    root. Other columns are ignored, whatever their names.

    Texts are read once. What is sorted and climbed holds digests only.
    """
    own = F.struct(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{group_column}`").alias("_group"), *[c.alias(f"_c{k}") for k, c in enumerate((carried or {}).values())])
    leaves = materialise(documents.select(own.alias("own"), digest_of([F.col(f"`{c}`") for c in fields]).alias("node")))
    ordered = in_order(leaves, F.col("own._group").asc_nulls_first(), F.col("own._id").asc_nulls_first(), F.col("node").asc())
    groups = materialise(ordered.groupBy(F.col("own._group").alias("_of")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_start")))
    groups = materialise(in_order(groups, F.col("_of").asc_nulls_first()).withColumnRenamed("_at", "g"))
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    nodes = ordered.join(groups, F.col("own._group").eqNullSafe(F.col("_of"))).select("g", "n", (F.col("_at") - F.col("_start")).alias("pos"), "node", "own")
    nodes = materialise(nodes)
    rounds = _up(nodes, size["most"])
    one = F.lit(0).cast("long").alias("g")
    subroots = rounds[-1].select(one, F.lit(size["groups"]).cast("long").alias("n"), F.col("g").alias("pos"), F.col("top").alias("node"), F.lit(None).cast("boolean").alias("own"))
    tops = _up(subroots, size["groups"])
    of_root = tops[-1].select("g", F.expr("cast(array() AS array<struct<left: string, right: string>>)").alias("above"), "top", F.col("top").alias("root"))
    above = _down(tops, of_root).select(F.col("pos").alias("g"), F.col("siblings").alias("above"), F.col("node").alias("top"), "root")
    names = [F.col(f"own._c{k}").alias(c) for k, c in enumerate(carried or {})]
    return _down(rounds, above).select(F.col("own._id").alias(id_column), F.col("own._group").alias(group_column), F.col("node").alias("leaf"), "siblings", F.col("top").alias("subroot"), "root", *names)


def verified(rows: DataFrame, candidate: str) -> DataFrame:
    """``rows`` of a manifest with folded_root and verified: whether the leaf in column ``candidate`` leads to the root over the row's siblings."""
    return rows.withColumn("folded_root", folded(F.col(candidate), F.col("siblings"))).withColumn("verified", F.col("folded_root") == F.col("root"))


# ---- queries ----


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a document that may have been tampered with still leads to the root."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    candidate = digest_of([tampered if c == "text" else F.col(c) for c in FIELDS])
    rows = verified(manifest(read_table(spark, sf_dir, "documents"), carried={"candidate": candidate}), "candidate")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_of(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {"op12_manifest": op12_manifest}


def _sql(levels: int = 8) -> str:
    """DuckDB SQL of the query, for up to 8 ** levels rows in a group and as many groups."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(text if c == "text" else field(c) for c in FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        "bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8)",
        "tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)",
        "marked AS (SELECT *, xor(list_reduce(list_transform(range(0, strlen(doc_id::VARCHAR)), lambda k: ord(substr(doc_id::VARCHAR, k + 1, 1))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 3 = 0 AS tampered FROM documents, tab)",
        f"""leaves AS (SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, {leaf(field('text'))} AS node, {leaf(f"CASE WHEN tampered THEN {field(low)} ELSE {field('text')} END")} AS candidate FROM marked)""",
    ]

    def climb(name: str, source: str) -> None:
        """Levels of each group: nodes with what stands left and right of them, and the group's last node."""
        for k in range(levels):
            of = source if k == 0 else f"{name}{k}"
            run = "OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
            out.append(f"{name}s{k} AS (SELECT g, pos, node, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY g) AS n FROM {of})")
            out.append(f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}s{k} WHERE n > 1 GROUP BY g, pos // 8)")
        out.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT g, node AS top FROM {name}s{k} WHERE n = 1" for k in range(levels)) + ")")

    climb("a", "leaves")
    out.append("roots AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, top AS node, g AS of FROM atop)")
    climb("b", "roots")
    joins = " ".join(f"LEFT JOIN as{k} ON as{k}.g IS NOT DISTINCT FROM leaves.g AND as{k}.pos = leaves.pos // {8**k} AND as{k}.n > 1" for k in range(levels))
    joins += " JOIN roots ON roots.of IS NOT DISTINCT FROM leaves.g " + " ".join(f"LEFT JOIN bs{k} ON bs{k}.pos = roots.pos // {8**k} AND bs{k}.n > 1" for k in range(levels))
    steps = [f"as{k}" for k in range(levels)] + [f"bs{k}" for k in range(levels)]
    lists = ", ".join(f"CASE WHEN {s}.n > 1 THEN {{'l': {s}.l, 'r': {s}.r}} END" for s in steps)
    out.append(f"proofs AS (SELECT doc_id, leaves.node AS leaf, candidate, roots.node AS subroot, (SELECT top FROM btop) AS root, list_filter([{lists}], lambda s: s IS NOT NULL) AS siblings FROM leaves {joins})")
    # a fold over structs: the first one holds the leaf
    fold = "list_reduce(list_transform(siblings, lambda s: {'l': s.l, 'r': s.r}), lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}, {'l': candidate, 'r': ''}).l"
    out.append(f"folds AS (SELECT *, {fold} AS folded_root FROM proofs)")
    return "WITH RECURSIVE " + ",\n".join(out) + "\nSELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(siblings, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds"


ORACLES: dict[str, str] = {"op12_manifest": _sql()}
