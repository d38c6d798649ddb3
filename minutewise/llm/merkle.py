"""Merkle manifest of a dataset: a hash tree per source, a tree over the sources' roots, and every row's proof.

Leaves are sorted and numbered by a range sort, so that one source may hold any share of the rows. Aligned runs of
fanout**height leaves form blocks, whose subtrees are built where the block lies. Above them no task ever holds a tree.
Blocks meet in a butterfly: in round r, the fanout blocks of an aligned group whose numbers differ in digit r alone swap the
roots that they know, and each hashes the parent for itself. So after as many rounds as the number of blocks has digits,
every block knows the root and all siblings on its way up, and nothing has to be passed down. Where the last group of a
round is ragged, its blocks stand in for the missing ones. A round shuffles a row per block of the trees that go on.

A proof is a list of (left, right): the siblings of a level as hex digests one after the other. Folding a leaf goes up
through it by H(left + node + right).

Edge cases: a null field is `-`. Rows without a source have a tree of their own, before the others; rows without a doc_id
come first in theirs. Rows that share a doc_id are ordered by their digest. A tree of one leaf is that leaf, and its proof
is empty. An empty table gives no rows. Other columns are not hashed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutewise.llm.common import CRC_SQL, crc32_sql, if_small, read, saved

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "struct<left: string, right: string>"


@dataclass(frozen=True)
class MerkleParams:
    """Children of a node, and levels of a block's own tree."""

    fanout: int = 3
    height: int = 6

    @property
    def block(self) -> int:
        return self.fanout**self.height


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its length in front."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof in a row."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf_hash: Column, proof: Column) -> Column:
    """The root that a leaf leads to by a proof."""
    return F.aggregate(proof, leaf_hash, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _levels(nodes: list[str], params: MerkleParams, whole: bool) -> list[list[str]]:
    """A block's nodes level by level, up to its root; a block that is its whole tree ends at the first lone node."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= params.height:
        below = out[-1]
        runs = ["".join(below[i : i + params.fanout]) for i in range(0, len(below), params.fanout)]
        out.append([hashlib.sha256(r.encode()).hexdigest() for r in runs])
    return out


def _block_roots(hashes: Column, whole: Column, params: MerkleParams) -> Column:
    @F.arrow_udf("string")
    def root(lists: pa.Array, flags: pa.Array) -> pa.Array:
        return pa.array([_levels(nodes, params, w)[-1][0] for nodes, w in zip(lists.to_pylist(), flags.to_pylist())], pa.string())

    return root(hashes, whole)


def _block_proofs(hashes: Column, whole: Column, params: MerkleParams) -> Column:
    """The proofs of a block's leaves within the block."""

    def steps(levels: list[list[str]], at: int) -> list[dict]:
        out = []
        for level in levels[:-1]:
            first = at - at % params.fanout
            out.append({"left": "".join(level[first:at]), "right": "".join(level[at + 1 : first + params.fanout])})
            at //= params.fanout
        return out

    @F.arrow_udf(f"array<array<{STEP}>>")
    def proofs(lists: pa.Array, flags: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        found = []
        for nodes, w in zip(lists.to_pylist(), flags.to_pylist()):
            levels = _levels(nodes, params, w)
            found.append([steps(levels, at) for at in range(len(nodes))])
        return pa.array(found, kind)

    return proofs(hashes, whole)


def _blocks(leaves: DataFrame, params: MerkleParams) -> DataFrame:
    """tree, block, blocks (their number in the tree) and leaves (array of place, hash, row) of leaves (tree, hash, row, then what they are ordered by); saved."""
    order = [F.col(c).asc_nulls_first() for c in leaves.columns if c not in ("hash", "row")]
    tied = saved(leaves.withColumn("tie", F.monotonically_increasing_id()))
    # Equal rows are told apart by `tie`, so that the sort can split them; which is first makes no difference.
    ordered = saved(tied.orderBy(*order, "hash", "tie").select("tree", "hash", "row", F.monotonically_increasing_id().alias("at")))
    # The number of a sorted row is that of its part, then its place there.
    part = F.shiftright("at", 33).alias("part")
    counted = ordered.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("n").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(by_tree).alias("n"))
    placed = ordered.withColumn("part", part).join(if_small(saved(starts)), ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift"))
    size = params.block
    return saved(
        placed.groupBy("tree", F.expr(f"place DIV {size}").alias("block"))
        .agg(F.first(F.expr(f"(n + {size - 1}) DIV {size}")).alias("blocks"), F.array_sort(F.collect_list(F.struct("place", "hash", "row"))).alias("leaves"))
    )


def _swapped(blocks: DataFrame, span: int, params: MerkleParams) -> DataFrame:
    """A round of the butterfly on blocks (tree, block, blocks, hash, proof), each of which knows the root of the span blocks around it."""
    k = params.fanout
    going = blocks.withColumns({"node": F.expr(f"block DIV {span}"), "offset": F.expr(f"block % {span}")})
    # A node at the ragged end has fewer blocks; each also answers for those it lacks.
    size = F.least(F.lit(span), F.col("blocks") - F.col("node") * span)
    asked = going.withColumn("place", F.explode(F.sequence(F.col("offset"), F.lit(span - 1).cast("long"), size)))
    own = F.col("place") == F.col("offset")
    member = F.struct(
        (F.col("node") % k).alias("digit"), "hash", F.when(own, F.col("block")).alias("block"), F.when(own, F.col("proof")).alias("proof")
    )
    met = asked.groupBy("tree", F.expr(f"node DIV {k}").alias("parent"), "place", "blocks").agg(F.array_sort(F.collect_list(member)).alias("group"))

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("group", keep), lambda m: m["hash"]), "")

    swapped = met.select("tree", "blocks", "group", F.sha2(joined(lambda m: F.lit(True)), 256).alias("hash"), F.explode(F.filter("group", lambda m: m["block"].isNotNull())).alias("me"))
    digit = F.col("me.digit")
    step = F.struct(joined(lambda m: m["digit"] < digit).alias("left"), joined(lambda m: m["digit"] > digit).alias("right"))
    return swapped.select("tree", F.col("me.block").alias("block"), "blocks", "hash", F.concat("me.proof", F.array(step)).alias("proof"))


def _climbed(blocks: DataFrame, params: MerkleParams) -> DataFrame:
    """tree, block, hash (the tree's root) and proof (from the block's root up) of every block."""
    hashes = F.transform("leaves", lambda x: x["hash"])
    none = F.array().cast(f"array<{STEP}>").alias("proof")
    known = blocks.select("tree", "block", "blocks", _block_roots(hashes, F.col("blocks") == 1, params).alias("hash"), none)
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    known, span = saved(known), 1
    ended = known.where(F.col("blocks") <= span)
    while span < most:
        known = saved(_swapped(known.where(F.col("blocks") > span), span, params))
        span *= params.fanout
        ended = ended.unionByName(known.where(F.col("blocks") <= span))
    return ended.drop("blocks")


def _proven(blocks: DataFrame, climbed: DataFrame, params: MerkleParams) -> DataFrame:
    """row, hash, proof, and the other columns of climbed, of every leaf."""
    rest = [c for c in climbed.columns if c not in ("tree", "block", "proof")]
    met = blocks.join(climbed, ["tree", "block"]).withColumn(
        "inner", _block_proofs(F.transform("leaves", lambda x: x["hash"]), F.col("blocks") == 1, params)
    )
    each = met.select(F.explode(F.arrays_zip("leaves", "inner")).alias("x"), "proof", *rest)
    return each.select("x.leaves.row", "x.leaves.hash", F.concat("x.inner", "proof").alias("proof"), *rest)


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None, params: MerkleParams = MerkleParams()) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof and the extra columns (expressions of docs) of every row of docs."""
    name = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    row = F.struct("doc_id", "source", *[c.alias(f"x_{k}") for k, c in (extra or {}).items()])
    leaves = docs.select(name.alias("tree"), "doc_id", leaf([F.col(c) for c in FIELDS]).alias("hash"), row.alias("row"))
    blocks = _blocks(leaves, params)
    climbed = _climbed(blocks, params)

    tops = climbed.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash", F.struct("tree").alias("row"))
    top_blocks = _blocks(tops, params)
    top = _proven(top_blocks, _climbed(top_blocks, params).withColumnRenamed("hash", "root"), params)
    top = saved(top.select("row.tree", "root", F.col("proof").alias("above")))
    # A source's blocks meet its proof here, without their leaves.
    whole = climbed.join(if_small(top), "tree").select("tree", "block", F.col("hash").alias("subroot"), "root", F.concat("proof", "above").alias("proof"))
    found = _proven(blocks, whole, params)
    return found.select("row.doc_id", "row.source", F.col("hash").alias("leaf"), "subroot", "root", "proof", *[F.col(f"row.x_{k}").alias(k) for k in (extra or {})])


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and where it leads after the line breaks of every other text were lost."""
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = leaf([text if c == "text" else F.col(c) for c in FIELDS])
    found = manifest(docs, {"changed": changed}).withColumn("folded_root", folded(F.col("changed"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# Levels enough for 3**13 documents a source, and sources.
def _sql(levels: int = 13) -> str:
    told = lambda text: " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*FIELDS[:-1], text)
    )
    octets = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    steps = [
        "WITH " + CRC_SQL,
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({told("text")}) AS h,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql(octets)} % 2 = 0 THEN sha256({told("replace(text, chr(10), '')")})
  ELSE sha256({told("text")}) END AS changed FROM documents, tab)""",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, changed AS f, '' AS proof FROM d)",
        "an0 AS MATERIALIZED (SELECT tree, pos, h FROM a0)",
    ]

    def climb(prefix: str, leaf_columns: str) -> None:
        for j in range(levels):
            siblings = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN {}), '')"
            steps.append(f"""{prefix}s{j} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n,
  {siblings.format("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS l, {siblings.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS r FROM {prefix}n{j})""")
            steps.append(f"""{prefix}n{j + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos,
  CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {prefix}s{j} GROUP BY ALL)""")
            steps.append(f"""{prefix}{j + 1} AS MATERIALIZED (SELECT {leaf_columns}, x.tree, x.pos // 3 AS pos,
  CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof
  FROM {prefix}{j} x JOIN {prefix}s{j} s ON x.tree = s.tree AND x.pos = s.pos)""")

    climb("a", "doc_id, x.h")
    steps += [
        f"subs AS MATERIALIZED (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM an{levels})",
        "bn0 AS MATERIALIZED (SELECT '' AS tree, pos, subroot AS h FROM subs)",
        f"b0 AS MATERIALIZED (SELECT doc_id, x.h, subroot, '' AS tree, s.pos, f, proof FROM a{levels} x JOIN subs s ON x.tree = s.name)",
    ]
    climb("b", "doc_id, x.h, subroot")
    return ",\n".join(steps) + f"""
SELECT x.doc_id, x.h AS leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = n.h AS verified
FROM b{levels} x, bn{levels} n"""


OP13_SQL = _sql()
