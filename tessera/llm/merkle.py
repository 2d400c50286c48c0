"""A Merkle manifest of a dataset (operator 11), with DataFrame functions only.

Every row is a leaf: the digest of its fields.  Leaves are numbered inside their group, and level by
level every ``fan`` consecutive nodes become a parent, the digest of their digests, until one node is
left: the group's subroot.  Each level is a written table that holds its children's digests beside its
own.  The subroots are the leaves of one more tree, whose last node is the root.

Proofs are pushed the other way, from the root down: a child takes over its parent's proof and puts its
own siblings before it.  So a proof lists siblings from the leaf upwards, and ``shape`` says how many of
each level's stand left and right of the path (left * fan + right).  Whoever has a row, its proof and
the root can check the row without any other.

Upwards each level has a ``fan``-th of the rows below; downwards a proof of level k has the siblings of
the levels above it only.  All joins are on group and number, which no group's size can crowd.

Edge cases: a null field is ``-`` and differs from an empty one; null groups are a group of their own,
before all others; rows without an order key come first in their group; rows that tie in the order are
put in the order of their digests, and equal rows have equal leaves, each with its own proof; a group of
one row has its leaf as subroot, and a single group's subroot is the root; an empty table has no root and
gives an empty result.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, salted_join
from .ordered import numbered

WIDTH = 32
#: A level whose proofs are written before the next, so that a lost executor doesn't cost the whole way.
WRITE_EVERY = 4
#: Groups up to which their roots are broadcast.
BROADCAST_GROUPS = 10_000


def field(c: Column) -> Column:
    """A value with its length in bytes before it, so that neighbours can't run together."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    """SHA-256 as bytes."""
    return F.unhex(F.sha2(text, 256))


def shown(b: Column) -> Column:
    return F.lower(F.hex(b))


def leaf(*fields: Column) -> Column:
    return digest(F.concat(*[field(c) for c in fields]))


def group_key(c: Column) -> Column:
    """A key that is never null; sorts like the column, nulls first, by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


@dataclass
class Tree:
    """``leaves`` and each of ``levels`` have g, idx, n (nodes of the group's level) and digest; levels also kids."""

    leaves: DataFrame
    levels: list[DataFrame]
    #: How many levels stand above the leaves of some group.
    heights: set[int]
    fan: int

    def nodes(self, k: int) -> DataFrame:
        return self.levels[k - 1] if k else self.leaves

    def roots(self) -> DataFrame:
        """``g, digest``: the last node of each group."""
        out = None
        for k in sorted(self.heights):
            top = self.nodes(k).where("n = 1").select("g", "digest")
            out = top if out is None else out.unionByName(top)
        return self.leaves.select("g", "digest") if out is None else out


def build(leaves: DataFrame, order: list[str], fan: int, name: str) -> Tree:
    """The tree of ``leaves`` (g, digest and further columns) by ``order`` inside each g."""
    placed, sizes = numbered(leaves, "g", order, name)
    placed = cut(placed, f"{name}-0", "zstd")
    most = sizes.agg(F.max("n")).head()[0] or 0
    steps, reach = [], 1
    while reach < most:
        steps.append((F.col("n") > reach).cast("int"))
        reach *= fan
    height = sum(steps[1:], steps[0]) if steps else F.lit(0)
    heights = {r[0] for r in sizes.select(height.alias("h")).distinct().collect()}  # 64 at most
    levels: list[DataFrame] = []
    below = placed
    for k in range(1, len(steps) + 1):
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: shown(x["digest"])), "")
        up = below.where("n > 1").groupBy("g", F.floor(F.col("idx") / fan).alias("up")).agg(F.unhex(kids).alias("kids"), F.first("n").alias("n"))
        up = up.select("g", F.col("up").alias("idx"), F.ceil(F.col("n") / fan).cast("long").alias("n"), "kids", digest(shown(F.col("kids"))).alias("digest"))
        below = cut(up, f"{name}-{k}", "zstd")
        levels.append(below)
    return Tree(placed, levels, heights, fan)


def push(tree: Tree, top: DataFrame, name: str) -> DataFrame:
    """The leaves with ``proof`` and ``shape``; ``top`` (g, proof, shape) has what stands above each group."""
    fan, down = tree.fan, None
    for k in range(len(tree.levels), -1, -1):
        nodes = tree.nodes(k).drop("digest") if k else tree.leaves
        parts = []
        if k in tree.heights:
            parts.append(nodes.where("n = 1").join(top, "g"))
        if down is not None:
            above = down.select("g", F.col("idx").alias("up"), F.col("kids").alias("run"), "proof", "shape")
            child = nodes.where("n > 1").withColumn("up", F.floor(F.col("idx") / fan)).join(above, ["g", "up"])
            at, size = F.pmod("idx", F.lit(fan)).cast("int"), F.expr(f"cast(octet_length(run) / {WIDTH} as int)")
            left, right = F.substring("run", F.lit(1), at * WIDTH), F.substring("run", (at + 1) * WIDTH + 1, F.octet_length("run"))
            sides = (at * fan + size - 1 - at).cast("int")
            parts.append(child.withColumns({"proof": F.concat(left, right, "proof"), "shape": F.concat(F.array(sides), "shape")}).drop("up", "run"))
        down = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else nodes.where("false").crossJoin(top.where("false").drop("g"))
        if k and k % WRITE_EVERY == 0:
            down = cut(down, f"{name}-proofs-{k}", "zstd")
    return down


def fold(leaf: Column, proof: Column, shape: Column, fan: int) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(s: Column, x: Column) -> Column:
        left, right = F.floor(x / fan).cast("int"), F.pmod(x, F.lit(fan)).cast("int")
        here, there = F.substring(proof, s["at"] + 1, left * WIDTH), F.substring(proof, s["at"] + left * WIDTH + 1, right * WIDTH)
        return F.struct(digest(F.concat(shown(here), shown(s["d"]), shown(there))).alias("d"), (s["at"] + (left + right) * WIDTH).alias("at"))

    return F.aggregate(shape, F.struct(leaf.alias("d"), F.lit(0).alias("at")), step, lambda s: s["d"])


def manifest(leaves: DataFrame, order: list[str], fan: int = 2, name: str = "merkle") -> DataFrame:
    """``leaves`` (g, digest and further columns) with ``subroot``, ``root``, ``proof`` and ``shape``."""
    tree = build(leaves, [*order, "digest"], fan, name)
    subroots = cut(tree.roots(), f"{name}-subroots")
    crown = build(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), ["group"], fan, f"{name}-crown")
    none = subroots.sparkSession.range(1).select(F.lit("").alias("g"), F.lit(b"").alias("proof"), F.array().cast("array<int>").alias("shape"))
    root = crown.roots().select(F.col("digest").alias("root"))
    named = push(crown, none, f"{name}-crown").select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "proof", "shape")
    named = cut(named.crossJoin(F.broadcast(root)), f"{name}-named")  # the root is one row, or none
    out = push(tree, named.select("g", "proof", "shape"), name)
    names = named.select("g", "subroot", "root")
    if named.count() <= BROADCAST_GROUPS:
        return out.join(F.broadcast(names), "g")
    return salted_join(out, names, ["g"], ["idx"])


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    fan = 2
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in docs.columns]
    changed = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 0
    tampered = F.when(changed & F.col("n_chars").isNotNull(), leaf(*[c + 1 if n == "n_chars" else c for n, c in zip(docs.columns, fields, strict=True)]))
    leaves = docs.select(group_key(F.col("lang")).alias("g"), "doc_id", leaf(*fields).alias("digest"), tampered.alias("tampered"))
    out = manifest(cut(leaves, "merkle-leaves", "zstd"), ["doc_id"], fan)
    folded = fold(F.coalesce("tampered", "digest"), F.col("proof"), F.col("shape"), fan)
    out = out.withColumn("folded", folded)
    return out.select(
        "doc_id", shown(F.col("digest")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"),
        F.sha2(shown(F.col("proof")), 256).alias("proof_sha256"), shown(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: CRC-32 by half bytes: the remainders of 0 to 15.
CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"

OP11_SQL = f"""
WITH RECURSIVE crcs AS (
    SELECT doc_id, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda c, b: xor(
            xor(xor(c, b) >> 4, {CRC}[(xor(c, b) & 15) + 1]) >> 4,
            {CRC}[(xor(xor(c, b) >> 4, {CRC}[(xor(c, b) & 15) + 1]) & 15) + 1])) AS c
    FROM (SELECT DISTINCT doc_id FROM documents)
), fields AS (
    SELECT d.doc_id, d.lang, xor(c, 4294967295) % 7 = 0 AS changed,
        coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(d.lang) || ':' || d.lang, '-') AS before,
        n_chars, coalesce(strlen(text) || ':' || text, '-') AS behind
    FROM documents d JOIN crcs ON d.doc_id = crcs.doc_id
), leaves AS (
    SELECT doc_id, lang, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || behind) AS leaf,
        CASE WHEN changed THEN sha256(before || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || behind) END AS tampered
    FROM fields
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), up AS (
    SELECT lang, 0 AS lev, idx, n, leaf AS h FROM placed
    UNION ALL
    SELECT lang, lev + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lang, lev, idx // 2
), subroots AS (
    SELECT lang, lev AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), crown AS (
    SELECT 0 AS lev, idx, n, subroot AS h FROM subroots
    UNION ALL
    SELECT lev + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY lev, idx // 2
), root AS (SELECT h AS root FROM crown WHERE n = 1),
low AS (
    SELECT p.lang, p.idx AS leaf_idx, s.lev, CASE WHEN s.idx IS NULL THEN '-' WHEN s.idx % 2 = 0 THEN 'l' ELSE 'r' END AS side, o.h
    FROM placed p JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.idx = p.idx >> s.lev AND s.n > 1
    LEFT JOIN up o ON o.lang IS NOT DISTINCT FROM p.lang AND o.lev = s.lev AND o.idx = xor(s.idx, 1)
), lows AS (
    SELECT lang, leaf_idx, list(side || coalesce(h, '') ORDER BY lev) AS steps FROM low GROUP BY ALL
), high AS (
    SELECT s.lang, c.lev, CASE WHEN c.idx % 2 = 0 THEN 'l' ELSE 'r' END AS side, o.h
    FROM subroots s JOIN crown c ON c.idx = s.idx >> c.lev AND c.n > 1
    LEFT JOIN crown o ON o.lev = c.lev AND o.idx = xor(c.idx, 1)
), highs AS (
    SELECT lang, list(side || coalesce(h, '') ORDER BY lev) AS steps FROM high GROUP BY lang
), proofs AS (
    SELECT p.*, s.subroot, list_concat(coalesce(l.steps, []), coalesce(h.steps, [])) AS steps
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN lows l ON l.lang IS NOT DISTINCT FROM p.lang AND l.leaf_idx = p.idx
    LEFT JOIN highs h ON h.lang IS NOT DISTINCT FROM p.lang
), folded AS (
    SELECT *, list_reduce(list_prepend(coalesce(tampered, leaf), steps),
        lambda a, s: sha256(CASE WHEN s[1] = 'r' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
    FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified
FROM folded, root
"""
