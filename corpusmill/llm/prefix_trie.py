"""A prefix trie of conversations, merged family by family.

A family is the conversations c with the same base c - c % 100; each is rebuilt from the first h turns of the base conversation
(h = crc32 of c's decimal digits, mod 6) and its own turns after its first h. Families are co-grouped with their base's
turns by one shuffle and a sort; a task streams through them, rebuilds each conversation and builds the family's small trie.
A node's key is a 128-bit hash of its path. Only combined nodes of families are shuffled for the global merge: smallest
member, members, depth, parent.

Sums over subtrees need no rounds by depth, deep chains included. Each conversation shares its first nodes with some smaller
one and owns the rest (it is the smallest member there). So the tokens saved below a node are, over its members, the code points
shared beyond the node's parent, and leaves are conversations that own a childless end. Both are added up inside
each family in a second streaming pass, deepest nodes first, from the owners that the merge has found, and merged by key again.

A family of more than FAMILY rows is split into its conversations, which keep their base's first turns; the merge puts them
together. A conversation of its own needs no memory, however long. The ids of conversations that end at one node are
hashed as a stream in their order, as SHA-256 asks for; families, whose ids are ranges, come as one string each.

Defined cases: null turns come first, and rows of equal turn are ordered by role and text; a null role or text is empty; repeated rows
are turns each; rows with a null conv_id belong to no conversation and are left out; a base that is absent adds no turns; very long
texts are hashed by one task each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import in_small_batches, small_side, written

SPAN, HEADS = 100, 6
#: Rows of a family whose trie a task builds in memory; rows of a batch that leaves a task.
FAMILY, ROWS_OUT = 20_000, 4_096
ROOT = bytes(16)
NODE_SCHEMA = "base long, part long, key binary, parent binary, depth long, chars long, conv_id long, n long, ends string, n_ends long"
NAMES = [field.split()[0] for field in NODE_SCHEMA.split(", ")]
KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
TYPES = [KINDS[field.split()[1]] for field in NODE_SCHEMA.split(", ")]


def child_key(parent: bytes, role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(parent + len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest()


def n_heads(conv_id: int) -> int:
    """How many of the base's first turns replace a conversation's own."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _out(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _chunks(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield _out(held, names, types)
            held = []
    if held:
        yield _out(held, names, types)


def family_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY) -> DataFrame:
    """The co-group: base, part, single, own, conv_id, role, text, dealt by family (or by conversation of a large one), the base's first turns first."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.where("conv_id IS NOT NULL").withColumn("base", F.col("conv_id") - F.col("conv_id") % SPAN)
    sizes = written(rows.groupBy("base").agg(F.count("*").alias("n")))
    large = small_side(sizes.where(F.col("n") > family).select("base", F.lit(True).alias("single")))
    own = rows.join(large, "base", "left").withColumn("single", F.coalesce("single", F.lit(False))).withColumn("part", F.when(F.col("single"), F.col("conv_id")).otherwise(F.col("base")))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    first = Window.partitionBy("conv_id").orderBy(*order)
    heads = rows.where("conv_id = base").withColumn("place", F.row_number().over(first)).where(F.col("place") < HEADS).drop("place")
    split = own.where("single").select("base", "part", "single").distinct()
    parts = sizes.where(F.col("n") <= family).select("base", F.col("base").alias("part"), F.lit(False).alias("single")).union(split)
    both = own.withColumn("own", F.lit(True)).unionByName(heads.join(parts, "base").withColumn("own", F.lit(False)))
    return both.repartition("base", "part").sortWithinPartitions("base", "part", "own", "conv_id", *order).select("base", "part", "single", "own", "conv_id", "role", "text")


def family_nodes(cogrouped: DataFrame) -> DataFrame:
    """The nodes of each family's trie, written: NODE_SCHEMA. conv_id and n: of the family's members; ends: its ids that end here, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        heads: list[tuple[str, str]] = []
        trie: dict[bytes, list] = {}  # of this family: parent, depth, chars, conv_id, n, ends
        group = conv = None
        key, depth, chars, h, seen = ROOT, 0, 0, 0, 0
        last: tuple | None = None  # of a conversation by itself: its node that may still be the end

        def visit(parent: bytes) -> Iterator[tuple]:
            nonlocal last
            if group[2]:
                if last:
                    yield last
                last = (*group[:2], key, parent, depth, chars, conv, 1, None, 0)
            elif (node := trie.get(key)) is not None:
                node[4] += 1
            else:
                trie[key] = [parent, depth, chars, conv, 1, []]

        def step(role: str, text: str) -> Iterator[tuple]:
            nonlocal key, depth, chars
            parent, key = key, child_key(key, role, text)
            depth, chars = depth + 1, chars + len(text)
            yield from visit(parent)

        def end() -> Iterator[tuple]:
            nonlocal last
            if conv is None:
                return
            if group[2]:
                yield (*last[:8], str(conv), 1)
                last = None
            else:
                trie[key][5].append(str(conv))

        def leave() -> Iterator[tuple]:
            nonlocal heads, trie
            for k, (parent, d, c, m, n, ends) in trie.items():
                yield (*group[:2], k, parent, d, c, m, n, ",".join(ends) if ends else None, len(ends))
            heads, trie = [], {}

        for base, part, single, own, c, role, text in read(batches):
            if group != (base, part, single):
                if group:
                    yield from end()
                    yield from leave()
                group, conv = (base, part, single), None
            if not own:
                heads.append((role, text))
                continue
            if c != conv:
                yield from end()
                conv, h, seen, key, depth, chars = c, n_heads(c), 0, ROOT, 0, 0
                yield from visit(None)
                for head in heads[:h]:
                    yield from step(*head)
            seen += 1
            if seen > h:
                yield from step(role, text)
        if group:
            yield from end()
            yield from leave()

    return written(in_small_batches(cogrouped).mapInArrow(lambda batches: _chunks(nodes(batches), NAMES, TYPES), NODE_SCHEMA))


def ends_digest(family: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes at which conversations end: a stream through each node's ids in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            key, digest = None, None
            for b in batches:
                for k, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if k != key:
                        if digest:
                            yield key, digest.hexdigest()
                        key, digest = k, hashlib.sha256(ends.encode())
                    else:
                        digest.update(b"," + ends.encode())
            if digest:
                yield key, digest.hexdigest()

        yield from _chunks(digests(), ["key", "ends_sha256"], [pa.binary(), pa.string()])

    # the ids of a family, or of a part of one, are a range of numbers that no other has ids in; a node's ends start with the least
    rows = family.where("n_ends > 0").select("key", "ends", F.split("ends", ",", 2)[0].cast("long").alias("least"))
    return rows.repartition("key").sortWithinPartitions("key", "least").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def subtree_sums(family: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, leaves, shared, many: sums over the node's subtree, combined in each family, then by key.

    Where a conversation leaves a smaller one (or ends without owning a node), the code points up to there are what it shares;
    `shared` sums those of the subtree's conversations that leave at the node or below, `many` counts them.
    """
    schema = "key binary, leaves long, shared long, many long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[tuple]:
            group, waiting = None, {}  # by node: what its children have brought; not more nodes than conversations
            for b in batches:
                for base, part, key, parent, chars, conv, ends, n_ends, owner, up_owner, up_chars, childless in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if group != (base, part):
                        group, waiting = (base, part), {}
                    leaves, shared, many = waiting.pop(key, (0, 0, 0))
                    # the owner, if of this family, is the family's smallest member; ids stand in order
                    owner_ends = bool(n_ends) and owner == conv and int(ends.split(",", 1)[0]) == owner
                    shared, many = shared + (n_ends - owner_ends) * chars, many + n_ends - owner_ends
                    leaves += owner_ends and childless
                    yield key, leaves, shared, many
                    if parent is not None:
                        if owner == conv and owner != up_owner:
                            shared, many = shared + up_chars, many + 1
                        a, b_, c_ = waiting.get(parent, (0, 0, 0))
                        waiting[parent] = (a + leaves, b_ + shared, c_ + many)

        yield from _chunks(sums(), ["key", "leaves", "shared", "many"], [pa.binary(), *[pa.int64()] * 3])

    known = nodes.select("key", F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("up_owner"), "up_chars", (F.col("n_children") == 0).alias("childless"))
    both = family.join(small_side(known), "key").repartition("base", "part").sortWithinPartitions("base", "part", F.desc("depth"))
    each = both.select("base", "part", "key", "parent", "chars", "conv_id", "ends", "n_ends", "owner", "up_owner", "up_chars", "childless").mapInArrow(run, schema)
    return each.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("leaves", "shared", "many")])


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY) -> DataFrame:
    """One row per node: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = family_nodes(family_turns(turns, conv_col, turn_col, role_col, text_col, family))
    merged = written(own.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars"), F.min("parent").alias("parent")))
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("chars").alias("up_chars"))
    nodes = merged.join(above, "parent", "left").join(children, "key", "left")
    nodes = written(nodes.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("up_chars", F.lit(0)).alias("up_chars")))
    found = nodes.join(subtree_sums(own, nodes), "key").join(ends_digest(own), "key", "left")
    return found.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                        (F.col("shared") - F.col("many") * F.col("up_chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: The same nodes by whole paths, for DuckDB. CRC-32 is computed bit by bit; ancestors are met along the smallest member's path.
TRIE_SQL = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM turns),
crcs AS (SELECT conv_id, base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM ids),
heads AS (SELECT conv_id, base, crc % 6 AS h FROM crcs),
rebuilt AS (SELECT heads.conv_id, place, role, text, 0 AS own FROM heads JOIN turns ON turns.conv_id = heads.base AND place <= h
            UNION ALL SELECT conv_id, place, role, text, 1 FROM heads JOIN turns USING (conv_id) WHERE place > h),
placed AS (SELECT conv_id, text, row_number() OVER w AS depth, md5(length(role) || ':' || role || text) AS turn FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
paths AS (SELECT conv_id, depth, length(text) AS len, md5(string_agg(turn, '') OVER w) AS key, coalesce(md5(string_agg(turn, '') OVER before), 'root') AS parent FROM placed
          WINDOW w AS (PARTITION BY conv_id ORDER BY depth), before AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM ids),
nodes AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, min(len) AS len FROM paths GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT p.key, CAST(sum((n.n_convs - 1) * n.len) AS BIGINT) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
          FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.key = n.key GROUP BY p.key),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM
         (SELECT conv_id, key FROM paths QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY key)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children, below.leaves AS n_leaves, below.saved AS saved_tokens,
       coalesce(ends.digest, sha256('')) AS ends_sha256
FROM nodes LEFT JOIN nodes up ON up.key = nodes.parent LEFT JOIN children ON children.key = nodes.key JOIN below ON below.key = nodes.key LEFT JOIN ends ON ends.key = nodes.key
"""
