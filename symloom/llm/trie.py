"""The prefix trie of conversations and sums over its subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. Turns become narrow rows first: three hashes of place,
role and text, whose running sums name every prefix of a conversation, so no conversation is
gathered anywhere. Each node's child with the most members is its heavy child; heavy edges form
paths, and as another child has at most half of the members, a walk to the root changes paths only
as often as the logarithm of the conversations. Nodes find the top of their path by doubling steps.
Then light paths are attached: paths below which none is open hand their sums to the node above
their top, round after round, and a suffix sum along each path gives every node its subtree's sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import materialize, n_words
from symloom.prefix import running_sums

#: Turns that a conversation takes from the first one of its block of ids at most, plus one, and
#: the ids of a block.
SHARED_TURNS, IDS = 4, 20
#: Bits of each of a turn's hashes: sums over eight million turns stay within a long.
HASH_BITS = 40
_KEY = ["depth", "p0", "p1", "p2"]
#: Characters of a piece of a list of ids.
PIECE = 1 << 20


def taken_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its block of ids."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED_TURNS).cast("long")


def block_of(conv_id: Column) -> Column:
    return conv_id - conv_id % IDS


def numbered_turns(conversations: DataFrame, name: str = "trie") -> DataFrame:
    """``conv_id, place, a, b, words`` of every turn: its place from 0, two hashes of (role, text),
    words of the text.

    Turns stand in order of ``turn``, null first; ties in an order of their hashes. A null role or
    text is the empty string. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().cast("int").alias("some"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), n_words(text).alias("words"), F.lit(1).cast("long").alias("one"))
    placed = running_sums(rows, ["conv_id"], ["some", "turn", "a", "b"], ["one"], name)
    return materialize(placed.select("conv_id", F.col("before_one").alias("place"), "a", "b", "words"), name)


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """The turns of the rebuilt conversations: the first ``taken_turns`` of the block's first
    conversation (all if it has fewer, none if it is not there), then a conversation's own turns
    after as many of its first ones."""
    h = taken_turns(F.col("conv_id"))
    first = turns.where((F.col("conv_id") % IDS == 0) & (F.col("place") < SHARED_TURNS - 1))
    first = first.select(F.col("conv_id").alias("block"), "place", "a", "b", "words")
    there = turns.select("conv_id").distinct().select("conv_id", block_of(F.col("conv_id")).alias("block"), h.alias("h"))
    taken = there.join(first, "block").where("place < h").select("conv_id", "place", "a", "b", "words")
    own = turns.where(F.col("place") >= h).select("conv_id", "place", "a", "b", "words", h.alias("h"), block_of(F.col("conv_id")).alias("block"))
    # where the block's first conversation has fewer turns, own ones move up
    length = first.groupBy(F.col("block").alias("_block")).agg(F.count("*").alias("_n"))
    moved = own.where("block <> conv_id").join(length, F.col("block") == F.col("_block"), "left")
    moved = moved.select("conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("_n", F.lit(0)))).alias("place"), "a", "b", "words")
    return taken.unionByName(own.where("block = conv_id").select("conv_id", "place", "a", "b", "words")).unionByName(moved)


def prefix_rows(rebuilt: DataFrame, name: str = "trie") -> DataFrame:
    """A row for each turn: ``conv_id, words``, the prefix that ends with it (``depth, p0, p1, p2``)
    and the one before it (``q0, q1, q2``)."""
    mask = F.lit((1 << HASH_BITS) - 1)
    rows = rebuilt.select("conv_id", "place", "words", *[F.xxhash64(F.lit(10 + k), "place", "a", "b").bitwiseAND(mask).alias(f"v{k}") for k in range(3)])
    rows = running_sums(rows, ["conv_id"], ["place"], ["v0", "v1", "v2"], name)
    return materialize(rows.select("conv_id", (F.col("place") + 1).alias("depth"), "words", *[(F.col(f"before_v{k}") + F.col(f"v{k}")).alias(f"p{k}") for k in range(3)], *[F.col(f"before_v{k}").alias(f"q{k}") for k in range(3)]), name)


def ends_digests(ends: DataFrame, name: str = "trie") -> DataFrame:
    """``depth, p0, p1, p2, ends_sha256`` of ``(conv_id, depth, p0, p1, p2)``: the digest of each
    node's conv_ids, ascending, comma-joined.

    A digest is a sequence by nature. So ranges of (node, conv_id) first join their ids to pieces,
    and what meets in one task is a node's pieces in order, which are hashed as they pass.
    """
    dealt = materialize(ends, name).repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").select(*_KEY, "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (own != key or size >= PIECE):
                    out.append((*key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = own, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*_KEY, "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, first, ",".join(ids))], names=[*_KEY, "first", "ids"])

    pieces = materialize(dealt.mapInArrow(join, "depth long, p0 long, p1 long, p2 long, first long, ids string"), name)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*_KEY, "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=[*_KEY, "ends_sha256"])

    dealt = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return dealt.mapInArrow(digest, "depth long, p0 long, p1 long, p2 long, ends_sha256 string")


def trie_nodes(conversations: DataFrame, name: str = "trie") -> DataFrame:
    """The nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, words, heavy,
    ends_sha256``; ``heavy`` says whether a node is the heavy child of its parent.

    ``(conv_id, depth)`` names a node, as its smallest member and its depth give the prefix. The
    heavy child has the most members, of several the one with the smallest conv_id.
    """
    turns = numbered_turns(conversations, name)
    rows = prefix_rows(rebuilt_turns(turns), name)
    convs = materialize(turns.select("conv_id").distinct(), name)
    below = rows.groupBy(*_KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *[F.min(f"q{k}").alias(f"q{k}") for k in range(3)])
    nowhere = [F.lit(0).cast("long").alias(f"p{k}") for k in range(3)]
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *nowhere, "n_convs", "conv_id", F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(f"q{k}") for k in range(3)])
    nodes = materialize(below.unionByName(root), name)
    # where conversations end: at their last prefix, or at the root
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "p0", "p1", "p2"), "depth").alias("e")).select("conv_id", "e.*")
    silent = convs.join(rows.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), *nowhere)
    ends = ends_digests(last.unionByName(silent), name)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"q{k}").alias(f"p{k}") for k in range(3)])
    kids = materialize(kids.agg(F.count("*").alias("n_children"), F.min(F.struct(-F.col("n_convs"), "conv_id"))["conv_id"].alias("heavy_conv")), name)
    whole = nodes.join(kids.drop("heavy_conv"), _KEY, "left").join(ends, _KEY, "left")
    whole = materialize(whole.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), name)
    # a parent may have many children: its row is small where it is sent to them, and else Spark
    # splits the children of one parent among tasks
    parents = whole.select((F.col("depth") + 1).alias("depth"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(3)], F.col("conv_id").alias("parent_conv_id")).where("n_children > 0")
    found = whole.join(parents, ["depth", "q0", "q1", "q2"], "left")
    heavy = kids.select((F.col("depth") + 1).alias("depth"), F.col("heavy_conv").alias("conv_id"), F.lit(True).alias("heavy"))
    found = found.join(heavy, ["conv_id", "depth"], "left")
    return materialize(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "words", F.coalesce("heavy", F.lit(False)).alias("heavy"), "ends_sha256"), name)


def heavy_paths(nodes: DataFrame, name: str = "trie") -> DataFrame:
    """``conv_id, depth, top_conv, top_depth``: the node at the top of each node's heavy path.

    Steps double: a node that knows its k-th ancestor on its path asks it for its own. Nodes that
    have arrived only answer; no two ask for one node, as a path has one node at each depth.
    """
    own = nodes.select("conv_id", "depth", F.when(F.col("heavy"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("top_conv"), F.when(F.col("heavy"), F.col("depth") - 1).otherwise(F.col("depth")).alias("top_depth"), (~F.col("heavy")).alias("done"))
    way = materialize(own, name)
    arrived = [way.where("done")]
    way = way.where("not done")
    asked = own
    while not way.isEmpty():
        above = asked.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), F.col("top_conv").alias("_top_conv"), F.col("top_depth").alias("_top_depth"), F.col("done").alias("_done"))
        further = way.join(above, (F.col("top_conv") == F.col("_conv")) & (F.col("top_depth") == F.col("_depth")))
        further = materialize(further.select("conv_id", "depth", F.col("_top_conv").alias("top_conv"), F.col("_top_depth").alias("top_depth"), F.col("_done").alias("done")), name)
        arrived.append(further.where("done"))
        way = further.where("not done")
        asked = arrived[0]
        for more in arrived[1:]:
            asked = asked.unionByName(more)
        asked = asked.unionByName(way)
    whole = arrived[0]
    for more in arrived[1:]:
        whole = whole.unionByName(more)
    return whole.select("conv_id", "depth", "top_conv", "top_depth")


def subtree_sums(nodes: DataFrame, values: dict[str, Column], name: str = "trie") -> DataFrame:
    """``conv_id, depth, top_conv, top_depth`` and, for each of ``values`` (longs), its sum over the
    node's subtree, under the value's name."""
    names = list(values)
    paths = heavy_paths(nodes, name)
    own = nodes.select("conv_id", "depth", "parent_conv_id", "heavy", F.greatest(F.col("n_children") - 1, F.lit(0)).alias("light"), *[v.cast("long").alias(n) for n, v in values.items()])
    own = materialize(own.join(paths, ["conv_id", "depth"]), name)
    top = (F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth"))
    totals = own.groupBy("top_conv", "top_depth").agg(F.max(F.when(top, F.col("parent_conv_id"))).alias("above_conv"), F.sum("light").alias("open"), *[F.sum(n).alias(n) for n in names])
    totals = materialize(totals, name)
    attached: list[DataFrame] = []
    while True:
        # paths below which none is open, summed by the node that their tops hang from
        ready = totals.where("open = 0 and above_conv is not null")
        hung = ready.groupBy(F.col("above_conv").alias("conv_id"), (F.col("top_depth") - 1).alias("depth")).agg(F.count("*").alias("n"), *[F.sum(n).alias(f"_{n}") for n in names])
        hung = materialize(hung, name)
        if hung.isEmpty():
            break
        attached.append(hung)
        by_path = hung.join(own.select("conv_id", "depth", "top_conv", "top_depth"), ["conv_id", "depth"]).groupBy("top_conv", "top_depth").agg(F.sum("n").alias("_n"), *[F.sum(f"_{n}").alias(f"_{n}") for n in names])
        rest = totals.where("open > 0").join(by_path, ["top_conv", "top_depth"], "left")
        totals = materialize(rest.select("top_conv", "top_depth", "above_conv", (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open"), *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names]), name)
    rows = own
    if attached:
        whole = attached[0]
        for more in attached[1:]:
            whole = whole.unionByName(more)
        # a node's light children may be ready in different rounds
        whole = whole.groupBy("conv_id", "depth").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
        rows = own.join(whole, ["conv_id", "depth"], "left").select("conv_id", "depth", "top_conv", "top_depth", *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names])
    rows = rows.select("conv_id", "depth", "top_conv", "top_depth", *names, (-F.col("depth")).alias("up"))
    summed = running_sums(rows, ["top_conv", "top_depth"], ["up"], names, name)
    return summed.select("conv_id", "depth", "top_conv", "top_depth", *[(F.col(n) + F.col(f"before_{n}")).alias(n) for n in names])


def conversation_trie(conversations: DataFrame, name: str = "trie") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    ``conv_id`` is the smallest member, ``depth`` the turns of the prefix, ``parent_conv_id`` the
    parent's conv_id (the root's is null), ``n_convs`` the members, ``n_children`` the children,
    ``n_leaves`` the childless nodes of the subtree, ``saved_tokens`` what sharing saves: the sum
    over the subtree of (n_convs - 1) times the words of the node's last text; ``ends_sha256`` is
    the digest of the conversations that end here; ``top_conv, top_depth`` name the node's heavy
    path by its top.

    Null roles and texts are empty; turns with a null number come first; repeated rows are turns of
    their own; rows without conv_id are left out; a conversation may end up without any turn and
    then ends at the root. An empty table gives an empty result; further columns are left out.
    """
    nodes = trie_nodes(conversations, name)
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = subtree_sums(nodes, {"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}, name)
    out = nodes.join(sums, ["conv_id", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top_conv", "top_depth")


def oracle_sql() -> str:
    """The same rows as DuckDB SQL: prefixes as lists, subtrees by the rows of each smallest member.

    The heavy paths come from a walk down from the root.
    """
    words = r"[^\x20\x09-\x0D]+"
    return f"""
WITH RECURSIVE t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
        md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS h, len(regexp_extract_all(coalesce(text, ''), '{words}')) AS words
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % {IDS} AS block FROM t GROUP BY 1
), k AS (
    SELECT conv_id, block, crc FROM c JOIN (SELECT conv_id AS i, crc FROM ({_CRC_SQL})) ON i = conv_id
), r AS (
    SELECT k.conv_id, t.place, t.h, t.words FROM k JOIN t ON t.conv_id = k.block AND t.place < crc % {SHARED_TURNS}
    UNION ALL
    SELECT k.conv_id, t.place - crc % {SHARED_TURNS} + least(crc % {SHARED_TURNS}, (SELECT count(*) FROM t AS b WHERE b.conv_id = k.block)), t.h, t.words
    FROM k JOIN t ON t.conv_id = k.conv_id AND t.place >= crc % {SHARED_TURNS}
), p AS (
    SELECT conv_id, place + 1 AS depth, words, md5(string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY place)) AS pre FROM r
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM c
), n AS (
    SELECT pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY 1, 2
), u AS (
    SELECT n.conv_id, n.depth, n.n_convs, n.words, m.conv_id AS parent_conv_id
    FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n AS m ON m.pre = p.pre AND m.depth = p.depth
), f AS (
    SELECT u.*, count(v.conv_id) AS n_children FROM u LEFT JOIN u AS v ON v.parent_conv_id = u.conv_id AND v.depth = u.depth + 1 GROUP BY ALL
), s AS (
    SELECT n.conv_id, n.depth, CAST(sum((f.n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum((f.n_convs - 1) * f.words) AS BIGINT) AS saved_tokens
    FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth JOIN n ON n.pre = p.pre AND n.depth = p.depth GROUP BY 1, 2
), e AS (
    SELECT n.conv_id, n.depth, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends
    FROM (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1) AS l JOIN p USING (conv_id, depth) JOIN n USING (pre, depth) GROUP BY 1, 2
), g AS (
    SELECT *, row_number() OVER (PARTITION BY parent_conv_id, depth ORDER BY n_convs DESC, conv_id) = 1 AND depth > 0 AS heavy FROM f
), w AS (
    SELECT conv_id, depth, conv_id AS top_conv, depth AS top_depth FROM g WHERE NOT heavy
    UNION ALL
    SELECT g.conv_id, g.depth, w.top_conv, w.top_depth FROM w JOIN g ON g.parent_conv_id = w.conv_id AND g.depth = w.depth + 1 AND g.heavy
)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256, w.top_conv, w.top_depth
FROM f JOIN s ON s.conv_id = f.conv_id AND s.depth = f.depth LEFT JOIN e ON e.conv_id = f.conv_id AND e.depth = f.depth JOIN w ON w.conv_id = f.conv_id AND w.depth = f.depth
"""


#: CRC-32 of each conv_id's decimal digits: eight steps of the polynomial for each bit of a digit.
_CRC_SQL = """
SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT + 4294967296, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b - 4294967296) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS crc
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
"""
