"""Prefix trie of conversations: a Cartesian tree over the LCP array of the sorted conversations.

Every turn is told by a 16-byte hash of role and text, a conversation by its turns' hashes in a row,
which sort into groups of equal prefixes. The rows are range-sorted into blocks. In a block, row j has
in common with the row before it L_j turns; a node of depth d begins at a row i with L_i < d and ends at
the next row whose L is smaller than d. A stack finds these nearest smaller values in one pass: what L_j
is smaller than is popped (equal values are one node), and all depths from L_i + 1 on are pushed (the
depths a Cartesian tree leaves out). Every figure of a node adds up over its interval of rows.

Blocks work in parallel. Of nodes that reach over a block's edge only pieces are told: those of depth up
to the smallest L of the block pass through it, so that the nearest block with a smaller minimum, which
is the last block before with a piece begun at this depth, owns them. Pieces are added up by owner; there
are at most the depth of one conversation for each block's edge.

Ids of conversations that end at a node are hashed as they stream by, in chunks where a node has many.
What must fit in a task is one conversation's hashes (20 bytes a turn), and its open nodes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.sources.tables import materialise, table

#: Bytes of a turn's hash; conversations that share a base; rows told at once; ids in a chunk and nodes that wait for their parent at most.
HASH, FAMILY, ROWS, CHUNK, WAITING = 16, 20, 4096, 65536, 10000
#: A node, or a piece of one: place of its first row (-1: an earlier block's), sums over its rows, parent, ids.
NODES = "b long, depth int, pos long, part long, n_convs long, conv_id long, n_leaves long, a long, w long, n_children long, s long, own long, up long, parent_conv_id long, ends_sha256 string, ids string, piece boolean"
WORD = r"[^\x20\x09-\x0D]+"


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, k_key, k_words): the rebuilt conversations as hashes of their turns, and the words of each turn.

    Of conv_id c the first h turns are those of c - c % 20, and the rest its own after its first h;
    h is crc32(c) mod 4. Turns go by turn (null first), equal ones by their hash. Null role or
    text is empty; rows of a null conv_id are ignored; other columns too.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    told = turns.where("conv_id IS NOT NULL").select(
        "conv_id", base.alias("base"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(text("role")), F.lit(":"), text("role"), text("text")).cast("binary"))).alias("h"), F.regexp_count(text("text"), F.lit(WORD)).alias("w"),
    )
    rows = told.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "h", "w"))).alias("x"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("x", 1, 3))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    x = F.concat(F.slice(F.coalesce(head, F.expr("array()").cast("array<struct<turn:bigint,h:binary,w:int>>")), F.lit(1), h), F.slice("x", h + 1, F.size("x")))
    return rows.select("conv_id", x.alias("x")).select("conv_id", F.unhex(F.array_join(F.transform("x", lambda t: F.hex(t["h"])), "")).alias("k_key"), F.transform("x", lambda t: t["w"]).alias("k_words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two conversations have in common at their beginning."""
    n = min(len(a), len(b)) // HASH
    if a[: n * HASH] == b[: n * HASH]:
        return n
    low, high = 0, n  # a[:low] is equal, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * HASH : mid * HASH] == b[low * HASH : mid * HASH] else (low, mid)
    return low


class _Node:
    __slots__ = ("depth", "pos", "n", "least", "leaves", "a", "w", "children", "s", "own", "ids", "part", "waiting", "told")

    def __init__(self, depth: int, pos: int, s: int, own: int):
        self.depth, self.pos, self.s, self.own, self.told = depth, pos, s, own, pos < 0 or depth == 0
        self.n = self.leaves = self.a = self.children = self.part = 0
        self.w, self.least, self.ids, self.waiting = own if pos >= 0 else 0, None, [], []


class _Block:
    """The nodes of one block: rows come in order, then the key of the row after them."""

    def __init__(self, b: int, chunk: int, waiting: int):
        self.b, self.stack, self.key, self.rows, self.at, self.chunk, self.most = b, None, None, [], 0, chunk, waiting

    def tell(self, x: _Node, up: int, parent: int | None, piece: bool) -> None:
        ids = ",".join(map(str, x.ids))
        sha = None if piece else hashlib.sha256(ids.encode()).hexdigest()
        self.rows.append((self.b, x.depth, x.pos, x.part, x.n, x.least, x.leaves, x.a, x.w, x.children, x.s, x.own, up, parent, sha, ids if piece else None, piece))

    def publish(self, upto: int) -> None:
        """From now on the nodes up to this place of the stack are told in pieces, as their children need them before they end."""
        for k in range(upto, -1, -1):
            x = self.stack[k]
            x.told = True
            for child in x.waiting:
                self.tell(child, x.pos, None, False)
            x.waiting = []

    def flush_ids(self, at: int) -> None:
        self.publish(at)
        x = self.stack[at]
        empty = _Node(x.depth, x.pos, x.s, x.own)
        empty.ids, empty.part, empty.w, empty.least = x.ids, x.part, 0, x.least
        self.tell(empty, self.stack[at - 1].pos if at else -1, None, True)
        x.ids, x.part = [], x.part + 1

    def pop(self) -> None:
        x = self.stack.pop()
        if self.stack:
            up = self.stack[-1]
            up.n, up.leaves, up.a, up.w = up.n + x.n, up.leaves + x.leaves, up.a + x.a, up.w + x.w
            up.least = x.least if up.least is None else min(up.least, x.least)
        for child in x.waiting:
            self.tell(child, x.pos, x.least, False)
        if x.told:
            self.tell(x, self.stack[-1].pos if self.stack else -1, None, True)
        elif up.told:
            self.tell(x, up.pos, None, False)
        else:
            up.waiting.append(x)
            if len(up.waiting) > self.most:
                self.publish(len(self.stack) - 1)

    def turn_to(self, shared: int) -> None:
        """Close what the next row has no part in."""
        top = self.stack[-1]
        if top.depth > shared:
            top.leaves += 1
            while self.stack and self.stack[-1].depth > shared:
                self.pop()

    def add(self, key: bytes, conv: int, words) -> None:
        n = len(key) // HASH
        if self.stack is None:
            shared = -1 if self.key is None else common(self.key, key)
            self.stack, s = [], 0
            for d in range(shared + 1):
                self.stack.append(_Node(d, -1, s, own := int(words[d - 1]) if d else 0))
                s += own
        else:
            shared = common(self.key, key)
            self.turn_to(shared)
        if shared < n and self.stack:
            self.stack[-1].children += 1
        for d in range(shared + 1, n + 1):
            below = self.stack[-1] if self.stack else None
            self.stack.append(_Node(d, self.at, below.s + below.own if below else 0, int(words[d - 1]) if d else 0))
            if d < n:
                self.stack[-1].children += 1
        top = self.stack[-1]
        top.n, top.a = top.n + 1, top.a + top.s + top.own
        top.least = conv if top.least is None or conv < top.least else top.least
        top.ids.append(conv)
        if len(top.ids) >= self.chunk:
            self.flush_ids(len(self.stack) - 1)
        self.key, self.at = key, self.at + 1

    def end(self, after: bytes | None) -> None:
        """What the row after the block has a part in stays open, and is told in pieces."""
        self.turn_to(-1 if after is None else common(self.key, after))
        self.publish(len(self.stack) - 1)
        while self.stack:
            self.pop()


def _frame(rows: list) -> pd.DataFrame:
    names = [x.split()[0] for x in NODES.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64")
    return out


def nodes_of_blocks(batches: Iterator[pd.DataFrame], chunk: int = CHUNK, waiting: int = WAITING) -> Iterator[pd.DataFrame]:
    """NODES of rows (b, pos, k_key, conv_id, k_words) in order of b, pos. A block's row without words
    before the others tells the key of the row before the block, one after them that of the row after it."""
    block, after = None, None
    for batch in batches:
        for b, key, conv, words in zip(batch["b"].tolist(), batch["k_key"].tolist(), batch["conv_id"].tolist(), batch["k_words"].tolist()):
            if block is None or block.b != b:
                if block is not None:
                    block.end(after)
                    yield _frame(block.rows)
                block, after = _Block(b, chunk, waiting), None
            key = bytes(key)
            if words is not None:
                block.add(key, int(conv), words)
            elif block.stack is None:
                block.key = key
            else:
                after = key
            if len(block.rows) >= ROWS:
                yield _frame(block.rows)
                block.rows = []
    if block is not None:
        block.end(after)
        yield _frame(block.rows)


OWNED = "depth int, o_b long, o_pos long, n_convs long, conv_id long, n_leaves long, saved long, n_children long, up long, ends_sha256 string"


def add_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """OWNED of pieces in order of depth, o_b, o_pos, b, pos, part: sums, and the hash of all ids in order."""
    names = [x.split()[0] for x in OWNED.split(", ")]
    key = now = None

    def told() -> tuple:
        return (*key, now["n"], now["least"], now["leaves"], now["a"] - now["n"] * now["s"] - now["w"], now["children"], now["up"], now["sha"].hexdigest())

    rows = []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if key != (r.depth, r.o_b, r.o_pos):
                if key is not None:
                    rows.append(told())
                key, now = (r.depth, r.o_b, r.o_pos), {"n": 0, "least": None, "leaves": 0, "a": 0, "w": 0, "children": 0, "s": r.s, "up": r.up, "sha": hashlib.sha256(), "any": False}
            for name, x in (("n", r.n_convs), ("leaves", r.n_leaves), ("a", r.a), ("w", r.w), ("children", r.n_children)):
                now[name] += int(x)
            now["least"] = r.conv_id if now["least"] is None else min(now["least"], r.conv_id)
            if r.ids:
                now["sha"].update((("," if now["any"] else "") + r.ids).encode())
                now["any"] = True
        if rows:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    if key is not None:
        yield pd.DataFrame([told()], columns=names)


def trie(convs: DataFrame, blocks: int | None = None, chunk: int = CHUNK, waiting: int = WAITING) -> DataFrame:
    """The nodes of the trie of convs (conv_id, k_key, k_words): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Repeated ids are members each. Turnless conversations end at the root; no conversations, no nodes.
    blocks: how many ranges the sorted rows are cut into (shuffle partitions if not given);
    chunk, waiting: ids told at once, and nodes that wait for their parent, at most.
    """
    spark = convs.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    convs, _ = materialise(convs)
    order = convs.repartitionByRange(blocks, "k_key", "conv_id").sortWithinPartitions("k_key", "conv_id")
    rows, _ = materialise(order.select(F.spark_partition_id().cast("long").alias("b"), F.monotonically_increasing_id().alias("pos"), "k_key", "conv_id", "k_words"))
    # one row a block
    edge = rows.groupBy("b").agg(F.min_by("k_key", "pos").alias("first"), F.max_by("k_key", "pos").alias("last"))
    along = Window.orderBy("b")
    edge = edge.select("b", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    ends = edge.select("b", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.col("before").alias("k_key")), F.struct(F.lit(1 << 62).alias("pos"), F.col("after").alias("k_key")))).alias("x")).select("b", "x.*").where("k_key IS NOT NULL")
    ends = ends.select("b", "pos", "k_key", F.lit(0).cast("long").alias("conv_id"), F.lit(None).cast("array<int>").alias("k_words"))
    dealt = rows.unionByName(ends).repartition(blocks, "b").sortWithinPartitions("b", "pos")
    told, _ = materialise(dealt.mapInPandas(functools.partial(nodes_of_blocks, chunk=chunk, waiting=waiting), NODES))
    pieces = told.where("piece")
    # a piece begun elsewhere belongs to the last node begun at its depth in an earlier block
    before = Window.partitionBy("depth").orderBy("b", "pos", "part")
    owner = F.last(F.when(F.col("pos") >= 0, F.struct("b", "pos")), ignorenulls=True).over(before)
    owned, _ = materialise(pieces.withColumn("o", owner).withColumn("o_b", F.col("o.b")).withColumn("o_pos", F.col("o.pos")).drop("o", "parent_conv_id", "ends_sha256", "piece"))
    whole, _ = materialise(owned.repartition("depth", "o_b", "o_pos").sortWithinPartitions("depth", "o_b", "o_pos", "b", "pos", "part").mapInPandas(add_pieces, OWNED))
    # every piece names its owner's smallest member, for the nodes right above which it is
    names = owned.select("depth", "b", "pos", "o_b", "o_pos").distinct().join(whole.select("depth", "o_b", "o_pos", F.col("conv_id").alias("p_conv")), ["depth", "o_b", "o_pos"])
    names = names.select((F.col("depth") + 1).alias("depth"), "b", F.col("pos").alias("up"), "p_conv")
    saved = F.col("a") - F.col("n_convs") * F.col("s") - F.col("w")
    shape = ["b", "depth", "up", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = told.where("NOT piece").withColumn("saved_tokens", saved).select(shape)
    loose = inner.where("parent_conv_id IS NULL").unionByName(whole.withColumns({"b": F.col("o_b"), "saved_tokens": F.col("saved"), "parent_conv_id": F.lit(None).cast("long")}).select(shape))
    tied = loose.join(names, ["depth", "b", "up"], "left").withColumn("parent_conv_id", F.col("p_conv"))
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inner.where("parent_conv_id IS NOT NULL").select(out).unionByName(tied.select(out))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


SQL = {
    "op11_prefix_trie": r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT t.conv_id, own, coalesce(b.base, []) AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(t.conv_id::VARCHAR) + 1), lambda i: unicode(substr(t.conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 4 AS h
  FROM turns t LEFT JOIN (SELECT conv_id AS base_id, own AS base FROM turns) b ON base_id = t.conv_id - t.conv_id % 20, crc_table
), whole AS (
  SELECT conv_id, list_concat(base[1:h], own[h + 1:]) AS seq FROM heads
), prefixes AS (
  SELECT conv_id, d AS depth, seq[1:d] AS p, CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words, len(seq) = d AS ends
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)
), nodes AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, p
), family AS (
  SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p) AS n_children
  FROM nodes n LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.p = n.p[1:n.depth - 1]
), spread AS (
  SELECT unnest(range(0, depth + 1)) AS d, p, n_children, (n_convs - 1) * words AS saved FROM family
), totals AS (
  SELECT d AS depth, p[1:d] AS p, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM spread GROUP BY d, p[1:d]
)
SELECT f.conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM family f JOIN totals t ON f.depth = t.depth AND f.p = t.p
"""
}
