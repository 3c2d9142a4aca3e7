"""A trie of conversations by their turns: a node for every distinct sequence of first turns.

Each conversation has a chain of SHA-256 digests, one for each of its prefixes, so equal prefixes have equal digests
wherever they are; nodes are groups of (depth, digest). A subtree's sums are gathered by giving what every node
contributes to all its ancestors, which are the prefixes of any of its members: of the smallest one here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import materialise, pieces

ROOT = hashlib.sha256(b"").digest()
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn, with the role's length before it, so no other role and text gives the same bytes."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns_in_order(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest, n_bytes: each turn as its digest and the UTF-8 bytes of its text, so that texts
    aren't shuffled. Turns go by `turn`, null first, equal ones by digest; null role or text is empty. Rows without a
    conv_id are no conversation's and are left out; repeated rows are turns each. Other columns aren't read."""
    said, by = F.coalesce(conversations[text].cast("string"), F.lit("")), F.coalesce(conversations[role].cast("string"), F.lit(""))
    rows = conversations.select(conversations[conv_id].cast("long").alias("conv_id"), conversations[turn].alias("turn"), turn_digest(by, said).alias("digest"), F.octet_length(said).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.where("conv_id IS NOT NULL").select("conv_id", F.row_number().over(order).alias("pos"), "digest", "n_bytes")


def rebuild(turns: DataFrame, step: int = 5, span: int = 9) -> DataFrame:
    """conv_id, pos, digest, n_bytes of rebuilt conversations, and one row with pos null for each that has no turn.

    With h = unsigned crc32(decimal conv_id) mod span, a conversation's first h turns are replaced by the first h of the
    conversation conv_id - conv_id % step: by all of them if there are fewer, by none if there is no such conversation.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % span
    ids = turns.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % step).alias("base"))
    heads = turns.where((F.col("pos") < span) & (F.col("conv_id") % step == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "n_bytes")
    taken = ids.join(heads, "base").where("pos <= h").select(turns.columns)  # at most step conversations of one base
    there = ids.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    return taken.unionByName(turns.where(F.col("pos") > h)).unionByName(there)


def _chain(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent, n_bytes, is_end: a row for each prefix of each conversation, the empty one too.

    The digest of a prefix is that of the digest before it and its last turn's digest. Turns come sorted, so a task
    holds one row of a conversation at a time, and a conversation of any length needs no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "digest", "parent", "n_bytes", "is_end"]
        last: tuple | None = None  # the prefix whose end isn't known yet

        for b in pieces(batches, rows=1 << 14):
            out: list[tuple] = []
            for c, digest, size in zip(b["conv_id"].to_pylist(), b["digest"].to_pylist(), b["n_bytes"].to_pylist()):
                if last is None or last[0] != c:
                    if last is not None:
                        out.append((*last, True))
                    last = (c, 0, ROOT, None, 0)
                if digest is not None:
                    out.append((*last, False))
                    last = (c, last[1] + 1, hashlib.sha256(last[2] + digest).digest(), last[2], size)
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], names)
        if last is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((*last, True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], names)

    rows = turns.select("conv_id", "pos", "digest", "n_bytes").repartition("conv_id").sortWithinPartitions("conv_id", F.col("pos").asc_nulls_first())
    return rows.mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, n_bytes long, is_end boolean")


def _ends(prefixes: DataFrame, width: int = 4096) -> DataFrame:
    """depth, digest, ends_sha256 of nodes where a conversation ends: SHA-256 over the ids, ascending, with commas.

    Ids are first gathered in ranges of `width`, so a node with very many is dealt over many tasks; the ranges' strings
    then pass through one running hash, in order, one at a time.
    """
    ranges = prefixes.where("is_end").groupBy("depth", "digest", F.floor(F.col("conv_id") / width).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, None
        for b in batches:
            out = []
            for key in zip(b["depth"].to_pylist(), b["digest"].to_pylist(), b["ids"].to_pylist()):
                if last == key[:2]:
                    running.update(b"," + key[2].encode())
                    continue
                if last:
                    out.append((*last, running.hexdigest()))
                last, running = key[:2], hashlib.sha256(key[2].encode())
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.string()))], ["depth", "digest", "ends_sha256"])
        if last:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((*last, running.hexdigest()), (pa.int64(), pa.binary(), pa.string()))], ["depth", "digest", "ends_sha256"])

    return ranges.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "range").mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id (the parent's conv_id, null for the
    root), n_convs (members), n_children, n_leaves and saved_tokens (of its subtree, itself included), ends_sha256, digest.

    turns has conv_id, pos, digest and n_bytes; a row whose digest is null only says that the conversation exists. The
    root is there as soon as one conversation is; an empty table gives no rows. Equal conversations share all nodes.

    Every step is linear in the turns. Counting is combined before it is shuffled, so the root and a first turn that a
    third of all conversations share are no larger than others there. What the nodes of one smallest member contribute
    is added up along its prefixes before each prefix passes it on to its node.
    """
    prefixes = materialise(_chain(turns), "trie-prefixes")
    nodes = prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("parent").alias("parent"))
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, ["depth", "digest"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = materialise(counted, "trie-children")

    gives = counted.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    takes = prefixes.select("conv_id", "depth", "digest", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"))
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    passed = gives.unionByName(takes).select("depth", "digest", F.sum("saved").over(below).alias("saved"), F.sum("leaf").over(below).alias("leaf")).where("digest IS NOT NULL")
    sums = passed.groupBy("depth", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = counted.join(sums, ["depth", "digest"]).join(_ends(prefixes), ["depth", "digest"], "left").join(parents, ["depth", "parent"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"))


_CRC = "xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')], lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295)"
ORACLE = f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM o),
r AS (
  SELECT ids.conv_id, pos, role, text FROM ids JOIN o ON o.conv_id = ids.base AND pos <= h
  UNION ALL SELECT ids.conv_id, pos, role, text FROM ids JOIN o ON o.conv_id = ids.conv_id AND pos > h
), c AS (
  SELECT ids.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns
  FROM ids LEFT JOIN r ON r.conv_id = ids.conv_id GROUP BY ids.conv_id
), p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM c),
k AS (SELECT conv_id, depth, turns[1:depth] AS path, depth = len(turns) AS is_end FROM p),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(path[depth].text) ELSE 0 END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM k GROUP BY depth, path
), kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids ON kids.depth = n.depth AND kids.path = n.path),
s AS (
  SELECT k.depth, k.path, count_if(m.n_children = 0) AS n_leaves, sum(m.saved) AS saved_tokens
  FROM k JOIN m ON m.conv_id = k.conv_id AND m.depth >= k.depth GROUP BY k.depth, k.path
)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.depth = m.depth AND s.path = m.path LEFT JOIN n up ON up.depth = m.depth - 1 AND up.path = m.path[1:m.depth - 1]
"""
