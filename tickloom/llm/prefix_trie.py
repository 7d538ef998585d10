"""The trie of conversation prefixes, by truncation peeling.

A row is part of a node: a conversation that ends there, or what has been found below
it. At the greatest depth equal rows are merged into a node, the node's figures are
written out, its last turn is stripped, and it stands as a row of the node above,
beside the conversations that end there. So nodes are found and added up in one pass
from the deepest to the root, and each carries its own path of turn digests.

Spark deals the work by prefix. A prefix of several rows with more than ``GROUP_TURNS``
turns is heavy; each row goes with its shortest prefix that is not, and a task peels its
groups down to these prefixes. There the rows meet heavy nodes: they are added up by
Spark (partly before the shuffle), one row for each heavy node, and these few rows are
peeled in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, give_back, read, stored, text_of

#: Turns below a prefix, counted once for each row, that one task may peel as a group.
GROUP_TURNS = 20_000
#: Nodes that a task hands on at a time.
BLOCK_NODES = 10_000
#: Bytes of a digest; a path is the digests of its prefixes, from depth 1 on.
WIDE = 16
#: Conversations that end at a node are joined by runs of so many ids.
RUN_BITS = 10
#: The digest of no ids.
NONE_END = hashlib.sha256(b"").hexdigest()

#: A part of the node at the end of ``path``; ``words`` are those of each of its turns.
PART = "path binary, words array<int>, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE = "digest binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_ARROW = pa.schema(
    [("digest", pa.binary()), ("above", pa.binary()), *((n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("path", pa.binary()), ("words", pa.list_(pa.int32()))]
)


def turn_digest(role: Column, text: Column) -> Column:
    """Equal for equal roles and texts only (128 bits)."""
    return F.unhex(F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 2 * WIDE))


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: an array of ``digest, words`` in the order of ``turn`` (null
    first; then of role and text). Rows without a ``conv_id`` belong to none."""
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "said")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of(F.col("role").cast("string")).alias("role"), text_of(F.col("text").cast("string")).alias("said"))
    turns = rows.select("conv_id", F.struct(F.row_number().over(order).alias("at"), turn_digest(F.col("role"), F.col("said")).alias("digest"), F.regexp_count("said", F.lit(WORD)).cast("int").alias("words")).alias("turn"))
    listed = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return turns.groupBy("conv_id").agg(listed.alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all prefixes of each sequence, each from the one before."""
    for batch in batches:
        paths = []
        for turns in batch.column(1).to_pylist():
            here, path = b"", []
            for digest in turns:
                here = hashlib.blake2b(here + digest, digest_size=WIDE).digest()
                path.append(here)
            paths.append(b"".join(path))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary()), batch.column(2)], names=["conv_id", "path", "words"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one sequence after the other, in ascending order: one row a
    sequence, with the digest of its ids. No more than a batch is held."""
    out = pa.schema([("path", pa.binary()), ("words", pa.list_(pa.int32())), *((n, pa.int64()) for n in ("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])
    now, sha, row = None, None, {}
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["path"] != now:
                if sha:
                    done.append(row | {"ends_sha256": sha.hexdigest()})
                now, sha = r["path"], hashlib.sha256()
                row = {"path": now, "words": r["words"], "n_convs": 0, "conv_id": r["conv_id"], "n_children": 0, "n_leaves": 0, "saved_tokens": 0}
            else:
                sha.update(b",")
            sha.update(r["ids"].encode())
            row["n_convs"] += r["n"]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=out)
    if sha:
        yield pa.RecordBatch.from_pylist([row | {"ends_sha256": sha.hexdigest()}], schema=out)


def ended(convs: DataFrame) -> DataFrame:
    """One part for each distinct sequence: the conversations that end there. Equal
    conversations, however many, are joined in runs of ids before they meet."""
    coded = convs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    paths = coded.mapInArrow(_paths, "conv_id long, path binary, words array<int>")
    run = F.shiftright("conv_id", RUN_BITS)
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    runs = paths.groupBy("path", run.alias("run")).agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), ids.alias("ids"))
    return runs.repartition("path").sortWithinPartitions("path", "run").select("path", "words", "conv_id", "n", "ids").mapInArrow(_streamed, PART)


def _prefix(depth: Column) -> Column:
    """The digest of the prefix with ``depth`` turns of ``path``; empty for the root."""
    return F.when(depth == 0, F.lit(b"")).otherwise(F.substring("path", ((depth - 1) * WIDE + 1).cast("int"), F.lit(WIDE)))


def heavy_prefixes(parts: DataFrame, limit: int) -> DataFrame:
    """Digests of the prefixes of two rows or more that have more than ``limit`` turns in
    all. There are at most ``turns / limit`` at each depth."""
    size = F.octet_length("path") / WIDE
    rows = parts.select(F.col("path"), (size + 1).cast("long").alias("turns"), F.explode(F.sequence(F.lit(0), size.cast("int"))).alias("depth"))
    return rows.select(_prefix(F.col("depth")).alias("digest"), "turns").groupBy("digest").agg(F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("rows")).where((F.col("turns") > limit) & (F.col("rows") > 1)).select("digest")


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peels groups, which come one after the other, each down to its own prefix."""
    top, rows, out = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["top"] != top:
                out += _peel(rows)
                rows = []
                if len(out) >= BLOCK_NODES:
                    yield pa.RecordBatch.from_pylist(out, schema=NODE_ARROW)
                    out = []
            top = r["top"]
            rows.append(r)
    if rows:
        out += _peel(rows)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=NODE_ARROW)
    give_back()


def _peel(rows: list[dict]) -> list[dict]:
    """The nodes of a group, from the deepest to depth ``top_depth``. Those of that depth
    keep their path, as the rows of the nodes above are made of it."""
    top, at = rows[0]["top_depth"], {}
    for r in rows:
        at.setdefault(len(r["path"]) // WIDE, []).append(r)
    levels: list[dict[bytes, dict]] = []
    for depth in range(max(at), top - 1, -1):
        nodes: dict[bytes, dict] = {}
        for part in at.pop(depth, ()):  # ends here, or has been stripped to here
            merge(nodes, part["path"][-WIDE:], part)
        for node in nodes.values():
            finish(node)
            if depth > top:
                at.setdefault(depth - 1, []).append(stripped(node))
        levels.append(nodes)
    out = []
    for below, above in zip(levels, [*levels[1:], {}], strict=True):
        for digest, n in below.items():
            depth = len(n["path"]) // WIDE
            parent = n["path"][-2 * WIDE : -WIDE] if depth else None
            known = above.get(parent)
            row = {k: n[k] for k in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")}
            row |= {"digest": digest, "depth": depth, "above": None if known else parent, "parent_conv_id": known and known["conv_id"]}
            out.append(row | ({"path": n["path"], "words": n["words"]} if depth == top else {}))
    return out


def merge(nodes: dict[bytes, dict], digest: bytes, part: dict) -> None:
    n = nodes.get(digest)
    if n is None:
        nodes[digest] = {k: part[k] for k in ("path", "words", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends_sha256")}
        return
    for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
        n[k] += part[k]
    n["conv_id"] = min(n["conv_id"], part["conv_id"])
    n["ends_sha256"] = n["ends_sha256"] or part["ends_sha256"]


def finish(node: dict) -> None:
    """All rows of the node are merged: what it adds itself."""
    node["n_leaves"] = node["n_leaves"] or 1
    if node["words"]:
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"][-1]


def stripped(node: dict) -> dict:
    """The node as a row of the one above."""
    return node | {"path": node["path"][:-WIDE], "words": node["words"][:-1], "n_children": 1, "ends_sha256": None}


def trie(convs: DataFrame, limit: int = GROUP_TURNS) -> DataFrame:
    """The nodes of all prefixes of ``convs`` (``conv_id, turns``; see ``sequences``):
    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    A conversation without turns is a member of the root. No conversations have no
    nodes. Repeated sequences are members of the same nodes, each counted. Turns are
    told apart by digests of 128 bits. There are as many rounds as it takes until no
    prefix is heavy. A node has one row after the first, so the deepest node that is
    left is never heavy and each round ends at least one depth; as a round leaves a row
    for each heavy node only, two or three rounds do unless hundreds of turns are heavy.
    """
    parts = stored(ended(convs), "trie-ended")
    done: list[DataFrame] = []
    while True:
        heavy = stored(heavy_prefixes(parts, limit), "trie-heavy")
        if last := heavy.isEmpty():
            dealt = parts.withColumns({"top_depth": F.lit(0), "top": F.lit(b"")})
        else:
            # Heavy prefixes of a row are its shortest ones: their number is the depth
            # of the first that is not heavy.
            size = (F.octet_length("path") / WIDE).cast("int")
            numbered = stored(parts.withColumn("row", F.monotonically_increasing_id()), "trie-parts")
            each = numbered.select("row", "path", F.explode(F.sequence(F.lit(0), size)).alias("depth")).select("row", _prefix(F.col("depth")).alias("digest"))
            depths = each.join(broadcast_if_small(heavy), "digest", "left_semi").groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("top_depth"))
            dealt = numbered.join(depths, "row", "left").fillna(0, ["top_depth"]).withColumn("size", size).withColumn("top", F.when(F.col("top_depth") <= F.col("size"), _prefix(F.col("top_depth"))))
            dealt = stored(dealt.drop("size", "row"), "trie-dealt")
        light = dealt.where("top is not null").repartition("top").sortWithinPartitions("top")
        peeled = stored(light.mapInArrow(_peeled, NODE + ", path binary, words array<int>"), "trie-nodes")
        done.append(peeled.drop("path", "words"))
        if last:
            break
        # Light tops, stripped, and conversations that end at heavy nodes.
        up = peeled.where("path is not null").select(
            F.substring("path", F.lit(1), F.octet_length("path") - WIDE).alias("path"), F.slice("words", F.lit(1), F.size("words") - 1).alias("words"),
            "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"),
        )
        here = dealt.where("top is null").drop("top", "top_depth")
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        parts = stored(up.unionByName(here).groupBy("path", "words").agg(*sums, F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256")), "trie-parts")
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    if len(done) > 1:
        # Only nodes that were peeled in a later round have children without a parent.
        upper = done[1]
        for d in done[2:]:
            upper = upper.unionByName(d)
        parents = upper.select(F.col("digest").alias("above"), F.col("conv_id").alias("parent"))
        nodes = nodes.join(broadcast_if_small(parents), "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE_END)).alias("ends_sha256"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation ``c`` with the first ``h`` turns of ``c - c % 20`` in place of its
    own first ``h``; ``h`` is ``crc32(c) % 4``. At most 20 share such a start."""
    heads = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("from"), F.slice("turns", 1, 3).alias("head"))
    own = convs.withColumns({"from": F.expr("conv_id - conv_id % 20"), "h": (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 4).cast("int")})
    none = F.array().cast(convs.schema["turns"].dataType)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "from", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(stored(sequences(read(spark, sf_dir, "conversations")), "conversations")))


# CRC-32 of the decimal id, byte by byte and bit by bit; each byte is followed by seven
# zeros, as every step also takes one bit off.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"""
# Sums over a subtree are sums over members: a member brings the words of its turns from
# the node on, less the words of the nodes of which it is the smallest member.
SQL = {
    "op11_prefix_trie": f"""
WITH turn_lists AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (SELECT *, {_CRC} % 4 AS h FROM turn_lists),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(p.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM headed c LEFT JOIN turn_lists p ON p.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(turns) AS size, d AS depth, turns[1:d] AS prefix,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends
  FROM prefixes GROUP BY prefix, depth
), children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
shares AS (
  SELECT p.conv_id, p.prefix, p.depth, n.conv_id AS smallest, coalesce(k.n_children, 0) AS n_children,
    p.words - CASE WHEN n.conv_id = p.conv_id THEN p.words ELSE 0 END AS saved,
    CASE WHEN k.n_children IS NULL AND n.conv_id = p.conv_id THEN 1 ELSE 0 END AS leaf
  FROM prefixes p JOIN nodes n ON n.prefix = p.prefix LEFT JOIN children k ON k.prefix = p.prefix
), suffixes AS (
  SELECT *, sum(saved) OVER w AS saved_from, sum(leaf) OVER w AS leaf_from FROM shares
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), totals AS (
  SELECT prefix, max(n_children) AS n_children, sum(saved_from) AS saved_tokens, sum(leaf_from) AS n_leaves FROM suffixes GROUP BY prefix
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(t.n_children AS BIGINT) AS n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN totals t ON t.prefix = n.prefix LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1] AND p.depth = n.depth - 1
"""
}
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
