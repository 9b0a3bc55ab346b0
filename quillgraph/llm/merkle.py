"""Merkle manifest of a dataset: leaf digests, group roots, one root, and a proof for every row.

Nodes are labelled by group, level and place. Time-forward processing hands digests up: a queue ordered by label delivers
what the children sent when their parent's turn comes, and the parent sends its digest on. A reversed sweep in falling
order of labels hands each node the rest of its proof, which it passes to its children with their siblings in front,
down to the leaves.

The queue is external: a block of up to ``block`` neighbouring nodes of a group is swept in one task with a heap, and what
its top sends is a row, dealt by the next round's block and sorted by label. So a tree of any size takes one round for
every factor of ``block`` in its leaves, a task holds one block, and a group with a third of all rows is many blocks.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small, stash, table

MESSAGE = "steps array<struct<left: string, right: string>>, subroot string, root string"
ALONE = ("", "")


def leaf_digest(columns: list[str | Column]) -> Column:
    """Lowercase hex sha256 of the columns in order: ``-`` for null, else the size in UTF-8 bytes, ``:`` and the value."""
    fields = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), 256)


def levels_of(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


class Sweep:
    """Both sweeps over one block, whose top stands ``levels`` above its ``digests``."""

    def __init__(self, digests: list[str], levels: int, fanout: int):
        self.sizes = [len(digests)]
        for _ in range(levels):
            self.sizes.append(-(-self.sizes[-1] // fanout))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).tolist()
        self.fanout, self.digests = fanout, [""] * self.first[-1]
        self._forward(digests)

    def parent(self, label: int, level: int) -> int:
        return self.first[level + 1] + (label - self.first[level]) // self.fanout

    def _forward(self, digests: list[str]) -> None:
        top, level = self.first[-1] - 1, 0
        self.digests[: len(digests)] = digests
        queue = [(self.parent(k, 0), k, d) for k, d in enumerate(digests)] if len(self.sizes) > 1 else []
        heapq.heapify(queue)
        while queue:
            label, received = queue[0][0], []
            while queue and queue[0][0] == label:
                received.append(heapq.heappop(queue)[2])
            digest = self.digests[label] = sha256("".join(received).encode()).hexdigest()
            while label >= self.first[level + 1]:
                level += 1
            if label != top:
                heapq.heappush(queue, (self.parent(label, level), label, digest))

    @property
    def top(self) -> str:
        return self.digests[-1]

    def backward(self, rest: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
        """Proofs of the block's nodes, given the ``rest`` of the proof of its top."""
        out: list = [None] * self.sizes[0]
        queue, level = [(1 - self.first[-1], rest)], len(self.sizes) - 1
        while queue:
            label, steps = heapq.heappop(queue)
            label = -label
            while label < self.first[level]:
                level -= 1
            if not level:
                out[label] = steps
                continue
            below = self.first[level - 1]
            start = below + (label - self.first[level]) * self.fanout
            children = self.digests[start : min(start + self.fanout, self.first[level])]
            for k in range(len(children)):
                step = ("".join(children[:k]), "".join(children[k + 1 :])) if len(children) > 1 else ALONE
                heapq.heappush(queue, (-start - k, [step, *steps]))
        return out


def _blocks(batches, keys: int):
    """Arrow tables of the rows that agree in the first ``keys`` columns, from sorted batches."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            here = tuple(int(c[a]) for c in columns)
            if held and here != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_g`` (an id of its group, rising with it), ``_at`` (its place in the group from 0) and ``_m`` (the group's size).

    Rows are dealt by ranges, so no group lies in one task; a place is counted in its partition and added to what lies before.
    """
    keys = [F.asc_nulls_first(c) for c in group + order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = stash(dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_k", F.struct(*group) if group else F.lit(0)))
    here = dealt.groupBy("_k", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ranked = Window.partitionBy("_k").orderBy("_part")
    every = Window.partitionBy("_k")
    # a row for each partition and group in it: as many as partitions and groups together
    starts = here.select("_k", "_part", F.min("_first").over(every).alias("_g"), F.sum("_n").over(every).alias("_m"), (F.sum("_n").over(ranked) - F.col("_n") - F.col("_first")).alias("_shift"))
    joined = dealt.join(small(stash(starts), 100_000), ["_k", "_part"])
    return joined.withColumn("_at", F.col("_at") + F.col("_shift")).drop("_k", "_part", "_shift")


def _tree(nodes: DataFrame, fanout: int, block: int) -> list[DataFrame]:
    """Nodes (``_g``, ``_at``, ``_m``, ``_d`` and others) of each round, from the leaves to one node a group."""
    deep = 1
    while fanout ** (deep + 1) <= block:
        deep += 1
    width = fanout**deep
    most = nodes.agg(F.max("_m")).first()[0] or 0

    def up(batches):
        import pyarrow as pa

        out = [], [], [], []
        for (g, b), rows in _blocks(batches, 2):
            m = rows.column("_m")[0].as_py()
            digest = Sweep(rows.column("_d").to_pylist(), min(deep, levels_of(m, fanout)), fanout).top
            for column, value in zip(out, (g, b, -(-m // width), digest), strict=True):
                column.append(value)
            if len(out[0]) == 1000:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["_g", "_at", "_m", "_d"])
                out = [], [], [], []
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["_g", "_at", "_m", "_d"])

    rounds = [nodes]
    while most > 1:
        dealt = nodes.select("_g", F.expr(f"_at div {width}").alias("_b"), "_at", "_m", "_d").repartition("_g", "_b").sortWithinPartitions("_g", "_b", "_at")
        nodes = stash(dealt.mapInArrow(up, "_g long, _at long, _m long, _d string"))
        rounds.append(nodes)
        most = -(-most // width)
    return rounds


def _down(rounds: list[DataFrame], messages: DataFrame, fanout: int, block: int) -> DataFrame:
    """The nodes of the first round with the message of each, from ``messages`` (``_g``, ``_at`` and those of ``MESSAGE``) to the tops."""
    deep = 1
    while fanout ** (deep + 1) <= block:
        deep += 1
    width, names = fanout**deep, ["steps", "subroot", "root"]

    def down(batches):
        import pyarrow as pa

        for _, rows in _blocks(batches, 2):
            note, rows = rows.slice(0, 1), rows.slice(1)
            if not rows.num_rows or note.column("_at")[0].as_py() is not None:
                raise ValueError("a block of nodes without its message, or a message without its block")
            m = rows.column("_m")[0].as_py()
            rest = [(s["left"], s["right"]) for s in note.column("steps")[0].as_py()]
            proofs = Sweep(rows.column("_d").to_pylist(), min(deep, levels_of(m, fanout)), fanout).backward(rest)
            flat = [s for p in proofs for s in p]
            steps = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], ["left", "right"])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in proofs])]), pa.int32())
            told = [pa.array([note.column(n)[0].as_py()] * rows.num_rows, pa.string()) for n in names[1:]]
            own = rows.drop_columns(["_b", *names])
            for batch in own.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, steps), *told], [*own.schema.names, *names])

    for nodes in reversed(rounds[:-1]):
        held = nodes.select("_g", F.expr(f"_at div {width}").alias("_b"), *[c for c in nodes.columns if c != "_g"])
        both = held.unionByName(messages.withColumnRenamed("_at", "_b"), allowMissingColumns=True)
        both = both.repartition("_g", "_b").sortWithinPartitions("_g", "_b", F.asc_nulls_first("_at"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
        messages = both.mapInArrow(down, f"{schema}, {MESSAGE}")
        if nodes is not rounds[0]:
            messages = stash(messages.select("_g", "_at", *names))
    return messages


def proofs(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = 2, block: int = 4096) -> DataFrame:
    """``leaves`` with ``subroot`` (of its group), ``root`` and ``proof``: for each level up to the root what stands left and right of the node.

    Within a group rows ascend by ``order`` and then by digest; a null order or group comes first. While several nodes
    remain, runs of ``fanout`` become the digest of their joined digests, the last run may be shorter and even one; a lone
    leaf is its group's root, and the groups' roots become the root in the same way. Repeated rows are leaves of their own.
    An empty table gives no rows. Texts play no part beyond their digest, so their length doesn't matter. All columns of
    ``leaves`` come along but those named ``subroot``, ``root`` and ``proof``, which are replaced.
    """
    own = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "proof")]
    # under names of their own, so that no column of the table clashes
    held = leaves.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.col(leaf).alias("_d"), F.struct(*[F.col(c) for c in own]).alias("_row"))
    nodes = stash(placed(held, ["_group"], ["_order", "_d"]).select("_g", "_at", "_m", "_d", "_row"))
    rounds = _tree(nodes, fanout, block)
    tops = rounds[-1].select(F.col("_g").alias("_of"), "_d")
    upper = _tree(stash(placed(tops, [], ["_of"]).select("_g", "_at", "_m", "_d", "_of")), fanout, block)
    no_steps = F.array().cast("array<struct<left: string, right: string>>")
    start = upper[-1].select("_g", "_at", no_steps.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("_d").alias("root"))
    if len(upper) > 1:
        told = _down(upper, start, fanout, block).select(F.col("_of").alias("_g"), F.lit(0).cast("long").alias("_at"), "steps", F.col("_d").alias("subroot"), "root")
    else:
        told = upper[-1].select(F.col("_of").alias("_g"), F.lit(0).cast("long").alias("_at"), no_steps.alias("steps"), F.col("_d").alias("subroot"), F.col("_d").alias("root"))
    told = stash(told)
    if len(rounds) == 1:
        return nodes.join(told.drop("_at"), "_g").select("_row.*", "subroot", "root", F.col("steps").alias("proof"))
    return _down(rounds, told, fanout, block).select("_row.*", "subroot", "root", F.col("steps").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to along ``proof``."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings in a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: F.concat(step["left"], step["right"]))), 256)


def manifest(docs: DataFrame, columns: list[str], changed: dict[str, Column], group: str = "lang", order: str = "doc_id") -> DataFrame:
    """Leaf, roots and proof digest of each row of ``docs``, and whether the row with its ``changed`` columns still leads to the root.

    ``changed`` gives columns of the row as found later; where a value is the same as before, so is its leaf. Nulls are
    values of their own. See ``proofs`` for orders, repeated rows and empty tables; other columns are ignored.
    """
    later = [changed.get(c, F.col(c)) for c in columns]
    same = F.lit(True)
    for c, value in changed.items():
        same &= F.col(c).eqNullSafe(value)
    leaf = leaf_digest(columns)
    rows = docs.select(F.col(group).alias("_by"), order, leaf.alias("leaf"), F.when(~same, leaf_digest(later)).alias("_later"))
    found = proofs(rows, "_by", order)
    root = folded(F.coalesce("_later", "leaf"), F.col("proof"))
    found = found.select(order, "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    tampered = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    return manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": tampered})


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
#: The checksum of a decimal is folded byte by byte and bit by bit, since the SQL has no function for it.
ORACLES = {
    "op11_merkle_manifest": """
WITH RECURSIVE c AS (
  SELECT *, 4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, b: xor(x // 2, (x % 2) * 3988292384))) AS crc FROM documents
), f AS (
  SELECT doc_id, lang, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS later, n_chars,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM c
), leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(octet_length(encode(later::VARCHAR)) || ':' || later, '-') || tail) AS later,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f
), node AS (
  SELECT lang, 0 AS level, pos, n, leaf AS d FROM leaf
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lang, level, pos // 2, n
), sub AS (
  SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, n, d FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), path AS (
  SELECT doc_id, leaf.lang, node.level, node.pos % 2 AS side, s.d AS sibling
  FROM leaf JOIN node ON node.lang IS NOT DISTINCT FROM leaf.lang AND node.n > 1 AND node.pos = leaf.pos // (2 ** node.level)::BIGINT
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM node.lang AND s.level = node.level AND s.pos = xor(node.pos, 1)
  UNION ALL
  SELECT doc_id, leaf.lang, 1000 + u.level, u.pos % 2, s.d
  FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang JOIN upper u ON u.n > 1 AND u.pos = sub.pos // (2 ** u.level)::BIGINT
  LEFT JOIN upper s ON s.level = u.level AND s.pos = xor(u.pos, 1)
), proof AS (
  SELECT doc_id, lang, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256,
    list({side: side, sibling: coalesce(sibling, '')} ORDER BY level) AS steps FROM path GROUP BY ALL
), all_ AS (
  SELECT leaf.doc_id, leaf.leaf, sub.d AS subroot, (SELECT d FROM upper WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_concat([{side: 0::BIGINT, sibling: leaf.later}], coalesce(steps, [])),
      lambda acc, s: {side: 0::BIGINT, sibling: sha256(CASE WHEN s.side = 1 THEN s.sibling || acc.sibling ELSE acc.sibling || s.sibling END)}).sibling AS folded_root
  FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang LEFT JOIN proof ON proof.doc_id = leaf.doc_id AND proof.lang IS NOT DISTINCT FROM leaf.lang
)
SELECT *, folded_root = root AS verified FROM all_
"""
}
