"""A Merkle manifest of a table: digests travel to parents and proofs to leaves through queues ordered by node label."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, documents

FAN = 3
LEVELS = 6  # of the tree that one sweep crosses: a sweep holds FAN ** LEVELS nodes at most
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = "tree string, pos long, n long, digest binary"
MESSAGE = "tree string, pos long, lefts array<string>, rights array<string>, top binary"
PROOF = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def digest_of(*values: Column) -> Column:
    """sha256 over the values, each '-' if null, else its byte count, ':' and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without line feeds where 2 divides the crc32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(nodes: int, levels: int) -> int:
    """Levels above a row of nodes of one tree, up to those of one sweep."""
    found = 0
    while found < levels and nodes > FAN**found:
        found += 1
    return found


def forward(leaves: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """(root, runs): a node's label is (end of its leaves, level), so that children come before parents.

    Leaves arrive in order and send their digest to the parent's label. Whenever all leaves up to a label are in, its
    messages stand at the queue's head; they are the run whose digest is sent on. The queue holds FAN messages a level.
    """
    queue, runs, root = [], {}, leaves[0]

    def send(level: int, index: int, value: str) -> None:
        end = min((index // FAN + 1) * FAN ** (level + 1), len(leaves))
        heappush(queue, (end, level + 1, index, value))

    for k, leaf in enumerate(leaves if levels else []):
        send(0, k, leaf)
        while queue and queue[0][0] <= k + 1:
            end, level = label = queue[0][:2]
            run = []
            while queue and queue[0][:2] == label:
                run.append(heappop(queue)[3])
            runs[label], root = run, digest(run)
            if level < levels:
                send(level, (end - 1) // FAN**level, root)
    return root, runs


def backward(runs: dict[tuple[int, int], list[str]], leaves: int, levels: int, above: tuple | None) -> list[tuple | None]:
    """Each leaf's proof suffixes as (left siblings, right siblings, rest): the sweep in the reverse order of labels."""
    found: list[tuple | None] = [above] * leaves
    queue = [(-leaves, -levels, above)] if levels else []
    while queue:
        end, level, rest = heappop(queue)
        run = runs[-end, -level]
        first = (-end - 1) // FAN**-level * FAN
        for j in range(len(run)):
            suffix = ("".join(run[:j]), "".join(run[j + 1 :]), rest)
            if level == -1:
                found[first + j] = suffix
            else:
                heappush(queue, (-min((first + j + 1) * FAN ** (-level - 1), leaves), level + 1, suffix))
    return found


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with equal (tree, chunk), the first two columns, from sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def swept(rows: DataFrame, sweep, schema: str, levels: int) -> DataFrame:
    """rows (tree, pos, ..) dealt by chunks of consecutive nodes and swept in order; what a sweep sends on leaves as rows."""
    chunk = F.expr(f"pos div {FAN**levels}")
    dealt = rows.select("tree", F.coalesce("to_chunk", chunk).alias("chunk"), *(c for c in rows.columns if c not in ("tree", "to_chunk")))
    return dealt.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "pos").mapInArrow(sweep, schema)


def rows_out(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


NODE_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
MESSAGE_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("top", pa.binary())])
PROOF_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])


def climb(nodes: DataFrame, scratch: Scratch, name: str, levels: int) -> list[DataFrame]:
    """nodes and the rows of roots of each round of sweeps above them, until every tree has one node."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            tree, chunk, _, n = rows[0][:4]
            root, _ = forward([r[4].hex() for r in rows], height(n, levels))
            yield rows_out(NODE_ARROW, [(tree, chunk, -(-n // FAN**levels), bytes.fromhex(root))])

    rounds, k = [nodes], 0
    while not k or rounds[-1].where("n > 1").take(1):
        k += 1
        slim = rounds[-1].select("tree", "pos", "n", "digest", F.lit(None).cast("long").alias("to_chunk"))
        rounds.append(scratch.table(swept(slim, up, NODE, levels), f"{name}-{k}"))
    return rounds


def descend(rounds: list[DataFrame], messages: DataFrame, scratch: Scratch, name: str, levels: int, finish, schema: str, arrow: pa.Schema) -> DataFrame:
    """The reversed sweeps: messages (to the topmost nodes: proof suffix and the tree's root) are delivered down to nodes.

    finish(row, chain, top) gives the output row of a node of the lowest round: row has its columns from pos on.
    """

    def down(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for message, *rows in chunks(batches):
                tree, (lefts, rights, top) = message[0], message[-3:]
                above = None
                for left, right in zip(reversed(lefts), reversed(rights), strict=True):
                    above = (left, right, above)
                tall = height(rows[0][3], levels)
                _, runs = forward([r[4].hex() for r in rows], tall)
                found = backward(runs, len(rows), tall, above)
                yield rows_out(arrow if last else MESSAGE_ARROW, [finish(r, chain, top) if last else (tree, r[2], *chain_lists(chain), top) for r, chain in zip(rows, found, strict=True)])

        return run

    for k in range(len(rounds) - 2, -1, -1):
        nodes = rounds[k].withColumn("to_chunk", F.lit(None).cast("long"))
        sent = messages.select("tree", F.lit(-1).cast("long").alias("pos"), F.col("pos").alias("to_chunk"), "lefts", "rights", "top")
        both = nodes.unionByName(sent, allowMissingColumns=True)
        messages = swept(both, down(k == 0), schema if k == 0 else MESSAGE, levels)
        if k:
            messages = scratch.table(messages, f"{name}-down-{k}")
    return messages


def chain_lists(chain: tuple | None) -> tuple[list[str], list[str]]:
    lefts, rights = [], []
    while chain:
        left, right, chain = chain
        lefts.append(left)
        rights.append(right)
    return lefts, rights


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with pos, from 0 on in their tree, and n, the tree's rows: range partitions are sorted, then offset by one row a part and tree."""
    keys = ["tree", *order]
    held = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id())
    held = scratch.table(held, f"{name}-sorted").withColumn("part", F.shiftright("mid", 33))
    parts = held.groupBy("tree", "part").agg(F.min("mid").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    parts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    found = held.join(scratch.table(parts, f"{name}-parts"), ["tree", "part"])
    return scratch.table(found.withColumn("pos", F.col("mid") + F.col("shift")).drop("mid", "part", "shift"), name)


def manifest(docs: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the row's columns. Per group, leaves ascend by id (null first; rows that share an id by
    leaf, equal rows in any order, each with its own place); every three consecutive nodes become one until one is left.
    The groups' roots, null first, then by their bytes, do likewise. A proof is the siblings from the leaf to the root.
    folded_root is worked out from the tampered leaf, where the row is one of those, and the original siblings.

    Null, empty and long texts are values like others; a null group is a group of its own. An empty table gives an empty
    result. Other columns are not read.

    Only digests travel: rows are range-sorted once and numbered by offsets, so a hot group is dealt in chunks of
    3 ** levels nodes like any other. Within a chunk a queue ordered by label delivers digests; beyond it they leave as
    rows, and Spark's sort by (tree, chunk, position) is the external queue. The proofs come back the same way.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    values = {c: F.col(c) for c in columns or COLUMNS}
    leaf = digest_of(*values.values())
    other = digest_of(*(values | {text_col: tampered(text, id_)}).values())
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))  # null first
    hit = (F.crc32(id_.cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
    rows = docs.select(group.alias("tree"), id_.alias("doc_id"), leaf.alias("digest"), F.when(hit, other).alias("other"), F.monotonically_increasing_id().alias("rid"))
    leaves = numbered(scratch.table(rows, "rows"), ["doc_id", "digest", "rid"], scratch, "leaves").drop("rid")
    up = climb(leaves.select("tree", "pos", "n", "digest", "doc_id", "other"), scratch, "source", levels)
    groups = numbered(up[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), ["key"], scratch, "groups")
    over = climb(groups.select("tree", "pos", "n", "digest", "key"), scratch, "root", levels)
    root = F.lit(next((r.digest.hex() for r in over[-1].select("digest").take(1)), None)).cast("string")

    def to_group(row: tuple, chain: tuple | None, top: bytes) -> tuple:
        return row[5], 0, *chain_lists(chain), row[4]

    def to_leaf(row: tuple, chain: tuple | None, top: bytes) -> tuple:
        own, proof = row[4].hex(), hashlib.sha256()
        folded = row[6].hex() if row[6] is not None else own
        while chain:
            left, right, chain = chain
            proof.update((left + right).encode())
            folded = digest([left, folded, right])
        return row[5], own, top.hex(), proof.hexdigest(), folded

    start = over[-1].select("tree", "pos", *(F.array().cast("array<string>").alias(c) for c in ("lefts", "rights")), F.col("digest").alias("top"))
    messages = scratch.table(descend(over, start, scratch, "root", levels, to_group, MESSAGE, MESSAGE_ARROW), "to-groups")
    found = descend(up, messages, scratch, "source", levels, to_leaf, PROOF, PROOF_ARROW)
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE held AS (
    SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS rid, crc_even.e AS e, f.own AS own, f.other AS other
    FROM documents, LATERAL (SELECT (WITH RECURSIVE c(k, v) AS (SELECT 1, 4294967295::UBIGINT UNION ALL
        SELECT k + 1, list_reduce(list_prepend(xor(v, ord(substr(CAST(doc_id AS VARCHAR), k, 1))::UBIGINT), range(8)::UBIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END)
        FROM c WHERE k <= length(CAST(doc_id AS VARCHAR))) SELECT xor(max_by(v, k), 4294967295::UBIGINT) % 2 = 0 FROM c) AS e) AS crc_even,
    LATERAL (SELECT coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head) AS h,
    LATERAL (SELECT sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS own, sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS other) AS f
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, own) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM held),
nodes AS (
    SELECT 0 AS level, source, idx, n, own AS d FROM leaves
    UNION ALL SELECT level + 1, source, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, source, idx // 3, n
),
subroots AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, idx, n, d FROM subroots
    UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 3, n
),
step AS (
    SELECT 0 AS level, rid, source, idx, n, '' AS proof, CASE WHEN e THEN other ELSE own END AS v FROM leaves
    UNION ALL SELECT s.level + 1, s.rid, s.source, s.idx // 3, (s.n + 2) // 3, s.proof || coalesce(string_agg(o.d, '' ORDER BY o.idx) FILTER (o.idx <> s.idx), ''), sha256(string_agg(CASE WHEN o.idx = s.idx THEN s.v ELSE o.d END, '' ORDER BY o.idx))
    FROM step s JOIN nodes o ON o.level = s.level AND o.source IS NOT DISTINCT FROM s.source AND o.idx // 3 = s.idx // 3 WHERE s.n > 1 GROUP BY s.level, s.rid, s.source, s.idx, s.n, s.proof, s.v
),
walk AS (
    SELECT 0 AS level, s.rid, r.idx, r.n, s.proof, s.v FROM step s JOIN subroots r ON r.source IS NOT DISTINCT FROM s.source WHERE s.n = 1
    UNION ALL SELECT s.level + 1, s.rid, s.idx // 3, (s.n + 2) // 3, s.proof || coalesce(string_agg(o.d, '' ORDER BY o.idx) FILTER (o.idx <> s.idx), ''), sha256(string_agg(CASE WHEN o.idx = s.idx THEN s.v ELSE o.d END, '' ORDER BY o.idx))
    FROM walk s JOIN tops o ON o.level = s.level AND o.idx // 3 = s.idx // 3 WHERE s.n > 1 GROUP BY s.level, s.rid, s.idx, s.n, s.proof, s.v
)
SELECT l.doc_id, l.own AS leaf, r.d AS subroot, t.d AS root, sha256(w.proof) AS proof_sha256, w.v AS folded_root, w.v = t.d AS verified
FROM leaves l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source JOIN walk w ON w.rid = l.rid AND w.n = 1 JOIN tops t ON t.n = 1
"""
