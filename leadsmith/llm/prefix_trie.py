"""Prefix trie of conversations: union-find over the common-prefix lengths of sorted neighbours, in descending depth.

Rebuilt conversations are sorted by their turns, each turn standing as the SHA-256 of its role and text. Within a block of
consecutive conversations, neighbours are joined in descending order of the number of turns that they share; each merge of
components is a branching node, and the turns between two merges are its chain. A block's forest is contracted to the two
paths at its ends: only nodes on those can have members in other blocks. Contracted paths are merged again, some hundred at a
time, until one group is left, so that no task reads more than a block or a group, however many conversations share a prefix.

Results for awkward input: null roles and texts count as empty; turns are ordered by ``turn``, nulls first, and rows that tie
by the SHA-256 of role and text (repeated rows are repeated turns); rows without conv_id belong to no conversation and are
left out; an empty table gives no node, not even a root. Other columns are not read. Texts may be of any length: only their
digest and size travel. Memory of a task grows with the longest single conversation (40 bytes a turn), not with the number
of conversations that share a prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.shared import ship, stored

#: Bytes that stand for one turn in a path: SHA-256 of role and text, then the text's size in bytes (big-endian).
DIGEST, TURN = 32, 40
#: Every conversation takes its first turns from the one at the start of its group of conv_ids; fewer than SHARED_TURNS of them.
GROUP, SHARED_TURNS = 5, 9
#: A block ends at so many rows or bytes of paths; so many partitions, and contracted paths, are merged at a time.
BLOCK_ROWS, BLOCK_BYTES, FAN = 20_000, 8_000_000, 256
#: Identifiers in one piece of a list that spans blocks.
PIECE_IDS = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

FOREST = (
    "kind string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, node binary, block bigint, side int, up bigint, first_id bigint, ids string, "
    "part bigint, place bigint, path binary, records array<array<bigint>>"
)
ARROW = pa.schema(
    [
        ("kind", pa.string()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
        ("node", pa.binary()),
        ("block", pa.int64()),
        ("side", pa.int32()),
        ("up", pa.int64()),
        ("first_id", pa.int64()),
        ("ids", pa.string()),
        ("part", pa.int64()),
        ("place", pa.int64()),
        ("path", pa.binary()),
        ("records", pa.list_(pa.list_(pa.int64()))),
    ]
)
#: What a path says of one of its nodes, open children left out: members, smallest member, and children, leaves and savings below.
Record = list[int]
#: A sorted path and what is known of its nodes, by depth.
Item = tuple[bytes, dict[int, Record]]


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): the first turns of the group's first conversation, then the own turns behind as many."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256)
    size = F.lpad(F.hex(F.octet_length(text).cast("bigint")), 2 * (TURN - DIGEST), "0")
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.concat(digest, size).alias("fp"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "fp")))["fp"].alias("own"))
    own = stored(own, "own_turns")
    heads = own.select(F.col("conv_id").alias("head_id"), F.slice("own", 1, SHARED_TURNS - 1).alias("head"))
    joined = own.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "head_id", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two paths have in common at their start."""
    limit, k = min(len(a), len(b)), 0
    while k < limit and a[k : k + TURN] == b[k : k + TURN]:
        k += TURN
    return k // TURN


def last_size(path: bytes, depth: int) -> int:
    """Bytes of the text of the depth-th turn; the root has none."""
    return int.from_bytes(path[depth * TURN - TURN + DIGEST : depth * TURN], "big") if depth else 0


def fold(records: dict[int, Record], depth: int, n: int, least: int, children: int, leaves: int, saved: int) -> None:
    r = records.get(depth)
    if r is None:
        records[depth] = [n, least, children, leaves, saved]
    else:
        r[0] += n
        r[1] = min(r[1], least)
        r[2] += children
        r[3] += leaves
        r[4] += saved


def contract(items: list[Item], whole: bool, node: Callable[..., dict]) -> tuple[list[Item], list[tuple[dict, int, int]]]:
    """Union-find over the edges between neighbouring items, deepest first.

    ``node(item, depth, totals)`` makes and keeps the row of a node that is complete; the item is its first. Returned are the paths at the two ends
    with the records of their nodes (nothing if the items are ``whole``), and the rows whose parent is such an open node,
    with the parent's side and depth.
    """
    m = len(items)
    root = list(range(m))
    low, high = list(range(m)), list(range(m))
    depth = [len(path) // TURN for path, _ in items]
    records = [r for _, r in items]
    kids: list[list[dict]] = [[] for _ in items]
    spine: tuple[dict[int, Record], dict[int, Record]] = ({}, {})
    waiting: list[tuple[dict, int, int]] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def lift(c: int, d: int) -> None:
        """Move component c up to depth d: the nodes deeper than that are over, or lie on an end's path."""
        if not whole and (low[c] == 0 or high[c] == m - 1):
            side = 0 if low[c] == 0 else 1
            waiting.extend((row, side, depth[c]) for row in kids[c])
            kids[c] = []
            for k in [k for k in records[c] if k > d]:
                spine[side][k] = records[c].pop(k)
        else:
            for k in range(depth[c], d, -1):
                n, least, children, leaves, saved = records[c].pop(k)
                leaves = leaves or 1
                saved += (n - 1) * last_size(items[c][0], k)
                row = node(low[c], k, (n, least, children, leaves, saved))
                for kid in kids[c]:
                    kid["parent_conv_id"] = least
                kids[c] = [row]
                fold(records[c], k - 1, n, least, 1, leaves, saved)
        depth[c] = d

    shared = [common_turns(items[k][0], items[k + 1][0]) for k in range(m - 1)]
    for k in sorted(range(m - 1), key=shared.__getitem__, reverse=True):
        a, b = find(k), find(k + 1)
        for c in (a, b):
            if depth[c] > shared[k]:
                lift(c, shared[k])
        if len(kids[a]) + len(records[a]) < len(kids[b]) + len(records[b]):
            a, b = b, a
        root[b] = a
        low[a], high[a] = min(low[a], low[b]), max(high[a], high[b])
        kids[a].extend(kids[b])
        for at, r in records[b].items():
            fold(records[a], at, *r)
        kids[b], records[b] = [], {}
    lift(find(0), -1)
    if whole:
        return [], []
    return [(items[e][0], spine[side]) for side, e in ((0, 0), (1, m - 1)) if side == 0 or spine[1]], waiting


class Rows:
    """Rows of FOREST that a task gathers for one batch of output."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, **values) -> dict:
        self.rows.append(values)
        return values

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array([r.get(f.name) for r in self.rows], f.type) for f in ARROW]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def node_digests(path: bytes, depths: list[int]) -> dict[int, bytes]:
    """SHA-256 of the path down to each of the depths: the identity of those nodes."""
    running, found, at = hashlib.sha256(), {}, 0
    for d in sorted(set(depths)):
        running.update(path[at * TURN : d * TURN])
        at = d
        found[d] = running.copy().digest()
    return found


def _forest(
    items: list[Item], ids: list[list[int]] | None, block: int, part: int | None, whole: bool
) -> tuple[pa.RecordBatch, list[Item]]:
    """Rows of one block: complete nodes, references and, for a part of the next level, contracted paths; and these paths.

    ``ids`` are the conversations that end at each item, if the items are conversations.
    """
    out = Rows()
    lengths = [len(path) // TURN for path, _ in items]
    deep: dict[int, list[tuple[int, dict]]] = {}

    def node(k: int, depth: int, totals: tuple) -> dict:
        n, least, children, leaves, saved = totals
        row = out.add(
            kind="node", conv_id=least, depth=depth, n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved, ends_sha256=NO_ENDS
        )
        if ids is None:
            deep.setdefault(k, []).append((depth, row))
        elif depth == lengths[k]:
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, ids[k])).encode()).hexdigest()
        return row

    paths = [path for path, _ in items]
    ends, waiting = contract(items, whole, node)
    for k, rows in deep.items():
        digests = node_digests(paths[k], [d for d, _ in rows])
        for d, row in rows:
            row["node"] = digests[d]
    at_ends = (paths[0], paths[-1])
    refs = [node_digests(at_ends[side], [d for _, s, d in waiting if s == side]) for side in (0, 1)]
    for row, side, d in waiting:
        row.update(block=block, side=side, up=d)
    for side in (0, 1):
        for d, digest in refs[side].items():
            out.add(kind="reference", block=block, side=side, up=d, node=digest)
    for k, path in enumerate(paths if ids is not None and not whole else []):
        if any(end.startswith(path) for end in at_ends):
            digest = hashlib.sha256(path).digest()
            for at in range(0, len(ids[k]), PIECE_IDS):
                piece = ids[k][at : at + PIECE_IDS]
                out.add(kind="ends", node=digest, first_id=piece[0], ids=",".join(map(str, piece)))
    for side, (path, records) in enumerate(ends if part is not None else []):
        out.add(kind="path", part=part, place=2 * block + side, path=path, records=[[d, *r] for d, r in sorted(records.items())])
    return out.batch(), ends


def _leaf_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of blocks of sorted conversations; conversations with the same turns are one item."""
    part = TaskContext.get().partitionId()
    block = part << 24
    items: list[Item] = []
    ids: list[list[int]] = []
    rows = size = 0
    for batch in batches:
        for conv_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                yield _forest(items, ids, block, part, False)[0]
                block, items, ids, rows, size = block + 1, [], [], 0, 0
            if items and items[-1][0] == path:
                fold(items[-1][1], len(path) // TURN, 1, conv_id, 0, 0, 0)
                ids[-1].append(conv_id)
            else:
                items.append((path, {len(path) // TURN: [1, conv_id, 0, 0, 0]}))
                ids.append([conv_id])
                size += len(path)
            rows += 1
    if items:
        yield _forest(items, ids, block, part, False)[0]


def _merged_forests(level: int, whole: bool, fan: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forests of groups of contracted paths in order; equal neighbours (one path over several blocks) are one item.

    Whenever ``fan`` paths are gathered they are contracted to two: a group may have any number of blocks.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[Item] = []
        group, block = None, 0
        for batch in batches:
            for part, path, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if items and part != group:
                    yield _forest(items, None, block, part, whole)[0]
                    items = []
                elif len(items) >= fan:
                    out, items = _forest(items, None, block, None, False)
                    yield out
                    block += 1
                if part != group:
                    group, block = part, (level << 56) + (part << 24)
                records = {r[0]: r[1:] for r in flat}
                if items and items[-1][0] == path:
                    for d, r in records.items():
                        fold(items[-1][1], d, *r)
                else:
                    items.append((path, records))
        if items:
            yield _forest(items, None, block, group, whole)[0]

    return merge


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined list, from its pieces in order; one piece is held at a time."""
    name, running = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node == name:
                running.update(b",")
            else:
                if name is not None:
                    done.append((name, running.hexdigest()))
                name, running = node, hashlib.sha256()
            running.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "sha"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["node", "sha"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of rebuilt conversations, the textless root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of last texts that
    sharing saves in the subtree), ends_sha256 (of the members that end there).
    """
    spark = conversations.sparkSession
    ship(spark)
    rows = rebuilt_conversations(conversations).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    levels = [stored(rows.mapInArrow(_leaf_forests, FOREST), "forest")]
    while True:
        paths = levels[-1].where("kind = 'path'").select(F.floor(F.col("part") / FAN).alias("part"), "path", "records", "place")
        last = paths.agg(F.max("part")).first()[0]
        if last is None:
            break
        spread = (paths.repartition("part") if last else paths.repartition(1)).sortWithinPartitions("part", "place")
        merged = spread.select("part", "path", "records").mapInArrow(_merged_forests(len(levels), not last, FAN), FOREST)
        levels.append(stored(merged, "forest"))

    def all_of(kind: str, among: list[DataFrame] = levels) -> DataFrame:
        found = among[0].where(F.col("kind") == kind)
        for level in among[1:]:
            found = found.unionByName(level.where(F.col("kind") == kind))
        return found

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = levels[0].where("kind = 'node'")
    outer = all_of("node", levels[1:] or levels).where("node is not null")
    pieces = levels[0].where("kind = 'ends'").select("node", "ids", "first_id")
    lists = pieces.repartition("node").sortWithinPartitions("node", "first_id").select("node", "ids")
    digests = lists.mapInArrow(_list_digests, "node binary, sha string")
    outer = outer.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("sha", "ends_sha256"))
    parents = all_of("reference").select("block", "side", "up", "node").join(
        outer.select("node", F.col("conv_id").alias("found")), "node"
    ).select("block", "side", "up", "found")
    nodes = inner.select(*columns, "block", "side", "up").unionByName(outer.select(*columns, "block", "side", "up"))
    known = nodes.where("block is null")
    open_ = nodes.where("block is not null").join(parents, ["block", "side", "up"]).withColumn("parent_conv_id", F.col("found"))
    return known.select(columns).unionByName(open_.select(columns))


#: DuckDB's form of the whole operator: nodes are grouped prefixes, subtrees sums over the prefixes of prefixes.
ORACLE_SQL = r"""
    WITH t AS (
        SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS fp,
               strlen(coalesce(text, '')) AS size
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    own AS (
        SELECT conv_id, list(fp || ':' || size ORDER BY turn NULLS FIRST, fp) AS turns,
               list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS digits
        FROM t GROUP BY conv_id
    ),
    h AS (
        SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295, digits), lambda s, b: list_reduce(
            [xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 9 AS h
        FROM own
    ),
    c AS (
        SELECT h.conv_id, list_concat(CASE WHEN s.conv_id IS NULL THEN [] ELSE list_slice(s.turns, 1, h.h) END,
                                      list_slice(h.turns, h.h + 1, len(h.turns))) AS path
        FROM h LEFT JOIN h s ON s.conv_id = h.conv_id - h.conv_id % 5
    ),
    p AS (
        SELECT conv_id, d, len(path) AS size, array_to_string(list_slice(path, 1, d), ' ') AS node, path
        FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM c)
    ),
    n AS (
        SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(list_slice(path, 1, d)) AS path,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
        FROM p GROUP BY node, d
    ),
    m AS (
        SELECT n.*, array_to_string(list_slice(n.path, 1, n.d - 1), ' ') AS up,
               CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * CAST(string_split(n.path[n.d], ':')[2] AS BIGINT) END AS saved,
               (SELECT count(*) FROM n k WHERE k.d = n.d + 1 AND array_to_string(list_slice(k.path, 1, n.d), ' ') = n.node) AS n_children
        FROM n
    ),
    b AS (
        SELECT node, d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved
        FROM (
            SELECT n_children, saved, k AS d, array_to_string(list_slice(path, 1, k), ' ') AS node
            FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM m)
        )
        GROUP BY node, d
    )
    SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children,
           CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM m JOIN b ON b.node = m.node AND b.d = m.d LEFT JOIN n u ON m.d > 0 AND u.d = m.d - 1 AND u.node = m.up
"""
