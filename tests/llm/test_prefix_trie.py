"""op11 prefix trie against brute force, in one block and over many."""

import hashlib
import math
import random
import zlib

import pytest
from corpus import sha

from leadsmith.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, node string, depth int, kind string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    below = {p: [0, 0, 0] for p in nodes}
    for p in sorted(nodes, key=len, reverse=True):
        b = below[p]
        b[1] = b[1] or 1
        b[2] += (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        if p:
            up = below[p[:-1]]
            up[0] += 1
            up[1] += b[1]
            up[2] += b[2]
    found = set()
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        found.add((min(members), len(p), parent, len(members), *below[p], sha(ends)))
    assert len(found) == len(nodes)
    return found


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "p", "n", 7, "k") for r in rows], SCHEMA).repartition(parts)
    found = [tuple(r) for r in P.prefix_trie(df).collect()]
    want = brute(rows)
    assert len(found) == len(want)
    assert set(found) == want


def talk(n, seed, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [("user", "hello"), ("assistant", "höi")] if rng.random() < hot else []
        turns += [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "né", ""])) for _ in range(rng.choice([0, 0, 1, 2, 3, 7, 12]))]
        if rng.random() < 0.02:
            turns += [("user", rng.choice("ab")) for _ in range(150)]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    return rows


AWKWARD = (
    [(None, 0, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 1, "user", None), (7, 1, None, "user")]
    + [(k, t, "user", f"turn {t}") for k in (10, 11, 12, 13, 14, 20, -3, -5) for t in range(12)]
    + [(15, 3, "user", "x"), (15, 3, "user", "x"), (15, 3, "assistant", "y"), (15, 2, "user", "long " * 200_000)]
    + [(31, 0, "user", "a"), (36, 0, "user", "a"), (2**40, 0, "us", "er"), (2**40 + 5, 0, "u", "ser")]
)


@pytest.mark.parametrize("rows", [AWKWARD, talk(300, 1), [(5, 0, "u", "a")], [(1, 0, "u", "a"), (6, 0, "u", "a")]])
def test_nodes_match_brute_force(spark, rows):
    check(spark, rows)


def test_blocks_merge_across_boundaries(spark, monkeypatch):
    """Many small blocks hold pieces of one hot prefix and of one hot conversation, and merge in two levels."""
    monkeypatch.setattr(P, "FAN", 16)
    same = [(5 * k + 4, t, "user", "same") for k in range(400) for t in range(3)]
    rows = same + [(c + 5000, t, r, x) for c, t, r, x in talk(400, 3, 0.7)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        check(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_contracted_blocks_of_any_size():
    """Contracting and merging blocks of up to seven paths, over several levels, gives the nodes of one pass."""
    rng = random.Random(5)
    for _ in range(60):
        paths = sorted({b"".join(bytes([rng.randrange(3)]) * P.TURN for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 40))})
        items = [(p, {len(p) // P.TURN: [1, k, 0, 0, 0]}) for k, p in enumerate(paths)]

        def nodes(items, step):
            found, kept = [], []

            def node(k, depth, totals):
                row = {"parent_conv_id": None}
                found.append((depth, totals, row))
                return row

            level = [(p, {d: list(r) for d, r in rec.items()}) for p, rec in items]
            while len(level) > step:
                kept = []
                for at in range(0, len(level), step):
                    kept += P.contract(level[at : at + step], False, node)[0]
                level = kept
            P.contract(level, True, node)
            return sorted((d, t) for d, t, _ in found)

        want = nodes(items, 1000)
        assert all(nodes(items, step) == want for step in (3, 4, 7))


def test_empty_table(spark):
    found = P.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0
    assert [f.name for f in found.schema][:2] == ["conv_id", "depth"]
