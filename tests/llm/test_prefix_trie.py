import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillspan.llm import prefix_trie as p

COLUMNS = "conv_id long, turn long, role string, text string, depth long, name string"


def plain(rows):
    """All nodes by a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    digest = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    return sorted((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node], digest(ends[node])) for node, m in members.items())


def nodes(spark, rows, **how):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], COLUMNS).repartition(5)
    return sorted((tuple(r) for r in p.trie(table, **how).collect()), key=lambda r: (r[0], r[1]))


def made(seed, convs, turns, alphabet):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.choice([r.randrange(-250, 900), 100 * r.randrange(9)])
        if not any(x[0] == c for x in rows):
            rows += [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(alphabet)) for t in range(r.randrange(1, turns))]
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("range_bytes", [p.RANGE_BYTES, 700])
def test_nodes_equal_a_dictionary_of_prefixes(spark, monkeypatch, seed, range_bytes):
    monkeypatch.setattr(p, "PIECE", 3)
    rows = made(seed, 120, 9, ["a", "bb", "", None, "ééé", "\U0001f600"][: 3 + seed])
    assert nodes(spark, rows, range_bytes=range_bytes) == plain(rows)


def test_many_copies_and_long_conversations(spark):
    rows = [(c, t, "user", "same") for c in range(40) for t in range(6)]
    rows += [(200, t, "user", f"{t % 3}") for t in range(1500)] + [(300, t, "user", f"{t % 3}") for t in range(1501)]
    for size in (p.RANGE_BYTES, 2000):
        assert nodes(spark, rows, range_bytes=size) == plain(rows)


def test_edge_cases(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 5, "a", "b"), (1, 5, "a", "b"), (-5, 1, "user", "y"), (101, 0, "user", "z"), (103, 0, "u", "only")]
    rows += [(0, 2, "user", "tie b"), (0, 2, "user", "tie a")]
    assert nodes(spark, rows) == plain(rows)
    assert any(zlib.crc32(str(c).encode()) % 6 >= 1 and c >= 100 for c, *_ in rows if c)  # a conversation without turns
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "a", "b")]) == []


def test_ranges_agree_on_shared_nodes():
    sequences = sorted({bytes([random.Random(i * 31 + j).randrange(2)]) * p.TURN + bytes([i % 5]) * p.TURN for i in range(30) for j in range(2)})
    assert p.common(sequences[0], sequences[0]) == 2
    assert p.common(b"", sequences[0]) == 0
    for a in sequences:
        for b in sequences:
            turns = [(a[k : k + p.TURN], b[k : k + p.TURN]) for k in range(0, 2 * p.TURN, p.TURN)]
            assert p.common(a, b) == (0 if turns[0][0] != turns[0][1] else 1 if turns[1][0] != turns[1][1] else 2)


def test_the_query_equals_the_dictionary(spark):
    from quillspan.llm.queries import op11_prefix_trie, table

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = op11_prefix_trie(spark, folder)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[1])) == plain(rows)
