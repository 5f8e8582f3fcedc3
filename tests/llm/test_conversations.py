import math
import random
import zlib

import pytest

from brute_force import WORDS, sha
from seriesmill.llm import conversations, queries

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    """Rows of the query for (conv_id, turn, role, text) rows without ties of different content."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        below = [total[x] for x in children.get(node, [])]
        saved = (len(members[node]) - 1) * (len(WORDS.findall(node[-1][1])) if node else 0)
        total[node] = (sum(x[0] for x in below) if below else 1, saved + sum(x[1] for x in below))
    out = []
    for node, own_members in members.items():
        ends = sorted(c for c in own_members if len(paths[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(own_members), len(node), up, len(own_members), len(children.get(node, [])), *total[node], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, depth string, a int, pos int"
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).repartition(3)


def test_table_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    result = got(queries.op13_trie(spark, sf))
    assert result == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = con.execute(queries.ORACLES["op13_trie"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in found), key=repr) == result


def shared_turns(seed, convs, length):
    """Conversations that share openings and whole copies, one of them very long."""
    rng = random.Random(seed)
    made = []
    for c in range(-5, convs):
        n = rng.randrange(1, length)
        made += [(c, t, rng.choice("ab"), rng.choice(["x", "y z", "one two three"]) if t < 5 else f"{t} {rng.random() < 0.1}") for t in range(n)]
    made += [(convs, t, "long", f"turn {t}") for t in range(600)]
    return made + [(convs + 20, t, "long", f"turn {t} {t == 590}") for t in range(700)]


@pytest.mark.parametrize(("least_light", "band"), [(1 << 20, 256), (30, 4), (3, 1), (60, 100)])
def test_shards_of_any_size(spark, least_light, band, monkeypatch):
    monkeypatch.setattr(conversations, "isqrt", lambda n: 1)
    rows = shared_turns(least_light, 120, 12)
    assert got(conversations.conversation_trie(frame(spark, rows), least_light, band)) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "a b"), (1, None, "user", None), (1, 2, None, "c"), (2, 0, "user", ""), (2, 1, "", ""), (20, 0, "x", "w\x0bw  w"), (20, 5, "x", "q"), (21, 7, None, None),
        (None, 0, "user", "lost"), (None, None, None, None), (40, 0, "r", "same"), (41, 0, "r", "same"), (41, 0, "r", "same"), (42, 0, "r", "same"), (43, 3, "r", "é" * 9), (-7, 0, "a", "neg"),
        (60, 0, "u", "very " * 50_000), (61, 0, "u", "very " * 50_000), (63, 0, "", "0"), (64, 0, "", "1"), (67, 0, "", "2"),
    ]
    assert got(conversations.conversation_trie(frame(spark, rows))) == expected(rows)


def test_many_copies_have_one_digest(spark, monkeypatch):
    rows = [(i, t, "u", f"t {t}") for i in range(0, 3000, 20) for t in range(3)] + [(i, 0, "u", "other") for i in range(5000, 5400)]
    assert got(conversations.conversation_trie(frame(spark, rows))) == expected(rows)


def test_no_conversations(spark):
    assert got(conversations.conversation_trie(frame(spark, []))) == []
    assert got(conversations.conversation_trie(frame(spark, [(None, 1, "a", "b")]))) == []


@pytest.mark.parametrize("rows", [4, 7, 1000])
def test_queue_that_spills(rows, monkeypatch):
    monkeypatch.setattr(conversations, "MOST_RUNS", 3)
    monkeypatch.setattr(conversations, "RUN_BLOCK", 2)
    rng = random.Random(rows)
    queue, plain = conversations.SpillingQueue(rows), []
    for _ in range(3000):
        if plain and rng.random() < 0.4:
            key = min(plain)[:3]
            assert sorted(queue.take(key)) == sorted(r for r in plain if r[:3] == key)
            plain = [r for r in plain if r[:3] != key]
        else:
            row = (rng.randrange(-9, 9), rng.randrange(3), rng.randrange(2), 1, rng.randrange(9), rng.randrange(2**60))
            queue.push(row)
            plain.append(row)
    assert bool(len(queue)) == bool(plain)
