import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tests.llm.conftest import folder, words
from tsumugi.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, row string, id string, depth int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(rows):
    """conv_id -> turns, as the query's contract says."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, tie, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def plain_trie(convs):
    """Every node by its own sequence of turns; sums by going down from each."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def sums(node):
        below = [sums(x) for x in children[node]]
        own = (len(members[node]) - 1) * len(words(node[-1][1])) if node else 0
        return max(1, sum(x[0] for x in below)), own + sum(x[1] for x in below)

    out = []
    for node, of in members.items():
        listed = ",".join(map(str, sorted(ends[node])))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), *sums(node), hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def odd_conversations(seed, convs=160):
    """Few different turns, so that prefixes are shared; copies, prefixes of others, odd values, one long conversation."""
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "", None, "c", "x\ty  z", " "])) for _ in range(5)]
    rows = []
    for c in range(convs):
        if c % 20 == 0 and rng.random() < 0.3:
            continue
        rows += [(c, t, *rng.choice(turns)) for t in range(rng.randrange(6))]
    rows += [(convs + c, t, "user", "same turn here") for c in range(60) for t in range(3)]
    rows += [(9_000, t, "user", f"turn {t}") for t in range(350)] + [(9_001, t, "user", f"turn {t}") for t in range(300)]
    rows += [(77, None, "user", "no turn"), (None, 1, "user", "no conversation"), (78, 1, None, None), (-7, 0, "user", "below zero"), (-7, 0, "user", "below zero")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 3), (3, 16), (4, 7)])
def test_trie_equals_the_plain_version(spark, seed, parts):
    rows = odd_conversations(seed)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA).repartition(5)
        got = found(trie.prefix_trie(trie.with_shared_heads(trie.sequences(df))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    expected = plain_trie(plain_rebuilt(rows))
    assert got == expected
    assert any(r[4] > 3 for r in got) and any(r[3] >= 60 for r in got)


def test_turnless_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.sequences(none)).count() == 0
    # crc32("3") % 4 turns of the absent conversation 0, and then nothing of its own
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(c, 0, "user", "gone"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)
    got = found(trie.prefix_trie(trie.with_shared_heads(trie.sequences(df))))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_roles_and_texts_are_told_apart(spark):
    df = spark.createDataFrame([(1, 0, "ab", "c", "x", "y", 3), (2, 0, "a", "bc", "x", "y", 3)], SCHEMA)
    assert [r[3] for r in found(trie.prefix_trie(trie.sequences(df)))] == [2, 1, 1]


def test_ids_of_a_common_key_are_hashed_in_pieces(spark):
    ids = [(b"k" if c % 3 else b"other", c) for c in range(4_000)]
    rows = {bytes(r["id"]): r for r in trie.end_lists(spark.createDataFrame(ids, "id binary, conv_id long").repartition(7)).collect()}
    for key in (b"k", b"other"):
        own = [c for k, c in ids if k == key]
        assert (rows[key]["n"], rows[key]["conv_id"], bytes(rows[key]["ends"])) == (len(own), min(own), hashlib.sha256(",".join(map(str, own)).encode()).digest())


def test_query_over_a_table(spark, tmp_path):
    rows = odd_conversations(9, convs=60)
    sf = folder(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found(queries.op11_prefix_trie(spark, sf)) == plain_trie(plain_rebuilt(rows))
