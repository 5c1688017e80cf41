import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from trackmill.llm import trie


def brute(rows):
    """The nodes out of a dictionary of all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(own[c])] for c in own}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        seqs[c] = tuple(base[:h] + own[c][h:])
    return nodes([(c, s) for c, s in seqs.items()])


def nodes(members):
    at = defaultdict(list)
    for c, s in members:
        for d in range(len(s) + 1):
            at[s[:d]].append(c)
    children = defaultdict(int)
    for p in at:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in at:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(at[p]) - 1) * (len(re.findall(trie.WORD, p[-1][1])) if p else 0)
    ends = defaultdict(list)
    for c, s in members:
        ends[s].append(c)
    return sorted(((min(at[p]), len(p), min(at[p[:-1]]) if p else None, len(at[p]), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p in at), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth int, b string")


def test_whole_operator(spark):
    pick, rows = random.Random(3), []
    for conv in [*range(0, 200, 3), *range(20, 40), -21, -5, 10**15 + 1, 10**15 + 20]:
        for turn in range(pick.choice([1, 1, 2, 3, 5])):
            rows.append((conv, turn or pick.choice([0, None]), pick.choice(["user", "assistant", None]), pick.choice(["a b", "c", "", None, "d\te f\n", "long " * 5000])))
    rows += [(None, 0, "user", "no id"), (7, 0, "user", "x"), (27, 0, "user", "y")]
    assert told(trie.trie(trie.rebuilt(conversations(spark, rows)))) == brute(rows)


def keyed(spark, members):
    h = lambda t: hashlib.md5(repr(t).encode()).digest()
    rows = [(c, b"".join(map(h, s)), [len(re.findall(trie.WORD, t[1])) for t in s]) for c, s in members]
    return spark.createDataFrame(rows, "conv_id long, k_key binary, k_words array<int>")


@pytest.mark.parametrize("blocks,chunk,waiting", [(1, 65536, 10000), (3, 2, 1), (16, 3, 0), (40, 65536, 2)])
def test_blocks(spark, blocks, chunk, waiting):
    """Shared beginnings, copies in the hundreds over many blocks, chains, chunks of ids, nodes told early."""
    pick = random.Random(blocks)
    turn = lambda: ("user", pick.choice(["a", "b b", "c c c"]))
    hot = tuple(turn() for _ in range(3))
    members = [(i, hot) for i in range(300)] + [(1000 + i, hot[: pick.randrange(4)] + tuple(turn() for _ in range(pick.randrange(6)))) for i in range(300)]
    members += [(5000, tuple(turn() for _ in range(200))), (5001, hot + tuple(turn() for _ in range(100))), (6000, ()), (6001, ())]
    pick.shuffle(members)
    assert told(trie.trie(keyed(spark, members), blocks, chunk, waiting)) == nodes(members)


def test_edges(spark):
    assert told(trie.trie(trie.rebuilt(conversations(spark, [])))) == []
    assert told(trie.trie(keyed(spark, [(4, ()), (3, ())]), 3)) == nodes([(4, ()), (3, ())])
    assert told(trie.trie(keyed(spark, [(9, (("u", "x y"),))]), 2)) == nodes([(9, (("u", "x y"),))])


def test_common():
    a = bytes(range(160))
    for n in range(11):
        b = a[: n * 16] + bytes([255] * 16) * (10 - n)
        assert trie.common(a, b) == n and trie.common(a, a[: n * 16]) == n
