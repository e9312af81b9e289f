"""The prefix trie against a brute-force trie, for units of every size, and on edge rows."""

import hashlib
import zlib

import numpy as np
import pytest

SCHEMA = "conv_id long, turn long, role string, text string, a string, seq long, ra long, pos long"


def brute(rows):
    """The trie by walking every prefix of every rebuilt conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)

    def under(k):
        yield k
        for child in children.get(k, []):
            yield from under(child)

    out = []
    for k, members in nodes.items():
        inside = list(under(k))
        ends = ",".join(str(c) for c in sorted(members) if built[c] == k)
        out.append(
            (min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), sum(x not in children for x in inside),
             sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in inside if x), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def trie(spark, rows, unit):
    from strandlab.llm.prefix_trie import prefix_trie

    found = prefix_trie(frame(spark, rows), unit)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


EDGES = [
    (0, 2, "user", "a"), (0, None, None, None), (0, 1, "user", "ümlaut \U0001f642"), (0, 1, "user", "ümlaut \U0001f642"), (0, 1, "system", "b"), (0, 9, "u", "z" * 3000), (0, 10, "u", "end"),
    (3, 1, "", ""), (5, 1, "user", "x"), (7, None, "1", "0:"), (7, 1, "10", ":"), (150, 1, "user", "far"), (150, 2, "user", "off"), (199, 5, "u", "v"), (None, 1, "user", "lost"),
    (-5, 1, "user", "below"), (-5, 2, "user", "zero"), (200, 1, "user", "far"), (200, 2, "user", "off"),
]


@pytest.mark.parametrize("unit", [1, 4, 1024])
def test_prefix_trie_edges(spark, unit):
    assert trie(spark, EDGES, unit) == brute(EDGES)


@pytest.mark.parametrize("unit", [2, 1024])
def test_prefix_trie_equals_brute_force(spark, unit):
    """Copies of few stems, so that all heights branch; one conversation holds a third of all rows."""
    random = np.random.default_rng(unit)
    rows = []
    stems = [[("user" if i % 2 else "bot", f"s{s}t{i}" * int(random.integers(1, 4))) for i in range(13)] for s in range(3)]
    for c in [*range(40), 100, 101, 230, 231, 250]:
        stem = list(stems[int(random.integers(0, 3))][: int(random.integers(0, 14))])
        stem += [("user", str(random.integers(0, 2))) for _ in range(int(random.integers(0, 3)))]
        rows += [(c, t, *x) for t, x in enumerate(stem or [("user", "alone")])]
    rows += [(17, 100 + t, "user", str(t % 3)) for t in range(len(rows) // 2)]
    assert trie(spark, rows, unit) == brute(rows)


def test_prefix_trie_without_turns(spark):
    assert trie(spark, [], 4) == [] and trie(spark, [(None, 1, "user", "x")], 4) == []
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)  # its family has no head, and its one turn is cut off
    assert trie(spark, [(alone, 1, "user", "x")], 4) == brute([(alone, 1, "user", "x")])


def test_ends_of_many_ids(spark, monkeypatch):
    """Ids that end at one node are hashed run by run, in numeric order."""
    from strandlab.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "RUN_BITS", 3)
    ids = [*range(-20, 90, 3), 1000, 10**12]
    got = prefix_trie.digests(spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 7)], "a long, b long, conv_id long")).collect()
    assert {(r["a"], r["b"]): r["ends_sha256"] for r in got} == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}
