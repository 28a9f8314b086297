import random
import re
from collections import Counter

import pytest
import xxhash

from accordant.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(values, radius=3):
    left, out = set(values), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        for x in group:
            out[x] = min(group)
    return out


def test_fingerprints():
    for text in (None, "", " \t\n", "A", "One two", "a B c", "x y z w " * 50, "Émile é x　y z \x1c q", "the \x00 cat"):
        assert simhash.fingerprint(simhash.shingle_hashes(text)) == plain_fingerprint(text)


def test_tree_finds_just_what_is_near():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(10)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert sorted(tree.values) == sorted(set(values))
    for v in values:
        assert {tree.values[n] for n in tree.within(v, 3)} == {x for x in values if (x ^ v).bit_count() <= 3}


@pytest.mark.parametrize("shard_rows", [2, 8, 256])
def test_components_equal_brute_force(spark, shard_rows):
    rng = random.Random(shard_rows)
    values = {0, 1, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            values.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b  # a chain: far ends are linked only through others
    hub = rng.getrandbits(64)
    values |= {hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = simhash.components(simhash.fingerprint_edges(fps, 3, shard_rows)).collect()
    own = Counter(r.node for r in found)
    assert max(own.values()) == 1
    got = {}
    for r in found:
        got.setdefault(r.component, set()).add(r.node & ((1 << 64) - 1))
    want = {}
    for x, head in plain_components(values).items():
        want.setdefault(head, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_query_on_hard_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text.upper()), (9, text + " "), (2, None), (7, ""), (8, " "), (1, "other words entirely here"), (None, text), (9, text + " "), (6, "x " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, fp string, component int")
    got = sorted(((r.doc_id, r.fp & ((1 << 64) - 1), r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    classes = plain_components(prints)
    least = {}
    for (k, _), p in zip(rows, prints, strict=True):
        if k is not None:
            least[classes[p]] = min(k, least.get(classes[p], k))
    assert got == sorted(((k, p, least[classes[p]]) for (k, _), p in zip(rows, prints, strict=True)), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
