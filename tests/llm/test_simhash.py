import random

import numpy as np
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.graph import components


def plain_fingerprint(text):
    words = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Smallest id reachable, by comparing all pairs."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {(i, f"{p:016x}", label[i]) for i, p in prints}


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gäm", "de lta", "x" * 30, "q", "ZZ", "K"]
    texts = [None, "", " \t\n", "one", "One two", "ONE two", "a b c", "a b  c\n"]
    while len(texts) < n:
        if rng.random() < 0.5:
            base = rng.choice(texts) or "start"
            texts.append(base + " " + rng.choice(words) if rng.random() < 0.6 else base)
        else:
            texts.append(" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 300))))
    return list(enumerate(texts))


def test_fingerprint_of_long_and_odd_texts(monkeypatch):
    for _, text in some_texts(1, 40):
        assert simhash.fingerprint(text and text.encode()) == plain_fingerprint(text)
    long = " ".join(str(i % 977) for i in range(5000))
    expected = plain_fingerprint(long)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 128)
    assert simhash.fingerprint(long.encode()) == expected


def test_groups_equal_brute_force(spark):
    rows = some_texts(2, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component_id")
    got = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got} == plain_groups(rows)


def test_pairs_within_three_bits_share_a_key_and_all_links_are_found():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in prints]
    other = prints ^ np.array(flips, np.uint64)
    assert (simhash.join_keys(prints) == simhash.join_keys(other)).any(axis=1).all()


def test_a_crowded_key_is_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    base = np.uint64(0x0123456789ABCDEF)
    values = {int(base ^ np.uint64(int(v))) for v in rng.integers(0, 1 << 18, 400)}
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in components(found, "a", "b").collect()}
    left = {v for v in values}
    expected = {}
    while left:
        group, frontier = set(), [left.pop()]
        while frontier:
            v = frontier.pop()
            group.add(v)
            near = {w for w in left if (v ^ w).bit_count() <= 3}
            left -= near
            frontier += near
        least = min(int(np.uint64(v).view(np.int64)) for v in group)
        expected |= {int(np.uint64(v).view(np.int64)): least for v in group if int(np.uint64(v).view(np.int64)) > least}
    assert roots == expected


def test_large_groups_in_one_task_equal_brute_force():
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 14, 300, dtype=np.uint64))
    a, b = simhash.linked_stars(np.zeros(len(prints), np.int64), prints)
    joined = {int(x) for x in a} | {int(x) for x in b}
    alone = {int(p) for p in prints if (np.bitwise_count(prints ^ p) <= 3).sum() == 1}
    assert joined == {int(p) for p in prints} - alone


def test_keep_one_of_each_group_whatever_the_ids(spark):
    rows = [
        (3, "a b c d", 1), (1, "a b c d", 1), (1, "a b c d", 1), (1, "quite another text under the same number", 1),
        (None, "a b c d", 1), (None, "only copies without number here", 1), (None, "only copies without number here", 2),
        (7, "other words stand here now", 1), (8, None, 1), (9, "", 1), (None, None, 1),
    ]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [
        (-1, "only copies without number here"), (1, "a b c d"), (1, "quite another text under the same number"),
        (7, "other words stand here now"), (8, ""),
    ]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}
