import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            if not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                for w in set(terms(text)) if c[w]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return out


def zipf_texts(seed, n, longest=300):
    rng = random.Random(seed)
    words = [f"W{j}" for j in range(150)] + ["Ä", "é9", "漢字", "o'neil", "a_b"]
    weights = [1 / (j + 1) for j in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.choice([0, 2, 20, longest]))) for _ in range(n)]


def test_terms_of_bytes():
    for text in ["", "A-b_C9 é'ü x\x85y", "\x1f\x7fZz", "漢字 漢", "a b"]:
        assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    parts = []
    for size in (1, 2, 127, 128):
        for most in (1, 3, 300, 70_000):
            parts.append((np.sort(rng.choice(most * 200, size, replace=False)), rng.integers(1, most + 1, size)))
    sizes = np.array([len(d) for d, _ in parts])
    ends = np.cumsum(sizes)
    documents, frequencies = (np.concatenate(x) for x in zip(*parts))
    codes, places, data = lexical.packed_blocks(ends - sizes, ends, documents, frequencies)
    for (docs, frequency), place, code in zip(parts, places, codes):
        got = lexical.open_block(data, int(place), int(code), int(docs[0]), len(docs))
        assert np.array_equal(got[0], docs) and np.array_equal(got[1], frequency)


def test_damping_beyond_64_bits():
    lengths = np.array([1, 10**6, 2 * 10**9])
    assert lexical.damped(lengths, 10**11, 10**14).tolist() == [10 + 90 * int(n) * 10**11 // 10**14 for n in lengths]


def shards(docs, size):
    made = []
    for start in range(0, len(docs), size):
        numbers = lexical.Numbers()
        part = docs[start : start + size]
        pieces = [np.fromiter(map(numbers.__getitem__, lexical.terms_of((t or "").encode())), np.uint32) for _, t in part]
        made.append(lexical.shard_row([i for i, _ in part], pieces, numbers))
    return made


def test_unpromising_blocks_stay_closed():
    """Frequent terms beside one rare term: once ten documents have the rare one, blocks of the others are rejected."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["the", "of", "and"], k=50)) + (" rare" * 5 if i % 700 == 3 else "")) for i in range(40_000)]
    (batch,) = shards(docs, len(docs))
    n_docs, n_terms = batch.column("n_docs")[0].as_py(), batch.column("n_terms")[0].as_py()
    shard = lexical.Shard.of(batch, 0, n_docs, n_terms)
    at = {w: i for i, w in enumerate(shard.words.to_pylist())}
    lists = []
    for word in (b"rare", b"the", b"of"):
        w = max(1, lexical.weight(n_docs, int(shard.counts[at[word]])))
        lists.append((at[word], w, w * int(shard.maxima[shard.starts[at[word]] : shard.ends[at[word]]].max())))
    heap, total = lexical.Heap(10), np.zeros(len(docs), np.int64)
    lexical.search_shard(shard, lists, heap, total)
    everything = sum(int(shard.ends[t] - shard.starts[t]) for t, *_ in lists)
    assert shard.opened < everything / 3 and not total.any()
    assert all("rare" in docs[i][1] for i in heap.ids)


@pytest.mark.parametrize("seed,shard_bytes,query_bytes", [(1, 1 << 24, 1 << 22), (2, 3000, 1 << 22), (3, 20_000, 200)])
def test_equals_scoring_everything(spark, seed, shard_bytes, query_bytes):
    docs = list(enumerate(zipf_texts(seed, 900)))
    docs += [(None, "W1 W2 W3"), (None, None), (5, docs[5][1]), (7, docs[7][1] + " W9"), (901, "W4 " * 50_000)]
    items = list(enumerate(zipf_texts(seed + 10, 25, 40))) + [(3, "W3 W4 W5"), (99, None), (98, "nowhere"), (97, "")]
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    index = lexical.build_index(frame, shard_bytes=shard_bytes)
    got = [tuple(r) for r in lexical.search(index, asked, query_bytes=query_bytes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, items)))


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(100 + i, "other") for i in range(60)]
    asked = spark.createDataFrame([(1, "same"), (1, "same")], "item_id long, text string")
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), asked).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(k, k) for k in range(1, 11)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).collect() == []
    assert lexical.ranked(docs, items.limit(0)).collect() == []
    assert [r.doc_id for r in lexical.ranked(docs, items).collect()] == [1]
