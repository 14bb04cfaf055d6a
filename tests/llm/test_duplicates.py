import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heatline.llm import repeats, simhash
from heatline.llm.components import components


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    ones = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def plain_roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_golay_keys_meet_for_up_to_two_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400)
    for word in words[:60].tolist():
        row, index = simhash.nearby_indices(np.array([word]))
        assert len(index) in (1, 6)
        for a in range(23):
            for b in range(a + 1):
                other = word ^ (1 << a) ^ ((1 << b) if b < a else 0)
                assert set(index.tolist()) & set(simhash.nearby_indices(np.array([other]))[1].tolist())


def near_prints(rng, n):
    """Random fingerprints, and chains and clouds of others few bits off."""
    prints = set(rng.integers(0, 1 << 63, n // 4).tolist())
    while len(prints) < n:
        base = random.Random(len(prints)).choice(sorted(prints))
        for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
            base ^= 1 << bit
        prints.add(base)
    return sorted(x - (1 << 64) if x >> 63 else x for x in prints)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, bits, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = near_prints(np.random.default_rng(bits), 250)
    unsigned = np.array(prints, np.int64).view(np.uint64)
    near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= bits
    want = plain_roots(len(prints), zip(*np.nonzero(near)))
    table = spark.createDataFrame([(x,) for x in prints], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(table, bits)).collect()}
    found = [roots.get(x, x) for x in prints]
    assert Counter(Counter(found).values()) == Counter(Counter(want).values())
    assert len(set(zip(found, want))) == len(set(want))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 8])
def test_one_key_s_fingerprints(monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = np.array(near_prints(np.random.default_rng(9), 120), np.int64)
    unsigned = prints.view(np.uint64)
    near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 2
    assert simhash._least_linked(prints, 2).tolist() == plain_roots(len(prints), zip(*np.nonzero(near)))


def test_components(spark):
    pick = random.Random(3)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)]
    links += [(k, k + 1) for k in range(2000, 2040)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = plain_roots(2100, [x for x in links if x[0] is not None])
    touched = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert found == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_odd_rows(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs, 3, 2).collect()
    docs = edge_docs.collect()
    prints = [plain_fingerprint(d.text, 3) for d in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = plain_roots(len(docs), near)
    least = {}
    for d, root in zip(docs, roots):
        if d.doc_id is not None:
            least[root] = min(d.doc_id, least.get(root, d.doc_id))
    want = Counter((d.doc_id, f"{p:016x}", least.get(r)) for d, p, r in zip(docs, prints, roots))
    assert Counter(tuple(r) for r in rows) == want
    assert simhash.near_duplicates(no_docs, 3, 2).count() == 0


def test_one_row_of_each_group_stays(edge_docs, no_docs):
    kept = simhash.representatives(edge_docs, 3, 2)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    docs = edge_docs.collect()
    prints = [plain_fingerprint(d.text, 3) for d in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert len(rows) == len(set(plain_roots(len(docs), near)))
    assert {r.doc_id for r in rows} >= {9, 10}
    assert simhash.representatives(no_docs, 3, 2).count() == 0


def plain_removals(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("length", [1, 2, 5, 16])
def test_matches_in_phrases(length):
    rng = np.random.default_rng(length)
    for _ in range(300):
        parts = [
            bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint8))
            for _ in range(rng.integers(1, 7))
        ]
        seen = Counter(p[k : k + length] for p in parts for k in range(len(p) - length + 1))
        want = [k + length <= len(p) and seen[p[k : k + length]] > 1 for p in parts for k in range(len(p))]
        data = np.frombuffer(b"".join(parts), np.uint8)
        got = repeats.repeated_windows(data, np.cumsum([len(p) for p in parts]), length)
        assert got.tolist() == want


def repetitive(seed, n):
    pick = random.Random(seed)
    passages = ["".join(pick.choices("abé ", k=pick.randint(10, 400))) for _ in range(12)]
    texts = ["".join(pick.choices(passages, k=pick.randint(0, 4))) + "".join(pick.choices("xyz", k=pick.randint(0, 90)))
             for _ in range(n)]
    return texts + texts[:5] + ["q" * 900, "q" * 150, ""]


@pytest.mark.parametrize("crowded", [repeats.CROWDED, 1])
@pytest.mark.parametrize("length", [20, 200])
def test_removed_bytes(spark, monkeypatch, length, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "SAMPLE", 1 if crowded == 1 else repeats.SAMPLE)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 2000)
    texts = repetitive(length, 60)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(repeats.removals(table, length).collect())
    assert [tuple(r)[1:] for r in rows] == [x[:4] for x in plain_removals(texts, length)]


def test_removed_bytes_of_odd_rows(edge_docs, no_docs):
    docs = edge_docs.collect()
    want = plain_removals([d.text for d in docs], 200)
    rows = repeats.removals(edge_docs, 200).collect()
    assert Counter(tuple(r) for r in rows) == Counter((d.doc_id, *x[:4]) for d, x in zip(docs, want))
    assert repeats.removals(no_docs, 200).count() == 0
    kept = repeats.without_repeats(edge_docs, 200)
    assert kept.columns == edge_docs.columns
    texts = Counter((r.doc_id, r.text, r.ha) for r in kept.collect())
    assert texts == Counter(
        (d.doc_id, None if d.text is None else x[4].decode("utf-8", "ignore"), d.ha) for d, x in zip(docs, want)
    )
    assert repeats.without_repeats(no_docs, 200).count() == 0
