import random
import re
from collections import Counter

import pytest

from heatline.llm import decontaminate, nearest

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def plain_hits(docs, items, size):
    out = []
    for doc_id, text in docs:
        ws, hit, names = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            m = min(size, len(iw))
            if not m:
                continue
            windows = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)}
            for k in range(len(ws) - m + 1):
                if tuple(ws[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    if item_id is not None:
                        names.add(str(item_id))
        out.append((doc_id, len(ws), len(hit), tuple(sorted(names))))
    return Counter(out)


@pytest.mark.parametrize("size", [1, 3, 10])
def test_passages(spark, size):
    pick = random.Random(size)
    vocabulary = ["the", "of", "É", "é", "x1", "naïve", "a", "b", "c", "d"]
    items = [(k % 7 if k else None, " ".join(pick.choices(vocabulary, k=pick.randint(0, 20)))) for k in range(14)]
    items += [(20, None), (21, "..."), (22, "Single"), (23, "the the the the"), items[3]]
    docs = [(k, " - ".join(pick.choices(vocabulary, k=pick.randint(0, 30)))) for k in range(30)]
    docs += [(50 + k, f"before {text} After") for k, (_, text) in enumerate(items)]
    docs += [(None, "single"), (None, None), (7, ""), docs[4], docs[4], (4, "another THE the. the the")]
    rows = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        size,
    ).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows) == plain_hits(docs, items, size)


def test_clean_rows_stay(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog sat on the rug"), (2, None)], "item_id long, text string")
    kept = decontaminate.clean(edge_docs, items, 10)
    assert kept.columns == edge_docs.columns
    assert kept.count() == edge_docs.count() - 4
    assert decontaminate.clean(no_docs, items, 10).count() == 0
    assert decontaminate.clean(edge_docs, items.limit(0), 10).count() == edge_docs.count()


def test_near_words(spark):
    docs = spark.createDataFrame(
        [(1, "a x x b x c"), (2, "c b a"), (3, "a x x x x x x b c"), (4, "a b"), (5, None)], "doc_id long, text string"
    )
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    terms = decontaminate.item_words(items)
    index = decontaminate.postings(docs, terms)
    keys = {(r.d, r.h): r.doc_id for r in decontaminate._keyed(docs, "doc_id", "text").collect()}
    found = {keys[r.d, r.h]: (r["first"], r["last"]) for r in decontaminate.near(index, terms, 3).collect()}
    assert found[2] == (0, 2) and 3 not in found and 4 not in found
    wide = {keys[r.d, r.h] for r in decontaminate.near(index, terms, 9).collect()}
    assert wide == {1, 2, 3}


def plain_nearest(codes, queries, k):
    out = set()
    for q, code in set(queries):
        ranked = sorted(((code ^ c) & (1 << 64) - 1).bit_count() * 10**9 + i for i, c in set(codes) if i != q)
        out |= {(q, x % 10**9, x // 10**9, r + 1) for r, x in enumerate(ranked[:k])}
    return out


@pytest.mark.parametrize("segments", [None, 4, 8])
def test_top_k_is_exact(spark, segments):
    pick = random.Random(segments)
    centres = [pick.getrandbits(64) for _ in range(6)]
    codes = [(k, pick.choice(centres) ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64))) for k in range(150)]
    codes += [(1000 + k, centres[0]) for k in range(60)] + [(2000 + k, pick.getrandbits(64)) for k in range(20)]
    codes = [(k, c - (1 << 64) if c >> 63 else c) for k, c in codes] + [(5, 77)]
    queries = [codes[k] for k in (0, 10, 150, 151, 215)] + [(9999, -1)]
    table = spark.createDataFrame(codes, "id long, code long")
    asked = spark.createDataFrame(queries, "q long, code long")
    rows = nearest.top_k(table, asked, 5, segments).collect()
    assert {tuple(r) for r in rows} == plain_nearest(codes, queries, 5) and len(rows) == 30


def test_small_and_odd_vectors(spark):
    rows = [(1, [1.0, -1.0]), (2, [float("nan"), None]), (3, None), (None, [1.0, 1.0]), (4, []), (1, [1.0, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    codes = nearest.sign_codes(vectors)
    assert sorted((r.id, r.code) for r in codes.collect()) == [(1, 1), (2, 0), (4, 0)]
    queries = codes.withColumnRenamed("id", "q")
    found = nearest.top_k(codes, queries, 10, 8).collect()
    assert sorted((r.q, r.id) for r in found) == [(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2)]
    assert nearest.top_k(codes.limit(0), queries.limit(0), 10).count() == 0
    assert nearest.sign_codes(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("size", [65, 200])
def test_codes_of_several_longs(spark, size):
    pick = random.Random(size)
    centres = [[pick.choice((-1.0, 1.0)) for _ in range(size)] for _ in range(4)]

    def near(centre):
        out = list(centre)
        for k in pick.sample(range(size), 6):
            out[k] = -out[k]
        return out

    rows = [(k, near(pick.choice(centres))) for k in range(60)]
    # Copies, ties, a vector that ends early, holes, and a repeated row.
    rows += [(100 + k, centres[0]) for k in range(9)] + [(200, centres[1][: size - 30]), (201, []), rows[7]]
    rows += [(202, [float("nan"), None, *centres[2][2:]]), (203, None), (None, centres[0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    codes = nearest.sign_codes(vectors)
    assert {len(r.code) for r in codes.collect()} == {(size + 63) // 64}
    asked = [0, 1, 2, 100, 200, 201, 202]
    queries = codes.filter(codes.id.isin(asked)).withColumnRenamed("id", "q")
    known = {k: [x is not None and x > 0 for x in (v + [0.0] * size)[:size]] for k, v in rows if k is not None and v is not None}
    wanted = set()
    for q in asked:
        ranked = sorted((sum(a != b for a, b in zip(known[q], known[k])), k) for k in known if k != q)
        wanted |= {(q, k, d, place + 1) for place, (d, k) in enumerate(ranked[:5])}
    for segments in (None, 8):
        assert {tuple(r) for r in nearest.top_k(codes, queries, 5, segments).collect()} == wanted
    mixed = spark.createDataFrame([(1, [1, 2]), (2, [1])], "id long, code array<long>")
    with pytest.raises(ValueError):
        nearest.top_k(mixed, mixed.withColumnRenamed("id", "q"), 1)
