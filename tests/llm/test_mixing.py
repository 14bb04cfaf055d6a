"""Source mixes against a plain apportionment, one block at a time."""
import heapq
import math
import random
import re

import pytest

from heatline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def table(spark, rows):
    return spark.createDataFrame([(k, t, s, 5, "x") for k, t, s in rows], SCHEMA)


def plain_targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, open_ones = 1.5 * sum(sizes.values()), {}, set(names)
    while open_ones:
        unit = left / sum(weight[s] for s in open_ones)
        over = {s for s in open_ones if unit * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_ones}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ones -= over
    return sizes, target


def check(spark, rows, tolerance=0.01, **options):
    got = mixing.mix(table(spark, rows), **options).collect()
    sizes, target = plain_targets(rows)
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted([(r.doc_id, r.source, r.size) for r in got], key=key) == sorted(
        [(k, s, words(t)) for k, t, s in rows], key=key)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(1, tolerance * target[s]), (s, taken[s], target[s])
    return got


def made(n, seed=1, sources=("b", "a", None, "é", "")):
    pick = random.Random(seed)
    chosen = [pick.choice([sources[0], *sources]) for _ in range(n)]
    return [(pick.randint(0, n), " ".join(["w"] * min(int(pick.paretovariate(1) * 9), 3000)), s) for s in chosen]


@pytest.mark.parametrize("rows_per_shard", [mixing.ROWS_PER_SHARD, 50])
def test_mix(spark, rows_per_shard):
    rows = made(900) + [(7, "the same row", "b")] * 300 + [(None, None, "b"), (None, "", None), (1, " \x0b ", "z")]
    rows += [(5000, "one very long text " * 30_000, "long")]
    got = check(spark, rows, rows_per_shard=rows_per_shard)
    again = mixing.mix(table(spark, rows[::-1]), rows_per_shard=rows_per_shard).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_small_sources_are_met(spark):
    rows = made(400, 2) + [(9000 + k, "few words here", "tiny") for k in range(3)]
    check(spark, rows)


def test_one_word_each(spark):
    check(spark, [(k, "w", f"s{k}") for k in range(30)])


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None), (2, " ", "a")]])
def test_nothing_to_take(spark, rows):
    assert [r.taken for r in mixing.mix(table(spark, rows)).collect()] == [0] * len(rows)


def test_highest_quotients(spark):
    pick = random.Random(4)
    parties, wanted = [], {}
    for group, n in enumerate([1, 2, 7, 40]):
        weights = [pick.choice([0.0, 1.0, 3.5, pick.random() * 50]) for _ in range(n - 1)] + [2.0]
        seats = pick.randint(0, 200)
        share = [math.ceil(seats * w / sum(weights)) for w in weights]
        most = [pick.choice([300, m, m + 1]) for m in share[:-1]] + [300]
        heap = [(-w, k, 0) for k, w in enumerate(weights) if most[k] and w]
        heapq.heapify(heap)
        quota = [0] * n
        for _ in range(seats):
            _, k, won = heapq.heappop(heap)
            quota[k] = won + 1
            if won + 1 < most[k]:
                heapq.heappush(heap, (-weights[k] / (2 * won + 3), k, won + 1))
        parties += [(group, k, w, seats, m) for k, (w, m) in enumerate(zip(weights, most))]
        wanted |= {(group, k): q for k, q in enumerate(quota)}
    frame = spark.createDataFrame(parties, "g long, k long, w double, seats long, most long")
    got = {(r.g, r.k): r.quota for r in mixing.sainte_lague(frame, ["g"], ["k"], "w", "seats", "most").collect()}
    assert got == wanted
