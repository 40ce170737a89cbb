"""The two joins against brute force, and on odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespan.llm import knn_join
from rulespan.llm.jaccard_join import Classes, components, jaccard_components, local_links, part_keys, possible_links, sketch

VECTORS = "id long, v array<long>"


def brute_knn(queries, data, k):
    out = {}
    for q, v in queries:
        best = {}
        for i, w in data:
            if i is not None and i != q and w is not None:
                score = sum(a * b for a, b in itertools.zip_longest(v, w, fillvalue=0))
                best[i] = max(best.get(i, score), score)
        out[q] = [(i, s) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def knn(spark, queries, data, k, **options):
    rows = knn_join.knn_join(spark.createDataFrame(queries, VECTORS), spark.createDataFrame(data, VECTORS), k, **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("spread", [3, 200])
def test_knn_equals_brute_force_with_ties_and_small_blocks(spark, spread):
    r = random.Random(spread)
    centres = [[r.randint(-spread, spread) for _ in range(8)] for _ in range(6)]
    data = [(i, [c + r.randint(-2, 2) for c in r.choice(centres)]) for i in range(400)]
    queries = [x for x in data if x[0] % 10 == 0]
    want = brute_knn(queries, data, 5)
    assert knn(spark, queries, data, 5) == want
    assert knn(spark, queries, data, 5, pivots=(4, 8), group_queries=8, block_rows=16) == want


def test_knn_of_one_common_vector(spark):
    data = [(i, [1, 2, 3]) for i in range(300)] + [(300, [9, 9, 9])]
    got = knn(spark, data[:20], data, 3, group_queries=4, block_rows=32)
    assert got == brute_knn(data[:20], data, 3)


def test_knn_of_an_id_with_many_rows(spark):
    # a circle: the rows of a query's own id are the nearest, those of the other ranks are in other cells
    turn = np.arange(400) * 2 * np.pi / 400
    data = list(enumerate((1e6 * np.stack([np.cos(turn), np.sin(turn)], 1)).round().astype(int).tolist()))
    queries = data[::20]
    data += [x for x in queries for _ in range(5)]
    assert knn(spark, queries, data, 3, pivots=(200, 200), group_queries=1) == brute_knn(queries, data, 3)


@pytest.mark.parametrize("repeats,options", [(600, {}), (600, {"group_queries": 4, "block_rows": 64}), (40, {"pivots": (32, 64), "group_queries": 2, "block_rows": 16})])
def test_knn_of_ids_that_repeat_around_axes(spark, repeats, options):
    r = random.Random(repeats)
    axis = lambda: [1000 if k == a else r.randint(-30, 30) for a in [r.randrange(15)] for k in range(15)]
    data = [(1, [1000 if k == 0 else r.randint(-30, 30) for k in range(15)]) for _ in range(repeats)] + [(i, axis()) for i in range(2, 602)]
    data += [(i, axis()) for i in range(2, 40) for _ in range(r.randint(0, 20))]
    queries = [(1, [1000] + [0] * 14), (2, data[repeats][1]), (900, [0] * 14 + [1000])]
    assert knn(spark, queries, data, 5, **options) == brute_knn(queries, data, 5)


def test_knn_scores_beyond_doubles(spark):
    r = random.Random(6)
    data = [(i, [r.randint(-(10**9), 10**9) for _ in range(4)]) for i in range(200)]
    data += [(1000 + i, [10**9, 10**9, 10**9 - 1, i]) for i in range(5)]
    queries = [(1000, [10**9, 10**9, 10**9, 1]), *data[:5]]
    assert knn(spark, queries, data, 4) == brute_knn(queries, data, 4)
    with pytest.raises(ValueError):
        knn(spark, queries, [(1, [2**62, 2**62])], 1)


def test_knn_odd_rows(spark):
    data = [(1, [1, 0]), (1, [5, 0]), (2, None), (None, [9, 9]), (3, [2]), (4, [-1, 0, 4]), (5, []), (5, [])]
    queries = [(1, [1, 1]), (7, [1, 0, 1]), (8, None), (None, [1])]
    assert knn(spark, queries, data, 2) == brute_knn([q for q in queries if q[0] is not None and q[1] is not None], data, 2)
    assert knn(spark, [], data, 2) == {} and knn(spark, queries, [], 2) == {}
    assert knn(spark, [(1, [1])], [(1, [1])], 2) == {}, "a query alone has no candidate"


def test_scaled_floors_and_refuses_odd_components(spark):
    rows = [([0.5, -0.001],), ([float("nan")],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)]
    got = [r.s for r in spark.createDataFrame(rows, "v array<float>").select(knn_join.scaled(F.col("v"), 256.0).alias("s")).collect()]
    assert got == [[128, -1], None, None, None, None, []]


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute_components(docs, width, num, den):
    sets = [shingles(t, width) for _, t in docs]
    label = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(label[i], []).append(d)
    return sorted((d, len(sets[i]), min(ids[label[i]])) for i, (d, _) in enumerate(docs))


def family(r, size, edits, words=60):
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(words)] = f"x{r.randrange(10_000)}"
        yield " ".join(copy)


@pytest.mark.parametrize("options", [{}, {"region_members": 3}, {"split_members": 1, "region_members": 4}, {"region_shingles": 100}])
@pytest.mark.parametrize("width,num", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, options, width, num):
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [t for k in range(6) for t in family(r, 12, 4)] + [passage + " " + " ".join(f"q{r.randrange(50)}" for _ in range(n)) for n in range(0, 60, 3)]
    texts += ["short", "Short", "two words", "a b c d", "a b c d e f", "a b c d e g", "", " \t\n"] + [" ".join(f"t{(i + j) % 9}" for i in range(8)) for j in range(4)] + texts[:5] * 3
    docs = list(enumerate(texts))
    r.shuffle(docs)
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), width=width, num=num, den=100, **options).collect()
    assert sorted(map(tuple, got)) == brute_components(docs, width, num, 100)


def test_a_region_of_many_copies_takes_linear_work(spark):
    from rulespan.llm import jaccard_join

    def rows_out(n):
        r = random.Random(n)
        base = [f"w{k}" for k in range(80)]
        copies = []
        for i in range(n):
            own = list(base)
            own[r.randrange(80)] = f"x{i}"
            copies.append((i, " ".join(own)))
        members = spark.createDataFrame(copies, "doc_id long, text string")
        described = jaccard_join._described(members, 5).select(F.lit(7).cast("long").alias("region"), "sid", "n", "sketch")
        seen = spark.sparkContext.accumulator(0)
        plain = jaccard_join.possible_links

        def counted(sketches, *rest, **named):
            seen.add(len(sketches))
            return plain(sketches, *rest, **named)

        jaccard_join.possible_links = counted
        try:
            regions = jaccard_join._subregions(jaccard_join.cut(described), 80, 100, 50)
            assert regions.select("region").distinct().count() == 1 and regions.count() == n
        finally:
            jaccard_join.possible_links = plain
        return seen.value

    assert rows_out(1600) < 1600 * 4


def test_jaccard_odd_rows(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "a b c d e", "z"), (3, "a b c d e", None), (None, "a b c d e", "z"), (4, "a\tB c\x0bd\x0ce " * 3000, "y"), (5, "İ ß ﬁ", "x"), (6, "i̇ ß ﬁ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("n", F.lit(1)).withColumn("sid", F.lit("x"))
    got = sorted(map(tuple, jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, 3), (4, 5, 4), (5, 1, 5), (6, 1, 6)], key=str)
    assert jaccard_components(df.where("false")).count() == 0


def test_linked_sets_share_a_part():
    r = np.random.default_rng(5)
    for num, n in itertools.product((80, 85, 90), (1, 2, 5, 6, 7, 8, 9, 12, 20, 40, 100, 300, 780, 3000)):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            b = a.copy()
            while True:
                c = np.unique(np.concatenate([b[r.random(len(b)) > 1 / max(2, len(b))], r.integers(0, 2**63, 1 if r.random() < 0.5 else 0, dtype=np.uint64)]))
                inter, union = len(np.intersect1d(a, c)), len(np.union1d(a, c))
                if not union or 100 * inter < num * union:
                    break
                b = c
            if np.array_equal(a, b):
                continue
            assert set(part_keys(a, Classes(num, 100)).tolist()) & set(part_keys(b, Classes(num, 100)).tolist()), (num, n)
            assert len(possible_links([sketch(a), sketch(b)], np.array([len(a), len(b)]), num, 100)) == 1
            assert local_links([a, b], num, 100) == [(0, 1)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bound", [1 << 29, 1 << 19])
def test_filter_never_misses_a_key(spark, monkeypatch, bound):
    from rulespan.llm import common

    monkeypatch.setattr(common, "FILTER_BITS", bound)
    keys = spark.range(40_000).select(F.xxhash64("id").alias("h"))
    bitmap, mask = common.key_filter(keys, 40_000)
    hashes = np.array([r.h for r in spark.range(80_000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    hit = common.maybe_in(hashes, bitmap, mask)
    assert len(bitmap) * 8 == min(bound, 1 << 20) and hit[:40_000].all() and hit[40_000:].mean() < 0.1
    none, mask = common.key_filter(keys.where("false"), 0)
    assert not common.maybe_in(hashes, none, mask).any()
