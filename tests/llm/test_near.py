"""Verified near dedup against all pairs."""

import random

import numpy as np
import pytest

from turnwise.llm import near
from turnwise.llm.simhash import fingerprint


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows):
    """{doc_id: smallest doc_id of its class} over all pairs."""
    sets, least = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    links = [(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= near.SIMILARITY]
    for _ in rows:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(60, 900))
        rows.append(" ".join(base))
        for share in (0.004, 0.01, 0.1, 0.5):  # the last two are other texts
            changed = [rng.choice(vocabulary) if rng.random() < share else w for w in base]
            rows.append(" ".join(changed))
    rows += ["short one", "Short  one\n", "another text", "", None, " \t", rows[0].upper()]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["lead"]["doc_id"] for r in near.classes(df).collect()}
    assert found == brute(rows)
    stay = {r["doc_id"] for r in near.near_deduplicated(df).collect()}
    assert stay == {i for i, lead in found.items() if i == lead}


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in near.near_deduplicated(df).collect()] == [0]


def test_edges(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (5, ""), (6, "word " * 30_000), (7, "é\x00 x")]
    df = spark.createDataFrame([(*r, 1, "g", 2) for r in rows], "doc_id long, text string, mark int, gone_id string, node int")
    out = near.near_deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 3, 4, 6, 7]  # rows alike stay together
    empty = df.where("false")
    assert near.classes(empty).count() == near.near_deduplicated(empty).count() == 0


def test_similarity_of_sets_is_that_of_shingles():
    a, b = "a b c d e f g h", "A b c d e f g x"
    assert near.similarity(near.shingle_set(a), near.shingle_set(b)) == pytest.approx(jaccard(shingles(a), shingles(b)))
    assert near.similarity(near.shingle_set(""), near.shingle_set(None)) == 1.0 and fingerprint("") == 0


def test_reruns_agree(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = [near.marked(df.repartition(n), 5, "doc_id", "text").select("fp", "node", "n", "counted", "more").distinct() for n in (1, 7)]
    first, second = ({r["node"]: r["root"] for r in near.components(near.candidates(k)).collect()} for k in kinds)
    assert first and first == second
    first, second = (sorted(map(tuple, near.neighbours(near.meeting(k)).collect())) for k in kinds)
    assert first and first == second


def bucket_rows(spark, rng, buckets, roots):
    """Rows (key, root, node, info, bits) of sets of numbers, and the sets."""
    sets = {n: np.array(rng.sample(range(114), rng.randint(95, 105)), np.int32) for n in range(300)}
    rows = [(k, roots.get(n, n), n, (len(sets[n]) << 32) + rng.randint(0, 9), near.bitmap(sets[n])) for k, size in enumerate(buckets) for n in rng.sample(range(300), size)]
    return rows, spark.createDataFrame(rows, "key int, root long, node long, info long, bits binary").repartition(5), sets


def may_be_alike(x, y):
    one, two = (near.words_of(np.array([r[4]], object)) for r in (x, y))
    return x[1] != y[1] and near.fitting(np.int64(x[3]), np.int64(y[3]), 0.8) and near.alike(np.array([x[3] >> 32]), np.array([y[3] >> 32]), one, two, 0.8)[0]


@pytest.mark.parametrize("tile", [3, 50, 4096])
def test_all_pairs_of_a_bucket_meet_in_tiles(spark, tile):
    roots = {n: n // 2 * 2 for n in range(200)}
    rows, frame, sets = bucket_rows(spark, random.Random(tile), [4, 16, 64, 256], roots)
    got = sorted(map(tuple, near.across(frame, tile=tile).collect()))
    want = {tuple(sorted((x[2], y[2]))) for x in rows for y in rows if x[0] == y[0] and may_be_alike(x, y)}
    assert got == sorted(want) and 0 < len(got)
    exact = {(a, b) for a, b in want if near.similarity(np.sort(sets[a]), np.sort(sets[b])) >= 0.8}
    met = {tuple(sorted((x[2], y[2]))) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and near.fitting(np.int64(x[3]), np.int64(y[3]), 0.8)}
    assert exact == {(a, b) for a, b in met if near.similarity(np.sort(sets[a]), np.sort(sets[b])) >= 0.8}


def kinds_of(spark, sets, often=None):
    rows = [(i, len(x), *(y.tolist() for y in near.ordered(x, 0.8, often))) for i, x in enumerate(sets)]
    return spark.createDataFrame(rows, "node long, n long, counted array<int>, more array<int>")


def random_sets(rng, space, number):
    """Sets of which some are others with a few items put in for others."""
    sets = []
    for n in rng.choice([1, 2, 4, 5, 9, 10, 45, 100, 301], number):
        a = rng.choice(space, n, replace=False)
        if sets and rng.random() < 0.6:
            b = sets[rng.integers(len(sets))].view(np.uint32)
            a = np.concatenate((rng.permutation(b)[: len(b) - rng.integers(0, len(b) // 8 + 1)], a[: rng.integers(0, len(b) // 8 + 1)]))
        sets.append(np.unique(a.astype(np.uint32)).view(np.int32))
    return sets


@pytest.mark.parametrize("common, few", [(False, False), (True, False), (False, True), (True, True)])
def test_similar_sets_meet_in_their_heads(spark, common, few, monkeypatch):
    rng = np.random.default_rng(8 + common)
    space = rng.integers(0, 2**31 if few else 2**32, 900 if few else 20_000, np.int64)
    often = (np.unique(rng.choice(space, 200)).astype(np.uint32), rng.integers(3, 90, 200)) if common else None
    often = often and (often[0], often[1][: len(often[0])])
    sets = random_sets(rng, space, 500)
    if few:
        monkeypatch.setattr(near, "PART", 0.05)  # heads need others, too
    met = near.meeting(kinds_of(spark, sets, often)).collect()
    heads = {}
    for r in met:
        heads.setdefault(r["node"], {})[r["key"]] = r["info"]
    linked = 0
    for i, a in enumerate(sets):
        assert len(heads.get(i, {})) <= near.head_size(len(a), 0.8)
        assert all(x >> 32 == len(a) and x & 0xFFFFFFFF < near.head_size(len(a), 0.8) for x in heads.get(i, {}).values())
        for j in range(i):
            if near.similarity(a, sets[j]) >= 0.8:
                linked += 1
                both = heads.get(i, {}).keys() & heads.get(j, {}).keys()
                assert any(near.fitting(np.int64(heads[i][k]), np.int64(heads[j][k]), 0.8) for k in both)
    assert linked > 100


def test_neighbours_across_batches(spark):
    rng = random.Random(6)
    roots = {n: n // 3 * 3 for n in range(150)}
    rows, frame, _ = bucket_rows(spark, rng, [rng.choice([1, 2, 9]) for _ in range(40)], roots)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, near.adjacent(frame, F.shiftright("info", 32), 0.8).collect()))
    by_chance = {tuple(r) for r in near.others(frame).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    want = set()
    for k in range(40):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[3] >> 32, r[2]))
        want |= {tuple(sorted((x[2], y[2]))) for i, y in enumerate(own) if i for x in (own[i - 1], own[0]) if may_be_alike(x, y)}
    assert got == sorted(want) and got
    assert by_chance <= {tuple(sorted((x[2], y[2]))) for x in rows for y in rows if x[0] == y[0] and may_be_alike(x, y)}


def classes_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["lead"]["doc_id"] for r in near.classes(df).collect()}


def other_words(rng, n):
    return [f"{rng.choice('abcdefghijklmnop')}{rng.randrange(10**6)}" for _ in range(n)]


def block_replaced(rng, base, alike):
    """base with a block replaced by other words, at about the similarity."""
    n = len(base) - 4
    width = max(1, int(n * (1 - alike) / (1 + alike)) - 4)
    at = rng.randrange(4, len(base) - width - 4)
    return base[:at] + other_words(rng, width) + base[at + width :]


def test_replaced_blocks_near_the_threshold(spark):
    rng, rows = random.Random(31), []
    for i in range(120):
        base = other_words(rng, rng.randint(120, 600))
        rows += [" ".join(base), " ".join(block_replaced(rng, base, 0.79 + 0.07 * i / 119))]
    rows = list(enumerate(rows))
    expected = brute(rows)
    assert 80 < sum(i != lead for i, lead in expected.items()) < 120
    assert classes_of(spark, rows) == expected


def test_repeated_lines_do_not_hide_a_copy(spark):
    rng, rows = random.Random(12), []
    for i in range(40):
        base, line = other_words(rng, 300), other_words(rng, 12)
        rows += [" ".join(base), " ".join(base + line * (5 if i % 2 else 10))]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in near.near_deduplicated(df).collect()} == set(range(0, 80, 2))


def test_links_among_look_alikes_that_fail(spark):
    rng = random.Random(77)
    base, rows = other_words(rng, 400), []
    for i in range(150):
        text = block_replaced(rng, base, 0.87)  # two of these are mostly at 0.75 to 0.8
        rows.append(" ".join(text))
        if i % 3 == 0:
            rows.append(" ".join(block_replaced(rng, text, 0.81)))
    rows = list(enumerate(rows))
    expected = brute(rows)
    assert classes_of(spark, rows) == expected
