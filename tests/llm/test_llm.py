"""The operators of turnwise.llm against brute force, round trips and held-out labels."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tests.oracle import SF, rows_of, same
from turnwise.llm import bpe, exact, html_text, langid, mixing, queries, sharding, simhash, voronoi, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, rep int, shard int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, 2) for i, t, lang, s in rows], DOC)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty, blank and long texts, ties, and repeated rows."""
    long = "ab" * 60_000
    return docs(spark, (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, "Hello  world", "en", "b"), (5, "Helloworld", "en", None), (5, "Helloworld", "en", None), (None, "Helloworld", "fr", "b"), (None, None, None, None), (6, long, "en", "a"), (7, long + " x", None, "a"), (8, "a <|endoftext|> b", "de", "c"), (9, "日本語 テキスト 🙂", "fr", "c"))


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark).limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_language_of_held_out(spark, edge, none):
    found = {r["doc_id"]: r for r in queries.QUERIES["op1_language_id"](spark, SF).collect()}
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in found.items())
    tested = [i for i, r in found.items() if r["held_out"]]
    assert sum(found[i]["lang_pred"] == known[i] for i in tested) >= 0.97 * len(tested)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predictions(edge).collect()]
    assert len(got) == 12 and {p for i, p in got if i in (1, 2, 3)} == {"und"}
    assert langid.predictions(none).count() == 0
    assert langid.learn(none).predict("any text") == ("und", 0.0)


def test_language_counts_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(random.Random(2).choice(["der", "Hund", "läuft", "1 2", "so-so"]) for _ in range(4000))
    whole = dict(zip(*(x.tolist() for x in langid.counted(text)), strict=True))
    monkeypatch.setattr(langid, "CHUNK", 777)
    assert dict(zip(*(x.tolist() for x in langid.counted(text)), strict=True)) == whole


def brute_counts(text):
    """Counts of n-grams as strings, by the keys that settle ties."""
    import re

    padded = "_" + re.sub(r"[\W\d_]+", "_", text.lower()).strip("_") + "_"
    counts = collections.Counter()
    for n in range(1, 6):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if "_" not in gram[1:-1] and gram.strip("_"):
                key = 0
                for c in gram:
                    key = (key * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
                    key ^= key >> 29
                counts[key] += 1
    return counts


def brute_profile(text, most):
    """Out-of-place ranks by hand, of a text or of counts."""
    counts = brute_counts(text) if isinstance(text, str) else text
    return sorted(counts, key=lambda k: (-counts[k], k))[:most]


def test_language_equals_brute_force_with_ties():
    rnd = random.Random(3)
    texts = {x: " ".join("".join(rnd.choices(x, k=rnd.randint(1, 6))) for _ in range(60)) for x in ("abcde", "cdefg", "efghi")}
    lists = {name: brute_profile(text, 50) for name, text in texts.items()} | {"again": brute_profile(texts["abcde"], 50)}
    profiles = langid.Profiles({name: [k - 2**64 if k >> 63 else k for k in own] for name, own in lists.items()}, 50)
    for _ in range(80):
        text = " ".join("".join(rnd.choices("abcdefghi1 -", k=5)) for _ in range(rnd.randint(1, 30)))
        mine = brute_profile(text, 50)
        far = {name: sum(min(50, abs(own.index(k) - r)) if k in own else 50 for r, k in enumerate(mine)) for name, own in lists.items()}
        best = min(sorted(far), key=far.get)
        assert profiles.predict(text) == (best, pytest.approx(1 - far[best] / (50 * len(mine))))
    assert profiles.predict(texts["abcde"]) == ("abcde", 1.0)  # as near as "again", which comes after


def brute_products(rows, k=10, every=100):
    v = {i: [int(np.floor(1024 * float(x))) for x in e] for i, e in rows if e is not None and i is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], e, strict=True)), i) for i, e in v.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_products_with_ties_nulls_and_hot_vectors(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) * (3 if i % 7 else 1) for _ in range(6)]) for i in range(700)] + [(i, [0.5] * 6) for i in range(700, 1100)]
    rows += [(1100, None), (1200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1201, [float("nan")] * 6), (None, [1.0] * 6), (1202, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in voronoi.top_products(df, pivots=12).collect())
    assert got == brute_products(rows)
    assert voronoi.top_products(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [11, 25])
def test_voronoi_with_repeated_ids(spark, copies, monkeypatch):
    rows = [(100, [9.0, 0.0])] * copies + [(i, [i / 8, i % 7 / 4]) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    products = sorted((-(9 * 1024) * (1024 * i // 8), i) for i in range(1, 31))
    expected = [(100, rank, i, -score) for rank, (score, i) in enumerate(products[:10], 1)]
    for most in (voronoi.COPIES, 5):
        monkeypatch.setattr(voronoi, "COPIES", most)
        assert sorted(map(tuple, voronoi.top_products(df).collect())) == expected


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(PATH, encoding="utf-8").read(), leaf=7, piece=40, long=10)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoding_equals_the_library(encoder):
    tok, rnd = library(), random.Random(1)
    kinds = ["ab", "abc", "éèa", "日本語", "!?", "the", "\n", " \n", "0123", "aé日🙂", "ab ", "the \n", "ȡ͸՘ a", "a's l", " \xa0 x"]
    for _ in range(600):
        text = "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 150)))
        text += rnd.choice(["", "", "<|endoftext|>" + text])
        ids = encoder.encode(text)
        assert ids == tok.encode(text, add_special_tokens=False).ids and encoder.counts([text, "", text]) == [len(ids), 0, len(ids)]
        assert encoder.decode(ids) == text == tok.decode(ids, skip_special_tokens=False)


def test_tree_of_long_words(encoder):
    tok = library()
    for text in ("ab" * 3000, "日本" * 900, " " * 3000, "!?" * 2000 + "x", "a" * 4001, "'" * 999, "12" * 2000, "ȡ" * 500, "日本、" * 500, " x" * 999 + "\n" * 999):
        assert encoder.encode(text) == tok.encode(text, add_special_tokens=False).ids
        assert encoder.counts([text]) == [len(encoder.encode(text))]


@pytest.mark.parametrize("window", [1, 3])
def test_windows_grow_until_both_sides_agree(window, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", window)
    own = bpe.Encoder(open(PATH, encoding="utf-8").read(), leaf=61, long=61)
    tok, rnd = library(), random.Random(window)
    kinds = ["ab", "the ", "'s", "s'll", " ", "\n", "  \n", "0123", "日本、", "é", "!?", "''", "x 's", "ȡ՘", "🙂"]
    for _ in range(400):
        some = rnd.sample(kinds, rnd.randint(1, 4))
        text = "".join(rnd.choice(some) * rnd.choice([1, 1, 2, 30]) for _ in range(rnd.randint(20, 120)))
        assert own.encode(text) == tok.encode(text, add_special_tokens=False).ids
    assert own.joins > 1000


def test_long_documents_go_through_joins(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_bpe_encode"](spark, SF).collect()}
    tok, long = library(), {i for i, t in known.items() if len(t) > bpe.LONG}
    assert long and {i for i, r in got.items() if r["n_joins"]} == long
    assert all(r["n_joins"] == max(0, -(-len(known[i]) // bpe.LEAF) - 1) for i, r in got.items() if i in long)
    for i, r in got.items():
        ids = tok.encode(known[i], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_and_counting_rows(spark, edge, none):
    tok = library()
    want = sorted((str(r["doc_id"]), len(ids := tok.encode(r["text"] or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in edge.collect())
    assert sorted((str(r[0]), *r[1:4]) for r in bpe.encode_digests(edge, PATH).collect()) == want
    counts = sorted((str(r["doc_id"]), r["n_tokens"]) for r in bpe.token_counts(edge, PATH).collect())
    assert counts == sorted((a, b) for a, b, _, _ in want)
    both = bpe.encode_documents(edge, PATH).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in both) and len(both) == 12
    assert bpe.token_counts(none, PATH).count() == bpe.encode_documents(none, PATH).count() == 0
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert sorted(r["n_tokens"] for r in bpe.token_counts(edge, model).collect()) == sorted(len(sp.encode(r["text"] or "")) for r in edge.collect())


@pytest.mark.parametrize("budget", [400, 4000, 1 << 30])
def test_trie_with_spilling(budget):
    rnd, trie, want = random.Random(3), exact.Trie(budget), collections.defaultdict(list)
    for k in range(2000):
        key = (b"common prefix" * 5 if rnd.random() < 0.3 else b"") + bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 1, 3, 8, 200])))
        trie.insert(key, ((rnd.randint(-3, 0), False, k), 1, [k], (k,)))
        want[key].append(k)
    assert sorted((v[1], sorted(v[2])) for v in trie.items()) == sorted((len(v), v) for v in want.values())


@pytest.mark.parametrize("budget", [500, exact.BUDGET])
def test_exact_dedup_of_edges(spark, edge, none, budget):
    got = exact.classes(edge.repartition(4), budget=budget).collect()
    size = collections.Counter(r["text_sha256"] for r in got)
    assert len(got) == 12 and all(r["group_size"] == size[r["text_sha256"]] for r in got)
    assert collections.Counter(r["text_sha256"] for r in got if r["kept"]) == dict.fromkeys(size, 1)
    assert {r["keep_id"] for r in got if r["doc_id"] in (4, 5)} == {4} and {r["keep_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {3}
    stay = exact.deduplicated(edge, budget=budget)
    assert stay.columns == edge.columns and sorted(r["doc_id"] for r in stay.collect()) == [3, 4, 6, 7, 8, 9]
    assert exact.classes(none).count() == exact.deduplicated(none).count() == 0


def test_many_partitions(spark):
    """More partitions than cores: no two tasks number or name things alike."""
    rows = [(i, f"text {i % 70} " + "x" * 120) for i in range(400)]
    found = exact.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(60)).collect()
    assert len(found) == 400 and sum(r["kept"] for r in found) == 70 and {r["keep_id"] for r in found} == set(range(70))
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string").repartition(60)
    back = warc.read(warc.write(pages, archive=1 << 9)).collect()
    assert len(back) == 400 and sum(r["record_type"] == "response" for r in back) == 70


def brute_components(fps, radius):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= radius and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_near_classes_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = brute_components(fps, 3)
    got = queries.QUERIES["op7_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


@pytest.mark.parametrize("radius, segments", [(3, 2), (3, 4), (5, 3), (7, 4)])
def test_links_of_dense_fingerprints(spark, radius, segments):
    rnd = random.Random(radius)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = {i: f for i, f in enumerate({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for s in seeds for _ in range(15)})}
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    got = dict(simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed.values()], "fp long"), radius, segments)).collect())
    want = collections.defaultdict(set)
    for i, r in brute_components(fps, radius).items():
        want[r].add(signed[i])
    mine = collections.defaultdict(set)
    for f in signed.values():
        mine[got.get(f, f)].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_a_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long").repartition(5)
    assert {r["root"] for r in simhash.components(edges).where("node < 1000").collect()} == {0}


def test_near_dedup_of_edges(spark, edge, none):
    got = simhash.near_classes(edge).collect()
    assert len(got) == 12 and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    stay = simhash.near_deduplicated(edge)
    assert stay.columns == edge.columns and stay.where("doc_id in (2, 3)").count() == 0
    assert simhash.near_classes(none).count() == simhash.near_deduplicated(none).count() == 0


def test_mixing(spark, edge, none):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.taken_words(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    assert all(abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 for own in by.values())
    assert sorted(tuple(r) for r in mixing.taken_words(documents.repartition(7)).collect()) == sorted(tuple(r)[:6] for r in got)
    words = sum(len(r["text"].encode().split()) for r in mixing.mixed(documents).collect())
    assert words == sum(r["taken"] for r in got)
    assert mixing.taken_words(edge).count() == 12 and mixing.taken_words(none).count() == mixing.mixed(none).count() == 0


def test_targets_and_tree():
    sizes = {"a": 100, "b": 1000, "c": 1000, None: 5}
    goal = mixing.targets(sizes)
    assert goal["a"] == 200 and goal[None] == 10 and sum(goal.values()) == pytest.approx(1.5 * 2105)
    assert all(goal[s] <= 2 * n + 1e-9 for s, n in sizes.items())
    quotas = np.array([50, 0, 7, 1000])
    parts = mixing.split(quotas, 6, "s")
    assert (parts.sum(0) == quotas).all() and parts.sum(1).max() - parts.sum(1).min() <= 3 and (parts >= 0).all()
    for n in (1, 2, 3, 100, 4097):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64)).tolist()) == list(range(n))


def test_blocks_are_disjoint_over_documents():
    rnd = random.Random(4)
    sizes = [rnd.randint(0, 90) for _ in range(200)]
    plan = mixing.Plan({"a": sum(sizes), "b": 50 * sum(sizes)}, block=16, shards=5)
    offset = np.cumsum([0, *sizes[:-1]])
    row, turn, shard, low, high = plan.spans(np.zeros(200, np.int64), offset, np.array(sizes))
    seen = collections.Counter((k, int(offset[r]) + w) for r, k, a, b in zip(row, turn, low, high, strict=True) for w in range(a, b))
    assert max(seen.values()) == 1 and sum(seen.values()) == round(plan.target["a"]) and set(shard) <= set(range(5))


def test_shards_follow_the_words_taken():
    assert mixing.Plan({"a": 1000}).shards == mixing.Plan({}).shards == 16
    plan = mixing.Plan({"a": 10**8, None: 10**8})
    assert plan.shards == 75 and plan.until.shape == (2, 75) and mixing.Plan({"a": 10**12}).shards == 65_536
    share = np.diff(plan.until.sum(0), prepend=0)
    assert share.max() - share.min() <= 8  # halves of halves, each rounded
    draw = np.arange(0, int(plan.until[1, -1]), 997)
    offset = (draw % plan.blocks[1]) * plan.block
    found = plan.spans(np.ones(len(draw), np.int64), offset, np.ones(len(draw), np.int64))
    for row, turn, shard in found[:3].T.tolist():
        at = int(mixing.permuted(np.array([offset[row] // plan.block]), plan.blocks[1:2], plan.key[1:2, turn])[0]) + turn * int(plan.blocks[1])
        assert shard == sum(x <= at for x in plan.until[1].tolist())


def brute_draws(rows, block, seed="mix"):
    """{source: [(pass, [(row number, word number), ...]), ...]}, the blocks drawn in their order,
    from lists of words; rows are (hash, source, size)."""
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal = mixing.targets(dict(sizes))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    words, draws = {s: [] for s in names}, {}
    for r in sorted(range(len(rows)), key=lambda r: rows[r][0]):
        words[rows[r][1]] += [(r, w) for w in range(rows[r][2])]
    for s in names:
        blocks, left, out = [words[s][i : i + block] for i in range(0, len(words[s]), block)], round(goal[s]), []
        for turn in range(3):
            key = int.from_bytes(hashlib.sha256(f"{seed}/{turn}/{s!r}".encode()).digest()[:7], "big")
            n = len(blocks)
            place = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64)).tolist() if n else []
            for b in sorted(range(n), key=lambda b: place[b]):
                if left > 0:
                    out.append((turn, blocks[b][:left]))
                    left -= len(out[-1][1])
        draws[s] = out
    return draws


def brute_mix(rows, shards, block, seed="mix"):
    """{row number: {shard: words}} by lists of blocks, word by word; the tree's quotas are drawn
    anew, position after position."""
    draws = brute_draws(rows, block, seed)
    quotas = mixing.split(np.array([len(x) for x in draws.values()]), shards, seed)
    taken = collections.defaultdict(collections.Counter)
    for i, drawn in enumerate(draws.values()):
        mine = iter(drawn)
        for shard in range(shards):
            for _ in range(quotas[shard, i]):
                for r, _ in next(mine)[1]:
                    taken[r][shard] += 1
        assert next(mine, None) is None
    return taken, quotas


@pytest.mark.parametrize("block, shards", [(16, 5), (64, 1), (500, 33)])
def test_mixing_equals_brute_force(spark, block, shards):
    rnd = random.Random(block)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 40, 300])), None, rnd.choice(["a", "b", "c", None, "a"]), None) for i in range(150)]
    rows += [(7, "copy of it", "en", "b", 1)] * 40 + [(None, None, None, None, None), (None, " \t", None, "", 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, size long, copies int, shard int, k1 int").repartition(3)
    got = [r.asDict() for r in mixing.taken_words(df, block=block, shards=shards).collect()]
    from pyspark.sql import functions as F

    keys = mixing.keys_of([F.col("doc_id"), F.col("source"), F.col("text")])
    order = df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).alias("n"), F.xxhash64(F.lit(3), *keys).alias("h")).collect()
    want, quotas = brute_mix([(r["h"] % 2**64, r["source"], r["n"]) for r in order], shards, block)
    assert quotas.sum(1).max() - quotas.sum(1).min() <= 2 * shards
    key = lambda i, n, t: (-1 if i is None else i, n, tuple(sorted(t.items())))
    assert sorted(key(r["doc_id"], r["size"], {x["shard"]: x["words"] for x in r["shards"]}) for r in got) == sorted(key(r["doc_id"], r["n"], want[k]) for k, r in enumerate(order))
    assert all(r["taken"] == sum(x["words"] for x in r["shards"]) <= 2 * r["size"] for r in got)
    out = mixing.mixed(df, block=block, shards=shards)
    assert out.columns[: len(df.columns)] == df.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(r["taken"] for r in got)


def test_archives(spark):
    rows = [(1, "http://a/\r\nx", "x" * 100), (2, None, "x" * 100), (3, "u", "é" * 40_000), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (2, "u", "x" * 100), (None, "u", "x" * 100)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    manifest = warc.write(pages, segment=1 << 10, archive=1 << 10)
    got = warc.read(manifest).collect()
    assert len(got) == 8 and all(r["complete"] for r in got)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 1)}
    assert next(r for r in got if r["page_id"] == 3)["payload"].decode() == "é" * 40_000
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_archives_that_are_cut_or_plain(tmp_path):
    import io

    raw = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, b"x" * (50 + i)) for i in range(3)]
    whole = b"".join(map(warc.zipped, raw))
    assert [len(b) for _, b in warc.records(io.BytesIO(whole), 7)] == [50, 51, 52] == [len(b) for _, b in warc.records(io.BytesIO(b"".join(raw)), 7)]
    assert list(warc.records(io.BytesIO(b""))) == []
    ends = [len(warc.zipped(raw[0])), len(warc.zipped(raw[0])) + len(warc.zipped(raw[1]))]
    for cut in range(1, len(whole)):
        if cut not in ends:
            with pytest.raises(ValueError):
                list(warc.records(io.BytesIO(whole[:cut]), 11))


def test_a_lost_first_segment_is_told(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "a" * 5000), (2, "v", "b" * 50)], "page_id long, url string, html string")
    manifest = warc.write(pages.coalesce(1), segment=1 << 10)
    path = manifest.first()["path"].removeprefix("file://")
    with open(path, "rb") as f:
        found = list(warc.records(f))
    kept = [warc.zipped(warc.record({k.title(): v for k, v in f.items() if k != "content-length"}, b)) for f, b in found if f.get("warc-segment-number") != "1"]
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(kept))
    got = warc.read(manifest.limit(1).select(F.lit(f"file://{tmp_path}/cut.warc.gz").alias("path"), "records")).orderBy("page_id").collect()
    assert [(r["page_id"], r["complete"]) for r in got] == [(None, False), (2, True)]


def test_exact_dedup_of_string_ids(spark):
    rows = spark.createDataFrame([("", "a b"), ("z", "ab"), ("b", "a b"), (None, "a b"), (None, None)], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact.classes(rows).collect()} == {("", ""), ("z", ""), ("b", ""), (None, ""), (None, None)}


def test_segments_that_are_lost_or_of_wrong_length():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload", 3)
    head = {"warc-type": "response", "warc-page-id": "1", "warc-payload-digest": "sha256:" + hashlib.sha256(b"payload").hexdigest()}
    assert warc.assembled(head, block, len(block), True)[5:] == (7, b"payload", True)
    assert warc.assembled(head, block[:-9], len(block), True)[5:] == (None, None, False)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"ff\r\nabc")


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>", ""),
        ("<nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>Be.<p>It is  the\n one</article><footer>&copy; the site of the firm</footer>", "T & U Be. It is the one"),
        ("<script>var a='</p>';</script><style>p{}</style><div class='ad'>buy it now</div><main><p>The cat is on the mat<br>and stays.</main>", "The cat is on the mat and stays."),
        ("<article><p>This is the text of it.</p><div id='comments'><p>I am the first to say it.</p></div></article>", "This is the text of it."),
        ("<header>Site</header><div><h2>Head</h2><p>" + "It is the way that we are in the end of it all. " * 6 + "</p><p>Yes.</p><p>" + "And so it was that they had to go on with it. " * 6 + "</p></div><ul><li><a href=x>one</a></li></ul>", "Head " + ("It is the way that we are in the end of it all. " * 6).strip() + " Yes. " + ("And so it was that they had to go on with it. " * 6).strip()),
        ("<article><p title=\"a>b\">Is it &lt;b&gt; or &#233;?</p></article>", "Is it <b> or é?"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_give_their_articles(spark):
    import html
    import re

    for r, p in zip(queries.QUERIES["op9_html_text"](spark, SF).orderBy("page_id").collect(), spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect(), strict=True):
        inside = re.search("<article>(.*)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == p["url"]


def article(page):
    import html
    import re

    inside = re.search("<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())


@pytest.mark.parametrize("change, least", [("article", 1.0), ("marks", 0.95), ("both", 0.95), ("tags", 0.6)])
def test_rules_decide_without_tags(spark, change, least):
    """No article tag; no class, id or role; neither; and no nav or footer besides."""
    import re

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    good = 0
    for page in pages:
        want = article(page)
        if change != "marks":
            page = page.replace("<article>", "<div>").replace("</article>", "</div>")
        if change != "article":
            page = re.sub(r' (class|id|role)="[^"]*"', "", page)
        if change == "tags":
            page = re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", page)
        good += html_text.main_text(page) == want
    assert good >= least * len(pages)


LONG_TEXT = "It was the way that they had to go in the end of it, and so they did as it is said. " * 4
OTHER = "Był to dzień, w którym nie było na niebie i na ziemi nic, co by się nie ruszało. Nie było też tak, że się nie da. " * 3


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='sidebar'><p>{LONG_TEXT}</p></div><div><p>{LONG_TEXT}</p></div><section id='comments'><p>{LONG_TEXT}</p></section>", LONG_TEXT),
        (f"<div><a href=a>All the news of the day that is fit to read in the evening and at night</a></div><div><p>{LONG_TEXT}</p><p>Short.</p></div><div>Imprint</div>", LONG_TEXT + "Short."),
        (f"<div role='dialog'>{LONG_TEXT}</div><form><p>{LONG_TEXT}</p></form><div><h2>Head</h2>{LONG_TEXT}<table><tr><td>1</td><td>2</td></tr></table>{LONG_TEXT}</div>", f"Head {LONG_TEXT}1 2 {LONG_TEXT}"),
        (f"<ul><li><a href=x>Strona</a></li></ul><div><p>{OTHER}</p><p>{OTHER}</p><p>{OTHER}</p></div><div><a href=y>O nas</a></div>", f"{OTHER}{OTHER}{OTHER}"),
        ("<nav><a href=a>x</a></nav><div>Ad</div><div><h1>Title</h1><p>Two words.</p></div><footer>f</footer>", "Title Two words."),
        ("plain words without a tag", "plain words without a tag"),
    ],
)
def test_layouts(page, text):
    assert html_text.main_text(page) == text.strip()


def test_extraction_of_odd_tables(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>a", 2), (3, "v", f"<p>{LONG_TEXT * 2000}", 3), (4, "", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((str(r["page_id"]), r["url"], r["n_chars"]) for r in html_text.extracted(pages).collect())
    assert got == [("1", "u", 0), ("1", "u", 0), ("3", "v", len(LONG_TEXT) * 2000 - 1), ("4", "", 0), ("None", None, 1)]
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_sharding(spark, edge, none):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    sizes = collections.Counter(table)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 25
    got = sharding.placed(edge).collect()
    assert len(got) == 12 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1 and sharding.placed(none).count() == 0
    clash = sharding.placed(edge.select("doc_id", "shard"), key="shard")
    assert clash.columns[0] == "shard" and len(set(clash.columns)) == 3 and clash.count() == 12
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_pipeline(spark):
    import corpus_pipeline

    seen = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = seen.columns, [seen.count()]
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, SF).cache()
        counts.append(seen.count())
        assert name == "bpe_encode" or seen.columns == columns
    assert counts[0] >= counts[1] > counts[2] >= counts[3] and seen.where("not round_trip").count() == 0
    run = corpus_pipeline.run(spark, SF)
    assert rows_of(run.columns, [tuple(r) for r in run.collect()]) == rows_of(seen.columns, [tuple(r) for r in seen.collect()])


def brute_pipeline(spark, rows, schema):
    """The pipeline's rows by plain Python over lists of dicts: no stage, no operator of it."""
    import re
    import zlib

    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from tests.llm.test_near import brute

    # language: out-of-place ranks of all labelled rows that are not held out
    learned = collections.defaultdict(collections.Counter)
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2):
            learned[r["lang"]].update(brute_counts(r["text"]))
    ranks = {name: {k: i for i, k in enumerate(brute_profile(counts, 400))} for name, counts in sorted(learned.items())}
    known = []
    for r in rows:
        mine = brute_profile(r["text"] or "", 400)
        if mine:
            far = {name: sum(min(400, abs(own[k] - i)) if k in own else 400 for i, k in enumerate(mine)) for name, own in ranks.items()}
            known.append(r | {"lang": min(far, key=far.get)})
    # exact copies: the longest stays, then the smallest id
    groups = collections.defaultdict(list)
    for r in known:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"])].append(r)
    single = [min(g, key=lambda r: (-len(r["text"]), r["doc_id"])) for g in groups.values()]
    # near copies: the smallest id of each class, over all pairs
    lead = brute([(r["doc_id"], r["text"]) for r in single])
    apart = [r for r in single if lead[r["doc_id"]] == r["doc_id"]]
    # mix: word by word, in the order of a hash of the row
    df = spark.createDataFrame([tuple(r.values()) for r in apart], schema)
    keys = mixing.keys_of([F.col(c) for c in df.columns])
    hashes = {r["doc_id"]: r["h"] % 2**64 for r in df.select("doc_id", F.xxhash64(F.lit(3), *keys).alias("h")).collect()}
    edges = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"])] for r in apart]
    draws = brute_draws([(hashes[r["doc_id"]], r["source"], len(e)) for r, e in zip(apart, edges, strict=True)], 4096)
    taken = collections.defaultdict(set)
    for drawn in draws.values():
        for turn, words in drawn:
            for r, w in words:
                taken[r, turn].add(w)
    # ids by the library
    library, out = Tokenizer.from_file(str(PATH)), []
    for (r, _), words in taken.items():
        text = apart[r]["text"]
        if len(words) < len(edges[r]):
            starts = sorted(w for w in words if w - 1 not in words)
            ends = sorted(w for w in words if w + 1 not in words)
            text = " ".join(text[edges[r][a][0] : edges[r][b][1]] for a, b in zip(starts, ends, strict=True))
        ids = library.encode(text, add_special_tokens=False).ids
        out.append((apart[r]["doc_id"], apart[r]["lang"], apart[r]["source"], ids, len(ids), library.decode(ids, skip_special_tokens=False) == text))
    return [len(known), len(single), len(apart)], out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    letters = {"en": "abcdefghij", "de": "fghijklmnoö", "fr": "lmnopqrsté"}
    vocabulary = {x: ["".join(rnd.choices(own, k=rnd.randint(2, 8))) for _ in range(700)] for x, own in letters.items()}
    rows = []

    def add(text, lang, source):
        n = len(rows)
        rows.append({"doc_id": n * 7 % 1009, "text": text, "lang": lang, "source": source, "n_chars": n, "rep": 1, "shard": None, "ids": "x"})

    for n in range(90):
        lang = rnd.choice(list(letters))
        source = rnd.choice(["hot", "hot", "hot", "b", None, "", "c"])
        words = rnd.choices(vocabulary[lang], k=rnd.choice([1, 4, 5, 60, 150, 300, 9000 if n == 40 else 80]))
        add(" ".join(words), rnd.choice([lang, lang, lang, None]), source)
        if n % 3 == 0:  # an exact copy but for white space
            add("\n".join(words) + "  " * (n % 2), lang, "b")
        if n % 4 == 0:  # near copies: a word changed, a paragraph added, another text
            add(" ".join([*words[:-3], "other", *words[-2:]]), lang, "hot")
            add(" ".join([*words, *rnd.choices(vocabulary[lang], k=len(words) // 20)]), None, "c")
            add(" ".join([*words[: len(words) // 2], *rnd.choices(vocabulary[lang], k=len(words) // 2 + 1)]), lang, None)
    for text in (None, "", " \t", "12 34", "日本語 🙂", "a <|endoftext|> b"):
        add(text, None, "hot")
    rows += [rows[3], rows[3]]
    schema = DOC + ", ids string"
    spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    counts, want = brute_pipeline(spark, rows, schema)
    assert len(rows) > counts[0] > counts[1] > counts[2]
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    # an empty table gives none
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"] and empty.count() == 0
