"""Small tables with values worked out by hand."""

from collections import Counter
from math import sqrt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.functions import cleaning, tokens
from turnwise.operators import alignment, statistics, surrogates, turns
from turnwise.plans import pipeline
from turnwise.sources import conversations, sinks


def frame(spark, *rows):
    return spark.createDataFrame([("f.txt", i, p, c) for i, (p, c) in enumerate(rows)], "source_file string, turn long, participant string, content string")


def one(spark, expression, text):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, cleaned",
    [("a\nb", "ab"), ("i um uh um go", "i uh go"), ("mama said", " said"), ("momma said", "momma said"), ("ham and moo", "ham and moo"), ("Über-Cool 7", "bercool ")],
)
def test_cleaning(spark, text, cleaned):
    assert one(spark, cleaning.cleaned, text) == cleaned


def test_list_and_modes(spark):
    assert one(spark, lambda c: cleaning.cleaned(c, "list", ["um"]), "i um go") == "i go"
    with pytest.raises(ValueError):
        cleaning.cleaned(None, "other")


@pytest.mark.parametrize("text, out", [("can't've", "cannot've"), ("rabbit's", "rabbit is"), ("they'd go", "they would go"), ("no change", "no change")])
def test_contractions(spark, text, out):
    assert one(spark, tokens.expanded, text) == out


@pytest.mark.parametrize(
    "text, out",
    [("don't", "do n't"), ("cannot cannot", "can not can not"), ("the dogs' bone", "the dogs ' bone"), ("gimme it", "gim me it"), ("she'll go", "she 'll go"), ("", ""), ("  a  b ", "a b")],
)
def test_tokens(spark, text, out):
    assert one(spark, tokens.words, text) == out.split()


def test_merging(spark):
    t = frame(spark, ("a", "x"), ("a", "y"), ("a", "z"), ("b", "w"), (None, "n"), (None, "m"), ("a", "v"))
    got = [tuple(r) for r in turns.merge_adjacent(t).orderBy("turn").select("turn", "participant", "content").collect()]
    assert got == [(0, "a", "x y z"), (1, "b", "w"), (2, None, "n"), (3, None, "m"), (4, "a", "v")]


def test_pairs_keep_their_tail(spark):
    t = frame(spark, ("a", "x"), ("b", "y"), ("a", "z"))
    got = [(r["content1"], r["content2"], r["utter_order"]) for r in turns.lag_pairs(t, ["content"], 2).orderBy("time").collect()]
    assert got == [("x", "z", "a a"), ("y", None, None), ("z", None, None)]
    assert turns.lag_pairs(t, ["content"], 9, drop_tail=True).count() == 0
    with pytest.raises(ValueError):
        turns.lag_pairs(t, ["content"], 0)


def test_equal_turns_score_no_syntax(spark):
    out = alignment.lexsyn(pipeline.prepare(frame(spark, ("a", "the dog runs"), ("b", "the dog runs"), ("a", "cats sleep")))).orderBy("time").collect()
    assert out[0]["lexical_tok1_cosine"] == pytest.approx(1) and out[0]["pos_tok1_cosine"] == 0.0
    assert out[1]["lexical_master_cosine"] == 0.0 and out[2]["lexical_tok1_cosine"] is None


def counted(a, b):
    a, b = Counter(a), Counter(b)
    return sum(n * b[x] for x, n in a.items()) / (sqrt(sum(n * n for n in a.values())) * sqrt(sum(n * n for n in b.values()))) if a and b else 0.0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=6)), min_size=1, max_size=20))
def test_bag_cosine_is_that_of_counters(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["cosine"] for r in alignment.exploded_cosine(df, ["i"], "a", "b").collect()}
    assert all(got[i] == pytest.approx(counted(a, b)) for i, (a, b) in enumerate(pairs))


def test_surrogates(spark):
    rows = [(f"dyad{k}-cond{c}.txt", t, s, f"{k}{t}") for k, c, n in ((1, 1, 4), (2, 1, 6), (3, 10, 4)) for t, s in zip(range(n), "abababab", strict=False)]
    t = spark.createDataFrame([*rows, ("noise.txt", 0, "a", "x")], "source_file string, turn long, participant string, content string")
    assert surrogates.file_pairs(surrogates.files(t)).count() == 1  # cond1 is not cond10
    made = surrogates.surrogates(t)
    assert made.count() == 2 * 4 * 2 and {r[0] for r in made.select("source_file").distinct().collect()} == {"SurrogatePair-dyad1A-dyad2B-cond1.txt", "SurrogatePair-dyad2A-dyad1B-cond1.txt"}
    first = [r["content"] for r in made.where("source_file like '%dyad1A%'").orderBy("turn").collect()]
    assert first[:4] == ["10", "20", "11", "21"]
    again = [sorted(tuple(r) for r in surrogates.surrogates(t.repartition(n), keep_order=False, seed=3).collect()) for n in (1, 5)]
    assert again[0] == again[1]
    with pytest.raises(ValueError):
        surrogates.check_enough(t.where("source_file = 'noise.txt'"))


def test_statistics(spark):
    assert statistics.p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert statistics.p_value(0.0, 5) == pytest.approx(1)
    a, b = (spark.createDataFrame([(float(x),) for x in v], "m double") for v in ((1, 2, 3, 4), (0, 1, 2, 3)))
    row = statistics.with_p_values(statistics.compare(a, b, ["m"])).first()
    assert row["t_statistic"] == pytest.approx(1.0954451) and row["cohens_d"] == pytest.approx(0.7745967) and row["effect"] == "medium"
    assert row["p_value"] == pytest.approx(0.3153, abs=1e-3)


def test_tsv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("participant\tcontent\tmood\ncgv\thello \"you\"\tok\nkid\t\t\n\nkid\tNA\tx\n")
    (tmp_path / "b.txt").write_text("speaker\tcontent\nx\ty\n")
    (tmp_path / "c.txt").write_text("participant\tcontent\n")
    (tmp_path / "d.txt").write_text("")
    got = conversations.read_tsv(spark, str(tmp_path)).orderBy("turn").collect()
    assert [(r["source_file"], r["turn"], r["participant"], r["content"], r["mood"]) for r in got] == [("a.txt", 0, "cgv", 'hello "you"', "ok"), ("a.txt", 1, "kid", None, None), ("a.txt", 2, "kid", None, "x")]
    only = conversations.read_tsv(spark, str(tmp_path), required=["content"], more=[]).where("source_file = 'b.txt'")
    assert [tuple(r) for r in only.collect()] == [("b.txt", 0, "y")]


def test_tsv_with_quotes_as_pandas_reads_it(spark, tmp_path):
    import pandas as pd

    text = 'content\tparticipant\n"he said ""hi"""\ta\nNA\tb\n"a tab\there"\tc\n"two\nlines"\td\nmid "quote"\te\n""\tf\nnull\tg\r\n"x"y\th\n\n"last"\ti'
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "f.txt").write_bytes(text.encode())
    (tmp_path / "two" / "f.txt").write_bytes(b"participant\tcontent\nz\tother\n")
    got = conversations.read_tsv(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).orderBy("source_file", "turn").collect()
    want = pd.read_csv(tmp_path / "one" / "f.txt", sep="\t")
    assert [(r["participant"], r["content"]) for r in got if r["source_file"] == "one/f.txt"] == [(p, None if pd.isna(c) else c) for p, c in zip(want["participant"], want["content"], strict=True)]
    assert [(r["source_file"], r["content"]) for r in got][-1] == ("two/f.txt", "other")


def test_models_plug_in(spark):
    from turnwise.functions import morphology
    from turnwise.operators import embeddings

    t = frame(spark, ("a", "the dog runs"), ("b", "a cat"), ("a", "  "), ("b", "the dog runs"))
    tagger = morphology.model_tagger(lambda: lambda lists: [[w.upper() for w in x] for x in lists])
    own = pipeline.prepare(t, extra_taggers={"spacy": tagger}, min_words=0)
    row = own.where("turn = 0").first()
    assert [tuple(x) for x in row["tagged_spacy_token"]] == [("the", "THE"), ("dog", "DOG"), ("runs", "RUNS")]
    assert alignment.tagger_of(own) == "spacy" and turns.in_transcript_order(own).columns[:2] == ["participant", "content"]
    scored = alignment.in_result_order(alignment.lexsyn(own, taggers=("", "spacy"))).columns
    assert scored[:4] == ["time", "source_file", "participant", "content"]
    at = scored.index("lexical_tok2_cosine")
    assert scored[at : at + 8] == ["lexical_tok2_cosine", "lexical_lem2_cosine", "pos_tok2_cosine", "pos_lem2_cosine", "spacy_pos_tok2_cosine", "spacy_pos_lem2_cosine", "lexical_master_cosine", "syntactic_master_cosine"]
    encoder = embeddings.model_encoder(lambda: lambda texts: [[len(x), 1.0] for x in texts])
    pairs = embeddings.contextual_similarity(t, encoder).orderBy("time").collect()
    assert pairs[0]["encoder_cosine_similarity"] == pytest.approx((12 * 5 + 1) / sqrt(145 * 26))
    assert pairs[1]["encoder_cosine_similarity"] is None and pairs[2]["encoder_cosine_similarity"] is None


def test_one_file_runs_and_writers(spark, tmp_path):
    rows = [(f"dyad{k}-cond1.txt", i, "ab"[i % 2], c) for k in (1, 2) for i, c in enumerate(["the dog runs", "a dog sat", "the cat runs"])]
    own = pipeline.prepare(spark.createDataFrame(rows, "source_file string, turn long, participant string, content string"))
    one = pipeline.analyze_file(own, "dyad1-cond1.txt")
    assert {r["source_file"] for r in one.collect()} == {"dyad1-cond1.txt"} and one.count() == 3
    means = {r["run"]: (r["n"], r["mean"]) for r in statistics.compare_runs({"x": one, "y": pipeline.analyze(own)}, "lexical_tok1_cosine").collect()}
    assert means["x"][0] == 2 and means["y"][0] == 4 and means["x"][1] == pytest.approx(means["y"][1])
    sinks.write_surrogates(surrogates.surrogates(own), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).select("source_file").distinct().count() == 2
    with pytest.raises(ValueError):
        sinks.write_surrogates(surrogates.surrogates(own).limit(0), str(tmp_path / "t"))
    sinks.write_csv(one, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.count() == 3 and "lexical_master_cosine" in back.columns
    sinks.write_vocabulary(spark.createDataFrame([("a", 1), ("b", 3)], "word string, count long"), str(tmp_path / "v"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "v")).first()["word"] == "b"


def test_vectors_lists_and_names(spark, tmp_path):
    (tmp_path / "v.vec").write_text("2 3\ncat 1 2 3\ndog 0 1 0\n")
    assert [(r[0], r[1]) for r in conversations.read_vectors(spark, str(tmp_path / "v.vec")).orderBy("word").collect()] == [("cat", [1, 2, 3]), ("dog", [0, 1, 0])]
    assert one(spark, conversations.list_of_words, """['a', "b's", 'c\\'d']""") == ["a", "b's", "c'd"]
    assert one(spark, conversations.list_of_words, "nonsense") == []
    assert sinks.merged_name() == "merged-lag1-ngram2-noAdd-noDups-sd3-n1.csv"
    assert sinks.lexsyn_name(tagger="stan") == "lexsyn_alignment_ngram2_lag1_noDups_withStan.csv"


def test_binary_vectors(spark, tmp_path):
    import gzip

    import numpy as np

    rows = [(f"w{i}é", [float(i), -0.5, i / 4]) for i in range(50)]
    raw = b"50 3\n" + b"".join(w.encode() + b" " + np.array(v, "<f4").tobytes() + b"\n" for w, v in rows)
    (tmp_path / "a.bin").write_bytes(raw)
    (tmp_path / "b.bin.gz").write_bytes(gzip.compress(raw.replace(b"\nw", b"w")[:4] + raw[4:]))
    for name in ("a.bin", "b.bin.gz"):
        got = conversations.read_binary_vectors(spark, str(tmp_path / name), batch=7).collect()
        assert [(r["word"], list(r["vector"])) for r in got] == rows
    (tmp_path / "c.bin").write_bytes(raw[:-9])
    with pytest.raises(Exception, match="ends early"):
        conversations.read_binary_vectors(spark, str(tmp_path / "c.bin")).collect()


def test_words_get_the_vector_of_their_rank(spark):
    from turnwise.operators import embeddings

    counts = [("ab", 3), ("abc", 3), ("a", 3), ("b", 9), ("éa", 1), ("z", 1), ("abd", 3), ("", 1)]
    order = [w for w, _ in sorted(counts, key=lambda x: (-x[1], x[0].encode()))]
    for n in (3, 8, 20):
        vectors = spark.createDataFrame([(i, [float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
        got = embeddings.ranked_vectors(spark.createDataFrame(counts, "word string, count long").repartition(3), vectors).collect()
        assert {r["word"]: r["vector"][0] for r in got} == {w: float(i) for i, w in enumerate(order[:n])}


def test_half_of_the_pairs(spark):
    import hashlib
    from itertools import combinations

    names = [(f"dyad{i}-cond{c}.txt", f"dyad{i}", f"cond{c}") for c, n in ((1, 30), (2, 3), (3, 1), (4, 6)) for i in range(n)]
    named = spark.createDataFrame(names, "source_file string, dyad string, condition string")
    want, every = set(), set()
    for c in ("cond1", "cond2", "cond3", "cond4"):
        pairs = list(combinations(sorted(f for f, _, k in names if k == c), 2))
        every |= set(pairs)
        want |= set(sorted(pairs, key=lambda p: (hashlib.md5("|".join(("5", *p)).encode()).hexdigest(), p))[: -(-len(pairs) // 2)])
    assert {(r["file1"], r["file2"]) for r in surrogates.file_pairs(named).collect()} == every
    got = [(r["file1"], r["file2"]) for r in surrogates.file_pairs(named, sample=True, seed=5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_encodings_are_kept(spark, tmp_path):
    from pyspark.sql import functions as F

    from turnwise.operators import embeddings

    path, asked = str(tmp_path / "kept"), []
    t = frame(spark, ("a", "one two"), ("b", "three"), ("a", "one two"), ("b", None))
    first = {r["content"]: r["_vector"] for r in embeddings.with_encoding(t, cache=path).collect()}
    assert first["one two"][4] == 1 and first[None] is None and spark.read.parquet(path).count() == 2

    def other(content):
        asked.append(content)
        return F.array(F.lit(7.0))

    more = frame(spark, ("a", "one two"), ("b", "four"))
    again = {r["content"]: r["_vector"] for r in embeddings.with_encoding(more, other, path).collect()}
    assert again == {"one two": first["one two"], "four": [7.0]} and spark.read.parquet(path).count() == 3
    assert pipeline.analyze(more, analyzers="contextual", cache=path).count() == 2


def test_states_and_their_mean(spark):
    from pyspark.sql import functions as F

    from turnwise.operators import embeddings

    encode = embeddings.model_states(lambda: lambda texts: [[[float(i), 1.0] for i in range(len(x))] for x in texts], most=4)
    df = spark.createDataFrame([("abc",), ("abcdefgh",), (" ",), (None,)], "t string").select("t", encode("t").alias("s"))
    got = {r["t"]: (r["s"], r["m"]) for r in df.select("t", "s", embeddings.mean_state(F.col("s")).alias("m")).collect()}
    assert got["abc"] == ([[0, 1], [1, 1], [2, 1]], [1.0, 1.0]) and len(got["abcdefgh"][0]) == 4 and got["abcdefgh"][1] == [1.5, 1.0]
    assert got[" "] == (None, None) and got[None] == (None, None)


def test_columns_of_results(spark):
    from turnwise.operators import embeddings

    own = pipeline.prepare(frame(spark, ("a", "the dog runs"), ("b", "a cat sat")))
    out = embeddings.in_static_order(embeddings.static_similarity(own, None))
    assert not [c for c in out.columns if c.startswith("tagged")]
    assert out.columns[-4:] == ["static_cosine_similarity", "token_static_cosine_similarity", "lemma_static_cosine_similarity", "master_static_cosine_similarity"]
    out = embeddings.in_contextual_order(embeddings.contextual_similarity(own, keep_vectors=True))
    assert out.columns == ["source_file", "participant", "content", "lag", "content1", "content2", "utter_order", "content1_embedding_encoder", "content1_embedding_encoder_dims", "content2_embedding_encoder", "content2_embedding_encoder_dims", "encoder_cosine_similarity"]


def test_surrogates_that_are_not_there(spark, tmp_path):
    with pytest.raises(ValueError, match="no folder"):
        conversations.read_surrogates(spark, str(tmp_path / "none"))
    (tmp_path / "a.txt").write_text("participant\tcontent\n")
    with pytest.raises(ValueError, match="no surrogates"):
        conversations.read_surrogates(spark, str(tmp_path))
    (tmp_path / "b.txt").write_text("participant\tcontent\nx\ty\n")
    assert conversations.read_surrogates(spark, str(tmp_path)).count() == 1


def test_settings(tmp_path, monkeypatch):
    from turnwise.sources import settings as own

    file = str(tmp_path / "new" / "s.json")
    with pytest.warns(UserWarning):
        assert own.lookup("token", file=file) is None
    own.keep("other", "1", file)
    own.keep("token", "filed", file)
    assert own.lookup("token", file=file) == "filed" and own.lookup("other", file=file) == "1"
    monkeypatch.setenv("SOME_TOKEN", "named")
    assert own.lookup("token", variable="SOME_TOKEN", file=file) == "named" and own.lookup("token", "given", "SOME_TOKEN") == "given"


@pytest.mark.parametrize(
    "text, lemmas, tags",
    [
        ("the dogs were running quickly", "the dog be run quickly", "DT NNS VBD VBG RB"),
        ("she tried boxes and churches", "she try box and church", "PRP VBD NNS CC NNS"),
        ("my nicest wolves can not agree", "my nic wolf can not agree", "PRP$ JJS NNS MD RB NN"),
        ("to be famous is useful oh", "to be famous be useful oh", "TO VB JJ VBZ JJ UH"),
        ("this thing has stopped as women sang", "this thing have stop as woman sang", "DT VBG VBZ VBD IN NN NN"),
        ("does this need planning", "do this need plan", "VBZ DT VBP VBG"),
    ],
)
def test_rules_of_words(spark, text, lemmas, tags):
    from turnwise.functions import morphology

    assert one(spark, lambda c: morphology.rule_tags(tokens.words(c)), text) == tags.split()
    assert one(spark, lambda c: morphology.rule_lemmas(tokens.words(c)), text) == lemmas.split()


def test_options():
    with pytest.raises(ValueError):
        pipeline.PrepareOptions(filler_mode="x")
    with pytest.raises(ValueError):
        pipeline.AnalyzeOptions(analyzers="bag").chosen()
    assert pipeline.AnalyzeOptions(analyzers="all").chosen() == ["lexsyn", "static", "contextual"]


def test_entry_without_the_optional_folder(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("turnwise.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "turnwise.llm", None)
    assert "lexsyn_master" in e.queries() and not any(k.startswith("op") for k in e.queries())


def test_no_row_of_a_pair_is_moved(spark, monkeypatch):
    names = [f"dyad{i}-cond{i % 2}.txt" for i in range(24)]
    rows = [(f, t, "ab"[t % 2], f"{f}{t}") for i, f in enumerate(names) for t in range(2 + i % 5)]
    t = spark.createDataFrame([*rows, ("dyad99-cond0.txt", 0, None, "x")], "source_file string, turn long, participant string, content string")
    found = []
    for block in (512, 3):
        monkeypatch.setattr(surrogates, "BLOCK", block, raising=False)
        for order in (True, False):
            made = surrogates.surrogates(t, keep_order=order, all_pairs=order, seed=3)
            above = made._jdf.queryExecution().executedPlan().toString().partition("Join")[0]
            assert "Exchange" not in above.replace("Exchange hashpartitioning(condition", "") and "_name" not in "".join(x for x in above.splitlines() if "Window" in x)
            found.append(sorted(tuple(r) for r in made.collect()))
        # a condition is dealt out over many tasks, though its files are few bytes
        assert block == 512 or surrogates.met(surrogates.files(t)).rdd.getNumPartitions() >= 30
    assert found[0] == found[2] and found[1] == found[3]
    turns_of = {}
    for r in found[0]:
        turns_of.setdefault(r[0], []).append(r[1])
    assert len(turns_of) == 2 * 2 * 66 and all(sorted(v) == list(range(len(v))) for v in turns_of.values())


def test_surrogates_of_one_name_keep_their_turns_apart(spark):
    rows = [(f, t, "ab"[t % 2], f"{f}{t}") for f in ("dyad1-cond1-x.txt", "dyad1-cond1-y.txt", "dyad2-cond1.txt") for t in range(4)]
    made = surrogates.surrogates(spark.createDataFrame(rows, "source_file string, turn long, participant string, content string")).collect()
    assert len(made) == 3 * 2 * 8 and len({(r["source_file"], r["turn"]) for r in made}) == len(made)


def test_lexical_scores_of_surrogates_that_are_not_made(spark, monkeypatch):
    import random

    from turnwise.operators import chance

    monkeypatch.setattr(surrogates, "BLOCK", 3, raising=False)
    monkeypatch.setattr(chance, "SPARSE", 5)
    draw = random.Random(5)
    rows = [(f"dyad{i}-cond{i % 2}.txt", t, draw.choice("abc"), " ".join(draw.choices(["the", "dogs", "ran", "cats", "sat", "on", "it's"], k=draw.randint(0, 6)))) for i in range(13) for t in range(draw.randint(1, 9))]
    own = pipeline.prepare(spark.createDataFrame(rows, "source_file string, turn long, participant string, content string"), min_words=0)
    for n, lag in ((2, 1), (1, 3)):
        made = pipeline.lexical_baseline(own, max_ngram=n, lag=lag)
        assert "_name" not in made._jdf.queryExecution().executedPlan().toString()
        wanted = pipeline.baseline(own, max_ngram=n, lag=lag).select(*made.columns)
        got, want = ({(r[0], r[1]): tuple(r)[2:] for r in x.collect()} for x in (made, wanted))
        assert len(got) > 200 and got == want


def test_two_edits_only_where_one_finds_nothing(spark):
    from turnwise.operators import spelling

    model = spark.createDataFrame([("stone", 2), ("store", 9), ("tsoen", 50), ("abcd", 3)], "word string, n long")
    words = spark.createDataFrame([("stonx",), ("tsone",), ("bdac",), ("badc",), ("xxbcd",), ("stone",)], "word string")
    made = spelling.corrections(words, model)
    assert dict(made.collect()) == {"stonx": "stone", "tsone": "tsoen", "bdac": "bdac", "badc": "abcd", "xxbcd": "abcd", "stone": "stone"}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


def test_encodings_come_to_turns_that_stay(spark):
    from pyspark.sql import functions as F

    from turnwise.operators import embeddings

    t = turns.dealt(frame(spark, ("a", "one two"), ("b", "three"), ("a", "one two"), ("b", None)).withColumn("heavy", F.lit("x")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = embeddings.with_encoding(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x for x in plan.splitlines() if "hashpartitioning(content" in x and "heavy" in x]
    left = plan[plan.index("SortMergeJoin [source_file") :].splitlines()[1:4]
    assert "REPARTITION_BY_NUM" in "".join(left) and "ENSURE_REQUIREMENTS" not in "".join(left)


def test_turns_are_pooled_in_as_many_places_as_the_input_is_large(spark, tmp_path, monkeypatch):
    from turnwise.operators import embeddings

    rows = [(f"f{i % 7}", i // 7, "ab"[i // 7 % 2], " ".join(("one two", "two three three", "none")[(i + j) % 3] for j in range(i % 4))) for i in range(70)]
    spark.createDataFrame(rows, "source_file string, turn long, participant string, content string").write.parquet(str(tmp_path / "t"))
    vectors = {"one": [1.0, 0.0], "two": [0.0, 2.0], "three": [4.0, 4.0]}
    known = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    monkeypatch.setattr(turns, "PART_BYTES", 40, raising=False)
    own = turns.tokenize(turns.dealt(spark.read.parquet(str(tmp_path / "t"))))
    assert own.rdd.getNumPartitions() > 20  # 8 are set
    pooled = embeddings.mean_pooled(own, known, {"v": "token", "w": embeddings.content_tokens(own["content"])}, 2)
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "hashpartitioning(source_file" in x and "turn" in x]  # no sums of parts of a turn
    found = {(r["source_file"], r["turn"]): (r["v"], r["w"]) for r in pooled.collect()}
    assert len(found) == 70
    for f, t, _, content in rows:
        some = [vectors[w] for w in content.split() if w in vectors]
        mean = [sum(x) / len(some) for x in zip(*some, strict=True)] if some else None
        assert found[f, t] == (mean and pytest.approx(mean), mean and pytest.approx(mean))


def test_scores_of_a_batch_are_those_of_columns(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from turnwise.functions import bags, similarity

    random.seed(5)
    some = lambda words: [random.choice(words) for _ in range(random.randrange(6))]
    for words in (["a", "b", "ab", ""], ["a", "b", "a b", None]):  # the second kind is counted pair by pair
        rows = []
        for i in range(60):
            lists = [some(words) if random.random() < 0.9 else None for _ in "12"]
            tagged = [x and [(w, random.choice(["N", "V", words[3]])) for w in x] for x in lists]
            rows.append((i, *lists, *lists, *tagged, *tagged))
        lists, kind = [f"{c}{s}" for c in ("token", "lemma") for s in "12"], "array<struct<word:string,tag:string>>"
        schema = ", ".join(["time int", *[f"{c} array<string>" for c in lists], *[f"tagged_{c} {kind}" for c in lists]])
        df = spark.createDataFrame(rows, schema)
        monkeypatch.setattr(bags, "ROWS", 7)
        for ignore in (True, False):
            made = alignment.lexsyn_metrics(df, 3, ignore)
            assert str(made._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
            found = {r["time"]: r for r in made.collect()}
            for n in (1, 2, 3):
                keys, tags = ([similarity.ngrams(F.transform(f"tagged_token{s}", f), n) for s in "12"] for f in (lambda x: F.concat(x["word"], F.lit("/"), x["tag"]), lambda x: x["tag"]))
                one, two = (F.zip_with(k, t, lambda k, t: F.struct(k.alias("key"), t.alias("tags"))) for k, t in zip(keys, tags, strict=True))
                if ignore:
                    shared = F.array_intersect(*keys)
                    one, two = similarity.lacking(one, shared), similarity.lacking(two, shared)
                full = (F.size("token1") > 0) & (F.size("token2") > 0)
                words_cosine = similarity.bag_cosine(*(similarity.ngrams(F.col(f"token{s}"), n) for s in "12"))
                tags_cosine = similarity.bag_cosine(*(F.transform(x, lambda y: y["tags"]) for x in (one, two)))
                for r in df.select("time", F.when(full, words_cosine).alias("w"), F.when(full, tags_cosine).alias("t")).collect():
                    assert (r["w"], r["t"]) == (found[r["time"]][f"lexical_tok{n}_cosine"], found[r["time"]][f"pos_tok{n}_cosine"])
