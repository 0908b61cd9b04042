"""The queries of catalog.py in DuckDB's SQL."""

from __future__ import annotations

from turnwise.functions.cleaning import FILLER_STEPS
from turnwise.functions.morphology import class_sql, lemma_sql, tag_sql
from turnwise.functions.tokens import CONTRACTION, CONTRACTIONS, TOKEN_RULES

FILLERS = ("the", "de", "und", "die", "in", "la")
#: What the queries on contractions put in for frequent words.
APOSTROPHES = ((" the ", " can't've "), (" le ", " rabbit's it's "), (" die ", " they'd've "), (" la ", " y'all'd "), (" und ", " cannot gimme cannot "), (" of ", " dogs' "), (" and ", " 'twas "))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def letters(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^a-zA-Z'' ]', '', 'g'))"


def no_pattern(x: str) -> str:
    for step in FILLER_STEPS:
        x = f"regexp_replace({x}, {q(step)}, ' ', 'g')"
    return x


def no_list(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w not in ({', '.join(map(q, FILLERS))})), ' ')"


def words(x: str) -> str:
    x = f"'  ' || replace({x}, ' ', '  ') || '  '"
    for pattern, to in TOKEN_RULES:
        x = f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def expanded(x: str) -> str:
    long = "case f[i] " + " ".join(f"when {q(k)} then {q(v)}" for k, v in CONTRACTIONS.items()) + " else '' end"
    return f"(select array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce({long}, '')), '') from (select regexp_split_to_array({x}, {q(CONTRACTION)}) as p, regexp_extract_all({x}, {q(CONTRACTION)}) as f))"


def grams(x: str, n: int) -> str:
    return x if n == 1 else f"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


def cosine(a: str, b: str) -> str:
    count = lambda v, x: f"len(list_filter({v}, lambda y: y = {x}))"
    total = lambda u, v: f"coalesce(list_sum(list_transform({u}, lambda x: {count(v, 'x')})), 0)"
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else {total(a, b)} / (sqrt({total(a, a)}::double) * sqrt({total(b, b)}::double)) end"


TURNS = "turns as (select 'dyad' || conv_id || '-cond' || (conv_id % 25) || '.txt' as source_file, turn, role as participant, text as content from conversations)"
USERS = "users as (select source_file, turn, case when participant = 'system' then 'user' else participant end as participant, content from turns)"


def clean(source: str, least: int, text: str | None = None) -> str:
    text = text or no_pattern(letters("content"))
    some = f" where len({words('content')}) >= {least}" if least else ""
    return f"clean as (select * from (select source_file, turn, participant, {text} as content from {source} where content is not null){some})"


MERGED = """marked as (select *, coalesce(participant <> lag(participant) over f, true)::int as new from clean window f as (partition by source_file order by turn)),
islands as (select *, sum(new) over (partition by source_file order by turn) as island from marked),
merged as (select source_file, row_number() over (partition by source_file order by island) - 1 as turn, participant, content from (
  select source_file, island, first(participant order by turn) as participant, string_agg(content, ' ' order by turn) as content from islands group by source_file, island))"""
TOKENS = f"tokens as (select *, case when contains(content, '''') then {words(expanded('content'))} else {words('content')} end as token from merged)"
LEMMAS = f"lemmas as (select *, list_transform(token, lambda w: {lemma_sql('w')}) as lemma, list_transform(token, lambda w: {tag_sql('w')}) as tag_tok from tokens)"
TAGS = f"prepared as materialized (select *, list_transform(lemma, lambda w: {tag_sql('w')}) as tag_lem from lemmas)"
PREPARED = ",\n".join((TURNS, USERS, clean("users", 2), MERGED, TOKENS, LEMMAS, TAGS))


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def paired(source: str, lag: int, *columns: str) -> str:
    both = ", ".join(f"{c} as {c}1, lead({c}, {lag}) over f as {c}2" for c in columns)
    return f"""pairs as materialized (select source_file, turn, row_number() over f as time, {lag} as lag, participant || ' ' || lead(participant, {lag}) over f as utter_order, {both} from {source} window f as (partition by source_file order by turn))"""


def lexical(short: str, n: int) -> str:
    name = {"tok": "token", "lem": "lemma"}[short]
    a, b = (grams(f"{name}{s}", n) for s in "12")
    return f"case when len({name}1) > 0 and len({name}2) > 0 then {cosine(a, b)} end"


def keyed(short: str, side: str, n: int) -> str:
    name = {"tok": "token", "lem": "lemma"}[short]
    return grams(f"list_transform(range(1, len({name}{side}) + 1), lambda k: {name}{side}[k] || '/' || tag_{short}{side}[k])", n)


def syntactic(short: str, n: int, ignore: bool) -> str:
    """Over the columns that pos_columns() made."""
    name = {"tok": "token", "lem": "lemma"}[short]
    return f"case when len({name}1) > 0 and len({name}2) > 0 then {cosine(f's_{short}{n}1', f's_{short}{n}2')} end"


def pos_columns(max_n: int, ignore: bool) -> str:
    keys, sides = [], []
    for n in range(1, max_n + 1):
        for short in ("tok", "lem"):
            for s, o in ("12", "21"):
                keys += [f"{keyed(short, s, n)} as k_{short}{n}{s}", f"{grams(f'tag_{short}{s}', n)} as t_{short}{n}{s}"]
                k, t = f"k_{short}{n}{s}", f"t_{short}{n}{s}"
                other = f"k_{short}{n}{o}"
                sides.append(f"list_transform(list_filter(range(1, len({k}) + 1), lambda i: not list_contains({other}, {k}[i])), lambda i: {t}[i]) as s_{short}{n}{s}" if ignore else f"{t} as s_{short}{n}{s}")
    return f"keyed as materialized (select *, {', '.join(keys)} from pairs),\nsided as materialized (select *, {', '.join(sides)} from keyed)"


ALL = ("content", "token", "lemma", "tag_tok", "tag_lem")
SHORT = ("tok", "lem")


def lexsyn(max_n: int = 2) -> str:
    lex = [(f"lexical_{s}{n}_cosine", lexical(s, n)) for n in range(1, max_n + 1) for s in SHORT]
    syn = [(f"pos_{s}{n}_cosine", syntactic(s, n, True)) for n in range(1, max_n + 1) for s in SHORT]
    some = [c for c, _ in syn if "1_" not in c]
    return with_(PREPARED, paired("prepared", 1, *ALL), pos_columns(max_n, True), f"scored as (select *, {', '.join(f'{x} as {c}' for c, x in lex + syn)} from sided)") + (
        f"select source_file, time, utter_order, coalesce(len(token1), 0) as utterance_length1, coalesce(len(token2), 0) as utterance_length2, {', '.join(f'round({c}, 6) as {c}' for c, _ in lex + syn)}, "
        f"round(({' + '.join(c for c, _ in lex)}) / {len(lex)}, 6) as lexical_master_cosine, round(({' + '.join(some)}) / {len(some)}, 6) as syntactic_master_cosine from scored"
    )


def pos(ignore: bool) -> str:
    return with_(PREPARED, paired("prepared", 1, *ALL), pos_columns(2, ignore)) + f"select source_file, time, {', '.join(f'round({syntactic(s, n, ignore)}, 6) as pos_{s}{n}_cosine' for n in (1, 2) for s in SHORT)} from sided"


def lagged(lag: int) -> str:
    return with_(PREPARED, paired("prepared", lag, "content", "token")) + "select source_file, time, lag, utter_order, content1, content2, coalesce(len(token1), 0) as utterance_length1, coalesce(len(token2), 0) as utterance_length2 from pairs"


def odd(x: str) -> str:
    for a, b in APOSTROPHES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return letters(x)


def corrected() -> str:
    cuts = "list_distinct(list_append(list_transform(range(1, len(word) + 1), lambda i: word[1:i - 1] || word[i + 1:]), word))"
    return with_(
        TURNS, clean("turns", 2), f"tokens as (select {words('content')} as token from clean)", "found as (select distinct unnest(token) as word from tokens)",
        "model as (select word, count(*) + 1 as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by word)",
        f"lost as (select word, unnest({cuts}) as cut from found where not contains(word, '''') and word not in (select word from model))",
        f"known as (select word as known, n, unnest({cuts}) as cut from model)",
        "best as (select word, arg_min(known, (-n, known)) as corrected from (select distinct word, known, n from lost join known using (cut)) where damerau_levenshtein(word, known) <= 1 group by word)",
    ) + "select word, coalesce(corrected, word) as corrected from found left join best using (word)"


def pairs_sql(sample: bool) -> str:
    base = """named as (select distinct source_file, regexp_extract(regexp_replace(source_file, '\\.txt$', ''), 'dyad[^-]*') as dyad, regexp_extract(regexp_replace(source_file, '\\.txt$', ''), '[^-]*cond[^-]*') as condition from turns),
all_pairs as (select a.condition, a.source_file as file1, b.source_file as file2, a.dyad as dyad1, b.dyad as dyad2 from named a join named b on a.condition = b.condition and a.source_file < b.source_file)"""
    if not sample:
        return base + ",\nfile_pairs as (select * from all_pairs)"
    return base + """,\nfile_pairs as (select condition, file1, file2, dyad1, dyad2 from (select *, row_number() over (partition by condition order by md5('7|' || file1 || '|' || file2), file1, file2) as r, count(*) over (partition by condition) as n from all_pairs) where r <= ceil(n / 2))"""


def surrogate(source: str, sample: bool = False, shuffle: bool = False, single: bool = False, extra: str = "") -> str:
    again = "row_number() over (partition by name, side, speaker order by md5('7|' || name || '|' || original_file || '|' || original_turn))" if shuffle else "i"
    return pairs_sql(sample) + f""",
spoken as (select *, dense_rank() over (partition by source_file order by participant) as speaker, row_number() over (partition by source_file, participant order by turn) as i from {source} where participant is not null),
speakers as (select source_file, speaker, count(*) as n from spoken group by source_file, speaker),
most as (select source_file, max(speaker) as k from speakers group by source_file),
used as (select p.*, least(a.k, b.k) as k from file_pairs p join most a on a.source_file = file1 join most b on b.source_file = file2),
cut as (select u.*, (select min(n) from speakers s where s.source_file in (u.file1, u.file2) and s.speaker <= u.k) as least_n from used u),
oriented as (select 'SurrogatePair-' || dyad1 || 'A-' || dyad2 || 'B-' || condition || '.txt' as name, condition, k, least_n, file1 as fa, file2 as fb from cut
  union all select 'SurrogatePair-' || dyad2 || 'A-' || dyad1 || 'B-' || condition || '.txt', condition, k, least_n, file2, file1 from cut),
sides as (select name, condition, k, least_n, fa as original_file, 0 as side from oriented union all select name, condition, k, least_n, fb, 1 from oriented),
rows_ as (select s.name, s.condition, s.side, s.original_file, t.turn as original_turn, t.participant, t.speaker, t.i{extra} from sides s join spoken t on t.source_file = s.original_file and t.speaker <= s.k and t.i <= s.least_n{' where t.speaker = s.side + 1' if single else ''}),
ordered as (select *, {again} as j from rows_),
surrogates as (select name as source_file, row_number() over (partition by name order by j, speaker, side) - 1 as turn, * exclude (name) from ordered)"""


SURROGATE = "select source_file, turn, participant, original_file, original_turn, condition from surrogates"
VOCAB = "counts as (select word, count(*) as count from (select unnest({}) as word from prepared) group by word)"
FILTERED = "lasting as (select * from counts where length(word) > 1 and count > {}), kept as (select * from lasting where count < (select avg(count) + {} * stddev_pop(count) from lasting))"
VECTORS = VOCAB.format("token") + ",\nranked as (select word, row_number() over (order by count desc, word) - 1 as vec_id from counts),\nvectors as (select word, embedding::double[] as v from ranked join embeddings using (vec_id))"


def pooled(name: str, items: str) -> str:
    return f"""{name}_words as (select source_file, turn, word, count(*) as n from (select source_file, turn, unnest({items}) as word from prepared) group by all),
{name}_at as (select source_file, turn, sum(n) over (partition by source_file, turn) as total, n, v from {name}_words join vectors using (word)),
{name}_sum as (select source_file, turn, place, sum(n * v[place]) / max(total) as x from {name}_at, range(1, 65) r(place) group by source_file, turn, place),
{name}_vec as (select source_file, turn, list(x order by place) as {name}_v from {name}_sum group by source_file, turn)"""


STATIC = ",\n".join((
    VECTORS, pooled("content", "list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')"), pooled("token", "token"), pooled("lemma", "lemma"),
    "pooled as materialized (select p.source_file, p.turn, content_v, token_v, lemma_v, participant from prepared p left join content_vec using (source_file, turn) left join token_vec using (source_file, turn) left join lemma_vec using (source_file, turn))",
    paired("pooled", 1, "content_v", "token_v", "lemma_v").replace("pairs as", "vec_pairs as", 1),
    "static as (select source_file, time, " + ", ".join(f"list_cosine_similarity({c}_v1, {c}_v2) as {n}" for c, n in (("content", "c"), ("token", "t"), ("lemma", "l"))) + " from vec_pairs)",
    "static_all as (select source_file, time, c, t, l, (coalesce(c, 0) + coalesce(t, 0) + coalesce(l, 0)) / nullif((c is not null)::int + (t is not null)::int + (l is not null)::int, 0) as m from static)",
))
LETTERS = "letters as materialized (select *, case when trim(content) <> '' then [" + ", ".join(f"(length(lower(content)) - length(replace(lower(content), '{c}', '')))::double" for c in "abcdefghijklmnopqrstuvwxyz") + "] end as enc from prepared)"
ENCODED = LETTERS + ",\n" + paired("letters", 1, "enc").replace("pairs as", "enc_pairs as", 1) + ",\nencoded as (select source_file, time, case when enc1 is not null and enc2 is not null then case when list_sum(enc1) = 0 or list_sum(enc2) = 0 then 0.0 else list_cosine_similarity(enc1, enc2) end end as e from enc_pairs)"
METRICS = ("lexical_tok1_cosine", "lexical_lem1_cosine", "lexical_master_cosine")


def scored(pairs: str, name: str) -> str:
    return f"{name} as materialized (select *, (lexical_tok1_cosine + lexical_lem1_cosine) / 2 as lexical_master_cosine from (select source_file, time, utter_order, {lexical('tok', 1)} as lexical_tok1_cosine, {lexical('lem', 1)} as lexical_lem1_cosine from {pairs}))"


ENOUGH = "enough as materialized (select * from prepared qualify count(*) over (partition by source_file) > 1)"
REAL = ",\n".join((PREPARED, ENOUGH, paired("enough", 1, "token", "lemma"), scored("pairs", "real")))
CHANCE = ",\n".join((surrogate("prepared", extra=", t.token, t.lemma"), "many as materialized (select * from surrogates qualify count(*) over (partition by source_file) > 1)", paired("many", 1, "token", "lemma").replace("pairs as", "chance_pairs as", 1), scored("chance_pairs", "chance")))
UNPIVOT = "select metric, value from ({}) unpivot (value for metric in (" + ", ".join(METRICS) + "))"


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


COMPARE = f"""rows_r as ({UNPIVOT.format('select ' + ', '.join(METRICS) + ' from real')}), rows_b as ({UNPIVOT.format('select ' + ', '.join(METRICS) + ' from chance')}),
sums as (select a.*, b.baseline_mean, b.baseline_std, coalesce(b.baseline_n, 0) as baseline_n from (select metric, avg(value) as real_mean, stddev_samp(value) as real_std, count(*) as real_n from rows_r group by metric) a
  left join (select metric, avg(value) as baseline_mean, stddev_samp(value) as baseline_std, count(*) as baseline_n from rows_b group by metric) b using (metric)),
more as (select *, real_mean - baseline_mean as difference, sqrt(((real_n - 1) * real_std ** 2 + (baseline_n - 1) * baseline_std ** 2) / nullif(real_n + baseline_n - 2, 0) * (1.0 / nullif(real_n, 0) + 1.0 / nullif(baseline_n, 0))) as error, sqrt((real_std ** 2 + baseline_std ** 2) / 2) as spread from sums),
done as (select *, case when baseline_mean > 0 then difference / baseline_mean * 100 else 0.0 end as percent_increase, case when error > 0 then difference / error end as t_statistic, case when spread > 0 then difference / spread end as cohens_d from more)"""

ORACLES = {
    "lexsyn_master": lexsyn(),
    "clean_text": with_(TURNS, clean("turns", 0)) + "select * from clean",
    "clean_letters": with_(TURNS, clean("turns", 0, letters("content"))) + "select * from clean",
    "filler_list": with_(TURNS, clean("turns", 0, no_list(letters("content")))) + "select * from clean",
    "filler_both": with_(TURNS, clean("turns", 0, no_list(no_pattern(letters("content"))))) + "select * from clean",
    "min_words": with_(TURNS, clean("turns", 12)) + "select * from clean",
    "adjacent_merge": with_(TURNS, USERS, clean("users", 12), MERGED) + "select * from merged",
    "expand_contractions": with_(TURNS, f"odd as (select source_file, turn, {odd('lower(content)')} as content from turns)") + f"select source_file, turn, {expanded('content')} as content from odd",
    "word_tokenize": with_(TURNS, f"odd as (select source_file, turn, {odd('lower(content)')} as content from turns)", f"t as (select source_file, turn, {words('content')} as token from odd)") + "select source_file, turn, array_to_string(token, ' ') as tokens, len(token) as n from t",
    "spell_train": "select word, count(*) + 1 as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by word",
    "spell_correct": corrected(),
    "lemmatize_rules": with_(PREPARED) + "select source_file, turn, array_to_string(token, ' ') as tokens, array_to_string(lemma, ' ') as lemmas from prepared",
    "pos_rules": with_(PREPARED) + "select source_file, turn, array_to_string(list_transform(range(1, len(token) + 1), lambda i: token[i] || '/' || tag_tok[i]), ' ') as tagged_token, array_to_string(list_transform(range(1, len(lemma) + 1), lambda i: lemma[i] || '/' || tag_lem[i]), ' ') as tagged_lemma from prepared",
    "word_classes": with_(PREPARED) + f"select {class_sql('tag')} as class, count(*) as n from (select unnest(tag_tok) as tag from prepared) group by 1",
    "lag_pairs_1": lagged(1),
    "lag_pairs_2": lagged(2),
    "small_files": with_(TURNS, clean("turns", 12)) + "select source_file, turn from clean qualify count(*) over (partition by source_file) >= 3",
    "ngram_counts": with_(PREPARED) + f"select gram, count(*) as n from (select unnest({grams('token', 2)}) as gram from prepared) group by gram",
    "lexical_alignment": with_(PREPARED, paired("prepared", 2, "token", "lemma")) + f"select source_file, time, {', '.join(f'round({lexical(s, n)}, 6) as lexical_{s}{n}_cosine' for n in (1, 2, 3) for s in SHORT)} from pairs",
    "pos_cosine": pos(True),
    "pos_cosine_dups": pos(False),
    "exploded_cosine": with_(PREPARED, paired("prepared", 1, "token")) + f"select source_file, time, round({cosine('token1', 'token2')}, 6) as cosine from pairs where token2 is not null",
    "vocab_freq": with_(PREPARED, VOCAB.format("lemma")) + "select * from counts",
    "vocab_filtered": with_(PREPARED, VOCAB.format("lemma"), FILTERED.format(1, 3)) + "select * from kept",
    "token_filter": with_(PREPARED, VOCAB.format("token"), FILTERED.format(2, 1)) + "select source_file, turn, array_to_string(list_filter(token, lambda w: list_contains(ws, w)), ' ') as tokens from prepared, (select list(word) as ws from kept)",
    "mean_pool": with_(PREPARED, VECTORS, pooled("token", "token")) + "select p.source_file, p.turn, place - 1 as place, round(x, 6) as x from prepared p left join token_sum s on s.source_file = p.source_file and s.turn = p.turn",
    "static_similarity": with_(PREPARED, STATIC) + "select source_file, time, round(c, 6) as static_cosine_similarity, round(t, 6) as token_static_cosine_similarity, round(l, 6) as lemma_static_cosine_similarity, round(m, 6) as master_static_cosine_similarity from static_all",
    "contextual_similarity": with_(PREPARED, ENCODED) + "select source_file, time, round(e, 6) as encoder_cosine_similarity from encoded",
    "surrogate_pairs": with_(TURNS, pairs_sql(False)) + "select * from file_pairs",
    "surrogate_sample": with_(TURNS, pairs_sql(True)) + "select * from file_pairs",
    "surrogate_turns": with_(TURNS, USERS, surrogate("users")) + SURROGATE,
    "surrogate_shuffled": with_(TURNS, USERS, surrogate("users", True, True)) + SURROGATE,
    "surrogate_one_per_dyad": with_(TURNS, USERS, surrogate("users", single=True)) + SURROGATE,
    "baseline_lexical": with_(PREPARED, CHANCE) + f"select source_file, time, {r(*METRICS)} from chance",
    "merged_metrics": with_(PREPARED, ENOUGH, paired("enough", 1, "token", "lemma"), scored("pairs", "real"), STATIC.replace("from prepared p left join", "from enough p left join"), ENCODED.replace("end as enc from prepared", "end as enc from enough")) + "select source_file, time, round(lexical_master_cosine, 6) as LEXICAL_MASTER_COSINE, round(c, 6) as static_cosine_similarity, round(m, 6) as MASTER_STATIC_COSINE_SIMILARITY, round(e, 6) as encoder_cosine_similarity from real join static_all using (source_file, time) join encoded using (source_file, time)",
    "describe_metrics": with_(REAL) + f"select metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as min, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3, round(max(value), 6) as max from ({UNPIVOT.format('select ' + ', '.join(METRICS) + ' from real')}) group by metric",
    "metric_corr": with_(REAL) + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from real" for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]),
    "real_vs_baseline": with_(REAL, CHANCE, COMPARE) + f"select metric, real_n, baseline_n, {r('real_mean', 'real_std', 'baseline_mean', 'baseline_std', 'difference', 'percent_increase', 't_statistic', 'cohens_d')}, case when abs(cohens_d) < 0.2 then 'negligible' when abs(cohens_d) < 0.5 then 'small' when abs(cohens_d) < 0.8 then 'medium' when cohens_d is not null then 'large' end as effect from done",
    "metric_histogram": with_(REAL, "v as (select round(lexical_tok1_cosine, 6) as x from real where lexical_tok1_cosine is not null)", "e as (select min(x) as low, max(x) as high from v)") + "select (case when high > low then least(floor((x - low) / (high - low) * 30) + 1, 30) else 1 end)::int as bin, count(*) as n from v, e group by 1",
    "direction_summary": with_(REAL) + "select utter_order, count(*) as n, round(avg(lexical_master_cosine), 6) as mean from real where lexical_master_cosine is not null and utter_order is not null group by utter_order",
}
