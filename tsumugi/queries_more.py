"""More queries over the driver's tables with their SQL: text and tag functions, gold structure, metrics, sources and sinks.

As in tsumugi.queries, tags, scores and annotations are derived from the tables by plain rules, the same in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi import vocab
from tsumugi.functions import decode, edits, text
from tsumugi.operators import corpus, lexicon, metrics, segment, structure, windows
from tsumugi.queries import ORACLES, UNITS, query, table, units
from tsumugi.sources import sinks
from tsumugi.sources import text as sources
from tsumugi.sources.dictionary import dictionary_entries, encode_dictionary, semantics_items
from tsumugi.sources.shared import shared_folder


def sql_map(pairs: dict[str, str]) -> str:
    return " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())


# --- text functions


@query("SELECT doc_id, CAST(regexp_matches(text, '[\\x{3040}-\\x{30ff}]') AS BOOLEAN) AS kana, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS kanji, translate(text, 'aiueo', 'あいうえお') AS hiragana FROM documents")
def character_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.has_kana("text").alias("kana"), text.has_kanji("text").alias("kanji"), text.to_hiragana(F.translate("text", "aiueo", "アイウエオ")).alias("hiragana"))


@query("SELECT p_partkey, p_name || '＃' AS surf, replace(p_type || 'う゛', 'う゛', 'ゔ') AS reading, replace(p_brand, '#', '＃') AS lemma FROM part")
def normalized_morphemes(spark, sf_dir):
    m = F.struct(F.concat("p_name", F.lit("#")).alias("surf"), F.concat("p_type", F.lit("う゛")).alias("reading"), F.col("p_brand").alias("lemma"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_morpheme(m).alias("m")).select("p_partkey", "m.*")


GA = ("関ケ原", "一ヶ月", "ケーキ", "七ヶ", "ヶ所", "犬", "霞ヶ関", "三ケ月")
GA_AT = (1, 1, -1, -1, -1, -1, 1, 1)


@query("SELECT p_partkey, CASE p_size % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(GA_AT)) + " END AS at FROM part")
def kanji_ga_places(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.kanji_ga(F.element_at(F.lit(list(GA)), F.col("p_size") % 8 + 1)).cast("int").alias("at"))


@query("SELECT l_orderkey, bool_or(CAST(l_quantity AS INT) % 10 = 3 OR (l_linestatus = 'F' AND l_returnflag = 'R')) AS excluded FROM lineitem GROUP BY 1")
def excluded_sentences(spark, sf_dir):
    m = F.struct(F.concat(F.lit("n"), (F.col("l_quantity").cast("int") % 10).cast("string"), F.lit("m")).alias("surf"), F.when(F.col("l_returnflag") == "R", "アル").otherwise("ある").alias("reading"), F.when(F.col("l_linestatus") == "F", "名詞").otherwise("特殊").alias("pos"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(m).alias("m")).select("l_orderkey", text.excluded("m", ("n3",)).alias("excluded"))


@query("SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN ';' || p_type ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ';' || p_container ELSE '' END AS canon FROM (SELECT p_partkey, p_size, replace(p_brand, ' ', '') AS p_brand, replace(p_type, ' ', '') AS p_type, 'c' || p_size AS p_container FROM part)")
def canon_alternatives(spark, sf_dir):
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    alt = lambda n, c: F.concat(F.lit(f'ALT-{n}-"代表表記:'), bare(c), F.lit(' x"'))
    key = lambda when, made, other: F.when(when, made).otherwise(F.lit(other))
    flags = F.map_from_arrays(F.array(key(F.col("p_size") % 2 == 0, alt("a", "p_type"), "用言"), key(F.col("p_size") % 3 == 0, F.concat(F.lit('ALT-b-"代表表記:c'), F.col("p_size").cast("string"), F.lit(' x"')), "体言"), alt("c", "p_brand")), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.canon_alternatives(bare("p_brand"), flags), ";").alias("canon"))


@query("SELECT n_nationkey, n_name || list_aggregate(list_transform(range(1, length(n_comment)), lambda k: ';' || n_name || n_comment[1:k]), 'string_agg', '') AS readings FROM (SELECT n_nationkey, n_name, regexp_replace(n_name, '[AEIOU]', '', 'g') || 'xy' AS n_comment FROM nation)")
def kanji_reading_expansion(spark, sf_dir):
    ending = F.concat(F.regexp_replace("n_name", "[AEIOU]", ""), F.lit("xy"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(text.kanji_readings(F.array(F.concat("n_name", F.lit("."), ending, F.lit("-")))), ";").alias("readings"))


LABELS = tuple(vocab.DISCOURSE_FOLDING)


@query("SELECT o_orderkey, CASE label " + sql_map(vocab.DISCOURSE_FOLDING) + " END AS relation FROM (SELECT o_orderkey, [" + ", ".join(f"'{x}'" for x in (*LABELS, "unknown")) + f"][o_orderkey % {len(LABELS) + 1} + 1] AS label FROM orders)")
def folded_discourse(spark, sf_dir):
    label = F.element_at(F.lit([*LABELS, "unknown"]), (F.col("o_orderkey") % (len(LABELS) + 1) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.fold_discourse(label).alias("relation"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS key, CASE WHEN o_orderstatus = 'O' THEN substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) END AS value FROM orders")
def labels_to_features(spark, sf_dir):
    label = F.when(F.col("o_orderstatus") == "O", F.replace("o_orderpriority", F.lit("-"), F.lit(":"))).otherwise(F.substring_index("o_orderpriority", "-", 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.label_to_feature(label).alias("f")).select("o_orderkey", "f.*")


# --- tags


EMBEDDED = "SELECT vec_id, label, embedding FROM embeddings"


@query("SELECT vec_id, array_to_string(list_transform(embedding[2:label + 1], lambda x: CASE WHEN x > 0 THEN 'K' ELSE 'D' END), '') AS tags, array_to_string(list_transform(embedding[2:label + 2], lambda x: CASE WHEN x > 0 THEN '_' ELSE 'I' END), '') AS more FROM embeddings")
def tag_windows(spark, sf_dir):
    tag = lambda a, b: F.transform("embedding", lambda x: F.when(x > 0, a).otherwise(b))
    own = table(spark, sf_dir, "embeddings")
    return own.select("vec_id", F.array_join(edits.tag_window(tag("K", "D"), F.col("label").cast("int")), "").alias("tags"), F.array_join(edits.tag_window(tag("_", "I"), F.col("label").cast("int"), 1), "").alias("more"))


@query("SELECT vec_id, array_to_string(list_transform(list_filter(range(64), lambda i: (i + label) % 3 <> 0), lambda i: CASE i % 2 WHEN 0 THEN 'B' ELSE 'I' END), '') AS tags FROM embeddings")
def predicted_char_tags(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    ids, special = F.transform("embedding", lambda x, i: i % 2), F.transform("embedding", lambda x, i: (i + F.col("label")) % 3 == 0)
    return own.select("vec_id", F.array_join(edits.char_tags(ids, special, ("B", "I")), "").alias("tags"))


@query("SELECT item_id, CASE WHEN e > 0 THEN repeat('K;', e - 1) || 'R:E;' || repeat('K;', length(t) - e) || 'K' ELSE repeat('K;', length(t)) || 'K' END AS kdr, repeat('_;', length(t)) || '_' AS ins FROM (SELECT item_id, t, strpos(t, 'e') AS e FROM (SELECT item_id, replace(replace(text, chr(10), ' '), '+', ' ') AS t FROM benchmark))")
def typo_gold_tags(spark, sf_dir):
    """The first e of each item was an E: one replacement, found from the texts and the diff."""
    own = table(spark, sf_dir, "benchmark").select("item_id", F.translate("text", "\n+", "  ").alias("a"))
    at = F.locate("e", F.col("a"))
    after = F.when(at > 0, F.concat(F.substring("a", F.lit(1), at - 1), F.lit("E"), F.substring("a", at + 1, F.length("a")))).otherwise(F.col("a"))
    none = F.array().cast("array<struct<pre_str:string,post_str:string>>")
    diffs = F.when(at > 0, F.array(F.struct(F.lit("e").alias("pre_str"), F.lit("E").alias("post_str")))).otherwise(none)
    found = own.select("item_id", edits.typo_gold_tags("a", after, diffs).alias("t"))
    return found.select("item_id", F.array_join("t.kdr_tags", ";").alias("kdr"), F.array_join("t.ins_tags", ";").alias("ins"))


TYPOS = "SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark"


@query(f"SELECT item_id, CAST(list_sum(list_transform(string_split(t, ''), lambda c: CASE WHEN c IN ('e', 'o') THEN 1 ELSE 0 END)) AS BIGINT) AS n, array_to_string(list_transform(list_filter(string_split(t, ''), lambda c: c IN ('e', 'o')), lambda c: c || CASE c WHEN 'e' THEN '3' ELSE '0' END), ' ') AS diffs FROM ({TYPOS})")
def char_diffs(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    found = own.select("item_id", edits.char_diffs("t", F.translate("t", "eo", "30")).alias("d"))
    return found.select("item_id", F.size("d").cast("long").alias("n"), F.array_join(F.transform("d", lambda x: F.concat(x["pre"], x["post"])), " ").alias("diffs"))


@query(f"WITH n AS (SELECT sum(length(t) - length(replace(t, 'e', ''))) AS e, sum(length(t) - length(replace(t, 'o', ''))) AS o, sum(length(t) - length(replace(t, 'a', ''))) AS a FROM ({TYPOS})), c AS (SELECT 0.0 AS threshold, e AS tp, o AS fp, a AS fn FROM n UNION ALL SELECT 0.8, e, 0, a FROM n UNION ALL SELECT 0.9, 0, 0, e + a FROM n) SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(CASE WHEN tp > 0 THEN 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) ELSE 0 END, 9) AS f0_5 FROM c")
def typo_scores(spark, sf_dir):
    """Corrections e to 3 and a to 4 are right; at 0.0 an o is changed too, at 0.8 only e, at 0.9 nothing."""
    own = table(spark, sf_dir, "benchmark").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("pre_text")).withColumn("post_text", F.translate("pre_text", "ea", "34"))
    made = F.array(*[F.struct(F.lit(t).alias("threshold"), p.alias("predicted")) for t, p in ((0.0, F.translate("pre_text", "eo", "30")), (0.8, F.translate("pre_text", "e", "3")), (0.9, F.col("pre_text")))])
    found = metrics.typo_scores(own.select("*", F.inline(made)))
    return found.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f0_5")])


@query("SELECT doc_id, CASE WHEN length(text) <= 1000 THEN 'taken' ELSE 'left' END AS way FROM documents")
def length_guard(spark, sf_dir):
    taken, left = segment.length_guard(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "n", 1000)
    return taken.select("doc_id", F.lit("taken").alias("way")).unionByName(left.select("doc_id", F.lit("left").alias("way")))


# --- words: normal forms, lemmas, attributes

ENDINGS = (("母音動詞", "未然形", "", "る"), ("母音動詞", "タ形", "た", "る"), ("子音動詞カ行", "未然形", "か", "く"), ("子音動詞カ行", "タ形", "いた", "く"))
ENDINGS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in ENDINGS) + ") d(conjtype, conjform, ending, base_ending)"
VERBS = "SELECT p_partkey AS key, CASE p_size % 4 WHEN 0 THEN '*' WHEN 1 THEN '母音動詞' ELSE '子音動詞カ行' END AS conjtype, CASE WHEN p_size % 4 = 0 THEN '*' WHEN p_size % 3 = 0 THEN '未然形' ELSE 'タ形' END AS conjform, p_brand || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'る' ELSE 'く' END AS lemma FROM part"


def verbs(spark, sf_dir) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.when(size % 4 == 0, "*").when(size % 4 == 1, "母音動詞").otherwise("子音動詞カ行").alias("conjtype"), F.when(size % 4 == 0, "*").when(size % 3 == 0, "未然形").otherwise("タ形").alias("conjform"),
        F.concat("p_brand", F.when(size % 4 == 0, "").when(size % 4 == 1, "る").otherwise("く")).alias("lemma"),
    )


def endings(spark) -> DataFrame:
    return spark.createDataFrame(list(ENDINGS), "conjtype string, conjform string, ending string, base_ending string")


NORMS = f"WITH v AS ({VERBS}), n AS (SELECT v.key, v.conjtype, v.conjform, v.lemma, CASE WHEN v.conjtype = '*' THEN lemma ELSE substr(lemma, 1, length(lemma) - length(base_ending)) || ending END AS norm FROM v LEFT JOIN {ENDINGS_SQL} USING (conjtype, conjform))"


@query(NORMS + " SELECT key, norm FROM n")
def normal_forms(spark, sf_dir):
    return lexicon.normal_forms(verbs(spark, sf_dir), endings(spark)).select("key", "norm")


@query(NORMS + " SELECT key, lemma AS lemmas FROM n")
def recovered_lemmas(spark, sf_dir):
    """Back from the normal forms to the lemmas, by the longest ending."""
    words = lexicon.normal_forms(verbs(spark, sf_dir), endings(spark)).select("key", "norm", F.lit("動詞").alias("pos"), F.lit("*").alias("subpos"), "conjtype", "conjform")
    none = words.limit(0).select(F.col("norm").alias("surf"), "pos", "subpos", "conjtype", F.col("norm").alias("lemma"), F.lit(0).alias("ord"))
    return lexicon.recover_lemmas(words, none, endings(spark), []).select("key", F.array_join("lemmas", ";").alias("lemmas"))


@query("SELECT w.p_partkey AS key, string_agg(l, ';' ORDER BY o) AS lemmas FROM part w JOIN (SELECT p_name, p_type || p_brand AS l, min(p_partkey) AS o FROM part GROUP BY 1, 2) e ON w.p_name = e.p_name GROUP BY 1")
def ambiguous_lemmas(spark, sf_dir):
    """An ambiguous form has all lemmas that the dictionary lists, in its order."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("norm"), F.lit("動詞").alias("pos"), F.lit("*").alias("subpos"), F.lit("母音動詞").alias("conjtype"), F.lit("未然形").alias("conjform"))
    entries = part.select(F.col("p_name").alias("surf"), F.lit("動詞").alias("pos"), F.lit("*").alias("subpos"), F.lit("母音動詞").alias("conjtype"), F.concat("p_type", "p_brand").alias("lemma"), F.col("p_partkey").alias("ord"))
    return lexicon.recover_lemmas(words, entries, endings(spark), [("母音動詞", "未然形")]).select("key", F.array_join("lemmas", ";").alias("lemmas"))


def _legal_sql(name: str, own: dict, names: tuple[str, ...]) -> str:
    return f"{name}(g, k, x, n) AS (VALUES " + ", ".join(f"('{g}', {names.index(x)}, '{x}', {n})" for g, xs in own.items() for n, x in enumerate(xs)) + ")"


def _names_sql(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


ATTRIBUTES = (
    f"WITH {_legal_sql('ls', vocab.SUBPOS_OF, vocab.SUBPOS)}, {_legal_sql('lf', vocab.CONJFORMS_OF, vocab.CONJFORMS)}, inf(p, s) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(vocab.INFLECTABLE)) + "), "
    f"a AS (SELECT vec_id, embedding, {_names_sql(vocab.POS)}[list_position(embedding[1:14], list_max(embedding[1:14]))] AS pos, {_names_sql(vocab.CONJTYPES)}[list_position(embedding[15:47], list_max(embedding[15:47]))] AS t FROM embeddings), "
    "b AS (SELECT vec_id, any_value(embedding) AS embedding, any_value(pos) AS pos, any_value(t) AS t, arg_max(x, embedding[(k * 5) % 64 + 1]) AS subpos FROM a JOIN ls ON g = pos GROUP BY vec_id), "
    "c AS (SELECT b.*, EXISTS (SELECT 1 FROM inf WHERE p = pos AND s = subpos) AS i FROM b), "
    "d AS (SELECT vec_id, pos, subpos, CASE WHEN i THEN t ELSE '*' END AS conjtype, CASE WHEN i THEN (SELECT arg_max(x, embedding[(k * 11) % 64 + 1]) FROM lf WHERE g = t) ELSE '*' END AS conjform FROM c) "
    "SELECT vec_id, pos, subpos, conjtype, conjform, CAST((SELECT n FROM lf WHERE g = conjtype AND x = conjform) AS INT) AS conjform_id FROM d"
)


@query(ATTRIBUTES)
def morpheme_attributes(spark, sf_dir):
    e = F.col("embedding")
    around = lambda n, step: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(e, (k * step) % 64 + 1))
    found = decode.morpheme_attributes(F.slice(e, 1, 14), around(len(vocab.SUBPOS), 5), F.slice(e, 15, 33), around(len(vocab.CONJFORMS), 11))
    return table(spark, sf_dir, "embeddings").select("vec_id", found.alias("a")).select("vec_id", "a.pos", "a.subpos", "a.conjtype", "a.conjform", "a.conjform_id")


# --- scores

STEPS = "SELECT vec_id, label % 3 AS f, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"
TAGS = ("O", "B-X", "I-X", "B-Y")


def _viterbi_sql() -> str:
    """The best path by recursion over the steps: for each tag its score and the tags so far; what BIO forbids costs 1024."""
    allowed = {(a, b) for a in range(4) for b in range(4) if b != 2 or a in (1, 2)}
    start = ", ".join(f"{'-1024.0' if k == 2 else '0.0'} + e[4 * f + {k + 1}]" for k in range(4))
    options = lambda b: "[" + ", ".join(f"s[{a + 1}] + {'0.0' if (a, b) in allowed else '-1024.0'}" for a in range(4)) + "]"
    best = ", ".join(f"list_max({options(b)}) + e[4 * i + {b + 1}]" for b in range(4))
    paths = ", ".join(f"p[list_position({options(b)}, list_max({options(b)}))] || '{b}'" for b in range(4))
    return (
        f"WITH RECURSIVE v AS ({STEPS}), r(vec_id, f, e, i, s, p) AS (SELECT vec_id, f, e, f + 1, [{start}], ['0', '1', '2', '3'] FROM v UNION ALL SELECT vec_id, f, e, i + 1, [{best}], [{paths}] FROM r WHERE i < 16) "
        "SELECT vec_id, repeat('0', CAST(f AS INT)) || p[list_position(s, list_max(s))] AS tags FROM r WHERE i = 16"
    )


@query(_viterbi_sql())
def viterbi_tags(spark, sf_dir):
    """Tags of 16 steps over 4 scores of each vector, under the BIO constraints; the first steps are masked."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    own = table(spark, sf_dir, "embeddings").select("vec_id", steps.alias("e"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i >= F.col("label") % 3).alias("m"))
    return own.select("vec_id", F.array_join(decode.crf_decode(TAGS)("e", "m").cast("array<string>"), "").alias("tags"))


ORACLES["viterbi_spans"] = f"SELECT vec_id, list_transform(string_split(tags, ''), lambda x: CAST(x AS INT)) AS tags FROM ({_viterbi_sql()})"


@query("SELECT vec_id, round(avg(-ln(CASE WHEN y THEN p ELSE 1 - p END)), 6) AS loss FROM (SELECT vec_id, i, 0.5 + 0.4 * sin(CAST(embedding[i] AS DOUBLE)) AS p, (i + label) % 2 = 0 AS y FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings)) WHERE i % 5 <> 0 GROUP BY vec_id")
def binary_losses(spark, sf_dir):
    p = F.transform("embedding", lambda x: 0.5 + 0.4 * F.sin(x.cast("double")))
    y = F.transform("embedding", lambda x, i: F.when((i + 1) % 5 != 0, ((i + 1 + F.col("label")) % 2 == 0).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(decode.binary_cross_entropy(p, y), 6).alias("loss"))


@query("SELECT vec_id, round(sum(ln(z) - x) FILTER (i % 16 = label % 16), 6) AS loss FROM (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x, list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE)))) AS z FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY vec_id")
def cohesion_losses(spark, sf_dir):
    y = F.transform("embedding", lambda x, i: (i % 16 == F.col("label") % 16).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(decode.cohesion_loss("embedding", y), 6).alias("loss"))


@query("SELECT conv_id, array_to_string(list_resize(list_transform(lens, lambda x: CAST(x AS VARCHAR)), 12, '-100'), ' ') AS labels FROM (SELECT conv_id, list(length(text) ORDER BY turn) AS lens FROM conversations GROUP BY conv_id)")
def padded_labels(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("lens"))
    return own.select("conv_id", F.array_join(metrics.padded("lens", 12, "sent_labels").cast("array<string>"), " ").alias("labels"))


# --- structure


@query(f"WITH RECURSIVE {UNITS}, h AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS u, count(*) OVER (PARTITION BY k) AS n, q FROM u), e AS (SELECT k, u, n, q % (n + 1) - 1 AS head FROM h), w(k, u, n, here, step) AS (SELECT k, u, n, u, 0 FROM e UNION ALL SELECT w.k, w.u, w.n, e.head, step + 1 FROM w JOIN e ON w.k = e.k AND w.here = e.u WHERE w.here >= 0 AND step <= w.n) SELECT k, bool_or(step > n) AS cyclic FROM w GROUP BY k")
def cyclic_heads(spark, sf_dir):
    own = units(spark, sf_dir).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
    return own.select("k", structure.cyclic(F.transform("q", lambda x: x % (F.size("q") + 1) - 1)).alias("cyclic"))


@query("SELECT conv_id, CASE WHEN token = '[ROOT]' THEN 'dependency' ELSE 'both' END AS level, CAST(n + k AS INT) AS at FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), (VALUES " + ", ".join(f"('{t}', {k})" for k, t in enumerate(vocab.SPECIAL_TOKENS)) + ") s(token, k)")
def special_indices(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    both = own.select("conv_id", F.explode(structure.special_indices(F.col("n"), "dependency")).alias("token", "at"), structure.special_indices(F.col("n")).alias("own"))
    return both.select("conv_id", F.when(F.map_contains_key("own", F.col("token")), "both").otherwise("dependency").alias("level"), "at")


@query(f"WITH {UNITS} SELECT k AS doc_id, i - 1 AS bp_idx, CAST(coalesce(sum(q % 3 + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS first_morph, CAST(sum(q % 3 + 1) OVER w - 1 AS INT) AS last_morph, CAST(row_number() OVER w - 1 AS INT) AS global_idx FROM (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, q FROM u) WINDOW w AS (PARTITION BY k ORDER BY i)")
def base_phrase_tables(spark, sf_dir):
    one = F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: F.struct((x["q"] % 3 + 1).alias("n_morphemes")))
    own = units(spark, sf_dir).groupBy(F.col("k").alias("doc_id")).agg(one.alias("base_phrases")).withColumns({"sent_idx": F.lit(0), "sid": F.lit("s")})
    return structure.base_phrase_table(own).select("doc_id", F.col("bp_idx").cast("long").alias("bp_idx"), "first_morph", "last_morph", F.col("global_idx").cast("int").alias("global_idx"))


@query(f"WITH {UNITS} SELECT k, i, q % 2 = 1 AS verb, d % 2 = 1 AS ne, f = 'A' AS clause FROM u")
def refreshed_features(spark, sf_dir):
    """Features that aren't maintained go; NE stays unless it is optional; a clause function stays whatever its value."""
    q, d, f = F.col("q"), F.col("d"), F.col("f")
    made = F.map_from_arrays(F.array(*map(F.lit, ("用言", "NE", "節-機能-条件", "unknown"))), F.array(F.when(q % 2 == 1, "動").otherwise("?"), F.when(d % 2 == 1, "PERSON:x").otherwise("OPTIONAL:x"), F.lit("z"), F.lit("1")))
    own = F.map_filter(made, lambda k, v: (k != "節-機能-条件") | (f == "A"))
    has = lambda k: F.map_contains_key("features", F.lit(k))
    found = units(spark, sf_dir).select("k", "i", structure.refreshed_features(own).alias("features"))
    return found.where(~has("unknown")).select("k", "i", has("用言").alias("verb"), has("NE").alias("ne"), has("節-機能-条件").alias("clause"))


@query(f"WITH {UNITS}, m AS (SELECT k, i, s AS category, CASE f WHEN 'A' THEN 'single' WHEN 'N' THEN 'head' ELSE CASE WHEN q % 2 = 0 THEN 'middle' ELSE 'tail' END END AS part FROM u), r AS (SELECT *, sum(CASE WHEN part IN ('single', 'head') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run FROM m), c AS (SELECT *, first_value(category) OVER (PARTITION BY k, run ORDER BY i) AS cat FROM r WHERE run > 0), o AS (SELECT *, coalesce(sum(CASE WHEN part IN ('single', 'tail') THEN 1 ELSE 0 END) OVER (PARTITION BY k, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM c WHERE category = cat) SELECT k, cat AS category, string_agg(i, ' ' ORDER BY i) AS places FROM o WHERE ended = 0 GROUP BY k, run, cat HAVING bool_or(part IN ('single', 'tail'))")
def head_runs(spark, sf_dir):
    part = F.when(F.col("f") == "A", "single").when(F.col("f") == "N", "head").when(F.col("q") % 2 == 0, "middle").otherwise("tail")
    found = windows.head_runs(units(spark, sf_dir).select("k", "i", F.col("s").alias("category"), part.alias("part")), ["k"], "i")
    return found.select("k", "category", F.array_join(F.col("places").cast("array<string>"), " ").alias("places"))


@query("SELECT p_partkey, CAST(a1 AS INT) AS a1, CAST(CASE WHEN (a1 + 3) * 2 > n THEN ceil(n / 2) ELSE a1 + 3 END AS INT) AS a2, CAST(a1 // 3 * 2 AS INT) AS b1, CAST(CASE WHEN (a1 + 3) * 2 > n THEN ceil(n / 3) ELSE a1 // 3 * 2 + 2 END AS INT) AS b2 FROM (SELECT p_partkey, length(p_name) AS n, unnest(range(0, CAST(ceil(length(p_name) / 2) AS BIGINT), 3)) AS a1 FROM part)")
def aligned_segmentations(spark, sf_dir):
    """Pieces of two and of three characters of the same name agree at every sixth character, and at the end."""
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.length("p_name") - 1) / n).cast("int")), lambda k: F.substring(F.col("p_name"), k * n + 1, F.lit(n)))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(lexicon.aligned(cut(2), cut(3))))


@query("SELECT user_id AS sid, event_type AS category, CAST(event_id * 2 AS BIGINT) AS \"start\", CAST(event_id * 2 + 2 AS BIGINT) AS \"end\" FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0 UNION ALL SELECT user_id, 'old', event_id, event_id + 1 FROM events WHERE user_id % 2 = 1 AND event_id % 50 = 0")
def transferred_entities(spark, sf_dir):
    """Entities of users without any yet, moved onto another segmentation, beside the old ones."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_type").alias("category"), F.col("event_id").cast("long").alias("n"))
    stretches = events.select("sid", F.col("n").alias("a1"), (F.col("n") + 1).alias("a2"), (F.col("n") * 2).alias("b1"), (F.col("n") * 2 + 2).alias("b2"))
    new = lexicon.transfer_entities(events.where("n % 3 = 0").select("sid", "category", F.col("n").alias("start"), (F.col("n") + 1).alias("end")), stretches)
    old = events.where("sid % 2 = 1 and n % 50 = 0").select("sid", F.lit("old").alias("category"), F.col("n").alias("start"), (F.col("n") + 1).alias("end"))
    odd = events.where("sid % 2 = 1").select("sid").distinct()
    return lexicon.onto_untagged(new.join(odd, "sid", "left_anti"), old)


@query("SELECT conv_id, a.text AS system, b.text AS baseline, c.text AS gold FROM conversations a JOIN conversations b USING (conv_id) JOIN conversations c USING (conv_id) WHERE a.turn = 0 AND b.turn = 1 AND c.turn = 2")
def compared_analyses(spark, sf_dir):
    of = lambda k: table(spark, sf_dir, "conversations").where(F.col("turn") == k).select(F.col("conv_id").alias("sid"), F.col("text").alias("morphemes"))
    return corpus.compared(of(0), of(1), of(2)).withColumnRenamed("sid", "conv_id")


# --- metrics


@query(f"WITH {UNITS}, p AS (SELECT q % 3 = 0 AS a, d % 2 = 0 AS b, t % 2 = 0 AS c, f <> 'R' AS e FROM u), x AS (SELECT avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS pos_f1, avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) AS subpos_f1, avg(CASE WHEN c THEN 1.0 ELSE 0.0 END) AS conjtype_f1, avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) AS conjform_f1 FROM p) SELECT key, round(value, 9) AS value FROM (SELECT *, (pos_f1 + subpos_f1 + conjtype_f1 + conjform_f1) / 4 AS morphological_analysis_f1 FROM x) UNPIVOT (value FOR key IN (pos_f1, subpos_f1, conjtype_f1, conjform_f1, morphological_analysis_f1))")
def attribute_scores(spark, sf_dir):
    """A gold value outside the vocabulary is never right, whatever was predicted."""
    right = {"pos": F.col("q") % 3 == 0, "subpos": F.col("d") % 2 == 0, "conjtype": F.col("t") % 2 == 0, "conjform": F.col("f") != "R"}
    gold = {"pos": F.lit("名詞"), "subpos": F.when(right["subpos"], "人名").otherwise("unknown"), "conjtype": F.lit("母音動詞"), "conjform": F.lit("タ形")}
    system = {n: F.when(right[n], gold[n]).otherwise("unknown") for n in right}
    rows = units(spark, sf_dir).select(*[F.struct(*[c.alias(n) for n, c in side.items()]).alias(name) for name, side in (("gold", gold), ("system", system))])
    return metrics.attribute_scores(rows).select("key", F.round("value", 9).alias("value"))


SEGMENTS = f"WITH {UNITS}, a AS (SELECT k, sum(q % 5 + 1) OVER w AS e, q % 5 + 1 AS n FROM u WINDOW w AS (PARTITION BY k ORDER BY i)), b AS (SELECT k, sum(d % 4 + 1) OVER w AS e, d % 4 + 1 AS n FROM u WINDOW w AS (PARTITION BY k ORDER BY i)), g AS (SELECT k, e - n AS s, e FROM a), h AS (SELECT k, e - n AS s, e FROM b)"


@query(SEGMENTS + ", x AS (SELECT k, s, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS c FROM g), y AS (SELECT k, s, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS c FROM h), c AS (SELECT avg(CASE WHEN (x.s = c) = (y.s = c) THEN 1.0 ELSE 0.0 END) AS accuracy FROM x JOIN y USING (k, c)), n AS (SELECT (SELECT count(*) FROM g JOIN h USING (k, s, e)) AS tp, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM h) AS ns) SELECT round(accuracy, 9) AS accuracy, tp, ns - tp AS fp, ng - tp AS fn, round(2 * tp / (ng + ns), 9) AS f1 FROM c, n")
def segmentation_scores(spark, sf_dir):
    cut = lambda c, m: segment.spans(units(spark, sf_dir).select("k", "i", F.repeat(F.lit("x"), F.col(c) % m + 1).alias("surf")), ["k"], "i").select("k", "start", "end")
    found = metrics.segmentation_scores(cut("q", 5), cut("d", 4), ["k"])
    return found.select(F.round("accuracy", 9).alias("accuracy"), "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query(f"WITH {UNITS}, c AS (SELECT key, count(*) FILTER (r) AS tp, count(*) FILTER (NOT r) AS fp FROM (SELECT q % 7 > 0 AS a, t % 3 > 0 AS b, d % 5 > 0 AS e, f = 'R' AS g FROM u), LATERAL (SELECT unnest(['surf', 'reading', 'lemma', 'canon']) AS key, unnest([true, b, e, g]) AS r) GROUP BY key) SELECT key, tp, fp, fp AS fn, round(2 * tp / (2 * tp + 2 * fp), 9) AS f1, CAST(1.0 AS DOUBLE) AS same_text FROM c")
def morphology_scores(spark, sf_dir):
    """Words with equal written forms, whose readings, lemmas and canonical forms differ here and there."""
    gold = F.struct("i", F.concat(F.lit("w"), F.col("i").cast("string")).alias("surf"), F.lit("r").alias("reading"), F.lit("l").alias("lemma"), F.lit("c").alias("canon"))
    wrong = lambda c, x: F.when(c, F.lit(x)).otherwise("?")
    system = F.struct("i", F.concat(F.lit("w"), F.col("i").cast("string")).alias("surf"), wrong(F.col("t") % 3 > 0, "r").alias("reading"), wrong(F.col("d") % 5 > 0, "l").alias("lemma"), wrong(F.col("f") == "R", "c").alias("canon"))
    ordered = lambda s: F.transform(F.array_sort(F.collect_list(s)), lambda x: F.struct(*[x[n].alias(n) for n in ("surf", "reading", "lemma", "canon")]))
    rows = units(spark, sf_dir).groupBy("k").agg(ordered(system).alias("system"), ordered(gold).alias("gold"))
    return metrics.morphology_scores(rows).select("key", "tp", "fp", "fn", F.round("f1", 9).alias("f1"), "same_text")


@query("SELECT o_orderkey, o_orderstatus AS features, CAST(o_orderkey % 5 AS INT) AS parent_idx, 'P' AS dep_type, 'system' AS rels FROM orders")
def partly_gold(spark, sf_dir):
    unit = lambda f, p, d, r: F.struct(f.alias("features"), p.cast("int").alias("parent_idx"), F.lit(d).alias("dep_type"), F.lit(r).alias("rels"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", unit(F.col("o_orderstatus"), F.col("o_orderkey") % 5, "P", "gold").alias("gold"), unit(F.lit("x"), F.lit(-1), "D", "system").alias("system"))
    return metrics.partly_gold(rows, 2)


CHUNKED = f"WITH {UNITS}, n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i, q % 3 = 0 AS gb, d % 3 = 0 AS sb, t % 2 = 0 AS gf, f = 'A' AS sf FROM u), "


@query(CHUNKED + "c AS (SELECT k, i, coalesce(sum(CAST(gb AS INT)) OVER w, 0) AS gr, coalesce(sum(CAST(sb AS INT)) OVER w, 0) AS sr FROM n WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT k, '基本句-区切' AS label, min(i) AS a, max(i) AS b FROM c GROUP BY k, gr UNION ALL SELECT k, '基本句-主辞', i, i FROM n WHERE gf), s AS (SELECT k, '基本句-区切' AS label, min(i) AS a, max(i) AS b FROM c GROUP BY k, sr UNION ALL SELECT k, '基本句-主辞', i, i FROM n WHERE sf), x AS (SELECT label, (SELECT count(*) FROM g JOIN s USING (k, label, a, b) WHERE label = l.label) AS tp, (SELECT count(*) FROM g WHERE g.label = l.label) + (SELECT count(*) FROM s WHERE s.label = l.label) AS n FROM (VALUES ('基本句-区切'), ('基本句-主辞')) l(label)) SELECT label, round(2 * tp / n, 9) AS f1 FROM x UNION ALL SELECT 'macro', round(avg(2 * tp / n), 9) FROM x UNION ALL SELECT 'micro', round(2 * sum(tp) / sum(n), 9) FROM x")
def word_feature_scores(spark, sf_dir):
    """Boundaries by their chunks, another feature word by word."""
    flags = lambda b, f: F.filter(F.array(F.when(b, "基本句-区切"), F.when(f, "基本句-主辞")), lambda x: x.isNotNull())
    side = lambda b, f: units(spark, sf_dir).select("k", "i", flags(b, f).alias("features"))
    found = metrics.word_feature_scores(side(F.col("q") % 3 == 0, F.col("t") % 2 == 0), side(F.col("d") % 3 == 0, F.col("f") == "A"), ["k"], "i", ("基本句-区切",))
    return found.select("label", F.round("f1", 9).alias("f1"))


DEPRELS = ("nsubj", "obj", "case")


@query(f"WITH {UNITS}, n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, q, d, t, f FROM u), w AS (SELECT k, i, i = 1 AS root, q % 3 AS gd, CASE WHEN d < 6 THEN q % 3 ELSE d % 3 END AS sd, 1 AS gh, CASE WHEN t < 5 THEN 1 ELSE greatest(i - 1, 1) END AS sh, f <> 'R' AS tag, t % 3 <> 0 AS lemma FROM n), m AS (SELECT count(*) AS n, count(*) FILTER (tag) AS tags, count(*) FILTER (lemma) AS lemmas, count(*) FILTER (root OR gh = sh) AS uas, count(*) FILTER (root OR gh = sh AND gd = sd) AS las FROM w) SELECT metric, round(x / n, 9) AS f1 FROM (SELECT unnest(['Tokens', 'Sentences', 'Words', 'UPOS', 'XPOS', 'UFeats', 'AllTags', 'Lemmas', 'UAS', 'LAS']) AS metric, unnest([n, n, n, tags, n, n, tags, lemmas, uas, las]) AS x, n FROM m)")
def conll_metrics(spark, sf_dir):
    """Ten of the thirteen metrics over documents in CoNLL-U, of the same segmentation; a document is an order."""
    own = units(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("i")))
    rel = lambda c: F.element_at(F.lit(list(DEPRELS)), c % 3 + 1)
    root = F.col("n") == 1

    def line(upos, lemma, head, deprel):
        return F.concat_ws("\t", F.col("n").cast("string"), F.concat(F.lit("w"), F.col("n").cast("string")), lemma, upos, F.lit("X"), F.lit("_"), F.when(root, 0).otherwise(head).cast("string"), F.when(root, "root").otherwise(deprel), F.lit("_"), F.lit("_"))

    gold = line(F.lit("NOUN"), F.lit("l"), F.lit(1), rel(F.col("q")))
    system = line(F.when(F.col("f") != "R", "NOUN").otherwise("VERB"), F.when(F.col("t") % 3 != 0, "l").otherwise("m"), F.when(F.col("t") < 5, 1).otherwise(F.greatest(F.col("n") - 1, F.lit(1))), rel(F.when(F.col("d") < 6, F.col("q")).otherwise(F.col("d"))))
    text_of = lambda c: F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c.alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n\n"))
    found = metrics.conll_table_scores(own.groupBy("k").agg(text_of(gold).alias("gold"), text_of(system).alias("system")))
    return found.where(~F.col("metric").isin("CLAS", "MLAS", "BLEX")).select("metric", F.round("f1", 9).alias("f1"))


@query("WITH d AS (SELECT doc_id AS k, n_chars % 60 + 1 AS n, greatest(n_chars % 60 - 9, 0) // 3 AS m, greatest(n_chars % 60 - 9, 0) % 3 AS r FROM documents), w AS (SELECT k, n, m, unnest(range(m + r + 1)) AS i FROM d) SELECT k, i, 2 * least(i, m) + i AS a, least(2 * least(i, m) + i + 10, n) AS b FROM w")
def stride_windows(spark, sf_dir):
    """Windows of ten equal items whose ends are three items apart; where that is too far, one by one."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.array_repeat(F.lit(1), (F.col("n_chars") % 60 + 1).cast("int")).alias("lengths"))
    each = own.select("k", F.posexplode(windows.window_spans(10, 3)("lengths")).alias("i", "w"))
    return each.select("k", F.col("i").cast("long").alias("i"), F.col("w.start").cast("long").alias("a"), F.col("w.end").cast("long").alias("b"))


def _crf_sql() -> str:
    """log p of the tag O at all of 16 steps: the path's score less the logarithm of the sum over all paths, by recursion."""
    allowed = {(a, b) for a in range(4) for b in range(4) if b != 2 or a in (1, 2)}
    start = ", ".join(f"{'-1024.0' if k == 2 else '0.0'} + e[{k + 1}]" for k in range(4))
    step = ", ".join("ln(" + " + ".join(f"exp(s[{a + 1}])" for a in range(4) if (a, b) in allowed) + f") + e[4 * i + {b + 1}]" for b in range(4))
    return f"WITH RECURSIVE v AS ({STEPS}), r(vec_id, e, i, s, own) AS (SELECT vec_id, e, 1, [{start}], e[1] FROM v UNION ALL SELECT vec_id, e, i + 1, [{step}], own + e[4 * i + 1] FROM r WHERE i < 16) SELECT vec_id, round(own - ln(exp(s[1]) + exp(s[2]) + exp(s[3]) + exp(s[4])), 6) AS loss FROM r WHERE i = 16"


@query(_crf_sql())
def crf_likelihoods(spark, sf_dir):
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    own = table(spark, sf_dir, "embeddings").select("vec_id", steps.alias("e"), F.array_repeat(F.lit(0), 16).alias("g"), F.array_repeat(F.lit(True), 16).alias("m"))
    return own.select("vec_id", F.round(decode.crf_log_likelihood(TAGS)("e", "g", "m"), 6).alias("loss"))


def _tree_sql() -> str:
    """The greedy tree by recursion over the units: h has the heads so far (-9: none yet); where a unit's chain of heads ends at it, the head makes a cycle."""
    end = "list_reduce(list_prepend(c, range(n)), lambda a, b: CASE WHEN a < 0 OR h[a + 1] = -9 THEN a ELSE h[a + 1] END)"
    free = lambda xs: f"list_filter({xs}, lambda c: {end} <> u)[1]"
    head = f"coalesce({free('r[u + 1]')}, CASE WHEN u = n - 1 AND NOT list_contains(h, -1) THEN -1 ELSE coalesce({free('range(u + 1, n)')}, {free('list_reverse(range(u))')}) END)"
    return (
        f"WITH RECURSIVE {UNITS}, b AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS u, count(*) OVER (PARTITION BY k) AS n, q FROM u), "
        "c AS (SELECT k, u, any_value(n) AS n, coalesce(list(v ORDER BY vq DESC, v) FILTER (v IS NOT NULL), [])[1:4] AS r FROM (SELECT b.k, b.u, b.n, o.u AS v, o.q AS vq FROM b LEFT JOIN b o ON b.k = o.k AND b.u <> o.u) GROUP BY k, u), "
        "d AS (SELECT k, any_value(n) AS n, list(r ORDER BY u) AS r FROM c GROUP BY k), "
        f"t(k, n, r, u, h) AS (SELECT k, n, r, CAST(0 AS BIGINT), list_transform(range(n), lambda x: CAST(-9 AS BIGINT)) FROM d UNION ALL SELECT k, n, r, u + 1, list_concat(h[1:u], [CAST({head} AS BIGINT)], h[u + 2:]) FROM t WHERE u < n), "
        "x AS (SELECT k, unnest(range(n)) AS u, h FROM t WHERE u = n) SELECT k AS doc_id, 0 AS sent_idx, CAST(u AS INT) AS bp_idx, CAST(h[u + 1] AS INT) AS parent_idx, 'D' AS dep_type, CAST(u AS INT) AS phrase_idx, CAST(h[u + 1] AS INT) AS phrase_parent_idx, 'D' AS phrase_dep_type FROM x"
    )


ORACLES["dependency_trees"] = _tree_sql()


@query(f"WITH {UNITS}, n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i, f, s, q FROM u) SELECT k AS doc_id, 0 AS sent_idx, s AS category, CAST(greatest(i - q % 2, 0) AS INT) AS \"start\", CAST(i + 1 AS INT) AS \"end\" FROM n WHERE f = 'A'")
def gold_entities(spark, sf_dir):
    """Entities spelt by the one or two words that end at a base phrase."""
    own = units(spark, sf_dir).withColumn("n", (F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1).cast("int"))
    words = own.select(F.col("k").alias("doc_id"), F.lit(0).alias("sent_idx"), F.col("n").alias("morph_idx"), F.concat(F.lit("w"), F.col("n").cast("string")).alias("surf"))
    spelt = F.concat(F.when((F.col("q") % 2 == 1) & (F.col("n") > 0), F.concat(F.lit("w"), (F.col("n") - 1).cast("string"))).otherwise(""), F.lit("w"), F.col("n").cast("string"))
    ne = F.struct(F.lit("NE").alias("key"), F.concat_ws(":", "s", spelt).alias("value"))
    phrases = own.select(F.col("k").alias("doc_id"), F.lit(0).alias("sent_idx"), F.col("n").alias("last_morph"), F.when(F.col("f") == "A", F.array(ne)).otherwise(F.array(F.struct(F.lit("x").alias("key"), F.lit("y").alias("value")))).alias("features"))
    return structure.gold_entities(phrases, words)


READINGS = ((("犬", "が"), "いぬが", "いぬ;が"), (("食べ", "る"), "たべる", "たべ;る"), (("コーヒー",), "こーひー", "こーひー"), (("日", "本", "語"), "にほんご", "に;ほん;ご"))
KANJI_READINGS = {"犬": ["いぬ", "けん"], "食": ["た", "しょく"], "日": ["に", "ひ"], "本": ["ほん"], "語": ["ご"]}


@query(f"WITH {UNITS} SELECT k, i, CASE q % 4 " + " ".join(f"WHEN {n} THEN '{r[2]}'" for n, r in enumerate(READINGS)) + " END AS readings FROM u")
def piece_readings(spark, sf_dir):
    """The readings of a word's pieces, by the readings of its characters."""
    pick = lambda xs: F.element_at(F.lit(xs) if isinstance(xs, list) else xs, F.col("q") % 4 + 1)
    pieces = F.array(*[F.lit(list(r[0])) for r in READINGS])
    kanji = F.array(*[F.struct(F.lit(c).alias("character"), F.lit(r).alias("readings")) for c, r in KANJI_READINGS.items()])
    return units(spark, sf_dir).select("k", "i", F.array_join(lexicon.piece_readings(pick(pieces), pick([r[1] for r in READINGS]), kanji), ";").alias("readings"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'not one root' ELSE 'a cycle' END AS errors FROM orders")
def conll_errors(spark, sf_dir):
    """Sentences of three words: well-formed, with two roots, and with a cycle beside the root."""
    kind = F.col("o_orderkey") % 3
    line = lambda n, head: F.concat(F.lit(f"{n}\tw\tw\tX\t_\t_\t"), head.cast("string"), F.lit("\tdep\t_\t_"))
    text_ = F.concat_ws("\n", line(1, F.lit(0)), line(2, F.when(kind == 1, 0).when(kind == 2, 3).otherwise(1)), line(3, F.when(kind == 2, 2).otherwise(1)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(metrics.conll_errors(text_), ";").alias("errors"))


# --- sources and sinks


@query("SELECT 'd' || p_partkey % 20 AS doc_id, CAST(row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) - 1 AS INT) AS sent_idx, replace(p_name, ' ', '_') AS surf FROM part")
def annotated_folders(spark, sf_dir):
    """A corpus of one file a document in folders of their own, read again; ids come from the sentences' ids."""
    doc = F.col("p_partkey") % 20
    line = F.concat(F.lit("# S-ID:d"), doc.cast("string"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit("\n"), F.concat_ws(" ", bare("p_name"), bare("p_brand"), bare("p_type"), F.lit("名詞 6 普通名詞 1 * 0 * 0 NIL")), F.lit("\nEOS\n"))
    files = table(spark, sf_dir, "part").groupBy(doc.alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("t")))), lambda x: x["t"]), "").alias("text"))
    folder = shared_folder(spark)
    files.repartition("doc").write.partitionBy("doc").text(folder)
    found = sources.read_annotated(spark, folder, "*.txt", recursive=True)
    return found.select("doc_id", "sent_idx", F.col("morphemes")[0]["surf"].alias("surf"))


@query("SELECT chr(CAST(19968 + p_partkey AS INT)) AS character, 'か' || CASE WHEN p_size % 2 = 0 THEN ';あ.う' ELSE '' END AS readings, p_size AS strokes, p_brand AS meanings FROM part")
def kanji_lines(spark, sf_dir):
    """Lines of a kanji dictionary that were written as files and read again, without the built-in signs.

    A number that is no code point (a surrogate, or beyond the last) has the replacement character; its SQL can't be run.
    """
    from tsumugi.sources.dictionary import read_kanji

    n = F.col("p_partkey") + 19968
    known = ~n.between(0xD800, 0xDFFF) & (n <= 0x10FFFF)
    code = F.when(known, n).otherwise(0xFFFD)
    high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
    hexed = F.hex(code)
    character = F.decode(F.unhex(F.when(code < 0x10000, hexed).otherwise(F.concat(F.hex(high), F.hex(low)))), "UTF-16BE")
    character = F.concat(F.when(code == 0xFEFF, "#\n").otherwise(""), character)  # at the start of a file that character would be its mark
    line = F.concat(character, F.lit(" "), hexed, F.lit(" S"), F.col("p_size").cast("string"), F.lit(" G1 Yya Wa カ"), F.when(F.col("p_size") % 2 == 0, " あ.う-").otherwise(""), F.lit(" {"), F.col("p_brand"), F.lit("}"))
    folder = shared_folder(spark)
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(folder)
    found = read_kanji(spark, folder).where(F.map_contains_key("numbers", F.lit("strokes")))
    return found.select("character", F.array_join("readings", ";").alias("readings"), F.element_at("numbers", "strokes").alias("strokes"), F.array_join("meanings", ";").alias("meanings"))



def bare(c: str):
    return F.replace(F.col(c), F.lit(" "), F.lit("_"))


@query("SELECT p_partkey % 50 AS doc, CAST(row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1 AS INT) AS sent_idx, replace(p_name, ' ', '_') AS surf, replace(p_brand, ' ', '_') AS reading, replace(p_type, ' ', '_') AS lemma, '普通名詞' AS subpos, 's' || p_partkey AS sid FROM part")
def read_morpheme_lines(spark, sf_dir):
    """Fifty files of morpheme lines, one word a sentence, parsed back."""
    line = F.concat(F.lit("# S-ID:s"), F.col("p_partkey").cast("string"), F.lit("\n"), F.concat_ws(" ", bare("p_name"), bare("p_brand"), bare("p_type"), F.lit("名詞 6 普通名詞 1 * 0 * 0 NIL")), F.lit("\nEOS\n"))
    files = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("t")))), lambda x: x["t"]), "").alias("text"))
    cut = files.select("doc", F.posexplode(sources.sentence_texts("text")).alias("sent_idx", "t"))
    each = cut.select("doc", "sent_idx", sources.parse_sentences("t").alias("s")).select("doc", "sent_idx", "s.*")
    words = structure.word_table(each.withColumnRenamed("doc", "doc_id"))
    return words.select(F.col("doc_id").alias("doc"), "sent_idx", "surf", "reading", "lemma", "subpos", "sid")


@query("SELECT p_partkey, p_name AS surf, p_type AS reading, '代表表記:' || p_brand || '/' || p_type || CASE WHEN p_size % 2 = 0 THEN ' x:' || p_size ELSE '' END AS semantics, CAST(dense_rank() OVER (ORDER BY first_of) - 1 AS INT) AS subpos_no FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS first_of FROM part)")
def dictionary_lines(spark, sf_dir):
    """Entries from twelve-column lines that were written as files and read again, with ids by first appearance."""
    part = table(spark, sf_dir, "part")
    lines = part.select(F.col("p_name").alias("surf"), F.lit("0").alias("left_id"), F.lit("0").alias("right_id"), F.col("p_partkey").cast("string").alias("cost"), F.lit("名詞").alias("pos"), F.col("p_brand").alias("subpos"), F.lit("*").alias("conjform"), F.lit("*").alias("conjtype"), F.col("p_brand").alias("lemma"), F.col("p_type").alias("reading"), F.concat_ws("/", "p_brand", "p_type").alias("repname"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x:"), F.col("p_size").cast("string"))).otherwise("NIL").alias("sem"))
    folder = shared_folder(spark)
    lines.write.csv(folder)
    # read line by line, so that the line's number can be kept beside the entry (read_dictionary_lines reads entries as such)
    from tsumugi.sources.dictionary import COLUMNS

    rows = spark.read.schema(COLUMNS).csv(folder)
    entries = dictionary_entries(rows.withColumn("lemma", F.col("cost"))).withColumn("ord", F.col("lemma").cast("long"))
    found = encode_dictionary(entries)
    return found.select(F.col("ord").alias("p_partkey"), "surf", "reading", "semantics", F.col("subpos_no").cast("int").alias("subpos_no"))


@query("SELECT p_partkey, key, value FROM (SELECT p_partkey, unnest(['代表表記', 'ID', '人']) AS key, unnest([p_brand || '/' || p_container, CAST(p_size AS VARCHAR), NULL]) AS value FROM (SELECT p_partkey, p_size, replace(p_brand, ' ', '') AS p_brand, 'c' || p_size AS p_container FROM part))")
def semantics_as_items(spark, sf_dir):
    joined = F.concat(F.lit("代表表記:"), F.replace("p_brand", F.lit(" "), F.lit("")), F.lit("/"), F.lit("c"), F.col("p_size").cast("string"), F.lit(" ID:"), F.col("p_size").cast("string"), F.lit(" 人"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(semantics_items(joined)))


@query("SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN '# turn ' || turn || chr(10) ELSE '' END || replace(text, chr(10), ' '), '|' ORDER BY turn) AS shown FROM conversations GROUP BY conv_id")
def spaced_sentences(spark, sf_dir):
    own = table(spark, sf_dir, "conversations")
    shown = sinks.spaced(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("# turn "), F.col("turn").cast("string"))), F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "))
    return sinks.document_texts(own.select("conv_id", "turn", F.concat(F.when(F.col("turn") > 0, "|").otherwise(""), shown).alias("text")), "conv_id", ("turn",)).withColumnRenamed("text", "shown")


@query("SELECT vec_id, array_to_string(list_transform(list_filter(range(20), lambda i: (i * 7 + label) % 10 NOT IN (0, 1)), lambda i: 't' || (i * 7 + label) % 10), '') AS text FROM embeddings")
def generated_texts(spark, sf_dir):
    """Token ids of which padding and end are left out, and blanks deleted."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((i * 7 + F.col("label")) % 10).cast("int"))
    tokens = F.lit([f"▁t {k}" for k in range(10)])
    return table(spark, sf_dir, "embeddings").select("vec_id", sinks.generated_text(ids, tokens, [0, 1]).alias("text"))


@query("SELECT conv_id, string_agg(replace(text, '# D-ID:', ''), chr(10) || 'EOD' || chr(10) ORDER BY turn) || chr(10) || 'EOD' AS text FROM conversations GROUP BY conv_id")
def shown_raw_texts(spark, sf_dir):
    """Raw texts with their id lines, as shown to a user without them."""
    block = sinks.raw_block(F.col("conv_id").cast("string"), F.replace("text", F.lit("# D-ID:"), F.lit("")))
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n").alias("t"))
    return texts.select("conv_id", sinks.without_id_lines("t").alias("text"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_folders(spark, sf_dir):
    """A corpus written as a folder a split, and read back."""
    folder = shared_folder(spark)
    split = F.when(F.col("doc_id") % 4 == 0, "valid").when(F.col("doc_id") % 4 == 1, "test").otherwise("train")
    sinks.write_splits(table(spark, sf_dir, "documents").select("doc_id", split.alias("split")), folder, "parquet")
    return spark.read.parquet(folder).select("doc_id", "split")


@query("SELECT p_partkey, p_brand AS surf, p_type AS lemma, CASE WHEN p_size % 2 = 0 THEN '母音動詞' END AS conjtype, p_name || p_brand || p_type AS text FROM part")
def partial_annotations(spark, sf_dir):
    """Records with an annotated word between plain lines, a file each."""
    notes = F.concat(F.lit("\t"), F.col("p_brand"), F.lit("\tbaseform:"), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.lit("\tconjtype:母音動詞")).otherwise(""))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.concat_ws("\n", "p_name", notes, "p_type").alias("text"))
    return sources.read_partial_annotations(files).select(F.col("path").alias("p_partkey"), "surf", "lemma", "conjtype", "text")


@query("SELECT p_partkey AS ord, CAST(0 AS INT) AS morph_idx, p_brand AS surf, p_type AS lemma, 'm' AS conjtype FROM part WHERE p_size % 3 > 0 AND p_size % 5 > 0")
def partial_matches(spark, sf_dir):
    """Sentences whose text isn't the record's, or that lack its word, are left out."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    sentences = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), F.array(F.struct(F.when(size % 3 > 0, F.col("p_brand")).otherwise("other").alias("surf")), F.struct(F.lit("tail").alias("surf"))).alias("morphemes"))
    records = part.select(F.col("p_partkey").alias("ord"), F.when(size % 5 > 0, F.col("p_name")).otherwise("?").alias("text"), F.col("p_brand").alias("surf"), F.col("p_type").alias("lemma"), F.lit("m").alias("conjtype"), F.lit("f").alias("conjform"))
    found, _ = corpus.partial_matches(sentences, records)
    return found.select("ord", F.col("morph_idx").cast("int").alias("morph_idx"), "surf", "lemma", "conjtype")


@query("SELECT reason, count(*) AS \"count\" FROM (SELECT CASE WHEN p_size % 5 = 0 THEN 'text_mismatch' WHEN p_size % 3 = 0 THEN 'no_info' END AS reason FROM part) WHERE reason IS NOT NULL GROUP BY 1")
def exclusion_reasons(spark, sf_dir):
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    sentences = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), F.array(F.struct(F.when(size % 3 > 0, F.col("p_brand")).otherwise("other").alias("surf"))).alias("morphemes"))
    records = part.select(F.col("p_partkey").alias("ord"), F.when(size % 5 > 0, F.col("p_name")).otherwise("?").alias("text"), F.col("p_brand").alias("surf"), F.col("p_type").alias("lemma"), F.lit("m").alias("conjtype"), F.lit("f").alias("conjform"))
    return corpus.partial_matches(sentences, records)[1]


@query("SELECT p_partkey, 'kanji' AS category, repeat('K;', length(p_name)) || 'R:Y;K' AS kdr FROM part WHERE p_size % 2 = 0")
def typo_examples(spark, sf_dir):
    """Training examples: diffs that aren't typos are left out, examples that differ elsewhere are dropped."""
    size = F.col("p_size")
    diff = lambda a, b, c: F.struct(F.lit(a).alias("pre_str"), F.lit(b).alias("post_str"), F.lit(c).alias("category"))
    raw = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("X")).alias("pre_text"), F.concat("p_name", F.when(size % 2 == 0, "Y").otherwise("Z")).alias("post_text"), F.array(diff("X", "Y", "kanji"), diff("a", "b", "not-typo")).alias("diffs"))
    keyed = corpus.typo_examples(raw.select(F.concat(F.col("p_partkey").cast("string"), F.lit(";"), F.col("pre_text")).alias("pre_text"), F.concat(F.col("p_partkey").cast("string"), F.lit(";"), F.col("post_text")).alias("post_text"), "diffs"), True)
    key = F.substring_index("pre_text", ";", 1)
    return keyed.select(key.cast("long").alias("p_partkey"), "category", F.array_join(F.slice("kdr_tags", F.length(key) + 2, F.size("kdr_tags")), ";").alias("kdr"))


@query("SELECT corpus, count(*) AS n FROM (SELECT 'a' AS corpus FROM orders UNION ALL SELECT 'b' FROM customer) GROUP BY 1")
def all_corpora(spark, sf_dir):
    parts = {"a": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "b": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))}
    return corpus.all_corpora(parts).groupBy("corpus").agg(F.count("*").alias("n"))

