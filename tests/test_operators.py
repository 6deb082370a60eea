import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tsumugi import vocab
from tsumugi.operators import corpus, lexicon, metrics, numbering, segment, structure, windows


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def dealt(df):
    """The rows in other partitions: no result may depend on them."""
    return df.repartition(3)


def test_segmentation(spark):
    docs = spark.createDataFrame([("d", "花咲ガニを買ぅ。雨 だ", list("BIIIIIIIBII"), list("BIBIBBIBBIB"), list("KKVKKKSKKKK"))], "doc_id string, text string, s array<string>, w array<string>, o array<string>")
    cut = docs.withColumn("sentences", segment.sentences_by_tags("text", "s"))
    assert cut.first()["sentences"] == ["花咲ガニを買ぅ。", "雨 だ"]
    words = cut.select("doc_id", F.posexplode(segment.words_by_tags("sentences", "w", "o")).alias("place", "x")).select("doc_id", "place", "x.*")
    assert [r[2:] for r in rows_of(words, "place")] == [(0, "花咲", "花咲"), (0, "ガニ", "カニ"), (0, "を", "を"), (0, "買ぅ", "買う"), (0, "。", "。"), (1, "雨", "雨"), (1, " ", " "), (1, "だ", "だ")]
    known = segment.unknown_morphemes(words).orderBy("place").first()
    assert (known["lemma"], known["pos"], known["pos_id"], known["subpos_id"], known["conjform"]) == ("花咲", "未定義語", 15, 1, "*")
    assert spark.createDataFrame([("a.b!c",)], "t string").select(segment.split_sentences("t")).first()[0] == ["a.", "b!", "c"]
    assert spark.createDataFrame([(["ab", "c"],)], "s array<string>").select(segment.segment_tags("s")).first()[0] == ["B", "I", "B"]
    odd = spark.createDataFrame([("ab", ["I"]), (None, ["B"]), ("", [])], "t string, g array<string>")
    assert [r[0] for r in odd.select(segment.sentences_by_tags("t", "g")).collect()] == [["a"], None, []]


SPLIT = r"[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$"


def test_sentences_are_the_matches_of_their_rule(spark):
    rng = random.Random(3)
    texts = [None, "", ".", "\n", "。。a", "😀.😀", "a\n.\n", "a.\n", *("".join(rng.choice("ab.!。 \n😀") for _ in range(rng.randrange(12))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for found, own in df.select(segment.split_sentences("t"), F.regexp_extract_all("t", F.lit(SPLIT), F.lit(0))).collect():
        assert found == own
    odd = spark.createDataFrame([("a]b^c-d\\e",)], "t string").select(segment.split_sentences("t", "]^-\\")).first()[0]
    assert odd == ["a]", "b^", "c-", "d\\", "e"]


def test_sentences_are_cut_faster_than_their_matches_are_extracted(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghé字") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    text = " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(4_000))
    df = spark.createDataFrame([(text + str(k),) for k in range(100)], "t string").repartition(4).cache()

    def seconds(cut):
        began = time.time()
        df.select(F.sum(F.size(cut))).collect()
        return time.time() - began

    ways = [segment.split_sentences("t"), F.regexp_extract_all("t", F.lit(SPLIT), F.lit(0))]
    own, extracted = (min(x) for x in zip(*[[seconds(w) for w in ways] for _ in range(3)], strict=True))
    df.unpersist()
    assert own < extracted / 1.5, (own, extracted)


def test_ids(spark):
    docs = spark.createDataFrame([(k, "x" if k == 3 else None) for k in range(11)], "ord int, doc_id string")
    found = dict(rows_of(segment.assign_doc_ids(dealt(docs), "p").select("ord", "doc_id")))
    assert found[0] == "p-00" and found[10] == "p-10" and found[3] == "x"
    several = spark.createDataFrame([(f, k, "" if (f, k) == ("b", 1) else None, "" if k in (2, 5) else "t") for f in ("b", "a") for k in range(7)], "path string, ord int, doc_id string, text string").where("text != ''")
    found = {(f, k): i for f, k, i in rows_of(segment.assign_doc_ids(dealt(several), "q").select("path", "ord", "doc_id"))}
    assert found == {(f, k): f"q-{n:02}" for n, (f, k) in enumerate((f, k) for f in ("a", "b") for k in (0, 1, 3, 4, 6))}
    sents = spark.createDataFrame([("a", k, None) for k in range(10)] + [("b", 0, "own")], "doc_id string, sent_idx int, sid string")
    found = {(d, i): s for d, i, s in rows_of(segment.assign_sentence_ids(sents).select("doc_id", "sent_idx", "sid"))}
    assert found["a", 3] == "a-03" and found["b", 0] == "own"


def test_long_numbers_stay_whole(spark):
    sents = spark.createDataFrame([("a", 7, None), ("a", 123, None)], "doc_id string, sent_idx int, sid string")
    assert {r["sid"] for r in segment.assign_sentence_ids(sents).collect()} == {"a-7", "a-123"}


def test_numbers_with_nulls_ties_and_skew(spark):
    """Nulls first, a value that most rows have, and repeated rows: every row has a number, in order."""
    rows = [(None, k) for k in range(40)] + [(5, k) for k in range(300)] + [(k, 0) for k in range(60)] + [(7, 0)] * 3
    df = dealt(spark.createDataFrame(rows, "a int, b int"))
    found = sorted((r["n"], r["a"], r["b"], r["all"]) for r in numbering.numbered(df, ["a", "b"], "n", "all").collect())
    assert [n for n, *_ in found] == list(range(len(rows))) and {t for *_, t in found} == {len(rows)}
    assert [(a, b) for _, a, b, _ in found] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbering.numbered(df.limit(0), ["a"], "n").count() == 0
    ids = corpus.renumbered(df.where("a is null or a > 6"), "a", "b")
    assert sorted(r["example_id"] for r in ids.collect()) == list(range(40 + 53 + 3))
    split = Counter(r["split"] for r in corpus.seeded_split(df, "a").collect())
    assert split == {"train": 362, "valid": 20, "test": 21}


def test_capped_sample_is_the_sequential_scan(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice("aabcde") for _ in range(rng.randrange(4))]) for k in range(200)] + [(300, None), (301, ["z", None, "z"])]
    for per_key, total in ((3, 100), (20, 30), (1, 1)):
        taken, own = Counter(), []
        for k, keys in rows:
            room = sorted({x for x in keys or [] if x is not None and taken[x] < per_key})
            if room and len(own) < total:
                own.append((k, room))
                taken.update(room)
        assert rows_of(corpus.capped_sample(dealt(spark.createDataFrame(rows, "ord long, keys array<string>")), per_key, total)) == own


def test_length_buckets_are_in_order(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "n int")
    parts = corpus.length_buckets(df, "n", 4).withColumn("p", F.spark_partition_id()).collect()
    assert [r["n"] for r in sorted(parts, key=lambda r: r["p"])] == list(range(101))


def test_gold_char_tags(spark):
    words = spark.createDataFrame([("d", 0, 0, "ab", ["K", "D"]), ("d", 0, 1, "c", ["K"]), ("d", 1, 0, "e", ["K"])], "doc_id string, sent_idx int, morph_idx int, surf string, ops array<string>")
    found = rows_of(segment.gold_char_tags(words, F.col("sent_idx") == 0), "offset")
    assert found == [("d", 0, "a", "B", "B", "K"), ("d", 1, "b", "I", "I", "D"), ("d", 2, "c", "I", "B", "K"), ("d", 3, "e", None, None, None)]


def test_windows(spark):
    sents = spark.createDataFrame([("test-0", 0, 15), ("test-0", 1, 15), ("test-1", 0, 5)], "doc_id string, sent_idx int, n_tokens int")
    found = windows.split_documents(dealt(sents), 20, 1)
    assert sorted({r["window_id"] for r in found.collect()}) == ["test-0-s1i0", "test-0-s1i1", "test-1"]
    more = spark.createDataFrame([("d", k, n) for k, n in enumerate([20, 40, 30, 50, 20, 50])], "doc_id string, sent_idx int, n_tokens int")
    own = rows_of(windows.split_documents(dealt(more), 100, 1).select("win_idx", "sent_idx", "target"))
    assert [(w, s) for w, s, _ in own] == [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 4), (3, 5)]
    # the first window ends three sentences after nothing: all of them are its targets, so that every sentence is one's
    assert [(w, s) for w, s, t in own if t] == [(0, 0), (0, 1), (0, 2), (1, 3), (2, 4), (3, 5)]


def test_runs(spark):
    tags = ["B-A", "I-A", "I-B", "I-B", "B-B", "O", "I-A", "B-A"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(tags)], "d int, i int, tag string")
    assert rows_of(windows.bio_spans(dealt(df), ["d"], "i"), "start") == [(1, "A", 0, 2), (1, "B", 4, 5), (1, "A", 7, 8)]
    marks = spark.createDataFrame([(1, k, c, p) for k, (c, p) in enumerate([("X", "head"), ("X", "middle"), ("X", "tail"), ("Y", "single"), ("X", "tail"), ("Z", "head")])], "d int, i int, category string, part string")
    assert rows_of(windows.head_runs(marks, ["d"], "i"), "category") == [(1, "X", [0, 1, 2]), (1, "Y", [3])]
    units = spark.createDataFrame([(1, k, b, p) for k, (b, p) in enumerate([(False, 0.1), (True, 0.9), (False, 0.5), (False, 0.5)])], "d int, i int, b boolean, p double")
    islands = windows.clause_islands(dealt(units), ["d"], "i", "b")
    assert [r[-1] for r in rows_of(islands, "i")] == [0, 0, 1, 1]
    assert rows_of(windows.clause_heads(islands, ["d"], "i", "p"), "clause") == [(1, 0, 1), (1, 1, 2)]


WORDS = "doc_id string, sent_idx int, morph_idx int, surf string, word_features array<double>"


def test_chunks_entities_features(spark):
    f = [[0.9, 0.2, 0.0, 0, 0], [0.1, 0.6, 0.3, 0, 0], [0.9, 0.3, 0.8, 0, 0], [0.0, 0.1, 0.95, 0, 0], [0.9, 0.2, 0.2, 0.9, 0.9]]
    words = structure.chunk(dealt(spark.createDataFrame([("d", 0, k, s, [float(x) for x in f[k]]) for k, s in enumerate("あいうえお")], WORDS)))
    own = rows_of(words.select("morph_idx", "bp_idx", "phrase_idx", "is_head", "surf_begins"))
    assert [r[1:3] for r in own] == [(0, 0), (0, 0), (1, 0), (2, 1), (3, 2)]
    bps = rows_of(structure.base_phrases_of(words).select("bp_idx", "phrase_idx", "first_morph", "last_morph", "head_morph"))
    assert bps == [(0, 0, 0, 1, 0), (1, 0, 2, 2, 2), (2, 1, 3, 3, 3), (3, 2, 4, 4, 4)]
    entities = spark.createDataFrame([("d", 0, "PERSON", 0, 1), ("d", 0, "DATE", 1, 2)], "doc_id string, sent_idx int, category string, start int, end int")
    assert rows_of(structure.entity_features(entities, words)) == [("d", 0, 0, "DATE:い")]
    label = {n: k for k, n in enumerate(vocab.BASE_PHRASE_FEATURES)}

    def hot(**at):
        return [at.get(n, 0.0) for n in vocab.BASE_PHRASE_FEATURES]

    scores = [hot(**{"用言:動": 0.6, "用言:判": 0.7, "体言": 0.5}), hot(**{"節-区切:補文": 0.8, "節-主辞": 0.9}), hot(**{"節-主辞": 0.9}), hot(**{"節-主辞": 0.9})]
    phrases = spark.createDataFrame([("d", 0, k, p, scores[k]) for k, p in enumerate([0, 0, 1, 1])], "doc_id string, sent_idx int, bp_idx int, phrase_idx int, bp_features array<double>")
    found = rows_of(structure.base_phrase_features(dealt(phrases)).select("bp_idx", "features", "clause"), "bp_idx")
    assert found == [(0, {"用言": "判", "体言": None}, 0), (1, {"節-区切": "補文", "節-主辞": None}, 0), (2, {"節-主辞": None}, 1), (3, {"節-区切": None}, 1)]
    assert label["体言"] == 3


def test_trees_and_pairs(spark):
    heads = [("d", 0, 0, 0, [(1, "P")]), ("d", 0, 1, 1, [(0, "D"), (2, "D")]), ("d", 0, 2, 1, [(-1, "D")])]
    df = spark.createDataFrame(heads, "doc_id string, sent_idx int, bp_idx int, phrase_idx int, heads array<struct<head:int,dep_type:string>>")
    assert rows_of(structure.dependency_trees(dealt(df)), "bp_idx") == [("d", 0, 0, 1, "P", 0, 1, "P"), ("d", 0, 1, 2, "D", 1, -1, "D"), ("d", 0, 2, -1, "D", 1, -1, "D")]
    assert [r[0] for r in spark.createDataFrame([([1, 0],), ([1, -1],)], "h array<int>").select(structure.cyclic("h")).collect()] == [True, False]
    words = spark.createDataFrame([("d", 0, 0), ("d", 0, 1)], "doc_id string, sent_idx int, morph_idx int")
    assert rows_of(structure.head_candidates(words).select("src", "tgt")) == [(0, -1), (0, 1), (1, -1), (1, 0)]
    bps = spark.createDataFrame([("d", k) for k in range(3)], "doc_id string, global_idx int")
    assert rows_of(structure.antecedent_candidates(bps).select("src", "tgt")) == [(1, 0), (2, 0), (2, 1)]
    assert len(rows_of(structure.clause_pairs(spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, clause int")))) == 4


def test_relations(spark):
    schema = "doc_id string, src int, rel string, tgt_ord int, logit double, bp_idx int, sid string, target string, token string"
    rows = [("d", 0, "ガ", 0, 1.0, 0, "s", "犬", None), ("d", 0, "ガ", 1, 1.0, None, None, None, "[著者]"), ("d", 1, "ガ", 0, 0.0, 0, "s", "犬", None), ("d", 1, "ガ", 1, 1.0, None, None, None, "[著者]"), ("d", 2, "ガ", 1, 1.0, None, None, None, "[NULL]")]
    found = rows_of(structure.relations(dealt(spark.createDataFrame(rows, schema))), "src")
    assert found == [("d", 0, "ガ", "犬", "s", 0, None), ("d", 1, "ガ", "著者", None, None, None)]
    pairs = spark.createDataFrame([("d", 0, 1, "対比", "s", 3), ("d", 0, 0, "目的", "s", 1), ("d", 1, 0, "談話関係なし", "s", 1)], "doc_id string, modifier int, head int, relation string, head_sid string, head_bp_idx int")
    assert rows_of(structure.discourse_features(dealt(pairs))) == [("d", 0, "s/1/目的;s/3/対比")]
    edges = spark.createDataFrame([("d", 0, "ガ", 0, 3, None), ("d", 0, "ガ", 1, None, "不特定:人１"), ("d", 1, "ガ", 0, None, None)], "doc_id string, src int, rel string, ord int, tgt int, referent string")
    assert [r[-1] for r in rows_of(structure.argument_tags(edges), "src")] == [["3", "[不特定:人]"], ["[NULL]"]]
    assert spark.range(1).select(structure.special_indices(10)).first()[0]["[NULL]"] == 14


def test_lexicon(spark):
    entries = spark.createDataFrame([("けんか", "けんか", "けんか", "名詞", "サ変名詞", "*", "*", c, f"代表表記:{c}", k) for k, c in enumerate(["喧嘩/けんか", "献花/けんか"])], "surf string, reading string, lemma string, pos string, subpos string, conjtype string, conjform string, canon string, semantics string, ord int")
    words = spark.createDataFrame([(0, "けんか", "けんか", "名詞", "サ変名詞", "*", "献花/けんか"), (1, "犬", "いぬ", "名詞", "普通名詞", "*", None)], "key int, norm string, reading string, pos string, subpos string, conjtype string, canon string")
    found = lexicon.look_up(dealt(words), entries)
    assert [r["meanings"] for r in found.orderBy("key").collect()] == [["代表表記:喧嘩/けんか", "代表表記:献花/けんか"], []]
    assert [r["meanings"] for r in lexicon.look_up(words, entries, by="canon").orderBy("key").collect()] == [["代表表記:献花/けんか"], []]
    assert [tuple(x) for x in found.where("key = 0").select(lexicon.homographs(F.array("norm"), "meanings")).first()[0]] == [("けんか", "代表表記:献花/けんか")]
    inflection = spark.createDataFrame([("母音動詞", "タ系連用テ形", "て", "る"), ("子音動詞ラ行", "タ系連用テ形", "って", "る")], "conjtype string, conjform string, ending string, base_ending string")
    verbs = spark.createDataFrame([(0, "見て", "動詞", "*", "母音動詞", "タ系連用テ形"), (1, "見", "動詞", "*", "母音動詞", "未然形"), (2, "犬", "名詞", "普通名詞", "*", "*")], "key int, norm string, pos string, subpos string, conjtype string, conjform string")
    assert [r["lemmas"] for r in lexicon.recover_lemmas(verbs, entries, inflection, []).orderBy("key").collect()] == [["見る"], ["見"], ["犬"]]
    some = entries.select("surf", "pos", F.lit("*").alias("subpos"), F.lit("母音動詞").alias("conjtype"), F.concat("canon", F.lit("!")).alias("lemma"), "ord")
    asked = spark.createDataFrame([(0, "けんか", "名詞", "*", "母音動詞", "未然形")], "key int, norm string, pos string, subpos string, conjtype string, conjform string")
    assert lexicon.recover_lemmas(asked, some, inflection, [("母音動詞", "未然形")]).first()["lemmas"] == ["喧嘩/けんか!", "献花/けんか!"]
    pieces = spark.createDataFrame([(0, 0, 0, "計", "けい"), (0, 0, 1, "算", "[UNK]"), (0, 1, 2, "", ""), (0, 2, 3, "機", "[ID]")], "example_id int, word_idx int, token_idx int, token string, reading string")
    assert [r[-1] for r in rows_of(lexicon.word_readings(dealt(pieces)), "word_idx")] == ["けい算", "_", "機"]
    values = pieces.select("example_id", "word_idx", "token_idx", F.col("token_idx").cast("double").alias("value"))
    assert {h: rows_of(lexicon.pool(values, h), "word_idx")[0][-1] for h in ("first", "last", "max", "average")} == {"first": 0, "last": 1, "max": 1, "average": 0.5}
    with pytest.raises(ValueError, match="pooling"):
        lexicon.pool(values, "sum")
    kanji = spark.createDataFrame([(["計算", "機"], "けいさんき", [("計", ["けい"]), ("算", ["さん"]), ("機", ["き"])])], "p array<string>, r string, k array<struct<character:string,readings:array<string>>>")
    assert kanji.select(lexicon.piece_readings("p", "r", "k")).first()[0] == ["けいさん", "き"]


def test_entity_transfer(spark):
    both = spark.createDataFrame([("s", ["太", "郎", "は"], ["太郎", "は"])], "sid string, a array<string>, b array<string>")
    stretches = both.select("sid", F.inline(lexicon.aligned("a", "b")))
    entities = spark.createDataFrame([("s", "PERSON", 0, 2), ("s", "DATE", 1, 3)], "sid string, category string, start int, end int")
    moved = lexicon.transfer_entities(entities, stretches)
    assert rows_of(moved) == [("s", "PERSON", 0, 1)]
    assert rows_of(lexicon.onto_untagged(moved, moved)) == [("s", "PERSON", 0, 1)]
    nested = spark.createDataFrame([("s", 0, 3), ("s", 1, 2), ("s", 3, 4)], "sid string, start int, end int")
    assert rows_of(structure.outer_entities(nested)) == [("s", 0, 3), ("s", 3, 4)]
    kept = spark.createDataFrame([({"用言": "動", "NE": "OPTIONAL:x", "体言": None, "他": "y", "節-機能-目的": "z"},)], "f map<string,string>").select(structure.refreshed_features("f")).first()[0]
    assert kept == {"用言": "動", "体言": None, "節-機能-目的": "z"}


def test_fall_back(spark):
    words = spark.createDataFrame([("動詞", "*", "文語", "連体形たる"), ("未定義語", "未対応表現", "*", "*"), ("名詞", "人名", "*", "*")], "pos string, subpos string, conjtype string, conjform string")
    changed = structure.fall_back(words)
    assert rows_of(changed.select("pos", "subpos", "conjtype", "conjform")) == [("副詞", "*", "*", "*"), ("動詞", "*", "子音動詞ラ行", "基本形"), ("名詞", "人名", "*", "*")]
    assert rows_of(structure.restore(changed)) == rows_of(words)


def test_linear_form(spark):
    schema = "m array<struct<surf:string,reading:string,lemma:string,canon:string>>"
    given = [("髑髏", "どくろ/x", "髑髏", "髑髏/どくろ/z"), (" ", " ", " ", None), ("だ", "だ", "だ", None)]
    df = spark.createDataFrame([(given,)], schema)
    source, target = structure.linearize("m")
    row = df.select(source.alias("s"), target.alias("t")).first()
    assert row["s"] == "<extra_id_19><extra_id_5><extra_id_6><extra_id_5>だ"
    back = spark.createDataFrame([(row["t"] + "<extra_id_0>broken",)], "t string").select(structure.parse_linear("t")).first()[0]
    assert [tuple(x) for x in back] == [("髑髏", "どくろ", "髑髏", "髑髏/どくろ"), (" ", " ", " ", "\\␣/\\␣"), ("だ", "だ", "だ", None), ("@", "@", "@", None)]


def test_encoding(spark):
    df = spark.createDataFrame([(["B", None, "I"],)], "t array<string>")
    assert df.select(structure.encoded("t", 6, F.lit(["B", "I"]))).first()[0] == [-100, 0, -100, 1, -100, -100]
    assert df.select(metrics.padded(F.lit([1.0]), 3, "x_logits"), metrics.padded(F.lit([1]), 2, "labels")).first()[:] == ([1.0, -1024.0, -1024.0], [1, -100])
    import pandas as pd

    batches = list(structure.collate(iter([pd.DataFrame({"id": [1, 2, 3], "x": [[1], [1, 2], [3]]})]), {"x": 0}, 2))
    assert [b["x"] for b in batches] == [[[1, 0], [1, 2]], [[3]]]


def test_metrics(spark):
    texts = spark.createDataFrame([(0.0, "abc", "abd", "xbd"), (0.0, "a", "a", "a")], "threshold double, pre_text string, predicted string, post_text string")
    row = metrics.typo_scores(texts).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 0, 1) and row["f1"] == pytest.approx(2 / 3) and row["f0_5"] == pytest.approx(1.25 * 0.5 / 0.75)
    marks = spark.createDataFrame([("K", "K"), ("D", "K"), ("P", "P"), ("K", "S"), ("_", "K"), ("P", "P")], "gold string, system string")
    found = dict(rows_of(metrics.norm_scores(marks)))
    assert found["word_normalization_accuracy"] == pytest.approx(3 / 5) and found["word_normalization_f1"] == pytest.approx(2 / 3) and found["word_normalization_f1:P"] == 1.0 and found["word_normalization_f1:V"] == 0.0
    a = ("名詞", "人名", "*", "*")
    pairs = spark.createDataFrame([(a, a), (("x", "人名", "*", "*"), ("x", "人名", "*", "*"))], "gold struct<pos:string,subpos:string,conjtype:string,conjform:string>, system struct<pos:string,subpos:string,conjtype:string,conjform:string>")
    found = dict(rows_of(metrics.attribute_scores(pairs)))
    assert found["pos_f1"] == 0.5 and found["morphological_analysis_f1"] == pytest.approx(0.875)
    rows = spark.createDataFrame([(1, 1), (0, 1), (2, 0), (-100, 1)], "gold int, system int")
    found = dict(rows_of(metrics.discourse_scores(rows)))
    assert found["discourse_relation_analysis_accuracy"] == pytest.approx(1 / 3) and found["discourse_relation_analysis_f1"] == pytest.approx(0.5)
    empty = dict(rows_of(metrics.discourse_scores(rows.limit(0))))
    assert empty["discourse_relation_analysis_accuracy"] == 0.0
    longs = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 0.0), ("a", "discourse", 0.2), ("b", "discourse", 0.6)], "corpus string, key string, value double")
    assert dict(rows_of(metrics.roll_up(longs, {"all": ["x", "discourse"]}, (("discourse", "a"),)))) == {"x": 0.5, "discourse": 0.2, "all": 0.35}
    s = "array<struct<surf:string,reading:string,lemma:string,canon:string>>"
    morph = spark.createDataFrame([([("a", "x", "a", "a"), ("bc", "y", "bc", "z")], [("a", "x", "a", "a"), ("b", "y", "b", "z"), ("c", "y", "c", "z")])], f"system {s}, gold {s}")
    found = {r["key"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.morphology_scores(morph).collect()}
    assert found["surf"] == (1, 1, 2)
    losses = spark.createDataFrame([(1, 0, 2.0), (1, 1, 8.0), (2, 0, 4.0)], "example_id int, arrival int, loss double")
    assert metrics.mean_loss(losses).first()[0] == 3.0
    line = spark.createDataFrame([((0, "犬", "犬", None, None),)], "u struct<idx:int,form:string,lemma:string,parent_idx:int,dep_type:string>").select(metrics.conll_line()).first()[0]
    assert line.split("\t") == ["1", "犬", "犬", "_", "_", "_", "0", "D", "_", "_"]
    assert spark.createDataFrame([(line,)], "s string").select(metrics.conll_errors("s")).first()[0] == []
    unit = "struct<features:string,parent_idx:int,dep_type:string,rels:string>"
    g = spark.createDataFrame([(("g", 1, "D", "r"), ("s", 2, "P", "q"))], f"gold {unit}, system {unit}")
    assert tuple(metrics.partly_gold(g, 2).first()) == ("g", 1, "D", "q") and tuple(metrics.partly_gold(g, 1).first()) == ("s", 2, "P", "q")


def test_corpus(spark):
    raw = spark.createDataFrame([("待つの木", "松の木", [("待つ", "松", "kanji"), ("x", "y", "not-typo")]), ("あ", "い", [("う", "え", "k")])], "pre_text string, post_text string, diffs array<struct<pre_str:string,post_str:string,category:string>>")
    found = corpus.typo_examples(raw, True).collect()
    assert [(r["category"], r["kdr_tags"]) for r in found] == [("kanji", ["R:松", "D", "K", "K", "K"])]
    tags = spark.createDataFrame([(["_", "I:する", "I:が"],), (["I:する"],), (["I:です"],)], "ins_tags array<string>")
    assert rows_of(corpus.insertion_counts(tags)) == [("する", 2)]
    sents = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"]), (2, ["a"]), (3, ["b"])], "ord int, keys array<string>")
    assert rows_of(corpus.capped_sample(dealt(sents), 2, 10)) == [(0, ["a", "b"]), (1, ["a"]), (3, ["b"])]
    ids = spark.range(103).withColumnRenamed("id", "k")
    a = dict(rows_of(corpus.seeded_split(ids, "k").select("k", "split")))
    assert a == dict(rows_of(corpus.seeded_split(ids.repartition(7), "k").select("k", "split")))
    assert sorted([list(a.values()).count(s) for s in ("train", "valid", "test")]) == [5, 6, 92]
    m = "array<struct<surf:string>>"
    sentences = spark.createDataFrame([(0, "犬だ", [("犬",), ("だ",)]), (1, "x", [("x",)]), (2, "猫", [("猫",)])], f"ord int, text string, morphemes {m}")
    records = spark.createDataFrame([(0, "犬だ", "だ", "だ", "判定詞", "基本形"), (1, "y", "y", None, None, None), (2, "猫", "犬", None, None, None)], "ord int, text string, surf string, lemma string, conjtype string, conjform string")
    hits, reasons = corpus.partial_matches(sentences, records)
    assert rows_of(hits) == [(0, 1, "だ", "だ", "判定詞", "基本形")] and dict(rows_of(reasons)) == {"text_mismatch": 1, "no_info": 1}
    assert set(corpus.all_corpora({"a": ids, "b": ids}).select("corpus").distinct().toPandas()["corpus"]) == {"a", "b"}


def test_parsed_tables(spark):
    from tsumugi.sources.text import parse_annotated

    knp = """# S-ID:d-0
* 1D
+ 1D <NE:PERSON:山田太郎><体言>
山田 やまだ 山田 名詞 6 人名 5 * 0 * 0 NIL <基本句-主辞>
太郎 たろう 太郎 名詞 6 人名 5 * 0 * 0 NIL
は は は 助詞 9 副助詞 2 * 0 * 0 NIL
* -1D
+ -1D <NE:DATE:今日><用言:動>
今日 きょう 今日 名詞 6 時相名詞 10 * 0 * 0 NIL
EOS
""".replace("太郎 たろう 太郎 名詞 6 人名 5 * 0 * 0 NIL\nは は は 助詞 9 副助詞 2 * 0 * 0 NIL\n", "太郎 たろう 太郎 名詞 6 人名 5 * 0 * 0 NIL\n")
    parsed = spark.createDataFrame([("d", knp)], "doc_id string, text string").select("doc_id", F.posexplode(parse_annotated("text")).alias("sent_idx", "s")).select("doc_id", "sent_idx", "s.*")
    words, phrases = structure.word_table(parsed), structure.base_phrase_table(parsed)
    assert [r["surf"] for r in words.orderBy("morph_idx").collect()] == ["山田", "太郎", "今日"]
    assert [(r["first_morph"], r["last_morph"], r["global_idx"]) for r in phrases.orderBy("bp_idx").collect()] == [(0, 1, 0), (2, 2, 1)]
    assert rows_of(structure.gold_entities(phrases, words)) == [("d", 0, "DATE", 2, 3), ("d", 0, "PERSON", 0, 2)]


def test_normal_forms(spark):
    inflection = spark.createDataFrame([("母音動詞", "タ系連用テ形", "て", "る")], "conjtype string, conjform string, ending string, base_ending string")
    words = spark.createDataFrame([(0, "見てぇ", "見る", "母音動詞", "タ系連用テ形"), (1, "犬", "犬", "*", "*"), (2, "x", "y", "母音動詞", "未然形")], "key int, surf string, lemma string, conjtype string, conjform string")
    assert [r["norm"] for r in lexicon.normal_forms(words, inflection).orderBy("key").collect()] == ["見て", "犬", None]


def test_segmentation_scores(spark):
    gold = spark.createDataFrame([("d", 0, 2), ("d", 2, 3), ("d", 3, 5)], "k string, start int, end int")
    system = spark.createDataFrame([("d", 0, 2), ("d", 2, 5)], "k string, start int, end int")
    row = metrics.segmentation_scores(gold, system, ["k"]).first()
    assert (row["accuracy"], row["tp"], row["fp"], row["fn"]) == (0.8, 1, 1, 2)


def test_look_ups_store_no_pairs(spark):
    """Many words of a form with many entries: lists are made once a form, and a join doesn't stand below an aggregate."""
    n = 400
    entries = spark.range(n).select(F.lit("a").alias("surf"), F.lit("r").alias("reading"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("lemma"), F.lit("p").alias("pos"), F.lit("*").alias("subpos"), F.lit("t").alias("conjtype"), F.lit("c").alias("canon"), F.col("id").cast("string").alias("semantics"), (n - F.col("id")).alias("ord"))
    words = spark.range(n).select(F.col("id").alias("key"), F.when(F.col("id") > 0, "a").alias("norm"), F.lit("r").alias("reading"), F.lit("p").alias("pos"), F.lit("*").alias("subpos"), F.lit("t").alias("conjtype"), F.lit("f").alias("conjform"))
    joins = lambda df: sum("Join " in line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    found = lexicon.look_up(words, entries)
    assert joins(found) == 1
    assert {(r["key"], tuple(r["meanings"])) for r in found.collect()} == {(k, tuple(str(x) for x in range(n - 1, -1, -1)) if k else ()) for k in range(n)}
    lemmas = lexicon.recover_lemmas(words, entries, spark.createDataFrame([], "conjtype string, conjform string, ending string, base_ending string"), [("t", "f")])
    assert {(r["key"], tuple(r["lemmas"])) for r in lemmas.where("key > 0").collect()} == {(k, ("l0", "l2", "l1")) for k in range(1, n)} and joins(lemmas) <= 3


def test_windows_of_base_phrases_carry_neither_scores_nor_labels(spark):
    """What is shuffled of a base phrase are the places of its features: its scores would be ten times that."""
    n = len(vocab.BASE_PHRASE_FEATURES)
    rows = spark.range(40, numPartitions=2).select(F.expr("id div 8").cast("string").alias("doc_id"), F.lit(0).alias("sent_idx"), (F.col("id") % 8).cast("int").alias("bp_idx"), F.expr("id % 8 div 2").cast("int").alias("phrase_idx"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * (F.col("id") + 3) % 11) / 10.0).alias("bp_features"))
    found = structure.base_phrase_features(rows).drop("bp_features")
    for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "Window" not in line or "bp_features" not in line
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1]
    assert "_counted" in below.splitlines()[1]
    for r in found.collect():
        own = {}
        for k, label in enumerate(vocab.BASE_PHRASE_FEATURES):
            if ((k + 1) * (int(r["doc_id"]) * 8 + r["bp_idx"] + 3) % 11) / 10.0 >= 0.5 and label != "節-主辞" and not label.startswith("節-区切"):
                name, _, value = label.partition(":")
                own[name] = value or None
        assert {k: v for k, v in r["features"].items() if k not in ("節-主辞", "節-区切")} == own


def test_readings_of_equal_words_are_worked_out_once(spark):
    """Equal words are one entry of a batch's dictionary; a null anywhere gives null."""
    from tsumugi.kernels.align import align_reading

    schema = "k int, p array<string>, r string, c array<struct<character:string,readings:array<string>>>"
    kanji = [("日", ["に", "ひ"]), ("本", ["ほん"])]
    rows = [(0, ["日", "本"], "にほん", kanji), (1, ["日", "本"], "にほん", kanji), (2, ["日", "本"], "x", kanji), (3, None, "にほん", kanji), (4, ["日"], None, kanji), (5, ["日"], "ひ", None), (6, ['"\\日'], '"\\ひ', kanji)]
    found = dict(rows_of(spark.createDataFrame(rows, schema).select("k", lexicon.piece_readings("p", "r", "c")), "k"))
    known = {c: r for c, r in kanji}
    assert all(found[k] == align_reading(p, r, known) for k, p, r, _ in rows if k in (0, 1, 2)) and [found[k] for k in (3, 4, 5)] == [None] * 3
    assert "".join(found[6]) == '"\\ひ'
