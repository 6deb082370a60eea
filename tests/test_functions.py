import pytest
from pyspark.sql import functions as F

from tsumugi import vocab
from tsumugi.functions import decode, edits, text
from tsumugi.kernels import norm
from tsumugi.operators import segment


def one(spark, rows, schema, *columns):
    out = [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]
    return [r[0] for r in out] if len(columns) == 1 else out


def test_normalize_text(spark):
    given = ["おはよう．", 'a"b#c▁d', "１２３ＡＢ", "x\ny\tz ", "が", "", None]
    assert one(spark, [(t,) for t in given], "t string", text.normalize_text("t")) == ["おはよう.", "a”b＃c▂d", "123AB", "xyz", "が", "", None]


def test_small_text_functions(spark):
    assert one(spark, [("カタカナー",)], "t string", text.to_hiragana("t")) == ["かたかなー"]
    assert one(spark, [("a1!",)], "t string", text.to_full_width("t")) == ["ａ１！"]
    words = ["関ケ原", "ヶ原", "関ヶ", "アケア", "関ヶ原ケ"]
    assert one(spark, [(w,) for w in words], "t string", text.kanji_ga("t")) == [norm.kanji_ga(w) for w in words] == [1, -1, -1, -1, 1]
    assert one(spark, [("た/だ",), ("/",), ("た",)], "t string", text.clean_reading("t")) == ["た", "/", "た"]
    assert one(spark, [("a/b/c",), ("/b/c",), ("a/b",)], "t string", text.clean_canon("t")) == ["a/b", "/b/c", "a/b"]
    assert one(spark, [("う゛ぁ",)], "t string", text.normalize_reading("t")) == ["ゔぁ"]
    assert one(spark, [("ひらがな", True), ("漢字", False), ("", False)], "t string, x boolean", text.is_hiragana("t")) == [True, False, False]
    assert one(spark, [("a 髑髏ゔ",)], "t string", text.rare_to_special("t")) == ["a<extra_id_6><extra_id_19><extra_id_7>"]
    assert one(spark, [("a<extra_id_6><extra_id_19>",)], "t string", text.special_to_rare("t")) == ["a 髑髏"]
    assert one(spark, [(["はか.らう", "-さん"],)], "r array<string>", text.kanji_readings("r")) == [["はか", "はから", "さん"]]
    assert one(spark, [("逆接・譲歩(順方向)",), ("NIL",), ("?",)], "t string", text.fold_discourse("t")) == ["逆接", "談話関係なし", None]


def test_ids(spark):
    rows = [("test-0-s1i12",), ("a-s2",), ("d-s10i0-s1i3",), ("日本-s1i1",)]
    assert one(spark, rows, "t string", text.original_id("t"), text.window_stride("t")) == [("test-0", 1), ("a-s2", None), ("d-s10i0", 1), ("日本-s1i1", None)]
    assert one(spark, [("# D-ID:x\nab\ncd",), ("ab",)], "t string", text.doc_id_of("t"), text.without_doc_id("t")) == [("x", "ab\ncd"), (None, "ab")]


def test_features(spark):
    rows = [({"用言": "動", "体言": None, "節-機能-原因・理由": "ので"},)]
    assert one(spark, rows, "m map<string,string>", F.array_sort(text.feature_labels("m")))[0] == sorted(["用言:動", "体言", "節-機能-原因・理由"])
    assert one(spark, [("敬語:尊敬表現",), ("体言",)], "t string", text.label_to_feature("t")) == [("敬語", "尊敬表現"), ("体言", None)]
    rows = [("喧嘩/けんか", {'ALT-けんか-"代表表記:献花/けんか"': None, "x": "y"})]
    assert one(spark, rows, "c string, f map<string,string>", text.canon_alternatives("c", "f")) == [["喧嘩/けんか", "献花/けんか"]]
    rows = [("食べる", "たべる", "動詞", "*", "x"), ("みる", "みて", "動詞", "母音動詞", "みる"), ("見る", "みて", "動詞", "母音動詞", "みる")]
    assert one(spark, rows, "l string, r string, p string, t string, b string", text.synthesize_canon("l", "r", "p", "t", "b")) == ["食べる/たべる", "みる/みる", "見る/みる"]
    rows = [([("（笑）", "わらい", "名詞")],), ([("犬", "いぬ", "名詞")],), ([("犬", "イヌ", "名詞")],), ([("。", "。", "特殊")],)]
    assert one(spark, rows, "m array<struct<surf:string,reading:string,pos:string>>", text.excluded("m", ("（笑）",))) == [True, False, True, False]


@pytest.mark.parametrize(("threshold", "expected"), [(0.0, "松の木が枯れる"), (0.8, "待の木が枯れる"), (0.9, "待つの木が枯れる")])
def test_typo_thresholds(spark, threshold, expected):
    tokens, p = ["松", "<d>", *["<k>"] * 7], [0.65, 0.85, *[1.0] * 7]
    rows = [("待つの木が枯れる", tokens[:8], p[:8], ["<_>"] * 9, [1.0] * 9)]
    schema = "t string, k array<string>, kp array<double>, i array<string>, ip array<double>"
    keep, insert = edits.typo_tags("k", "kp", threshold, "R"), edits.typo_tags("i", "ip", threshold, "I")
    assert one(spark, rows, schema, edits.apply_edits("t", keep, insert)) == [expected]


def test_apply_edits(spark):
    schema = "t string, k array<string>, i array<string>"
    rows = [("紹介ことなかった", ["K"] * 8, ["_", "_", "I:する", "_", "I:が", "_", "_", "_", "_"]), ("𠮷b", ["R:c", "D"], ["_", "_", "I:!"]), ("", [], ["I:x"])]
    assert one(spark, rows, schema, edits.apply_edits("t", "k", "i")) == ["紹介することがなかった", "c!", "x"]
    with pytest.raises(Exception, match="one keep tag"):
        one(spark, [("ab", ["K"], ["_", "_"])], schema, edits.apply_edits("t", "k", "i"))


def test_norm_ops_natively(spark):
    rows = [("買ぅ", list("KS"), "買う"), ("ね〜〜", list("KED"), "ねえ"), ("ガニ", list("VK"), "カニ"), ("ー", ["P"], "ー"), ("そーー", list("KPD"), "そう"), ("か", ["S"], "か")]
    assert one(spark, rows, "s string, o array<string>, n string", edits.apply_norm_ops("s", "o")) == [r[2] for r in rows] == [norm.apply_ops(s, o, strict=False) for s, o, _ in rows]
    assert one(spark, rows[:3], "s string, o array<string>, n string", edits.apply_norm_ops("s", "o", strict=True)) == [r[2] for r in rows[:3]]
    with pytest.raises(Exception, match="small kana"):
        one(spark, rows[5:], "s string, o array<string>, n string", edits.apply_norm_ops("s", "o", strict=True))
    assert one(spark, [("買ぅ", "買う"), ("あ", ""), (None, "x")], "s string, n string", edits.infer_norm_ops("s", "n")) == [["K", "S"], ["_"], None]
    words = ["なあ", "もう", "関ケ原", "びみょうだ", "もどかしいな", "すげえな", "犬", "ようようだ"]
    assert one(spark, [(w,) for w in words], "s string", edits.denormalize("s")) == [norm.denormalize(w) for w in words]
    a = one(spark, [("そうだ", k) for k in range(40)], "s string, k long", edits.denormalize_randomly("s", "k"))
    assert a == one(spark, [("そうだ", k) for k in range(40)], "s string, k long", edits.denormalize_randomly("s", "k"))


def test_typo_gold_tags(spark):
    rows = [("待つの木", "松の木", [("待つ", "松")]), ("あ", "いう", [("え", "お")])]
    found = one(spark, rows, "a string, b string, d array<struct<pre_str:string,post_str:string>>", edits.typo_gold_tags("a", "b", "d"))
    assert found[0]["kdr_tags"] == ["R:松", "D", "K", "K", "K"] and found[1]["kdr_tags"] is None


def test_choices(spark):
    rows = [([0.5, 2.0, 2.0, -1.0],), ([],)]
    schema = "x array<double>"
    assert one(spark, rows, schema, decode.argmax("x")) == [1, None]
    assert one(spark, rows[:1], schema, decode.top_k("x", 3)) == [[1, 2, 0]]
    assert one(spark, rows[:1], schema, F.round(decode.softmax("x")[1], 6), decode.threshold_choice("x", 0.5)) == [(pytest.approx(0.439963, abs=1e-6), 0)]
    assert one(spark, [([1.0, 2.0], [True, False])], "x array<double>, m array<boolean>", decode.mask_scores("x", "m")) == [[1.0, vocab.MASKED]]
    assert one(spark, [([0.0, 0.0], 1), ([0.0, 0.0], -100)], "x array<double>, y int", decode.cross_entropy("x", "y")) == [pytest.approx(0.693147, abs=1e-6), None]
    assert one(spark, [([0.0, 0.0], [True, True]), ([0.0], [False])], "x array<double>, y array<boolean>", decode.cohesion_loss("x", "y")) == [pytest.approx(1.386294, abs=1e-6), None]
    assert one(spark, [([0.5, 0.5], [1, None])], "p array<double>, y array<int>", decode.binary_cross_entropy("p", "y")) == [pytest.approx(0.693147, abs=1e-6)]


def test_legal_attributes(spark):
    def hot(names, *at):
        return [next((float(len(at) - k) for k, a in enumerate(at) if a == n), 0.0) for n in names]

    rows = [
        (hot(vocab.POS, "動詞"), hot(vocab.SUBPOS, "人名", "*"), hot(vocab.CONJTYPES, "サ変動詞"), hot(vocab.CONJFORMS, "ダ列タ形", "基本形")),
        (hot(vocab.POS, "名詞"), hot(vocab.SUBPOS, "格助詞", "人名"), hot(vocab.CONJTYPES, "サ変動詞"), hot(vocab.CONJFORMS, "基本形")),
    ]
    found = one(spark, rows, "a array<double>, b array<double>, c array<double>, d array<double>", decode.morpheme_attributes("a", "b", "c", "d"))
    assert tuple(found[0]) == ("動詞", 2, "*", 0, "サ変動詞", 16, "基本形", 2)
    assert tuple(found[1]) == ("名詞", 6, "人名", 5, "*", 0, "*", 0)


def test_crf_in_spark(spark):
    tags = ("O", "B-X", "I-X")
    rows = [([[0.0, 1.0, 5.0], [0.0, 0.0, 3.0], [1.0, 0.0, 0.0]], [True, True, True]), ([[0.0, 9.0, 9.0]] * 2, [False, True])]
    schema = "e array<array<double>>, m array<boolean>"
    assert one(spark, rows, schema, decode.crf_decode(tags)("e", "m")) == [[1, 2, 0], [0, 1]]
    likelihood = spark.createDataFrame(rows, schema).withColumn("g", F.array(F.lit(1), F.lit(2), F.lit(0))).limit(1).select(decode.crf_log_likelihood(tags)("e", "g", "m")).first()[0]
    assert -2 < likelihood < 0


def test_diffs(spark):
    found = one(spark, [("abc", "abd", "xbd")], "a string, p string, g string", edits.diff_counts("a", "p", "g"))[0]
    assert tuple(found) == (1, 0, 1)
    assert [tuple(d) for d in one(spark, [("ab", "b")], "a string, b string", edits.char_diffs("a", "b"))[0]] == [("a", "")]


def test_char_tags(spark):
    rows = [([0, 1, 0, 1], [True, False, False, True])]
    assert one(spark, rows, "p array<int>, s array<boolean>", edits.char_tags("p", "s", vocab.WORD_TAGS)) == [["I", "B"]]
    assert one(spark, [(["x", "a", "b", "c", "d"], 3)], "t array<string>, n int", edits.tag_window("t", "n"), edits.tag_window("t", "n", 1)) == [(["a", "b", "c"], ["a", "b", "c", "d"])]


def test_denormalized_sentences(spark):
    rows = [([("そう", "そう"), ("だ", "だ"), ("ガニ", "カニ")], k) for k in range(60)]
    found = one(spark, rows, "w array<struct<surf:string,norm:string>>, k long", edits.denormalize_sentence("w", "k", 1.0))
    assert all(f[1:] == ["だ", "ガニ"] for f in found) and {f[0] for f in found} > {"そう"}


def test_edit_codes_equal_edit_tags(spark):
    """Codes with replacements and insertions apart give what one tag a character gives."""
    import random

    rng = random.Random(2)
    rows = []
    for k in range(200):
        text = "".join(rng.choice("aé犬😀\n ") for _ in range(rng.randrange(12)))
        keep = [rng.choice(["K", "_", "D", "R:" + rng.choice(["", "x", "猫猫"])]) for _ in text]
        insert = [rng.choice(["_", "_", "I:" + rng.choice(["", "y", "鳥"])]) for _ in range(len(text) + 1)]
        rows.append((k, text, keep, insert, "".join(t[0] for t in keep), [t[2:] for t in keep if t[0] == "R"], "".join(t[0] for t in insert), [t[2:] for t in insert if t[0] == "I"]))
    rows.append((-1, None, [], ["_"], "", [], "_", []))
    rows.append((-2, "a", ["K"], ["_", "_"], None, [], "__", []))
    df = spark.createDataFrame(rows, "k int, text string, keep array<string>, insert array<string>, kc string, r array<string>, ic string, i array<string>").repartition(3)
    found = df.select("k", edits.apply_edits("text", "keep", "insert").alias("tags"), edits.apply_edit_codes("text", "kc", "r", "ic", "i").alias("codes")).collect()
    assert all(x["tags"] == x["codes"] for x in found if x["k"] >= 0) and {x["codes"] for x in found if x["k"] < 0} == {None}
    for bad in (("a", "KK", [], "__", []), ("a", "K", [], "_", []), ("a", "R", [], "__", []), ("a", "K", [], "I_", [])):
        one = spark.createDataFrame([bad], "text string, kc string, r array<string>, ic string, i array<string>")
        with pytest.raises(Exception, match="are needed"):
            one.select(edits.apply_edit_codes("text", "kc", "r", "ic", "i")).collect()


def test_sentences_by_codes(spark):
    df = spark.createDataFrame([(0, "犬。猫。", "BIBI"), (1, "abc", "IBI"), (2, "", ""), (3, None, "B"), (4, "abcd", "BI"), (5, "ab", "BIBB"), (6, "x", None)], "k int, text string, codes string")
    found = df.select("k", segment.sentences_by_tags("text", "codes").alias("a"), segment.sentences_by_tags("text", F.when(F.col("codes") == "", F.array().cast("array<string>")).otherwise(F.split("codes", ""))).alias("b")).orderBy("k").collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] and found[0]["a"] == ["犬。", "猫。"]


def test_functions_see_bounded_pieces_of_a_batch(spark):
    """What a function holds at a time doesn't grow with the rows of a batch: texts, lists and structs, with nulls."""
    import pandas as pd
    import pyarrow as pa

    from tsumugi.functions.arrow import PIECE_BYTES, arrow, batch

    @batch("long")
    def sizes(text):
        assert text.nbytes <= 2 * PIECE_BYTES
        return pa.array([None if t is None else len(text) for t in text.to_pylist()], pa.int64())

    @arrow("struct<n:long,own:array<string>>")
    def halves(text):
        assert text.map(len, na_action="ignore").sum() <= 2 * PIECE_BYTES
        return pd.DataFrame({"n": text.map(len, na_action="ignore"), "own": [None if t is None else [t[:2], t[-1]] for t in text]})

    rows = spark.range(3000, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.concat("id", F.repeat(F.lit("x"), 3000))).alias("t"))
    found = rows.select("id", sizes("t").alias("s"), halves("t").alias("h")).collect()
    assert len(found) == 3000 and all(r["h"]["n"] == 3000 + len(str(r["id"])) and r["h"]["own"] == [(str(r["id"]) + "x")[:2], "x"] and r["s"] < 3000 for r in found if r["id"] % 7)
    assert all(r["s"] is None and r["h"]["n"] is None and r["h"]["own"] is None for r in found if r["id"] % 7 == 0)
