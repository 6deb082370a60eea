"""The word stage from stimuli (not a model's output) to written analyses; two documents, with all kinds of annotation."""

import pytest
from pyspark.sql import functions as F

from tsumugi import vocab as v
from tsumugi.plans import pipeline, word_stage
from tsumugi.sources.text import annotated

WORDS = {
    ("test-0", "test-0-0"): ["太郎", "と", "次郎", "は", "よく", "けんか", "する"],
    ("test-1", "test-1-0"): ["辛い", "ラーメン", "が", "好きな", "ので", "頼み", "ました"],
}
READ = {"太郎": "たろう", "次郎": "じろう", "辛い": "からい", "ラーメン": "らーめん", "好きな": "すきな", "頼み": "たのみ"}
KIND = {
    "太郎": ("名詞", "人名"), "と": ("助詞", "格助詞"), "次郎": ("名詞", "人名"), "は": ("助詞", "副助詞"), "よく": ("副詞", "*"), "けんか": ("名詞", "サ変名詞"), "する": ("動詞", "*", "サ変動詞", "基本形"),
    "辛い": ("形容詞", "*", "イ形容詞アウオ段", "基本形"), "ラーメン": ("名詞", "普通名詞"), "が": ("助詞", "格助詞"), "好きな": ("形容詞", "*", "ナ形容詞", "ダ列基本連体形"), "ので": ("助動詞", "*", "ナ形容詞", "ダ列タ系連用テ形"),
    "頼み": ("動詞", "*", "子音動詞マ行", "基本連用形"), "ました": ("接尾辞", "動詞性接尾辞", "動詞性接尾辞ます型", "タ形"),
}
HEADS = {"太郎", "次郎", "よく", "けんか", "辛い", "ラーメン", "好きな", "頼み"}
ENDS = {"と", "は", "よく", "する", "辛い", "が", "ので", "ました"}
PREDICATES = {"よく", "けんか", "辛い", "好きな", "頼み"}
FEATURES = {
    "太郎": ["体言", "SM-主体"], "次郎": ["体言", "SM-主体"], "よく": ["修飾"], "けんか": ["用言:動", "時制:非過去", "節-主辞", "節-区切", "レベル:C", "動態述語"], "辛い": ["用言:形", "時制:非過去", "レベル:B-", "状態述語"], "ラーメン": ["体言"],
    "好きな": ["用言:形", "時制:非過去", "節-主辞", "節-区切", "レベル:B+", "状態述語", "節-機能-原因・理由"], "頼み": ["用言:動", "時制:過去", "節-主辞", "節-区切", "レベル:C", "動態述語", "敬語:丁寧表現"],
}
DEPENDS = {"太郎": (2, "P"), "次郎": (5, "D"), "よく": (5, "D"), "けんか": (-1, "D"), "辛い": (1, "D"), "ラーメン": (3, "D"), "好きな": (5, "D"), "頼み": (-1, "D")}
ARGUMENTS = {"けんか": [("ガ", 2)], "辛い": [("ガ", 1)], "好きな": [("ガ", 1), ("ガ２", "[著者]")], "頼み": [("ガ", "[著者]"), ("ヲ", 1)]}
EXPECTED = """\
# S-ID:test-0-0 stimulus
* 1P
+ 1P <NE:PERSON:太郎><体言><SM-主体>
太郎 たろう 太郎 名詞 6 人名 5 * 0 * 0 "代表表記:太郎/たろう 人名" <基本句-主辞>
と と と 助詞 9 格助詞 1 * 0 * 0
* 3D
+ 3D <NE:PERSON:次郎><体言><SM-主体>
次郎 じろう 次郎 名詞 6 人名 5 * 0 * 0 "代表表記:次郎/じろう 人名" <基本句-主辞>
は は は 助詞 9 副助詞 2 * 0 * 0
* 3D
+ 3D <修飾>
よく よく よく 副詞 8 * 0 * 0 * 0 <基本句-主辞><用言表記先頭><用言表記末尾>
* -1D
+ -1D <rel type="ガ" target="次郎" sid="test-0-0" id="1"/><用言:動><時制:非過去><レベル:C><動態述語><節-区切><節-主辞>
けんか けんか けんか 名詞 6 サ変名詞 2 * 0 * 0 "代表表記:喧嘩/けんか" <基本句-主辞><用言表記先頭><用言表記末尾><ALT-けんか-けんか-けんか-6-2-0-0-"代表表記:献花/けんか">
する する する 動詞 2 * 0 サ変動詞 16 基本形 2
EOS
# S-ID:test-1-0 stimulus
* 1D
+ 1D <rel type="ガ" target="ラーメン" sid="test-1-0" id="1"/><用言:形><時制:非過去><レベル:B-><状態述語>
辛い からい 辛い 形容詞 3 * 0 イ形容詞アウオ段 18 基本形 2 <基本句-主辞><用言表記先頭><用言表記末尾>
* 2D
+ 2D <体言>
ラーメン らーめん ラーメン 名詞 6 普通名詞 1 * 0 * 0 <基本句-主辞>
が が が 助詞 9 格助詞 1 * 0 * 0
* 3D
+ 3D <rel type="ガ" target="ラーメン" sid="test-1-0" id="1"/><rel type="ガ２" target="著者"/><用言:形><時制:非過去><レベル:B+><状態述語><節-機能-原因・理由><節-区切><節-主辞><談話関係:test-1-0/3/原因・理由>
好きな すきな 好きだ 形容詞 3 * 0 ナ形容詞 21 ダ列基本連体形 3 <基本句-主辞><用言表記先頭><用言表記末尾>
ので ので のだ 助動詞 5 * 0 ナ形容詞 21 ダ列タ系連用テ形 12
* -1D
+ -1D <rel type="ガ" target="著者"/><rel type="ヲ" target="ラーメン" sid="test-1-0" id="1"/><用言:動><時制:過去><レベル:C><動態述語><敬語:丁寧表現><節-区切><節-主辞>
頼み たのみ 頼む 動詞 2 * 0 子音動詞マ行 9 基本連用形 8 <基本句-主辞><用言表記先頭><用言表記末尾>
ました ました ます 接尾辞 14 動詞性接尾辞 7 動詞性接尾辞ます型 31 タ形 7
EOS
"""


def one_hot(names, chosen):
    return [1.0 if n in chosen else 0.0 for n in names]


@pytest.fixture
def given(spark):
    words, rows = [], []
    for (doc, sid), own in WORDS.items():
        n = len(own)
        for k, w in enumerate(own):
            words.append((doc, 0, k, sid, "stimulus", w, w, "_", None))
            pos, sub, kind, form = (*KIND[w], "*", "*")[:4]
            flags = [f for f, s in (("基本句-主辞", HEADS), ("基本句-区切", ENDS), ("文節-区切", ENDS), ("用言表記先頭", PREDICATES), ("用言表記末尾", PREDICATES)) if w in s]
            rest = [(r, n + v.SPECIAL_TOKENS.index("[NA]" if r == "=" else "[NULL]"), 1.0) for r in word_stage.RELATIONS]
            best = [(r, t if isinstance(t, int) else n + v.SPECIAL_TOKENS.index(t), 2.0) for r, t in ARGUMENTS.get(w, [])]
            discourse = [(5, "原因・理由"), (3, v.NO_DISCOURSE)] if w == "好きな" else []
            rows.append((doc, k, READ.get(w, w), one_hot(v.POS, [pos]), one_hot(v.SUBPOS, [sub]), one_hot(v.CONJTYPES, [kind]), one_hot(v.CONJFORMS, [form]), one_hot(v.WORD_FEATURES, flags), "B-PERSON" if w in ("太郎", "次郎") else "O", one_hot(v.BASE_PHRASE_FEATURES, FEATURES.get(w, [])), [DEPENDS[w]] if w in DEPENDS else [], best + rest, discourse))
    entry = lambda k, surf, reading, sub, canon, more="": (surf, reading, surf, "名詞", sub, "*", "*", canon, f"代表表記:{canon}{more}", k)
    entries = [entry(0, "太郎", "たろう", "人名", "太郎/たろう", " 人名"), entry(1, "次郎", "じろう", "人名", "次郎/じろう", " 人名"), entry(2, "けんか", "けんか", "サ変名詞", "喧嘩/けんか"), entry(3, "けんか", "けんか", "サ変名詞", "献花/けんか"), entry(4, "けんか", "けんか", "普通名詞", "県下/けんか")]
    inflection = [("ナ形容詞", "ダ列基本連体形", "な", "だ"), ("ナ形容詞", "ダ列タ系連用テ形", "で", "だ"), ("子音動詞マ行", "基本連用形", "み", "む"), ("動詞性接尾辞ます型", "タ形", "ました", "ます")]
    return (
        spark.createDataFrame(words, "doc_id string, sent_idx int, morph_idx int, sid string, comment string, surf string, lemma string, reading string, canon string").repartition(3),
        spark.createDataFrame(rows, word_stage.PREDICTIONS).repartition(2),
        word_stage.Dictionary(spark.createDataFrame(entries, "surf string, reading string, lemma string, pos string, subpos string, conjtype string, conjform string, canon string, semantics string, ord int"), spark.createDataFrame(inflection, "conjtype string, conjform string, ending string, base_ending string")),
    )


def test_analyses_are_written(given):
    words, predictions, dictionary = given
    sentences = word_stage.assemble(words, predictions, dictionary)
    texts = [r["text"] for r in word_stage.written(sentences).orderBy("doc_id").collect()]
    assert "".join(texts) == EXPECTED


def test_what_an_earlier_stage_made_stays(given):
    words, predictions, dictionary = given
    kept = words.withColumn("reading", F.when(F.col("surf") == "太郎", "たろう").otherwise("x")).withColumn("canon", F.when(F.col("surf") == "太郎", "太郎/たろう"))
    found = word_stage.morphemes(kept, predictions, dictionary, keep=True).collect()
    assert {(r["surf"], r["reading"], r["lemma"], r["semantics"]) for r in found if r["doc_id"] == "test-0"} >= {("太郎", "たろう", "太郎", "代表表記:太郎/たろう 人名"), ("次郎", "x", "次郎", None)}
    assert len(found) == 14


def test_no_words(given):
    words, predictions, dictionary = given
    assert word_stage.assemble(words.limit(0), predictions, dictionary).count() == 0


def registry(rows):
    """A word predictor that looks its rows up, and a sequence-to-sequence one that reads each word as itself."""
    import pandas as pd

    fields = [c.split()[0] for c in word_stage.PREDICTIONS.split(", ")][2:]
    known = {(r[0], r[1]): dict(zip(fields, r[2:], strict=True)) for r in rows}

    def word(frames):
        for f in frames:
            for d, words in zip(f["doc_id"], f["words"], strict=True):
                assert "".join(w["surf"] for w in words) == "".join(WORDS[d, f"{d}-0"]) and all(w["target"] for w in words)
            yield f[["doc_id", "win_idx"]].assign(words=[[known[d, k] for k in range(len(words))] for d, words in zip(f["doc_id"], f["words"], strict=True)])

    def seq2seq(frames):
        for f in frames:
            one = lambda t: "".join(f"{v.SURF}{w}{v.READING}{READ.get(w, w)}{v.LEMMA}{w}{v.CANON}{w}/{READ.get(w, w)}" for w in t.split(v.DELIMITER))
            yield f[["doc_id", "sent_idx"]].assign(target=f["source"].map(one))

    own = pipeline.Registry()
    own.register("word", word, word_stage.WINDOW_PREDICTIONS)
    own.register("seq2seq", seq2seq, "doc_id string, sent_idx int, target string")
    return own


LINES = "".join(f"# S-ID:{sid} stimulus\n" + "".join(f"{w} _ {w} 未定義語 15 その他 1 * 0 * 0\n" for w in own) + "EOS\n" for (_, sid), own in WORDS.items())


def test_annotated_input_end_to_end(spark, given, tmp_path):
    words, predictions, dictionary = given
    rows = [tuple(x if not isinstance(x, list) else [y.asDict() if hasattr(y, "asDict") else y for y in x] for x in r) for r in predictions.collect()]
    own = pipeline.Pipeline(registry(rows), dictionary=dictionary)
    (tmp_path / "in.jumanpp").write_text(LINES)
    found = pipeline.analyze(spark, own, "word", files=[str(tmp_path)], kind="jumanpp")
    assert "".join(r["text"] for r in pipeline.rendered(found, "word").orderBy("doc_id").collect()) == EXPECTED
    read = pipeline.analyze(spark, own, "seq2seq", text=LINES, kind="jumanpp")
    lines = "".join(r["text"] for r in pipeline.rendered(read, "seq2seq").orderBy("doc_id").collect())
    assert lines.startswith('# S-ID:test-0-0\n太郎 たろう 太郎 未定義語 15 その他 1 * 0 * 0 "代表表記:太郎/たろう"\nと と と') and lines.count("EOS") == 2
    both = pipeline.analyze(spark, own, "seq2seq,word", text=LINES, kind="jumanpp")
    text = "".join(r["text"] for r in pipeline.rendered(both, "word").orderBy("doc_id").collect())
    assert "太郎 たろう 太郎 名詞 6 人名 5 * 0 * 0 \"代表表記:太郎/たろう 人名\"" in text and "好きな すきな 好きな 形容詞" in text
    again = annotated(spark.createDataFrame([("x", EXPECTED)], "path string, text string"))
    assert "".join(r["text"] for r in word_stage.written(again).orderBy("doc_id").collect()) == EXPECTED
    pipeline.write(found, "word", str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.txt"))) == EXPECTED
    two = annotated(spark.createDataFrame([("x", LINES)], "path string, text string"))
    sets = pipeline.over_corpora(own, {"a": two, "b": two.where("doc_id = 'test-1'")}, "word")
    assert sorted((r["corpus"], r["doc_id"]) for r in sets.collect()) == [("a", "test-0"), ("a", "test-1"), ("b", "test-1")]
    with pytest.raises(LookupError, match="dictionary"):
        pipeline.analyze(spark, pipeline.Pipeline(registry(rows)), "word", text=LINES, kind="jumanpp")


def long_words(spark, sizes):
    """Documents of sentences of so many one-letter words each; a sentence's words are its letter and place."""
    rows = [(d, s, k, chr(97 + s % 26)) for d, own in sizes.items() for s, n in enumerate(own) for k in range(n)]
    words = spark.createDataFrame(rows, "doc_id string, sent_idx int, morph_idx int, surf string").withColumns({"reading": F.lit("_"), "lemma": F.col("surf")})
    return word_stage.with_places(words).repartition(5)


@pytest.mark.parametrize("stride", [-1, 1, 2, 3])
def test_windows_are_whole_and_merged_in_place(spark, stride):
    """Each word is predicted once, in the window whose target it is; places in windows become places in documents."""
    import pandas as pd

    from tsumugi.kernels.spans import split_spans
    from tsumugi.operators import predicting

    sizes = {"a": [4, 7, 3, 12, 2, 2, 9, 1], "b": [5, 5], "c-s1i0": [11] * 9, "d": [3, 30, 4], "e": [1] * 40}
    own = long_words(spark, sizes)
    fitting, rejected = predicting.word_windows(own, 20, stride)
    schema = "doc_id string, win_idx int, words array<struct<seen:string,heads:array<struct<head:int,dep_type:string>>,cohesion:array<struct<rel:string,tgt:int,logit:double>>,discourse:array<struct<tgt:int,relation:string>>>>"

    def predictor(frames):
        for f in frames:
            out = []
            for words in f["words"]:
                n, text = len(words), "".join(w["surf"] for w in words)
                assert 0 < n <= 20 and words[0]["morph_idx"] == 0 and any(w["target"] for w in words)
                out.append([{"seen": text, "heads": [{"head": -1, "dep_type": "D"}, {"head": k, "dep_type": "D"}], "cohesion": [{"rel": "x", "tgt": k, "logit": 1.0}, {"rel": "x", "tgt": n + 3, "logit": 0.5}], "discourse": [{"tgt": n - 1, "relation": "y"}]} for k in range(n)])
            yield pd.DataFrame({"doc_id": f["doc_id"], "win_idx": f["win_idx"], "words": out})

    found = predicting.in_document(fitting, fitting.select("doc_id", "win_idx", "words").mapInPandas(predictor, schema)).collect()
    expected = {}
    for d, own_sizes in sizes.items():
        n, upto = sum(own_sizes), [sum(own_sizes[:k]) for k in range(len(own_sizes) + 1)]
        spans = [(0, len(own_sizes))] if n <= 20 else split_spans(own_sizes, 20, stride)
        ended = 0
        for a, b in spans:
            first = ended  # a window's targets are the sentences since the end of the window before
            if sum(own_sizes[a:b]) <= 20:
                text = "".join(chr(97 + s % 26) * own_sizes[s] for s in range(a, b))
                for w in range(upto[first], upto[b]):
                    expected[d, w] = (text, [-1, w], [w, n + 3], [upto[b] - 1])
            ended = b
        assert ended == len(own_sizes)
    got = {(r["doc_id"], r["word_idx"]): (r["seen"], [h["head"] for h in r["heads"]], [c["tgt"] for c in r["cohesion"]], [x["tgt"] for x in r["discourse"]]) for r in found}
    assert len(found) == len(got) and got == expected
    assert {(r["doc_id"], len(r["words"])) for r in rejected.collect()} == {("d", 30)}


def test_a_prediction_of_another_length_is_an_error(spark):
    from tsumugi.operators import predicting

    windows, _ = predicting.word_windows(long_words(spark, {"a": [3]}), 20, 1)
    short = windows.select("doc_id", "win_idx", F.array(F.struct(F.lit("x").alias("seen"))).alias("words"))
    with pytest.raises(Exception, match="a window of 3 words has 1"):
        predicting.in_document(windows, short).collect()


def test_predictions_keep_their_place_without_a_shuffle_of_windows(spark):
    """Windows are made where a document's words are, predicted in frames of bounded size and put in place without a join."""
    import pandas as pd

    from tsumugi.operators import predicting

    rows = [(str(d), s, k, "w" * 20) for d in range(300) for s in range(10) for k in range(20)]
    words = spark.createDataFrame(rows, "doc_id string, sent_idx int, morph_idx int, surf string").repartition(1, "doc_id")
    windows, rejected = predicting.word_windows(word_stage.with_places(words), 1200, 1)

    def predictor(frames):
        held = []
        for f in frames:
            assert len(f) < 1000 and list(f.columns) == ["doc_id", "win_idx", "window_id", "words"]
            held.append(pd.DataFrame({"doc_id": f["doc_id"], "win_idx": f["win_idx"], "words": [[{"seen": f"{k}/{len(w)}"} for k in range(len(w))] for w in f["words"]]}))
        yield from reversed(held)  # answers may come in another order than examples

    own = pipeline.Registry()
    own.register("word", predictor, "doc_id string, win_idx int, words array<struct<seen:string>>")
    found = predicting.in_place(own.predict("word", predicting.with_targets(windows), predicting.PLACES))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("MapInArrow")[0].count("Exchange") == 0
    got = {(r["doc_id"], r["word_idx"]): r["seen"] for r in found.collect()}
    # windows of three sentences whose ends are a sentence apart: a word of a later sentence is seen in the window that ends with it
    assert got == {(str(d), s * 20 + k): f"{min(s, 2) * 20 + k if s > 2 else s * 20 + k}/60" for d in range(300) for s in range(10) for k in range(20)}
    assert rejected.count() == 0


def test_long_texts_in_windows_with_running_ids(spark, tmp_path, capsys):
    """char over windows of whole sentences: ids from 1 on through a document, output in the order of the input."""

    def char(frames):
        for f in frames:
            assert (f["text"].str.len() <= 10).all()
            tags = [["B" if i == 0 or t[i - 1] == "。" else "I" for i in range(len(t))] for t in f["text"]]
            yield f[["example_id"]].assign(sent_tags=tags, word_tags=[["B"] * len(t) for t in f["text"]], norm_ops=[["K"] * len(t) for t in f["text"]])

    own = pipeline.Registry()
    own.register("char", char, "example_id string, sent_tags array<string>, word_tags array<string>, norm_ops array<string>")
    lines = pipeline.Pipeline(own, max_length=12)
    text = "# D-ID:b\n犬。猫と鳥。魚だ。貝\nEOD\n# D-ID:a\n長い長い長い長い長い文。犬。\nEOD\n"
    found = pipeline.analyze(spark, lines, "char", text=text)
    texts = pipeline.rendered(found, "char")
    written = "".join(r["text"] for r in texts.orderBy(*pipeline.in_order(texts)).collect())
    assert [x for x in written.splitlines() if x.startswith("#")] == ["# S-ID:b-1", "# S-ID:b-2", "# S-ID:b-3", "# S-ID:b-4", "# S-ID:a-1"]
    assert "".join(x[0] for x in written.splitlines() if x[0] not in "#E") == "犬。猫と鳥。魚だ。貝犬。"
    assert [(r["doc_id"], r["text"]) for r in lines.rejected["char"].select("doc_id", "text").collect()] == [("a", "長い長い長い長い長い文。")]
    pipeline.write(found, "char", str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.txt"))) == written


def plain_char(frames):
    for f in frames:
        yield f[["example_id"]].assign(sent_tags=[["B"] + ["I"] * (len(t) - 1) for t in f["text"]], word_tags=[["B"] * len(t) for t in f["text"]], norm_ops=[["K"] * len(t) for t in f["text"]])


def plain_word(frames):
    """Nouns that depend on the next word, the last one on none."""
    for f in frames:
        out = []
        for words in f["words"]:
            n = len(words)
            ends = [k + 1 == n or words[k + 1]["sent_idx"] != w["sent_idx"] for k, w in enumerate(words)]
            out.append([{"reading": w["surf"], "pos_logits": one_hot(v.POS, ["名詞"]), "subpos_logits": one_hot(v.SUBPOS, ["普通名詞"]), "conjtype_logits": one_hot(v.CONJTYPES, ["*"]), "conjform_logits": one_hot(v.CONJFORMS, ["*"]), "word_features": one_hot(v.WORD_FEATURES, ["基本句-主辞", "基本句-区切", "文節-区切"]), "ne": "O", "bp_features": one_hot(v.BASE_PHRASE_FEATURES, ["体言"]), "heads": [{"head": -1 if ends[k] else k + 1, "dep_type": "D"}], "cohesion": [], "discourse": []} for k, w in enumerate(words)])
        yield f[["doc_id", "win_idx"]].assign(words=out)


CLI_PREDICTORS = pipeline.Registry()
CLI_PREDICTORS.register("char", plain_char, "example_id string, sent_tags array<string>, word_tags array<string>, norm_ops array<string>")
CLI_PREDICTORS.register("word", plain_word, word_stage.WINDOW_PREDICTIONS)


def test_command_line(spark, given, tmp_path, capsys):
    from tsumugi.__main__ import main

    given[2].write(str(tmp_path / "dictionary"))
    (tmp_path / "in.txt").write_text("# D-ID:z\n太郎\nEOD\n")
    (tmp_path / "and.txt").write_text("# D-ID:b\n犬猫\nEOD\n")  # given after the other
    arguments = ["--predictors", "tests.test_word_stage:CLI_PREDICTORS", "--filename", str(tmp_path / "in.txt"), "--filename", str(tmp_path / "and.txt")]
    with pytest.raises(SystemExit):
        main(arguments)
    capsys.readouterr()
    main([*arguments, "--dictionary", str(tmp_path / "dictionary")])
    out = capsys.readouterr().out
    assert [x.split(" <")[0] for x in out.splitlines() if x[0] in "#+*E"] == ["# S-ID:z-1", "* 1D", "+ 1D", "* -1D", "+ -1D", "EOS", "# S-ID:b-1", "* 1D", "+ 1D", "* -1D", "+ -1D", "EOS"]
    assert out.splitlines()[2] == "+ 1D <体言><節-主辞>" and out.splitlines()[3] == "太 太 太 名詞 6 普通名詞 1 * 0 * 0 <基本句-主辞>"
