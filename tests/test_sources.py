import pytest
from pyspark.sql import functions as F

from tsumugi.plans import config, pipeline
from tsumugi.sources import dictionary, sinks, text

KNP = """# S-ID:test-0-0
* -1D
+ -1D <体言>
犬 いぬ 犬 名詞 6 普通名詞 1 * 0 * 0 "代表表記:犬/いぬ" <基本句-主辞>
EOS
# S-ID:test-0-1
* -1D
+ -1D
猫 ねこ 猫 名詞 6 普通名詞 1 * 0 * 0 NIL
EOS
"""


def put(folder, **files):
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_text(content)
    return str(folder)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_raw(spark, tmp_path):
    put(tmp_path, a__txt="# D-ID:x\none\ntwo \nEOD\n\nEOD\nthree\n\n", b__txt="")
    found = rows_of(text.read_raw(spark, str(tmp_path)).select("ord", "doc_id", "text"), "ord")
    assert found == [(0, "x", "one\ntwo"), (1, None, ""), (2, None, "three")]
    assert rows_of(text.from_text(spark, "a\nEOD\nb").select("ord", "text")) == [(0, "a"), (1, "b")]


def test_lines(spark):
    lines = ["# S-ID:1", "a", "", "b", "# c1", "# c2", "d", "# end"]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "path string, line_no int, line string")
    assert [r[1:] for r in rows_of(text.line_sentences(df), "sent_idx")] == [(0, "# S-ID:1", "a"), (1, "", "b"), (2, "# c1\n# c2", "d"), (3, "# end", None)]
    sents = spark.createDataFrame([("f", k, d, t) for k, (d, t) in enumerate([("x", "1"), ("x", "2"), ("y", "3"), ("x", "4")])], "path string, sent_idx int, doc_id string, text string")
    assert [r[2:] for r in rows_of(text.line_documents(sents), "doc_ord")] == [("x", "12"), ("y", "3"), ("x", "4")]


def test_annotated_round_trip(spark, tmp_path):
    put(tmp_path, a__knp=KNP)
    found = text.read_annotated(spark, str(tmp_path))
    assert [r["doc_id"] for r in found.collect()] == ["test-0", "test-0"]
    out = found.select("doc_id", "sent_idx", text.emit_annotated("sid", "comment", "morphemes", "base_phrases", "phrases").alias("text"))
    assert sinks.document_texts(out).first()["text"] == KNP


def test_other_sources(spark, tmp_path):
    (tmp_path / "j" / "sub").mkdir(parents=True)
    for k, name in enumerate(("j/b.jsonl", "j/sub/a.jsonl")):
        (tmp_path / name).write_text('{"pre_text":"%d","post_text":"x","kdr_tags":["K"],"ins_tags":["_"]}\n' % k * 2)
    found = rows_of(text.read_typo_examples(spark, str(tmp_path / "j")).select("example_id", "pre_text"))
    assert [r[0] for r in found] == [0, 1, 2, 3]
    (tmp_path / "ids").mkdir()
    put(tmp_path / "ids", train__id="a\nb\n", dev__id="c\n", all__id="z\n")
    assert rows_of(text.read_split_ids(spark, str(tmp_path / "ids"))) == [("a", "train"), ("b", "train"), ("c", "valid")]
    assert rows_of(text.read_split_ids(spark, str(tmp_path / "ids"), only_all=True)) == [("z", "all")]
    files = spark.createDataFrame([("f", "今日は\n\t寒か\tbaseform:寒い\tconjtype:イ形容詞アウオ段\nった\n\n犬\n")], "path string, text string")
    found = rows_of(text.read_partial_annotations(files).select("ord", "text", "surf", "lemma", "conjtype", "conjform"), "ord")
    assert found == [(0, "今日は寒かった", "寒か", "寒い", "イ形容詞アウオ段", None), (1, "犬", None, None, None, None)]


def test_dictionaries(spark, tmp_path):
    put(tmp_path, d__csv="犬,0,0,0,名詞,普通名詞,*,*,犬,いぬ,犬/いぬ,カテゴリ:動物\n猫,0,0,0,名詞,普通名詞,*,*,猫,ねこ,猫/ねこ,NIL\n")
    found = dictionary.read_dictionary(spark, str(tmp_path / "d.csv"))
    assert [r["semantics"] for r in found.orderBy("surf").collect()] == ["代表表記:犬/いぬ カテゴリ:動物", "代表表記:猫/ねこ"]
    ids = dictionary.encode_dictionary(found.withColumn("ord", F.when(F.col("surf") == "犬", 0).otherwise(1)))
    assert {r["pos_no"] for r in ids.collect()} == {0}
    put(tmp_path, k__txt="# header\n計 3757 U8a08 B149 G2 S9 ケイ はか.る -はか.らい T1 かず {plot} {plan it}\n")
    kanji = {r["character"]: r for r in dictionary.read_kanji(spark, str(tmp_path / "k.txt")).collect()}
    assert kanji["計"]["readings"] == ["けい", "はか.る", "-はか.らい", "かず"] and kanji["計"]["meanings"] == ["plot", "plan it"] and kanji["計"]["numbers"]["strokes"] == 9
    assert kanji["°"]["readings"] == ["ど"] and len(kanji) == 15 and {"さんびゃっ", "さんぜんおく", "さんちょう"} < set(kanji["3"]["readings"]) and "ごぜんまん" in kanji["5"]["readings"]
    lines = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "")], "ord int, line string")
    assert rows_of(dictionary.reading_vocabulary(lines), "id") == [("[UNK]", 0), ("[ID]", 1), ("b", 2), ("a", 3)]
    assert rows_of(dictionary.insertion_vocabulary(lines.where("ord < 2"), 10), "id") == [("b", 10), ("a", 11)]
    assert [tuple(x) for x in spark.createDataFrame([("代表表記:犬/いぬ 人名",)], "s string").select(dictionary.semantics_items("s")).first()[0]] == [("代表表記", "犬/いぬ"), ("人名", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "x", "a"), (1, None, "b")], "ord int, doc_id string, text string")
    assert [r[0] for r in df.orderBy("ord").select(sinks.raw_block("doc_id", "text")).collect()] == ["# D-ID:x\na\nEOD", "b\nEOD"]
    assert spark.createDataFrame([("# D-ID:x\na\nEOD\n",)], "t string").select(sinks.without_id_lines("t")).first()[0] == "a\nEOD\n"
    assert spark.createDataFrame([("# c", ["a", "b"]), (None, ["c"])], "c string, s array<string>").select(sinks.spaced("c", "s")).collect()[0][0] == "# c\na b"
    assert spark.createDataFrame([([0, 2, 3, 1],)], "i array<int>").select(sinks.generated_text("i", F.lit(["<pad>", "</s>", "▁a", "b c"]), [0, 1])).first()[0] == "abc"
    sinks.write_text(df, str(tmp_path / "out"), ["ord"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert text.existing([str(tmp_path), "/nowhere"], ".none") == []
    lines = text.normalized_lines(spark.createDataFrame([("f", "１\n２")], "path string, text string")).first()["text"]
    assert lines == "1\n2"
    sinks.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").is_dir() and sinks.rendered("") == "EOD\n"


@pytest.mark.parametrize(("given", "expected"), [("char", ["char"]), ("word,char", ["char", "word"]), ("word,seq2seq,char,typo", ["typo", "char", "seq2seq", "word"])])
def test_tasks(given, expected):
    assert pipeline.parse_tasks(given) == expected


def test_task_combinations():
    ok = {"raw": ["typo", "char", "typo,char", "char,word", "char,seq2seq", "typo,char,word", "typo,char,seq2seq", "char,seq2seq,word", "typo,char,seq2seq,word"]}
    ok["knp"] = ok["jumanpp"] = [*ok["raw"], "word", "seq2seq", "seq2seq,word"]
    for n in range(1, 16):
        tasks = [t for k, t in enumerate(pipeline.TASKS) if n >> k & 1]
        for kind in pipeline.FORMATS:
            if ",".join(tasks) in ok[kind]:
                assert len(pipeline.check_tasks(tasks, kind)) == (kind != "raw")
            else:
                with pytest.raises(ValueError, match="can't"):
                    pipeline.check_tasks(tasks, kind)
    for bad in ("", "x", "char,char"):
        with pytest.raises(ValueError, match="task"):
            pipeline.parse_tasks(bad)


def test_pipeline_needs_predictors(spark):
    own = pipeline.Pipeline(pipeline.Registry())
    with pytest.raises(LookupError, match="char"):
        pipeline.analyze(spark, own, "char", text="犬")
    with pytest.raises(ValueError, match="text or files"):
        pipeline.analyze(spark, own, "char")


def test_pipeline_with_stimuli(spark):
    """The tags come from plain rules here: they are test stimuli, not the output of a model."""
    registry = pipeline.Registry()

    def typo(frames):
        for f in frames:
            n = f["pre_text"].str.len()
            yield f[["example_id"]].assign(
                kdr_predictions=[["<k>", *("松" if c == "待" else "<d>" if c == "つ" else "<k>" for c in t)] for t in f["pre_text"]], kdr_probabilities=[[1.0] * (k + 1) for k in n],
                ins_predictions=[["<_>"] * (k + 2) for k in n], ins_probabilities=[[1.0] * (k + 2) for k in n],
            )

    def char(frames):
        for f in frames:
            tags = [["B" if i == 0 or t[i - 1] == "。" else "I" for i in range(len(t))] for t in f["text"]]
            yield f[["example_id"]].assign(sent_tags=tags, word_tags=[["B" if i % 2 == 0 else "I" for i in range(len(t))] for t in f["text"]], norm_ops=[["K"] * len(t) for t in f["text"]])

    registry.register("typo", typo, "example_id string, kdr_predictions array<string>, kdr_probabilities array<double>, ins_predictions array<string>, ins_probabilities array<double>")
    registry.register("char", char, "example_id string, sent_tags array<string>, word_tags array<string>, norm_ops array<string>")
    own = pipeline.Pipeline(registry, max_typo_length=20)
    long = "この文は解析されません" * 3
    fixed = own.run(text.from_text(spark, f"待つの木\nEOD\n\nEOD\n{long}"), "typo")
    assert rows_of(fixed.select("ord", "doc_id", "text")) == [(0, "doc-0", "松の木"), (2, "doc-1", long)]
    words = pipeline.analyze(spark, own, "typo,char", text="待つの木。犬")
    assert rows_of(words.select("sent_idx", "morph_idx", "surf", "pos")) == [(0, 0, "松の", "未定義語"), (0, 1, "木。", "未定義語"), (1, 0, "犬", "未定義語")]
    assert pipeline.raw_output(fixed).orderBy("ord").first()["value"] == "# D-ID:doc-0\n松の木\nEOD"


def test_config():
    lines = "model_size: base\ndevice: auto # comment\nnum_workers: 0\ntorch_compile: false\n" + "".join(f"{t}_batch_size: 1\n" for t in pipeline.TASKS)
    assert config.read_config(lines, model_size="large", device=None).model_size == "large"
    for bad in ("model_size: base", lines + "x: 1\n", lines.replace("base", "huge")):
        with pytest.raises(ValueError, match="settings|model_size"):
            config.read_config(bad)
    assert str(config.config_path({"XDG_CONFIG_HOME": "/x"})) == "/x/tsumugi/config.yaml"
    assert str(config.config_path({"TSUMUGI_CONFIG_FILE": "/y"})) == "/y" and str(config.config_path({"HOME": "/h"})) == "/h/.config/tsumugi/config.yaml"
    assert config.without_keys({"a": 1, "b": [{"a": 2, "c": 3}]}, {"a"}) == {"b": [{"c": 3}]}


def test_kanji_lines_beyond_the_first_plane(spark, tmp_path):
    from tsumugi import queries_more

    codes = [19968, 0xD7FF, 0xD800, 0xDFFF, 0xFEFF, 0xFFFF, 0x10000, 0x2A6DF, 0x10FFFF, 0x110000]
    spark.createDataFrame([(c - 19968, c % 2, "B#1") for c in codes], "p_partkey long, p_size int, p_brand string").repartition(len(codes)).write.parquet(str(tmp_path / "part.parquet"))
    found = sorted((r["character"], r["strokes"], r["readings"]) for r in queries_more.kanji_lines(spark, str(tmp_path)).collect())
    known = lambda c: chr(0xFFFD) if 0xD800 <= c < 0xE000 or c > 0x10FFFF else chr(c)
    assert found == sorted((known(c), c % 2, "か" if c % 2 else "か;あ.う") for c in codes)


def test_sentences_of_a_text_are_cut_before_they_are_parsed(spark):
    """The same sentences as those of the whole text, one row each, so that no row holds a file's parsed sentences."""
    word = "{0} {0} {0} 名詞 6 普通名詞 1 * 0 * 0 NIL"
    line = lambda w: word.format(w)
    own = ["", "\n\n", "EOS", "EOS\n", "EOS\nEOS\n\n", "\n" + line("犬") + "\nEOS\r\n\n" + line("猫") + "\n", line("EOSx") + "\n\rEOS\r\nEOS x\u2028".replace("EOS x", line("a")) + "\n", "# S-ID:d-1 c\n" + line("b\u0085EOS") + "\nEOS\n# x\n" + line("c"), None]
    rows = spark.createDataFrame(list(enumerate(own)), "k int, text string")
    whole = rows.select("k", F.posexplode(text.parse_annotated("text")).alias("i", "s"))
    cut = rows.select("k", F.posexplode(text.sentence_texts("text")).alias("i", "t")).select("k", "i", text.parse_sentences("t").alias("s"))
    assert rows_of(cut, "k", "i") == rows_of(whole, "k", "i") and cut.count() == 10
