"""Encoded word examples against dense labels and masks that are filled by hand."""

import pytest

from tsumugi import vocab
from tsumugi.operators import encoding

#: Two sentences of four and three words; the first is context only.
WORDS = [("e", 0, k, False) for k in range(4)] + [("e", 1, k, True) for k in range(4, 7)]
N, ROOT, NULL = 7, 7 + vocab.SPECIAL_TOKENS.index("[ROOT]"), 7 + vocab.SPECIAL_TOKENS.index("[NULL]")
#: Base phrases: number, head word, first and last word, whether they are targets.
PHRASES = [("e", 0, 0, 0, 1, False), ("e", 1, 3, 2, 3, False), ("e", 2, 4, 4, 5, True), ("e", 3, 6, 6, 6, True)]


@pytest.fixture
def words(spark):
    return spark.createDataFrame(WORDS, "example_id string, sent_idx int, word_idx int, target boolean").repartition(3)


def test_word_labels(spark, words):
    rows = [(*w, "名詞", "普通名詞", "*", "*", ["文節-区切", "other"]) for w in WORDS[:-1]] + [(*WORDS[-1], "何か", "普通名詞", "母音動詞", "基本形", [])]
    df = spark.createDataFrame(rows, "example_id string, sent_idx int, word_idx int, target boolean, pos string, subpos string, conjtype string, conjform string, features array<string>")
    found = {r["word_idx"]: tuple(r)[2:] for r in encoding.word_labels(df).collect()}
    assert set(found) == {4, 5, 6}
    assert found[4] == (vocab.POS.index("名詞"), vocab.SUBPOS.index("普通名詞"), 0, 0, [int(f == "文節-区切") for f in vocab.WORD_FEATURES])
    assert found[6] == (None, vocab.SUBPOS.index("普通名詞"), vocab.CONJTYPES.index("母音動詞"), vocab.CONJFORMS.index("基本形"), [0] * 5)


def test_base_phrase_labels(spark):
    df = spark.createDataFrame([("e", 4, True, ["体言", "時間", "?"]), ("e", 0, False, ["体言"])], "example_id string, word_idx int, target boolean, features array<string>")
    rows = encoding.base_phrase_labels(df).collect()
    assert len(rows) == 1 and rows[0]["features"] == [int(f in ("体言", "時間")) for f in vocab.BASE_PHRASE_FEATURES]


def test_entities(spark, words):
    tags = vocab.ne_tags()
    entities = lambda *rows: spark.createDataFrame(list(rows), "example_id string, category string, start int, end int")
    found = {r["word_idx"]: tags[r["label"]] for r in encoding.entity_labels(entities(("e", "PERSON", 0, 2), ("e", "DATE", 2, 3), ("e", "?", 5, 6)), words).collect()}
    assert found == {0: "B-PERSON", 1: "I-PERSON", 2: "B-DATE", 3: "O", 4: "O", 5: "O", 6: "O"}
    with pytest.raises(Exception, match="nested entities in e"):
        encoding.entity_labels(entities(("e", "PERSON", 0, 3), ("e", "DATE", 2, 4)), words).collect()
    assert {r["label"] for r in encoding.entity_labels(entities(("e", "DATE", 0, 1)).limit(0), words).collect()} == {0}


def test_dependency(spark, words):
    heads = spark.createDataFrame([("e", 0, 1, "D"), ("e", 4, 5, "P"), ("e", 5, 6, "D"), ("e", 6, -1, "D")], "example_id string, src int, head int, dep_type string")
    rows = encoding.dependency_edges(words, heads).collect()
    assert {(r["src"], r["tgt"], r["label"]) for r in rows if r["kind"] == "head"} == {(4, 5, 1), (5, 6, 0), (6, ROOT, 0)}
    assert {(r["src"], r["tgt"]) for r in rows if r["kind"] == "mask"} == {(a, b) for a in (4, 5, 6) for b in (4, 5, 6, ROOT) if a != b}


def test_cohesion(spark, words):
    phrases = spark.createDataFrame(PHRASES, "example_id string, global_idx int, head int, first int, last int, target boolean")
    tags = spark.createDataFrame([("e", 2, "ガ", ["0", "[著者]"]), ("e", 3, "ガ", ["[NULL]"]), ("e", 3, "ヲ", ["1", "1"]), ("e", 0, "ガ", ["[NULL]"])], "example_id string, global_idx int, rel string, tags array<string>")
    rows = encoding.cohesion_edges(words, phrases, tags).collect()
    assert sorted((r["rel"], r["src"], r["tgt"]) for r in rows if r["kind"] == "label") == sorted([("ガ", 4, 0), ("ガ", 4, N), ("ガ", 6, NULL), ("ヲ", 6, 3)])
    tokens = {N + k for k, t in enumerate(vocab.SPECIAL_TOKENS) if t != "[ROOT]"}
    expected = {(w, t) for w in (4, 5) for t in {0, 3} | tokens} | {(6, t) for t in {0, 3, 4} | tokens}
    assert {(r["src"], r["tgt"]) for r in rows if r["kind"] == "mask"} == expected


def test_discourse(spark):
    df = spark.createDataFrame([("e", 6, 4, "原因・理由"), ("e", 4, 6, "談話関係なし"), ("e", 4, 4, "?")], "example_id string, modifier int, head int, relation string")
    assert {(r["src"], r["tgt"], r["label"]) for r in encoding.discourse_edges(df).collect()} == {(6, 4, 1), (4, 6, 0)}


def test_offsets_and_indices(spark, words):
    tokens = spark.createDataFrame([("e", t, w) for t, w in enumerate([None, 0, 0, 1, 3, 3, 3, 6])], "example_id string, token_idx int, word_idx int")
    row = encoding.csr(encoding.subword_map(tokens, spark.createDataFrame([("e", 8, 7)], "example_id string, token_idx int, word_idx int")), ["example_id"], encoding.sizes(words)).first()
    dense = [row["indices"][a:b] for a, b in zip(row["offsets"], row["offsets"][1:])]
    assert dense == [[1, 2], [3], [], [4, 5, 6], [], [], [7], [8]]
    longer = encoding.csr(encoding.subword_map(tokens), ["example_id"], spark.createDataFrame([("e", 10)], "example_id string, n_words int")).first()
    assert longer["offsets"] == [0, 2, 3, 3, 6, 6, 6, 7, 7, 7, 7]
