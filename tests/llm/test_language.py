import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import ROWS, folder
from tsumugi.llm import language, queries

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    """N-grams of one to three characters, character by character."""
    words, word = [], ""
    for c in (text or "").lower():
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words.append(word)
            word = ""
    words += [word] if word else []
    counts = Counter()
    for w in words:
        padded = f"_{w}_"
        counts.update(c for c in w)
        counts.update(padded[k : k + n] for n in (2, 3) for k in range(len(padded) - n + 1))
    return counts, any(unicodedata.category(c)[0] == "L" for c in text or "")


def plain_places(counts, places):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:places]


def plain_prediction(text, profiles, places):
    counts, letters = plain_grams(text)
    if not letters or not profiles:
        return "und", 0.0
    own = plain_places(counts, places)
    distance = {lang: sum(abs(k - listed.index(g)) if g in listed else places for k, g in enumerate(own)) for lang, listed in profiles.items()}
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (len(own) * places)


def plain_profiles(rows, places):
    totals = defaultdict(Counter)
    for text, lang in rows:
        if text is not None and lang is not None and plain_grams(text)[1]:
            totals[lang] += plain_grams(text)[0]
    return {lang: plain_places(c, places) for lang, c in totals.items()}


@pytest.mark.parametrize("places", [5, 40, 400])
def test_predictions_equal_the_plain_version(spark, docs, places):
    learnt = [(r[1], r[2]) for r in ROWS if r[0] is not None]
    profiles = plain_profiles(learnt, places)
    own = language.learn(docs.where("doc_id is not null"), places)
    assert {lang: [language.gram_text(int(g)) for _, g in sorted((int(p), int(own.grams[i])) for i in range(len(own.grams)) for p, k in zip(own.place[own.starts[i] : own.starts[i + 1]], own.language[own.starts[i] : own.starts[i + 1]]) if own.languages[k] == lang)] for lang in own.languages} == profiles
    found = sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(docs, own, ["doc_id", "score"]).collect()), key=repr)
    plain = [(r[0], *plain_prediction(r[1], profiles, places)) for r in ROWS]
    assert found == sorted(((d, lang, round(s, 9)) for d, lang, s in plain), key=repr)


def test_long_texts_are_counted_by_steps(monkeypatch):
    text = "Große Wörter, été; x" + "y" * 50 + " ein_zwei 日本語の文́ and more " * 9
    whole = language.gram_counts(language.marked(text))
    for step in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "STEP", step)
        grams, counts = language.gram_counts(language.marked(text))
        assert grams.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()
    counts, _ = plain_grams(text)
    assert {language.gram_text(int(g)): int(n) for g, n in zip(*whole, strict=True)} == dict(counts)


def test_counts_that_are_handed_on_in_parts(spark, docs, monkeypatch):
    whole = language.learning_counts(docs).collect()
    monkeypatch.setattr(language, "MANY", 10)
    assert sorted(map(tuple, language.learning_counts(docs).collect())) == sorted(map(tuple, whole))


def test_without_letters_or_learning(spark, docs, none):
    assert language.identify(none, language.learn(none), ["doc_id"]).count() == 0
    untaught = language.identify(docs, language.learn(none), ["doc_id"]).collect()
    assert len(untaught) == len(ROWS) and {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 3 !"), (4, "́́"), (5, "a")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(odd, language.learn(docs), ["doc_id"]).orderBy("doc_id").collect()][:4] == ["und"] * 4


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        language.learn(spark.createDataFrame([("text of it", f"l{k}") for k in range(4)], "text string, lang string"))


def test_query_learns_from_its_fold_only_and_is_right_on_the_other(spark, tmp_path):
    found = queries.op12_language_id(spark, SF).toPandas()
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").toPandas().set_index("doc_id")
    assert len(found) == len(known) and found["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(found["doc_id"], found["held_out"], strict=True))
    own = found[found["held_out"]]
    assert (own["lang_pred"].to_numpy() == known.loc[own["doc_id"], "lang"].to_numpy()).mean() > 0.98
    # held-out labels don't change anything
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    swapped = docs.withColumn("lang", language.F.when(language.held_out(docs["doc_id"]), "xx").otherwise(docs["lang"]))
    again = queries.op12_language_id(spark, folder(spark, tmp_path, documents=swapped)).toPandas()
    assert sorted(map(tuple, found.to_numpy())) == sorted(map(tuple, again.to_numpy()))
