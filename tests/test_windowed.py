"""Windows of documents that are one row each, and predictions that are put in place where they are made."""

import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tsumugi import queries_stages
from tsumugi.operators import predicting, segment
from tsumugi.plans import pipeline, word_stage

SF = "/root/testdata/sf0.001"
KIND = "reading string, heads array<struct<head:int,dep_type:string>>, cohesion array<struct<rel:string,tgt:int,logit:double>>, discourse array<struct<tgt:int,relation:string>>"
SCHEMA = "doc_id string, win_idx int, words array<struct<" + ",".join(f.replace(" ", ":", 1) for f in KIND.split(", ")) + ">>"


@pytest.fixture
def docs(spark):
    rng = random.Random(7)
    sentence = lambda: "".join(rng.choice("ab1é語𠮷 -") for _ in range(rng.randrange(1, 14))) + "."
    texts = [("".join(sentence() for _ in range(rng.randrange(0, 12))) + rng.choice(["", "end"])) for _ in range(30)]
    rows = [(str(k), t) for k, t in enumerate(texts)] + [("empty", ""), ("null", None), (None, "a b. c."), ("long", "a. " + "x" * 30 + ". b c."), ("one", "y" * 31)]
    return spark.createDataFrame(rows, "doc_id string, text string").repartition(3).select("doc_id", segment.split_sentences("text").alias("sentences"))


@pytest.mark.parametrize("stride", [-1, 1, 2])
def test_windows_of_sentences_are_those_of_their_words(docs, stride):
    cut = docs.select("doc_id", F.posexplode("sentences").alias("sent_idx", "s"))
    words = word_stage.with_places(cut.select("doc_id", "sent_idx", F.posexplode(segment.split_words("s")).alias("morph_idx", "surf")))
    for own, of_words in zip(predicting.sentence_windows(docs, 20, stride), predicting.word_windows(words, 20, stride), strict=True):
        columns = ["doc_id", "win_idx", "window_id", "words", *predicting.PLACES]
        mine, others = (sorted(map(repr, w.select(*columns).collect())) for w in (own, predicting.with_targets(of_words)))
        assert mine == others and mine


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_documents_are_shuffled_once_and_no_row_a_word_is_sorted(spark):
    plan = queries_stages.windowed_predictions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Sort", "Window [", "Aggregate")), plan


def answers(words):
    """Odd ones too: no list, an empty one, a null in a list, special tokens, a root."""
    n = len(words)
    heads = lambda k: None if k % 5 == 4 else [{"head": k - 1, "dep_type": "D"}, None] if k % 3 else []
    one = lambda k: {"reading": f"{k}/{n}" if k else None, "heads": heads(k), "cohesion": [{"rel": "x", "tgt": k, "logit": 1.0}, {"rel": "x", "tgt": n + 2, "logit": None}], "discourse": [{"tgt": n - 1, "relation": "y"}, {"tgt": None, "relation": "z"}]}
    return [one(k) for k in range(n)]


def on_frames(frames):
    held = [pd.DataFrame({"doc_id": f["doc_id"], "win_idx": f["win_idx"], "words": [answers(w) for w in f["words"]]}) for f in frames]
    yield from reversed(held)


def on_batches(batches):
    lists = {"heads": {"head": pa.int32(), "dep_type": pa.string()}, "cohesion": {"rel": pa.string(), "tgt": pa.int32(), "logit": pa.float64()}, "discourse": {"tgt": pa.int32(), "relation": pa.string()}}
    word = pa.struct({"reading": pa.string()} | {k: pa.list_(pa.struct(v)) for k, v in lists.items()})
    schema = pa.schema({"doc_id": pa.string(), "win_idx": pa.int32(), "words": pa.list_(word)})
    held = [pa.RecordBatch.from_pandas(f, schema=schema, preserve_index=False) for f in on_frames(b.to_pandas() for b in batches)]
    yield from held


@pytest.mark.parametrize("predictor", [on_frames, on_batches])
def test_predictions_are_put_in_place_where_they_are_made(docs, predictor):
    windows, _ = predicting.sentence_windows(docs, 20, 2)
    own = pipeline.Registry()
    own.register("word", predictor, SCHEMA, on_batches=predictor is on_batches)
    found = own.predict_in_place("word", windows)
    as_joined = predicting.in_place(own.predict("word", windows, predicting.PLACES))
    mine, others = (sorted(map(repr, f.select("doc_id", "word_idx", *[c.split()[0] for c in KIND.split(", ")]).collect())) for f in (found, as_joined))
    assert mine == others and len(mine) == docs.where("doc_id not in ('long', 'one')").select(F.sum(F.size(segment.split_words(F.array_join("sentences", ""))))).first()[0] + 7


def test_a_prediction_of_another_length_stops_where_it_is_made(docs):
    own = pipeline.Registry()
    own.register("word", lambda frames: (f[["doc_id", "win_idx"]].assign(words=[answers(w)[1:] for w in f["words"]]) for f in frames), SCHEMA)
    with pytest.raises(Exception, match=r"a window of \d+ words has \d+"):
        own.predict_in_place("word", predicting.sentence_windows(docs, 20, 2)[0]).collect()


def test_documents_of_one_id_are_predicted_each_on_its_own(spark):
    docs = spark.createDataFrame([("a", ["ab cd.", " e."]), ("a", ["ab cd.", " e."]), ("a", ["f."]), ("b", ["g."])], "doc_id string, sentences array<string>").coalesce(1)
    own = pipeline.Registry()
    own.register("word", on_batches, SCHEMA, on_batches=True)
    found = own.predict_in_place("word", predicting.sentence_windows(docs.where("size(sentences) = 2 or doc_id = 'b'"), 20, 2)[0]).collect()
    assert sorted((r["doc_id"], r["word_idx"]) for r in found) == sorted([("a", k) for k in range(7)] * 2 + [("b", 0), ("b", 1)])
    from tsumugi.queries_stages import COUNTED, counting_predictor

    own.register("word", counting_predictor, COUNTED, on_batches=True)
    found = own.predict_in_place("word", predicting.sentence_windows(docs, 20, 2)[0]).collect()
    assert sorted((r["doc_id"], r["word_idx"], r["reading"]) for r in found) == sorted([("a", k, f"{k}/7") for k in range(7)] * 2 + [(d, k, f"{k}/2") for d in "ab" for k in range(2)])
