"""Forced decoding on tables and for many sequences at a time, against the plain state machine."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsumugi.kernels.forced import Forced, by_first_character
from tsumugi.operators import forced
from tsumugi.vocab import CANON, DELIMITER, HALF_SPACE, LEMMA, NO_CANON, RARE_TO_SPECIAL, READING, SURF

SPECIAL = RARE_TO_SPECIAL["鮪"]
TOKENS = ["<s>", "<pad>", "</s>", SURF, READING, LEMMA, CANON, NO_CANON, DELIMITER, HALF_SPACE, SPECIAL, "▁", "▁▁", "▁か", "か", "かみ", "かみさ", "み", "さ", "神", "カ", "▁神", "a", "b", "ab", "▁ab", "abc"]
IDS = {t: k for k, t in enumerate(TOKENS)}


def decode(ids):
    return "".join(TOKENS[i] for i in ids[1:]).replace("▁", " ")


def sequences(seed, n):
    """Random prefixes of what could be generated for two or three written forms."""
    rng = random.Random(seed)
    forms = [["かみ"], ["か", "み"], ["ab"], ["ab", "c"], ["a", "b"], [HALF_SPACE], [SPECIAL], ["神"], ["▁か", "み"]]
    out = []
    for _ in range(n):
        chosen = [rng.choice(forms) for _ in range(rng.randrange(1, 4))]
        surfs = ["".join(f).replace("▁", "") for f in chosen]
        tokens = ["<s>"]
        for f in chosen:
            tokens += [SURF, *f, READING, *rng.choices(["か", "み", "さ"], k=rng.randrange(1, 3)), LEMMA, *rng.choices(["か", "神"], k=rng.randrange(1, 3)), CANON, *rng.choices(["か", NO_CANON], k=1)]
        tokens = [t for t in tokens if t in IDS]
        out.append((surfs, [IDS[t] for t in tokens[: rng.randrange(1, len(tokens) + 1)]]))
    return out


def plain(surfs, ids):
    try:
        return sorted(Forced(surfs, IDS, decode).allowed(ids))
    except IndexError:  # a form that the vocabulary can't write
        return None


def test_allowed_tokens_equal_the_plain_machine(spark):
    own = [(k, *x) for k, x in enumerate(sequences(1, 400))]
    df = spark.createDataFrame([*own, (-1, None, [0]), (-2, ["か"], None)], "k int, surfs array<string>, ids array<int>").repartition(3)
    found = {r["k"]: r["allowed"] for r in df.select("k", forced.allowed_tokens(TOKENS, step=37)("surfs", "ids").alias("allowed")).collect()}
    assert found.pop(-1) is None and found.pop(-2) is None
    assert found == {k: plain(surfs, ids) for k, surfs, ids in own}
    assert len({tuple(v) for v in found.values()}) > 12


def test_sequences_that_are_over(spark):
    machine = forced.Machine(TOKENS)
    surfs, ids = [["か"], ["か"]], [np.array([IDS[t] for t in ("<s>", SURF, "か", READING, "か", LEMMA, "か", CANON, "か")])] * 2
    scores, finished = np.zeros((2, len(TOKENS))), np.zeros(2, bool)
    scores[0, IDS["</s>"]], scores[1, IDS["み"]] = 1.0, 1.0
    assert machine.step(scores, surfs, ids, finished).tolist() == [IDS["</s>"], IDS["み"]] and finished.tolist() == [True, False]
    scores[:, IDS["み"]] = 2.0
    assert machine.step(scores, surfs, [np.append(i, IDS["か"]) for i in ids], finished).tolist() == [IDS["</s>"], IDS["み"]]


def test_too_many_tokens(monkeypatch):
    monkeypatch.setattr(forced, "MOST_TOKENS", 5)
    with pytest.raises(ValueError):
        forced.Machine(TOKENS)


def test_permitted_tokens_and_indexes(spark):
    vocab = spark.createDataFrame(list(IDS.items()), "token string, id int").repartition(2)
    rests = ["かみさま", "み", "ab", "abcd", "x", "▁か", "▁▁か", HALF_SPACE + "か", SPECIAL, "", "神か", "カ"]
    found = {}
    for r in forced.permitted_tokens(spark.createDataFrame([(x,) for x in rests], "rest string"), vocab).collect():
        found.setdefault(r["rest"], set()).add(r["id"])
    own = Forced(["x"], IDS, decode)
    assert found == {r: t for r in rests if r and (t := own.tokens_for(r))}
    assert {r["character"]: r["tokens"] for r in forced.first_characters(vocab).collect()} == by_first_character(IDS)
    assert sorted(r["id"] for r in forced.reading_tokens(vocab).collect()) == sorted(own.readings)


def test_rests_are_not_brought_together_by_their_prefixes(spark):
    """Frequent prefixes would make a task with most of the rests: the vocabulary goes to the rests, and nothing is shuffled but it."""
    vocab = spark.createDataFrame([("a", 1), ("ab", 2), ("▁a", 3), ("▁▁", 4), ("▁▁", 4)], "token string, id int")
    rests = spark.range(2000, numPartitions=3).select("id", F.concat(F.lit("ab"), F.col("id").cast("string")).alias("rest")).unionByName(spark.createDataFrame([(-1, "▁▁▁")], "id long, rest string"))
    found = forced.permitted_tokens(rests.withColumnRenamed("id", "n"), vocab)
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BuildLeft" not in plan
    assert sorted(found.groupBy("token").count().collect()) == [("a", 2000), ("ab", 2000), ("▁a", 2000), ("▁▁", 1)]


def test_sections_and_rests_as_columns(spark):
    own = [(k, surfs, [TOKENS[i] for i in ids]) for k, (surfs, ids) in enumerate(sequences(2, 200)) if len(ids) > 1]
    df = spark.createDataFrame(own, "k int, surfs array<string>, tokens array<string>")
    for r in df.select("*", forced.section("tokens").alias("section"), forced.rest_of_surf("tokens", "surfs").alias("rest")).collect():
        ids, machine = [IDS[t] for t in r["tokens"]], Forced(r["surfs"], IDS, decode)
        assert r["section"] == machine.section(ids)
        if r["section"] == SURF:
            assert r["rest"] == machine.rest_of_surf(ids)
