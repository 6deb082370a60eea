"""Operators within the parts of dealt tables: what they return, and that nothing is shuffled by more than the keys."""

import random

import pytest
from pyspark.sql import functions as F

from tsumugi import queries
from tsumugi.kernels import conll
from tsumugi.operators import dependency, metrics
from tsumugi.operators.dealing import MOST_ROWS, dealt, parts_for


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_do_not_grow_with_their_input():
    assert parts_for(0, 32) == 1 and parts_for(600_000, 200) == 30 and parts_for(3_600_000, 32) == 32
    assert all(n / parts_for(n, 4) <= MOST_ROWS for n in (10**5, 10**6, 216 * 10**6))


def cut(rng, length):
    """A segmentation of a text, with an empty segment and a gap here and there."""
    at, out = 0, set()
    while at < length:
        end = min(length, at + rng.randrange(0, 4))
        if rng.random() < 0.9:
            out.add((at, end))
        at = end
    return out


def test_segmentations_against_plain_python(spark):
    rng = random.Random(5)
    sides = [{k: cut(rng, 30) for k in range(40)} for _ in range(2)]
    shared = same = 0
    for k in range(40):
        chars = [{c: c == a for a, b in side[k] for c in range(a, b)} for side in sides]
        shared += len(chars[0].keys() & chars[1].keys())
        same += sum(chars[0][c] == chars[1][c] for c in chars[0].keys() & chars[1].keys())
    tp, n_g, n_s = sum(len(sides[0][k] & sides[1][k]) for k in range(40)), *(sum(map(len, side.values())) for side in sides)
    rows = [[(k, a, b) for k, own in side.items() for a, b in own] for side in sides]
    frames = [spark.createDataFrame(r + [(None, 0, 2)], "k int, start long, end long") for r in rows]  # as in a join, null equals nothing
    found = metrics.segmentation_scores(*frames, ["k"]).first()
    assert (found["tp"], found["fp"], found["fn"]) == (tp, n_s + 1 - tp, n_g + 1 - tp) and found["accuracy"] == pytest.approx(same / shared)
    assert metrics.segmentation_scores(*[f.limit(0) for f in frames], ["k"]).first().asDict() == {"accuracy": None, "tp": 0, "fp": 0, "fn": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_segmentations_of_dealt_sides_are_not_shuffled(spark):
    frames = [dealt(spark.createDataFrame([(1, 0, 2), (1, 2, 3)], "k int, start long, end long"), "k") for _ in range(2)]
    plan = plan_of(metrics.segmentation_scores(*frames, ["k"]))
    assert all("REPARTITION_BY_NUM" in line or "SinglePartition" in line for line in plan.split("\n") if "Exchange" in line), plan


@pytest.fixture
def words(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.sample(["A", "B", "x", "y"], rng.randrange(3))) for k in range(60) for i in range(rng.randrange(1, 9)) if rng.random() < 0.9]
    other = [(k, i, [f for f in fs if rng.random() < 0.8]) for k, i, fs in rows if rng.random() < 0.9] + [(99, 0, ["A"]), (None, 0, ["x"])]
    return [spark.createDataFrame(r, "k int, i int, features array<string>") for r in (rows + [(None, 0, ["x"])], other)]


def spans_of(rows, names):
    """Spans of word features as plain Python finds them."""
    out, sequences = set(), {}
    for k, i, fs in rows:
        sequences.setdefault(k, []).append((i, fs))
    for k, own in sequences.items():
        own.sort()
        out |= {(k, f, i, i) for i, fs in own for f in fs if f not in names}
        for name in names:
            start = None
            for at, (i, fs) in enumerate(own):
                start = i if start is None else start
                if name in fs or at == len(own) - 1:
                    out.add((k, name, start, i))
                    start = None
    return out


def test_word_features_against_plain_python(spark, words):
    g, s = (spans_of([tuple(r) for r in w.collect()], ("A", "B")) for w in words)
    right = {x for x in g & s if x[0] is not None}  # as in a join, null equals nothing
    f1 = {x: 2 * sum(r[1] == x for r in right) / (sum(r[1] == x for r in g) + sum(r[1] == x for r in s)) for x in "ABxy"}
    found = {r["label"]: r["f1"] for r in metrics.word_feature_scores(*words, ["k"], "i", ("A", "B")).collect()}
    assert found == pytest.approx(f1 | {"macro": sum(f1.values()) / 4, "micro": 2 * len(right) / (len(g) + len(s))})


def test_word_features_of_dealt_sides_are_not_shuffled(spark, words):
    plan = plan_of(metrics.word_feature_scores(*[dealt(w, "k") for w in words], ["k"], "i", ("A", "B")))
    assert all("REPARTITION_BY_NUM" in line or "hashpartitioning(label" in line or "SinglePartition" in line for line in plan.split("\n") if "Exchange" in line), plan


def test_dependency_counts_of_dealt_sides_shuffle_documents_only(spark):
    row = ("d", 0, 0, "w", "l", "NOUN", "x", "", -1, "root")
    kind = "doc_id string, sent_idx int, word_idx int, form string, lemma string, upos string, xpos string, feats string, head int, deprel string"
    sides = [dealt(spark.createDataFrame([row], kind), "doc_id") for _ in range(2)]
    counts = dependency.dependency_counts(*sides)
    assert all("REPARTITION_BY" in line or "SinglePartition" in line for line in plan_of(counts).split("\n") if "Exchange" in line), plan_of(counts)
    assert all((r["gold"], r["system"], r["right"], r["n_failed"]) == (1, 1, 1, 0) for r in counts.collect())


def test_dependency_trees_make_no_pairs_of_units(spark, tmp_path):
    rows = [(k, n, "A", "O", float(q), 0.0, 0.0) for k, own in enumerate([[3], [5, 5, 5, 5, 5, 5], [1, 9, 2, 8, 3, 7, 4]]) for n, q in enumerate(own)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    trees = queries.QUERIES["dependency_trees"](spark, str(tmp_path))
    plan = plan_of(trees)
    assert "Join" not in plan and plan.count("Exchange") == 1, plan
    found = {(r["doc_id"], r["bp_idx"]): r["parent_idx"] for r in trees.collect()}
    # by hand: the best other unit that makes no cycle; the last unit is the root where none is left
    assert len(found) == 14 and found[0, 0] == -1 and [found[2, k] for k in range(3)] == [1, 3, 1] and found[1, 0] == 1


def test_conll_counts_compare_a_pair_once():
    asked = []

    class Tag(str):
        def __eq__(self, other):
            asked.append(other)
            return str(self) == str(other)

        __hash__ = str.__hash__

    lines = [f"{n}\tw{n}\tl\tNOUN\tX\t_\t{n - 1}\t{'obj' if n > 1 else 'root'}\t_\t_" for n in range(1, 6)] + [""]
    sides = [conll.read(lines) for _ in range(2)]
    sides[0].words[:] = [w._replace(upos=Tag(w.upos)) for w in sides[0].words]
    assert conll.counts(*sides)["MLAS"] == conll.counts(*sides)["UPOS"] == (5, 5, 5) and len(asked) == 2 * 5
