"""Trees as tables: validation by recursion and the 13 metrics, against the plain kernels."""

import random

import pytest
from pyspark.sql import functions as F

from tsumugi.kernels import conll
from tsumugi.operators import dependency

UPOS, DEPRELS = ["NOUN", "VERB", "ADP"], ["nsubj", "obj", "case", "aux", "det", "root", "nsubj:pass", "punct"]
SCHEMA = "doc_id string, sent_idx int, word_idx int, form string, lemma string, upos string, xpos string, feats string, head int, deprel string, token_idx int, token_form string"


def random_side(rng, text):
    """A segmentation of a text into sentences and words, some of them parts of multi-word tokens; as rows and as CoNLL-U."""
    rows, lines, at, base, sent = [], [], 0, 0, 0
    while at < len(text):
        end = min(len(text), at + rng.randrange(3, 12))
        tokens = []
        while at < end:
            n = rng.randrange(1, 4)
            form = text[at : min(end, at + n)]
            at += len(form)
            parts = [form] if rng.random() < 0.75 else [rng.choice([form, form[:1], "x", form.upper()]) for _ in range(rng.randrange(2, 4))]
            tokens.append((form, parts, len(parts) > 1))
        words = [(form, p, multi, k == 0, len(parts)) for form, parts, multi in tokens for k, p in enumerate(parts)]
        root = rng.randrange(len(words))
        for k, (form, part, multi, first, n) in enumerate(words):
            head = -1 if k == root else root if rng.random() < 0.4 else (k - 1 if k > root else k + 1)
            deprel = rng.choice(DEPRELS)
            values = (part, rng.choice(["l", "_", part]), rng.choice(UPOS), rng.choice("ab"), rng.choice(["_", "Case=Nom", "Foo=1|Number=Sing"]))
            token = next(i for i in range(k, -1, -1) if words[i][3])
            rows.append((sent, base + k, *values[:4], "|".join(f for f in values[4].split("|") if f.split("=")[0] in conll.UNIVERSAL_FEATURES), base + head if head >= 0 else -1, deprel, base + token if multi else None, form if multi else None))
            if multi and first:
                lines.append(f"{k + 1}-{k + n}\t{form}" + "\t_" * 8)
            lines.append("\t".join([str(k + 1), *values, str(head + 1), deprel, "_", "_"]))
        lines.append("")
        base, sent = base + len(words), sent + 1
    return rows, "\n".join(lines) + "\n"


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    gold, system, expected, failed = [], [], {}, 0
    for d in range(40):
        text = "".join(rng.choice("abcあい") for _ in range(rng.randrange(1, 60)))
        other = text if d % 10 else text + "z"
        (g, g_text), (s, s_text) = random_side(rng, text), random_side(rng, other)
        gold += [(f"d{d}", *r) for r in g]
        system += [(f"d{d}", *r) for r in s]
        try:
            found = conll.counts(conll.read(g_text.split("\n")), conll.read(s_text.split("\n")))
        except conll.ConllError:
            failed += 1
            continue
        for m, n in found.items():
            expected[m] = tuple(a + b for a, b in zip(expected.get(m, (0, 0, 0)), n))
    g, s = (spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in (gold, system))
    rows = dependency.dependency_counts(g, s).collect()
    assert {r["metric"]: (r["gold"], r["system"], r["right"]) for r in rows} == expected and {r["n_failed"] for r in rows} == {failed} == {4}
    assert all(expected[m][2] for m in ("Tokens", "Words", "UAS", "AllTags"))


def test_common_subsequences(spark):
    rng = random.Random(4)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(400)] + [(None, ["a"]), ([], [])]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<string>, b array<string>")
    for r in df.select("k", dependency.common_subsequences("a", "b").alias("c")).collect():
        a, b = pairs[r["k"]]
        assert (r["c"] is None and a is None) or [(x["g"], x["s"]) for x in r["c"]] == conll.longest_common(a, b)


@pytest.mark.parametrize("heads, expected", [
    ([0, 1, 1], set()), ([2, 0, 2, 3], set()), ([0], set()), ([2, 1, 0], {"cycle"}), ([0, 3, 2], {"cycle"}), ([0, 2], {"cycle"}), ([1], {"roots", "cycle"}), ([2, 1], {"roots", "cycle"}), ([0, 0], {"roots"}),
    ([0, 9], {"head"}), ([0, -1], {"head"}), ([0, None], {"head"}), ([0] + list(range(1, 150)), set()), ([0] + list(range(1, 150)) + [152, 151], {"cycle"}),
])
def test_what_is_wrong_with_trees(spark, heads, expected):
    rows = [("d", 0, k + 1, h) for k, h in enumerate(heads)] + [("d", 1, 1, 0), ("e", 0, 1, 0)]
    found = dependency.tree_errors(spark.createDataFrame(rows, "doc_id string, sent_idx int, id int, head int")).collect()
    assert {r["error"] for r in found} == expected and all((r["doc_id"], r["sent_idx"]) == ("d", 0) for r in found)


def test_ids_that_are_not_in_sequence(spark):
    rows = [("d", 0, 1, 0), ("d", 0, 3, 1), ("d", 1, 1, 0), ("d", 1, 1, 0), ("d", 2, 2, 0), ("d", 3, None, 0)]
    found = {(r["sent_idx"], r["error"]) for r in dependency.tree_errors(spark.createDataFrame(rows, "doc_id string, sent_idx int, id int, head int")).collect()}
    assert {k for k, e in found if e == "ids"} == {0, 1, 2, 3}


def test_trees_beyond_the_row_limit_of_recursion(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        words = spark.range(3000).select((F.col("id") / 3).cast("int").alias("doc_id"), F.lit(0).alias("sent_idx"), (F.col("id") % 3 + 1).cast("int").alias("id"), F.when(F.col("id") == 2999, 3).otherwise(F.col("id") % 3).cast("int").alias("head"))
        assert [tuple(r) for r in dependency.tree_errors(words).collect()] == [(999, 0, "cycle")]
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_cycles_where_ids_leave_gaps(spark):
    rows = [("d", 0, 1, 0), ("d", 0, 4, 1), ("d", 0, 7, 1), ("e", 0, 1, 0), ("e", 0, 4, 3), ("e", 0, 7, 2)]
    found = {tuple(r) for r in dependency.tree_errors(spark.createDataFrame(rows, "doc_id string, sent_idx int, id int, head int")).collect()}
    assert found == {("d", 0, "ids"), ("e", 0, "ids"), ("e", 0, "cycle")}
