"""Each stage of the pipeline against a plain version of it, on its own input, with planted cases."""

import random

import pytest

import corpus_pipeline
from tests.llm.conftest import folder, words
from tests.llm.test_operators import contained_by_hand, removed_by_hand, simulated
from tsumugi.llm import mixing, quality
from tsumugi.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The smallest tables with copies, near copies, shared passages, benchmark items and rows without an id or text."""
    rng = random.Random(8)
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r in base if 100 < len(r[1].split()) and "***" not in r[1] and "!!" not in r[1] and " | " not in r[1]][:20]
    rows, planted = list(base), {"copies": [], "near": [], "passages": [], "leaks": []}
    for k, (_, text, lang, source, _) in enumerate(clean[:16]):
        own = text.split(" ")
        at = rng.randrange(10, len(own) - 10)
        kind, new = (("copies", text), ("near", " ".join([*own[:at], "changed", *own[at + 1 :]])), ("passages", " ".join([f"start{k}", *(f"n{k}x{j}" for j in range(300)), *text.split()[:70], f"end{k}"])), ("leaks", " ".join([*(f"m{k}x{j}" for j in range(150)), items[k][1], f"last{k}"])))[k % 4]
        planted[kind].append(5000 + k)
        rows.append((5000 + k, new, lang, source, len(new)))
    rows += [(9000, None, "en", None, None), (9001, "", "en", "src0", 0), (None, "without an id but with some words", "en", "src0", 33)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    path = tmp_path_factory.mktemp("pipeline")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return folder(spark, path, documents=spark.createDataFrame(rows, schema), labels=labels, benchmark=spark.read.parquet(f"{SF}/benchmark.parquet")), planted, dict(items)


def read(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, inputs):
    path, planted, items = inputs
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")

    good = stored(stages["quality_classifier"](spark, docs, path))
    machine = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = machine.scores([t for _, t in texts])
    assert sorted(map(str, read(good))) == sorted(str(i) for (i, _), s in zip(texts, scores, strict=True) if s >= quality.THRESHOLD)
    assert good.columns == corpus_pipeline.COLUMNS and all(i in read(good) for kind in planted.values() for i in kind)

    single = stored(stages["simhash_near_dedup"](spark, good, path))
    own, kept = read(good), read(single)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, t in own.items() for w in [words((t or "").lower())]}
    like = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for i in planted["copies"] + planted["near"]:
        assert i not in kept
    for i in set(own) - set(kept):  # what goes is near something else
        assert any(like(i, j) > 0.7 for j in own if j != i), i
    ids = sorted(i for i in kept if i is not None)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if like(a, b) > 0.88]
    assert single.columns == corpus_pipeline.COLUMNS

    cut = stored(stages["substring_dedup"](spark, single, path))
    by_hand = removed_by_hand([(i, t) for i, t in kept.items() if i is not None])
    left = read(cut)
    assert {i: words(t) for i, t in left.items() if i is not None} == {i: k.split() for i, (n, gone, k) in by_hand.items() if not n or gone < n}
    assert all(by_hand[i][1] >= 50 for i in planted["passages"])
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None and r["doc_id"] in planted["passages"])

    safe = stored(stages["benchmark_decontamination"](spark, cut, path))
    hits = {d for d, _ in contained_by_hand([(i, t) for i, t in left.items()], list(items.items()))}
    assert set(read(safe)) == set(left) - hits and hits >= set(planted["leaks"])

    mixed = stages["mixing_sources"](spark, safe, path).collect()
    assert {r["doc_id"] for r in mixed} == set(read(safe)) and len(mixed) == safe.count()
    sizes = {}
    for r in mixed:
        sizes[r["source"] or ""] = sizes.get(r["source"] or "", 0) + 1
    order = simulated({s: -(-n // mixing.BLOCK) for s, n in sizes.items()}, {s: n**0.5 for s, n in sizes.items()}, mixing.PARTS)
    assert {(r["slot"], r["source"] or "") for r in mixed} == set(enumerate(order))

    assert {r["doc_id"]: r["mix_order"] for r in corpus_pipeline.run(spark, path).collect()} == {r["doc_id"]: r["mix_order"] for r in mixed}


def test_other_columns_pass_through(spark, inputs):
    path, _, _ = inputs
    names = ("score", "n_words", "n_removed", "text_hash", "hash", "row", "others", "spans", "component_id", "slot", "_text")
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(60)
    for name in names:
        docs = docs.withColumn(name, docs["doc_id"].cast("string"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, path))
        if k < 4:
            assert docs.columns == before.columns and docs.where("not (score <=> cast(doc_id as string) and n_words <=> cast(doc_id as string))").count() == 0
    assert docs.count() > 20 and {"slot", "mix_order"} <= set(docs.columns)


def test_without_n_chars(spark, inputs):
    path, _, _ = inputs
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(40).drop("n_chars", "lang")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, path))
    assert docs.columns[:3] == ["doc_id", "text", "source"] and docs.count() > 10


def test_empty_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    path = folder(spark, tmp_path, documents=none, labels=spark.read.parquet(f"{SF}/labels.parquet"), benchmark=spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert corpus_pipeline.run(spark, path).count() == 0
