"""Accuracy metrics as aggregates: counts by join, scores from counts, and roll-ups over corpora."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow, batch
from tsumugi import vocab
from tsumugi.functions.edits import diff_counts
from tsumugi.kernels import conll
from tsumugi.kernels.align import KEYS, morphology_counts


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_score(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return ratio((1 + b) * p * r, b * p + r)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": f_score(p, r)}


def with_scores(counts: DataFrame, half: bool = False) -> DataFrame:
    """Counts tp, fp, fn with precision, recall and f1 (and f0_5)."""
    out = counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.withColumn("f0_5", f_score(F.col("precision"), F.col("recall"), 0.5)) if half else out


def typo_scores(texts: DataFrame) -> DataFrame:
    """Scores of corrections (threshold, pre_text, predicted, post_text) by threshold, over changed characters as multisets."""
    counted = texts.withColumn("c", diff_counts("pre_text", "predicted", "post_text"))
    return with_scores(counted.groupBy("threshold").agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn")]), half=True)


def span_counts(gold: DataFrame, system: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of spans that are equal in keys, by some of them (all together without).

    Spans are a set in each. One full join; what only one side has is a positive or a negative.
    """
    by = by or []
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    s = system.select(*keys).distinct().withColumn("_s", F.lit(1))
    both = g.join(s, keys, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    in_g, in_s = F.col("_g").isNotNull(), F.col("_s").isNotNull()
    return both.groupBy(*by).agg(count(in_g & in_s).alias("tp"), count(in_s & ~in_g).alias("fp"), count(in_g & ~in_s).alias("fn"))


def accuracy(rows: DataFrame, gold: str, system: str, by: list[str] | None = None) -> DataFrame:
    """Share of rows with equal values; rows with an ignored gold value (null or -100) don't count."""
    known = F.col(gold).isNotNull() & (F.col(gold).cast("string") != str(vocab.IGNORE_INDEX))
    return rows.where(known).groupBy(*(by or [])).agg(F.avg(F.col(gold).eqNullSafe(F.col(system)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def segmentation_scores(gold: DataFrame, system: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy of B and I over characters, and F1 of segments as spans, of two segmentations (keys, start, end) of the same texts.

    A character is a B where a segment starts; characters beyond either segmentation don't count. The segments of a side are a set and
    don't overlap; empty ones have no characters. Characters are counted between the places where a segment starts or ends, so none is a row, and all is done by
    groups and windows within keys: sides that are dealt by them (operators.dealing) aren't shuffled.
    """
    side = lambda df, g, s: df.select(*keys, "start", "end", F.lit(g).alias("_g"), F.lit(s).alias("_s"))
    segments = side(gold, 1, 0).unionByName(side(system, 0, 1)).groupBy(*keys, "start", "end").agg(F.max("_g").alias("_g"), F.max("_s").alias("_s"))
    tp = _known(*keys, "start", "end").cast("int") * F.col("_g") * F.col("_s")
    found = (F.col("end") > F.col("start")).cast("int")
    end = lambda at, sign, first: F.struct(F.col(at).cast("long").alias("at"), *[(sign * F.col(x)).alias("d" + x) for x in ("_g", "_s")], *[(found * F.col(x) * first).alias("b" + x) for x in ("_g", "_s")], *[(n * first).alias(name) for name, n in (("tp", tp), ("fp", F.col("_s") - tp), ("fn", F.col("_g") - tp))])
    places = segments.select(*keys, F.inline(F.array(end("start", 1, 1), end("end", -1, 0))))
    sums, begins = ("d_g", "d_s", "tp", "fp", "fn"), ("b_g", "b_s")
    places = places.groupBy(*keys, "at").agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in begins])
    order = Window.partitionBy(*keys).orderBy("at")
    inside = (F.sum("d_g").over(order) > 0) & (F.sum("d_s").over(order) > 0) & _known(*keys)
    own = places.withColumns({"_in": inside, "_n": F.lead("at").over(order) - F.col("at")}).withColumn("_n", F.when(F.col("_in"), F.col("_n")).otherwise(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = own.agg(*[total(n).alias(n) for n in ("tp", "fp", "fn")], total("_n").alias("_n"), total(F.when(F.col("_in"), (F.col("b_g") != F.col("b_s")).cast("long"))).alias("_wrong"))
    accuracy = F.try_divide((F.col("_n") - F.col("_wrong")).cast("double"), F.col("_n").cast("double"))
    return with_scores(counts.select(accuracy.alias("accuracy"), "tp", "fp", "fn"))


def _known(*names: str) -> Column:
    """Whether none of the columns is null: as in a join, a null equals nothing."""
    return reduce(and_, [F.col(n).isNotNull() for n in names])


def norm_scores(rows: DataFrame, gold: str = "gold", system: str = "system") -> DataFrame:
    """Word normalization: per operation, "change" (all but K) and accuracy, in long form (key, value).

    Precision is the accuracy where the operation was predicted, recall that where it is right.
    """
    known = rows.where(F.col(gold).isNotNull() & (F.col(gold) != vocab.NORM_IGNORED)).select(F.col(gold).alias("g"), F.col(system).alias("s"))
    right = (F.col("g") == F.col("s")).cast("long")
    outs = [F.avg(right.cast("double")).alias("accuracy")]
    for name, of in [("f1", lambda c: c != "K"), *[(f"f1:{op}", lambda c, op=op: c == op) for op in vocab.NORM_OPS]]:
        p = ratio(F.sum(F.when(of(F.col("s")), right)), F.sum(of(F.col("s")).cast("long")))
        r = ratio(F.sum(F.when(of(F.col("g")), right)), F.sum(of(F.col("g")).cast("long")))
        outs.append(f_score(p, r).alias(name))
    return _long(known.agg(*outs), "word_normalization_")


def _long(wide: DataFrame, prefix: str = "") -> DataFrame:
    """One row a column: key and value."""
    pairs = F.array(*[F.struct(F.lit(prefix + c).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns])
    return wide.select(F.inline(pairs))


def attribute_scores(rows: DataFrame) -> DataFrame:
    """Micro F1 (accuracy) of part of speech, sub-part, inflection type and form, and their mean (key, value).

    rows: gold and system structs of the four. A gold value outside the vocabulary is never right.
    """
    known = {"pos": vocab.POS, "subpos": vocab.SUBPOS, "conjtype": vocab.CONJTYPES, "conjform": vocab.CONJFORMS}
    each = {n: F.avg(((F.col(f"gold.{n}") == F.col(f"system.{n}")) & F.col(f"gold.{n}").isin(*names)).cast("double")) for n, names in known.items()}
    wide = rows.agg(*[c.alias(f"{n}_f1") for n, c in each.items()])
    return _long(wide.withColumn("morphological_analysis_f1", (F.col("pos_f1") + F.col("subpos_f1") + F.col("conjtype_f1") + F.col("conjform_f1")) / 4))


def label_scores(gold: DataFrame, system: DataFrame, keys: list[str], label: str = "label", only_gold: bool = True) -> DataFrame:
    """Scores of each label over units that have it (keys, label), "macro" (their mean) and "micro" (all together).

    With only_gold, labels that no gold unit has don't count for macro. One pass over the units: what follows is one row that
    holds the counts of all labels, which are a closed vocabulary.
    """
    return counted_label_scores(span_counts(gold, system, [*keys, label], [label]), label, only_gold)


def counted_label_scores(counts: DataFrame, label: str = "label", only_gold: bool = True) -> DataFrame:
    """label_scores() of the counts of each label: label, tp, fp, fn."""
    every = with_scores(counts).agg(F.collect_list(F.struct(label, "f1", "tp", "fp", "fn")).alias("every"))
    listed = F.filter("every", lambda x: x["tp"] + x["fn"] > 0) if only_gold else F.col("every")
    total = lambda name: F.aggregate("every", F.lit(0).cast("long"), lambda a, x: a + x[name])
    row = lambda name, f1: F.struct(F.lit(name).alias(label), f1.alias("f1"))
    macro = F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["f1"]) / F.size(listed))
    rows = F.concat(F.transform(listed, lambda x: F.struct(x[label].alias(label), x["f1"].alias("f1"))), F.array(row("macro", macro), row("micro", prf(total("tp"), total("fp"), total("fn"))["f1"])))
    return every.select(F.inline(rows))


def word_feature_scores(gold: DataFrame, system: DataFrame, keys: list[str], order: str, boundaries: tuple[str, ...] = ("基本句-区切", "文節-区切")) -> DataFrame:
    """Scores of word features (keys, order, features: an array of names), by label, macro and micro.

    A boundary is a feature of the last word of a chunk, so it is scored by its chunks: runs of words up to one with the feature
    and, at the end of a sequence, without. All others are scored word by word. Both sides' words meet by groups and windows within keys: sides
    that are dealt by them (operators.dealing) aren't shuffled. A chunk is counted at its last word, where both sides' chunks have to end and to have begun at the same.
    """
    side = lambda df, g, s: df.select(*keys, order, "features", F.lit(g).alias("_g"), F.lit(s).alias("_s"))
    both = side(gold, 1, 0).unionByName(side(system, 0, 1))
    counts = lambda g, s, tp: (tp.cast("long").alias("tp"), (s & ~tp).cast("long").alias("fp"), (g & ~tp).cast("long").alias("fn"))
    plain = both.select(*keys, order, F.explode("features").alias("label"), "_g", "_s").where(~F.col("label").isin(*boundaries))
    g, s = F.col("_g") == 1, F.col("_s") == 1
    plain = plain.groupBy(*keys, order, "label").agg(F.max("_g").alias("_g"), F.max("_s").alias("_s")).select("label", *counts(g, s, g & s & _known(*keys, order, "label")))
    # null: no word of that side
    has = lambda x, name: F.max(F.when(F.col(x) == 1, F.coalesce(F.array_contains("features", name), F.lit(False))))
    flags = {(x, k): f"{x}{k}" for k in range(len(boundaries)) for x in ("_g", "_s")}
    if not flags:
        return counted_label_scores(plain.groupBy("label").agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")]))
    words = both.groupBy(*keys, order).agg(*[has(x, boundaries[k]).alias(c) for (x, k), c in flags.items()])
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, whole = upto.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    begins = {f"{c}_b": F.col(c).isNotNull() & F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(True)) for c in flags.values()}
    last = {f"{c}_last": F.max(F.when(F.col(c).isNotNull(), F.col(order))).over(whole) for c in flags.values()}
    own = words.withColumns(begins | last).withColumns({f"{c}_at": F.last(F.when(F.col(f"{c}_b"), F.col(order)), ignorenulls=True).over(upto) for c in flags.values()})
    ends = lambda c: F.coalesce(F.col(c) | (F.col(c).isNotNull() & (F.col(order) == F.col(f"{c}_last"))), F.lit(False))

    def chunk(k: int) -> Column:
        g, s = flags["_g", k], flags["_s", k]
        right = ends(g) & ends(s) & F.coalesce(F.col(f"{g}_at") == F.col(f"{s}_at"), F.lit(False)) & _known(*keys, order)
        return F.when(ends(g) | ends(s), F.struct(F.lit(boundaries[k]).alias("label"), *counts(ends(g), ends(s), right)))

    chunks = own.select(F.explode(F.array(*[chunk(k) for k in range(len(boundaries))])).alias("c")).where("c is not null").select("c.*")
    return counted_label_scores(plain.unionByName(chunks).groupBy("label").agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")]))


def discourse_scores(rows: DataFrame, gold: str = "gold", system: str = "system") -> DataFrame:
    """Accuracy over known labels, and micro precision, recall and F1 over all relations but the empty one (key, value)."""
    r = rows.where(F.col(gold).isNotNull() & (F.col(gold) != vocab.IGNORE_INDEX)).select(F.col(gold).alias("g"), F.col(system).alias("s"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    tp, n_s, n_g = count((F.col("g") == F.col("s")) & (F.col("g") != 0)), count(F.col("s") != 0), count(F.col("g") != 0)
    p, q = ratio(tp, n_s), ratio(tp, n_g)
    wide = r.agg(ratio(count(F.col("g") == F.col("s")), F.count("*")).alias("accuracy"), p.alias("precision"), q.alias("recall"), f_score(p, q).alias("f1"))
    return _long(wide, "discourse_relation_analysis_")


def cohesion_scores(gold: DataFrame, system: DataFrame) -> DataFrame:
    """F1 of predicate arguments, bridging and coreference over edges (doc_id, src, rel, tgt), by relation and in all; and their mean.

    An edge is right if an equal one is in gold (tgt: the base phrase's number, or the referent's name). Coreference edges
    are compared as links of each mention. One pass over the edges: their counts by relation are one row then.
    """
    task = F.when(F.col("rel") == vocab.COREFERENCE, "coreference").when(F.col("rel").isin(*vocab.BRIDGING_RELATIONS), "bridging").otherwise("pas")
    counts = span_counts(gold.withColumn("task", task), system.withColumn("task", task), ["doc_id", "src", "rel", "tgt", "task"], ["task", "rel"])
    every = with_scores(counts).agg(F.collect_list(F.struct("task", "rel", "f1", "tp", "fp", "fn")).alias("every"))
    own = lambda t: F.filter("every", lambda x: x["task"] == t)
    total = lambda t, n: F.aggregate(own(t), F.lit(0).cast("long"), lambda a, x: a + x[n])
    tasks = ("pas", "bridging", "coreference")
    f1 = {t: F.when(F.size(own(t)) > 0, prf(total(t, "tp"), total(t, "fp"), total(t, "fn"))["f1"]) for t in tasks}
    each = F.transform(own("pas"), lambda x: F.struct(F.concat_ws("_", x["task"], x["rel"], F.lit("f1")).alias("key"), x["f1"].alias("value")))
    alls = F.filter(F.array(*[F.struct(F.lit(f"{t}_f1").alias("key"), f1[t].alias("value")) for t in tasks]), lambda x: x["value"].isNotNull())
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["value"]) / F.nullif(F.size(xs), F.lit(0))
    return every.select(F.inline(F.concat(each, alls, F.array(F.struct(F.lit("cohesion_analysis_f1").alias("key"), mean(alls).alias("value"))))))


def attachment_scores(gold: DataFrame, system: DataFrame, keys: list[str]) -> DataFrame:
    """UAS and LAS of units with equal spans (keys, head, deprel), natively; the full set needs conll_table_scores().

    keys must tell the units of a side apart: repeated ones would count once for each pair.
    """
    pairs = gold.alias("g").join(system.alias("s"), keys)
    n_g, n_s = gold.agg(F.count("*").alias("n_g")), system.agg(F.count("*").alias("n_s"))
    right = pairs.agg(F.sum((F.col("g.head") == F.col("s.head")).cast("long")).alias("uas"), F.sum(((F.col("g.head") == F.col("s.head")) & (F.col("g.deprel") == F.col("s.deprel"))).cast("long")).alias("las"))
    return right.crossJoin(n_g).crossJoin(n_s).select(ratio(2 * F.col("uas"), F.col("n_g") + F.col("n_s")).alias("UAS"), ratio(2 * F.col("las"), F.col("n_g") + F.col("n_s")).alias("LAS"))


def conll_scores(gold: str, system: str) -> dict[str, float]:
    """The 13 metrics of two texts in CoNLL-U."""
    return conll.score(conll.read(gold.splitlines()), conll.read(system.splitlines()))


METRICS = ("Tokens", "Sentences", "Words", "UPOS", "XPOS", "UFeats", "AllTags", "Lemmas", "UAS", "LAS", "CLAS", "MLAS", "BLEX")


@batch("struct<" + ",".join(f"{m}:struct<gold:long,system:long,right:long>" for m in METRICS) + ">")
def conll_counts(gold: pa.Array, system: pa.Array) -> pa.Array:
    """For each of the 13 metrics of two texts in CoNLL-U: units of either and how many are right; null where the texts differ or are malformed."""
    out: list[dict | None] = []
    for g, s in zip(gold.to_pylist(), system.to_pylist(), strict=True):
        try:
            found = conll.counts(conll.read(g.splitlines()), conll.read(s.splitlines())) if g is not None and s is not None else None
        except conll.ConllError:
            found = None
        out.append(found and {m: dict(zip(("gold", "system", "right"), n, strict=True)) for m, n in found.items()})
    kind = pa.struct([("gold", pa.int64()), ("system", pa.int64()), ("right", pa.int64())])
    return pa.array(out, pa.struct([(m, kind) for m in METRICS]))


def conll_table_scores(documents: DataFrame, gold: str = "gold", system: str = "system") -> DataFrame:
    """metric, precision, recall and f1 of the 13 metrics over all documents (texts in CoNLL-U), and n_failed, how many can't be compared."""
    each = documents.select(conll_counts(gold, system).alias("c"))
    sums = [F.struct(F.lit(m).alias("metric"), *[F.coalesce(F.sum(f"c.{m}.{n}"), F.lit(0)).alias(n) for n in ("gold", "system", "right")]) for m in METRICS]
    wide = each.agg(F.array(*sums).alias("rows"), F.sum(F.col("c").isNull().cast("long")).alias("n_failed"))
    rows = wide.select("n_failed", F.inline("rows"))
    p, r = ratio(F.col("right"), F.col("system")), ratio(F.col("right"), F.col("gold"))
    return rows.select("metric", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("right"), F.col("gold") + F.col("system")).alias("f1"), "n_failed")


@arrow("array<string>")
def conll_errors(sentence: pd.Series) -> pd.Series:
    """What is wrong with a sentence of CoNLL-U lines."""
    return sentence.map(lambda s: conll.sentence_errors([x.split("\t") for x in s.split("\n") if x and not x.startswith("#")]), na_action="ignore")


def conll_line(unit: str = "u") -> Column:
    """A unit (struct idx, form, lemma, parent_idx, dep_type) as a CoNLL-U line; without a parent it hangs from the root."""
    u = F.col(unit)
    head = F.coalesce(u["parent_idx"] + 1, F.lit(0))
    return F.concat_ws("\t", (u["idx"] + 1).cast("string"), u["form"], u["lemma"], *[F.lit("_")] * 3, head.cast("string"), F.coalesce(u["dep_type"], F.lit("D")), F.lit("_"), F.lit("_"))


@arrow("struct<" + ",".join(f"{k}:struct<tp:long,fp:long,fn:long>" for k in KEYS) + ">")
def morphology(system: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Counts of written forms, readings, lemmas and canonical forms of a sentence: arrays of structs of the four."""
    rows = []
    for s, g in zip(system, gold, strict=True):
        counts = morphology_counts([tuple(x[k] for k in KEYS) for x in s], [tuple(x[k] for k in KEYS) for x in g])
        rows.append({k: dict(zip(("tp", "fp", "fn"), v, strict=True)) for k, v in counts.items()})
    return pd.DataFrame(rows, columns=list(KEYS))


def morphology_scores(sentences: DataFrame) -> DataFrame:
    """key, tp, fp, fn, precision, recall and f1 over sentences (system, gold), and in same_text the share of equal texts."""
    c = sentences.select(morphology("system", "gold").alias("c"), (F.array_join(F.transform("system", lambda x: x["surf"]), "") == F.array_join(F.transform("gold", lambda x: x["surf"]), "")).alias("same"))
    wide = c.agg(*[F.struct(*[F.sum(f"c.{k}.{x}").alias(x) for x in ("tp", "fp", "fn")]).alias(k) for k in KEYS], F.avg(F.col("same").cast("double")).alias("same"))
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), *[F.col(f"{k}.{x}").alias(x) for x in ("tp", "fp", "fn")], F.col("same").alias("same_text")) for k in KEYS])))
    return with_scores(rows)


def roll_up(metrics: DataFrame, aggregates: dict[str, list[str]] | None = None, drop: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Mean of each metric (corpus, key, value) over the corpora that have it, and named means of some of the keys.

    drop: (key prefix, corpus): the key counts for that corpus only.
    """
    rows = metrics
    for prefix, corpus in drop:
        rows = rows.where(~F.startswith("key", F.lit(prefix)) | (F.col("corpus") == corpus))
    means = rows.groupBy("key").agg(F.avg("value").alias("value"))
    for name, keys in (aggregates or {}).items():
        means = means.unionByName(means.where(F.col("key").isin(keys)).agg(F.avg("value").alias("value")).where("value is not null").select(F.lit(name).alias("key"), "value"))
    return means


def partly_gold(units: DataFrame, level: int) -> DataFrame:
    """Units with gold structure for conditional evaluation: level 1 takes features and heads from the prediction, level 2 from gold.

    units: gold and system structs of features, parent_idx, dep_type and rels; relations are always the predicted ones.
    """
    if level not in (1, 2):
        raise ValueError("level is 1 or 2")
    side = "system" if level == 1 else "gold"
    return units.select(*[c for c in units.columns if c not in ("gold", "system")], *[F.col(f"{side}.{n}").alias(n) for n in ("features", "parent_idx", "dep_type")], F.col("system.rels").alias("rels"))


def padded(values: Column | str, size: int, key: str) -> Column:
    """A dense view of a ragged array: filled up with -1024 for logits, -100 for labels, else 0."""
    filler = vocab.MASKED if key.endswith("logits") else vocab.IGNORE_INDEX if key.endswith("labels") else 0
    c = F.col(values) if isinstance(values, str) else values
    return F.slice(F.concat(c, F.array_repeat(F.lit(filler), size)), 1, size)


def mean_loss(losses: DataFrame) -> DataFrame:
    """Mean loss over examples, each counted once (the first to arrive)."""
    from tsumugi.operators.windows import first_of_each

    return first_of_each(losses, "example_id", "arrival").agg(F.avg("loss").alias("loss"))
