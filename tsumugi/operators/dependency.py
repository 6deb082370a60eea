"""Dependency trees as tables: their validation, and the 13 shared-task metrics for differing segmentations.

Words are rows (doc_id, sent_idx, word_idx: their place in the document, form, lemma, upos, xpos, feats, head: a place in the
document or -1 for the root, deprel). Words of a multi-word token have its written form as token_form and the place of its first word as token_idx;
both are null for other words. Words are aligned by their character spans: by windows over equal spans, and within stretches of
multi-word tokens by a longest common subsequence of forms, for many stretches at a time.

The words of both sides are one table whose groups, windows and joins all are within documents: they are shuffled once, by doc_id, or not at all if
they come dealt by it (operators.dealing). Where a side has multi-word tokens, aligned words are shuffled again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import batch
from tsumugi.kernels.conll import CONTENT_DEPRELS, FUNCTIONAL_DEPRELS
from tsumugi.operators.metrics import METRICS, ratio

DOC = "doc_id"


# --- validation


def tree_errors(words: DataFrame) -> DataFrame:
    """doc_id, sent_idx and error for everything that is wrong with sentences of rows (doc_id, sent_idx, id, head: 0 for the root).

    "ids": not 1 to n; "head": null or none of 0 to n; "roots": not exactly one word hangs from the root; "cycle": a word that the root can't be
    reached from. A sentence can have several. For the last, the heads of a sentence are one array, in which every word's head is replaced by
    that one's head until 2^steps is its length: a word whose way ends at the root has it then. A sentence is what a row holds.
    """
    own = words.select(DOC, "sent_idx", F.col("id").cast("int").alias("id"), F.col("head").cast("int").alias("head"))
    sentence = own.groupBy(DOC, "sent_idx").agg(
        F.count("*").alias("n"), (F.countDistinct("id") != F.count("*")).alias("twice"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("nulls"),
        F.count_if(F.col("head") == 0).alias("roots"), F.count_if(F.col("head").isNull() | (F.col("head") < 0)).alias("bad"), F.max("head").alias("far"),
    )
    checks = {"ids": F.col("twice") | (F.col("nulls") > 0) | (F.col("low") != 1) | (F.col("high") != F.col("n")), "head": (F.col("bad") > 0) | (F.col("far") > F.col("n")), "roots": F.col("roots") != 1}
    simple = sentence.select(DOC, "sent_idx", F.explode(F.filter(F.array(*[F.when(c, name) for name, c in checks.items()]), lambda x: x.isNotNull())).alias("error"))
    # only a sentence whose heads are all in range can have a cycle; one without a root is all cycle
    sound = own.groupBy(DOC, "sent_idx").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("id", "head"))).alias("w"), (F.countDistinct("id") == F.count("*")).alias("once"), F.count_if(F.col("id").isNull() | F.col("head").isNull() | (F.col("head") < 0)).alias("bad"), F.max("head").alias("far")).where("once and bad = 0 and far <= n")
    ids = F.transform("w", lambda x: x["id"])
    counted = (F.col("w")[0]["id"] == 1) & (F.element_at("w", -1)["id"] == F.col("n"))
    # a head as the place of its word; one that no word is, is its own head and leads nowhere
    place = lambda x: F.when(x["head"] == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position("ids", x["head"]), F.lit(0)), F.array_position("ids", x["id"]))).cast("int")
    heads = F.when(counted, F.transform("w", lambda x: x["head"])).otherwise(F.transform("w", place))
    step = lambda h, _: F.transform(h, lambda x: F.when(x == 0, 0).otherwise(F.element_at(h, x)))
    ends = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.col("n") + 1)).cast("int")), F.col("heads"), step)
    cycles = sound.withColumn("ids", ids).withColumn("heads", heads).where(F.exists(ends, lambda x: x != 0)).select(DOC, "sent_idx", F.lit("cycle").alias("error"))
    return simple.unionByName(cycles)


# --- spans and alignment


def spanned(words: DataFrame) -> DataFrame:
    """words with start and end in the document's characters (spaces within forms don't count), and multi: whether their token has several."""
    own = words if "token_idx" in words.columns else words.withColumns({"token_idx": F.lit(None).cast("int"), "token_form": F.lit(None).cast("string")})
    first = F.col("token_idx").isNull() | (F.col("token_idx") == F.col("word_idx"))
    length = F.length(F.replace(F.coalesce("token_form", "form"), F.lit(" "), F.lit("")))
    upto = F.sum(F.when(first, length).otherwise(0)).over(Window.partitionBy(DOC).orderBy("word_idx"))
    return own.withColumns({"end": upto.cast("int"), "first": first, "multi": F.col("token_idx").isNotNull()}).withColumn("start", F.col("end") - length)


def stretches(rows: DataFrame) -> DataFrame:
    """doc_id, low and high of the stretches that multi-word tokens of either side cover together (rows: spanned words of both sides).

    Tokens that overlap are in one stretch. A stretch goes on to the end of the gold word that is the first from its start on, if that
    is part of a multi-word token. Those of a document are few; they are joined by a fold over their array.
    """
    gold = rows.where(~F.col("system"))
    spans = rows.where("multi").select(DOC, "start", "end").distinct()
    order = Window.partitionBy(DOC).orderBy("start", "end")
    begins = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = spans.withColumn("_b", begins.cast("int")).withColumn("_run", F.sum("_b").over(order))
    own = runs.groupBy(DOC, "_run").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    # the next gold word: by one sort of words and stretches, from the end
    none = F.lit(None).cast("struct<end:int,multi:boolean>")
    marks = own.select(DOC, F.col("low").alias("_at"), F.lit(1).alias("_kind"), "high", none.alias("_word"))
    words = gold.select(DOC, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("high"), F.struct("end", "multi").alias("_word"))
    following = F.last("_word", ignorenulls=True).over(Window.partitionBy(DOC).orderBy(F.desc("_at"), "_kind"))
    reach = marks.unionByName(words).withColumn("_next", following).where("_kind = 1")
    run = F.struct(F.col("_at").alias("low"), "high", F.greatest("high", F.when(F.col("_next.multi"), F.col("_next.end"))).alias("to"))
    kind = "array<struct<low:int,high:int>>"

    def joined(made: Column, x: Column) -> Column:
        last = F.try_element_at(made, F.lit(-1))
        longer = F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))
        return F.when((F.size(made) > 0) & (x["low"] < last["high"]), F.concat(F.slice(made, 1, F.size(made) - 1), F.array(longer))).otherwise(F.concat(made, F.array(F.struct(x["low"].alias("low"), x["to"].alias("high")))))

    listed = reach.groupBy(DOC).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return listed.select(DOC, F.inline(F.aggregate("runs", F.array().cast(kind), lambda made, x: joined(made, x).cast(kind))))


def within_stretches(words: DataFrame, runs: DataFrame) -> DataFrame:
    """words with low, the start of the stretch that they begin in (null: none): found by one sort of words and stretches, no range join."""
    names = [n for n in words.columns if n != DOC]
    marks = runs.select(DOC, F.col("low").alias("_at"), F.lit(0).alias("_kind"), F.struct("low", "high").alias("_run"), F.lit(None).cast(words.select(F.struct(*names)).dtypes[0][1]).alias("_w"))
    rows = words.select(DOC, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<low:int,high:int>").alias("_run"), F.struct(*names).alias("_w"))
    last = F.last("_run", ignorenulls=True).over(Window.partitionBy(DOC).orderBy("_at", "_kind"))
    both = marks.unionByName(rows).withColumn("_last", last).where("_kind = 1")
    return both.select(DOC, "_w.*", F.when(F.col("_at") < F.col("_last.high"), F.col("_last.low")).alias("low"))


@batch("array<struct<g:int,s:int>>")
def common_subsequences(gold: pa.Array, system: pa.Array) -> pa.Array:
    """Places of a longest common subsequence of two arrays of strings, the earliest in the first, for all rows at a time.

    The table is filled cell by cell for every row of the batch at once; rows are padded with values that equal nothing.
    """
    rows = list(zip(gold.to_pylist(), system.to_pylist(), strict=True))
    kind = pa.list_(pa.struct([("g", pa.int32()), ("s", pa.int32())]))
    out: list[list[dict] | None] = [None if a is None or b is None else [] for a, b in rows]
    sizes: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(rows):
        if a and b:  # rows of like size together, so that little is padded
            sizes.setdefault(((len(a) - 1).bit_length(), (len(b) - 1).bit_length()), []).append(k)
    for of in sizes.values():
        n, m = max(len(rows[k][0]) for k in of), max(len(rows[k][1]) for k in of)
        step = max(1, (1 << 22) // ((n + 1) * (m + 1)))
        for at in range(0, len(of), step):
            some = of[at : at + step]
            code: dict[str | None, int] = {}
            a, b = np.full((len(some), n), -1), np.full((len(some), m), -2)
            for r, k in enumerate(some):
                for side, values in ((a, rows[k][0]), (b, rows[k][1])):
                    side[r, : len(values)] = [code.setdefault(v, len(code)) for v in values]
            size = np.zeros((n + 1, m + 1, len(some)), np.int32)
            for i in range(n - 1, -1, -1):
                for j in range(m - 1, -1, -1):
                    size[i, j] = np.where(a[:, i] == b[:, j], size[i + 1, j + 1] + 1, np.maximum(size[i + 1, j], size[i, j + 1]))
            i, j, r = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), np.arange(len(some))
            while len(r):
                same = a[r, i[r]] == b[r, j[r]]
                for x in r[same].tolist():
                    out[some[x]].append({"g": int(i[x]), "s": int(j[x])})
                down = same | (size[i[r] + 1, j[r], r] >= size[i[r], j[r] + 1, r])
                right = same | ~down
                i[r] += down
                j[r] += right
                r = r[(i[r] < n) & (j[r] < m)]
    return pa.array(out, kind)


def align(rows: DataFrame) -> DataFrame:
    """rows (spanned words of both sides) with of: the place of the word of the other side that they are aligned with, or null."""
    # an empty form has the span of its neighbour's end: its turn among equal spans tells it apart
    turn = F.row_number().over(Window.partitionBy(DOC, "start", "end", "system").orderBy("word_idx"))
    equal = Window.partitionBy(DOC, "start", "end", "_turn")
    place = lambda system: F.max(F.when(F.col("system") == system, F.col("word_idx"))).over(equal)
    other = F.when(F.col("start").isNotNull(), F.when(F.col("system"), place(False)).otherwise(place(True)))
    by_spans = lambda some: some.withColumn("_turn", turn).withColumn("of", other).drop("_turn")
    if "token_idx" not in rows.columns:
        return by_spans(rows)
    found = within_stretches(rows, stretches(rows))
    inside = found.where("low is not null").drop("low")
    forms = [F.array_sort(F.collect_list(F.when(F.col("system") == side, F.struct("word_idx", F.lower("form").alias("form"))))).alias(name) for side, name in ((False, "g"), (True, "s"))]
    pairs = found.where("low is not null").groupBy(DOC, "low").agg(*forms).select(DOC, "g", "s", common_subsequences("g.form", "s.form").alias("c"))
    end = lambda p, name: F.element_at(f"{name}.word_idx", p[name] + 1)
    both = F.flatten(F.transform("c", lambda p: F.array(F.struct(F.lit(False).alias("system"), end(p, "g").alias("word_idx"), end(p, "s").alias("of")), F.struct(F.lit(True).alias("system"), end(p, "s").alias("word_idx"), end(p, "g").alias("of")))))
    aligned = pairs.select(DOC, F.inline(both)).withColumn("_pair", F.lit(True))
    marked = inside.unionByName(aligned, allowMissingColumns=True).withColumn("of", F.max("of").over(Window.partitionBy(DOC, "system", "word_idx"))).where("_pair is null").drop("_pair")
    return by_spans(found.where("low is null").drop("low")).unionByName(marked)


# --- metrics


def kept_features(feats: Column | str, names: frozenset[str]) -> Column:
    """Those of the features a=b|c=d whose names count, in order."""
    each = F.filter(F.split(F.col(feats) if isinstance(feats, str) else feats, r"\|"), lambda f: F.substring_index(f, "=", 1).isin(sorted(names)))
    return F.array_join(F.array_sort(each), "|")


def aligned_pairs(rows: DataFrame) -> DataFrame:
    """doc_id, g_w and s_w (the words of a pair), g_c and s_c (their functional children, in order: key, deprel, upos and feats) and head_g: the gold word that the system word's head is aligned with.

    rows: words with of (see align()). Words and what hangs from them meet by a window over the head's place: so a system word finds what its head is
    aligned with, and a functional word the pair that it is a child of. Each goes to the gold word's place of its pair then.
    """
    word = F.struct("upos", "xpos", "feats", "lemma", "deprel", "head")
    key = F.when(F.col("system"), F.coalesce("of", F.lit(-2))).otherwise(F.col("word_idx")).alias("key")
    child = F.struct("word_idx", F.struct(key, "deprel", "upos", "feats").alias("x"))
    kinds = [rows.dtypes[rows.columns.index("word_idx")][1], *[rows.select(c.alias("c")).dtypes[0][1] for c in (word, child)]]
    as_ = lambda kind, at, own, me, c: rows.select(DOC, "system", F.lit(kind).alias("_kind"), F.col(at).alias("_at"), own.cast(kinds[0]).alias("_of"), me.cast(kinds[1]).alias("_w"), c.cast(kinds[2]).alias("_c"))
    null, hangs = F.lit(None), F.col("_at") >= 0
    itself = as_(0, "word_idx", F.col("of"), word, null)
    below = as_(1, "head", F.col("of"), null, null).where(hangs & F.col("system") & F.col("_of").isNotNull())
    functional = as_(2, "head", null, null, F.when(F.col("deprel").isin(sorted(FUNCTIONAL_DEPRELS)), child)).where(hangs & F.col("_c").isNotNull())
    to = F.max(F.when(F.col("_kind") == 0, F.col("_of"))).over(Window.partitionBy(DOC, "system", "_at"))  # what the word at that place is aligned with
    met = itself.unionByName(below).unionByName(functional).withColumn("_to", to)
    there = F.when(F.col("system"), F.col("_to")).when(F.col("_to").isNotNull(), F.col("_at"))
    ends = met.withColumn("_pair", F.when(F.col("_kind") == 1, F.col("_of")).otherwise(there)).where("_pair is not null")
    of = lambda system: F.first(F.when(F.col("system") == system, F.col("_w")), ignorenulls=True)
    children = lambda system: F.array_sort(F.collect_list(F.when(F.col("system") == system, F.col("_c"))))["x"]
    return ends.groupBy(DOC, "_pair").agg(of(False).alias("g_w"), of(True).alias("s_w"), children(False).alias("g_c"), children(True).alias("s_c"), F.max(F.when(F.col("_kind") == 1, F.col("_to"))).alias("head_g"))


def dependency_counts(gold: DataFrame, system: DataFrame) -> DataFrame:
    """metric, gold, system and right of the 13 metrics over all documents whose texts are equal on both sides; n_failed: how many aren't.

    deprels are compared without their subtypes (what follows a colon), feats as given (see kept_features()). Each document is
    counted on its own, whether its texts are equal or not, and left out then, so that no words are kept or shuffled for that.
    """
    tokens = [n for n in ("token_idx", "token_form") if "token_idx" in gold.columns or "token_idx" in system.columns]
    names = (DOC, "system", "sent_idx", "word_idx", "form", "lemma", "upos", "xpos", "feats", "head", *tokens, "start", "end", "first", "multi")
    side = lambda w, system: spanned(w).withColumn("system", F.lit(system)).select(*names, F.coalesce("token_form", "form").alias("_t"), F.substring_index("deprel", ":", 1).alias("deprel"))
    rows = side(gold, False).unionByName(side(system, True))
    # a document's texts, sizes and spans, by its sentences; a span is one number
    content = F.col("deprel").isin(sorted(CONTENT_DEPRELS))
    span = F.col("start").cast("long") * F.lit(1 << 32) + F.col("end")
    piece = F.when(F.col("first"), F.struct("word_idx", F.replace("_t", F.lit(" "), F.lit("")).alias("t"), span.alias("span")))
    sizes = {"words": F.count("*"), "content": F.count_if(content), "tokens": F.count_if("first")}
    by_sentence = rows.groupBy(DOC, "system", "sent_idx").agg(F.collect_list(piece).alias("pieces"), F.min("start").alias("start"), F.max("end").alias("end"), *[c.alias(n) for n, c in sizes.items()])
    sides = {"g": ~F.col("system"), "s": F.col("system")}
    text = lambda own: F.array_sort(F.flatten(F.collect_list(F.when(own, F.col("pieces")))))
    size = lambda own: F.struct(*[F.coalesce(F.sum(F.when(own, F.col(n))), F.lit(0)).alias(n) for n in sizes], F.count_if(own & F.col("sent_idx").isNotNull()).alias("sentences"))
    documents = by_sentence.groupBy(DOC).agg(*[text(c).alias(f"t_{x}") for x, c in sides.items()], *[F.collect_list(F.when(c, span)).alias(f"spans_{x}") for x, c in sides.items()], *[size(c).alias(f"n_{x}") for x, c in sides.items()])
    joined = lambda x: F.array_join(F.transform(f"t_{x}", lambda p: p["t"]), "")
    has = {x: F.size(f"t_{x}") > 0 for x in sides}
    same = F.col(DOC).isNotNull() & has["g"] & has["s"] & (joined("g") == joined("s"))
    failed = F.when(F.col(DOC).isNull(), has["g"].cast("long") + has["s"].cast("long")).otherwise((~same).cast("long"))
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    shared = lambda g, s: F.size(F.array_intersect(known(g), known(s))).cast("long")
    documents = documents.select(DOC, same.alias("same"), failed.alias("failed"), "n_g", "n_s", shared(F.col("t_g.span"), F.col("t_s.span")).alias("Tokens"), shared("spans_g", "spans_s").alias("Sentences"))
    # aligned words
    equal = lambda *of: F.forall(F.array(*[F.col(f"g_w.{n}").eqNullSafe(F.col(f"s_w.{n}")) for n in of]), lambda x: x)
    lemma = (F.col("g_w.lemma") == "_") | equal("lemma")
    attached = F.when(F.col("s_w.head") < 0, F.col("g_w.head") < 0).otherwise(F.coalesce(F.col("head_g") == F.col("g_w.head"), F.lit(False)))
    labelled = attached & equal("deprel")
    content = F.col("g_w.deprel").isin(sorted(CONTENT_DEPRELS))
    children = F.col("g_c").eqNullSafe(F.col("s_c"))
    right = {
        "Words": F.lit(True), "UPOS": equal("upos"), "XPOS": equal("xpos"), "UFeats": equal("feats"), "AllTags": equal("upos", "xpos", "feats"), "Lemmas": lemma, "UAS": attached, "LAS": labelled,
        "CLAS": content & labelled, "MLAS": content & labelled & equal("upos", "feats") & children, "BLEX": content & labelled & lemma,
    }
    words = aligned_pairs(align(rows)).groupBy(DOC).agg(*[F.count_if(c).alias(m) for m, c in right.items()])
    # a row a document is shuffled, so that one task doesn't hold what either part needs
    each = documents.repartition(DOC).join(words.repartition(DOC), DOC, "left")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("same"), F.col(c))), F.lit(0))
    unit = lambda m, x: f"n_{x}." + ("sentences" if m == "Sentences" else "tokens" if m == "Tokens" else "content" if m in ("CLAS", "MLAS", "BLEX") else "words")
    one = each.agg(F.coalesce(F.sum("failed"), F.lit(0)).alias("n_failed"), *[F.struct(F.lit(m).alias("metric"), total(unit(m, "g")).alias("gold"), total(unit(m, "s")).alias("system"), total(m).alias("right")).alias(m) for m in METRICS])
    return one.select("n_failed", F.inline(F.array(*METRICS)))


def dependency_scores(gold: DataFrame, system: DataFrame) -> DataFrame:
    """metric, precision, recall, f1 and n_failed: see dependency_counts()."""
    c = dependency_counts(gold, system)
    return c.select("metric", ratio(F.col("right"), F.col("system")).alias("precision"), ratio(F.col("right"), F.col("gold")).alias("recall"), ratio(2 * F.col("right"), F.col("gold") + F.col("system")).alias("f1"), "n_failed")
