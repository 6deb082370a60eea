"""Column functions on arrays of scores: choices, masks, and the tags that they stand for."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow
from tsumugi.functions.binding import let
from tsumugi import vocab
from tsumugi.kernels.crf import Chain


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(scores: Column | str) -> Column:
    """0-origin place of the largest score, the first of equal ones; null for an empty array."""
    scores = _col(scores)
    return F.nullif(F.array_position(scores, F.array_max(scores)), F.lit(0)).cast("int") - 1


def _exps(scores: Column, then) -> Column:
    """then(exponentials of the scores less the largest), each worked out once."""
    exps = let(lambda x, top: F.transform(x, lambda v: F.exp(v.cast("double") - top)), scores, F.array_max(scores).cast("double"))
    return let(then, exps)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(scores: Column | str) -> Column:
    return _exps(_col(scores), lambda e: let(lambda own, total: F.transform(own, lambda x: x / total), e, _total(e)))


def best_probability(scores: Column | str) -> Column:
    """The softmax of the largest score."""
    return 1.0 / _exps(_col(scores), _total)


def threshold_choice(scores: Column | str, threshold: float, default: int = 0) -> Column:
    """argmax where its probability reaches the threshold, else the default class."""
    return F.when(best_probability(scores) < threshold, F.lit(default)).otherwise(argmax(scores))


def top_k(scores: Column | str, k: int) -> Column:
    """Places of the k largest scores, largest first; of equal ones the first."""
    rows = F.transform(_col(scores), lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: r["i"])


def mask_scores(scores: Column | str, mask: Column | str, masked: float = vocab.MASKED) -> Column:
    return F.zip_with(_col(scores), _col(mask), lambda x, m: F.when(m, x).otherwise(F.lit(masked)))


def _legal(names: Sequence[str], groups: dict[str, Sequence[str]]) -> Column:
    """A map from each group to the mask of its names."""
    items = []
    for g, own in groups.items():
        items += [F.lit(g), F.lit([n in own for n in names])]
    return F.create_map(*items)


def morpheme_attributes(pos: Column | str, subpos: Column | str, conjtype: Column | str, conjform: Column | str) -> Column:
    """Names and ids chosen from four score arrays so that they are legal together.

    The sub-part is one of the part's; what doesn't inflect has type and form "*", else the form is one of the type's.
    """
    name = lambda names, at: F.element_at(F.lit(list(names)), at + 1)
    place = lambda names, x: F.array_position(F.lit(list(names)), x).cast("int") - 1
    pairs = F.lit(sorted(f"{a}\t{b}" for a, b in vocab.INFLECTABLE))

    def within(groups: dict, g: Column, x: Column) -> Column:
        return F.array_position(F.element_at(F.create_map(*[y for k, own in groups.items() for y in (F.lit(k), F.lit(list(own)))]), g), x).cast("int")

    def with_pos(p: Column) -> Column:
        s = name(vocab.SUBPOS, argmax(mask_scores(subpos, F.element_at(_legal(vocab.SUBPOS, vocab.SUBPOS_OF), p))))
        return let(with_subpos, p, s)

    def with_subpos(p: Column, s: Column) -> Column:
        inflects = F.array_contains(pairs, F.concat(p, F.lit("\t"), s))
        return let(with_type, p, s, inflects, F.when(inflects, name(vocab.CONJTYPES, argmax(conjtype))).otherwise(F.lit("*")))

    def with_type(p: Column, s: Column, inflects: Column, t: Column) -> Column:
        form = name(vocab.CONJFORMS, argmax(mask_scores(conjform, F.element_at(_legal(vocab.CONJFORMS, vocab.CONJFORMS_OF), t))))
        return let(with_form, p, s, t, F.when(inflects, form).otherwise(F.lit("*")))

    def with_form(p: Column, s: Column, t: Column, f: Column) -> Column:
        sub_id = within(vocab.SUBPOS_OF, p, s) - F.when(s == "*", 1).otherwise(0)
        return F.struct(
            p.alias("pos"), (place(vocab.POS, p) + 1).alias("pos_id"), s.alias("subpos"), sub_id.alias("subpos_id"), t.alias("conjtype"), place(vocab.CONJTYPES, t).alias("conjtype_id"),
            f.alias("conjform"), (within(vocab.CONJFORMS_OF, t, f) - 1).alias("conjform_id"),
        )

    return let(with_pos, name(vocab.POS, argmax(pos)))


def crf_decode(tags: tuple[str, ...], start: Sequence[float] | None = None, step: Sequence[Sequence[float]] | None = None, end: Sequence[float] | None = None):
    """A pandas function (emissions, mask) -> tag ids, by Viterbi under the BIO constraints."""
    chain = Chain(tags, start, step, end)

    @arrow("array<int>")
    def decode(emissions: pd.Series, mask: pd.Series) -> pd.Series:
        return pd.Series([chain.decode(np.array([list(x) for x in e], float), np.array(list(m), bool)) for e, m in zip(emissions, mask, strict=True)])

    return decode


def crf_log_likelihood(tags: tuple[str, ...], start: Sequence[float] | None = None, step: Sequence[Sequence[float]] | None = None, end: Sequence[float] | None = None):
    chain = Chain(tags, start, step, end)

    @arrow("double")
    def likelihood(emissions: pd.Series, gold: pd.Series, mask: pd.Series) -> pd.Series:
        return pd.Series([chain.log_likelihood(np.array([list(x) for x in e], float), list(g), np.array(list(m), bool)) for e, g, m in zip(emissions, gold, mask, strict=True)])

    return likelihood


def cross_entropy(scores: Column | str, label: Column | str) -> Column:
    """-log softmax of the label's score; null for an ignored label (null or -100)."""
    scores, label = _col(scores), _col(label)
    own = F.try_element_at(scores, label.cast("int") + 1).cast("double") - F.array_max(scores).cast("double")
    return F.when(label.isNotNull() & (label != vocab.IGNORE_INDEX), F.log(_exps(scores, _total)) - own)


def binary_cross_entropy(probabilities: Column | str, labels: Column | str) -> Column:
    """The mean over labels of -log p of each; null labels don't count."""
    rows = F.filter(F.zip_with(_col(probabilities), _col(labels), lambda p, y: F.when(y.isNotNull(), -F.log(F.when(y.cast("boolean"), p).otherwise(1 - p)))), lambda x: x.isNotNull())
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.nullif(F.size(rows), F.lit(0)))


def cohesion_loss(scores: Column | str, labels: Column | str) -> Column:
    """-sum of label weight times log softmax over candidates: several antecedents may be right; null without one."""
    scores = _col(scores)
    total = F.log(_exps(scores, _total)) + F.array_max(scores).cast("double")
    own = let(lambda x, y, t: _total(F.zip_with(x, y, lambda v, right: F.when(right.cast("boolean"), t - v.cast("double")).otherwise(F.lit(0.0)))), scores, _col(labels), total)
    return F.when(F.exists(_col(labels), lambda y: y.cast("boolean")), own)
