"""Dictionary look-up: meanings, lemmas and homographs of words; alignment joins."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow, batch
from tsumugi.kernels.align import align_reading, align_segmentations


#: Bytes of results that a part of a form's words gets, about.
PART_BYTES = 8 << 30


def look_up(words: DataFrame, entries: DataFrame, by: str = "norm") -> DataFrame:
    """words (with norm or canon, reading, pos, subpos, conjtype) and the meanings of their entries, in entry order.

    by norm: the entry's surf is the word's norm. by canon: its canon is the word's, and its lemma the norm. entries has
    ord. A word without an entry has an empty array. Entries are listed once for each distinct form, and words meet the lists: no
    pair of a word and an entry is stored. Catalyst broadcasts the lists if they are small enough.
    """
    of = {"reading": "reading", "pos": "pos", "subpos": "subpos", "conjtype": "conjtype", **({"norm": "surf"} if by == "norm" else {"canon": "canon", "norm": "lemma"})}
    rows = F.array_sort(F.collect_list(F.struct("ord", "semantics")))
    listed = entries.groupBy(*[F.col(e).alias(f"_{w}") for w, e in of.items()]).agg(F.transform(rows, lambda x: x["semantics"]).alias("meanings"))
    found = words.join(listed, [F.col(w) == F.col(f"_{w}") for w in of], "left").drop(*[f"_{w}" for w in of])
    return found.withColumn("meanings", F.coalesce("meanings", F.array().cast("array<string>")))


def by_form(words: DataFrame, looked_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key of words, and what a function finds for their distinct forms (all columns but key): what is made of an entry list is made once a form."""
    form = [c for c in words.columns if c != "key"]
    found = looked_up(words.select(*form).distinct())
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in form]
    return words.join(found.withColumnsRenamed({c: f"_{c}" for c in form}), same).drop(*form, *[f"_{c}" for c in form])


def by_long_form(words: DataFrame, looked_up: Callable[[DataFrame], DataFrame], n_bytes: Column) -> DataFrame:
    """As by_form(), for results that are long (n_bytes each): the words of a form come one after the other, so that a columnar sink can store its result once.

    Words and results are dealt by form, those of a form that makes more than PART_BYTES in several parts by their key. How many parts is
    known from counts by form; neither words nor keys of a form are brought together in a row.
    """
    form, usual = [c for c in words.columns if c != "key"], int(words.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    own = words.select("key", F.struct(*form).alias("_form"))  # null equals null within a struct
    counted = own.groupBy("_form").agg(F.count("*").alias("_n"))
    forms = counted.select("_form", "_form.*", "_n")
    found = looked_up(forms).withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_n") * n_bytes / PART_BYTES)).cast("int"))
    made = [c for c in found.columns if c not in (*forms.columns, "_parts")]
    part = own.join(found.select("_form", "_parts"), "_form").select("key", "_form", F.pmod(F.xxhash64("key"), "_parts").cast("int").alias("_part"))
    lists = found.select("_form", *made, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    on = ["_form", "_part"]
    # merged, not broadcast: a merge leaves the words in the order of their forms
    return part.repartition(usual, *on).join(lists.repartition(usual, *on).hint("merge"), on).select("key", *made)


def recover_lemmas(words: DataFrame, entries: DataFrame, inflection: DataFrame, ambiguous: list[tuple[str, str]]) -> DataFrame:
    """lemmas of words (key, norm, pos, subpos, conjtype, conjform): the first is the lemma, others make homographs.

    What doesn't inflect is its own lemma. For ambiguous (type, form) pairs, the lemmas of the dictionary's entries for the
    form, in entry order; they are listed once a form, as in look_up. Else the base form by inflection (conjtype, conjform, ending, base_ending): the longest ending
    that fits is exchanged. Where nothing is found the norm stays.
    """
    pair = F.struct("conjtype", "conjform")
    is_ambiguous = pair.isin([F.struct(F.lit(a), F.lit(b)) for a, b in ambiguous]) if ambiguous else F.lit(False)
    of = {"norm": "surf", "pos": "pos", "subpos": "subpos", "conjtype": "conjtype"}
    firsts = entries.groupBy(*[F.col(e).alias(f"_{w}") for w, e in of.items()], F.col("lemma").alias("_lemma")).agg(F.min("ord").alias("ord"))
    lists = firsts.groupBy(*[f"_{w}" for w in of]).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_lemma"))), lambda x: x["_lemma"]).alias("_listed"))
    asked = is_ambiguous & (F.col("conjtype") != "*")
    endings = inflection.select(F.col("conjtype").alias("_t"), F.col("conjform").alias("_f"), "ending", "base_ending")
    fits = F.endswith(F.col("norm"), F.col("ending"))
    stem = F.substring(F.col("norm"), F.lit(1), F.length("norm") - F.length("ending"))
    bases = (
        words.where(~is_ambiguous & (F.col("conjtype") != "*")).join(endings, (F.col("conjtype") == F.col("_t")) & (F.col("conjform") == F.col("_f")) & fits)
        .groupBy("key").agg(F.max_by(F.concat(stem, F.col("base_ending")), F.struct(F.length("ending"), "base_ending")).alias("_base"))
    )
    own = words.join(lists, [asked, *[F.col(w) == F.col(f"_{w}") for w in of]], "left").drop(*[f"_{w}" for w in of]).join(bases, "key", "left")
    return own.withColumn("lemmas", F.coalesce(F.col("_listed"), F.array(F.coalesce("_base", "norm")))).drop("_listed", "_base")


def normal_forms(words: DataFrame, inflection: DataFrame) -> DataFrame:
    """norm of words (key, surf, lemma, conjtype, conjform): the lemma, or for what inflects the lemma in the word's form.

    The base ending of the form's row in inflection is exchanged for its ending; without a row norm is null.
    """
    endings = inflection.select(F.col("conjtype").alias("_t"), F.col("conjform").alias("_f"), "ending", "base_ending")
    fits = (F.col("conjtype") == F.col("_t")) & (F.col("conjform") == F.col("_f")) & F.endswith(F.col("lemma"), F.col("base_ending"))
    stem = F.substring(F.col("lemma"), F.lit(1), F.length("lemma") - F.length("base_ending"))
    made = words.where("conjtype != '*'").join(endings, fits).groupBy("key").agg(F.max_by(F.concat(stem, F.col("ending")), F.struct(F.length("base_ending"), "ending")).alias("_norm"))
    return words.join(made, "key", "left").withColumn("norm", F.when(F.col("conjtype") == "*", F.col("lemma")).otherwise(F.col("_norm"))).drop("_norm")


def homographs(lemmas: Column | str, meanings: Column | str) -> Column:
    """The other readings of a word: every further lemma with every further meaning; with only one of either, that stays."""
    lemmas, meanings = (F.col(c) if isinstance(c, str) else c for c in (lemmas, meanings))
    rest = lambda a: F.when(F.size(a) > 1, F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))).otherwise(a)
    some = (F.size(lemmas) > 1) | (F.size(meanings) > 1)
    filled = F.when(F.size(meanings) == 0, F.array(F.lit(None).cast("string"))).otherwise(rest(meanings))
    made = F.flatten(F.transform(rest(lemmas), lambda x: F.transform(filled, lambda m: F.struct(x.alias("lemma"), m.alias("semantics")))))
    return F.when(some, made).otherwise(F.slice(made, 1, 0))


def keep_or_predict(keep: bool, given: Column | str, predicted: Column | str) -> Column:
    """Readings, lemmas and canonical forms: those given where an earlier stage made them."""
    return F.col(given) if keep else F.col(predicted)


@batch("array<string>")
def _piece_readings(words: pa.Array) -> pa.Array:
    def one(pieces: list[str], reading: str, kanji: list[dict]) -> list[str] | None:
        try:
            return align_reading(pieces, reading, {x["character"]: x["readings"] for x in kanji})
        except ValueError:
            return None

    coded = words.dictionary_encode()
    found = [one(**json.loads(w)) for w in coded.dictionary.to_pylist()]
    return pa.array(found, pa.list_(pa.string())).take(coded.indices)


def piece_readings(pieces: Column | str, reading: Column | str, kanji: Column | str) -> Column:
    """The reading of each piece of a word; kanji is an array of structs (character, readings) of the word's characters.

    Null where the reading can't be aligned, and where one of the three is null. Equal words of a batch are worked out once.
    """
    p, r, k = (F.col(c) if isinstance(c, str) else c for c in (pieces, reading, kanji))
    word = F.to_json(F.struct(p.alias("pieces"), r.alias("reading"), k.alias("kanji")))
    return _piece_readings(F.when(p.isNotNull() & r.isNotNull() & k.isNotNull(), word))


def word_readings(pieces: DataFrame) -> DataFrame:
    """reading of each word from its pieces (example_id, word_idx, token_idx, token, reading).

    An unknown or identity reading stands for the piece itself; a word whose readings are all empty reads "_".
    """
    own = F.when(F.col("reading").isin("[UNK]", "[ID]"), F.col("token")).otherwise(F.col("reading"))
    rows = F.array_sort(F.collect_list(F.struct("token_idx", own.alias("r"))))
    joined = F.array_join(F.transform(rows, lambda x: x["r"]), "")
    return pieces.groupBy("example_id", "word_idx").agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit("_")).alias("reading"))


def pool(pieces: DataFrame, how: str, value: str = "value") -> DataFrame:
    """Pieces (example_id, word_idx, token_idx, value) of each word as one: first, last, max or average."""
    return pools(pieces, {value: how}, value)


def pools(pieces: DataFrame, ways: dict[str, str], value: str = "value") -> DataFrame:
    """As pool(), for several ways at once (name of the result -> way): one pass over the pieces."""
    known = {"first": F.min_by(value, "token_idx"), "last": F.max_by(value, "token_idx"), "max": F.max(value), "average": F.avg(F.col(value).cast("double"))}
    for how in ways.values():
        if how not in known:
            raise ValueError(f"unknown pooling {how!r}")
    return pieces.groupBy("example_id", "word_idx").agg(*[known[how].alias(name) for name, how in ways.items()])


@arrow("array<struct<a1:int,a2:int,b1:int,b2:int>>")
def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    """Stretches in which two segmentations of a text agree; null if they don't."""
    names = ("a1", "a2", "b1", "b2")
    made = [align_segmentations(list(x), list(y)) for x, y in zip(a, b, strict=True)]
    return pd.Series([None if m is None else [dict(zip(names, s, strict=True)) for s in m] for m in made])


def transfer_entities(entities: DataFrame, stretches: DataFrame) -> DataFrame:
    """Entities (sid, category, start, end over tagged words) onto another segmentation by its stretches (sid, a1..b2).

    Only entities that begin and end where stretches do are carried over.
    """
    s = stretches.select("sid", "a1", "a2", "b1", "b2")
    first = s.select(F.col("sid"), F.col("a1").alias("start"), F.col("b1").alias("to_start"))
    last = s.select(F.col("sid"), F.col("a2").alias("end"), F.col("b2").alias("to_end"))
    return entities.join(first, ["sid", "start"]).join(last, ["sid", "end"]).select("sid", "category", F.col("to_start").alias("start"), F.col("to_end").alias("end"))


def onto_untagged(new: DataFrame, old: DataFrame) -> DataFrame:
    """New entities for sentences that have none yet, and the old ones."""
    return old.unionByName(new.join(old.select("sid").distinct(), "sid", "left_anti"))


def overlay(sentences: DataFrame, analysed: DataFrame) -> DataFrame:
    """Sentences with the analysis of their sid where there is one, that of the earliest window (sid, win_idx, analysis)."""
    first = Window.partitionBy("sid").orderBy("win_idx")
    own = analysed.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("sid", F.col("analysis").alias("_a"))
    return sentences.join(own, "sid", "left").withColumn("analysis", F.coalesce("_a", "analysis")).drop("_a")


def discourse_overlay(docs: DataFrame, expert: DataFrame, crowd: DataFrame) -> DataFrame:
    """discourse of docs (doc_id, text, split): the experts', else for training the crowd's, if its text is the same."""
    e = expert.select("doc_id", F.col("text").alias("_te"), F.col("discourse").alias("_de"))
    c = crowd.select("doc_id", F.col("text").alias("_tc"), F.col("discourse").alias("_dc"))
    own = docs.join(e, "doc_id", "left").join(c, "doc_id", "left")
    expert_has = F.col("_te").isNotNull()
    found = F.when(expert_has, F.when(F.col("_te") == F.col("text"), F.col("_de"))).when((F.col("split") == "train") & (F.col("_tc") == F.col("text")), F.col("_dc"))
    return own.withColumn("discourse", found).drop("_te", "_de", "_tc", "_dc")
