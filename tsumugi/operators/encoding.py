"""Encoded word examples as sparse tables: labels a word, and edges with their masks as offsets and indices.

Words are rows (example_id, sent_idx, word_idx: place in the example, target). Special tokens follow the words at places that
n_words and their order give. A dense label or mask of relations x places x places is never made: edges are rows, and csr()
puts those of an example into two arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsumugi import vocab
from tsumugi.operators.structure import antecedent_candidates, head_candidates

EX = "example_id"
TAGS = {"pos": vocab.POS, "subpos": vocab.SUBPOS, "conjtype": vocab.CONJTYPES, "conjform": vocab.CONJFORMS}


def _place(value: Column | str, names: tuple[str, ...]) -> Column:
    """The place of a name among names; null if it isn't there."""
    at = F.array_position(F.lit(list(names)), F.col(value) if isinstance(value, str) else value).cast("int")
    return F.when(at > 0, at - 1)


def _flags(features: str, names: tuple[str, ...]) -> Column:
    return F.transform(F.lit(list(names)), lambda n: F.array_contains(features, n).cast("int"))


def word_labels(words: DataFrame) -> DataFrame:
    """example_id, word_idx, ids of pos, subpos, conjtype and conjform, and flags of the word features (array<string>) of each target word.

    A name that the vocabulary hasn't has no label (null). Words that aren't targets have no row: they are ignored.
    """
    own = words.where("target")
    return own.select(EX, "word_idx", *[_place(c, names).alias(c) for c, names in TAGS.items()], _flags("features", vocab.WORD_FEATURES).alias("features"))


def base_phrase_labels(heads: DataFrame) -> DataFrame:
    """example_id, word_idx and flags of the base phrase features (array<string>) of target base phrases' head words."""
    return heads.where("target").select(EX, "word_idx", _flags("features", vocab.BASE_PHRASE_FEATURES).alias("features"))


def entity_labels(entities: DataFrame, words: DataFrame, categories: tuple[str, ...] = vocab.NE_CATEGORIES) -> DataFrame:
    """example_id, word_idx and the id of the tag of every word, for entities (example_id, category, start, end: excluded).

    Entities that share a word are an error that names the example.
    """
    tags = vocab.ne_tags(categories)
    each = entities.select(EX, "category", "start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("word_idx"))
    tag = F.concat(F.when(F.col("word_idx") == F.col("start"), "B-").otherwise("I-"), "category")
    nested = F.raise_error(F.concat(F.lit("nested entities in "), F.col(EX).cast("string"))).cast("string")
    one = each.withColumn("tag", tag).groupBy(EX, "word_idx").agg(F.count("*").alias("n"), F.max("tag").alias("tag")).select(EX, "word_idx", F.when(F.col("n") == 1, F.col("tag")).otherwise(nested).alias("tag"))
    return words.select(EX, "word_idx").join(one, [EX, "word_idx"], "left").select(EX, "word_idx", F.coalesce(_place("tag", tags), F.lit(tags.index("O"))).alias("label"))


def sizes(words: DataFrame) -> DataFrame:
    """example_id and n_words."""
    return words.groupBy(EX).agg(F.count("*").cast("int").alias("n_words"))


def special_place(token: Column, n_words: Column | str = "n_words") -> Column:
    """The place of a special token behind an example's words."""
    return (F.col(n_words) if isinstance(n_words, str) else n_words) + _place(token, vocab.SPECIAL_TOKENS)


def dependency_edges(words: DataFrame, heads: DataFrame) -> DataFrame:
    """kind, example_id, src, tgt and label: "head" edges of heads (example_id, src, head: -1 for the root, dep_type) with the type's id,
    and "mask" edges: each target word with the other words of its sentence and the root, which are the candidates."""
    n = sizes(words)
    own = heads.join(words.where("target").select(EX, F.col("word_idx").alias("src")), [EX, "src"]).join(n, EX)
    root = special_place(F.lit("[ROOT]"))
    labels = own.select(F.lit("head").alias("kind"), EX, "src", F.when(F.col("head") == -1, root).otherwise(F.col("head")).cast("int").alias("tgt"), _place("dep_type", vocab.DEPENDENCY_TYPES).alias("label"))
    pairs = head_candidates(words.select(F.col(EX).alias("doc_id"), "sent_idx", "word_idx"), "word_idx").join(words.where("target").select(F.col(EX).alias("doc_id"), F.col("word_idx").alias("src")), ["doc_id", "src"])
    mask = pairs.withColumnRenamed("doc_id", EX).join(n, EX).select(F.lit("mask").alias("kind"), EX, "src", F.when(F.col("tgt") == -1, root).otherwise(F.col("tgt")).cast("int").alias("tgt"), F.lit(1).alias("label"))
    return labels.unionByName(mask)


def cohesion_edges(words: DataFrame, phrases: DataFrame, tags: DataFrame, rule: Column | None = None) -> DataFrame:
    """kind, rel, example_id, src, tgt and label (1) of cohesion.

    phrases: example_id, global_idx, head (its head word's place), first, last (words), target. tags: example_id, global_idx, rel and tags (array<string>: numbers
    of base phrases, or special tokens). "label" edges go from a target's head word to the head word or special token of
    each tag. "mask" edges go from every word of a target to the head words of its candidates (what precedes it, or a rule over src
    and tgt) and to the special tokens but the root; they hold for all relations (rel is null).
    """
    n = sizes(words)
    targets = phrases.where("target")
    heads = phrases.select(EX, F.col("global_idx").alias("to"), F.col("head").alias("to_head"))
    each = tags.join(targets.select(EX, "global_idx", F.col("head").alias("src")), [EX, "global_idx"]).join(n, EX).withColumn("tag", F.explode("tags"))
    found = each.withColumn("to", F.when(F.col("tag").rlike("^[0-9]+$"), F.col("tag").cast("int"))).join(heads, [EX, "to"], "left")
    labels = found.select(F.lit("label").alias("kind"), "rel", EX, "src", F.coalesce("to_head", special_place(F.col("tag"))).cast("int").alias("tgt"), F.lit(1).alias("label")).where("tgt is not null").distinct()
    pairs = antecedent_candidates(phrases.withColumnRenamed(EX, "doc_id"), rule, F.col("target")).withColumnRenamed("doc_id", EX)
    within = targets.select(EX, F.col("global_idx").alias("of"), F.explode(F.sequence("first", "last")).alias("src"))
    to_heads = pairs.select(EX, F.col("src").alias("of"), F.col("tgt").alias("to")).join(heads, [EX, "to"]).join(within, [EX, "of"]).select(EX, "src", F.col("to_head").alias("tgt"))
    tokens = [t for t in vocab.SPECIAL_TOKENS if t != "[ROOT]"]
    to_tokens = within.join(n, EX).select(EX, "src", F.explode(F.transform(F.lit([vocab.SPECIAL_TOKENS.index(t) for t in tokens]), lambda k: k + F.col("n_words"))).alias("tgt"))
    mask = to_heads.unionByName(to_tokens).select(F.lit("mask").alias("kind"), F.lit(None).cast("string").alias("rel"), EX, "src", F.col("tgt").cast("int").alias("tgt"), F.lit(1).alias("label"))
    return labels.unionByName(mask)


def discourse_edges(relations: DataFrame) -> DataFrame:
    """example_id, src, tgt and label: the id of the relation between two clauses' words (example_id, modifier, head, relation); relations that aren't known are ignored."""
    return relations.select(EX, F.col("modifier").alias("src"), F.col("head").alias("tgt"), _place("relation", vocab.DISCOURSE_RELATIONS).alias("label")).where("label is not null")


def subword_map(tokens: DataFrame, specials: DataFrame | None = None) -> DataFrame:
    """example_id, src (a word's place) and tgt (a token's): which tokens a word has (example_id, token_idx, word_idx: null for none), and special tokens' own."""
    own = tokens.where("word_idx is not null").select(EX, F.col("word_idx").alias("src"), F.col("token_idx").alias("tgt"))
    return own if specials is None else own.unionByName(specials.select(EX, F.col("word_idx").alias("src"), F.col("token_idx").alias("tgt")))


def csr(edges: DataFrame, keys: list[str], n: DataFrame | None = None) -> DataFrame:
    """keys, offsets and indices: of each key's edges (src, tgt), indices[offsets[i]:offsets[i + 1]] are the targets of place i, in order.

    n (keys and n_words): places that there are at least, with edges or without. A key's edges are one row: windows bound them.
    """
    per = edges.groupBy(*keys, "src").agg(F.array_sort(F.collect_set("tgt")).alias("to"))
    rows = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("src", "to"))).alias("rows"))
    own = rows.join(n, keys, "left") if n is not None else rows.withColumn("n_words", F.lit(0))
    places = F.greatest(F.coalesce("n_words", F.lit(0)), F.element_at("rows", -1)["src"] + 1)
    by = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["src"].alias("src"), F.size(r["to"]).alias("size"))))
    counted = own.select(*keys, "rows", F.transform(F.sequence(F.lit(0), places - 1), lambda i: F.coalesce(F.try_element_at(by, i), F.lit(0))).alias("_n"))
    summed = F.aggregate("_n", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return counted.select(*keys, summed.alias("offsets"), F.flatten(F.transform("rows", lambda r: r["to"])).alias("indices"))
