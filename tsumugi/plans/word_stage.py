"""The word stage: from a predictor's scores for each word to written analyses, by the table operators.

Everything is joined on a word's place in its document (word_idx), a base phrase's in its sentence (bp_idx) and in its
document; scores for pairs of words come as lists of candidates, so that no pair is made that the predictor didn't give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsumugi import vocab
from tsumugi.functions import decode
from tsumugi.operators import lexicon, structure, windows
from tsumugi.schema import BASE_PHRASE, FEATURES, MORPHEME, PHRASE
from tsumugi.sources import sinks
from tsumugi.sources.dictionary import semantics_items
from tsumugi.sources.shared import kept
from tsumugi.sources.text import emit_annotated

#: What a predictor gives for each word. Word numbers are places in the document; in heads -1 is the root, in cohesion the
#: special tokens count on from the document's number of words; a relation or pair that isn't listed isn't considered.
PREDICTIONS = (
    "doc_id string, word_idx int, reading string, pos_logits array<double>, subpos_logits array<double>, conjtype_logits array<double>, conjform_logits array<double>, "
    "word_features array<double>, ne string, bp_features array<double>, heads array<struct<head:int,dep_type:string>>, cohesion array<struct<rel:string,tgt:int,logit:double>>, discourse array<struct<tgt:int,relation:string>>"
)
#: The same as a predictor gives it: one row a window, with places counted in the window.
WINDOW_PREDICTIONS = "doc_id string, win_idx int, words array<struct<" + ",".join(f.replace(" ", ":", 1) for f in PREDICTIONS.split(", ")[2:]) + ">>"
SENT = ["doc_id", "sent_idx"]
#: Relations in the order in which they are written, and the special tokens that may be their targets.
RELATIONS = (*vocab.PAS_RELATIONS, *vocab.BRIDGING_RELATIONS, vocab.COREFERENCE)
TOKENS = tuple(t for t in vocab.SPECIAL_TOKENS if t != "[ROOT]")


@dataclass
class Dictionary:
    """entries: surf, reading, lemma, pos, subpos, conjtype, canon, semantics, ord. inflection: conjtype, conjform, ending, base_ending."""

    entries: DataFrame
    inflection: DataFrame
    ambiguous: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def read(spark: SparkSession, path: str, ambiguous: tuple[tuple[str, str], ...] = ()) -> Dictionary:
        """A dictionary from a folder that write() has made."""
        return Dictionary(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/inflection"), ambiguous)

    def write(self, path: str) -> None:
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        self.inflection.write.mode("overwrite").parquet(f"{path}/inflection")


def with_places(words: DataFrame) -> DataFrame:
    """words (doc_id, sent_idx, morph_idx) with word_idx, their place in the document."""
    return words.withColumn("word_idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx", "morph_idx")) - 1).cast("int"))


def morphemes(words: DataFrame, predictions: DataFrame, dictionary: Dictionary, keep: bool = False) -> DataFrame:
    """The words with their predicted attributes, lemma, meaning and the readings that are left open (homographs).

    keep: reading, lemma and canon are an earlier stage's and stay.
    """
    own = with_places(words).withColumnRenamed("reading", "given").join(predictions, ["doc_id", "word_idx"])
    attributes = decode.morpheme_attributes("pos_logits", "subpos_logits", "conjtype_logits", "conjform_logits")
    own = own.withColumn("a", attributes).select("*", "a.*").drop("a").withColumn("reading", lexicon.keep_or_predict(keep, "given", "reading"))
    own = own.withColumns({"norm": F.col("lemma"), "key": F.concat_ws(":", "doc_id", "word_idx")})
    with_lemmas = own.withColumn("lemmas", F.array("norm")) if keep else lexicon.recover_lemmas(own, dictionary.entries, dictionary.inflection, list(dictionary.ambiguous))
    found = lexicon.look_up(with_lemmas, dictionary.entries, by="canon" if keep else "norm")
    return found.withColumns({"lemma": F.col("lemmas")[0], "others": lexicon.homographs("lemmas", "meanings"), "semantics": F.get("meanings", F.lit(0))}).drop("lemmas", "meanings", "norm", "key", "given")


def phrases_of(words: DataFrame) -> DataFrame:
    """Base phrases of chunked words, with what was predicted for their heads, their features, entities and places."""
    cols = ["bp_features", "heads", "cohesion"]
    head = words.select(*SENT, F.col("morph_idx").alias("head_morph"), F.col("surf").alias("head_text"), F.col("word_idx").alias("head_word"), *cols)
    ends = words.select(*SENT, F.col("morph_idx").alias("first_morph"), F.col("word_idx").alias("first_word"), "discourse", "sid")
    own = structure.base_phrases_of(words).join(head, [*SENT, "head_morph"]).join(ends, [*SENT, "first_morph"])
    tags = windows.bio_spans(words.select(*SENT, "morph_idx", F.col("ne").alias("tag")), SENT, "morph_idx")
    with_ne = structure.base_phrase_features(own).join(structure.entity_features(tags, words), [*SENT, "bp_idx"], "left")
    return with_ne.withColumn("global_idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx", "bp_idx")) - 1).cast("int"))


def trees_of(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Heads of base phrases and phrases: candidates of a base phrase's head word are those in its sentence, and the root."""
    at = words.select("doc_id", F.col("word_idx").alias("head"), F.col("sent_idx").alias("of"), F.col("bp_idx").alias("to"))
    each = phrases.select(*SENT, "bp_idx", "phrase_idx", F.posexplode("heads").alias("ord", "h")).select("*", F.col("h.head").alias("head"), F.col("h.dep_type").alias("dep_type")).drop("h")
    known = each.join(at, ["doc_id", "head"], "left").where("head = -1 or of = sent_idx").withColumn("to", F.when(F.col("head") == -1, -1).otherwise(F.col("to")))
    ranked = known.groupBy(*SENT, "bp_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "to", "dep_type"))), lambda x: F.struct(x["to"].alias("head"), x["dep_type"].alias("dep_type"))).alias("ranked"))
    none = F.array().cast("array<struct<head:int,dep_type:string>>")
    return structure.dependency_trees(phrases.select(*SENT, "bp_idx", "phrase_idx").join(ranked, [*SENT, "bp_idx"], "left").select(*SENT, "bp_idx", "phrase_idx", F.coalesce("ranked", none).alias("heads")))


def relations_of(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """rels of base phrases (doc_id, global_idx): the best candidate of each relation, in the order of RELATIONS."""
    n_words = words.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_words"))
    heads = phrases.select("doc_id", F.col("head_word").alias("tgt"), F.col("global_idx").alias("tgt_ord"), "bp_idx", "sid", F.col("head_text").alias("target"))
    each = phrases.select("doc_id", F.col("global_idx").alias("src"), F.explode("cohesion").alias("c")).select("doc_id", "src", "c.*").join(n_words, "doc_id")
    to_words = each.where("tgt < n_words").join(heads, ["doc_id", "tgt"]).withColumn("token", F.lit(None).cast("string"))
    no = F.lit(None).cast("string")
    place = F.col("tgt") - F.col("n_words")
    to_tokens = each.where("tgt >= n_words").withColumns({"tgt_ord": F.lit(1 << 30) + place, "bp_idx": F.lit(None).cast("int"), "sid": no, "target": no, "token": F.try_element_at(F.lit(list(TOKENS)), place + 1)})
    found = structure.relations(to_words.unionByName(to_tokens))
    rel = F.struct(F.array_position(F.lit(list(RELATIONS)), F.col("type")).alias("o"), "type", "target", "sid", F.col("bp_idx").cast("int").alias("bp_idx"), "mode")
    ordered = F.transform(F.array_sort(F.collect_list(rel)), lambda x: F.struct(*[x[n].alias(n) for n in ("type", "target", "sid", "bp_idx", "mode")]))
    return found.groupBy("doc_id", F.col("src").alias("global_idx")).agg(ordered.alias("rels"))


def discourse_of(phrases: DataFrame) -> DataFrame:
    """discourse of the last base phrases of clauses (doc_id, global_idx): relations with other clauses, as a feature's value."""
    last = F.max("bp_idx").over(Window.partitionBy(*SENT, "clause"))
    ends = phrases.withColumn("_last", last).where("bp_idx = _last")
    heads = ends.select("doc_id", F.col("first_word").alias("tgt"), F.col("global_idx").alias("head"), F.col("sid").alias("head_sid"), F.col("bp_idx").alias("head_bp_idx"))
    pairs = ends.select("doc_id", F.col("global_idx").alias("modifier"), F.explode("discourse").alias("d")).select("doc_id", "modifier", "d.tgt", "d.relation").join(heads, ["doc_id", "tgt"])
    return structure.discourse_features(pairs).withColumnRenamed("modifier", "global_idx")


def flag(name: str | Column, value: Column | None = None) -> Column:
    key = F.lit(name) if isinstance(name, str) else name
    return F.array(F.struct(key.cast("string").alias("key"), (value if value is not None else F.lit(None)).cast("string").alias("value")))


def assemble(words: DataFrame, predictions: DataFrame, dictionary: Dictionary, keep: bool = False) -> DataFrame:
    """Parsed sentences (doc_id, sent_idx and the columns of a sentence) of words (doc_id, sent_idx, morph_idx, sid, comment, surf,
    lemma, reading, canon) and their predictions (see PREDICTIONS). Words without a prediction are left out.

    Words and base phrases, which several parts need, are worked out once and kept in the shared folder.
    """
    own = kept(structure.chunk(morphemes(words, predictions, dictionary, keep)))
    phrases = kept(phrases_of(own))
    no_features = F.array().cast(FEATURES)
    parts = phrases.join(trees_of(phrases, own).drop("phrase_idx"), [*SENT, "bp_idx"]).join(relations_of(phrases, own), ["doc_id", "global_idx"], "left").join(discourse_of(phrases).withColumnRenamed("discourse", "_discourse"), ["doc_id", "global_idx"], "left")
    given = F.transform(F.map_entries("features"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    features = F.concat(F.when(F.col("NE").isNotNull(), flag("NE", F.col("NE"))).otherwise(no_features), given, F.when(F.col("_discourse").isNotNull(), flag("談話関係", F.col("_discourse"))).otherwise(no_features))
    n = F.col("last_morph") - F.col("first_morph") + 1
    rels = F.coalesce("rels", F.array().cast("array<struct<type:string,target:string,sid:string,bp_idx:int,mode:string>>"))
    bp = F.struct("bp_idx", F.struct("parent_idx", "dep_type", features.alias("features"), n.cast("int").alias("n_morphemes"), rels.alias("rels"), "phrase_idx").cast(BASE_PHRASE).alias("x"))
    by_sentence = parts.groupBy(*SENT).agg(F.transform(F.array_sort(F.collect_list(bp), lambda a, b: a["bp_idx"] - b["bp_idx"]), lambda x: x["x"]).alias("base_phrases"))
    phrase = parts.groupBy(*SENT, "phrase_idx").agg(F.max("phrase_parent_idx").alias("parent_idx"), F.max("phrase_dep_type").alias("dep_type"), F.sum(n).cast("int").alias("n_morphemes"), F.count("*").cast("int").alias("n_base_phrases"))
    unit = F.struct("phrase_idx", F.struct("parent_idx", "dep_type", no_features.alias("features"), "n_morphemes", "n_base_phrases").cast(PHRASE).alias("x"))
    upper = phrase.groupBy(*SENT).agg(F.transform(F.array_sort(F.collect_list(unit), lambda a, b: a["phrase_idx"] - b["phrase_idx"]), lambda x: x["x"]).alias("phrases"))
    items = lambda s: F.struct(F.lit(False).alias("nil"), F.coalesce(semantics_items(s), F.array().cast(FEATURES)).alias("items"))
    marks = F.concat(*[F.when(F.col(c), flag(name)).otherwise(no_features) for c, name in (("is_head", "基本句-主辞"), ("surf_begins", "用言表記先頭"), ("surf_ends", "用言表記末尾"))])
    ids = F.concat_ws("-", *[F.col(c).cast("string") for c in ("pos_id", "subpos_id", "conjtype_id", "conjform_id")])
    alternative = lambda h: F.concat(F.concat_ws("-", F.lit("ALT"), "surf", "reading", h["lemma"], ids), F.lit('-"'), F.coalesce(h["semantics"], F.col("semantics"), F.lit("")), F.lit('"'))
    open_ = F.transform("others", lambda h: F.struct(F.substring_index(alternative(h), ":", 1).alias("key"), F.when(F.contains(alternative(h), F.lit(":")), F.substring(alternative(h), F.locate(":", alternative(h)) + 1, F.length(alternative(h)))).alias("value")))
    names = ("surf", "reading", "lemma", "pos", "pos_id", "subpos", "subpos_id", "conjtype", "conjtype_id", "conjform", "conjform_id")
    word = F.struct(*[F.col(c) for c in names], items(F.col("semantics")).alias("semantics"), F.concat(marks, open_).alias("features"), F.array().cast("array<string>").alias("homographs"), "bp_idx")
    typed = own.select(*SENT, "sid", "comment", "morph_idx", word.alias("w"))
    cast = typed.withColumn("w", F.struct(*[F.col(f"w.{c}") for c in (*names, "semantics", "features")], F.from_json(F.lit("[]"), MORPHEME.split("homographs:")[1].rsplit(",bp_idx", 1)[0]).alias("homographs"), F.col("w.bp_idx")))
    sentences = cast.groupBy(*SENT).agg(F.first("sid").alias("sid"), F.first("comment").alias("comment"), F.transform(F.array_sort(F.collect_list(F.struct("morph_idx", "w")), lambda a, b: a["morph_idx"] - b["morph_idx"]), lambda x: x["w"]).alias("morphemes"))
    return sentences.join(by_sentence, SENT).join(upper, SENT)


def written(sentences: DataFrame) -> DataFrame:
    """doc_id and text (and doc_ord, if there is one): each document's sentences as annotated lines, in order."""
    order = ["doc_ord"] if "doc_ord" in sentences.columns else []
    lines = sentences.select(*SENT, *order, emit_annotated("sid", "comment", "morphemes", "base_phrases", "phrases").alias("text"))
    return sinks.document_texts(lines, carried=order)
