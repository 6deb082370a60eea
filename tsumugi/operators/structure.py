"""Structure builders: chunks, entities, features, dependencies, relations between phrases, and encoded examples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow
from tsumugi.functions.binding import let
from tsumugi import vocab
from tsumugi.functions.decode import argmax
from tsumugi.kernels.trees import build_tree, has_cycle, phrase_heads

WORD = ["doc_id", "sent_idx"]


def word_table(sentences: DataFrame) -> DataFrame:
    """One row a morpheme of parsed sentences: doc_id, sent_idx, sid, morph_idx and its columns (features as they were read)."""
    return sentences.select("doc_id", "sent_idx", "sid", F.posexplode("morphemes").alias("morph_idx", "m")).select("doc_id", "sent_idx", "sid", "morph_idx", "m.*")


def base_phrase_table(sentences: DataFrame) -> DataFrame:
    """One row a base phrase of parsed sentences, with its place in the document and its first and last word."""
    each = sentences.select("doc_id", "sent_idx", "sid", F.posexplode("base_phrases").alias("bp_idx", "b")).select("doc_id", "sent_idx", "sid", "bp_idx", "b.*")
    within = Window.partitionBy(*WORD).orderBy("bp_idx")
    upto = F.sum("n_morphemes").over(within)
    document = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx", "bp_idx")) - 1
    return each.withColumns({"last_morph": (upto - 1).cast("int"), "first_morph": (upto - F.col("n_morphemes")).cast("int"), "global_idx": document})


def gold_entities(base_phrases: DataFrame, words: DataFrame) -> DataFrame:
    """category, start and end of the NE features of base phrases: words up to the base phrase's last that spell the entity.

    The shortest run of words that ends there and has the entity's text; features that no run spells give nothing.
    """
    ne = F.element_at(F.filter("features", lambda f: f["key"] == "NE"), 1)["value"]
    own = base_phrases.where(F.exists("features", lambda f: f["key"] == "NE")).select(*WORD, F.col("last_morph").alias("_last"), F.substring_index(ne, ":", 1).alias("category"), ne.alias("_ne"))
    text = F.substring(F.col("_ne"), F.locate(":", F.col("_ne")) + 1, F.length("_ne"))
    w = words.select(*WORD, "morph_idx", "surf")
    runs = own.join(w, WORD).where("morph_idx <= _last")
    tail = Window.partitionBy(*WORD, "_last").orderBy(F.desc("morph_idx"))
    spelt = F.array_join(F.reverse(F.collect_list("surf").over(tail)), "")
    found = runs.withColumn("_spelt", spelt).where(F.col("_spelt") == text)
    return found.groupBy(*WORD, "category", "_last").agg(F.max("morph_idx").alias("start")).select(*WORD, "category", "start", (F.col("_last") + 1).alias("end"))


def chunk(words: DataFrame, scores: str = "word_features") -> DataFrame:
    """bp_idx and phrase_idx of words (doc_id, sent_idx, morph_idx, scores) and their flags.

    A base phrase ends where its score is at least 0.5, or the two end scores make at least 1 together; a phrase where its
    own is at least 0.5 and both make 1. What is left at the end of a sentence is a chunk too.
    """
    s = {f: F.element_at(scores, k + 1) for k, f in enumerate(vocab.WORD_FEATURES)}
    bp, ph = s["基本句-区切"], s["文節-区切"]
    w = Window.partitionBy(*WORD).orderBy("morph_idx").rowsBetween(Window.unboundedPreceding, -1)
    ends_bp = (bp >= 0.5) | (bp + ph >= 1.0)
    ends_ph = (ph >= 0.5) & (bp + ph >= 1.0)
    before = lambda c: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0)).cast("int")
    return words.withColumns(
        {"bp_idx": before(ends_bp), "phrase_idx": before(ends_ph), "is_head": s["基本句-主辞"] >= 0.5, "surf_begins": s["用言表記先頭"] >= 0.5, "surf_ends": s["用言表記末尾"] >= 0.5}
    )


def base_phrases_of(words: DataFrame) -> DataFrame:
    """Base phrases of chunked words: their phrase, first and last word, and head (the first word marked so, else the last)."""
    head = F.coalesce(F.min(F.when(F.col("is_head"), F.col("morph_idx"))), F.max("morph_idx"))
    return words.groupBy(*WORD, "bp_idx").agg(F.min("phrase_idx").alias("phrase_idx"), F.min("morph_idx").alias("first_morph"), F.max("morph_idx").alias("last_morph"), head.alias("head_morph"))


def entity_features(entities: DataFrame, words: DataFrame) -> DataFrame:
    """NE feature (category:text) of base phrases: that of the last word of each entity; a later one overwrites.

    entities: doc_id, sent_idx, category, start, end (words of the sentence).
    """
    w = words.select(*WORD, "morph_idx", "surf", "bp_idx")
    inside = entities.join(w, WORD).where((F.col("morph_idx") >= F.col("start")) & (F.col("morph_idx") < F.col("end")))
    each = inside.groupBy(*WORD, "category", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("morph_idx", "surf"))), lambda x: x["surf"]), "").alias("text"), F.max_by("bp_idx", "morph_idx").alias("bp_idx"))
    return each.groupBy(*WORD, "bp_idx").agg(F.max_by(F.concat_ws(":", "category", "text"), "start").alias("NE"))


def base_phrase_features(phrases: DataFrame, scores: str = "bp_features") -> DataFrame:
    """features of base phrases (doc_id, sent_idx, bp_idx, phrase_idx, scores of their head).

    A feature counts from 0.5; of one key's values the last label. The clause boundaries of a phrase's base phrases go to its
    last one, again the last label; the last phrase always ends a clause. One base phrase a clause is its head, the first of
    the best. Gives features (map) and clause.
    """
    labels = F.lit(list(vocab.BASE_PHRASE_FEATURES))
    is_boundary = lambda i: F.startswith(F.element_at(labels, i + 1), F.lit("節-区切"))
    entry = lambda label: F.struct(F.substring_index(label, ":", 1).alias("key"), F.when(F.contains(label, F.lit(":")), F.substring(label, F.locate(":", label) + 1, F.length(label))).alias("value"))
    head_at = vocab.BASE_PHRASE_FEATURES.index("節-主辞")
    # places of the features that count: what windows carry is these, not scores or labels
    counted = F.filter(F.transform(scores, lambda p, i: F.when((p >= 0.5) & (i != head_at), i)), lambda i: i.isNotNull())
    own = phrases.withColumns({"_counted": counted, "_head": F.element_at(scores, head_at + 1)}).withColumn("_ended", F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.filter("_counted", is_boundary)), -1))
    by_phrase, sentence = Window.partitionBy(*WORD, "phrase_idx"), Window.partitionBy(*WORD)
    own = own.withColumn("_last_phrase", F.col("phrase_idx") == F.max("phrase_idx").over(sentence))
    own = own.withColumns({"_ended": F.max(F.when(F.col("_ended").isNotNull(), F.struct(F.col("bp_idx").alias("b"), F.col("_ended").alias("i")))).over(by_phrase)["i"], "_last_bp": F.col("bp_idx") == F.max("bp_idx").over(by_phrase)})
    ends = (F.col("_last_bp") & (F.col("_ended").isNotNull() | F.col("_last_phrase"))).cast("int")
    before = Window.partitionBy(*WORD).orderBy("bp_idx").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("clause", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("int"))
    own = own.withColumn("_is_head", F.max(F.struct(F.col("_head"), -F.col("bp_idx"))).over(Window.partitionBy(*WORD, "clause")) == F.struct(F.col("_head"), -F.col("bp_idx")))
    # later labels overwrite earlier ones of their key
    key = lambda label: F.substring_index(label, ":", 1)
    plain = F.transform(F.filter("_counted", lambda i: ~is_boundary(i)), lambda i: F.element_at(labels, i + 1))
    kept = let(lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: key(o) == key(x))), plain)
    boundary = F.when(F.col("_ended").isNull(), "節-区切").otherwise(F.element_at(labels, F.coalesce(F.col("_ended"), F.lit(0)) + 1))
    entries = F.concat(F.transform(kept, entry), F.when(ends == 1, F.array(entry(boundary))).otherwise(F.slice(F.array(entry(boundary)), 1, 0)), F.when(F.col("_is_head"), F.array(entry(F.lit("節-主辞")))).otherwise(F.slice(F.array(entry(F.lit("節-主辞"))), 1, 0)))
    return own.withColumn("features", F.map_from_entries(entries)).drop("_counted", "_head", "_ended", "_last_bp", "_last_phrase", "_is_head")


TREE = "array<struct<bp_idx:int,parent_idx:int,dep_type:string,phrase_idx:int,phrase_parent_idx:int,phrase_dep_type:string>>"


@arrow(TREE)
def _trees(sentences: pd.Series) -> pd.Series:
    def build(units) -> list[dict]:
        tree = build_tree([[(int(h["head"]), h["dep_type"]) for h in u["heads"]] for u in units])
        phrase_of = [int(u["phrase_idx"]) for u in units]
        phrases = phrase_heads(tree, phrase_of)
        out = []
        for u, arc, p in zip(units, tree, phrase_of, strict=True):
            up = phrases.get(p)
            out.append({"bp_idx": u["bp_idx"], "parent_idx": arc.head, "dep_type": arc.kind, "phrase_idx": p, "phrase_parent_idx": up and up.head, "phrase_dep_type": up and up.kind})
        return out

    return sentences.map(build, na_action="ignore")


def dependency_trees(candidates: DataFrame) -> DataFrame:
    """Trees of base phrases (doc_id, sent_idx, bp_idx, phrase_idx, heads: array of structs head and dep_type, best first).

    Heads are base phrases of the sentence, -1 the root; the phrases' heads follow. A sentence's candidates are brought
    together as one row, so that a batch holds many sentences.
    """
    units = F.struct(F.col("bp_idx").cast("int").alias("bp_idx"), F.col("phrase_idx").cast("int").alias("phrase_idx"), "heads")
    sentences = candidates.groupBy(*WORD).agg(F.array_sort(F.collect_list(units), lambda a, b: a["bp_idx"] - b["bp_idx"]).alias("units"))
    return sentences.select(*WORD, F.inline(_trees("units")))


@arrow("boolean")
def cyclic(heads: pd.Series) -> pd.Series:
    """Whether an array of heads (-1 is the root) has a cycle."""
    return heads.map(lambda h: has_cycle({k: int(x) for k, x in enumerate(h)}), na_action="ignore")


def head_candidates(words: DataFrame, unit: str = "morph_idx") -> DataFrame:
    """Pairs src, tgt of different words of a sentence, and each word with the root (-1). Linear in the square of sentences' lengths."""
    a = words.select(*WORD, F.col(unit).alias("src"))
    pairs = a.join(words.select(*WORD, F.col(unit).alias("tgt")), WORD).where("src != tgt")
    return pairs.unionByName(a.withColumn("tgt", F.lit(-1).cast(a.schema["src"].dataType)))


def antecedent_candidates(phrases: DataFrame, rule: Column | None = None, target: Column | None = None) -> DataFrame:
    """Pairs src, tgt of base phrases (doc_id, global_idx): what precedes, unless another rule over src and tgt is given.

    target says of which base phrases antecedents are sought (over the columns of phrases). The pairs are those within a
    document, so its number of base phrases bounds them; windows bound that.
    """
    own = phrases.where(target) if target is not None else phrases
    src = own.select("doc_id", F.col("global_idx").alias("src"))
    return src.join(phrases.select("doc_id", F.col("global_idx").alias("tgt")), "doc_id").where(rule if rule is not None else F.expr("tgt < src"))


def clause_pairs(clauses: DataFrame, key: str = "doc_id", clause: str = "clause") -> DataFrame:
    """Pairs modifier, head of the clauses of a document, each with itself too."""
    a = clauses.select(key, F.col(clause).alias("modifier"))
    return a.join(clauses.select(key, F.col(clause).alias("head")), key)


def relations(candidates: DataFrame, allowed: tuple[str, ...] = vocab.EXOPHORA) -> DataFrame:
    """One relation a base phrase and type: the best of its candidates, base phrases before special tokens, earlier ones first.

    candidates: doc_id, src, rel, tgt_ord (place among the candidates), logit, and either bp_idx, sid, target of a base
    phrase or token of a special token. A special token makes a relation only if it is an allowed referent.
    """
    best = F.max_by(F.struct("bp_idx", "sid", "target", "token"), F.struct("logit", -F.col("tgt_ord")))
    rows = candidates.groupBy("doc_id", "src", "rel").agg(best.alias("b"))
    stripped = F.regexp_replace("b.token", r"^\[|\]$", "")
    kept = rows.where(F.col("b.token").isNull() | stripped.isin(*allowed))
    return kept.select("doc_id", "src", F.col("rel").alias("type"), F.coalesce(F.col("b.target"), stripped).alias("target"), F.col("b.sid").alias("sid"), F.col("b.bp_idx").alias("bp_idx"), F.lit(None).cast("string").alias("mode"))


def discourse_features(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Feature of each modifying clause: sid/base phrase/relation of its heads, joined in order; no relation is left out.

    pairs: key, modifier, head, relation, head_sid, head_bp_idx.
    """
    own = pairs.where(F.col("relation") != vocab.NO_DISCOURSE)
    text = F.concat_ws("/", "head_sid", F.col("head_bp_idx").cast("string"), "relation")
    return own.groupBy(key, "modifier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", text.alias("t")))), lambda x: x["t"]), ";").alias("discourse"))


def argument_tags(edges: DataFrame, none: str = "[NULL]") -> DataFrame:
    """tags of each (doc_id, src, rel): base phrase numbers, [referent] without its number for exophora, else the tag for none.

    edges: doc_id, src, rel, ord, tgt (null for exophora), referent; a row with neither stands for no argument.
    """
    bare = F.concat(F.lit("["), F.regexp_replace("referent", "[0-9０-９]+$", ""), F.lit("]"))
    tag = F.coalesce(F.col("tgt").cast("string"), F.when(F.col("referent").isNotNull(), bare))
    rows = edges.groupBy("doc_id", "src", "rel").agg(F.array_sort(F.collect_list(F.when(tag.isNotNull(), F.struct("ord", tag.alias("t"))))).alias("r"))
    return rows.select("doc_id", "src", "rel", F.when(F.size("r") == 0, F.array(F.lit(none))).otherwise(F.transform("r", lambda x: x["t"])).alias("tags"))


def special_indices(base: Column | int, level: str = "cohesion", tokens: tuple[str, ...] = vocab.SPECIAL_TOKENS) -> Column:
    """Places of the special tokens after base of the units; the root isn't one for cohesion."""
    own = [t for t in tokens if level != "cohesion" or t != "[ROOT]"]
    base = F.lit(base) if isinstance(base, int) else base
    return F.create_map(*[x for k, t in enumerate(own) for x in (F.lit(t), (base + k).cast("int"))])


def refreshed_features(features: Column | str, kept: tuple[str, ...] = vocab.BASE_PHRASE_FEATURES) -> Column:
    """A map of features with those that are maintained: labels of the list, and NE unless it is optional."""
    f = F.col(features) if isinstance(features, str) else features
    labels = F.lit(list(kept))

    def stays(k: Column, v: Column) -> Column:
        label = F.when(v.isNull() | F.rlike(k, F.lit(vocab.IGNORED_VALUE)), k).otherwise(F.concat(k, F.lit(":"), v))
        return ((k == "NE") & ~F.coalesce(F.startswith(v, F.lit("OPTIONAL")), F.lit(True))) | F.array_contains(labels, label)

    return F.map_filter(f, stays)


def outer_entities(entities: DataFrame, key: str = "sid") -> DataFrame:
    """Entities (key, start, end) without those that overlap a longer one."""
    b = entities.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    longer = (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")) & (F.col("end") - F.col("start") < F.col("_e") - F.col("_s"))
    return entities.join(b, longer, "left_anti")


def fall_back(words: DataFrame) -> DataFrame:
    """Words with unsupported inflections and parts of speech exchanged; the old names stay as *_given."""
    names = ("pos", "subpos", "conjtype", "conjform")

    def table(pairs: dict) -> Column:
        return F.create_map(*[x for (a, b), (c, d) in pairs.items() for x in (F.lit(f"{a}\t{b}"), F.struct(F.lit(c).alias("a"), F.lit(d).alias("b")))])

    conj = F.try_element_at(table(vocab.CONJUGATION_FALLBACK), F.concat_ws("\t", "conjtype", "conjform"))
    pos = F.try_element_at(table(vocab.POS_FALLBACK), F.concat_ws("\t", "pos", "subpos"))
    given = words.withColumns({f"{n}_given": F.col(n) for n in names})
    return given.withColumns({"conjtype": F.coalesce(conj["a"], "conjtype"), "conjform": F.coalesce(conj["b"], "conjform"), "pos": F.coalesce(pos["a"], "pos"), "subpos": F.coalesce(pos["b"], "subpos")})


def restore(words: DataFrame) -> DataFrame:
    """The names that fall_back() exchanged."""
    names = ("pos", "subpos", "conjtype", "conjform")
    return words.withColumns({n: F.col(f"{n}_given") for n in names}).drop(*[f"{n}_given" for n in names])


def encoded(labels: Column | str, length: int, classes: Column | str | None = None) -> Column:
    """Labels of a sequence behind one special token, filled up to length with the ignored index; names become ids by classes."""
    own = F.col(labels) if isinstance(labels, str) else labels
    ids = own if classes is None else F.transform(own, lambda x: F.array_position(F.col(classes) if isinstance(classes, str) else classes, x).cast("int") - 1)
    ignored = F.lit(vocab.IGNORE_INDEX)
    return F.slice(F.concat(F.array(ignored), F.transform(ids, lambda x: F.coalesce(x, ignored)), F.array_repeat(ignored, length)), 1, length)


def linearize(morphemes: Column | str) -> tuple[Column, Column]:
    """Source and target texts of the sequence-to-sequence stage for an array of structs surf, reading, lemma, canon."""
    from tsumugi.functions.text import clean_canon, clean_reading, rare_to_special

    m = F.col(morphemes) if isinstance(morphemes, str) else morphemes
    source = rare_to_special(F.array_join(F.transform(m, lambda x: x["surf"]), vocab.DELIMITER))
    space = lambda c: F.when(c == " ", F.lit(vocab.HALF_SPACE)).otherwise(c)

    def one(x: Column) -> Column:
        blank = x["surf"] == " "
        half = F.lit(vocab.HALF_SPACE)
        canon = F.coalesce(clean_canon(x["canon"]), F.lit(vocab.NO_CANON))
        return F.concat(
            F.lit(vocab.SURF), F.when(blank, half).otherwise(x["surf"]), F.lit(vocab.READING), F.when(blank, half).otherwise(space(clean_reading(x["reading"]))),
            F.lit(vocab.LEMMA), F.when(blank, half).otherwise(x["lemma"]), F.lit(vocab.CANON), F.when(blank, F.lit("/")).otherwise(canon),
        )

    return source, rare_to_special(F.array_join(F.transform(m, one), ""), spaces=False)


def parse_linear(text: Column | str) -> Column:
    """Morphemes (surf, reading, lemma, canon) of a generated text; a malformed one is "@" in all and has no canonical form."""
    from tsumugi.functions.text import special_to_rare

    c = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(c, vocab.SURF), lambda p: p != "")
    pattern = f"^(.*?){vocab.READING}(.*?){vocab.LEMMA}(.*?){vocab.CANON}([^<]*(?:<(?!extra_id_[0-3]>)[^<]*)*).*$"

    def one(p: Column) -> Column:
        good = F.rlike(p, F.lit("(?s)" + pattern))
        part = lambda k: special_to_rare(F.regexp_extract(p, "(?s)" + pattern, k))
        blank = part(1) == " "
        at = F.lit("@")
        canon = F.when(good & blank, F.lit("\\␣/\\␣")).when(good & (part(4) != vocab.NO_CANON), part(4))
        return F.struct(
            F.when(good, part(1)).otherwise(at).alias("surf"), F.when(good & blank, F.lit(" ")).when(good, part(2)).otherwise(at).alias("reading"),
            F.when(good & blank, F.lit(" ")).when(good, part(3)).otherwise(at).alias("lemma"), canon.alias("canon"),
        )

    return F.transform(parts, one)


def collate(batches: Iterator[pd.DataFrame], arrays: dict[str, object], size: int) -> Iterator[dict[str, list]]:
    """Batches of at most size rows for a predictor, each array filled up to the longest of its batch. arrays: name -> filler."""
    for frame in batches:
        for start in range(0, len(frame), size):
            part = frame.iloc[start : start + size]
            out = {c: part[c].tolist() for c in part.columns if c not in arrays}
            for name, filler in arrays.items():
                rows = [list(x) for x in part[name]]
                most = max(map(len, rows), default=0)
                out[name] = [r + [filler] * (most - len(r)) for r in rows]
            yield out
