"""What predictors see, and what becomes of it: windows of whole sentences, one row each, and predictions put back in place.

A document that is longer than a predictor takes is cut into windows between sentences. Where windows overlap, a sentence is
predicted in the window whose target it is, the earliest that holds it with all the context that fits before it; the other
windows see it as context only. Places within a window become places within the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.operators.segment import length_guard, sentences_by_tags, split_sentences, split_words, words_by_tags
from tsumugi.operators.windows import document_spans, placed_spans, window_spans

#: What a predictor gets of each word of a window.
WINDOW_WORD = ("sent_idx", "morph_idx", "target", "surf", "reading", "lemma", "canon")
#: So many windows of a document are made of one copy of its words.
AT_ONCE = 16


def text_windows(docs: DataFrame, max_length: int, sentences: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows of texts (win_idx, window_id and text, beside doc_id and others), and those that are too long all the same.

    Texts are cut after tentative sentences, packed as tightly as they fit; a text that fits is one window and keeps its id. A single
    sentence of more than max_length code points is a window that no predictor can take. No shuffle: a document is one row.
    """
    own = docs.withColumn("_sentences", split_sentences("text") if sentences is None else sentences)
    lengths = F.transform("_sentences", lambda s: F.length(s))
    fits = F.length("text") <= max_length
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("_sentences").alias("end")))
    each = own.withColumn("_fits", fits).select("*", F.posexplode(F.when(fits, whole).otherwise(window_spans(max_length, -1)(lengths))).alias("win_idx", "_span"))
    n = F.col("_span.end") - F.col("_span.start")
    text = F.when(F.col("_fits"), F.col("text")).otherwise(F.array_join(F.slice("_sentences", F.col("_span.start") + 1, n), ""))
    window = F.when(F.col("_fits"), F.col("doc_id")).otherwise(F.concat("doc_id", F.lit("-s"), n.cast("string"), F.lit("i"), F.col("win_idx").cast("string")))
    cut = each.withColumns({"text": text, "window_id": window}).drop("_sentences", "_fits", "_span")
    return length_guard(cut, F.length("text"), max_length)


def words_of_windows(windows: DataFrame) -> DataFrame:
    """Words of windows (doc_id, win_idx, text, sent_tags, word_tags, norm_ops and others): sent_idx, morph_idx, sid, surf, norm.

    A window begins a sentence. Sentences are numbered on through a document's windows, and their ids {doc_id}-{n} count from 1.
    """
    others = [c for c in windows.columns if c not in ("text", "window_id", "sent_tags", "word_tags", "norm_ops")]
    cut = windows.withColumn("_sentences", sentences_by_tags("text", "sent_tags"))
    earlier = Window.partitionBy("doc_id").orderBy("win_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_before", F.coalesce(F.sum(F.size("_sentences")).over(earlier), F.lit(0)).cast("int"))
    words = placed.select(*others, "_before", F.posexplode(words_by_tags("_sentences", "word_tags", "norm_ops")).alias("_place", "_w"))
    within = F.row_number().over(Window.partitionBy("doc_id", "win_idx", "_w.sent_idx").orderBy("_place")) - 1
    sent = F.col("_before") + F.col("_w.sent_idx")
    kept = [c for c in others if c != "win_idx"]
    return words.withColumn("morph_idx", within).select(*kept, sent.alias("sent_idx"), "morph_idx", F.concat_ws("-", "doc_id", sent + 1).alias("sid"), "_w.surf", "_w.norm")


def word_windows(words: DataFrame, max_length: int, stride: int, length: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows of documents' words (doc_id, sent_idx, morph_idx, word_idx, surf and others), and those that are too long all the same.

    One row a window: doc_id, win_idx, window_id, first_word (its place in the document), doc_words (the document's number of
    words) and words, an array of WINDOW_WORD in order. length: tokens of a word, by default its code points. Sentences of more
    than max_length tokens make windows that no predictor can take. A window, not a document, is what a row holds.
    """
    tokens = words.where("doc_id is not null").withColumn("_n", F.length("surf") if length is None else length)
    named = [F.col(c) if c in words.columns else F.lit(None).cast("string").alias(c) for c in WINDOW_WORD if c != "target"]
    n_tokens = F.sum("_n").cast("int").alias("n_tokens")
    spans = document_spans(tokens.groupBy("doc_id", "sent_idx").agg(n_tokens), max_length, stride)
    own = tokens.groupBy("doc_id", "sent_idx").agg(n_tokens, F.array_sort(F.collect_list(F.struct("word_idx", *named))).alias("words"))
    docs = own.groupBy("doc_id").agg(F.sum(F.size("words")).cast("int").alias("doc_words"), F.array_sort(F.collect_list(F.struct("sent_idx", "n_tokens", "words"))).alias("_sentences"))

    def window(span: Column, k: Column) -> Column:
        place, n = F.col("_from") + k, span["end"] - span["start"]
        before = F.coalesce(F.get("spans", place - 1)["end"], F.lit(0))
        sentences = F.slice("_sentences", span["start"] + 1, n)
        word = lambda w, target: F.struct(*[target.alias(c) if c == "target" else w[c].alias(c) for c in WINDOW_WORD])
        window_id = F.when(F.col("fits"), F.col("doc_id")).otherwise(F.concat("doc_id", F.lit("-s"), (span["end"] - before).cast("string"), F.lit("i"), place.cast("string")))
        return F.struct(
            place.alias("win_idx"), window_id.alias("window_id"), F.get(F.get("_sentences", span["start"])["words"], F.lit(0))["word_idx"].alias("first_word"),
            F.aggregate(sentences, F.lit(0), lambda a, x: a + x["n_tokens"]).alias("_size"),
            F.flatten(F.transform(sentences, lambda x, j: F.transform(x["words"], lambda w: word(w, span["start"] + j >= before)))).alias("words"),
        )

    # windows are made where a document's words are, some at a time: neither they nor their words are shuffled
    dealt = docs.join(spans.hint("shuffle_hash"), "doc_id").select("*", F.explode_outer(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(AT_ONCE))).alias("_from"))
    windows = dealt.select("doc_id", "doc_words", F.inline_outer(F.transform(F.slice("spans", F.col("_from") + 1, AT_ONCE), window)))
    fitting, others = length_guard(windows, "_size", max_length)
    return fitting.drop("_size"), others.drop("_size")


def sentence_windows(docs: DataFrame, max_length: int, stride: int) -> tuple[DataFrame, DataFrame]:
    """As with_targets(word_windows()), for documents that are one row each (doc_id, sentences: an array of texts): a token is a code point, words are split_words().

    Only sentences are brought into windows, and cut into words where a window is a row: no row a word is made, sorted or grouped.
    Documents without a sentence have no window.
    """
    spans = placed_spans(max_length, stride)(F.transform("sentences", F.length), F.transform("sentences", lambda s: F.size(split_words(s))))
    held = lambda s, k: F.struct(s.alias("_span"), k.alias("win_idx"), F.slice("sentences", s["start"] + 1, s["end"] - s["start"]).alias("_own"))
    each = docs.where("doc_id is not null").select("doc_id", "sentences", spans.alias("_spans")).select("doc_id", F.inline(F.transform("_spans", held)))
    span = F.col("_span")

    def word(w: Column, sent: Column, morph: Column) -> Column:
        known = {"sent_idx": sent, "morph_idx": morph, "target": sent >= span["before"], "surf": w}
        return F.struct(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in WINDOW_WORD])

    words = F.flatten(F.transform("_own", lambda x, j: F.transform(split_words(x), lambda w, m: word(w, span["start"] + j, m))))
    window_id = F.when(span["fits"], F.col("doc_id")).otherwise(F.concat("doc_id", F.lit("-s"), (span["end"] - span["before"]).cast("string"), F.lit("i"), F.col("win_idx").cast("string")))
    fitting, others = length_guard(each, span["size"], max_length)
    return tuple(w.select("doc_id", span["doc_words"].alias("doc_words"), "win_idx", window_id.alias("window_id"), span["first_word"].alias("first_word"), words.alias("words"), *[span[c].alias(c) for c in ("n_words", "n_targets")]) for w in (fitting, others))


#: What in_place() needs of a window, beside what was predicted for it.
PLACES = ("first_word", "doc_words", "n_words", "n_targets")


def with_targets(windows: DataFrame) -> DataFrame:
    """windows with n_words and n_targets: their words, and how many of them, at the end, are targets."""
    return windows.withColumns({"n_words": F.size("words"), "n_targets": F.size(F.filter("words", lambda w: w["target"]))})


def in_document(windows: DataFrame, found: DataFrame) -> DataFrame:
    """Predictions (doc_id, win_idx, words: one for each word of the window) as rows of target words: doc_id, word_idx and the fields.

    heads and discourse count words from the window's first, cohesion too and then special tokens: these become places in the
    document. A prediction that hasn't as many words as its window is an error.
    """
    return in_place(with_targets(windows).select("doc_id", "win_idx", *PLACES).join(found, ["doc_id", "win_idx"]))


def in_place(found: DataFrame) -> DataFrame:
    """As in_document(), for predictions that have their window's PLACES beside them."""
    fields, n = found.schema["words"].dataType.elementType.names, F.col("n_words")
    wrong = F.raise_error(F.concat(F.lit("a prediction for a window of "), n.cast("string"), F.lit(" words has "), F.coalesce(F.size("words"), F.lit(0)).cast("string")))
    whole = F.when(F.coalesce(F.size("words"), F.lit(0)) == n, F.col("words")).otherwise(wrong.cast(found.schema["words"].dataType))
    each = found.select("doc_id", "first_word", "doc_words", n.alias("_n"), (n - F.col("n_targets")).alias("_context"), F.posexplode(whole).alias("_k", "_p")).where("_k >= _context")
    base = F.col("first_word")
    moved = {
        "heads": lambda c: F.transform(c, lambda h: h.withField("head", F.when(h["head"] < 0, h["head"]).otherwise(h["head"] + base))),
        "cohesion": lambda c: F.transform(c, lambda x: x.withField("tgt", x["tgt"] + F.when(x["tgt"] < F.col("_n"), base).otherwise(F.col("doc_words") - F.col("_n")))),
        "discourse": lambda c: F.transform(c, lambda x: x.withField("tgt", x["tgt"] + base)),
    }
    values = [moved.get(f, lambda c: c)(F.col(f"_p.{f}")).alias(f) for f in fields]
    return each.select("doc_id", (base + F.col("_k")).cast("int").alias("word_idx"), *values)
