"""The analysis pipeline: tasks in order, predictors as plug-ins, one lazy plan for all stages.

No models are shipped. A stage whose predictor isn't registered raises an error that names it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tsumugi import vocab
from tsumugi.functions.edits import apply_edits, tag_window, typo_tags
from tsumugi.functions.text import normalize_text
from tsumugi.kernels.places import target_words
from tsumugi.operators import predicting, structure
from tsumugi.operators.corpus import all_corpora
from tsumugi.operators.segment import assign_doc_ids, eligible, unknown_attributes, unknown_morphemes
from tsumugi.plans import word_stage
from tsumugi.sources.shared import kept
from tsumugi.sources import sinks
from tsumugi.sources.splits import read_raw_splits
from tsumugi.sources.text import annotated, from_text, read_annotated

log = logging.getLogger(__name__)
TASKS = ("typo", "char", "seq2seq", "word")
#: Names of input formats: plain text, morpheme lines, and those with phrases (fixed values).
FORMATS = ("raw", "jumanpp", "knp")
Predictor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
BatchPredictor = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Bytes of examples, as Arrow has them, that become Python objects at a time.
FRAME_BYTES = 1 << 19
WINDOW = ["doc_id", "win_idx"]


def parse_tasks(text: str) -> list[str]:
    """Tasks of a comma-separated list, in their order. Unknown tasks, and none at all, are errors."""
    given = [t for t in text.split(",") if t]
    rest = list(given)
    own = [t for t in TASKS if t in given]
    for t in own:
        rest.remove(t)
    if rest:
        raise ValueError(f"invalid tasks: {', '.join(map(repr, rest))}")
    if not own:
        raise ValueError("a task must be specified")
    return own


def check_tasks(tasks: list[str], kind: str) -> list[str]:
    """Warnings on how an annotated input will be read. A combination that can't run is an error.

    seq2seq and word need words: they come first only for an annotated input. What typo gives is raw text, so only char
    can follow it.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if tasks[0] in ("seq2seq", "word") and kind == "raw":
        raise ValueError(f"{tasks[0]} can't be the first task for raw text")
    if tasks[0] == "typo" and len(tasks) > 1 and tasks[1] != "char":
        raise ValueError(f"{tasks[1]} can't follow typo")
    if kind == "raw":
        return []
    return [f"input in {kind} is treated as raw text" if tasks[0] in ("typo", "char") else f"input in {kind} is treated as a word sequence"]


@dataclass
class Registry:
    """Predictors by stage: what they need, run on frames of about FRAME_BYTES, and the columns that they add.

    on_batches: stages whose predictor takes and gives Arrow record batches instead of pandas frames, so that no word becomes a Python object.
    """

    own: dict[str, tuple[Predictor | BatchPredictor, str]] = field(default_factory=dict)
    on_batches: set[str] = field(default_factory=set)

    def register(self, stage: str, predictor: Predictor | BatchPredictor, schema: str, on_batches: bool = False) -> None:
        if stage not in TASKS:
            raise ValueError(f"unknown stage {stage!r}")
        self.own[stage] = (predictor, schema)
        (self.on_batches.add if on_batches else self.on_batches.discard)(stage)

    def _of(self, stage: str) -> tuple[BatchPredictor, str]:
        if stage not in self.own:
            raise LookupError(f"no predictor is registered for the stage {stage!r}")
        predictor, schema = self.own[stage]
        return (predictor if stage in self.on_batches else _on_batches(predictor, to_arrow_schema(StructType.fromDDL(schema)))), schema

    def predict(self, stage: str, examples: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """What the stage's predictor gives for the examples. carried: columns of theirs that it doesn't see and that go beside its rows, by WINDOW."""
        predictor, schema = self._of(stage)
        kind = StructType(StructType.fromDDL(schema).fields + [examples.schema[c] for c in carried])
        return examples.mapInArrow(_carrying(predictor, to_arrow_schema(kind), list(carried)), kind)

    def predict_in_place(self, stage: str, windows: DataFrame) -> DataFrame:
        """What the stage's predictor gives for windows (with PLACES), as predicting.in_place() has it: a row a target word.

        What was predicted for words that are context only doesn't leave the worker.
        """
        predictor, schema = self._of(stage)
        given = StructType.fromDDL(schema)
        beside = to_arrow_schema(StructType(given.fields + [windows.schema[c] for c in predicting.PLACES]))
        kind = StructType([given["doc_id"], StructField("word_idx", IntegerType()), *given["words"].dataType.elementType.fields])
        own = to_arrow_schema(kind)
        carrying = _carrying(predictor, beside, list(predicting.PLACES))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in carrying(batches):
                doc, word_idx, fields = target_words(b.column("doc_id"), b.column("words"), {c: b.column(c) for c in predicting.PLACES})
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([doc, word_idx, *fields.values()], own, strict=True)], schema=own)

        return windows.mapInArrow(run, kind)


def _on_batches(predictor: Predictor, schema: pa.Schema) -> BatchPredictor:
    """A predictor of pandas frames as one of Arrow record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in predictor(b.to_pandas() for b in batches):
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    return run


def _carrying(predictor: BatchPredictor, schema: pa.Schema, carried: list[str]) -> BatchPredictor:
    """The predictor on pieces of about FRAME_BYTES, without the carried columns, which are put beside what it gives.

    Examples of equal WINDOW (documents of one id) must be answered in their order.
    """

    def rows(b: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
        return zip(*[b.column(c).to_pylist() for c in columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[tuple]] = {}  # what is carried for examples that have no prediction yet

        def pieces() -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = max(1, b.num_rows * FRAME_BYTES // max(1, b.nbytes))
                for k in range(0, b.num_rows, n):
                    piece = b.slice(k, n)
                    if carried:
                        for w, values in zip(rows(piece, WINDOW), rows(piece, carried), strict=True):
                            waiting.setdefault(w, []).append(values)
                    yield piece.select([c for c in piece.schema.names if c not in carried])

        for out in predictor(pieces()):
            own = []
            for w in rows(out, WINDOW) if carried else ():
                own.append(waiting[w].pop(0))
                if not waiting[w]:
                    del waiting[w]
            beside = {c: pa.array([x[i] for x in own], schema.field(c).type) for i, c in enumerate(carried)}
            yield pa.RecordBatch.from_arrays([beside[f.name] if f.name in beside else out.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


@dataclass
class Pipeline:
    """The stages. dictionary: what the word stage looks up.

    max_length: tokens that the char and word stages' predictors take, special ones included. stride: how many sentences further
    each window of the word stage ends (-1: windows don't overlap). word_length: a word's number of tokens, by default its code
    points. rejected: what the last run's char and word stages had to leave out, by stage.
    """

    registry: Registry
    max_typo_length: int = 256
    typo_threshold: float = 0.0
    dictionary: word_stage.Dictionary | None = None
    max_length: int = 512
    stride: int = 2
    word_length: Column | None = None
    rejected: dict[str, DataFrame] = field(default_factory=dict)

    def typo(self, docs: DataFrame) -> DataFrame:
        """docs with corrected texts. Texts that the stage can't take stay as they are, in their places.

        The predictor gets example_id (doc_id) and pre_text and gives example_id and tokens and probabilities for keep and
        insert tags, a special token first.
        """
        marked = docs.withColumn("eligible", eligible("text", F.length("text"), self.max_typo_length))
        found = self.registry.predict("typo", marked.where("eligible").select(F.col("doc_id").alias("example_id"), F.col("text").alias("pre_text")))
        own = marked.join(found.withColumnRenamed("example_id", "doc_id"), "doc_id", "left")
        keep = tag_window(typo_tags("kdr_predictions", "kdr_probabilities", self.typo_threshold, "R"), F.length("text"))
        insert = tag_window(typo_tags("ins_predictions", "ins_probabilities", self.typo_threshold, "I"), F.length("text"), 1)
        return own.withColumn("text", F.when(F.col("kdr_predictions").isNotNull(), apply_edits("text", keep, insert)).otherwise(F.col("text"))).select(docs.columns)

    def char(self, docs: DataFrame) -> DataFrame:
        """Morphemes (doc_id, sent_idx, morph_idx, sid and their columns) by predicted tags.

        Texts are cut into windows of whole (tentative) sentences that the predictor can take. It gets example_id (window_id) and
        text and gives example_id and sent_tags, word_tags and norm_ops, one a character. Sentences too long for it are left out.
        """
        fitting, self.rejected["char"] = predicting.text_windows(docs, self.max_length - 2)
        windows = kept(fitting.select(*[c for c in ("doc_id", "doc_ord") if c in docs.columns], "win_idx", "window_id", "text"))
        found = self.registry.predict("char", windows.select(F.col("window_id").alias("example_id"), "text")).withColumnRenamed("example_id", "window_id")
        return unknown_morphemes(predicting.words_of_windows(windows.join(found, "window_id")))

    def seq2seq(self, words: DataFrame) -> DataFrame:
        """Words with the readings, lemmas and canonical forms of generated texts; sentences without any words are left out.

        The predictor gets doc_id, sent_idx and source (the words' linear form) and gives doc_id, sent_idx and target.
        """
        own = words if "canon" in words.columns else words.withColumn("canon", F.lit(None).cast("string"))
        m = F.struct("morph_idx", F.struct("surf", "reading", "lemma", "canon").alias("m"))
        carried = [c for c in ("sid", "comment", "doc_ord") if c in own.columns]
        others = [F.first(c).alias(c) for c in carried]
        sentences = own.groupBy("doc_id", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(m), lambda a, b: a["morph_idx"] - b["morph_idx"]), lambda x: x["m"]).alias("m"), *others)
        source, _ = structure.linearize("m")
        made = self.registry.predict("seq2seq", sentences.select("doc_id", "sent_idx", source.alias("source")))
        each = sentences.drop("m").join(made, ["doc_id", "sent_idx"]).select("*", F.posexplode(structure.parse_linear("target")).alias("morph_idx", "w"))
        return each.select("doc_id", "sent_idx", "morph_idx", *carried, "w.*")

    def word(self, words: DataFrame, keep: bool = False) -> DataFrame:
        """Parsed sentences of words, by predicted scores (see word_stage). keep: readings and lemmas are an earlier stage's.

        The predictor gets one row a window (doc_id, win_idx, window_id and words, an array of predicting.WINDOW_WORD) and gives doc_id,
        win_idx and words: for each word, in order, the fields of word_stage.PREDICTIONS, with places counted in the window. A
        word's prediction is that of the window whose target it is. Sentences too long for the predictor are left out.
        """
        if self.dictionary is None:
            raise LookupError("the stage 'word' needs a dictionary")
        missing = {"sid": F.concat_ws("-", "doc_id", F.col("sent_idx") + 1), "comment": F.lit(None).cast("string"), "canon": F.lit(None).cast("string")}
        named = words.withColumns({c: x for c, x in missing.items() if c not in words.columns})
        own = word_stage.with_places(named.select("doc_id", "sent_idx", "morph_idx", "sid", "comment", "surf", "reading", "lemma", "canon"))
        fitting, self.rejected["word"] = predicting.word_windows(own, self.max_length - len(vocab.SPECIAL_TOKENS) - 2, self.stride, self.word_length)
        windows = kept(fitting)
        found = self.registry.predict_in_place("word", predicting.with_targets(windows))
        sentences = word_stage.assemble(own.drop("word_idx"), found, self.dictionary, keep)
        return sentences.join(words.groupBy("doc_id").agg(F.min("doc_ord").alias("doc_ord")), "doc_id") if "doc_ord" in words.columns else sentences

    def run(self, docs: DataFrame, tasks: str, kind: str = "raw", prefix: str = "doc") -> DataFrame:
        """Documents through the tasks.

        Raw ones (ord, doc_id, text): empty ones are dropped, ids assigned, texts normalized. Annotated ones (sentences as
        read_annotated() gives them) are word sequences for seq2seq and word, and else the texts that their words make. The
        documents' order in the input (path and place in it; the ids, where there is neither) goes along as doc_ord.
        """
        own = parse_tasks(tasks)
        for warning in check_tasks(own, kind):
            log.warning(warning)
        places = [c for c in ("file_no", "path", "ord" if kind == "raw" else "sent_idx") if c in docs.columns] if "path" in docs.columns or kind == "raw" else []
        order = F.struct(*places or ["doc_id"])
        if kind != "raw":
            orders = docs.groupBy("doc_id").agg(F.min(order).alias("doc_ord"))
        if kind != "raw" and own[0] in ("seq2seq", "word"):
            rows = structure.word_table(docs).join(docs.select("doc_id", "sent_idx", "comment"), ["doc_id", "sent_idx"])
            m = F.filter("semantics.items", lambda x: x["key"] == "代表表記")
            now = rows.withColumn("canon", F.try_element_at(m, F.lit(1))["value"]).join(orders, "doc_id").select("doc_id", "doc_ord", "sent_idx", "morph_idx", "sid", "comment", "surf", "reading", "lemma", "canon")
        else:
            texts = docs.withColumn("doc_ord", order) if kind == "raw" else sinks.document_texts(docs.select("doc_id", "sent_idx", F.array_join(F.transform("morphemes", lambda x: x["surf"]), "").alias("text"))).join(orders, "doc_id")
            now = assign_doc_ids(texts.where(F.coalesce(F.col("text"), F.lit("")) != ""), prefix, ("file_no", "path", "ord") if "ord" in texts.columns else ("doc_id",)).withColumn("text", normalize_text("text"))
        for t in own:
            now = self.word(now, keep="seq2seq" in own) if t == "word" else getattr(self, t)(now)
        return now


#: Files of a command that keep the order in which they are given; more are taken in the order of their paths.
MOST_FILES = 64


def analyze(spark: SparkSession, pipeline: Pipeline, tasks: str, text: str | None = None, files: list[str] | None = None, kind: str = "raw") -> DataFrame:
    """Runs the tasks over a text or over files, raw or annotated; just one of them must be given.

    Raw files may be of any size: they are read by byte ranges. Files come one after the other as they are given (up to MOST_FILES
    of them), those of a folder by their paths.
    """
    if (text is None) == (files is None):
        raise ValueError("give a text or files")

    def read(paths: list[str]) -> DataFrame:
        return read_raw_splits(spark, paths) if kind == "raw" else read_annotated(spark, paths, glob=None, with_path=True)

    if text is not None:
        docs = from_text(spark, text) if kind == "raw" else annotated(spark.createDataFrame([("text", text)], "path string, text string"), with_path=True)
    elif 1 < len(files) <= MOST_FILES:
        docs = reduce(DataFrame.unionByName, [read([f]).withColumn("file_no", F.lit(k)) for k, f in enumerate(files)])
    else:
        docs = read(files)
    return pipeline.run(docs, tasks, kind)


def rendered(found: DataFrame, last: str) -> DataFrame:
    """doc_id, text and doc_ord: what the last task of a run gives, as it is written: raw text, morpheme lines, or analyses."""
    order = ["doc_ord"] if "doc_ord" in found.columns else []
    if last == "typo":
        return found.select("doc_id", *order, F.concat(sinks.raw_block("doc_id", "text"), F.lit("\n")).alias("text"))
    if last == "word":
        return word_stage.written(found)
    names = ("surf", "reading", "lemma", "pos", "pos_id", "subpos", "subpos_id", "conjtype", "conjtype_id", "conjform", "conjform_id")
    own = found if "pos" in found.columns else unknown_attributes(found)
    canon = F.concat(F.lit(' "代表表記:'), F.col("canon"), F.lit('"')) if "canon" in own.columns else F.lit(None).cast("string")
    line = F.concat(F.concat_ws(" ", *[F.col(n).cast("string") for n in names]), F.coalesce(canon, F.lit("")), F.lit("\n"))
    sid = F.first("sid") if "sid" in own.columns else F.concat_ws("-", "doc_id", F.col("sent_idx") + 1)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("morph_idx", line.alias("t")))), lambda x: x["t"])
    sentences = own.groupBy("doc_id", "sent_idx").agg(F.concat(F.lit("# S-ID:"), sid, F.lit("\n"), F.array_join(lines, ""), F.lit("EOS\n")).alias("text"), *[F.first(c).alias(c) for c in order])
    return sinks.document_texts(sentences, carried=order)


def over_corpora(pipeline: Pipeline, corpora: dict[str, DataFrame], tasks: str, kind: str = "knp") -> DataFrame:
    """What the tasks give for each of several (evaluation) corpora, rendered: corpus, doc_id and text. Ids needn't differ between corpora."""
    last = parse_tasks(tasks)[-1]
    return all_corpora({name: rendered(pipeline.run(docs, tasks, kind, prefix=name), last).select("doc_id", "text") for name, docs in corpora.items()})


def in_order(texts: DataFrame) -> list[str]:
    """The columns that bring a run's texts into the order of its input."""
    return ["doc_ord" if "doc_ord" in texts.columns else "doc_id"]


def write(found: DataFrame, last: str, path: str) -> None:
    """What the last task of a run gives, as text files that are in the documents' order within and across."""
    texts = rendered(found, last)
    sinks.write_text(texts.withColumn("text", F.regexp_replace("text", r"\n\z", "")), path, in_order(texts))


def raw_output(docs: DataFrame) -> DataFrame:
    """Documents as blocks of raw text, in order."""
    return docs.select("ord", sinks.raw_block("doc_id", "text").alias("value"))
