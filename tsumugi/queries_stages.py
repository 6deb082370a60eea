"""Queries over whole stages, sources and streams, with their SQL: windowed prediction, byte ranges, forced decoding, dependency metrics.

As in tsumugi.queries, tags and scores are derived from the tables by plain rules; a predictor here is a stimulus, not a model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsumugi import vocab
from tsumugi.functions import edits, text
from tsumugi.kernels import conll
from tsumugi.operators import dependency, encoding, forced, lexicon, loading, predicting, segment
from tsumugi.operators.dealing import parts_for
from tsumugi.plans import pipeline
from tsumugi.queries import SENTENCES, UNITS, query, table, units
from tsumugi.sources import annotated, sinks
from tsumugi.sources import text as sources
from tsumugi.sources.dictionary import read_dictionary
from tsumugi.sources.shared import shared_folder
from tsumugi.sources.splits import read_raw_splits
from tsumugi.streaming import interactive

# --- windows

MOST, STRIDE = 300, 2


def _spans_sql(most: int, stride: int) -> str:
    """Windows (doc_id, i, a, b, last: the end of the window before) over sentences en (doc_id, sent_idx, n): each ends stride sentences after the last where it can."""
    size = "(total[c.e + 1] - total[c.s + 1])"
    score = f"(CASE WHEN {size} <= {most} THEN CASE WHEN c.e - b = {stride} THEN {most + 1} ELSE 0 END + {size} ELSE -{size} END)"
    return f"""
l AS (SELECT doc_id, list(n ORDER BY sent_idx) AS ns FROM en GROUP BY doc_id),
o AS (SELECT doc_id, len(ns) AS k, list_prepend(0, list_transform(range(1, len(ns) + 1), lambda j: CAST(list_sum(ns[1:j]) AS BIGINT))) AS total FROM l),
r(doc_id, k, total, i, a, b, last) AS (
  SELECT doc_id, k, total, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o WHERE total[k + 1] > {most}
  UNION ALL SELECT doc_id, k, total, i + 1, c.s, c.e, b FROM (
    SELECT doc_id, k, total, i, b, CASE WHEN len(good) > 0 THEN {{'s': good[1].s, 'e': CASE WHEN b > 0 THEN b + {stride} ELSE good[1].e END}}
      ELSE list_filter(cs, lambda c: {score} = list_max(list_transform(cs, lambda c: {score})))[1] END AS c
    FROM (SELECT *, list_filter(cs, lambda c: {size} <= {most} AND c.e - b >= {stride}) AS good FROM (
      SELECT *, list_transform(range(a, least(b, k - 1) + 1), lambda s: {{'s': s, 'e': greatest(b + 1, len(list_filter(total, lambda t: t <= total[s + 1] + {most})) - 1)}}) AS cs FROM r WHERE b < k)))),
spans AS (SELECT doc_id, i, a, b, last, total[b + 1] - total[a + 1] AS size FROM r WHERE i >= 0 UNION ALL SELECT doc_id, 0, 0, k, 0, total[k + 1] FROM o WHERE total[k + 1] <= {most})"""


def counting_predictor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a window: its place and the window's words; the word before as head, the window's first word and a special token as targets."""

    def lists(ends: np.ndarray, **fields: pa.Array | np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays([pa.array(f) for f in fields.values()], list(fields)))

    for b in batches:
        sizes = np.asarray(pc.list_value_length(b.column("words")), np.int32)
        ends = np.cumsum(sizes)
        n, total = np.repeat(sizes, sizes), int(sizes.sum())
        k = np.arange(total, dtype=np.int32) - np.repeat(ends - sizes, sizes).astype(np.int32)
        reading = pc.binary_join_element_wise(pa.array(k).cast(pa.string()), pa.array(n).cast(pa.string()), "/")
        each = np.arange(1, total + 1)
        heads = lists(each, head=k - 1, dep_type=pa.repeat("D", total))
        cohesion = lists(2 * each, rel=pa.repeat("ガ", 2 * total), tgt=np.column_stack([np.zeros_like(n), n + 2]).ravel(), logit=np.tile([1.0, 0.5], total))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("win_idx"), lists(ends, reading=reading, heads=heads, cohesion=cohesion)], names=["doc_id", "win_idx", "words"])


COUNTED = "doc_id string, win_idx int, words array<struct<reading:string,heads:array<struct<head:int,dep_type:string>>,cohesion:array<struct<rel:string,tgt:int,logit:double>>>>"


def _windowed_sql() -> str:
    return SENTENCES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", en AS (SELECT doc_id, sent_idx, sentence, length(sentence) AS n FROM e),
{_spans_sql(MOST, STRIDE).lstrip()},
ws AS (SELECT doc_id, sent_idx, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}]+|.') AS ws FROM en),
wn AS (SELECT *, len(ws) AS m, CAST(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY sent_idx) - len(ws) AS BIGINT) AS before, CAST(sum(len(ws)) OVER (PARTITION BY doc_id) AS BIGINT) AS total_words FROM ws),
win AS (SELECT s.doc_id, s.i, s.a, s.b, s.last, min(w.before) AS first_word, CAST(sum(w.m) AS BIGINT) AS n FROM spans s JOIN wn w ON w.doc_id = s.doc_id AND w.sent_idx >= s.a AND w.sent_idx < s.b WHERE s.size <= {MOST} GROUP BY ALL),
tw AS (SELECT v.doc_id, v.first_word, v.n, w.total_words, unnest(range(w.before, w.before + w.m)) AS word_idx FROM win v JOIN wn w ON w.doc_id = v.doc_id AND w.sent_idx >= v.last AND w.sent_idx < v.b)
SELECT doc_id, CAST(word_idx AS INT) AS word_idx, (word_idx - first_word) || '/' || n AS seen, CAST(CASE WHEN word_idx = first_word THEN -1 ELSE word_idx - 1 END AS INT) AS head, CAST(first_word AS INT) AS target, CAST(total_words + 2 AS INT) AS token FROM tw"""


@query(_windowed_sql())
def windowed_predictions(spark, sf_dir):
    """Long documents through a predictor that gets whole windows, and its predictions back in the documents' places."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # texts are dealt out, so that words and windows needn't be
    windows, _ = predicting.sentence_windows(docs.select("doc_id", segment.split_sentences(text.normalize_text("text")).alias("sentences")), MOST, STRIDE)
    registry = pipeline.Registry()
    registry.register("word", counting_predictor, COUNTED, on_batches=True)
    found = registry.predict_in_place("word", windows)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "word_idx", F.col("reading").alias("seen"), F.col("heads")[0]["head"].alias("head"), F.col("cohesion")[0]["tgt"].alias("target"), F.col("cohesion")[1]["tgt"].alias("token"))


# --- sources


@query("SELECT 'd' || doc_id AS doc_id, regexp_replace(text, '[\\s]+$', '') AS text FROM documents WHERE text IS NOT NULL")
def raw_documents_by_ranges(spark, sf_dir):
    """Documents that were written as raw text and are read again by byte ranges of the files."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    folder = shared_folder(spark)
    docs.select(sinks.raw_block(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text").alias("value")).write.text(folder)
    return read_raw_splits(spark, folder).select("doc_id", "text")


@query("SELECT 'p' || p_partkey AS doc_id, 'p' || p_partkey || '-' || p_size AS sid, 'size ' || p_size AS comment, replace(p_name, ' ', '_') AS surf, replace(p_brand, ' ', '_') AS reading, replace(p_type, ' ', '_') AS lemma FROM part")
def annotated_source(spark, sf_dir):
    """Files of morpheme lines through the data source: ids and comments by a schema without words, words by the whole one."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    size = F.col("p_size").cast("string")
    block = F.concat(F.lit("# S-ID:p"), F.col("p_partkey").cast("string"), F.lit("-"), size, F.lit(" size "), size, F.lit("\n"), F.concat_ws(" ", bare("p_name"), bare("p_brand"), bare("p_type"), F.lit("名詞 6 普通名詞 1 * 0 * 0 NIL")), F.lit("\nEOS"))
    folder = shared_folder(spark)
    table(spark, sf_dir, "part").select(block.alias("value")).write.text(folder)
    annotated.register(spark)
    read = spark.read.format("annotated_text").option("glob", "*.txt")
    ids = read.schema("doc_id string, sid string, comment string").load(folder)
    words = spark.read.format("annotated_text").option("glob", "*.txt").load(folder).select("sid", F.explode("morphemes").alias("m"))
    return ids.join(words, "sid").select("doc_id", "sid", "comment", "m.surf", "m.reading", "m.lemma")


# --- dependency trees


UPOS = ("NOUN", "VERB", "ADP")
RELATIONS = ("nsubj", "obj", "case", "aux", "det:x", "root")


def _pick(values: tuple[str, ...], place: str) -> str:
    return f"CASE {place} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: Gold: a word a line of an order, in sentences of three lines. System: every third word is cut in two, and some attributes differ.
GOLD_SQL = f"""
{UNITS},
p AS (SELECT *, CASE WHEN i <= 3 THEN 0 ELSE 1 END AS sent_idx FROM u),
g0 AS (SELECT k, sent_idx, row_number() OVER w - 1 AS word_idx, 'w' || q || f AS form, CASE WHEN t % 4 = 0 THEN '_' ELSE 'l' || q % 5 END AS lemma, {_pick(UPOS, 'q % 3')} AS upos, s AS xpos, CASE WHEN d % 2 = 1 THEN 'Case=Nom' ELSE '' END AS feats,
         {_pick(RELATIONS, 'q % 6')} AS deprel, t, row_number() OVER (PARTITION BY k, sent_idx ORDER BY i) - 1 AS pos FROM p WINDOW w AS (PARTITION BY k ORDER BY i)),
g1 AS (SELECT *, CASE WHEN pos = 0 THEN -1 WHEN t % 2 = 0 THEN word_idx - 1 ELSE word_idx - pos END AS head FROM g0),
s0 AS (SELECT p.*, unnest(CASE WHEN d % 3 = 0 THEN [0, 1] ELSE [2] END) AS half FROM p),
s1 AS (SELECT k, sent_idx, row_number() OVER (PARTITION BY k ORDER BY i, half) - 1 AS word_idx, CASE half WHEN 0 THEN 'w' WHEN 1 THEN q || f ELSE 'w' || q || f END AS form, CASE WHEN t = 1 THEN 'x' ELSE 'l' || q % 5 END AS lemma, CASE WHEN d = 5 THEN 'VERB' ELSE {_pick(UPOS, 'q % 3')} END AS upos,
         s AS xpos, CASE WHEN d % 2 = 1 AND t <> 3 THEN 'Case=Nom' ELSE '' END AS feats, CASE WHEN half = 1 THEN 'aux' ELSE {_pick(RELATIONS, 'q % 6')} END AS deprel, row_number() OVER (PARTITION BY k, sent_idx ORDER BY i, half) - 1 AS pos FROM s0),
s2 AS (SELECT *, CASE WHEN pos = 0 THEN -1 ELSE word_idx - 1 END AS head FROM s1)"""


def _sides_sql() -> str:
    content, functional = (", ".join(f"'{x}'" for x in sorted(names)) for names in (conll.CONTENT_DEPRELS, conll.FUNCTIONAL_DEPRELS))
    side = lambda of: f"SELECT k, sent_idx, word_idx, form, lemma, upos, xpos, feats, split_part(deprel, ':', 1) AS deprel, head, sum(length(form)) OVER w - length(form) AS a, sum(length(form)) OVER w AS b FROM {of} WINDOW w AS (PARTITION BY k ORDER BY word_idx)"
    child = lambda of, key: f"SELECT k, head AS word_idx, list({{'o': {key}, 'd': deprel, 'u': upos, 'f': feats}} ORDER BY word_idx) AS c FROM {of} WHERE head >= 0 AND deprel IN ({functional}) GROUP BY ALL"
    units_of = lambda words, sentences, content_: f"CASE WHEN m = 'Sentences' THEN {sentences} WHEN m IN ('CLAS', 'MLAS', 'BLEX') THEN {content_} ELSE {words} END"
    same = "(g.lemma = '_' OR g.lemma = s.lemma)"
    labelled = "att AND g_deprel = s_deprel"
    rights = {"Words": "true", "UPOS": "upos", "XPOS": "xpos", "UFeats": "feats", "AllTags": "upos AND xpos AND feats", "Lemmas": "lemma", "UAS": "att", "LAS": labelled, "CLAS": f"con AND {labelled}", "MLAS": f"con AND {labelled} AND upos AND feats AND kids", "BLEX": f"con AND {labelled} AND lemma"}
    sent = lambda of: f"(SELECT k, sent_idx, min(a) AS a, max(b) AS b FROM {of} GROUP BY ALL)"
    rows = " UNION ALL ".join([f"SELECT '{m}' AS m, count(*) FILTER ({c}) AS r FROM e" for m, c in rights.items()] + ["SELECT 'Tokens', count(*) FROM pr", f"SELECT 'Sentences', count(*) FROM {sent('g')} x JOIN {sent('s')} y USING (k, a, b)"])
    return f"""WITH {GOLD_SQL.lstrip()},
g AS ({side('g1')}), s AS ({side('s2')}),
pr AS (SELECT g.k, g.word_idx AS gi, s.word_idx AS si FROM g JOIN s USING (k, a, b)),
sa AS (SELECT s.*, coalesce(pr.gi, -2) AS gi FROM s LEFT JOIN pr ON pr.k = s.k AND pr.si = s.word_idx),
gc AS ({child('g', 'word_idx')}), sc AS ({child('sa', 'gi')}),
e AS (SELECT g.upos = s.upos AS upos, g.xpos = s.xpos AS xpos, g.feats = s.feats AS feats, {same} AS lemma, CASE WHEN s.head < 0 THEN g.head < 0 ELSE coalesce(h.gi = g.head, false) END AS att, g.deprel AS g_deprel, s.deprel AS s_deprel, g.deprel IN ({content}) AS con, gc.c IS NOT DISTINCT FROM sc.c AS kids
      FROM pr JOIN g ON g.k = pr.k AND g.word_idx = pr.gi JOIN s ON s.k = pr.k AND s.word_idx = pr.si LEFT JOIN pr h ON h.k = s.k AND h.si = s.head
      LEFT JOIN gc ON gc.k = g.k AND gc.word_idx = g.word_idx LEFT JOIN sc ON sc.k = s.k AND sc.word_idx = s.word_idx),
n AS (SELECT (SELECT count(*) FROM g) AS gw, (SELECT count(*) FROM s) AS sw, (SELECT count(*) FROM g WHERE deprel IN ({content})) AS gc, (SELECT count(*) FROM s WHERE deprel IN ({content})) AS sc, (SELECT count(DISTINCT (k, sent_idx)) FROM g) AS gs, (SELECT count(DISTINCT (k, sent_idx)) FROM s) AS ss)
SELECT m AS metric, {units_of('gw', 'gs', 'gc')} AS gold, {units_of('sw', 'ss', 'sc')} AS system, r AS "right", CAST(0 AS BIGINT) AS n_failed FROM ({rows}), n"""


def dependency_sides(spark, sf_dir):
    """The gold and the system words of GOLD_SQL, as tables."""
    pick = lambda values, c: F.element_at(F.lit(list(values)), c + 1)
    own = units(spark, sf_dir).withColumn("sent_idx", F.when(F.col("i") <= 3, 0).otherwise(1))
    in_order, in_sentence = Window.partitionBy("k").orderBy("i", "half"), Window.partitionBy("k", "sent_idx").orderBy("i", "half")
    word = F.concat(F.lit("w"), F.col("q").cast("string"), "f")
    placed = lambda rows: rows.withColumns({"word_idx": (F.row_number().over(in_order) - 1).cast("int"), "at": F.row_number().over(in_sentence) - 1})
    lemma, feats = F.concat(F.lit("l"), (F.col("q") % 5).cast("string")), F.when(F.col("d") % 2 == 1, "Case=Nom").otherwise("")
    gold = placed(own.withColumn("half", F.lit(2))).withColumns({"form": word, "lemma": F.when(F.col("t") % 4 == 0, "_").otherwise(lemma), "upos": pick(UPOS, F.col("q") % 3), "xpos": F.col("s"), "feats": feats, "deprel": pick(RELATIONS, F.col("q") % 6)})
    gold = gold.withColumn("head", F.when(F.col("at") == 0, -1).when(F.col("t") % 2 == 0, F.col("word_idx") - 1).otherwise(F.col("word_idx") - F.col("at")).cast("int"))
    halves = own.withColumn("half", F.explode(F.when(F.col("d") % 3 == 0, F.lit([0, 1])).otherwise(F.lit([2]))))
    form = F.when(F.col("half") == 0, "w").when(F.col("half") == 1, F.concat(F.col("q").cast("string"), "f")).otherwise(word)
    system = placed(halves).withColumns({"form": form, "lemma": F.when(F.col("t") == 1, "x").otherwise(lemma), "upos": F.when(F.col("d") == 5, "VERB").otherwise(pick(UPOS, F.col("q") % 3)), "xpos": F.col("s"), "feats": F.when(F.col("t") == 3, "").otherwise(feats), "deprel": F.when(F.col("half") == 1, "aux").otherwise(pick(RELATIONS, F.col("q") % 6))})
    system = system.withColumn("head", F.when(F.col("at") == 0, -1).otherwise(F.col("word_idx") - 1).cast("int"))
    names = ("sent_idx", "word_idx", "form", "lemma", "upos", "xpos", "feats", "head", "deprel")
    return [w.select(F.col("k").alias("doc_id"), *names) for w in (gold, system)]


@query(_sides_sql())
def dependency_metrics(spark, sf_dir):
    """All 13 metrics of two sides that cut the text into different words, without Python."""
    return dependency.dependency_counts(*dependency_sides(spark, sf_dir))


@query("WITH RECURSIVE " + UNITS + """, n AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) AS id, q, count(*) OVER (PARTITION BY k) AS n FROM u), h AS (SELECT k, id, n, CASE WHEN q % 11 = 0 THEN n + 3 WHEN id = 1 AND q % 5 > 0 THEN 0 WHEN q % 7 = 0 THEN 1 + q % n ELSE id - 1 END AS head FROM n),
r(k, id) AS (SELECT k, id FROM h WHERE head = 0 UNION SELECT h.k, h.id FROM r JOIN h ON h.k = r.k AND h.head = r.id WHERE h.id <> h.head),
s AS (SELECT k, n, count(*) FILTER (head = 0) AS roots, bool_or(head > n) AS far FROM h GROUP BY k, n), c AS (SELECT k, count(*) AS seen FROM r GROUP BY k)
SELECT k, 'head' AS error FROM s WHERE far UNION ALL SELECT k, 'roots' FROM s WHERE roots <> 1 UNION ALL SELECT s.k, 'cycle' FROM s LEFT JOIN c USING (k) WHERE NOT far AND coalesce(seen, 0) < n""")
def tree_errors(spark, sf_dir):
    """Orders as trees over their lines, some of them with heads out of range, no or several roots, or cycles."""
    own = units(spark, sf_dir).select("k", "q", F.row_number().over(Window.partitionBy("k").orderBy("i")).alias("id"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    head = F.when(F.col("q") % 11 == 0, F.col("n") + 3).when((F.col("id") == 1) & (F.col("q") % 5 > 0), 0).when(F.col("q") % 7 == 0, 1 + F.col("q") % F.col("n")).otherwise(F.col("id") - 1)
    return dependency.tree_errors(own.select(F.col("k").alias("doc_id"), F.lit(0).alias("sent_idx"), "id", head.alias("head"))).select(F.col("doc_id").alias("k"), "error")


# --- streams


@query("WITH c AS (SELECT 'c' || conv_id AS doc_id, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, md5(text) AS h FROM conversations) SELECT doc_id || ' ' || doc_id || '-' || n || ' ' || h || CASE WHEN n > 1 THEN ' window 0' ELSE ' window 1' END AS line FROM c")
def appended_analyses(spark, sf_dir):
    """Conversations as analysed sentences of overlapping windows: merged by state, appended epoch by epoch, and read again."""
    out = shared_folder(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    turns = turns.repartition(max(4, parts_for(turns.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))), "conv_id")  # a document's rows arrive together
    rows = turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).cast("long").alias("ord"), F.lead(F.lit(False), 1, True).over(Window.partitionBy("conv_id").orderBy("turn")).alias("last"), "h")
    windows = rows.select("doc_id", "ord", F.concat_ws("-", "doc_id", "ord").alias("sid"), "last", "h", F.explode(F.when(F.col("ord") > 1, F.lit([2, 1, 0])).otherwise(F.lit([2, 1])).cast("array<bigint>")).alias("win_idx"))
    analysed = windows.select("doc_id", "win_idx", "ord", "sid", F.concat_ws(" ", "h", F.lit("window"), F.col("win_idx").cast("string")).alias("analysis"), "last")
    analysed.write.parquet(f"{out}/in")
    files = spark.read.schema(analysed.schema).parquet(f"{out}/in").inputFiles()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        interactive.use_rocksdb(spark)
        read = spark.readStream.schema(analysed.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // 2))).parquet(f"{out}/in")  # two epochs
        lines = interactive.merged_sentences(read).withColumn("text", F.concat_ws(" ", "doc_id", "sid", "analysis"))
        append = lambda batch, epoch: sinks.append_epoch(batch, epoch, f"{out}/out", ["doc_id", "ord"])
        lines.writeStream.foreachBatch(append).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sinks.read_epochs(spark, f"{out}/out").select("line")


# --- forced decoding


LETTERS = "abcdefghijklmnopqrstuvwxyz"
TOKENS = ("<s>", "<pad>", "</s>", vocab.SURF, vocab.READING, vocab.LEMMA, vocab.CANON, vocab.NO_CANON, vocab.DELIMITER, vocab.HALF_SPACE, *LETTERS, *("▁" + c for c in LETTERS), "an", "re", "che", "▁al", "ala", "b" * 9)


def _forced_sql() -> str:
    tokens = "[" + ", ".join(f"'{t}'" for t in TOKENS) + "]"
    ids = lambda condition: f"array_to_string(list_filter(list_transform(range({len(TOKENS)}), lambda k: CASE WHEN {condition} THEN k END), lambda k: k IS NOT NULL), ',')"
    t = f"({tokens})[k + 1]"
    out = lambda *names: f"{t} NOT IN ({', '.join(repr(n) for n in names)})"
    v = vocab
    reading = out("<pad>", "</s>", v.SURF, v.READING, v.LEMMA, v.CANON, v.NO_CANON, v.DELIMITER)
    lemma, canon = ("<pad>", "</s>", v.SURF, v.READING, v.LEMMA, v.NO_CANON, v.DELIMITER), ("<pad>", v.READING, v.LEMMA, v.CANON, v.DELIMITER)
    spelt = "string_split(x, '')"
    return f"""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1:2] AS surfs FROM part),
f AS (SELECT p_partkey, surfs, list_prepend('<s>', flatten(list_transform(surfs, lambda x: flatten([['{v.SURF}'], {spelt}, ['{v.READING}'], {spelt}, ['{v.LEMMA}'], {spelt}, ['{v.CANON}'], {spelt}])))) AS own FROM w),
c AS (SELECT p_partkey, surfs, own[1:p_partkey % len(own) + 1] AS own FROM f),
s AS (SELECT p_partkey, surfs, own, own[-1] AS last, list_filter(own, lambda x: x IN ('{v.SURF}', '{v.READING}', '{v.LEMMA}', '{v.CANON}'))[-1] AS section, len(list_filter(own, lambda x: x = '{v.READING}')) AS done,
        len(own) - list_position(list_reverse(own), '{v.SURF}') + 1 AS begun FROM c),
r AS (SELECT *, CASE WHEN section = '{v.SURF}' THEN substr(surfs[done + 1], len(own) - begun + 1) END AS rest FROM s)
SELECT p_partkey, rest, CASE WHEN len(own) = 1 THEN '3' WHEN section = '{v.SURF}' AND rest = '' THEN '4'
  WHEN section = '{v.SURF}' THEN {ids(f"starts_with(rest, replace({t}, '▁', ''))")}
  WHEN section = '{v.READING}' AND last = '{v.READING}' THEN {ids(reading)} WHEN section = '{v.READING}' THEN {ids(f"{reading} OR {t} = '{v.LEMMA}'")}
  WHEN section = '{v.LEMMA}' AND last = '{v.LEMMA}' THEN {ids(out(*lemma, v.CANON))} WHEN section = '{v.LEMMA}' THEN {ids(out(*lemma))}
  WHEN last = '{v.CANON}' THEN {ids(out(*canon, "</s>", v.SURF))} WHEN done < len(surfs) THEN {ids(out(*canon, "</s>", v.NO_CANON))} ELSE {ids(out(*canon, v.SURF, v.NO_CANON))} END AS allowed
FROM r"""


@query(_forced_sql())
def forced_tokens(spark, sf_dir):
    """The tokens that may come next in sequences that spell two words of a name, cut at any place."""
    spelt = lambda w: F.split(w, "")
    one = lambda w: F.flatten(F.array(F.array(F.lit(vocab.SURF)), spelt(w), F.array(F.lit(vocab.READING)), spelt(w), F.array(F.lit(vocab.LEMMA)), spelt(w), F.array(F.lit(vocab.CANON)), spelt(w)))
    own = table(spark, sf_dir, "part").select("p_partkey", F.slice(F.split("p_name", " "), 1, 2).alias("surfs")).withColumn("own", F.concat(F.array(F.lit("<s>")), F.flatten(F.transform("surfs", one))))
    cut = own.withColumn("own", F.slice("own", F.lit(1), (F.col("p_partkey") % F.size("own") + 1).cast("int")))
    ids = F.transform("own", lambda t: F.array_position(F.lit(list(TOKENS)), t).cast("int") - 1)
    rest = F.when(forced.section("own") == vocab.SURF, forced.rest_of_surf("own", "surfs"))
    return cut.select("p_partkey", rest.alias("rest"), F.array_join(F.transform(forced.allowed_tokens(TOKENS)("surfs", ids), lambda i: i.cast("string")), ",").alias("allowed"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), v AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT substr(w, 1, n) AS token FROM w, range(1, 4) t(n) UNION SELECT DISTINCT '▁' || substr(w, 1, 2) FROM w)), r AS (SELECT p_partkey, replace(p_name, ' ', '') AS rest FROM part) SELECT p_partkey, count(*) AS n, string_agg(token, ' ' ORDER BY token) AS tokens FROM r JOIN v ON starts_with(rest, replace(token, '▁', '')) GROUP BY p_partkey")
def permitted_tokens(spark, sf_dir):
    """Tokens of a vocabulary, made of the names' words, with which a name may begin: found by prefixes."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    tokens = words.select(F.explode(F.transform(F.lit([1, 2, 3]), lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("token")).unionByName(words.select(F.concat(F.lit("▁"), F.substring("w", 1, 2)).alias("token"))).distinct()
    own = forced.permitted_tokens(part.select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit("")).alias("rest")), tokens.withColumn("id", F.xxhash64("token")))
    return own.groupBy("p_partkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("token")), " ").alias("tokens"))


# --- values at their limits


def _rare(shift: int, special: bool) -> str:
    return f"CASE (p_size + {shift}) % 19 " + " ".join(f"WHEN {k} THEN '{vocab.RARE_TO_SPECIAL[c] if special else c}'" for k, c in enumerate(vocab.RARE)) + " END"


@query(f"SELECT p_partkey, replace(p_name, ' ', '{vocab.HALF_SPACE}') || {_rare(0, True)} || '{vocab.HALF_SPACE}' || {_rare(7, True)} || {_rare(0, True)} AS special, p_name || {_rare(0, False)} || ' ' || {_rare(7, False)} || {_rare(0, False)} AS rare FROM part")
def rare_characters(spark, sf_dir):
    """All rare characters, spaces too, as special tokens and back."""
    rare = lambda shift: F.element_at(F.lit(list(vocab.RARE)), (F.col("p_size") + shift) % 19 + 1)
    own = table(spark, sf_dir, "part").withColumn("special", text.rare_to_special(F.concat("p_name", rare(0), F.lit(" "), rare(7), rare(0))))
    return own.select("p_partkey", "special", text.special_to_rare("special").alias("rare"))


@query("WITH p AS (SELECT p_partkey, ['l1', 'l2', 'l3'][1:p_size % 3 + 1] AS ls, [p_brand, p_type, 'm3'][1:p_size % 4] AS ms FROM part), r AS (SELECT p_partkey, CASE WHEN len(ls) > 1 THEN ls[2:] ELSE ls END AS ls, CASE WHEN len(ms) = 0 THEN [NULL] WHEN len(ms) > 1 THEN ms[2:] ELSE ms END AS ms FROM p WHERE len(ls) > 1 OR len(ms) > 1), l AS (SELECT p_partkey, ms, unnest(ls) AS lemma FROM r) SELECT p_partkey, lemma, unnest(ms) AS semantics FROM l")
def homograph_lists(spark, sf_dir):
    """The other readings of words with one to three lemmas and none to three meanings."""
    first = lambda values, n: F.slice(F.array(*values), F.lit(1), n)
    own = table(spark, sf_dir, "part").select("p_partkey", first([F.lit("l1"), F.lit("l2"), F.lit("l3")], F.col("p_size") % 3 + 1).alias("ls"), first([F.col("p_brand"), F.col("p_type"), F.lit("m3")], F.col("p_size") % 4).alias("ms"))
    return own.select("p_partkey", F.inline(lexicon.homographs("ls", "ms")))


@query("SELECT p_name AS surf, p_type AS reading, p_brand AS lemma, '名詞' AS pos, 's' || p_size AS subpos, '*' AS conjtype, '*' AS conjform, p_brand || '/' || p_type AS canon, '代表表記:' || p_brand || '/' || p_type || CASE p_size % 4 WHEN 0 THEN ' x:' || p_size WHEN 1 THEN ' a b:c' ELSE '' END AS semantics FROM part")
def read_dictionary_lines(spark, sf_dir):
    """Twelve-column lines, written as files and read as entries; NIL, * and nothing at all add nothing to the semantics."""
    size = F.col("p_size")
    sem = F.when(size % 4 == 0, F.concat(F.lit("x:"), size.cast("string"))).when(size % 4 == 1, "a b:c").when(size % 4 == 2, "NIL").when(size % 8 == 3, "*").otherwise("")
    folder = shared_folder(spark)
    part = table(spark, sf_dir, "part")
    star = F.lit("*")
    part.select("p_name", F.lit("0"), F.lit("0"), F.lit("1"), F.lit("名詞"), F.concat(F.lit("s"), size.cast("string")), star, star, "p_brand", "p_type", F.concat_ws("/", "p_brand", "p_type"), sem).toDF(*[str(k) for k in range(12)]).write.csv(folder)
    return read_dictionary(spark, folder)


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INT) AS example_id, '' AS doc_id, o_orderstatus AS pre_text, o_orderpriority AS post_text, CASE WHEN o_orderkey % 2 = 0 THEN 'K,D' ELSE 'K' END AS kdr_tags, '_' AS ins_tags FROM orders")
def typo_examples(spark, sf_dir):
    """JSON lines in several files, numbered through all of them."""
    folder = shared_folder(spark)
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.lit(["K", "D"])).otherwise(F.lit(["K"]))
    own = table(spark, sf_dir, "orders").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey")
    own.select(F.col("o_orderstatus").alias("pre_text"), F.col("o_orderpriority").alias("post_text"), tags.alias("kdr_tags"), F.lit(["_"]).alias("ins_tags")).write.json(folder)
    found = sources.read_typo_examples(spark, folder, "*.json")
    return found.select("example_id", "doc_id", "pre_text", "post_text", F.array_join("kdr_tags", ",").alias("kdr_tags"), F.array_join("ins_tags", ",").alias("ins_tags"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN '体言;時間' WHEN o_orderstatus = 'F' THEN '体言' WHEN o_orderkey % 3 = 0 THEN '時間' ELSE '' END AS features FROM orders")
def known_features(spark, sf_dir):
    """Features that the vocabulary has, of lists with others and repeated ones."""
    other = F.concat(F.lit("other:"), "o_orderpriority")
    given = F.array(F.when(F.col("o_orderstatus") == "F", "体言").otherwise("用言"), other, F.when(F.col("o_orderkey") % 3 == 0, "時間").otherwise(other), F.when(F.col("o_orderstatus") == "F", "体言").otherwise(other))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.known_labels(given, vocab.BASE_PHRASE_FEATURES), ";").alias("features"))


@query("WITH p AS (SELECT p_partkey, unnest(string_split(translate(p_name, 'oae', 'どぁっ'), ' ')) AS surf, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part), n AS (SELECT p_partkey, k, surf, replace(translate(surf, 'どぁ', 'とあ'), 'っ', '') AS norm FROM p) SELECT p_partkey, CAST(2 * k - 2 AS INT) AS place, surf, CASE WHEN norm = '' THEN surf ELSE norm END AS norm FROM n UNION ALL SELECT p_partkey, CAST(2 * k - 1 AS INT), ' ', ' ' FROM n WHERE k < (SELECT max(k) FROM n m WHERE m.p_partkey = n.p_partkey)")
def words_by_operations(spark, sf_dir):
    """Words under normalization operations of several kinds, spaces between."""
    own = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", "oae", "どぁっ").alias("t"))
    chars = F.split("t", "")
    op = lambda c: F.when(c == "ど", "V").when(c == "ぁ", "S").when(c == "っ", "D").otherwise("K")
    begins = F.transform(chars, lambda c, i: F.when(i == 0, "B").otherwise("I"))
    words = segment.words_by_tags(F.array("t"), begins, F.transform(chars, op))
    return own.select("p_partkey", F.posexplode(words).alias("place", "w")).select("p_partkey", "place", "w.surf", "w.norm")


# --- loaders


@query("WITH d AS (SELECT doc_id, n_chars, md5('7:2:' || doc_id) AS draw, CASE WHEN n_chars <= 1 THEN 0 ELSE CAST(ceil(ln(n_chars) / ln(2.0) - 1e-9) AS INT) END AS r FROM documents WHERE n_chars IS NOT NULL), b AS (SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % 8 AS block, greatest(1, 20000 // CAST(power(2, r) AS BIGINT)) AS fits FROM d), k AS (SELECT *, (row_number() OVER (PARTITION BY block, r ORDER BY draw, doc_id) - 1) AS k FROM b), g AS (SELECT *, k // fits AS no FROM k), m AS (SELECT block || ':' || r || ':' || no AS batch, CAST(count(*) AS INT) AS n, CAST(max(n_chars) AS INT) AS longest, round(CASE WHEN max(n_chars) > 0 THEN 1 - sum(n_chars) / (count(*) * max(n_chars)) ELSE 0.0 END, 9) AS padding, string_agg(doc_id::VARCHAR, ',' ORDER BY k) AS keys FROM g GROUP BY block, r, no) SELECT * FROM m")
def loader_batches(spark, sf_dir):
    """An epoch's batches of documents of like length, padded to at most 20,000 characters."""
    docs = table(spark, sf_dir, "documents").where("n_chars is not null")
    made = loading.batches(docs, "doc_id", "n_chars", 20_000, seed=7, epoch=2, blocks=8, ratio=2.0)
    return made.select("batch", "n", "longest", F.round("padding", 9).alias("padding"), F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query("SELECT doc_id, CAST(CAST('0x' || substr(draw, 1, 8) AS BIGINT) % 64 AS INT) AS block, CAST(row_number() OVER (PARTITION BY CAST('0x' || substr(draw, 1, 8) AS BIGINT) % 64 ORDER BY draw, doc_id) - 1 AS INT) AS place FROM (SELECT doc_id, md5('11:0:' || doc_id) AS draw FROM documents)")
def shuffled_epoch(spark, sf_dir):
    """Every document once, in the order of an epoch."""
    return loading.loaders(table(spark, sf_dir, "documents").select("doc_id"), "train", "doc_id", "doc_id", seed=11)


# --- encoded examples


@query("WITH " + UNITS + """, w AS (SELECT k, i, CASE WHEN i <= 3 THEN 0 ELSE 1 END AS sent, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS w, count(*) OVER (PARTITION BY k) AS n FROM u),
e AS (SELECT a.k, a.w AS src, b.w AS tgt FROM w a JOIN w b ON a.k = b.k AND a.sent = b.sent AND a.w <> b.w WHERE a.sent = 1 UNION ALL SELECT k, w, n + 6 FROM w WHERE sent = 1),
c AS (SELECT w.k, w.w, count(e.tgt) AS m, coalesce(string_agg(e.tgt::VARCHAR, ',' ORDER BY e.tgt), '') AS t FROM w LEFT JOIN e ON e.k = w.k AND e.src = w.w GROUP BY ALL),
o AS (SELECT k, w, t, sum(m) OVER (PARTITION BY k ORDER BY w) AS upto FROM c)
SELECT k, '0,' || string_agg(upto::VARCHAR, ',' ORDER BY w) AS offsets, string_agg(t, ',' ORDER BY w) FILTER (t <> '') AS indices FROM o GROUP BY k HAVING max(upto) > 0""")
def encoded_heads(spark, sf_dir):
    """The candidate heads of orders' lines as offsets and indices: lines of the second sentence are targets, the root comes behind the words."""
    own = units(spark, sf_dir).select(F.col("k").alias("example_id"), F.when(F.col("i") <= 3, 0).otherwise(1).alias("sent_idx"), (F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1).cast("int").alias("word_idx"))
    words = own.withColumn("target", F.col("sent_idx") == 1)
    none = words.limit(0).select("example_id", F.col("word_idx").alias("src"), F.col("word_idx").alias("head"), F.lit("D").alias("dep_type"))
    mask = encoding.dependency_edges(words, none).where("kind = 'mask'")
    text_ = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return encoding.csr(mask, ["example_id"], encoding.sizes(words)).select(F.col("example_id").alias("k"), text_("offsets").alias("offsets"), text_("indices").alias("indices"))


#: What letters become in a written form, in its normal form, and by which operations.
SPELT = {"a": ("かー", "かあ", "KP"), "e": ("ねー", "ねえ", "KE"), "o": ("とぉ", "とお", "KS"), "i": ("みっ", "み", "KD"), "u": ("うぅ〜", "うう", "KSD")}


def _spelt_sql(at: int) -> str:
    text_ = "replace(p_name, ' ', '')"
    if at == 2:  # every other letter is kept
        text_ = f"regexp_replace({text_}, '[^aeiou]', 'k', 'g')"
    for c, forms in SPELT.items():
        text_ = f"replace({text_}, '{c}', '{forms[at]}')"
    return f"replace({text_}, 'k', 'K')" if at == 2 else text_


@query(f"SELECT p_partkey, {_spelt_sql(0)} AS surf, {_spelt_sql(1)} AS norm, {_spelt_sql(2)} AS ops FROM part")
def inferred_operations(spark, sf_dir):
    """Operations between written and normal forms that are made of the names' letters."""

    def spelt(at: int):
        out = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
        for c, forms in SPELT.items():
            out = F.replace(out, F.lit(c), F.lit(forms[at]))
        return out

    own = table(spark, sf_dir, "part").select("p_partkey", spelt(0).alias("surf"), spelt(1).alias("norm"))
    return own.select("*", F.array_join(edits.infer_norm_ops("surf", "norm"), "").alias("ops"))
