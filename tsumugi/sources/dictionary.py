"""Dictionary sources: word entries, kanji readings, reading and insertion vocabularies."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow
from tsumugi.kernels.align import TO_HIRAGANA
from tsumugi.vocab import ID, UNK

#: Columns of a dictionary line (fixed values).
COLUMNS = "surf string, left_id string, right_id string, cost string, pos string, subpos string, conjform string, conjtype string, lemma string, reading string, repname string, sem string"
ENTRY = ("surf", "reading", "lemma", "pos", "subpos", "conjtype", "conjform", "canon", "semantics")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of 12-column lines; the semantics are the canonical form and what else the line says."""
    rows = spark.read.schema(COLUMNS).csv(path)
    return dictionary_entries(rows)


def dictionary_entries(rows: DataFrame) -> DataFrame:
    extra = F.when(F.col("sem").isNull() | F.col("sem").isin("", "NIL", "*"), F.lit(None)).otherwise(F.col("sem"))
    return rows.select("surf", "reading", "lemma", "pos", "subpos", "conjtype", "conjform", F.col("repname").alias("canon"), F.concat_ws(" ", F.concat(F.lit("代表表記:"), F.col("repname")), extra).alias("semantics"))


def encode_dictionary(entries: DataFrame) -> DataFrame:
    """Entries with an id for each distinct value of the columns that repeat, counted from 0 by first appearance.

    entries has ord, the entries' order. Parquet does the compression; the ids serve programs that want numbers.
    """
    out = entries
    for name in ("pos", "subpos", "conjtype", "conjform"):
        firsts = entries.groupBy(name).agg(F.min("ord").alias("_first"))  # a closed set of values
        ids = firsts.select(name, (F.row_number().over(Window.orderBy("_first")) - 1).alias(f"{name}_no"))
        out = out.join(ids, name)
    return out.select(*entries.columns, *[f"{n}_no" for n in ("pos", "subpos", "conjtype", "conjform")])


#: Readings of signs, of 0 and of 1 (fixed values).
SIGNS = {
    "°": "ど", "&": "あんど", ".": "てん", ":": "じ", "0": "れい ぜろ まる",
    "1": "いち いっ ひと ひとつ わん ふぁーすと じゅう じゅっ ひゃく ひゃっ いっぴゃく せん いっせん まん いちまん じゅうまん ひゃくまん せんまん いっせんまん おく おっ いちおく じゅうおく じゅくおっ ひゃくおく ひゃくおっ せんおく せんおっ いっせんおく いっせんおっ ちょう いっちょう",
}
#: For the other digits: their own readings, then how they begin compounds, their hundred, and their thousand alone and before 10^4 (fixed values).
DIGITS = {
    "2": ("に じ ふた ふたつ つー とぅー せかんど", "に", "にひゃく", "にせん", "にせん"),
    "3": ("さん み みっつ みっ すりー さーど", "さん", "さんびゃく", "さんぜん", "さんぜん"),
    "4": ("し よ よっつ よっ よん ふぉー ふぉーす", "よん", "よんひゃく", "よんせん", "よんせん"),
    "5": ("ご いつ ふぁいぶ ふぃふす", "ご", "ごひゃく", "ごせん", "ごぜん"),
    "6": ("ろく ろっ む むっ むっつ しっくす", "ろく", "ろっぴゃく", "ろくせん", "ろくせん"),
    "7": ("しち なな ななつ なの せぶん", "なな", "ななひゃく", "ななせん", "ななせん"),
    "8": ("はち はっ や やっつ えいと", "はち", "はっぴゃく", "はっせん", "はっせん"),
    "9": ("きゅう く ここの ここのつ ないん", "きゅう", "きゅうひゃく", "きゅうせん", "きゅうせん"),
}


def built_in_readings() -> dict[str, list[str]]:
    """Readings of the signs and digits: a digit's compounds are its tens, hundreds, thousands, and those with 10^4 and 10^8."""
    out = {c: r.split() for c, r in SIGNS.items()}
    short = lambda r: r[:-1] + "っ"
    for c, (own, lead, hundred, thousand, before) in DIGITS.items():
        small = [lead + "じゅう", lead + "じゅっ", hundred, short(hundred), thousand]
        man = [x + "まん" for x in (lead, lead + "じゅう", hundred, before)]
        oku = [x + y for x in (lead, lead + "じゅう", hundred, before) for y in ("おく", "おっ")]
        out[c] = [*own.split(), *small, *man, *oku, lead + "ちょう"]
    return out


KANJI = "struct<character:string,readings:array<string>,meanings:array<string>,pinyin:array<string>,korean:array<string>,numbers:map<string,int>>"
#: One-letter marks of numeric fields (fixed values).
NUMBERS = {"B": "radical", "C": "classical_radical", "S": "strokes", "G": "grade", "F": "frequency"}


def parse_kanji_line(line: str) -> dict | None:
    """A line's character, readings in hiragana (a hyphen at the end dropped), meanings in braces, and other fields."""
    if not line.strip() or line.startswith("#"):
        return None
    character, _, rest = line.rstrip().partition(" ")
    out: dict = {"character": character, "readings": [], "meanings": re.findall(r"\{([^}]*)\}", rest), "pinyin": [], "korean": [], "numbers": {}}
    for f in re.sub(r"\{[^}]*\}", "", rest).split()[1:]:  # the first is a code point
        if f[0] in NUMBERS and f[1:].isdigit():
            out["numbers"].setdefault(NUMBERS[f[0]], int(f[1:]))
        elif f[0] in "YW":
            out["pinyin" if f[0] == "Y" else "korean"].append(f[1:])
        elif unicodedata.name(f[0], "").startswith(("HIRAGANA", "KATAKANA")) or f[0] == "-" and len(f) > 1:
            out["readings"].append(f.translate(TO_HIRAGANA).removesuffix("-"))
    return out


def read_kanji(spark: SparkSession, path: str) -> DataFrame:
    """character, readings, meanings and other fields of a kanji dictionary's lines, and the built-in signs and digits."""

    @arrow(f"array<{KANJI}>")
    def parsed(line: pd.Series) -> pd.Series:
        return line.map(lambda x: [k] if (k := parse_kanji_line(x)) else [])

    own = spark.read.text(path).select(F.inline(parsed("value")))
    signs = spark.createDataFrame([(c, r, [], [], [], {}) for c, r in built_in_readings().items()], own.schema)
    return own.unionByName(signs.join(own.select("character"), "character", "left_anti"))


def reading_vocabulary(lines: DataFrame) -> DataFrame:
    """reading and id of lines (ord, line): the unknown and identity readings are 0 and 1, others count by first appearance."""
    firsts = lines.select("ord", F.trim("line").alias("reading")).where(~F.col("reading").isin("", UNK, ID)).groupBy("reading").agg(F.min("ord").alias("ord"))
    ids = firsts.select("reading", (F.row_number().over(Window.orderBy("ord")) + 1).alias("id"))
    return lines.sparkSession.createDataFrame([(UNK, 0), (ID, 1)], "reading string, id int").unionByName(ids)


def insertion_vocabulary(lines: DataFrame, size: int) -> DataFrame:
    """token and id of non-empty lines (ord, line), counted on from the size of the vocabulary that they extend."""
    own = lines.select("ord", F.trim("line").alias("token")).where("token != ''")
    return own.select("token", (F.row_number().over(Window.orderBy("ord")) + size - 1).cast("int").alias("id"))


def semantics_items(semantics: Column | str) -> Column:
    """Items (key, value) of a semantics string; a word without a colon is a flag."""
    c = F.col(semantics) if isinstance(semantics, str) else semantics
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(F.substring_index(w, ":", 1).alias("key"), F.when(F.contains(w, F.lit(":")), F.substring(w, F.locate(":", w) + 1, F.length(w))).alias("value")))
