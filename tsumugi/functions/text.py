"""Column functions on text. All but NFKC and random spelling variants are built from Spark's own functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow
from tsumugi import vocab
from tsumugi.kernels.align import expand_readings


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@arrow("string")
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def escape_symbols(text: Column | str) -> Column:
    """Replaces the symbols that annotation lines reserve and deletes control characters (line ends and tabs too)."""
    keys = "".join(vocab.REPLACED)
    return F.translate(_col(text), keys + vocab.DELETED, "".join(vocab.REPLACED.values()))


def normalize_text(text: Column | str) -> Column:
    """NFKC, then escape_symbols."""
    return escape_symbols(nfkc(_col(text)))


def normalize_reading(reading: Column | str) -> Column:
    return F.replace(_col(reading), F.lit("う゛"), F.lit("ゔ"))


def normalize_morpheme(m: Column | str) -> Column:
    """A morpheme struct with surf, lemma and (if it has one) canon normalized, and the reading's う゛ composed."""
    m = _col(m)
    return m.withField("surf", normalize_text(m["surf"])).withField("lemma", normalize_text(m["lemma"])).withField("reading", normalize_reading(m["reading"]))


def to_hiragana(text: Column | str) -> Column:
    return F.translate(_col(text), vocab.KATAKANA, vocab.HIRAGANA)


def to_full_width(text: Column | str) -> Column:
    """ASCII letters, digits and symbols as their full-width forms, U+FF01 to U+FF5E."""
    ascii_ = "".join(map(chr, range(0x21, 0x7F)))
    return F.translate(_col(text), ascii_, "".join(chr(ord(c) + 0xFEE0) for c in ascii_))


def has_kana(text: Column | str) -> Column:
    return F.rlike(_col(text), F.lit("[\\x{3040}-\\x{30ff}]"))


def has_kanji(text: Column | str) -> Column:
    return F.rlike(_col(text), F.lit("[\\x{4e00}-\\x{9fff}]"))


def is_hiragana(text: Column | str) -> Column:
    """Whether all is hiragana or the prolonged mark (false for an empty text)."""
    return F.rlike(_col(text), F.lit("^[\\x{3041}-\\x{309f}ー]+$"))


def kanji_ga(text: Column | str) -> Column:
    """0-origin place of the first inner ケ, or else ヶ, if it is between two kanji; else -1."""
    text = _col(text)
    inner = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    at = F.when(F.contains(inner, F.lit("ケ")), F.locate("ケ", inner)).otherwise(F.locate("ヶ", inner))
    sides = F.concat(F.substring(text, at, F.lit(1)), F.substring(text, at + 2, F.lit(1)))
    return F.when((at > 0) & F.rlike(sides, F.lit("^[\\x{4e00}-\\x{9fff}]{2}$")), at).otherwise(F.lit(-1))


def feature_labels(features: Column | str) -> Column:
    """Labels of a map of features: key:value, the key alone for a null value (a flag) and for clause functions."""
    return F.transform(F.map_entries(_col(features)), lambda e: F.when(e["value"].isNull() | F.rlike(e["key"], F.lit(vocab.IGNORED_VALUE)), e["key"]).otherwise(F.concat(e["key"], F.lit(":"), e["value"])))


def label_to_feature(label: Column | str) -> Column:
    """A label as a struct of key and value, split at the first colon; a flag has a null value."""
    label = _col(label)
    key = F.substring_index(label, ":", 1)
    return F.struct(key.alias("key"), F.when(F.contains(label, F.lit(":")), F.substring(label, F.length(key) + 2, F.length(label))).alias("value"))


def clean_reading(reading: Column | str) -> Column:
    reading = _col(reading)
    return F.when(F.contains(reading, F.lit("/")) & (F.length(reading) > 1), F.substring_index(reading, "/", 1)).otherwise(reading)


def clean_canon(canon: Column | str) -> Column:
    canon = _col(canon)
    parts = F.split(canon, "/")
    return F.when((F.size(parts) > 2) & (parts[0] != "") & (parts[1] != ""), F.concat_ws("/", parts[0], parts[1])).otherwise(canon)


def _replace_all(text: Column, pairs: Mapping[str, str]) -> Column:
    for a, b in pairs.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rare_to_special(text: Column | str, spaces: bool = True) -> Column:
    pairs = {" ": vocab.HALF_SPACE} if spaces else {}
    return _replace_all(_col(text), pairs | vocab.RARE_TO_SPECIAL)


def special_to_rare(text: Column | str, spaces: bool = True) -> Column:
    pairs = {vocab.HALF_SPACE: " "} if spaces else {}
    return _replace_all(_col(text), pairs | vocab.SPECIAL_TO_RARE)


def make_window_id(doc_id: Column | str, window: Column | str, stride: int = 1) -> Column:
    return F.concat(_col(doc_id), F.lit(f"-s{stride}i"), _col(window).cast("string"))


WINDOW_ID = r"^([a-zA-Z0-9\-_]+?)-s([0-9]+)i([0-9]+)$"


def original_id(window_id: Column | str) -> Column:
    """The document of a window's id; an id of another form is a document's own."""
    c = _col(window_id)
    return F.when(F.rlike(c, F.lit(WINDOW_ID)), F.regexp_extract(c, WINDOW_ID, 1)).otherwise(c)


def window_stride(window_id: Column | str) -> Column:
    """The stride in a window's id, else null."""
    return F.regexp_extract(_col(window_id), WINDOW_ID, 2).try_cast("int") if hasattr(Column, "try_cast") else F.nullif(F.regexp_extract(_col(window_id), WINDOW_ID, 2), F.lit("")).cast("int")


def synthesize_canon(lemma: Column | str, reading: Column | str, pos: Column | str, conjtype: Column | str, base_reading: Column | str | None = None) -> Column:
    """lemma/reading for what doesn't inflect, lemma/lemma for a hiragana lemma, else lemma/base_reading (null without one)."""
    lemma, reading = _col(lemma), _col(reading)
    inflected = F.concat_ws("/", lemma, _col(base_reading)) if base_reading is not None else F.lit(None).cast("string")
    return F.when((_col(conjtype) == "*") | (_col(pos) == "特殊"), F.concat_ws("/", lemma, reading)).when(is_hiragana(lemma), F.concat_ws("/", lemma, lemma)).otherwise(inflected)


def excluded(morphemes: Column | str, stop_surfs: tuple[str, ...]) -> Column:
    """Whether a sentence (array of structs with surf, reading, pos) has a stop surface or a reading that isn't hiragana."""
    stops = F.array(*[F.lit(s) for s in stop_surfs]) if stop_surfs else F.array().cast("array<string>")
    return F.exists(_col(morphemes), lambda m: F.exists(stops, lambda s: F.contains(m["surf"], s)) | ((m["pos"] != "特殊") & ~is_hiragana(m["reading"])))


def canon_alternatives(canon: Column | str, features: Column | str) -> Column:
    """The canonical form and those within features ALT-...\"代表表記:x ...\", in order, each once."""
    keys = F.filter(F.map_keys(_col(features)), lambda k: F.startswith(k, F.lit("ALT-")))
    inside = F.transform(keys, lambda k: F.regexp_extract(k, '"代表表記:([^ "]*)', 1))
    return F.array_distinct(F.filter(F.concat(F.array(_col(canon)), inside), lambda c: c.isNotNull() & (c != "")))


@arrow("array<string>")
def kanji_readings(readings: pd.Series) -> pd.Series:
    return readings.map(lambda r: expand_readings(list(r)), na_action="ignore")


def fold_discourse(label: Column | str) -> Column:
    """The coarse relation of a discourse label; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in vocab.DISCOURSE_FOLDING.items() for x in pair]), _col(label))


def doc_id_of(text: Column | str) -> Column:
    """The id in a line "# D-ID:x", else null."""
    c = _col(text)
    pattern = r"(?m)^#[ \t]+D-ID:(\S*)"
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1))


def without_doc_id(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?m)^#[ \t]+D-ID:[^\n]*(\n|$)", "")


def known_labels(labels: Column | str, known: Sequence[str]) -> Column:
    """Those of the labels that a vocabulary has, once each, in the order of the labels."""
    return F.array_intersect(_col(labels), F.lit(list(known)).cast("array<string>"))
