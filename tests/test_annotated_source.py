"""Annotated text as a data source: the rows of the plain reader, in batch and as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from tsumugi.sources import annotated
from tsumugi.sources.text import read_annotated

WORD = "{0} {0} {0} 名詞 6 普通名詞 1 * 0 * 0 \"代表表記:{0}/{0}\"\n"


def document(k):
    sentences = [f"# S-ID:doc{k}-{s} note {s}\n* -1D\n+ -1D <体言>\n" + "".join(WORD.format(w) for w in ("犬", f"w{k}")) + "EOS\n" for s in range(k % 3 + 1)]
    return "".join(sentences) if k % 4 else "".join(WORD.format(f"n{s}") + "EOS\n" for s in range(2))


@pytest.fixture
def folder(spark, tmp_path):
    annotated.register(spark)
    at = tmp_path / "in"
    (at / "sub").mkdir(parents=True)
    for k in range(9):
        (at / f"{k}.knp").write_text(document(k))
    (at / "sub" / "9.knp").write_text(document(9))
    (at / "empty.knp").write_text("")
    (at / "other.txt").write_text("not asked for")
    return at


def rows(df):
    return sorted((repr(r.asDict(recursive=True)) for r in df.collect()))


def test_rows_of_the_plain_reader(spark, folder):
    plain = read_annotated(spark, str(folder))
    own = spark.read.format("annotated_text").load(str(folder))
    assert rows(own.drop("path")) == rows(plain) and own.where("path like '%.txt'").count() == 0
    deep = spark.read.format("annotated_text").option("recursive", "true").option("groupBytes", "200").load(str(folder))
    assert rows(deep.drop("path")) == rows(read_annotated(spark, str(folder), recursive=True))
    assert deep.rdd.getNumPartitions() > 3 and own.rdd.getNumPartitions() == 1


def test_some_columns_only(spark, folder, monkeypatch):
    schema = "sid string, doc_id string, sent_idx int"
    own = spark.read.format("annotated_text").schema(schema).load(f"file://{folder}")
    assert rows(own) == rows(read_annotated(spark, str(folder)).select("sid", "doc_id", "sent_idx"))
    monkeypatch.setattr(annotated.formats, "parse_sentence", lambda lines: pytest.fail("words were parsed"))
    assert annotated.rows_of("a/b.knp", document(5), ["sid", "doc_id"])[0] == {"sid": "doc5-0", "doc_id": "doc5"}


def test_no_files(spark, folder):
    assert spark.read.format("annotated_text").option("glob", "*.none").load(str(folder)).count() == 0


def test_a_stream_of_files(spark, folder, tmp_path):
    """Each file once, over several batches and a restart."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        read = spark.readStream.format("annotated_text").schema("path string, sid string, doc_id string, sent_idx int").load(str(folder))
        read.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    go()
    for k in (20, 21):
        (folder / f"{k}.knp").write_text(document(k))
        os.utime(folder / f"{k}.knp")
    go()
    go()
    found = spark.read.parquet(out)
    assert rows(found.select("sid", "doc_id", "sent_idx")) == rows(read_annotated(spark, str(folder)).select("sid", "doc_id", "sent_idx"))
    assert found.where(F.col("path").like("%20.knp")).count() == 20 % 3 + 1 if 20 % 4 else 2


def test_a_file_is_read_in_bounded_batches(tmp_path):
    """A file is never held whole: batches come while it is read, with the rows of the whole text."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    text = "".join(f"# S-ID:d-{k} n\r\n" + WORD.format(f"w{k}") + ("EOS\r\n" if k % 2 else "EOS\n\n") for k in range(2000)) + WORD.format("last")
    (tmp_path / "a.knp").write_bytes(text.encode())
    schema = StructType([StructField("sid", StringType()), StructField("sent_idx", IntegerType())])
    reader = annotated.AnnotatedReader(schema, {"path": str(tmp_path)})
    batches = list(reader.read(reader.partitions()[0]))
    assert max(b.num_rows for b in batches) <= 256
    assert [r for b in batches for r in b.to_pylist()] == annotated.rows_of("a.knp", text, ["sid", "sent_idx"]) and sum(b.num_rows for b in batches) == 2001
