"""op13 language identification: held-out accuracy, sizes by hand, and awkward texts."""

import zlib

import zstandard
from corpus import SCHEMA, empty, frame
from pyspark.sql import functions as F

from leadsmith.llm import language as L

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    found = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    right = [r for r in found if r.lang_pred == r.lang]
    assert len(right) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    sure = [r for r in found if not r.rejected]
    assert len(sure) > 0.9 * len(found) and sum(r.lang_pred == r.lang for r in sure) >= 0.99 * len(sure)


def test_nothing_is_learned_from_held_out_rows_and_lang_is_no_input(spark):
    docs = spark.read.parquet(DOCS)
    spoiled = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).drop("source")
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(spoiled).collect()))
    assert "xx" not in L.learn(spoiled).langs


def test_sample_bound_and_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 5)
    known = L.learn(spark.read.parquet(DOCS))
    assert known.langs[0] == "en" and set(known.langs) == {"en", "de", "fr", "es"}
    assert all(0 < len(c) <= 5 * (2 * L.PIECE + 2) for c in known.contents)


def test_sizes_add_up_over_the_whole_text():
    known = L.Dictionaries(("a", "b"), (b" the words of one language " * 3, b" les mots d une langue " * 3))
    text = "The WORDS, of one: language! " * 2000
    data = L.letters(text)
    assert data.startswith(b" the words of one language the")
    for k, content in enumerate(known.contents):
        params = zstandard.ZstdCompressionParameters.from_level(9, dict_size=L.DICTIONARY, source_size=L.BLOCK, strategy=6, min_match=4, write_content_size=0)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        want = sum(len(c.compress(L.PAD + data[at : at + L.BLOCK])) for at in range(0, len(data), L.BLOCK))
        assert abs(L.sizes(text, known)[k] - want) <= 4 * (len(data) // L.BLOCK + 1)
    assert L.decide(L.sizes("the words of one", known), known)[0] == "a"
    assert L.decide(L.sizes("les mots d'une", known), known)[0] == "b"


def test_ties_and_narrow_margins():
    known = L.Dictionaries(("m", "n"), (b"x", b"y"))
    assert L.decide([50, 50], known) == ("m", 0.5, 0.0, True)
    assert L.decide([1000, 1005], known)[3] and not L.decide([1000, 1050], known)[3]
    assert L.decide([90, 80], known)[0] == "n"
    assert L.decide([7], L.Dictionaries(("m",), (b"x",))) == ("m", 1.0, 100.0, False)


def test_awkward_rows(spark):
    texts = [None, "", " \t", "12 34 % 🙂", "ª", "é", "the " * 100_000, "퟿ x", "the cat", "the cat"]
    ids = [1, 2, None, 4, 5, 6, 7, 8, 9, 9]
    found = L.identify(frame(spark, texts, ids)).collect()
    assert len(found) == len(texts)
    by = {r.doc_id: r for r in found}
    for k in (1, 2, None, 4):
        assert by[k].lang_pred == "und" and by[k].score == 0
    assert all(by[k].lang_pred != "und" for k in (6, 7, 8, 9))
    assert by[None].held_out is False


def test_nothing_to_learn_from(spark):
    assert L.identify(empty(spark)).collect() == []
    rows = [(1, "words of a text", None, "s", 1, True, "r", 1, "l")]
    (r,) = L.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
