"""Words and their complements over two letters, whose hashes were equal while a hash was a sum over byte places."""

import pytest
from corpus import SCHEMA

from leadsmith.llm.backoff import backoff_scores
from leadsmith.llm.bpe import encode_decode
from leadsmith.llm.lpf import suffix_dedup
from leadsmith.llm.odd_sketch import near_dedup
from leadsmith.llm.recompression import repeated_words
from leadsmith.llm.words import joined, span_hashes


def pair(n):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_hashes_differ(n):
    data, at = joined([w.encode() for w in (*pair(n), pair(n)[0])])
    a, b, c = span_hashes(data, at[:-1], at[1:] - 1)
    assert a == c and a != b


@pytest.mark.parametrize("n", [1024, 4096])
def test_operators_tell_the_words_apart(spark, tmp_path, n):
    a, b = pair(n)
    tail = " ".join(f"w{k}" for k in range(34))
    one, full = [a, b], [f"{a} {tail}", f"{b} {tail}"]

    def table(texts):
        path = str(tmp_path / f"t{len(texts[0])}")
        spark.createDataFrame([(k, t, "en", "s", 1, True, "r", 1, "l") for k, t in enumerate(texts)], SCHEMA).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    assert [r.component_id for r in near_dedup(table(one), width=2).orderBy("doc_id").collect()] == [0, 1]
    texts = {r.doc_id: r.decoded for r in encode_decode(table(one)).collect()}
    assert texts == {0: a, 1: b}
    assert [r.n_unseen for r in backoff_scores(table(one)).orderBy("doc_id").collect()] == [1, 1]
    assert [r.n_removed for r in repeated_words(table(full)).collect()] == [0, 0]
    kept = suffix_dedup(table(full)).orderBy("doc_id").collect()
    first, second = (t.encode() for t in full)
    seen = {first[k : k + 50] for k in range(len(first) - 49)}
    covered = {k + j for k in range(len(second) - 49) if second[k : k + 50] in seen for j in range(50)}
    assert [r.n_removed for r in kept] == [0, len(covered)]
