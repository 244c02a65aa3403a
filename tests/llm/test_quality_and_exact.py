"""op1 quality rules and op8 streaming exact dedup against brute force."""

import math

import pytest
from corpus import awkward_texts, empty, frame, sha, stored_frame, words

from leadsmith.llm.divergence import js_distance, quality_rules
from leadsmith.llm.shared import shared_dir
from leadsmith.llm.stream_dedup import exact_dedup, fingerprints, fold_stream


def base_row(text):
    text = text or ""
    w = words(text)
    lines = [s for s in text.split("\n") if words(s)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    counts = {}
    for x in windows:
        counts[x] = counts.get(x, 0) + 1
    covered = {k + j for k, x in enumerate(windows) if counts[x] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_base_rules_match_brute_force(spark):
    texts = awkward_texts()
    found = {r.doc_id: r for r in quality_rules(frame(spark, texts)).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        r = found[10 + k]
        want = base_row(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, text and text[:60]
        assert not (r.kept and r.base_failed)


def test_divergence_drops_the_odd_one_and_keeps_prose(spark):
    listed = "the of and to in a is that for it as with".split()
    texts = [" ".join(f"{listed[(k * j) % 12]} prose{j % 7 * 'x'} word" for j in range(100 + k)) for k in range(1, 30)]
    texts.append(" ".join(f"|{j}|{j * j}" for j in range(300)))
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    found = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    odd = found[len(texts) - 1]
    assert not odd.base_failed and not odd.kept
    assert all(found[k].kept or found[k].base_failed for k in range(len(texts) - 1))


def test_js_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.9, 0.1], [0.4, 0.6])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(js_distance("p", "q")).collect()]

    def js(p, q):
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return math.sqrt((kl(p, m) + kl(q, m)) / 2)

    assert got == pytest.approx([0, 1, js([0.9, 0.1], [0.4, 0.6])])


def brute_exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault("".join(words(t)), []).append((i, t))
    out = {}
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            out[i] = (keep, len(members), i == keep, sha(body))
    return out


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup_matches_brute_force(spark, tmp_path, bits):
    """With 4 bits nearly all digests collide, and the full bytes decide."""
    texts = awkward_texts()
    ids = list(range(10, 10 + len(texts)))
    docs = stored_frame(spark, tmp_path, texts, ids)
    want = brute_exact(list(zip(ids, texts)))
    found = exact_dedup(docs, digest_bits=bits).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == want


def test_exact_dedup_repeated_rows_and_null_ids(spark, tmp_path):
    docs = stored_frame(spark, tmp_path, ["a b", "a b", "a  b", "a  b", None], [5, 5, None, 7, None])
    rows = sorted(((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()), key=str)
    assert rows == [(-1, 7, 4, False), (-1, None, 1, True), (5, 7, 4, False), (5, 7, 4, False), (7, 7, 4, True)]


def test_state_outlives_a_run(spark, tmp_path):
    """A second run over the same folder reads only the new files, and still knows the old digests."""
    folder = shared_dir(spark)
    for batch, want in (([(2, "same text"), (3, "other")], 1), ([(1, "same text"), (4, "new")], 2)):
        docs = spark.createDataFrame(batch, "doc_id long, text string")
        fingerprints(docs).write.mode("append").parquet(f"{folder}/rows")
        state = {r.digest: r for r in fold_stream(spark, folder).collect()}
        assert state[sha("sametext")].group_size == want
    assert state[sha("sametext")].keep_id == 1 and len(state) == 3


def test_empty_tables(spark):
    assert quality_rules(empty(spark)).count() == 0
    assert exact_dedup(empty(spark)).count() == 0
