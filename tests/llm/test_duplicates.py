"""op4 near dedup, op6 suffix arrays, op9 recompression, op7 scores, all against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import awkward_texts, empty, frame, sha, stored_frame, vocabulary, words

from leadsmith.llm import backoff, chunks, lpf, odd_sketch, recompression
from leadsmith.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(pairs, width):
    sets = {i: shingles(t, width) for i, t in pairs}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_matches_brute_force(spark, tmp_path, width):
    texts = awkward_texts()
    rng, vocab = random.Random(5), vocabulary(300, 5)
    base = [rng.choice(vocab) for _ in range(60)]
    for _ in range(40):  # copies of copies: chains in which far ends are not linked themselves
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(vocab)
        texts.append(" ".join(base))
    ids = list(range(10, 10 + len(texts)))
    found = odd_sketch.near_dedup(stored_frame(spark, tmp_path, texts, ids), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_components(list(zip(ids, texts)), width)


def test_near_dedup_null_ids_and_repeated_rows(spark, tmp_path):
    docs = stored_frame(spark, tmp_path, ["a b c d e f", "a b c d e f", "a b c d e f", "x y", None], [4, 4, None, None, 3])
    rows = sorted(odd_sketch.near_dedup(docs).collect(), key=str)
    assert sorted((r.doc_id or -1, r.component_id) for r in rows if r.component_id) == [(-1, 4), (3, 3), (4, 4), (4, 4)]
    assert [r.component_id for r in rows if r.doc_id is None and r.n_shingles == 1 and r.component_id is None] == [None]


def test_mixed_buckets_lose_no_link(spark, tmp_path):
    """Two large groups around the threshold share bands; links between them are found beyond the stars."""
    rng, vocab = random.Random(8), vocabulary(900, 8)
    base = [rng.choice(vocab) for _ in range(80)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    ids = rng.sample(range(1000), len(texts))
    found = odd_sketch.near_dedup(stored_frame(spark, tmp_path, texts, ids), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_components(list(zip(ids, texts)), 2)


def test_sketch_estimates_are_close():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for share in (0.8, 0.9, 0.97):
        n = 1000
        common = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(pool[n - common : 2 * n - common])
        samples = odd_sketch.minhash([a, b])
        sketches = odd_sketch.odd_sketches(samples)
        z = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        assert z <= odd_sketch.MOST_BITS
        bits = 64 * odd_sketch.SKETCH_LONGS
        assert abs(1 + bits / (4 * odd_sketch.SAMPLES) * math.log(1 - 2 * z / bits) - share) < 0.15


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    nodes = rng.sample(range(10_000), 300)
    edges = [(nodes[k], nodes[k + 1]) for k in range(99)] + [(nodes[100], nodes[k]) for k in range(101, 250)] + [(nodes[260], nodes[260])]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {n: min(nodes[:100]) for n in nodes[:100]} | {n: min(nodes[100:250]) for n in nodes[100:250]}
    assert got == want


def brute_earlier(pairs, width=50):
    first = {}
    data = [(math.inf if i is None else i, (t or "").encode()) for i, t in pairs]
    for i, b in sorted(data):
        for k in range(len(b) - width + 1):
            first.setdefault(b[k : k + width], i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [2_000_000, 2_000])
def test_suffix_dedup_matches_brute_force(spark, tmp_path, monkeypatch, chunk_bytes):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    texts = awkward_texts()
    ids = list(range(10, 10 + len(texts)))
    random.Random(1).shuffle(ids)
    texts, ids = texts + [texts[7], texts[7]], ids + [None, 3]
    found = lpf.suffix_dedup(stored_frame(spark, tmp_path, texts, ids)).collect()
    got = sorted((math.inf if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in found)
    assert got == brute_earlier(list(zip(ids, texts)))


def test_previous_and_next_smaller():
    rng = np.random.default_rng(1)
    block = np.sort(rng.integers(0, 6, 40))
    doc = rng.integers(0, 9, 40)
    got = lpf._smaller_before(doc, np.unique(block, return_inverse=True)[1])
    assert got.tolist() == [any(doc[j] < doc[k] and block[j] == block[k] for j in range(k)) for k in range(40)]


def brute_repeated(pairs, width=35):
    count = Counter()
    for _, t in pairs:
        w = words(t)
        count.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, t in pairs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((-1 if i is None else i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def test_repeated_words_match_brute_force(spark, tmp_path):
    texts = awkward_texts()
    rng, vocab = random.Random(9), vocabulary(30, 9)
    block = " ".join(rng.choice(vocab) for _ in range(50))
    texts += [block + "\n" + " ".join(rng.choice(vocab) for _ in range(20)) + " " + block]  # within one text
    texts += ["the " * 34, "the " * 35, "the " * 36, " ".join(f"u{k}" for k in range(35)), " ".join(f"u{k}" for k in range(1, 40))]
    ids = [*range(10, 9 + len(texts)), None]
    found = recompression.repeated_words(stored_frame(spark, tmp_path, texts, ids)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in found)
    assert got == brute_repeated(list(zip(ids, texts)))


def test_equal_windows_have_equal_keys():
    """Keys depend on the window alone, wherever it stands and whatever lies around it."""
    rng, vocab = random.Random(2), vocabulary(12, 2)
    inner = " ".join(rng.choice(vocab) for _ in range(70))
    texts = [(" ".join(rng.choice(vocab) for _ in range(k)) + " " + inner + " " + " ".join(rng.choice(vocab) for _ in range(k))).encode() for k in range(40)]
    scheme = recompression.RepeatedWords()
    view = scheme.view(texts)
    keys, _ = scheme.keys(view)
    for k in range(40):
        at = view.at[k] + k
        assert (keys[at : at + 36] == keys[view.at[0] : view.at[0] + 36]).all()


def test_bucket_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    for _, i, j in chunks.by_bucket(keys, 6):
        short = chunks.shorten(keys, 6)[i:j]
        assert (chunks.unpack_keys(chunks.pack_keys(short)) == short).all()


def brute_scores(pairs, order):
    docs = [words(t) for _, t in pairs]
    total, own = Counter(), [Counter() for _ in docs]
    for w, mine in zip(docs, own):
        for n in range(1, order + 1):
            mine.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        total.update(mine)
    n_all, out = sum(map(len, docs)), []
    for (i, _), w, mine in zip(pairs, docs, own):
        score = backed = unseen = 0
        other = lambda g: total[g] - mine[g]  # noqa: E731, B023
        for k in range(len(w)):
            longest = min(order, k + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if other(gram) > 0:
                    below = other(gram[:-1]) if n > 1 else n_all - len(w)
                    s = backoff.BACKOFF ** (longest - n) * other(gram) / below
                    backed += n < longest
                    break
            else:
                s, unseen = backoff.BACKOFF**longest / (n_all - len(w) + 1), unseen + 1
            score += round(math.log10(s) * backoff.UNIT)
        out.append((-1 if i is None else i, len(w), score, backed, unseen))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 3])
def test_backoff_scores_match_brute_force(spark, tmp_path, order):
    texts = awkward_texts()
    ids = [*range(10, 9 + len(texts)), None]
    found = backoff.backoff_scores(stored_frame(spark, tmp_path, texts, ids), order=order).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.log_score, r.n_backed_off, r.n_unseen) for r in found)
    want = brute_scores(list(zip(ids, texts)), order)
    assert [(*g[:2], *g[3:]) for g in got] == [(*w[:2], *w[3:]) for w in want]
    assert all(abs(g[2] - w[2]) <= 2 for g, w in zip(got, want))
    assert all(r.mean_log10 is None for r in found if r.n_words == 0)


def test_empty_tables(spark):
    none = empty(spark)
    assert odd_sketch.near_dedup(none).count() == 0
    assert lpf.suffix_dedup(none).count() == 0
    assert recompression.repeated_words(none).count() == 0
    assert backoff.backoff_scores(none).count() == 0
