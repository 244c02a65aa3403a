"""op12 phrase collocations against counts of every phrase by itself."""

import random
import re
from collections import Counter

import pytest
from corpus import SCHEMA, awkward_texts, empty, frame

from leadsmith.llm import phrases as P


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            totals[lang] += len(ws)
            for n in (1, 2, 3, 4):
                for k in range(len(ws) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[k : k + n])] += 1
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in good.items():
            for n in range(2, len(p)):
                for k in range(len(p) - n + 1):
                    covered[p[k : k + n]] = max(covered[p[k : k + n]], a)
        scored = []
        for p, a in good.items():
            if 100 * covered[p] < 80 * a:
                score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]], cut))
        for rank, (s, a, phrase, lo, r, cut) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, lo, r, totals[lang], -s, cut))
    return sorted(out)


def prose(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "a", "é", "𝒳", "b\x85c", "New", "york", "city", "zz"]
    return "".join(rng.choices(words, [9, 9, 5, 3, 1, 1, 4, 4, 4, 1])[0] + rng.choice(["  ", " ", "\t", " ", " ", ". ", "\n", ",\x0b"]) for _ in range(n))


@pytest.mark.parametrize("least,top,buckets", [(2, 50, 64), (2, 5, 1 << 16), (4, 2000, 1 << 16)])
def test_phrases_match_brute_force(spark, monkeypatch, least, top, buckets):
    """Also with so few counters that nearly no window is cut."""
    monkeypatch.setattr(P, "PAIR_BUCKETS", buckets)
    texts = awkward_texts() + [prose(n, n) for n in (1, 2, 3, 40, 400, 3000)] + ["  x y  x y", "x y.x y", "x\ty x y\x0bx y"]
    found = P.collocations(frame(spark, texts), least, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]
    assert sorted(map(tuple, found.collect())) == brute([(t, [None, "en", "de", "xx"][k % 4]) for k, t in enumerate(texts)], least, top)


def test_a_piece_of_one_hot_word_and_no_text(spark, monkeypatch):
    monkeypatch.setattr(P, "PAIR_BUCKETS", 1 << 10)
    rows = [(1, "no " * 5000, None), (1, "no " * 5000, None), (2, None, "de"), (None, "", "en"), (3, "no\nno", "de")]
    df = spark.createDataFrame([(i, t, x, "s", 0, True, "r", 1, "l") for i, t, x in rows], SCHEMA)
    assert sorted(map(tuple, P.collocations(df, 30, 9).collect())) == brute([r[1:] for r in rows], 30, 9)
    assert P.collocations(empty(spark)).count() == 0
