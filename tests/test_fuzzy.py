"""Fuzzy record dedup against all pairs, and the fuzzy header match on its rules."""

import random

import pytest

from leadsmith.operators import fuzzy as Z
from leadsmith.operators import profile as PR

SCHEMA = "`Full Name` string, `Company Name` string, `Job Title` string, Source string, _row long"


def normal(v):
    v = (v or "").strip()
    return "" if v.lower() in ("", "nan", "none", "null") else " ".join(v.lower().split())


def grams(s):
    p = f" {s} "
    return {p[k:k + 3] for k in range(len(p) - 2)} if s else set()


def alike(a, b, percent):
    for x, y in zip(a, b):
        gx, gy = grams(x), grams(y)
        if 100 * len(gx & gy) < percent * len(gx | gy):
            return False
    return True


def brute_links(rows, percent):
    keys = sorted({k for r in rows if any(k := (normal(r[0]), normal(r[1])))})
    return {("\x1f".join(a), "\x1f".join(b)) for i, a in enumerate(keys) for b in keys[i + 1:] if alike(a, b, percent)}


def people(n, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))) for _ in range(max(n // 4, 1))]
    rows = []
    for k in range(n):
        name = rng.choice(names)
        if rng.random() < 0.4 and name:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice(["", "z", "  ", name[at].upper()]) + name[at + 1:]
        rows.append((rng.choice([name, name, name, None, "NaN", ""]) if rng.random() < 0.3 else name,
                     rng.choice(["Acme  Freight", "acme freight", "acme fright", "béta", None, "none"]),
                     rng.choice([None, "x" * (k % 5)]), f"f{k % 3}.csv", k))
    return rows


@pytest.mark.parametrize("percent,block,buckets", [(60, 2_000, 1 << 10), (60, 3, 8), (90, 5, 64), (35, 2, 16)])
def test_links_match_all_pairs(spark, monkeypatch, percent, block, buckets):
    """Also with so few counters that the order is nearly arbitrary and every token is a hot one, joined in blocks."""
    monkeypatch.setattr(Z, "BLOCK_ROWS", block)
    monkeypatch.setattr(Z, "BUCKETS", buckets)
    rows = people(160, percent)
    keyed = Z.fuzzy_key(spark.createDataFrame(rows, SCHEMA), "people")
    found = [tuple(r) for r in Z.fuzzy_links(keyed.select(keyed["_key"].alias("key")).distinct(), percent).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_links(rows, percent)


def test_classes_of_a_long_chain_and_a_hub(spark):
    chain = [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(60)]
    hub = [("a", f"z{i}") for i in range(80)] + [("q", "q")]
    got = dict(map(tuple, Z.link_classes(spark.createDataFrame(chain + hub, "key_u string, key_v string")).collect()))
    assert {got[f"k{i:03d}"] for i in range(61)} == {"k000"}
    assert {got[f"z{i}"] for i in range(80)} | {got["a"]} == {"a"}
    assert "q" not in got


def test_merge_keeps_every_record_and_the_longest_values(spark):
    rows = [("Ann  Lee", "Freight Co", "vp", "a.csv", 0), ("ann lee", "freight co", None, "b.csv", 1), ("Ann Leee", "Freight Co.", "head of sales", "b.csv", 2),
            ("Bob", None, "cto", "a.csv", 3), ("Bob", "Freight Co", "cto", "a.csv", 4), (None, "nan", "x", "a.csv", 5), ("", "", "y", "a.csv", 6)]
    found = {r["_row"]: r for r in Z.fuzzy_deduplicate(spark.createDataFrame(rows, SCHEMA), "people").collect()}
    assert sum(r["_n"] for r in found.values()) == len(rows)
    assert sorted(found) == [0, 3, 4, 5, 6]
    assert (found[0]["Full Name"], found[0]["Job Title"], found[0]["_n"]) == ("Ann  Lee", "head of sales", 3)
    assert found[5]["Job Title"] == "x" and found[6]["Job Title"] == "y"


def test_company_keys_and_empty_table(spark):
    rows = [("Acme Labs", "acme-labs.io", "a", 0), ("Acme Labs Inc", "acme-labs.io", "b", 1), ("Acme Labs", "zeta.com", "a", 2)]
    df = spark.createDataFrame(rows, "`Company Name` string, `Company Domain` string, Source string, _row long")
    assert sorted(r["_n"] for r in Z.fuzzy_deduplicate(df, "company").collect()) == [1, 2]
    assert Z.fuzzy_deduplicate(df.limit(0), "company").count() == 0
    with pytest.raises(ValueError):
        Z.fuzzy_key(df.select("Source", "_row"), "company")


@pytest.mark.parametrize("header,alias,score", [
    ("Linked_In  URL", "url linked in", 100), ("Compny Name", "company name", 92), ("e-mail", "email", 83), ("", "--", 0), ("web", "site", 0)])
def test_header_ratio(spark, header, alias, score):
    df = spark.createDataFrame([(header, alias)], "a string, b string")
    assert df.select(Z.header_ratio(df["a"], df["b"])).first()[0] == score


def test_exact_alias_wins_and_room_loses_nothing(spark):
    al = [tuple(r) for r in PR.alias_table(spark, "people").select("alias", "std").collect()]
    headers = [a for a, _ in al] + [a[:-1] + "q" for a, _ in al] + ["zzzz", "x"]
    profile = spark.createDataFrame([("f", k, h, True) for k, h in enumerate(headers)] + [("f", 9999, al[0][0], False)],
                                    "Source string, ordinal int, column_name string, kept boolean")
    found = {r["ordinal"]: r for r in Z.fuzzy_alias_matches(profile, "people").collect()}
    exact = {r["ordinal"]: r for r in PR.alias_matches(profile, "people").collect()}
    assert all(found[k]["std"] == r["std"] and found[k]["score"] == 100 for k, r in exact.items())
    pairs = spark.createDataFrame([(k, h, a) for k, h in enumerate(headers) for a, _ in al], "k int, a string, b string")
    best = pairs.select("k", Z.header_ratio(pairs["a"], pairs["b"]).alias("s")).groupBy("k").max("s").collect()
    assert {k for k, s in map(tuple, best) if s >= 85} == set(found)
