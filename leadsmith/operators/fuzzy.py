"""Fuzzy matching: record dedup on names and domains (O2), header match (O1).

O2. Records whose key fields (name and company of people, name and domain of
companies) differ slightly are one record. Two keys match if each field's sets
of 3-grams share ``percent`` of their union; a missing field matches only a
missing one. The join is an exact set-similarity join on distinct keys:

* a key's grams are ordered from rare to common, and matching keys must share a
  gram among the first few of that order (prefix filter);
* sizes and places of the shared gram bound what two keys can share, inside the
  join;
* grams that very many prefixes hold are joined in blocks, so that no task gets
  such a group whole;
* what is left is compared on the full sets of grams.

The order only needs to be the same everywhere, so it comes from a table of
``BUCKETS`` counters, of fixed size. Matches are closed to classes, and the
records of a class are merged like those of an exact key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import C, m6, strip
from ..functions.constants import FUZZY_HEADER_LEAST, FUZZY_KEYS
from ..session import ensure_checkpoint_dir
from .dedup import KEY, ROW, fold_aggs, merged_rows, partial_aggs
from .profile import alias_table, header_key

GRAM, PERCENT = 3, 60
BUCKETS = 1 << 16
BLOCK_ROWS = 2_000
MAX_ROUNDS = 60


def _bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _counters(tokens: DataFrame) -> Column:
    """How many rows fall in each bucket of ``token``: one array of fixed size, as a scalar subquery."""
    seen = tokens.groupBy(_bucket("token").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    blank = tokens.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("bigint").alias("k"))
    dense = seen.unionByName(blank).groupBy("b").agg(F.sum("k").alias("k"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "k"))), lambda x: x["k"])).scalar()


def normal_field(c: Column) -> Column:
    """Lower case, blanks collapsed; empty when missing (M6)."""
    return F.when(m6(c), F.lit("")).otherwise(F.lower(F.regexp_replace(strip(c), r"\s+", " ")))


def grams(c: Column) -> Column:
    """Distinct 3-grams of a field with one blank before and behind it; none of an empty field."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    cut = F.transform(F.sequence(F.lit(1), F.length(c) + 3 - GRAM), lambda i: F.substr(padded, i, F.lit(GRAM)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(cut))


def fuzzy_key(df: DataFrame, table_type: str, fields: list[str] | None = None) -> DataFrame:
    """``_key``: the normal key fields, separated; ``unique_<row>`` where all are missing."""
    fields = [f for f in fields or FUZZY_KEYS[table_type] if f in df.columns]
    if not fields:
        raise ValueError(f"no fuzzy key column of {table_type} in the table")
    joined = F.concat_ws("\x1f", *[normal_field(C(f)) for f in fields])
    blank = F.replace(joined, F.lit("\x1f"), F.lit("")) == ""
    return df.withColumn(KEY, F.when(blank, F.concat(F.lit("unique_"), F.col(ROW).cast("string"))).otherwise(joined))


def _field_grams(keys: DataFrame) -> DataFrame:
    """(key, fields): the grams of each field of distinct keys; keys of records without key fields match nothing."""
    parts = F.split("key", "\x1f", -1)
    return keys.where(~F.col("key").startswith("unique_") | F.col("key").contains("\x1f")).select(
        "key", F.transform(parts, lambda p: grams(p)).alias("fields"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, n, token, pos): each set's rarest tokens, as many as a match must share one of."""
    rows = sets.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rare_first = Window.partitionBy("key").orderBy("seen", "token")
    rows = rows.withColumn("seen", F.element_at(_counters(rows), _bucket("token") + 1))
    rows = rows.withColumn("pos", F.row_number().over(rare_first))
    return rows.where(F.expr(f"pos <= n - (({percent} * n + 99) div 100) + 1")).select("key", "n", "token", "pos")


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """(key_u, key_v), once each: keys that share a prefix token and may match by the bounds."""
    blocks = F.ceil(F.element_at(_counters(prefixes), _bucket("token") + 1) / BLOCK_ROWS)
    rows = prefixes.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    u, v = (rows.select("token", "x", "y", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "pos", "own")]) for s in "uv")
    both = u.join(v, ["token", "x", "y"])
    most = F.least("pos_u", "pos_v") + F.least(F.col("n_u") - F.col("pos_u"), F.col("n_v") - F.col("pos_v"))
    may = ((F.col("key_u") < F.col("key_v"))
           & ((F.col("own_u") != F.col("own_v")) | (F.col("x") == F.col("y")))
           & (F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
           & (most * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent))
    return both.where(may).select("key_u", "key_v").distinct()


def fuzzy_links(keys: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key_u, key_v) of distinct ``key`` values that match in every field; key_u < key_v."""
    ensure_checkpoint_dir(keys.sparkSession)
    sets = _field_grams(keys)
    tagged = F.flatten(F.transform("fields", lambda g, i: F.transform(g, lambda t: F.concat(i.cast("string"), t))))
    prefixes = _prefixes(sets.select("key", tagged.alias("tokens")), percent).checkpoint()
    pairs = _candidates(prefixes, percent)
    for s in "uv":
        pairs = pairs.join(sets.select(F.col("key").alias(f"key_{s}"), F.col("fields").alias(f"fields_{s}")), f"key_{s}")

    def alike(a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        return shared * 100 >= (F.size(a) + F.size(b) - shared) * percent

    return pairs.where(F.forall(F.zip_with("fields_u", "fields_v", alike), lambda same: same)).select("key_u", "key_v")


def link_classes(links: DataFrame, u: str = "key_u", v: str = "key_v") -> DataFrame:
    """(key, class) of every linked key; class is the smallest key reachable.

    Large and small stars by turns: every round joins the links to each key's smallest neighbour, so a key with very many
    links is a join key with many rows, never a list. Rounds are checkpointed.
    """
    ensure_checkpoint_dir(links.sparkSession)

    def downward(a: str, b: str) -> list[Column]:
        return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]

    edges = links.where(F.col(u) != F.col(v)).select(*downward(u, v)).distinct().checkpoint()
    for _ in range(MAX_ROUNDS):
        sides = edges.select(F.col("hi").alias("k"), F.lit(1).alias("above")).unionAll(edges.select("lo", F.lit(0)))
        moving = sides.groupBy("k").agg(F.sum("above").alias("ups"), F.min("above").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
        if moving.isEmpty():
            break
        near = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = near.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        edges = near.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct().checkpoint()
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = edges.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct().checkpoint()
    else:
        raise RuntimeError("classes did not settle")
    tops = edges.select(F.col("lo").alias("key"), F.col("lo").alias("class")).distinct()
    return edges.select(F.col("hi").alias("key"), F.col("lo").alias("class")).unionByName(tops)


def fuzzy_deduplicate(df: DataFrame, table_type: str, percent: int = PERCENT) -> DataFrame:
    """O2: one row per class of matching records, merged like equal ones; ``_key`` is the class, ``_n`` its records.

    Rows of one key are folded to one partial row before classes are joined to them, so a key that a third of all rows
    have meets the join once.
    """
    keyed = fuzzy_key(df, table_type)
    cols = [c for c in df.columns if c not in (ROW, KEY) and not c.startswith("__")]
    partials = keyed.groupBy(KEY).agg(*partial_aggs(cols))
    ensure_checkpoint_dir(df.sparkSession)
    partials = partials.checkpoint()
    classes = link_classes(fuzzy_links(partials.select(F.col(KEY).alias("key")), percent))
    labelled = partials.join(classes, F.col(KEY) == F.col("key"), "left").withColumn(KEY, F.coalesce("class", KEY)).drop("key", "class")
    return merged_rows(labelled.groupBy(KEY).agg(*fold_aggs(cols)), cols)


# O1 -------------------------------------------------------------------------

def sorted_words(header: Column) -> Column:
    """Lower-case letters and digits of a header, its words in order: 'LinkedIn_Url' and 'url linkedin' are alike."""
    words = F.split(F.btrim(F.regexp_replace(F.lower(header), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


def header_ratio(a: Column, b: Column) -> Column:
    """0 to 100: Levenshtein distance of the word-sorted forms against the longer one, rounded half up."""
    x, y = sorted_words(a), sorted_words(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 0).otherwise(F.floor((longest - F.levenshtein(x, y)) * 100 / longest + 0.5)).cast("int")


def fuzzy_alias_matches(profile: DataFrame, table_type: str, least: int = FUZZY_HEADER_LEAST) -> DataFrame:
    """O1: kept profile columns matched to the standard header of their most similar alias, from a score of ``least`` on.

    An exact alias (J3) wins over any other; then the score counts, then the order of the dictionary. Headers are compared
    with the aliases of the fixed dictionary (< 200 rows, broadcast) whose lengths allow that score.
    """
    al = alias_table(profile.sparkSession, table_type).select(
        header_key(F.col("alias")).alias("alias"), F.length(sorted_words(F.col("alias"))).alias("size"), "std", "std_ord", "alias_ord")
    cols = profile.where("kept").select("Source", "ordinal", "column_name", F.length(sorted_words(F.col("column_name"))).alias("own"))
    room = F.abs(F.col("own") - F.col("size")) * 100 <= F.greatest("own", "size") * (100 - least + 1)
    found = cols.join(F.broadcast(al), room).withColumn("score", header_ratio(F.col("column_name"), F.col("alias")))
    exact = header_key(F.col("column_name")) == F.col("alias")
    rank = F.struct(exact.alias("e"), "score", (-F.col("std_ord")).alias("s"), (-F.col("alias_ord")).alias("a"))
    best = F.max_by(F.struct("std", "std_ord", "alias_ord", "alias", "score"), rank).alias("m")
    return found.where(F.col("score") >= least).groupBy("Source", "ordinal", "column_name").agg(best).select(
        "Source", "ordinal", "column_name", "m.std", "m.std_ord", "m.alias_ord", "m.alias", "m.score")
