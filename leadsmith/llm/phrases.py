"""Phrase collocations by top-order marginalisation: only the longest windows are counted, shorter phrases are sums over them.

Every word of a piece begins one window of MOST_WORDS words: lead columns hold the words behind it, padded with empty
strings at the end of the piece. Windows are counted once, and a ROLLUP over their columns sums the counts of all their
shorter prefixes: each occurrence of a phrase is the prefix of exactly one window, so these sums are the phrases' counts.

Most windows are seen once or twice, so a first pass bounds the counts of neighbouring words by a table of PAIR_BUCKETS
counters; a window ends before a pair whose counter stays under the least count. No phrase with that pair can reach the
least count, and no candidate has it in any of its parts, so results do not change; where more text fills the counters, fewer
windows are cut. The table is a fixed number of bits, whatever the input's size.

Results for awkward input: a null text counts as empty, a null lang as ``und``; identifiers and other columns are not read, so
repeated rows count each time; ties in score and count go by the phrase's bytes; an empty table gives no phrase. Texts are read
whole; a task's memory grows with the longest piece between two marks of punctuation or line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.shared import release, stored

MOST_WORDS, LEAST_COUNT, TOP, COVERED = 4, 30, 2000, 80
#: Counters of neighbouring words; one bit of each goes to the executors (8 MB).
PAIR_BUCKETS = 1 << 26
#: Copies of a single word's count, so that the candidates that begin or end with a very common word spread over tasks.
SALTS = 16
MARKS = r"[.,;:!?\n\x0B\f\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
W = [f"w{k}" for k in range(1, MOST_WORDS + 1)]


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words) of every piece with a word."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    found = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, MARKS, -1)).alias("piece"))
    found = found.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece != ''")
    return found.select("lang", F.split("piece", r"[ \t]+", -1).alias("words"))


def windows(found: DataFrame, width: int) -> DataFrame:
    """(lang, w1, w2, ...): the window that begins at each word, padded with empty strings."""
    n = F.size("words")
    leads = [F.col("words").alias(W[0]), *(F.slice("words", F.lit(k + 1), n).alias(W[k]) for k in range(1, width))]
    rows = found.select("lang", *leads).select("lang", F.inline(F.arrays_zip(*W[:width])))
    return rows.select("lang", W[0], *(F.coalesce(w, F.lit("")).alias(w) for w in W[1:width]))


def _bucket(a: str, b: str) -> Column:
    return F.pmod(F.xxhash64("lang", a, b), F.lit(PAIR_BUCKETS))


def frequent_pairs(found: DataFrame, least: int) -> Column:
    """Bits of the counters that reach ``least``, as one array of 64-bit numbers (a scalar subquery)."""
    counts = windows(found, 2).where("w2 != ''").groupBy(_bucket("w1", "w2").alias("bucket")).count().where(F.col("count") >= least)
    at = F.shiftright("bucket", 6).alias("at")
    words = counts.groupBy(at).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits"))
    words = words.unionByName(found.sparkSession.range(PAIR_BUCKETS // 64).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("bits")))
    words = stored(words.groupBy("at").agg(F.bit_or("bits").alias("bits")), "pairs")
    return words.agg(F.sort_array(F.collect_list(F.struct("at", "bits")))["bits"]).scalar()


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, size, phrase, n): counts of phrases of 1 to MOST_WORDS words that occur ``least`` times or more; size 0 is all words."""
    found = pieces(docs)
    bits = frequent_pairs(found, least)
    release(docs.sparkSession)

    def frequent(a: str, b: str) -> Column:
        bucket = _bucket(a, b)
        word = F.element_at(bits, (F.shiftright(bucket, 6) + 1).cast("int"))
        return F.call_function("getbit", word, F.pmod(bucket, F.lit(64)).cast("int")) == 1

    rows = windows(found, MOST_WORDS)
    for k in range(1, MOST_WORDS):
        keep = (F.col(W[k]) != "") & frequent(W[k - 1], W[k])
        rows = rows.withColumn(W[k], F.when(keep, F.col(W[k])).otherwise(""))
        if k + 1 < MOST_WORDS:
            rows = rows.withColumn(W[k + 1], F.when(F.col(W[k]) != "", F.col(W[k + 1])).otherwise(""))
    window = F.rtrim(F.concat_ws(" ", *W))  # words hold no spaces: one string a window, without its padding, makes the shortest rows
    longest = stored(rows.groupBy("lang", window.alias("window")).agg(F.count("*").alias("n")), "windows")
    release(docs.sparkSession)
    words = F.split("window", " ", -1)
    longest = longest.select("lang", "window", "n", *(F.coalesce(F.get(words, F.lit(k)), F.lit("")).alias(w) for k, w in enumerate(W)))
    full = longest.where((F.col(W[-1]) != "") & (F.col("n") >= least)).select("lang", F.lit(MOST_WORDS).alias("size"), F.col("window").alias("phrase"), "n")
    shorter = W[:-1]
    sums = longest.rollup("lang", *shorter).agg(F.sum("n").alias("n"), F.grouping_id().alias("left_out"))
    size = len(shorter) - F.log2(F.col("left_out") + 1).cast("int")
    sums = sums.withColumn("size", size).where("lang is not null")
    last = F.element_at(F.array(F.lit("x"), *shorter), F.col("size") + 1)
    sums = sums.where((F.col("size") == 0) | ((last != "") & (F.col("n") >= least)))
    return full.unionByName(sums.select("lang", "size", F.concat_ws(" ", *shorter).alias("phrase"), "n"))


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, size), " ")


def _exact(c: Column) -> Column:
    """A count as a decimal, so that products of counts are exact beyond 64 bits."""
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: each language's best phrases of 2 to MOST_WORDS words.

    The score is floor(2000000 a / (l + r)) at the worst cut into a first part (l) and a rest (r); phrases that a longer one
    covers in COVERED of 100 occurrences are left out.
    """
    counts = stored(phrase_counts(docs, least), "phrases")
    release(docs.sparkSession)
    parts = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), "size")
    parts = parts.withColumn("salt", F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("size")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("words"))

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    rest = F.col("size") - F.col("cut")
    for name, start, size in (("l", 1, F.col("cut")), ("r", F.col("cut") + 1, rest)):
        salt = F.when(size == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
        cuts = cuts.withColumn("part", _part(F.col("words"), start, size)).withColumn("salt", salt)
        cuts = cuts.join(parts, ["lang", "part", "salt"]).withColumnRenamed("f", name).drop("part", "salt")
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))

    inner = found.where("size > 2").select("lang", "words", "size", "a")
    inner = inner.select("*", F.explode(F.expr("sequence(2, size - 1)")).alias("short"))
    inner = inner.select("*", F.explode(F.expr("sequence(1, size - short + 1)")).alias("start"))
    covered = inner.groupBy("lang", _part(F.col("words"), F.col("start"), F.col("short")).alias("phrase")).agg(F.max("a").alias("longer"))
    covered = covered.select("lang", "phrase", "longer")
    kept = worst.join(covered, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * COVERED))

    totals = counts.where("size = 0").select(F.col("lang").alias("total_lang"), F.col("n"))
    ranked = kept.select("lang", "phrase", "a", "worst.*")
    best = ranked.withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")).where(F.col("rank") <= top)
    best = best.join(totals, F.col("lang") == F.col("total_lang"))
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("bigint").alias("cut"))


#: DuckDB's form, with every phrase of every length counted by itself.
ORACLE_SQL = r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
    i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
    g AS (
        SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS a
        FROM (SELECT *, unnest([1, 2, 3, 4]) AS size FROM i) WHERE i + size - 1 <= len(ws) GROUP BY ALL
    ),
    f AS (SELECT * FROM g WHERE a >= 30),
    c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
    k AS (SELECT *, unnest(range(1, size)) AS cut FROM c),
    s AS (
        SELECT k.lang, k.phrase, k.a, k.cut, x.a AS l, y.a AS r, CAST(k.a AS HUGEINT) * 2000000 // (CAST(x.a AS HUGEINT) + y.a) AS score
        FROM k
        JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.cut], ' ')
        JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.cut + 1:], ' ')
    ),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    o AS (
        SELECT lang, array_to_string(ws[i:i + short - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT *, unnest(range(1, size - short + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS short FROM c WHERE size > 2))
        GROUP BY ALL
    ),
    n AS (SELECT lang, sum(a) AS n FROM g WHERE size = 1 GROUP BY lang),
    t AS (
        SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
        FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
        WHERE o.longer IS NULL OR CAST(o.longer AS HUGEINT) * 100 < CAST(b.a AS HUGEINT) * 80
    )
    SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, CAST(n.n AS BIGINT) AS n, CAST(t.score AS BIGINT) AS score, t.cut
    FROM t JOIN n ON n.lang = t.lang WHERE t.rank <= 2000
"""
