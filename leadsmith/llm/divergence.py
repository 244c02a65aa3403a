"""Quality rules by distribution divergence, in built-in expressions only.

Each document gets a character-class histogram and a histogram over its language's common words. Summed over all documents
of a language they give that language's reference; a document whose Jensen-Shannon distance to the reference is too large
is dropped, provided that it is long enough for its histogram to mean something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.shared import SPACE, stored

#: Character classes as Java patterns, in the order in which they are taken out of a text; a last bin holds the rest.
CLASSES = {
    "lower": "[a-z]+",
    "space": SPACE,
    "upper": "[A-Z]+",
    "stop": "[.,;:!?'\"()-]+",
    "letter": r"\p{L}+",
    "digit": r"\p{N}+",
}
#: Common function words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as with".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y a los se del las un".split(),
}
N_COMMON = 12
#: Largest distances (0 to 1) and least words for them to count.
MAX_CLASS_DISTANCE, MIN_CLASS_WORDS = 0.3, 50
MAX_WORD_DISTANCE, MIN_WORD_WORDS = 0.27, 200


def _windows(words: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` words, from the words' hashes; none if there are fewer words."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def _places(listed: list[str]) -> Column:
    """Places (from 1) in the list, of the words that are in it."""
    places = F.array(*[F.lit(w) for w in listed])
    hits = F.filter("words", lambda w: w.isin(*listed))
    return F.transform(hits, lambda w: F.array_position(places, w).cast("int"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, counts of the base rules, and the two histograms (arrays of long) of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).alias("lang"),
        text.alias("text"),
        F.when(bare != "", F.split(bare, SPACE)).otherwise(F.array().cast("array<string>")).alias("words"),
        F.filter(F.split(text, "\n"), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    # The lists are literals in the lambda: as a column they would be built anew for every word.
    found = F.array().cast("array<int>")
    for lang, listed in COMMON_WORDS.items():
        found = F.when(F.col("lang") == lang, _places(listed[:N_COMMON])).otherwise(found)
    read = read.withColumn("found", found).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    read = read.withColumn("windows", _windows(F.col("hashes"), 5))
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    read = read.withColumn(
        "ranked", F.when(F.size("windows") > F.size(F.array_distinct("windows")), ranked)
    )
    same = lambda k, j: F.get(F.col("ranked"), j)["h"].eqNullSafe(k["h"])
    repeated = F.sort_array(
        F.transform(
            F.filter("ranked", lambda r, k: same(r, k - 1) | same(r, k + 1)),
            lambda r: r["i"],
        )
    )
    read = read.withColumn("repeated", F.when(F.col("ranked").isNotNull(), repeated))
    covered = F.aggregate(
        F.transform("repeated", lambda p, k: F.least(F.lit(5), F.coalesce(F.get(F.col("repeated"), k + 1) - p, F.lit(5)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    # Each class is counted by what its removal takes away, from a text that has grown shorter by the classes before it.
    counts, rest = {}, "text"
    for name, pattern in CLASSES.items():
        read = read.withColumn(f"without_{name}", F.regexp_replace(rest, pattern, ""))
        counts[name] = F.char_length(rest) - F.char_length(f"without_{name}")
        rest = f"without_{name}"
    n_chars = F.char_length("text")
    n_words = F.size("words").cast("bigint")
    bins = F.sequence(F.lit(1), F.lit(N_COMMON))
    hits = F.transform(bins, lambda k: F.size("found") - F.size(F.array_remove(F.col("found"), k)))
    return read.select(
        "doc_id",
        "lang",
        n_words.alias("n_words"),
        (n_chars - counts["space"]).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        n_chars.cast("bigint").alias("n_chars"),
        F.array(*counts.values()).cast("array<bigint>").alias("classes"),
        hits.cast("array<bigint>").alias("commons"),
    )


def _shares(counts: Column, total: Column) -> Column:
    """The bins and what they leave of the total, as shares of the total; null for an empty total."""
    used = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    bins = F.array_append(counts, total - used)
    return F.when(total > 0, F.transform(bins, lambda x: x / total))


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance with base 2 of two columns of shares; null if one of them is null."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(found: DataFrame) -> DataFrame:
    """Histograms of each language in COMMON_WORDS, summed over all its documents."""
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES))]
    sums += [F.sum(F.col("commons")[k]).alias(f"w{k}") for k in range(N_COMMON)]
    return (
        found.where(F.col("lang").isin(*COMMON_WORDS))
        .groupBy("lang")
        .agg(F.sum("n_chars").alias("ref_chars"), F.sum("n_words").alias("ref_words"), *sums)
        .select(
            "lang",
            "ref_chars",
            "ref_words",
            F.array(*[f"c{k}" for k in range(len(CLASSES))]).alias("ref_classes"),
            F.array(*[f"w{k}" for k in range(N_COMMON)]).alias("ref_commons"),
        )
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    Null text: no words, so base_failed. Languages without a list of common words, and null, have no reference: their
    distances are null and only the base rules decide. Texts under the least length of a distance are not judged by it.
    Rows are judged one by one, so repeated rows and null identifiers come out as they went in; an empty table gives an
    empty result. Columns other than the three named are never read.
    """
    found = stored(features(docs, id_col, text_col, lang_col), "features")
    # At most one row per language of COMMON_WORDS: four rows, whatever the input.
    both = found.join(F.broadcast(references(found)), "lang", "left")
    both = both.withColumns(
        {
            "p_class": _shares(F.col("classes"), F.col("n_chars")),
            "q_class": _shares(F.col("ref_classes"), F.col("ref_chars")),
            "p_word": _shares(F.col("commons"), F.col("n_words")),
            "q_word": _shares(F.col("ref_commons"), F.col("ref_words")),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = F.coalesce((F.col("n_words") >= MIN_CLASS_WORDS) & (F.col("class_distance") > MAX_CLASS_DISTANCE), F.lit(False))
    odd = F.coalesce((F.col("n_words") >= MIN_WORD_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE), F.lit(False))
    return (
        both.withColumns(
            {"class_distance": js_distance("p_class", "q_class"), "word_distance": js_distance("p_word", "q_word")}
        )
        .withColumn("base_failed", failed)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & ~far & ~odd).alias("kept"),
            F.round("class_distance", 6).alias("class_distance"),
            F.round("word_distance", 6).alias("word_distance"),
        )
    )


def oracle_sql() -> str:
    """The same rules in DuckDB's SQL, over the documents table."""
    space = r"[\x20\x09-\x0D]"
    q = lambda x: "'" + x.replace("'", "''") + "'"
    chain, counts, rest = [], [], "t"
    for name, pattern in CLASSES.items():
        chain.append(f"regexp_replace({rest}, {q(pattern)}, '', 'g') AS without_{name}")
        counts.append(f"length({rest}) - length(without_{name})")
        rest = f"without_{name}"
    cases = " ".join(
        f"WHEN {q(lang)} THEN [" + ", ".join(f"len(list_filter(ws, lambda w: w = {q(w)}))" for w in listed[:N_COMMON]) + "]"
        for lang, listed in COMMON_WORDS.items()
    )
    languages = ", ".join(map(q, COMMON_WORDS))
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{k + 1}])" for k in range(n)) + "]"
    shares = lambda c, n: f"list_transform(list_append({c}, {n} - list_sum({c})), lambda x: x::DOUBLE / {n})"
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] + z[2]) / 2)) ELSE 0.0 END"

    def distance(p: str, r: str) -> str:
        term = f"({part.format('z[1]')} + {part.format('z[2]')}) / 2"
        total = f"list_sum(list_transform(list_zip({p}, {r}), lambda z: {term}))"
        return f"CASE WHEN {p} IS NOT NULL AND {r} IS NOT NULL THEN sqrt(greatest({total}, 0.0)) END"

    steps = ", ".join(f"s{k + 1} AS (SELECT *, {x} FROM s{k})" for k, x in enumerate(chain))
    return f"""
        WITH s0 AS (
            SELECT doc_id, lang, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls
            FROM documents
        ), {steps},
        f AS (
            SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(t)::BIGINT AS n_chars,
                   (length(t) - (length(without_lower) - length(without_space)))::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, ws,
                   [{", ".join(counts)}] AS classes, CASE lang {cases} END AS commons
            FROM s{len(chain)}
        ),
        p AS (
            SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM f WHERE len(ws) >= 5
        ),
        w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS n FROM p),
        c AS (
            SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
            FROM w, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id
        ),
        r AS (
            SELECT lang, sum(n_chars) AS ref_chars, sum(n_words) AS ref_words,
                   {sums("classes", len(CLASSES))} AS ref_classes, {sums("commons", N_COMMON)} AS ref_commons
            FROM f WHERE lang IN ({languages}) GROUP BY lang
        ),
        b AS (
            SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   CASE WHEN n_chars > 0 THEN {shares("classes", "n_chars")} END AS p_class,
                   CASE WHEN ref_chars > 0 THEN {shares("ref_classes", "ref_chars")} END AS q_class,
                   CASE WHEN n_words > 0 THEN {shares("commons", "n_words")} END AS p_word,
                   CASE WHEN ref_words > 0 THEN {shares("ref_commons", "ref_words")} END AS q_word
            FROM f LEFT JOIN c USING (doc_id) LEFT JOIN r USING (lang)
        ),
        j AS (SELECT *, {distance("p_class", "q_class")} AS cd, {distance("p_word", "q_word")} AS wd,
                     n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(n_words >= {MIN_CLASS_WORDS} AND cd > {MAX_CLASS_DISTANCE}, false)
                   AND NOT coalesce(n_words >= {MIN_WORD_WORDS} AND wd > {MAX_WORD_DISTANCE}, false) AS kept,
               round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
        FROM j
    """
