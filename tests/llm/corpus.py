"""Small corpora with every awkward case, and brute-force versions of the operators' rules."""

import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, `row` string, rep int, label string"


def words(text):
    return WORD.findall(text or "")


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeéöñ") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def awkward_texts(seed=1):
    """Null, empty, blank, one word, repeated, exact and near copies, shared passages, one long text."""
    rng = random.Random(seed)
    vocab = vocabulary(400, seed)

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    base, passage = prose(300), prose(60)
    long = prose(20_000)
    texts = [None, "", " \t\n", "word", "Word", "two words", "tWO  words", base, base, base.replace(" ", "\n"), base.upper()]
    for k in range(6):  # near copies, a few words apart
        w = base.split()
        for _ in range(2 + k):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [prose(40) + " " + passage + " " + prose(40) for _ in range(5)]
    texts += [long, prose(100) + " " + long[:3000], "ab " * 500, "ab " * 500, "no " * 40 + passage, passage]
    texts += [prose(80) + "\n" + prose(5) + "\n" + prose(5) for _ in range(12)]
    texts += ["line one here\nline one here\n\n \nline one here", "#$%& <|endoftext|> it's 12 ½ \x85\xa0 𝒳 don't", "é" * 60, "é" * 60]
    return texts


def frame(spark, texts=None, ids=None):
    """A documents table with null identifiers, a repeated row, and columns whose names operators might use themselves."""
    texts = awkward_texts() if texts is None else texts
    ids = list(range(10, 10 + len(texts))) if ids is None else ids
    rows = [
        (i, t, [None, "en", "de", "xx"][k % 4], "s", len(t or ""), k % 2 == 0, "r", k, "l") for k, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def stored_frame(spark, tmp_path, texts=None, ids=None):
    path = str(tmp_path / "docs")
    frame(spark, texts, ids).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
