"""Documents with the odd cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp long, n_lines int, kept string, score double, bucket int, verdict string, own_hash string, text_hash int, removed string, `group` int, hash string, n int, text_of string, base_of string, more_of string, all_of string, number string, known string, __text string, __base string, __all string, __text_hash string, __n string, __verdict string, `key` int, word string, part string"
SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo zu el an or im us".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def row(doc_id, text):
    """Extra columns have names that operators use inside."""
    return (doc_id, text, "en", "s", None if text is None else len(text), "x", 7, 3, "no", 0.5, 1, "v", "o", 5, "r", 6, "h", 8, "t", "b", "m", "a", "9", "k", "__t", "__b", "__a", "__h", "__n", "__v", 2, "w", "p")


def odd_documents(spark):
    rng = random.Random(3)
    base = words(rng, 300)
    long_ = "\n".join(words(rng, 60) for _ in range(400))
    texts = [
        (1, base), (2, base), (3, base + " more words"), (4, words(rng, 200)), (5, None), (6, ""), (7, " \t\n\x0b "), (8, "one"), (9, "One two"), (10, long_), (11, "x" * 30_000), (None, words(rng, 80)), (None, None),
        (12, words(rng, 80)), (12, words(rng, 80)), (13, base), (13, base), (14, "é ünï 你好 🎉 <|endoftext|> \x1c   İ Σ"), (15, "a\nb\nc\na\nb\nc\n\n"),
    ]
    return spark.createDataFrame([row(i, t) for i, t in texts], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows, partitions=3):
    return spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(partitions)
