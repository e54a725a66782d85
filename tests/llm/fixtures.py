"""Small tables with everything that can be odd about documents."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, fp string, kept string, toxic string, word string, size string, taken string"

A = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees near the quiet river bank and sing "
B = "der schnelle braune fuchs springt ueber den faulen hund waehrend sieben weise eulen von alten eichen am stillen fluss zusehen "


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ka", "lo", "mi", "ter", "un", "sha", "pe", "dor")) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    shared = words(70, 99)
    texts = [
        (1, A * 3, "en", "s0"), (2, A * 3, "en", "s0"), (3, A * 3 + "once more", "en", "s1"), (4, B * 2, "de", "s1"), (5, B * 2, "de", None), (6, None, "en", "s0"), (7, "", "de", "s2"),
        (8, " \t\n ", None, "s2"), (9, "héllo wörld 日本語 😀 <|endoftext|>", None, None), (9, "héllo wörld 日本語 😀 <|endoftext|>", None, None), (None, A * 3, "en", "s0"), (None, "alone", None, "s0"),
        (10, words(40, 1) + " " + shared + " " + words(30, 2), "en", "s3"), (11, words(20, 3) + " " + shared + " " + words(50, 4), "en", "s3"), (12, words(120, 5), "en", "s3"),
        (13, "x" * 5000, "en", "s4"), (14, words(9000, 6), "en", "s4"), (15, "12 34 !!", "en", "s4"), (-3, "İstanbul ǅ ß wide\x0bspace", "tr", "s5"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "d", "r", "f", "k", "t", "w", "z", "n") for i, t, lang, s in texts]


def odd(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
