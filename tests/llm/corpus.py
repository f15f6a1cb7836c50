"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns whose names the operators use inside
EXTRA = ["id", "key", "n", "size", "bucket", "part", "tokens", "set", "sig", "node", "spans", "group", "level_0", "at", "score"]


def prose(rng, words, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(words))


def documents():
    rng = random.Random(5)
    rows, doc = [], 0
    for lang, alphabet in (("en", "the andof"), ("fr", "éàçleou"), ("de", "üöschein")):
        alphabet = alphabet.replace(" ", "")
        for i in range(40):
            rows.append((doc, prose(rng, rng.randint(1, 120), alphabet), lang, f"src{doc % 5}", 1))
            doc += 1
    base = prose(rng, 150, "abcdefg")
    for i in range(45):  # near copies, more than a leaf holds
        words = base.split()
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((doc, " ".join(words), "en", "src1", 1))
        doc += 1
    for text in [base] * 6 + [base.upper(), base.replace(" ", "\n\t ")]:
        rows.append((doc, text, "en", "src1", 1))
        doc += 1
    for text in (None, "", "   \n", "12 34 !?", "word", "WORD", "two words", "aaaaaaaa" * 300, "𝒜𝒷 𐐀𐐁 ünïcode", "no letters"[:0]):
        rows.append((doc, text, None, None, None))
        doc += 1
    rows.append((doc, prose(rng, 6000, "abcdefghijkl"), "en", "src0", 1))
    rows.append((doc + 1, "x" * 5000 + " " + prose(rng, 50, "rstuv"), None, "src0", 1))
    return rows


def with_extra(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])
