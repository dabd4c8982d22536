"""Documents with every awkward case: nulls, empty and long texts, copies, ties, clashing columns."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, body string, "
          "digest string, n_words bigint, label string, locator string, bucket string, node string")


def rows(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    far = base.split()[:60] + text(60).split()
    texts = [base, base, " ".join(near), " ".join(far), base.replace(" ", "  "), None, "", " \n\t ", "one", "one two three",
             text(20000), "la " * 300, "\n".join(["same line here"] * 12 + [text(60)]), "日本語 текст 🙂 é ñ " * 20, text(49), text(50),
             text(80), text(80), " ".join(f"w{i} ###$$" for i in range(60)), "Ä́ X Y Z <|endoftext|> token = 'abcdef0123456789abcdef0123456789'"]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, "en", [None, "a", "b", "c"][i % 4], 7, 1, "x", "d", 99, "l", "loc", "bu", "no"))
    out.append((None, base, None, None, None, None, None, None, None, None, None, None, None))
    out.append((None, text(70), None, None, None, None, None, None, None, None, None, None, None))
    out += [out[16], out[16]]  # repeated rows
    out.append((3, text(90), "fr", "a", 1, 1, "y", "e", 1, "m", "l2", "b2", "n2"))  # an id that is used twice
    return out


def frame(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
