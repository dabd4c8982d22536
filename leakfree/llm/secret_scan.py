"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

Two first-order models over an alphabet of 68 characters are trained from labelled samples: one of
random strings, one of ordinary ones: identifiers, paths, slugs and dotted names.  Values that the fixed
patterns find are random.  Ordinary strings are the corpus' other long runs and names put together from its
words the way names are written (camelCase, snake_case, UPPER_CASE, hyphens, paths, dots, with numbers), since prose
alone would make every capital, digit and underscore inside a name look random.  The ordinary model mixes pair
counts with a model of character classes, so that letters seldom seen together aren't evidence by themselves.

A run of at least RUN_LEAST (20) of these characters (a full stop only between others) is a secret if its
log-likelihood ratio exceeds THRESHOLD; shorter ones hold too little evidence and are left to the patterns.  Fixed
patterns (assignments, access keys, hex runs) are matched besides; a Markov span that overlaps one of theirs is not
reported again.

Positions: a text is split at a pattern's matches, so a match starts where the pieces and
matches before it end; positions are code points, ends are exclusive.

Defined results: a null text is the empty text, without spans; null ids and repeated rows pass
through, a row each; an empty table gives no rows; an empty training sample gives a ratio of 0
everywhere, so no Markov spans; other columns play no part; texts are scanned whole, whatever their length.
DataFrame functions only, no shuffle of texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakfree.llm.common import let, sampled, whole, word_array

#: The patterns of each kind, written so that only whole matches of the least length remain.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
RUN_LEAST = 20
RUN = rf"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_=.-]{{{RUN_LEAST}}})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*"
#: Log-likelihood ratio (nats) beyond which a run counts as random.
THRESHOLD = 10.0
#: Documents (about, by a hash of the id) from which the labelled sample is drawn.
SAMPLE_DOCS = 20_000
#: Random strings are flat: counts that every pair starts with.
ALPHA_RANDOM = 1.0
#: Share of the class model in the ordinary one.
CLASS_SHARE = 0.25


def _spans(found: Column, pieces: Column, kind: int) -> Column:
    """Structs (start, kind, end) of matches, from the matches and the pieces between them."""
    steps = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(F.concat(acc["out"], F.array(one)).alias("out"), end.alias("at"))

    zero = F.struct(none.alias("out"), F.lit(0).alias("at"))
    return F.when(F.size(found) > 0, F.aggregate(steps, zero, add, lambda a: a["out"])).otherwise(none)


def _with_spans(df: DataFrame, name: str, pattern: str, kind: int, good: Column | None = None) -> DataFrame:
    """Column ``name``: the spans of a pattern in ``_t`` (of those matches for which good(i) holds)."""
    df = df.withColumn("_m", F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
    pieces = F.when(F.size("_m") > 0, F.split("_t", pattern)).otherwise(F.array(F.lit("")))
    df = df.withColumn("_p", pieces).withColumn("_s", _spans(F.col("_m"), F.col("_p"), kind))
    if good is None:
        return df.withColumnRenamed("_s", name).drop("_m", "_p")
    df = df.withColumn("_g", F.when(F.size("_m") > 0, good).otherwise(F.array().cast("array<boolean>")))
    return df.withColumn(name, F.filter("_s", lambda x, i: F.get(F.col("_g"), i))).drop("_m", "_p", "_s", "_g")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _t and the spans of the fixed patterns: _assign, _access, _hex."""
    df = docs.select("doc_id", whole(text).alias("_t"))
    long = F.transform(F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    df = _with_spans(df, "_assign", ASSIGN, 0, long)
    return _with_spans(_with_spans(df, "_access", ACCESS, 1), "_hex", HEX, 2)


#: One name is made of three consecutive words out of so many.
NAME_EVERY = 30


def _names(words: Column) -> Column:
    """Names of three consecutive words each, written in the usual ways."""
    plain = lambda three, k: F.lower(F.regexp_replace(F.get(three, F.lit(k)), "[^A-Za-z]", ""))

    def name(abc: Column, i: Column) -> Column:
        a, b, c = abc["a"], abc["b"], abc["c"]
        number = ((i * 37) % 1000).cast("string")
        styles = [F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("_", a, b, c), F.upper(F.concat_ws("_", a, b, c)),
                  F.concat_ws("-", a, b, c), F.concat(a, F.lit("/"), b, F.lit("_"), c, F.lit("."), F.substring(b, 1, 2)),
                  F.concat_ws(".", a, b, F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.lit("V"), number),
                  F.concat(a, F.lit("-"), b, F.lit("-"), number), F.concat(F.upper(F.substring(a, 1, 3)), F.initcap(b), F.lit("_"), number),
                  F.concat(F.lit("https-www/"), a, F.lit("/"), b, F.lit("-"), c)]
        turn = F.floor(i / NAME_EVERY) % len(styles)
        out = F.lit("")
        for k, style in enumerate(styles):
            out = F.when(turn == k, style).otherwise(out)
        return out

    def made(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3, F.lit(NAME_EVERY))
        return F.when(F.size(w) >= 3, F.transform(places, lambda i: let(F.slice(w, i + 1, 3), lambda t: name(
            F.struct(plain(t, 0).alias("a"), plain(t, 1).alias("b"), plain(t, 2).alias("c")), i)))).otherwise(F.array().cast("array<string>"))

    return let(words, made)


def labelled_samples(docs: DataFrame, text: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """(string, label): values that fixed patterns find are random (1); plain words, names made of the text's words and
    long runs beside the patterns' matches are ordinary (0); from about ``most`` documents, chosen by a hash of their id."""
    chosen = sampled(docs, most, 3)
    t = whole(text)
    random = F.concat(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))
    plain = F.filter(word_array(t), lambda w: w.rlike("^[A-Za-z]{6,}[.,]?$"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.concat(plain, _names(word_array(t)), F.regexp_extract_all(rest, F.lit(RUN), F.lit(0)))
    return (chosen.select(F.explode(random).alias("string"), F.lit(1).alias("label")).where("length(string) >= 16")
            .unionByName(chosen.select(F.explode(ordinary).alias("string"), F.lit(0).alias("label"))))


#: Classes of the alphabet's characters: lower case, upper case, digits, and each sign by itself.
CLASSES = [0] * 26 + [1] * 26 + [2] * 10 + list(range(3, 9))


def _ordinary(c: np.ndarray) -> np.ndarray:
    """Pair probabilities by row: counts, mixed with class pairs times the characters' shares of their class."""
    k, of = len(ALPHABET), np.eye(max(CLASSES) + 1)[CLASSES]
    between = of.T @ c @ of + 0.5
    share = c.sum(axis=0) + c.sum(axis=1) + 1.0
    share /= (of.T @ share)[CLASSES]
    by_class = (between / between.sum(axis=1, keepdims=True))[np.ix_(CLASSES, CLASSES)] * share
    seen = c.sum(axis=1, keepdims=True)
    weight = (1 - CLASS_SHARE) * seen / (seen + k)  # a character that is seldom seen leans on its class
    return weight * c / np.maximum(seen, 1) + (1 - weight) * by_class


def train(samples: DataFrame) -> np.ndarray:
    """Log-ratio table, one entry per pair of alphabet characters.  Only the pair counts (at most
    2 * 68 * 68 rows) come to the driver."""
    k = len(ALPHABET)
    chars = F.filter(F.split("string", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    df = samples.select("label", chars.alias("c")).where("size(c) > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.col("c")[i - 1], F.col("c")[i]))
    counts = np.zeros((2, k, k))
    for r in df.select("label", F.explode(pairs).alias("ab")).groupBy("label", "ab").count().collect():
        counts[r["label"], ALPHABET.index(r["ab"][0]), ALPHABET.index(r["ab"][1])] = r["count"]
    if not counts.any():
        return np.zeros(k * k)

    random = (counts[1] + ALPHA_RANDOM) / (counts[1].sum(axis=1, keepdims=True) + ALPHA_RANDOM * k)
    return (np.log(random) - np.log(_ordinary(counts[0]))).ravel()


def ratio(run: Column, table: np.ndarray) -> Column:
    """Log-likelihood ratio of a string over the alphabet."""
    k = len(ALPHABET)
    codes = [0] * 128
    for i, c in enumerate(ALPHABET):
        codes[ord(c)] = i
    lookup, cells = F.lit(np.array(codes, dtype=np.int64)), F.lit(table)
    code = lambda c: F.get(lookup, F.ascii(c))

    def add(acc, c):
        now = code(c)
        gain = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(cells, acc["last"] * k + now))
        return F.struct((acc["sum"] + gain).alias("sum"), now.alias("last"))

    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("last"))
    return F.aggregate(F.split(run, ""), zero, add, lambda a: a["sum"])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, found (array of start, kind, end in order, kind an index of KINDS), and the strings."""
    df = base_spans(docs, text).withColumn("_base", F.concat("_assign", "_access", "_hex"))
    random = F.transform(F.regexp_extract_all("_t", F.lit(RUN), F.lit(0)), lambda r: (F.length(r) >= RUN_LEAST) & (ratio(r, table) > threshold))
    df = _with_spans(df, "_markov", RUN, 3, random)
    clear = F.filter("_markov", lambda m: ~F.exists(
        F.col("_base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return df.select("doc_id", "_t", "_assign", "_access", "_hex", "_base", F.array_sort(F.concat("_base", clear)).alias("found"))


def report(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """One row per document: counts, digest of the fixed patterns' spans, and all spans as text."""
    s = scan(docs, table, threshold, text)
    return s.select("doc_id", *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
                    F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
                    _joined(F.col("found")).alias("spans"),
                    (F.size("found") - F.size("_base")).cast("bigint").alias("n_markov"))


def strings(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end and the matched string."""
    names = F.array(*[F.lit(k) for k in KINDS])
    s = scan(docs, table, threshold, text).select("doc_id", "_t", F.explode("found").alias("s"))
    return s.select("doc_id", F.get(names, F.col("s.kind")).alias("kind"), F.col("s.start").alias("start"),
                    F.col("s.end").alias("end"),
                    F.col("_t").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("string"))
