"""Quality rules on DataFrame functions alone: surface counts, then divergence from language references.

A document's character-class histogram and its histogram over common words of its language are compared with those of
all documents of that language by Jensen-Shannon distance; short documents have no reliable histogram and are not
compared. The references are sums over the whole corpus for each language of `COMMON_WORDS` and one for all others, so
they have a fixed number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD_GAP, durable

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "be", "by", "this"],
    "fr": ["le", "la", "de", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "par", "pour", "sur"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para"],
}
N_COMMON = 16
CLASSES = ("lower", "upper", "space", "digit", "mark", "other")
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def words_of(text: Column) -> Column:
    """The words of a text; none for null or white space alone."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP, -1))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def common_counts(text: Column, lang: Column) -> Column:
    """How often each of the language's common words stands in the text, in order, and how many words are none of them."""
    found = F.array().cast("array<string>")
    listed = F.array().cast("array<string>")
    for code, words in COMMON_WORDS.items():
        pattern = rf"(?<![\p{{L}}])(?:{'|'.join(words)})(?![\p{{L}}])"
        found = F.when(lang == code, F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).otherwise(found)
        listed = F.when(lang == code, F.array(*map(F.lit, words))).otherwise(listed)
    return found.alias("found"), listed.alias("listed")


def features(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document the `keep` columns, the surface counts and both histograms (classes, common: arrays of double)."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keep, body.alias("_t"), F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise("").alias("_lang"))
    # what is left after each class of characters is taken out, the commonest first
    d = d.withColumn("_r1", without(F.col("_t"), r"\p{Ll}+"))
    d = d.withColumn("_r2", without(F.col("_r1"), WORD_GAP))
    d = d.withColumn("_r3", without(F.col("_r2"), r"\p{Lu}+"))
    d = d.withColumn("_r4", without(F.col("_r3"), r"[.,;:!?'\"()-]+"))
    d = d.withColumn("_r5", without(F.col("_r4"), r"\p{Nd}+"))
    size = {k: F.length(f"_{k}") for k in ("t", "r1", "r2", "r3", "r4", "r5")}
    found, listed = common_counts(F.col("_t"), F.col("_lang"))
    d = d.select(
        *keep,
        "_lang",
        "_t",
        words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        found,
        listed,
        (size["t"] - size["r1"] + size["r2"]).cast("long").alias("word_chars"),
        (size["r5"] - F.length(without(F.col("_r5"), r"[#*$%&|<>]+"))).cast("long").alias("n_symbols"),
        F.array(size["t"] - size["r1"], size["r2"] - size["r3"], size["r1"] - size["r2"], size["r4"] - size["r5"], size["r3"] - size["r4"], size["r5"]).cast("array<double>").alias("classes"),
    )
    n = F.size("_w")
    # the hashes of all 3-word windows; only where some are equal are they sorted, each with its place, to find which
    d = d.withColumn("_h", F.when(n >= 3, F.transform(F.slice("_w", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))))
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(placed)))
    d = d.withColumn("_common", F.transform("listed", lambda w: F.size(F.filter("found", lambda x: x == w)).cast("double")))
    again = F.filter("_s", lambda x, i: (x.h == F.get("_s", i - 1).h) | (x.h == F.get("_s", i + 1).h))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x.p, x.p + 1, x.p + 2))))
    return d.select(
        *keep,
        "_lang",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        "classes",
        F.when(F.size("_common") > 0, F.concat("_common", F.array((n - F.size("found")).cast("double")))).alias("common"),
    )


def references(d: DataFrame) -> DataFrame:
    """Per language (and '' for all others) the summed histograms: a fixed number of rows."""
    sums = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(n)))
    return d.groupBy("_lang").agg(sums("classes", len(CLASSES)).alias("ref_classes"), sums("common", N_COMMON + 1).alias("ref_common"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of two arrays of counts; null if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    ta, tb = total(a), total(b)

    def term(x, y):
        p, q = F.coalesce(x, F.lit(0.0)) / ta, F.coalesce(y, F.lit(0.0)) / tb
        return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2

    return F.when((ta > 0) & (tb > 0), F.sqrt(F.greatest(total(F.zip_with(a, b, term)), F.lit(0.0))))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), min_compared: int = 50, max_classes: float = 0.27, max_common: float = 0.36) -> DataFrame:
    """Per document the `keep` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    js_classes and js_common.

    base_failed: under `MIN_WORDS` words, or over half of the words in 3-word windows that come twice. Else a document is
    kept unless it has `min_compared` words or more and a histogram is farther from its language's than allowed. A null
    text has no words and fails; a language that isn't listed (or null) is compared by characters alone, with all such
    documents. Repeated rows are judged alike; other columns of docs are left behind, whatever their names.
    """
    d = durable(features(docs, text, lang, keep), "rules")
    d = d.join(F.broadcast(references(d)), "_lang")  # one row per listed language, and one
    compared = F.col("n_words") >= min_compared
    d = d.withColumn("js_classes", F.when(compared, js_distance(F.col("classes"), F.col("ref_classes")))).withColumn("js_common", F.when(compared, js_distance(F.col("common"), F.col("ref_common"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    far = (F.coalesce("js_classes", F.lit(0.0)) > max_classes) | (F.coalesce("js_common", F.lit(0.0)) > max_common)
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "js_classes", "js_common")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns, whatever their names."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_of"))
    return judge(whole, "_text", "_of", ("_row",), **limits).where("kept").select("_row.*")
