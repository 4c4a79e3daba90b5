"""Operator 4: quality rules with risk-controlled thresholds.

Each rule is a ratio for which more is worse (``RULES``). Cutoffs are chosen for each stratum (language) on one
half of the labelled documents, by a hash of the id: of the cutoffs that reject at most ``alpha / rules`` of the
clean documents there, the one that separates junk best, the most lenient of equals. The rules, the best first,
make a chain of verdicts, each of which rejects what the one before rejects and more. The other half certifies
the chain by fixed-sequence testing: a verdict is certified when an exact binomial bound shows that it rejects at
most ``alpha`` of clean documents at confidence 1 - ``delta``, and the first that fails ends the chain. As the
order is fixed before that half is seen and nothing is tested after a failure, the confidence holds for a
stratum's whole verdict without a correction; it is held stratum by stratum. ``log(delta) / log(1 - alpha)`` = 59
clean documents in that half can certify a verdict; ``certification`` tells which strata stay uncertified.

The bound: with k of n clean holdout documents above a cutoff, P(Bin(n, a) <= k) <= d proves a true rate
below a at confidence 1 - d. The sum runs in log space, so a large n does not underflow.

Toxic words are learned, not listed: on the first half of the labels, words found in ``TOXIC_DOCUMENTS`` toxic
documents or more get the logarithm of their rates in toxic and other documents as weight, less two standard errors,
and those of ``TOXIC_WEIGHT`` or more count, the ``TOXIC_WORDS`` of greatest weight at most. They are learned from a bounded
part of the labels, ``FIT_LABELS`` on average, taken by a hash of the id; cutoffs and bounds use all labels. A document's ``toxic_weight`` is the sum over its distinct words; its rule takes the
weight a word, and its cutoff is certified like any other. Without toxic labels no word has a weight.

Scale: everything about a document is computed in its row, from its whole text, and no text is shuffled: the
labels that teach words are broadcast (their number has a bound), and so are the words learned (likewise). The
labelled rows' ratios (numbers only) are joined to the labels and counted by (stratum, rule, cutoff), with partial
sums before the shuffle. Only those counts, a row for each combination, reach the last aggregate. The confidence
is held within each stratum; with s strata, about s times delta of them may exceed alpha.

Defined cases: null and blank texts have no words and fail the base rule; a null language is a stratum of
its own; a stratum without labels gets no cutoffs; labels that are null or of unknown documents do not
count; a document labelled more than once counts once, by its worst label (``one_label``); other columns of the
labels are not read. An empty labels table leaves the base rule alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.llm.line_dedup import few
from lakescope.llm.shared import SPACE_CLASS, frozen, let, text_or_empty, words

# Symbols of the base counts, the base rule's limits, and the window of repeated words.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: A word is learned as toxic from so many toxic documents at least, and with such a weight: the logarithm of how
#: much more often it is found in toxic documents than in others, less two standard errors.
TOXIC_DOCUMENTS, TOXIC_WEIGHT = 3, 1.0
#: Labels (rows of 16 bytes) from which words are learned, on average, and words learned, at most.
FIT_LABELS, TOXIC_WORDS = 500_000, 20_000

#: Candidate cutoffs of each rule; a document is above one if its ratio exceeds it.
GRID = (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7)

#: Rule: (numerator, denominator) of its ratio.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "word_chars"),
    "toxic": ("toxic_weight", "n_words"),
}
ALPHA, DELTA = 0.05, 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations", "toxic_weight")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the array ``w``.

    Windows are hashed and sorted with their places; the union of the equal ones' spans is summed. All in
    the row, in time n log n.
    """
    starts_of = lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"])), lambda x: x["i"]))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))),
        F.lit(0), lambda a, x: a + x)
    spans = lambda v: let(F.sort_array(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
                          lambda s: let(starts_of(s), covered))
    hashes = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window),
                                   lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
    of = lambda h: F.when(F.size(h) < window, F.lit(0)).otherwise(
        let(hashes(h), lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(spans(v))))
    return let(F.transform(w, lambda x: F.xxhash64(x)), of).cast("long")


def spoken(text: Column) -> Column:
    """The words of a text in lower case, without ASCII marks; one may be empty."""
    return F.split(F.lower(text_or_empty(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic): one row for each labelled document, the worst label where they differ."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def toxic_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (toxic_words, toxic_weights): the words learned as toxic, in order, and their weights, from the
    labelled documents on which cutoffs are chosen. ``docs``: doc_id, text."""
    known = frozen(one_label(labels).filter("toxic is not null").select("doc_id", (F.col("toxic") == 1).cast("long").alias("toxic")).filter(in_fit(F.col("doc_id"))))
    share = min(1.0, FIT_LABELS / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    held = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    n = held.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"), F.count(F.lit(1)).alias("n_all"))
    each = held.select("toxic", F.explode(F.array_distinct(spoken(F.col("text")))).alias("word")).filter("word != ''").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("k")).filter(F.col("t") >= TOXIC_DOCUMENTS)
    rate = lambda k, of: (k + F.lit(0.5)) / (of + F.lit(1))
    weight = F.log(rate(F.col("t"), F.col("n_toxic")) / rate(F.col("k") - F.col("t"), F.col("n_all") - F.col("n_toxic")))
    error = F.sqrt(1 / (F.col("t") + F.lit(0.5)) + 1 / (F.col("k") - F.col("t") + F.lit(0.5)))
    learned = each.crossJoin(F.broadcast(n)).withColumn("weight", F.round(weight - 2 * error, 2)).filter(F.col("weight") >= TOXIC_WEIGHT)
    learned = learned.select("word", "weight").orderBy(F.desc("weight"), "word").limit(TOXIC_WORDS)
    one = learned.agg(F.sort_array(F.collect_list(F.struct("word", "weight"))).alias("x"))
    return frozen(one.select(F.col("x.word").alias("toxic_words"), F.col("x.weight").alias("toxic_weights")))


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "", toxic: DataFrame | None = None) -> DataFrame:
    """Adds the counts that the rules use, named ``prefix`` and COUNTS, from each row's whole text.
    ``toxic``: the row of ``toxic_words``; without it no word is toxic."""
    t = text_or_empty(F.col(text_col))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    by_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                  (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    list_, weights = F.col(f"{prefix}_learned.hashes"), F.col(f"{prefix}_learned.toxic_weights")
    hashes = lambda x: F.transform(x, lambda w: F.xxhash64(w))
    summed = lambda found: F.aggregate(found, F.lit(0.0), lambda a, w: a + F.get(weights, F.array_position(list_, w).cast("int") - 1))
    score = F.lit(0.0) if toxic is None else F.round(let(F.array_intersect(list_, hashes(spoken(F.col(text_col)))), summed), 2)
    held = f"{prefix}_counts"
    one = F.struct(
        let(words(F.col(text_col)), by_words).alias("w"), let(lines, by_lines).alias("l"),
        _without(t, f"[{SPACE_CLASS}]+").alias("word_chars"), (F.size(F.split(t, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
        _without(t, "[^A-Z]+").alias("n_capitals"), (F.size(F.split(t, "!")) - 1).cast("long").alias("n_exclamations"),
        score.alias("toxic_weight"))
    place = {"n_words": "w.", "n_repeat_words": "w.", "n_lines": "l.", "n_dup_lines": "l."}
    if toxic is not None:
        docs = docs.crossJoin(F.broadcast(toxic.select(F.struct(hashes(F.col("toxic_words")).alias("hashes"), "toxic_weights").alias(f"{prefix}_learned"))))
    # the generator keeps the counts from being computed again for each column taken from them
    return docs.withColumn(held, F.explode(F.array(one))).withColumns(
        {f"{prefix}{c}": F.col(f"{held}.{place.get(c, '')}{c}") for c in COUNTS}).drop(held, f"{prefix}_learned")


def ratio(rule: str, prefix: str = "") -> Column:
    over, under = (F.col(prefix + c) for c in RULES[rule])
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def base_failed(prefix: str = "") -> Column:
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (again * 100 > n * MAX_REPEAT_PERCENT)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): the terms' logarithms follow from one another; scaled by the largest, the last."""
    import math

    odds, first = math.log(p) - math.log1p(-p), math.log1p(-p)
    acc = F.struct((n * F.lit(first)).alias("log"), F.lit(1.0).alias("sum"))  # sum: in units of exp(log)

    def step(a, i):
        up = F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct((a["log"] + up).alias("log"), (a["sum"] * F.exp(-up) + F.lit(1.0)).alias("sum"))

    got = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), acc, step)
    return F.when(k >= 1, F.exp(got["log"]) * got["sum"]).otherwise(F.exp(n * F.lit(first)))


def stratum(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def chains(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum with a chain: stratum, chain (rule, cutoff; the best first), n_clean (clean
    documents of the certifying half), certified (rules from the chain's start that are certified together).

    ``counted``: doc_id, stratum and COUNTS; ``labels``: doc_id, quality, toxic. Clean: quality 1, not
    toxic. Junk: quality 0 or toxic. Documents that the base rule rejects do not count.
    """
    clean = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    junk = (F.col("quality") == 0) | (F.col("toxic") == 1)
    ratios = F.array(*[F.struct(F.lit(r).alias("rule"), ratio(r).alias("ratio")) for r in RULES])
    held = frozen(counted.filter(~base_failed()).join(
        one_label(labels).select("doc_id", clean.alias("clean"), junk.alias("junk")).filter("clean or junk"), "doc_id").select(
        "stratum", "clean", "junk", in_fit(F.col("doc_id")).alias("fit"), ratios.alias("ratios")))
    each = held.filter("fit").select("stratum", "clean", "junk", F.explode("ratios").alias("r")).select(
        "stratum", "clean", "junk", "r.rule", F.explode(F.transform(
            F.array(*[F.lit(c) for c in GRID]), lambda c: F.struct(c.alias("cutoff"), (F.col("r.ratio") > c).alias("above")))).alias("c"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    # a labelled document counts in every (rule, cutoff): sums by task come before the shuffle
    tests = each.groupBy("stratum", "rule", F.col("c.cutoff").alias("cutoff")).agg(
        one(F.col("clean")).alias("n_clean"), one(F.col("junk")).alias("n_junk"),
        one(F.col("clean") & F.col("c.above")).alias("clean_above"), one(F.col("junk") & F.col("c.above")).alias("junk_above"))
    gain = F.col("junk_above") / F.greatest("n_junk", F.lit(1)) - F.col("clean_above") / F.greatest("n_clean", F.lit(1))
    fit = tests.filter(F.col("clean_above") <= F.col("n_clean") * F.lit(alpha / len(RULES))).withColumn("gain", gain).filter("gain > 0")
    best = fit.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b"))
    chain = frozen(best.groupBy("stratum").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("b.gain")).alias("loss"), "rule", F.col("b.cutoff").alias("cutoff")))).alias("chain")))
    above = lambda c: F.exists("ratios", lambda r: (r["rule"] == c["rule"]) & (r["ratio"] > c["cutoff"]))
    first = F.array_position(F.transform("chain", above), True)  # the chain's first rule that rejects it; 0: none
    by = held.filter("clean and not fit").join(chain, "stratum").select("stratum", first.alias("first")).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_clean"), *[one(F.col("first").between(1, k + 1)).alias(f"above_{k}") for k in range(len(RULES))])
    # k above a * n can't be certified, and its sum of terms is never begun
    tail = lambda k: F.when(F.col(k) <= F.col("n_clean") * F.lit(alpha), binomial_tail(F.col(k), F.col("n_clean"), alpha) <= F.lit(delta)).otherwise(False)
    passed = F.array(*[tail(f"above_{k}") for k in range(len(RULES))], F.lit(False))
    certified = F.least(F.array_position(passed, False).cast("int") - 1, F.size("chain"))
    return chain.join(by, "stratum", "left").select(
        "stratum", "chain", F.coalesce("n_clean", F.lit(0)).cast("long").alias("n_clean"), F.when(F.col("n_clean") > 0, certified).otherwise(0).alias("certified"))


def in_fit(doc_id: Column) -> Column:
    """True for documents of the half on which cutoffs are chosen; the others certify them."""
    return F.xxhash64(doc_id).bitwiseAND(F.lit(1)) == 0


def thresholds(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: (stratum, rule, cutoff)."""
    c = chains(counted, labels, alpha, delta).filter("certified > 0")
    return c.select("stratum", F.explode(F.slice("chain", F.lit(1), F.col("certified"))).alias("c")).select("stratum", "c.rule", "c.cutoff")


def certification(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """For each stratum of the documents: n_documents, rules chosen, rules certified (0: the base rule alone)."""
    of = chains(counted, labels, alpha, delta).select("stratum", F.size("chain").alias("chosen"), "certified")
    return counted.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_documents")).join(of, "stratum", "left").fillna(0, ["chosen", "certified"])


def cutoffs_by_stratum(cuts: DataFrame) -> DataFrame:
    """One row for each stratum with a column cut_<rule> for each rule (null: the rule rejects nothing)."""
    return cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def verdict(prefix: str = "") -> Column:
    """True where no certified cutoff of the row's stratum is exceeded (columns cut_<rule> are at hand)."""
    above = reduce(lambda a, b: a | b, [F.coalesce(ratio(r, prefix) > F.col(f"{prefix}cut_{r}"), F.lit(False)) for r in RULES])
    return ~base_failed(prefix) & ~above


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, lang, COUNTS, base_failed, kept. ``docs``: doc_id, text, lang."""
    toxic = toxic_words(docs, labels)
    counted = frozen(with_counts(docs.select("doc_id", "lang", "text"), toxic=toxic).drop("text").withColumn("stratum", stratum(F.col("lang"))))
    cuts = few(frozen(cutoffs_by_stratum(thresholds(counted, labels, alpha, delta))))
    return counted.join(cuts, "stratum", "left").select(
        "doc_id", "lang", *COUNTS, base_failed().alias("base_failed"), verdict().alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the verdict keeps, with their columns.

    The documents are written once with their counts; the cutoffs are found from the counts alone, and the
    verdict is a filter on what was written. No text is shuffled.
    """
    toxic = toxic_words(docs, labels)
    # the row as one struct, so that no column's name can clash with one used here
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id"), F.col("text"), stratum(F.col("lang")).alias("stratum"))
    counted = frozen(with_counts(d, toxic=toxic).drop("text"))
    cuts = few(frozen(cutoffs_by_stratum(thresholds(counted.drop("doc"), labels, alpha, delta))))
    return counted.join(cuts, "stratum", "left").filter(verdict()).select("doc.*")
