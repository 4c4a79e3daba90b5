"""Operator 7: line dedup by a deletion-neighbourhood join, with word edits.

Two lines are alike if their words are equal or one word inserted, removed or replaced makes them so (for
lines of ``NEAR_WORDS`` words or more: one edit then leaves three quarters of the words or more; shorter lines
are alike only if equal). A line is dropped if an alike line stands earlier in the corpus, by (doc_id, line); the earliest stays.

Each line emits its variants, itself and itself without its p-th word, as hashed keys:

- lines that share (variant, p) differ in word p alone, so only the earliest of such a group matters and a
  minimum for each key finds it: no pairs inside a group are made;
- a line that equals another's variant has one word less; each variant meets at most one such line.

What is found is verified on the words. Only lines that can have a partner emit variants: one edit leaves a
line's first or second half as it is, so such a line shares a half's hash with another line. That test is
exact, and most lines fail it.

Scale: equal lines are one row with their earliest place, by a map-side minimum, so a line that fills a
third of all rows costs one row for each task. Shuffles carry hashes and ranks. Texts are read again only
where a line needs its words, and once to take the dropped lines out. What those readings meet is
broadcast if it has at most ``BROADCAST_ROWS`` rows (``BROADCAST_DOCS`` documents) by count, and joined by a
shuffle otherwise.

Defined cases: null text has no lines and stays null; lines without words stay; a null id comes last in the
order; rows with one id and line number are equally early and none drops the other; a line is judged whole,
however long it is. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.llm.shared import SPACE_CHARS, SPACE_CLASS, frozen, let, ranked

EXACT_WORDS, NEAR_WORDS = 1, 4
#: Lines are judged whole: no line has more words than the longest array.
PIECE_WORDS = (1 << 31) - 1
#: Words of a block of running values.
BLOCK_WORDS = 128
#: Rows (of some 40 bytes) that may be broadcast, and documents with their dropped lines.
BROADCAST_ROWS, BROADCAST_DOCS = 1_000_000, 200_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def blanks(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))


def odd(line: Column) -> Column:
    """True unless single blanks are all the white space, between words only."""
    found = line.startswith(" ") | line.endswith(" ")
    for c in ("  ", "\t", "\x0b", "\f", "\r"):
        found = found | line.contains(c)
    return found


def canonical(line: Column) -> Column:
    """A line's words with one blank between them; equal for lines with equal words."""
    return F.when(odd(line), F.regexp_replace(F.btrim(line, F.lit(SPACE_CHARS)), f"[{SPACE_CLASS}]+", " ")).otherwise(line)


def halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the first and the second half of a canonical line, for its n words and for one less."""
    out = []
    upto = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    for less in (0, 1):
        head = F.floor((n - less) / 2).cast("int")
        tail = n - less - head
        out += [F.xxhash64(n - less, upto(head)), F.xxhash64(less - n, upto(-tail))]
    return out


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line of EXACT_WORDS words or more: place (null ids last), t (its text's hash), its 128-bit hash
    (a, b), and the hashes of its halves where it has NEAR_WORDS words or more."""
    t, line = F.col(text_col), F.col("line")
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("t"), F.posexplode(lines_of(t)).alias("no", "text"))
    # the generator keeps the filter from computing the line once more
    d = d.select("doc_id", "t", "no", F.explode(F.array(canonical(F.col("text")))).alias("line"))
    d = d.withColumn("n", blanks(line) + F.when(line == "", 0).otherwise(1)).filter(F.col("n") >= EXACT_WORDS)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "no")
    half = [F.when(F.col("n") >= NEAR_WORDS, x).alias(f"h{i}") for i, x in enumerate(halves(line, F.col("n")))]
    return d.select(place.alias("place"), "t", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), *half)


def _appended(z: Column) -> Column:
    return F.aggregate(z, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.get(acc, F.size(acc) - 1).bitwiseXOR(x)))


def running(z: Column) -> Column:
    """Exclusive or of the first 0, 1, ... values of an array that isn't empty. Each value appended copies those
    before it, so long arrays go by blocks, whose totals run in the same way."""
    def by_block(within, before):
        moved = F.transform(within, lambda w, k: F.transform(F.slice(w, F.lit(2), F.size(w) - 1), lambda x: x.bitwiseXOR(F.get(before, k))))
        return F.concat(F.array(F.lit(0).cast("long")), F.flatten(moved))

    def of(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK_WORDS).cast("int")),
                             lambda k: _appended(F.slice(v, k * BLOCK_WORDS + 1, BLOCK_WORDS)))
        long = let(blocks, lambda within: let(_appended(F.transform(within, lambda w: F.element_at(w, -1))), lambda before: by_block(within, before)))
        return F.when(F.size(v) > BLOCK_WORDS, long).otherwise(_appended(v))

    return let(z, of)


def _variants(lines: DataFrame) -> DataFrame:
    """(v, p, rank): a hash of the line itself (p = -1) and of the line without its p-th word.

    The hash is the exclusive or of hashes of (word, place), so all variants follow from running values: the
    words before p count at their own places, those after it one place earlier."""
    at = lambda less: running(F.transform(F.col("words"), lambda x, i: F.xxhash64(x, i - less)))

    def each(own, moved):
        last = F.size(own) - 1
        v = lambda p: F.get(own, p).bitwiseXOR(F.get(moved, last)).bitwiseXOR(F.get(moved, p + 1))
        gone = F.transform(F.sequence(F.lit(0), last - 1), lambda p: F.struct(v(p).alias("v"), p.alias("p")))
        return F.concat(F.array(F.struct(F.get(own, last).alias("v"), F.lit(-1).alias("p"))), gone)

    all_ = let(at(0), lambda own: let(at(1), lambda moved: each(own, moved)))
    return frozen(lines.select("rank", F.explode(all_).alias("x")).select("x.v", "x.p", "rank"))


def near_lines(lines: DataFrame) -> DataFrame:
    """(rank) of the lines with an earlier line one word edit away. ``lines``: rank (by place), words."""
    v = _variants(lines)
    gone = v.filter("p >= 0")
    # a group that shares a variant and the place of its missing word: its earliest line decides
    earliest = gone.groupBy("v", "p").agg(F.min("rank").alias("other"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    same = gone.join(earliest, ["v", "p"]).filter("other < rank").select("rank", "other")
    plain = v.filter("p = -1").select("v", F.col("rank").alias("short"))
    met = frozen(gone.join(plain, "v").select("rank", "short"))
    longer = met.filter("short < rank").select("rank", F.col("short").alias("other"))
    shorter = met.filter("rank < short").groupBy(F.col("short").alias("rank")).agg(F.min("rank").alias("other"))
    found = same.unionByName(longer).unionByName(shorter).groupBy("rank", "other").agg(F.lit(1).alias("one"))
    own = lines.select("rank", F.col("words").alias("x"))
    others = lines.select(F.col("rank").alias("other"), F.col("words").alias("y"))
    return found.join(own, "rank").join(others, "other").filter(one_edit(F.col("x"), F.col("y"))).select("rank").distinct()


def one_edit(x: Column, y: Column) -> Column:
    """True if at most one insertion, removal or replacement makes the arrays equal: what the common start
    and the common end leave over is at most one element on each side."""
    n, m = F.size(x), F.size(y)
    short = F.least(n, m)
    differ = lambda a, b: F.coalesce(F.array_min(F.filter(F.transform(a, lambda v, i: F.when(v != F.get(b, i), i)), lambda i: i.isNotNull())), short)
    start = differ(F.slice(x, F.lit(1), short), y)
    end = differ(F.slice(F.reverse(x), F.lit(1), short), F.reverse(y))
    left = F.greatest(n, m) - F.least(start + end, short)
    return (F.abs(n - m) <= 1) & (left <= 1)


def few(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks written rows for a broadcast if they are at most ``limit``."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def able_lines(lines: DataFrame) -> DataFrame:
    """(rank, a, b, place): the lines of which a half occurs in another line too, in the order of places."""
    half = lines.filter(F.col("h0").isNotNull()).select("node", F.explode(F.array_distinct(F.array("h0", "h1", "h2", "h3"))).alias("half"))
    met = frozen(half.groupBy("half").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("x"), F.max("node").alias("y")).filter("k > 1"))
    # a group of two is its least and its largest; the members of larger ones are looked up
    two = met.select(F.explode(F.array("x", "y")).alias("node"))
    more = half.join(few(met.filter("k > 2").select("half")), "half", "left_semi").select("node")
    nodes = frozen(two.unionByName(more).distinct())
    return ranked(lines.join(few(nodes), "node", "left_semi").select("a", "b", "place"), [F.col("place")], "rank")


def with_words(docs: DataFrame, able: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rank, words): the word hashes of the given lines, from the documents where they stand first."""
    want = frozen(able.groupBy(F.col("place.doc_id").alias("_id")).agg(
        F.collect_list(F.struct(F.col("place.no").alias("no"), "a", "rank")).alias("_want")))
    d = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")).join(few(want), F.col("_own").eqNullSafe(F.col("_id")))
    take = lambda ls: F.transform(F.col("_want"), lambda w: F.struct(w["rank"].alias("rank"), w["a"].alias("a"), F.get(ls, w["no"]).alias("text")))
    each = d.select(F.explode(let(lines_of(F.col("_text")), take)).alias("x")).select("x.rank", "x.a", canonical(F.col("x.text")).alias("line"))
    # of rows with one id, the one whose line has the hash
    each = each.filter(F.xxhash64("line") == F.col("a")).select("rank", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("words"))
    return frozen(each.groupBy("rank").agg(F.first("words").alias("words")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, t, near) of every line to drop."""
    every = frozen(occurrences(docs, id_col, text_col))
    one = [F.first(f"h{i}").alias(f"h{i}") for i in range(4)]
    lines = frozen(every.groupBy("a", "b").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"), *one)
                   .withColumn("node", F.monotonically_increasing_id()))
    able = frozen(able_lines(lines))
    near = near_lines(with_words(docs, able, id_col, text_col))
    near = able.join(near, "rank", "left_semi").select("a", "b", F.lit(True).alias("near"))
    verdict = lines.select("a", "b", "place", "times").join(near, ["a", "b"], "left").filter("times > 1 or near")
    verdict = frozen(verdict.select("a", "b", F.col("place").alias("earliest"), F.coalesce("near", F.lit(False)).alias("near")))
    return every.select("place", "t", "a", "b").join(few(verdict), ["a", "b"]).filter(
        F.col("near") | (F.col("place") != F.col("earliest"))).select("place", "t", "near")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, and _lines: lines, and those dropped as equal and as near."""
    no = F.col("place.no")
    # a text is named by its id and hash, as several rows may have one id
    gone = frozen(dropped_lines(docs, id_col, text_col).groupBy(F.col("place.doc_id").alias("_id"), F.col("t").alias("_t")).agg(
        F.collect_set(F.when(~F.col("near"), no)).alias("_exact"), F.collect_set(F.when(F.col("near"), no)).alias("_near"),
        F.lit(True).alias("_any")))

    def kept(ls):
        every = F.sequence(F.lit(0), F.size(ls) - 1)
        stay = F.array_except(every, F.concat("_exact", "_near"))
        left = F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n")
        times = lambda c: F.size(F.col(c)).cast("long")
        return F.struct(left.alias("text"), times("_exact").alias("exact"), times("_near").alias("near"))

    # the row as one struct, so that no column's name can clash with one used here
    text = F.col("doc").getField(text_col)
    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("exact"), F.lit(0).cast("long").alias("near"))
    new = F.when(text.isNull() | F.col("_any").isNull(), same).otherwise(let(lines_of(text), kept))
    n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    d = d.join(few(gone, BROADCAST_DOCS), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("doc", F.explode(F.array(new)).alias("new"))
    lines = F.struct(n.alias("n"), F.col("new.exact").alias("exact"), F.col("new.near").alias("near"))
    return d.select(*[F.col("new.text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns], lines.alias("_lines"))
