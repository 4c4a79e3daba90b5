import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from lakescope.llm import licenses as L, quality as Q

from .data import DOCS, WORD, awkward_docs, documents

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    w = WORD.findall(text or "")
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {i for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rows = awkward_docs()
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0)], LABELS)
    out = Q.judged(documents(spark, rows), labels)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=repr)
    want = sorted(((i, *base(t), base(t)[0] < 10 or 100 * base(t)[4] > 20 * base(t)[0]) for i, t, *_ in rows), key=repr)
    assert got == want
    assert all(r.kept == (not r.base_failed) for r in out.collect())  # three labels certify nothing


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.05), (40, 1000, 0.05), (0, 40_000, 0.01), (380, 40_000, 0.01), (5, 5, 0.3)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(Q.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first().x
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    assert got == pytest.approx(sum(math.exp(log(i)) for i in range(k + 1)), rel=1e-8)


def test_certified_cutoffs_separate_junk(spark):
    clean = [(i, f"plain words number {i} follow one another here without any odd marks at all", "en", "a", 1) for i in range(3000)]
    junk = [(10_000 + i, "%%% buy ### now $$$ " * 2 + f"x{i} y{i} z{i} u{i} v{i} w{i} and more", "en", "a", 1) for i in range(50)]
    few = [(20_000 + i, "%%% ### $$$ one two three four five six seven eight", "xx", "a", 1) for i in range(5)]
    labels = [(r[0], 1, 0) for r in clean] + [(r[0], 0, 0) for r in junk[:40]] + [(r[0], 0, 0) for r in few]
    docs, labels = documents(spark, clean + junk + few, extra=False), spark.createDataFrame(labels, LABELS)
    out = {r.doc_id: r for r in Q.judged(docs, labels).collect()}
    assert all(out[r[0]].kept for r in clean)
    assert not any(out[r[0]].kept for r in junk)  # those without labels too
    assert all(out[r[0]].kept != out[r[0]].base_failed for r in few)  # no clean holdout in that language
    assert {r.doc_id for r in Q.kept_documents(docs, labels).collect()} == {i for i, r in out.items() if r.kept}


def test_small_strata_are_certified(spark):
    rows = []
    for k, lang in enumerate(("en", "de", "fr", "es")):
        rows += [(1000 * k + i, f"plain words number {i} follow one another here without any odd marks at all", lang, "a", 1) for i in range(200)]
        rows += [(1000 * k + 500 + i, f"%%% buy ### now $$$ x{i} y{i} z{i} u{i} v{i} w{i} and more", lang, "a", 1) for i in range(30)]
    rows += [(9000 + i, r[1], "xx", "a", 1) for i, r in enumerate([*rows[:20], *rows[200:220]])]  # too few to certify anything
    labels = spark.createDataFrame([(r[0], int(r[1].startswith("plain")), 0) for r in rows], LABELS)
    docs = documents(spark, rows, extra=False)
    kept = {r.doc_id: r.kept for r in Q.judged(docs, labels).collect()}
    assert all(kept[r[0]] == (r[1].startswith("plain") or r[2] == "xx") for r in rows)
    counted = Q.with_counts(docs).withColumn("stratum", Q.stratum(F.col("lang")))
    got = {r.stratum: (r.n_documents, r.certified > 0) for r in Q.certification(counted, labels).collect()}
    assert got == {"=en": (230, True), "=de": (230, True), "=fr": (230, True), "=es": (230, True), "=xx": (40, False)}


def test_toxic_words_are_learned(spark):
    rows = [(i, f"plain words number {i} follow one another here in the usual calm way", "de", "a", 1) for i in range(300)]
    rows += [(1000 + i, f"{('Vollpfosten', 'blödmann!')[i % 2]} number {i} follow one another here in the usual way", "de", "a", 1) for i in range(80)]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 1000)) for r in rows if r[0] < 1060], LABELS)
    docs = documents(spark, rows, extra=False)
    assert Q.toxic_words(docs, labels).first().toxic_words == ["blödmann", "vollpfosten"]
    assert {r.doc_id for r in Q.judged(docs, labels).collect() if r.kept} == set(range(300))  # those without labels too
    assert {r.doc_id for r in Q.kept_documents(docs, labels).collect()} == set(range(300))


def test_labels_that_repeat_or_disagree(spark):
    """A document counts once, by its worst label; extra columns of the labels are not read."""
    rows = [(1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, None), (3, None, 1), (None, 0, 1)]
    labels = spark.createDataFrame(rows, LABELS).selectExpr("*", "'x' AS text", "'x' AS lang", "1 AS clean", "2 AS n_words")
    assert sorted(tuple(r) for r in Q.one_label(labels).collect()) == [(1, 1, 0), (2, 0, 0), (3, 1, 1)]
    docs = [(i, f"plain words number {i} follow one another here without any odd marks at all", "en", "a", 1) for i in range(40)]
    out = Q.judged(documents(spark, docs, extra=False), labels)
    assert out.count() == 40 and out.filter("kept").count() == 40


def test_words_are_learned_from_a_bounded_part_of_the_labels(spark, monkeypatch):
    monkeypatch.setattr(Q, "FIT_LABELS", 100)
    monkeypatch.setattr(Q, "TOXIC_WORDS", 1)
    rows = [(i, f"plain words number {i} follow one another here in the usual calm way", "de", "a", 1) for i in range(300)]
    rows += [(1000 + i, f"vollpfosten blödmann number {i} follow one another here in the usual way", "de", "a", 1) for i in range(200)]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 1000)) for r in rows], LABELS)
    assert len(Q.toxic_words(documents(spark, rows, extra=False), labels).first().toxic_words) == 1


def test_kept_documents_keep_columns(spark):
    docs = documents(spark)
    out = Q.kept_documents(docs, spark.createDataFrame([], LABELS))
    assert out.columns == docs.columns
    want = sorted(((r[0], r[1]) for r in awkward_docs() if not (base(r[1])[0] < 10 or 100 * base(r[1])[4] > 20 * base(r[1])[0])), key=repr)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want
    empty = Q.judged(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert empty.count() == 0


LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def license_brute(text, templates, threshold):
    low = (text or "").translate(str.maketrans(L.UPPER, L.LOWER))
    w = LICENSE_WORD.findall(low)
    places = [(k, label) for p, label in L.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    labels, score = {x for _, x in places}, 0.0
    for label, texts in templates.items():
        for t in texts:
            own, n = set(L.template_words(t)), len(L.template_words(t))
            for k in range(0, max(1, len(w)), n // 2):
                block = set(w[k:][: n + n // 2])
                if len(own & block) >= L.needed(len(own), threshold):
                    labels.add(label)
                    score = max(score, len(own & block) / len(own))
    starts = [k for k, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score)


def test_license_scan(spark):
    rows = awkward_docs()
    mit, apache = L.TEMPLATES["mit"][0], L.TEMPLATES["apache"][0]
    words = mit.split()
    rows += [(50, mit, "en", "a", 1), (51, "x\n" + apache.upper() + "\ny", "en", "a", 1), (52, " ".join(words[2:]), "en", "a", 1), (53, " ".join(words[8:]), "en", "a", 1),
             (54, "filler " * 200 + " ".join(reversed(words)) + " filler" * 200, "en", "a", 1), (55, "mit license mit license General   Public\nLicense", "en", "a", 1),
             (56, "This work is licensed under the GNU General Public License, version 3.", "en", "a", 1)] + [(60 + i, f"a {mit} b", "en", "a", 1) for i in range(40)]
    out = L.scan(documents(spark, rows))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in out.collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        *x, score = license_brute(t, L.TEMPLATES, L.THRESHOLD)
        want.append((i, *x, round(score, 9)))
    assert got == sorted(want, key=repr)
    assert any(r[6] and not r[5] for r in got)  # the method finds more than the phrases


def test_wrapped_notices(spark):
    mit, gpl = L.TEMPLATES["mit"][0].split(), L.TEMPLATES["gpl"][0].split()
    wrap = lambda w, n, mark: "\n".join(mark + " ".join(w[k : k + n]) for k in range(0, len(w), n))
    far = "\n".join(["some other line of text"] * 70)
    texts = [wrap(mit, 11, ""), f"{far}\n{wrap(gpl, 7, ' * ')}\n{far}", wrap(mit, 4, "# "), f"{' '.join(mit[:11])}\n{far}\n{' '.join(mit[11:])}"]
    out = L.scan(documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)], extra=False)).collect()
    assert {r.doc_id: r.labels for r in out} == {0: "mit", 1: "gpl", 2: "mit", 3: ""}


def test_scattered_words_are_no_notice(spark):
    """Words of a short notice that stand apart give no label; the notice itself does, wherever it starts."""
    rows = ["the license plate of a student at mit was under review when he was released on monday",
            "words by the cc office under rule 4 say 0 licensed shops remain"]
    rows += [f"{'pad ' * k}Released under the MIT License{' pad' * (9 - k)}" for k in range(10)] + [f"{'pad ' * k}(licensed under\n# CC-BY 4.0)" for k in range(10)]
    out = L.scan(documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(rows)], extra=False)).collect()
    assert {r.doc_id: r.labels for r in out} == {0: "", 1: ""} | {k: "mit" for k in range(2, 12)} | {k: "cc" for k in range(12, 22)}


def test_long_templates(spark):
    long = [f"t{i}" for i in range(150)]
    text = "\n".join(["x " * 100, *(" ".join(long[k : k + 10]) for k in range(0, 150, 10)), "y " * 100])
    out = L.scan(documents(spark, [(1, text, "en", "a", 1)], extra=False), templates={"long": [" ".join(long)]}).collect()
    assert [(r.labels, r.score) for r in out] == [("long", 1.0)]


def test_license_scan_of_no_rows(spark):
    assert L.scan(spark.createDataFrame([], DOCS)).count() == 0
