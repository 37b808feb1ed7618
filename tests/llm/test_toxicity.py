"""Toxicity: the lexicon, its matching and the rows that it is learned from."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm import toxicity


def letters(rng, n):
    return "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))


def test_every_qualified_term_is_kept(spark, monkeypatch):
    """2,500 terms of their own beginnings; blocks of terms and of known words change nothing."""
    rng = random.Random(3)
    terms = sorted({letters(rng, 8) for _ in range(2_500)})
    toxic = [(" ".join(terms), 1.0)] * 12
    clean = [(f"clean words number{k}", 0.0) for k in range(108)]
    marked = spark.createDataFrame(toxic + clean, "text string, y double")
    found, words = toxicity.learn_terms(marked)
    names = {r.term.rstrip("$") for r in found.collect()}
    assert len(terms) > 2_000 and len(names) == len({t[:4] for t in terms})
    docs = spark.createDataFrame([(k, f"the {t} here") for k, t in enumerate(terms)], "doc_id long, text string")
    whole = toxicity.with_evidence(docs, toxicity.known_words(docs, found, words), ["doc_id"], "text").collect()
    assert all(len(r.hits) == 1 for r in whole)
    monkeypatch.setattr(toxicity, "TRIE_TERMS", 1_000)
    monkeypatch.setattr(toxicity, "KNOWN_BYTES", 64 << 10)
    parts = toxicity.with_evidence(docs, toxicity.known_words(docs, found, words), ["doc_id"], "text").collect()
    assert sorted(parts) == sorted(whole)


def test_only_confirmed_copies_are_left_out(spark):
    """Thirty texts share a passage of two thirds; two are copies, one of them near."""
    rng = random.Random(8)
    passage = [letters(rng, 6) for _ in range(60)]
    rows = [(k, " ".join(passage + [letters(rng, 6) for _ in range(40)]), 1.0) for k in range(30)]
    rows += [(40, rows[7][1].upper(), 1.0), (41, rows[9][1] + " tail", 1.0), (42, rows[9][1], 0.0), (43, None, 0.0)]
    marked = spark.createDataFrame(rows, "_key long, text string, y double")
    kept = toxicity.without_copies(marked).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in marked.drop("_key").collect()
                                            if r.text not in (rows[30][1], rows[31][1]))


def test_stems_are_found_misspelled():
    trie = toxicity.Trie([("idiot", 5.0), ("scum$", 4.0), ("clown$", 4.0), ("lowei", 3.0)], fuzzy=4, swaps=True)
    found = {"idiots": "idiot", "idots": "idiot", "idi0ts": "idiot", "iddiotic": "idiot", "idoitic": "idiot",
             "iidotx": "idiot", "diiots": "idiot", "idio7": "idiot", "xidiots": "idiot", "idol": "", "idioms": "",
             "scvm": "scum", "csum": "scum", "scumm": "scum", "scvms": "", "clwon": "clown", "clowning": "",
             "lower": "lowei", "lowest": "", "lwoeischaft": "lowei"}
    assert {w: trie.match(w)[0] for w in found} == found


def test_misspelled_uses_from_labelled_rows(spark):
    """A quarter of the uses is inflected, a quarter misspelled: the stem must still find its misspellings."""
    rng = random.Random(4)
    filler = [letters(rng, 5) for _ in range(300)]
    forms = ["idiot", "idiot", "idiots", "idoit", "scum", "scum", "scum", "scvm"]
    rows = [(k, " ".join(rng.sample(filler, 30) + ([forms[k % 8]] if k % 5 == 0 else [])), float(k % 5 == 0))
            for k in range(600)]
    terms, words = toxicity.learn_terms(spark.createDataFrame(rows, "id long, text string, y double"))
    uses = ["idiot", "idiots", "idoit", "idi0ts", "idiotts", "diiots", "scum", "scmu", "scuum", "scvm"]
    docs = spark.createDataFrame([(k, f"so a {w} here") for k, w in enumerate(uses)], "doc_id long, text string")
    known = {r.word for r in toxicity.known_words(docs, terms, words).collect()}
    assert known == set(uses)


def test_own_words_are_told_by_rates(spark):
    """Two clean uses (quoted, mislabelled) do not hide a misspelling of three toxic documents."""
    rng = random.Random(6)
    filler = [letters(rng, 5) for _ in range(300)]

    def use(word, toxic, clean):
        return [(" ".join(rng.sample(filler, 20) + [word]), float(k < toxic)) for k in range(toxic + clean)]

    rows = use("clown", 60, 3) + use("clovn", 3, 2) + use("crown", 1, 12) + use("clone", 0, 2) + use("nothing", 0, 500)
    terms, words = toxicity.learn_terms(spark.createDataFrame(rows, "text string, y double"))
    docs = spark.createDataFrame([("clovn crown clone clowm",)], "text string")
    assert {r.word for r in toxicity.known_words(docs, terms, words).collect()} == {"clovn", "clowm"}


def test_short_words_and_scripts_without_blanks(spark):
    """Half of the rows are toxic; the terms are a word of three letters and one inside runs of Han."""
    rng = random.Random(2)
    filler, signs = [letters(rng, 5) for _ in range(300)], [chr(0x5000 + k) for k in range(200)]
    rows = [(" ".join(rng.sample(filler, 20) + ["git"] * y), float(y)) for y in (0, 1) for _ in range(40)]
    rows += [("".join(rng.sample(signs, 20) + ["傻瓜"] * y + rng.sample(signs, 20)), float(y))
             for y in (0, 1) for _ in range(40)]
    terms, words = toxicity.learn_terms(spark.createDataFrame(rows, "text string, y double"))
    assert {r.term for r in terms.collect()} == {"git$", "傻瓜", "瓜"}
    docs = spark.createDataFrame([(1, "a git here"), (2, "digit"), (3, "倀倁傻瓜倂")], "doc_id long, text string")
    found = toxicity.with_evidence(docs, toxicity.known_words(docs, terms, words), ["doc_id"], "text").collect()
    assert {r.doc_id: len(r.hits) for r in found} == {1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize("balanced", [False, True])
def test_held_out_toxic_rows(spark, balanced):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    if balanced:
        toxic = labels.filter("toxic = 1")
        labels = toxic.union(labels.filter("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(toxic.count()))
    rows = toxicity.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()
    held = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    caught = sum(a and b for a, b in held)
    assert caught >= 0.8 * sum(a for a, _ in held) and caught >= 0.7 * sum(b for _, b in held)
