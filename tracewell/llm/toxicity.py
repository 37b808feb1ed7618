"""Toxicity by a learned lexicon that also catches misspelled terms.

Terms (words and stems) are learned from labelled documents and held in a trie. Every word of a text
runs as a Levenshtein automaton over that trie: it walks the branches that its edits still permit.
Hits are weighed by their context window, so quoted terms count little and terms that stand close
together count as abuse; few numbers per document then go through ridge scores and calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import held_out_fold, rows_of, written
from tracewell.llm.fitting import fit, scored
from tracewell.llm.near_dedup import near_duplicates

FOLDS, HELD_OUT = 3, 1
ACCEPT = 0.7                # scores from here on are toxic
SHORTEST, LONGEST = 4, 14   # letters of a stem; whole words of any length may become terms
SPAN = 4                    # letters of a stem in scripts without blanks, where every letter begins one
LEAST_SUPPORT = 4           # toxic documents that hold a term, copies not counted
TRIE_TERMS = 20_000         # terms that one trie holds; a larger lexicon is searched in blocks
KNOWN_BYTES = 32 << 20      # words that stand for terms, sent to the tasks at once
LEAST_ODDS = 4.0            # how much likelier toxic documents hold a term, as odds against clean ones
FALSE_TERMS = 1.0           # prefixes that may pass the test by chance, over the whole vocabulary
WHOLE = 0.9                 # a prefix grows while one longer form has this share of its documents
FUZZY_LENGTH = 5            # terms of this length on may have one edit, unless a trie is told otherwise
SHORTEST_FUZZY = 4          # the same in documents
OWN_EVIDENCE = 3.0          # how much likelier (ln) such a word is of its own than the misspelled term
SUREST = 0.95               # toxic share that a misspelled term is held to at most
FUZZY_WEIGHT, QUOTED_WEIGHT = 0.8, 0.25
WINDOW = 8                  # words on either side that make up a hit's context
HELD_PREFIXES = 400_000     # counts or words that a task holds before it passes them on
WIDTH = 5

_WORD = re.compile(r"\w+")
# Thai to Burmese, Khmer, kana, Han.
_NO_BLANKS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_NO_BLANK = re.compile(f"[{_NO_BLANKS}]")
_SPREAD = re.compile(rf"(?=([{_NO_BLANKS}]{{1,{SPAN}}}))[{_NO_BLANKS}]|[^\W{_NO_BLANKS}]+")
_QUOTE = re.compile("[\"“”„«»]")
_CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«"}


# --- lexicon -----------------------------------------------------------------------------------

def _words(lower: str) -> list[str]:
    """Words of a text in lower case; in scripts without blanks, the next letters from each letter on."""
    if lower.isascii() or not _NO_BLANK.search(lower):
        return _WORD.findall(lower)
    return [m[1] or m[0] for m in _SPREAD.finditer(lower)]


def _places(lower: str) -> Iterator[tuple[str, int]]:
    """The same words with their places."""
    if lower.isascii() or not _NO_BLANK.search(lower):
        return ((m.group(), m.start()) for m in _WORD.finditer(lower))
    return ((m[1] or m[0], m.start()) for m in _SPREAD.finditer(lower))


def _prefixes(word: str) -> list[str]:
    """Prefixes of a word; the whole word ends with a mark, so that it can be told from a stem."""
    if _NO_BLANK.match(word):
        return [word[:k] for k in range(1, len(word) + 1)]
    return [*(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)), word + "$"]


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {0: Counter(), 1: Counter()}

    def passed_on():
        names = list(set(counts[0]) | set(counts[1]))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][p] for p in names], pa.int64()),
             pa.array([counts[0][p] for p in names], pa.int64())], names=["prefix", "toxic", "clean"])
        counts[0].clear()
        counts[1].clear()
        return batch

    for text, label in rows_of(batches):
        words = set(_words((text or "").lower()))
        counts[int(label > 0)].update({p for w in words for p in _prefixes(w)})
        if len(counts[0]) + len(counts[1]) > HELD_PREFIXES:
            yield passed_on()
    yield passed_on()


def without_copies(marked: DataFrame) -> DataFrame:
    """``text, y`` of the smallest key per label and group of near-duplicates, from ``_key, text, y``.

    Groups are those of ``near_duplicates``, which confirms links on the full sets, so texts that only
    share a passage all stay.
    """
    rows = written(marked.withColumn("_row", F.xxhash64("_key", "text")).dropDuplicates(["_key", "_row"]), "rows")
    groups = near_duplicates(rows, "_row").select(F.col("_row").alias("_id"), F.col("component_id").alias("group"))
    narrow = rows.select("_row", "_key", "y").join(groups, F.col("_row") == F.col("_id"))
    first = narrow.groupBy("y", "group").agg(F.min(F.struct("_key", "_row")).alias("first")).select("y", "group", "first._row")
    copies = narrow.select("_row").join(first.select("_row"), "_row", "left_anti")
    return rows.join(written(copies, "copies"), "_row", "left_anti").select("text", "y")


TERM = "term string, weight double, part double"


def learn_terms(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms from rows ``text, y``, and the documents of each word: ``word, toxic, clean, share``.

    Terms have a weight and the toxic ``part`` of their documents; ``share`` is that of all documents.
    Terms that end with ``$`` are words, others are stems. A prefix qualifies if chance would hardly
    put so many of its documents among the toxic ones, with a bound that counts how many prefixes are
    tried, and if its odds ratio, which the share of toxic rows does not change, is that of a term. All that qualify are kept; prefixes of one family grow together in one task.
    """
    spark = marked.sparkSession
    counts = written(marked.select("text", "y").mapInArrow(
        _prefix_counts, "prefix string, toxic bigint, clean bigint").groupBy("prefix").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= LEAST_SUPPORT) | F.endswith("prefix", F.lit("$"))), "prefixes")
    words = counts.filter(F.endswith("prefix", F.lit("$"))).select(
        F.expr("left(prefix, char_length(prefix) - 1)").alias("word"), "toxic", "clean")
    size = marked.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    if not size.n or not size.p:
        return spark.createDataFrame([], TERM), words.withColumn("share", F.lit(0.0))
    share, positive, negative = size.p / size.n, size.p, size.n - size.p
    counts = counts.filter(F.col("toxic") >= LEAST_SUPPORT)
    tried = max(counts.count(), 1)
    n = F.col("toxic") + F.col("clean")
    part = F.col("toxic") / n
    # Chernoff: -ln P(at least this many toxic among n by chance).
    rest = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    evidence = n * (part * F.log(part / share) + rest)

    def choose(family: pa.Table) -> pa.Table:
        found = {p: (a, b) for p, a, b in zip(*(family.column(c).to_pylist() for c in ("prefix", "toxic", "clean")))}
        names, weights = zip(*_chosen(found, positive, negative))
        return pa.table({"term": pa.array(names, pa.string()), "weight": pa.array(weights, pa.float64()),
                         "part": pa.array([found[t][0] / sum(found[t]) for t in names], pa.float64())})

    odds = (F.col("toxic") + 0.5) / (positive + 1) * (negative + 1) / (F.col("clean") + 0.5)
    begin = F.when(F.col("prefix").rlike(f"^[{_NO_BLANKS}]"), F.lit(1)).otherwise(SHORTEST)
    terms = counts.filter((part > share) & (odds >= LEAST_ODDS) & (evidence >= math.log(tried / FALSE_TERMS))) \
        .withColumn("family", F.substring("prefix", F.lit(1), begin)).groupBy("family").applyInArrow(choose, TERM)
    return written(terms, "terms"), words.withColumn("share", F.lit(float(share)))


def _chosen(found: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[tuple[str, float]]:
    longer = defaultdict(list)
    for p in found:
        longer[p[:-1][:LONGEST]].append(p)
    terms = []
    for p in found:
        if p[:-1][:LONGEST] in found:
            continue                            # a shorter form already qualifies
        while len(heirs := [q for q in longer[p] if found[q][0] >= WHOLE * found[p][0]]) == 1:
            p = heirs[0]                        # with two such forms only the stem covers both
        a, b = found[p]
        terms.append((p, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))))
    return sorted(terms)


KNOWN = "word string, term string, weight double, rank int"


def known_words(docs: DataFrame, terms: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """``word, term, weight, rank`` for each word of ``docs`` that stands for a term.

    Rank is 2 for a term itself, 1 for a word that begins with a stem, 0 for a misspelled one. A word
    near a term is not misspelled, but its own, if its labelled documents are toxic at the rate of all
    documents rather than at the rate of the term. The vocabulary of ``docs`` is held
    against the lexicon, each word once, one block of terms after the other.
    """
    spark = docs.sparkSession
    blocks = 1 + terms.count() // TRIE_TERMS
    source = written(docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_vocabulary, "text string").distinct(),
                     "vocabulary")
    found = None
    for k in range(blocks):
        shared = spark.sparkContext.broadcast([(r.term, r.weight) for r in terms.filter(
            F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect()])
        part = written(source.mapInArrow(_matching(shared), KNOWN).distinct(), "matched")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("word").agg(F.max(F.struct("rank", "weight", "term")).alias("best")) \
        .select("word", "best.term", "best.weight", "best.rank")
    part = terms.groupBy(F.regexp_replace("term", "\\$$", "").alias("term")).agg(F.max("part").alias("part"))
    p = F.least(F.greatest("part", "share"), F.lit(SUREST))
    own = F.col("toxic") * F.log(F.col("share") / p) + F.col("clean") * F.log((1 - F.col("share")) / (1 - p))
    return written(best.join(words, "word", "left").join(part, "term", "left").filter(
        (F.col("rank") > 0) | (F.coalesce(own, F.lit(0.0)) <= OWN_EVIDENCE)).select("word", "term", "weight", "rank"), "known")


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task, each once as long as it is held."""
    seen: set[str] = set()
    for (text,) in rows_of(batches):
        seen.update(_words((text or "").lower()))
        if len(seen) > HELD_PREFIXES:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["text"])
            seen.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["text"])


def _matching(shared):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value, fuzzy=SHORTEST_FUZZY, swaps=True)
        for batch in batches:
            if found := trie.matches(set(batch.column(0).to_pylist())):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array([t for t, _ in found.values()], pa.string()),
                     pa.array([w for _, w in found.values()], pa.float64()),
                     pa.array([trie.rank(word, t) for word, (t, _) in found.items()], pa.int32())],
                    names=["word", "term", "weight", "rank"])
    return match


def _shortened(word: str) -> Iterator[str]:
    return (word[:k] + word[k + 1:] for k in range(len(word)))


class Trie:
    """Terms as a trie; words stand for a term within one edit, and what begins with a stem for the stem.

    A misspelled stem must hold its edit inside: what follows it is free, so its last letter must be
    there. ``own`` are words that are never taken for a misspelled term, terms from ``fuzzy`` letters on
    are found misspelled, and with ``swaps`` two letters in each other's place are one edit.
    """

    def __init__(self, terms: list[tuple[str, float]], own: list[str] = (), fuzzy: int = FUZZY_LENGTH,
                 swaps: bool = False):
        self.own, self.fuzzy, self.swaps = set(own), fuzzy, swaps
        self.stems = {t: w for t, w in terms if not t.endswith("$")}
        self.words = {t[:-1]: w for t, w in terms if t.endswith("$")}
        self.lengths = sorted({len(t) for t in self.stems})
        self.root: dict = {}
        self.near: set[str] = set()             # fuzzy terms and what is left without one letter
        self.near_stems: set[str] = set()
        self.begins: set[str] = set()           # one edit leaves one half of a term as it is
        self.ends: set[str] = set()
        self.stem_begins: set[str] = set()
        self.stem_ends: set[tuple[int, str]] = set()            # with the places where they may stand
        for term in {*self.words, *self.stems}:
            if len(term) < fuzzy:
                continue
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term
            k = len(term) // 2
            begins = {term[:k], term[:k - 1] + term[k]}         # as it is, or swapped across the middle
            self.near |= {term, *_shortened(term)}
            self.begins |= begins
            self.ends.add(term[k:])
            if term in self.stems:
                self.near_stems |= {term, *_shortened(term)}
                self.stem_begins |= begins
                self.stem_ends |= {(place, term[k:]) for place in (k - 1, k, k + 1)}
        self.sizes = {len(x) + k for x in self.near for k in (0, 1)}
        self.stem_sizes = sorted({len(x) + k for x in self.near_stems for k in (0, 1)})
        self.parts = sorted({len(x) for x in self.begins}), sorted({len(x) for x in self.ends})
        self.stem_parts = sorted({len(x) for x in self.stem_begins}), sorted({(p, len(x)) for p, x in self.stem_ends})
        self.firsts, self.lasts = {x[:2] for x in self.begins}, {x[-2:] for x in self.ends}

    def weight(self, term: str) -> float:
        return max(self.words.get(term, 0.0), self.stems.get(term, 0.0))

    def matches(self, words: set[str]) -> dict[str, tuple[str, float]]:
        """The words that stand for a term, with it and its weight."""
        found = {}
        for word in words:
            term, weight = self.match(word)
            if weight > 0:
                found[word] = term, weight
        return found

    def rank(self, word: str, term: str) -> int:
        """2 for a term itself, 1 for a word that begins with a stem, 0 for a misspelled one."""
        return 2 if word in self.words else int(term in self.stems and word.startswith(term))

    def match(self, word: str) -> tuple[str, float]:
        """The term that a word stands for and its weight, or ("", 0)."""
        if word in self.words:
            return word, self.words[word]
        for k in self.lengths:
            if word[:k] in self.stems:
                return word[:k], self.stems[word[:k]]
        term = "" if word in self.own else self.misspelled(word)
        return (term, FUZZY_WEIGHT * self.weight(term)) if term else ("", 0.0)

    def misspelled(self, word: str) -> str:
        """The term that ``word``, or its beginning, is one edit away from, or ""."""
        # Within one edit means equal without a letter each at most; only such words walk the trie.
        if len(word) in self.sizes and self._has_half(word) and _close(word, self.near):
            return self._within_one(word)
        if self.stems and self._begins_with_half(word) and any(_close(word[:k], self.near_stems) for k in self.stem_sizes if k < len(word)):
            return self._within_one(word)
        return ""

    def _has_half(self, word: str) -> bool:
        if self.fuzzy >= 4 and word[:2] not in self.firsts and word[-2:] not in self.lasts:
            return False
        return any(word[:k] in self.begins for k in self.parts[0]) or any(word[-k:] in self.ends for k in self.parts[1])

    def _begins_with_half(self, word: str) -> bool:
        for k in self.stem_parts[0]:
            if word[:k] in self.stem_begins:
                return True
        for place, k in self.stem_parts[1]:
            if (place, word[place:place + k]) in self.stem_ends:
                return True
        return False

    def _within_one(self, word: str) -> str:
        """The heaviest term within one edit: the word's automaton, walked along the trie.

        A state is the edits needed so far for each beginning of the word, as far as it is at most one.
        A stem is also accepted where the word goes on, if its last letter was not the edit.
        """
        best, heaviest = "", 0.0
        stack = [(self.root, {0: 0, 1: 1} if word else {0: 0}, {}, "", False)]
        while stack:
            node, state, before, last, inside = stack.pop()
            term = node.get("")
            if term:
                weight = max(self.words.get(term, 0.0) if state.get(len(word), 2) <= 1 else 0.0,
                             self.stems.get(term, 0.0) if inside or state.get(len(word), 2) <= 1 else 0.0)
                if weight > heaviest or weight == heaviest and weight and term < best:
                    best, heaviest = term, weight
            for letter, below in node.items():
                if not letter:
                    continue
                after = _step(state, letter, word)
                met = any(p < len(word) and word[p] == letter for p in state)
                for place, edits in before.items() if self.swaps else ():
                    if edits < 1 and word[place:place + 2] == letter + last:
                        after.setdefault(place + 2, 1)
                        met = True
                if after:
                    stack.append((below, after, state, letter, met))
        return best


def _close(word: str, near: set[str]) -> bool:
    return word in near or any(x in near for x in _shortened(word))


def _step(state: dict[int, int], letter: str, word: str) -> dict[int, int]:
    after: dict[int, int] = {}
    for place, edits in sorted(state.items()):
        if place < len(word) and word[place] == letter:
            after[place + 1] = min(edits, after.get(place + 1, 2))
        if edits < 1:
            after[place] = min(1, after.get(place, 2))                  # a letter too few in the word
            if place < len(word):
                after[place + 1] = min(1, after.get(place + 1, 2))      # another letter
    for place, edits in sorted(after.items()):
        if edits < 1 and place < len(word):
            after.setdefault(place + 1, 1)                              # a letter too many
    return after


# --- documents ---------------------------------------------------------------------------------

def _quoted(text: str) -> list[tuple[int, int]]:
    """Spans inside quotation marks that close within a line."""
    spans = []
    for line in re.finditer(r"[^\n]+", text):
        opened = None
        for mark in _QUOTE.finditer(line.group()):
            if opened is None:
                opened = mark.start() if mark.group() in _CLOSERS else None
            elif mark.group() in _CLOSERS[line.group()[opened]]:
                spans.append((line.start() + opened, line.start() + mark.start()))
                opened = None
    return spans


def evidence(text: str | None, trie: Trie) -> tuple[list[float], list[tuple[str, int, bool]]]:
    """Numbers for the score, and the hits: term, word number, quoted."""
    hits, n = _hits(text, trie.matches(set(_words((text or "").lower()))))
    hits = _apart(hits)
    return _numbers(hits, n), [h[:3] for h in hits]


def _hits(text: str | None, known: dict[str, tuple[str, float]]) -> tuple[list[tuple[str, int, bool, float]], int]:
    """Term, word number, quoted and weight of each known word, and the number of all words."""
    lower = (text or "").lower()
    words = _words(lower)
    if known.keys().isdisjoint(words):
        return [], len(words)
    spans = _quoted(lower) if _QUOTE.search(lower) else []
    hits = []
    for k, (word, start) in enumerate(_places(lower)):
        if word in known:
            term, weight = known[word]
            hits.append((term, k, any(a < start < b for a, b in spans), weight))
    return hits, len(words)


def _apart(hits: list[tuple[str, int, bool, float]]) -> list[tuple[str, int, bool, float]]:
    """Hits without those inside another one, which scripts without blanks permit."""
    kept, upto = [], 0
    for hit in hits:
        if hit[1] >= upto:
            kept.append(hit)
            upto = hit[1] + (len(hit[0]) if _NO_BLANK.match(hit[0]) else 1)
    return kept


def _numbers(hits: list[tuple[str, int, bool, float]], n: int) -> list[float]:
    if not hits:
        return [0.0] * WIDTH
    weight = np.array([w * (QUOTED_WEIGHT if q else 1) for *_, q, w in hits])
    place = np.array([p for _, p, _, _ in hits])
    total = np.concatenate(([0], np.cumsum(weight)))
    window = total[np.searchsorted(place, place + WINDOW, "right")] - total[np.searchsorted(place, place - WINDOW)]
    open_terms = {t for t, _, q, _ in hits if not q}
    return [math.log1p(weight.sum()), math.log1p(window.max()), math.log1p(len(open_terms)),
            math.sqrt(weight.sum() / n), weight.max()]


HIT = ("term", "word", "quoted", "weight")


def with_evidence(docs: DataFrame, known: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` with ``x`` and ``hits`` (terms, word numbers, whether quoted, weights).

    Known words of more than one block are searched one block after the other.
    """
    sc = docs.sparkSession.sparkContext
    size = known.agg(F.sum(F.octet_length("word") + F.octet_length("term") + 64)).first()[0] or 0
    blocks = 1 + int(size) // KNOWN_BYTES
    kind = pa.list_(pa.struct([("term", pa.string()), ("word", pa.int32()), ("quoted", pa.bool_()),
                               ("weight", pa.float64())]))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"), F.array().cast(
        "array<struct<term:string,word:int,quoted:boolean,weight:double>>").alias("hits"))

    def searching(shared, last: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    found = []
                    for t, earlier in rows_of(iter([part.select(["_text", "hits"])])):
                        hits, n = _hits(t, shared.value)
                        if earlier:
                            hits = sorted(hits + [tuple(h[c] for c in HIT) for h in earlier], key=lambda h: h[1])
                        found.append((_apart(hits) if last else hits, n))
                    hits = pa.array([[dict(zip(HIT, h)) for h in hs] for hs, _ in found], kind)
                    own = pa.array([_numbers(*f) for f in found], pa.list_(pa.float64())) if last \
                        else part.column("_text")
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], own, hits],
                                                     names=[*keep, "x" if last else "_text", "hits"])
        return search

    for k in range(blocks):
        shared = sc.broadcast({r.word: (r.term, r.weight) for r in known.filter(
            F.pmod(F.xxhash64("word"), F.lit(blocks)) == k).collect()})
        if k == blocks - 1:
            schema = rows.select(*[F.col(f"`{c}`") for c in keep], F.array().cast("array<double>").alias("x"), "hits").schema
            return rows.mapInArrow(searching(shared, True), schema)
        rows = written(rows.mapInArrow(searching(shared, False), rows.schema), "searched")
        shared.destroy()


def _same(z: np.ndarray) -> np.ndarray:
    return z


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted, n_hits`` of each row of ``docs``.

    Terms, weights and calibration come from labelled rows outside the held-out fold. The whole text
    is searched. Null and empty texts have no hit and get the score of texts without hits; a null key
    is not held out; without toxic labels there are no terms and all scores are alike. Repeated rows
    get equal scores; extra columns are not read.
    """
    fold = F.pmod(F.crc32(F.col("_key").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    marked = labels.select(F.col(key).alias("_key"), F.col("toxic").cast("double").alias("y")) \
        .filter("y is not null and _key is not null").dropDuplicates(["_key"]) \
        .withColumn("fold", fold).filter(F.col("fold") != HELD_OUT)
    train = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("text")) \
        .join(marked.hint("shuffle_hash"), F.col("_id") == F.col("_key"))
    terms, words = learn_terms(without_copies(train.select("_key", "text", "y")))
    known = known_words(docs, terms, words, text)
    rows = written(with_evidence(docs, known, [key], text).select(key, "x", F.size("hits").alias("n_hits")), "hits")
    model = fit(written(rows.join(marked, F.col(f"`{key}`") == F.col("_key")).select(
        "x", "y", "fold"), "labelled"), WIDTH, _same)
    return scored(rows, model, [key, "n_hits"]).select(
        key, held_out_fold(key, FOLDS, HELD_OUT).alias("held_out"), "score", toxic().alias("predicted"), "n_hits")


def toxic() -> Column:
    return (F.col("score") >= ACCEPT).cast("int")
