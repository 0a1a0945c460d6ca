"""Toxic terms, also misspelled ones, by Levenshtein automata over a trie of the lexicon, scored in their context."""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Cache, hashes, over_texts, read, settled, table, words

LEXICON = (
    "idiot idiots idiotic moron morons moronic imbecile stupid stupidity dumb dumbass loser losers scum scumbag trash clown clowns pathetic worthless "
    "disgusting vermin subhuman lowlife cretin halfwit dimwit nitwit dipshit bastard bitch asshole jackass dickhead shithead bullshit fuck fucker fucking "
    "motherfucker retard retarded whore slut douchebag degenerate filthy"
).split()
#: Letters of the term that must agree, words on either side that make up a hit's context, and the score from which a document is toxic.
PREFIX, WINDOW, THRESHOLD = 0, 8, 1.0
#: What a hit counts by its edits, and in quotation.
WEIGHTS, QUOTED = (1.0, 0.6, 0.4), 0.3
SECOND_PERSON = frozenset("you your yours yourself u ur youre".split())
REPORTED = frozenset("quote quoted quotes quoting said says wrote writes called calls calling word words term terms phrase slur insult insults define defined definition means meaning".split())
#: Labelled documents of each kind from which terms are learned, and what a learned term must show.
LABELLED, MIN_CONTEXTS, MIN_ODDS = 3000, 4, 30
#: A neighbour of a term is a word of its own if less than this share of its distinct contexts, MIN_CONTEXTS or more, has an exact hit.
OWN_SHARE = 0.1
#: SQL can't express the context scores; tested against brute force.
ORACLE = None
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("word", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("score", pa.float64()), ("context", pa.int64()), ("beside", pa.bool_())])
_CONTEXTS = pa.schema([("word", pa.string()), ("context", pa.int64()), ("toxic", pa.bool_())])
_QUOTES = re.compile(r"[\"“”„«»]")


def edits(term: str) -> int:
    """Edits that a term allows: none under four letters, one under eight, else two."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Lexicon:
    """The trie of the terms, and the automaton of all that lies within each term's edits.

    A state is a set of (trie node, edits so far): what the Levenshtein automata of all terms can be in after the letters
    read. Sets and their transitions are computed once, when a word first needs them. The first `prefix` letters must agree.
    """

    def __init__(self, terms: Iterable[str], exact: Iterable[str] = (), prefix: int = PREFIX) -> None:
        allowed = {t.lower(): 0 for t in exact if t} | {t.lower(): edits(t) for t in terms if t}
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.depth, self.most = [0], [0]
        self.allowed = allowed
        for term in sorted(allowed):
            at = 0
            self.most[0] = max(self.most[0], allowed[term])
            for letter in term:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.depth.append(self.depth[at] + 1)
                    self.most.append(0)
                at = self.next[at][letter]
                self.most[at] = max(self.most[at], allowed[term])
            self.term[at] = term
        self.prefix = prefix
        self.states: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.first = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, after the letters that a term has more (deletions in the word)."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes.get(node) == e and self.depth[node] >= self.prefix:
                for child in self.next[node].values():
                    if e + 1 <= self.most[child] and e + 1 < nodes.get(child, 9):
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(nodes)
            self.steps.append({})
            ends = [(e, t) for n, e in nodes.items() if (t := self.term[n]) is not None and e <= self.allowed[t]]
            self.ends.append(min(ends) if ends else None)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        to: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and e < to.get(node, 9):
                to[node] = e

        for node, e in self.states[state].items():
            free = self.depth[node] >= self.prefix
            if free:
                reach(node, e + 1)  # a letter too many
            for own, child in self.next[node].items():
                if own == letter:
                    reach(child, e)
                elif free:
                    reach(child, e + 1)
        self.steps[state][letter] = found = self._state(to) if to else -1
        return found

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term that the word lies within, the first of equally near ones."""
        state, steps = self.first, self.steps
        for letter in word:
            if (to := steps[state].get(letter)) is None:
                to = self._step(state, letter)
            if to < 0:
                return None
            state = to
        return self.ends[state]


def hits(text: str, found: dict[int, tuple[int, str]], window: int = WINDOW) -> list[tuple[str, str, int, bool, float, int, bool]]:
    """(word, term, edits, quoted, score, context, beside) of each hit in a text, `found` being the matches by word number.

    A hit weighs by its edits. It is quoted, and counts QUOTED times as much, if quotation marks are open around it in its
    line or a word of reporting stands in its window. Unquoted it gains a quarter for each exact hit in its window
    and a half for a word in the second person there; with either, a misspelled hit counts as an exact one at least.
    context is a hash of the words in its window, beside whether an exact hit is one of them.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    lowered = [text[a:b].lower() for a, b in spans]
    out = []
    exact = [i for i, (e, _) in found.items() if e == 0]
    for i in sorted(found):
        (a, b), (e, term) = spans[i], found[i]
        near = lowered[max(0, i - window) : i] + lowered[i + 1 : i + 1 + window]
        line_end = text.find("\n", b)
        before, after = text[text.rfind("\n", 0, a) + 1 : a], text[b : line_end if line_end >= 0 else len(text)]
        marked = len(_QUOTES.findall(before)) % 2 == 1 and _QUOTES.search(after) is not None
        quoted = marked or not REPORTED.isdisjoint(near)
        beside = sum(1 for j in exact if 0 < abs(j - i) <= window)
        lift = QUOTED if quoted else 1 + 0.25 * beside + 0.5 * (not SECOND_PERSON.isdisjoint(near))
        score = max(WEIGHTS[e] * lift, WEIGHTS[0] if lift > 1 else 0.0)
        out.append((lowered[i], term, e, quoted, score, xxhash.xxh64_intdigest(" ".join(near)) - (1 << 63), beside > 0))
    return out


_MATCHERS: dict[tuple, Cache] = {}


def _run(terms: tuple[str, ...], exact: tuple[str, ...], prefix: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (terms, exact, prefix) not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[terms, exact, prefix] = Cache(Lexicon(terms, exact, prefix).match)
        matches = _MATCHERS[terms, exact, prefix]
        for ids, texts in over_texts(batches):
            rows = []
            for i, text in zip(ids, texts):
                if not text:
                    continue
                lowered = list(map(str.lower, WORD.findall(text)))
                hit = {w for w in set(lowered) if matches[w] is not None}
                if hit:
                    rows += [(i, *h) for h in hits(text, {k: matches[w] for k, w in enumerate(lowered) if w in hit}, window)]
            if rows:
                yield table(dict(zip(_SCHEMA.names, map(list, zip(*rows)))), _SCHEMA)

    return run


def toxic(docs: DataFrame, terms: Iterable[str] = LEXICON, exact: Iterable[str] = (), prefix: int = PREFIX, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, n_abusive, n_quoted, terms) of the documents whose hits score at least `threshold` together.

    docs has doc_id and text; other columns are ignored. Whole texts are read. `exact` are terms of which no misspelling counts. A word close to a term counts as a misspelling
    unless it is a word of its own: one with MIN_CONTEXTS distinct contexts at least, of which less than OWN_SHARE have an exact hit.
    Copies have one context together, and a word of fewer contexts has shown nothing against it. Null and empty texts, and null doc_ids, are never toxic; rows of the same doc_id are one document. An empty table gives
    no rows.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = settled(texts.mapInArrow(_run(tuple(sorted({t.lower() for t in terms if t})), tuple(sorted({t.lower() for t in exact if t})), prefix, window), "doc_id long, word string, term string, edits int, quoted boolean, score double, context long, beside boolean"))
    seen = found.where("edits > 0").groupBy("word", "context").agg(F.max("beside").alias("beside"))
    spread = seen.groupBy("word").agg(F.count("*").alias("n"), F.count_if("beside").alias("with_hit"))
    own = spread.where((F.col("n") >= MIN_CONTEXTS) & (F.col("with_hit") < OWN_SHARE * F.col("n"))).select("word")
    kept = found.join(own, "word", "left_anti")
    scored = kept.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count_if(~F.col("quoted")).alias("n_abusive"), F.count_if("quoted").alias("n_quoted"), F.array_sort(F.collect_set("term")).alias("terms"))
    return scored.where(F.col("score") >= threshold)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, context, toxic): of toxic texts every word with a hash of its neighbours, of others each word once."""
    for batch in batches:
        word, context, bad = [], [], []
        for text, toxic_ in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            w = words(text)
            if toxic_:
                h = hashes(w)
                around = np.zeros(len(h), np.uint64)
                around[1:] += h[:-1]
                around[:-1] += h[1:] * np.uint64(3)
                word += w
                context += around.view(np.int64).tolist()
            else:
                w = list(set(w))
                word += w
                context += [0] * len(w)
            bad += [toxic_] * len(w)
        if word:
            yield table({"word": word, "context": context, "toxic": bad}, _CONTEXTS)


def learned_terms(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> list[str]:
    """Words that the labelled toxic documents use in many places, and the others hardly ever.

    At most about `bound` labelled documents of each kind are read, those of the least hashes of their doc_id. A word
    is a term if it has MIN_CONTEXTS distinct pairs of neighbours at least, and one in a hundred toxic documents' worth of
    them (so copies of one toxic document prove nothing), and is MIN_ODDS times as frequent as in the others. Null labels, ids
    and texts are left out; no labels give no terms.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {bool(r["toxic"]): r["count"] for r in marks.groupBy("toxic").count().collect()}
    if True not in n:
        return []
    part = F.when(F.col("toxic") > 0, bound / n[True]).otherwise(bound / n.get(False, 1))
    sample = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").where("text is not null").join(F.broadcast(sample), "__id").select("text", "toxic")  # of a size bounded by the parameter
    n_bad, n_good = min(n[True], bound), min(n.get(False, 0), bound)
    seen = texts.mapInArrow(_contexts, "word string, context long, toxic boolean")
    counts = seen.groupBy("word").agg(F.count_distinct(F.when(F.col("toxic"), F.col("context"))).alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    least = max(MIN_CONTEXTS, n_bad // 100)
    good = F.col("good") + 0.5
    return sorted(r["word"] for r in counts.where((F.col("bad") >= least) & (F.col("bad") / n_bad >= MIN_ODDS * good / (n_good + 1)) & (F.length("word") >= 4)).select("word").collect())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxic(docs, exact=learned_terms(docs, read(spark, sf_dir, "labels")))
