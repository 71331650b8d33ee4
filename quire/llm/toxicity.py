"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause's tokens side by side: insult, threat, target, negation and reported
speech. Their product gives the clause one output class (plain, aimed at someone, negated, reported,
threat) and a weight, and a document is scored by its matched clauses, not by isolated words.

The insult transducer's arcs (words and word beginnings) and the weights of the output classes are
learned from labels: from rows whose crc32(doc_id as text) mod 5 is not 0, at most ``max_train`` of them,
taken by a hash of the id. That is the only bound: all words of those rows are counted, on the executors, and
every one that three toxic documents hold and that is e^3 times as frequent in them may enter. A feature enters the lexicon by how many toxic
documents it explains that few other entries explain already, so that words shared by copies of one
document don't. Labels, language, source and id are no inputs of a score.

Null and empty texts match nothing and get the score of a text without matches. Without labels of both
classes the lexicon is empty and every score is the (smoothed) share of toxic labels. Rows that repeat a doc_id or have
none are scored, and rejected, by their own text. Columns but doc_id and text are ignored, and kept by ``reject``.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLASSES = ("plain", "aimed", "negated", "reported", "threat")
#: Weights of the classes that the fit is drawn towards.
PRIOR = (1.0, 1.3, 0.3, 0.3, 1.3)
PREFIXES = (3, 4, 5)
_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+|[\"“”„«»]")
_STOP = re.compile(r"[.!?;:\n]")

#: Closed word classes of the grammar, in English, German, French and Spanish.
NEGATION = frozenset("not never no isn aren wasn nicht kein keine nie niemals jamais aucun nunca jamás".split())
REPORT = frozenset("said says wrote writes called claimed quoted sagte sagt schrieb behauptete disait affirme écrit dijo dice escribió".split())
TARGET = frozenset("you your yourself he she they him them his her their du dich dir ihr euch tu toi te vous usted ustedes ellos".split())
INTENT = frozenset("will gonna going ll shall werde werden vais allons voy vamos".split())
HARM = frozenset("kill murder strangle shoot stab hurt töten umbringen ermorden tuer massacrer matar asesinar".split())
QUOTES = frozenset('"“”„«»')


class Transducer:
    """Deterministic and weighted: (state, symbol) leads to (state, weight); other symbols stay at no weight."""

    def __init__(self, arcs: dict, accept: frozenset):
        self.arcs, self.accept = arcs, accept

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 0.0))


#: A word of the lexicon carries its own weight, so insult's arcs hold the share of it that counts.
INSULT = Transducer({(0, "I"): (1, 1.0), (1, "I"): (1, 0.5)}, frozenset({1}))
#: Intent, then harm, then someone whom it meets.
THREAT = Transducer({(0, "W"): (1, 0.0), (1, "H"): (2, 0.0), (2, "T"): (3, 2.0)}, frozenset({3}))
AIM = Transducer({(0, "T"): (1, 0.0)}, frozenset({1}))
#: A negation holds for the next three tokens up to an insult.
NEGATE = Transducer({(0, "N"): (3, 0.0), **{(s, x): (s - 1, 0.0) for s in (1, 2, 3) for x in "oTWHRQ"}, **{(s, "N"): (3, 0.0) for s in (1, 2, 3)}, **{(s, "I"): (4, 0.0) for s in (1, 2, 3)}}, frozenset({4}))
#: A reporting verb before the insult, or an insult between quotation marks.
REPORTED = Transducer({(0, "R"): (1, 0.0), (1, "I"): (2, 0.0), (0, "Q"): (3, 0.0), (3, "Q"): (0, 0.0), (3, "R"): (1, 0.0), (3, "I"): (4, 0.0), (4, "Q"): (5, 0.0)}, frozenset({2, 5}))


def clause_output(symbols: list[tuple[str, float]]) -> tuple[int, float]:
    """Class and weight of a clause, from the five transducers' product."""
    machines = (INSULT, THREAT, AIM, NEGATE, REPORTED)
    state, insult, threat = [0] * 5, 0.0, 0.0
    for symbol, weight in symbols:
        for k, m in enumerate(machines):
            state[k], w = m.step(state[k], symbol)
            if k == 0:
                insult += w * weight
            elif k == 1:
                threat += w
    hit = [s in m.accept for s, m in zip(state, machines, strict=True)]
    if hit[1]:
        return 4, threat + insult
    if not hit[0]:
        return 0, 0.0
    return (3 if hit[4] else 2 if hit[3] else 1 if hit[2] else 0), insult


def _word_features(text: str) -> set[str]:
    """Words, and beginnings of words (marked by a star), of a lower-cased text."""
    words = {w for w in _WORD.findall(text) if len(w) > 2 and not w.isdigit()}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


class Grammar:
    """Finds the clauses of a text that hold an entry of the lexicon or a harm word, and reads them."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.find = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.find.add_word(entry.rstrip("*"), (entry.rstrip("*"), weight))
        for word in HARM:
            if word not in lexicon:
                self.find.add_word(word, (word, 0.0))
        self.find.make_automaton()
        self.longest = max((len(e) for e in lexicon), default=0)

    def weight(self, word: str) -> float:
        best = self.lexicon.get(word, 0.0)
        for k in PREFIXES:
            best = max(best, self.lexicon.get(word[:k] + "*", 0.0))
        return best

    def symbol(self, token: str) -> tuple[str, float]:
        if w := self.weight(token):
            return "I", w
        for name, words in (("N", NEGATION), ("R", REPORT), ("H", HARM), ("W", INTENT), ("T", TARGET), ("Q", QUOTES)):
            if token in words:
                return name, 0.0
        return "o", 0.0

    def features(self, text: str) -> list[float]:
        """Summed weights of the clauses of each class."""
        out, done = [0.0] * len(CLASSES), -1
        low = text.lower()
        for end, (entry, _) in self.find.iter(low):
            start = end - len(entry) + 1
            if end < done or start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            before = max(low.rfind(c, 0, start) for c in ".!?;:\n") + 1
            after = m.start() if (m := _STOP.search(low, end)) else len(low)
            done = after
            kind, weight = clause_output([self.symbol(t) for t in _TOKEN.findall(low[before:after])])
            out[kind] += weight
        return out


@lru_cache(2)
def _grammar(items: tuple) -> Grammar:
    return Grammar(dict(items))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, other documents) over a partition of training rows."""
    yes, no = Counter(), Counter()
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            (yes if toxic else no).update(_word_features((text or "").lower()))
    names = list(yes)
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "yes": pa.array([yes[x] for x in part], pa.int64()), "no": pa.array([no[x] for x in part], pa.int64())})
    rest = [x for x in no if x not in yes]
    for at in range(0, len(rest), 50_000):
        part = rest[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "yes": pa.array([0] * len(part), pa.int64()), "no": pa.array([no[x] for x in part], pa.int64())})
    names, rest, yes, no = [], [], None, None
    common.trim()


def _incidence(known: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted(known[x] for x in _word_features((t or "").lower()) if x in known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["has"])

    return run


def choose_lexicon(rows: list[list[int]], names: list[str], weights: list[float], least: float = 3.0) -> dict[str, float]:
    """Greedy multi-cover: each time the entry with the largest gain (then the longest, then the last by name); a document's gain halves with each entry it has."""
    has = defaultdict(list)
    for d, fs in enumerate(rows):
        for f in fs:
            has[f].append(d)
    has = {f: np.array(d) for f, d in has.items()}
    rank = {f: n for n, f in enumerate(sorted(has, key=lambda f: (len(names[f]), names[f])))}
    worth, out = np.ones(len(rows)), {}
    queue = [(-float(len(d)), -rank[f], f) for f, d in has.items()]
    heapq.heapify(queue)
    while queue and -queue[0][0] >= least:
        # gains only shrink: an old value is an upper bound
        old, place, f = heapq.heappop(queue)
        now = float(worth[has[f]].sum())
        if now < -old - 1e-9:
            heapq.heappush(queue, (-now, place, f))
            continue
        out[names[f]] = weights[f]
        worth[has[f]] /= 2
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR; the last weight is the intercept."""
    z = np.hstack([np.log1p(x), np.ones((len(x), 1))])
    base = (y.sum() + 1) / (len(y) + 2)
    prior = np.array([*PRIOR, math.log(base / (1 - base)) if len(y) else 0.0])
    pull = np.array([ridge] * len(PRIOR) + [1e-3])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - pull * (w - prior)
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[: len(PRIOR)] = np.maximum(w[: len(PRIOR)], 0)
    return w


def _features(items: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _grammar(items)
        for b in batches:
            rows = [g.features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> dict:
    """The model, a small dict: lexicon and class weights. max_train bounds the labelled rows that are read."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    ids = common.save(ids.orderBy(F.xxhash64("id"), "id").limit(max_train), "train_ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.save(texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("text", "toxic"), "train")
    n = {int(r["toxic"] > 0): r["count"] for r in rows.groupBy("toxic").count().collect()}
    yes, no = n.get(1, 0), n.get(0, 0)
    if not yes or not no:
        common.discard(rows, ids)
        base = (yes + 1) / (yes + no + 2)
        return {"lexicon": {}, "weights": [0.0] * len(CLASSES) + [math.log(base / (1 - base))]}
    counts = rows.mapInArrow(_count, "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    weight = F.log((F.col("yes") + 0.5) / (yes + 1)) - F.log((F.col("no") + 0.5) / (no + 1))
    found = counts.where(F.col("yes") >= 3).withColumn("w", weight).where("w > 3").orderBy(F.desc(F.col("yes") * F.col("w")), "feature").collect()  # words of max_train rows
    names, weights = [r["feature"] for r in found], [float(r["w"]) for r in found]
    known = {x: k for k, x in enumerate(names)}
    incidence = [r["has"] for r in rows.where("toxic > 0").select("text").mapInArrow(_incidence(known), "has array<int>").collect()]
    lexicon = choose_lexicon(incidence, names, weights)
    items = tuple(sorted(lexicon.items()))
    got = rows.select("text", "toxic").mapInArrow(_features(items), "toxic int, x array<double>").collect()
    w = fit_weights(np.array([r["x"] for r in got]), np.array([float(r["toxic"] > 0) for r in got]))
    common.discard(rows, ids)
    return {"lexicon": lexicon, "weights": w.tolist()}


def _score(items: tuple, weights: list[float]):
    w = np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _grammar(items)
        for b in batches:
            x = np.array([g.features(t or "") for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(CLASSES))
            z = np.log1p(x) @ w[:-1] + w[-1]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*names, "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """A row a document: doc_id, score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(tuple(sorted(model["lexicon"].items())), model["weights"]), "doc_id long, score double")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the toxic ones, in docs' own columns."""
    model = train(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_hash().alias("raw"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(tuple(sorted(model["lexicon"].items())), model["weights"]), "doc_id long, raw long, score double")
    bad = common.save(scored.where(F.col("score") >= threshold).select("doc_id", "raw").distinct(), "toxic")
    return common.among(docs, bad, "left_anti")
