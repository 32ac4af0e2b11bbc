"""Toxicity by a weighted grammar over clauses.

A text is cut into clauses. Words become symbols (insult, threat, target, negation, reported speech,
other) by a lexicon, and a clause's symbols run through one transducer, composed of four small ones:
negation turns insults and threats close behind it into denied ones, reported speech turns those after
it into quoted ones, target marks those next to somebody addressed, and the last turns what is left into
events. A text is scored by the events of its clauses, so the same word counts differently when it is
denied, quoted or aimed at somebody.

The lexicon starts from the fixed words below and learns further insults: words and word stems that
many toxic and next to no clean training texts hold, picked greedily by the toxic texts they add. The
weights of the events are learned by ridge-regularised logistic regression around the prior weights.
Both use at most ``TRAIN_ROWS`` labelled texts, the first by a hash of their ids; texts that are copies of
each other count once. Only the text is read to score it.

Null and empty texts have no clause and get the score of a text without events. Repeated rows repeat.
Rows without a label or text are not learned from; without any labelled row the prior weights hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import freeze, map_batches

#: Labelled texts that are learned from at most.
TRAIN_ROWS = 20_000
#: A learned stem is in so many toxic training texts that no earlier stem is in, and so rarely in clean ones.
STEM_SUPPORT, STEM_CLEAN = 5, 0.05
STEM_LENGTHS = range(4, 9)
#: Words within which a negation or a target reaches.
REACH = 3

# fixed values: the seed lexicon
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb",
           "imbecile", "idiota", "estúpido", "basura", "imbécile", "connard", "idiote", "dummkopf", "trottel", "abschaum")
THREATS = ("kill", "murder", "destroy", "hurt", "stab", "shoot", "matar", "tuer", "töten", "umbringen")
TARGETS = ("you", "your", "you're", "du", "dich", "ihr", "tu", "toi", "vous", "usted", "ustedes", "ti")
NEGATIONS = ("not", "never", "isn't", "aren't", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "called", "calls", "quoted", "wrote", "alleged", "sagte", "dit", "dijo")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
#: Events of the grammar and their prior weights.
PRIOR = {"insult": 6.0, "threat": 2.0, "aimed insult": 2.0, "aimed threat": 4.0, "denied insult": 0.5,
         "denied threat": 0.0, "quoted insult": 1.0, "quoted threat": 0.2}
EVENTS = tuple(PRIOR)
PRIOR_BIAS, RIDGE = -3.0, 0.5

_CLAUSE_END = re.compile(r"[.!?;:,\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass
class Transducer:
    """A finite-state machine: ``arcs[state, symbol] = (next state, symbols put out)``."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, tuple[str, ...]]] = field(default_factory=dict)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, put = self.arcs[state, symbol]
            out += put
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine that does what ``second`` does with what ``first`` puts out; states reached only."""
    names = {(first.start, second.start): 0}
    out, todo = Transducer(0), [(first.start, second.start)]
    symbols = {s for _, s in first.arcs}
    while todo:
        pair = todo.pop()
        for symbol in symbols:
            left, middle = first.arcs[pair[0], symbol]
            right, put = pair[1], []
            for m in middle:
                right, p = second.arcs[right, m]
                put += p
            to = (left, right)
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            out.arcs[names[pair], symbol] = (names[to], tuple(put))
    return out


def negation(symbols: set[str]) -> Transducer:
    """State: words that a negation still reaches."""
    t = Transducer(0)
    for left in range(REACH + 1):
        for s in symbols:
            if s == NEGATION:
                t.arcs[left, s] = (REACH, (OTHER,))
            elif s in (INSULT, THREAT) and left:
                t.arcs[left, s] = (left - 1, (f"denied {s}",))
            else:
                t.arcs[left, s] = (max(0, left - 1), (s,))
    return t


def reported(symbols: set[str]) -> Transducer:
    """State: whether the rest of the clause is somebody else's words."""
    t = Transducer(0)
    for quoting in (0, 1):
        for s in symbols:
            if s == REPORT:
                t.arcs[quoting, s] = (1, (OTHER,))
            else:
                t.arcs[quoting, s] = (quoting, (f"quoted {s}",) if quoting and s in (INSULT, THREAT) else (s,))
    return t


def aimed(symbols: set[str]) -> Transducer:
    """States: 0 nothing near, 1.. a target so near, then an insult so near, then a threat so near."""
    t = Transducer(0)
    state = lambda kind, left: 0 if left <= 0 else 1 + kind * REACH + left - 1
    cells = [(0, 0)] + [(kind, left) for kind in range(3) for left in range(1, REACH + 1)]
    for kind, left in cells:
        for s in symbols:
            here = state(kind, left)
            if s in (INSULT, THREAT):
                near = kind == 0 and left > 0
                t.arcs[here, s] = (state(1 if s == INSULT else 2, REACH), (s, f"aimed {s}") if near else (s,))
            elif s == TARGET:
                put = (f"aimed {INSULT if kind == 1 else THREAT}",) if kind and left else ()
                t.arcs[here, s] = (state(0, REACH), put)
            else:
                t.arcs[here, s] = (state(kind, left - 1), () if s == OTHER else (s,))
    return t


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    first = {INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER}
    second = (first - {NEGATION}) | {"denied insult", "denied threat"}
    third = (second - {REPORT}) | {"quoted insult", "quoted threat"}
    return compose(compose(negation(first), reported(second)), aimed(third))


@dataclass(frozen=True)
class Model:
    """Learned stems and the weights of the events; a few kilobytes."""

    stems: tuple[str, ...] = ()
    weights: tuple[float, ...] = tuple(PRIOR.values())
    bias: float = PRIOR_BIAS


@lru_cache(maxsize=4)
def _lexicon(stems: tuple[str, ...]):
    """An automaton that finds insults and threats, and the whole words of each symbol."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for s in stems:
        found.add_word(s, (len(s), INSULT, False))
    for kind, words in ((INSULT, INSULTS), (THREAT, THREATS)):
        for w in words:
            found.add_word(w, (len(w), kind, True))
    found.make_automaton()
    whole = {w: kind for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
    return found, whole


def events(text: str, stems: tuple[str, ...]) -> Counter:
    """Events of all clauses that hold an insult or a threat; the other clauses have none."""
    found, whole = _lexicon(stems)
    text = text.lower()
    hits: dict[int, str] = {}
    for end, (n, kind, complete) in found.iter(text):
        start = end - n + 1
        if (start == 0 or not text[start - 1].isalpha()) and not (complete and text[end + 1:end + 2].isalpha()):
            hits[start] = kind
    out: Counter = Counter()
    if not hits:
        return out
    # clause ends and hits in one walk: a clause is read whole, however long it is
    ends = chain((m.start() for m in _CLAUSE_END.finditer(text)), [len(text)])
    begin, done = 0, -1
    for start in sorted(hits):
        if start < done:
            continue
        while done < start:
            begin, done = done + 1, next(ends)
        symbols = [hits.get(m.start()) or whole.get(m.group(), OTHER) for m in _WORD.finditer(text, begin, done)]
        out.update(grammar().run(symbols))
    return out


def vector(text: str, stems: tuple[str, ...]) -> list[float]:
    found = events(text, stems)
    return [math.log1p(found[e]) for e in EVENTS]


def score_text(text: str, model: Model) -> float:
    z = model.bias + sum(w * x for w, x in zip(model.weights, vector(text, model.stems)))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def score(model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t or "", model) for t in texts], dtype="float64")

    return scored(text)


def training_set(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``text`` and ``label`` of at most ``train_rows`` labelled texts, copies once."""
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # at most train_rows rows of two numbers
    joined = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return freeze(joined.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"),
                                                                   F.max("label").alias("label")), "toxicity_rows")


def _stems(text: str) -> set[str]:
    out = set()
    for m in _WORD.finditer(text.lower()):
        w = m.group()
        if len(w) >= STEM_LENGTHS[0]:
            out.update(w[:n] for n in STEM_LENGTHS if n < len(w))
            out.add(w)
    return out


def learn_stems(rows: DataFrame) -> tuple[str, ...]:
    """Greedy cover of the toxic training texts by stems that clean ones hardly hold."""
    def toxic(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
            found = list(_stems(text))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([h] * len(found), pa.int64())], ["stem", "h"])

    posts = map_batches(rows.where("label = 1").select("h", "text"), toxic, "stem string, h long")
    posts = freeze(posts.groupBy("stem").agg(F.collect_list("h").alias("texts")).where(F.size("texts") >= STEM_SUPPORT), "stems")
    # prefixes of one word that are in the same texts are one candidate, the longest
    alike = posts.groupBy(F.xxhash64(F.array_sort("texts")).alias("k"), F.size("texts").alias("n")).agg(
        F.max_by(F.struct("stem", "texts"), F.struct(F.length("stem"), "stem")).alias("best")).select("best.*")
    posts = freeze(alike, "stems")
    wanted = {r.stem for r in posts.select("stem").collect()}  # bounded by the words of the training texts

    def clean(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(_stems(text) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["stem", "n"])

    counts = {r.stem: r.n for r in rows.where("label = 0").select("text").mapInArrow(clean, "stem string, n long")
              .groupBy("stem").agg(F.sum("n").alias("n")).collect()}
    texts = {r.stem: set(r.texts) for r in posts.collect() if counts.get(r.stem, 0) <= STEM_CLEAN * len(r.texts)}
    chosen, covered = [], set()
    gain = lambda s: (len(texts[s] - covered), -counts.get(s, 0), -len(s), s)
    known = {s: set() for s in INSULTS}
    for s in texts:
        if s in known:
            covered |= texts[s]
    while texts and len(texts[best := max(texts, key=gain)] - covered) >= STEM_SUPPORT:
        chosen.append(best)
        covered |= texts.pop(best)
        texts = {s: t for s, t in texts.items() if len(t - covered) >= STEM_SUPPORT}
    return tuple(sorted(chosen))


def learn_weights(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Newton steps for logistic regression, drawn to the prior weights."""
    prior = np.array([*PRIOR.values(), PRIOR_BIAS])
    w, x = prior.copy(), np.column_stack([x, np.ones(len(x))])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(rows: DataFrame) -> Model:
    """``rows``: a training set. One short vector per training text comes to the driver."""
    stems = learn_stems(rows)

    def vectors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [vector(t, stems) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.float64()))], ["label", "x"])

    got = map_batches(rows.select("label", "text"), vectors, "label int, x array<double>").toPandas()
    if not len(got):
        return Model()
    got = got.assign(k=got["x"].map(tuple)).sort_values(["k", "label"])
    weights, bias = learn_weights(np.array(got["x"].tolist()), got["label"].to_numpy(float))
    return Model(stems, tuple(float(w) for w in weights), bias)
