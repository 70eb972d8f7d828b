"""Toxicity by a weighted finite-state pattern grammar.

A clause's words become symbols (insult, threat, target, negation, reported speech, other) and a last one for its end.
Two transducers say of insults and threats whether they are negated or reported; a third reads what these write and
finds the clauses that count: an insult with a target near it, a clause that is hardly more than an insult (vocative),
a threat with its target. Their composition is one machine, whose states are built as texts reach them. What it emits,
by weight, are the document's features, and a logistic model makes them a score.

An insult or threat outside such a clause is a lone word: it has features of its own, which weigh what the labels teach
and nothing without labels. One that its clause negates or reports weighs a part of one that it asserts, and such marks
never raise a score. A report holds over a colon and as long as a quotation does.

The insult lexicon and the model are fitted on a bounded sample of labelled rows (sample, by a hash of the id): words
and five-letter stems that tell toxic from other documents beyond chance (G-test, Bonferroni over a million features).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import carried, small_batches, written

#: Seed word lists, in English, German, French and Spanish; small and general, the lexicon is learned besides. Fixed values.
SEEDS = {
    "insult": (
        "idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "pathetic", "worthless",
        "disgusting", "clown", "dumb", "dummkopf", "trottel", "abschaum", "idiota", "estupido", "imbécile",
        "imbecile", "connard", "basura", "escoria", "crétin",
    ),
    "threat": (
        "kill", "hurt", "destroy", "beat", "burn", "shoot", "töten", "umbringen", "vernichten", "tuer", "frapper",
        "détruire", "matar", "golpear", "destruir",
    ),
    "target": (
        "you", "your", "youre", "u", "du", "dich", "dir", "euch", "ihr", "tu", "te", "toi", "vous", "vos", "usted",
        "ustedes", "tú", "vosotros", "they", "them", "he", "she", "him", "her",
    ),
    "negation": (
        "not", "never", "no", "dont", "isnt", "arent", "nicht", "nie", "kein", "keine", "pas", "jamais", "aucun",
        "nunca", "ningún", "ni",
    ),
    "reported": (
        "said", "says", "wrote", "claimed", "quoted", "told", "sagte", "sagt", "schrieb", "behauptete", "dit",
        "disait", "écrit", "dijo", "dice", "escribió",
    ),
}
SYMBOLS = ("insult", "threat", "target", "negation", "reported", "other", "end")
STEM = 5
#: What a clause weighs, and a lone word, before negation and report change that; and what these leave of it.
CLAUSES, LONE = {"insult": 1.5, "vocative": 1.0, "threat": 0.75}, {"lone insult": 1.0, "lone threat": 0.5}
NEGATED, REPORTED = 0.3, 0.5
#: Words back and on in which an insult's target stands, and on for a threat's; a vocative's words, and how many of them are no insults.
BACK, ON, VOCATIVE, BESIDE = 4, 3, 4, 2
_WORD, _CLAUSE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;:\n]+")
#: A quotation, and how far from it what reports it stands.
_QUOTED, NEAR = re.compile(r"[\"“„«][^\"“”„«»]*[\"”“»]"), 60


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) to (next state, marks); what is not listed keeps the state and writes nothing."""

    start: object
    arcs: dict = field(hash=False)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, ()))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Runs both over the same symbols; marks add up. Only states that can be reached are built."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        s, t = todo.pop()
        for x in SYMBOLS:
            (s2, m), (t2, n) = a.step(s, x), b.step(t, x)
            arcs[(s, t), x] = ((s2, t2), m + n)
            if (s2, t2) not in seen:
                seen.add((s2, t2))
                todo.append((s2, t2))
    return Transducer(start, arcs)


def _window(opener: str, mark: str, reach: int) -> Transducer:
    """Marks insults and threats up to reach words after an opener."""
    arcs = {}
    for state in range(reach + 1):
        for x in SYMBOLS:
            arcs[state, x] = (max(0, state - 1), (mark,) if state and x in ("insult", "threat") else ())
        arcs[state, opener] = (reach, ())
    return Transducer(0, arcs)


def modifiers() -> Transducer:
    """negated within 3 words, reported to the clause's end."""
    reported = Transducer(0, {(0, "reported"): (1, ()), **{(1, x): (1, ("reported",)) for x in ("insult", "threat")}})
    return compose(_window("negation", "negated", 3), reported)


@dataclass(frozen=True)
class Clause:
    """The third transducer: what of a clause has been read. waiting: insults and threats whose target may still come."""

    target: int = 0  # words in which an insult still has the last target behind it
    aimed: bool = False  # there was a target
    words: int = 0
    beside: int = 0  # words that are no insults
    waiting: tuple = ()  # (kind, words since, negated, reported)

    def step(self, x: str, marks: tuple) -> tuple[Clause, tuple]:
        out, waiting = [], [(k, n + 1, a, b) for k, n, a, b in self.waiting]
        if x == "end":
            short = self.words <= VOCATIVE and self.beside <= BESIDE and not self.aimed
            return Clause(), tuple(("vocative" if short and k == "insult" else f"lone {k}", a, b) for k, _, a, b in waiting)
        out += [(f"lone {k}", a, b) for k, n, a, b in waiting if n > ON]
        waiting = [w for w in waiting if w[1] <= ON]
        if x == "target":
            out += [(k, a, b) for k, _, a, b in waiting]
            waiting = []
        if x in ("insult", "threat"):
            own = "negated" in marks, "reported" in marks
            if x == "insult" and self.target:
                out.append((x, *own))
            else:
                waiting.append((x, 0, *own))
        target = BACK if x == "target" else max(0, self.target - 1)
        return Clause(target, self.aimed or x == "target", min(self.words + 1, VOCATIVE + 1), min(self.beside + (x != "insult"), BESIDE + 1), tuple(waiting)), tuple(out)


class Machine:
    """The cascade of the modifiers and the clause, built as it is walked; its states are few, as all counts end early."""

    def __init__(self):
        self.modifiers, self.arcs = modifiers(), {}
        self.start = (self.modifiers.start, Clause())

    def step(self, state, symbol: str) -> tuple[object, tuple]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            first, marks = self.modifiers.step(state[0], symbol)
            second, out = state[1].step(symbol, marks)
            arc = self.arcs[state, symbol] = (first, second), out
        return arc


def grammar() -> Machine:
    return Machine()


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, str]
    stems: frozenset[str] = frozenset()

    def symbol(self, word: str) -> str:
        known = self.words.get(word)
        return known or ("insult" if word[:STEM] in self.stems and len(word) >= STEM else "other")


def seed_lexicon() -> Lexicon:
    return Lexicon({w: kind for kind in ("target", "negation", "reported", "threat", "insult") for w in SEEDS[kind]})


FEATURES = ("one", "two", "three", "weight", "aimed", "threats", "negated", "reported", "density", "lone", "lone_one", "lone_two", "lone_three", "lone_density")


def clauses(low: str, lexicon: Lexicon, loud: set[str]) -> Iterator[tuple[list[str], bool]]:
    """The clauses with a word of loud: their words, and whether the clause is part of what someone is reported to say."""
    reports = lambda text: any(lexicon.symbol(w) == "reported" for w in _WORD.findall(text))
    spoken = []
    for q in _QUOTED.finditer(low):
        before = _CLAUSE.split(low[max(0, q.start() - NEAR) : q.start()].rstrip(" :"))[-1]
        if reports(before) or reports(_CLAUSE.split(low[q.end() : q.end() + NEAR])[0]):
            spoken.append((q.start(), q.end()))
    begin, held, k = 0, False, 0
    for m in [*_CLAUSE.finditer(low), None]:
        end = m.start() if m else len(low)
        part = low[begin:end]
        words = _WORD.findall(part)
        while k < len(spoken) and spoken[k][1] <= begin:
            k += 1
        if not loud.isdisjoint(words):
            yield words, held or k < len(spoken) and spoken[k][0] < end
        held = m is not None and ":" in m[0] and reports(part)
        begin = m.end() if m else end


def features(text: str | None, lexicon: Lexicon, machine: Machine) -> list[float]:
    """What the machine emits over a text's clauses.

    one, two, three, weight, density: of clauses, by the weight of their kind and what negation and report leave of it.
    aimed, threats: asserted ones. lone and the rest: the same of lone words.
    """
    low = (text or "").lower()
    own = _WORD.findall(low)
    loud = {w for w in set(own) if lexicon.symbol(w) in ("insult", "threat")}
    if not loud:
        return [0.0] * len(FEATURES)
    weight = lone = 0.0
    marks = dict.fromkeys(("aimed", "threats", "negated", "reported"), 0)
    for words, spoken in clauses(low, lexicon, loud):
        state = machine.start
        for x in [*map(lexicon.symbol, words), "end"]:
            state, out = machine.step(state, x)
            for kind, negated, reported in out:
                reported = reported or spoken
                left = (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
                weight += CLAUSES.get(kind, 0.0) * left
                lone += LONE.get(kind, 0.0) * left
                marks["negated"] += negated
                marks["reported"] += reported
                if not negated and not reported:
                    marks["aimed"] += kind == "insult"
                    marks["threats"] += kind == "threat"
    log = lambda v: float(np.log1p(v))
    reach = lambda v: [float(v >= k - 1e-9) for k in (1, 2, 3)]
    dense = lambda v: min(1.0, 20 * v / len(own))
    return [*reach(weight), log(weight), *(log(n) for n in marks.values()), dense(weight), log(lone), *reach(lone), dense(lone)]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last coefficient is the intercept, which is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Without both labels in the sample: two insulting clauses tip the score, lone words do not move it.
PRIOR = np.asarray([4.0 if name == "two" else float(name == "weight") for name in FEATURES] + [-3.0])


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _evidence(labelled: DataFrame) -> DataFrame:
    """feature (word, or stem and *), bad, good: documents of each label with it."""

    def run(batches):
        for b in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = set(_WORD.findall((text or "").lower()))
                for f in own | {w[:STEM] + "*" for w in own if len(w) >= STEM}:
                    counts.setdefault(f, [0, 0])[1 - y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["feature", "bad", "good"])

    return labelled.mapInArrow(run, "feature string, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn_lexicon(labelled: DataFrame, n_bad: int, n_good: int, g_least: float = 25.0) -> Lexicon:
    """The seeds, and the features whose G statistic is beyond chance and of whose documents over half are toxic.

    The words of three or more documents of the sample bound them.
    """
    n = n_bad + n_good
    bad, good = F.col("bad").cast("double"), F.col("good").cast("double")
    cell = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * n / (row * col))).otherwise(0.0)
    has = bad + good
    g = 2 * (cell(bad, has, F.lit(float(n_bad))) + cell(good, has, F.lit(float(n_good))) + cell(n_bad - bad, n - has, F.lit(float(n_bad))) + cell(n_good - good, n - has, F.lit(float(n_good))))
    rows = _evidence(labelled).where((F.col("bad") >= 3) & (2 * F.col("bad") > has)).withColumn("g", g).where(F.col("g") >= g_least).select("feature").collect()
    seeds = seed_lexicon()
    learned = {r["feature"]: "insult" for r in rows if not r["feature"].endswith("*")}
    # What the seeds know stays: a target that toxic documents name more often is a target still.
    return Lexicon(learned | seeds.words, frozenset(r["feature"][:-1] for r in rows if r["feature"].endswith("*")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> Model:
    """Learns from at most sample labelled rows, none of them held out; rows without a label are left out."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    picked = known.groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    train = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked.withColumnRenamed(id_col, "_k")), F.col("_id") == F.col("_k")).select("text", "toxic")
    train = written(train.withColumn("toxic", (F.col("toxic") > 0).cast("int")), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(seed_lexicon(), PRIOR)
    lexicon = learn_lexicon(train, n[1], n[0])
    names = [*FEATURES, "y"]

    def run(batches):
        machine = grammar()
        for b in batches:
            rows = [[*features(t, lexicon, machine), float(y)] for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], names)

    seen = train.mapInArrow(run, ", ".join(f"{x} double" for x in names)).groupBy(*names).count().toPandas()
    x, w = seen[list(FEATURES)].to_numpy(), seen["count"].to_numpy()
    at = np.repeat(np.arange(len(x)), w)  # sample rows at most
    y = seen["y"].to_numpy()[at]
    free = np.ones(len(FEATURES), bool)
    while True:  # a mark of negation or report that would raise the score goes out of the model
        w = np.zeros(len(FEATURES) + 1)
        w[np.append(free, True)] = logistic(x[at][:, free], y)
        wrong = [i for i, name in enumerate(FEATURES) if name in ("negated", "reported") and w[i] > 0]
        if not wrong:
            return Model(lexicon, w)
        free[wrong] = False


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The keep columns of docs, score (0 to 1) and predicted (1 from 0.5 up); every text whole, a null one as empty."""
    small_batches(docs.sparkSession)
    keep = carried(docs, keep, ("score", "predicted"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        machine, w = grammar(), model.coefficients
        for b in batches:
            x = np.asarray([features(t, model.lexicon, machine) for t in b.column("__text__").to_pylist()]).reshape(-1, len(FEATURES))
            s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text_col).alias("__text__")).mapInArrow(run, f"{kinds}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> DataFrame:
    """id, held_out, score and predicted of every row.

    Neither labels nor any column but the text enters a score. Texts of any length count whole, a clause at a time.
    Nulls: a null text scores as an empty one; a null id
    is never held out; labels that are null or have no document teach nothing, conflicting ones count as toxic.
    Repeated rows score alike. Without labels of both kinds a fixed prior over the seeds scores. No rows give none.
    """
    model = fit(docs, labels, id_col, text_col, sample)
    scored = score(docs, model, text_col, [id_col])
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
