"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the words of a clause as symbols and rewrite them: insult turns words with an insulting stem into insults,
strong ones after a word of degree; negation marks insults and
threats in its scope, reported speech marks those that a verb of saying introduces, target
marks those that a pronoun aims at someone, and threat turns a verb of harm before a target into a threat.
They are composed once into a single deterministic machine. What it emits is scored clause by clause: a match weighs its
stem's log-odds among labelled texts, times the weight of its kind (its log-odds, relative to the strongest kind); a text's
features are the weights of its heaviest clause and of all clauses, and a logistic curve fitted to the labels turns them into a score.

Insult stems are learned too: the shortest beginnings of words whose labelled texts are mostly toxic, made longer (to all
their good branches) while together these keep 99 in 100 of those texts, added to a short fixed list. Learning reads at most `train_rows` labelled texts (those with the
least hashes of their ids) and keeps at most `max_stems` stems, the most frequent after that reduction; scoring covers every whole text. Tasks find stems by the hashes of
word beginnings and run the machine on the clauses that hold one.

Defined cases: null and blank texts have no clause and get the score of a text without matches; repeated rows are
scored alike; rows without id are not held out; an id with several texts is trained on the least of them; without labels of both kinds the fixed stems and a fixed curve apply.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .textblocks import prefix_sums, span_hash, utf8_blocks, words

TRAIN_ROWS, MAX_STEMS = 20_000, 4_000
STEM_LENGTHS = tuple(range(3, 9))
MIN_TEXTS, MIN_SHARE = 6, 0.75  # labelled texts with a stem, and the share of them that is toxic
KEPT = 0.99  # share of a stem's toxic texts that its longer branches keep together
THRESHOLD = 0.7
SEED_WEIGHT = 4.0  # log-odds of a stem that no label speaks of

# Seed stems and the closed word classes of the grammar (English, German, French, Spanish).
INSULTS = "idiot moron stupid imbecil scum loser pathetic worthless disgusting dumbass trottel arschloch abschaum connard salaud idiota estúpid".split()
HARM = "kill hurt destroy strangle stab beat punish töte vernichte schlage tuer frapper détruire matar golpear destruir".split()
NEGATIONS = frozenset("not never no isn't aren't don't nicht kein keine niemals pas jamais nunca jamás".split())
REPORTS = frozenset("said says called claimed quoted wrote sagte nannte schrieb dit disait écrivit dijo llamó escribió".split())
TARGETS = frozenset("you your he she they this these du dich ihr sie dieser tu toi vous ce cette tú usted eres este esta".split())
DEGREES = frozenset("very so such total totally absolute absolutely complete utter utterly damn bloody sehr total totaler völlig verdammt absolut très vraiment complètement sacré muy tan totalmente absolutamente maldito".split())
_CLAUSE_END = re.compile(r"[.!?;:]\W*$")

NEGATION, REPORT, TARGET, STEM, DEGREE, VERB, OTHER = "negation", "report", "target", "stem", "degree", "harm", "other"
INSULT, STRONG, AIMED, THREAT = "insult", "strong insult", "insult at target", "threat"
KINDS = (INSULT, STRONG, AIMED, "negated", "reported", THREAT)
SYMBOLS = (NEGATION, REPORT, TARGET, STEM, DEGREE, VERB, OTHER)
_SCOPE = 3  # words that a negation or a verb of harm reaches


class Transducer:
    """A deterministic transducer: `step(state, symbol)` gives the next state and the symbol passed on."""

    def __init__(self, states: int, arcs: dict[tuple[int, str], tuple[int, str]], idle: dict[int, int]):
        self.states, self.arcs, self.idle = states, arcs, idle

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.idle[state], symbol)


def _scope(opener: str, marked: dict[str, str], n: int) -> Transducer:
    """State k > 0: `opener` stood at most n - k + 1 words before."""
    arcs = {(k, opener): (n, opener) for k in range(n + 1)}
    arcs |= {(k, a): (max(k - 1, 0), b) for k in range(1, n + 1) for a, b in marked.items()}
    return Transducer(n + 1, arcs, {k: max(k - 1, 0) for k in range(n + 1)})


def insult() -> Transducer:
    """A word with an insulting stem is an insult, up to two words after a word of degree a strong one; the next in a row of them too."""
    arcs = {(k, DEGREE): (2, DEGREE) for k in range(3)} | {(0, STEM): (0, INSULT)} | {(k, STEM): (2, STRONG) for k in (1, 2)}
    return Transducer(3, arcs, {0: 0, 1: 0, 2: 1})


def threat() -> Transducer:
    """A target up to `_SCOPE` words after a verb of harm is the object of a threat."""
    return _scope(VERB, {TARGET: THREAT}, _SCOPE)


def target() -> Transducer:
    """A target earlier in the clause aims the insults after it."""
    return Transducer(2, {(0, TARGET): (1, TARGET), (1, INSULT): (1, AIMED), (1, STRONG): (1, AIMED)}, {0: 0, 1: 1})


def negation() -> Transducer:
    return _scope(NEGATION, {k: "negated" for k in (INSULT, STRONG, AIMED, THREAT)}, _SCOPE)


def reported() -> Transducer:
    """After a verb of saying, the rest of the clause is someone else's speech."""
    marks = {(1, a): (1, "reported") for a in (INSULT, STRONG, AIMED, THREAT)}
    return Transducer(2, {(0, REPORT): (1, REPORT)} | marks, {0: 0, 1: 1})


#: In the order in which they read: each what the one before it emits.
PARTS = (insult, threat, target, negation, reported)


def compose(a: Transducer, b: Transducer, symbols: Iterable[str]) -> Transducer:
    """The transducer that passes what `a` emits to `b`."""
    arcs = {}
    for p in range(a.states):
        for q in range(b.states):
            for s in symbols:
                p2, middle = a.step(p, s)
                q2, out = b.step(q, middle)
                arcs[p * b.states + q, s] = (p2 * b.states + q2, out)
    return Transducer(a.states * b.states, arcs, {})


def grammar() -> Transducer:
    first, *rest = [part() for part in PARTS]
    for part in rest:
        first = compose(first, part, SYMBOLS)
    return first


def clause_matches(machine: Transducer, symbols: list[str]) -> list[tuple[int, str]]:
    """(word number, kind) of the matches in one clause."""
    state, out = 0, []
    for i, s in enumerate(symbols):
        state, emitted = machine.step(state, s)
        if emitted in KINDS:
            out.append((i, emitted))
    return out


# ---- finding clauses ------------------------------------------------------------------------

class Lexicon:
    """Stems by the hashes of their bytes; a bitmap over 20 bits of the hash rejects most words."""

    def __init__(self, stems: dict[str, float]):
        self.weight = dict(stems) | {s: SEED_WEIGHT for s in HARM}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        names: dict[int, list[bytes]] = {}
        for s in self.weight:
            names.setdefault(len(s.encode()), []).append(s.encode())
        for n, found in names.items():
            raw = np.frombuffer(b"".join(found), np.uint8)
            at = np.arange(len(found)) * n
            h = np.sort(span_hash(prefix_sums(raw), at, at + n))
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[n] = h, bits
        self.longest = max(map(len, self.weight))
        self.harm = frozenset(HARM)

    def hits(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), bool)
        for n, (known, bits) in self.by_length.items():
            long_enough = np.flatnonzero(end - start >= n)
            at = start[long_enough]
            h = span_hash(sums, at, at + n)
            maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            out[long_enough[maybe[np.isin(h[maybe], known)]]] = True
        return out

    def symbol(self, word: str) -> tuple[str, float]:
        """Of the word as a whole (with its inner apostrophes), else of the first stem that a run of letters in it begins with,
        else of the first run that is a word of a closed class."""
        plain = _EDGES.sub("", word)
        runs = list(_RUN.finditer(word))
        for part in (plain, plain.replace("’", "'")):
            if known := self._closed(part):
                return known, 0.0
        for run in runs:
            for n in range(min(len(word) - run.start(), self.longest), 0, -1):
                s = word[run.start(): run.start() + n]
                if s in self.weight:
                    return (VERB if s in self.harm else STEM), self.weight[s]
        return next((known for run in runs if (known := self._closed(run.group()))), OTHER), 0.0

    @staticmethod
    def _closed(word: str) -> str | None:
        return NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else DEGREE if word in DEGREES else None


_RUN = re.compile(r"[^\W_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _run_starts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where a run of letters and digits begins, in words that begin at `start`."""
    inside = _ASCII_LETTER[data]
    if data.max(initial=0) > 127:
        text = data.tobytes().decode()
        inside = inside | (data > 127)
        # characters beyond ASCII that are neither letters nor digits, by the bytes they take
        for c in (c for c in set(text) if c > "\x7f" and not c.isalnum()):
            raw = c.encode()
            at = np.flatnonzero(data[: len(data) - len(raw) + 1] == raw[0])
            for k in range(1, len(raw)):
                at = at[data[at + k] == raw[k]]
            for k in range(len(raw)):
                inside[at + k] = False
    before = np.append(False, inside[:-1])
    before[start] = False  # the row before may end with a letter
    return np.flatnonzero(inside & ~before)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[c for c in range(128) if chr(c).isalnum()]] = True


def text_matches(lexicon: Lexicon, machine: Transducer, batch: pa.RecordBatch):
    """(row, [[(kind, stem weight), ...] a clause]) for the texts of a batch with a match."""
    lowered = pa.RecordBatch.from_arrays([pc.utf8_lower(pc.fill_null(batch.column("text"), ""))], names=["text"])
    for lo, hi, data, offsets in utf8_blocks(lowered, "text"):
        start, end, row = words(data, offsets)
        if not len(start):
            continue
        first = _run_starts(data, start)
        inside = np.searchsorted(start, first, "right") - 1
        first, inside = first[inside >= 0], inside[inside >= 0]
        hit = np.unique(inside[lexicon.hits(prefix_sums(data), first, end[inside])])
        if not len(hit):
            continue
        edge = np.searchsorted(row, np.arange(hi - lo + 1))
        for r in np.unique(row[hit]).tolist():
            a, b = int(edge[r]), int(edge[r + 1])
            mine = hit[(hit >= a) & (hit < b)]
            clauses, done = [], a
            for at in mine.tolist():
                if at < done:
                    continue
                left = at
                while left > done and not _ends(data, start, end, left - 1):
                    left -= 1
                right = at
                while right < b - 1 and not _ends(data, start, end, right):
                    right += 1
                known = [lexicon.symbol(bytes(data[start[k]: end[k]]).decode()) for k in range(left, right + 1)]
                found = clause_matches(machine, [s for s, _ in known])
                if found:
                    # a threat is weighed by itself, an insult by its stem
                    clauses.append([(kind, known[i][1] or SEED_WEIGHT) for i, kind in found])
                done = right + 1
            if clauses:
                yield lo + r, clauses


def _ends(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> bool:
    """Does a clause end after word k: by its punctuation, or by a line end before the next word?"""
    if data[end[k] - 1] in b".!?;:" or end[k] - start[k] > 1 and _CLAUSE_END.search(bytes(data[start[k]: end[k]]).decode()):
        return True
    return k + 1 < len(start) and 10 in data[end[k]: start[k + 1]]


def _match_rows(stems: dict[str, float]):
    def run(batches):
        lexicon, machine = Lexicon(stems), grammar()
        for batch in batches:
            found = list(text_matches(lexicon, machine, batch))
            if found:
                ids = batch.column("doc_id").take(pa.array([r for r, _ in found]))
                share = [[max((w for c in clauses for kind, w in c if kind == k), default=0.0) for k in KINDS] for _, clauses in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(share, pa.list_(pa.float64()))], names=["doc_id", "kinds"])

    return run


def _feature(clauses: list[list[tuple[str, float]]], weights: dict[str, float]) -> tuple[float, float]:
    sums = [sum(weights[k] * w for k, w in c) for c in clauses]
    return (float(np.log1p(max(sums))), float(np.log1p(sum(sums)))) if sums else (0.0, 0.0)


def _scored(model):
    def run(batches):
        lexicon, machine = Lexicon(model.stems), grammar()
        for batch in batches:
            heaviest, total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for r, clauses in text_matches(lexicon, machine, batch):
                heaviest[r], total[r] = _feature(clauses, model.weights)
                n[r] = len(clauses)
            z = model.curve[0] + model.curve[1] * heaviest + model.curve[2] * total
            score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "held_out")], pa.array(score), pa.array(n)], names=["doc_id", "held_out", "score", "n_clauses"])

    return run


class Model:
    def __init__(self, stems: dict[str, float], weights: dict[str, float], curve: tuple[float, float, float]):
        self.stems, self.weights, self.curve = stems, weights, curve


def default_model() -> Model:
    return Model({s: SEED_WEIGHT for s in INSULTS}, {INSULT: 0.8, STRONG: 1.0, AIMED: 1.0, "negated": 0.3, "reported": 0.3, THREAT: 1.0}, (-3.0, 1.5, 1.5))


def learned_stems(texts: DataFrame, prior: float, max_stems: int = MAX_STEMS) -> dict[str, float]:
    """Stems of `texts` (doc_id, text, toxic) and their log-odds beyond the `prior`; equal texts count once."""
    once = texts.select(F.lower("text").alias("text"), "toxic").dropDuplicates(["text"])
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))).alias("word")
    by_word = once.select("toxic", word).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    stem = F.explode(F.transform(F.array(*[F.lit(n) for n in STEM_LENGTHS]), lambda n: F.substring("word", F.lit(1), n))).alias("stem")
    by_stem = by_word.select(stem, "word", "toxic", "n").distinct().groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    good = by_stem.where((F.length("stem") >= STEM_LENGTHS[0]) & (F.col("toxic") >= MIN_TEXTS) & (F.col("toxic") >= MIN_SHARE * F.col("n")))
    # stems of at least MIN_TEXTS of at most `train_rows` texts
    return reduced_stems({r.stem: (int(r.toxic), int(r.n)) for r in good.collect()}, prior, max_stems)


def reduced_stems(good: dict[str, tuple[int, int]], prior: float, max_stems: int) -> dict[str, float]:
    """The shortest good beginnings, each replaced by all its good branches while these keep `KEPT` of its toxic texts; at most `max_stems`."""
    branches: dict[str, list[str]] = {}
    for s in good:
        branches.setdefault(s[:-1], []).append(s)
    chosen: list[str] = []
    for root in good:
        if any(root[:n] in good for n in range(1, len(root))):
            continue
        front = [root]
        while True:
            longer = [b for s in front for b in branches.get(s, [s] if len(s) < max(map(len, front)) else [])]
            if not longer or longer == front or sum(good[s][0] for s in longer) < KEPT * good[root][0]:
                break
            front = longer
        chosen += front
    chosen.sort(key=lambda s: (-good[s][0], s))
    return {s: float(np.log((good[s][0] + 0.5) / (good[s][1] - good[s][0] + 0.5)) + prior) for s in chosen[:max_stems]}


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, max_stems: int = MAX_STEMS) -> Model:
    """A model from `labels` (doc_id, toxic 0 or 1) of `docs` (doc_id, text)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows ids
    texts = staged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "training-texts")
    n_toxic, n_all = texts.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not n_toxic or n_toxic == n_all:
        return default_model()
    stems = learned_stems(texts, float(np.log((n_all - n_toxic) / n_toxic)), max_stems)
    stems |= {s: SEED_WEIGHT for s in INSULTS if not any(s[:n] in stems for n in range(1, len(s) + 1))}
    matched = texts.select("doc_id", "text").mapInArrow(_match_rows(stems), "doc_id bigint, kinds array<double>").join(texts.select("doc_id", "toxic"), "doc_id")
    counts = matched.select("toxic", *[(F.get("kinds", F.lit(k)) > 0).cast("int").alias(f"k{k}") for k in range(len(KINDS))]).groupBy("toxic").agg(*[F.sum(f"k{k}").alias(f"k{k}") for k in range(len(KINDS))]).collect()
    by = {r.toxic: r for r in counts}
    n = {1: n_toxic, 0: n_all - n_toxic}
    weights = {kind: float(np.log(((by[1][f"k{k}"] if 1 in by else 0) + 0.5) / (n[1] + 1)) - np.log(((by[0][f"k{k}"] if 0 in by else 0) + 0.5) / (n[0] + 1))) for k, kind in enumerate(KINDS)}
    for k in (STRONG, AIMED):  # where labels say little of them, no less than of any insult
        weights[k] = max(weights[k], weights[INSULT])
    strongest = max(max(weights.values()), 1e-9)
    weights = {k: max(w, 0.0) / strongest for k, w in weights.items()}
    first = Model(stems, weights, (0.0, 1.0, 0.0))
    scored = texts.select("doc_id", "text", F.lit(False).alias("held_out")).mapInArrow(_features(first), "doc_id bigint, heaviest double, total double").join(texts.select("doc_id", "toxic"), "doc_id")
    rows = scored.select("heaviest", "total", "toxic").orderBy("doc_id").toArrow()  # at most train_rows
    x = np.column_stack([rows.column(c).to_numpy() for c in ("heaviest", "total")])
    return Model(stems, weights, fit_curve(x, rows.column("toxic").to_numpy().astype(float)))


def _features(model):
    def run(batches):
        lexicon, machine = Lexicon(model.stems), grammar()
        for batch in batches:
            x = np.zeros((batch.num_rows, 2))
            for r, clauses in text_matches(lexicon, machine, batch):
                x[r] = _feature(clauses, model.weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "heaviest", "total"])

    return run


def score_texts(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, n_clauses, predicted) of every row of `docs` (doc_id bigint, text string)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    out = rows.mapInArrow(_scored(model), "doc_id bigint, held_out boolean, score double, n_clauses bigint")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
