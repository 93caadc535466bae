"""Toxicity of texts by a weighted grammar of finite-state transducers.

Words become signs: insult, address (the target), negation, report (someone else's words),
threat modal, threat verb. Small transducers each read the signs of a clause and keep one
thing in mind: whether a target, a negation just before, a report, or a modal came. They are
composed into one machine whose states are the tuples of theirs; where it reads an insult, or
a threat verb after a modal, it puts out a match that names what was in mind. A text's score
is the logistic function of the weighted numbers of its matches: no word counts outside its
clause's pattern.

Two parts are learned from labelled rows: further insult words with their stems (words that occur
in toxic rows nearly always, too often for chance), and the weights of the matches. Learning
reads at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of ``doc_id``.

Nulls and edges: a null or empty text has no match and gets the score of such texts. Rows of
``labels`` with a null id or label teach nothing; of several labels for one id the highest
holds. Without any label the weights stay at a prior. A table without rows gives none;
repeated rows are scored alike. Long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import slices, stored
from punctual.llm.words import Words

#: Labelled rows read to learn from.
SAMPLE_ROWS = 20_000
STEM_BYTES = range(4, 9)
THRESHOLD = 0.3
#: Text read at once: a task holds about thirty times as much in arrays.
SLICE_BYTES = 1 << 20

INSULT, TARGET, NEGATION, REPORT, MODAL, THREAT = range(6)
# Function words of the four languages of the corpus: fixed lists.
SIGNS = {
    TARGET: "you your yourself youre he she they them him her u tu te toi vous votre il elle ils du dich dir ihr euch "
            "sie er usted ustedes vosotros él ella ellos",
    NEGATION: "not no never nobody isnt arent dont doesnt without pas jamais aucun ni sans nicht kein keine nie niemals "
              "ohne nunca jamás ningún sin tampoco",
    REPORT: "said says say told called calls wrote writes quote quoted reported claimed dit disait écrit appelle sagte "
            "sagt schrieb nannte zitat dijo dice escribió llamó",
    MODAL: "will ill gonna going shall must should want vais va veux dois werde wird will muss soll voy vamos quiero debo",
    THREAT: "kill hurt destroy beat burn shoot stab hang crush tuer frapper détruire brûler töten schlagen vernichten "
            "verbrennen matar golpear destruir quemar",
}
# Common insults known before anything is learned: a fixed list.
INSULTS = (
    "idiot moron imbecile fool stupid dumb scum trash filth vermin clown loser jerk creep bastard pathetic worthless "
    "disgusting despicable dummkopf trottel abschaum idiote crétin connard ordure idiota imbécil escoria basura"
)
#: Words after a negation in which it still holds.
REACH = 3


class Machine:
    """A transducer by its transition function: ``step(state, sign)`` gives the next state;
    its state is what the composed machine's output reads."""

    def __init__(self, states: int, step):
        self.table = [[step(s, sign) for sign in range(-1, 6)] for s in range(states)]


def _machines() -> list[Machine]:
    target = Machine(2, lambda s, sign: 1 if sign == TARGET else s)
    negation = Machine(REACH + 1, lambda s, sign: REACH if sign == NEGATION else max(0, s - 1))
    report = Machine(2, lambda s, sign: 1 if sign == REPORT else s)
    modal = Machine(2, lambda s, sign: 1 if sign == MODAL else s)
    return [target, negation, report, modal]


#: Kinds of matches: what was said about whom, and how.
MATCHES = ["insult", "insult to a target", "negated insult", "reported insult", "threat", "threat to a target",
           "negated or reported threat"]


def _output(state: tuple[int, ...], sign: int) -> int:
    target, negation, report, modal = state
    if sign == INSULT:
        return 2 if negation else 3 if report else 1 if target else 0
    if sign == THREAT and modal:
        return 6 if negation or report else 5 if target else 4
    return -1


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The product machine: next state and output by (state, sign + 1)."""
    machines = _machines()
    states = list(itertools.product(*(range(len(m.table)) for m in machines)))
    place = {s: i for i, s in enumerate(states)}
    step = [[place[tuple(m.table[x][sign + 1] for m, x in zip(machines, s))] for sign in range(-1, 6)] for s in states]
    out = [[_output(s, sign) for sign in range(-1, 6)] for s in states]
    return np.array(step), np.array(out)


@dataclass
class Grammar:
    """What was learned; small enough to go with every task."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    #: Per kind of match, and of texts without any.
    weights: list[float] = field(default_factory=lambda: [1.5, 2.0, 0.3, 0.3, 2.0, 3.0, 0.5])
    base: float = -3.0


class Reader:
    """Matches of a grammar in many texts."""

    def __init__(self, grammar: Grammar):
        signs = {w: sign for sign, words in SIGNS.items() for w in words.split()}
        signs |= {w: INSULT for w in [*INSULTS.split(), *grammar.words]}
        known = Words([w.encode() for w in signs])
        whole = np.diff(known.bounds) == 1  # a word that is one by the pattern
        order = np.argsort(known.hash[known.bounds[:-1][whole]])
        self.hashes = known.hash[known.bounds[:-1][whole]][order]
        self.signs = np.array(list(signs.values()))[whole][order]
        self.stems = {
            n: np.sort(np.array([int.from_bytes(s.encode(), "little") for s in grammar.stems if len(s.encode()) == n], np.uint64))
            for n in {len(s.encode()) for s in grammar.stems}
        }
        self.step, self.out = compose()

    def matches(self, texts: pa.Array) -> np.ndarray:
        """(texts, kinds): the number of matches."""
        lowered = pc.utf8_lower(pc.fill_null(texts, ""))
        words = Words([t.encode() for t in lowered.to_pylist()])
        counts = np.zeros((len(texts), len(MATCHES)), np.int64)
        if not len(words.first):
            return counts
        at = np.searchsorted(self.hashes, words.hash).clip(max=len(self.hashes) - 1)
        sign = np.where(self.hashes[at] == words.hash, self.signs[at], -1)
        data = np.frombuffer(words.raw + b"\0" * 8, np.uint8)
        starts = np.lib.stride_tricks.sliding_window_view(data, 8)[words.first]
        starts = np.ascontiguousarray(starts).view(np.uint64).reshape(-1)
        sizes = words.last - words.first
        for n, stems in self.stems.items():
            key = starts & np.uint64((1 << 8 * n) - 1)
            near = np.searchsorted(stems, key).clip(max=len(stems) - 1)
            sign[(stems[near] == key) & (sizes >= n)] = INSULT
        # Only clauses with an insult or a threat are read.
        ends = np.isin(data, np.frombuffer(b".!?;:\n\0", np.uint8))
        clause = np.cumsum(ends)[words.first]
        telling = np.isin(clause, np.unique(clause[(sign == INSULT) | (sign == THREAT)]))
        last, state = -1, 0
        rows = words.text[telling].tolist()
        for text, c, s in zip(rows, clause[telling].tolist(), sign[telling].tolist()):
            if c != last:
                last, state = c, 0
            if (kind := self.out[state, s + 1]) >= 0:
                counts[text, kind] += 1
            state = self.step[state, s + 1]
        return counts


def held_out(column: str = "doc_id"):
    """Rows that teach nothing: remainder 2 of the id's checksum by 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """The grammar of the labelled rows of ``docs`` that are not held out. An entry has to occur in
    several of the toxic ones, so the sample bounds their number."""
    marked = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # At most sample_rows rows of two numbers.
    rows = stored(
        docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").isNotNull())
        .join(F.broadcast(marked), "doc_id"), "labelled"
    )
    toxic, total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    grammar = Grammar()
    if not toxic or toxic == total:
        return grammar
    seen = rows.select(
        "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    ).filter(F.length("word") > 2).groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows")
    )
    seen = stored(seen, "words")
    # That all n rows with a word are toxic by chance: rate ** n. Over all words it should
    # not happen once.
    vocabulary = max(seen.count(), 2)
    least = max(3, int(np.ceil(np.log(vocabulary) / -np.log(toxic / total))))
    telling = lambda share: (F.col("toxic") >= least) & (F.col("toxic") >= share * F.col("rows"))
    grammar.words += [
        r["word"] for r in seen.filter(telling(0.9)).orderBy(F.desc("toxic"), "word").collect()
    ]
    stems: list[str] = []
    for n in STEM_BYTES:
        # A stem: several words begin with it, and what begins with it tells toxic rows.
        found = (
            seen.filter(F.octet_length("word") > n)
            .select("toxic", "rows", F.substring(F.col("word").cast("binary"), 1, n).alias("stem"))
            .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("words"))
            .filter(telling(0.99) & (F.col("words") >= 3) & (F.col("toxic") >= 2 * least))
            .orderBy(F.desc("toxic"), "stem")
        )
        for r in found.collect():
            stem = bytes(r["stem"]).decode(errors="ignore")
            if len(stem.encode()) == n and not any(stem.startswith(s) for s in stems):
                stems.append(stem)
    grammar.stems = stems
    # Rows with the same matches are one line of the fit: the sample bounds their number.
    table = (
        matches(rows.select("text", "toxic"), grammar).groupBy("matches")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic")).toPandas()
    )
    fit(grammar, np.array(table["matches"].tolist(), float), table["toxic"].to_numpy(float), table["rows"].to_numpy(float))
    return grammar


def strength(counts: np.ndarray) -> np.ndarray:
    """Every further match of a kind adds something, and less than the one before it."""
    return np.log2(1.0 + counts)


def fit(grammar: Grammar, x: np.ndarray, toxic: np.ndarray, rows: np.ndarray, ridge: float = 0.5) -> None:
    """Logistic weights of the matches by Newton's method, drawn to the prior's."""
    prior = np.append(grammar.weights, grammar.base)
    x = np.column_stack([strength(x), np.ones(len(x))])
    w, pull = prior.copy(), ridge * np.append(np.ones(len(prior) - 1), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (toxic - rows * p) - pull * (w - prior)
        bend = (x * (rows * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(bend, slope)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    grammar.weights, grammar.base = w[:-1].tolist(), float(w[-1])


def _read(grammar: Grammar, weigh: bool):
    reader: list[Reader] = []

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not reader:
            reader.append(Reader(grammar))
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts.cast(pa.string())], ["text"])
            found = [reader[0].matches(part.column("text")) for part in slices([batch], most_bytes=SLICE_BYTES)]
            counts = np.concatenate(found) if found else np.zeros((0, len(MATCHES)), np.int64)
            if weigh:
                yield pa.array(1 / (1 + np.exp(-(strength(counts) @ np.array(grammar.weights) + grammar.base))))
            else:
                yield pa.array(counts.tolist(), pa.list_(pa.int64()))

    return read


def matches(docs: DataFrame, grammar: Grammar, text: str = "text", column: str = "matches") -> DataFrame:
    """``docs`` with the number of matches of each kind (``MATCHES``)."""
    count = F.arrow_udf(_read(grammar, False), "array<long>")
    return docs.withColumn(column, count(F.col(f"`{text}`").cast("string")))


def score(docs: DataFrame, grammar: Grammar, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the chance, 0 to 1, that the text is toxic."""
    weigh = F.arrow_udf(_read(grammar, True), "double")
    return docs.withColumn(column, weigh(F.col(f"`{text}`").cast("string")))
