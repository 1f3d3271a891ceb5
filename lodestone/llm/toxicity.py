"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, other; commas and sentence ends are symbols too. Three
transducers are composed into one. *Negation* turns an insult or threat within three words of a negation into a
negated one, up to the next comma. *Report* turns what stands after a verb of saying, up to the sentence's end, into a
reported one. *Clause* weighs what is left: an insult has its own weight, one with a target in the same clause has
TARGETED more, a threat counts in full with a target only, negated and reported ones a share. A document's evidence is
the sum over its clauses, less what so many words would hold in toxic texts beyond clean ones (none unless labels tell
of it); its score is the logistic function of evidence and BIAS: one untargeted word of the fixed list that no label
supports stays below 0.5.

Weights of insults are log ratios of their rates under the two labels, those of the fixed list with a prior of LISTED.
Words and word beginnings of four to six letters that the list lacks are learned where their documents' likelihood-ratio
statistic is above twice the logarithm of the number of candidates. Learning takes ``per_label`` texts at most of each
label (drawn from labelled ids by hash; of texts that share the least hash of their three-word runs, under any of three
hash functions, one: copies are no evidence of their own) and keeps ``most_terms`` terms at most; scoring reads every
text whole. Ids, languages, sources and labels are no inputs of a score.

Null and empty texts score as texts without a match. Ids labelled both ways count as toxic; null labels, null ids and
labels without a document teach nothing; without labels of both kinds the list's own weights hold. Rows are kept as
they are, repeated ones too; other columns come along only if asked for, and may clash with nothing but the names of
the new ones, which can be given. A row without an id counts as held out. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import cut, plain, ship, tidied, working

#: Words of each class in the four languages of the corpus (fixed values).
INSULTS = frozenset(
    "idiot idiots moron morons loser losers stupid worthless trash scum pathetic clown clowns disgusting imbecile dumb "
    "dumbass jerk bastard bitch asshole fool vermin filth filthy garbage coward crap cretin dimwit dipshit douchebag freak "
    "halfwit ignorant liar lowlife maggot parasite pig pigs scumbag shithead slut sucker swine twat ugly useless whore "
    "dumm dummkopf trottel arschloch abschaum versager wertlos nutzlos widerlich erbärmlich idiotin "
    "imbécile abruti crétin connard salope ordure déchet minable dégoûtant inutile "
    "idiota estúpido estúpida imbécil basura escoria inútil asqueroso patético payaso cabrón".split()
)
THREATS = frozenset(
    "kill hurt destroy beat strangle stab shoot murder smash crush burn punish "
    "töten umbringen schlagen vernichten verletzen tuer frapper détruire blesser matar golpear destruir herir".split()
)
TARGETS = frozenset("you your yours yourself he him she her they them their du dich dir euch ihr sie tu toi te vous ils elles tú ti vosotros ustedes ellos ellas".split())
NEGATIONS = frozenset("not never no none neither nor nobody isn aren wasn weren don doesn didn nicht nie niemals kein keine keinen ne jamais aucun nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset(
    "said says saying claimed claims wrote writes quoted quotes reported reports alleged called "
    "sagte sagt schrieb behauptete berichtete dit disait écrivit affirmait rapporte dijo dice escribió afirmó informó".split()
)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COMMA, END = "oithnr,."
NEGATED_INSULT, NEGATED_THREAT, REPORTED_INSULT, REPORTED_THREAT = "xyXY"
#: Words a negation reaches; shares of negated and reported matches; what a target adds; a threat's weight; a listed insult's.
REACH, NEGATED, REPORTED, TARGETED, THREATENING, LISTED = 3, 0.1, 0.25, 1.5, 3.0, 2.0
BIAS, MOST_WEIGHT, LEAST_DOCS = -2.5, 6.0, 3
#: Texts of a label that are learned from, terms that are learned, letters of learned beginnings.
PER_LABEL, MOST_TERMS, PREFIXES = 5000, 2000, (4, 5, 6)

WORDS = re.compile(r"[^\W\d_]+")
WORD = re.compile(r"[^\W\d_]+|[,;:()]")
SENTENCE = re.compile(r"[.!?…\n\r]+")


@dataclass
class Transducer:
    """start, and for (state, symbol): the next state and what is put out."""

    start: object
    step: dict = field(default_factory=dict)


def tabulated(start, symbols: str, rule: Callable) -> Transducer:
    """The transducer of a rule (state, symbol) -> (state, output), over all states that symbols lead to."""
    out, todo, seen = Transducer(start), [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            nxt, said = rule(state, symbol)
            out.step[state, symbol] = nxt, said
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    return out


def composed(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """second on what first puts out."""

    def rule(state, symbol):
        a, said = first.step[state[0], symbol]
        b, out = second.step[state[1], said]
        return (a, b), out

    return tabulated((first.start, second.start), symbols, rule)


def negation() -> Transducer:
    def rule(left: int, symbol: str):
        if symbol == NEGATION:
            return REACH, OTHER
        if left and symbol in INSULT + THREAT:
            return left - 1, NEGATED_INSULT if symbol == INSULT else NEGATED_THREAT
        return (0 if symbol in COMMA + END else max(left - 1, 0)), symbol

    return tabulated(0, OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT + COMMA + END, rule)


def reporting() -> Transducer:
    def rule(reported: bool, symbol: str):
        if symbol == REPORT:
            return True, OTHER
        if reported and symbol in INSULT + THREAT:
            return True, REPORTED_INSULT if symbol == INSULT else REPORTED_THREAT
        return reported and symbol != END, symbol

    return tabulated(False, OTHER + INSULT + THREAT + TARGET + NEGATED_INSULT + NEGATED_THREAT + REPORT + COMMA + END, rule)


def clause() -> Transducer:
    """Puts out (share of the word's own weight, weight besides). A state: whether a clause has had its target, and
    the share at which an insult and a threat wait for one."""
    share = {INSULT: 1.0, THREAT: 1.0, NEGATED_INSULT: NEGATED, NEGATED_THREAT: NEGATED, REPORTED_INSULT: REPORTED, REPORTED_THREAT: REPORTED}

    def rule(state, symbol: str):
        aimed, insult, threat = state
        if symbol in COMMA + END:
            return (False, 0.0, 0.0), (0.0, 0.0)
        if symbol == TARGET:
            return (True, 0.0, 0.0), (0.0, TARGETED * insult + THREATENING * threat)
        if symbol in INSULT + NEGATED_INSULT + REPORTED_INSULT:
            s = share[symbol]
            return (aimed, 0.0 if aimed else max(insult, s), threat), (s, TARGETED * s if aimed else 0.0)
        if symbol in THREAT + NEGATED_THREAT + REPORTED_THREAT:
            s = share[symbol]
            return (aimed, insult, 0.0 if aimed else max(threat, s)), (0.0, THREATENING * s if aimed else 0.0)
        return state, (0.0, 0.0)

    return tabulated((False, 0.0, 0.0), OTHER + INSULT + THREAT + TARGET + NEGATED_INSULT + NEGATED_THREAT + REPORTED_INSULT + REPORTED_THREAT + COMMA + END, rule)


def grammar() -> Transducer:
    symbols = OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT + COMMA + END
    return composed(composed(negation(), reporting(), symbols), clause(), symbols)


@dataclass
class Model:
    """Weights of insults, as whole words and as beginnings of words."""

    words: dict[str, float]
    prefixes: dict[str, float]
    #: Matched words that toxic texts have beyond clean ones, as a share of their words.
    expected: float = 0.0

    def __post_init__(self) -> None:
        self._fixed = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self._lengths = sorted({len(p) for p in self.prefixes}, reverse=True)

    def term(self, word: str) -> str:
        """The insult that a word is: itself with $, else its longest known beginning, else nothing."""
        if word in self.words:
            return f"{word}$"
        if word in self._fixed:
            return ""
        return next((word[:n] for n in self._lengths if len(word) >= n and word[:n] in self.prefixes), "")

    def symbol(self, token: str) -> tuple[str, float]:
        """A token's class, and the weight if it is an insult: the whole word's, else that of its longest known beginning."""
        if token in self._fixed and token not in self.words:
            return self._fixed[token], 0.0
        if not token[0].isalpha():
            return COMMA, 0.0
        term = self.term(token)
        return (INSULT, self.words[term[:-1]] if term.endswith("$") else self.prefixes[term]) if term else (OTHER, 0.0)


class Scorer:
    """A model with its tables, made once a task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.start, self.table = _numbered(grammar())
        self.found = ahocorasick.Automaton()
        for word in [*model.words, *model.prefixes, *THREATS]:
            self.found.add_word(word, len(word))
        self.found.make_automaton()
        self.known: dict[str, tuple[str, float]] = {}

    def symbol(self, token: str) -> tuple[str, float]:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self.model.symbol(token)
        return self.known[token]

    def sentence(self, text: str) -> list[float]:
        """Weights of the clauses that matched."""
        state, out, total, hit = self.start, [], 0.0, False
        for m in WORD.finditer(text):
            symbol, weight = self.symbol(m[0])
            state, (share, more) = self.table[state][symbol]
            if symbol == COMMA:
                if hit:
                    out.append(total)
                total, hit = 0.0, False
            elif share or more:
                total, hit = total + share * weight + more, True
        return [*out, total] if hit else out

    def clauses(self, text: str | None) -> list[float]:
        """Weights of a text's matched clauses. Sentences without an insult or threat weigh nothing and are passed over."""
        if not text:
            return []
        low = text.lower()
        at = [end - n + 1 for end, n in self.found.iter(low) if end < n or not low[end - n].isalpha()]
        if not at:
            return []
        ends = [m.start() for m in SENTENCE.finditer(low)]
        out, last = [], -1
        for k in np.unique(np.searchsorted(ends, at, "left")).tolist():
            if k != last:
                out += self.sentence(low[ends[k - 1] if k else 0 : ends[k] if k < len(ends) else len(low)])
            last = k
        return out


def _numbered(t: Transducer) -> tuple[int, list[dict]]:
    """t's start and table with states as numbers."""
    names = {s: k for k, s in enumerate(dict.fromkeys(s for s, _ in t.step))}
    table: list[dict] = [{} for _ in names]
    for (state, symbol), (nxt, said) in t.step.items():
        table[names[state]][symbol] = names[nxt], said
    return names[t.start], table


def score_of(clauses: list[float], words: int, model: Model) -> float:
    """A text's score from its matched clauses and the number of its words."""
    evidence = math.fsum(clauses) - model.expected * words
    return 1 / (1 + math.exp(-min(max(BIAS + evidence, -40.0), 40.0)))


def held_out(key: str = "doc_id") -> Column:
    """Whether a row must not be learned from; one without an id must not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def listed() -> Model:
    """The fixed list with its prior weights."""
    return Model(dict.fromkeys(sorted(INSULTS), LISTED), {})


def weight(toxic: float, clean: float, least: float, prior: float) -> float:
    """Log ratio of a term's rates in toxic and clean texts, pulled towards prior as if by a rate of least."""
    return max(0.0, min(MOST_WEIGHT, math.log((toxic + least * math.exp(prior)) / (clean + least))))


def _statistic(n1: int, n0: int) -> Column:
    """The likelihood-ratio statistic of a term in a of n1 toxic and b of n0 clean texts."""
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n1 + n0)

    def part(seen: Column, row: float, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    held, rest = a + b, F.lit(n) - a - b
    return 2 * (part(a, n1, held) + part(b, n0, held) + part(n1 - a, n1, rest) + part(n0 - b, n0, rest))


def _beginnings(letters: int) -> Column:
    """The beginnings of so many letters of the words in column w."""
    return F.transform(F.filter("w", lambda w: F.length(w) >= letters), lambda w: F.substring(w, 1, letters))


def _chosen(found: list[tuple[str, int]], own: set[str] | frozenset[str]) -> tuple[list[str], list[str]]:
    """Words and beginnings of significant terms (term, toxic texts); whole words end with $.

    A beginning goes if one longer term has nine tenths of its toxic texts, any term if a beginning of it stays.
    """
    seen, longest = dict(found), {}
    for t, a in found:
        word = t.rstrip("$")
        for n in PREFIXES:
            if n < len(word) or (n == len(word) and t.endswith("$")):
                longest[word[:n]] = max(longest.get(word[:n], 0), a)
    prefixes: list[str] = []
    for t in sorted((t for t in seen if not t.endswith("$")), key=lambda t: (len(t), t)):
        if longest.get(t, 0) < 0.9 * seen[t] and not t.startswith(tuple(prefixes)):
            prefixes.append(t)
    words = [t[:-1] for t in seen if t.endswith("$") and t[:-1] not in own and not t.startswith(tuple(prefixes))]
    return sorted(words), prefixes


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_terms: int = MOST_TERMS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), without the rows that are held out."""
    spark = docs.sparkSession
    rated = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in rated.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return listed()
    # Somewhat more ids than wanted, by hash; at most 2 x 1.5 x per_label of them (on average), so they are broadcast.
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 1.5 * per_label / counts[1]))).otherwise(F.lit(min(1.0, 1.5 * per_label / counts[0])))
    some = rated.where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 24)) < share * (1 << 24))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~held_out()).join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("text", "toxic", F.xxhash64("text").alias("h"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    runs = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))))
    once = texts.dropDuplicates(["toxic", "h"]).withColumn("w", words).withColumn("r", F.coalesce(runs, F.array("h")))
    for k in range(3):
        once = once.withColumn(f"s{k}", F.array_min(F.transform("r", lambda x: F.xxhash64(x, F.lit(k)))))  # noqa: B023
    once = cut(once.select("text", "toxic", "h", "s0", "s1", "s2"))
    # Of the rows that share a signature the one of least hash stays, so that a rerun learns the same.
    for k in range(3):
        once = once.groupBy("toxic", f"s{k}").agg(F.min_by(F.struct("text", "h", *(f"s{j}" for j in range(k + 1, 3))), F.struct("h", "text")).alias("one")).select("toxic", "one.*")
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "text"))
    sample = cut(once.withColumn("place", place).where(F.col("place") <= per_label).select("text", "toxic", "h"))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return listed()
    n1, n0 = sizes[1], sizes[0]
    begun = [_beginnings(n) for n in PREFIXES]
    whole = F.transform(F.filter("w", lambda w: F.length(w) >= 3), lambda w: F.concat(w, F.lit("$")))
    # Dealt by the texts' hash: a few rows of the sample hold many words, which a few large partitions would keep in few tasks.
    dealt = sample.repartition(2 * spark.sparkContext.defaultParallelism, "h").select("toxic", F.array_distinct(words).alias("w"))
    terms = dealt.select("toxic", F.explode(F.array_distinct(F.concat(whole, *begun))).alias("t"))
    counted = terms.groupBy("t").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    rich = counted.where((F.col("a") >= LEAST_DOCS) & (F.col("a") * n0 > F.col("b") * n1)).withColumn("g", _statistic(n1, n0))
    tested = F.count("*").over(Window.partitionBy())  # candidates: a few thousand, as LEAST_DOCS texts of the bounded sample hold each
    own = F.col("t").isin(*(f"{w}$" for w in sorted(INSULTS)))
    found = rich.withColumn("m", tested).where((F.col("g") > 2 * F.log(F.greatest("m", F.lit(2)))) | own).orderBy(F.desc("g"), "t").limit(most_terms).collect()
    whole_words, beginnings = _chosen([(r.t, r.a) for r in found], INSULTS)
    return _weighed(sample, Model(dict.fromkeys([*sorted(INSULTS), *whole_words], LISTED), dict.fromkeys(beginnings, LISTED)))


def _weighed(sample: DataFrame, model: Model) -> Model:
    """model with weights from its terms' rates in sample (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = WORDS.findall(text.as_py().lower())
                seen["", toxic] += len(words)
                seen.update((t, toxic) for t in map(model.term, words) if t)
        yield pa.record_batch([pa.array([t for t, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["t", "toxic", "k"])

    # Rows: terms, of which there are few, and two labels.
    rows = sample.select("text", "toxic").mapInArrow(tidied(count), "t string, toxic int, k long").groupBy("t", "toxic").agg(F.sum("k").alias("k")).collect()
    got = {(r.t, r.toxic): r.k for r in rows}
    words = [max(got.get(("", x), 0), 1) for x in (0, 1)]
    rate = lambda t, x: got.get((t, x), 0) / words[x]
    least = 1 / sum(words)
    own = {w: weight(rate(f"{w}$", 1), rate(f"{w}$", 0), least, LISTED if w in INSULTS else 0.0) for w in model.words}
    begun = {p: weight(rate(p, 1), rate(p, 0), least, 0.0) for p in model.prefixes}
    terms = [*(f"{w}$" for w in own), *begun]
    return Model(own, begun, max(0.0, sum(rate(t, 1) - rate(t, 0) for t in terms)))


def predict(docs: DataFrame, model: Model, keep: list[Column] | None = None, names: tuple[str, str, str] = ("score", "predicted", "n_clauses")) -> DataFrame:
    """For each row: the columns in keep (all of docs if None), score (0 to 1), whether it is 0.5 or more, and the matched clauses' number."""
    ship(docs.sparkSession)
    keep = plain(docs) if keep is None else keep
    kept = docs.select(*keep).schema
    chosen = docs.select(*keep, F.col("text").alias("_"))
    chosen = chosen.toDF(*(f"c{i}" for i in range(len(chosen.columns))))
    schema = StructType([*kept.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType()), StructField(names[2], LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        scorer = Scorer(model)
        for batch in batches:
            found, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                own = text.as_py() or ""
                found.append(scorer.clauses(own))
                scores.append(score_of(found[-1], len(own.split()), model))
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([len(c) for c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return chosen.mapInArrow(tidied(run), schema)
