"""Toxic passages by maximum-scoring segment search over token log-odds.

Tokens are the words of a text (lower case, without punctuation at the ends) and their prefixes
of 4 to 6 letters. Their log-odds between toxic and clean training texts take an informative
Dirichlet prior from the counts of all documents (a word counts once in a text, however often one
text repeats it); those that differ from zero by ``LEAST_Z``
standard errors are the lexicon, with their sign: tokens of clean texts count against a passage. A
word scores the log-odds of its most specific token in the lexicon, others nothing; every word costs
a drift, just so much that clean words lose ``MARGIN`` on average. A linear scan finds all maximal
scoring segments of a text (Ruzzo and Tompa). Their scores follow an extreme-value law in clean
text: lambda solves ``sum p * exp(lambda * s) = 1`` over the scores of the words of clean training
texts, and K is the rate of positive segments there, so that ``E = K * words * exp(-lambda * S)``.
The evidence of a document is the sum of ``-log E`` over its significant segments, and a logistic
curve through training texts turns it into a score from 0 to 1.

The training texts are a hash sample of about ``MOST_TRAINING`` labelled texts per class, each
distinct text once; counts of the prior cover all documents. Defined results: null and empty
texts score like a text without passages; labels that are null are not used, several labels of
a document count as toxic if one is; null and repeated ids are scored row by row. Without
training texts of both classes there is no lexicon and every text scores 0.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from textwarden.llm.common import map_batches, stored

#: labelled texts of a class that the lexicon and the calibration learn from, about
MOST_TRAINING = 20_000
#: pseudo-count of the prior, as a share of the training words; it goes to the tokens by their share of all documents
PRIOR = 0.03
#: a token enters the lexicon at this many standard errors, and from this many training texts on
LEAST_Z, LEAST_COUNT = 4.0, 4
PREFIXES = (6, 5, 4)
#: what a word loses on average, at least, in all but this share of the clean texts
MARGIN, RARE = 0.05, 0.005
#: segments up to this E-value are significant
MOST_E = 0.001
#: filter of the tokens that occur often enough in training texts: 2 ** 24 bits, 2 MiB
FILTER_BITS = 24
#: different words that a task counts before it reports, and that it remembers
COUNTED, REMEMBERED = 500_000, 200_000
ADDED = ["score", "predicted", "passages"]
_PUNCTUATION = string.punctuation + "¡¿«»…–—“”‘’"


def tokens_of(word: str) -> list[int]:
    """Hashes of a word and its prefixes, the most specific first; none for bare punctuation."""
    word = word.lower().strip(_PUNCTUATION)
    if not word:
        return []
    return [xxh3_64_intdigest("w" + word) >> 1, *(xxh3_64_intdigest("p" + word[:n]) >> 1
                                                  for n in PREFIXES if len(word) > n)]


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in linear time.

    ``hits`` are the (position, weight) of scoring words in order; every word costs ``drift``.
    """
    stack: list[list] = []  # first, last, sum before first, sum after last
    gained = 0.0
    for at, weight in hits:
        before = gained - drift * at
        gained += weight
        now = [at, at, before, gained - drift * (at + 1)]
        if now[3] <= now[2]:
            continue
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j -= 1
            if j < 0 or stack[j][3] >= now[3]:
                stack.append(now)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after in stack]


@dataclass
class Model:
    lexicon: dict[int, float] = field(default_factory=dict)
    drift: float = MARGIN
    lambda_: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = -50.0
    most_e: float = MOST_E

    def evidence(self, n_words: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[tuple]]:
        """Sum of -log E over the significant segments, and these with their E-values."""
        found = [(a, b, s, self.k * n_words * math.exp(-self.lambda_ * s)) for a, b, s in segments]
        found = [x for x in found if x[3] <= self.most_e]
        return sum(-math.log(max(x[3], 1e-300)) for x in found), found

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * evidence))))


def word_score(word: str, lexicon: dict[int, float]) -> float:
    """The log-odds of a word's most specific token in the lexicon, 0 without one."""
    for token in tokens_of(word):
        if token in lexicon:
            return lexicon[token]
    return 0.0


class Scanner:
    """Finds scoring words; remembers at least the last ``REMEMBERED`` different words, and at most twice as many."""

    def __init__(self, model: Model):
        self.model = model
        self.seen, self.hot, self.older, self.older_hot = set(), {}, set(), {}

    def split(self, text: str | None) -> list[str]:
        """The words of a text, whose scores are known from then on."""
        words = (text or "").split()
        new = set(words) - self.seen
        if len(self.seen) > REMEMBERED:
            self.older, self.older_hot, self.seen, self.hot = self.seen, self.hot, set(), {}
            new = set(words)
        for word in new:
            score = self.older_hot.get(word, 0.0) if word in self.older else word_score(word, self.model.lexicon)
            if score:
                self.hot[word] = score
        self.seen |= new
        return words

    def segments(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        for text in texts:
            words, hot = self.split(text), self.hot
            hits = [(i, hot[w]) for i, w in enumerate(words) if w in hot]
            yield len(words), maximal_segments(hits, self.model.drift) if hits else []


def training(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
             most: int) -> DataFrame:
    """(id, toxic) of a hash sample of the labelled texts, distinct texts only; about 2 * ``most`` rows."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic")))
    sizes = dict(known.groupBy("toxic").count().collect())
    rate = F.when(F.col("toxic") == 1, most / max(1, sizes.get(1, 0))).otherwise(most / max(1, sizes.get(0, 0)))
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30))
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    return stored(texts.join(F.broadcast(drawn), "id").groupBy("hash", "toxic").agg(F.min("id").alias("id"))
                  .select("id", "toxic"), "toxicity-training")


def _labelled(documents: DataFrame, sample: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Texts with the label of the sample, which is small by construction."""
    return (documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(sample), "id", how).select("text", "toxic"))


def _count_tokens(texts: DataFrame, keep=None) -> DataFrame:
    """(token, toxic, n) summed over the distinct words of each text; ``keep`` is a broadcast filter of tokens."""
    def report(counts: dict[int, Counter]):
        rows, kept, mask = Counter(), None if keep is None else keep.value.tobytes(), (1 << FILTER_BITS - 3) - 1
        for label, words in counts.items():
            rows[(-1, label)] += sum(words.values())
            for word, n in words.items():
                for t in tokens_of(word):
                    if kept is None or kept[t >> 3 & mask] >> (t & 7) & 1:
                        rows[(t, label)] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int32()),
             pa.array(rows.values(), pa.int64())], ["token", "toxic", "n"])

    def work(batches):
        counts: dict[int, Counter] = {}
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                counts.setdefault(-1 if label is None else label, Counter()).update(set((text or "").split()))
            if sum(map(len, counts.values())) > COUNTED:
                yield from report(counts)
                counts = {}
        yield from report(counts)

    return map_batches(texts, work, "token long, toxic int, n long").groupBy("token", "toxic").agg(F.sum("n").alias("n"))


def _lexicon(documents: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> dict[int, float]:
    """The significant tokens with their log-odds; bounded by the training sample, whose texts hold each ``LEAST_COUNT`` times."""
    spark = documents.sparkSession
    bits = (F.shiftrightunsigned("token", 3).bitwiseAND((1 << FILTER_BITS - 3) - 1))
    wanted = (_count_tokens(_labelled(documents, sample, id_col, text_col, "inner")).groupBy("token").agg(F.sum("n").alias("n"))
              .filter(f"token >= 0 AND n >= {LEAST_COUNT}")
              .groupBy(bits.alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(token & 7 as int))")).alias("bits"))).toArrow()
    filter_ = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    filter_[np.asarray(wanted["at"])] = np.asarray(wanted["bits"])  # at most one row per byte of the filter
    keep = spark.sparkContext.broadcast(filter_)
    counts = _count_tokens(_labelled(documents, sample, id_col, text_col, "left"), keep)
    n = F.sum("n")
    table = stored(counts.groupBy("token").agg(n.alias("all"), F.sum(F.expr("if(toxic = 1, n, 0)")).alias("t"),
                                              F.sum(F.expr("if(toxic = 0, n, 0)")).alias("c")), "toxicity-counts")
    total = table.filter("token = -1").first()
    if total is None or not total.t or not total.c:
        return {}
    mass = PRIOR * (total.t + total.c)
    prior = F.col("all") * F.lit(mass / total["all"])
    a, b = F.col("t") + prior, F.col("c") + prior
    odds = F.log(a / (total.t + mass - a)) - F.log(b / (total.c + mass - b))
    strong = (table.filter(f"token >= 0 AND t + c >= {LEAST_COUNT}")
              .withColumns({"odds": odds, "z": odds / F.sqrt(1 / a + 1 / b)})
              .filter(f"abs(z) >= {LEAST_Z}").select("token", "odds").toArrow())
    return dict(zip(strong["token"].to_pylist(), strong["odds"].to_pylist()))


def _clean_words(texts: DataFrame, model: Model) -> tuple[list[tuple[float, int]], list[tuple[float, int]]]:
    """How many words of clean training texts have each score, and how many of the texts each mean score, to two places.

    A bounded number of rows, as scores are log-odds.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scanner, counts = Scanner(shared.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = scanner.split(text)
                scores = [scanner.hot.get(w, 0.0) for w in words]
                counts.update((0, round(s, 2)) for s in scores)
                if scores:
                    counts[1, round(sum(scores) / len(scores), 2)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.int32()), pa.array([s for _, s in counts], pa.float64()),
                                          pa.array(counts.values(), pa.int64())], ["kind", "score", "n"])

    rows = (map_batches(texts.filter("toxic = 0").select("text"), work, "kind int, score double, n long")
            .groupBy("kind", "score").agg(F.sum("n").alias("n")).collect())
    return tuple([(r.score, r.n) for r in rows if r.kind == kind] for kind in (0, 1))


def drift_of(means: list[tuple[float, int]]) -> float:
    """The cost of a word at which all but ``RARE`` of the clean texts lose ``MARGIN`` a word on average."""
    left = RARE * sum(n for _, n in means)
    for mean, n in sorted(means, reverse=True):
        left -= n
        if left < 0:
            return max(0.0, mean) + MARGIN
    return MARGIN


def lambda_of(scores: list[tuple[float, int]], drift: float) -> float:
    """The positive root of sum p * exp(lambda * s) = 1 over the scores of clean words, by bisection."""
    s, n = np.array([x for x, _ in scores]) - drift, np.array([x for _, x in scores], float)
    p = n / max(1.0, n.sum())
    low, high = 0.0, 64.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(np.minimum(mid * s, 700))).sum() > 1 else (mid, high)
    return max(low, 1e-3)


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, intercept) through (evidence, clean, toxic) counts, by damped Newton steps with a weak ridge."""
    x = np.array([[r[0], 1.0] for r in rows])
    bad, n = np.array([r[2] for r in rows], float), np.array([r[1] + r[2] for r in rows], float)
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])

    def loss(w):
        z = x @ w
        return (n * np.logaddexp(0, z) - bad * z).sum() + w @ ridge @ w / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (n * p - bad) + ridge @ w
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, g)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-6:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", most: int = MOST_TRAINING) -> Model:
    """Lexicon, extreme-value parameters and calibration from labelled texts and the counts of all texts."""
    sample = training(documents, labels, id_col, text_col, label_col, most)
    lexicon = _lexicon(documents, sample, id_col, text_col)
    if not lexicon:
        return Model()
    model = Model(lexicon, most_e=MOST_E)
    spark = documents.sparkSession
    texts = _labelled(documents, sample, id_col, text_col, "inner")
    scores, means = _clean_words(texts, model)
    model.drift = drift_of(means)
    model.lambda_ = lambda_of(scores, model.drift)
    first = spark.sparkContext.broadcast(model)

    def scan(batches):
        scanner = Scanner(first.value)
        for batch in batches:
            out = [(n, [s for _, _, s in found]) for n, found in scanner.segments(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.float64())),
                 batch.column(1)], ["words", "segments", "toxic"])

    scanned = stored(map_batches(texts, scan, "words long, segments array<double>, toxic int"), "toxicity-scan")
    clean = scanned.filter("toxic = 0").agg(F.sum("words").alias("words"), F.sum(F.size("segments")).alias("n")).first()
    model.k = ((clean.n or 0) + 1) / max(1, clean.words or 0)
    e = f"{model.k!r}D * words * exp(-{model.lambda_!r}D * s)"
    evidence = F.expr(f"aggregate(filter(segments, s -> {e} <= {model.most_e}), 0D, (a, s) -> a - ln(greatest({e}, 1e-300D)))")
    bins = (scanned.groupBy(F.round(F.least(evidence, F.lit(1000.0)), 1).alias("x"))
            .agg(F.count_if(F.expr("toxic = 0")).alias("clean"), F.count_if(F.expr("toxic = 1")).alias("toxic")).collect())
    model.slope, model.intercept = _logistic(sorted((r.x, r.clean, r.toxic) for r in bins))  # at most 10,001 rows
    return model


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with score, predicted and their significant passages (word positions, score, E-value)."""
    keep = [c for c in documents.columns if c not in ADDED]
    packed = documents.select(F.col(text_col).cast("string").alias("_text"), F.struct(*keep).alias("_row"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e", pa.float64())])

    def work(batches):
        model = shared.value
        scanner = Scanner(model)
        for batch in batches:
            scores, passages = [], []
            for n, found in scanner.segments(batch.column(0).to_pylist()):
                evidence, kept = model.evidence(n, found)
                scores.append(model.score(min(evidence, 1000.0)))
                passages.append([dict(zip(("first", "last", "score", "e"), x)) for x in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array(passages, pa.list_(passage))], ["_row", *ADDED])

    kind = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
                         T.StructField("score", T.DoubleType()), T.StructField("e", T.DoubleType())])
    out = map_batches(packed, work, T.StructType(
        [packed.schema["_row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
         T.StructField("passages", T.ArrayType(kind))]))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), *ADDED)
