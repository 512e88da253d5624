import math
import random
from collections import Counter

from pyspark.sql import functions as F

from textwarden.llm import toxicity


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best one, then left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            key = (round(total, 9), -(j - i))
            if total > 1e-12 and (best is None or key > best[0]):
                best = (key, i, j, total)
    if best is None:
        return []
    _, i, j, total = best
    left = brute_segments(scores[:i])
    right = [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(scores[j + 1:])]
    return left + [(i, j, total)] + right


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    for _ in range(300):
        weights = [rng.choice([0, 0, -0.9, 0.5, 1.7, 3.1]) + rng.random() * 0.01 if rng.random() < 0.4 else 0.0 for _ in range(14)]
        got = toxicity.maximal_segments([(i, w) for i, w in enumerate(weights) if w], 0.6)
        want = brute_segments([w - 0.6 for w in weights])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want))


def corpus(n, rng):
    bad = ["scumlike", "vilest", "wretchy"]
    for i in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(10, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        yield i, " ".join(words), int(toxic)


def test_learns_on_some_rows_and_finds_the_others(spark, docs):
    rows = list(corpus(1800, random.Random(9)))
    df = docs([(i, t) for i, t, _ in rows]).withColumn("score", F.lit("clash")).withColumn("_row", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(None, 1), (1, None), (99999, 1), (2, 0), (2, 0)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(y, out[i].predicted) for i, _, y in rows if i % 5 == 0]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.02 * len(held)
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in out.values())
    words = {i: t.split() for i, t, _ in rows}
    found = [r for r in out.values() if r.predicted]
    assert all("scumlike" in x or "vilest" in x or "wretchy" in x
               for r in found for p in r.passages for x in [" ".join(words[r.doc_id][p["first"]:p["last"] + 1])])
    # a model scores any text
    odd = docs([(1, None), (2, ""), (2, ""), (None, "scumlike vilest scumlike wretchy"), (3, "w1 " * 50_000)])
    scores = {(r.doc_id, r.text): r.score for r in toxicity.score(odd, model).collect()}
    assert scores[1, None] == scores[2, ""] < 0.5 < scores[None, "scumlike vilest scumlike wretchy"]
    assert scores[3, "w1 " * 50_000] < 0.5
    assert toxicity.score(docs([]), model).count() == 0


def test_words_that_clean_texts_hold_too(spark, docs):
    """Every toxic text has twelve words about twenty times likelier there than in clean text."""
    rng = random.Random(1)
    common = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(4000):
        words = [rng.choice(common) for _ in range(150)]
        if i % 4 == 0:
            at = rng.randrange(130)
            words[at:at] = [rng.choice(common[:60]) for _ in range(12)]
        rows.append((i, " ".join(words)))
    df = docs(rows).repartition(8)
    model = toxicity.fit(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows if i % 5], "doc_id long, toxic int"))
    held = [(r.doc_id % 4 == 0, r.predicted) for r in toxicity.score(df, model).filter("doc_id % 5 = 0").collect()]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) < 0.02 * sum(not y for y, _ in held)


def brute_scores(rows, labels):
    """Every text's score from dictionaries: tokens by their letters, counts over sets of words, all segments by definition."""
    def tokens(word):
        word = word.lower().strip(toxicity._PUNCTUATION)
        return ["w" + word, *("p" + word[:n] for n in (6, 5, 4) if len(word) > n)] if word else []

    label = {}
    for i, y in labels:
        label[i] = max(label.get(i, 0), y)
    texts = {}
    for i, t in rows:
        if i in label:
            texts.setdefault((t, label[i]), i)
    chosen = {i: y for (t, y), i in texts.items()}
    everywhere, by_class, words = Counter(), {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    total = 0
    for i, t in rows:
        distinct = set((t or "").split())
        total += len(distinct)
        found = Counter(x for w in distinct for x in tokens(w))
        everywhere += found
        if i in chosen:
            by_class[chosen[i]] += found
            words[chosen[i]] += len(distinct)
    mass = toxicity.PRIOR * (words[0] + words[1])
    lexicon = {}
    for x, n in everywhere.items():
        prior = n * mass / total
        a, b = by_class[1][x] + prior, by_class[0][x] + prior
        if by_class[1][x] + by_class[0][x] >= toxicity.LEAST_COUNT:
            odds = math.log(a / (words[1] + mass - a)) - math.log(b / (words[0] + mass - b))
            if abs(odds) / math.sqrt(1 / a + 1 / b) >= toxicity.LEAST_Z:
                lexicon[x] = odds
    value = lambda w: next((lexicon[x] for x in tokens(w) if x in lexicon), 0.0)
    clean = Counter(round(value(w), 2) for i, t in rows if chosen.get(i) == 0 for w in (t or "").split())
    drift = toxicity.drift_of(list(clean.items()))
    lam = toxicity.lambda_of(sorted(clean.items()), drift)

    def segments(text):
        return [s for _, _, s in brute_segments([value(w) - drift for w in (text or "").split()])]

    all_ = [(i, t, segments(t)) for i, t in rows]
    n_words = sum(len((t or "").split()) for i, t, _ in all_ if chosen.get(i) == 0)
    k = (sum(len(s) for i, _, s in all_ if chosen.get(i) == 0) + 1) / max(1, n_words)

    def evidence(text, found):
        e = [k * len((text or "").split()) * math.exp(-lam * s) for s in found]
        return sum(-math.log(max(x, 1e-300)) for x in e if x <= toxicity.MOST_E)

    bins = {}
    for i, t, found in all_:
        if i in chosen:
            row = bins.setdefault(round(min(evidence(t, found), 1000.0), 1), [0, 0])
            row[chosen[i]] += 1
    slope, intercept = toxicity._logistic(sorted((x, c, d) for x, (c, d) in bins.items()))
    return {i: 1 / (1 + math.exp(-(intercept + slope * min(evidence(t, found), 1000.0)))) for i, t, found in all_}


def test_scores_equal_brute_force(spark, docs):
    rows = [(i, t) for i, t, _ in corpus(500, random.Random(2))] + [(900, None), (901, ""), (902, "!!! ... vilest"), (903, "w1 w2")]
    labels = [(i, y) for i, _, y in corpus(500, random.Random(2)) if i % 5] + [(902, 1), (903, 0)]
    df = docs(rows).repartition(5)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = brute_scores(rows, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6 and model.lexicon


def test_without_labels_nothing_is_toxic(spark, docs):
    df = docs([(1, "some words here"), (2, "others")])
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(df, model).collect()] == [0, 0]
    assert toxicity.fit(docs([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).lexicon == {}
