import random
import re

from pyspark.sql import functions as F

from textwarden.llm import licences


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(rows, notices, least):
    out = {}
    for name, body in notices:
        w = words(body)
        template = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        size = 1 << (len(template) - 1).bit_length()
        for i, text in rows:
            w = words(text)
            grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
            best = max((len(template & set(grams[k * size if k > 0 else 0:(k + 2) * size])) for k in range(-1, len(grams) // size + 1)),
                       default=0)
            if best >= least * len(template):
                out[i, name] = max(out.get((i, name), 0), best)
    return out


def test_against_all_windows(spark, docs):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"f{rng.randint(0, 999)}" for _ in range(n))
    rows = [(0, None), (1, ""), (2, "MIT License"), (3, "released UNDER the MIT license"), (3, "released UNDER the MIT license")]
    for name, body in licences.NOTICES:
        for k in range(6):
            w = body.split()
            for _ in range(k // 2):
                w[rng.randrange(len(w))] = "edited"
            rows.append((len(rows) + 10, f"{filler(rng.randint(0, 90))} {' '.join(w)} {filler(rng.randint(0, 40))}"))
    rows += [(500, " ".join(b for _, b in licences.NOTICES)), (501, filler(30_000) + " " + licences.NOTICES[4][1]),
             (None, licences.NOTICES[0][1])]
    df = docs(rows).withColumn("h", F.lit(1)).withColumn("license", F.lit("clash"))
    got = {(r.doc_id, r.license): r.n_shared for r in licences.scan(df).collect()}
    assert got == brute(rows, licences.NOTICES, licences.LEAST)
    assert licences.scan(docs([])).count() == 0


def test_rows_of_one_id_are_texts_of_their_own(spark, docs):
    words = licences.NOTICES[4][1].split()
    half = len(words) // 2
    halves = [(7, " ".join(words[:half])), (7, " ".join(words[half:])), (None, licences.NOTICES[0][1]), (None, licences.NOTICES[0][1])]
    assert [(r.doc_id, r.license) for r in licences.scan(docs(halves)).collect()] == [(None, "MIT")] * 2


def test_least_probability_of_a_meeting():
    """A window of almost four template lengths, full of other templates beside four fifths of this one."""
    similarity = 0.8 / (1 + 4 - 0.8)
    assert 1 - (1 - similarity ** licences.ROWS) ** licences.BANDS > 0.997


def test_plan_is_native(spark, docs, capsys):
    licences.scan(docs([(1, "a b c d e f")])).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
