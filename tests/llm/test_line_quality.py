import random
import re

from pyspark.sql import functions as F

from textwarden.llm import line_quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, share, most):
    """Every measure as the rule reads, and the verdict by counting distinct texts per line and host."""
    held, texts = {}, {}
    norm = lambda x: " ".join(WORDS.findall(x)).translate(LOWER)
    for _, text, host in rows:
        texts.setdefault(host, set()).add(text or "")
        for line in {norm(x) for x in (text or "").split("\n")} - {""}:
            held.setdefault((host, line), set()).add(text or "")
    out = []
    for i, text, host in rows:
        text = text or ""
        words = WORDS.findall(text)
        grams = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
        cover = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        lost = sum(len(WORDS.findall(x)) for x in lines if len(held[host, norm(x)]) >= least
                   and 100 * len(held[host, norm(x)]) > share * len(texts[host]))
        failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                    len(lines) - len(set(lines)), len(cover), failed, lost,
                    not failed and 100 * lost <= most * len(words)))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs):
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(30)] + ["é", "#$%", "<b>", "Word", "ß&"]
    notes = ["Subscribe to our   newsletter today for more", "subscribe to our newsletter\ttoday for MORE", "all rights reserved"]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 4))]
        lines += rng.sample(notes, rng.randint(0, 2)) * rng.randint(0, 2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h", "h", "", None])))
    cycle = "a b c d e f g h i j " * 30
    rows += [(200, None, "h"), (201, "", "h"), (201, "", "h"), (None, cycle, "h"), (202, cycle, None),
             (203, "\n".join(notes * 3), "h"), (204, " ".join(f"v{i}" for i in range(5000)), "h"), (205, "one " * 12, "h")]
    df = docs(rows).withColumn("line", F.lit(1)).withColumn("kept", F.lit("clash"))
    out = line_quality.judge_lines(df, least_documents=5, most_share=2, most_removed=50)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                   r.removed_words, r.kept) for r in out.collect()), key=str)
    assert got == brute(rows, 5, 2, 50)
    assert any(x[7] and not x[6] and not x[8] for x in got) and any(x[7] and x[8] for x in got)
    assert "line" in out.columns and line_quality.judge_lines(docs([])).count() == 0


def test_cut_texts_lose_the_frequent_lines(spark, docs):
    rng = random.Random(8)
    notes = ["Subscribe to our   newsletter", "subscribe to OUR newsletter ", "all rights reserved", "só"]
    rows = []
    for i in range(90):
        lines = [f"line {rng.randint(0, 500)} of text" for _ in range(rng.randint(0, 4))] + rng.sample(notes, rng.randint(0, 3)) + ["", " "]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h", "g", "", None])))
    rows += [(5, None, "h"), (5, "", "h"), (None, notes[2], "h"), (6, "\n".join(notes * 2000), None)]
    norm = lambda x: " ".join(WORDS.findall(x)).translate(LOWER)
    held, texts = {}, {}
    for _, text, host in rows:
        texts.setdefault(host, set()).add(text or "")
        for line in {norm(x) for x in (text or "").split("\n")} - {""}:
            held.setdefault((host, line), set()).add(text or "")
    above = {k for k, v in held.items() if len(v) >= 4 and 100 * len(v) > 3 * len(texts[k[0]])}
    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, norm(x)) not in above), h) for i, t, h in rows]
    df = docs(rows).withColumn("gone", F.lit("clash"))
    out = line_quality.cut_lines(df, least_documents=4, most_share=3)
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str) == sorted(want, key=str)
    assert out.columns == df.columns and above and line_quality.cut_lines(docs([])).count() == 0


def test_exact_copies_count_once(spark, docs):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text, "h") for i in range(60)] + [(100 + i, f"{text} {i}", "h") for i in range(5)]
    assert all(r.kept for r in line_quality.judge_lines(docs(rows)).collect())


def test_repeated_words_equals_plain_count():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        grams = [tuple(words[k:k + 8]) for k in range(max(0, len(words) - 7))]
        cover = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 8)}
        assert line_quality.repeated_words(words) == len(cover)
