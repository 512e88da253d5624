"""Files read in pieces against the same text in one row."""

import random

import pytest
from pyspark.sql import functions as F

from textwarden.functions import detectors
from textwarden.functions.text import plain_blanks
from textwarden.operators.large_files import detect_files, scan_large_files
from textwarden.operators.scan import detect
from textwarden.plans.queries import planted
from textwarden.sources import ranges
from textwarden.sources.ranges import list_files, outline, pieces


def whole(spark, texts):
    """Signals of whole texts, without the hash."""
    df = spark.createDataFrame([(k, v, "file.io", "paste") for k, v in texts.items()], "name string, text string, host string, action_type string")
    return {r.name: (r.text_length, r.findings, r.secrets, r.narrative, r.classifier) for r in detect(df).collect()}


def in_pieces(spark, folder, size):
    files = list_files(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return {r.name: (r.text_length, r.findings, r.secrets, r.narrative, r.classifier) for r in detect_files(files, size).collect()}


SENTENCES = ["The plan holds.", "Is it so?", "Yes, it is!", "revenue", "password:", "import os.", "from a.b.", "KEY_A=1", "KEY_B=2", "KEY_C=3", "project codename",
             "4111111111111111", "4111111111111112", "mail a@b.co", "1,2,3,4,5", "415-555-0123", "ssn 123-45-6789", "const a = 1;", "strictly", "confidential.",
             "zX9q!Lm2v@Rt7#Wp4k$Hs8n%Bd3", "é ü 日本語.", "$ 42", "million.", "\U0001f600 ok."]


@pytest.mark.parametrize("open_ends", [False, True])
def test_pieces_give_what_the_whole_text_gives(spark, tmp_path, monkeypatch, open_ends):
    monkeypatch.setattr(ranges, "AROUND", 200)
    rng = random.Random(3 + open_ends)
    texts = {}
    for k in range(12):
        parts = SENTENCES + (["postgres://u", ":p", "@h/x", "Server = a;", "Password=b", "redis://"] if open_ends and k % 2 else [])
        body = "".join(rng.choice(parts) + rng.choice([" ", "\n", "\n\n", "\n\n", "\r\n\r\n", "\n \n"]) for _ in range(500))
        texts[f"{k}.txt"] = body
        (tmp_path / f"{k}.txt").write_bytes(body.encode())
    (tmp_path / "blank.txt").write_bytes(b" \n\n ")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bad.txt").write_bytes(b"caf\xff is it.\n\nYes a@b.co")
    found = pieces(list_files(spark, f"file://{tmp_path}"), 300)
    assert found.count() > (30 if open_ends else 60)
    want = whole(spark, texts | {"bad.txt": "caf� is it.\n\nYes a@b.co"})
    assert in_pieces(spark, f"file://{tmp_path}", 300) == want


def test_planted_documents_in_large_files(spark, data, tmp_path, monkeypatch):
    """All fragments that the scan knows, in files of many documents, cut every 20,000 bytes."""
    texts = {}
    for r in planted(spark, data).orderBy("doc_id").collect():
        if "://" not in r.text and "Server" not in r.text:
            texts.setdefault(f"{r.doc_id % 3}.md", []).append(r.text + "\n\n")
    texts = {k: "".join(v) for k, v in texts.items()}
    for k, v in texts.items():
        (tmp_path / k).write_bytes(v.encode())
    found = pieces(list_files(spark, f"file://{tmp_path}"), 20_000)
    assert found.count() >= 9
    bounds = sorted((r.path, r.start, r.end) for r in found.collect())
    assert all(a[2] == b[1] for a, b in zip(bounds, bounds[1:]) if a[0] == b[0])
    assert in_pieces(spark, f"file://{tmp_path}", 20_000) == whole(spark, texts)


def test_a_hundred_megabytes(spark, tmp_path):
    """A file of 100 MB in many pieces: one e-mail address per paragraph, and a secret on a cut."""
    paragraph = "The quick brown fox writes to someone@example.org about nothing.\n\n"
    n = 100_000_000 // len(paragraph)
    with open(tmp_path / "big.txt", "w") as out:
        for _ in range(n // 10_000):
            out.write(paragraph * 10_000)
    files = list_files(spark, f"file://{tmp_path}").withColumn("host", F.lit("file.io"))
    size = 8_000_000
    assert pieces(files, size).count() > 10
    row = scan_large_files(files, size).first()
    assert [(f.detector, f.n) for f in detect_files(files, size).first().findings] == [("EMAIL", n // 10_000 * 10_000)]
    assert row.final_decision in ("WARN", "BLOCK") and row.text_length == n // 10_000 * 10_000 * len(paragraph)


def test_outlines_hold_the_same_connection_strings(spark):
    rng = random.Random(5)
    parts = ["postgres://", "mysql://u:", "redis://", "rediss://h", "mssql://", "Server = a", "server=", "Password = b", "password", "=", ":", ";", "@", "@h/x", "\"", "\n",
             "\n\n", " " * 60, " \n ", "word " * 20, "x" * 70, "one\n" * 20, "it's " * 15, "\u2003" * 50, "\u2028 tail " * 9]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    rows = [(i, t, outline(t)) for i, t in enumerate(texts)]
    assert sum(len(r[2]) for r in rows) < 0.9 * sum(map(len, texts))
    df = spark.createDataFrame(rows, "id int, whole string, outline string").repartition(8)
    counts = [df.selectExpr("id", f"{plain_blanks(c)} AS _plain").selectExpr("*", *detectors.gate_columns()).selectExpr(
        "id", f"{detectors.connection_counts()} AS n").collect() for c in ("whole", "outline")]
    assert sorted(counts[0]) == sorted(counts[1]) and all(any(r.n[k] for r in counts[0]) for k in (0, 2, 3, 4))


def test_files_are_cut_behind_connection_strings(spark, tmp_path):
    """One scheme at the start of a file leaves no piece much longer than asked for, and tasks do not depend on the rows' size."""
    (tmp_path / "a.txt").write_bytes(b"postgres://u:p" + b" and so it goes.\n\nOn" * 4000 + b"@host/x end")
    files = list_files(spark, f"file://{tmp_path}")
    found = pieces(files, 10_000)
    assert found.count() > 5 and max(r.end - r.start for r in found.collect()) < 25_000
    assert ranges.read_pieces(found, 8).rdd.getNumPartitions() == 8
    assert [(f.detector, f.n) for f in detect_files(files, 10_000).first().findings] == [("DB_POSTGRES", 1)]


def test_parts_of_a_piece_give_what_the_whole_gives(spark, tmp_path, monkeypatch):
    """Lines of prose among lines that patterns begin on and go on from; a piece is scanned in many small parts."""
    monkeypatch.setattr(ranges, "PART_BYTES", 60)
    rng = random.Random(8)
    prose = ["The plan holds for all of us.", "Nobody knows what comes next, or when!", "One, two, three, four, and then five of them.",
             "Acv: $ 5 is what they ask of you.", "Codename: heron, they said to all of them.", "We read the number from os.", "And so it goes on and on."]
    texts = {}
    for k in range(12):
        ends = ["\n", "\n", "\n", "\n\n", " ", "\r\n"] if k % 2 else ["\n"]
        lines = [rng.choice(prose if rng.random() < 0.6 else SENTENCES + ["1,2,3,4 of us.", "FROM_A=to b of us.", "from a.b import c of us.", "postgres://u:p@h/x"]) for _ in range(400)]
        texts[f"{k}.txt"] = "".join(line + rng.choice(ends) for line in lines)
        (tmp_path / f"{k}.txt").write_bytes(texts[f"{k}.txt"].encode())
    files = list_files(spark, f"file://{tmp_path}")
    read = ranges.read_pieces(pieces(files), 8).orderBy("path", "start").collect()
    assert len(read) > 12 * 20 and sum(r.outline is not None for r in read) == 12
    for name, text in texts.items():
        own = [r for r in read if r.path.endswith(f"/{name}")]
        assert "".join(r.text for r in own) == text and all(a.end == b.start for a, b in zip(own, own[1:]))
    assert in_pieces(spark, f"file://{tmp_path}", ranges.RANGE_BYTES) == whole(spark, texts)


def test_parts_do_not_cut_rows_settings_or_imports():
    line = b"The quick brown fox jumps over all of them.\n"
    assert ranges.parts(line * 100, 200) == [len(line) * 5 * k for k in range(20)]
    for before, behind in ((b"one, two, three, four of them.\n", b"Five, six, seven, and then eight of them.\n"), (b"a = some of them.\n", b"KEY_B=2 and others of them.\n"),
                           (b"                          from them.\n", line), (line[:-1] + b"\r\n", line), (b"what are the words:\n", line)):
        assert len(before) * 3 not in ranges.parts(before * 3 + behind * 30, len(before) * 3 - 1)
        assert len(line) * 3 in ranges.parts(line * 30, len(line) * 3 - 1)
