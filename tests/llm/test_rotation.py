from pyspark.sql import functions as F

from textwarden.llm import rotation

SCHEMA = "conv_id long, turn int, role string, text string, block string, turns string"


def parts(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = {}
    for r in rotation.rotate(df, **options).orderBy(F.col("block").asc_nulls_last(), "sub").collect():
        out.setdefault((r.conv_id, r.perspective), []).append(r)
    return out


def test_every_participant_sees_the_dialogue(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ana", "Hi é"), (1, 2, "ben", "Yo <|im_end|>"), (1, 3, "ana", None),
            (1, 4, None, "who"), (2, 0, "ana", "alone"), (None, 0, "ben", "lost")]
    got = parts(spark, rows)
    assert set(got) == {(1, "ana"), (1, "ben"), (1, "unknown"), (2, "ana"), (None, "ben")}
    (ana,) = got[1, "ana"]
    assert ana.text == ("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi é<|im_end|>\n"
                        "<|im_start|>user name=ben\nYo <\\|im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
                        "<|im_start|>user name=unknown\nwho<|im_end|>\n")
    assert [ana.text[s["first"]:s["last"]] for s in ana.spans] == ["Hi é<|im_end|>", "<|im_end|>"]
    assert (ana.n_turns, ana.n_own) == (5, 2)
    (ben,) = got[1, "ben"]
    assert [ben.text[s["first"]:s["last"]] for s in ben.spans] == ["Yo <\\|im_end|><|im_end|>"]


def test_long_crowded_and_repeated_turns_stay_whole(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(300)]
    rows += [(2, 5, "a", f"tie {i}") for i in range(500)] + [(2, 6, "b", "end"), (2, 6, "b", "end"), (2, None, "b", "last")]
    got = parts(spark, rows, part=16)
    whole = "".join(r.text for r in got[1, "a"])
    assert whole == "".join(f"<|im_start|>{'assistant' if i % 2 == 0 else 'user name=b'}\nt{i}<|im_end|>\n" for i in range(300))
    assert max(r.n_turns for r in got[1, "a"]) == 16
    tied = got[2, "a"]
    assert sum(r.n_turns for r in tied) == 503 and max(r.n_turns for r in tied) <= 64
    text = "".join(r.text for r in tied)
    assert sorted(x for x in text.split("<|im_start|>") if "tie" in x) == sorted(f"assistant\ntie {i}<|im_end|>\n" for i in range(500))
    assert text.endswith("user name=b\nlast<|im_end|>\n") and text.count("end<|im_end|>") == 2


def test_empty_and_native(spark, capsys):
    df = spark.createDataFrame([], SCHEMA)
    out = rotation.rotate(df)
    assert out.count() == 0
    out.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "EvalPython" not in plan
