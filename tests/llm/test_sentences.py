"""Sentence units: rules, chunks against whole texts, the operator."""

import random
import re

import pytest
from pyspark.sql import functions as F

from canopyq.llm import sentences as s


def units(text):
    return [text[a:z] for a, z in s.sentences(text)]


@pytest.mark.parametrize(
    "want",
    [
        ["It costs 3.14 here.", "Dr. Vesk went."],
        ["We saw birds etc.", "Then we left."],
        ["V. B. Vesk said so.", "Yes!"],
        ["“Do you see it?” said Vesk.", "No."],
        ["(A whole one.)", "Another one."],
        ["A part (is it in brackets?) of one.", "Next."],
        ["人们说花园。", "“我们回家？”他这样说。", "对！"],
        ["朝になると開きます。", "「守ります。」とVeskが言った。"],
        ["यह पुल है।", "वह नदी है?"],
        ["Όταν μένει;", "Εδώ είναι."],
        ["ይህ ድልድይ ነው።", "ሰዎች ይላሉ።"],
        ["Die 1. Brücke steht.", "Am Ende z.B. Vesk."],
        ["See https://a.example/q?x=1.2 now.", "Then v1.2 came."],
        ["It waits … and waits.", "Done..."],
        ["lower start here.", "another lower one."],
    ],
)
def test_units(want):
    assert units(" ".join(want)) == want


def test_lines():
    assert units("Heading\n\nOne line\nwrapped here. Two.\r\n\r\n- a b. c\n- d\n1. not a list") == ["Heading", "One line\nwrapped here.", "Two.", "- a b. c", "- d", "1. not a list"]
    assert units("The kettle holds.Many visitors say so. index.html stays") == ["The kettle holds.", "Many visitors say so.", "index.html stays"]
    assert units("") == [] and units(" \n ") == []


def test_thai():
    assert units("เราเห็นสะพาน ตลาดเก่าแสดง 77 สะพาน") == ["เราเห็นสะพาน", "ตลาดเก่าแสดง 77 สะพาน"]


def test_composition_is_associative():
    rng = random.Random(1)
    fs = [bytes(rng.randrange(s.STATES) for _ in range(s.STATES)) for _ in range(9)]
    state, want = s.START, []
    for f in fs:
        want.append(state)
        state = f[state]
    assert s.scan(fs) == want


BITS = ["Word ", "word ", "Dr. ", "etc. ", "3.14 ", "“", "” ", "(", ") ", '"', ". ", "! ", "?” said X. ", "... ", "\n\n", "\n", "- item\n", "1. item\n", "中文。", "ไทย ", "α; ", "A. ", "。”", "x.Y", ":-) "]


def random_text(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_units_cover_all_but_white_space():
    rng = random.Random(4)
    for _ in range(300):
        t = random_text(rng, rng.randint(0, 60))
        found = s.sentences(t)
        assert re.sub(r"\s", "", "".join(t[a:z] for a, z in found)) == re.sub(r"\s", "", t)
        assert all(a < z and t[a:z] == t[a:z].strip() for a, z in found)


def in_chunks(text, size):
    made = [(p, a - b, z - b, b, s._marks(p, a, z, b, beyond)) for _, a, z, b, p, beyond in s.pieces(text, size)]
    states = s.scan([s.function(p, marks, a, z) for p, a, z, _, marks in made])
    return s.spans(text, [e + b for (p, a, z, b, marks), state in zip(made, states, strict=True) for e in s.run(p, marks, a, z, state)[1]])


def test_chunks_of_long_lines_follow_the_rules_of_whole_texts():
    for bit in ("- x and so on. ", "– a pause here. ", "7. The next one. "):
        for shift in range(0, 15, 2):  # so that the context of some chunk begins with the sign
            t = "A" * shift + " word. " + bit * 4000
            assert in_chunks(t, 8192) == s.sentences(t)
            assert in_chunks("- " + t, 8192) == s.sentences("- " + t) == [(0, len(t) + 1)]
    rng = random.Random(8)
    for _ in range(20):
        t = random_text(rng, 900) + "\n" + " " * rng.choice([0, 5000]) + "x. Y " * 900 + "\r\n2. item. Z\n" + random_text(rng, 900).replace("\n", " ")
        assert in_chunks(t, 700) == s.sentences(t)


@pytest.mark.parametrize("breaks", [True, False])
def test_chunks_of_any_size_give_what_the_whole_text_gives(breaks):
    rng = random.Random(11 + breaks)
    for _ in range(150):
        t = random_text(rng, rng.randint(5, 400))
        for old, new in ((" ", rng.choice([" ", " ", " " * 300])), ("\n", "\n" if breaks else " "), ("word ", rng.choice(["word ", "www.a.b/" + "x." * 300, "w@x.y."]))):
            t = t.replace(old, new)
        for size in (20, 150, 900):
            assert in_chunks(t, size) == s.sentences(t)


def test_quotations_of_any_length():
    inside = "One word here. " * 700  # 10,500 characters
    for left, right in ("“”", "«»", "()", '""'):
        t = f"Vesk wrote {left}{inside.strip()}{right} and left. Then more."
        assert units(t) == [f"Vesk wrote {left}{inside.strip()}{right} and left.", "Then more."]
        assert in_chunks(t, 512) == s.sentences(t)
        open_only = f"Vesk wrote {left}{inside}\n\nThen{right} more."
        assert len(units(open_only)) > 700 and in_chunks(open_only, 512) == s.sentences(open_only)


def test_numbered_line_after_a_long_line():
    long = "5. word " + "word " * 300
    assert units(f"{long}\n6. One. Two") == [long.strip(), "6. One. Two"]
    plain = "word " * 300
    text = f"7. a\n\n{plain}\n8. was it. Two"
    assert [k for k, *_ in s.symbols(text, 0, len(text)) if k in s.LINES] == ["number", "blank", "plain", "number"]
    assert s.LINES["number"][s.PLAIN] == s.ITEM and s.LINES["number"][s.BLANK] == s.LISTED


def test_operator(spark):
    rng = random.Random(6)
    texts = [None, "", " \n", "One. Two.", *[random_text(rng, 700) for _ in range(12)], "word " * 3000 + ". End", "中" * 6000 + "。中"]
    texts.append(texts[5])
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, sent_start int")
    want = sorted((k, a, z) for k, t in enumerate(texts) if t for a, z in s.sentences(t))
    whole = s.split_sentences(df, ["doc_id"])
    assert [f.simpleString() for f in whole.schema] == ["doc_id:bigint", "sent_start:int", "sent_end:int"]
    assert sorted(map(tuple, whole.collect())) == want
    assert sorted(map(tuple, s.split_sentences(df, ["doc_id"], long_chars=1500, chunk_chars=700).collect())) == want
    clash = df.withColumnRenamed("doc_id", "a").withColumn("z", F.lit(1)).withColumn("h", F.lit(2))
    assert s.split_sentences(clash, ["a", "z", "h"], long_chars=1500, chunk_chars=700).count() == len(want)
    assert s.split_sentences(df.limit(0), ["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="keep"):
        s.split_sentences(df, ["sent_start"])
