"""Rules of footers, slides, sections and chunks on made-up decks."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import slides


def deck(spark, pages, document=1):
    return spark.createDataFrame([(document, "CS1", i, p) for i, p in enumerate(pages, 1)], "document_id long, course string, page int, text string")


def lecture_deck(nouns, footer="A Lecturer"):
    return [f"{i}Topic{n}\n{n} discussed at some length on this page here\n{footer} {i}" for i, n in enumerate(nouns, 1)]


def footer(spark, pages):
    got = slides.footers(deck(spark, pages)).collect()
    return got[0]["footer"] if got else None


def test_footers(spark):
    nouns = "abcdefghij"
    assert footer(spark, lecture_deck(nouns)) == "A Lecturer"
    assert footer(spark, ["one", "two", "three"]) is None
    assert footer(spark, ["", ""]) is None
    assert footer(spark, ["same\nsame\nsame\nsame\nsame\nFoot 1", "b\nFoot 2", "c\nFoot 3"]) == "Foot"


@pytest.mark.parametrize("page, line, title", [(4, "4Motivation", "Motivation"), (7, "73D Convolution", "3D Convolution"), (2, "3D Convolution", "3D Convolution"), (1, "10 reasons", "0 reasons")])
def test_titles(spark, page, line, title):
    p = spark.createDataFrame([(1, "c", page, f"{line}\nbody")], "document_id long, course string, page int, text string")
    assert slides.parse(p, None).first()["title"] == title


def test_footer_in_the_middle(spark):
    f = spark.createDataFrame([(1, "A Lecturer")], "document_id long, footer string")
    row = slides.parse(deck(spark, ["Title\nA Lecturer 1\nreal body"]), f).first()
    assert (row["title"], row["body"]) == ("Title", "real body")
    empty = slides.parse(deck(spark, ["  \n"]), None).first()
    assert (empty["title"], empty["body"]) == (None, "")


def test_sections(spark):
    rows = slides.with_sections(slides.parse(deck(spark, ["Outline\nSection A\nSection B", "Intro\nx", "OUTLINE\nSection A", "Deep\ny", "Overview\n", "Late\nz"]), None)).orderBy("page").collect()
    assert [r["section"] for r in rows] == [None, None, "Section A", "Section A", "Section A", "Section A"]
    assert [r["body"] for r in rows] == ["", "x", "", "y", "", "z"]


LONG = " ".join(f"word{i}" for i in range(20))


def test_equal_slides_and_ordinals(spark):
    same = slides.chunks(deck(spark, [f"Same\n{LONG}"] * 3), remove_footer=False).collect()
    assert [(r["ordinal"], r["page"]) for r in same] == [(0, 1)]
    got = slides.chunks(deck(spark, ["Outline\nPart", f"A\n{LONG}", f"B\n{LONG}", "Tiny\nx"]), remove_footer=False).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["page"], r["section"]) for r in got] == [(0, 2, "Part"), (1, 3, "Part")]


def test_lecture(spark):
    got = slides.chunks(deck(spark, [f"Lecture 5 : Nets\n{LONG}", f"Next\n{LONG}"]), remove_footer=False).collect()
    assert {r["lecture"] for r in got} == {"Lecture 5"}


def packed(title, lines, limit):
    prefix, out, held = f"{title}\n" if title else "", [], []
    for line in lines:
        if held and len((prefix + "\n".join([*held, line])).split()) > limit:
            out.append(prefix + "\n".join(held))
            held = []
        held.append(line)
    return [*out, prefix + "\n".join(held)]


def test_packing_lines_like_a_loop(spark):
    rng = random.Random(1)
    cases = [(i, rng.choice(["A title", None]), [" ".join("w" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))]) for i in range(40)]
    df = spark.createDataFrame([(i, t, "\n".join(x)) for i, t, x in cases], "i int, title string, body string")
    got = {r["i"]: r["p"] for r in df.select("i", slides.packed_lines(F.col("title"), F.col("body"), 12).alias("p")).collect()}
    assert got == {i: packed(t, x, 12) for i, t, x in cases}


def test_oversized_slides_keep_their_title(spark):
    body = "\n".join(f"line {i} with five more words here" for i in range(200))
    by_words = slides.chunks(deck(spark, [f"Dense\n{body}"]), remove_footer=False).orderBy("ordinal").collect()
    assert len(by_words) > 2 and all(r["content"].startswith("Dense\n") and r["token_count"] <= 450 for r in by_words)
    by_function = slides.chunks(deck(spark, [f"Dense\n{body}"]), remove_footer=False, count_tokens=lambda s: s.str.split().str.len()).orderBy("ordinal").collect()
    assert by_function == by_words


def test_other_document_types_are_skipped_with_a_reason(spark):
    docs = spark.createDataFrame([(1, "slides"), (2, "notes"), (3, "poem")], "document_id long, doc_type string")
    pages = deck(spark, [f"A\n{LONG}"]).unionByName(deck(spark, [f"A\n{LONG}"], 2))
    found, none = slides.chunk_documents(docs, pages, remove_footer=False)
    assert {r["document_id"] for r in found.collect()} == {1}
    assert {r["document_id"]: r["reason"] for r in none.collect()} == {2: "no chunking strategy for this document type", 3: "unknown document type"}


def test_clean(spark):
    raw = "a <latexit sha1=x>\nblob</latexit> b\r\n" + "Q" * 70 + "== c\x00\x0bd  e\t f\n\n\n\n g \n"
    assert spark.createDataFrame([(raw,)], "t string").select(text.clean(F.col("t"))).first()[0] == "a [FORMULA] b\n [FORMULA] cd e f\n\n g"


def test_small_rules(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(text.doc_type(F.lit("week1/Tutorial_Solutions.pdf"))) == "tutorial_soln"
    assert one(text.doc_type(F.lit("L3 slides.pdf"))) == "slides"
    assert one(text.without_page_number(F.lit("ResNet50"))) == "ResNet"
    assert one(text.without_page_number(F.lit("Topic 12345"))) == "Topic 1"
    assert one(text.breadcrumb(F.lit("C"), F.lit(None).cast("string"), F.lit("S"), F.lit("x"))) == "C > S\nx"
    pages = lambda *p: F.array(*map(F.lit, p)).cast("array<int>")
    assert one(text.ask_citation(F.lit("a.pdf"), F.lit(None).cast("string"), F.lit("S"), pages(3))) == "[a.pdf | S p3]"
    assert one(text.ask_citation(F.lit("a.pdf"), F.lit("L"), F.lit("S"), pages(3, 4, 9))) == "[a.pdf | L | S pp3-9]"
    assert one(text.ask_citation(F.lit("a.pdf"), F.lit("L"), F.lit("S"), pages())) == "[a.pdf | L | S]"
    quote = lambda q, s: one(text.quote_supported(F.lit(q), F.lit(s)))
    assert quote("The CAT, sat", "on it the cat sat down") and quote("cat", "concat") and not quote("", "x") and not quote("a b c d", "a b")
    assert quote("a b c d", "d c b") and not quote("!!", "!!")
    assert one(text.is_meta_claim(F.lit("The passage does not give the formula"))) and not one(text.is_meta_claim(F.lit("Convolution shares weights")))
