"""Text rules as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import schema

# Patterns that decide results (fixed values).
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
FORMULA, BASE64 = r"(?s)<latexit.*?</latexit>", r"[A-Za-z0-9+/]{60,}={0,2}"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LECTURE = r"\bLecture\s+\d+\b"
META_CLAIM = (
    r"(?i)\b(passages?|slides?|context|excerpts?|document)\b.{0,40}?\b(do(es)? not|don't|doesn't|no|never|lack|omit|fail)\b"
    r"|\b(not|never)\b.{0,20}?\b(mentioned|provided|given|stated|shown|covered|specified|described|included)\b"
)
LINE_PATTERNS = {
    "markdown_atx": r"^#{1,6}\s+\S",
    "markdown_setext": r"^[=-]{3,}\s*$",
    "numbered": r"^\d+(\.\d+)*[.)]?\s+\S",
    "all_caps": r"^[A-Z][A-Z0-9 \-&/(),.]{4,60}$",
    "keyword": r"(?i)^(chapter|lecture|week|topic|section|part)\b",
    "bullet": r"^\s*[-*•]\s+\S",
    "page_marker": r"^<!-- page \d+ -->$",
}


#: White space of any script, as \s under (?U) has it; the characters are named, as trimming and plain classes are much faster.
SPACE = "\t\n\x0b\f\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What divides words: white space and the four separators of ASCII. As a class of Java's: a table for Latin-1, and one range to pass for the rest.
DIVIDERS = SPACE + "\x1c\x1d\x1e\x1f"
DIVIDER = f"[{''.join(x for x in DIVIDERS if x < chr(256))}[\u1680-\u3000&&[{''.join(x for x in DIVIDERS if x >= chr(256))}]]]+"
#: LINE_BREAK but for the plain one.
OTHER_BREAK = "[\x0b\f\r\x1c\x1d\x1e\x85[\u2028-\u2029]](?:(?<=\r)\n)?"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(c, F.lit(SPACE))


def clean(c: Column) -> Column:
    """Formula blobs to a mark, line ends and spaces to their plain forms, control characters out."""
    for pattern, to in ((FORMULA, " [FORMULA] "), (BASE64, " [FORMULA] "), (r"\r\n", "\n"), ("\u00a0", " "), (CONTROL, ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, OTHER_BREAK, "\n"), "\n"), strip), lambda x: x != "")


def without_page_number(c: Column, stripped: bool = False) -> Column:
    """stripped: c is known to have no white space at its ends, as lines() gives it."""
    bare = c if stripped else strip(c)
    # A number can only stand there if the last character is a digit; most lines end without one.
    return F.when(F.substring(bare, -1, 1).rlike(r"(?U)\d"), strip(F.regexp_replace(c, r"(?U)\s*\d{1,4}\s*$", ""))).otherwise(bare)


def is_blank(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE)) == ""


def doc_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike("solution|answer"), "tutorial_soln").when(p.rlike("tutorial|problem"), "tutorial_q").when(p.rlike("slide|lecture"), "slides").otherwise("notes")


def lecture_id(head: Column) -> Column:
    return F.nullif(F.regexp_extract(head, LECTURE, 0), F.lit(""))


def word_count(c: Column) -> Column:
    bare = F.btrim(c, F.lit(DIVIDERS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, DIVIDER)))


def join_parts(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def breadcrumb(course: Column, lecture: Column, section: Column, content: Column) -> Column:
    return F.concat_ws("\n", join_parts(" > ", course, lecture, section), content)


def ask_citation(path: Column, lecture: Column, section: Column, pages: Column) -> Column:
    """[path | lecture | section pA-B]; without pages, just the place."""
    low, high = F.array_min(pages).cast("string"), F.array_max(pages).cast("string")
    where = F.when(F.size(pages) == 1, F.concat(F.lit(" p"), low)).when(F.size(pages) > 1, F.concat(F.lit(" pp"), low, F.lit("-"), high)).otherwise("")
    return F.concat(F.lit("["), join_parts(" | ", path, lecture, section), where, F.lit("]"))


def quiz_citation(path: Column, lecture: Column, label: Column) -> Column:
    return F.concat(F.lit("["), path, F.lit(" | "), F.coalesce(F.nullif(lecture, F.lit("")), F.lit("no lecture")), F.lit(" | "), label, F.lit("]"))


def run_label(first: Column, last: Column) -> Column:
    return F.concat(F.lit("slides "), (first + 1).cast("string"), F.lit("-"), (last + 1).cast("string"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def quote_supported(quote: Column, source: Column, overlap: float = schema.QUOTE_OVERLAP) -> Column:
    """Whether the words of the quote stand in the source in one run, or enough of them anywhere."""

    def judge(x: Column) -> Column:
        q, s = x["q"], x["s"]
        # Words are looked up once each: distinct ones are met with the source's, repeats count by how often they stand in the quote.
        held = F.array_intersect(q, s)
        known = F.size(F.filter(q, lambda w: F.array_contains(held, w))) / F.size(q)
        return F.when(F.size(q) == 0, False).when(F.array_join(s, " ").contains(F.array_join(q, " ")), True).otherwise(known >= overlap)

    # Bound as a struct, so that neither side is split into words again for every word of the quote.
    bound = F.when(quote.isNotNull() & source.isNotNull(), F.array(F.struct(words(quote).alias("q"), words(source).alias("s"))))
    return F.get(F.transform(bound, judge), F.lit(0))


def is_meta_claim(c: Column) -> Column:
    return c.rlike(META_CLAIM)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
