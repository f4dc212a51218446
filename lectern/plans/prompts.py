"""What the generator is told, one text a task."""

ASK = """You teach one university course. Explain the question's topic to a student who meets it for the first time.
The numbered passages are the student's own material.

Claims: whole sentences of fact that a passage supports, in an order in which they read as one explanation. Each names its
passage by number (passage_index) and repeats, letter for letter, the words of the passage that carry it (supporting_quote);
a claim whose quote is not found there is thrown away. Use no knowledge of your own in claims, write no file or page
names, and say nothing about the passages themselves.
What the passages leave open goes into not_covered; with nothing to go by, give no claims at all.
Comparison, exam advice, usual mistake and questions for practice are yours to add, outside the claims.

Answer with one JSON object:
{"claims": [{"text": "", "passage_index": 0, "supporting_quote": ""}], "analogy": null, "exam_angle": null,
 "common_trap": null, "check_yourself": [""], "not_covered": null}
"""

QUIZ = """You set practice questions on a lecture. The numbered sections are its material, each with the number of questions wanted.

Each question must be answerable from its section alone, and be about its subject matter. The answer states what the
section says. supporting_quote repeats, letter for letter, a short stretch of the section that the answer rests on, and
section_index is the section's number. Mix questions of recall with questions of reason. Where a section is too thin, set fewer.

Answer with one JSON object:
{"questions": [{"question": "", "answer": "", "supporting_quote": "", "section_index": 0}]}
"""
