"""DuckDB SQL of the queries, built from shared common table expressions."""

from __future__ import annotations

from lectern import schema
from lectern.functions import text

META = text.META_CLAIM.replace("'", "''")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s*[0-9]{{1,4}}\s*$', '')")


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def count(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def supported(q: str, s: str) -> str:
    a, b = words(q), words(s)
    return f"(CASE WHEN len({a}) = 0 THEN false WHEN contains(array_to_string({b}, ' '), array_to_string({a}, ' ')) THEN true ELSE len(list_filter({a}, lambda w: list_contains({b}, w))) / len({a}) >= {schema.QUOTE_OVERLAP} END)"


DOCS = "docs AS (SELECT doc_id AS id, lang AS course, source || '/' || doc_id AS doc_path, source AS lecture FROM documents)"
PAGES = (
    "raw AS (SELECT doc_id AS document_id, lang AS course, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), "
    "pages_ AS (SELECT document_id, course, i + 1 AS page, array_to_string(l[i * 4 + 1:i * 4 + 4], chr(10)) AS text FROM (SELECT document_id, course, l, unnest(range(0, (len(l) + 3) // 4)) AS i FROM raw)), "
    f"lines AS (SELECT document_id, page, pos, {strip('line')} AS line FROM (SELECT document_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages_) WHERE {strip('line')} <> '')"
)
FOOTERS = (
    f"seen AS (SELECT DISTINCT document_id, page, {norm('line')} AS footer FROM lines), "
    "footers AS (SELECT document_id, footer FROM (SELECT document_id, footer, count(*) AS n FROM seen WHERE footer <> '' GROUP BY ALL) JOIN (SELECT document_id, count(*) AS pages FROM pages_ GROUP BY ALL) USING (document_id) "
    f"QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, footer) = 1 AND n / pages >= {schema.FOOTER_MIN_SHARE})"
)
SLIDES = (
    f"left_ AS (SELECT document_id, page, line, row_number() OVER (PARTITION BY document_id, page ORDER BY pos) AS rn FROM lines LEFT JOIN footers USING (document_id) WHERE footer IS NULL OR {norm('line')} <> footer), "
    "parts AS (SELECT document_id, page, max(line) FILTER (rn = 1) AS first, string_agg(line, chr(10) ORDER BY rn) FILTER (rn > 1) AS rest FROM left_ GROUP BY ALL), "
    rf"slides AS (SELECT p.document_id, p.course, p.page, nullif({strip(r"regexp_replace(first, '^' || p.page || '\s*', '')")}, '') AS title, coalesce(rest, '') AS body FROM pages_ p LEFT JOIN parts USING (document_id, page))"
)
MARKER = f"coalesce(lower(title) IN ({', '.join(map(repr, schema.SECTION_MARKERS))}), false)"
SECTIONS = (
    f"sections AS (SELECT document_id, course, page, title, CASE WHEN {MARKER} THEN '' ELSE body END AS body, "
    f"last_value(CASE WHEN {MARKER} AND body <> '' AND NOT contains(body, chr(10)) THEN body END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM slides)"
)


def packing(source: str) -> str:
    """rec: slides of `source` (k, title, body) packed line by line; done: k and parts."""
    c, head = count("bl[i + 1]"), f"coalesce({count('title')}, 0)"
    over = f"(open IS NOT NULL AND {head} + n + {c} > {schema.MAX_TOKENS})"
    return (
        f"rec AS (SELECT k, title, string_split(body, chr(10)) AS bl, 0 AS i, []::VARCHAR[] AS parts, NULL::VARCHAR AS open, 0::BIGINT AS n FROM {source} "
        f"UNION ALL SELECT k, title, bl, i + 1, CASE WHEN {over} THEN list_append(parts, open) ELSE parts END, CASE WHEN open IS NOT NULL AND NOT {over} THEN open || chr(10) || bl[i + 1] ELSE bl[i + 1] END, CASE WHEN {over} THEN {c} ELSE n + {c} END FROM rec WHERE i < len(bl)), "
        "done AS (SELECT k, list_transform(list_append(parts, open), lambda p: coalesce(nullif(title, '') || chr(10), '') || p) AS parts FROM rec WHERE i = len(bl))"
    )


CHUNKS = (
    "WITH RECURSIVE " + ", ".join((DOCS, PAGES, FOOTERS, SLIDES, SECTIONS)) + ", "
    "contents AS (SELECT *, concat_ws(chr(10), nullif(title, ''), nullif(body, '')) AS content FROM sections WHERE body <> ''), "
    "once AS (SELECT *, document_id || ':' || page AS k FROM contents QUALIFY row_number() OVER (PARTITION BY document_id, content ORDER BY page) = 1), "
    f"big AS (SELECT * FROM once WHERE {count('content')} > {schema.MAX_TOKENS}), " + packing("big") + ", "
    "cut AS (SELECT document_id, course, section, page, 1 AS part, content, true AS whole FROM once WHERE k NOT IN (SELECT k FROM big) "
    "UNION ALL SELECT document_id, course, section, page, unnest(range(1, len(parts) + 1)), unnest(parts), len(parts) = 1 FROM once JOIN done USING (k)), "
    f"chunks AS (SELECT document_id, course, section, (row_number() OVER (PARTITION BY document_id ORDER BY page, part) - 1)::INTEGER AS ordinal, page::INTEGER AS page, content, {count('content')}::INTEGER AS token_count FROM cut WHERE NOT whole OR {count('content')} >= {schema.MIN_TOKENS})"
)
#: Scored hits: of each lecture of a course the chunks of highest pretended score.
HITS = (
    ", hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, ordinal) AS rank, score, course, document_id, doc_path, lecture, section, ordinal FROM "
    "(SELECT c.course || '/' || coalesce(lecture, '') AS query_id, token_count % 101 / 100.0::DOUBLE AS score, c.course, document_id, doc_path, lecture, section, ordinal FROM chunks c JOIN docs d ON d.id = document_id AND d.course IS NOT DISTINCT FROM c.course) "
    f"QUALIFY rank <= {schema.TOP_K})"
)
#: The start of a document's text, as a question.
QUESTION = "substr(coalesce(text, ''), 1, 200)"
LETTERS = "etaoinshrdlcumwfgypbvk"


def retrieval(question: str) -> str:
    """hits of the whole retrieval by letter counts, reranked by shared words and gated; see the registry's q_retrieve."""
    counts = lambda x: "[" + ", ".join(f"(length(lower({x})) - length(replace(lower({x}), '{a}', '')))::DOUBLE" for a in LETTERS) + "]"
    return (
        f"{CHUNKS}, asked AS (SELECT doc_id AS query_id, lang AS course, CASE WHEN doc_id % 200 = 0 THEN source END AS lecture, {question} AS question FROM documents WHERE doc_id % 100 = 0), "
        f"qv AS (SELECT *, {counts('question')} AS v, list_distinct({words('question')}) AS w FROM asked), "
        f"cv AS (SELECT c.document_id, c.ordinal, c.section, c.content, d.course, d.doc_path, d.lecture, {counts('c.content')} AS v FROM chunks c JOIN docs d ON d.id = c.document_id), "
        "near AS (SELECT q.query_id, q.w, c.document_id, c.ordinal, c.section, c.content, c.course, c.doc_path, c.lecture, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.v, c.v), 10) DESC, c.document_id * 1000000 + c.ordinal) AS r "
        f"FROM qv q JOIN cv c ON c.course = q.course AND (q.lecture IS NULL OR c.lecture = q.lecture) WHERE list_max(q.v) > 0 AND list_max(c.v) > 0 QUALIFY r <= {schema.TOP_K}), "
        f"scored AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: list_contains({words('content')}, x))) / len(w) END AS score FROM near), "
        "hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank, score, course, document_id, doc_path, lecture, section, ordinal FROM scored)"
    )


SPANS = (
    ", spans AS (SELECT h.query_id, h.rank, c.ordinal, c.page, c.content FROM hits h JOIN chunks c ON c.document_id = h.document_id AND (c.section = h.section OR h.section IS NULL AND c.ordinal BETWEEN h.ordinal - 1 AND h.ordinal + 1))"
)
PASSAGES = (
    f", gated AS (SELECT * FROM hits QUALIFY score >= greatest({schema.MIN_RERANK_SCORE}, max(score) OVER (PARTITION BY query_id) * {schema.RELATIVE_FLOOR})), "
    "held AS (SELECT query_id, rank, string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) AS span, array_to_string(list_sort(list_distinct(list(page) FILTER (page IS NOT NULL))), ',') AS pages, min(page) AS lo, max(page) AS hi, count(DISTINCT page) AS np, string_agg(content, chr(10) || chr(10) ORDER BY ordinal) AS content FROM spans GROUP BY ALL), "
    "distinct_ AS (SELECT * FROM gated JOIN held USING (query_id, rank) QUALIFY row_number() OVER (PARTITION BY query_id, document_id, span ORDER BY rank) = 1), "
    f"passages AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS passage FROM distinct_ QUALIFY passage < {schema.MAX_PASSAGES})"
)
BUCKETS = (
    ", buckets AS (SELECT document_id, doc_path, c.course, lecture, coalesce(nullif(section, ''), 'slides ' || (min(ordinal) + 1) || '-' || (max(ordinal) + 1)) AS label, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, count(*) AS n_chunks "
    "FROM chunks c JOIN docs d ON d.id = document_id GROUP BY document_id, doc_path, c.course, lecture, section)"
)
PLAN = (
    f", cuts AS (SELECT *, starts_with(label, 'slides ') AND n_chunks > {schema.RUN_CHUNKS} AS long FROM buckets), "
    f"plan AS (SELECT document_id, doc_path, course, lecture, CASE WHEN long THEN 'slides ' || (s + 1) || '-' || (least(s + {schema.RUN_CHUNKS - 1}, last_ordinal) + 1) ELSE label END AS label, s::INTEGER AS first_ordinal, "
    f"(CASE WHEN long THEN least(s + {schema.RUN_CHUNKS - 1}, last_ordinal) ELSE last_ordinal END)::INTEGER AS last_ordinal, (CASE WHEN long THEN least(s + {schema.RUN_CHUNKS - 1}, last_ordinal) - s + 1 ELSE n_chunks END)::BIGINT AS n_chunks, document_id || ':' || s AS key "
    f"FROM (SELECT *, unnest(CASE WHEN long THEN range(first_ordinal, last_ordinal + 1, {schema.RUN_CHUNKS}) ELSE [first_ordinal] END) AS s FROM cuts))"
)
_ORDER = "doc_path, first_ordinal, key"
QUOTAS = (
    f", sized AS (SELECT *, count(*) OVER w AS b, sum(n_chunks) OVER w AS total, {schema.DEFAULT_QUESTIONS} - count(*) OVER w AS spare, row_number() OVER (PARTITION BY course, lecture ORDER BY n_chunks DESC, {_ORDER}) AS by_size FROM plan WINDOW w AS (PARTITION BY course, lecture)), "
    f"ranked AS (SELECT *, spare * n_chunks // total AS share, row_number() OVER (PARTITION BY course, lecture ORDER BY spare * n_chunks % total DESC, n_chunks DESC, {_ORDER}) AS by_rest FROM sized), "
    f"quotas AS (SELECT *, (CASE WHEN spare < 0 THEN CASE WHEN by_size <= {schema.DEFAULT_QUESTIONS} THEN 1 ELSE 0 END ELSE 1 + share + CASE WHEN by_rest <= spare - sum(share) OVER (PARTITION BY course, lecture) THEN 1 ELSE 0 END END)::BIGINT AS quota FROM ranked)"
)
#: Pretended questions: every document asks about its first planned bucket with benchmark quotes and with its own words.
QUESTIONS = (
    ", owned AS (SELECT document_id, course, lecture, key, quota, first_ordinal, last_ordinal, row_number() OVER (PARTITION BY document_id ORDER BY first_ordinal, key) - 1 AS section_index FROM quotas), "
    "chosen AS (SELECT document_id AS scope, section_index, key, quota, (SELECT string_agg(content, chr(10) || chr(10) ORDER BY ordinal) FROM chunks c WHERE c.document_id = owned.document_id AND c.ordinal BETWEEN first_ordinal AND last_ordinal) AS content FROM owned), "
    "asked AS (SELECT document_id AS scope, ordinal AS pos, ordinal // 2 AS section_index, CASE WHEN ordinal % 3 = 0 THEN 'entirely made up words' ELSE content END AS supporting_quote FROM chunks), "
    f"tested AS (SELECT a.scope, a.pos, a.section_index, key, quota, quota IS NOT NULL AND coalesce({supported('supporting_quote', 'content')}, false) AS valid FROM asked a LEFT JOIN chosen USING (scope, section_index)), "
    "written AS (SELECT *, coalesce(sum(valid::INTEGER) OVER (PARTITION BY scope, section_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM tested), "
    "judged AS (SELECT scope, pos, section_index, key, CASE WHEN quota IS NULL THEN 'bad_section' WHEN w >= quota THEN 'over_quota' WHEN NOT valid THEN 'unverified' ELSE 'kept' END AS status FROM written)"
)
SCORES = (
    "WITH scores AS (SELECT doc_id, lang AS course, source AS kind, quality::DOUBLE AS faithfulness, toxic::DOUBLE AS answer_relevancy, n_chars % 1000 / 1000.0::DOUBLE AS context_precision FROM documents LEFT JOIN labels USING (doc_id))"
)


def _means(by: str) -> str:
    m = lambda c: f"round(avg({c}), 4) AS {c}, count({c}) AS {c}_scored, count(*) - count({c}) AS {c}_unscored"
    return f"SELECT {by}, count(*) AS n, {m('faithfulness')}, {m('answer_relevancy')}, {m('context_precision')} FROM scores GROUP BY {by}"


MEANS = _means("kind")
CLEAN = "html"
for _p, _to, _f in ((text.FORMULA, " [FORMULA] ", "g"), (text.BASE64, " [FORMULA] ", "g"), (r"\r\n", "\n", "g"), (" ", " ", "g"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", "g"), (r"[ \t]+", " ", "g"), (r"\n{3,}", "\n\n", "g")):
    CLEAN = f"regexp_replace({CLEAN}, '{_p}', '{_to}', '{_f}')"
_DUCK_PATTERNS = {n: p.replace("'", "''") for n, p in text.LINE_PATTERNS.items()}
_STATUS = (
    "WITH prior AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations) "
    f"SELECT conv_id, turn, CASE WHEN source IS NULL THEN 'bad_index' WHEN regexp_matches(text, '{META}') THEN 'meta' WHEN NOT {supported('text', 'source')} THEN 'unverified' ELSE 'kept' END AS status FROM prior"
)

ORACLE: dict[str, str] = {
    "vector_topk": f"SELECT * FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 10) DESC, r.vec_id)::INTEGER AS rank FROM embeddings q JOIN embeddings r ON q.label = r.label WHERE q.vec_id % 100 = 0) WHERE rank <= {schema.TOP_K}",
    "scoped_search": "SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 10) DESC, id)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s "
    f"FROM embeddings q JOIN embeddings r ON q.label = r.label AND (q.vec_id % 200 <> 0 OR q.vec_id % 3 = r.vec_id % 3) WHERE q.vec_id % 100 = 0)) WHERE rank <= {schema.TOP_K}",
    "topk_edge_vectors": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 NOT IN (1, 2, 3)) SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 10) DESC, id)::INTEGER AS rank FROM "
    f"(SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(q.v, r.v) AS s FROM e q JOIN e r ON q.label = r.label WHERE q.vec_id % 100 = 0)) WHERE rank <= {schema.TOP_K}",
    "retrieve": retrieval(QUESTION) + f"{SPANS}{PASSAGES} SELECT query_id, passage::INTEGER AS passage, doc_path, section, pages, md5(content) AS content, round(score, 6) AS score FROM passages",
    "ask_status": retrieval("(doc_id // 100) || ' ' || " + QUESTION) + f"{SPANS}{PASSAGES}, had AS (SELECT DISTINCT query_id AS h FROM passages) SELECT query_id, h IS NOT NULL AND (query_id // 100) % 3 = 0 AS failed, h IS NULL AS no_context FROM asked LEFT JOIN had ON h = query_id",
    "quiz_prompts": f"{CHUNKS}{BUCKETS}{PLAN}{QUOTAS}, texts AS (SELECT key, string_agg(content, chr(10) || chr(10) ORDER BY ordinal) AS content FROM plan p JOIN chunks c ON c.document_id = p.document_id AND ordinal BETWEEN first_ordinal AND last_ordinal GROUP BY key), "
    "picked AS (SELECT concat_ws(' / ', course, lecture) AS scope, row_number() OVER (PARTITION BY course, lecture ORDER BY doc_path, first_ordinal, key) - 1 AS i, label, quota, t.content FROM quotas JOIN texts t USING (key) WHERE quota > 0) "
    "SELECT scope, md5('Scope: ' || scope || chr(10) || chr(10) || string_agg('[section ' || i || '] ' || label || '; questions wanted: ' || quota || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) || chr(10)) AS prompt FROM picked GROUP BY scope",
    "quiz_means": f"{CHUNKS}{BUCKETS}{PLAN}, t AS (SELECT concat_ws(' / ', lang, source) AS scope, doc_id || ':0' AS section_key, quality::DOUBLE AS faithfulness FROM documents LEFT JOIN labels USING (doc_id)), h AS (SELECT t.*, p.key IS NOT NULL AS held FROM t LEFT JOIN plan p ON p.key = section_key) "
    "SELECT scope, count(*) AS n, round(avg(faithfulness), 4) AS faithfulness, count(faithfulness) AS faithfulness_scored, count(*) - count(faithfulness) AS faithfulness_unscored, count(*) FILTER (held) AS with_text FROM h GROUP BY scope",
    "clean_text": f"SELECT page_id, md5({strip(CLEAN)}) AS cleaned FROM pages",
    "doc_type": "SELECT page_id, CASE WHEN regexp_matches(lower(url), 'solution|answer') THEN 'tutorial_soln' WHEN regexp_matches(lower(url), 'tutorial|problem') THEN 'tutorial_q' WHEN regexp_matches(lower(url), 'slide|lecture') THEN 'slides' ELSE 'notes' END AS doc_type FROM pages",
    "footer_detect": f"WITH {PAGES}, {FOOTERS} SELECT document_id, footer FROM footers",
    "parse_slides": f"WITH {PAGES}, {FOOTERS}, {SLIDES} SELECT document_id, page, title, body FROM slides",
    "sections_ffill": "WITH turns AS (SELECT conv_id AS document_id, turn AS page, CASE WHEN role = 'user' THEN 'Outline' ELSE role END AS title, coalesce(text, '') AS body FROM conversations) "
    f"SELECT document_id, page, title, CASE WHEN {MARKER} THEN '' ELSE body END AS body, last_value(CASE WHEN {MARKER} AND len(regexp_extract_all(body, '[^\\n]*\\S[^\\n]*')) = 1 THEN {strip('body')} END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM turns",
    "chunk_ordinals": f"{CHUNKS} SELECT document_id, course, section, ordinal, page, md5(content) AS content, token_count FROM chunks",
    "breadcrumbs": f"{CHUNKS} SELECT document_id, ordinal, md5(concat_ws(chr(10), concat_ws(' > ', nullif(c.course, ''), nullif(d.lecture, ''), nullif(c.section, '')), content)) AS crumb FROM chunks c JOIN docs d ON d.id = document_id",
    "lecture_detect": "SELECT conv_id, turn, nullif(regexp_extract('Lecture ' || turn || '0 : ' || coalesce(text, ''), '\\bLecture\\s+\\d+\\b'), '') AS lecture, nullif(regexp_extract(coalesce(text, ''), '\\bLecture\\s+\\d+\\b'), '') AS none FROM conversations",
    "hash_dedupe": "SELECT course, content_hash, count(*) AS copies, min(doc_path) AS first_path FROM (SELECT lang AS course, source || '/' || doc_id AS doc_path, sha256(coalesce(text, '')) AS content_hash FROM documents) GROUP BY ALL",
    "new_files": "WITH f AS (SELECT lang AS course, source || '/' || doc_id AS doc_path, sha256(coalesce(text, '')) AS content_hash, n_chars FROM documents), k AS (SELECT course, content_hash, min(doc_path) AS p FROM f WHERE n_chars > 2000 GROUP BY ALL) "
    "SELECT f.course, doc_path, f.content_hash FROM f LEFT JOIN k USING (course, content_hash) WHERE p IS NULL QUALIFY row_number() OVER (PARTITION BY course, content_hash ORDER BY doc_path) = 1",
    "upsert_documents": "WITH o AS (SELECT doc_id AS id, lang AS course, source || '/' || doc_id AS doc_path, sha256(coalesce(text, '')) AS content_hash, 1 AS ingested, 1 AS updated FROM documents WHERE n_chars >= 1000), n AS (SELECT doc_id + 1000000 AS id, lang AS course, source || '/' || doc_id AS doc_path, sha256('new' || coalesce(text, '')) AS content_hash, 2 AS ingested, 2 AS updated FROM documents WHERE n_chars < 3000) "
    "SELECT coalesce(o.id, n.id) AS id, course, doc_path, coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(o.ingested, n.ingested) AS ingested, coalesce(n.updated, o.updated) AS updated FROM o FULL JOIN n USING (course, doc_path)",
    "replace_chunks": "WITH n AS (SELECT conv_id, turn, 'new ' || text AS text FROM conversations WHERE turn < 2) SELECT conv_id AS document_id, turn::INTEGER AS ordinal, text AS content FROM n UNION ALL SELECT conv_id, turn::INTEGER, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM n)",
    "score_gate": f"{CHUNKS}{HITS} SELECT query_id, document_id, ordinal, score FROM hits QUALIFY score >= greatest({schema.MIN_RERANK_SCORE}, max(score) OVER (PARTITION BY query_id) * {schema.RELATIVE_FLOOR})",
    "rerank_order": f"{CHUNKS}{HITS} SELECT query_id, document_id, ordinal, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, rank))::INTEGER AS new_rank FROM hits",
    "expand_spans": f"{CHUNKS}{HITS}{SPANS} SELECT query_id, rank::INTEGER AS rank, ordinal, page FROM spans",
    "passages": f"{CHUNKS}{HITS}{SPANS}{PASSAGES} SELECT query_id, passage::INTEGER AS passage, doc_path, section, pages, md5(content) AS content, score FROM passages",
    "ask_citations": f"{CHUNKS}{HITS}{SPANS}{PASSAGES} SELECT query_id, passage::INTEGER AS passage, '[' || concat_ws(' | ', nullif(doc_path, ''), nullif(lecture, ''), nullif(section, '')) || CASE WHEN np = 1 THEN ' p' || lo WHEN np > 1 THEN ' pp' || lo || '-' || hi ELSE '' END || ']' AS citation FROM passages",
    "ask_prompts": f"{CHUNKS}{HITS}{SPANS}{PASSAGES} SELECT query_id, md5('Question: ' || query_id || chr(10) || chr(10) || 'Passages:' || chr(10) || string_agg('[' || passage || '] [' || concat_ws(' | ', nullif(doc_path, ''), nullif(lecture, ''), nullif(section, '')) || CASE WHEN np = 1 THEN ' p' || lo WHEN np > 1 THEN ' pp' || lo || '-' || hi ELSE '' END || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY passage) || chr(10)) AS prompt FROM passages GROUP BY query_id",
    "quote_support": f"WITH n AS (SELECT count(*) AS n FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, item_id, text FROM benchmark) SELECT doc_id, item_id, {supported('b.text', "coalesce(d.text, '')")} AS supported FROM documents d JOIN b ON b.i = d.doc_id % (SELECT n FROM n)",
    "rerank_overlap": f"WITH n AS (SELECT count(*) AS n FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, item_id, list_distinct({words('text')}) AS q FROM benchmark) SELECT doc_id, item_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_filter(q, lambda w: list_contains({words("coalesce(d.text, '')")}, w))) / len(q) END, 6) AS score FROM documents d JOIN b ON b.i = d.doc_id % (SELECT n FROM n)",
    "meta_claims": f"SELECT conv_id, turn, regexp_matches(text, '{META}') AS meta FROM conversations",
    "verify_claims": _STATUS,
    "buckets": f"{CHUNKS}{BUCKETS} SELECT document_id, label, first_ordinal, last_ordinal, n_chunks FROM buckets",
    "plan_buckets": f"{CHUNKS}{BUCKETS}{PLAN} SELECT key, label, first_ordinal, last_ordinal, n_chunks FROM plan",
    "allocate": f"{CHUNKS}{BUCKETS}{PLAN}{QUOTAS} SELECT key, course, lecture, quota FROM quotas",
    "bucket_text": f"{CHUNKS}{BUCKETS}{PLAN} SELECT key, md5(string_agg(content, chr(10) || chr(10) ORDER BY ordinal)) AS content FROM plan p JOIN chunks c ON c.document_id = p.document_id AND ordinal BETWEEN first_ordinal AND last_ordinal GROUP BY key",
    "quiz_citations": f"{CHUNKS}{BUCKETS}{PLAN} SELECT key, '[' || doc_path || ' | ' || coalesce(nullif(lecture, ''), 'no lecture') || ' | ' || label || ']' AS citation FROM plan",
    "quota_filter": f"{CHUNKS}{BUCKETS}{PLAN}{QUOTAS}{QUESTIONS} SELECT scope, pos, status FROM judged",
    "quiz_report": f"{CHUNKS}{BUCKETS}{PLAN}{QUOTAS}{QUESTIONS} SELECT scope, count(*) AS n_generated, count(*) FILTER (status = 'kept') AS n_kept, count(*) FILTER (status = 'over_quota') AS n_dropped_over_quota, count(DISTINCT CASE WHEN status = 'kept' THEN key END) AS sections_covered, sections_available, round(count(DISTINCT CASE WHEN status = 'kept' THEN key END) / sections_available, 4) AS coverage, "
    "round((count(*) - count(*) FILTER (status = 'unverified') - count(*) FILTER (status = 'bad_section')) / count(*), 4) AS quote_validity, count(*) FILTER (status = 'kept') < least(10, sections_available) AS short FROM judged JOIN (SELECT scope, count(*) AS sections_available FROM chosen GROUP BY ALL) USING (scope) GROUP BY scope, sections_available",
    "eval_by_kind": f"{SCORES} {MEANS}",
    "below_threshold": f"{SCORES}, m AS ({_means('course')}) SELECT course, concat_ws(',', CASE WHEN faithfulness < 0.8 THEN 'faithfulness' END, CASE WHEN answer_relevancy < 0.8 THEN 'answer_relevancy' END, CASE WHEN context_precision < 0.8 THEN 'context_precision' END) AS below_threshold FROM m",
    "marks": f"{SCORES}, m AS ({_means('course')}), u AS (SELECT course, 'faithfulness' AS metric, faithfulness AS value FROM m UNION ALL SELECT course, 'answer_relevancy', answer_relevancy FROM m UNION ALL SELECT course, 'context_precision', context_precision FROM m) SELECT course, metric, value, CASE WHEN value IS NULL THEN 'NOT SCORED' WHEN value >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS mark FROM u",
    "routes": "SELECT lang AS course, CASE WHEN quality = 0 OR toxic = 1 THEN 'abstention' ELSE 'judged' END AS route, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "abstention": "SELECT lang AS course, count(*) AS n_abstention, round(avg(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 4) AS abstention_rate, round(avg(CASE WHEN n_chars % 3 = 0 THEN 1.0 ELSE quality END), 4) AS abstention_faithfulness FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "worst_first": "SELECT doc_id, quality::DOUBLE AS quality, (row_number() OVER (ORDER BY quality ASC NULLS FIRST, doc_id))::INTEGER AS place FROM documents LEFT JOIN labels USING (doc_id)",
    "catalog": f"{CHUNKS} SELECT d.course, doc_path, lecture, count(c.document_id) AS chunks FROM docs d LEFT JOIN chunks c ON c.document_id = d.id GROUP BY ALL",
    "catalog_rollup": f"{CHUNKS}, l AS (SELECT d.course, doc_path, lecture, count(c.document_id) AS chunks FROM docs d LEFT JOIN chunks c ON c.document_id = d.id GROUP BY ALL) SELECT course, sum(chunks)::BIGINT AS chunks, md5(string_agg(doc_path || '=' || chunks, ';' ORDER BY lecture NULLS LAST, doc_path)) AS documents FROM l GROUP BY course",
    "scopes": "SELECT DISTINCT lang AS course, source AS lecture FROM documents WHERE source IS NOT NULL",
    "course_lectures": "SELECT DISTINCT lang AS course, source AS lecture FROM documents WHERE source <> ''",
    "line_profile": "WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(CASE WHEN ends_with(coalesce(text, ''), chr(10)) OR coalesce(text, '') = '' THEN string_split(coalesce(text, ''), chr(10))[:-2] ELSE string_split(text, chr(10)) END, lambda x: "
    + strip("x")
    + ") AS l FROM documents) SELECT doc_id, length(text) AS chars, length(text) AS stripped_chars, "
    + count("text")
    + "::BIGINT AS words, len(l)::BIGINT AS lines, len(list_filter(l, lambda x: x = ''))::BIGINT AS blank_lines, "
    + ", ".join(f"len(list_filter(l, lambda x: regexp_matches(x, '{p}')))::BIGINT AS {n}" for n, p in _DUCK_PATTERNS.items())
    + " FROM t",
    "line_samples": f"WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS n, {strip('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE {strip('line')} <> '') "
    "SELECT doc_id, 'first' AS kind, n, line[:88] AS line FROM l WHERE n <= 15 " + " ".join(f"UNION ALL SELECT doc_id, '{n}', (row_number() OVER (PARTITION BY doc_id ORDER BY n))::INTEGER AS m, line[:88] FROM l WHERE regexp_matches(line, '{p}') QUALIFY m <= 4" for n, p in _DUCK_PATTERNS.items()),
    "oversized_split": "WITH RECURSIVE s AS (SELECT doc_id AS k, string_split(text, chr(10))[1] AS title, array_to_string(string_split(text, chr(10))[2:], chr(10)) AS body FROM documents WHERE text IS NOT NULL), " + packing("s") + " SELECT k AS doc_id, unnest(range(1, len(parts) + 1))::INTEGER AS part, md5(unnest(parts)) AS content FROM done",
    "file_identity": "SELECT page_id, string_split(p, '/')[1] AS course, array_to_string(string_split(p, '/')[2:], '/') AS doc_path, sha256(html) AS content_hash FROM (SELECT page_id, html, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages) WHERE contains(p, '/')",
    "corpus_layout": "SELECT string_split(p, '/')[1] AS course, count(*) AS files FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS p FROM pages) WHERE contains(p, '/') GROUP BY ALL",
    "ingest_counters": f"{CHUNKS} SELECT count(*) FILTER (n > 0) AS ingested, count(*) FILTER (n = 0) AS skipped, sum(n)::BIGINT AS total_chunks FROM (SELECT id, count(c.document_id) AS n FROM docs LEFT JOIN chunks c ON c.document_id = id GROUP BY id)",
    "html_preview": "SELECT page_id, replace(replace(replace(html[:700], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS preview FROM pages",
    "profile_text": "WITH " + PAGES + f" SELECT document_id, md5(string_agg('<!-- page ' || page || ' -->' || chr(10) || {strip('text')}, chr(10) || chr(10) ORDER BY page) FILTER ({strip('text')} <> '')) AS joined FROM pages_ GROUP BY document_id",
}
