"""The four pipelines: ingest, ask, quiz and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import models, text
from lectern.operators import catalog, evaluate, ground, quiz, retrieval, slides
from lectern.plans import prompts
from lectern.sources import files, shared, store


def ingest(spark: SparkSession, root: str, tables: str, course: str | None = None, force: bool = False, dry_run: bool = False, embed: Callable[[Column], Column] | None = None, model: str = "hashed-words", reader=files.pdf_reader, dim: int = schema.EMBED_DIM, count_tokens: Callable | None = None) -> DataFrame:
    """Files below root into the tables; returns rel_path, status, detail of every file.

    count_tokens: the embedder's tokenizer, on pandas series; by default, and in a dry run, words are counted. A dry run
    makes no vectors and writes nothing.
    """
    wanted, unsupported = files.discover(files.scan(spark, root), course)
    known, bad = files.identified(wanted)
    documents, chunks = store.read(spark, f"{tables}/documents", schema.DOCUMENTS), store.read(spark, f"{tables}/chunks", schema.CHUNKS)
    fresh, same = (known, None) if dry_run else store.new_files(known, documents, force)
    texts, unread = files.loaded(fresh, reader)
    texts = texts.withColumn("document_id", files.document_id()).persist()
    cut, none = slides.chunk_documents(texts.select("document_id", "rel_path", "doc_type"), files.pages(texts), count_tokens=None if dry_run else count_tokens)
    cut = cut.persist()
    counts = cut.groupBy("document_id").agg(F.count("*").alias("n"))
    status = texts.where("doc_type = 'slides'").join(counts, "document_id", "left").select("rel_path", F.lit("ingested").alias("status"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" chunks")).alias("detail"))
    said = lambda df, reason: df.select("rel_path", F.lit("skipped").alias("status"), reason.alias("detail"))
    status = status.unionByName(said(none, F.col("reason"))).unionByName(said(unsupported, F.lit("unsupported file type"))).unionByName(said(bad, F.col("reason"))).unionByName(said(unread, F.col("reason")))
    if same is not None:
        status = status.unionByName(said(same, F.concat(F.lit("same bytes already ingested as "), "known_as")))
    status = shared.cut(status.orderBy("rel_path"))  # before the tables change
    decks = texts.where("doc_type = 'slides'")
    touched = [] if dry_run else sorted(r[0] for r in decks.select("course").distinct().collect())
    if touched:
        now, own = F.current_timestamp(), F.col("course").isin(touched)
        # The document's own lecture is read with the footer still in place.
        first = slides.lectures(slides.with_sections(slides.parse(files.pages(texts).where("page = 1"), None)))
        new_docs = decks.join(first, "document_id", "left").select(F.col("document_id").alias("id"), "course", "doc_path", "content_hash", "doc_type", "lecture", now.alias("ingested_at"), now.alias("updated_at"))
        vectors = (embed or models.embedder(dim=dim))(text.breadcrumb(F.col("course"), F.col("lecture"), F.col("section"), F.col("content")))
        new_chunks = cut.withColumn("embedding", vectors).withColumn("embed_model", F.lit(model)).withColumn("created_at", now).withColumn("updated_at", now)
        held = store.replace_chunks(chunks.where(own), store.checked(new_chunks, dim), decks)
        store.commit(spark, tables, touched, documents=store.upsert_documents(documents.where(own), new_docs), chunks=held)
    cut.unpersist()
    texts.unpersist()
    return status


def counters(status: DataFrame) -> DataFrame:
    """ingested, skipped, total_chunks."""
    n = F.when(F.col("status") == "ingested", F.regexp_extract("detail", r"^(\d+)", 1).cast("long"))
    return status.agg(F.count_if(F.col("status") == "ingested").alias("ingested"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(F.sum(n), F.lit(0)).alias("total_chunks"))


def passages_prompt(passages: DataFrame) -> DataFrame:
    """query_id, prompt: the numbered passages with their citations."""
    block = F.concat(F.lit("["), F.col("passage").cast("string"), F.lit("] "), F.col("citation"), F.lit("\n"), F.col("content"))
    rows = passages.groupBy("query_id", "question").agg(F.sort_array(F.collect_list(F.struct("passage", block.alias("b")))).alias("r"))
    return rows.select("query_id", F.concat(F.lit("Question: "), "question", F.lit("\n\nPassages:\n"), F.array_join(F.transform("r", lambda r: r["b"]), "\n\n"), F.lit("\n")).alias("prompt"))


def sections_prompt(chosen: DataFrame) -> DataFrame:
    """scope, prompt: the numbered sections of a quiz, each with the number of questions it owes.

    chosen: scope, section_index, label, quota, content.
    """
    block = F.concat(F.lit("[section "), F.col("section_index").cast("string"), F.lit("] "), "label", F.lit("; questions wanted: "), F.col("quota").cast("string"), F.lit("\n"), "content")
    rows = chosen.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("section_index", block.alias("b")))).alias("r"))
    return rows.select("scope", F.concat(F.lit("Scope: "), "scope", F.lit("\n\n"), F.array_join(F.transform("r", lambda r: r["b"]), "\n\n---\n\n"), F.lit("\n")).alias("prompt"))


def ask(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embed, rerank=models.overlap_score, generator=models.extractive_answers, system: str = prompts.ASK) -> DataFrame:
    """An answer for each of queries (query_id, course, question, optional lecture).

    query_id, claims (text, citation), explanation, citations, n_claims, analogy, exam_angle, common_trap, check_yourself,
    not_covered, passages (what the generator was shown, in order), error. A generation that failed twice leaves
    its reason in error, and nothing else of it counts; without failure error is null. Queries without passages are
    answered without the generator. Passages and what was generated are written once to the shared folder, so
    that no lost executor makes the generator speak again.
    """
    found = retrieval.retrieve(queries, chunks, documents, embed, rerank).withColumn("citation", text.ask_citation(F.col("doc_path"), F.col("lecture"), F.col("section"), F.col("pages")))
    found = shared.cut(found.join(queries.select("query_id", "question"), "query_id"))
    raw = shared.cut(models.generate(passages_prompt(found), generator, system, models.conforms(schema.ANSWER)))
    answer = raw.select("query_id", "error", models.parsed(F.col("raw"), schema.ANSWER).alias("a"))
    claims = answer.where("error IS NULL").select("query_id", F.col("a.not_covered").alias("not_covered"), F.posexplode_outer("a.claims").alias("claim", "c")).select("query_id", "not_covered", "claim", "c.*")
    shown = F.struct("passage", "citation", "content", "score")
    shown = found.groupBy("query_id").agg(F.sort_array(F.collect_list(shown)).alias("passages"))
    extras = answer.select("query_id", "error", *(F.when(F.col("error").isNull(), F.col(f"a.{c}")).alias(c) for c in ("analogy", "exam_angle", "common_trap", "check_yourself")))
    return ground.answers(queries, found, ground.verdicts(claims, found)).join(extras, "query_id", "left").join(shown, "query_id", "left")


def validate_questions(n: int) -> int:
    if not 1 <= n <= schema.MAX_QUESTIONS:
        raise ValueError(f"between 1 and {schema.MAX_QUESTIONS} questions can be asked for, not {n}")
    return n


def make_quiz(course: str, lecture: str | None, chunks: DataFrame, documents: DataFrame, n_questions: int = schema.DEFAULT_QUESTIONS, generator=models.extractive_quiz, system: str = prompts.QUIZ) -> tuple[DataFrame, DataFrame]:
    """The questions kept (with citation, section and key) and the counters of one quiz.

    One round for all sections, and one more for those that are still owed questions. A round that cannot be generated is an error.
    """
    validate_questions(n_questions)
    docs = documents.where(F.col("course") == course)
    docs = docs if lecture is None else docs.where(F.col("lecture") == lecture)
    plan = quiz.planned(quiz.buckets(retrieval.scoped(chunks.drop("lecture"), course), docs))
    plan = shared.cut(quiz.allocate(plan, n_questions))
    if plan.isEmpty():
        raise LookupError(f"{course!r} has no sections to ask about" + (f" in {lecture!r}" if lecture else ""))
    scope = lecture or f"{course}, all lectures"
    chosen = shared.cut(plan.where("quota > 0").join(quiz.bucket_texts(plan, retrieval.scoped(chunks.drop("lecture"), course)), "key"))
    spark, statuses, kept = chunks.sparkSession, [], None
    rounds = 0
    owed = chosen
    while True:
        # At most MAX_QUESTIONS sections: their order in the prompt is their number.
        rows = owed.orderBy("doc_path", "first_ordinal", "key").collect()
        if not rows:
            break
        asked = spark.createDataFrame([(scope, i, *(r[c] for c in ("key", "quota", "content", "doc_path", "lecture", "label"))) for i, r in enumerate(rows)], "scope string, section_index int, key string, quota long, content string, doc_path string, lecture string, label string")
        before = "" if kept is None else "".join(f"- {r[0]}\n" for r in kept.select("question").collect())
        prompt = sections_prompt(asked).first()["prompt"] + (f"\n{ASKED_BEFORE}\n{before}" if before else "")
        raw = models.generate(spark.createDataFrame([(0, prompt)], "query_id long, prompt string"), generator, system, models.conforms(schema.QUIZ), temperature=0.0)
        said = raw.first()  # one answer, of bounded size
        if said["error"] is not None:
            raise RuntimeError(f"generation failed: {said['error']}")
        raw = spark.createDataFrame([(said["raw"],)], "raw string")
        found = raw.select(F.posexplode(models.parsed(F.col("raw"), schema.QUIZ)["questions"]).alias("pos", "q")).select(F.lit(scope).alias("scope"), "pos", "q.*")
        told = quiz.judged(found, asked).join(asked.select("section_index", "key", "doc_path", "lecture", "label"), "section_index", "left")
        told = spark.createDataFrame(told.select("scope", F.lit(rounds).alias("round"), "pos", "question", "answer", "supporting_quote", "status", "key", "doc_path", "lecture", "label").collect(), "scope string, round int, pos int, question string, answer string, supporting_quote string, status string, key string, doc_path string, lecture string, label string")
        statuses.append(told)
        kept = told.where("status = 'kept'") if kept is None else kept.unionByName(told.where("status = 'kept'"))
        rounds += 1
        owed = quiz.outstanding(chosen, kept)
        if rounds > schema.TOPUP_ROUNDS:
            break
    told = statuses[0] if len(statuses) == 1 else statuses[0].unionByName(statuses[1])
    available = plan.agg(F.count("*").alias("sections_available")).withColumn("scope", F.lit(scope))
    counted = quiz.report(told, available).withColumn("n_requested", F.lit(n_questions)).withColumn("n_topup_rounds", F.lit(rounds - 1))
    questions = kept.select("round", "pos", "question", "answer", "supporting_quote", text.quiz_citation(F.col("doc_path"), F.col("lecture"), F.col("label")).alias("citation"), F.col("label").alias("section"), F.col("key").alias("section_key"))
    return questions, counted


#: Stands before the questions of earlier rounds in a prompt.
ASKED_BEFORE = "Asked before; choose other points of these sections:"
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def evaluate_answers(gold: DataFrame, answered: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """by_course, by_kind, abstention and below_threshold of an evaluation.

    gold: id, course, reference, kind; answered: id, n_claims, not_covered, error; scores: id and the METRICS.
    Questions that failed count in no mean.
    """
    all_ = evaluate.routed(gold).join(answered, "id")
    t = all_.where("error IS NULL").join(scores, "id", "left")
    judged = evaluate.require_samples(t.where("route = 'judged'"))
    by_course = evaluate.means_by(judged, "course", *METRICS)
    quiet = t.where("route = 'abstention'").withColumn("abstained", F.coalesce(F.col("not_covered") != "", F.lit(False)))
    return {"by_course": by_course, "by_kind": evaluate.means_by(judged, "kind", *METRICS), "abstention": evaluate.abstention(quiet, "course"), "below_threshold": evaluate.below(by_course, "course", *METRICS), "marks": evaluate.marks(by_course, "course", *METRICS), "errors": all_.where("error IS NOT NULL").select("id", "course", F.substring("error", 1, 200).alias("error"))}


def failure(e: Exception) -> str:
    return str(e)[:200]


def quiz_scopes(chunks: DataFrame, documents: DataFrame, n_questions: int = schema.DEFAULT_QUESTIONS, generator=models.extractive_quiz) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A quiz of every (course, lecture): counters by scope, the questions kept with the text of their sections, and errors by scope.

    The texts are looked up anew by section, not taken from the quiz; a section that is not found has an empty one.
    Scopes are lectures: few, and one generation each. One that fails is listed and ends no other.
    """
    spark, told, asked, errors = chunks.sparkSession, [], [], []
    for course, lecture in ((r["course"], r["lecture"]) for r in catalog.scopes(documents).collect()):
        scope = f"{course} / {lecture}"
        try:
            questions, counted = make_quiz(course, lecture, chunks, documents, n_questions, generator)
            told += [r.asDict() | {"scope": scope} for r in counted.collect()]
            asked += [(scope, i, r["question"], r["answer"], r["citation"], r["section"], r["section_key"]) for i, r in enumerate(questions.orderBy("round", "pos").collect())]
        except Exception as e:  # noqa: BLE001 - an error of one scope is a result
            errors.append((scope, failure(e)))
    questions = spark.createDataFrame(asked, "scope string, pos int, question string, answer string, citation string, section string, section_key string")
    plan = quiz.planned(quiz.buckets(chunks.drop("lecture"), documents))
    return spark.createDataFrame(told, QUIZ_COUNTERS), evaluate.with_section_texts(questions, quiz.bucket_texts(plan, chunks)), spark.createDataFrame(errors, "scope string, error string")


QUIZ_COUNTERS = "scope string, n_requested int, n_generated long, n_kept long, n_dropped_bad_section long, n_dropped_unverified long, n_dropped_over_quota long, sections_covered long, sections_available long, coverage double, quote_validity double, n_topup_rounds int"


def evaluate_quizzes(counters_: DataFrame, questions: DataFrame, scores: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
    """by_scope (counters with mean faithfulness), per_question (worst first, unscored ahead), errors.

    scores: scope, pos, faithfulness of the questions. Nothing to score is an error.
    """
    scored = evaluate.require_samples(questions).join(scores, ["scope", "pos"], "left")
    means = evaluate.means_by(scored, "scope", "faithfulness").drop("n")
    listed = scored.select("scope", "pos", "section", "question", F.round(evaluate.scored("faithfulness"), 4).alias("faithfulness"))
    return {"by_scope": counters_.join(means, "scope", "left").orderBy("scope"), "per_question": evaluate.worst_first(listed, "faithfulness", "scope", "pos"), "errors": errors.orderBy("scope")}


def quizzes_failed(out: dict[str, DataFrame]) -> bool:
    """The exit code of a quiz evaluation: a scope that failed, or faithfulness under the pass mark. Coverage and quotes do not decide."""
    return not out["errors"].isEmpty() or evaluate.failed(out["by_scope"], "faithfulness")


def result(out: dict[str, DataFrame], **about: object) -> dict:
    """The tables of an evaluation as one object with the time of the run, the pass mark and what else is told about it."""
    tables = {name: [r.asDict(recursive=True) for r in t.collect()] for name, t in out.items()}  # a row a question at most
    return {"run_at": datetime.now(UTC).isoformat(), "threshold": schema.PASS_MARK, **about, **tables}
