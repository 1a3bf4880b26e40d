"""The engine's operations as one facade; every result is a DataFrame, every question one of many."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.functions.text import lead_sentences
from tessera.operators import answering as A
from tessera.operators import evaluation, history, ranking, reporting, search
from tessera.operators.chunking import chunk_documents
from tessera.operators.cleaning import clean_pages, full_text, pages_of
from tessera.operators.store import Store, index_summary
from tessera.operators.structure import parse_structure
from tessera.runtime import spool


@dataclass(frozen=True)
class Models:
    """What a deployment may plug in. A writer maps (question_id, prompt) and the contexts to (question_id, answer); a deck
    writer maps answers and citations to (question_id, deck). `alive` says whether what answers is there."""

    embed: Callable[[Column, int], Column] | None = search.hashed_embedding
    score: Callable[[Column, Column], Column] = ranking.overlap_logit
    summarize: Callable[[Column], Column] | None = lead_sentences
    write: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    deck: Callable[[DataFrame, DataFrame, bool], DataFrame] | None = None  # the flag asks for strict JSON, on a second try
    alive: Callable[[], bool] = lambda: True


#: The models that may be chosen by name.
WRITERS: dict[str, Models] = {"extractive": Models()}


def named(model: str) -> Models:
    """The models of a name; one that is not known is an error."""
    if model not in WRITERS:
        raise ValueError(f"unknown model: {model}")
    return WRITERS[model]


def models(spark: SparkSession, default: str = "extractive") -> DataFrame:
    """(id, label, is_default, thinking) for listings."""
    rows = [(n, n, n == default, False) for n in sorted(WRITERS)]
    return spark.createDataFrame(rows, "id string, label string, is_default boolean, thinking boolean")


STAGES = ("receive", "parse", "summarize", "chunk", "embed", "index")
#: The tables that have rows of a document.
TABLES = ("chunks", "weights", "vectors", "nodes", "pages", "meta", "manifest", "ingests")
_EVENTS = "doc_id string, stage string, status string, done long, total long"


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    root: str
    config: Config = DEFAULT
    model: Models | str = "extractive"

    @property
    def models(self) -> Models:
        return named(self.model) if isinstance(self.model, str) else self.model

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root, changes=8)

    def parse(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The clean pages and the nodes of documents with doc_id and page_texts."""
        pages = clean_pages(pages_of(documents))
        return pages, parse_structure(pages, self.config)

    def index(self, meta: DataFrame, nodes: DataFrame, pages: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
        """Builds the index anew, or replaces the documents in `only` (doc_id) and no others; a document that yields no
        chunk any more has none in the index. Gives the summary of the whole index."""
        if only is not None:
            meta = meta.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
        chunks = spool(chunk_documents(meta, nodes, pages, self.config), "chunks")
        self._put(chunks, only)
        return index_summary(self.store.read("chunks"))

    def _put(self, chunks: DataFrame, ids: DataFrame | None) -> None:
        """Writes chunks and what search needs of them: for the documents in `ids`, or as the whole index. Weights and
        vectors depend on a chunk's own text alone, so those of other documents stay as they are."""
        weights = search.text_weights(chunks, "chunk_id", "text", "doc_id")
        parts = [("chunks", chunks), ("weights", weights)]
        if self.models.embed is not None:
            parts.append(("vectors", chunks.select("chunk_id", "doc_id", self.models.embed(F.col("text"), self.config.dense_dim).alias("dense"))))
        for name, rows in parts:
            if ids is None:
                self.store.replace(name, rows, sort_by="term" if name == "weights" else "doc_id")
            else:
                self.store.replace_documents(name, rows, ids)

    def emit(self, rows: DataFrame, stage: str, status: str, done: Column | None = None, total: Column | None = None) -> None:
        """Adds an event for each document in rows to the table of events."""
        no = F.lit(None).cast("long")
        event = rows.select("doc_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), (no if done is None else done.cast("long")).alias("done"), (no if total is None else total.cast("long")).alias("total"))
        self.store.append("events", event.withColumn("ts", F.current_timestamp()))

    def add(self, meta: DataFrame, documents: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
        """Parses, sums up and indexes documents (doc_id, page_texts, perhaps parser and warnings) that replace those of the
        same ids; gives the summary of the whole index.

        Events tell how far it is, `ingests` has a row for each document. A document that yields no chunk is an error:
        its meta data is taken, its chunks in the index stay as they are; if none yields any, ValueError is raised.
        """
        ids = spool(meta.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), "ids")
        self.emit(ids, "receive", "done")
        documents = documents.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        for name, kind in (("parser", "string"), ("warnings", "array<string>")):
            if name not in documents.columns:
                documents = documents.withColumn(name, F.lit(None).cast(kind))
        pages, nodes = (spool(x, "parsed") for x in self.parse(documents))
        n_nodes = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"))
        facts = documents.select("doc_id", F.greatest(F.size("page_texts"), F.lit(0)).alias("pages"), "parser", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
        facts = spool(ids.join(facts, "doc_id", "left").join(n_nodes, "doc_id", "left").fillna(0, ["pages", "nodes"]), "facts")
        self.emit(facts, "parse", "done", F.col("pages"), F.col("pages"))
        summary = F.lit(None).cast("string") if self.models.summarize is None else self.models.summarize(F.col("full_text"))
        texts = full_text(pages).select("doc_id", summary.alias("summary"))
        meta = meta.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).drop("n_pages", "summary")
        meta = meta.join(facts.select("doc_id", F.col("pages").alias("n_pages")), "doc_id", "left").join(texts, "doc_id", "left")
        meta = spool(meta, "meta")
        self.emit(ids, "summarize", "done")
        rows = meta if manifest is None else manifest.join(ids, "doc_id", "left_semi")
        for name, new in (("meta", meta), ("manifest", rows), ("nodes", nodes), ("pages", pages)):
            self.store.replace_documents(name, new, ids)
        chunks = spool(chunk_documents(meta, nodes, pages, self.config), "chunks")
        counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
        facts = spool(facts.join(counts, "doc_id", "left").fillna(0, ["chunks"]), "facts")
        sound, empty = facts.filter("chunks > 0"), facts.filter("chunks = 0")
        self.emit(sound, "chunk", "done", F.col("chunks"), F.col("chunks"))
        self.emit(empty, "chunk", "error", F.lit(0), F.lit(0))
        done = facts.join(meta.select("doc_id", "title"), "doc_id").withColumns({
            "scanned": F.contains(F.coalesce("parser", F.lit("")), F.lit("ocr")), "error": F.when(F.col("chunks") == 0, "no chunks"),
        })
        self.store.replace_documents("ingests", done, ids)
        if sound.isEmpty():
            raise ValueError("no document yields a chunk")
        self._put(chunks, sound)
        self.emit(sound, "embed", "done", F.col("chunks"), F.col("chunks"))
        self.emit(sound, "index", "done", F.col("chunks"), F.col("chunks"))
        return index_summary(self.store.read("chunks"))

    def remove(self, doc_ids: list[str] | DataFrame) -> DataFrame:
        """Takes documents out of every table; gives the summary of what is left."""
        for name in TABLES:
            if self.store.exists(name):
                self.store.remove_documents(name, doc_ids)
        return index_summary(self.store.read("chunks"))

    def progress(self) -> DataFrame:
        return history.progress(self.store.read("events"))

    def search(self, questions: DataFrame, limit: int | None = None, doc_ids: list[str] | None = None, doc_types: list[str] | None = None) -> DataFrame:
        """(question_id, chunk_id, score, rank); facets are applied before any list is cut."""
        allowed = search.facets(self.store.read("chunks"), doc_ids, doc_types).select("chunk_id") if doc_ids or doc_types else None
        weights, vectors = self.store.read("weights"), None
        if self.models.embed is not None:
            vectors = self.store.read("vectors")
            questions = questions.withColumn("dense", self.models.embed(F.col("question"), self.config.dense_dim))
        if allowed is not None:
            weights = weights.join(allowed, "chunk_id", "left_semi")
            vectors = vectors.join(allowed, "chunk_id", "left_semi") if vectors is not None else None
        return search.hybrid_search(questions, weights, vectors, limit, self.config, self.store.read("chunks").count())

    def retrieve(self, questions: DataFrame, hits: DataFrame | None = None) -> DataFrame:
        """The contexts of each question: question_id, position, score, fused_score and the chunk's columns."""
        chunks = self.store.read("chunks")
        ranked = ranking.rerank(self.search(questions) if hits is None else hits, questions, chunks, self.models.score)
        best = ranking.select_contexts(ranked, self.config).select("question_id", "chunk_id", "position", "fused_score", F.col("score").alias("rerank_score"))
        return best.join(chunks, "chunk_id")  # the long texts come in for the few that are left

    def ask(self, questions: DataFrame, trace: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(question_id, question, route, answer, grounded) and the citations.

        A question about the corpus itself is answered by the number of documents; the lines are in corpus(). An answer
        of fewer than three characters is asked for once more, then it is a refusal. `trace` takes the milliseconds of
        search, ranking and writing.
        """
        trace, began = {} if trace is None else trace, time.time()

        def lap(name: str) -> None:
            nonlocal began
            trace[name], began = round(1000 * (time.time() - began)), time.time()

        routed = spool(questions.withColumn("route", A.route(F.col("question"))), "questions")
        plain = routed.filter(F.col("route") == "retrieve")
        hits = spool(self.search(plain), "hits")
        lap("t_search_ms")
        contexts = spool(self.retrieve(plain, hits), "contexts")
        lap("t_rerank_ms")
        if self.models.write is None:
            written = A.extractive_answers(contexts)
        else:
            asked = spool(A.prompts(plain, contexts, self.config), "prompts")
            written = spool(self.models.write(asked, contexts), "written")
            short = F.length(F.trim(F.coalesce("answer", F.lit("")))) < 3
            again = asked.join(written.filter(~short).select("question_id"), "question_id", "left_anti")
            if not again.isEmpty():
                retried = self.models.write(again, contexts.join(again.select("question_id"), "question_id", "left_semi"))
                written = written.filter(~short).unionByName(retried)
        answer = F.when(F.length(F.trim(F.coalesce("answer", F.lit("")))) < 3, F.lit(self.config.refusal)).otherwise(F.trim("answer"))
        rows = plain.select("question_id").join(written, "question_id", "left").withColumn("answer", answer)
        rows = spool(rows.withColumn("grounded", A.grounded(F.col("answer"), self.config.refusal)), "answers")
        lap("t_generate_ms")
        rows = routed.join(rows, "question_id", "left")
        if self.store.exists("meta"):
            meta = self.store.read("meta")
            many = F.lit(f"{meta.count()} документов")
            told = meta.filter(F.nullif("summary", F.lit("")).isNotNull()).limit(1).count() > 0
            own = F.col("route").isin("about", "meta")
            rows = rows.withColumns({"answer": F.when(own, many).otherwise(F.col("answer")), "grounded": F.when(own, (F.col("route") == "meta") | F.lit(told)).otherwise(F.col("grounded"))})
        rows = rows.withColumns({"answer": F.coalesce("answer", F.lit(self.config.refusal)), "grounded": F.coalesce("grounded", F.lit(False))})
        cited = A.citations(rows.filter(F.col("grounded") & (F.col("route") == "retrieve")).select("question_id", "answer"), contexts)
        return rows, cited

    def corpus(self) -> DataFrame:
        """(route, title, doc_id, line): what questions about the corpus are answered with, document by document."""
        meta = self.store.read("meta")
        parsers = self.store.read("ingests").select("doc_id", "parser") if self.store.exists("ingests") else None
        return A.corpus_lines(A.corpus_listing(meta, parsers), A.corpus_summaries(meta))

    def ask_stream(self, questions: DataFrame) -> DataFrame:
        """(question_id, seq, type, payload) in the order in which an answer is delivered."""
        rows, cited = self.ask(questions)
        return A.answer_events(rows.select("question_id", "answer"), cited)

    def evaluate(self, golden: DataFrame) -> DataFrame:
        rows, cited = self.ask(golden.select("question_id", F.col("q").alias("question")))
        return evaluation.summarize(evaluation.judge(golden, rows, cited))

    def report(self, questions: DataFrame, title: str, extracts: bool = False) -> DataFrame:
        rows, cited = self.ask(questions)
        blocks = reporting.report_blocks(rows, cited, title, extracts=extracts)
        return self._keep("report", title, rows, cited, blocks)

    def deck(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The content slides and the source slides of each question's answer. What the deck writer gives is tried twice,
        then the slides are made of the answer's paragraphs."""
        rows, cited = self.ask(questions)
        if self.models.deck is None:
            decks = self.spark.createDataFrame([], f"question_id {rows.schema['question_id'].dataType.simpleString()}, deck string")
        else:
            decks = spool(self.models.deck(rows, cited, False), "decks")
            sound = reporting.valid_slides(reporting.deck_slides(decks)).select("question_id").distinct()
            again = rows.join(sound, "question_id", "left_anti")
            if not again.isEmpty():
                decks = decks.join(sound, "question_id", "left_semi").unionByName(self.models.deck(again, cited, True))
        slides = self._keep("deck", None, rows, cited, reporting.whole_deck(decks, rows))
        return slides, reporting.source_slides(cited)

    def _keep(self, kind: str, doc_type: str | None, rows: DataFrame, cited: DataFrame, made: DataFrame) -> DataFrame:
        """Stores what was generated and enters it in the history: a record for each question, all with the same path."""
        run = uuid.uuid4().hex
        path = f"{self.root}/generated/{run}"
        made.write.parquet(path)
        n = cited.groupBy("question_id").agg(F.count("*").cast("int").alias("n_citations"))
        name = self.model if isinstance(self.model, str) else "custom"
        record = rows.join(n, "question_id", "left").select(
            F.concat(F.lit(f"{run}-"), F.col("question_id").cast("string")).alias("id"), F.lit(kind).alias("kind"), F.lit(doc_type).cast("string").alias("doc_type"),
            "question", F.lit(None).cast("string").alias("subject"), F.lit(name).alias("model"), F.lit(run).alias("filename"), F.lit(path).alias("path"),
            "grounded", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.current_timestamp().alias("created_at"),
        )
        self.store.append("history", record.withColumn("doc_id", F.col("id")))
        return self.spark.read.parquet(path)

    def preview(self, kind: str, questions: DataFrame, title: str = "") -> tuple[DataFrame, DataFrame]:
        """Generates once and gives the records and what was made: its parts need not be made again to be fetched."""
        before = self.history().select("id") if self.store.exists("history") else None
        made = self.report(questions, title) if kind == "report" else self.deck(questions)[0]
        records = self.history()
        return (records if before is None else records.join(before, "id", "left_anti")), made

    def history(self) -> DataFrame:
        """The latest first; empty where nothing was generated yet."""
        return history.listed(self.store.read("history", history.RECORD).drop("doc_id"))

    def generated(self, record_id: str) -> DataFrame:
        """What a record stands for. LookupError: there is no such record (404); FileNotFoundError: its file is gone (410)."""
        row = history.found(self.history(), record_id).first()
        if row is None:
            raise LookupError(record_id)
        fs, path = self.store._fs(row.path)
        if not fs.exists(path):
            raise FileNotFoundError(row.path)
        return self.spark.read.parquet(row.path)

    def forget(self, record_id: str) -> bool:
        """Deletes a record, and its file once no other record shares it; False if there is none."""
        row = history.found(self.history(), record_id).first()
        if row is None:
            return False
        self.store.remove_documents("history", [record_id])
        if self.history().filter(F.col("path") == row.path).isEmpty():
            fs, path = self.store._fs(row.path)
            fs.delete(path, True)
        return True

    def documents(self) -> DataFrame:
        """(doc_id, title, doc_type, n_pages, effective_date, summary, source_url, parser, scanned) in the order of titles."""
        meta = self.store.read("meta")
        if self.store.exists("ingests"):
            meta = meta.join(self.store.read("ingests").select("doc_id", "parser", "scanned"), "doc_id", "left")
        wanted = ("doc_id", "title", "doc_type", "n_pages", "effective_date", "summary", "source_url", "parser", "scanned")
        return meta.select(*[c for c in wanted if c in meta.columns]).orderBy("title", "doc_id")

    def status(self) -> dict:
        return self.store.info("chunks") | {"documents": self.store.read("meta").count() if self.store.exists("meta") else 0}

    def health(self) -> dict:
        """Never raises: 'ok' if there is an index and a model to answer with, else 'degraded'."""
        try:
            found = self.store.exists("chunks")
        except Exception:  # noqa: BLE001 - a store that cannot be reached is what health is asked about
            found = False
        try:
            alive = bool(self.models.alive())
        except Exception:  # noqa: BLE001
            alive = False
        return {"status": "ok" if found and alive else "degraded", "index": found, "model": alive}
