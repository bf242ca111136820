"""The knowledge base as one object: load, guard, chunk, embed and commit; search, answer, list, delete, rebuild.

State is a Snapshots folder of tables: documents, chunks, tokens (the lexical index), vectors (the dense one) and meta. Every
change is one commit, so the indexes are always in step with the chunks. Batches of any number of files and questions are
frames; the methods for a single one raise errors instead of giving status rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.functions import text as T
from granth.operators import chat, chunking, dense, fusion, lexical
from granth.operators import knowledge_base as kb
from granth.runtime import materialise, small_side
from granth.sources import loaders

DOCUMENTS = "doc_id long, filename string, sha256 string, language string, num_pages int, num_chunks int, size_bytes long, warnings string, created_at timestamp"
CHUNKS = "id long, doc_id long, chunk_index int, page int, language string, token_count int, text string"
#: Longest question, and most hits that may be asked for, in a chat and in a search (fixed values).
MAX_QUESTION, MAX_CHAT_HITS, MAX_HITS = 4000, 20, 50


class LLMError(RuntimeError):
    """A language model could not be reached or gave no answer."""


class Embedder(Protocol):
    name: str

    def passages(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


class HashEmbedder:
    """The default: tokens counted in hashed slots; passages and queries alike."""

    name = "hash-64"

    def passages(self, text: Column) -> Column:
        return dense.hash_vector(T.tokens(F.coalesce(text, F.lit(""))))

    queries = passages


class PrefixEmbedder:
    """Wraps a model that is a function of text (a pandas UDF that gives array<double>): models whose name has 'e5' in it want their prefixes."""

    def __init__(self, name: str, model: Callable[[Column], Column]):
        self.name, self.model, self.prefixed = name, model, "e5" in name.lower()

    def passages(self, text: Column) -> Column:
        return self.model(F.concat(F.lit("passage: "), text) if self.prefixed else text)

    def queries(self, text: Column) -> Column:
        return self.model(F.concat(F.lit("query: "), text) if self.prefixed else text)


class LLM(Protocol):
    name: str

    def generate(self, system: str, messages: list[dict[str, str]], max_tokens: int) -> str: ...


def check_question(text: str, top_k: int | None, most: int) -> None:
    if not isinstance(text, str) or not 1 <= len(text) <= MAX_QUESTION:
        raise ValueError(f"a question has 1 to {MAX_QUESTION} characters")
    if top_k is not None and not 0 <= top_k <= most:
        raise ValueError(f"top_k is at most {most}; 0 and None stand for the default")


class KnowledgeBase:
    """reranker: Column of scores from (query, text) columns, or None; llm: None answers with passages; count: token counter of a text."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, reranker: Callable[[str, str], Column] | None = fusion.overlap_score, llm: LLM | None = None, count: Callable[[str], int] | None = None, limit: int = 300, overlap: int = 50, top_k: int = 5, candidates: int = 25, max_mb: int = kb.MAX_UPLOAD_MB, history_turns: int = 6, rewrite: bool = True):
        self.spark, self.store = spark, kb.Snapshots(spark, path)
        self.embedder, self.reranker, self.llm, self.count = embedder or HashEmbedder(), reranker, llm, count
        self.limit, self.overlap, self.top_k, self.candidates = limit, overlap, top_k, candidates
        self.max_bytes, self.history_turns, self.rewrite = max_mb << 20, history_turns, rewrite
        if not self.store.manifest():
            empty = lambda schema: spark.createDataFrame([], schema)
            self.store.commit({"documents": empty(DOCUMENTS), "chunks": empty(CHUNKS), "tokens": empty("id long, tokens array<string>"), "vectors": empty("id long, vector array<double>"), "meta": spark.createDataFrame([("embedding_model", self.embedder.name), ("last_doc_id", "0"), ("last_chunk_id", "0")], "key string, value string")})
        elif self.stale():
            self.rebuild()

    # -- state --
    def meta(self, key: str) -> str | None:
        row = self.store.read("meta").where(F.col("key") == key).select("value").first()
        return row.value if row else None

    def stale(self) -> bool:
        """Whether the indexes must be made anew: another model than recorded, or not one vector and token list a chunk."""
        n = self.store.read("chunks").count()
        return self.meta("embedding_model") != self.embedder.name or any(self.store.read(t).count() != n for t in ("vectors", "tokens"))

    def _indexes(self, chunks: DataFrame) -> dict[str, DataFrame]:
        c = chunks.select("id", "text")
        return {"tokens": lexical.index(c), "vectors": c.select("id", self.embedder.passages(F.col("text")).alias("vector"))}

    def rebuild(self) -> None:
        meta = kb.upsert(self.store.read("meta"), self.spark.createDataFrame([("embedding_model", self.embedder.name)], "key string, value string"))
        self.store.commit(self._indexes(self.store.read("chunks")) | {"meta": meta})

    def stats(self) -> dict:
        return {"documents": self.store.read("documents").count(), "chunks": self.store.read("chunks").count(), "embedding_model": self.embedder.name, "reranker": getattr(self.reranker, "__name__", None), "llm": self.llm.name if self.llm else None}

    # -- ingestion --
    def add(self, path: str, pdf=None, ocr=None) -> DataFrame:
        """(path, filename, status, doc_id, error) of every file under path: added, duplicate (doc_id is the one that is there) or error."""
        return self.add_pages(loaders.load(self.spark, path, pdf, ocr))

    def add_pages(self, pages: DataFrame) -> DataFrame:
        """The same for loaded pages (path, sha256, size_bytes, number, text, error); guards come in the order type, size, duplicate, text."""
        pages = materialise(pages.select("path", "sha256", "size_bytes", "number", "text", "error"), "pages")
        per = pages.groupBy("path").agg(F.first("sha256").alias("sha256"), F.max("size_bytes").alias("size_bytes"), F.max("number").alias("num_pages"), F.max("error").alias("error"))
        ext = kb.extension("path")
        known = ext.isNotNull() & ext.isin(*kb.SUPPORTED)
        early = F.when(~known, F.concat(F.lit("Unsupported file type: "), ext)).when(F.col("size_bytes") > self.max_bytes, "file is too large")
        per = per.withColumn("early", early).withColumn("key", kb.file_key())
        old = self.store.read("documents").select(kb.file_key().alias("key"), "doc_id").where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("old_id"))
        first = per.where("early IS NULL AND error IS NULL").groupBy("key").agg(F.min("path").alias("first_path"))
        judged = per.join(old, "key", "left").join(first, "key", "left")
        status = F.when(F.col("early").isNotNull(), "error").when(F.col("old_id").isNotNull(), "duplicate").when(F.col("error").isNotNull(), "error").when(F.col("first_path") != F.col("path"), "duplicate").otherwise("added")
        judged = materialise(judged.select("path", "sha256", "size_bytes", "num_pages", "old_id", "first_path", status.alias("status"), F.coalesce("early", "error").alias("error")), "judged")
        fresh = kb.new_ids(judged.where("status = 'added'").select("path", "sha256", "size_bytes", "num_pages"), int(self.meta("last_doc_id")), ["path"]).withColumnRenamed("id", "doc_id")
        fresh = materialise(fresh, "fresh")
        cut = chunking.chunk(pages.where("error IS NULL").join(fresh.select("path", "doc_id"), "path").select("doc_id", F.col("number").alias("page"), "text"), self.limit, self.overlap, self.count)
        cut = kb.new_ids(cut.withColumn("language", T.detect_language("text")), int(self.meta("last_chunk_id")), ["doc_id", "chunk_index"])
        cut = materialise(cut.select("id", "doc_id", "chunk_index", "page", "language", "token_count", "text"), "chunks")
        counts = cut.groupBy("doc_id").agg(F.count("*").cast("int").alias("num_chunks"))
        documents = fresh.join(chunking.dominant_language(cut), "doc_id").join(counts, "doc_id").select("doc_id", kb.basename("path").alias("filename"), "sha256", "language", "num_pages", "num_chunks", "size_bytes", F.lit("").alias("warnings"), F.current_timestamp().alias("created_at"))
        top = lambda df, c, key: max(int(self.meta(key)), df.agg(F.max(c)).first()[0] or 0)
        marks = [("last_doc_id", str(top(fresh, "doc_id", "last_doc_id"))), ("last_chunk_id", str(top(cut, "id", "last_chunk_id")))]
        if not fresh.isEmpty():
            meta = materialise(kb.upsert(self.store.read("meta"), self.spark.createDataFrame(marks, "key string, value string")), "meta")
            self.store.commit({"documents": documents, "chunks": cut} | self._indexes(cut), append=True, replace={"meta": meta})
        ids = fresh.select("path", "doc_id")
        via = ids.select(F.col("path").alias("first_path"), F.col("doc_id").alias("twin"))
        out = judged.join(ids, "path", "left").join(via, "first_path", "left")
        return out.select("path", kb.basename("path").alias("filename"), "status", F.coalesce("doc_id", "old_id", F.when(F.col("status") == "duplicate", F.col("twin"))).alias("doc_id"), F.when(F.col("status") == "error", F.col("error")).alias("error"))

    def add_document(self, path: str, pdf=None, ocr=None) -> int:
        """Id of one new file; raises UnsupportedFileType, DuplicateDocumentError or DocumentProcessingError."""
        row = self.add(path, pdf, ocr).first()
        if row is None:
            raise kb.DocumentProcessingError(f"no file at {path}")
        if row.status == "duplicate":
            raise kb.DuplicateDocumentError(row.filename, row.doc_id)
        if row.status == "error":
            raise (kb.UnsupportedFileType if (row.error or "").startswith("Unsupported") else kb.DocumentProcessingError)(row.error)
        return row.doc_id

    def delete(self, doc_id: int) -> None:
        """Remove a document with its chunks and their index rows; KeyError if it is unknown."""
        self._known(doc_id)
        gone = self.spark.createDataFrame([(doc_id,)], "doc_id long")
        kept = kb.delete({k: self.store.read(k) for k in ("documents", "chunks")}, gone)
        ids = self.store.read("chunks").where(F.col("doc_id") == doc_id).select("id")
        kept |= {k: self.store.read(k).join(ids, "id", "left_anti") for k in ("tokens", "vectors")}
        self.store.commit({k: v.select(*self.store.read(k).columns) for k, v in kept.items()})

    def _known(self, doc_id: int) -> None:
        if self.store.read("documents").where(F.col("doc_id") == doc_id).isEmpty():
            raise KeyError(doc_id)

    # -- reading --
    def list_documents(self) -> DataFrame:
        return kb.list_documents(self.store.read("documents")).orderBy(*kb.listing_order())

    def document_chunks(self, doc_id: int) -> DataFrame:
        self._known(doc_id)
        return self.store.read("chunks").where(F.col("doc_id") == doc_id).orderBy("chunk_index")

    def search_all(self, questions: DataFrame, top_k: int | None = None, doc_ids: list[int] | None = None) -> DataFrame:
        """Hits of (query_id, query), best first by pos. An empty list of doc_ids is no filter; unknown ids match nothing."""
        k = top_k or self.top_k
        n = max(self.candidates, k)
        chunks = self.store.read("chunks")
        scope = None
        if doc_ids:
            wanted = small_side(materialise(self.spark.createDataFrame([(i,) for i in set(doc_ids)], "doc_id long"), "scope"), 16)
            scope = chunks.join(wanted, "doc_id", "left_semi").select("id")
        asked = questions.select("query_id", self.embedder.queries(F.col("query")).alias("vector"))
        near = dense.search(self.store.read("vectors"), asked, n, scope)
        words = lexical.bm25(self.store.read("tokens"), questions, n, scope)
        hits = fusion.hydrate(fusion.rrf(near, words, n), chunks, self.store.read("documents"))
        if self.reranker is None:
            return hits.withColumn("rerank_score", F.lit(None).cast("double")).where(F.col("pos") <= k)
        scored = hits.join(questions.select("query_id", "query"), "query_id").withColumn("rerank_score", self.reranker("query", "text"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "pos")).cast("long")
        return scored.withColumn("pos", place).where(F.col("pos") <= k).select(*hits.columns, "rerank_score")

    def search(self, query: str, top_k: int | None = None, doc_ids: list[int] | None = None) -> list[dict]:
        check_question(query, top_k, MAX_HITS)
        q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return [r.asDict() for r in self.search_all(q, top_k, doc_ids).orderBy("pos").collect()]  # at most MAX_HITS

    def answer(self, question: str, history: list[dict[str, str]] | None = None, top_k: int | None = None, doc_ids: list[int] | None = None, max_tokens: int = 1024) -> dict:
        """Answer, language, query searched for and sources. The search uses the question as rewritten from the history, the prompt the
        original one. Without a model, or any document, the answer is made of passages or says so."""
        check_question(question, top_k, MAX_CHAT_HITS)
        one = lambda text: self.spark.createDataFrame([(0, text)], "query_id long, query string")
        asked = one(question).withColumn("language", T.detect_language("query"))
        language = asked.first().language
        past = self.spark.createDataFrame([(0, k, m.get("role"), m.get("content")) for k, m in enumerate(history or [])], "conv_id long, turn long, role string, content string")
        turns = materialise(chat.clean_history(past, self.history_turns), "history")
        messages = [{"role": r.role, "content": r.content} for r in turns.orderBy("turn_no").collect()]  # the last few turns
        query = question
        if messages and self.llm and self.rewrite:
            prompt = chat.rewrite_prompt(turns, self.spark.createDataFrame([(0, question)], "conv_id long, question string")).first().prompt
            try:
                raw = self.llm.generate("Rewrite the latest message as one question that stands alone.", [{"role": "user", "content": prompt}], 200)
                query = self.spark.createDataFrame([(raw, question)], "a string, q string").select(chat.rewritten("a", F.col("q")).alias("x")).first().x
            except LLMError:
                pass
        hits = materialise(self.search_all(one(query), top_k, doc_ids), "hits")
        sources = [r.asDict() for r in hits.orderBy("pos").collect()]
        if self.store.read("documents").isEmpty():
            text = "नॉलेज बेस empty है; पहले दस्तावेज़ जोड़ें।" if language == "hi" else "The knowledge base is empty; add documents first."
        elif self.llm is None:
            text = chat.no_llm_answer(asked, hits).first().answer
        else:
            p = chat.answer_prompt(asked, hits).first()
            text = self.llm.generate(p.system, [*messages, {"role": "user", "content": p.prompt}], max_tokens)
        return {"answer": text, "language": language, "search_query": query, "sources": sources, "llm": self.llm.name if self.llm else None}
