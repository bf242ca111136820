"""Queries of the knowledge base over whole tables, each with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granth.functions import text as T
from granth.functions.labels import SPELLINGS, label
from granth.operators import chat, chunking, dense, evaluation, fusion, lexical
from granth.operators import knowledge_base as kb
from granth.runtime import materialise, table
from granth.sources.loaders import decode_text as decode_bytes
from granth.sources.loaders import layout_rejoin as rejoin_layout

K, CANDIDATES, TOP_K = 10, 25, 5
LIMIT, OVERLAP = 40, 5
#: Chunk indexes that are numbered together.
RANGE = 4096

# -- Spark ---------------------------------------------------------------------------------------------------------------


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: questions whose id is divisible by 20, once each."""
    q = table(s, d, "qa_test").where("qa_id % 20 = 0 AND query IS NOT NULL")
    return q.groupBy(F.col("qa_id").alias("query_id")).agg(F.min(F.struct("query", "lang", "chunk_id")).alias("q")).select("query_id", "q.query", "q.lang", "q.chunk_id")


def _scope(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).join(_docs(s, d).where("source LIKE 'krishi-%'").select("doc_id"), "doc_id", "left_semi").select("id")


def normalize_text(s, d):
    n = _docs(s, d).select("doc_id", T.normalize("text").alias("t"))
    return n.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


def detect_language(s, d):
    return _chunks(s, d).select("id", T.detect_language("text").alias("detected"))


def tokenize(s, d):
    t = _chunks(s, d).select("id", T.tokens("text").alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def split_sentences(s, d):
    p = _docs(s, d).select("doc_id", T.sentences(T.normalize("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


def devanagari_repair(s, d):
    return _chunks(s, d).select("id", F.md5(T.repair_devanagari("text")).alias("digest"))


def garbled_flags(s, d):
    return _chunks(s, d).select("id", T.looks_garbled("text").cast("int").alias("garbled"))


def legacy_font_flags(s, d):
    return _chunks(s, d).select("id", T.looks_legacy_font("text").cast("int").alias("legacy"))


def page_quality(s, d):
    """Pages (chunks) of each document that are empty or broken, and the warnings they give."""
    empty = ~F.coalesce("text", F.lit("")).rlike(rf"(?s)[^{T.HBLANK}\n].{{18,}}[^{T.HBLANK}\n]")  # fewer than 20 characters without the blanks around
    broken = ~empty & (T.looks_garbled("text") | T.looks_legacy_font("text"))
    g = _chunks(s, d).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(empty).alias("empty"), F.count_if(broken).alias("broken"))
    w = F.concat_ws("; ", F.when(F.col("empty") > 0, F.concat(F.col("empty").cast("string"), F.lit(" page(s) without text"))), F.when(F.col("broken") > 0, F.concat(F.col("broken").cast("string"), F.lit(" page(s) with a broken text layer"))))
    return g.select("doc_id", "pages", "empty", "broken", w.alias("warnings"))


def _chunked(s, d):
    return chunking.chunk(_docs(s, d).select("doc_id", F.lit(1).alias("page"), "text"), LIMIT, OVERLAP)


def chunk_documents(s, d):
    return _chunked(s, d).select("doc_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


def dominant_language(s, d):
    c = _chunks(s, d).select("doc_id", T.detect_language("text").alias("language"), T.n_words("text").cast("long").alias("token_count"))
    return chunking.dominant_language(c)


def term_freq(s, d):
    return lexical.postings(lexical.index(_chunks(s, d)))


def doc_freq(s, d):
    return lexical.postings(lexical.index(_chunks(s, d))).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(s, d):
    return lexical.corpus_stats(lexical.index(_chunks(s, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


def _index(s, d):
    return lexical.stored_index(_chunks(s, d))


def _bm25(s, d, k, scoped=False, index=None):
    return lexical.bm25(index or _index(s, d), _queries(s, d), k, _scope(s, d) if scoped else None)


def bm25_topk(s, d):
    return _bm25(s, d, K).select("query_id", "id", "score", "rank")


def bm25_scoped(s, d):
    return _bm25(s, d, K, True).select("query_id", "id", "score", "rank")


def dense_topk(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return dense.search(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), K).select("query_id", "id", "score", "rank")


def dense_scoped(s, d):
    e = table(s, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return dense.search(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), K, e.where("label = 1").select(F.col("vec_id").alias("id"))).select("query_id", "id", "score", "rank")


def _hash_dense(s, d, k, scoped=False, index=None):
    q = dense.embed(_queries(s, d), "query").select("query_id", "vector")
    v = (index or _index(s, d)).select("id", dense.hash_vector("tokens").alias("vector"))
    return dense.search(v, q, k, _scope(s, d) if scoped else None)


def _fused(s, d, scoped=False, n=CANDIDATES):
    index = _index(s, d)  # both sides read the tokens that were cut once
    return fusion.rrf(_hash_dense(s, d, n, scoped, index), _bm25(s, d, n, scoped, index), n)


def rrf_fusion(s, d):
    return _fused(s, d).select("query_id", "id", "dense_rank", "bm25_rank", "rrf_score", "pos")


def _hits(s, d, scoped=False, n=CANDIDATES, first=CANDIDATES):
    return fusion.hydrate(_fused(s, d, scoped, n).where(F.col("pos") <= first), _chunks(s, d), _docs(s, d))


def hybrid_search(s, d):
    return _hits(s, d, first=TOP_K).drop("text")


def search_scoped(s, d):
    return _hits(s, d, True, first=TOP_K).drop("text")


def rerank_search(s, d):
    return fusion.rerank(_hits(s, d), _queries(s, d), TOP_K).select("query_id", "chunk_id", "rerank_score", "pos", "final")


def dedup_exact(s, d):
    return kb.canonical(_docs(s, d))


def ingest_added(s, d):
    old = F.col("created_at") < F.lit("2025-09-01").cast("timestamp")
    return kb.ingest(_docs(s, d).where(old), _docs(s, d).where(~old))


def upload_status(s, d):
    return kb.check_uploads(table(s, d, "uploads"))


def delete_roundtrip(s, d):
    """Rows of documents and chunks before and after the deletion of a source."""
    t = {"documents": _docs(s, d).select("doc_id"), "chunks": _chunks(s, d).select("doc_id")}
    after = kb.delete(t, _docs(s, d).where("source = 'old-archive'"))
    count = lambda df, name, col: df.agg(F.count("*").alias(col)).select(F.lit(name).alias("tbl"), col)
    parts = [count(t[k], k, "n_before").join(count(after[k], k, "n_after"), "tbl") for k in t]
    return parts[0].unionByName(parts[1])


def meta_upsert(s, d):
    new = s.createDataFrame([("embedding_model", "hash-64"), ("schema_version", "4"), ("new_key", None)], "key string, value string")
    return kb.upsert(table(s, d, "meta"), new)


def index_staleness(s, d):
    """Whether the vectors must be rebuilt: another model than recorded, or not one vector a chunk."""
    v, c = table(s, d, "embeddings").agg(F.count("*").alias("vectors")), _chunks(s, d).agg(F.count("*").alias("chunks"))
    m = table(s, d, "meta").where("key = 'embedding_model'").agg(F.max("value").alias("model"))
    one = v.crossJoin(c).crossJoin(m)  # one row each
    return one.select("vectors", "chunks", "model", (~F.col("model").eqNullSafe("pocket-embed-v2") | (F.col("vectors") != F.col("chunks"))).cast("int").alias("stale"))


def list_documents(s, d):
    return kb.list_documents(_docs(s, d)).orderBy(*kb.listing_order()).select("doc_id", "filename", "language", "num_pages", "num_chunks", "size_bytes", F.size("warnings").cast("long").alias("n_warnings"), F.array_join("warnings", "|").alias("warnings"))


def chunks_for_document(s, d):
    """Chunks with their position in their document. Large documents are numbered by ranges of chunk_index: counts of the
    ranges before, then the place within the range, so no task sorts a document."""
    from pyspark.sql import Window as W

    c = _chunks(s, d).where("doc_id IS NOT NULL").select("doc_id", "id", "page", "token_count", "chunk_index", F.floor(F.col("chunk_index") / RANGE).alias("part"))
    per = c.groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    before = per.select("doc_id", "part", (F.sum("n").over(W.partitionBy("doc_id").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("doc_id", "part").orderBy("chunk_index", "id"))
    j = c.withColumn("k", inside).join(before.withColumnRenamed("doc_id", "_d").withColumnRenamed("part", "_p"), (F.col("doc_id") == F.col("_d")) & F.col("part").eqNullSafe(F.col("_p")))
    return j.select("doc_id", (F.col("before") + F.col("k")).cast("long").alias("position"), "id", "page", "token_count")


def kb_scan(s, d):
    c = _chunks(s, d).join(_docs(s, d).select("doc_id", "filename"), "doc_id")
    return c.select("id", "doc_id", "page", "language", "token_count", "filename", F.md5("text").alias("digest"))


def kb_stats(s, d):
    a, b = _docs(s, d).agg(F.count("*").alias("documents")), _chunks(s, d).agg(F.count("*").alias("chunks"))
    m = table(s, d, "meta").where("key = 'embedding_model'").agg(F.max("value").alias("embedding_model"))
    return a.crossJoin(b).crossJoin(m)  # one row each


def decode_text(s, d):
    """Decoding cascade on literal bytes: UTF-8 with its mark, UTF-16, odd-length Windows-1252."""
    df = s.createDataFrame([(i, bytes.fromhex(h)) for i, h, _ in RAW_BYTES], "id long, content binary")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=pdf["content"].map(decode_bytes))[["id", "text"]]

    return df.mapInPandas(run, "id long, text string")


def layout_rejoin(s, d):
    return rejoin_layout(s.createDataFrame(SPANS, "doc long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double"))


def load_dispatch(s, d):
    e = kb.extension("filename")
    return _docs(s, d).select("doc_id", kb.basename("filename").alias("basename"), e.alias("extension"), e.isin(*kb.SUPPORTED).cast("int").alias("supported"))


MESSAGES = [
    (1, 1, "assistant", "Welcome"), (1, 2, "user", "Hello"), (1, 3, "user", "  Who pays? "), (1, 4, "assistant", "The office."), (1, 5, "user", "When"),
    (2, 1, "user", "एक"), (2, 2, "assistant", " "), (2, 3, "system", "x"), (2, 4, "assistant", "दो"), (2, 5, "assistant", "तीन"),
    (3, 1, "assistant", "only"), (4, 1, "user", "a"), (4, 2, "assistant", "b"), (4, 3, "user", None), (4, 4, "user", "c"), (4, 5, "assistant", "d"),
]
ANSWERS = [(1, "Fee is 50 [1]. See [3][1]."), (2, "none"), (3, "[12] and [2]"), (4, None)]
RAW_BYTES = [(1, "efbbbfe0a4b9e0a4bee0a481", "हाँ"), (2, "636166e973", "cafés"), (3, "fffe410042093c09", "AूI".replace("ूI", "\u0942\u093c")), (4, "706c61696e", "plain")]
SPANS = [
    (1, 1, 1, "उपस्थि", 0.0, 90.0, 30.0, 100.0, 10.0), (1, 1, 2, "ति", 35.0, 90.0, 45.0, 100.0, 10.0), (1, 1, 3, "Name", 0.0, 102.0, 30.0, 112.0, 10.0), (1, 1, 4, "Fee", 40.0, 102.0, 60.0, 112.0, 10.0),
    (1, 1, 5, "  ", 0.0, 110.0, 5.0, 118.0, 10.0), (1, 2, 1, "one", 0.0, 0.0, 20.0, 10.0, 10.0), (1, 2, 2, "two", 0.0, 40.0, 20.0, 50.0, 10.0),
]
RAW_QA = [(1, 'Sure: {"questions": [{"lang": "hi", "question": "शुल्क कितना है भाई?"}, {"lang": "fr", "question": "long enough text"}, {"lang": "en", "question": "short"}]} ok'), (2, "no json"), (3, '{"questions": [{"lang": "en", "question": "  What is the fee here?  "}]}'), (4, "{broken"), (5, None)]


def _messages(s):
    return s.createDataFrame(MESSAGES, "conv_id long, turn long, role string, content string")


def clean_history(s, d):
    return chat.clean_history(_messages(s), 2)


def rewrite_prompt(s, d):
    q = s.createDataFrame([(1, "और कब?"), (2, "why"), (4, "e")], "conv_id long, question string")
    return chat.rewrite_prompt(chat.clean_history(_messages(s), 6), q)


def citations(s, d):
    a = s.createDataFrame(ANSWERS, "id long, answer string")
    return a.select("id", F.array_join(chat.citations("answer"), ",").alias("cited"))


def format_passages(s, d):
    p = chat.passages(_hits(s, d, first=TOP_K))
    return p.select("query_id", F.md5("passages").alias("digest"))


def _asked(s, d):
    q = _queries(s, d)
    return q.select("query_id", "query", T.detect_language("query").alias("language"))


def answer_prompt(s, d):
    p = chat.answer_prompt(_asked(s, d), _hits(s, d, first=TOP_K))
    return p.select("query_id", F.md5("system").alias("system"), F.md5("prompt").alias("prompt"))


def no_llm_answer(s, d):
    p = chat.no_llm_answer(_asked(s, d), _hits(s, d, first=TOP_K))
    return p.select("query_id", F.md5("answer").alias("answer"))


def _evaluated(s, d):
    q = _queries(s, d)
    live = q.join(_chunks(s, d).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    index = _index(s, d)
    dn, bm = materialise(_hash_dense(s, d, CANDIDATES, index=index), "dense"), materialise(_bm25(s, d, CANDIDATES, index=index), "bm25")
    hits = fusion.hydrate(fusion.rrf(dn, bm, CANDIDATES), _chunks(s, d), _docs(s, d))
    rr = materialise(fusion.rerank(hits, q, 2**31 - 1).select("query_id", "chunk_id", "pos", "final"), "reranked")  # all hits, without their texts
    part = lambda df, name, i, r: df.select(F.lit(name).alias("system"), "query_id", F.col(i).alias("id"), F.col(r).alias("rank"))
    ranks = part(bm, "BM25", "id", "rank").unionByName(part(dn, "Dense", "id", "rank")).unionByName(part(rr, "Hybrid", "chunk_id", "pos")).unionByName(part(rr.where(F.col("final") <= CANDIDATES), "Hybrid + rerank", "chunk_id", "final"))
    return evaluation.metrics(materialise(ranks, "ranks"), live.select("query_id", F.coalesce(label("lang"), F.lit("und")).alias("lang"), F.col("chunk_id").alias("target")))


def eval_metrics(s, d):
    m = _evaluated(s, d)
    return m.select("system", "query_id", "lang", "rank", "r1", "r5", "r10", F.round("mrr10", 6).alias("mrr10"), F.round("ndcg10", 6).alias("ndcg10"))


def eval_overall(s, d):
    return evaluation.summary(_evaluated(s, d), False)


def eval_by_lang(s, d):
    return evaluation.summary(_evaluated(s, d), True)


def ablation_markdown(s, d):
    return evaluation.markdown(evaluation.summary(_evaluated(s, d), False))


def qa_sample(s, d):
    """The first 300 chunks of at least 40 stored tokens, in hash order (a sampling operator: the limit is the feature)."""
    c = _chunks(s, d).where("token_count >= 40").select("id", "doc_id", "token_count", evaluation.shuffle_key(13, "id").alias("h"))
    return c.orderBy("h", "id").limit(300).select("id", "doc_id", "token_count")


def qa_parse(s, d):
    r = s.createDataFrame(RAW_QA, "id long, raw string").select("id", F.explode(evaluation.parse_questions("raw")).alias("q"))
    return r.select("id", "q.lang", "q.question")


def qa_split(s, d):
    qa = table(s, d, "qa_train").select("qa_id", "chunk_id").dropDuplicates().where("chunk_id IS NOT NULL")
    test = evaluation.take_fraction(qa.select(F.col("chunk_id").alias("id")), 0.3, 13).select(F.col("id").alias("chunk_id"), F.lit("test").alias("t"))
    return qa.join(test, "chunk_id", "left").select("qa_id", "chunk_id", F.coalesce("t", F.lit("train")).alias("split"))


def qa_valid(s, d):
    q = table(s, d, "qa_test").dropDuplicates().join(_chunks(s, d).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return q.select("qa_id", "chunk_id", "lang")


def _mined(s, d):
    q = _queries(s, d)
    items = materialise(dense.embed(_chunks(s, d).select("id", "text")).select("id", "vector"), "vectors")
    asked = dense.embed(q, "query").select("query_id", "vector", "chunk_id")
    dot = F.aggregate(F.zip_with("vector", "pv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pos = asked.join(items.select(F.col("id").alias("chunk_id"), F.col("vector").alias("pv")), "chunk_id").select("query_id", F.col("chunk_id").alias("positive"), F.round(dot, 6).alias("pos_score"))
    return evaluation.hard_negatives(dense.search(items, asked.select("query_id", "vector"), 41), pos)


def hard_negatives(s, d):
    return _mined(s, d)


def triplets(s, d):
    h = _mined(s, d)
    c = _chunks(s, d).select("id", "text")
    j = h.join(c.select(F.col("id").alias("positive"), F.col("text").alias("p")), "positive").join(c.select(F.col("id").alias("negative"), F.col("text").alias("n")), "negative").join(_queries(s, d).select("query_id", "query"), "query_id")
    pre = lambda k, c: F.md5(F.concat(F.lit(k), F.coalesce(c, F.lit(""))))
    return j.select("query_id", pre("query: ", "query").alias("anchor"), pre("passage: ", "p").alias("positive"), pre("passage: ", "n").alias("negative"))


def _study(s, d):
    x = _docs(s, d).select("doc_id", F.posexplode(T.sentences(T.normalize("text"))).alias("k", "sentence"))
    return x.where(T.n_words("sentence") >= 3)


def study_sentences(s, d):
    return _study(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


def _fertility(s, d):
    """Blank-cut words and character trigrams as stand-in tokenizers, per detected language."""
    x = _study(s, d).select(T.detect_language("sentence").alias("lang"), T.n_words("sentence").cast("long").alias("words"), F.length("sentence").cast("long").alias("chars"), F.size(F.filter(F.split("sentence", rf"[{T.HBLANK}\n]+"), lambda w: F.length(w) > 3)).cast("long").alias("long_words"))
    g = x.where("lang IN ('hi', 'en')").groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("words", "chars", "long_words")], F.sum(F.ceil(F.col("chars") / 3)).alias("grams"))
    row = lambda name, tok, split: F.struct(F.lit(name).alias("tokenizer"), tok.cast("long").alias("tokens"), split.cast("long").alias("split"))
    e = g.select("lang", "words", "chars", F.explode(F.array(row("words", F.col("words"), F.lit(0)), row("trigrams", F.col("grams"), F.col("long_words")))).alias("t"))
    one = F.lit(1)
    return e.select("lang", "t.tokenizer", "t.tokens", F.round(F.col("t.tokens") / F.greatest("words", one), 6).alias("fertility"), F.round(F.col("chars") / F.greatest(F.col("t.tokens"), one), 6).alias("chars_per_token"), F.round(100 * F.col("t.split") / F.greatest("words", one), 6).alias("pct_words_split"))


def fertility(s, d):
    return _fertility(s, d)


def token_tax(s, d):
    p = _fertility(s, d).groupBy("tokenizer").pivot("lang", ["hi", "en"]).agg(F.first("fertility"))
    return p.select("tokenizer", F.round(F.col("hi") / F.col("en"), 6).alias("hi_en_ratio"))


QUERIES = {f.__name__: f for f in (
    normalize_text, detect_language, tokenize, split_sentences, devanagari_repair, garbled_flags, legacy_font_flags, page_quality, chunk_documents, dominant_language,
    term_freq, doc_freq, corpus_stats, bm25_topk, bm25_scoped, dense_topk, dense_scoped, rrf_fusion, hybrid_search, search_scoped, rerank_search,
    dedup_exact, ingest_added, upload_status, delete_roundtrip, meta_upsert, index_staleness, list_documents, chunks_for_document, kb_scan, kb_stats, load_dispatch, decode_text, layout_rejoin,
    clean_history, rewrite_prompt, citations, format_passages, answer_prompt, no_llm_answer,
    eval_metrics, eval_overall, eval_by_lang, ablation_markdown, qa_sample, qa_parse, qa_split, qa_valid, hard_negatives, triplets, study_sentences, fertility, token_tax,
)}

# -- SQL -----------------------------------------------------------------------------------------------------------------
_H = T.HBLANK


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_lit(x) for x in xs) + "]"


def _values(rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else _lit(v)
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


def _norm(x: str) -> str:
    x = rf"regexp_replace(nfc_normalize({x}), '[\x{{200B}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '[ \t\x{{A0}}]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '[{_H}]*\n[{_H}]*', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({x}, '^[{_H}\n]+|[{_H}\n]+$', '', 'g')"


def _tok(x: str) -> str:
    return rf"list_filter(regexp_extract_all(regexp_replace(nfc_normalize(lower({x})), '[\x{{200C}}\x{{200D}}]', '', 'g'), '{T.TOKEN}'), lambda w: regexp_matches(w, '{T.DIGITS}') OR (length(w) > 1 AND NOT list_contains({_list(T.STOP_WORDS)}, w)))"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_lit(pattern)}))"


def _detect(x: str) -> str:
    x = f"coalesce({x}, '')"
    deva, latin = _count(x, f"[{T.DEVA}]"), _count(x, "[A-Za-z]")
    words = f"regexp_extract_all(lower({x}), '[a-z]+')"
    marks = f"len(list_filter({words}, lambda w: list_contains({_list(T.HINGLISH)}, w)))"
    share = f"({deva})::double / nullif({deva} + {latin}, 0)"
    return f"CASE WHEN {share} >= 0.6 THEN 'hi' WHEN {share} >= 0.15 THEN 'mixed' WHEN len({words}) > 0 AND ({marks})::double / nullif(len({words}), 0) >= 0.2 THEN 'hinglish' ELSE 'en' END"


def _sent(rel: str, key: str) -> str:
    """CTEs sent(key, k, sentence) from rel(key, t), t being normalised."""
    return rf"""
      s_b AS (SELECT {key}, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?।॥])[{_H}\n]+', '\1' || chr(30), 'g'), '\n{{2,}}', chr(30), 'g'), chr(30))) AS b, generate_subscripts(string_split(regexp_replace(regexp_replace(t, '([.!?।॥])[{_H}\n]+', '\1' || chr(30), 'g'), '\n{{2,}}', chr(30), 'g'), chr(30)), 1) AS bn FROM {rel}),
      s_l AS (SELECT {key}, bn, unnest(string_split(b, chr(10))) AS l, generate_subscripts(string_split(b, chr(10)), 1) AS ln FROM s_b),
      s_f AS (SELECT *, sum(CASE WHEN length(l) < 40 OR regexp_matches(l, '^([-•*]|\p{{Nd}}{{2}}|\p{{Nd}}\.)') THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, bn ORDER BY ln) AS part FROM s_l WHERE l <> ''),
      s_g AS (SELECT {key}, bn, part, min(ln) AS ln, string_agg(l, ' ' ORDER BY ln) AS sentence FROM s_f GROUP BY ALL),
      sent AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY bn, ln) AS k, trim(sentence) AS sentence FROM s_g WHERE trim(sentence) <> '')"""


_ND = f"norm AS (SELECT doc_id, {_norm('text')} AS t FROM documents)"
_REP = "text"
for _c in [*range(0x93E, 0x94D), 0x962, 0x963]:
    _REP = rf"regexp_replace({_REP}, '(\x{{{_c:X}}}[\x{{900}}-\x{{903}}\x{{93C}}\x{{94D}}]*)\x{{{_c:X}}}+', '\1', 'g')"
for _c in (0x900, 0x901, 0x902, 0x903, 0x93C):
    _REP = rf"regexp_replace({_REP}, '\x{{{_c:X}}}{{2,}}', '{chr(_c)}', 'g')"

_GARBLED = rf"({_count('t', rf'[^{_H}\n]*[\x{{900}}-\x{{97F}}][^{_H}\n]*')} >= 10 AND ({_count('t', rf'(?m)(?:^|[{_H}\n])[{T.SIGNS}]')})::double / nullif({_count('t', rf'[^{_H}\n]*[\x{{900}}-\x{{97F}}][^{_H}\n]*')}, 0) > 0.05)"
_LW = rf"regexp_extract_all(substring(t, 1, 8000), '[^{_H}\n]+')"
_STRIPPED = "regexp_replace(w, '^[.,:()\"'']+|[.,:()\"'']+$', '', 'g')"
_LEGACY = rf"(len({_LW}) >= 20 AND (len(list_filter({_LW}, lambda w: list_contains({_list(T.LEGACY_WORDS)}, {_STRIPPED}))) + {_count('substring(t, 1, 8000)', T.LEGACY_INNER)})::double / nullif(len({_LW}), 0) > 0.06)"
_CT = "ct AS (SELECT id, doc_id, coalesce(text, '') AS t FROM chunks)"
_WORDS = rf"len(regexp_extract_all(coalesce(text, ''), '[^{_H}\n]+'))"

_POST = f"tk AS (SELECT id, {_tok("coalesce(text, '')")} AS w FROM chunks), post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tk) GROUP BY ALL)"
_Q = "qs AS (SELECT qa_id AS query_id, min(struct_pack(query := query, lang := lang, chunk_id := chunk_id)) AS q FROM qa_test WHERE qa_id % 20 = 0 AND query IS NOT NULL GROUP BY qa_id), q AS (SELECT query_id, q.query AS query, q.lang AS lang, q.chunk_id AS chunk_id FROM qs)"
_SCOPE = "allowed AS (SELECT id FROM chunks JOIN documents USING (doc_id) WHERE source LIKE 'krishi-%')"


def _bm25_sql(name: str, k: int, scoped: bool) -> str:
    where = "WHERE p.id IN (SELECT id FROM allowed)" if scoped else ""
    return f"""
      {name}_s AS (SELECT query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM (SELECT query_id, unnest(list_distinct({_tok("query")})) AS term FROM q) t JOIN post p USING (term) JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) USING (term)
        JOIN (SELECT id, len(w) AS dl FROM tk) l ON l.id = p.id CROSS JOIN (SELECT count(*)::double AS n, avg(len(w)) AS avgdl FROM tk) {where} GROUP BY query_id, p.id),
      {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


_SLOTS = """
      cs AS (SELECT id, ('0x' || right(md5(term), 2))::int % 64 AS slot, sum(tf)::double AS c FROM post GROUP BY ALL),
      cn AS (SELECT id, sqrt(sum(c * c)) AS n FROM cs GROUP BY id),
      qsl AS (SELECT query_id, ('0x' || right(md5(term), 2))::int % 64 AS slot, count(*)::double AS c FROM (SELECT query_id, unnest({tq}) AS term FROM q) GROUP BY ALL),
      qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qsl GROUP BY query_id),
      dp AS (SELECT query_id, id, sum(a.c * b.c) AS s FROM qsl a JOIN cs b USING (slot) GROUP BY ALL),
      dall AS (SELECT x.query_id, y.id, round(coalesce(s / (qn.n * cn.n), 0), 6) AS score FROM q x CROSS JOIN tk y LEFT JOIN dp ON dp.query_id = x.query_id AND dp.id = y.id LEFT JOIN qn ON qn.query_id = x.query_id LEFT JOIN cn ON cn.id = y.id {where})""".replace("{tq}", _tok("query"))


def _dense_sql(name: str, k: int, scoped: bool) -> str:
    return _SLOTS.replace("{where}", "WHERE y.id IN (SELECT id FROM allowed)" if scoped else "") + f""",
      {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dall) WHERE rank <= {k})"""


def _fused_sql(scoped: bool) -> str:
    n = CANDIDATES
    return f"WITH {_POST}, {_Q}, {_SCOPE}, {_bm25_sql('bm', n, scoped)}, {_dense_sql('dn', n, scoped)}, " + f"""
      u AS (SELECT query_id, id, score AS ds, rank AS dr, NULL::bigint AS br, 1.0::double / (60 + rank) AS p FROM dn UNION ALL SELECT query_id, id, NULL, NULL, rank, 1.0::double / (60 + rank) FROM bm),
      f AS (SELECT query_id, id, max(ds) AS dense_score, max(dr) AS dense_rank, max(br) AS bm25_rank, round(sum(p), 9) AS rrf_score FROM u GROUP BY query_id, id),
      fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, id) AS pos FROM f) WHERE pos <= {n}),
      hits AS (SELECT query_id, f.id AS chunk_id, c.doc_id, filename, c.page, c.language, c.text, dense_score, dense_rank, bm25_rank, rrf_score, pos FROM fused f JOIN chunks c ON c.id = f.id JOIN documents d ON d.doc_id = c.doc_id)"""


_HIT = "query_id, chunk_id, doc_id, filename, page, language, dense_score, dense_rank, bm25_rank, rrf_score, pos"
_RERANK = f"""rr AS (SELECT h.*, round(coalesce(len(list_intersect(list_distinct({_tok("q.query")}), {_tok("coalesce(text, '')")}))::double / nullif(len(list_distinct({_tok("q.query")})), 0), 0), 6) AS rerank_score FROM hits h JOIN q USING (query_id)),
      rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) AS final FROM rr)"""
_LAB = f"CASE WHEN l IN ('', 'und') THEN NULL ELSE coalesce(map_extract(MAP {{{', '.join(f'{_lit(a)}: {_lit(b)}' for a, b in SPELLINGS.items())}}}, l)[1], l) END"
_EVAL = _fused_sql(False) + f""", {_RERANK},
      ranks AS (SELECT 'BM25' AS system, query_id, id, rank FROM bm UNION ALL SELECT 'Dense', query_id, id, rank FROM dn UNION ALL SELECT 'Hybrid', query_id, chunk_id, pos FROM hits UNION ALL SELECT 'Hybrid + rerank', query_id, chunk_id, final FROM rk),
      lang AS (SELECT query_id, coalesce({_LAB}, 'und') AS lang, chunk_id AS target FROM (SELECT *, CASE WHEN lower(trim(lang)) = 'hi-latn' THEN 'hi-latn' ELSE regexp_replace(lower(trim(lang)), '[-_][a-z]{{2}}$', '') END AS l FROM q) WHERE chunk_id IN (SELECT id FROM chunks)),
      ev AS (SELECT s.system, t.query_id, t.lang, r.rank, CASE WHEN r.rank <= 1 THEN 1.0 ELSE 0.0 END::double AS r1, CASE WHEN r.rank <= 5 THEN 1.0 ELSE 0.0 END::double AS r5, CASE WHEN r.rank <= 10 THEN 1.0 ELSE 0.0 END::double AS r10, CASE WHEN r.rank <= 10 THEN 1.0::double / r.rank ELSE 0 END AS mrr10, CASE WHEN r.rank <= 10 THEN 1.0::double / log2(r.rank + 1) ELSE 0 END AS ndcg10
        FROM lang t CROSS JOIN (SELECT DISTINCT system FROM ranks) s LEFT JOIN ranks r ON r.system = s.system AND r.query_id = t.query_id AND r.id = t.target)"""
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in evaluation.METRICS)
_FILE = f"nullif(lower(regexp_replace(sha256, '^[{_H}\\n]+|[{_H}\\n]+$', '', 'g')), '')"
_BASE = r"regexp_extract(replace(filename, '\', '/'), '([^/]*)$', 1)"
_EXT = rf"lower(regexp_extract({_BASE}, '(\.[^.]*)$', 1))"
_OK = "(" + ", ".join(_lit(x) for x in kb.SUPPORTED) + ")"
_HIST = rf"""
      m AS (SELECT conv_id, turn, role, regexp_replace(content, '^[{_H}\n]+|[{_H}\n]+$', '', 'g') AS content FROM (VALUES {_values(MESSAGES)}) v(conv_id, turn, role, content) WHERE role IN ('user', 'assistant')),
      m2 AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM m WHERE content <> ''),
      m3 AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m2),
      m4 AS (SELECT conv_id, run, role, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS content FROM m3 GROUP BY ALL),
      m5 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY run DESC) AS k FROM m4),
      m6 AS (SELECT *, min(CASE WHEN role = 'user' THEN run END) OVER (PARTITION BY conv_id) AS a, max(CASE WHEN role = 'assistant' THEN run END) OVER (PARTITION BY conv_id) AS b FROM m5 WHERE k <= {{n}}),
      hist AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY run) AS turn_no, role, content FROM m6 WHERE run >= a AND run <= b)"""
_PASS = f"pass AS (SELECT query_id, string_agg('[' || n || '] (source: ' || coalesce(filename, '') || ', page ' || coalesce(page::varchar, '?') || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY n) AS passages FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM hits WHERE pos <= {TOP_K}) GROUP BY query_id)"
_HI = lambda d: f"CASE WHEN {_detect('query')} = 'hi' THEN {_lit(d['hi'])} ELSE {_lit(d['en'])} END"
_STUDY = f"WITH {_ND}, {_sent('norm', 'doc_id')}, st AS (SELECT doc_id, sentence, len(regexp_extract_all(sentence, '[^{_H}\\n]+')) AS words FROM sent WHERE len(regexp_extract_all(sentence, '[^{_H}\\n]+')) >= 3)"
_FERT = _STUDY + f""", fl AS (SELECT {_detect('sentence')} AS lang, words, length(sentence) AS chars, len(list_filter(regexp_split_to_array(sentence, '[{_H}\\n]+'), lambda w: length(w) > 3)) AS long_words FROM st),
      fg AS (SELECT lang, sum(words)::bigint AS words, sum(chars)::bigint AS chars, sum(long_words)::bigint AS lw, sum(ceil(chars / 3))::bigint AS grams FROM fl WHERE lang IN ('hi', 'en') GROUP BY lang),
      fe AS (SELECT lang, words, chars, 'words' AS tokenizer, words AS tokens, 0 AS split FROM fg UNION ALL SELECT lang, words, chars, 'trigrams', grams, lw FROM fg),
      fert AS (SELECT lang, tokenizer, tokens, round(tokens::double / greatest(words, 1), 6) AS fertility, round(chars::double / greatest(tokens, 1), 6) AS chars_per_token, round(100.0::double * split / greatest(words, 1), 6) AS pct_words_split FROM fe)"""
_MINED = f"WITH {_POST}, {_Q}, {_dense_sql('dn', 41, False)}, " + """
      pos AS (SELECT d.query_id, d.id AS positive, d.score AS pos_score FROM dall d JOIN q ON q.query_id = d.query_id AND q.chunk_id = d.id),
      rn AS (SELECT n.*, positive, pos_score, row_number() OVER (PARTITION BY n.query_id ORDER BY score DESC, id) AS k FROM dn n JOIN pos USING (query_id) WHERE id <> positive),
      cd AS (SELECT *, CASE WHEN k BETWEEN 3 AND 30 AND score < pos_score - 0.02::double THEN 0 WHEN k BETWEEN 31 AND 40 THEN 1 END AS tier, md5('13-' || query_id || '-' || id) AS h FROM rn),
      mined AS (SELECT query_id, positive, id AS negative, pos_score, score AS neg_score, k AS neg_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, h) AS o FROM cd WHERE tier IS NOT NULL) WHERE o = 1)"""

SQL = {
    "normalize_text": f"WITH {_ND} SELECT doc_id, md5(t) AS digest, length(t) AS n FROM norm",
    "detect_language": f"SELECT id, {_detect('text')} AS detected FROM chunks",
    "tokenize": f"SELECT id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT id, {_tok('text')} AS w FROM chunks)",
    "split_sentences": f"WITH {_ND}, {_sent('norm', 'doc_id')} SELECT d.doc_id, count(k) AS n, md5(coalesce(string_agg(sentence, '|' ORDER BY k), '')) AS digest FROM documents d LEFT JOIN sent USING (doc_id) GROUP BY d.doc_id",
    "devanagari_repair": f"SELECT id, md5({_REP}) AS digest FROM chunks",
    "garbled_flags": f"WITH {_CT} SELECT id, {_GARBLED}::int AS garbled FROM ct",
    "legacy_font_flags": f"WITH {_CT} SELECT id, {_LEGACY}::int AS legacy FROM ct",
    "page_quality": f"WITH {_CT}, x AS (SELECT doc_id, length(regexp_replace(t, '^[{_H}\\n]+|[{_H}\\n]+$', '', 'g')) < 20 AS e, ({_GARBLED} OR {_LEGACY}) AS b FROM ct), g AS (SELECT doc_id, count(*) AS pages, count_if(e) AS empty, count_if(b AND NOT e) AS broken FROM x GROUP BY doc_id) SELECT doc_id, pages, empty::bigint AS empty, broken::bigint AS broken, concat_ws('; ', CASE WHEN empty > 0 THEN empty || ' page(s) without text' END, CASE WHEN broken > 0 THEN broken || ' page(s) with a broken text layer' END) AS warnings FROM g",
    "chunk_documents": f"""WITH RECURSIVE {_ND}, {_sent('norm', 'doc_id')},
      w AS (SELECT doc_id, k, unnest(string_split(sentence, ' ')) AS word, generate_subscripts(string_split(sentence, ' '), 1) AS j, len(string_split(sentence, ' ')) AS nw FROM sent),
      pc AS (SELECT doc_id, k, CASE WHEN nw > {LIMIT} THEN (j - 1) // {LIMIT} ELSE 0 END AS part, string_agg(word, ' ' ORDER BY j) AS piece, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
      p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, part) - 1 AS i, piece, n, sum(n) OVER (PARTITION BY doc_id ORDER BY k, part) AS upto, count(*) OVER (PARTITION BY doc_id) AS total FROM pc),
      lo AS (SELECT a.doc_id, a.i, a.n, a.upto, a.total, coalesce(min(CASE WHEN (a.upto - a.n) - (b.upto - b.n) <= {OVERLAP} THEN b.i END), max(a.i)) AS lo FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND b.i < a.i AND b.i >= a.i - {2 * OVERLAP + 2} GROUP BY a.doc_id, a.i, a.n, a.upto, a.total),
      rec AS (SELECT doc_id, i, 0::bigint AS s, upto, total, NULL::bigint AS es, NULL::bigint AS ee FROM lo WHERE i = 0
        UNION ALL SELECT l.doc_id, l.i, CASE WHEN l.upto - coalesce(f.upto - f.n, 0) > {LIMIT} AND l.i > r.s THEN greatest(l.lo, r.s) ELSE r.s END, l.upto, l.total, CASE WHEN l.upto - coalesce(f.upto - f.n, 0) > {LIMIT} AND l.i > r.s THEN r.s END, CASE WHEN l.upto - coalesce(f.upto - f.n, 0) > {LIMIT} AND l.i > r.s THEN l.i END
        FROM rec r JOIN lo l ON l.doc_id = r.doc_id AND l.i = r.i + 1 JOIN p f ON f.doc_id = r.doc_id AND f.i = r.s),
      ch AS (SELECT doc_id, es AS a, ee AS b FROM rec WHERE es IS NOT NULL UNION ALL SELECT doc_id, s, total FROM rec WHERE i = total - 1),
      o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS chunk_index, a, b FROM ch)
      SELECT o.doc_id, chunk_index::int AS chunk_index, sum(n)::int AS token_count, md5(string_agg(piece, ' ' ORDER BY i)) AS digest FROM o JOIN p ON p.doc_id = o.doc_id AND p.i >= o.a AND p.i < o.b GROUP BY o.doc_id, chunk_index""",
    "dominant_language": f"WITH x AS (SELECT doc_id, {_detect('text')} AS l, {_WORDS} AS n FROM chunks), g AS (SELECT doc_id, sum(CASE WHEN l IN ('hi', 'mixed') THEN n ELSE 0 END)::double / nullif(sum(n), 0) AS s FROM x GROUP BY doc_id) SELECT doc_id, CASE WHEN s >= 0.8 THEN 'hi' WHEN s >= 0.2 THEN 'mixed' ELSE 'en' END AS language FROM g",
    "term_freq": f"WITH {_POST} SELECT id, term, tf FROM post",
    "doc_freq": f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term",
    "corpus_stats": f"WITH {_POST} SELECT count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM tk",
    "bm25_topk": f"WITH {_POST}, {_Q}, {_bm25_sql('bm', K, False)} SELECT query_id, id, score, rank FROM bm",
    "bm25_scoped": f"WITH {_POST}, {_Q}, {_SCOPE}, {_bm25_sql('bm', K, True)} SELECT query_id, id, score, rank FROM bm",
    "dense_topk": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= {K}",
    "dense_scoped": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0 AND b.label = 1)) WHERE rank <= {K}",
    "rrf_fusion": _fused_sql(False) + " SELECT query_id, id, dense_rank, bm25_rank, rrf_score, pos FROM fused",
    "hybrid_search": _fused_sql(False) + f" SELECT {_HIT} FROM hits WHERE pos <= {TOP_K}",
    "search_scoped": _fused_sql(True) + f" SELECT {_HIT} FROM hits WHERE pos <= {TOP_K}",
    "rerank_search": _fused_sql(False) + f", {_RERANK} SELECT query_id, chunk_id, rerank_score, pos, final FROM rk WHERE final <= {TOP_K}",
    "dedup_exact": f"WITH k AS (SELECT doc_id, coalesce({_FILE}, '#' || doc_id) AS k FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_id, count(*) OVER (PARTITION BY k) AS copies FROM k",
    "ingest_added": f"WITH k AS (SELECT doc_id, created_at, coalesce({_FILE}, '#' || doc_id) AS k, created_at < TIMESTAMPTZ '2025-09-01 00:00:00+00' AS old FROM documents), o AS (SELECT k, min(doc_id) AS old_id FROM k WHERE old GROUP BY k), b AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY created_at, doc_id) AS f FROM k WHERE NOT old) SELECT doc_id, CASE WHEN old_id IS NOT NULL OR f <> doc_id THEN 'duplicate' ELSE 'added' END AS status, CASE WHEN old_id IS NOT NULL THEN old_id WHEN f <> doc_id THEN f END AS existing_id FROM b LEFT JOIN o USING (k)",
    "upload_status": f"WITH u AS (SELECT DISTINCT * FROM uploads), x AS (SELECT *, {_BASE} AS base, {_EXT} AS ext, CASE WHEN {_EXT} IS NULL OR {_EXT} NOT IN {_OK} THEN 'unsupported type' WHEN size_bytes > {kb.MAX_UPLOAD_MB * 1024 * 1024} THEN 'too large' WHEN coalesce(size_bytes, 0) <= 0 THEN 'empty' END AS bad FROM u) SELECT upload_id, base AS filename, ext AS extension, CASE WHEN bad IS NOT NULL THEN 'error' ELSE status END AS status, coalesce(bad, error) AS reason FROM x",
    "delete_roundtrip": "WITH g AS (SELECT doc_id FROM documents WHERE source = 'old-archive') SELECT 'documents' AS tbl, count(*) AS n_before, count_if(doc_id NOT IN (SELECT doc_id FROM g))::bigint AS n_after FROM documents UNION ALL SELECT 'chunks', count(*), count_if(doc_id NOT IN (SELECT doc_id FROM g))::bigint FROM chunks",
    "meta_upsert": "WITH n AS (SELECT * FROM (VALUES ('embedding_model', 'hash-64'), ('schema_version', '4'), ('new_key', NULL)) v(key, value)) SELECT key, value FROM meta WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, value FROM n",
    "index_staleness": "SELECT v AS vectors, c AS chunks, m AS model, (m IS DISTINCT FROM 'pocket-embed-v2' OR v <> c)::int AS stale FROM (SELECT (SELECT count(*) FROM embeddings) AS v, (SELECT count(*) FROM chunks) AS c, (SELECT max(value) FROM meta WHERE key = 'embedding_model') AS m)",
    "list_documents": "WITH w AS (SELECT *, list_filter(string_split(coalesce(warnings, ''), chr(10)), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, filename, language, num_pages, num_chunks, size_bytes, len(ws) AS n_warnings, array_to_string(ws, '|') AS warnings FROM w",
    "chunks_for_document": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, id) AS position, id, page, token_count FROM chunks WHERE doc_id IS NOT NULL",
    "kb_scan": "SELECT id, c.doc_id, page, c.language, token_count, filename, md5(c.text) AS digest FROM chunks c JOIN documents d ON c.doc_id = d.doc_id",
    "kb_stats": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT max(value) FROM meta WHERE key = 'embedding_model') AS embedding_model",
    "load_dispatch": f"SELECT doc_id, {_BASE} AS basename, {_EXT} AS extension, ({_EXT} IN {_OK})::int AS supported FROM documents",
    "decode_text": f"SELECT * FROM (VALUES {_values([(i, t) for i, _, t in RAW_BYTES])}) v(id, text)",
    "layout_rejoin": rf"""
        WITH s AS (SELECT * FROM (VALUES {_values(SPANS)}) v(doc, page, seq, text, x0, y0, x1, y1, size) WHERE trim(text) <> ''),
        p AS (SELECT *, lag(text) OVER w AS pt, x0 - lag(x1) OVER w AS gap, lag(y1) OVER w AS py, lag(size) OVER w AS ps FROM s WINDOW w AS (PARTITION BY doc, page ORDER BY seq)),
        g AS (SELECT *, coalesce(abs(py - y1) < 0.3 * size AND gap >= -2 * size, false) AS goes_on FROM p),
        j AS (SELECT *, CASE WHEN pt IS NULL THEN '' WHEN NOT goes_on THEN CASE WHEN y0 - py > 0.9 * ps THEN chr(10) || chr(10) ELSE chr(10) END
                WHEN right(pt, 1) = ' ' OR left(text, 1) = ' ' OR gap <= 0.25 * size OR (regexp_matches(right(pt, 1), '[\x{{0900}}-\x{{097F}}]') AND regexp_matches(left(text, 1), '[\x{{0900}}-\x{{097F}}]') AND gap < 1.5 * size) THEN '' ELSE ' ' END AS glue,
              lead(goes_on) OVER (PARTITION BY doc, page ORDER BY seq) AS nxt FROM g),
        t AS (SELECT *, CASE WHEN goes_on THEN text ELSE ltrim(text) END AS t1 FROM j)
        SELECT doc::bigint AS doc, page::int AS page, string_agg(glue || CASE WHEN coalesce(nxt, false) THEN t1 ELSE rtrim(t1) END, '' ORDER BY seq) AS text FROM t GROUP BY ALL""",
    "clean_history": f"WITH {_HIST.replace('{n}', '4')} SELECT conv_id, turn_no, role, content FROM hist",
    "rewrite_prompt": f"WITH {_HIST.replace('{n}', '12')}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no DESC) AS k FROM hist), t AS (SELECT conv_id, string_agg(role || ': ' || substring(content, 1, 500), chr(10) ORDER BY turn_no) AS t FROM l WHERE k <= 4 GROUP BY conv_id) SELECT conv_id, 'Conversation so far:' || chr(10) || t || chr(10) || chr(10) || 'Latest message: ' || question AS prompt FROM t JOIN (VALUES (1, 'और कब?'), (2, 'why'), (4, 'e')) v(conv_id, question) USING (conv_id)",
    "citations": f"SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::int))), ',') AS cited FROM (VALUES {_values(ANSWERS)}) v(id, answer)",
    "format_passages": _fused_sql(False) + f", {_PASS} SELECT query_id, md5(passages) AS digest FROM pass",
    "answer_prompt": _fused_sql(False) + f", {_PASS} SELECT query_id, md5({_lit(chat.SYSTEM_PROMPT)} || chr(10) || chr(10) || CASE {_detect('query')} {' '.join(f'WHEN {_lit(a)} THEN {_lit(b)}' for a, b in chat.INSTRUCTIONS.items())} END) AS system, md5('Passages:' || chr(10) || chr(10) || coalesce(passages, '(no relevant passages found)') || chr(10) || chr(10) || 'Question: ' || query) AS prompt FROM q LEFT JOIN pass USING (query_id)",
    "no_llm_answer": _fused_sql(False) + f", na AS (SELECT query_id, string_agg('**[' || n || '] ' || coalesce(filename, '') || ', p.' || coalesce(page::varchar, '?') || '**' || chr(10) || CASE WHEN length(x) <= 600 THEN x ELSE regexp_replace(substring(x, 1, 600), ' [^ ]*$', '') || ' …' END || chr(10), chr(10) ORDER BY n) AS lines FROM (SELECT *, coalesce(text, '') AS x, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM hits WHERE pos <= 3) GROUP BY query_id) SELECT query_id, md5(CASE WHEN lines IS NULL THEN {_HI(chat.NOTHING)} ELSE {_HI(chat.HEADER)} || chr(10) || chr(10) || lines END) AS answer FROM q LEFT JOIN na USING (query_id)",
    "eval_metrics": _EVAL + " SELECT system, query_id, lang, rank, r1, r5, r10, round(mrr10, 6) AS mrr10, round(ndcg10, 6) AS ndcg10 FROM ev",
    "eval_overall": _EVAL + f" SELECT system, count(*) AS n, {_MEANS} FROM ev GROUP BY system",
    "eval_by_lang": _EVAL + f" SELECT system, lang, count(*) AS n, {_MEANS} FROM ev GROUP BY system, lang",
    "ablation_markdown": _EVAL + f", sm AS (SELECT system, {_MEANS} FROM ev GROUP BY system) SELECT 1::bigint AS line_no, {_lit('| ' + ' | '.join(('system', *evaluation.METRICS)) + ' |')} AS line UNION ALL SELECT 2, {_lit('|' + ' --- |' * (len(evaluation.METRICS) + 1))} UNION ALL SELECT row_number() OVER (ORDER BY system) + 2, '| ' || system || {' || '.join(f"' | ' || format('{{:.3f}}', {c})" for c in evaluation.METRICS)} || ' |' FROM sm",
    "qa_sample": "SELECT id, doc_id, token_count FROM chunks WHERE token_count >= 40 ORDER BY md5('13-' || id), id LIMIT 300",
    "qa_parse": "SELECT * FROM (VALUES (1::bigint, 'hi', 'शुल्क कितना है भाई?'), (3, 'en', 'What is the fee here?')) v(id, lang, question)",
    "qa_split": "WITH q AS (SELECT DISTINCT qa_id, chunk_id FROM qa_train WHERE chunk_id IS NOT NULL), c AS (SELECT chunk_id, row_number() OVER (ORDER BY md5('13-' || chunk_id), chunk_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT chunk_id FROM q)) SELECT qa_id, q.chunk_id, CASE WHEN k <= floor(n * 0.3::double) THEN 'test' ELSE 'train' END AS split FROM q JOIN c USING (chunk_id)",
    "qa_valid": "SELECT qa_id, chunk_id, lang FROM (SELECT DISTINCT * FROM qa_test) WHERE chunk_id IN (SELECT id FROM chunks)",
    "hard_negatives": _MINED + " SELECT query_id, positive, negative, pos_score, neg_score, neg_rank FROM mined",
    "triplets": _MINED + " SELECT m.query_id, md5('query: ' || query) AS anchor, md5('passage: ' || coalesce(p.text, '')) AS positive, md5('passage: ' || coalesce(n.text, '')) AS negative FROM mined m JOIN chunks p ON p.id = positive JOIN chunks n ON n.id = negative JOIN q USING (query_id)",
    "study_sentences": _STUDY + " SELECT doc_id, count(*) AS n, sum(length(sentence))::bigint AS chars FROM st GROUP BY doc_id",
    "fertility": _FERT + " SELECT * FROM fert",
    "token_tax": _FERT + " SELECT tokenizer, round(max(CASE WHEN lang = 'hi' THEN fertility END) / max(CASE WHEN lang = 'en' THEN fertility END), 6) AS hi_en_ratio FROM fert GROUP BY tokenizer",
}
