import io
import zipfile

import pytest
from pyspark.sql import functions as F

from granth.functions import text as T
from granth.functions.labels import label
from granth.operators import chat, chunking, dense, evaluation, fusion, lexical
from granth.operators import knowledge_base as kb
from granth.sources import loaders
from granth.streaming import ingest


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in df.select("i", f("t").alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    got = column(spark, ["क़", "  a​  \r\n\r\n\r\nx ", "infor-\nmation", "infor- \nmation", "a\xa0\tb", None, ""], T.normalize)
    assert got == ["क़", "a\n\nx", "information", "infor-\nmation", "a b", None, ""]


def test_detect_language(spark):
    got = column(spark, ["The fee is due in March.", "शुल्क मार्च में देना है।", "fee kab deni hai aur kaise", "शुल्क fee मार्च में submit करना form deadline please check now", "123", None], T.detect_language)
    assert got == ["en", "hi", "hinglish", "mixed", "en", "en"]


def test_tokens_keep_signs_and_numbers(spark):
    assert column(spark, ["The किताबें है। 7 a Café", None, ""], T.tokens) == [["किताबें", "7", "café"], None, []]


def test_sentences(spark):
    long = "x" * 45
    got = column(spark, ["पहला वाक्य। दूसरा वाक्य॥ Third one.", f"Head\n{long} a\n{long} b\n- item\n12 more {long}", None], T.sentences)
    assert got[0] == ["पहला वाक्य।", "दूसरा वाक्य॥", "Third one."]
    assert got[1] == [f"Head {long} a {long} b", "- item", f"12 more {long}"]
    assert got[2] is None


def test_devanagari(spark):
    assert column(spark, ["महाविद्याालय", "हैंं", "नियम"], T.repair_devanagari) == ["महाविद्यालय", "हैं", "नियम"]
    assert column(spark, [" ".join(["नियम"] * 12), " ".join(["िनयम"] * 12), None], T.looks_garbled) in ([False, True, None], [False, True, False])
    assert column(spark, ["dk " * 5 + "word " * 20, "word " * 30, "dk dk"], T.looks_legacy_font) == [True, False, False]


def test_page_checks_take_linear_time(spark):
    import time

    began = time.time()
    assert column(spark, ["a" * 150_000], T.looks_garbled) == [False]
    assert time.time() - began < 20
    words = ["fd", "(fd)", "fd;k", "}kjk,", "fy,", ",oa", "fdx", "x.fd", "'dk'", "dk", "esa:", "tk,xkA.", "ds\u00a0dh"]  # ten of these count, and one sign inside
    assert column(spark, [" ".join(words + ["plain"] * n) for n in (160, 180)], T.looks_legacy_font) == [True, False]


def test_labels(spark):
    got = column(spark, ["Hindi", "hi-IN", "hi-Latn", "HINGLISH", " ", "und", None, "ne", "zh_CN"], label)
    assert got == ["hi", "hi", "hinglish", "hinglish", None, None, None, "ne", "zh"]


def test_chunk_windows():
    assert chunking.windows([5] * 6 + [30], 30, 8) == [(0, 6), (5, 7)]  # the budget is soft
    assert chunking.windows([], 10, 2) == []
    assert [n for _, n in chunking.pieces(["word " * 25], 10)] == [10, 10, 5]


def test_chunk(spark):
    pages = spark.createDataFrame([(1, 3, " ".join(f"Sentence number {i} has exactly seven words." for i in range(30))), (2, 1, None)], "doc_id long, page int, text string")
    rows = chunking.chunk(pages, 30, 8).orderBy("chunk_index").collect()
    assert all(r.token_count <= 30 and r.page == 3 for r in rows) and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].text.split(". ")[-1].rstrip(".") in rows[1].text
    assert chunking.chunk(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.chunk(pages, 5, 5)


def test_bm25(spark):
    items = spark.createDataFrame([(1, "apple banana"), (2, "banana cherry"), (3, "durian"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(1, "banana"), (2, "zzz"), (3, None)], "query_id long, query string")
    ix = lexical.index(items)
    assert [(r.query_id, r.id) for r in lexical.bm25(ix, q, 5).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    only = spark.createDataFrame([(2,), (2,)], "id long")
    assert [(r.id, r["rank"]) for r in lexical.bm25(ix, q, 5, only).collect()] == [(2, 1)]
    assert lexical.bm25(lexical.index(items.limit(0)), q, 5).count() == 0


def test_bm25_shuffles_no_postings(spark, monkeypatch):
    import math
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i % 190 if i < 200 else None, " ".join(rng.choices(words, range(30, 0, -1), k=rng.randrange(0, 25)))) for i in range(210)]  # ten ids twice, ten nulls
    asked = {q: rng.sample(words, 4) for q in range(12)}
    items = spark.createDataFrame(rows, "id long, text string")
    monkeypatch.setattr(lexical, "ITEMS", 7)
    monkeypatch.setattr(lexical, "BLOCK", 5)
    got = lexical.bm25(lexical.index(items), spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()], "query_id long, query string"), 6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # each task keeps its best rows
    pooled, lengths = {}, {}
    for i, text in rows:
        pooled.setdefault(i, []).extend(text.split())
        lengths.setdefault(i, []).append(len(text.split()))
    n, avgdl = len(rows), sum(len(x.split()) for _, x in rows) / len(rows)
    for q, ws in asked.items():
        want = []
        for i in pooled:
            terms = [w for w in ws if w in pooled[i]]
            idf = {w: math.log(1 + (n - sum(w in p for p in pooled.values()) + 0.5) / (sum(w in p for p in pooled.values()) + 0.5)) for w in terms}
            part = [idf[w] * pooled[i].count(w) * 2.5 / (pooled[i].count(w) + 1.5 * (0.25 + 0.75 * dl / avgdl)) for w in terms for dl in lengths[i]]
            if part and i is not None:
                want.append((-round(sum(part), 6), i))
        assert [(-r.score, r.id) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == sorted(want)[:6]


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.id for r in dense.search(v, q, 2).orderBy("rank").collect()] == [1, 3]  # ties by id
    assert [r.id for r in dense.search(v, q, 9).orderBy("rank").collect()] == [1, 3, 2]  # no threshold
    assert dense.search(v, q, 0).count() == 0
    zero = spark.createDataFrame([(8, [0.0, 0.0])], "query_id long, vector array<double>")
    assert [r.id for r in dense.search(v, zero, 2).orderBy("rank").collect()] == [1, 2]  # k rows, not all ties
    with pytest.raises(Exception, match="dimension"):
        dense.search(v.union(spark.createDataFrame([(5, [1.0])], v.schema)), q, 2).collect()


def test_dense_keeps_a_running_best():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (400, 3)).astype(float)
    ids = rng.permutation(400)
    q = rng.integers(-2, 3, (7, 3)).astype(float)
    run = dense._scorer(pd.DataFrame({"query_id": range(7), "vector": list(q)}), 9)
    parts = [pd.DataFrame({"id": ids[a:a + 50], "vector": list(x[a:a + 50])}) for a in range(0, 400, 50)]
    got = pd.concat(run(iter(parts)))
    assert len(got) == 63
    for k in range(7):
        want = sorted(zip(-(x @ q[k]), ids))[:9]
        assert sorted(zip(-got.score[got.query_id == k], got.id[got.query_id == k])) == want
    big = np.array([[1e9, 5.0, 1e9]])
    assert sorted(dense.best_columns(big, 2)[0]) == [0, 2]


def test_dense_screens_pairs_and_keeps_ties():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(3000, 8)), np.repeat(rng.normal(size=(30, 8)), 20, axis=0)])  # many equal rows
    ids = rng.permutation(len(x))
    q = np.concatenate([x[:40], np.zeros((1, 8)), x[-40:], rng.normal(size=(40, 8)) * 1e-5, rng.normal(size=(2, 8)) * 1e35])
    run = dense._scorer(pd.DataFrame({"query_id": range(len(q)), "vector": list(q)}), 9)
    parts = [pd.DataFrame({"id": ids[a:a + 400], "vector": list(x[a:a + 400])}) for a in range(0, len(x), 400)]
    got = pd.concat(run(iter(parts))).groupby("query_id")
    for k in range(len(q) - 2):
        want = sorted(zip(-(np.round(x @ q[k], 6) + 0.0), ids))[:9]
        assert sorted(zip(-got.get_group(k).score, got.get_group(k).id)) == want
    assert got.size().eq(9).all()
    row, column, whole = dense._screened(q[:1], x, np.array([(q[0] @ q[0]) * 0.99]), 9)
    assert not whole.any() and 0 in column and len(row) < 20


def test_hits_of_many_partitions_move_little(spark):
    from granth.runtime import materialise

    v = spark.range(400).repartition(40).select("id", F.array(F.col("id") % 7 + 0.0, F.lit(1.0)).alias("vector"))
    found = dense.search(v, v.where("id < 5").withColumnRenamed("id", "query_id"), 3)
    assert "Coalesce 8" in found._jdf.queryExecution().executedPlan().toString()  # 2 x 4 cores, not 40 tasks, return 3 rows a query
    chunks = spark.range(400).selectExpr("id", "id as doc_id", "1 as page", "'en' as language", "repeat('x', 99) as text")
    hits = spark.createDataFrame([(1, 3, 0.5, 1, None, 0.1, 1), (1, 999, 0.5, 2, None, 0.1, 2)], "query_id long, id long, dense_score double, dense_rank long, bm25_rank long, rrf_score double, pos long")
    got = fusion.hydrate(hits, materialise(chunks), chunks.selectExpr("doc_id", "'f' as filename"))
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()  # texts of other chunks are not shuffled
    assert [(r.chunk_id, r.filename, r.pos) for r in got.collect()] == [(3, "f", 1)]


def test_rrf(spark):
    cols = "query_id long, id long, score double, rank long"
    a = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (1, 3, 0.7, 3)], cols)
    b = spark.createDataFrame([(1, 2, 5.0, 1), (1, 3, 4.0, 2), (1, 1, 3.0, 3)], cols)
    got = fusion.rrf(a, b, 3).orderBy("pos").collect()
    assert got[0].id == 2 and got[0].dense_rank == 2 and got[0].bm25_rank == 1
    assert fusion.rrf(a.limit(0), b, 3).count() == 3


def test_ingest_and_delete(spark):
    t = "doc_id long, sha256 string, created_at long"
    old = spark.createDataFrame([(1, "AA", 1), (2, None, 1)], t)
    new = spark.createDataFrame([(3, " aa ", 2), (4, "bb", 3), (5, "BB", 4), (6, None, 5), (7, " ", 5)], t)
    got = {r.doc_id: (r.status, r.existing_id) for r in kb.ingest(old, new).collect()}
    assert got == {3: ("duplicate", 1), 4: ("added", None), 5: ("duplicate", 4), 6: ("added", None), 7: ("added", None)}
    assert kb.delete({"x": old}, old.where("doc_id = 1"))["x"].count() == 1
    ids = [r.id for r in kb.new_ids(new, 100, ["doc_id"]).collect()]
    assert sorted(ids) == list(range(101, 106))


def test_meta_upsert(spark):
    m = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    got = {r.key: r.value for r in kb.upsert(m, spark.createDataFrame([("b", "2"), ("c", "3")], m.schema)).collect()}
    assert got == {"a": "1", "b": "2", "c": "3"}


def test_history_turns(spark):
    m = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 2, "user", "a"), (1, 3, "user", "b"), (1, 4, "assistant", "c"), (1, 5, "user", "d")], "conv_id long, turn long, role string, content string")
    for turns in (6, 0):
        got = chat.clean_history(m, turns).orderBy("turn_no").collect()
        assert [(r.role, r.content) for r in got] == [("user", "a\n\nb"), ("assistant", "c")]
    assert chat.clean_history(m.limit(0)).count() == 0


def test_rewritten_and_citations(spark):
    df = spark.createDataFrame([('""', "q"), ('"one\ntwo"', "q"), (None, "q")], "a string, q string")
    assert [r.x for r in df.select(chat.rewritten("a", F.col("q")).alias("x")).collect()] == ["q", "one", "q"]


def test_metrics(spark):
    r = spark.createDataFrame([("A", 1, 10, 3), ("A", 2, 11, 1)], "system string, query_id long, id long, rank long")
    t = spark.createDataFrame([(1, "en", 10), (2, "hi", 99)], "query_id long, lang string, target long")
    got = {x.query_id: x for x in evaluation.metrics(r, t).collect()}
    assert got[1].r1 == 0 and got[1].r5 == 1 and abs(got[1].ndcg10 - 0.5) < 1e-9 and got[2].mrr10 == 0


def test_take_fraction(spark):
    ids = spark.range(1000).select("id")
    assert evaluation.take_fraction(ids.union(ids), 0.3, 1).count() == 300
    assert evaluation.take_fraction(ids.limit(0), 0.3, 1).count() == 0


def test_decode():
    assert loaders.decode_text("नमस्ते".encode("utf-8-sig")) == "नमस्ते"
    assert loaders.decode_text("नमस्ते".encode("utf-16")) == "नमस्ते"
    assert loaders.decode_text(b"caf\xe9s") == "cafés"
    assert loaders.decode_text(None) is None


def test_load(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>para</w:t></w:r></w:p></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.TXT").write_bytes("हाँ ".encode())
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.md").write_bytes(b"  ")
    got = {r.path.rsplit("/", 1)[-1]: r for r in loaders.load(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "para\nc1 | c2" and got["b.TXT"].text == "हाँ" and "Unsupported" in got["c.exe"].error and got["d.md"].error == "no text"
    import hashlib

    assert got["b.TXT"].sha256 == hashlib.sha256("हाँ ".encode()).hexdigest() and got["b.TXT"].size_bytes == len("हाँ ".encode())


def test_pdf_fallback_and_ocr(spark, tmp_path):
    def broken(data):
        raise OSError("no reader")

    (tmp_path / "a.pdf").write_bytes(b"x")
    plain = lambda data: ["a page with a good text layer", "", "  "]
    pages = lambda **kw: {r.number: r.text or r.error for r in loaders.load(spark, str(tmp_path), **kw).collect()}
    assert pages(pdf=[broken, plain]) == {1: "a page with a good text layer"}
    assert pages(pdf=plain, ocr=lambda data, numbers: {k: f"read {k}" for k in numbers if k < 3}) == {1: "a page with a good text layer", 2: "read 2"}
    assert pages(pdf=plain, ocr=lambda data, numbers: 1 / 0) == {1: "a page with a good text layer"}
    assert pages(pdf=broken) == {None: "no reader"} and pages() == {None: "Unsupported file type: .pdf"}


def test_layout(spark):
    span = lambda k, text, x0, x1, y: (1, 1, k, text, float(x0), y - 10.0, float(x1), float(y), 10.0)
    rows = [span(1, " उपस्थि", 0, 50, 100), span(2, "ति", 55, 70, 100), span(3, "next", 0, 40, 112), span(4, "gap ", 50, 70, 112), span(5, "  ", 70, 80, 112), span(6, "para", 0, 40, 160)]
    df = spark.createDataFrame(rows, "doc long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert [r.text for r in loaders.layout_rejoin(df).collect()] == ["उपस्थिति\nnext gap\n\npara"]
    assert loaders.layout_rejoin(df.limit(0)).count() == 0


def test_stream_adds_once_and_keeps_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aa", 1), (2, "AA", 2), (3, "bb", 3)], "doc_id long, sha256 string, created_at long")
    snap = kb.Snapshots(spark, str(tmp_path / "kb"))
    chunk = lambda docs: {"chunks": docs.select("doc_id", F.lit("t").alias("text"))}
    snap.commit({"documents": rows.where("doc_id = 1"), "meta": spark.createDataFrame([("k", "v")], "key string, value string")} | chunk(rows.where("doc_id = 1")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for k in ("one", "two"):  # the second run replays everything
        ingest.start(stream, snap, str(tmp_path / k), chunk).awaitTermination()
    assert sorted(r.doc_id for r in snap.read("documents").collect()) == [1, 3]
    assert sorted(r.doc_id for r in snap.read("chunks").collect()) == [1, 3] and snap.read("meta").count() == 1


class FakeLLM:
    name = "fake"

    def __init__(self):
        self.seen = []

    def generate(self, system, messages, max_tokens):
        self.seen.append((system, messages))
        return "answer [1]"


def test_knowledge_base_round_trip(spark, tmp_path):
    from granth.knowledge import HashEmbedder, KnowledgeBase

    files = tmp_path / "in"
    files.mkdir()
    (files / "fees.txt").write_bytes("The hostel fee is 6000 rupees. It is due in March.\n\nLate payment costs 50 rupees a day.".encode())
    (files / "yojana.txt").write_bytes("किसान को 6000 रुपये की सहायता मिलेगी। आवेदन ग्राम सभा में होगा।".encode())
    (files / "again.txt").write_bytes((files / "fees.txt").read_bytes())
    (files / "bad.exe").write_bytes(b"x")
    (files / "none.txt").write_bytes(b" ")
    at = str(tmp_path / "kb")
    base = KnowledgeBase(spark, at, limit=40, overlap=5, reranker=None)
    assert "empty" in base.answer("What is the fee?")["answer"] and base.search("fee") == []
    got = {r.filename: r for r in base.add(str(files)).collect()}
    assert [got[k].status for k in ("again.txt", "fees.txt", "yojana.txt", "bad.exe", "none.txt")] == ["added", "duplicate", "added", "error", "error"]
    assert got["fees.txt"].doc_id == got["again.txt"].doc_id and "Unsupported" in got["bad.exe"].error and got["none.txt"].error == "no text"
    assert {r.status for r in base.add(str(files)).where("error IS NULL").collect()} == {"duplicate"} and base.stats()["documents"] == 2
    for name, error in (("fees.txt", kb.DuplicateDocumentError), ("bad.exe", kb.UnsupportedFileType), ("none.txt", kb.DocumentProcessingError)):
        with pytest.raises(error):
            base.add_document(str(files / name))
    fees, hindi = got["fees.txt"].doc_id, got["yojana.txt"].doc_id
    assert base.search("hostel fee", 1)[0]["doc_id"] == fees and base.search("किसान सहायता", 1)[0]["doc_id"] == hindi
    assert {h["doc_id"] for h in base.search("6000", doc_ids=[hindi])} == {hindi} and {h["doc_id"] for h in base.search("6000", doc_ids=[])} == {fees, hindi}
    assert base.search("6000", doc_ids=[999]) == [] and len(base.search("6000", top_k=0)) == base.stats()["chunks"]
    assert "6000" in base.answer("hostel fee kya hai")["answer"]
    for bad in ("", "x" * 4001):
        with pytest.raises(ValueError):
            base.search(bad)
    with pytest.raises(ValueError):
        base.search("x", 51)
    llm = FakeLLM()
    chatty = KnowledgeBase(spark, at, limit=40, overlap=5, llm=llm)
    out = chatty.answer("किसान को कितने रुपये मिलेंगे?", [{"role": "user", "content": "नमस्ते"}, {"role": "assistant", "content": "कहिए"}])
    system, messages = llm.seen[-1]
    assert out["language"] == "hi" and out["search_query"] == "answer [1]" and "Hindi" in system and "source: yojana.txt, page 1" in messages[-1]["content"] and len(messages) == 3
    base.store.commit({"vectors": base.store.read("vectors").limit(0)})  # a lost index is made again when the base is opened
    assert base.stale() and not KnowledgeBase(spark, at).stale()
    other = type("Other", (HashEmbedder,), {"name": "other-64"})()
    assert KnowledgeBase(spark, at, embedder=other).meta("embedding_model") == "other-64"
    base.delete(fees)
    assert fees not in {h["doc_id"] for h in base.search("hostel fee")} and base.store.read("vectors").count() == base.store.read("chunks").count()
    assert [r.doc_id for r in base.list_documents().collect()] == [hindi] and base.document_chunks(hindi).count() == 1
    for call in (base.delete, base.document_chunks):
        with pytest.raises(KeyError):
            call(fees)
    assert base.add_document(str(files / "fees.txt")) > max(fees, hindi)  # ids are not used twice


def test_watched_folder(spark, tmp_path):
    from granth.knowledge import KnowledgeBase

    files = tmp_path / "in"
    files.mkdir()
    (files / "a.txt").write_bytes(b"The water committee meets on Monday in the village hall.")
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    for k in ("one", "two"):
        ingest.watch_folder(spark, str(files), base, str(tmp_path / k)).awaitTermination()
    assert base.stats()["documents"] == 1 and base.search("water committee")[0]["filename"] == "a.txt"


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:07:00", "b")], "ts string, k string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.late_counts(stream, "ts", "k").writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert {(r.k, r.n) for r in spark.table("late").collect()} == {("a", 2), ("b", 1)}


def test_files(spark, tmp_path):
    from granth.sources import files

    df = spark.createDataFrame([(1, "शुल्क"), (2, None)], "id long, t string")
    files.write_jsonl(df, str(tmp_path / "x"))
    assert sorted(tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "x"), df.schema).collect()) == [(1, "शुल्क"), (2, None)]
    s = spark.createDataFrame([("BM25", 2, 0.5, 1.0, 1.0, 0.75, 0.8)], "system string, n long, r1 double, r5 double, r10 double, mrr10 double, ndcg10 double")
    for tag in ("first", "second"):
        files.append_report(str(tmp_path / "report.md"), tag, evaluation.markdown(s), s)
    text = (tmp_path / "report.md").read_text()
    assert text.count("| BM25 | 0.500 |") == 2 and (tmp_path / "second.json").exists()


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from granth import runtime

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(session)


def test_hard_negatives_fall_back(spark):
    ranked = spark.createDataFrame([(1, i, 1.0 - i / 100, i + 1) for i in range(8)], "query_id long, id long, score double, rank long")
    pos = spark.createDataFrame([(1, 0, 0.2)], "query_id long, positive long, pos_score double")
    assert evaluation.hard_negatives(ranked, pos).count() == 1  # nothing is below the margin: the last ten serve


def test_plans_push_filters_and_limit_groups(spark):
    from granth.plans import catalog

    d = "/root/testdata/sf0.001"
    plan = catalog.delete_roundtrip(spark, d)._jdf.queryExecution().toString()
    assert "EqualTo(source,old-archive)" in plan
    assert "WindowGroupLimit" in catalog.bm25_topk(spark, d)._jdf.queryExecution().executedPlan().toString()


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_materialised_tables_are_cleared(spark):
    import os

    from granth import runtime

    df = runtime.materialise(spark.range(3), "three")
    path = runtime._WRITTEN[-1]
    assert df.count() == 3 and os.path.isdir(path) and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert runtime.clear(spark) >= 1 and not os.path.exists(path)
