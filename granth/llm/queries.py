"""Queries of the training-data problems, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granth.functions.labels import label
from granth.llm import encoding, language, linked_splits, mixing, near_duplicates, oversize, packing, scan_noise, sentences, sizes
from granth.runtime import materialise, meta_int, scratch, small_side, table


def _noise(spark: SparkSession, d: str) -> scan_noise.Noise:
    return scan_noise.Noise(table(spark, d, "chunks"), table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d).found()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repair(_noise(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return oversize.split_oversized(table(spark, d, "chunks"), meta_int(spark, d, "chunk_tokens", 300), meta_int(spark, d, "chunk_overlap_tokens", 50))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("piece_no = 0 AND n_pieces > 1").select("chunk_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.expand(*near_duplicates.similar(_texts(spark, d)))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*near_duplicates.similar(_texts(spark, d)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.question_groups(table(spark, d, "qa_train"), table(spark, d, "chunks"), table(spark, d, "documents"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.split_questions(spark, table(spark, d, "qa_train"), table(spark, d, "chunks"), table(spark, d, "documents"))


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Component table after two batches: questions up to the middle of the time range, then all later ones."""
    qa, chunks, files = table(spark, d, "qa_train"), table(spark, d, "chunks"), linked_splits.file_links(table(spark, d, "documents"))
    span = qa.agg(F.min("created_at").cast("double"), F.max("created_at").cast("double")).first()
    middle = ((span[0] or 0) + (span[1] or 0)) / 2
    late = F.coalesce(F.col("created_at").cast("double"), F.lit(middle + 1)) > middle
    kept = linked_splits.ComponentTable(spark, scratch(spark, "components"))
    for batch in (qa.where(~late), qa.where(late)):
        named = materialise(linked_splits.question_docs(batch, chunks), "named")
        first = named.groupBy("qa_id").agg(F.min("doc").alias("doc"))
        kept.update(first, linked_splits.question_links(named).unionByName(files))
    return kept.read()


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(sizes.with_tokens(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "pack_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d))


def _mixture(spark: SparkSession, d: str, total: str | None = None) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "language", "text")
    listed = small_side(table(spark, d, "mix_targets").select("source").dropDuplicates(), 256)
    sized = sizes.with_tokens(docs.where("source IS NOT NULL").join(listed, "source", "left_semi")).drop("text")
    return mixing.mix(materialise(sized, "sizes"), table(spark, d, "mix_targets"), label("language"), total)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Mixture of the whole pool: small sources run out and pass their shares on."""
    return _mixture(spark, d, "whole")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares that p8_mixture really reaches."""
    return mixing.share_report(materialise(p8_mixture(spark, d), "mixture"), table(spark, d, "mix_targets"))


def p8_exact_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Largest mixture in which every source that has texts reaches its target share."""
    return _mixture(spark, d)


def p8_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(materialise(p8_exact_mixture(spark, d), "mixture"), table(spark, d, "mix_targets"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Every record with a language label: (tbl, rec_id, stored, text)."""
    c, o, q = table(spark, d, "chunks"), table(spark, d, "documents"), table(spark, d, "qa_test").select("qa_id", "lang", "query").dropDuplicates()
    part = lambda name, df, i, lang, text: df.select(F.lit(name).alias("tbl"), F.col(i).alias("rec_id"), F.col(lang).alias("stored"), F.col(text).alias("text"))
    return part("chunks", c, "id", "language", "text").unionByName(part("documents", o, "doc_id", "language", "text")).unionByName(part("qa_test", q, "qa_id", "lang", "query"))


def _network(spark: SparkSession, d: str) -> language.BiGRU:
    asked = table(spark, d, "qa_train").select(F.lit("qa_train").alias("tbl"), F.col("qa_id").alias("rec_id"), F.col("lang").alias("stored"), F.col("query").alias("text"))
    return language.train(*language.training_rows(table(spark, d, "lang_samples"), _labelled(spark, d).unionByName(asked)))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(_labelled(spark, d), _network(spark, d)).drop("segments", "stored")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of every mixed record."""
    s = language.identify(_labelled(spark, d), _network(spark, d), with_segments=True).where("lang = 'mixed'")
    return s.select("tbl", "rec_id", F.posexplode("segments").alias("seg_no", "s")).select("tbl", "rec_id", "seg_no", "s.*")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(language.identify(_labelled(spark, d), _network(spark, d)))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return encoding.records(table(spark, d, "chunks"), table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(_fields(spark, d))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(_fields(spark, d))


def p9_units(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentences.sentences(docs, sentences.fit_spaceless(docs, table(spark, d, "lang_samples").where(label("lang").isin("th", "ja", "zh"))))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_units(spark, d).select("doc_id", "start_pos", "end_pos")


def p8_pool_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture as large as all listed texts: small sources run out and pass their shares on."""
    return mixing.share_report(materialise(_mixture(spark, d, "pool"), "mixture"), table(spark, d, "mix_targets"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_pieces, p3_found, p3_groups, p4_found, p4_splits, p4_incremental, p5_found, p5_labels, p5_segments, p6_found, p6_repaired, p7_packing, p7_fill, p8_mixture, p8_shares, p8_exact_mixture, p8_exact_shares, p8_pool_shares, p9_found, p9_units)}

_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SQL = {
    "p2_found": rf"""
        SELECT id AS chunk_id FROM chunks
        WHERE len(regexp_extract_all(text, '[^{_BLANK}]+')) > (SELECT max(try_cast(value AS INT)) FROM meta WHERE key = 'chunk_tokens')""",
    "p3_found": rf"""
        WITH w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[{_BLANK}]+'), lambda x: x <> '') AS w FROM chunks),
        s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
        u AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
        c AS (SELECT a.id AS chunk_a, b.id AS chunk_b, a.n AS n, b.n AS m, count(*) AS k FROM u a JOIN u b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
        SELECT chunk_a, chunk_b FROM c WHERE k >= 0.6 * (n + m - k)""",
    "p4_found": """
        WITH RECURSIVE named AS (
          SELECT DISTINCT qa_id, doc_id AS doc FROM qa_train WHERE doc_id IS NOT NULL
          UNION SELECT DISTINCT q.qa_id, c.doc_id FROM qa_train q JOIN chunks c ON q.chunk_id = c.id WHERE c.doc_id IS NOT NULL),
        sha AS (SELECT doc_id, lower(regexp_replace(sha256, '^\\s+|\\s+$', '', 'g')) AS s FROM documents WHERE sha256 IS NOT NULL),
        e AS (
          SELECT DISTINCT x.doc AS a, y.doc AS b FROM named x JOIN named y USING (qa_id)
          UNION SELECT x.doc_id, y.doc_id FROM sha x JOIN sha y USING (s) WHERE s <> ''),
        reach(a, b) AS (
          SELECT a, b FROM e
          UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
        low AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
        SELECT qa_id, min(coalesce(root, doc)) AS group_doc_id FROM named LEFT JOIN low ON named.doc = low.a GROUP BY qa_id""",
}
