"""Conversation history, prompts, and answers without a language model. Models are called at the edge, never in a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.functions.text import HBLANK

SYSTEM_PROMPT = "Answer from the numbered passages only and cite them as [1], [2]. Say so when they do not hold the answer. Keep numbers, dates and names as written."
#: Instruction for the language of the answer (fixed values).
INSTRUCTIONS = {"hi": "Answer in Hindi, in Devanagari.", "hinglish": "Answer in Hinglish, in Latin letters.", "mixed": "Answer in the same mix of Hindi and English.", "en": "Answer in English."}
NOTHING = {"hi": "दस्तावेज़ों में इससे जुड़ा कुछ नहीं मिला।", "en": "Nothing relevant was found in the documents."}
HEADER = {"hi": "कोई भाषा मॉडल नहीं है; सबसे प्रासंगिक अंश ये हैं:", "en": "No language model is set; these are the most relevant passages:"}


def _strip(c):
    return F.regexp_replace(c, rf"^[{HBLANK}\n]+|[{HBLANK}\n]+$", "")


def clean_history(messages: DataFrame, max_turns: int = 6) -> DataFrame:
    """(conv_id, turn_no, role, content): user and assistant messages, neighbours of one role merged, the last 2 x max_turns,
    from the first user to the last assistant message. max_turns = 0 keeps all."""
    m = messages.select("conv_id", "turn", "role", _strip("content").alias("content")).where("role IN ('user', 'assistant') AND content <> ''")
    w = W.partitionBy("conv_id").orderBy("turn")
    m = m.withColumn("new", F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    m = m.groupBy("conv_id", "run", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n\n").alias("content"))
    back, whole = W.partitionBy("conv_id").orderBy(F.desc("run")), W.partitionBy("conv_id")
    if max_turns:
        m = m.withColumn("k", F.row_number().over(back)).where(F.col("k") <= 2 * max_turns).drop("k")
    m = m.withColumn("a", F.min(F.when(F.col("role") == "user", F.col("run"))).over(whole)).withColumn("b", F.max(F.when(F.col("role") == "assistant", F.col("run"))).over(whole))
    m = m.where("run >= a AND run <= b")
    return m.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("run")).cast("long").alias("turn_no"), "role", "content")


def rewrite_prompt(history: DataFrame, questions: DataFrame) -> DataFrame:
    """(conv_id, prompt) from the last four messages, 500 characters each, and the question."""
    last = history.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn_no")))).where("k <= 4")
    lines = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "role", "content"))), lambda x: F.concat(x["role"], F.lit(": "), F.substring(x["content"], 1, 500))), "\n").alias("t"))
    return questions.join(lines, "conv_id").select("conv_id", F.concat(F.lit("Conversation so far:\n"), "t", F.lit("\n\nLatest message: "), "question").alias("prompt"))


def rewritten(answer, question):
    """First line of a model's rewrite without outer blanks and quotes; the question if nothing is left."""
    line = F.regexp_extract(F.regexp_replace(_strip(answer), '^"+|"+$', ""), r"^([^\n\r]*)", 1)
    return F.coalesce(F.nullif(line, F.lit("")), question)


def passages(hits: DataFrame) -> DataFrame:
    """(query_id, passages): numbered passages in order of pos."""
    one = F.struct("pos", F.concat(F.lit("[{}] (source: "), F.coalesce("filename", F.lit("")), F.lit(", page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(")\n"), F.coalesce("text", F.lit(""))).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), F.substring(x["p"], 5, 1 << 30)))
    return hits.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("passages"))


def snippet(c, limit: int = 600):
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit), " [^ ]*$", ""), F.lit(" …")))


def no_llm_answer(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer): header and the first three passages, in Hindi only for questions labelled exactly hi."""
    h = hits.where("pos <= 3")
    one = F.struct("pos", F.concat(F.coalesce("filename", F.lit("")), F.lit(", p."), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("**\n"), snippet(F.coalesce("text", F.lit(""))), F.lit("\n")).alias("p"))
    lines = h.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x, i: F.concat(F.lit("**["), (i + 1).cast("string"), F.lit("] "), x["p"])), "\n").alias("lines"))
    hi = F.col("language") == "hi"
    pick = lambda d: F.when(hi, d["hi"]).otherwise(d["en"])
    return questions.join(lines, "query_id", "left").select("query_id", F.when(F.col("lines").isNull(), pick(NOTHING)).otherwise(F.concat(pick(HEADER), F.lit("\n\n"), "lines")).alias("answer"))


def answer_prompt(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, system, prompt) for (query_id, query, language)."""
    p = questions.join(passages(hits), "query_id", "left")
    lang = F.coalesce(*[F.when(F.col("language") == k, v) for k, v in INSTRUCTIONS.items()], F.lit(INSTRUCTIONS["en"]))
    return p.select("query_id", F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), lang).alias("system"), F.concat(F.lit("Passages:\n\n"), F.coalesce("passages", F.lit("(no relevant passages found)")), F.lit("\n\nQuestion: "), "query").alias("prompt"))


def citations(answer):
    """Distinct passage numbers that an answer cites, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
