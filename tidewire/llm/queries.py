"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import chat_format, decontaminate, exact_dedup, html_extract, jaccard_join, masked_lm, periodic_runs, pivot_search, prefix_trie, quality, sentencepiece_fst, substring_dedup, suffix_dedup
from tidewire.operators.graph import use_checkpoints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_checkpoints(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@register(
    "op1_chat_formatting",
    r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(text, '\', '\\')) + length(replace(role, '\', '\\'))
    + (SELECT sum(len(string_split(x, c)) - 1) FROM (SELECT unnest([text, role]) AS x), (SELECT unnest(['<s>', '</s>', '[INST]', '[/INST]']) AS c))
    + length('<s>[INST][/INST]</s>') + 1 AS w FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(w) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    out = chat_format.format_trees(chat_format.turns_as_tree(turns.unionByName(extra)), unique_ids=True)
    back = chat_format.read_back(F.col("formatted"))
    loss = chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select(F.col("tree").alias("conv_id"), back.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@register("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_windows(table(spark, sf_dir, "documents")).drop("kept")


@register(
    "op8_exact_dedup",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
g AS (SELECT s, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM d JOIN g USING (s)
""",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign_groups(table(spark, sf_dir, "documents"))


@register("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("kept", F.col("p_ge_2") >= quality.KEEP_AT)


@register("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents"))


@register("op7_masked_lm")
def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(table(spark, sf_dir, "documents"))


@register("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


@register("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


#: unsigned CRC-32 of a number's decimal form
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def crc(ident: str) -> Column:
    return F.crc32(F.col(ident).cast("string").cast("binary"))


@register(
    "op11_prefix_trie",
    f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC.format('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h UNION ALL SELECT conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
s AS (SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, d, turns[1:d] AS k, turns[d].text AS last, len(turns) = d AS ends FROM s, unnest(range(len(turns) + 1)) AS u(d)),
n AS (SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf,
  (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(last), ''), '[^\\x20\\x09-\\x0D]+')) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY k),
u AS (SELECT DISTINCT a.k AS k, b.k AS under FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d >= a.d),
v AS (SELECT u.k, count(*) FILTER (WHERE x.leaf) AS n_leaves, CAST(sum(x.own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE len(u.under) = len(u.k) + 1) AS n_children FROM u JOIN n x ON x.k = u.under GROUP BY u.k)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, v.n_children, v.n_leaves, v.saved_tokens, n.ends_sha256
FROM n JOIN v ON v.k = n.k LEFT JOIN n m ON n.depth > 0 AND m.k = n.k[1:n.depth - 1]
""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.digested(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    conversations = prefix_trie.written(prefix_trie.paths(*rebuilt(prefix_trie.written(turns))))
    nodes = prefix_trie.trie(conversations)
    ends = prefix_trie.digest_ids(prefix_trie.members(conversations))
    out = nodes.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ids_sha256", F.sha2(F.lit(""), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digested turns whose first h come from conversation c - c % 20, and the ids of all conversations."""
    convs = turns.select("conv_id").distinct()
    base, h = F.col("conv_id") - F.col("conv_id") % 20, crc("conv_id") % 4
    first = turns.filter("pos <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    borrowed = convs.filter("conv_id % 20 <> 0").select("conv_id", base.alias("base"), h.alias("h")).join(first, "base").filter("pos <= h")
    own = turns.filter((F.col("conv_id") % 20 == 0) | (F.col("pos") > h))
    return own.unionByName(borrowed.select(*own.columns)), convs


@register(
    "op12_pivot_search",
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
""",
)
def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pivot_search.top_k(pivot_search.quantised(vectors, "embedding", F.col("vec_id") % 20 == 0), 20)


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("m", longest)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("m.start").alias("start"), (-F.col("m.l")).alias("length"), F.col("m.period").alias("period"), F.expr("-m.l * 1000 div m.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the CRC of their id, repeat their words from some place on."""
    h = crc("doc_id")
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    some = docs.filter("h % 10 = 0").select("doc_id", words.alias("w"), "g").withColumn("n", F.size("w")).filter("n > 0")
    some = some.withColumn("a", F.col("g") % F.col("n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.array_join(F.expr("transform(sequence(0, n - 1), i -> w[cast(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS int)])"), " ")
    plain = docs.filter(F.coalesce(F.col("h") % 10 != 0, F.lit(True)) | ~F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    return some.select("doc_id", text.alias("text")).unionByName(plain.select("doc_id", "text"))
