"""The corpus operators' registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    align, chat, exact_dedup, hnsw, langid, lm, mixing, nn_descent, packing, secrets, simhash, toxicity, variants)

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, text, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM r),
l AS (SELECT *, cap / weight AS r,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
        sum(source_size) OVER () AS total FROM w),
v AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - held::DOUBLE) / free::DOUBLE AS level FROM l),
t AS (SELECT source, source_size,
        coalesce(least(cap::DOUBLE, max(CASE WHEN level <= r THEN level END) OVER () * weight), cap::DOUBLE) AS target
      FROM v),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d),
e AS (SELECT p.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken
FROM e
"""


@query("op1_source_mix", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"))
    thin = exact_dedup.digests(table(spark, sf_dir, "documents"))
    result = exact_dedup.dedup_batch(thin, index, "documents")
    index.close()
    return result.select("doc_id", "keep_id", "group_size", "kept",
                         F.lower(F.hex("digest")).alias("text_sha256"))


def _op4_spans(kind: str, no: int, pattern: str, least: int, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, rid, '{kind}' AS kind, {no} AS no, i,
         (list_sum(list_transform(pc[1:i], lambda x: length(x))) +
          coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s,
         length(m[i]) AS n, length(g[i]) AS gl
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, rid, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g,
                     string_split_regex(t, '{p}') AS pc FROM d)) WHERE length(g[i]) >= {least}"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_op4_spans(r.kind, i, r.pattern, r.least, r.group)
                          for i, r in enumerate(secrets.BASE_RULES))}),
a AS (SELECT rid, sum((kind = 'assign')::INT)::BIGINT AS n_assign, sum((kind = 'access')::INT)::BIGINT AS n_access,
             sum((kind = 'hex')::INT)::BIGINT AS n_hex,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


@query("op4_secret_ledger", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "blob-ledger"))
    found = secrets.scan_versions(
        docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"), ledger)
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                      x["end"].cast("string"))), ",")
    return (found.withColumn("spans", spans)
            .select(F.col("path").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"),
                    n("hex").alias("n_hex"), F.sha2("spans", 256).alias("base_sha256"), "spans"))


def preference_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference data from the given table: every conversation is chosen; its
    rejected twin answers the last assistant turn with the first assistant turn's
    text, or with nothing where that is the same turn. Conversations without an
    assistant have equal twins."""
    c = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    helper = F.col("role") == "assistant"
    ends = c.groupBy(F.struct(F.col("pair_id").alias("_p")).alias("_k")).agg(
        F.min(F.when(helper, F.struct("turn", F.col("text").alias("first_text")))).alias("f"),
        F.max(F.when(helper, F.col("turn"))).alias("last_turn"))
    twin = c.withColumn("_k", F.struct(F.col("pair_id").alias("_p"))).join(ends, "_k")
    text = F.when(helper & (F.col("turn") == F.col("last_turn")),
                  F.when(F.col("f.turn") < F.col("last_turn"), F.col("f.first_text")).otherwise(F.lit(""))
                  ).otherwise(F.col("text"))
    return c, twin.select("pair_id", "turn", "role", text.alias("text"))


OP5_SQL = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
e AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS ft, max(turn) FILTER (role = 'assistant') AS lt,
             arg_min(text, turn) FILTER (role = 'assistant') AS first_text FROM c GROUP BY 1),
b AS (SELECT conv_id, turn, role, text AS ct,
             CASE WHEN role = 'assistant' AND turn = lt THEN CASE WHEN ft < lt THEN first_text ELSE '' END ELSE text END AS rt
      FROM c JOIN e USING (conv_id)),
k AS (SELECT conv_id, min(turn) FILTER (ct <> rt) AS cut FROM b GROUP BY 1),
t AS (SELECT b.*, cut IS NULL OR turn < cut AS shared,
             '<|' || role || '|>' || chr(10) AS h, '<|end|>' || chr(10) AS z FROM b JOIN k USING (conv_id)),
m AS (SELECT *, CASE WHEN role = 'assistant' THEN '0:' || length(h) || ',1:' || (length(ct) + 8) ELSE '0:' || (length(h) + length(ct) + 8) END AS cm,
                CASE WHEN role = 'assistant' THEN '0:' || length(h) || ',1:' || (length(rt) + 8) ELSE '0:' || (length(h) + length(rt) + 8) END AS rm FROM t)
SELECT conv_id AS pair_id, 0::BIGINT AS part, count(*) FILTER (shared)::BIGINT AS prompt_turns,
  coalesce(string_agg(h || ct || z, '' ORDER BY turn) FILTER (shared), '') AS prompt,
  coalesce(string_agg(h || ct || z, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
  coalesce(string_agg(h || rt || z, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
  coalesce(string_agg(cm, ',' ORDER BY turn) FILTER (NOT shared), '') AS chosen_mask,
  coalesce(string_agg(rm, ',' ORDER BY turn) FILTER (NOT shared), '') AS rejected_mask,
  count(*) FILTER (NOT shared)::BIGINT AS n_chosen, count(*) FILTER (NOT shared)::BIGINT AS n_rejected
FROM m GROUP BY conv_id
"""


@query("op5_preference_format", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(*preference_pairs(table(spark, sf_dir, "conversations")))


def held_out() -> Column:
    return F.expr("coalesce(crc32(cast(doc_id AS string)) % 3 = 1, false)")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer's file, which every machine has at the same place."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def _op9_sql(order: int) -> str:
    """Leave-one-out scores with n-grams as space-joined words, up to ``order``."""
    ks = range(1, order + 1)
    lists = ", ".join(f"unnest(list_resize([]::VARCHAR[], least({j}, len(w))) || w[1:greatest(len(w) - {j}, 0)]) AS b{j}" for j in range(1, order))
    gram = lambda k: " || ' ' || ".join([f"b{j}" for j in range(k - 1, 0, -1)] + ["b0"])
    counts = ",\n".join(f"c{k} AS (SELECT g{k} AS g, count(*) AS n FROM g WHERE g{k} IS NOT NULL GROUP BY 1), "
                        f"o{k} AS (SELECT doc_id, g{k} AS g, count(*) AS n FROM g WHERE g{k} IS NOT NULL GROUP BY 1, 2)" for k in ks)
    joins = " ".join(f"LEFT JOIN c{k} ON c{k}.g = g.g{k} LEFT JOIN o{k} ON o{k}.g = g.g{k} AND o{k}.doc_id = g.doc_id" for k in ks)
    level = " ".join(f"WHEN r{k} > 0 THEN {k}" for k in reversed(ks))
    value = " ".join(f"WHEN {k} THEN ln(r{k}) - ln({f'p{k - 1}' if k > 1 else 'o'})" for k in reversed(ks))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS b0, {lists} FROM d WHERE len(w) > 0),
g AS MATERIALIZED (SELECT doc_id, i, {", ".join(f"{gram(k)} AS g{k}" for k in ks)} FROM t),
{counts},
s AS (SELECT count(*) AS n FROM g), sd AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
x AS MATERIALIZED (SELECT g.doc_id, g.i, greatest(s.n - sd.n, 1) AS o, {", ".join(f"coalesce(c{k}.n - o{k}.n, 0) AS r{k}" for k in ks)}
      FROM g JOIN sd ON sd.doc_id = g.doc_id CROSS JOIN s {joins}),
y AS (SELECT *, {", ".join(f"lag(r{k}) OVER (PARTITION BY doc_id ORDER BY i) AS p{k}" for k in ks)},
             least(i + 1, {order}) AS most, CASE {level} ELSE 0 END AS level FROM x),
v AS (SELECT doc_id, most, level, (most - level) * ln(0.4) + CASE level {value} ELSE -ln(o) END AS l FROM y),
a AS (SELECT doc_id, count(*) AS n, sum(l) AS l, sum((level < most)::INT) AS back, sum((level = 0)::INT) AS unseen FROM v GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(l, 0), 3) AS logprob, round(l / n, 5) AS score,
       coalesce(back, 0)::BIGINT AS backoffs, coalesce(unseen, 0)::BIGINT AS unseen
FROM documents LEFT JOIN a USING (doc_id)
"""


@query("op9_stupid_backoff", _op9_sql(lm.ORDER))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.lm_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("logprob", 3).alias("logprob"),
                         F.round("score", 5).alias("score"), "backoffs", "unseen")


@query("op8_hnsw")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                 tokenizer_path("piece_bpe_32k.model"))


OP12_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND list_count(v) = len(v) AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query("op12_embedding_near_dedup", OP12_SQL.replace("WITH e", "WITH RECURSIVE e", 1))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


#: The letters of a word as one byte each: those from U+00C0 on become other ASCII signs.
_HIGH = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not "a" <= c <= "z" and c != "'")[:len(_HIGH)]
_CRC_STEP = "xor({0} >> 8, t[((xor({0}, {1})) & 255) + 1])"
_CRC_2 = _CRC_STEP.format("(" + _CRC_STEP.format("a", "195") + ")", "(x - 64)")

OP13_SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
         lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) AS g(i)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z{_HIGH}]+')) AS w FROM documents) GROUP BY 1, 2),
h AS (SELECT w, c, xor(4294967295::BIGINT, list_reduce(
        [4294967295::BIGINT] || list_transform(string_split(d || ':' || w, ''), lambda y: unicode(y)::BIGINT),
        lambda a, x: CASE WHEN x < 128 THEN {_CRC_STEP.format("a", "x")} ELSE {_CRC_2} END)) AS h FROM runs, tab),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c
        FROM h),
words AS (SELECT word, sum(c)::BIGINT AS n, translate(word, '{_HIGH}', '{_SIGNS}') AS s FROM cut
          WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
keys AS (SELECT word, s, n, unnest([s] || list_transform(range(length(s)), lambda i: substr(s, 1, i::INT) || substr(s, i::INT + 2))) AS k
         FROM words),
near AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM keys a JOIN keys b USING (k)
         WHERE a.word <> b.word AND levenshtein(a.s, b.s) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
             CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at WHERE e.form IS NULL
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_forms(table(spark, sf_dir, "documents"))
