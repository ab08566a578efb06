"""Registered queries, one per inventory row, each with its DuckDB oracle.

Every query reads the given tables (``part``, ``lineitem``, ``embeddings``)
or data Spark derives from them, whole. Doubles are rounded to 6 places in
both forms; every computed column carries the same alias in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories as cat_fn
from ..functions import phonetic as ph
from ..functions import pyregex as rx
from ..functions.normalize import TRAILING_MEASURE, TRAILING_PACK, py, trailing_measure_cut
from ..operators import batching as bt
from ..operators import charts as ch
from ..operators import extract as ex
from ..operators import results as res
from ..operators.cluster import ClusterConfig, adaptive_params, cluster_products, clustering_stats
from ..operators.embed import embed, read_embeddings
from ..operators import hierarchy, mst, pivots
from ..operators.neighbors import eps_pairs, kth_core_distances, mutual_reachability
from ..operators.prepare import IdentityConfig, dealt, process_products
from ..operators.sisters import sisters
from ..operators import tfidf
from ..session import saved
from ..sources.catalog import derive_catalog, read_table
from . import flows
from .oracle_views import (
    MESSY_COLUMNS, sql_codes, sql_match_rating, sql_soundex, with_catalog, with_messy, with_processed)

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = sql
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


# ----------------------------------------------------------------- extraction

@query("R1_catalog_extract", with_catalog(
    "SELECT brandSKUId, brandId, brandLabel, label, facets_jsonb, categoryLabel FROM extract"))
def r1(spark, d):
    return flows.products(spark, d)


@query("R2_active_filters", with_catalog("""
SELECT s.brandSKUId, s.brandId FROM sku s JOIN brand b ON s.brandId = b.brandId
WHERE s.isActive AND b.isActive"""))
def r2(spark, d):
    c = derive_catalog(spark, d)
    b = ex.active_brands(c.brand).select("brandId")
    return c.sku.filter(F.col("isActive")).join(b, "brandId").select("brandSKUId", "brandId")


@query("R3_linked_brands_only", with_catalog("""
SELECT brandId FROM brand WHERE brandId IN (SELECT brandId FROM seller_brand)"""))
def r3(spark, d):
    c = derive_catalog(spark, d)
    return ex.linked_brands_only(c.brand.select("brandId"), c.seller_brand)


_UNVERIFIED = "SELECT brandId AS processed_brand_ids FROM brand WHERE NOT isVerified"


def _unverified(c):
    return c.brand.filter(~F.col("isVerified")).select(F.col("brandId").alias("processed_brand_ids"))


@query("R4_exclude_ids", with_catalog(f"""
SELECT brandSKUId, brandId FROM extract WHERE brandId NOT IN ({_UNVERIFIED})"""))
def r4(spark, d):
    c = derive_catalog(spark, d)
    return ex.exclude_ids(ex.catalog_extract(c), _unverified(c)).select("brandSKUId", "brandId")


@query("R5_one_category_per_product", with_catalog("""
SELECT brandSKUId, categoryId FROM (
  SELECT sc.brandSKUId, sc.categoryId,
         ROW_NUMBER() OVER (PARTITION BY sc.brandSKUId ORDER BY sc.categoryId) AS rn
  FROM sku_category sc JOIN category c ON sc.categoryId = c.categoryId WHERE c.isActive) t
WHERE rn = 1"""))
def r5(spark, d):
    c = derive_catalog(spark, d)
    bridge = c.sku_category.join(c.category.filter("isActive").select("categoryId"), "categoryId", "left_semi")
    return ex.one_category_per_product(bridge)


@query("R6_distinct_products", with_catalog(
    "SELECT DISTINCT brandSKUId, brandId, brandLabel, label, facets_jsonb, categoryLabel FROM extract"))
def r6(spark, d):
    return ex.distinct_products(flows.products(spark, d))


@query("R7_filter_brands", with_catalog(f"""
SELECT brandSKUId, brandId FROM extract WHERE brandId IN ({_UNVERIFIED})"""))
def r7(spark, d):
    c = derive_catalog(spark, d)
    return ex.filter_brands(ex.catalog_extract(c), _unverified(c)).select("brandSKUId", "brandId")


_ROLLUP = """
SELECT b.brandId, b.brandLabel AS brandName, count(DISTINCT s.brandSKUId) AS product_count
FROM brand b JOIN sku s ON s.brandId = b.brandId
JOIN sku_category sc ON sc.brandSKUId = s.brandSKUId
JOIN category c ON c.categoryId = sc.categoryId
WHERE b.isActive AND (b.isTest = false OR b.isTest IS NULL) AND s.isActive AND c.isActive
  AND EXISTS (SELECT 1 FROM seller_brand sb WHERE sb.brandId = b.brandId) {extra}
GROUP BY b.brandId, b.brandLabel HAVING count(DISTINCT s.brandSKUId) > 0"""


@query("R8_brand_rollup", with_catalog(_ROLLUP.format(extra="")))
def r8(spark, d):
    return ex.brand_rollup(derive_catalog(spark, d))


@query("R9_exclude_test_brands", with_catalog(
    "SELECT brandId FROM brand WHERE isTest = false OR isTest IS NULL"))
def r9(spark, d):
    return ex.exclude_test_brands(derive_catalog(spark, d).brand).select("brandId")


@query("R10_exclude_listed_brands", with_catalog(_ROLLUP.format(extra=f"AND b.brandId NOT IN ({_UNVERIFIED})")))
def r10(spark, d):
    c = derive_catalog(spark, d)
    return ex.brand_rollup(c, exclude=_unverified(c))


@query("R11_verified_brands", with_catalog("""
SELECT DISTINCT brandId, coalesce(brandLabel, CAST(brandId AS VARCHAR)) AS brandLabel FROM brand
WHERE isActive AND isVerified AND brandId IN (SELECT brandId FROM seller_brand)"""))
def r11(spark, d):
    return ex.verified_brands(derive_catalog(spark, d))


@query("R12_order_products", with_catalog("SELECT brandSKUId, brandId FROM extract"))
def r12(spark, d):
    return ex.order_products(flows.products(spark, d)).select("brandSKUId", "brandId")


@query("R13_extract_flags", with_catalog("""
SELECT e.brandSKUId, e.brandId FROM extract e JOIN brand b ON e.brandId = b.brandId
WHERE b.isVerified AND e.facets_jsonb IS NOT NULL"""))
def r13(spark, d):
    return ex.catalog_extract(derive_catalog(spark, d), verified_only=True, facets_not_null=True) \
        .select("brandSKUId", "brandId")


# ------------------------------------------------------------- normalization

@query("N1_trailing_measure_cut", with_processed("SELECT brandSKUId, _n1 AS cut FROM n1d"))
def n1(spark, d):
    return flows.products(spark, d).select("brandSKUId", trailing_measure_cut(F.col("label")).alias("cut"))


@query("N2_N3_trailing_unit_and_pack", with_processed("""
SELECT brandSKUId, regexp_replace(regexp_replace(regexp_replace(_n1,
      '(?i)\\s+\\d+\\s*(g|gm|gms|gram|grams|kg|ml|l|ltr|ltrs|liter|liters|oz|lb|lbs|pound|pounds)\\s*$', ''),
      '(?i)\\s+\\((box|pack|packet|pouch|bag|tin|can|jar|bottle)\\)\\s*$', ''),
      '(?i)\\s+(box|pack|packet|pouch|bag|tin|can|jar|bottle)\\s*$', '') AS trimmed FROM n1d"""))
def n2(spark, d):
    c = trailing_measure_cut(F.col("label"))
    c = F.regexp_replace(c, py(TRAILING_MEASURE, True), "")
    for p in TRAILING_PACK:
        c = F.regexp_replace(c, py(p, True), "")
    return flows.products(spark, d).select("brandSKUId", c.alias("trimmed"))


@query("N13_normalize_name", with_processed("SELECT brandSKUId, normalized_name FROM processed"))
def n13(spark, d):
    return flows.processed(spark, d).select("brandSKUId", "normalized_name")


# --------------------------------------------------- categories / identity

@query("F2_brand_from_facets", with_processed("SELECT brandSKUId, brand_extracted FROM processed"))
def f2(spark, d):
    return flows.processed(spark, d).select("brandSKUId", "brand_extracted")


@query("F3_F5_parse_categories", with_processed(
    "SELECT brandSKUId, categories_parsed, primary_category FROM identity"))
def f3(spark, d):
    return flows.processed(spark, d).select("brandSKUId", "categories_parsed", "primary_category")


@query("F6_facets_identity", with_processed("""
, fx AS (
  SELECT brandSKUId, cats, categoryLabel,
    list_transform(json_keys(facets_jsonb), lambda k: {'k': k, 'v': json_extract(facets_jsonb, '$."' || k || '"')}) AS kv
  FROM identity),
parts AS (
  SELECT brandSKUId, cats, categoryLabel, list_filter(list_transform(kv, lambda e:
    CASE json_type(e.v)
      WHEN 'VARCHAR' THEN CASE WHEN trim(json_extract_string(e.v, '$')) <> ''
             AND lower(trim(json_extract_string(e.v, '$'))) NOT IN ('n/a', 'null', 'none')
           THEN e.k || ':' || regexp_replace(trim(json_extract_string(e.v, '$')), '^[❌✅]\\s*', '') END
      WHEN 'ARRAY' THEN CASE WHEN len(list_filter(list_transform(CAST(json_extract_string(e.v, '$[*]') AS VARCHAR[]),
               lambda x: regexp_replace(trim(x), '^[❌✅]\\s*', '')), lambda x: x <> '' AND lower(x) NOT IN ('n/a', 'null', 'none'))) > 0
           THEN e.k || ':' || array_to_string(list_filter(list_transform(CAST(json_extract_string(e.v, '$[*]') AS VARCHAR[]),
               lambda x: regexp_replace(trim(x), '^[❌✅]\\s*', '')), lambda x: x <> '' AND lower(x) NOT IN ('n/a', 'null', 'none')), ' ') END
      WHEN 'BIGINT' THEN e.k || ':' || json_extract_string(e.v, '$')
      WHEN 'DOUBLE' THEN e.k || ':' || json_extract_string(e.v, '$')
    END), lambda x: x IS NOT NULL) AS ps
  FROM fx)
SELECT brandSKUId, coalesce(nullif(lower(trim(array_to_string(
  CASE WHEN coalesce(categoryLabel, '') <> '' THEN list_concat(['category:' || array_to_string(cats, ' ')], ps) ELSE ps END,
  ' | '))), ''), 'unknown product') AS core_identity
FROM parts"""))
def f6(spark, d):
    return flows.processed(spark, d, IdentityConfig(use_facets=True)).select("brandSKUId", "core_identity")


@query("F7_core_identity", with_processed("SELECT brandSKUId, core_identity FROM identity"))
def f7(spark, d):
    return flows.processed(spark, d).select("brandSKUId", "core_identity")


@query("F8_simple_identity", with_processed("""
SELECT brandSKUId, coalesce(nullif(lower(trim(concat_ws(' | ', nullif(trim(brand_extracted), ''),
  nullif(trim(primary_category), '')))), ''), 'unknown product') AS core_identity FROM identity"""))
def f8(spark, d):
    return flows.processed(spark, d, IdentityConfig(simple_identity=True)).select("brandSKUId", "core_identity")


@query("F11_row_status", with_processed("SELECT brandSKUId, 'ok' AS row_status FROM identity"))
def f11(spark, d):
    return flows.processed(spark, d).select("brandSKUId", "row_status")


@query("V2_clean_identities", with_processed("SELECT brandSKUId, trim(core_identity) AS identity FROM identity"))
def v2(spark, d):
    from ..functions.identity import clean_identity
    return flows.processed(spark, d).select("brandSKUId", clean_identity(F.col("core_identity")).alias("identity"))


# ------------------------------------------------------------------ phonetics

@query("P1_phonetic_tokens", with_processed("""
SELECT brandSKUId, array_to_string(list_filter(
  regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(core_identity),
    '[^\\w\\s]', ' ', 'g'), '\\d+', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+'),
  lambda w: length(w) >= 3), ' ') AS tokens
FROM identity"""))
def p1(spark, d):
    return flows.processed(spark, d).select("brandSKUId", F.array_join(ph.tokens(F.col("core_identity")), " ")
                                            .alias("tokens"))


@query("P2_soundex", with_processed(
    f"SELECT brandSKUId, array_to_string({sql_codes('core_identity', sql_soundex)}, ' ') AS codes FROM identity"))
def p2(spark, d):
    return flows.processed(spark, d).select("brandSKUId", ph.encode(F.col("core_identity"), "soundex").alias("codes"))


@query("P3_metaphone")
def p3(spark, d):
    return flows.processed(spark, d).select("brandSKUId", ph.encode(F.col("core_identity"), "metaphone").alias("codes"))


@query("P4_nysiis")
def p4(spark, d):
    return flows.processed(spark, d).select("brandSKUId", ph.encode(F.col("core_identity"), "nysiis").alias("codes"))


@query("P5_match_rating_codex", with_processed(
    f"SELECT brandSKUId, array_to_string({sql_codes('core_identity', sql_match_rating)}, ' ') AS codes FROM identity"))
def p5(spark, d):
    return flows.processed(spark, d).select(
        "brandSKUId", ph.encode(F.col("core_identity"), "match_rating_codex").alias("codes"))


@query("P6_label_codes", with_processed(
    f"SELECT brandSKUId, array_to_string({sql_codes('label', sql_match_rating)}, ' ') AS codes FROM identity"))
def p6(spark, d):
    return dealt(flows.products(spark, d).select("brandSKUId", "label")).select(
        "brandSKUId", ph.encode(F.col("label"), "match_rating_codex").alias("codes"))


_RAW_IDENTITY = "concat_ws(' | ', nullif(trim(normalized_name), ''), nullif(trim(cats[1]), ''))"


@query("F9_phonetic_suffix", with_processed(f"""
SELECT brandSKUId, CASE WHEN raw <> '' AND len(codes) > 0
  THEN lower(trim(raw || ' | PHONETIC:' || array_to_string(codes, ' '))) ELSE core_identity END AS core_identity
FROM (SELECT *, {_RAW_IDENTITY} AS raw, {sql_codes(_RAW_IDENTITY, sql_soundex)} AS codes FROM identity)"""))
def f9(spark, d):
    return flows.processed(spark, d, IdentityConfig(phonetic="soundex")).select("brandSKUId", "core_identity")


@query("P7_phonetic_similarity", with_processed(f""",
coded AS (SELECT brandId, brandSKUId, cluster_id, list_distinct({sql_codes('label', sql_soundex)}) AS c FROM detailed),
rep AS (SELECT brandId, cluster_id, min(brandSKUId) AS r FROM detailed WHERE cluster_id >= 0 GROUP BY 1, 2)
SELECT a.brandId, a.brandSKUId, rep.r AS sisterProductId,
  CASE WHEN len(a.c) = 0 OR len(b.c) = 0 THEN 0.0
    ELSE round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) END::DOUBLE AS similarity
FROM coded a JOIN rep ON rep.brandId = a.brandId AND rep.cluster_id = a.cluster_id
JOIN coded b ON b.brandId = a.brandId AND b.brandSKUId = rep.r"""))
def p7(spark, d):
    """Similarity of each clustered SKU's codes to its cluster representative's."""
    det = flows.identity_detailed(spark, d)
    codes = det.select("brandId", "brandSKUId", "cluster_id",
                       ph.encode(F.col("label"), "soundex").alias("codes"))
    reps = res.representatives(det).select("brandId", "brandSKUId", "sisterProductId")
    rc = codes.select(F.col("brandSKUId").alias("sisterProductId"), F.col("codes").alias("rep_codes"))
    return (reps.join(codes.select("brandSKUId", "codes"), "brandSKUId").join(rc, "sisterProductId")
            .select("brandId", "brandSKUId", "sisterProductId",
                    _r6(ph.similarity(F.col("codes"), F.col("rep_codes"))).alias("similarity")))


@query("P7_sister_products", with_processed(f""",
coded AS (SELECT brandId, brandSKUId, list_distinct({sql_codes('label', sql_soundex)}) AS c FROM identity),
pairs AS (
  SELECT a.brandSKUId AS k, len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c))) AS s
  FROM coded a JOIN coded b ON a.brandId = b.brandId AND a.brandSKUId <> b.brandSKUId AND len(a.c) > 0 AND len(b.c) > 0)
SELECT coded.brandId, coded.brandSKUId, CASE WHEN len(c) > 0 THEN min(coded.brandSKUId) OVER (
    PARTITION BY coded.brandId, list_sort(c)) END AS class_id,
  coalesce(n, 0)::BIGINT AS n_sisters, round(top, 6) AS top_similarity
FROM coded LEFT JOIN (SELECT k, count(*) AS n, max(s) AS top FROM pairs WHERE s >= 0.5 GROUP BY k) ON k = coded.brandSKUId"""))
def p7_sisters(spark, d):
    """All products of a brand whose label codes are at least half the same."""
    coded = flows.products(spark, d).select("brandId", "brandSKUId", ph.encode(F.col("label"), "soundex").alias("codes"))
    return sisters(coded, 0.5).withColumn("top_similarity", _r6(F.col("top_similarity")))


# ------------------------------------------------------------- messy input

def _messy(spark, d):
    rows = read_table(spark, d, "part").selectExpr(*[f"{e} AS {c}" for c, e in MESSY_COLUMNS.items()])
    return process_products(rows)


@query("N13_normalize_messy", with_messy("SELECT brandSKUId, normalized_name FROM messy"))
def n13_messy(spark, d):
    return _messy(spark, d).select("brandSKUId", "normalized_name")


@query("F4_F12_identity_messy", with_messy("""
SELECT brandSKUId, core_identity, categories_parsed, primary_category, brand_extracted FROM messy"""))
def f_messy(spark, d):
    return _messy(spark, d).select("brandSKUId", "core_identity", "categories_parsed", "primary_category",
                                   "brand_extracted")


@query("F11_row_status_messy", with_messy("""
SELECT brandId, row_status, count(*) AS n, count(DISTINCT core_identity) AS identities FROM messy GROUP BY 1, 2"""))
def f11_messy(spark, d):
    return _messy(spark, d).groupBy("brandId", "row_status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("core_identity").alias("identities"))


@query("P1_document_tokens", r"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    lower(coalesce(text, '')), '[^\p{L}\p{N}_\s\p{Z}\x{85}\x{0B}\x{1c}-\x{1f}]', ' ', 'g'), '\p{Nd}+', '', 'g'),
    '[\s\p{Z}\x{85}\x{0B}\x{1c}-\x{1f}]+', ' ', 'g'), '^ | $', '', 'g'), ' '),
    lambda w: length(w) >= 3) AS t FROM documents)""")
def p1_documents(spark, d):
    t = ph.tokens(F.coalesce("text", F.lit("")))
    return (read_table(spark, d, "documents").select("doc_id", t.alias("t"))
            .select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5")))


# ----------------------------------------------------------- embeddings / C

_EMB = """
emb AS (SELECT CAST(label AS VARCHAR) AS brandId, vec_id AS brandSKUId, CAST(embedding AS DOUBLE[]) AS v
        FROM embeddings),
pairs AS (
  SELECT a.brandId, a.brandSKUId AS a, b.brandSKUId AS b, list_distance(a.v, b.v) AS d
  FROM emb a JOIN emb b ON a.brandId = b.brandId AND a.brandSKUId < b.brandSKUId
  WHERE list_distance(a.v, b.v) <= {eps}),
both_dir AS (SELECT brandId, a, b, d FROM pairs UNION ALL SELECT brandId, b, a, d FROM pairs),
cores AS (SELECT brandId, a AS id, d AS core FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY brandId, a ORDER BY d, b) AS rn FROM both_dir) t WHERE rn = {ms}),
mr AS (
  SELECT p.brandId, p.a, p.b, greatest(ca.core, cb.core, p.d) AS mr FROM pairs p
  JOIN cores ca ON ca.brandId = p.brandId AND ca.id = p.a
  JOIN cores cb ON cb.brandId = p.brandId AND cb.id = p.b
  WHERE greatest(ca.core, cb.core, p.d) <= {eps}),
edges AS (SELECT a AS u, b AS v FROM mr UNION ALL SELECT b, a FROM mr),
reach(node, root) AS (
  SELECT u, u FROM edges
  UNION
  SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
members AS (SELECT e.brandId, c.node AS brandSKUId, c.root FROM comp c JOIN emb e ON e.brandSKUId = c.node),
big AS (SELECT brandId, root FROM members GROUP BY brandId, root HAVING count(*) >= {mcs}),
ids AS (SELECT brandId, root, CAST(dense_rank() OVER (PARTITION BY brandId ORDER BY root) - 1 AS INTEGER) AS cid FROM big),
assigned AS (
  SELECT e.brandId, e.brandSKUId, CAST(coalesce(i.cid, -1) AS INTEGER) AS cluster_id
  FROM emb e LEFT JOIN members m ON m.brandSKUId = e.brandSKUId
  LEFT JOIN ids i ON i.brandId = m.brandId AND i.root = m.root)
"""


def _emb_sql(body: str, eps: float, ms: int, mcs: int = 2) -> str:
    return "WITH RECURSIVE " + _EMB.format(eps=eps, ms=ms, mcs=mcs).strip() + "\n" + body


@query("S7_read_embeddings", "SELECT vec_id AS brandSKUId, len(embedding) AS dims FROM embeddings")
def s7(spark, d):
    v = read_embeddings(read_table(spark, d, "embeddings"))
    return v.select("brandSKUId", F.size("embedding").alias("dims"))


@query("C1_pair_distances", _emb_sql("SELECT brandId, a, b, round(d, 6) AS d FROM pairs", 1.2, 1))
def c1(spark, d):
    p = eps_pairs(flows.embedding_points(spark, d), 1.2)
    return p.select("brandId", "a", "b", _r6(F.col("d")).alias("d"))


#: Every point's exact k-th distance, over all pairs of its brand.
_ALL_PAIRS = """
emb AS (SELECT CAST(label AS VARCHAR) AS brandId, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
allp AS (SELECT a.brandId, a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d
  FROM emb a JOIN emb b ON a.brandId = b.brandId AND a.id < b.id),
cores AS (SELECT brandId, a AS id, d AS core FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY brandId, a ORDER BY d, b) AS rn
  FROM (SELECT brandId, a, b, d FROM allp UNION ALL SELECT brandId, b, a, d FROM allp)) t WHERE rn = {ms}),
mrp AS (SELECT *, ROW_NUMBER() OVER (ORDER BY w, a, b) AS e FROM (
  SELECT p.brandId, p.a, p.b, p.d, greatest(ca.core, cb.core, p.d) AS w FROM allp p
  JOIN cores ca ON ca.brandId = p.brandId AND ca.id = p.a
  JOIN cores cb ON cb.brandId = p.brandId AND cb.id = p.b))
"""


@query("C2_core_distance", "WITH " + _ALL_PAIRS.format(ms=3).strip() +
       " SELECT brandId, id, round(core, 6) AS core FROM cores")
def c2(spark, d):
    return kth_core_distances(flows.embedding_points(spark, d), 3).select("brandId", "id", _r6(F.col("core")).alias("core"))


@query("C3_mutual_reachability", "WITH " + _ALL_PAIRS.format(ms=3).strip() +
       " SELECT brandId, a, b, round(w, 6) AS mr FROM mrp WHERE d <= 1.25")
def c3(spark, d):
    e = mutual_reachability(flows.embedding_points(spark, d), 1.25, 3)
    return e.select("brandId", "a", "b", _r6(F.col("mr")).alias("mr"))


#: Boruvka rounds and levels of the selection that the SQL below writes out.
_TREE_ROUNDS, _LEVELS = 9, 16
_MIN_SAMPLES, _MIN_CLUSTER, _TREE_EPS = 3, 3, 1.12


def _tree_sql() -> str:
    """The minimum spanning trees, round by round, over all pairs."""
    parts = ["c0 AS (SELECT id AS v, id AS c FROM emb)"]
    for i in range(_TREE_ROUNDS):
        chosen = " UNION ALL ".join(f"SELECT a, b FROM t{j}" for j in range(i + 1))
        parts.append(f"""
x{i} AS (SELECT m.e, m.a, m.b, p.c AS c1, q.c AS c2 FROM mrp m JOIN c{i} p ON p.v = m.a JOIN c{i} q ON q.v = m.b WHERE p.c <> q.c),
t{i} AS MATERIALIZED (SELECT DISTINCT m.* FROM mrp m JOIN (
  SELECT min(e) AS e FROM (SELECT c1 AS c, e FROM x{i} UNION ALL SELECT c2, e FROM x{i}) GROUP BY c) k ON k.e = m.e),
u{i} AS (SELECT a AS p, b AS q FROM ({chosen}) UNION ALL SELECT b, a FROM ({chosen})),
r{i}(v, c) AS (SELECT id, id FROM emb UNION SELECT u.q, r.c FROM r{i} r JOIN u{i} u ON u.p = r.v),
c{i + 1} AS MATERIALIZED (SELECT v, min(c) AS c FROM r{i} GROUP BY v)""")
    union = " UNION ALL ".join(f"SELECT brandId, e, a, b, w FROM t{i}" for i in range(_TREE_ROUNDS))
    return ("WITH RECURSIVE " + _ALL_PAIRS.format(ms=_MIN_SAMPLES).strip() + ", " + ",".join(parts) +
            f", tree AS MATERIALIZED (SELECT DISTINCT * FROM ({union}))")


def _condensed_sql() -> str:
    """Merge tree by reachability along lighter edges; condensed clusters; stabilities."""
    m = _MIN_CLUSTER
    return _tree_sql() + f""",
k(e, v) AS (SELECT e, a FROM tree UNION SELECT e, b FROM tree
  UNION SELECT k.e, CASE WHEN f.a = k.v THEN f.b ELSE f.a END FROM k JOIN tree f ON f.e <= k.e AND (f.a = k.v OR f.b = k.v)),
node AS (SELECT e AS id, count(DISTINCT v) AS size,
    (SELECT min(f.e) FROM tree f JOIN k k2 ON k2.v IN (f.a, f.b) WHERE k2.e = k.e AND f.e > k.e) AS parent FROM k GROUP BY e
  UNION ALL SELECT -1 - id, 1, (SELECT min(e) FROM tree WHERE id IN (a, b)) FROM emb WHERE id IN (SELECT id FROM cores)),
full_ AS MATERIALIZED (SELECT n.*, 1 / f.w AS up FROM node n LEFT JOIN tree f ON f.e = n.parent),
split_ AS (SELECT parent FROM full_ WHERE size >= {m} AND parent IS NOT NULL GROUP BY parent HAVING count(*) = 2),
head AS MATERIALIZED (SELECT * FROM full_ WHERE size >= {m} AND (parent IS NULL OR parent IN (SELECT parent FROM split_))),
up(id, pos) AS (SELECT id, id FROM full_
  UNION SELECT u.id, f.parent FROM up u JOIN full_ f ON f.id = u.pos WHERE f.parent IS NOT NULL AND u.pos NOT IN (SELECT id FROM head)),
lab AS MATERIALIZED (SELECT id, pos AS c FROM up WHERE pos IN (SELECT id FROM head)),
clu AS MATERIALIZED (SELECT h.id AS c, h.size, l.c AS parent, coalesce(h.up, 0) AS birth FROM head h LEFT JOIN lab l ON l.id = h.parent),
stab AS MATERIALIZED (SELECT c.c, c.size, c.parent, c.birth, coalesce(s.s, 0) AS stability FROM clu c LEFT JOIN (
  SELECT l.c, sum(f.size * (f.up - c2.birth)) AS s FROM full_ f JOIN full_ p ON p.id = f.parent AND p.size >= {m}
  JOIN lab l ON l.id = f.parent JOIN clu c2 ON c2.c = l.c
  WHERE f.size < {m} OR f.id IN (SELECT id FROM head) GROUP BY l.c) s ON s.c = c.c)"""


def _labels_sql() -> str:
    levels = ["s0 AS (SELECT c, parent, stability, stability AS total FROM stab WHERE parent IS NOT NULL)"]
    for i in range(_LEVELS):
        levels.append(f"s{i + 1} AS MATERIALIZED (SELECT s.c, s.parent, s.stability, greatest(s.stability, coalesce(k.t, s.stability)) AS total "
                      f"FROM s{i} s LEFT JOIN (SELECT parent AS c, sum(total) AS t FROM s{i} GROUP BY 1) k ON k.c = s.c)")
    e = _TREE_EPS
    return _condensed_sql() + ", " + ",\n".join(levels) + f""",
best AS (SELECT s.c, s.parent FROM s{_LEVELS} s LEFT JOIN (SELECT parent AS c, sum(total) AS t FROM s{_LEVELS} GROUP BY 1) k ON k.c = s.c
  WHERE k.t IS NULL OR s.stability >= k.t),
anc(c, a) AS (SELECT c, parent FROM clu WHERE parent IS NOT NULL
  UNION SELECT x.c, p.parent FROM anc x JOIN clu p ON p.c = x.a WHERE p.parent IS NOT NULL),
eom AS MATERIALIZED (SELECT c FROM best WHERE c NOT IN (SELECT x.c FROM anc x JOIN best b ON b.c = x.a)),
climb(c, pos) AS (SELECT e.c, e.c FROM eom e JOIN clu ON clu.c = e.c
  UNION SELECT x.c, p.parent FROM climb x JOIN clu p ON p.c = x.pos JOIN clu g ON g.c = p.parent
  WHERE g.parent IS NOT NULL AND 1 / p.birth <= {e} AND (x.pos <> x.c OR 1 / p.birth < {e})),
fin AS MATERIALIZED (SELECT DISTINCT arg_max(x.pos, n.size) AS c FROM climb x JOIN clu n ON n.c = x.pos GROUP BY x.c),
home AS (SELECT l.id, l.c AS pos, l.c AS c0 FROM lab l WHERE l.id < 0),
sel AS (SELECT h.id, min(CASE WHEN f.c IS NOT NULL THEN f.c END) AS c FROM (
  SELECT id, c0 AS pos FROM home UNION SELECT h.id, x.a FROM home h JOIN anc x ON x.c = h.c0) h LEFT JOIN fin f ON f.c = h.pos GROUP BY h.id),
mem AS (SELECT e.brandId, e.id AS brandSKUId, s.c FROM emb e LEFT JOIN sel s ON s.id = -1 - e.id),
roots AS (SELECT brandId, c, min(brandSKUId) AS root FROM mem WHERE c IS NOT NULL GROUP BY ALL),
ids AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY brandId ORDER BY root) - 1 AS INTEGER) AS cid FROM roots)
SELECT m.brandId, m.brandSKUId, CAST(coalesce(i.cid, -1) AS INTEGER) AS cluster_id
FROM mem m LEFT JOIN ids i ON i.brandId = m.brandId AND i.c = m.c"""


def _trees(spark, d):
    index = pivots.build(flows.embedding_points(spark, d), "brandId", "brandSKUId", "embedding")
    cores = saved(pivots.kth_distances(index, _MIN_SAMPLES))
    return index, cores, saved(mst.spanning_trees(index, cores))


@query("C5_spanning_tree", _tree_sql() + " SELECT brandId, a, b, round(w, 6) AS w FROM tree")
def c5_tree(spark, d):
    index, _, edges = _trees(spark, d)
    name = lambda vid, key: index.points.select(F.col("vid").alias(vid), F.col("key").alias(key))
    brand = index.points.select(F.col("vid").alias("lo"), F.col("g").alias("brandId"))
    return (edges.join(brand, "lo").join(name("lo", "a"), "lo").join(name("hi", "b"), "hi")
            .select("brandId", "a", "b", _r6(F.col("w")).alias("w")))


@query("C5_condensed_tree", _condensed_sql() + """
SELECT size::BIGINT AS size, round(birth, 6) AS birth, round(stability, 6) AS stability, parent IS NULL AS top FROM stab""")
def c5_condensed(spark, d):
    index, cores, edges = _trees(spark, d)
    tree = hierarchy.merge_tree(edges, index.points.join(cores, "vid"))
    clusters, _ = hierarchy.condensed(tree, cores, _MIN_CLUSTER)
    return clusters.select("size", _r6(F.col("birth")).alias("birth"), _r6(F.col("stability")).alias("stability"),
                           F.col("parent").isNull().alias("top"))


@query("C5_hdbscan_clusters", _labels_sql())
def c5(spark, d):
    cfg = ClusterConfig(method="hdbscan", min_samples=_MIN_SAMPLES, min_cluster_size=_MIN_CLUSTER, epsilon=_TREE_EPS)
    return cluster_products(flows.embedding_points(spark, d), cfg)


@query("C4_density_clusters", _emb_sql("SELECT brandId, brandSKUId, cluster_id FROM assigned", 1.2, 1))
def c4(spark, d):
    return flows.embedding_clusters(spark, d, 1.2, 1)


@query("C4_density_clusters_ms3", _emb_sql("SELECT brandId, brandSKUId, cluster_id FROM assigned", 1.25, 3))
def c4b(spark, d):
    return flows.embedding_clusters(spark, d, 1.25, 3)


@query("C6_C7_adaptive_params", """
SELECT CAST(label AS VARCHAR) AS brandId, count(*) AS n,
  CASE WHEN count(*) > 2000 THEN 'kmeans' ELSE 'density' END AS route,
  CASE WHEN count(*) > 1000 THEN 5 ELSE 2 END AS min_cluster_size,
  CASE WHEN count(*) > 1000 THEN 3 ELSE 1 END AS min_samples,
  CASE WHEN count(*) > 1000 THEN 'manhattan' ELSE 'euclidean' END AS metric,
  CAST(least(greatest(count(*) // 20, 10), 100, count(*)) AS INTEGER) AS k
FROM embeddings GROUP BY label""")
def c6(spark, d):
    p = adaptive_params(flows.embedding_points(spark, d), ClusterConfig())
    return p.select("brandId", "n", "route", F.col("_mcs").alias("min_cluster_size"),
                    F.col("_ms").alias("min_samples"), F.col("_metric").alias("metric"), "k")


@query("C8_kmeans_clusters")
def c8(spark, d):
    return flows.embedding_clusters(spark, d, 0.1, 1, method="kmeans")


#: Rounds that the SQL below writes out; further rounds change nothing once it has converged.
_LLOYD_ROUNDS = 24


def _lloyd_sql() -> str:
    """One start from the smallest ids; every round reassigns and averages."""
    rounds = []
    for i in range(_LLOYD_ROUNDS):
        rounds.append(f"""
a{i} AS MATERIALIZED (SELECT e.brandId, e.brandSKUId, any_value(e.v) AS v,
    arg_min(c.cid, struct_pack(d := list_distance(e.v, c.c), c := c.cid)) AS cid
  FROM emb e JOIN c{i} c ON c.brandId = e.brandId GROUP BY e.brandId, e.brandSKUId),
x{i} AS (SELECT brandId, cid, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{i}),
m{i} AS (SELECT brandId, cid, list(x ORDER BY i) AS c FROM (
  SELECT brandId, cid, i, avg(x) AS x FROM x{i} GROUP BY ALL) GROUP BY brandId, cid),
c{i + 1} AS MATERIALIZED (SELECT c.brandId, c.cid, coalesce(m.c, c.c) AS c FROM c{i} c
  LEFT JOIN m{i} m ON m.brandId = c.brandId AND m.cid = c.cid)""")
    return f"""
WITH emb AS (SELECT CAST(label AS VARCHAR) AS brandId, vec_id AS brandSKUId, CAST(embedding AS DOUBLE[]) AS v
             FROM embeddings),
c0 AS MATERIALIZED (SELECT brandId, cid, v AS c FROM (
  SELECT brandId, v, CAST(row_number() OVER (PARTITION BY brandId ORDER BY brandSKUId) - 1 AS INTEGER) AS cid,
         count(*) OVER (PARTITION BY brandId) AS n FROM emb)
  WHERE cid < least(greatest(n // 20, 10), 100, n)),{",".join(rounds)}
SELECT brandId, brandSKUId, cid AS cluster_id FROM a{_LLOYD_ROUNDS - 1}"""


@query("C8_kmeans_first_seeds", _lloyd_sql())
def c8_first(spark, d):
    cfg = ClusterConfig(method="kmeans", kmeans_n_init=1, kmeans_seeding="first")
    return cluster_products(flows.embedding_points(spark, d), cfg)


@query("C9_clustering_stats", _emb_sql("""
SELECT brandId, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters,
  sum(CASE WHEN cluster_id = -1 THEN 1 ELSE 0 END) AS n_noise,
  sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS n_clustered
FROM assigned GROUP BY brandId""", 1.2, 1))
def c9(spark, d):
    return clustering_stats(flows.embedding_clusters(spark, d, 1.2, 1))


@query("V1_embed_hashed")
def v1(spark, d):
    pts = embed(flows.processed(spark, d), "hashed")
    return pts.select("brandSKUId", F.size("embedding").alias("dims"),
                      _r6(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))


@query("V1_tfidf_weights", with_processed(r""",
words AS (SELECT brandId, brandSKUId, unnest(regexp_split_to_array(lower(CASE WHEN trim(core_identity) = ''
  THEN 'unknown product' ELSE trim(core_identity) END), '[^\p{L}\p{N}_]+')) AS term FROM identity),
tf AS (SELECT brandId, brandSKUId, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL),
df AS (SELECT brandId, term, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT brandId, count(DISTINCT brandSKUId) AS n FROM identity GROUP BY ALL),
raw AS (SELECT brandId, brandSKUId, ('0x' || substr(md5(term), 1, 8))::BIGINT % 384 AS bucket,
  sum(tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1)) AS w
  FROM tf JOIN df USING (brandId, term) JOIN n USING (brandId) GROUP BY ALL)
SELECT brandId, brandSKUId, bucket::INT AS bucket,
  round(w / sqrt(sum(w * w) OVER (PARTITION BY brandId, brandSKUId)), 6) AS weight FROM raw"""))
def v1_tfidf(spark, d):
    rows = tfidf.terms(flows.processed(spark, d))
    return tfidf.weights(rows, tfidf.frequencies(rows)).withColumn("weight", _r6(F.col("weight")))


# ------------------------------------------------- results over exact identity

def _det(spark, d):
    return flows.identity_detailed(spark, d)


_NAME = "CASE WHEN cluster_id = -1 THEN 'no_sisters' ELSE 'cluster_' || CAST(cluster_id AS VARCHAR) END"
_SIZES = "sizes AS (SELECT brandId, cluster_id, count(*) AS size FROM detailed WHERE cluster_id <> -1 GROUP BY 1, 2)"


@query("O1_assign_clusters", with_processed("SELECT brandSKUId, brandId, cluster_id FROM detailed"))
def o1(spark, d):
    return _det(spark, d).select("brandSKUId", "brandId", "cluster_id")


@query("O2_nest_clusters", with_processed(f"""
SELECT brandId, {_NAME} AS cluster_name, count(*) AS n_products, min(brandSKUId) AS first_sku,
  max(brandSKUId) AS last_sku FROM detailed GROUP BY brandId, cluster_id"""))
def o2(spark, d):
    n = res.nest_clusters(_det(spark, d))
    g = n.groupBy("brandId", "cluster_name").agg(
        F.sum(F.size("products")).alias("n_products"),
        F.min(F.element_at("products", 1)["brandSKUId"]).alias("first_sku"),
        F.max(F.element_at("products", -1)["brandSKUId"]).alias("last_sku"))
    return g


@query("O3_noise_bucket", with_processed(f"SELECT brandSKUId, {_NAME} AS cluster_name FROM detailed"))
def o3(spark, d):
    return _det(spark, d).select("brandSKUId", res.cluster_name().alias("cluster_name"))


@query("O4_brand_summary", with_processed("""
SELECT brandId, count(*) AS total_products,
  count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS total_clusters,
  sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS products_with_sisters,
  sum(CASE WHEN cluster_id = -1 THEN 1 ELSE 0 END) AS products_without_sisters
FROM detailed GROUP BY brandId"""))
def o4(spark, d):
    return res.brand_summary(_det(spark, d)).select(
        "brandId", "total_products", "total_clusters", "products_with_sisters", "products_without_sisters")


@query("O5_cluster_summary", with_processed(f"""
SELECT brandId, {_NAME} AS cluster_id, brandSKUId, label, normalized_name, categoryLabel,
  categories_parsed, primary_category FROM detailed"""))
def o5(spark, d):
    return res.cluster_summary(_det(spark, d))


@query("O6_top_clusters", with_processed(f""", {_SIZES},
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY brandId ORDER BY size DESC, cluster_id) AS rank FROM sizes),
samples AS (SELECT brandId, cluster_id, string_agg(label, ' || ' ORDER BY brandSKUId) AS sample_labels FROM (
  SELECT d.*, ROW_NUMBER() OVER (PARTITION BY d.brandId, d.cluster_id ORDER BY d.brandSKUId) AS i
  FROM detailed d JOIN ranked r ON d.brandId = r.brandId AND d.cluster_id = r.cluster_id WHERE r.rank <= 5) t
  WHERE i <= 3 GROUP BY brandId, cluster_id)
SELECT r.brandId, r.rank, 'cluster_' || CAST(r.cluster_id AS VARCHAR) AS cluster_name, r.size,
  s.sample_labels, greatest(r.size - 3, 0) AS more
FROM ranked r JOIN samples s ON r.brandId = s.brandId AND r.cluster_id = s.cluster_id WHERE r.rank <= 5"""))
def o6(spark, d):
    t = res.top_clusters(_det(spark, d))
    return t.withColumn("sample_labels", F.array_join("sample_labels", " || "))


@query("O7_master_summary", with_processed("""
SELECT count(*) AS total_products, count(DISTINCT brandId) AS total_brands,
  count(DISTINCT CASE WHEN cluster_id <> -1 THEN brandId || '/' || CAST(cluster_id AS VARCHAR) END) AS total_clusters,
  count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS distinct_cluster_ids,
  sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS products_with_sisters,
  round(sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS clustering_rate
FROM detailed"""))
def o7(spark, d):
    return res.master_summary(_det(spark, d))


@query("O8_run_summary", with_processed("""
SELECT brandId, count(*) AS total_products,
  count(DISTINCT CASE WHEN cluster_id <> -1 THEN brandId || '/' || CAST(cluster_id AS VARCHAR) END) AS total_clusters,
  sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS products_with_sisters,
  CASE WHEN count(*) > 0 THEN round(sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) ELSE 0.0 END AS clustering_rate
FROM detailed GROUP BY ROLLUP (brandId)"""))
def o8(spark, d):
    return res.run_summary(_det(spark, d))


_VT = f"""
vt AS (SELECT brandId, cluster_id, count(*) AS n_products, count(DISTINCT sig) AS n_signatures FROM (
  SELECT brandId, cluster_id, array_to_string(list_sort(list_distinct(
    regexp_extract_all(label, '\\d+(?:\\.\\d+)?'))), ',') AS sig FROM detailed) t GROUP BY brandId, cluster_id),
vtt AS (SELECT *, CASE WHEN cluster_id = -1 THEN 'no_sisters' WHEN n_products = 1 THEN 'single_product'
  WHEN n_signatures = 1 THEN 'type_variant' WHEN n_signatures = n_products THEN 'size_variant' ELSE 'mixed' END
  AS variant_type, {_NAME} AS cluster_name FROM vt)"""


@query("O11_variant_type", with_processed(f", {_VT} SELECT brandId, cluster_id, n_products, n_signatures, "
                                          "variant_type, cluster_name FROM vtt"))
def o11(spark, d):
    return res.variant_type(_det(spark, d))


@query("O12_variant_type_summary", with_processed(f""", {_VT}
SELECT brandId,
  count(*) FILTER (WHERE variant_type = 'type_variant') AS type_variant,
  count(*) FILTER (WHERE variant_type = 'size_variant') AS size_variant,
  count(*) FILTER (WHERE variant_type = 'mixed') AS mixed,
  count(*) FILTER (WHERE variant_type = 'single_product') AS single_product,
  count(*) FILTER (WHERE variant_type = 'no_sisters') AS no_sisters
FROM vtt GROUP BY brandId"""))
def o12(spark, d):
    return res.variant_type_summary(_det(spark, d))


_REPS = """
reps AS (SELECT brandId, cluster_id AS clusterId, brandSKUId,
  min(brandSKUId) OVER (PARTITION BY brandId, cluster_id) AS sisterProductId
  FROM detailed WHERE cluster_id >= 0)"""


@query("O13_representatives", with_processed(f", {_REPS} SELECT brandId, clusterId, brandSKUId, sisterProductId FROM reps"))
def o13(spark, d):
    return res.representatives(_det(spark, d))


@query("O14_validate_representatives", with_processed(f""", {_REPS}
SELECT brandId, clusterId, count(DISTINCT sisterProductId) AS n_representatives FROM reps
GROUP BY brandId, clusterId HAVING count(DISTINCT sisterProductId) > 1"""))
def o14(spark, d):
    return res.validate_representatives(res.representatives(_det(spark, d)))


@query("O15_master_stats", with_processed(f""", {_REPS}
SELECT count(*) AS total_rows, count(DISTINCT brandId) AS unique_brands,
  count(DISTINCT clusterId) AS unique_cluster_ids,
  count(DISTINCT brandId || '/' || CAST(clusterId AS VARCHAR)) AS unique_clusters,
  count(DISTINCT brandSKUId) AS unique_products FROM reps"""))
def o15(spark, d):
    return res.master_stats(res.representatives(_det(spark, d)))


@query("O16_preview", with_processed(f""", {_REPS}
SELECT * FROM reps ORDER BY brandId, clusterId, brandSKUId LIMIT 10"""))
def o16(spark, d):
    return res.preview(res.representatives(_det(spark, d)))


# ------------------------------------------------------------------ batching

_BATCHES = f"""
rollup AS ({_ROLLUP.format(extra="")}),
batches AS (SELECT *, CAST(1 + (ROW_NUMBER() OVER (ORDER BY product_count DESC, brandId) - 1) // 5 AS INTEGER)
  AS batch_number FROM rollup),
ledger AS (
  SELECT 'r1' AS run_id, brandId, CASE WHEN product_count % 2 = 1 THEN 'failed' ELSE 'processed' END AS status,
    batch_number, TIMESTAMP '2023-12-31 23:30:00' AS started, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM batches
  UNION ALL
  SELECT 'r2', brandId, 'processed', batch_number, TIMESTAMP '2024-01-01 23:45:00', TIMESTAMP '2024-01-02 00:00:00' FROM batches WHERE batch_number % 3 <> 0),
state AS (SELECT brandId, arg_max(status, ts) AS status, arg_max(batch_number, ts) AS batch_number,
    arg_max(started, ts) AS started, max(ts) AS ts
  FROM ledger GROUP BY brandId)"""


def _batches(spark, d):
    return bt.assign_batches(ex.brand_rollup(derive_catalog(spark, d)), 5)


def _ledger(spark, d):
    """Every brand's first run, of which odd product counts fail, and a second run of
    the batches whose number three does not divide."""
    b = _batches(spark, d)
    r1 = b.select(
        F.lit("r1").alias("run_id"), F.col("brandId"),
        F.when(F.col("product_count") % 2 == 1, "failed").otherwise("processed").alias("status"),
        F.lit(None).cast("string").alias("error"), "batch_number",
        F.lit("2023-12-31 23:30:00").cast("timestamp").alias("started"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    r2 = b.filter("batch_number % 3 <> 0").select(
        F.lit("r2").alias("run_id"), F.col("brandId"), F.lit("processed").alias("status"),
        F.lit(None).cast("string").alias("error"), "batch_number",
        F.lit("2024-01-01 23:45:00").cast("timestamp").alias("started"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("ts"))
    return r1.unionByName(r2)


@query("B1_assign_batches", with_catalog(", " + _BATCHES.strip() +
                                         " SELECT brandId, brandName, product_count, batch_number FROM batches"))
def b1(spark, d):
    return _batches(spark, d)


@query("B2_remaining_brands", with_catalog(", " + _BATCHES.strip() + """
SELECT brandId FROM batches WHERE brandId NOT IN (SELECT brandId FROM state WHERE status = 'processed')"""))
def b2(spark, d):
    return bt.remaining_brands(_batches(spark, d), _ledger(spark, d)).select("brandId")


@query("B3_ledger_state", with_catalog(", " + _BATCHES.strip() +
                                       " SELECT brandId, status, batch_number, ts FROM state"))
def b3(spark, d):
    return bt.ledger_state(_ledger(spark, d)).select("brandId", "status", "batch_number", "ts")


@query("B4_resume_point", with_catalog(", " + _BATCHES.strip() + """,
present AS (SELECT batch_number AS b FROM state GROUP BY 1 HAVING bool_and(status = 'processed')),
run AS (SELECT b, ROW_NUMBER() OVER (ORDER BY b) AS rn FROM present)
SELECT coalesce(max(b), 0) AS last_completed, coalesce(max(b), 0) + 1 AS next_batch FROM run WHERE b = rn"""))
def b4(spark, d):
    return bt.resume_point(bt.completed_batches(_ledger(spark, d)))


@query("B5_retry_failed", with_catalog(", " + _BATCHES.strip() + """
SELECT e.brandSKUId, e.brandId FROM extract e WHERE e.brandId IN (SELECT brandId FROM state WHERE status = 'failed')"""))
def b5(spark, d):
    return ex.filter_brands(flows.products(spark, d), bt.failed_brands(_ledger(spark, d))) \
        .select("brandSKUId", "brandId")


@query("B6_upsert_by_brand", with_processed(", " + _BATCHES.strip() + """,
simple AS (SELECT brandSKUId, brandId, coalesce(nullif(lower(trim(concat_ws(' | ', nullif(trim(brand_extracted), ''),
  nullif(trim(primary_category), '')))), ''), 'unknown product') AS core_identity FROM identity
  WHERE brandId IN (SELECT brandId FROM batches WHERE batch_number = 1)),
sg AS (SELECT brandId, core_identity, count(*) AS n FROM simple GROUP BY 1, 2),
sid AS (SELECT brandId, core_identity, CAST(dense_rank() OVER (PARTITION BY brandId ORDER BY core_identity) - 1 AS INTEGER) AS cid
  FROM sg WHERE n >= 2),
new AS (SELECT s.brandSKUId, s.brandId, s.core_identity, CAST(coalesce(i.cid, -1) AS INTEGER) AS cluster_id FROM simple s
  LEFT JOIN sid i ON i.brandId = s.brandId AND i.core_identity = s.core_identity)
SELECT brandSKUId, brandId, core_identity, cluster_id FROM detailed WHERE brandId NOT IN (SELECT brandId FROM new)
UNION ALL SELECT brandSKUId, brandId, core_identity, cluster_id FROM new"""))
def b6(spark, d):
    cols = ["brandSKUId", "brandId", "core_identity", "cluster_id"]
    master = _det(spark, d).select(*cols)
    first = _batches(spark, d).filter("batch_number = 1").select("brandId")
    newp = process_products(flows.products(spark, d).join(first, "brandId", "left_semi"), IdentityConfig(simple_identity=True))
    from ..operators.cluster import identity_grouped
    new = identity_grouped(newp).select(*cols)
    return bt.upsert_by_brand(master, new)


@query("B7_union_batches", with_processed(", " + _BATCHES.strip() + f", {_REPS}" + """
SELECT r.*, b.batch_number FROM reps r JOIN batches b ON r.brandId = b.brandId"""))
def b7(spark, d):
    det = _det(spark, d).join(_batches(spark, d).select("brandId", "batch_number"), "brandId")
    reps = res.representatives(det).join(det.select("brandId", "batch_number").distinct(), "brandId")
    return bt.union_batches(reps).withColumn("batch_number", F.col("batch_number").cast("int"))


_BSUM = f""",
{_BATCHES.strip()},
bd AS (SELECT d.*, b.batch_number FROM detailed d JOIN batches b ON d.brandId = b.brandId),
bs AS (SELECT s.batch_number, count(*) AS brands_in_batch,
    sum(CASE WHEN s.status = 'processed' THEN 1 ELSE 0 END) AS brands_processed,
    sum(CASE WHEN s.status = 'failed' THEN 1 ELSE 0 END) AS brands_failed,
    coalesce(string_agg(s.brandId, ',' ORDER BY s.brandId) FILTER (s.status = 'failed'), '') AS failed_list,
    round((epoch_us(max(s.ts)) - epoch_us(min(s.started))) / 60e6, 2) AS minutes
    FROM state s GROUP BY s.batch_number),
bp AS (SELECT batch_number, count(*) AS total_products,
    count(DISTINCT CASE WHEN cluster_id <> -1 THEN brandId || '/' || CAST(cluster_id AS VARCHAR) END) AS total_clusters,
    sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS products_clustered FROM bd GROUP BY batch_number),
summary AS (SELECT bs.*, coalesce(bp.total_products, 0) AS total_products, coalesce(bp.total_clusters, 0) AS total_clusters,
    coalesce(bp.products_clustered, 0) AS products_clustered,
    CASE WHEN coalesce(bp.total_products, 0) > 0 THEN round(bp.products_clustered * 100.0 / bp.total_products, 6) ELSE 0.0 END
    AS clustering_rate FROM bs LEFT JOIN bp ON bs.batch_number = bp.batch_number)"""


def _bsum(spark, d):
    det = _det(spark, d).join(_batches(spark, d).select("brandId", "batch_number"), "brandId")
    return bt.batch_summary(det, _ledger(spark, d))


@query("O9_batch_summary", with_processed(_BSUM + " SELECT * FROM summary"))
def o9(spark, d):
    return _bsum(spark, d)


@query("O10_global_summary", with_processed(_BSUM + """
SELECT count(*) AS batches, string_agg(batch_number || ':' || total_products || ':' || total_clusters, ',' ORDER BY batch_number) AS breakdown,
  round(sum(minutes), 2) AS minutes, sum(brands_processed) AS brands_processed, sum(brands_failed) AS brands_failed,
  sum(total_products) AS total_products, sum(total_clusters) AS total_clusters,
  sum(products_clustered) AS products_clustered,
  CASE WHEN sum(total_products) > 0 THEN round(sum(products_clustered) * 100.0 / sum(total_products), 6) ELSE 0.0 END
  AS clustering_rate FROM summary"""))
def o10(spark, d):
    return bt.global_summary(_bsum(spark, d))


# -------------------------------------------------------------------- charts

@query("G1_cluster_size_histogram", with_processed(f""", {_SIZES},
st AS (SELECT brandId, min(size) AS lo, max(size) AS hi, count(*) AS nc FROM sizes GROUP BY brandId),
sb AS (SELECT s.*, st.lo, st.hi, CAST(greatest(10, st.nc // 5) AS INTEGER) AS bins FROM sizes s JOIN st ON s.brandId = st.brandId)
SELECT brandId, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((size - lo) * bins / (hi - lo)), bins - 1) END AS INTEGER) AS bin,
  bins, lo, hi, count(*) AS n_clusters FROM sb GROUP BY ALL"""))
def g1(spark, d):
    return ch.cluster_size_histogram(_det(spark, d))


@query("G2_largest_clusters", with_processed(f""", {_SIZES}
SELECT brandId, cluster_id, size, rank, 'cluster_' || CAST(cluster_id AS VARCHAR) AS cluster_name FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY brandId ORDER BY size DESC, cluster_id) AS rank FROM sizes) t
WHERE rank <= 10"""))
def g2(spark, d):
    return ch.largest_clusters(_det(spark, d))


@query("G3_clustered_split", with_processed("""
SELECT brandId, sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS with_sisters,
  sum(CASE WHEN cluster_id = -1 THEN 1 ELSE 0 END) AS without_sisters FROM detailed GROUP BY brandId"""))
def g3(spark, d):
    return ch.clustered_split(_det(spark, d))


@query("G4_cluster_size_stats", with_processed(f""", {_SIZES}
SELECT b.brandId, round(coalesce(avg(s.size), 0.0), 6) AS avg_size, coalesce(max(s.size), 0) AS max_size,
  coalesce(min(s.size), 0) AS min_size
FROM (SELECT DISTINCT brandId FROM detailed) b LEFT JOIN sizes s ON s.brandId = b.brandId GROUP BY b.brandId"""))
def g4(spark, d):
    return ch.cluster_size_stats(_det(spark, d))


@query("G5_products_per_category", with_processed("""
SELECT brandId, coalesce(primary_category, categoryLabel) AS category, count(*) AS n_products
FROM detailed WHERE cluster_id <> -1 GROUP BY 1, 2"""))
def g5(spark, d):
    return ch.products_per_category(_det(spark, d))


@query("G6_clusters_per_category", with_processed("""
SELECT brandId, coalesce(primary_category, categoryLabel) AS category, count(DISTINCT cluster_id) AS n_clusters
FROM detailed WHERE cluster_id <> -1 GROUP BY 1, 2"""))
def g6(spark, d):
    return ch.clusters_per_category(_det(spark, d))


@query("G7_graph_nodes", with_processed(f"""
SELECT brandId, brandSKUId AS id,
  CASE WHEN length(label) > 20 THEN label[1:20] || '...' ELSE label END AS short_label, label, normalized_name,
  coalesce(primary_category, categoryLabel) AS category, coalesce(categories_parsed, categoryLabel) AS categories_all,
  {_NAME} AS cluster FROM detailed WHERE cluster_id <> -1"""))
def g7(spark, d):
    return ch.graph_nodes(_det(spark, d))


@query("G8_graph_edges", with_processed(f"""
SELECT brandId, source, brandSKUId AS target, {_NAME} AS cluster FROM (
  SELECT *, min(brandSKUId) OVER (PARTITION BY brandId, cluster_id) AS source FROM detailed WHERE cluster_id <> -1) t
WHERE brandSKUId <> source"""))
def g8(spark, d):
    return ch.graph_edges(_det(spark, d))


@query("G9_cluster_details", with_processed(f""", {_SIZES},
top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY brandId ORDER BY size DESC, cluster_id) AS rank
  FROM sizes WHERE size >= 2) t WHERE rank <= 6)
SELECT d.brandId, t.rank, 'cluster_' || CAST(d.cluster_id AS VARCHAR) AS cluster_name, t.size, d.brandSKUId,
  ROW_NUMBER() OVER (PARTITION BY d.brandId, d.cluster_id ORDER BY d.brandSKUId) - 1 AS ordinal,
  CASE WHEN length(d.label) > 30 THEN d.label[1:30] || '...' ELSE d.label END AS short_label
FROM detailed d JOIN top t ON d.brandId = t.brandId AND d.cluster_id = t.cluster_id"""))
def g9(spark, d):
    return ch.cluster_details(_det(spark, d))


@query("G10_brand_comparison", with_processed("""
SELECT brandId, count(*) AS products, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS clusters,
  sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS with_sisters,
  round(sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS rate
FROM detailed GROUP BY brandId HAVING (SELECT count(DISTINCT brandId) FROM detailed) >= 2"""))
def g10(spark, d):
    return ch.brand_comparison(_det(spark, d))
