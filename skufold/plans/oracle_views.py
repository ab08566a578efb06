"""DuckDB text of the derived catalog views, used as CTEs by the oracle SQL.

Same definitions as ``sources.catalog.derive_catalog`` (FIXTURES.md section 2).
"""

CATALOG_CTES = """
sku AS (
  SELECT p_partkey AS brandSKUId, p_brand AS brandId,
    concat(p_brand, ' ', p_name, ' ', CAST(p_size AS VARCHAR),
      CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN ' Grams' WHEN 2 THEN 'ml' ELSE ' (box)' END) AS label,
    concat('{"flavour":"', split_part(p_name, ' ', 1), '","netWeight":"', CAST(p_size AS VARCHAR),
      'g","tags":["', split_part(p_name, ' ', 2), '",""],"brandName":"', p_brand, '"}') AS facets_jsonb,
    p_partkey % 10 <> 0 AS isActive
  FROM part),
brand AS (
  SELECT DISTINCT p_brand AS brandId, p_brand AS brandLabel,
    p_brand <> 'Brand#7' AS isActive,
    p_brand NOT IN ('Brand#3', 'Brand#9') AS isVerified,
    CASE WHEN p_brand = 'Brand#5' THEN true WHEN p_brand = 'Brand#6' THEN false END AS isTest
  FROM part),
category AS (
  SELECT DISTINCT p_type AS categoryId,
    CASE p_type WHEN 'SMALL' THEN 'Sweets/Snacks' WHEN 'PROMO' THEN 'N/A' ELSE p_type END AS categoryLabel,
    p_type <> 'LARGE' AS isActive
  FROM part),
sku_category AS (
  SELECT p_partkey AS brandSKUId, p_type AS categoryId FROM part
  UNION
  SELECT p_partkey, CASE WHEN p_size > 25 THEN 'STANDARD' ELSE 'ECONOMY' END FROM part),
seller_brand AS (
  SELECT DISTINCT l_suppkey AS sellerId, p_brand AS brandId
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#11'),
extract AS (
  SELECT brandSKUId, brandId, brandLabel, label, facets_jsonb, categoryLabel FROM (
    SELECT s.brandSKUId, s.brandId, b.brandLabel, s.label, s.facets_jsonb, c.categoryLabel,
      ROW_NUMBER() OVER (PARTITION BY s.brandSKUId ORDER BY c.categoryId) AS rn
    FROM sku s
    JOIN brand b ON s.brandId = b.brandId
    JOIN sku_category sc ON s.brandSKUId = sc.brandSKUId
    JOIN category c ON sc.categoryId = c.categoryId
    WHERE s.isActive AND b.isActive AND c.isActive
      AND EXISTS (SELECT 1 FROM seller_brand sb WHERE sb.brandId = b.brandId)) t
  WHERE rn = 1)
"""


def with_catalog(body: str) -> str:
    return "WITH " + CATALOG_CTES.strip() + "\n" + body


# Label normalization, categories and identity in DuckDB SQL over ``extract``.
# RE2 has no lookarounds and ASCII classes; the derived tables are ASCII, so
# \b \w \d \s mean the same as in Python there. Of the six size facet keys the
# derived facets carry only netWeight (a string), which is all N5 needs here.
PROCESSED_CTES = r"""
,n1 AS (
  SELECT *, regexp_replace(label, '^\s+|\s+$', '', 'g') AS _t FROM extract),
n1b AS (
  SELECT *, regexp_split_to_array(_t, '\s+') AS _w FROM n1),
n1c AS (
  SELECT *, list_max(list_filter(list_transform(_w, lambda w, i: CASE WHEN regexp_matches(w, '\d') THEN i END),
                                 lambda x: x IS NOT NULL)) AS _i FROM n1b),
n1d AS (
  SELECT *, CASE WHEN _i > 1 AND coalesce(list_bool_or(list_transform(_w[_i + 1:],
      lambda w: regexp_matches(regexp_replace(lower(w), '[^a-zA-Z0-9_]', '', 'g'),
        '^(grams?|gms?|g|kg|kilograms?|kilo|ml|milliliters?|liters?|l|ltrs?|oz|ounces?|lbs?|pounds?|gram|gm)$'))), false)
    THEN array_to_string(_w[1:_i - 1], ' ') ELSE _t END AS _n1 FROM n1c),
n2 AS (
  SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(_n1,
      '(?i)\s+\d+\s*(g|gm|gms|gram|grams|kg|ml|l|ltr|ltrs|liter|liters|oz|lb|lbs|pound|pounds)\s*$', ''),
      '(?i)\s+\((box|pack|packet|pouch|bag|tin|can|jar|bottle)\)\s*$', ''),
      '(?i)\s+(box|pack|packet|pouch|bag|tin|can|jar|bottle)\s*$', ''),
      '^\s+|\s+$', '', 'g')) AS _n4,
    regexp_replace(coalesce(json_extract_string(facets_jsonb, '$.netWeight'), ''), '^\s+|\s+$', '', 'g') AS _nw
  FROM n1d),
n5 AS (
  SELECT *, CASE WHEN _nw <> '' AND lower(_nw) NOT IN ('n/a', 'null', 'none')
                  AND length(regexp_replace(lower(_nw), '[^\w\s]', '', 'g')) > 2
      THEN replace(replace(_n4, lower(_nw), ' '), regexp_replace(lower(_nw), '[^\w\s]', '', 'g'), ' ')
      ELSE _n4 END AS _n5 FROM n2),
n6 AS (
  SELECT *, CASE WHEN lower(trim(brandLabel)) <> '' AND starts_with(_n5, lower(trim(brandLabel)))
      THEN regexp_replace(_n5[length(lower(trim(brandLabel))) + 1:], '^\s+|\s+$', '', 'g') ELSE _n5 END AS _n6
  FROM n5),
n8 AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      _n6,
      '\s*[-–—]\s*', ' ', 'g'),
      '[^\w\s]', ' ', 'g'),
      '(?i)\b\d+(\.\d+)?\s*(grams?|g|kg|kilograms?|ounces?|oz|lbs?|pounds?)\b', ' ', 'g'),
      '(?i)\b\d+(\.\d+)?\s*gm\b', ' ', 'g'),
      '(?i)\b\d+(\.\d+)?\s*GM\b', ' ', 'g'),
      '(?i)\b\d+(\.\d+)?\s*(ml|milliliters?|liters?|l|fl\.?\s*oz|fluid\s*ounces?)\b', ' ', 'g'),
      '(?i)\b\d+(\.\d+)?\s*ML\b', ' ', 'g'),
      '(?i)\b(small|medium|large|xl|xxl|s|m|l)\b', ' ', 'g'),
      '(?i)\b\d+\s*(inch|inches|cm|centimeters?|mm|millimeters?)\b', ' ', 'g'),
      '(?i)rs\.?\s*\d+', ' ', 'g'),
      '(?i)₹\s*\d+', ' ', 'g'),
      '(?i)\$\s*\d+(\.\d+)?', ' ', 'g'),
      '(?i)\b(single-use|multi-use|family\s*pack|party\s*pack)\b', ' ', 'g'),
      '\b\d+\b', ' ', 'g'),
      '(?i)\b(rs\.?|₹)\s*\d+\b', ' ', 'g'),
      '(?i)\b\d+%\s*(extra|off|free)\b', ' ', 'g'),
      '(?i)\b(new|improved|special|premium|original)\b', ' ', 'g'),
      '(?i)\b(available|now|today|limited|offer)\b', ' ', 'g'),
      '\s+', ' ', 'g') AS _n10 FROM n6),
n12 AS (
  SELECT *, regexp_replace(_n10, '^\s+|\s+$', '', 'g') AS _n11,
    regexp_replace(regexp_replace(regexp_replace(lower(label), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'),
                   '^\s+|\s+$', '', 'g') AS _fb
  FROM n8),
processed AS (
  SELECT brandSKUId, brandId, brandLabel, label, facets_jsonb, categoryLabel,
    CASE WHEN length(_n11) < 3 THEN
      CASE WHEN lower(trim(brandLabel)) <> '' AND starts_with(_fb, lower(trim(brandLabel)) || ' ')
        THEN regexp_replace(_fb[length(lower(trim(brandLabel))) + 1:], '^\s+|\s+$', '', 'g') ELSE _fb END
    ELSE _n11 END AS normalized_name,
    _cats AS cats,
    coalesce(json_extract_string(facets_jsonb, '$.brandName'), brandLabel) AS brand_extracted
  FROM (SELECT *,
      CASE WHEN coalesce(categoryLabel, '') = '' THEN ['general']
           WHEN len(list_filter(list_transform(_parts, lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('n/a', 'null', 'none', 'n', 'a'))) = 0 THEN ['general']
           ELSE list_filter(list_transform(_parts, lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('n/a', 'null', 'none', 'n', 'a')) END AS _cats
    FROM (SELECT *, CASE WHEN instr(categoryLabel, '/') > 0 THEN string_split(categoryLabel, '/')
                         WHEN instr(categoryLabel, ',') > 0 THEN string_split(categoryLabel, ',')
                         WHEN instr(categoryLabel, ';') > 0 THEN string_split(categoryLabel, ';')
                         WHEN instr(categoryLabel, '|') > 0 THEN string_split(categoryLabel, '|')
                         ELSE [trim(categoryLabel)] END AS _parts FROM n12) p) q),
identity AS (
  SELECT *, cats[1] AS primary_category, array_to_string(cats, ', ') AS categories_parsed,
    coalesce(nullif(lower(trim(concat_ws(' | ', nullif(trim(normalized_name), ''), nullif(trim(cats[1]), '')))), ''),
             'unknown product') AS core_identity
  FROM processed),
id_groups AS (
  SELECT brandId, core_identity, count(*) AS n FROM identity GROUP BY brandId, core_identity),
id_ids AS (
  SELECT brandId, core_identity, CAST(dense_rank() OVER (PARTITION BY brandId ORDER BY core_identity) - 1 AS INTEGER) AS cid
  FROM id_groups WHERE n >= 2),
detailed AS (
  SELECT i.*, CAST(coalesce(d.cid, -1) AS INTEGER) AS cluster_id
  FROM identity i LEFT JOIN id_ids d ON i.brandId = d.brandId AND i.core_identity = d.core_identity)
"""


def with_processed(body: str) -> str:
    return with_catalog(PROCESSED_CTES + body)


# Catalog rows with prices, noise words, pack words, several separators, null
# labels and unusable facets. The expressions are the same in Spark and DuckDB.
MESSY_COLUMNS = {
    "brandSKUId": "p_partkey",
    "brandId": "p_brand",
    "brandLabel": "p_brand",
    "label": """CASE p_partkey % 10
      WHEN 0 THEN concat(p_name, ' Rs. ', CAST(p_size AS VARCHAR(9)), ' only')
      WHEN 1 THEN concat('New ', p_name, ' ', CAST(p_size AS VARCHAR(9)), ' ml pouch')
      WHEN 2 THEN concat(p_brand, ' ', p_name, ' 20% extra - ', CAST(p_size AS VARCHAR(9)), 'g (Pack)')
      WHEN 3 THEN concat(p_name, ' Family  Pack ', CAST(p_size AS VARCHAR(9)), '.5 kg sachet')
      WHEN 4 THEN concat(p_name, ' Large 10 cm tin')
      WHEN 5 THEN concat('Limited offer! ', p_name, ' $', CAST(p_size AS VARCHAR(9)), '.50 today')
      WHEN 6 THEN concat(CAST(p_size AS VARCHAR(9)), 'UP')
      WHEN 7 THEN NULL
      WHEN 8 THEN concat('  ', p_name, ' – premium ', CAST(p_size AS VARCHAR(9)), ' fluid ounces jar ')
      ELSE concat(p_brand, p_name) END""",
    "facets_jsonb": """CASE p_partkey % 6
      WHEN 0 THEN NULL
      WHEN 1 THEN concat('{"netWeight":"', CAST(p_size AS VARCHAR(9)), 'kg","brandName":"Other ', p_brand, '"}')
      WHEN 2 THEN '{"netWeight":null}'
      WHEN 3 THEN '5'
      WHEN 4 THEN '[]'
      ELSE '{not json' END""",
    "categoryLabel": """CASE p_partkey % 7
      WHEN 0 THEN 'Sweets/Snacks, Fried' WHEN 1 THEN 'Tea, Coffee' WHEN 2 THEN 'A;Spices'
      WHEN 3 THEN 'Oil|Ghee| ' WHEN 4 THEN NULL WHEN 5 THEN ' / ' ELSE 'n/a, Rice' END""",
}


def with_messy(body: str) -> str:
    """``body`` over the processed rows of the messy catalog; facets that are no
    JSON read as null; a null label or a bare number as facets is a fallback row."""
    raw = ", ".join(f"{e} AS {c}" for c, e in MESSY_COLUMNS.items())
    names = ", ".join(c if c != "facets_jsonb" else
                      "CASE WHEN json_valid(facets_jsonb) THEN facets_jsonb END AS facets_jsonb" for c in MESSY_COLUMNS)
    return (f"WITH raw AS (SELECT {raw} FROM part),\nextract AS (SELECT {names} FROM raw)\n" + PROCESSED_CTES + """
,messy AS (
  SELECT brandSKUId, brandId, normalized_name, primary_category, categories_parsed,
    CASE WHEN ok THEN 'ok' ELSE 'fallback' END AS row_status,
    CASE WHEN ok THEN brand_extracted ELSE brandLabel END AS brand_extracted,
    CASE WHEN ok THEN core_identity
         ELSE coalesce(normalized_name, 'None') || ' | ' || coalesce(categoryLabel, 'None') END AS core_identity
  FROM (SELECT *, label IS NOT NULL AND coalesce(facets_jsonb, '') <> '5' AS ok FROM identity))
""" + body)


def sql_tokens(text: str) -> str:
    """P1 over ASCII text."""
    return (rf"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({text}), "
            r"'[^\w\s]', ' ', 'g'), '\d+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+'), "
            r"lambda w: length(w) >= 3)")


def sql_soundex(w: str) -> str:
    """P2 of an ASCII word: codes with H and W left out, runs of a code once, the
    first letter's own code and vowels dropped."""
    x = (f"(CASE WHEN upper({w}[1]) IN ('H', 'W') THEN '8' ELSE '' END || replace(translate(upper({w}), "
         "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230129022455012623019202'), '9', ''))")
    for digit in "0123456":
        x = f"regexp_replace({x}, '{digit}+', '{digit}', 'g')"
    return f"(upper({w}[1]) || left(replace({x}[2:], '0', '') || '000', 3))"


def sql_match_rating(w: str) -> str:
    """P5 of an ASCII word."""
    chars = f"string_split(upper({w}), '')"
    once = f"array_to_string(list_filter({chars}, lambda c, i: i = 1 OR c <> {chars}[i - 1]), '')"
    code = f"({once}[1] || regexp_replace({once}[2:], '[AEIOU]', '', 'g'))"
    return f"CASE WHEN length({code}) > 6 THEN left({code}, 3) || right({code}, 3) ELSE {code} END"


def sql_codes(text: str, code) -> str:
    """A list of the tokens' codes."""
    return f"list_filter(list_transform({sql_tokens(text)}, lambda w: {code('w')}), lambda x: x <> '')"
