"""The queries of this package, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import baskets, byte_bpe, divergence, elkan, exact_dedup, html_text, mixing, near_dedup, packing, quality, token_counts, token_files, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False).drop("ids")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(_table(spark, sf_dir, "documents"), tokenizer_file())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.cluster_digest(_table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets.frequent_itemsets(_table(spark, sf_dir, "sale_lines"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_token_files": op5_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_html_text": op7_html_text,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_frequent_itemsets": op13_frequent_itemsets,
}

_PLACE = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _rest_sql(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _host_sql(url: str) -> str:
    return f"translate(regexp_extract({_rest_sql(url)}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path_sql(url: str) -> str:
    return f"regexp_extract({_rest_sql(url)}, '^[^/?#]*([^?#]*)', 1)"


def _tags_sql(name: str) -> str:
    pattern = rf"""(?is)<{name}(?:[\s/](?:[^<>"'']+|"[^"]*"|''[^'']*''){{0,800}})?>"""
    return f"SELECT row, url, node, '{name}' AS kind, t[i] AS tag, i FROM (SELECT *, regexp_extract_all(m, '{pattern}', 0) AS t FROM markup), unnest(range(1, len(t) + 1)) AS u(i)"


def _value_sql(name: str) -> str:
    """The attribute of a name: quotes off, character references read."""
    raw = f"v[list_filter(range(1, len(n) + 1), lambda j: lower(n[j]) = '{name}')[1]]"
    bare = f"""(CASE WHEN length({raw}) > 1 AND {raw}[1] IN ('"', '''') AND {raw}[-1] = {raw}[1] THEN {raw}[2:-2] ELSE {raw} END)"""
    number = lambda digits: f"chr(CASE WHEN {digits} BETWEEN 1 AND 55295 OR {digits} BETWEEN 57344 AND 1114111 THEN {digits} ELSE 65533 END)"
    rest, named = "regexp_replace(p, '^[^;]*;', '')", "known[regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)]"
    decimal, hexadecimal = "TRY_CAST(regexp_extract(p, '^#([0-9]{1,7});', 1) AS INT)", "TRY_CAST('0x' || regexp_extract(p, '^#[xX]([0-9A-Fa-f]{1,6});', 1) AS INT)"
    piece = f"""CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^#[0-9]{{1,7}};') THEN {number(decimal)} || {rest} WHEN regexp_matches(p, '^#[xX][0-9A-Fa-f]{{1,6}};') THEN {number(hexadecimal)} || {rest}
      WHEN {named} IS NOT NULL THEN chr({named}) || {rest} ELSE '&' || p END"""
    return f"array_to_string(list_transform(string_split({bare}, '&'), lambda p, i: {piece}), '')"


def _links_sql() -> str:
    """CTEs up to ``found`` (url, node, base, link)."""
    unread = "(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|$)" for t in ("script", "style", "textarea", "title", "xmp", "template"))
    attribute = r"""([^\s=>"''/]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s>]*))?"""
    clean = lambda x: rf"regexp_replace(regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\r]', '', 'g')"
    known = ", ".join(f"'{name}': {code}" for name, code in url_filters.NAMED.items())
    first = lambda x, kind: f"coalesce({clean(f"arg_min({x}, i) FILTER (kind = '{kind}' AND {x} IS NOT NULL)")}, '')"
    return rf"""
names AS (SELECT MAP {{{known}}} AS known),
markup AS (SELECT row_number() OVER () AS row, url, node, regexp_replace(html, '{unread}', ' ', 'g') AS m FROM node WHERE html IS NOT NULL AND node IS NOT NULL),
tags AS ({" UNION ALL ".join(map(_tags_sql, ("link", "meta", "base")))}),
attributes AS (SELECT row, url, node, kind, i, regexp_extract_all(inside, '{attribute}', 1) AS n, regexp_extract_all(inside, '{attribute}', 2) AS v FROM (SELECT *, regexp_replace(tag, '^<[A-Za-z]+|>$', '', 'g') AS inside FROM tags)),
valued AS (
  SELECT row, url, node, kind, i, {_value_sql("rel")} AS rel, {_value_sql("href")} AS href, {_value_sql("http-equiv")} AS equiv, {_value_sql("content")} AS content FROM attributes, names
), pointed AS (
  SELECT *, CASE WHEN kind = 'meta' AND lower(trim(equiv)) = 'refresh' THEN regexp_extract(coalesce(content, ''), '(?is)^\s*[0-9.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(.*)$', 1) END AS rest,
         CASE WHEN kind = 'link' AND list_contains(string_split_regex(lower(coalesce(rel, '')), '\s+'), 'canonical') THEN href WHEN kind = 'base' THEN href END AS named FROM valued
), aimed AS (
  SELECT *, CASE WHEN rest[1] = '"' THEN regexp_extract(rest, '(?s)^"([^"]*)', 1) WHEN rest[1] = '''' THEN regexp_extract(rest, '(?s)^''([^'']*)', 1) ELSE rest END AS later FROM pointed
), firsts AS (
  SELECT row, url, node, {first("named", "base")} AS base, {first("named", "link")} AS canonical, {first("later", "meta")} AS refresh FROM aimed GROUP BY row, url, node
), found AS (SELECT url, node, base, unnest([canonical, refresh]) AS link FROM firsts)"""


def _resolved_sql(name: str, source: str, to: str, against: str) -> str:
    """CTE ``name``: ``source`` with the url that ``to`` means at ``against`` as column ``name``."""
    return f"""{name}_parts AS (
  SELECT *, CASE WHEN regexp_matches({to}, '(?i)^https?:') AND NOT regexp_matches({to}, '(?i)^https?://') THEN regexp_replace({to}, '(?i)^https?:', '') ELSE {to} END AS t,
         regexp_extract({against}, '{_PLACE}//[^/?#]*', 0) AS site, {_path_sql(against)} AS at_path FROM {source}
), {name} AS (
  SELECT * EXCLUDE (t, site, at_path), CASE WHEN regexp_matches(t, '{_PLACE}//') THEN t WHEN site = '' OR regexp_matches(t, '{_PLACE}') THEN NULL
    WHEN starts_with(t, '//') THEN regexp_extract({against}, '{_PLACE}', 0) || t WHEN starts_with(t, '/') THEN site || t WHEN starts_with(t, '?') THEN site || at_path || t
    WHEN t = '' OR starts_with(t, '#') THEN {against} ELSE site || coalesce(nullif(regexp_replace(at_path, '[^/]*$', ''), ''), '/') || t END AS {name} FROM {name}_parts
)"""


def _resource_sql(name: str, source: str, url: str) -> str:
    """CTE ``name``: ``source`` with the resource of ``url`` as column ``name``."""
    return rf"""{name}_tail AS (SELECT *, regexp_extract({_rest_sql(url)}, '(?s)^[^/?#]*([^#]*)', 1) AS tail FROM {source}
), {name}_place AS (SELECT *, coalesce(nullif(regexp_extract(tail, '^[^?]*', 0), ''), '/') AS place, regexp_extract(tail, '(?s)\?.*$', 0) AS query FROM {name}_tail
), {name} AS (
  SELECT * EXCLUDE (tail, place, query), CASE WHEN instr({url}, '://') > 0 THEN 'https://' || {_host_sql(url)} || CASE WHEN regexp_matches(place, '/\.\.?(/|$)') THEN
    coalesce(nullif(list_reduce(list_prepend('', string_split(place, '/')[2:]), lambda a, p: CASE WHEN p = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN p = '.' THEN a ELSE a || '/' || p END), ''),
             CASE WHEN regexp_matches(place, '/\.\.?$') THEN '' ELSE '/' END) || CASE WHEN regexp_matches(place, '/\.\.?$') THEN '/' ELSE '' END ELSE place END || query END AS {name} FROM {name}_place
)"""


_OP1_SQL = rf"""
WITH RECURSIVE cut AS (SELECT page_id, url, html, {_host_sql("url")} AS host, {_path_sql("url")} AS path FROM (SELECT page_id, coalesce(url, '') AS url, html FROM pages)
), rules(rule, verdict, rule_host, rule_path) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
         ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), {_resource_sql("node", "cut", "url")}, {_links_sql()}, linked AS (SELECT * FROM found WHERE link <> ''), {_resolved_sql("root", "linked", "base", "url")},
based AS (SELECT *, CASE WHEN base = '' THEN url ELSE coalesce(root, url) END AS seen_from FROM root), {_resolved_sql("meant", "based", "link", "seen_from")}, {_resource_sql("target", "meant", "meant")},
links AS (SELECT node AS a, target AS b FROM target WHERE target IS NOT NULL UNION SELECT target, node FROM target WHERE target IS NOT NULL),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
fits AS (
  SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM cut) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, url
), decided AS (
  SELECT reach.a AS node, min(verdict) AS decision FROM reach JOIN rules
    ON (regexp_extract(reach.b, '://([^/?#]*)', 1) = rule_host OR ends_with(regexp_extract(reach.b, '://([^/?#]*)', 1), '.' || rule_host))
   AND starts_with(regexp_extract(reach.b, '://[^/?#]*([^?#]*)', 1), rule_path) GROUP BY reach.a
)
SELECT n.page_id, host, path, fits.rule AS rule, coalesce(fits.verdict, decision, 'allow') AS verdict,
       CASE WHEN fits.verdict IS NOT NULL THEN 'rule' WHEN decision IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM node n LEFT JOIN fits ON fits.page_id IS NOT DISTINCT FROM n.page_id AND fits.url = n.url LEFT JOIN decided ON decided.node = n.node
"""

_OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((n - 1) % 3 + 1)::INT] AS weight, source_size::DOUBLE * 2.0::DOUBLE AS stop FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(weight) OVER () AS weights,
         coalesce(sum(stop) OVER fill, 0) AS stops_before, coalesce(sum(weight) OVER fill, 0) AS weights_before
  FROM weighed WINDOW fill AS (ORDER BY stop / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, (budget - stops_before) / (weights - weights_before) AS level, (budget - stops_before) / (weights - weights_before) * weight >= stop AS is_full FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN stop ELSE arg_min(CASE WHEN NOT is_full THEN level END, CASE WHEN NOT is_full THEN stop / weight END) OVER () * weight END AS target FROM judged
), placed AS (
  SELECT doc_id, s.source, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || '|mix'), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size + 0.5) - before)))::BIGINT AS taken
FROM placed
"""

_COUNTED = {
    "lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r" \t\n\v\f\r", "mark": r""".,;:!?''"()\-""", "symbol": r"#*$%&|<>@^_~`+=/\\\[\]{}",
    "other_ascii": r"\x00-\x08\x0E-\x1F\x7F", "beyond_ascii": r"^\x00-\x7F",
}


def _class_counts() -> str:
    def others(chars: str) -> str:
        return f"[{chars[1:]}]" if chars.startswith("^") else f"[^{chars}]"

    return ", ".join(f"{{'bin': '{name}', 'n': length(regexp_replace(t, '{others(chars)}', '', 'g'))}}" for name, chars in _COUNTED.items())


_OP3_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS row
  FROM documents
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n
  FROM (SELECT row, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM base))
), covered AS (
  SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE n > 1) GROUP BY row
), counts AS (
  SELECT base.row, doc_id, lang, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, [{_class_counts()}] AS classes
  FROM base LEFT JOIN covered USING (row)
), judged AS (SELECT *, classes[8].n > classes[1].n + classes[2].n AS other_script, n_words < {divergence.MIN_WORDS} OR 100 * n_repeat_words > {divergence.REPEATED_PERCENT} * n_words AS base_failed FROM counts),
vocabulary AS (SELECT unnest(string_split('{" ".join(divergence.VOCABULARY)}', ' ')) AS v),
forms AS (
  SELECT DISTINCT form || mark AS word, v FROM (SELECT v, unnest([v, upper(v[1]) || v[2:], upper(v)]) AS form FROM vocabulary), (SELECT unnest(['', '.', ',', ';', ':', '!', '?']) AS mark)
), common AS (
  SELECT row, coalesce(v, '') AS bin, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM judged) LEFT JOIN forms USING (word) GROUP BY ALL
), histograms AS (
  SELECT row, 'class' AS kind, c.bin AS bin, c.n AS n FROM (SELECT row, unnest(classes) AS c FROM judged)
  UNION ALL SELECT row, 'word', bin, n FROM common
), bins AS (SELECT 'word' AS kind, v AS bin FROM vocabulary UNION ALL SELECT 'word', '' UNION ALL SELECT 'class', unnest({list(_COUNTED)})),
shares AS (
  SELECT j.row, lang, base_failed, n_words, other_script, b.kind, b.bin, coalesce(h.n, 0)::DOUBLE / greatest(sum(coalesce(h.n, 0)) OVER (PARTITION BY j.row, b.kind), 1) AS p
  FROM judged j CROSS JOIN bins b LEFT JOIN histograms h ON h.row = j.row AND h.kind = b.kind AND h.bin = b.bin
), refs AS (
  SELECT lang AS reference, kind, bin, avg(p) AS q FROM shares WHERE NOT base_failed AND lang IN ({", ".join(f"'{x}'" for x in divergence.COMMON_WORDS)}) GROUP BY ALL
), distances AS (
  SELECT row, kind, reference, sqrt(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS d
  FROM shares JOIN refs USING (kind, bin) WHERE n_words >= {divergence.GUARD_WORDS} AND NOT other_script AND lang IN (SELECT reference FROM refs) GROUP BY ALL
), nearest AS (SELECT row, min(d) FILTER (kind = 'class') AS c, min(d) FILTER (kind = 'word') AS w FROM (SELECT row, kind, min(d) AS d FROM distances GROUP BY ALL) GROUP BY row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(nearest.c <= {divergence.CLASS_LIMIT} + {divergence.CLASS_ALLOWANCE} / sqrt(n_words), true)
       AND coalesce(nearest.w <= {divergence.WORD_LIMIT} + {divergence.WORD_ALLOWANCE} / sqrt(n_words), true) AS kept
FROM judged LEFT JOIN nearest USING (row)
"""

_OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), both_ways AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x),
least AS (SELECT x AS doc_id, min(y) AS component FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""



def _op11_sql() -> str:
    def assigned(n: int) -> str:
        squared = f"list_sum(list_transform(range(1, 65), lambda i: (x[i] - c{n}.x[i])::HUGEINT * (x[i] - c{n}.x[i])))"
        return f"""
a{n} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT row, vec_id, v.x AS x, cluster, {squared.replace("(x[i]", "(v.x[i]")} AS d FROM v, c{n}) GROUP BY row
)"""

    rounds = ",".join(
        f"""{assigned(n)}, m{n} AS (SELECT cluster, list(m ORDER BY i) AS x FROM (
  SELECT cluster, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m FROM a{n}, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY cluster
), c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (cluster))"""
        for n in range(10)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INT AS cluster, x FROM v QUALIFY cluster < 8
),{rounds},{assigned(10)}
SELECT vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (cluster)"""


_OP13_SQL = """
WITH RECURSIVE b AS MATERIALIZED (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
baskets AS MATERIALIZED (SELECT count(DISTINCT sale_id) AS n, greatest(5, ceil(count(DISTINCT sale_id) / 20000)) AS least FROM b),
frequent(items, last_item, sales) AS (
  SELECT [item_id], item_id, list(sale_id) FROM b GROUP BY item_id HAVING count(*) >= (SELECT least FROM baskets)
  UNION ALL
  SELECT list_append(f.items, b.item_id), b.item_id, list(b.sale_id) FROM (SELECT items, last_item, unnest(sales) AS sale_id FROM frequent) f JOIN b USING (sale_id)
  WHERE b.item_id > f.last_item GROUP BY f.items, b.item_id HAVING count(*) >= (SELECT least FROM baskets)
), sets AS MATERIALIZED (SELECT items, len(sales) AS support FROM frequent),
parts AS MATERIALIZED (SELECT items, support, c, list_filter(items, lambda x: x <> c) AS part FROM (SELECT items, support, unnest(items) AS c FROM sets WHERE len(items) > 1)),
closed AS (SELECT s.* FROM sets s LEFT JOIN (SELECT part, max(support) AS above FROM parts GROUP BY part) p ON p.part = s.items WHERE above IS NULL OR above < s.support),
rules AS (
  SELECT p.items, p.c, q.support AS a, o.support AS s FROM parts p JOIN sets q ON q.items = p.part JOIN sets o ON o.items = [p.c], baskets
  WHERE 100 * p.support >= 60 * q.support AND p.support * baskets.n > q.support * o.support
), listed AS (SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS text FROM rules GROUP BY items)
SELECT array_to_string(items, ',') AS items, len(items)::BIGINT AS n_items, support::BIGINT AS support, coalesce(n_rules, 0)::BIGINT AS n_rules, best_item, sha256(coalesce(text, '')) AS rules_sha256
FROM closed LEFT JOIN listed USING (items)
"""

SQL = {
    "op1_url_filters": _OP1_SQL, "op2_mixing": _OP2_SQL, "op3_quality_rules": _OP3_SQL, "op8_near_dedup": _OP8_SQL, "op10_exact_dedup": _OP10_SQL,
    "op11_centroid_clusters": _op11_sql(), "op13_frequent_itemsets": _OP13_SQL,
}
