"""The registered queries and, for each, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import values as V
from lodestone.operators import compare, endpoints, package, scan, structure
from lodestone.plans import report
from lodestone.plans.fixtures import duck, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def sql_url_category(u: str) -> str:
    low = f"lower({u})"
    return f"CASE WHEN starts_with({low}, 'ws://') OR starts_with({low}, 'wss://') THEN 'websocket' WHEN {sql_any(low, V.ANALYTICS_HOSTS)} THEN 'analytics' WHEN {sql_any(low, V.CDN_HOSTS)} THEN 'cdn' WHEN {sql_any(low, V.AUTH_PATHS)} THEN 'auth' WHEN {sql_any(low, V.API_PATHS)} THEN 'api' ELSE 'unknown' END"


def sql_endpoint_category(p: str) -> str:
    low = f"lower({p})"
    named = (("auth", V.AUTH_PATHS), ("session", V.SESSION_PATHS), ("store", V.STORE_PATHS), ("gameplay", V.GAMEPLAY_PATHS), ("social", V.SOCIAL_PATHS), ("analytics", V.ANALYTICS_PATHS), ("cdn", V.CDN_PATHS))
    return "CASE " + " ".join(f"WHEN {sql_any(low, ws)} THEN {q(n)}" for n, ws in named) + " ELSE 'unknown' END"


METHOD_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN {q(m)}" for p, m in V.HTTP_METHODS) + " END"
URLS_SQL = f"""{duck("source_lines")},
hits AS (SELECT file, line, text, 0 AS kind, unnest(regexp_extract_all(text, {q(V.URL)})) AS raw FROM source_lines
  UNION ALL SELECT file, line, text, 1, unnest(regexp_extract_all(text, {q(V.WEBSOCKET_URL)})) FROM source_lines),
cleaned AS (SELECT file, line, kind, trim(text) AS context, regexp_replace(raw, '[,;:!.)}}\\]]+$', '') AS url FROM hits),
urls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, url ORDER BY line, kind) AS nth,
    CASE WHEN kind = 1 THEN 'websocket' ELSE {sql_url_category("url")} END AS category
  FROM cleaned WHERE kind = 1 OR NOT {sql_any("lower(url)", V.NOISE)}) WHERE nth = 1)"""
LINES_SQL = f"""methods AS (SELECT *, coalesce(own, first_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 'UNKNOWN') AS method
  FROM (SELECT *, {METHOD_SQL} AS own FROM source_lines))"""
LITERAL_SQL = "literal AS (" + " UNION ALL ".join(f"SELECT file, line, method, {k} AS rule, unnest(regexp_extract_all(text, {q(p)})) AS raw FROM methods" for k, p in enumerate(V.REST_PATHS)) + ")"
PATHS_SQL = f"""{URLS_SQL}, {LINES_SQL}, {LITERAL_SQL},
every AS (SELECT file, line, method, 0 AS pass, rule, substring(raw, 2, length(raw) - 2) AS path, NULL AS full_url FROM literal
  UNION ALL SELECT file, line, 'UNKNOWN', 1, kind, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), url FROM urls),
per_file AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, path ORDER BY pass, line, rule) AS nth FROM every WHERE path NOT IN ('', '/')) WHERE nth = 1),
uniq AS (SELECT *, {sql_endpoint_category("path")} AS category FROM (SELECT *, row_number() OVER (PARTITION BY method, path ORDER BY file, pass, line, rule) AS again FROM per_file) WHERE again = 1)"""
AUTH_SQL = f"""{duck("source_lines")}, auth AS ({" UNION ALL ".join(f"SELECT {k} AS rule, {q(t)} AS type, file, line, trim(text) AS context FROM source_lines WHERE regexp_matches(text, {q(p)})" for k, (p, t) in enumerate(V.AUTH_PATTERNS))})"""
NORMAL_SQL = "CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE array_to_string(list_transform(string_split(rtrim(path, '/'), '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{id}' ELSE s END), '/') END"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "source_lines")


@query(f"{URLS_SQL} SELECT url, file, line, context, category FROM urls")
def url_discovery(spark, d):
    return scan.discover_urls(lines(spark, d)).drop("ord")


@query(f"{URLS_SQL} SELECT url, file, line FROM urls WHERE kind = 1")
def websocket_urls(spark, d):
    return scan.discover_urls(lines(spark, d)).where("category = 'websocket'").select("url", "file", "line")


@query(f"SELECT {sql_url_category('url')} AS category, CAST(count(*) AS BIGINT) AS n FROM pages WHERE NOT {sql_any('lower(url)', V.NOISE)} GROUP BY 1")
def page_url_categories(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("url").where(~rules.is_noise(F.col("url")))
    return pages.groupBy(rules.url_category(rules.clean_url(F.col("url"))).alias("category")).agg(F.count("*").alias("n"))


@query(f"{duck('source_lines')}, {LINES_SQL}, {LITERAL_SQL} SELECT file, substring(raw, 2, length(raw) - 2) AS path, line, method, {sql_endpoint_category('raw')} AS category, rule FROM literal")
def rest_paths(spark, d):
    found = scan.literal_paths(lines(spark, d))
    return found.select("file", "path", F.col("line").cast("int").alias("line"), "method", rules.endpoint_category(F.col("path")).alias("category"), F.col("rule").cast("int").alias("rule"))


@query(f"{duck('source_lines')} SELECT file, line, {METHOD_SQL} AS method FROM source_lines")
def http_method_by_line(spark, d):
    return lines(spark, d).select("file", "line", rules.http_method(F.col("text")).alias("method"))


@query(f"{duck('source_lines')}, {LINES_SQL} SELECT file, line, method FROM methods")
def method_inference(spark, d):
    return scan.with_methods(lines(spark, d)).select("file", "line", "method")


@query(f"{URLS_SQL} SELECT file, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM urls WHERE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) NOT IN ('', '/')")
def url_path_endpoints(spark, d):
    urls = scan.discover_urls(lines(spark, d))
    return urls.select("file", "url", rules.url_path(F.col("url")).alias("path")).where("path is not null")


def found_endpoints(spark, d):
    return scan.unique_endpoints(scan.discover_endpoints(lines(spark, d), scan.discover_urls(lines(spark, d))))


@query(f"{PATHS_SQL} SELECT method, path, full_url, file, line, category FROM uniq")
def endpoint_dedup(spark, d):
    return found_endpoints(spark, d).select("method", "path", "full_url", "file", "line", "category")


@query(f"{PATHS_SQL} SELECT category, CAST(count(*) AS BIGINT) AS n FROM uniq GROUP BY 1")
def endpoint_category_counts(spark, d):
    return scan.category_counts(found_endpoints(spark, d)).select("category", "n")


@query(f"{AUTH_SQL} SELECT type, file, line, context FROM auth")
def auth_patterns(spark, d):
    return scan.discover_auth(lines(spark, d)).select("type", "file", "line", "context")


@query(f"{AUTH_SQL} SELECT type, context, file, line FROM (SELECT *, row_number() OVER (PARTITION BY type, context ORDER BY file, line, rule) AS nth FROM auth) WHERE nth = 1")
def auth_dedup(spark, d):
    return scan.unique_auth(scan.discover_auth(lines(spark, d))).select("type", "context", "file", "line")


@query(f"""{PATHS_SQL}, {AUTH_SQL.removeprefix(duck("source_lines"))[2:]} SELECT (SELECT count(DISTINCT file) FROM source_lines) AS files, (SELECT count(*) FROM urls) AS urls, (SELECT count(*) FROM uniq) AS endpoints,
  (SELECT count(*) FROM (SELECT DISTINCT type, context FROM auth)) AS auth_patterns""")
def scan_summary(spark, d):
    rows = lines(spark, d)
    found = scan.scan_lines(rows, rows.select("file").distinct())
    counts = [found.files.select(F.lit("files").alias("k")), found.urls.select(F.lit("urls")), found.endpoints.select(F.lit("endpoints")), found.auth.select(F.lit("auth_patterns"))]
    every = counts[0].union(counts[1]).union(counts[2]).union(counts[3])
    return every.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("files", "urls", "endpoints", "auth_patterns")])


def mapped(spark, d):
    raw = relation(spark, d, "raw_endpoints").select("ord", "method", "path", "full_url", rules.endpoint_category(F.col("path")).alias("category"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("").alias("context"))
    return endpoints.map_endpoints(raw)


MAP_SQL = f"""{duck("raw_endpoints")}, merged AS (SELECT {NORMAL_SQL} AS normal, coalesce(arg_min(method, ord) FILTER (WHERE method <> 'UNKNOWN'), 'UNKNOWN') AS method,
  arg_min(full_url, ord) FILTER (WHERE full_url IS NOT NULL) AS full_url, arg_min({sql_endpoint_category("path")}, ord) AS category, CAST(count(*) AS INT) AS sources FROM raw_endpoints GROUP BY 1)"""


@query(f"{MAP_SQL} SELECT normal AS path, method, full_url, category, sources FROM merged")
def endpoint_map(spark, d):
    return mapped(spark, d).select("path", "method", "full_url", "category", F.size("sources").alias("sources"))


@query(f"{MAP_SQL} SELECT normal AS path, unnest(regexp_extract_all(normal, '\\{{(\\w+)\\}}', 1)) AS name, 'path' AS location, 'string' AS type FROM merged")
def endpoint_params(spark, d):
    return mapped(spark, d).select("path", F.inline("parameters"))


@query(f"{MAP_SQL} SELECT normal AS path, CAST(list_position([{', '.join(q(c) for c in V.ENDPOINT_ORDER)}], category) - 1 AS INT) AS rank FROM merged")
def endpoint_ranked(spark, d):
    return endpoints.catalogue(mapped(spark, d)).select("path", endpoints.category_rank(F.col("category")).alias("rank"))


ENGINE_SQL = f"""{duck("archive_entries")}, seen AS (SELECT archive, bool_or(contains(lower(entry), 'libunity.so')) AS u, bool_or(contains(lower(entry), 'libil2cpp.so')) AS i, bool_or(contains(lower(entry), 'global-metadata.dat')) AS g,
  bool_or(contains(lower(entry), 'managed') AND ends_with(lower(entry), '.dll')) AS m, bool_or(contains(lower(entry), 'libue4.so') OR contains(lower(entry), 'libunrealengine.so')) AS r, bool_or(contains(lower(entry), 'libgodot.so') OR contains(lower(entry), 'libgodot_android.so')) AS o FROM archive_entries GROUP BY 1),
engines AS (SELECT archive, CASE WHEN u AND (i OR g) THEN 'unity-il2cpp' WHEN u THEN 'unity-mono' WHEN r THEN 'unreal' WHEN o THEN 'godot' ELSE 'native' END AS engine, g AS has_global_metadata, m AS has_managed_dlls FROM seen)"""


@query(f"{ENGINE_SQL} SELECT * FROM engines")
def archive_engine(spark, d):
    return package.detect_engines(relation(spark, d, "archive_entries"))


@query(f"{ENGINE_SQL} SELECT archive, CASE engine WHEN 'unity-mono' THEN 'jadx,assetripper' WHEN 'unity-il2cpp' THEN 'jadx,assetripper,il2cppdumper' ELSE 'jadx' END AS tools FROM engines")
def tool_selection(spark, d):
    return package.detect_engines(relation(spark, d, "archive_entries")).select("archive", F.array_join(rules.tools_for(F.col("engine")), ",").alias("tools"))


@query(f"{duck('archive_entries')} SELECT DISTINCT archive, CASE WHEN ends_with(archive, '.xapk') THEN 'xapk' WHEN ends_with(archive, '.apk') THEN 'apk' ELSE 'split-apk' END AS input_type FROM archive_entries")
def input_type(spark, d):
    return relation(spark, d, "archive_entries").select("archive").distinct().withColumn("input_type", rules.input_type(F.col("archive")))


@query(f"{duck('archive_entries')} SELECT archive, entry_ord, regexp_extract(entry, '^lib/([^/]+)/(.+\\.so)$', 2) AS name, regexp_extract(entry, '^lib/([^/]+)/(.+\\.so)$', 1) AS abi, entry AS path FROM archive_entries WHERE regexp_matches(entry, '^lib/([^/]+)/(.+\\.so)$')")
def native_libs(spark, d):
    return package.native_libraries(relation(spark, d, "archive_entries"))


@query(f"""{duck("manifests")} SELECT app_id, regexp_extract(xml, 'package="([^"]*)"', 1) AS package_name, regexp_extract(xml, 'versionCode="([^"]*)"', 1) AS version_code, '0.0.0' AS version_name, 'unknown' AS min_sdk_version,
  array_to_string(regexp_extract_all(xml, '<uses-permission name="([^"]*)"', 1), ',') AS permissions, array_to_string(regexp_extract_all(xml, '<activity name="([^"]*)"', 1), ',') AS activities, array_to_string(regexp_extract_all(xml, '<service name="([^"]*)"', 1), ',') AS services FROM manifests""")
def manifest_components(spark, d):
    parsed = package.parse_manifests(relation(spark, d, "manifests"))
    return parsed.select("app_id", "package_name", "version_code", "version_name", "min_sdk_version", *[F.array_join(c, ",").alias(c) for c in ("permissions", "activities", "services")])


CLASS_SQL = f"""{duck("class_sources")}, classes AS (SELECT file, content, regexp_extract(content, {q(V.CLASS_HEADER)}, 1) AS name, regexp_extract(content, '(?m)^package\\s+([\\w.]+)\\s*;', 1) AS package_name,
  nullif(regexp_extract(content, {q(V.CLASS_HEADER)}, 2), '') AS super_class, regexp_extract(content, {q(V.CLASS_HEADER)}, 3) AS implemented FROM class_sources),
named AS (SELECT *, CASE WHEN contains(lower(coalesce(super_class, '')), 'activity') THEN 'activity' WHEN contains(lower(coalesce(super_class, '')), 'view') THEN 'view' ELSE 'network' END AS category FROM classes)"""


@query(f"{CLASS_SQL} SELECT file, name, package_name, super_class, array_to_string(list_filter(list_transform(string_split(implemented, ','), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> ''), ',') AS interfaces, array_to_string(regexp_extract_all(content, '(?m)^import\\s+([\\w.*]+)\\s*;', 1), ',') AS imports FROM named")
def class_headers(spark, d):
    found = structure.class_headers(relation(spark, d, "class_sources"))
    return found.select("file", "name", "package_name", "super_class", F.array_join("interfaces", ",").alias("interfaces"), F.array_join("imports", ",").alias("imports"))


@query(f"{CLASS_SQL} SELECT file, 'MAX' AS name, 'int' AS type, true AS is_static, regexp_extract(content, 'MAX = (\\d+);', 1) AS initial_value FROM classes UNION ALL SELECT file, 'ref', 'Object', false, NULL FROM classes")
def class_fields(spark, d):
    return relation(spark, d, "class_sources").select("file", F.inline(structure.parse_fields(F.col("content"))))


def classes(spark, d):
    return structure.parse_classes(relation(spark, d, "class_sources"))


@query(f"{CLASS_SQL} SELECT k.category, CAST(count(named.file) AS BIGINT) AS n FROM (SELECT unnest([{', '.join(q(c) for c in V.COMPONENTS)}]) AS category) k LEFT JOIN named ON k.category = named.category GROUP BY 1")
def class_category_counts(spark, d):
    return structure.component_counts(classes(spark, d))


GAPS_SQL = f"""{CLASS_SQL}, gaps AS (SELECT file, name AS class_name, 'obfuscated-name' AS gap_type, 'Class "' || name || '" appears to be ProGuard-obfuscated.' AS description, CAST(0.9 AS DOUBLE) AS confidence FROM named WHERE length(name) <= 2 AND name <> upper(name)
  UNION ALL SELECT file, name, 'unclear-type', 'Field "' || name || '.ref" has a generic type "Object".', 0.6 FROM named
  UNION ALL SELECT file, name, 'inferred-pattern', 'Class "' || name || '" appears to be a network layer component (inferred from API usage patterns).', 0.75 FROM named WHERE category = 'network' AND super_class IS NULL)"""


@query(f"{GAPS_SQL} SELECT * FROM gaps")
def class_gaps(spark, d):
    return structure.find_gaps(classes(spark, d)).drop("gap_ord")


@query(f"{GAPS_SQL} SELECT CAST(floor(30 + 25 + 20 - least(2 * (SELECT count(*) FROM gaps WHERE gap_type = 'obfuscated-name'), 20) + 25 + 0.5) AS INT) AS fidelity_score")
def fidelity_score(spark, d):
    rows = classes(spark, d)
    return structure.fidelity(rows, structure.find_gaps(rows))


@query("""WITH t AS (SELECT unnest([{'k': 0, 'java': 'int', 'kotlin': 'Int'}, {'k': 1, 'java': 'String[]', 'kotlin': 'Array<String>'}, {'k': 2, 'java': 'List<Integer>', 'kotlin': 'List<Int>'}, {'k': 3, 'java': 'Foo', 'kotlin': 'Foo'}]) AS x)
SELECT p_partkey, x.java AS java, x.kotlin AS kotlin FROM part JOIN t ON p_partkey % 4 = x.k""")
def kotlin_types(spark, d):
    java = F.element_at(F.array(*[F.lit(x) for x in ("int", "String[]", "List<Integer>", "Foo")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", java.alias("java")).withColumn("kotlin", rules.kotlin_type(F.col("java")))


@query(f"{CLASS_SQL} SELECT file, 'kotlin.collections.List,okhttp3.Call' AS imports FROM classes")
def kotlin_imports(spark, d):
    found = structure.class_headers(relation(spark, d, "class_sources"))
    return found.select("file", F.array_join(rules.kotlin_imports(F.col("imports")), ",").alias("imports"))


@query(None)
def kotlin_skeletons(spark, d):
    rows = classes(spark, d)
    return structure.skeletons(rows, structure.find_gaps(rows))


def halves(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    file = F.concat(F.lit("src/D"), F.expr("doc_id div 2").cast("string"), F.lit(".java"))
    rows = docs.select(file.alias("file"), F.col("text").alias("content"), "doc_id")
    return rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 2 = 1").drop("doc_id")


def comparison(spark, d):
    return compare.compare_sources(*halves(spark, d))


PAIR_SQL = """WITH rows AS (SELECT doc_id, 'src/D' || CAST(doc_id // 2 AS VARCHAR) || '.java' AS file, text AS content, list_distinct(regexp_extract_all(text, '\\b[A-Za-z_]\\w{2,}')) AS tokens FROM documents),
pairs AS (SELECT a.file AS original_path, b.file AS reconstructed_path, a.content AS ac, b.content AS bc, len(list_intersect(a.tokens, b.tokens)) AS both_, len(a.tokens) AS na, len(b.tokens) AS nb,
  CAST(len(string_split(a.content, chr(10))) AS INT) AS original_lines, CAST(len(string_split(b.content, chr(10))) AS INT) AS reconstructed_lines
  FROM rows a JOIN rows b ON a.file = b.file AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1),
scored AS (SELECT *, CAST(CASE WHEN na = 0 AND nb = 0 THEN 100 WHEN na = 0 OR nb = 0 THEN 0 ELSE floor(100.0 * both_ / (na + nb - both_) + 0.5) END AS INT) AS similarity FROM pairs)"""


@query(f"{PAIR_SQL} SELECT original_path, similarity FROM scored")
def token_jaccard(spark, d):
    return comparison(spark, d).matches.select("original_path", "similarity")


@query(f"{PAIR_SQL} SELECT original_path, reconstructed_path, similarity, original_lines, reconstructed_lines FROM scored")
def compare_first_match(spark, d):
    return comparison(spark, d).matches.drop("shared_symbols")


@query("""WITH rows AS (SELECT doc_id, doc_id // 2 AS half FROM documents) SELECT 'original' AS side, 'src/D' || CAST(half AS VARCHAR) || '.java' AS path FROM rows a WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM rows b WHERE b.half = a.half AND b.doc_id % 2 = 1)
UNION ALL SELECT 'reconstructed', 'src/D' || CAST(half AS VARCHAR) || '.java' FROM rows a WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM rows b WHERE b.half = a.half AND b.doc_id % 2 = 0)""")
def compare_unmatched(spark, d):
    found = comparison(spark, d)
    one = found.unmatched_originals.select(F.lit("original").alias("side"), F.col("original_path").alias("path"))
    return one.union(found.unmatched_reconstructed.select(F.lit("reconstructed"), "reconstructed_path"))


@query(f"{PAIR_SQL} SELECT CAST(coalesce(floor(avg(similarity) + 0.5), 0) AS INT) AS overall_similarity FROM scored")
def overall_similarity(spark, d):
    return comparison(spark, d).overall()


SYMBOLS_SQL = "list_distinct(list_concat(list_concat(" + "), list_concat(".join(", ".join(f"regexp_extract_all({{c}}, {q(p)}, 1)" for p in V.SYMBOLS[k : k + 2]) for k in (0, 2)) + ")))"


@query(f"""{duck("class_sources")}, rows AS (SELECT CAST(regexp_extract(file, '(\\d+)', 1) AS BIGINT) AS k, content FROM class_sources), marked AS (SELECT k, {SYMBOLS_SQL.format(c="content")} AS symbols FROM rows)
SELECT 'src/D' || CAST(a.k // 2 AS VARCHAR) || '.java' AS original_path, array_to_string(list_sort(list_intersect(a.symbols, b.symbols)), ',') AS shared_symbols FROM marked a JOIN marked b ON a.k % 2 = 0 AND b.k = a.k + 1""")
def shared_symbols(spark, d):
    rows = relation(spark, d, "class_sources").withColumn("k", F.regexp_extract("file", r"(\d+)", 1).cast("long"))
    rows = rows.withColumn("file", F.concat(F.lit("src/D"), F.expr("k div 2").cast("string"), F.lit(".java")))
    found = compare.compare_sources(rows.where("k % 2 = 0").select("file", "content"), rows.where("k % 2 = 1").select("file", "content"))
    return found.matches.select("original_path", F.array_join("shared_symbols", ",").alias("shared_symbols"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


ORDERED_SQL = f"""{PATHS_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY file, pass, line, rule) AS ord FROM uniq),
merged AS (SELECT {NORMAL_SQL} AS normal, coalesce(arg_min(method, ord) FILTER (WHERE method <> 'UNKNOWN'), 'UNKNOWN') AS method, arg_min(full_url, ord) FILTER (WHERE full_url IS NOT NULL) AS full_url,
  arg_min(category, ord) AS category, CAST(count(*) AS INT) AS sources FROM numbered GROUP BY 1)"""


@query(f"""{ORDERED_SQL}, {AUTH_SQL.removeprefix(duck("source_lines"))[2:]}
SELECT 'urls' AS section, CAST(json_object('url', url, 'category', category, 'file', file, 'line', line) AS VARCHAR) AS payload FROM urls
UNION ALL SELECT 'endpoints', CAST(json_object('method', method, 'path', normal, 'fullUrl', full_url, 'category', category, 'sourceCount', sources) AS VARCHAR) FROM merged
UNION ALL SELECT 'authPatterns', CAST(json_object('type', type, 'file', file, 'line', line) AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY type, context ORDER BY file, line, rule) AS nth FROM auth) WHERE nth = 1""")
def report_payload(spark, d):
    rows = lines(spark, d)
    found = scan.scan_lines(rows, rows.select("file").distinct())
    return report.payload_rows(found, endpoints.map_endpoints(found.endpoints))


@query(f"""{ORDERED_SQL} SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, min(ord)) AS INT) AS place FROM numbered GROUP BY 1""")
def endpoint_category_order(spark, d):
    """Categories of a summary: by count, then by where each comes first."""
    counts = scan.category_counts(found_endpoints(spark, d))
    return counts.select("category", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("int").alias("place"))


RULE_SQL = f"""{duck("rule_lines")}, literal AS ({" UNION ALL ".join(f"SELECT file, line, {k} AS rule, unnest(regexp_extract_all(text, {q(p)})) AS raw FROM rule_lines" for k, p in enumerate(V.REST_PATHS))})"""


def rule_lines(spark, d):
    return relation(spark, d, "rule_lines").withColumn("dir_ord", F.lit(0))


@query(f"{RULE_SQL} SELECT file, line, rule, substring(raw, 2, length(raw) - 2) AS path, {sql_endpoint_category('raw')} AS category FROM literal")
def rest_rules(spark, d):
    """Every rule for quoted paths, on lines that each of them matches."""
    found = scan.literal_paths(rule_lines(spark, d))
    return found.select("file", "line", F.col("rule").cast("int").alias("rule"), "path", rules.endpoint_category(F.col("path")).alias("category"))


@query(f"{duck('rule_lines')} SELECT file, line, {METHOD_SQL} AS method FROM rule_lines")
def method_rules(spark, d):
    """Every rule for HTTP methods."""
    return rule_lines(spark, d).select("file", "line", rules.http_method(F.col("text")).alias("method"))


@query(f"""{duck("rule_lines")} SELECT * FROM ({" UNION ALL ".join(f"SELECT {k} AS rule, {q(t)} AS type, file, line FROM rule_lines WHERE regexp_matches(text, {q(p)})" for k, (p, t) in enumerate(V.AUTH_PATTERNS))})""")
def auth_rules(spark, d):
    """Every rule for authentication."""
    return scan.discover_auth_rows(rule_lines(spark, d)).select(F.col("rule").cast("int").alias("rule"), "type", "file", "line")


@query(f"{duck('rule_lines')}, hits AS (SELECT file, line, unnest(regexp_extract_all(text, {q(V.URL)})) AS url FROM rule_lines) SELECT DISTINCT file, url, {sql_url_category('url')} AS category FROM hits WHERE NOT {sql_any('lower(url)', V.NOISE)}")
def url_rules(spark, d):
    """Every host and path that decides the category of a URL."""
    return scan.discover_urls(rule_lines(spark, d)).where("category <> 'websocket'").select("file", "url", "category")


@query(f"""{duck("class_sources")} SELECT file, 'run' AS name, 'void' AS return_type, '' AS params, false AS is_override,
  CAST(length(regexp_extract(content, 'run\\(\\) \\{{([^}}]*)\\}}', 1)) - length(replace(regexp_extract(content, 'run\\(\\) \\{{([^}}]*)\\}}', 1), chr(10), '')) AS INT) AS body_lines FROM class_sources""")
def class_methods(spark, d):
    found = classes(spark, d).select("file", F.explode("methods").alias("m"))
    return found.select("file", "m.name", "m.return_type", F.array_join("m.params", ",").alias("params"), "m.is_override", "m.body_lines")


@query(f"{duck('class_sources')} SELECT file, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '(?m)^@(\\w+)', 1))), ',') AS annotations FROM class_sources")
def class_annotations(spark, d):
    found = structure.class_headers(relation(spark, d, "class_sources"))
    return found.select("file", F.array_join(F.sort_array("annotations"), ",").alias("annotations"))


@query("""WITH t AS (SELECT unnest(['Long', 'Boolean', 'String', 'List<Int>', 'Map<String, Int>', 'Foo']) AS kotlin, unnest(range(6)) AS k)
SELECT p_partkey, kotlin, CASE WHEN starts_with(kotlin, 'List<') THEN 'emptyList()' WHEN starts_with(kotlin, 'Map<') THEN 'emptyMap()' WHEN kotlin = 'Long' THEN '0L' WHEN kotlin = 'Boolean' THEN 'false' WHEN kotlin = 'String' THEN '""' ELSE 'null' END AS value FROM part JOIN t ON p_partkey % 6 = k""")
def kotlin_defaults(spark, d):
    kotlin = F.element_at(F.array(*[F.lit(x) for x in ("Long", "Boolean", "String", "List<Int>", "Map<String, Int>", "Foo")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", kotlin.alias("kotlin")).withColumn("value", rules.kotlin_default(F.col("kotlin")))


UUID_SQL = "concat('/s/', substr(md5(CAST(o_orderkey AS STRING)), 1, 8), '-', substr(md5(CAST(o_orderkey AS STRING)), 9, 4), '-', substr(md5(CAST(o_orderkey AS STRING)), 13, 4), '-', substr(md5(CAST(o_orderkey AS STRING)), 17, 4), '-', substr(md5(CAST(o_orderkey AS STRING)), 21, 12), CASE WHEN o_orderkey % 2 = 0 THEN '/items/' ELSE '/' END, CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '/' ELSE 'x' END)"


@query(f"""SELECT o_orderkey, rtrim(regexp_replace(regexp_replace({UUID_SQL}, '/[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '/{{id}}'), '/[0-9]+(/|$)', '/{{id}}\\1'), '/') AS path FROM orders""")
def path_ids(spark, d):
    """Paths whose ids are UUIDs and numbers."""
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", rules.normal_path(F.expr(UUID_SQL)).alias("path"))


@query(f"{ENGINE_SQL} SELECT archive, CASE engine {' '.join(f'WHEN {q(k)} THEN {q(n)}' for k, n in V.ENGINE_NAMES.items())} ELSE engine END AS name FROM engines")
def engine_names(spark, d):
    named = F.create_map(*[F.lit(x) for kv in V.ENGINE_NAMES.items() for x in kv])
    found = package.detect_engines(relation(spark, d, "archive_entries"))
    return found.select("archive", F.coalesce(F.try_element_at(named, "engine"), "engine").alias("name"))


MANY_SQL = """WITH rows AS (SELECT doc_id, 'src/D' || CAST(doc_id // 4 AS VARCHAR) || '.java' AS name, text, list_distinct(regexp_extract_all(text, '\\b[A-Za-z_]\\w{2,}')) AS tokens FROM documents),
originals AS (SELECT 'old/' || name AS path, name, tokens FROM rows WHERE doc_id % 4 = 0 AND doc_id % 5 <> 0),
others AS (SELECT 'new/' || CAST(doc_id % 4 AS VARCHAR) || '/' || name AS path, name, tokens FROM rows WHERE doc_id % 4 > 0 AND doc_id % 3 <> 0),
firsts AS (SELECT name, min(path) AS path, arg_min(tokens, path) AS tokens FROM others GROUP BY 1),
pairs AS (SELECT a.path AS original_path, b.path AS reconstructed_path, len(list_intersect(a.tokens, b.tokens)) AS both_, len(a.tokens) AS na, len(b.tokens) AS nb FROM originals a JOIN firsts b USING (name))"""


def many(spark, d):
    """Originals with up to three counterparts of their name, and files of either side without any."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.lit("src/D"), F.expr("doc_id div 4").cast("string"), F.lit(".java"))
    old = docs.where("doc_id % 4 = 0 AND doc_id % 5 <> 0").select(F.concat(F.lit("old/"), name).alias("file"), F.col("text").alias("content"))
    new = docs.where("doc_id % 4 > 0 AND doc_id % 3 <> 0").select(F.concat(F.lit("new/"), F.expr("doc_id % 4").cast("string"), F.lit("/"), name).alias("file"), F.col("text").alias("content"))
    return compare.compare_sources(old, new)


@query(f"{MANY_SQL} SELECT original_path, reconstructed_path, CAST(CASE WHEN na = 0 AND nb = 0 THEN 100 WHEN na = 0 OR nb = 0 THEN 0 ELSE floor(100.0 * both_ / (na + nb - both_) + 0.5) END AS INT) AS similarity FROM pairs")
def compare_first_of_many(spark, d):
    return many(spark, d).matches.select("original_path", "reconstructed_path", "similarity")


@query(f"{MANY_SQL} SELECT 'original' AS side, path FROM originals WHERE path NOT IN (SELECT original_path FROM pairs) UNION ALL SELECT 'reconstructed', path FROM others WHERE path NOT IN (SELECT reconstructed_path FROM pairs)")
def compare_left_over(spark, d):
    found = many(spark, d)
    one = found.unmatched_originals.select(F.lit("original").alias("side"), F.col("original_path").alias("path"))
    return one.union(found.unmatched_reconstructed.select(F.lit("reconstructed"), "reconstructed_path"))
