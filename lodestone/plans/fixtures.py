"""Relations of the product's kind, derived from the star-schema tables in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "source_lines": """
SELECT concat('jadx/m', CAST(user_id % 7 AS STRING), '/Client', CAST(user_id AS STRING), '.java') AS file,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS line,
  CASE event_type
    WHEN 'click' THEN concat('  client.post("/api/v1/players/', CAST(user_id AS STRING), '/clicks", body);')
    WHEN 'view' THEN concat('  String p = "/shop/items/', CAST(event_id % 50 AS STRING), '";')
    WHEN 'purchase' THEN concat('  String u = "https://api.game', CAST(event_id % 5 AS STRING), '.net/v1/purchase/', CAST(event_id % 20 AS STRING), '";')
    WHEN 'signup' THEN '  headers.put("Authorization", "Bearer " + jwtToken);'
    ELSE '  // http://schemas.android.com/apk/res/android wss://rt.game.net/ws,' END AS text
FROM events""",
    "rule_lines": """
SELECT concat('R', CAST(event_id % 97 AS STRING), '.cs') AS file, CAST(event_id AS INT) AS line,
  CASE event_id % 6
    WHEN 0 THEN concat('call("/', ' + PATHS + ', CAST(user_id AS STRING), '");')
    WHEN 1 THEN concat('call("/', ' + WORDS + ', '");')
    WHEN 2 THEN concat('x = ', ' + METHODS + ', ';')
    WHEN 3 THEN concat('// ', ' + SECRETS + ')
    WHEN 4 THEN concat('u = "https://', ' + HOSTS + ', '";')
    ELSE concat('u = "https://x.net/', ' + WORDS + ', '/a";') END AS text
FROM events""",
    "raw_endpoints": """
SELECT CAST(o_orderkey AS BIGINT) AS ord,
  CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 3 = 1 THEN 'GET' ELSE 'POST' END AS method,
  concat(CASE WHEN o_orderpriority LIKE '1%' THEN '/auth/token/' WHEN o_orderpriority LIKE '2%' THEN '/shop/items/' ELSE '/api/v1/orders/' END,
    CAST(o_custkey % 40 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '/detail' ELSE '/' END) AS path,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('https://api.game.net/o/', CAST(o_orderkey AS STRING)) END AS full_url
FROM orders""",
    "archive_entries": """
SELECT concat('app', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 3 = 0 THEN '.xapk' WHEN s_suppkey % 3 = 1 THEN '.apk' ELSE '.zip' END) AS archive,
  e.k AS entry_ord,
  CASE e.k WHEN 0 THEN 'AndroidManifest.xml' WHEN 1 THEN 'classes.dex'
    WHEN 2 THEN CASE s_suppkey % 5 WHEN 0 THEN 'lib/arm64-v8a/libunity.so' WHEN 1 THEN 'lib/arm64-v8a/libUE4.so' WHEN 2 THEN 'lib/x86/libgodot_android.so' ELSE 'lib/x86/libmain.so' END
    ELSE CASE WHEN s_suppkey % 10 = 0 THEN 'assets/bin/Data/Managed/Metadata/global-metadata.dat' ELSE 'assets/bin/Data/Managed/Assembly-CSharp.dll' END END AS entry
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) e""",
    "manifests": """
SELECT c_custkey AS app_id,
  concat('<manifest package="com.game.c', CAST(c_custkey AS STRING), '" versionCode="', CAST(c_nationkey AS STRING),
    '"><uses-permission name="android.permission.INTERNET"/><application><activity name=".A', CAST(c_custkey % 9 AS STRING), '"/><service name=".S"/></application></manifest>') AS xml
FROM customer""",
    "class_sources": """
SELECT concat('src/C', CAST(p_partkey AS STRING), '.java') AS file,
  concat('package com.game.p', CAST(p_size AS STRING), ';', chr(10), 'import java.util.List;', chr(10), 'import okhttp3.Call;', chr(10), '@Keep', chr(10), 'public class ',
    CASE WHEN p_partkey % 11 = 0 THEN 'ab' ELSE concat('C', CAST(p_partkey AS STRING)) END,
    CASE WHEN p_partkey % 4 = 0 THEN ' extends AppCompatActivity' WHEN p_partkey % 4 = 1 THEN ' extends SurfaceView implements Runnable, Listener' ELSE '' END,
    ' {', chr(10), '  private static final int MAX = ', CAST(p_size AS STRING), ';', chr(10), '  private Object ref;', chr(10), '  public void run() {', chr(10), '    go();', chr(10), '  }', chr(10), '}', chr(10)) AS content
FROM part""",
}
LISTS = {
    "PATHS": ("api/v2/", "api/", "v3/", "auth/", "users/", "user/", "sessions/", "leaderboards", "scores/", "match/", "player/", "items", "shop/", "purchase/", "inventory/", "rewards/", "events/", "config/", "version/", "update/", "notifications/", "friends/", "guild/", "chat/", "gacha/", "summon/", "battle/", "quests/"),
    "WORDS": ("login", "register", "logout", "token", "score", "mission", "level", "clan", "iap", "store", "metrics", "assets", "profile", "zzz"),
    "METHODS": (".get (u)", "a.Post(u)", ".put(u)", ".delete(u)", ".patch(u)", "HttpMethod.GET", "HttpMethod.Post", "HttpMethod.PUT", "HttpMethod.DELETE", "RequestMethod.GET", "RequestMethod.POST", '"GET"', '"POST"', '"PUT"', '"DELETE"', "UnityWebRequest.Get", "UnityWebRequest.Post", "UnityWebRequest.Put", "UnityWebRequest.Delete", "new WWW (u)", "none"),
    "SECRETS": ("JWT", "json web token", "Bearer x", "OAuth2", "openid", "api_key", "ApiKey", "session-token", "sessionId", "basic auth", "Authorization: Basic", "X-Auth-Token", "x-session-id", "refresh_token", "accessToken", "nothing"),
    "HOSTS": ("www.google-analytics.com/a", "sentry.io/b", "x.cloudfront.net/c", "cdn.x.net/d", "assets.x.net", "x.net/auth", "x.net/oauth", "x.net/api/e", "x.net/v1/f", "x.net/g", "schemas.android.com/h"),
}
for _name, _words in LISTS.items():
    SQL["rule_lines"] = SQL["rule_lines"].replace(f"' + {_name} + '", "CASE (event_id div 6) % " + str(len(_words)) + "".join(f" WHEN {k} THEN '{w}'" for k, w in enumerate(_words)) + " END")
TABLE_OF = {"rule_lines": "events", "source_lines": "events", "raw_endpoints": "orders", "archive_entries": "supplier", "manifests": "customer", "class_sources": "part"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLE_OF[name]
    template = SQL[name].replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", f"FROM {{{table}}}")
    made = spark.sql(template, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})
    return made.withColumn("dir_ord", F.lit(0)) if name == "source_lines" else made


def duck(*names: str) -> str:
    """The relations as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].replace(' div ', ' // ')})" for n in names)
