"""Examples of the product's operators with exact expected values."""

import hashlib
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.operators import compare, endpoints, package, scan, structure
from lodestone.plans import pipeline, plugins, report
from lodestone.sources import archives, files
from lodestone.streaming import watch


def lines_of(spark, text, file="A.java"):
    return spark.createDataFrame([(0, file, k + 1, t) for k, t in enumerate(text.split("\n"))], "dir_ord int, file string, line int, text string")


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("url", "category"), [
    ("https://api.example.com/api/v1/users", "api"), ("https://d1234.cloudfront.net/assets/sprite.png", "cdn"), ("https://cdn.example.com/bundles/main", "cdn"),
    ("https://www.google-analytics.com/collect", "analytics"), ("https://app-measurement.com/log", "analytics"), ("https://x.net/auth/login", "auth"), ("https://x.net/api/token", "auth"),
    ("wss://x.net/s", "websocket"), ("ws://localhost:8080/socket", "websocket"), ("https://x.net/about", "unknown"),
])
def test_url_category(spark, url, category):
    assert value(spark, rules.url_category, url) == category


@pytest.mark.parametrize(("path", "category"), [
    ("/auth/login", "auth"), ("/api/v1/register", "auth"), ("/token", "auth"), ("/api/session", "session"), ("/api/v1/battle/start", "gameplay"), ("/match/join", "gameplay"),
    ("/shop/items", "store"), ("/api/purchase", "store"), ("/gacha/pull", "store"), ("/friends/list", "social"), ("/guild/join", "social"), ("/config/game", "gameplay"), ("/leaderboard/team", "social"), ("/zzz", "unknown"),
])
def test_endpoint_category(spark, path, category):
    assert value(spark, rules.endpoint_category, path) == category


def test_scan_of_a_file(spark):
    text = """
class A {
  client.post("/api/v1/scores", body);
  client.get("/api/v1/leaderboards");
  String jwtToken; // Bearer x
  String u = "https://api.game.net/v1/play?x=1", n = "http://schemas.android.com/x";
  String w = "wss://rt.game.net/ws;";
  String again = "https://api.game.net/v1/play?x=1";
}
"""
    found = scan.scan_lines(lines_of(spark, text), lines_of(spark, text).select("file").distinct())
    assert {(r["url"], r["line"], r["category"]) for r in found.urls.collect()} == {("https://api.game.net/v1/play?x=1", 6, "api"), ("wss://rt.game.net/ws", 7, "websocket")}
    got = {(r["method"], r["path"], r["line"], r["category"]) for r in found.endpoints.collect()}
    assert got == {("POST", "/api/v1/scores", 3, "unknown"), ("GET", "/api/v1/leaderboards", 4, "unknown"), ("UNKNOWN", "/v1/play", 6, "gameplay"), ("UNKNOWN", "/ws", 7, "unknown")}
    assert {(r["type"], r["line"]) for r in found.auth.collect()} == {("jwt", 5), ("bearer", 5)}
    assert found.summary()["categories"] == {"unknown": 3, "gameplay": 1}


def test_method_window_and_empty_file(spark):
    rows = scan.with_methods(lines_of(spark, 'a\n"/shop/x"\nb\nc\n.put(x)\n"POST"')).orderBy("line").collect()
    assert [r["method"] for r in rows] == ["UNKNOWN", "PUT", "PUT", "PUT", "PUT", "POST"]
    assert scan.discover_urls(lines_of(spark, "")).count() == 0


def test_quoted_paths(spark):
    text = '"/api/session"\n"/api/v1/a"\n"/api//a"\n"/login/x"\n"/users"\n"/users/9"\n\'/login"'
    assert [r["path"] for r in scan.literal_paths(lines_of(spark, text)).orderBy("line", "rule").collect()] == ["/api/v1/a", "/api//a", "/users/9", "/login"]


def test_endpoint_catalogue(spark):
    rows = [(1, "UNKNOWN", "/auth/login", None, "auth"), (2, "POST", "/auth/login/", "https://x.net/auth/login", "auth"), (3, "GET", "/api/v1/players/12345", None, "unknown"), (4, "GET", "/s/123e4567-e89b-12d3-a456-426614174000", None, "store"), (5, "GET", "//", None, "unknown")]
    raw = spark.createDataFrame(rows, "ord int, method string, path string, full_url string, category string").withColumns({"file": F.lit("f"), "line": F.col("ord"), "context": F.lit("")})
    got = endpoints.catalogue(endpoints.map_endpoints(raw)).collect()
    assert [r["path"] for r in got] == ["/auth/login", "/s/{id}", "/", "/api/v1/players/{id}"]
    assert (got[0]["method"], got[0]["full_url"], len(got[0]["sources"]), got[0]["response_hint"]) == ("POST", "https://x.net/auth/login", 2, None)
    assert got[1]["parameters"][0].asDict() == {"name": "id", "location": "path", "type": "string"}


@pytest.mark.parametrize(("entries", "engine"), [
    (["lib/arm64-v8a/libunity.so", "assets/bin/Data/Managed/A.dll"], "unity-mono"), (["lib/a/libunity.so", "lib/a/libil2cpp.so"], "unity-il2cpp"),
    (["lib/a/libUE4.so"], "unreal"), (["lib/a/libgodot_android.so"], "godot"), (["classes.dex"], "native"),
])
def test_engines(spark, entries, engine):
    rows = spark.createDataFrame([("a", k, e) for k, e in enumerate(entries)], "archive string, entry_ord int, entry string")
    assert package.detect_engines(rows).first()["engine"] == engine


def axml(pool, elements):
    """A compiled document: elements are (name, [(name, type, value)]) or a closing name."""
    index = {s: k for k, s in enumerate(pool)}
    data, offsets = b"", []
    for s in pool:
        offsets.append(len(data))
        raw = s.encode("utf-16-le")
        data += struct.pack("<H", len(s)) + raw + b"\0\0"
    data += b"\0" * (-len(data) % 4)
    head = 28 + 4 * len(pool)
    body = struct.pack("<HHIIIIII", 1, 28, head + len(data), len(pool), 0, 0, head, 0) + b"".join(struct.pack("<I", o) for o in offsets) + data
    for e in elements:
        if isinstance(e, str):
            body += struct.pack("<HHIIiii", 0x103, 16, 24, 1, -1, -1, index[e])
        else:
            name, attributes = e
            body += struct.pack("<HHIIi", 0x102, 16, 36 + 20 * len(attributes), 1, -1) + struct.pack("<iiHHHHHH", -1, index[name], 20, 20, len(attributes), 0, 0, 0)
            for key, kind, v in attributes:
                body += struct.pack("<iiiHBBI", -1, index[key], index[v] if kind == 3 else -1, 8, 0, kind, index[v] if kind == 3 else v & 0xFFFFFFFF)
    return struct.pack("<HHI", 3, 8, 8 + len(body)) + body


def test_compiled_manifest():
    data = axml(["manifest", "package", "com.a<b", "versionCode", "debug"], [("manifest", [("package", 3, "com.a<b"), ("versionCode", 0x10, 7), ("debug", 0x12, 1)]), "manifest"])
    assert archives.decode_xml(data).split("\n")[1:] == ['<manifest package="com.a&lt;b" versionCode="7" debug="true">', "</manifest>"]
    assert archives.decode_xml(b"<manifest/>") is None and archives.decode_xml(b"") is None and archives.decode_xml(None) is None


MANIFEST = '<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.x" android:versionCode="3"><uses-sdk android:minSdkVersion="21"/><uses-permission android:name="android.permission.INTERNET"/><application><activity android:name=".Main"><intent-filter/></activity><receiver name=".R"/></application></manifest>'


def bundle(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_commands(spark, tmp_path):
    inner = bundle([("AndroidManifest.xml", MANIFEST), ("lib/x86/libunity.so", "")])
    (tmp_path / "game.xapk").write_bytes(bundle([("other.apk", b"x"), ("base.apk", inner)]))
    work = str(tmp_path / "work")
    found = pipeline.ingest(spark, str(tmp_path / "game.xapk"), work)
    source = tmp_path / "work/extracted/a/ApiClient.java"
    source.parent.mkdir(parents=True)
    source.write_text('package com.x;\nimport java.util.List;\n@Keep\npublic class ApiClient {\n  private static final int MAX = 3;\n  private Object o;\n  @Override\n  public String run(int a, List<String> b) {\n    post("/auth/login", jwt);\n    return go();\n  }\n  int none() {}\n}\n')
    (tmp_path / "work/extracted/skip.bin").write_text("https://x.net/zip")
    (tmp_path / "work/extracted/AndroidManifest.xml").unlink()
    assert found["meta"]["sha256"] == hashlib.sha256(inner).hexdigest() == found["meta"]["apkFiles"][0]["sha256"]
    assert found["meta"]["engine"] == "unity-mono" and found["meta"]["inputType"] == "xapk" and found["meta"]["nativeLibs"] == [{"name": "libunity.so", "abi": "x86", "path": "lib/x86/libunity.so"}]
    assert found["manifest"]["packageName"] == "com.x" and found["manifest"]["versionCode"] == "3" and found["manifest"]["versionName"] == "0.0.0" and found["manifest"]["minSdkVersion"] == "21"
    assert found["manifest"]["permissions"] == ["android.permission.INTERNET"] and found["manifest"]["activities"] == [".Main"] and found["manifest"]["receivers"] == [".R"]
    result = pipeline.scan_workdir(spark, work)
    paths = pipeline.write_reports(found, result, work)
    text = open(paths["markdown"]).read()
    for part in ("# APK Analysis Report", "| Engine | Unity (Mono) |", "- `INTERNET`", "| 1 | `?` | `/auth/login` | auth | 1 |", "### Jwt", "Unity Mono build detected", "1 auth endpoint(s)", "`a/ApiClient.java` line 9"):
        assert part in text
    data = json.load(open(paths["json"]))
    assert data["endpoints"] == [{"method": "UNKNOWN", "path": "/auth/login", "fullUrl": None, "category": "auth", "sourceCount": 1}]
    assert data["scan"] == {"totalFiles": 1, "filesScanned": 1, "urlsFound": 0, "endpointsFound": 1, "authPatternsFound": 1, "categories": {"auth": 1}}
    meta = pipeline.reconstruct(spark, work)
    assert (meta["classesFound"], meta["classesReconstructed"], meta["categories"]["network"], meta["fidelityScore"]) == (1, 1, 1, 88)
    assert [g["gapType"] for g in meta["gaps"]] == ["missing-body", "unclear-type", "inferred-pattern"]
    kotlin = (tmp_path / "work/reconstructed/src/main/java/com/x/ApiClient.kt").read_text()
    for part in ("package com.x\n\nimport kotlin.collections.List\n", "        const val MAX: Int = 3\n", "    var o: Any = Any()\n", '    override fun run(a: Int, b: List<String>): String {\n        TODO("Reconstructed — 3 original lines")\n    }\n', "[missing-body]", "(confidence: 70%)"):
        assert part in kotlin
    same = pipeline.compare(spark, f"{work}/extracted", f"{work}/extracted", str(tmp_path / "c.md"))
    assert same.overall().first()[0] == 100 and "| **Overall similarity** | **100%** |" in (tmp_path / "c.md").read_text()
    tools = pipeline.decompile(spark, "x.apk", work)
    assert list(tools) == ["jadx", "assetripper"] and "not installed" in tools["jadx"]["error"]
    assert "missing" in pipeline.decompile(spark, "x.apk", work, ["il2cppdumper"])["il2cppdumper"]["error"]
    assert pipeline.decompile(spark, "none.apk", work, ["jadx"], {"jadx": "/bin/ls"})["jadx"]["error"]
    assert pipeline.report(spark, work)["json"].endswith("report.json")
    assert [e["path"] for e in json.load(open(f"{work}/analysis/endpoints.json"))] == ["/auth/login"] and json.load(open(f"{work}/analysis/scan-summary.json"))["endpointsFound"] == 1
    assert pipeline.reconstruct(spark, str(tmp_path / "none"))["fidelityScore"] == 0


def test_analyze_without_tools(spark, tmp_path, monkeypatch):
    """From .apk and .xapk to both reports, with a relative working directory, hidden names and damaged entries."""
    monkeypatch.chdir(tmp_path)
    inner = bundle([("AndroidManifest.xml", MANIFEST), ("assets/_config.json", '{"u": "https://api.game.net/v1/play"}'), ("_Root/.x/a.txt", 'p("/shop/items")'), ("../../evil.txt", "x"), ("res/", "")])
    damaged = bytearray(bundle([("AndroidManifest.xml", MANIFEST), ("a.txt", "secret words" * 50)]))
    at = damaged.rindex(b"PK\x01\x02")
    damaged[at + 8] |= 1  # marked as encrypted
    (tmp_path / "a.apk").write_bytes(inner)
    (tmp_path / "b.xapk").write_bytes(bundle([("split.apk", b"no archive"), ("BASE.apk", inner)]))
    (tmp_path / "c.apk").write_bytes(bytes(damaged))
    for package, work in (("a.apk", "./out a"), ("b.xapk", "out/x/../b")):
        made = pipeline.analyze(spark, str(tmp_path / package), work, tools=())
        data = json.load(open(made["json"]))
        assert [(u["url"], u["file"]) for u in data["urls"]] == [("https://api.game.net/v1/play", "assets/_config.json")] and "# APK Analysis Report" in open(made["markdown"]).read()
        assert {e["path"] for e in data["endpoints"]} == {"/v1/play", "/shop/items"} and data["scan"]["totalFiles"] == 3
    assert not (tmp_path.parent / "evil.txt").exists() and not (tmp_path / "evil.txt").exists()
    assert pipeline.ingest(spark, str(tmp_path / "c.apk"), str(tmp_path / "c"))["manifest"]["packageName"] == "com.x" and (tmp_path / "c/extracted/a.txt").read_text().startswith("secret")
    (tmp_path / "d.xapk").write_bytes(bundle([("readme.txt", "x")]))
    with pytest.raises(ValueError, match="no package"):
        pipeline.ingest(spark, str(tmp_path / "d.xapk"), "d")
    from lodestone.__main__ import parser, run

    said = run(spark, parser().parse_args(["-q", "scan", "./out a"]))
    assert "totalFiles: 3" in said and run(spark, parser().parse_args(["compare", "./out a/extracted", "out/b/extracted", "-o", "c.md"])).endswith("100%")


@pytest.mark.parametrize(("xml", "name", "activities"), [
    ("<manifest package='a.b'><application><activity android:name=\"it's &amp; A&#66;&#x43;\"/></application></manifest>", "a.b", ["it's & ABC"]),
    ("<manifest label=\"a>b\" package='x\"y'><application label='>'><activity\n name = '.N'></activity><!-- <activity name='.C'/> --></application></manifest>", 'x"y', [".N"]),
    ("<manifest package=\"\"><application/></manifest>", "", []), ("<manifest/>", "unknown", []), ("<manifest a='&amp;lt;' package='&lt;&amp;lt;'/>", "<&lt;", []),
])
def test_manifests_as_xml(spark, xml, name, activities):
    got = package.parse_manifests(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (got["package_name"], got["activities"]) == (name, activities)


@pytest.mark.parametrize(("url", "path"), [
    ("https://x.net/a/./b/../c?q=1", "/a/c"), ("https://x.net/a/b/..", "/a/"), ("https://x.net/..", None), ("https://x.net/a/%2e%2E/b", "/b"), ("https://x.net/é{id}", "/%C3%A9%7Bid%7D"), ("https://x.net", None), ("https://x.net//a//", "//a//"),
])
def test_url_paths(spark, url, path):
    assert value(spark, rules.url_path, url) == path


def test_comparison_of_names_and_tokens(spark):
    old = spark.createDataFrame([("a/Foo.kts.kt", "class Foo val x = 1"), ("b/Bar.java", "alpha beta"), ("E.java", "")], "file string, content string")
    new = spark.createDataFrame([("Foos.kt.java", "class Foo fun go()"), ("z/Bar.java", "beta gamma"), ("y/Bar.java", "alpha beta"), ("E.java", "")], "file string, content string")
    got = compare.compare_sources(old, new)
    rows = {r["original_path"]: r for r in got.matches.collect()}
    assert (rows["b/Bar.java"]["reconstructed_path"], rows["b/Bar.java"]["similarity"], rows["E.java"]["similarity"]) == ("y/Bar.java", 100, 100)
    assert rows["a/Foo.kts.kt"]["shared_symbols"] == ["Foo"]
    assert [r[0] for r in got.unmatched_reconstructed.collect()] == ["z/Bar.java"]
    assert report.bar(50, 4) == "[██░░] 50%"


def test_types_and_defaults(spark):
    for java, kotlin in (("void", "Unit"), ("int[][]", "Array<Array<Int>>"), ("Map<String, List<Integer>>", "Map<String, List<Integer>>"), ("List<List<Integer>>", "List<List<Int>>"), ("Foo", "Foo")):
        assert value(spark, rules.kotlin_type, java) == kotlin
    assert [value(spark, rules.kotlin_default, t) for t in ("Long", "List<Int>", "Foo")] == ["0L", "emptyList()", "null"]


def test_methods_that_are_none(spark):
    got = structure.methods_of("public Foo() {\n}\n else if (x) {\n y();\n }\nMap<String, Integer> m() { }")
    assert [(m["return_type"], m["name"], m["body_lines"]) for m in got] == [("public", "Foo", 1), ("else", "if", 2), ("Integer>", "m", 0)]


def test_trim_and_encoding(spark):
    assert value(spark, rules.trimmed_context, "﻿   x y  ") == "x y"
    assert spark.createDataFrame([(bytearray(b"a\xff\n"),)], "content binary").transform(files.as_text).first()[0] == "a�\n"


def test_plugins(spark):
    registry = plugins.Registry()
    assert registry.select({}).id == "generic" and [p.id for p in registry.list()] == ["generic"]
    assert registry.generic.can_handle({"engine": "native"}) and not registry.generic.can_handle({"engine": "unreal"})
    rows = plugins.plugin_urls(lines_of(spark, '@GET("/a/b")\nnew URL( "https://x.net")'), registry.generic)
    assert [(r["line"], r["url"]) for r in rows.orderBy("line").collect()] == [(1, "/a/b"), (2, "https://x.net")]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.java").write_text("x jwt\njwt\nx jwt")
    stream = watch.watch_auth(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("auth_stream").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted(r["context"] for r in spark.table("auth_stream").collect()) == ["jwt", "x jwt"]


def test_skeleton_notes_are_put_together_once_a_name(spark):
    """600 classes of one name on two paths: each file has the notes of all, and they meet the classes that stay only."""
    source = "package p{};\nclass ab {{\n  private Object ref;\n}}\n"
    rows = spark.createDataFrame([(f"f{k:03}", source.format(k % 2)) for k in range(600)], "file string, content string")
    parsed = structure.parse_classes(rows)
    made = structure.skeletons(parsed, structure.find_gaps(parsed))
    got = {r["path"]: r["text"] for r in made.collect()}
    assert sorted(got) == ["src/main/java/p0/ab.kt", "src/main/java/p1/ab.kt"]
    assert all(t.count("[obfuscated-name]") == t.count("[unclear-type]") == 600 for t in got.values())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("max_by")
