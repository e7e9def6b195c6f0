"""The commands: ingest, scan, report, analyze, decompile, reconstruct and compare."""

from __future__ import annotations

import logging
import shutil
import subprocess
import time
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import values as V
from lodestone.operators import compare as comparing
from lodestone.operators import endpoints, scan, structure
from lodestone.plans import report as reports
from lodestone.plans.plugins import EnginePlugin, Registry
from lodestone.sources import archives, files, storage

STAGES = ("urls", "endpoints", "auth", "categories", "files")
#: Seconds that a tool may take.
TOOL_SECONDS = 600
# Arguments of the tools, their output folders, and where a package keeps what the dumper reads.
TOOLS: dict[str, Callable[[list[str], str], list[str]]] = {
    "jadx": lambda sources, out: ["jadx", "-d", out, "--no-res", "--no-debug-info", *sources],
    "assetripper": lambda sources, out: ["AssetRipper", *sources, "-o", out, "-q"],
    "il2cppdumper": lambda sources, out: ["Il2CppDumper", *sources, out],
}
OUTPUT = {"jadx": "jadx", "assetripper": "unity", "il2cppdumper": "il2cpp"}
DUMPED_LIBS = ("lib/arm64-v8a/libil2cpp.so", "lib/armeabi-v7a/libil2cpp.so", "lib/x86_64/libil2cpp.so", "lib/x86/libil2cpp.so")
DUMPED_METADATA = "assets/bin/Data/Managed/Metadata/global-metadata.dat"

logger = logging.getLogger("lodestone")


def scan_folders(spark: SparkSession, folders: Sequence[str], workdir: str, plugin: EnginePlugin | None = None) -> scan.ScanResult:
    """Scans the folders in order and keeps the results in workdir/analysis, as tables and as JSON files.

    A plugin adds folders and a last step over the endpoints. What is scanned
    once is written and read again; nothing stays in memory.
    """
    workdir = files.qualified(spark, workdir)
    folders = [*folders, *(plugin.additional_scan_dirs(workdir) if plugin else [])]
    found = files.source_files(spark, folders)
    if found is None:
        raise ValueError("no source folder to scan")
    lines = files.numbered_lines(files.as_text(found)).persist()
    result = scan.scan_lines(lines, found.select("dir_ord", "file"))
    if plugin:
        result.endpoints = plugin.post_process(result.endpoints)
        result.categories = scan.category_counts(result.endpoints)
    for name in STAGES:
        getattr(result, name).write.mode("overwrite").parquet(f"{workdir}/analysis/{name}")
    lines.unpersist()
    kept = read_scan(spark, workdir)
    write_artefacts(kept, workdir)
    return kept


def write_artefacts(result: scan.ScanResult, workdir: str) -> None:
    """endpoints.json, urls.json, auth-flow.json and scan-summary.json in reading order, a row at a time."""
    parts = {
        "endpoints": (result.endpoints, ("method", "path", F.col("full_url").alias("fullUrl"), "file", "line", "context", "category")),
        "urls": (result.urls, ("url", "file", "line", "context", "category")),
        "auth-flow": (result.auth, ("type", "file", "line", "context")),
    }
    for name, (rows, columns) in parts.items():
        said = rows.orderBy("ord").select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
        storage.write_array(f"{workdir}/analysis/{name}.json", (r[0] for r in said.toLocalIterator()))
    storage.write_json(f"{workdir}/analysis/scan-summary.json", result.summary())


def scan_workdir(spark: SparkSession, workdir: str) -> scan.ScanResult:
    """Scans those of jadx, unity, il2cpp and extracted that exist, and keeps the results in analysis/."""
    workdir = files.qualified(spark, workdir)
    return scan_folders(spark, files.existing(spark, workdir, files.SCAN_FOLDERS), workdir)


def read_scan(spark: SparkSession, workdir: str) -> scan.ScanResult:
    return scan.ScanResult(*[spark.read.parquet(f"{workdir}/analysis/{name}") for name in STAGES])


def ingest(spark: SparkSession, package: str, workdir: str) -> dict:
    """The facts of one package as plain values, also kept as manifest.json and meta.json in workdir; its entries go to workdir/extracted."""
    workdir = files.qualified(spark, workdir)
    found = archives.ingest(spark, package)
    manifest, meta = found["manifests"].first(), found["meta"].first()
    if meta is None:
        raise ValueError(f"no package in {package}")
    if manifest is None:
        raise ValueError(f"no manifest in {package}")
    m = {"packageName": manifest["package_name"], "versionCode": manifest["version_code"], "versionName": manifest["version_name"], "minSdkVersion": manifest["min_sdk_version"], "targetSdkVersion": manifest["target_sdk_version"], "permissions": manifest["permissions"], "activities": manifest["activities"], "services": manifest["services"], "contentProviders": manifest["content_providers"], "receivers": manifest["receivers"]}
    libs = found["native_libs"].orderBy("entry_ord").select("name", "abi", "path").collect()
    t = {"inputType": meta["input_type"], "engine": meta["engine"], "sha256": meta["sha256"], "apkFiles": [{"path": package, "sha256": meta["sha256"]}], "nativeLibs": [x.asDict() for x in libs], "hasGlobalMetadata": meta["has_global_metadata"], "hasManagedDlls": meta["has_managed_dlls"]}
    found["entries"].unpersist()
    n = archives.extract(spark, package, f"{workdir}/extracted")
    logger.info("%s: engine %s, %d entries extracted", m["packageName"], t["engine"], n)
    storage.write_json(f"{workdir}/manifest.json", m)
    storage.write_json(f"{workdir}/meta.json", t)
    return {"manifest": m, "meta": t}


def tools_of(spark: SparkSession, engine: str) -> list[str]:
    """The tools that an engine asks for."""
    return spark.range(1).select(rules.tools_for(F.lit(engine))).first()[0]


def tool_sources(spark: SparkSession, tool: str, package: str, workdir: str) -> list[str] | None:
    """What a tool reads; null if it isn't there."""
    if tool != "il2cppdumper":
        return [package]
    folder = f"{workdir}/extracted"
    libs, metadata = files.existing(spark, folder, DUMPED_LIBS), files.existing(spark, folder, [DUMPED_METADATA])
    return [libs[0], metadata[0]] if libs and metadata else None


def decompile(spark: SparkSession, package: str, workdir: str, tools: Sequence[str] | None = None, paths: dict[str, str] | None = None, seconds: int = TOOL_SECONDS) -> dict[str, dict]:
    """Runs external tools on the driver, by default those that the package's engine asks for; a tool that fails doesn't stop the others."""
    workdir = files.qualified(spark, workdir)
    if tools is None:
        tools = tools_of(spark, storage.read_json(f"{workdir}/meta.json")["engine"])
    out = {}
    for tool in tools:
        target, began = f"{workdir}/{OUTPUT[tool]}", time.time()
        sources, error = tool_sources(spark, tool, package, workdir), ""
        command = TOOLS[tool](sources or [], target)
        command[0] = (paths or {}).get(tool, command[0])
        if sources is None:
            error = "libil2cpp.so or global-metadata.dat is missing"
        elif not shutil.which(command[0]):
            error = f"{command[0]} is not installed"
        if not error:
            try:
                done = subprocess.run(command, capture_output=True, text=True, timeout=seconds, check=False)
                error = (done.stderr[-500:] or f"ended with code {done.returncode}") if done.returncode else ""
            except (subprocess.TimeoutExpired, OSError) as failure:
                error = f"stopped after {seconds} s" if isinstance(failure, subprocess.TimeoutExpired) else str(failure)
        if error:
            logger.warning("%s: %s", tool, error)
        out[tool] = {"tool": tool, "success": not error, "output_dir": target, "duration": int((time.time() - began) * 1000), "error": error or None}
    return out


def write_reports(found: dict, result: scan.ScanResult, workdir: str, formats: Sequence[str] = ("markdown", "json"), decompiled: dict | None = None) -> dict[str, str]:
    """Reports of one package under workdir/analysis, by format."""
    made = reports.Report(found["manifest"], found["meta"], result, endpoints.map_endpoints(result.endpoints), decompiled or {})
    out = {}
    if "markdown" in formats:
        out["markdown"] = storage.write_text(f"{workdir}/analysis/report.md", reports.markdown_report(made))
    if "json" in formats:
        out["json"] = storage.write_json(f"{workdir}/analysis/report.json", reports.json_report(made))
    return out


def report(spark: SparkSession, workdir: str, formats: Sequence[str] = ("markdown", "json")) -> dict[str, str]:
    """Reports from what ingest and scan kept in workdir."""
    workdir = files.qualified(spark, workdir)
    found = {name: storage.read_json(f"{workdir}/{name}.json") for name in ("manifest", "meta")}
    return write_reports(found, read_scan(spark, workdir), workdir, formats)


def analyze(spark: SparkSession, package: str, workdir: str = "./analysis-output", tools: Sequence[str] | None = None, formats: Sequence[str] = ("markdown", "json"), paths: dict[str, str] | None = None, registry: Registry | None = None) -> dict[str, str]:
    """Ingests a package, decompiles it, scans the tools' output and the extracted entries, and reports.

    Without tools the engine's are run; an empty list runs none.
    """
    workdir = files.qualified(spark, workdir)
    found = ingest(spark, package, workdir)
    decompiled = decompile(spark, package, workdir, tools, paths)
    made = [x["output_dir"] for x in decompiled.values() if x["success"]]
    folders = [d for d in made if files.existing(spark, d, [""])] + files.existing(spark, workdir, ["extracted"])
    plugin = (registry or Registry()).select(found["meta"])
    return write_reports(found, scan_folders(spark, folders, workdir, plugin), workdir, formats, decompiled)


def reconstruct(spark: SparkSession, workdir: str, output: str | None = None) -> dict:
    """Writes a Kotlin project of the classes found in workdir; returns counts, categories and the fidelity score.

    Class files are written by the tasks that hold them, to one shared file
    system; only counts and the first gaps come to the driver.
    """
    workdir = files.qualified(spark, workdir)
    output = files.qualified(spark, output or f"{workdir}/reconstructed")
    found = files.source_files(spark, files.existing(spark, workdir, files.CLASS_FOLDERS), extensions=V.CLASS_EXTENSIONS, max_bytes=None)
    sources = None if found is None else files.as_text(found).select("file", "content")
    n = 0 if sources is None else sources.count()
    if not n:
        return {"classesFound": 0, "classesReconstructed": 0, "fidelityScore": 0, "categories": dict.fromkeys(V.COMPONENTS, 0), "gapCount": 0, "gaps": []}
    classes = structure.parse_classes(sources).persist()
    gaps = structure.find_gaps(classes).persist()

    def write(rows) -> None:
        for r in rows:
            storage.write_text(f"{output}/{r['path']}", r["text"])

    structure.skeletons(classes, gaps).foreachPartition(write)
    facts = classes.agg(F.count("*").alias("n"), F.max(F.col("category").isin("activity", "view", "service", "receiver")).alias("android"), F.min_by("package_name", F.when(F.col("package_name") != "", F.col("file"))).alias("package")).first()
    storage.write_text(f"{output}/build.gradle.kts", reports.build_file(facts["package"], bool(facts["android"])))
    storage.write_text(f"{output}/settings.gradle.kts", 'rootProject.name = "reconstructed-game"\n')
    shown = gaps.orderBy("file", "gap_ord").limit(reports.SHOWN_GAPS).collect()
    meta = {"classesFound": n, "classesReconstructed": facts["n"], "fidelityScore": structure.fidelity(classes, gaps).first()[0], "categories": dict(structure.component_counts(classes).collect()), "gapCount": gaps.count(), "gaps": [{"className": g["class_name"], "gapType": g["gap_type"], "description": g["description"], "confidence": g["confidence"]} for g in shown]}
    classes.unpersist()
    gaps.unpersist()
    storage.write_json(f"{output}/reconstruction-meta.json", meta)
    return meta


def compare(spark: SparkSession, original: str, reconstructed: str, output: str | None = "./comparison-report.md") -> comparing.Comparison:
    sides: list[DataFrame] = [files.as_text(files.list_files(spark, d, V.COMPARED_EXTENSIONS, None)).select("file", "content") for d in (original, reconstructed)]
    result = comparing.compare_sources(*sides)
    if output:
        storage.write_text(output, reports.compare_report(result, datetime.now(UTC).isoformat()))
    return result
