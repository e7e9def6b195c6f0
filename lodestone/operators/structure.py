"""Class structure of sources: parsing, categories, gaps, fidelity and Kotlin skeletons."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import values as V

METHODS = "array<struct<name:string,return_type:string,params:array<string>,annotations:array<string>,is_override:boolean,body_lines:int>>"


def body_ends(text: str, starts: list[int]) -> list[int]:
    """For each place behind an opening brace the newlines up to the brace that closes it, in one walk over the braces."""
    out, open_, newlines, wanted = {}, [], 0, set(starts)
    for m in re.finditer(r"[{}\n]", text):
        c = m.group()
        if c == "\n":
            newlines += 1
        elif c == "{":
            open_.append((m.end(), newlines))
        elif open_:
            at, before = open_.pop()
            if at in wanted:
                out[at] = newlines - before
    out.update((at, newlines - before) for at, before in open_)
    return [out[s] for s in starts]


def methods_of(text: str | None) -> list[dict]:
    found = list(re.finditer(V.METHOD, text or "", re.A))
    bodies = body_ends(text or "", [m.end() for m in found])
    made = []
    for m, lines in zip(found, bodies, strict=True):
        note, said = m[1] or "", m[4].strip()
        made.append({"name": m[3], "return_type": m[2], "params": [p.strip() for p in said.split(",")] if said else [], "annotations": [note.replace("@", "", 1)] if note else [], "is_override": note == "@Override", "body_lines": lines})
    return made


def parse_methods(content: Column) -> Column:
    """Methods in order of their text; needs match offsets and brace depth, which no built-in gives."""

    @F.pandas_udf(METHODS)
    def parse(contents: pd.Series) -> pd.Series:
        return pd.Series([methods_of(x) for x in contents])

    return parse(content)


def parse_fields(content: Column) -> Column:
    group = lambda g: F.regexp_extract_all(content, F.lit(V.FIELD), F.lit(g))
    parts = F.arrays_zip(group(1).alias("s"), group(2).alias("t"), group(3).alias("n"), group(4).alias("v"))
    value = lambda v: F.nullif(F.regexp_replace(v, F.lit(rf"^[{V.WIDE_SPACE}]+|[{V.WIDE_SPACE}]+\z"), F.lit("")), F.lit(""))
    return F.transform(parts, lambda p: F.struct(p["n"].alias("name"), p["t"].alias("type"), (p["s"] != "").alias("is_static"), value(p["v"]).alias("initial_value")))


def class_headers(sources: DataFrame) -> DataFrame:
    """sources (file, content) that declare a class, with its package, imports, annotations and header."""
    head = lambda g: F.regexp_extract("content", V.CLASS_HEADER, g)
    every = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    interfaces = F.filter(F.transform(F.split(head(3), ","), lambda i: F.regexp_replace(i, F.lit(r"^\s+|\s+\z"), F.lit(""))), lambda i: i != "")
    return sources.where(F.col("content").rlike(V.CLASS_HEADER)).withColumns({
        "name": head(1),
        "package_name": F.regexp_extract("content", r"(?m)^package\s+([\w.]+)\s*;", 1),
        "super_class": F.nullif(head(2), F.lit("")),
        "interfaces": interfaces,
        "imports": every(r"(?m)^import\s+([\w.*]+)\s*;"),
        "annotations": F.array_distinct(every(r"(?m)^@(\w+)")),
    })


def class_category() -> Column:
    above, name = F.coalesce(F.lower("super_class"), F.lit("")), F.lower("name")
    imports = F.lower(F.array_join("imports", " "))
    has = lambda c, *ws: rules.any_of(c, ws)
    accessor = lambda m: m["name"].startswith("toString") | m["name"].startswith("hashCode") | m["name"].startswith("equals") | m["name"].startswith("get") | m["name"].startswith("set")
    model = (F.size("methods") <= 3) & (F.size("fields") >= 2) & F.forall("methods", accessor)
    return (
        F.when(has(above, "activity"), "activity").when(has(above, "view"), "view").when(has(above, "service"), "service").when(has(above, "broadcastreceiver"), "receiver")
        .when(has(imports, "httpurlconnection", "okhttp", "retrofit") | has(name, "api", "client", "service", "auth"), "network")
        .when(model, "model").otherwise("utility")
    )


def parse_classes(sources: DataFrame) -> DataFrame:
    """A row for each source that declares a class: header, methods, fields and category."""
    parsed = class_headers(sources).withColumn("methods", parse_methods(F.col("content"))).withColumn("fields", parse_fields(F.col("content")))
    return parsed.withColumn("category", class_category())


def component_counts(classes: DataFrame) -> DataFrame:
    """(category, n) for every component category, 0 included."""
    names = classes.sparkSession.createDataFrame([(c,) for c in V.COMPONENTS], "category string")
    return names.join(classes.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def find_gaps(classes: DataFrame) -> DataFrame:
    """(file, gap_ord, class_name, gap_type, description, confidence): what can't be recovered for certain.

    In the order of class, methods, fields, pattern. Methods of one or two
    letters other than a, b and c are passed over.
    """

    def gap(kind: str, text: Column, sure: float) -> Column:
        return F.struct(F.lit(kind).alias("gap_type"), text.alias("description"), F.lit(sure).alias("confidence"))

    none = F.array().cast("array<struct<gap_type:string,description:string,confidence:double>>")
    only = lambda test, g: F.when(test, F.array(g)).otherwise(none)
    name = F.col("name")
    short_class = (F.length("name") <= 2) & (name != F.upper("name"))
    method = lambda m: F.concat(F.lit('Method "'), name, F.lit("."), m["name"], F.lit('()"'))
    seen = F.filter("methods", lambda m: (F.length(m["name"]) > 2) | m["name"].isin("a", "b", "c"))
    of_methods = F.flatten(F.transform(seen, lambda m: F.concat(
        only(F.length(m["name"]) <= 2, gap("obfuscated-name", F.concat(method(m), F.lit(" has an obfuscated name.")), 0.85)),
        only((m["body_lines"] == 0) & ~F.contains(m["return_type"], F.lit("void")), gap("missing-body", F.concat(method(m), F.lit(" has an empty body.")), 0.7)),
    )))
    vague = F.filter("fields", lambda f: f["type"].isin("Object", "var"))
    of_fields = F.transform(vague, lambda f: gap("unclear-type", F.concat(F.lit('Field "'), name, F.lit("."), f["name"], F.lit('" has a generic type "'), f["type"], F.lit('".')), 0.6))
    network = (F.col("category") == "network") & F.col("super_class").isNull()
    every = F.concat(
        only(short_class, gap("obfuscated-name", F.concat(F.lit('Class "'), name, F.lit('" appears to be ProGuard-obfuscated.')), 0.9)),
        of_methods, of_fields,
        only(network, gap("inferred-pattern", F.concat(F.lit('Class "'), name, F.lit('" appears to be a network layer component (inferred from API usage patterns).')), 0.75)),
    )
    return classes.select("file", name.alias("class_name"), F.posexplode(every).alias("gap_ord", "g")).select("file", "gap_ord", "class_name", "g.*")


def fidelity(classes: DataFrame, gaps: DataFrame) -> DataFrame:
    """fidelity_score of all classes: 0 without any, else 30 for there being some, up to 25 for method bodies, up to 20 less 2 for each obfuscated name, and 25 for categories."""
    sums = classes.agg(F.count("*").alias("n"), F.sum(F.size("methods")).alias("methods"), F.sum(F.size(F.filter("methods", lambda m: m["body_lines"] > 0))).alias("bodies"), F.count_if(F.col("category") != "unknown").alias("named"))
    hidden = gaps.agg(F.count_if(F.col("gap_type") == "obfuscated-name").alias("hidden"))
    bodies = F.when(F.col("methods") > 0, F.lit(25.0) * F.col("bodies") / F.greatest("methods", F.lit(1))).otherwise(0.0)
    score = F.lit(30.0) + bodies + (F.lit(20) - F.least(F.col("hidden") * 2, F.lit(20))) + F.lit(25.0) * F.col("named") / F.greatest("n", F.lit(1))
    return sums.join(hidden).select(F.when(F.col("n") == 0, 0).otherwise(rules.rounded(score)).alias("fidelity_score"))


def skeletons(classes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(path, text): a Kotlin file for each class, the last of equal paths.

    Gaps come by the simple name of the class, so classes of one name share
    them: their notes are put together once a name, and only for the classes
    that stay.
    """
    folder = F.translate("package_name", ".", "/")
    path = F.concat(F.lit("src/main/java/"), F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), "name", F.lit(".kt"))
    held = ["name", "package_name", "super_class", "interfaces", "imports", "methods", "fields"]
    last = classes.groupBy(path.alias("path")).agg(F.max_by(F.struct(*held), "file").alias("c")).select("path", "c.*")
    note = F.concat(F.lit(" *   ["), "gap_type", F.lit("] "), "description", F.lit(" (confidence: "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)"))
    listed = F.array_sort(F.collect_list(F.struct("file", "gap_ord", "gap_type", "description", "confidence", note.alias("note"))))
    by_name = gaps.groupBy("class_name").agg(F.array_join(listed["note"], "\n").alias("notes"))
    rows = last.join(by_name, last["name"] == by_name["class_name"], "left")
    lit = F.lit
    none = F.array().cast("array<string>")
    value = lambda f: F.coalesce(f["initial_value"], rules.kotlin_default(rules.kotlin_type(f["type"])))
    imports = rules.kotlin_imports(F.col("imports"))
    above = F.concat(F.when(F.col("super_class").isNotNull(), F.array(F.concat("super_class", lit("()")))).otherwise(none), F.col("interfaces"))
    head = F.concat(lit("class "), F.col("name"), F.when(F.size(above) > 0, F.concat(lit(" : "), F.array_join(above, ", "))).otherwise(lit("")), lit(" {"))
    field = lambda f, start: F.concat(lit(start), f["name"], lit(": "), rules.kotlin_type(f["type"]), lit(" = "), value(f))
    statics, own = F.filter("fields", lambda f: f["is_static"]), F.filter("fields", lambda f: ~f["is_static"])

    def parameter(p: Column) -> Column:
        parts = F.split(p, r"\s+")
        return F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, -1), lit(": "), rules.kotlin_type(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, lit(0))), " ")))).otherwise(p)

    def method(m: Column) -> Column:
        result = rules.kotlin_type(m["return_type"])
        line = F.concat(F.when(m["is_override"], lit("    override fun ")).otherwise(lit("    fun ")), m["name"], lit("("), F.array_join(F.transform(m["params"], parameter), ", "), lit(")"), F.when(result == "Unit", lit("")).otherwise(F.concat(lit(": "), result)), lit(" {"))
        return F.array(line, F.concat(lit('        TODO("Reconstructed — '), m["body_lines"].cast("string"), lit(' original lines")')), lit("    }"), lit(""))

    blank = F.array(lit(""))
    some = lambda test, *parts: F.when(test, F.concat(*parts)).otherwise(none)
    text = F.concat(
        some(F.col("package_name") != "", F.array(F.concat(lit("package "), "package_name")), blank),
        some(F.size(imports) > 0, F.transform(imports, lambda i: F.concat(lit("import "), i)), blank),
        some(F.col("notes").isNotNull(), F.array(lit("/*"), lit(" * RECONSTRUCTION NOTES:"), F.col("notes"), lit(" */")), blank),
        F.array(head, lit("")),
        some(F.size(statics) > 0, F.array(lit("    companion object {")), F.transform(statics, lambda f: field(f, "        const val ")), F.array(lit("    }"), lit(""))),
        some(F.size(own) > 0, F.transform(own, lambda f: field(f, "    var ")), blank),
        F.flatten(F.transform("methods", method)),
        F.array(lit("}")),
    )
    return rows.select("path", F.concat(F.array_join(text, "\n"), lit("\n")).alias("text"))
