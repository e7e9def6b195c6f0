"""Rules as Column expressions: first match wins, evaluated inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import values as V


def any_of(lowered: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])


def trimmed_context(line: Column) -> Column:
    """A line without white space at its ends, 200 characters at most."""
    return F.substring(F.regexp_replace(line, F.lit(rf"^[{V.WIDE_SPACE}]+|[{V.WIDE_SPACE}]+\z"), F.lit("")), 1, 200)


def clean_url(raw: Column) -> Column:
    return F.regexp_replace(raw, F.lit(r"[,;:!.)}\]]+\z"), F.lit(""))


def unquoted(raw: Column) -> Column:
    return F.regexp_replace(raw, F.lit(r"""^["']|["']\z"""), F.lit(""))


def is_noise(url: Column) -> Column:
    return any_of(F.lower(url), V.NOISE)


def url_category(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.startswith("ws://") | low.startswith("wss://"), "websocket")
        .when(any_of(low, V.ANALYTICS_HOSTS), "analytics")
        .when(any_of(low, V.CDN_HOSTS), "cdn")
        .when(any_of(low, V.AUTH_PATHS), "auth")
        .when(any_of(low, V.API_PATHS), "api")
        .otherwise("unknown")
    )


def endpoint_category(path: Column) -> Column:
    low = F.lower(path)
    named = (("auth", V.AUTH_PATHS), ("session", V.SESSION_PATHS), ("store", V.STORE_PATHS), ("gameplay", V.GAMEPLAY_PATHS), ("social", V.SOCIAL_PATHS), ("analytics", V.ANALYTICS_PATHS), ("cdn", V.CDN_PATHS))
    chosen = F.when(F.lit(False), "unknown")
    for name, words in named:
        chosen = chosen.when(any_of(low, words), name)
    return chosen.otherwise("unknown")


def http_method(line: Column) -> Column:
    """The method that a line names; null if none."""
    chosen = F.when(F.lit(False), "UNKNOWN")
    for pattern, name in V.HTTP_METHODS:
        chosen = chosen.when(line.rlike(pattern), name)
    return chosen


def url_path(url: Column) -> Column:
    """The path of a URL; null where there is none or only the root."""
    path = resolved(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    return F.when(~path.isin("", "/"), path)


def resolved(path: Column) -> Column:
    """A URL path as parsers give it: . and .. parts resolved, and what may not stand in a path percent-encoded."""
    bare = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit("."))
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(bare(part) == "..", up).when(bare(part) == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = bare(F.element_at(parts, -1)).isin(".", "..")
    walked = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise(""))
    dotted = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|\z)"), walked).otherwise(path)
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit("%$1"))
    encoded = F.array_join(F.transform(F.split(dotted, ""), lambda c: F.when(c.rlike(r"""[^\x21-\x7e]|["<>^`{}]"""), code(c)).otherwise(c)), "")
    return F.when(dotted.rlike(r"""[^\x21-\x7e]|["<>^`{}]"""), encoded).otherwise(dotted)


def normal_path(path: Column) -> Column:
    """A path with ids replaced by {id} and without slashes at its end."""
    bare = F.regexp_replace(path, F.lit(r"/+\z"), F.lit(""))
    uuid = F.regexp_replace(bare, F.lit(r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), F.lit("/{id}"))
    done = F.regexp_replace(uuid, F.lit(r"/\d+(?=/|\z)"), F.lit("/{id}"))
    return F.when(done == "", "/").otherwise(done)


def path_parameters(path: Column) -> Column:
    """Each {name} of a path as (name, location, type)."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"\{(\w+)\}"), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit("path").alias("location"), F.when(n == "id", "string").otherwise("unknown").alias("type")))


def input_type(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".xapk"), "xapk").when(low.endswith(".apk"), "apk").otherwise("split-apk")


def tools_for(engine: Column) -> Column:
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return F.when(engine == "unity-mono", names("jadx", "assetripper")).when(engine == "unity-il2cpp", names("jadx", "assetripper", "il2cppdumper")).otherwise(names("jadx"))


def rounded(x: Column) -> Column:
    """Half up, as an integer."""
    return F.floor(x + 0.5).cast("int")


def kotlin_type(java: Column) -> Column:
    """A Java type in Kotlin: arrays and one-argument generics are peeled off one by one, what is left is looked up."""
    state = F.struct(F.lit("").alias("before"), java.alias("rest"), F.lit("").alias("after"))
    layers = F.length(java) - F.length(F.translate(java, "[<", "")) + 1

    def peel(s: Column, _: Column) -> Column:
        rest = s["rest"]
        outer, inner = F.regexp_extract(rest, r"^(\w+)<(.+)>\z", 1), F.regexp_extract(rest, r"^(\w+)<(.+)>\z", 2)
        state_of = lambda opened, left: F.struct(F.concat(s["before"], opened, F.lit("<")).alias("before"), left.alias("rest"), F.concat(F.lit(">"), s["after"]).alias("after"))
        array = state_of(F.lit("Array"), F.regexp_replace(rest, F.lit(r"\[\]\z"), F.lit("")))
        return F.when(rest.endswith("[]"), array).when(outer != "", state_of(outer, inner)).otherwise(s)

    def named(s: Column) -> Column:
        known = F.create_map(*[F.lit(x) for kv in V.KOTLIN_TYPES.items() for x in kv])
        return F.concat(s["before"], F.coalesce(F.try_element_at(known, s["rest"]), s["rest"]), s["after"])

    return F.aggregate(F.sequence(F.lit(1), layers), state, peel, named)


def kotlin_default(kotlin: Column) -> Column:
    chosen = F.when(F.lit(False), "null")
    for start, value in V.KOTLIN_EMPTY.items():
        chosen = chosen.when(kotlin.startswith(start), value)
    for name, value in V.KOTLIN_DEFAULTS.items():
        chosen = chosen.when(kotlin == name, value)
    return chosen.otherwise("null")


def kotlin_imports(imports: Column) -> Column:
    """Imports without java.lang, with the first java.util. and java.io. of each rewritten."""
    first = lambda x, a, b: F.regexp_replace(x, F.lit("^((?s).*?)" + a.replace(".", r"\.")), F.lit("$1" + b))
    kept = F.filter(imports, lambda i: ~i.startswith("java.lang."))
    return F.transform(kept, lambda i: first(first(i, "java.util.", "kotlin.collections."), "java.io.", "kotlin.io."))
