"""Values that results depend on; they are fixed and not to be changed."""

# File kinds that are scanned, and the largest size in bytes.
SCANNED_EXTENSIONS = ("java", "kt", "cs", "json", "xml", "js", "ts", "smali", "properties", "cfg", "yaml", "yml", "txt")
CLASS_EXTENSIONS = ("java", "kt", "cs")
COMPARED_EXTENSIONS = ("java", "kt", "cs", "xml", "json")
MAX_FILE_BYTES = 10 * 1024 * 1024

# White space as trimmed from lines.
WIDE_SPACE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# Where URLs end.
URL = r"""(?i)https?://[^\s"'`<>{}|\\^)\]]+"""
WEBSOCKET_URL = r"""(?i)wss?://[^\s"'`<>{}|\\^)\]]+"""

# Patterns of quoted REST paths, in order.
REST_PATHS = (
    r"""(?i)["']/api/v?\d*/[^\s"']+["']""",
    r"""(?i)["']/v\d+/[^\s"']+["']""",
    r"""(?i)["']/auth/[^\s"']+["']""",
    r"""(?i)["']/user[s]?/[^\s"']*["']""",
    r"""(?i)["']/session[s]?/[^\s"']*["']""",
    r"""(?i)["']/login["']""",
    r"""(?i)["']/register["']""",
    r"""(?i)["']/logout["']""",
    r"""(?i)["']/token["']""",
    r"""(?i)["']/leaderboard[s]?[^\s"']*["']""",
    r"""(?i)["']/score[s]?[^\s"']*["']""",
    r"""(?i)["']/match[^\s"']*["']""",
    r"""(?i)["']/player[s]?[^\s"']*["']""",
    r"""(?i)["']/item[s]?[^\s"']*["']""",
    r"""(?i)["']/shop[^\s"']*["']""",
    r"""(?i)["']/purchase[^\s"']*["']""",
    r"""(?i)["']/inventory[^\s"']*["']""",
    r"""(?i)["']/reward[s]?[^\s"']*["']""",
    r"""(?i)["']/event[s]?[^\s"']*["']""",
    r"""(?i)["']/config[^\s"']*["']""",
    r"""(?i)["']/version[^\s"']*["']""",
    r"""(?i)["']/update[^\s"']*["']""",
    r"""(?i)["']/notification[s]?[^\s"']*["']""",
    r"""(?i)["']/friend[s]?[^\s"']*["']""",
    r"""(?i)["']/guild[s]?[^\s"']*["']""",
    r"""(?i)["']/chat[^\s"']*["']""",
    r"""(?i)["']/gacha[^\s"']*["']""",
    r"""(?i)["']/summon[^\s"']*["']""",
    r"""(?i)["']/battle[^\s"']*["']""",
    r"""(?i)["']/quest[s]?[^\s"']*["']""",
)

# Patterns of HTTP methods, the first that matches counts.
HTTP_METHODS = (
    (r"(?i)\.get\s*\(", "GET"),
    (r"(?i)\.post\s*\(", "POST"),
    (r"(?i)\.put\s*\(", "PUT"),
    (r"(?i)\.delete\s*\(", "DELETE"),
    (r"(?i)\.patch\s*\(", "PATCH"),
    (r"(?i)HttpMethod\.GET", "GET"),
    (r"(?i)HttpMethod\.POST", "POST"),
    (r"(?i)HttpMethod\.PUT", "PUT"),
    (r"(?i)HttpMethod\.DELETE", "DELETE"),
    (r"(?i)RequestMethod\.GET", "GET"),
    (r"(?i)RequestMethod\.POST", "POST"),
    (r'"GET"', "GET"),
    (r'"POST"', "POST"),
    (r'"PUT"', "PUT"),
    (r'"DELETE"', "DELETE"),
    (r"(?i)UnityWebRequest\.Get", "GET"),
    (r"(?i)UnityWebRequest\.Post", "POST"),
    (r"(?i)UnityWebRequest\.Put", "PUT"),
    (r"(?i)UnityWebRequest\.Delete", "DELETE"),
    (r"(?i)WWW\s*\(", "GET"),
)

# Patterns of authentication, each that matches counts.
AUTH_PATTERNS = (
    (r"(?i)jwt|json\s*web\s*token", "jwt"),
    (r"Bearer\s+", "bearer"),
    (r"(?i)oauth|oauth2|openid", "oauth"),
    (r"(?i)api[_-]?key|apikey", "api-key"),
    (r"(?i)session[_-]?token|sessionid|session[_-]?id", "session-token"),
    (r"(?i)basic\s+auth|basicauth|Authorization:\s*Basic", "basic-auth"),
    (r"(?i)x-auth-token|x-api-key|x-session-id", "bearer"),
    (r"(?i)refresh[_-]?token", "jwt"),
    (r"(?i)access[_-]?token", "bearer"),
)

# Words that decide categories.
ANALYTICS_HOSTS = (
    "google-analytics.com", "firebase.google.com", "app-measurement.com",
    "adjust.com", "appsflyer.com", "branch.io", "amplitude.com",
    "mixpanel.com", "bugsnag.com", "crashlytics.com", "sentry.io",
    "flurry.com", "facebook.com/tr", "doubleclick.net",
)
CDN_HOSTS = (
    "cloudfront.net", "akamaized.net", "cdn.", "assets.",
    "fastly.net", "azureedge.net", "googleapis.com/download",
    "bunnycdn.com", "cloudflare.com",
)
AUTH_PATHS = (
    "/auth", "/login", "/register", "/signup", "/token",
    "/oauth", "/logout", "/verify", "/password",
)
API_PATHS = ("/api/", "/v1/", "/v2/")
SESSION_PATHS = ("/session",)
STORE_PATHS = ("/shop", "/store", "/purchase", "/iap", "/buy", "/gacha", "/summon")
GAMEPLAY_PATHS = (
    "/battle", "/match", "/quest", "/mission", "/level",
    "/combat", "/fight", "/play", "/game", "/round",
)
SOCIAL_PATHS = (
    "/friend", "/guild", "/clan", "/chat", "/message",
    "/social", "/invite", "/party", "/team",
)
ANALYTICS_PATHS = ("/analytics", "/telemetry", "/track")
CDN_PATHS = ("/cdn", "/asset", "/download", "/bundle")

# URLs with one of these in their lower-cased form are noise. The one with capitals never matches.
NOISE = (
    "schemas.android.com", "www.w3.org", "schemas.microsoft.com",
    "xmlns.", "developer.android.com", "docs.oracle.com",
    "github.com/nicm", "example.com", "example.org",
    "localhost", "127.0.0.1", "0.0.0.0",
    "xml.org", "purl.org", "json-schema.org",
    "creativecommons.org", "mozilla.org/MPL",
    "apache.org/licenses", "opensource.org/licenses",
)

# Order of categories in the endpoint catalogue.
ENDPOINT_ORDER = ("auth", "session", "gameplay", "store", "social", "cdn", "analytics", "unknown")

# Component categories of classes.
COMPONENTS = ("activity", "view", "service", "receiver", "network", "model", "utility", "unknown")

# Patterns that find a class, its methods and fields, and the symbols of a source.
CLASS_HEADER = r"(?:public\s+)?(?:abstract\s+)?(?:final\s+)?(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?"
METHOD = r"(?:(@\w+)\s+)?(?:public|protected|private)?\s*(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?([\w<>\[\]]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*\{"
FIELD = r"(?:public|protected|private)\s+(static\s+)?(?:final\s+)?([\w<>\[\]]+)\s+(\w+)\s*(?:=\s*([^;]+))?\s*;"
SYMBOLS = (
    r"(?:class|interface|enum)\s+(\w+)",
    r"(?:fun|void|int|boolean|String|float|double|long)\s+(\w+)\s*\(",
    r"(?:val|var|private|public|protected)\s+(?:\w+\s+)?(\w+)\s*[=:;]",
    r'"(/[\w/]+)"',
)

# Java types in Kotlin, and Kotlin default values.
KOTLIN_TYPES = {
    "void": "Unit", "int": "Int", "long": "Long", "float": "Float", "double": "Double",
    "boolean": "Boolean", "byte": "Byte", "char": "Char", "short": "Short",
    "String": "String", "Object": "Any", "Integer": "Int", "Long": "Long",
    "Float": "Float", "Double": "Double", "Boolean": "Boolean",
}
KOTLIN_DEFAULTS = {
    "Int": "0", "Long": "0L", "Float": "0f", "Double": "0.0", "Boolean": "false", "Byte": "0",
    "Char": "'\\u0000'", "Short": "0", "String": '""', "Any": "Any()", "Unit": "Unit",
}
KOTLIN_EMPTY = {"Array": "emptyArray()", "List": "emptyList()", "Map": "emptyMap()", "Set": "emptySet()"}

# Names of engines.
ENGINE_NAMES = {"unity-mono": "Unity (Mono)", "unity-il2cpp": "Unity (IL2CPP)", "unreal": "Unreal Engine", "godot": "Godot", "native": "Native Java/Kotlin"}

# URL patterns of the generic plugin; group 1 is the URL or path.
PLUGIN_URLS = (
    r"""(?i)new\s+Request\.Builder\(\)\s*\.url\s*\(\s*["']([^"']+)["']""",
    r"""(?i)@(?:GET|POST|PUT|DELETE|PATCH)\s*\(\s*["']([^"']+)["']\s*\)""",
    r"""(?i)new\s+(?:String|Json\w*)Request\s*\(\s*(?:\w+\s*,\s*)?["']([^"']+)["']""",
    r"""(?i)new\s+URL\s*\(\s*["']([^"']+)["']\s*\)""",
)
