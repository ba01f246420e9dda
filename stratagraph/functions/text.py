"""Scalar functions over names, paths and routes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_tokens(text: Column) -> Column:
    """Lower-case words of a name: camel case and _ - . / split, anything but letters and digits dropped."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-./]", " ")
    return F.filter(F.split(F.lower(split), "[^a-z0-9]+"), lambda x: x != "")


def words_in_name(name_words: Column, query_words: list[str]) -> Column:
    """Whether every query word is part of some word of the name."""
    return F.forall(F.array(*map(F.lit, query_words)), lambda q: F.exists(name_words, lambda n: F.contains(n, q)))


def coverage(name_words: Column, query_words: list[str]) -> Column:
    """Share of the distinct query words among the words of the name."""
    wanted = F.array_distinct(F.array(*map(F.lit, query_words)))
    return F.size(F.array_intersect(wanted, name_words)) / F.size(wanted)


def normal_route(path: Column) -> Column:
    """Origin, query and fragment stripped, template and number segments as ':param'; null without a slash."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"[?#].*", "")
    named = F.regexp_replace(bare, r"\$\{[^}]*\}|\{[^}/]*\}|\[[^\]/]*\]|(?<=/)(?::\w+|\*|[0-9]+)(?=/|$)", ":param")
    short = F.regexp_replace(F.regexp_replace(named, "/{2,}", "/"), "(?<=.)/$", "")
    return F.when(F.contains(path, F.lit("/")), F.when(short == "", "/").otherwise(short))


def route_shape(path: Column) -> Column:
    """Segments in lower case with placeholders as '{}', joined again."""
    segments = F.filter(F.split(F.regexp_replace(path, r"[?#].*", ""), "/"), lambda s: s != "")
    shaped = F.transform(segments, lambda s: F.when(s.rlike(r"^(:|\{|\[|\*|<|\$)") | s.rlike("^[0-9]+$"), "{}").otherwise(F.lower(s)))
    return F.concat(F.lit("/"), F.concat_ws("/", shaped))


def segments(route: Column) -> Column:
    return F.filter(F.split(route, "/"), lambda s: s != "")


def _tail_matches(short: Column, long: Column) -> Column:
    tail = F.slice(long, F.greatest(F.size(long) - F.size(short) + 1, F.lit(1)), F.greatest(F.size(short), F.lit(1)))
    pairs = F.arrays_zip(short.alias("a"), tail.alias("b"))
    fits = F.forall(pairs, lambda p: (p["a"] == p["b"]) | (p["a"] == ":param") | (p["b"] == ":param"))
    shares = F.exists(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != ":param"))
    return F.coalesce(fits & shares, F.lit(False))


def routes_compatible(left: Column, right: Column) -> Column:
    """Equal, segment-wise equal with parameters and one shared literal, or one the tail of the other under that rule."""
    a, b = segments(left), segments(right)
    parameters = F.contains(left, F.lit(":param")) | F.contains(right, F.lit(":param"))
    by_parts = F.when(F.size(a) == F.size(b), _tail_matches(a, b)).when(F.size(a) < F.size(b), (F.size(a) > 0) & _tail_matches(a, b)).otherwise((F.size(b) > 0) & _tail_matches(b, a))
    return (left == right) | F.when(parameters, by_parts).otherwise(F.endswith(left, right) | F.endswith(right, left))


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def paths_compatible(left: Column, right: Column) -> Column:
    """Equal, or one ends with '/' and the other."""
    a, b = clean_path(left), clean_path(right)
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(clean_path(path), "/"), -1)


def entity_key(name: Column) -> Column:
    """Lower case, without a leading 'entity_', letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "^entity_", ""), "[^a-z0-9]", "")


def role_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def camel_words(name: Column) -> Column:
    """Parts of a camel- or snake-case name in lower case."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), lambda w: F.lower(w))


#: Parts of paths that mark files outside of the primary product.
OUTSIDE_DIRECTORIES = "node_modules|dist|build|coverage|vendor|vendors|generated|fixtures?|__fixtures__|__mocks__|__tests__|tests?|spec|e2e|cypress|playwright"
OUTSIDE_SUFFIXES = "test|spec|stories|story"


def in_primary_product(file: Column, name: Column, is_test: Column, is_generated: Column) -> Column:
    """Neither test nor generated, and not in a folder or file of tests, builds, third parties or fixtures."""
    path = F.lower(F.regexp_replace(F.coalesce(F.nullif(file, F.lit("")), name, F.lit("")), r"\\", "/"))
    outside = path.rlike(rf"(^|/)({OUTSIDE_DIRECTORIES})(/|$)") | path.rlike(rf"\.({OUTSIDE_SUFFIXES})\.[a-z0-9]+$") | path.rlike("^legacy/")
    return ~(F.coalesce(is_test, F.lit(False)) | F.coalesce(is_generated, F.lit(False)) | outside)


#: Language by file extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "c": "c", "h": "c", "cpp": "cpp", "sql": "sql", "sh": "shell", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "css": "css", "html": "html", "md": "markdown"}


def language_of(path: Column) -> Column:
    """Language of a file by its extension, null if unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[extension]


def naming_style(name: Column) -> Column:
    """camel, Pascal, snake, kebab or other."""
    return F.when(name.rlike("^[a-z]+(?:[A-Z][a-z0-9]*)+$"), "camel").when(name.rlike("^(?:[A-Z][a-z0-9]*)+$"), "pascal").when(name.rlike("^[a-z0-9]+(?:_[a-z0-9]+)+$"), "snake").when(name.rlike("^[a-z0-9]+(?:-[a-z0-9]+)+$"), "kebab").otherwise("other")


def fnv1a(text: Column, seed: int = 0) -> Column:
    """32-bit FNV-1a over the code points of a text (UTF-16 units for the basic plane), offset xor ``seed``."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(points, F.lit(2166136261 ^ seed).cast("bigint"), step)


def token_estimate(value: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(value) / 4)


def half_up(value: Column) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(value + 0.5)


def service_route(path: Column) -> Column:
    """A route as services spell it: lower case, without origin and query, parameters as ':param', single slashes, none at the end; '/' for nothing."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(path), r"^https?://[^/]+", ""), r"\?.*$", "")
    named = F.regexp_replace(bare, r"\$\{[^}]*\}|(?<=/)(?::[^/]+|\{[^/]+\}|\*)(?=/|$)", ":param")
    short = F.regexp_replace(F.regexp_replace(named, "/{2,}", "/"), "/$", "")
    return F.when(short == "", "/").otherwise(short)


#: What the name of a guard says of its kind; the first that fits counts.
GUARD_KINDS = (
    ("rate-limiting", "throttl|rate[-_]?limit"),
    ("authorization", "authoriz|role|permission|policy|policies|acl|rbac|abac|grant|tenant|organization|owner|scope"),
    ("validation", "csrf|xsrf|recaptcha|captcha"),
    ("authentication", "auth|jwt|session|api[-_]?key|apikey|oauth|sso|login|signin|sign[-_]?in|token|bearer|passport|credential|identity"),
    ("validation", "valid|sanitiz|schema"),
)


def guard_kind(name: Column) -> Column:
    """Kind of a guard by its name, 'unknown' if nothing fits."""
    out = None
    for kind, pattern in GUARD_KINDS:
        fits = F.lower(name).rlike(pattern)
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("unknown")


#: Types around another one that stand for many of it, or for it alone.
MANY_WRAPPERS = "array|list|set|collection|iterable|sequence|vec|queryset|observablearray|readonlyarray|hashset|arraylist|linkedlist"
ONE_WRAPPERS = "promise|optional|option|ref|mapped|box|rc|arc|observable|lazy|future|task|nullable"


def type_shape(declared: Column, rounds: int = 8) -> Column:
    """struct<name, collection> of a declared type: references, optional marks, null unions, lists and wrappers are taken off.

    name is null where no single plain type is left. ``rounds`` wrappers within each other are taken off.
    """
    state = F.struct(F.trim(F.regexp_replace(F.trim(F.coalesce(declared, F.lit(""))), r"^&(?:'\w+\s+)?(?:mut\s+)?|^\?", "")).alias("t"), F.lit(False).alias("many"))

    def peel(s: Column, _: Column) -> Column:
        kept = F.filter(F.transform(F.split(s["t"], r"\|"), lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).rlike("^(?:null|undefined|none|nil|void)$"))
        plain = F.when(~F.contains(s["t"], F.lit("|")), s["t"]).when(F.size(kept) == 1, kept[0]).otherwise("")
        suffix = F.regexp_extract(plain, r"^(.*?)\s*\[\s*\]$", 1)
        slice_ = F.regexp_extract(plain, r"^\[\s*([^;\]]+?)\s*(?:;[^\]]*)?\]$", 1)
        wrapper = F.lower(F.element_at(F.split(F.regexp_extract(plain, r"^([A-Za-z_][\w.]*)\s*[<\[]\s*[\s\S]+?\s*[>\]]$", 1), r"\."), -1))
        inner = F.trim(F.regexp_extract(plain, r"^[A-Za-z_][\w.]*\s*[<\[]\s*([\s\S]+?)\s*[>\]]$", 1))
        first = F.trim(F.regexp_extract(inner, r"^((?:[^,<\[]|<[^<>]*>|\[[^\[\]]*\])*)", 1))
        many, one = wrapper.rlike(f"^(?:{MANY_WRAPPERS})$"), wrapper.rlike(f"^(?:{ONE_WRAPPERS})$")
        peeled = F.when(suffix != "", suffix).when(slice_ != "", slice_).when(wrapper == "", plain).when(many | one, first).otherwise("")
        return F.struct(F.trim(peeled).alias("t"), (s["many"] | (suffix != "") | (slice_ != "") | many).alias("many"))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, peel)
    name = F.when(last["t"].rlike(r"^[A-Za-z_][\w.]*$"), F.element_at(F.split(last["t"], r"\."), -1))
    return F.struct(name.alias("name"), last["many"].alias("collection"))


def git_remote(url: Column) -> Column:
    """One key, host/path, for the ssh and https spellings of a remote repository."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"\.git$", "")
    web = F.regexp_replace(bare, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?", "")
    ssh = F.regexp_replace(F.regexp_replace(bare, r"^(?:[\w.-]+@)?", ""), r"^([\w.-]+):", "$1/")
    return F.regexp_replace(F.when(F.contains(bare, F.lit("://")), web).otherwise(ssh), "/+$", "")


def frame_of_line(line: Column) -> Column:
    """struct<file, line, function> of a line of a stack trace, null if it is none."""
    pattern = r"at\s+(?:([^\s(]+)\s+)?\(?([^\s():]+):(\d+)(?::\d+)?\)?"
    file = F.regexp_extract(line, pattern, 2)
    return F.when(file != "", F.struct(file.alias("file"), F.regexp_extract(line, pattern, 3).cast("int").alias("line"), F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("function")))


def common_tail(left: Column, right: Column) -> Column:
    """The number of path segments that two paths share at their ends."""
    a, b = F.reverse(segments(clean_path(left))), F.reverse(segments(clean_path(right)))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def same_source(left: Column, right: Column) -> Column:
    """Whether two paths likely name one source file: compatible, or with a common end of 3 segments and half of the shorter path."""
    shorter = F.least(F.size(segments(clean_path(left))), F.size(segments(clean_path(right))))
    tail = common_tail(left, right)
    return paths_compatible(left, right) | ((tail >= 3) & (tail >= F.ceil(shorter / 2)))


def volume(own: Column, attributes: Column) -> Column:
    """How many events an event stands for: its own volume, its attribute volume or count, else 1; rounded."""
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    second = number(F.coalesce(F.nullif(attributes["volume"], F.lit("")), attributes["count"]))
    return F.when(own > 0, half_up(own)).when(second > 0, half_up(second)).otherwise(1).cast("bigint")


def risk_of_fixes(fixes: Column, percentile: Column, rate: Column) -> Column:
    """'high', 'medium' or null: the risk that a file's bug fixes tell of. 90 with 3 fixes, 75 with 2, rate 0.3."""
    known = F.when((percentile >= 90) & (fixes >= 3), "high").when((percentile >= 75) & (fixes >= 2), "medium")
    return F.when(fixes.isNotNull() & percentile.isNotNull(), known).when(rate > 0.3, "high")


def signature_text(name: Column, parameters: Column, returns: Column) -> Column:
    """name(parameter: type, other?: type) -> type; unknown types are 'any', and nothing is returned as 'void'."""
    shown = F.transform(parameters, lambda p: F.concat(F.coalesce(p["name"], F.lit("_")), F.when(p["optional"], "?").otherwise(""), F.lit(": "), F.coalesce(p["type"], F.lit("any"))))
    return F.concat(name, F.lit("("), F.coalesce(F.concat_ws(", ", shown), F.lit("")), F.lit(") -> "), F.coalesce(returns, F.lit("void")))


#: What the words of an operation's name say it does. A whole name counts first, then its first word, then any word in this order.
EFFECT_WORDS = {
    "whole": {"prepare": "addparameter addwithvalue createcommand existssync pathexists pathexistssync", "read": "executereader executescalar exists keyexists stringgetlease", "write": "executenonquery"},
    "first": {"prepare": "access begin canonicalize close connect dispose ensure lstat metadata mkdir mkdtemp open prepare realpath stat"},
    "word": {
        "delete": "clear del delete destroy drop evict expire flush purge remove rm rmdir truncate unlink",
        "send": "dispatch emit enqueue notify publish send",
        "write": "add append commit copy create decrement increment insert merge mkdir move patch persist post push put register rename replace save set store update upsert write",
    },
}


def effect_of(operation: Column) -> Column:
    """What an operation does by its name: delete, send, write, prepare or read, which is also what is left."""
    bare = F.regexp_replace(F.element_at(F.split(operation, "[.:]"), -1), "Async$", "")
    words = F.filter(F.split(F.lower(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2")), "[ _!?-]+"), lambda w: w != "")
    out = None
    for stage, rules in EFFECT_WORDS.items():
        for does, listed in rules.items():
            known = listed.split()
            fits = F.concat_ws("", words).isin(known) if stage == "whole" else F.element_at(F.concat(words, F.array(F.lit(""))), 1).isin(known) if stage == "first" else F.arrays_overlap(words, F.array(*map(F.lit, known)))
            out = F.when(fits, does) if out is None else out.when(fits, does)
    return out.otherwise("read")
