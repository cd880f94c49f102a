"""Scalar normalisers and renderers."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of a route. A variable stands in balanced braces; a slash inside them, or after a brace that is never
#: closed, doesn't part segments. A segment that is one of WILD as a whole takes any text.
VARIABLE = r"(?P<variable>\{(?P<inside>(?:[^{}]++|\{(?:[^{}]++|(?&braces))*+\})*+)\})(?(DEFINE)(?P<braces>\{(?:[^{}]++|(?&braces))*+\}))"
NAME = r"\s*+[^\s:,*.;?&#+/][^:,*]*+(?::.*)?"
WILD = [r"\*\*?", r"<[^<>{]*[^<>{\s][^<>{]*>"]
WILD_INSIDE = [r".*\.\.\.", r"\*.*", rf"\+{NAME}"]
_VARIABLE = regex.compile(VARIABLE, regex.DOTALL)
_PART = regex.compile(r"(?:(?&braces)|\{.*|[^/{])+(?(DEFINE)(?P<braces>\{(?:[^{}]++|(?&braces))*+\}))", regex.DOTALL)
_WILD = regex.compile("|".join(f"(?:{w})" for w in WILD), regex.DOTALL)
_WILD_INSIDE = regex.compile("|".join(f"(?:{w})" for w in WILD_INSIDE), regex.DOTALL)
_OPTIONAL = regex.compile(rf"/{NAME}", regex.DOTALL)


def _variable(found) -> str:
    """A variable without its rule; optional ones end in a question mark."""
    inside = found["inside"].strip()
    name, _, rule = inside.partition(":")
    if _OPTIONAL.fullmatch(inside):
        return "/{" + name[1:].strip() + "?}"
    return "{" + name.strip() + ("?" if rule.strip() == "?" else "") + "}"


def _segment(segment: str) -> str:
    whole = _VARIABLE.fullmatch(segment)
    if _WILD.fullmatch(segment) or (whole and _WILD_INSIDE.fullmatch(whole["inside"].strip())):
        return "*"
    return _VARIABLE.sub(_variable, segment).lstrip("/")


def route(verbatim: str | None, context: str | None = None) -> str | None:
    """F1 for one route; null stays null."""
    if verbatim is None:
        return None
    parts = (m[0] for m in _PART.finditer(f"{context or ''}/{verbatim}"))
    return "/" + "/".join(_segment(p) for p in parts if p.strip())


def _routes(routes: pd.Series) -> pd.Series:
    distinct = {r: route(r) for r in routes.unique()}
    return routes.map(distinct)


def normalize_route(col: Column, context: Column | None = None) -> Column:
    """a route template in its one form, by an Arrow UDF that works on the distinct routes of a batch."""
    routes = F.pandas_udf(_routes, "string")
    return routes(col if context is None else F.concat(F.coalesce(context, F.lit("")), F.lit("/"), col))


#: White space in any script, and the separators that count as such.
SPACE = r"[\s\p{Z}\x1C-\x1F\x85]+"


def stripped(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, f"^{SPACE}|{SPACE}$", "")


def normalize_verb(col: Column) -> Column:
    """trimmed and upper-cased; ``*`` for a null, blank or ``*`` verb."""
    return F.coalesce(F.nullif(F.upper(stripped(col)), F.lit("")), F.lit("*"))


def identity_key(identities: Column) -> Column:
    """the sorted distinct ``group:artifact`` of an array of structs, with ``\\``, ``:`` and ``,`` escaped, joined by commas."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")), F.lit(","), F.lit("\\,"))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(identities, lambda i: F.concat(esc(i["group_id"]), F.lit(":"), esc(i["artifact_id"]))))), ",")


#: What a jar's file name looks like.
STEM = r"^(.+?)-((?:\d+\.\d+|\d+-SNAPSHOT)(?:[.-][A-Za-z0-9_+]+)*)$"
EXTENSION = r"(?i)\.(jar|zip)$"


def jar_identity(file_name: Column, pom_artifact: Column | None = None, pom_version: Column | None = None, manifest_version: Column | None = None) -> Column:
    """(artifact, version, source): pom properties, or else the file name, whose missing version the manifest gives."""
    none = F.lit(None).cast("string")
    stem = F.regexp_replace(file_name, EXTENSION, "")
    named, version = F.nullif(F.regexp_extract(stem, STEM, 1), F.lit("")), F.nullif(F.regexp_extract(stem, STEM, 2), F.lit(""))
    pom = F.nullif(F.trim(pom_artifact), F.lit("")) if pom_artifact is not None else none
    clean = lambda c: F.nullif(F.trim(c), F.lit("")) if c is not None else none
    from_pom = F.struct(pom.alias("artifact"), clean(pom_version).alias("version"), F.lit("POM_PROPERTIES").alias("source"))
    from_name = F.struct(F.coalesce(named, stem).alias("artifact"), F.coalesce(version, clean(manifest_version)).alias("version"), F.lit("FILENAME").alias("source"))
    return F.when(pom.isNotNull(), from_pom).otherwise(from_name)


#: The letters of primitive types in a method descriptor.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def parameter_types(descriptor: Column) -> Column:
    """simple names of the parameter types of a method descriptor, as an array."""
    each = F.regexp_extract_all(F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1), F.lit(r"(\[*(?:L[^;]*;|[BCDFIJSZ]))"), 1)
    names = F.create_map(*[x for k, v in PRIMITIVES.items() for x in (F.lit(k), F.lit(v))])

    def shown(t):
        base = F.regexp_replace(t, r"^\[+", "")
        name = F.when(F.startswith(base, F.lit("L")), F.regexp_replace(F.regexp_extract(base, r"([^/;]+);$", 1), r"\$", ".")).otherwise(F.try_element_at(names, base))
        return F.concat(name, F.repeat(F.lit("[]"), F.length(t) - F.length(base)))

    return F.transform(each, shown)


def method_text(class_name: Column, method_name: Column, descriptor: Column) -> Column:
    """``Class#method``; constructors as ``Class(types)``, initialisers as ``Class static initialiser``."""
    own = F.concat(class_name, F.lit("("), F.array_join(parameter_types(descriptor), ", "), F.lit(")"))
    return F.when(method_name == "<init>", own).when(method_name == "<clinit>", F.concat(class_name, F.lit(" static initialiser"))).otherwise(F.concat(class_name, F.lit("#"), method_name))


#: How a literal is escaped, in this order.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def condition_text(parts: Column) -> Column:
    """F8: string literals quoted and escaped, ``…`` for a placeholder, any other part as it is."""

    def quoted(text):
        for plain, escaped in ESCAPES:
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit('"'), text, F.lit('"'))

    return F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "STRING_LITERAL", quoted(p["text"])).when(p["kind"] == "PLACEHOLDER", F.lit("…")).otherwise(p["text"])), "")


def line_ranges(ranges: Column) -> Column:
    """``line 3, Other.kt:5-8``: the file where one is given (source_file, first_line, last_line)."""

    def shown(r):
        lines = F.when(r["first_line"] == r["last_line"], r["first_line"].cast("string")).otherwise(F.concat_ws("-", r["first_line"], r["last_line"]))
        return F.concat(F.when(F.coalesce(r["source_file"], F.lit("")) == "", F.lit("line ")).otherwise(F.concat(r["source_file"], F.lit(":"))), lines)

    return F.array_join(F.transform(ranges, shown), ", ")


def outcome_text(role: Column, condition: Column, line: Column, case_label: Column, case_key: Column, guarded: Column, partly: Column) -> Column:
    """the sentence for an outcome that never ran, and what code it alone leads to.

    condition and case_label: arrays of parts (kind, text), case_key an int, guarded and partly: arrays of line ranges; null counts as empty.
    """
    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    quoted = lambda a: F.concat(F.lit("`"), condition_text(a), F.lit("`"))
    known = some(condition)
    subject = F.when(known, quoted(condition)).otherwise(F.concat(F.lit("the branch at line "), line.cast("string")))
    said = (
        F.when(role == "FALL_THROUGH", F.concat(subject, F.when(known, " was never true").otherwise(" never fell through")))
        .when(role == "TAKEN", F.concat(subject, F.when(known, " was never false").otherwise(" never jumped")))
        .when((role == "CASE") & some(case_label), F.concat(subject, F.lit(" was never "), quoted(case_label)))
        .when((role == "CASE") & case_key.isNotNull(), F.concat(subject, F.lit(" was never "), case_key.cast("string")))
        .when(role == "CASE", F.concat(F.lit("a case of "), subject, F.lit(" never ran")))
        .when(role == "DEFAULT", F.concat(subject, F.lit(" never reached its default")))
        .otherwise(F.concat(subject, F.lit(" had an outcome that never ran")))
    )
    leads = (
        F.when(some(guarded) & some(partly), F.concat(F.lit("only path to "), line_ranges(guarded), F.lit(", partly to "), line_ranges(partly)))
        .when(some(guarded), F.concat(F.lit("only path to "), line_ranges(guarded)))
        .when(some(partly), F.concat(F.lit("partly the path to "), line_ranges(partly)))
        .otherwise(F.lit("guards no code of its own"))
    )
    return F.concat(said, F.lit(", "), leads)


def outside_reason(kind: Column, type_name: Column) -> Column:
    """why code outside the scope may call a method: ``overrides X``, ``@X`` or the plain simple name."""
    simple = F.substring_index(F.coalesce(type_name, F.lit("")), ".", -1)
    return F.when(kind == "OVERRIDES_METHOD", F.concat(F.lit("overrides "), simple)).when(kind == "CALLBACK_ANNOTATION", F.concat(F.lit("@"), simple)).otherwise(simple)


def site_text(class_name: Column, method_name: Column, never_loaded: Column, failed_to_load: Column | None = None, failed_to_initialize: Column | None = None) -> Column:
    """``Class#method`` or ``Class (class level)``, with the first mark that holds; sites sort by it."""
    where = F.when(method_name.isNull(), F.concat(class_name, F.lit(" (class level)"))).otherwise(F.concat(class_name, F.lit("#"), method_name))
    marks = [(failed_to_load, " (failed to load)"), (failed_to_initialize, " (failed to initialise)"), (never_loaded, " (never loaded)")]
    return F.concat(where, F.coalesce(*[F.when(c, F.lit(m)) for c, m in marks if c is not None], F.lit("")))


def status_text(col: Column) -> Column:
    """F12."""
    return F.lower(F.replace(col, F.lit("_"), F.lit("-")))


def member(col: Column) -> Column:
    """(class_name, method_name) of ``pkg.C#m`` or ``pkg.C.m``; a name without either is a class of its own."""
    hashed = F.instr(col, "#") > 0
    dotted = F.when(F.instr(col, ".") > 0, F.regexp_replace(col, r"\.[^.]*$", "")).otherwise(F.lit(""))
    return F.struct(F.when(hashed, F.substring_index(col, "#", 1)).otherwise(dotted).alias("class_name"), F.when(hashed, F.regexp_replace(col, "^[^#]*#", "")).otherwise(F.substring_index(col, ".", -1)).alias("method_name"))


def class_matches(pattern: str, col: Column) -> Column:
    """the name itself, its end, or a full match. A pattern that isn't an expression matches as text only."""
    import re

    text = (col == pattern) | F.endswith(col, F.lit(pattern))
    try:
        re.compile(pattern)
    except re.error:
        return text
    return text | F.rlike(col, F.lit(f"^(?:{pattern})$"))


#: Where a plain log line states its level, what the virtual machine's warnings begin with, and the time before a line.
LEVEL = r"^(SEVERE|WARNING):|(?:^|[\s\[])(ERROR|WARN)(?:[\s\]])"
MACHINE = r"(?i)^(?:OpenJDK|Java HotSpot).*warning:"
STAMP = r"^(\d{4}-\d\d-\d\dT[\d:.]+Z) (.*)$"


def _is_json(line: Column) -> Column:
    return F.startswith(line, F.lit("{")) & (F.instr(line, '"level"') > 0) & F.get_json_object(line, "$").isNotNull()


def log_text(line: Column) -> Column:
    """the line without its time; a JSON line as it is."""
    return F.when(~_is_json(line) & F.rlike(line, F.lit(STAMP)), F.regexp_extract(line, STAMP, 2)).otherwise(line)


def log_level(line: Column) -> Column:
    """ERROR, WARN or null of a plain or JSON log line."""
    rest = log_text(line)
    stated = F.when(F.rlike(rest, F.lit(LEVEL)), F.concat(F.regexp_extract(rest, LEVEL, 1), F.regexp_extract(rest, LEVEL, 2)))
    found = F.when(_is_json(line), F.upper(F.get_json_object(line, "$.level"))).otherwise(F.coalesce(stated, F.when(F.rlike(rest, F.lit(MACHINE)), F.lit("WARN"))))
    level = F.when(found == "SEVERE", F.when(_is_json(line), found).otherwise("ERROR")).when(found == "WARNING", "WARN").otherwise(found)
    return F.when(level.isin("WARN", "ERROR"), level)


def log_is_agent(line: Column, marks: str) -> Column:
    """whether the collecting agent or the virtual machine wrote a plain line. marks: the expression of the agent's own prefixes."""
    rest = log_text(line)
    return F.coalesce(~_is_json(line) & (F.rlike(rest, F.lit(f"(?i){marks}")) | F.rlike(rest, F.lit(MACHINE))), F.lit(False))


def log_time(line: Column) -> Column:
    """the time at the start of a plain line, or the field time of a JSON one."""
    at = F.when(_is_json(line), F.get_json_object(line, "$.time")).when(F.rlike(line, F.lit(STAMP)), F.regexp_extract(line, STAMP, 1))
    return F.try_to_timestamp(at)


def violation_key(col: Column) -> Column:
    """F16: counts in parentheses, which change between reads, become N."""
    return F.regexp_replace(col, r"\(\d+ [^)]*\)", "(N)")


#: An ISO 8601 duration of weeks to seconds, and the seconds of each unit.
DURATION = r"^P(?=.)(?:(\d+(?:\.\d+)?)W)?(?:(\d+(?:\.\d+)?)D)?(?:T(?=.)(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
UNITS = [604_800, 86_400, 3600, 60, 1]


def try_iso_seconds(col: Column) -> Column:
    """seconds of an ISO 8601 duration, white space around it aside; null for null and for anything else."""
    text = stripped(col)
    part = lambda k, by: F.coalesce(F.regexp_extract(text, DURATION, k).try_cast("double"), F.lit(0.0)) * by
    return F.when(F.rlike(text, F.lit(DURATION)), sum((part(k, by) for k, by in enumerate(UNITS, 1)), F.lit(0.0)))


def iso_seconds(col: Column) -> Column:
    """as try_iso_seconds, but text that is no duration fails the job."""
    seconds = try_iso_seconds(col)
    return F.when(col.isNotNull() & seconds.isNull(), F.raise_error(F.concat(F.lit("not an ISO 8601 duration: "), col)).cast("double")).otherwise(seconds)


def home_folder(col: Column) -> Column:
    """a home folder at the start of a location becomes ``~``."""
    return F.regexp_replace(col, r"^(file:)?(/home/[^/]+|/Users/[^/]+|/root)(?=/|$)", "$1~")


def fingerprint(key: Column, kind: Column, root_kind: Column, planned: Column) -> Column:
    """a cluster's key carries its root kind; for roots that a test run is planned to turn, called_only_by_tests reads as uncalled."""
    folded = F.when((root_kind == "called_only_by_tests") & planned, F.lit("uncalled")).otherwise(root_kind)
    return F.when(kind == "cluster", F.concat(key, F.lit(" ["), folded, F.lit("]"))).otherwise(key)
