"""Names of contexts and subjects, version specifications, paths and codes, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT, WILDCARD = ".", "*"


def context_of(name: Column) -> Column:
    """The context that a qualified name opens: only `:.` opens one, up to the next colon or the end; `:*:` is the wildcard."""
    return F.when(name.startswith(":."), F.regexp_extract(name, r"^:(\.[^:]*)", 1)).when(name.startswith(":*:"), F.lit(WILDCARD)).otherwise(F.lit(DEFAULT))


def subject_of(name: Column) -> Column:
    """The rest of a qualified name; empty if it names a context only."""
    opened = F.regexp_extract(name, r"(?s)^:\.[^:]*:(.*)$", 1)
    return F.when(name.startswith(":."), opened).when(name.startswith(":*:"), F.substring(name, 4, 2**31 - 1)).otherwise(name)


def qualified(ctx: Column, subject: Column) -> Column:
    """The form that clients see: without a prefix in the default context."""
    return F.when(ctx == DEFAULT, subject).otherwise(F.concat(F.lit(":"), ctx, F.lit(":"), subject))


def normalized_context(ctx: Column) -> Column:
    """A context name as deletes and exporters take it, with its dot; null if it is not valid."""
    name = F.when(ctx.startswith("."), ctx).otherwise(F.concat(F.lit("."), ctx))
    good = name.rlike(r"^\.[A-Za-z0-9._-]+$") & (F.octet_length(name) <= 256)
    return F.when(ctx.isin("", DEFAULT), F.lit(DEFAULT)).when(ctx == WILDCARD, F.lit(WILDCARD)).when(good, name)


def valid_subject(name: Column) -> Column:
    """Whether a write may use the name: no control characters, not reserved."""
    return ~name.rlike(r"[\x00-\x1F\x7F-\x9F]") & ~subject_of(name).isin("__GLOBAL", "__EMPTY")


def java_int(text: Column) -> Column:
    """A 32-bit integer with an optional sign, in ASCII digits; null for anything else."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), F.expr("1") * text.try_cast("int"))


def version_number(spec: Column) -> Column:
    """A version specification: -1 for the latest (`latest` in any case, or -1), the number from 1 on, null if invalid."""
    spec = F.trim(spec)
    number = java_int(spec)
    return F.when(F.lower(spec) == "latest", F.lit(-1)).when((number == -1) | (number >= 1), number)


def effective_limit(limit: Column, default: int, most: int) -> Column:
    """A limit that is not positive or above the maximum becomes the default, not the maximum."""
    return F.when((limit > 0) & (limit <= most), limit).otherwise(F.lit(default))


def http_status(code: Column) -> Column:
    """The status of an error code: its first three digits."""
    return F.substring(code.cast("string"), 1, 3).cast("int")


#: The first segments that are served, those after which a name stands, and the methods.
ROUTE_ROOTS = ("", "subjects", "schemas", "contexts", "config", "mode", "compatibility", "exporters", "metrics", "admin", "_admin", "v1")
BEFORE_NAMES = ("subjects", "config", "mode", "contexts", "exporters", "ids")
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS")
#: A longer label is another client's invention.
ROUTE_BYTES = 64


def segments(path: Column) -> Column:
    """A path's segments without the slashes at its ends."""
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/", -1)


def route_shape(path: Column) -> Column:
    """A path with its names and versions replaced by `*`, by their position; `/other` for what isn't served, so that
    clients cannot mint labels. Null for null."""
    segs = segments(path)

    def shown(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(segs, i - 1))
        number = x.rlike("^[+]?[0-9]+$") & (F.coalesce(x.try_cast("long"), F.lit(2**32)) < 2**32)
        named = before.isin(*BEFORE_NAMES) | ((before == "versions") & (number | (x == "latest")))
        return F.when(F.coalesce(named, F.lit(False)), F.lit("*")).otherwise(x)

    shape = F.concat(F.lit("/"), F.array_join(F.transform(segs, shown), "/"))
    served = F.get(segs, F.lit(0)).isin(*ROUTE_ROOTS) & (F.octet_length(shape) <= ROUTE_BYTES) & ~shape.contains('"') & ~shape.contains("\\")
    return F.when(path.isNotNull(), F.when(served, shape).otherwise(F.lit("/other")))


def method_label(method: Column) -> Column:
    """The method, or `other` for one that isn't served."""
    return F.when(method.isin(*METHODS), method).otherwise(F.lit("other"))


def percent_decoded(text: Column) -> Column:
    """Percent decoding where a plus sign is a space."""
    return F.url_decode(text)


def percent_encoded(text: Column) -> Column:
    """Percent encoding that keeps the colon and writes a space as %20."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%3A"), F.lit(":")), F.lit("+"), F.lit("%20"))


def glob_to_regex(pattern: Column) -> Column:
    """A pattern with `*`, `?` and bracket classes as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$(){}|])", r"\\$1")
    inner = F.replace(F.replace(F.replace(quoted, F.lit("[!"), F.lit("[^")), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^"), inner, F.lit("$"))


def star_match(text: Column, pattern: Column) -> Column:
    """Whether a pattern in which only `*` stands for anything matches the whole text. Its parts are found one after
    the other, each at its first place, and the last one must end the text."""
    plain = lambda x: F.regexp_replace(x, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    parts = F.split(pattern, "[*]", -1)
    later = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x != "")
    found = F.array_join(F.transform(later, lambda x: F.concat(F.lit("(?>.*?"), plain(x), F.lit(")"))), "")
    return F.rlike(text, F.concat(F.lit("(?s)^"), plain(F.get(parts, F.lit(0))), found, F.when(pattern.endswith("*"), F.lit(".*")).otherwise(F.lit("")), F.lit("\\z")))


def glob_match(text: Column, pattern: Column) -> Column:
    return F.rlike(text, glob_to_regex(pattern))
