"""Identities, names and code text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of files that may be generated.
GENERATED_SUFFIXES = ("ts", "tsx", "css")


def source_id(path: Column) -> Column:
    """A path as a relative identity with forward slashes; null if it is empty, absolute or has '.', '..' or empty parts.
    A trailing slash and repeated ones are as one path library treats them: dropped."""
    plain = F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"(?<!^)/+(?=/|$)", "")
    parts = F.split(F.regexp_replace(plain, r"(?<=.)/\.(?=/|$)", ""), "/")
    bad = (plain == "") | plain.startswith("/") | F.exists(parts, lambda x: x == "..") | (F.array_join(parts, "/") == ".")
    return F.when(~bad, F.array_join(parts, "/"))


def page_of(source: Column) -> Column:
    """The markup file that a code file belongs to: Name.xaml.cs and Name.cs have Name.xaml; null for others."""
    low = F.lower(source)
    return F.when(low.endswith(".xaml.cs"), F.left(source, F.length(source) - 3)).when(low.endswith(".cs"), F.concat(F.left(source, F.length(source) - 3), F.lit(".xaml")))


def component_name(page: Column) -> Column:
    """A symbol made of a page's whole path, so that pages of one name in two folders differ."""
    stem = F.regexp_replace(page, r"(?<=[^./])\.[^./]*$", "")
    name = F.array_join(F.transform(F.split(stem, "/"), lambda x: F.coalesce(F.nullif(F.regexp_replace(x, r"[^0-9A-Za-z_$]", "_"), F.lit("")), F.lit("Page"))), "__")
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("Page_"), name)).otherwise(name)


def mirrored(source: Column, suffix: str = ".json") -> Column:
    """The relative path under which a source's result is kept: its own with a suffix added."""
    return F.concat(source_id(source), F.lit(suffix))


def state_name(target: Column) -> Column:
    return F.concat(F.lower(F.left(target, F.lit(1))), F.substr(target, F.lit(2)), F.lit("Open"))


def setter_name(target: Column) -> Column:
    return F.concat(F.lit("set"), target, F.lit("Open"))


def symbol_variants(symbol: Column) -> Column:
    """A symbol's last part, and that without a trailing Model."""
    last = F.substring_index(F.regexp_replace(F.trim(symbol), "^[\"']+|[\"']+$", ""), ".", -1)
    return F.array_distinct(F.array(last, F.regexp_replace(last, "Model$", "")))


def without_comments(code: Column) -> Column:
    """Code without comments to the end of a line and between slash and star."""
    return F.regexp_replace(F.regexp_replace(code, r"(?m)//.*?$", ""), r"(?s)/\*.*?\*/", "")


def without_imports(code: Column) -> Column:
    return F.array_join(F.filter(F.split(code, "\n", -1), lambda x: ~F.trim(x).startswith("import ")), "\n")


def indented(code: Column, spaces: int) -> Column:
    """Every line that is not empty moved to the right."""
    return F.array_join(F.transform(F.split(code, "\n", -1), lambda x: F.when(x != "", F.concat(F.lit(" " * spaces), x)).otherwise(x)), "\n")


def generated_path(path: Column) -> Column:
    """A path that generated files may have, with forward slashes; null if it is not allowed: empty, absolute, upwards,
    in node_modules, or of another suffix."""
    plain = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(plain, "/"), lambda x: (x != "") & (x != "."))
    bad = plain.startswith("/") | F.exists(parts, lambda x: x.isin("..", "node_modules")) | ~F.lower(F.element_at(parts, -1)).rlike(rf"[^.].*\.({'|'.join(GENERATED_SUFFIXES)})$")
    return F.when((F.size(parts) > 0) & ~bad, F.array_join(parts, "/"))


def utc_iso(moment: Column) -> Column:
    """A timestamp as ISO text with its offset; of the session's zone, which should be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one's where both have a key."""
    only = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(only, right)
