"""Scalar functions of the analyser as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative(path: Column, root: str) -> Column:
    """``path`` below ``root``; a path elsewhere stays as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(slashes(path).startswith(prefix), F.substr(slashes(path), F.lit(len(prefix) + 1))).otherwise(path)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(tsx?|jsx?|mjs|cjs)$", "")


def normalized(path: Column) -> Column:
    """A path without ``.`` and, as far as it goes, ``..`` segments."""
    parts = F.filter(F.split(slashes(path), "/"), lambda p: ~p.isin("", "."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda acc, p: F.when((p == "..") & F.coalesce(F.try_element_at(acc, F.lit(-1)) != "..", F.lit(False)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def shortened(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last three dots if something was cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def version_base(name: Column) -> Column:
    """What stands before V1, _v2 or Version3; empty if nothing does."""
    return F.regexp_extract(name, r"^(.+?)(?:V|_v|Version)\d+$", 1)


def callee_of(call: Column) -> Column:
    """The plain identifier that a call's text begins with; empty if it doesn't."""
    return F.regexp_extract(call, r"^([A-Za-z_$][\w$]*)\(", 1)


def plural(n: Column, what: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, what).otherwise(what + "s"))


def seconds(ms: Column) -> Column:
    return F.concat(F.format_number(ms / 1000, 1), F.lit("s"))
