"""The block of ``key: value`` lines between ``---`` marks that an article may open with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import lines, strip, unquote


def end(content: Column) -> Column:
    """Where the closing mark begins, counted from 1; 0 without one. Any later ``---`` closes, even in a value."""
    return F.when(content.startswith("---"), F.locate("---", content, 4)).otherwise(0)


def head(content: Column, at: Column) -> Column:
    """The block's text, null where there is none; ``at`` is :func:`end`, computed once."""
    return F.when(at > 0, content.substr(F.lit(4), at - 4))


def body(content: Column, at: Column) -> Column:
    return F.when(at > 0, strip(content.substr(at + 3, F.length(content)))).otherwise(content)


def fields(block: Column) -> Column:
    """A block as a map; of a repeated key the last value holds. Does not rest on the session's policy for duplicate keys."""
    kv = F.transform(
        F.filter(F.transform(lines(strip(F.coalesce(block, F.lit("")))), strip), lambda x: x.contains(":")),
        lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), unquote(strip(x.substr(F.instr(x, ":") + 1, F.length(x)))).alias("value")),
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    last = F.aggregate(F.reverse(kv), none, lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.array_append(acc, x)))
    return F.map_from_entries(last)


def _items(inner: Column) -> Column:
    return F.split(inner, ",")


def typed_list(value: Column) -> Column:
    """A search field as a list: a bracketed value's items without empty ones, else the value itself; null without one."""
    inner = value.substr(F.lit(2), F.length(value) - 2)
    items = F.filter(F.transform(_items(inner), lambda x: unquote(strip(x))), lambda x: x != "")
    return F.when(value.startswith("[") & value.endswith("]") & (F.length(value) > 1), items).when(value.isNotNull(), F.array(value))


def gate_list(value: Column) -> Column:
    """A gate field as a list: brackets are optional, items empty before they are unquoted are dropped."""
    v = strip(F.coalesce(value, F.lit("")))
    inner = F.when(v.startswith("[") & v.endswith("]") & (F.length(v) > 1), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(F.filter(_items(inner), lambda x: strip(x) != ""), lambda x: unquote(strip(x)))
