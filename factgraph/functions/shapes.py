"""Parsers of the JSON shapes that models return; what fits no shape is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FACT = "struct<subject:string,predicate:string,object:string,confidence:string>"


def parse_facts(c: Column) -> Column:
    """Facts of ``{"facts": [...]}`` or of a bare list."""
    starts_list = F.startswith(F.ltrim(c), F.lit("["))
    return F.when(starts_list, F.from_json(c, f"array<{_FACT}>")).otherwise(F.from_json(c, f"struct<facts:array<{_FACT}>>")["facts"])


def nli_scores(c: Column) -> Column:
    """Lower-cased label -> score of ``[[{label,score}]]`` or ``[{label,score}]``."""
    entry = "struct<label:string,score:double>"
    nested = F.rlike(c, F.lit(r"^\s*\[\s*\["))
    rows = F.when(nested, F.try_element_at(F.from_json(c, f"array<array<{entry}>>"), F.lit(1))).when(F.rlike(c, F.lit(r"^\s*\[")), F.from_json(c, f"array<{entry}>"))
    rows = F.filter(rows, lambda e: e["label"].isNotNull())
    return F.map_from_entries(F.transform(rows, lambda e: F.struct(F.lower(e["label"]), e["score"])))


def zero_shot_top(c: Column) -> Column:
    """(label, score) of the best label of a dict of lists, a list of dicts, or a list with such a dict."""
    lists = "struct<labels:array<string>,scores:array<double>>"
    is_list = F.rlike(c, F.lit(r"^\s*\["))
    wrapped = F.when(is_list, F.try_element_at(F.from_json(c, f"array<{lists}>"), F.lit(1))).otherwise(F.from_json(c, lists))
    zipped = F.transform(F.arrays_zip(wrapped["labels"].alias("label"), wrapped["scores"].alias("score")), lambda e: F.struct(e["score"].alias("score"), e["label"].alias("label")))
    dicts = F.transform(F.when(is_list, F.from_json(c, "array<struct<label:string,score:double>>")), lambda e: F.struct(e["score"].alias("score"), e["label"].alias("label")))
    known = lambda a: F.filter(a, lambda e: e["label"].isNotNull() & e["score"].isNotNull())
    best = F.coalesce(F.array_max(known(zipped)), F.array_max(known(dicts)))
    return F.when(best.isNotNull(), F.struct(best["label"].alias("label"), best["score"].alias("score")))
