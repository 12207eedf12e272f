"""Attribute strings (k=v;k=v), ids and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(attributes: Column, lenient: bool = False) -> Column:
    """Map of an attribute string: split at the first =, the last of equal keys wins, empty parts are skipped, null and '' give an
    empty map. A part without = raises, or is left out if lenient."""
    parts = F.filter(F.transform(F.split(F.coalesce(attributes, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    whole = F.filter(parts, lambda p: p.contains("="))
    if not lenient:
        whole = F.when(F.size(whole) == F.size(parts), whole).otherwise(F.raise_error(F.concat(F.lit("attribute without =: "), attributes)).cast("array<string>"))
    entries = F.transform(whole, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value")))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return last


def parse_lists(attributes: Column) -> Column:
    """Map of arrays: values split at commas and percent-decoded (+ stays), equal keys appended, a key without = is 'true'."""
    parts = F.filter(F.transform(F.split(F.coalesce(attributes, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    decode = lambda v: F.url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(p.contains("="), F.transform(F.split(F.substring(p, F.instr(p, "=") + 1, F.length(p)), ","), decode)).otherwise(F.array(F.lit("true"))).alias("values")))
    return F.aggregate(entries, F.create_map().cast("map<string,array<string>>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], F.concat(F.coalesce(F.try_element_at(m, e["key"]), F.array().cast("array<string>")), e["values"]))))


def render(attributes: Column) -> Column:
    """k=v;k=v of a map, keys sorted."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def id_parent(ident: Column, parent: Column) -> Column:
    return F.concat_ws(";", F.concat(F.lit("ID="), ident), F.concat(F.lit("Parent="), parent))


def prefix_ids(attributes: Column, prefix: str) -> Column:
    """ID and all ids of a Parent list get the prefix; other keys that end in ID stay."""
    one = F.regexp_replace(attributes, "(^|;)ID=", f"$1ID={prefix}")
    listed = F.regexp_extract(one, "(^|;)Parent=([^;]*)", 2)
    many = F.concat(F.lit(prefix), F.replace(listed, F.lit(","), F.lit(f",{prefix}")))
    return F.when(listed == "", one).otherwise(F.regexp_replace(one, F.lit("(^|;)Parent=[^;]*"), F.concat(F.lit("$1Parent="), many)))


def column_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip()).lower()


def species_id(name: Column) -> Column:
    """'arabidopsis thaliana' is Athaliana; one word stays; null and blank are ''."""
    w = F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+")
    return F.when(F.size(w) < 2, F.trim(F.coalesce(name, F.lit("")))).otherwise(F.concat(F.upper(F.substring(w[0], 1, 1)), F.lower(F.try_element_at(w, F.lit(2)))))


def chromosome_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^chr(\d+)$", 1), F.lit("")).cast("int")


def merged_key(chrom: Column, genes: Column, strand: Column) -> Column:
    """chrom~gene|gene~strand."""
    return F.concat_ws("~", chrom, F.array_join(genes, "|"), strand)


def split_merged_key(key: Column) -> Column:
    """chrom, genes and strand of a key; null if it has not three parts."""
    p = F.split(key, "~")
    return F.when(F.size(p) == 3, F.struct(F.get(p, F.lit(0)).alias("chrom"), F.split(F.get(p, F.lit(1)), r"\|").alias("genes"), F.get(p, F.lit(2)).alias("strand")))


def gene_of(transcript: Column, known: Column) -> Column:
    """The gene by lookup, else the id without what follows its last dot."""
    return F.coalesce(known, F.regexp_replace(transcript, r"\.[^.]*$", ""))


def chromosome_order(name: Column) -> list[Column]:
    """Sort keys: numbered chromosomes by number, then all other names by name."""
    return [chromosome_number(name).asc_nulls_last(), name]


#: What stands between semicolons; those inside quotes do not count, and a quote without a partner is a plain letter.
TOKEN = r'(?:[^;"]++|"[^"]*+"|")+'


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def parse_quoted(attributes: Column) -> Column:
    """Map of arrays of an attribute string of GFF3 (k=v) or of GFF2 and GTF (k "v" or k v); its first part tells which.

    Semicolons in quotes belong to the value. A value that is quoted as a whole is one value without its quotes, others are split at
    commas; empty ones are left out, and a key without any is 'true'. Values of equal keys are appended. Percent codes are
    decoded where they are valid, + stays."""
    whole = F.transform(F.regexp_extract_all(F.coalesce(attributes, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda p: F.trim(F.regexp_replace(p, "[\\t\\r\\n]", " ")))
    decode = lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)
    none = F.array().cast("array<string>")

    def listed(value: Column) -> Column:
        quoted = (F.length(value) > 1) & value.startswith('"') & value.endswith('"')
        values = F.when(quoted, F.array(F.substr(value, F.lit(2), F.length(value) - 2))).otherwise(F.split(value, ","))
        return bound(F.filter(values, lambda v: v != ""), lambda v: F.when(F.size(v) > 0, F.transform(v, decode)).otherwise(F.array(F.lit("true"))))

    def entry(p: Column, at: Column) -> Column:
        key, value = F.when(at > 0, F.substr(p, F.lit(1), at - 1)).otherwise(p), F.when(at > 0, F.trim(F.substr(p, at + 1))).otherwise(F.lit(""))
        return F.struct(F.trim(key).alias("key"), bound(value, listed).alias("values"))

    def entries(parts: Column) -> Column:
        gff3 = F.coalesce(F.get(parts, 0), F.lit("")).rlike(r"^\w+=")
        return bound(F.when(gff3, F.lit("=")).otherwise(F.lit(" ")), lambda mark: F.transform(parts, lambda p: bound(F.call_function("locate", mark, p), lambda at: entry(p, at))))

    return F.aggregate(bound(F.filter(whole, lambda p: p != ""), entries), F.create_map().cast("map<string,array<string>>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], F.concat(F.coalesce(F.try_element_at(m, e["key"]), none), e["values"]))))


def is_gff3(attributes: Column) -> Column:
    """Whether the first attribute is written k=v; without attributes, too."""
    return F.coalesce(attributes.rlike(r'^[\s;]*\w+=') | ~attributes.rlike(r"[^\s;]"), F.lit(True))
