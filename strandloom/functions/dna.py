"""Nucleotide strings as Column expressions that stay in the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements.
IUPAC, COMPLEMENT = "ACGTMRWSYKVHDBNacgtmrwsykvhdbn", "TGCAKYWSRMBDHVNtgcakywsrmbdhvn"
# The standard genetic code, codons in the order T, C, A, G.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("TAA", "TAG", "TGA")


def complement(dna: Column) -> Column:
    return F.translate(dna, IUPAC, COMPLEMENT)


def reverse_complement(dna: Column) -> Column:
    return F.reverse(complement(dna))


def soft_masked(base: Column) -> Column:
    """Whether a base is lower-case."""
    return base.rlike("^[a-z]$")


def slice_of(dna: Column, start: Column, stop: Column) -> Column:
    return F.substr(dna, (start + 1).cast("int"), (stop - start).cast("int"))


def spliced(dna: Column, parts: Column, strand: Column) -> Column:
    """Concatenation of the half-open parts (array of start, stop), reverse-complemented on the negative strand."""
    joined = F.array_join(F.transform(F.array_sort(parts), lambda p: F.substr(dna, (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int"))), "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def codons(dna: Column) -> Column:
    """Whole codons from the first base on. One pass of a pattern: substrings by place would walk a long string again for each codon."""
    return F.regexp_extract_all(dna, F.lit("(?s).{3}"), F.lit(0))


def is_complete_orf(dna: Column) -> Column:
    """At least two codons, no part of a codon left, ATG first, a stop last and none before."""
    c = codons(F.upper(dna))
    inner = F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    return F.coalesce((F.length(dna) >= 6) & (F.length(dna) % 3 == 0) & F.upper(dna).startswith("ATG") & F.element_at(c, -1).isin(*STOPS) & ~F.exists(inner, lambda x: x.isin(*STOPS)), F.lit(False))


def translate(dna: Column) -> Column:
    """Protein letters of the whole codons, * for stops and X for codons with other letters than ACGT."""
    table = F.create_map(*(F.lit(v) for c, a in zip(product("TCAG", repeat=3), AMINO, strict=True) for v in ("".join(c), a)))
    return F.array_join(F.transform(codons(F.upper(dna)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def clean_protein(protein: Column) -> Column:
    """U, Z and O become X; gaps go."""
    return F.translate(protein, "UZO-", "XXX")


def is_canonical_junction(donor: Column, acceptor: Column) -> Column:
    return F.upper(donor).isin("GT", "GC", "AT") & (F.upper(acceptor) == "AG")


def near_boundary(gap: Column) -> Column:
    return gap.between(-2, 2)


def tokens(dna: Column, vocabulary: dict[str, int], unknown: int, strict: bool = False) -> Column:
    """Ids of bases, case ignored; IUPAC codes outside the vocabulary are `unknown`, any other letter is null, or with strict an error."""
    ids = F.create_map(*(F.lit(v) for b in sorted({*IUPAC.upper()}) for v in (b, vocabulary.get(b, unknown))))
    found = lambda b: F.try_element_at(ids, b)
    return F.transform(F.split(F.upper(dna), ""), lambda b: F.coalesce(found(b), F.raise_error(F.concat(F.lit("unmapped base "), b)).cast("int")) if strict else found(b))
