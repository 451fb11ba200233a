"""String, number and name helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RESERVED = "+-./\\*^$#@!&()~=?\"`][}{ "


def normal_chrom(name: Column) -> Column:
    """Reserved characters become ``_``; a leading chr, Chr or CHR goes."""
    clean = F.translate(name, _RESERVED, "_" * len(_RESERVED))
    return F.regexp_replace(clean, "^(chr|Chr|CHR)", "")


def tokens(text: Column, separators: str, keep_empty: bool = False) -> Column:
    """Split at any of the characters; empty tokens are dropped unless kept."""
    split = F.split(text, "[" + "".join("\\" + c for c in separators) + "]")
    return split if keep_empty else F.filter(split, lambda t: t != "")


def tokens_by_text(text: Column, separator: str) -> Column:
    return F.filter(F.split(text, "\\Q" + separator + "\\E"), lambda t: t != "")


def first_tokens(text: Column, separators: str, n: int) -> Column:
    return F.slice(tokens(text, separators), 1, n)


def count_tokens(text: Column, separators: str, keep_empty: bool = False) -> Column:
    return F.size(tokens(text, separators, keep_empty))


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def integers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("\\d+"), F.lit(0)), lambda x: x.cast("long"))


def in_base(number: Column, base: int) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, base))


def from_base(text: Column, base: int) -> Column:
    return F.conv(text, base, 10).cast("long")


def same_text(a: Column, b: Column, case_sensitive: bool = True) -> Column:
    return a == b if case_sensitive else F.lower(a) == F.lower(b)


def names_match(a: Column, b: Column) -> Column:
    """One name holds the other, whatever the case; ``.`` matches any."""
    x, y = F.lower(a), F.lower(b)
    return (a == ".") | (b == ".") | F.contains(x, y) | F.contains(y, x)


def matching_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return F.array_max(at)


def without(text: Column, characters: str, by: str = "_") -> Column:
    return F.translate(text, characters, by * len(characters))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def trim_left(text: Column) -> Column:
    return F.ltrim(text)


def is_balanced(text: Column, opening: str = "([{", closing: str = ")]}") -> Column:
    """Brackets close in the order they were opened."""
    marks = F.split(F.regexp_replace(text, "[^" + "".join("\\" + c for c in opening + closing) + "]", ""), "")

    def step(stack: Column, mark: Column) -> Column:
        opener = F.translate(mark, closing, opening)
        closing_mark = F.instr(F.lit(closing), mark) > 0
        return (
            F.when((mark == "") | F.startswith(stack, F.lit("!")), stack)
            .when(~closing_mark, F.concat(stack, mark))
            .when(F.right(stack, F.lit(1)) == opener, F.left(stack, F.length(stack) - 1))
            .otherwise(F.lit("!"))
        )

    return F.aggregate(marks, F.lit(""), step) == ""


def natural_order(name: str) -> list[Column]:
    """Sort keys that put shorter names first, then bytewise."""
    return [F.length(name), F.col(name)]


# ---------------------------------------------------------------- attributes


def attribute(attributes: Column, key: str) -> Column:
    """Value of ``key=value`` or ``key value`` among ``;``-separated GFF attributes; the last one counts."""
    found = F.regexp_extract_all(attributes, F.lit(f'(?:^|;)\\s*{key}[= ]\\s*"?([^;"]*)"?'), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def info_field(info: Column, key: str) -> Column:
    return F.try_element_at(F.str_to_map(info, F.lit(";"), F.lit("=")), F.lit(key))


def derived_frequency(info: Column, ref: Column, alt: Column, compat: bool = False) -> Column:
    """Frequency of the allele that is not ancestral (AA), from AC and AN.

    Null if AA is neither REF nor ALT or a field is missing.  ``compat`` gives the ancestral one.
    """
    ancestral = F.upper(F.element_at(F.split(F.coalesce(info_field(info, "AA"), F.lit("")), "\\|"), 1))
    alt_share = info_field(info, "AC").try_cast("double") / F.nullif(info_field(info, "AN").try_cast("double"), F.lit(0.0))
    derived = F.when(ancestral == F.upper(ref), alt_share).when(ancestral == F.upper(alt), 1 - alt_share)
    return 1 - derived if compat else derived


def recombination_probability(delta_cm: Column) -> Column:
    """Half of 1 - exp(-2 cM / 100)."""
    return 0.5 * (1 - F.exp(-2 * delta_cm / 100))


# ---------------------------------------------------------------- genotypes


def genotype_alleles(gt: Column) -> Column:
    """struct(a0, a1, phased) of a GT field; missing alleles are null, a haploid call has one allele."""
    parts = F.split(gt, "[|/]")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).try_cast("int").alias("a0"),
        F.try_element_at(parts, F.lit(2)).try_cast("int").alias("a1"),
        F.contains(gt, F.lit("|")).alias("phased"),
    )


def presence(a0: Column, a1: Column) -> Column:
    return ((a0 > 0) | (a1 > 0)).cast("int")


def dosage(a0: Column, a1: Column) -> Column:
    return (a0 > 0).cast("int") + (a1 > 0).cast("int")


def haplotype_code(a0: Column, a1: Column) -> Column:
    """2 a0 + a1; missing is -1."""
    return F.coalesce(2 * (a0 > 0).cast("int") + (a1 > 0).cast("int"), F.lit(-1))


def haplotype_allele(code: Column, haplotype: int) -> Column:
    """Bit ``haplotype`` of a code (1 is the first haplotype); null if missing."""
    return F.when(code >= 0, F.shiftright(code, haplotype).bitwiseAND(F.lit(1)))


def dosage_of_code(code: Column) -> Column:
    return F.when(code >= 0, F.bit_count(code.bitwiseAND(F.lit(3))))
