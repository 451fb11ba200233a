"""Bases, codons and the packed impact word, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import AMINO_ACIDS, TERM_NAMES

BASES = "ACGT"


def base_code(base: Column) -> Column:
    """A 0, C 1, G 2, T and U 3, anything else 4."""
    at = F.instr(F.lit("ACGTU"), F.upper(base))
    return F.when(at == 0, 4).when(at == 5, 3).otherwise(at - 1).cast("int")


def base_of(code: Column) -> Column:
    """Inverse of :func:`base_code`; 4 is ``-``."""
    return F.substring(F.lit("ACGT-"), (code + 1).cast("int"), F.lit(1))


def is_base(base: Column) -> Column:
    return F.upper(base).isin(*"ACGTU")


def complement(seq: Column, rna: bool = False) -> Column:
    """Complementary bases, case kept; U pairs with A; other letters stay."""
    return F.translate(seq, "ACGTUacgtu", "UGCAAugcaa" if rna else "TGCAAtgcaa")


def reverse_complement(seq: Column, rna: bool = False) -> Column:
    return F.reverse(complement(seq, rna))


def transcribe(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def back_transcribe(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def oriented(seq: Column, strand: Column) -> Column:
    """The sequence as read on its strand."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def amino_acid(codon: Column) -> Column:
    """Three-letter amino acid or STOP; null for anything that is not a codon of A, C, G, T or U."""
    code = F.create_map(*[F.lit(x) for pair in sorted(AMINO_ACIDS.items()) for x in pair])
    return F.try_element_at(code, back_transcribe(F.upper(codon)))


def codon_number(codon: Column) -> Column:
    """0..63 by base codes, first base highest; null with any other letter."""
    codes = [base_code(F.substring(codon, i, 1)) for i in (1, 2, 3)]
    valid = (F.length(codon) == 3) & (F.greatest(*codes) < 4)
    return F.when(valid, codes[0] * 16 + codes[1] * 4 + codes[2]).cast("int")


def pairs(a: Column, b: Column) -> Column:
    """Watson-Crick or GU wobble pairing of RNA bases."""
    couple = F.concat(transcribe(F.upper(a)), transcribe(F.upper(b)))
    return couple.isin("AU", "UA", "CG", "GC", "GU", "UG")


def is_purine(base: Column) -> Column:
    return F.upper(base).isin("A", "G")


def is_gc(base: Column) -> Column:
    return F.upper(base).isin("G", "C")


def transition(base: Column) -> Column:
    """A<->G, C<->T."""
    return F.translate(base, "ACGTacgt", "GTACgtac")


def other_base(base: Column, draw: Column) -> Column:
    """One of the three other bases by a draw in [0, 1); of four for an unknown base."""
    others = F.replace(F.lit("ACGT"), F.upper(base), F.lit(""))
    return F.substring(others, (F.floor(draw * F.length(others)) + 1).cast("int"), F.lit(1))


def to_gc(base: Column, draw: Column) -> Column:
    """G or C: as it is, or by a draw."""
    return F.when(is_gc(base), F.upper(base)).otherwise(F.when(draw < 0.5, "G").otherwise("C"))


def gc_to_au(seq: Column, which: Column, draw: Column) -> Column:
    """The sequence with one G or C, the ``which``-th by a draw, made A or U by another; unchanged without any."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(seq))), lambda i: is_gc(F.substring(seq, i, F.lit(1))))
    place = F.try_element_at(at, (F.floor(which * F.size(at)) + 1).cast("int"))
    return F.when(place.isNull(), seq).otherwise(F.overlay(seq, F.when(draw < 0.5, "A").otherwise("U"), place))


# ---------------------------------------------------------------- packed words


def _packed_bases(bases: Column, width: int, shift: int) -> Column:
    codes = [base_code(F.substring(bases, i + 1, 1)).cast("long") for i in range(6)]
    out = F.shiftleft(codes[0], shift)
    for i in range(1, 6):
        out = out.bitwiseOR(F.shiftleft(codes[i], shift + width * i))
    return out


def _unpacked_bases(word: Column, width: int, shift: int) -> Column:
    parts = [base_of(F.shiftright(word, shift + width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(6)]
    return F.concat(*parts)


def pack_impact(frame: Column, neighbours: Column, mask: Column) -> Column:
    """2 bits frame, 18 bits neighbourhood (six bases of three bits, nearest the left end lowest), then terms."""
    return frame.cast("long").bitwiseOR(_packed_bases(neighbours, 3, 2)).bitwiseOR(F.shiftleft(mask.cast("long"), 20))


def unpack_impact(word: Column) -> Column:
    """struct(frame, neighbours, mask)."""
    return F.struct(
        word.bitwiseAND(F.lit(3)).cast("int").alias("frame"),
        _unpacked_bases(word, 3, 2).alias("neighbours"),
        F.shiftrightunsigned(word, 20).alias("mask"),
    )


def pack_cds_impact(frame: Column, neighbours: Column, cds_neighbours: Column, mask: Column) -> Column:
    """2 bits frame, twice six bases of two bits (genome, spliced CDS), then terms.

    Two bits hold no unknown base: a word with one is null.
    """
    known = F.rlike(F.concat(neighbours, cds_neighbours), F.lit("^[ACGTUacgtu]{12}$"))
    word = (
        frame.cast("long")
        .bitwiseOR(_packed_bases(neighbours, 2, 2))
        .bitwiseOR(_packed_bases(cds_neighbours, 2, 14))
        .bitwiseOR(F.shiftleft(mask.cast("long"), 26))
    )
    return F.when(known, word)


def unpack_cds_impact(word: Column) -> Column:
    return F.struct(
        word.bitwiseAND(F.lit(3)).cast("int").alias("frame"),
        _unpacked_bases(word, 2, 2).alias("neighbours"),
        _unpacked_bases(word, 2, 14).alias("cds_neighbours"),
        F.shiftrightunsigned(word, 26).alias("mask"),
    )


def term_mask(terms: Column) -> Column:
    """Bit mask of an array of terms; unknown terms add nothing (see :func:`unknown_terms`).

    One membership test per known term: these are compiled, which a fold over the array is not.
    """
    mask = F.lit(0).cast("long")
    for i, t in enumerate(TERM_NAMES):
        mask = mask.bitwiseOR(F.when(F.array_contains(terms, t), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(terms.isNotNull(), mask)


def unknown_terms(terms: Column) -> Column:
    return F.array_except(terms, F.array(*[F.lit(t) for t in TERM_NAMES]))


def terms_of(mask: Column) -> Column:
    """Array of the terms of a mask, in bit order."""
    named = F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(TERM_NAMES)])
    return F.filter(named, lambda t: t.isNotNull())
