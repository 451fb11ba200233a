"""Fixed tables of the domain and the column conventions.

Regions have ``chrom, start, end, name, strand`` with 1-based inclusive coordinates; variants
``chrom, pos, ref, alt``; tracks ``chrom, track_pos``.  Coordinates are longs.
"""

from __future__ import annotations

# Consequence terms in bit order, each with its contexts.
TERMS: tuple[tuple[str, str], ...] = (
    ("NOMINAL_IMPACT", ""),
    ("intergenic_variant", ""),
    ("feature_truncation", ""),
    ("regulatory_region_variant", ""),
    ("feature_elongation", ""),
    ("regulatory_region_amplification", ""),
    ("regulatory_region_ablation", ""),
    ("TF_binding_site_variant", ""),
    ("TFBS_amplification", ""),
    ("TFBS_ablation", ""),
    ("downstream_gene_variant", ""),
    ("upstream_gene_variant", ""),
    ("non_coding_transcript_variant", ""),
    ("NMD_transcript_variant", ""),
    ("intron_variant", "Intron"),
    ("non_coding_transcript_exon_variant", ""),
    ("3_prime_UTR_variant", "3p_UTR"),
    ("5_prime_UTR_variant", "5p_UTR"),
    ("mature_miRNA_variant", ""),
    ("coding_sequence_variant", "CDS"),
    ("synonymous_variant", "CDS"),
    ("stop_retained_variant", "Stop_Codon"),
    ("start_retained_variant", "Start_Codon"),
    ("incomplete_terminal_codon_variant", "CDS"),
    ("splice_region_variant", "Splice_Region"),
    ("protein_altering_variant", ""),
    ("missense_variant", "CDS"),
    ("inframe_deletion", "CDS"),
    ("inframe_insertion", "CDS"),
    ("transcript_amplification", ""),
    ("start_lost", "CDS Start_Codon"),
    ("stop_lost", "CDS Stop_Codon"),
    ("frameshift_variant", "CDS"),
    ("stop_gained", "Stop_Codon"),
    ("splice_donor_variant", "Splice_Donor"),
    ("splice_acceptor_variant", "Splice_Acceptor"),
    ("transcript_ablation", ""),
)
# Context names in flag order.
CONTEXTS = ("CDS", "Splice_Region", "Splice_Acceptor", "Splice_Donor", "5p_UTR", "3p_UTR", "Start_Codon", "Stop_Codon", "Intron")
TERM_NAMES = tuple(t for t, _ in TERMS)
TERM_BIT = {t: i for i, t in enumerate(TERM_NAMES)}


def context_mask(context: str) -> int:
    """Impact bits of the terms that carry a context."""
    return sum(1 << i for i, (_, flags) in enumerate(TERMS) if context in flags.split())


# The standard genetic code, one letter per codon in the order TCAG x TCAG x TCAG.
_GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_THREE = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile",
    "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "STOP",
}
AMINO_ACIDS = {
    a + b + c: _THREE[_GENETIC_CODE[16 * i + 4 * j + k]]
    for i, a in enumerate("TCAG")
    for j, b in enumerate("TCAG")
    for k, c in enumerate("TCAG")
}
