"""Taxonomic ranks and their partial order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks from general to specific.
RANKS = """ROOT CELLULAR_ROOT ACELLULAR_ROOT DOMAIN REALM SUPERKINGDOM KINGDOM SUBKINGDOM SUPERPHYLUM PHYLUM SUBPHYLUM SUPERCLASS CLASS SUBCLASS INFRACLASS COHORT SUBCOHORT
SUPERORDER ORDER SUBORDER INFRAORDER PARVORDER SUPERFAMILY FAMILY SUBFAMILY TRIBE SUBTRIBE GENUS SUBGENUS SECTION SUBSECTION SERIES SPECIES_GROUP SPECIES_SUBGROUP SPECIES
SUBSPECIES FORMA_SPECIALIS VARIETY MORPH SUBVARIETY FORMA SUBFORMA SEROGROUP PATHOGROUP SEROTYPE BIOTYPE GENOTYPE STRAIN ISOLATE
GO0 GO1 GO2 GO3 GO4 GO5 GO6 GO7 GO8 GO9""".split()
#: Values by place, the root's the largest. Positive values compare; the others compare with nothing.
RANK_VALUES = {rank: len(RANKS) - k for k, rank in enumerate(RANKS)} | {"UNCLASSIFIED": 0, "NO_RANK": -1}
TOP_VALUE = RANK_VALUES["ROOT"]
ALIASES = {"VARIETAS": "VARIETY", "SUBVARIETAS": "SUBVARIETY", "CLADE": "NO_RANK"}
LETTERS = {"D": "DOMAIN", "K": "KINGDOM", "P": "PHYLUM", "C": "CLASS", "O": "ORDER", "F": "FAMILY", "G": "GENUS", "S": "SPECIES", "N": "STRAIN", "U": "UNCLASSIFIED", "-": "NO_RANK"}
TARGET_RANKS = ["STRAIN", "SPECIES", "GENUS", "FAMILY", "ORDER", "CLASS", "PHYLUM", "KINGDOM", "DOMAIN"]
GO_TARGET_RANKS = [f"GO{k}" for k in range(9, 1, -1)]


def target_ranks(strain: bool = True, go: bool = False) -> list[str]:
    """The ranks that cross analysis visits, most specific first."""
    return GO_TARGET_RANKS if go else TARGET_RANKS if strain else TARGET_RANKS[1:]


def rank_name(text: Column) -> Column:
    """A dump's rank text as a rank: upper case, blanks to underscores, other spellings resolved."""
    plain = F.regexp_replace(F.upper(F.trim(text)), " ", "_")
    for other, name in ALIASES.items():
        plain = F.when(plain == other, name).otherwise(plain)
    return plain


def rank_value(rank: Column) -> Column:
    """A rank's value; null for text that is no rank."""
    table = F.create_map(*(F.lit(x) for pair in RANK_VALUES.items() for x in pair))
    return F.try_element_at(table, rank)


def rank_of_letter(letter: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair)), letter)


def at_or_below(value: Column, other: Column | int) -> Column:
    """Whether a rank is as specific as another or more; false if either has no place in the order."""
    other = F.lit(other) if isinstance(other, int) else other
    return F.coalesce((value > 0) & (other > 0) & (value <= other), F.lit(False))


def below(value: Column, other: Column | int) -> Column:
    other = F.lit(other) if isinstance(other, int) else other
    return F.coalesce((value > 0) & (other > 0) & (value < other), F.lit(False))


def go_rank(depth: Column) -> Column:
    """The rank of a gene-ontology node by its depth: GO0 at the root to GO9; deeper nodes have none."""
    return F.when(depth <= 9, F.concat(F.lit("GO"), depth.cast("string"))).otherwise("NO_RANK")
