"""Scores of reads and of groups of reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets of the single hit equivalent length by classifier, and its largest score of GO annotations.
SHEL_OFFSET = {"centrifuge": 15, "kraken": 35, "clark": 31}
GO_LARGEST_SCORE = 308.0

SCORINGS = ("SHEL", "LENGTH", "LOGLENGTH", "NORMA", "LMAT", "CLARK_C", "CLARK_G", "KRAKEN", "GENERIC", "GO")
#: What a chart calls each scoring.
DISPLAY = {
    "SHEL": "Score (avg)", "LENGTH": "Read length (avg)", "LOGLENGTH": "Length (log10)", "NORMA": "Score/Length (%)", "LMAT": "LMAT score (avg)", "CLARK_C": "CLARK conf (%)",
    "CLARK_G": "CLARK gamma (avg)", "KRAKEN": "Kmer coverage (%)", "GENERIC": "Generic score (avg)", "GO": "Score from Eval",
}
#: Scorings that each reader can give; what it falls back to stands first.
COMPATIBLE = {
    "centrifuge": ("SHEL", "LENGTH", "LOGLENGTH", "NORMA"),
    "kraken": ("KRAKEN", "SHEL", "LENGTH", "LOGLENGTH", "NORMA"),
    "clark": ("SHEL", "CLARK_C", "CLARK_G", "LENGTH", "LOGLENGTH", "NORMA"),
    "lmat": ("LMAT",),
    "generic": ("GENERIC", "LENGTH", "LOGLENGTH", "NORMA"),
    "go": ("GO", "LENGTH", "LOGLENGTH"),
}


def checked_scoring(reader: str, scoring: str | None) -> str:
    """The scoring to use: what was asked for (SHEL, if nothing was) if the reader has it, else its fall-back."""
    usable = COMPATIBLE[reader]
    asked = "SHEL" if scoring is None else scoring
    if asked not in SCORINGS:
        raise ValueError(f"no such scoring: {scoring}")
    return asked if asked in usable else usable[0]


def centrifuge_shel(score: Column) -> Column:
    return F.sqrt(score) + SHEL_OFFSET["centrifuge"]


def group_score(scoring: str, score: Column, length: Column) -> Column:
    """The score of a group of reads, as an aggregate."""
    if scoring == "LENGTH":
        return F.avg(length)
    if scoring == "LOGLENGTH":
        return F.log10(F.avg(length))
    if scoring == "NORMA":
        return F.lit(100.0) * F.avg(score) / F.avg(length)
    return F.avg(score)


def weighted_mean(score: Column, weight: Column, log: bool = False) -> Column:
    """Mean of scores with weights, as an aggregate; null scores are left out. Logarithmic scores are averaged as powers of ten."""
    weight = F.when(score.isNotNull(), weight)
    if log:
        return F.log10(F.try_divide(F.sum(weight * F.pow(F.lit(10.0), score)), F.sum(weight)))
    return F.try_divide(F.sum(weight * score), F.sum(weight))


def auto_mintaxa(filtered: Column) -> Column:
    """The least number of reads of a node, from the number of a sample's reads: the rounded logarithm, half to even, 1 for none."""
    return F.coalesce(F.bround(F.log10(F.when(filtered > 0, filtered))).cast("int"), F.lit(1))


def length_text(nt: Column) -> Column:
    """A number of nucleotides with a unit: nt, knt, Mnt, Gnt, Tnt."""
    found = F.concat(nt.cast("string"), F.lit(" nt"))
    for exponent, unit in ((3, "knt"), (6, "Mnt"), (9, "Gnt"), (12, "Tnt")):
        found = F.when(nt > 10**exponent, F.concat(F.format_string("%.2f", nt / F.lit(10.0**exponent)), F.lit(f" {unit}"))).otherwise(found)
    return found


def share(part: Column, whole: Column) -> Column:
    """part / whole, NaN where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(float("nan")))
