"""Column expressions for variants, reads and methylation calls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def meth_state(call: Column, high: float, low: float) -> Column:
    """``high`` / ``mid`` / ``low``; bounds are compared as 32-bit floats, like the calls."""
    return (
        F.when(call >= F.lit(high).cast("float"), "high")
        .when(call > F.lit(low).cast("float"), "mid")
        .otherwise("low")
    )


def call_probability(qual: Column) -> Column:
    """Modification quality 0..255 as a 32-bit probability."""
    return (qual.cast("double") / F.lit(255.0)).cast("float")


def variant_type(ref: Column, alts: Column) -> Column:
    """Record type from allele lengths; several ALT alleles make the record ``MULTI``."""
    ref_len, alt_len = F.length(ref), F.length(F.get(alts, F.lit(0)))
    return (
        F.when(F.size(alts) > 1, "MULTI")
        .when(F.size(alts) < 1, "UNKNOWN")
        .when((ref_len == 1) & (alt_len == 1), "SNV")
        .when(ref_len > alt_len, "DEL")
        .when(ref_len < alt_len, "INS")
        .otherwise("COMPLEX")
    )


def variant_group(variant_type: Column) -> Column:
    """Insertions and deletions form one group."""
    return F.when(variant_type.isin("INS", "DEL"), "INDEL").otherwise(variant_type)


def haplotype_tag(hp_type: Column, hp_value: Column, orig_hp: Column) -> Column:
    """Haplotype label of a read; text tags stay as they are, a missing tag is ``0``."""
    number = hp_value.try_cast("int")
    from_text = F.when(hp_value == "UN", "un").otherwise(hp_value)
    from_number = (
        F.when((number == 0) & orig_hp.isin("1-1", "2-1"), orig_hp)
        .when(number == -1, "un")
        .otherwise(F.coalesce(number.cast("string"), F.lit("0")))
    )
    return (
        F.when(hp_type == "Z", from_text)
        .when(hp_type.isNotNull(), from_number)
        .otherwise("0")
    )


def allele_type(base: Column, ref: Column, alt: Column) -> Column:
    """Side a read base supports, judged by the first base of each allele."""
    return (
        F.when(base == F.substring(ref, 1, 1), "ref")
        .when(base == F.substring(alt, 1, 1), "alt")
        .otherwise("unknown")
    )


def passes_filter(filter_text: Column) -> Column:
    """PASS is among the record's filters, or no filter was applied at all."""
    return (filter_text == ".") | F.array_contains(F.split(filter_text, ";"), "PASS")


def passes_filter_strictly(filter_text: Column) -> Column:
    return filter_text == "PASS"


def is_fetchable(flag: Column, mapq: Column) -> Column:
    """Primary, mapped and well placed: these reads count towards the depth limit."""
    unmapped, secondary, supplementary = 4, 256, 2048
    return (flag.bitwiseAND(unmapped | secondary | supplementary) == 0) & (mapq >= 10)


def is_usable(flag: Column) -> Column:
    """Neither failed quality control nor a duplicate: applied after the depth limit."""
    unmapped, secondary, qc_fail, duplicate = 4, 256, 512, 1024
    return flag.bitwiseAND(unmapped | secondary | qc_fail | duplicate) == 0


def strand(flag: Column) -> Column:
    return F.when(flag.bitwiseAND(16) == 0, "+").otherwise("-")


def methylation_bin(value: Column, low: float, high: float) -> Column:
    """Coarse level with open outer bounds; a missing side is ``miss``."""
    return (
        F.when(value.isNull(), "miss")
        .when(value > F.lit(high), "high")
        .when(value < F.lit(low), "low")
        .otherwise("mid")
    )


def asm_mode(normal: Column, tumor: Column, low: float = 0.2, high: float = 0.8) -> Column:
    """Change of level from normal to tumor, such as ``low→high``."""
    mode = F.concat(
        methylation_bin(normal, low, high), F.lit("→"), methylation_bin(tumor, low, high)
    )
    if low <= high:
        return mode
    # Crossed bounds: a value can be below one and above the other, and nothing is in between.
    # A pair that fits several modes takes the first: a change before a constant level.
    fits = {"low": lambda c: c < F.lit(low), "high": lambda c: c > F.lit(high)}
    ranked = [("low", "high"), ("high", "low"), ("low", "low"), ("high", "high")]
    paired = F.coalesce(
        *[F.when(fits[n](normal) & fits[t](tumor), f"{n}→{t}") for n, t in ranked], F.lit("other")
    )
    return F.when(normal.isNull() | tumor.isNull(), mode).otherwise(paired)


def source_id(path: Column) -> Column:
    """File name without folder and extension (``.vcf.gz`` counts as one extension)."""
    name = F.regexp_extract(path, "[^/]+$", 0)
    return (
        F.when((F.length(name) > 7) & name.endswith(".vcf.gz"),
               F.substring(name, F.lit(1), F.length(name) - 7))
        .otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    )
