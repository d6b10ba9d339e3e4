"""Scalar expressions of the study data model; all of them run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: KING kinship thresholds from duplicate to third degree, and the seed's modulus.
KINSHIP_CLASSES = ((0.354, "duplicate"), (0.177, "first"), (0.0884, "second"), (0.0442, "third"))
SEED_MODULUS = 2_000_000
LEAST_P = 1e-300


def clean_sample_id(raw: Column) -> Column:
    """Drop a ``gen1_`` to ``gen3_`` prefix, then fold a doubled id ``X_X`` to ``X``."""
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"^gen[123]_", ""), r"^(.+)_\1$", "$1")


def fold_equal_halves(raw: Column) -> Column:
    """Fold ``X_X`` where the text before the first underscore equals the rest."""
    head = F.substring_index(raw, "_", 1)
    tail = F.substring(raw, F.length(head) + 2, F.length(raw))
    return F.when((F.instr(raw, "_") > 0) & (head == tail), head).otherwise(raw)


def id_head(raw: Column) -> Column:
    """Text before the first underscore."""
    return F.substring_index(raw, "_", 1)


def variant_label(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws("_", chrom.cast("string"), pos.cast("string"), ref, alt)


def parse_label(label: Column) -> dict[str, Column]:
    """``chrom, pos, mutation`` of a label; a position that is no integer is null."""
    parts = F.split(label, "_", 3)
    return {"chrom": F.get(parts, F.lit(0)), "pos": F.get(parts, F.lit(1)).try_cast("int"), "mutation": F.get(parts, F.lit(2))}


def chromosome_of(label: Column) -> Column:
    """Chromosome of a free-form label: what stands before a colon or else before the first of ``: _ -``, without leading c, h and r; null is ``NA``."""
    colon = F.regexp_extract(label, r"^(?:chr)?([^:]+):", 1)
    head = F.when(colon != "", colon).otherwise(F.get(F.split(label, r"[:_\-]", 2), F.lit(0)))
    return F.coalesce(F.upper(F.ltrim(F.lower(F.trim(head)), F.lit("chr"))), F.lit("NA"))


def contig(raw: Column) -> Column:
    """A contig's name without a ``chr`` prefix."""
    return F.regexp_replace(raw, r"(?i)^chr", "")


def chromosome_order(chrom: Column) -> list[Column]:
    """Sort keys: numbers by value, then names."""
    return [chrom.try_cast("int").asc_nulls_last(), chrom.asc()]


def sex_code(sex: Column) -> Column:
    """M is 1, F is 0; any other value is an error."""
    return F.when(sex == "M", 1.0).when(sex == "F", 0.0).when(sex.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("unknown sex: "), sex)).cast("double"))


def number(raw: Column) -> Column:
    """A number, or null where the text is none, NaN, or the missing mark ``.``."""
    value = F.nullif(F.trim(raw.cast("string")), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(value), value)


def dosage(raw: Column) -> Column:
    """A dosage of 0, 1 or 2; marks of missing data and other values are null."""
    value = number(raw)
    return F.when(value.between(0, 2), value).cast("tinyint")


def carrier(value: Column) -> Column:
    """1 for any positive dosage, 0 for none, null for missing."""
    return F.when(value > 0, 1).when(value == 0, 0).cast("int")


def carrier_of_two(value: Column) -> Column:
    """1 for dosages 1 and 2, 0 for 0, null for all others."""
    return F.when(value.isin(1, 2), 1).when(value == 0, 0).cast("int")


def standardized(x: Column, *by: str) -> Column:
    """Value less mean over the population standard deviation, within ``by``; a deviation of 0 counts as 1."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return (x - F.avg(x).over(w)) / F.when(sd > 0, sd).otherwise(1.0)


def average_rank(x: Column, *by: str) -> Column:
    """Rank with ties sharing their mean; null stays null and takes no rank."""
    known = F.when(x.isNotNull(), 1)
    order = Window.partitionBy(*by, known).orderBy(x)
    ties = Window.partitionBy(*by, x)
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def shifted_log(x: Column, *by: str) -> Column:
    """Logarithm after a shift that makes the smallest value at least 1."""
    return F.log(x - (F.least(F.lit(0.0), F.min(x).over(Window.partitionBy(*by))) - 1))


def kinship_class(phi: Column) -> Column:
    out = F.when(phi.isNull(), F.lit(None).cast("string"))
    for least, name in KINSHIP_CLASSES:
        out = out.when(phi >= least, name)
    return out.otherwise("unrelated")


def stable_seed(label: Column, base: int = 42) -> Column:
    """A seed that depends on the label alone: its MD5's first eight hex digits."""
    return F.pmod(F.conv(F.substring(F.md5(label.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(SEED_MODULUS)) + base


def minus_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(LEAST_P)))


def any_keyword(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def split_clean(text: Column, pattern: str = r"[,;|]") -> Column:
    """Parts of a delimited text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), F.trim), lambda x: x != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9A-Za-z_-]+", "_")


def translated(label: Column, names: dict[str, str]) -> Column:
    """A label's display name; unmapped labels stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    return F.coalesce(F.try_element_at(table, label), label) if names else label


def p_text(p: Column) -> Column:
    """A p-value as text: scientific below 0.001, else three decimals."""
    return F.when(p.isNull(), "NA").when(p < 0.001, F.format_string("%.2e", p)).otherwise(F.format_string("%.3f", p))


def yes_no(text: Column) -> Column:
    """Yes or No for boolean-like words, other text unchanged."""
    low = F.lower(F.trim(text.cast("string")))
    return F.when(low.isin("true", "1", "yes", "t", "y"), "Yes").when(low.isin("false", "0", "no", "f", "n"), "No").otherwise(text.cast("string"))


def clipped(text: Column, most: int = 80) -> Column:
    """Text cut to ``most`` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
