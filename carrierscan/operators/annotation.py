"""Gene annotation from captured JSON payloads and tab-separated toxicogenomics tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierscan.functions import expressions as X

#: Words that mark pesticides; motor neuron disease in panels, disease scores and toxicogenomics; and the cell types of nervous tissue.
PESTICIDE_WORDS = [
    "pesticide", "herbicide", "insecticide", "fungicide", "rodenticide", "chlorpyrifos", "glyphosate", "paraquat", "atrazine", "malathion", "permethrin", "carbaryl", "diazinon",
    "ddt", "dichlorodiphenyltrichloroethane", "rotenone", "fipronil", "2,4-d", "dieldrin", "endosulfan", "deltamethrin", "imidacloprid", "endrin", "lindane", "aldrin", "chlordane", "heptachlor",
    "organophosphate", "organochlorine", "carbamate", "diquat", "metolachlor", "pyrethroid", "pyrethrin",
]
PANEL_WORDS = ["amyotrophic lateral sclerosis", "motor neuron", "motor neurone", "mnd"]
SCORE_WORDS = ["amyotrophic lateral sclerosis", "motor neuron", "motor neurone"]
DISEASE_WORDS = ["amyotrophic", "motor neuron"]
NEURON_WORDS = ["neuron"]
GLIA_WORDS = ["astro", "oligo", "microglia", "glia"]

GENE_LOOKUP = "display_name string, biotype string, seq_region_name string, id string"
TISSUES = "data array<struct<tissueSiteDetailId string, median double, gencodeId string>>"
CELL_TYPES = "`RNA single cell type specific nCPM` map<string, string>, Gene string"
PANELS = "results array<struct<confidence_level string, panel struct<name string>>>"
DISEASES = "data struct<target struct<associatedDiseases struct<rows array<struct<score double, disease struct<name string>>>>>>"


def gene_lookup(payloads: DataFrame) -> DataFrame:
    """``gene_id, symbol, biotype, chrom`` from ``gene_id, payload``; a payload that is no JSON gives nulls."""
    j = F.from_json("payload", GENE_LOOKUP)
    return payloads.select("gene_id", j["display_name"].alias("symbol"), j["biotype"].alias("biotype"), j["seq_region_name"].alias("chrom"))


def brain_expression(payloads: DataFrame) -> DataFrame:
    """Whether any brain tissue has expression, and the newest versioned id of the payload."""
    rows = F.from_json("payload", TISSUES)["data"]
    version = lambda r: F.coalesce(F.split_part(r["gencodeId"], F.lit("."), F.lit(2)).try_cast("int"), F.lit(0))
    newest = F.array_max(F.transform(rows, lambda r: F.struct(version(r).alias("v"), r["gencodeId"].alias("id"))))["id"]
    return payloads.select("gene_id", F.coalesce(F.exists(rows, lambda r: F.lower(r["tissueSiteDetailId"]).contains("brain") & (r["median"] > 0)), F.lit(False)).alias("in_brain"), newest.alias("versioned_id"))


def cell_types(payloads: DataFrame) -> DataFrame:
    names = F.map_keys(F.from_json("payload", CELL_TYPES)["RNA single cell type specific nCPM"])
    held = lambda words: F.coalesce(F.exists(names, lambda n: X.any_keyword(n, words)), F.lit(False))
    return payloads.select("gene_id", F.coalesce(names, F.array().cast("array<string>")).alias("cell_types"), held(NEURON_WORDS).alias("in_neurons"), held(GLIA_WORDS).alias("in_glia"))


def panel_confidence(payloads: DataFrame) -> DataFrame:
    """Largest confidence, compared as text, over panels of the disease."""
    rows = F.filter(F.from_json("payload", PANELS)["results"], lambda r: X.any_keyword(r["panel"]["name"], PANEL_WORDS))
    return payloads.select("gene_id", F.array_max(F.transform(rows, lambda r: r["confidence_level"])).alias("panel_confidence"))


def disease_score(payloads: DataFrame) -> DataFrame:
    rows = F.from_json("payload", DISEASES)["data"]["target"]["associatedDiseases"]["rows"]
    best = F.array_max(F.transform(F.filter(rows, lambda r: X.any_keyword(r["disease"]["name"], SCORE_WORDS)), lambda r: F.struct(r["score"].alias("score"), r["disease"]["name"].alias("name"))))
    return payloads.select("gene_id", best["score"].alias("disease_score"), best["name"].alias("disease_name"))


def chemical_index(rows: DataFrame) -> DataFrame:
    """Human chemical-gene rows by upper-case gene symbol: chemicals, whether any is a pesticide, publications."""
    human = rows.where((F.col("Organism") == "Homo sapiens") & (F.trim("GeneSymbol") != ""))
    return human.groupBy(F.upper(F.trim("GeneSymbol")).alias("gene_symbol")).agg(
        F.array_sort(F.collect_set("ChemicalName")).alias("chemicals"), F.bool_or(X.any_keyword(F.col("ChemicalName"), PESTICIDE_WORDS)).alias("has_pesticide"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("PubMedIDs", r"\|"))))).alias("pubmed_ids")
    )


def disease_index(rows: DataFrame) -> DataFrame:
    """Gene-disease rows of the disease by gene: a direct link, and a link inferred through a pesticide."""
    wanted = rows.where((F.trim("GeneSymbol") != "") & (F.trim("DiseaseName") != "") & X.any_keyword(F.col("DiseaseName"), DISEASE_WORDS))
    direct = F.coalesce(F.trim("DirectEvidence"), F.lit("")) != ""
    return wanted.groupBy(F.upper(F.trim("GeneSymbol")).alias("gene_symbol")).agg(F.bool_or(direct).alias("direct_link"), F.bool_or(~direct & F.coalesce(X.any_keyword(F.col("InferenceChemicalName"), PESTICIDE_WORDS), F.lit(False))).alias("pesticide_mediated"))


def annotate(genes: DataFrame, parts: list[DataFrame], chemicals: DataFrame, diseases: DataFrame) -> DataFrame:
    """Genes (``gene_id, symbol``) with every part by ``gene_id`` and both indices by symbol; missing flags are false."""
    out = genes
    for part in parts:
        out = out.join(part, "gene_id", "left")
    out = out.withColumn("gene_symbol", F.upper(F.trim("symbol"))).join(chemicals, "gene_symbol", "left").join(diseases, "gene_symbol", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("in_brain", "in_neurons", "in_glia", "direct_link", "pesticide_mediated", "has_pesticide") if c in out.columns}
    return out.withColumns(flags | {"has_chemicals": F.size(F.coalesce("chemicals", F.array().cast("array<string>"))) > 0})


def joined_text(column: str) -> Column:
    return F.array_join(column, ", ")
