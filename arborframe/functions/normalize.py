"""Identifiers, numbers, lineages and node labels as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks from domain to species, by their prefixes.
RANKS = ("d__", "p__", "c__", "o__", "f__", "g__", "s__")
ILLEGAL_ID = r"[()\[\],;= ]"


def prefixes(first: str | None = None) -> Column:
    return F.array(*(F.lit(p) for p in ((first or RANKS[0]), *RANKS[1:])))


def canonical_id(gid: Column) -> Column:
    """Accession without source prefix and version; ids that start with U stay."""
    bare = F.regexp_replace(F.regexp_replace(gid, "^(RS_|GB_)", ""), "GC[AF]_", "G")
    return F.when(gid.startswith("U"), gid).otherwise(F.substring_index(bare, ".", 1))


def prefixed_id(gid: Column) -> Column:
    """RS_ before GCF_ accessions, GB_ before GCA_ ones."""
    return F.when(gid.startswith("GCF_"), F.concat(F.lit("RS_"), gid)).when(gid.startswith("GCA_"), F.concat(F.lit("GB_"), gid)).otherwise(gid)


def is_float(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").isNotNull(), F.lit(False))


def is_integer(text: Column) -> Column:
    return F.coalesce(text.try_cast("long").isNotNull(), F.lit(False))


def parse_label(label: Column) -> Column:
    """``support:taxon|aux`` as a struct; a label of one part is a support if it is a number, else a taxon."""
    aux = F.when(F.instr(label, "|") > 0, F.substring_index(label, "|", -1))
    head = F.substring_index(label, "|", 1)
    two = F.instr(head, ":") > 0
    first = F.substring_index(head, ":", 1)
    number = first.try_cast("double")
    rest = F.when(two, F.regexp_replace(head, "^[^:]*:", ""))
    taxon = F.when(two, rest).when(number.isNull(), head)
    return F.struct(number.alias("support"), F.nullif(taxon, F.lit("")).alias("taxon"), aux.alias("aux"))


def create_label(support: Column, taxon: Column, aux: Column) -> Column:
    """Inverse of :func:`parse_label`; nulls leave their part out."""
    head = F.concat_ws(":", support.cast("string"), taxon)
    return F.nullif(F.concat_ws("|", F.nullif(head, F.lit("")), aux), F.lit(""))


def split_lineage(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, ";+$", ""), ";"), lambda t: F.trim(t))


def standardise(taxa: Column, domain: Column) -> Column:
    """Seven ranks by position: empty elements go, the domain comes first, missing ranks are bare prefixes."""
    named = F.filter(taxa, lambda t: t.isNotNull() & (F.length(t) > 0))
    full = F.when(F.coalesce(F.get(named, F.lit(0)).startswith("d__"), F.lit(False)), named).otherwise(F.concat(F.array(domain), named))
    return F.transform(prefixes(), lambda p, i: F.coalesce(F.get(full, i), p))


def limit_rank(taxa: Column, rank: int) -> Column:
    """The lineage down to rank ``rank`` (0 is the domain), bare prefixes below."""
    return F.transform(prefixes(), lambda p, i: F.when(i <= rank, F.coalesce(F.get(taxa, i), p)).otherwise(p))


def fill_trailing(taxa: Column) -> Column:
    return F.transform(prefixes(), lambda p, i: F.coalesce(F.get(taxa, i), p))


def fill_missing(taxa: Column) -> Column:
    """Gaps inside a lineage filled by prefix; each rank keeps its first taxon."""
    return F.transform(prefixes(), lambda p: F.coalesce(F.get(F.filter(taxa, lambda t: t.startswith(p)), F.lit(0)), p))


def is_full(taxa: Column) -> Column:
    """Seven ranks with the right prefixes."""
    return (F.size(taxa) == 7) & F.forall(F.zip_with(taxa, prefixes(), lambda t, p: F.coalesce(t.startswith(p), F.lit(False))), lambda x: x)


def bad_id(gid: Column) -> Column:
    """Why an identifier is refused, or null."""
    return F.when(gid.isNull() | (F.trim(gid) == ""), "blank").when(gid.rlike(ILLEGAL_ID), "illegal character")


def bad_outgroup(taxon: Column) -> Column:
    """Why a taxon cannot be an outgroup, or null; the tests hold in this order."""
    return (
        F.when(taxon.isNull() | (taxon == ""), "empty").when(F.length(taxon) < 4, "too short").when(taxon.startswith("d__"), "a domain")
        .when(~F.substring(taxon, 1, 3).isin(*RANKS[1:]), "no rank prefix")
    )


# Words that no accepted species name holds, and the reason given for each, in the order of the tests.
SPECIES_WORDS = (
    (" bacterium", "bacterium"), (" archaeon", "archaeon"), (" archeaon", "archeaon"), ("-like", "-like"), (" group ", "group"),
    (" symbiont", "symbiont"), (" endosymbiont", "endosymbiont"), (" taxon", "taxon"), (" cluster", "cluster"), (" of ", "of"),
)


def bad_species(name: Column) -> Column:
    """Why a species name is refused, or null; a bare prefix is valid, and the first reason counts."""
    bare = F.regexp_replace(name, "^s__", "")
    low, words = F.lower(bare), F.size(F.split(bare, " "))
    tests = [
        (~name.startswith("s__"), "no species prefix"),
        (words <= F.when(low.contains("candidatus"), 2).otherwise(1), "no generic name"),
        *((low.contains(text), f"contains '{word}'") for text, word in SPECIES_WORDS),
        (bare.rlike(r"^\p{Ll}"), "starts in lower case"),
        (low.contains("sp."), "contains 'sp.'"),
    ]
    reason = reduce(lambda out, t: F.when(t[0], t[1]).otherwise(out), reversed(tests), F.lit(None).cast("string"))
    return F.when(name != "s__", reason)


def related(rows: Column) -> Column:
    """``id, species, radius, ani, af`` for every struct of an array, joined by ``; `` in the array's order."""
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(", ", r["ref"], r["species"], F.format_string("%.2f", r["radius"]), F.format_string("%.2f", r["ani"]), F.format_string("%.3f", r["af"]))), "; ")


def parse_related(text: Column) -> Column:
    """The ids of :func:`related` with their numbers; entries of fewer fields or bad numbers are left out."""
    entries = F.transform(F.split(text, ";"), lambda e: F.transform(F.split(e, ","), lambda t: F.trim(t)))
    read = F.transform(entries, lambda e: F.struct(F.get(e, F.lit(0)).alias("ref"), F.get(e, F.lit(3)).try_cast("double").alias("ani"), F.get(e, F.lit(4)).try_cast("double").alias("af")))
    return F.filter(read, lambda r: r["ani"].isNotNull() & r["af"].isNotNull())


def without_related(text: Column, ref: Column) -> Column:
    """The list without one id; null when none is left."""
    kept = F.filter(F.transform(F.split(text, ";"), lambda t: F.trim(t)), lambda e: ~e.startswith(F.concat(ref, F.lit(","))))
    return F.nullif(F.array_join(kept, "; "), F.lit(""))


def warnings(*named: tuple[Column, str]) -> Column:
    """Messages of the conditions that hold, sorted and joined by ``;``; null without any."""
    held = F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in named)))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(held)), ";"), F.lit(""))


def strip_hmm(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(HMM|hmm)", "")


def remove_extension(name: Column, extension: str | None = None) -> Column:
    """A file name without its last extension, or without ``extension`` and the dot before it."""
    base = F.regexp_replace(name, "^.*/", "")
    if extension:
        return F.regexp_replace(F.regexp_replace(base, f"\\Q{extension}\\E$", ""), r"\.$", "")
    return F.regexp_replace(base, r"\.[^.]*$", "")


def translation_table(density4: Column, density11: Column, user: Column | None = None) -> Column:
    """4 if its coding density is over 0.7 and exceeds that of 11 by over 0.05, else 11; a user's choice wins."""
    best = F.when((density4 - density11 > 0.05) & (density4 > 0.7), 4).otherwise(11)
    return best if user is None else F.coalesce(user.cast("int"), best)


def itol_label(taxon: Column) -> Column:
    """Taxa of a label parted by ``|`` alone, without quotes."""
    return F.translate(F.replace(taxon, F.lit("; "), F.lit(";")), ";'", "|")


def itol_length(edge: Column, support: Column) -> Column:
    """An edge's length with the support of its node in brackets behind it; null where there is no length."""
    return F.when(edge != 0, F.concat(edge.cast("string"), F.lit("["), F.coalesce(support.cast("string"), F.lit("None")), F.lit("]")))


def taxa_at_ranks(text: Column) -> Column:
    """Rank prefix to taxon, for the ranks that a lineage has."""
    taxa = split_lineage(text)
    return F.map_from_arrays(F.slice(prefixes(), 1, F.least(F.size(taxa), F.lit(7))), F.slice(taxa, 1, 7))


def valid_species(taxon: Column) -> Column:
    """The generic and specific name of a species, null where :func:`bad_species` refuses it or a word is missing."""
    bare = F.regexp_replace(taxon, "^s__", "")
    words = F.split(F.regexp_replace(bare, r"^Candidatus ", ""), " ")
    pair = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    return F.when(bad_species(taxon).isNull() & (F.size(words) > 1), F.concat(F.lit("s__"), pair))


def species_with_genus(taxa: Column) -> Column:
    """A lineage whose species starts with its genus."""
    genus, species = F.substring_index(F.get(taxa, F.lit(5)), "__", -1), F.substring_index(F.get(taxa, F.lit(6)), "__", -1)
    full = F.when((species == "") | species.startswith(genus), F.get(taxa, F.lit(6))).otherwise(F.concat(F.lit("s__"), genus, F.lit(" "), species))
    return F.transform(taxa, lambda t, i: F.when(i == 6, full).otherwise(t))


def rank_medians(named: Column) -> Column:
    """Medians by rank prefix from a map by rank name (Phylum, class, ...); names that are no rank go."""
    prefix = lambda k: F.concat(F.lower(F.substring(k, 1, 1)), F.lit("__"))
    known = F.map_filter(named, lambda k, v: F.lower(k).isin("domain", "phylum", "class", "order", "family", "genus", "species"))
    return F.transform_keys(known, lambda k, v: prefix(k))


def half_even(value: Column, digits: int) -> Column:
    """A double rounded by the exact value of its binary fraction, ties to even: what Python's ``round`` gives.

    Which side of a tie a double lies on is read from its product with twice the power of ten, taken exactly as a
    rounded product and its error (Dekker 1971).
    """
    scale = 2.0 * 10**digits
    high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    low = scale - high
    v = F.abs(value)
    top = v * 134217729.0 - (v * 134217729.0 - v)
    rest, product = v - top, v * scale
    error = ((top * high - product) + top * low + rest * high) + rest * low
    k = F.floor(product / 2).cast("double")
    side = (product - (2 * k + 1)) + error
    up = (side > 0) | ((side == 0) & (k % 2 == 1))
    return F.signum(value) * (F.when(up, k + 1).otherwise(k) / F.lit(10.0**digits))


def bad_path(path: Column) -> Column:
    """Why a path is refused, or null."""
    return F.when(path.isNull() | (path == ""), "blank path").when(path.contains(" "), "space in path")


def is_user_genome(gid: Column) -> Column:
    return gid.startswith("U_")
