"""Rank decisions: consensus lineages, backbone and class-level merges, and the divergence-topology classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborframe.functions.normalize import RANKS, limit_rank, standardise

from . import tree


def rank_index(prefix: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, RANKS)), prefix) - 1).cast("int")


def consensus_lineage(taxa: DataFrame, key: str = "query") -> DataFrame:
    """Lineage of each query from those of its references (query, rank_idx, taxa): down to ``rank_idx`` where all agree,
    with ``undefined`` after the prefix where they do not."""
    each = taxa.select(key, "rank_idx", F.posexplode("taxa").alias("k", "taxon")).where("k <= rank_idx")
    per = each.groupBy(key, "k").agg(F.count_distinct("taxon").alias("n"), F.min("taxon").alias("taxon"))
    named = F.when(F.col("n") == 1, F.col("taxon")).otherwise(F.concat(F.substring("taxon", 1, 3), F.lit("undefined")))
    ordered = per.select(key, F.struct("k", named.alias("taxon")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return ordered.select(key, F.transform("x", lambda r: r["taxon"]).alias("taxa"))


def merge_lineages(pairs: DataFrame, classes: list[str], phyla: list[str]) -> DataFrame:
    """Final lineage of a query from its backbone lineage and its class-level one, with the rule that decided.

    ``pairs`` has query, backbone and subtree (arrays of seven). The first rule that holds counts: 1 neither names a
    class; 2 the subtree's class is valid and the backbone agrees; 3 it is valid and the backbone does not; 4 and 5 the
    same for the phylum, the lineage then ending at the phylum; 6 ranks on which both agree stay, others are bare.
    """
    b, c = F.col("backbone"), F.col("subtree")
    at = lambda x, k: F.get(x, F.lit(k))
    valid_class, valid_phylum = at(c, 2).isin(*classes), at(c, 1).isin(*phyla)
    rule = (
        F.when((at(b, 2) == "c__") & (at(c, 2) == "c__"), 1).when(valid_class & (at(b, 2) == at(c, 2)), 2).when(valid_class, 3)
        .when(valid_phylum & (at(b, 1) == at(c, 1)), 4).when(valid_phylum, 5).otherwise(6)
    )
    common = F.transform(F.array(*map(F.lit, RANKS)), lambda p, i: F.when(F.get(b, i) == F.get(c, i), F.get(b, i)).otherwise(p))
    lineage = F.when(F.col("rule").isin(2, 3), c).when(F.col("rule").isin(4, 5), limit_rank(c, 1)).when(F.col("rule") == 6, common).otherwise(b)
    warning = F.when(F.col("rule") == 3, "backbone and class-level trees name different classes").when(F.col("rule") == 4, "classification restricted to the phylum").when(F.col("rule") == 5, "backbone and class-level trees name different phyla")
    return pairs.withColumn("rule", rule).select("query", "rule", lineage.alias("taxa"), warning.alias("warning"))


def route(placed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Subtree of every query: that of its class by divergence, else of its terminal class; null stays on the backbone.

    ``placed`` has query, red_class and terminal_class; ``mapping`` (class, tree_id) is small and broadcast by size.
    """
    named = F.coalesce(F.nullif("red_class", F.lit("c__")), F.nullif("terminal_class", F.lit("c__")))
    return placed.withColumn("class", named).join(mapping, "class", "left").select("query", "class", "tree_id")


def reconcile(by_ani: DataFrame, by_tree: DataFrame) -> DataFrame:
    """One row a query with the lineage that counts and how it was found: similarity before topology, both noted."""
    joined = by_ani.select("query", F.col("taxa").alias("ani_taxa")).join(by_tree.select("query", F.col("taxa").alias("tree_taxa")), "query", "full_outer")
    method = (
        F.when(F.col("tree_taxa").isNull(), "ani").when(F.col("ani_taxa").isNull(), "topology")
        .when(F.get("ani_taxa", F.lit(5)) == F.get("tree_taxa", F.lit(5)), "ani and topology congruent").otherwise("ani and topology incongruent")
    )
    return joined.select("query", F.coalesce("ani_taxa", "tree_taxa").alias("taxa"), method.alias("method"))


def classify_by_divergence(encoded: DataFrame, red: DataFrame, queries: DataFrame, references: DataFrame, medians: dict[str, float], domain: str = "d__") -> DataFrame:
    """Rank and lineage of every query leaf from where it attaches between labelled nodes.

    ``references`` has tree_id, node_id (a leaf) and taxa. ``cur`` is the query's lowest ancestor with a reference, and
    the parent rank is that of the last taxon of the first labelled node above it. If that is a genus, or references
    under ``cur`` differ at the child rank, topology decides (cases 1a, 2). Otherwise the taxa of the first labelled
    node of the child rank under ``cur`` (case 3b), or of the single reference (1b), are tried from the deepest: a taxon
    counts if the divergence of ``cur`` is nearer to its rank's median than to that of the rank above, and in 3b also
    nearer than the node's own; else the parent rank stands.
    """
    ids = ["tree_id", "node_id"]
    median = F.create_map(*(x for rank, m in medians.items() for x in (F.lit(rank), F.lit(float(m)))))
    held = tree.closure(encoded).join(references.select("tree_id", F.col("node_id").alias("desc_id"), "taxa"), ["tree_id", "desc_id"])
    with_refs = held.select("tree_id", F.col("anc_id").alias("node_id")).distinct()
    cur = tree.first_above(encoded, queries.select(*ids), with_refs, strict=True).withColumnRenamed("anc_id", "cur").withColumnRenamed("node_id", "query")
    labelled = encoded.where("taxon IS NOT NULL AND NOT is_leaf")
    above = tree.first_above(encoded, cur.select("tree_id", F.col("cur").alias("node_id")).distinct(), labelled, strict=True)
    parent = above.join(labelled.select("tree_id", F.col("node_id").alias("anc_id"), F.split("taxon", ";").alias("t")), ["tree_id", "anc_id"]).select("tree_id", F.col("node_id").alias("cur"), F.substring(F.trim(F.element_at("t", -1)), 1, 3).alias("parent_rank"))
    base = cur.join(parent, ["tree_id", "cur"]).join(red.select("tree_id", F.col("node_id").alias("cur"), F.col("red").alias("cur_red")), ["tree_id", "cur"])
    base = base.withColumn("parent_idx", rank_index(F.col("parent_rank")))
    refs = base.select("tree_id", "cur", "parent_idx").distinct().join(held.withColumnRenamed("anc_id", "cur"), ["tree_id", "cur"])
    names = refs.groupBy("tree_id", "cur").agg(
        F.count_distinct(F.get("taxa", F.col("parent_idx") + 1)).alias("n_names"), F.count("*").alias("n_refs"), F.min_by("taxa", "desc_id").alias("ref_taxa")
    )
    below = tree.closure(encoded, leaves_only=False).join(labelled.select("tree_id", F.col("node_id").alias("desc_id"), "taxon", "path"), ["tree_id", "desc_id"]).withColumnRenamed("anc_id", "cur")
    child = base.select("tree_id", "cur", "parent_idx").distinct().join(below, ["tree_id", "cur"]).where(rank_index(F.substring("taxon", 1, 3)) == F.col("parent_idx") + 1)
    child = child.groupBy("tree_id", "cur").agg(F.min_by(F.struct("desc_id", "taxon"), "path").alias("c")).select("tree_id", "cur", F.col("c.desc_id").alias("child"), F.transform(F.split("c.taxon", ";"), lambda t: F.trim(t)).alias("child_taxa"))
    child = child.join(red.select("tree_id", F.col("node_id").alias("child"), F.col("red").alias("child_red")), ["tree_id", "child"])
    all_of = base.join(names, ["tree_id", "cur"]).join(child, ["tree_id", "cur"], "left")
    by_topology = (F.col("parent_rank") == "g__") | (F.col("n_names") != 1)
    near = lambda value, rank: F.abs(value - F.element_at(median, rank))
    single = F.expr("slice(ref_taxa, parent_idx + 2, greatest(5 - parent_idx, 0))")
    tried = F.coalesce("child_taxa", single)

    def wins(t: Column, i: Column) -> Column:
        rank = F.substring(t, 1, 3)
        before = F.when(i == 0, F.col("parent_rank")).otherwise(F.substring(F.get(tried, i - 1), 1, 3))
        own = near(F.col("cur_red"), rank) < near(F.col("cur_red"), before)
        return own & F.when(F.col("child").isNotNull(), near(F.col("cur_red"), rank) < near(F.col("child_red"), rank)).otherwise(True)

    won = F.filter(F.transform(tried, lambda t, i: F.when(wins(t, i), F.substring(t, 1, 3))), lambda r: r.isNotNull())
    rank = F.when(by_topology, F.col("parent_rank")).otherwise(F.coalesce(F.element_at(F.when(F.size(won) > 0, won), -1), F.col("parent_rank")))
    case = F.when(F.col("parent_rank") == "g__", "1a").when(F.col("n_names") != 1, "2").when(F.col("child").isNotNull(), "3b").when(F.col("n_refs") == 1, "1b").otherwise("error")
    decided = all_of.select("tree_id", "query", "cur", "cur_red", case.alias("case"), rank.alias("rank"))
    lineage = consensus_lineage(
        decided.withColumn("rank_idx", rank_index(F.col("rank"))).join(held.select("tree_id", F.col("anc_id").alias("cur"), "taxa"), ["tree_id", "cur"]).select("query", "rank_idx", "taxa")
    )
    return decided.join(lineage, "query").select("tree_id", "query", "case", "rank", "cur_red", standardise(F.col("taxa"), F.lit(domain)).alias("taxa"))


def _near(red: Column, taxon_or_rank: Column, medians: dict[str, float]) -> Column:
    """Distance of a divergence from the median of a rank (the first three letters of a taxon)."""
    median = F.create_map(*(x for rank, m in medians.items() for x in (F.lit(rank), F.lit(float(m)))))
    return F.abs(red - F.element_at(median, F.substring(taxon_or_rank, 1, 3)))


def terminal_rank(taxa: Column, parent_idx: Column, red: Column, medians: dict[str, float]) -> Column:
    """Index of the lowest rank, from below ``parent_idx`` to the genus, whose median is nearer to ``red`` than that of
    the rank above; the parent's if there is none."""
    ranks = F.array(*map(F.lit, RANKS))
    below = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: (k > parent_idx) & (F.get(taxa, k) != ""))
    won = F.filter(below, lambda k: _near(red, F.get(ranks, k), medians) < _near(red, F.get(ranks, k - 1), medians))
    return F.coalesce(F.array_max(won), parent_idx).cast("int")


def terminal_branch(taxa: Column, parent_idx: Column, red: Column, medians: dict[str, float]) -> Column:
    """Lineage of a query on the branch of the single reference with ``taxa``: down to :func:`terminal_rank`, which is
    the class at least; lower ranks are bare."""
    return limit_rank(taxa, F.greatest(terminal_rank(taxa, parent_idx, red, medians), F.lit(2)))


def internal_rank(child_taxa: Column, child_red: Column, parent: Column, red: Column, medians: dict[str, float], every: bool = False) -> Column:
    """The taxon of a child node, or else its parent's, whose rank a query between them has.

    The first taxon counts if ``red`` is nearer to its rank's median than the child's divergence and than the parent's
    rank. A further one is never taken, as its test compares a value with itself; with ``every`` it is compared with
    the taxon before it instead, and the deepest that holds wins.
    """
    first = F.get(child_taxa, F.lit(0))
    takes = (_near(red, first, medians) < _near(child_red, first, medians)) & (_near(red, first, medians) < _near(red, parent, medians))
    plain = F.when(takes, first).otherwise(parent)
    if not every:
        return plain
    tests = F.transform(
        child_taxa, lambda t, i: F.when((i > 0) & (_near(red, t, medians) < _near(red, F.get(child_taxa, i - 1), medians)) & (_near(red, t, medians) < _near(child_red, t, medians)), t)
    )
    won = F.array_compact(tests)
    return F.coalesce(F.when(F.size(won) > 0, F.element_at(won, -1)), plain)


def backbone(encoded: DataFrame, red: DataFrame, queries: DataFrame, references: DataFrame, medians: dict[str, float], domain: str, every: bool = False) -> DataFrame:
    """Three lineages of every query leaf of a backbone tree, with its divergence and whether it is on a terminal branch.

    ``references`` has tree_id, node_id (a leaf) and taxa. ``placement`` is what the labels above the query say. On a
    branch with one reference ``terminal`` follows that reference. ``red_taxa`` follows the divergence between the last
    label above and the first label of the next rank below the lowest ancestor with references; where references
    differ at that rank, the placement stands. A lineage by divergence above the class, under a child that names a class,
    lends it to ``terminal`` if the query has no terminal branch.
    """
    leaves = queries.select("tree_id", "node_id")
    held = tree.closure(encoded).join(references.select("tree_id", F.col("node_id").alias("desc_id"), "taxa"), ["tree_id", "desc_id"])
    with_refs = held.groupBy("tree_id", F.col("anc_id").alias("cur")).agg(F.count("*").alias("n_refs"), F.min_by("taxa", "desc_id").alias("ref_taxa"), F.collect_set("taxa").alias("all_taxa"))
    cur = tree.first_above(encoded, leaves, with_refs.withColumnRenamed("cur", "node_id"), strict=True).withColumnRenamed("anc_id", "cur")
    placed = tree.lineages(encoded, with_root=False).select("tree_id", "node_id", F.col("taxa").alias("labels"))
    base = leaves.join(cur, ["tree_id", "node_id"]).join(with_refs, ["tree_id", "cur"]).join(placed, ["tree_id", "node_id"], "left")
    measured = encoded.join(red, ["tree_id", "node_id"]).where("red < 1").select("tree_id", "node_id")
    known = tree.first_above(encoded, leaves, measured, strict=True).join(red.select("tree_id", F.col("node_id").alias("anc_id"), "red"), ["tree_id", "anc_id"]).select("tree_id", "node_id", "red")
    base = base.join(known, ["tree_id", "node_id"], "left").withColumn("red", F.coalesce("red", F.lit(1.0)))
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    parent = F.when(F.size(labels) > 0, F.element_at(labels, -1)).otherwise(F.lit(domain))
    base = base.withColumn("parent", parent).withColumn("parent_idx", rank_index(F.substring("parent", 1, 3)))
    inner = encoded.where("taxon IS NOT NULL AND NOT is_leaf").select("tree_id", F.col("node_id").alias("desc_id"), "taxon", "path")
    wanted = base.select("tree_id", "cur", "parent_idx").distinct()
    below = tree.closure(encoded, leaves_only=False).withColumnRenamed("anc_id", "cur").join(wanted, ["tree_id", "cur"]).join(inner, ["tree_id", "desc_id"])
    below = below.where(rank_index(F.substring("taxon", 1, 3)) == F.col("parent_idx") + 1).groupBy("tree_id", "cur", "parent_idx").agg(F.min_by(F.struct("desc_id", "taxon"), "path").alias("c"))
    child = below.select("tree_id", "cur", "parent_idx", F.transform(F.split("c.taxon", ";"), lambda t: F.trim(t)).alias("child_taxa"), F.col("c.desc_id").alias("node_id"))
    child = child.join(red.select("tree_id", "node_id", F.col("red").alias("child_red")), ["tree_id", "node_id"]).drop("node_id")
    rows = base.join(child, ["tree_id", "cur", "parent_idx"], "left")
    terminal = F.col("n_refs") == 1
    own = terminal_branch(F.col("ref_taxa"), F.col("parent_idx"), F.col("red"), medians)
    one_name = F.size(F.array_distinct(F.transform("all_taxa", lambda t: F.get(t, F.col("parent_idx") + 1)))) == 1
    has_child = F.col("child_taxa").isNotNull()
    by_child = internal_rank(F.col("child_taxa"), F.col("child_red"), F.col("parent"), F.col("red"), medians, every)
    idx = F.when(has_child, rank_index(F.substring(by_child, 1, 3))).when(terminal, terminal_rank(F.col("ref_taxa"), F.col("parent_idx"), F.col("red"), medians)).otherwise(F.col("parent_idx"))
    placement = standardise(F.filter(labels, lambda t: t != domain), F.lit(domain))
    by_red = F.when((F.col("parent_idx") == 5) | ~one_name, placement).otherwise(limit_rank(F.col("ref_taxa"), idx))
    lends = has_child & one_name & (F.col("parent_idx") < 5) & F.exists("child_taxa", lambda t: t.startswith("c__")) & (idx < 2) & ~terminal
    bare = standardise(F.array().cast("array<string>"), F.lit(domain))
    last = F.when(terminal, own).when(lends, limit_rank(F.col("ref_taxa"), 2)).otherwise(bare)
    return rows.select("tree_id", F.col("node_id").alias("query"), by_red.alias("red_taxa"), last.alias("terminal"), placement.alias("placement"), terminal.alias("is_terminal"), "red")


def route_backbone(placed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Subtree of every query of :func:`backbone` by its class, which lineage named it, and the rule of those that stay."""
    at = lambda c: F.nullif(F.get(c, F.lit(2)), F.lit("c__"))
    named = placed.select("query", at("red_taxa").alias("red_class"), at("terminal").alias("terminal_class"))
    routed = route(named, mapping).join(named, "query")
    kind = F.when(F.col("red_class").isNotNull(), "RED").when(F.col("terminal_class").isNotNull(), "TERMINAL")
    return routed.select("query", "class", "tree_id", kind.alias("named_by"), F.when(kind.isNull(), "Rule 1").alias("rule"))
