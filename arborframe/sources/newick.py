"""Newick trees to node tables and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborframe.functions.normalize import parse_label

NODES = "tree_id string, node_id long, parent_id long, ord int, edge_length double, label string, is_leaf boolean"


def parse(text: str) -> list[tuple[int, int | None, int, float | None, str | None, bool]]:
    """(node, parent, order among siblings, edge, label, is leaf) in pre-order; brackets hold comments, quotes labels."""
    return [r[:6] for r in parse_numbered(text)]


def parse_numbered(text: str) -> list[tuple[int, int | None, int, float | None, str | None, bool, int | None]]:
    """As ``parse``, with the number in braces that follows an edge's length in trees of placement files."""
    rows: list[list] = [[0, None, 0, None, None, True, None]]
    stack, at, k, n = [], 0, 0, len(text)
    while k < n:
        c = text[k]
        if c == "(":
            rows[at][5] = False
            stack.append(at)
            rows.append([len(rows), at, 0, None, None, True, None])
            at = len(rows) - 1
        elif c == ",":
            if not stack:
                raise ValueError("a comma outside brackets")
            rows.append([len(rows), stack[-1], rows[at][2] + 1, None, None, True, None])
            at = len(rows) - 1
        elif c == ")":
            if not stack:
                raise ValueError("a bracket that was not opened")
            at = stack.pop()
        elif c == ";":
            break
        elif c == "[":
            k = text.index("]", k)
        elif c == "'":
            end = k + 1
            while end < n and (text[end] != "'" or text[end + 1 : end + 2] == "'"):
                end += 2 if text[end] == "'" else 1
            rows[at][4] = text[k + 1 : end].replace("''", "'")
            k = end
        elif not c.isspace():
            end = k
            while end < n and text[end] not in "(),;[]'" and not (text[end] == ":" and c != ":"):
                end += 1
                if c == ":" and end < n and text[end] in "(),;[]'":
                    break
            token = text[k:end].strip()
            if c == ":":
                length, _, number = token[1:].partition("{")
                rows[at][3] = float(length)
                if number:
                    rows[at][6] = int(number.rstrip("}"))
            else:
                rows[at][4] = token
            k = end - 1
        k += 1
    if stack:
        raise ValueError("a bracket is not closed")
    return [tuple(r) for r in rows]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Node table of tree files: ids by file, parents, edges, and labels taken apart into support, taxon and aux."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^.*/", "").alias("tree_id"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree_id, text in zip(pdf["tree_id"], pdf["value"], strict=True):
                rows = pd.DataFrame(parse(text), columns=["node_id", "parent_id", "ord", "edge_length", "label", "is_leaf"])
                yield rows.assign(tree_id=tree_id, parent_id=rows["parent_id"].astype("Int64"))[[x.split()[0] for x in NODES.split(", ")]]

    nodes = texts.mapInPandas(run, NODES)
    inner = parse_label(F.col("label"))
    return nodes.select("tree_id", "node_id", "parent_id", "ord", "edge_length", F.when(F.col("is_leaf"), F.col("label")).alias("leaf_label"), F.when(~F.col("is_leaf"), inner["support"]).alias("support"), F.when(~F.col("is_leaf"), inner["taxon"]).alias("taxon"), F.when(~F.col("is_leaf"), inner["aux"]).alias("aux"))


def read_placement_tree(spark: SparkSession, path: str) -> DataFrame:
    """Node tables of the trees in placement JSON files, with ``edge_num``; ids are strings, those of leaves their labels."""
    texts = spark.read.schema("tree string").option("multiLine", True).json(path).select(F.regexp_replace(F.input_file_name(), "^.*/", "").alias("tree_id"), "tree")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree_id, text in zip(pdf["tree_id"], pdf["tree"], strict=True):
                rows = parse_numbered(text)
                name = [label if leaf and label else f"n{node}" for node, _, _, _, label, leaf, _ in rows]
                yield pd.DataFrame([(tree_id, name[n], None if p is None else name[p], o, e, k) for n, p, o, e, _, _, k in rows], columns=["tree_id", "node_id", "parent_id", "ord", "edge_length", "edge_num"]).astype({"edge_num": "Int64"})

    return texts.mapInPandas(run, "tree_id string, node_id string, parent_id string, ord int, edge_length double, edge_num long")


def write_newick(nodes: DataFrame) -> DataFrame:
    """(tree_id, newick) of node tables with parent_id, ord, edge_length and ``label``; a tree is one group.

    Where there is an ``edge_text``, it stands in the place of the length.
    """
    texts = F.col("edge_text") if "edge_text" in nodes.columns else F.lit(None).cast("string")

    def text(pdf: pd.DataFrame) -> pd.DataFrame:
        kids: dict = {}
        rows = {r.node_id: r for r in pdf.itertuples()}
        for r in sorted(rows.values(), key=lambda r: r.ord):
            kids.setdefault(None if pd.isna(r.parent_id) else r.parent_id, []).append(r.node_id)
        done: dict = {}
        stack = [(kids[None][0], False)]
        while stack:
            node, closed = stack.pop()
            if not closed:
                stack.append((node, True))
                stack += [(c, False) for c in kids.get(node, [])]
                continue
            r = rows[node]
            inner = f"({','.join(done.pop(c) for c in kids[node])})" if node in kids else ""
            label = "" if r.label is None or pd.isna(r.label) else r.label
            if any(x in label for x in "(),:;[]' "):
                label = "'" + label.replace("'", "''") + "'"
            done[node] = inner + label + (f":{r.edge_text}" if isinstance(r.edge_text, str) else "" if pd.isna(r.edge_length) else f":{r.edge_length:.10g}")
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "newick": [done[kids[None][0]] + ";"]})

    return nodes.select("tree_id", "node_id", "parent_id", "ord", "edge_length", "label", texts.alias("edge_text")).groupBy("tree_id").applyInPandas(text, f"tree_id {nodes.schema['tree_id'].dataType.simpleString()}, newick string")
