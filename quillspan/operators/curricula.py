"""Controlled curricula: small generated cases with a known verdict, as tables.

A case is a binary tree of definitions; its root applied to a number is compared with a
claim.  Each tree comes with six changes, of which one keeps it right.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import udfs

#: What is changed, and the verdict that it should lead to.
CHANGES = {"sound": "PASS", "reordered": "PASS", "wrong_claim": "FAIL_LOGIC", "missing": "FAIL_GAP", "late": "FAIL_GAP", "repeated": "ABSTAIN"}
CASE = "case_id string, topology int, category string, expected string, passages array<struct<id:string,name:string,body:string,position:int>>, equality string, target_position int"


@lru_cache
def trees(n: int) -> tuple:
    """All ordered binary trees with n inner nodes; None is a leaf."""
    if n == 0:
        return (None,)
    return tuple((left, right) for k in range(n) for left in trees(k) for right in trees(n - 1 - k))


def definitions(tree: tuple) -> tuple[list[tuple[str, str]], int, int]:
    """A definition (name, body in x) per inner node, children first, and the root's value as factor * x + offset."""
    out: list[tuple[str, str]] = []

    def visit(node: tuple) -> tuple[str, int, int]:
        terms, factor, offset = [], 0, 0
        for child in node:
            name, f, o = ("x", 1, 0) if child is None else visit(child)
            terms.append(name if child is None else f"{name}(x)")
            factor, offset = factor + f, offset + o
        constant = len(out) + 2
        out.append((f"f{len(out)}", " + ".join([*terms, str(constant)])))
        return out[-1][0], factor, offset + constant

    _, factor, offset = visit(tree)
    return out, factor, offset


def case(topology: int, tree: tuple, category: str) -> tuple:
    own, factor, offset = definitions(tree)
    x = topology + 3
    claim = factor * x + offset + (category == "wrong_claim")
    passages = [(f"d{i}", name, body, i) for i, (name, body) in enumerate(own)]
    if category == "missing":
        passages = passages[1:]
    elif category == "late":
        passages[0] = (*passages[0][:3], 100)
    elif category == "repeated":
        passages.append((f"d{len(own)}", own[0][0], "x + 1", len(own)))
    elif category == "reordered":
        passages = [(i, n, b, len(own) - 1 - at) for i, n, b, at in passages]
    return f"{topology}-{category}", topology, category, CHANGES[category], passages, f"{own[-1][0]}({x}) = {claim}", 50


def controlled_cases(spark: SparkSession, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """A row per tree and change."""
    every = [t for n in sizes for t in trees(n)]
    return spark.createDataFrame([case(i, t, c) for i, t in enumerate(every) for c in CHANGES], CASE)


def solve(cases: DataFrame) -> DataFrame:
    """case_id, status, needed and missing of each case, from the passages before its target only."""
    seen = F.transform(F.filter("passages", lambda p: p["position"] < F.col("target_position")), lambda p: F.struct(p["id"], p["name"], p["body"]))
    r = cases.select("case_id", "topology", "category", "expected", udfs()["definitions_value"]("equality", seen).alias("r"))
    return r.select("case_id", "topology", "category", "expected", "r.status", "r.needed", "r.missing")
