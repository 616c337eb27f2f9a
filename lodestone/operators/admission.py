"""Token-budgeted admission of a question's pool into its packet.

The full rule set depends on order and on what was admitted before, so it runs per question, over a
pool of thirty rows at most; ``within_budget`` is the part that a fold over a sorted array can express.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ROLE_ORDER

POOL = 30
NEAR_DUPLICATE = 0.985


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 6000
    per_source: int = 3
    per_commit: int = 2
    memory: int = 5


def within_budget(candidates: DataFrame, max_tokens: int) -> DataFrame:
    """(query_id, unit_id, place, token_count, used): units taken in order whenever they still fit.

    ``candidates``: query_id, unit_id, place, token_count, with a bounded number of rows for each question.
    """
    row = F.struct(F.col("place").cast("int").alias("place"), F.col("unit_id").cast("long").alias("unit_id"), F.col("token_count").cast("long").alias("token_count"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:int,unit_id:bigint,token_count:bigint,used:bigint>>").alias("taken"))

    def step(state, x):
        used = state["used"] + x["token_count"]
        taken = F.concat(state["taken"], F.array(F.struct(x["place"].alias("place"), x["unit_id"].alias("unit_id"), x["token_count"].alias("token_count"), used.alias("used"))))
        return F.when(used <= max_tokens, F.struct(used.alias("used"), taken.alias("taken"))).otherwise(F.struct(state["used"].alias("used"), state["taken"].alias("taken")))

    folded = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return folded.select("query_id", F.inline(F.aggregate("rows", empty, step, lambda s: s["taken"])))


_OUT = "query_id bigint, unit_id bigint, place int, token_count bigint, role string, lane string, position int"


def admit(pool: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The admitted units of each question by lane, in selection order.

    ``pool``: query_id, unit_id, place, source_kind, role, source_id, commit, path, symbol, part, content_hash,
    token_count, credible, required (array of roles), embedding (or null). Rows past the thirtieth place are not in it.
    """

    def run(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values(["place", "unit_id"]).head(POOL)
        units = rows.to_dict("records")
        taken: list[tuple[dict, str]] = []
        ids, hashes = set(), set()
        spent = 0

        def fits(u: dict, required: bool) -> bool:
            nonlocal spent
            if u["unit_id"] in ids:
                return False
            got = [x for x, _ in taken]
            if u["role"] == "curated_memory":
                if sum(x["role"] == "curated_memory" for x in got) >= limits.memory:
                    return False
            elif not required and sum(x["source_id"] == u["source_id"] for x in got) >= limits.per_source:
                return False
            if u["source_kind"] == "git_commit":
                same = [x for x in got if x["source_kind"] == "git_commit" and x["commit"] == u["commit"]]
                if len(same) >= limits.per_commit:
                    return False
                if u["path"] is not None and any((x["path"], x["symbol"], x["part"]) == (u["path"], u["symbol"], u["part"]) for x in same):
                    return False
            if u["content_hash"] in hashes:
                return False
            # Seen from here on, even if a later test refuses the unit.
            hashes.add(u["content_hash"])
            if spent + u["token_count"] > limits.max_tokens:
                return False
            v = u["embedding"]
            if v is not None:
                v = np.asarray(v, float)
                for x in got:
                    if x["role"] == u["role"] and x["embedding"] is not None:
                        w = np.asarray(x["embedding"], float)
                        norm = np.linalg.norm(v) * np.linalg.norm(w)
                        if len(v) == len(w) and norm > 0 and v @ w / norm > NEAR_DUPLICATE:
                            return False
            return True

        def take(u: dict, lane: str) -> bool:
            nonlocal spent
            if not fits(u, lane == "required"):
                return False
            taken.append((u, lane))
            ids.add(u["unit_id"])
            spent += u["token_count"]
            return True

        required = list(units[0]["required"]) if units else []
        for role in required:
            any(u["role"] == role and take(u, "required") for u in units)
        for role in ROLE_ORDER:
            if role not in required:
                any(u["role"] == role and u["credible"] and take(u, "supporting") for u in units)
        for u in units:
            if u["source_kind"] != "git_commit" or u["credible"]:
                take(u, "fill")
        out = sorted(taken, key=lambda x: (x[0]["place"], x[0]["unit_id"]))
        return pd.DataFrame([(u["query_id"], u["unit_id"], u["place"], u["token_count"], u["role"], lane, k + 1) for k, (u, lane) in enumerate(out)], columns=[c.split()[0] for c in _OUT.split(", ")])

    return pool.filter(F.col("place") <= POOL).groupBy("query_id").applyInPandas(run, _OUT)
