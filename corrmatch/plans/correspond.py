"""The whole comparison: phases from the strongest evidence to the weakest.

Each phase joins the files that are still free into candidates, scores them, and lets
left files choose in order; what it takes is gone for the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HIGH, UNCERTAIN, Request, Settings
from ..functions import similarity
from ..operators import blocks, candidates, report, resolve
from ..operators.lineage import cut
from ..sources.workspace import scan

#: Columns that connect the candidates of a phase.
GROUPED = {"2": "filename"}
TAKEN = "l_ord long, r_ord long, phase string, match_type string, similarity double"


@dataclass
class Comparison:
    left: DataFrame
    right: DataFrame
    matches: DataFrame
    calls: int
    request: dict

    def sections(self) -> DataFrame:
        return report.sections(self.left, self.right, self.matches)

    def stats(self) -> dict:
        out = {"llm_calls": self.calls, **self.request}
        for r in report.totals(self.left.select("side", "ignored").unionByName(self.right.select("side", "ignored"))).collect():
            out |= {f"{k}_{r.side}": r[k] for k in ("total", "comparable", "ignored")}
        return out | report.counters(self.matches).first().asDict()


def free(files: DataFrame, taken: DataFrame, side: str) -> DataFrame:
    return report.leftovers(files, taken, side)


def _text(files: DataFrame) -> DataFrame:
    return files.where("not is_binary")


def phase_one(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same path."""
    pairs = candidates.exact_path(left, right)
    return pairs.select("l_ord", "r_ord", F.lit("1").alias("phase"), F.lit("exact_path").alias("match_type"), F.lit(100.0).alias("similarity"))


def phase_binary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Binary files of one name: equal bytes first, then the more similar folder."""
    l, r = left.where("is_binary"), right.where("is_binary")  # noqa: E741
    pairs = candidates.same_name(l, r).withColumn("dir_sim", similarity.folder_similarity("l_dir", "r_dir"))
    data = lambda f, s: f.select(F.col("ord").alias(f"{s}_ord"), F.sha2("content", 256).alias(f"{s}_sha"))
    pairs = pairs.join(data(l, "l"), "l_ord").join(data(r, "r"), "r_ord").withColumn("same", F.coalesce((F.col("l_sha") == F.col("r_sha")).cast("int"), F.lit(0)))
    taken = resolve.greedy(pairs.select("l_ord", "r_ord", "filename", "same", "dir_sim"), "same", "dir_sim", group="filename")
    body = lambda f, s: f.select(F.col("ord").alias(f"{s}_ord"), F.substring("content", 1, similarity.BINARY_CAP).alias(f"{s}_head"))
    sim = F.when(F.col("same") == 1, 100.0).otherwise(similarity.binary_similarity("l_head", "r_head"))
    taken = taken.join(body(l, "l"), "l_ord").join(body(r, "r"), "r_ord")
    return taken.select("l_ord", "r_ord", F.lit("2-BIN").alias("phase"), F.lit("binary").alias("match_type"), sim.alias("similarity"))


def edges(phase: str, left: DataFrame, right: DataFrame, cfg: Settings, judged: bool) -> tuple[DataFrame, str]:
    """Scored candidates of a text phase, and the column that ranks them.

    Pairs below the lowest score that can still matter are left out.
    """
    l, r = _text(left), _text(right)  # noqa: E741
    if phase == "2":
        least = min(HIGH, cfg.llm_min_sim if judged else max(UNCERTAIN, cfg.llm_min_sim)) if cfg.max_llm_per_file else HIGH
        return blocks.scored(l, r, least, by="filename"), "sim"
    if phase == "3":
        least = min(HIGH, cfg.llm_min_sim) if judged and cfg.max_llm_per_file else HIGH
        found = candidates.scored(candidates.similar_name(l, r), l, r, least)
        return found.withColumn("combined", similarity.NAME_WEIGHT * F.col("name_sim") + similarity.CONTENT_WEIGHT * F.col("sim")), "combined"
    least = min(cfg.content_sim_threshold, cfg.llm_min_sim) if judged and cfg.max_llm_per_file else cfg.content_sim_threshold
    return blocks.scored(l, r, least, threshold=cfg.content_sim_threshold), "sim"


def accepted(phase: str, found: DataFrame, cfg: Settings) -> DataFrame:
    """The candidates that a phase without an arbiter may take."""
    if phase == "2" and cfg.max_llm_per_file:
        return found.where((F.col("sim") > HIGH) | (F.col("sim") > UNCERTAIN) & (F.col("sim") >= cfg.llm_min_sim))
    return found.where(F.col("sim") >= cfg.content_sim_threshold if phase == "3b" else F.col("sim") > HIGH)


def compare(left: DataFrame, right: DataFrame, settings: Settings = Settings(), judge: Callable[[dict], int | None] | None = None, request: dict | None = None) -> Comparison:
    """Match the files of two scans; ``judge`` is an optional arbiter of text pairs.

    A judge gets an edge (l_ord, r_ord, sim, ...) and returns a percentage or None.
    """
    spark = left.sparkSession
    left, right = cut(left), cut(right)
    l, r = left.where("not ignored"), right.where("not ignored")  # noqa: E741
    taken = cut(phase_one(l, r))
    taken = cut(taken.unionByName(phase_binary(free(l, taken, "l"), free(r, taken, "r"))))
    gate = resolve.Gate(judge, settings.llm_failure_limit) if judge else None
    for phase in ("2", "3", "3b"):
        free_l, free_r = free(l, taken, "l"), free(r, taken, "r")
        if _text(free_l).isEmpty() or _text(free_r).isEmpty():
            break  # nobody is left to match
        found, rank = edges(phase, free_l, free_r, settings, bool(judge))
        kind = "content" if phase == "3b" else "deterministic"
        if judge is None:
            got = resolve.greedy(accepted(phase, found, settings), rank, group=GROUPED.get(phase)).select("l_ord", "r_ord", F.lit(phase).alias("phase"), F.lit(kind).alias("match_type"), F.col("sim").alias("similarity"))
        else:
            nul = lambda f, s: f.select(F.col("ord").alias(f"{s}_ord"), (F.instr("text", "\0") > 0).alias(f"{s}_nul"))
            found = found.join(nul(l, "l"), "l_ord").join(nul(r, "r"), "r_ord").withColumn("nul", F.col("l_nul") | F.col("r_nul"))
            rows, gate = resolve.with_arbiter(found, phase, rank, judge, settings, gate)
            got = resolve.frame(spark, [x | {"phase": phase, "similarity": float(x["sim"])} for x in rows], TAKEN)
        taken = cut(taken.unionByName(got))
    matches = cut(candidates.status(taken, l, r).select("l_ord", "r_ord", "phase", "match_type", "similarity", "content_status", "binary"))
    return Comparison(left, right, matches, gate.calls if gate else 0, request or {"settings": asdict(settings)})


def compare_folders(spark: SparkSession, body: dict, judge: Callable[[dict], int | None] | None = None, ignore_case: bool = False) -> Comparison:
    """Scan and match the two folders of a request."""
    asked = Request.of(body)
    left, right = (scan(spark, getattr(asked, s), s, asked.exclusions, getattr(asked.charsets, s), ignore_case) for s in ("left", "right"))
    return compare(left, right, asked.settings, judge, {k: v for k, v in asdict(asked).items() if k not in ("left", "right")})
