"""A whole scan as tables: what is known before the model is asked, and what follows from answers.

``prepare`` selects files and builds the requests; ``finish`` turns the answers into findings, risk
and report tables. Calling the model in between is left to the user.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import project
from tracewell.operators.facts import KEYS
from tracewell.operators.sizing import only_wanted, written
from tracewell.plans import report, requests, responses
from tracewell.sources import corpus, manifests
from tracewell.streaming import state as state_of
from tracewell.streaming.state import ScanState


@dataclass(frozen=True)
class Prepared:
    selected: DataFrame
    files: DataFrame
    cross_calls: DataFrame
    file_requests: DataFrame
    pattern_requests: DataFrame
    saved: DataFrame | None = None


@dataclass(frozen=True)
class Finished:
    findings: DataFrame
    recommendations: DataFrame | None
    summary: DataFrame


def select_files(files: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``project_id, path, ord``: the files worth a deep scan.

    A project with enough scored files takes its best ones. Otherwise the model's list is used
    with the scored files after it, else the scored files, else the name-based fallback. Scores are
    written because every branch reads them and reading file heads is the costly part.
    """
    scores = written(project.file_scores(project.file_metadata(files)), "scores")
    best = project.top_files(scores).select(*KEYS, F.col("rank").alias("ord"))
    done = best.select("project_id").distinct()
    parts = [best]
    if answers is not None:
        chosen = responses.parse_selection(answers).join(done, "project_id", "left_anti")
        asked = chosen.select("project_id").distinct()
        extra = scores.join(asked, "project_id", "left_semi")
        parts.append(project.append_missing(chosen, extra))
        done = _projects(done, asked)
    scored = project.fallback_files(scores.join(done, "project_id", "left_anti")) \
        .select(*KEYS, F.col("rank").alias("ord"))
    parts.append(scored)
    done = _projects(done, scores.select("project_id"))
    rest = project.fallback_scores(files.drop("content")).join(done, "project_id", "left_anti")
    parts.append(project.fallback_files(rest).select(*KEYS, F.col("rank").alias("ord")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _projects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Projects in either list. The exchange is stated: joined as it is, a union of equally dealt parts
    can count on a number of partitions that adaptive execution has changed."""
    return a.unionByName(b).distinct().repartition("project_id")


def _listed(files: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed files; content of others does not move."""
    keys = listed.select(*KEYS)
    return only_wanted(files, keys, KEYS).join(keys, KEYS, "left_semi")


def prepare(files: DataFrame, root_files: DataFrame, patterns: DataFrame | None = None,
            answers: DataFrame | None = None, scan_all: bool = True,
            pattern_files: int | None = None, state: ScanState | None = None, rules_version: str = "") -> Prepared:
    """Select files and build the requests of the deep scan.

    ``patterns`` are project patterns parsed from earlier pattern responses. All files are scanned
    unless ``scan_all`` is off; ``pattern_files`` asks for patterns of so many files per project. With
    ``state`` (``files`` then has ``mtime``) only files without saved results of ``rules_version`` give requests;
    the findings of the others are ``saved``.
    """
    if scan_all:
        selected = files.select(*KEYS, F.lit(None).cast("int").alias("ord"))
        first = selected if pattern_files is None else corpus.first_files(selected, pattern_files)
        scanned = files
    else:
        selected = written(select_files(files, answers), "selected")
        first = selected if pattern_files is None else selected.where(F.col("ord") <= pattern_files)
        scanned = _listed(files, selected)
    scanned = corpus.scannable(scanned)
    sampled = scanned if pattern_files is None and scan_all else _listed(scanned, first)
    asked, known = scanned, None
    if state is not None:
        asked, known = unsaved(scanned, state.read("file_scans"), rules_version)
    return Prepared(
        selected=selected, files=asked, saved=known,
        cross_calls=project.first_cross_calls(project.cross_file_calls(scanned)),
        file_requests=requests.file_requests(
            asked, manifests.project_context(root_files), patterns),
        pattern_requests=requests.pattern_requests(sampled))


SAVED = ("array<struct<line:int,vulnerability_type:string,description:string,severity:string,confidence:double,"
         "code_snippet:string,cwe_id:string,data_flow:array<string>,remediation:string>>")


def unsaved(files: DataFrame, scans: DataFrame, rules_version: str) -> tuple[DataFrame, DataFrame]:
    """Files to scan, with their content, and the findings that are saved for all others.

    A bitmap of the files without results decides for both sides: a file that it holds by chance is scanned
    again and its saved findings stay out, so each file counts once, and no content moves.
    """
    todo = written(state_of.to_scan(files, scans, rules_version).select(*KEYS), "todo")
    rows = only_wanted(state_of.reused(files, scans, rules_version).select(*KEYS, "vulnerabilities"), todo, KEYS, keep=False)
    found = rows.select("project_id", F.col("path").alias("file"), F.explode(F.from_json("vulnerabilities", SAVED)).alias("f"))
    return only_wanted(files, todo, KEYS), found.select("project_id", "file", "f.*")


def save(state: ScanState, scanned: DataFrame, findings: DataFrame, now: float, rules_version: str) -> None:
    """Saves what the answers on ``scanned`` files gave, findings above no threshold left out."""
    state.save_file_results(scanned, findings, now, rules_version)


def finish(selected: DataFrame, file_answers: DataFrame, cross_answers: DataFrame | None = None,
           advice: DataFrame | None = None,
           threshold: float = report.CONFIDENCE_THRESHOLD, saved: DataFrame | None = None) -> Finished:
    """Findings above the confidence threshold, recommendations and one summary per project.

    ``saved`` are findings of files that were not asked about again.
    """
    found = responses.parse_findings(file_answers).drop("parse_path", "finding_ord")
    if saved is not None:
        found = found.unionByName(saved, allowMissingColumns=True)
    if cross_answers is not None:
        found = report.union_findings(
            found, responses.parse_cross_findings(cross_answers).drop("finding_ord"))
    kept = report.confident(found, threshold)
    recommended = None if advice is None else responses.parse_recommendations(
        advice, report.affected_files(kept))
    return Finished(findings=kept, recommendations=recommended,
                    summary=report.summary(kept, selected, recommended))
