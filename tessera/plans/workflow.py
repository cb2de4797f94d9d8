"""From source files to modernized files, scored: analyze, plan, rewrite, guard, verify, and again, or to the fixer, what
needs it."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fenced_code, plausible_code
from tessera.operators import guard
from tessera.operators.extract import extract, unnest
from tessera.operators.graph import last_records
from tessera.operators.patterns import error_context
from tessera.operators.rules import apply_rules
from tessera.plans.answers import Answers, prompt_key
from tessera.plans.plan import ANALYZED, analyzer_findings, plan, rating, route, score
from tessera.sources.files import dealt
from tessera.sources.scratch import Run, Scratch

#: A function of a text, or of a text and its plan (a line for each transformation).
Rewriter = Callable[..., str]
#: A function of a text, the compiler's output for it and the lines about its errors.
Fixer = Callable[[str, str, str], str]
#: (file_id, text) to (file_id, success, error_log).
Verify = Callable[[DataFrame], DataFrame]


def _call(f: Callable[..., str], *args: str, tries: int = 3) -> str | None:
    for k in range(tries):
        try:
            return f(*args)
        except Exception:  # whatever a model bridge raises
            time.sleep(0.1 * 2**k)
    return None


def ask(rows: DataFrame, f: Callable[..., str], *columns: str, role: str = "", answers: Answers | None = None) -> DataFrame:
    """rows with `answer`, by a function of those columns that is called once for each distinct set of them; null where
    it fails. With answers, which are kept, only what none is known for is asked."""

    def run(batches):
        for b in batches:
            args = zip(*(b.column(c).to_pylist() for c in columns))
            yield pa.record_batch([b.column("key"), pa.array([_call(f, *(x or "" for x in a)) for a in args], pa.string())], ["key", "answer"])

    keyed = rows.withColumn("key", prompt_key(role, *columns))
    prompts = keyed.select("key", *columns)
    said = answers.ask(prompts, partial(_call, f)) if answers else prompts.dropDuplicates(["key"]).mapInArrow(run, "key string, answer string")
    return keyed.join(said, "key").drop("key")


def rewrite(files: DataFrame, rewriter: Rewriter, answers: Answers | None = None) -> DataFrame:
    """file_id, text by a function of a text (and of the column `plan`, if there is one): the code of its answer. A failure
    or a blank answer keeps the text."""
    args = ("text", "plan") if "plan" in files.columns else ("text",)
    code = fenced_code(F.col("answer"))
    return ask(files.select("file_id", *args), rewriter, *args, role="modernizer", answers=answers).select("file_id", F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(F.col("text")).alias("text"))


def lite(files: DataFrame, rewriter: Rewriter | None = None, answers: Answers | None = None) -> DataFrame:
    """Rewriting alone: rules, the rewriter, and rules again. file_id, text, applied (by the last rules), normalized
    (whether the first rules changed it) and enforced (whether the last ones did)."""
    first = apply_rules(files)
    if rewriter is None:
        return first.select("file_id", "text", "applied", F.col("changed").alias("normalized"), F.lit(False).alias("enforced"))
    first = Scratch(files.sparkSession, "rewrite").write(first.join(files.select("file_id", "plan"), "file_id") if "plan" in files.columns else first, "rules")
    return _enforced(first, first.count(), rewriter, answers)


def _enforced(first: DataFrame, n: int, rewriter: Rewriter, answers: Answers | None) -> DataFrame:
    """What the rewriter makes of about n files that went through the rules, and the rules of that."""
    # Joins leave as many tasks as there are bytes; rules take their time by the text.
    last = apply_rules(dealt(rewrite(first, rewriter, answers), n)).withColumnRenamed("changed", "enforced")
    return last.join(first.select("file_id", F.col("changed").alias("normalized")), "file_id")


def fix(broken: DataFrame, fixer: Fixer, verify: Verify, answers: Answers | None = None) -> DataFrame:
    """file_id, text: of (file_id, text, error_log), by a fixer that sees the errors and the lines about them. Its answer is
    taken if it looks like code and compiles; else the text stays."""
    scratch = Scratch(broken.sparkSession, "fix")
    lines = error_context(broken.select("file_id", F.col("error_log").alias("error_text")), broken.select("file_id", "text"))
    about = lines.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("error_line", "line", "text"))), lambda x: F.format_string("%d: %s", x.line, x.text)), "\n").alias("about"))
    asked = ask(broken.select("file_id", "text", "error_log").join(about, "file_id", "left"), fixer, "text", "error_log", "about", role="fixer", answers=answers)
    said = scratch.write(asked.select("file_id", "text", fenced_code(F.col("answer")).alias("answer")), "answers")
    good = verify(said.where(plausible_code(F.col("answer"))).select("file_id", F.col("answer").alias("text"))).where("success").select("file_id", F.lit(True).alias("ok"))
    return said.join(good, "file_id", "left").select("file_id", F.when(F.col("ok"), F.col("answer")).otherwise(F.col("text")).alias("text"))


def _plan_lines(plans: DataFrame) -> DataFrame:
    return plans.select("file_id", F.array_join(F.transform("transformations", lambda t: F.concat(F.lit("- "), t.type, F.lit(": "), t.description)), "\n").alias("plan"))


def _about(files: DataFrame, max_attempts: int, planned: bool, *functions) -> dict:
    """What a run that goes on must have in common with the one before."""
    n, digest = files.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("file_id", "text")), F.lit(0))).first()
    return {"files": n, "digest": digest, "max_attempts": max_attempts, "planned": planned, "functions": [f is not None for f in functions]}


def _ruled(files: DataFrame, plans: DataFrame | None, n: int) -> DataFrame:
    """file_id, text, changed (and plan) of about n files after the rules, which make the same of a file in every round."""
    first = apply_rules(dealt(files, n)).select("file_id", "text", "changed")
    return first if plans is None else first.join(_plan_lines(plans), "file_id")


def _round(anew: DataFrame, broken: DataFrame | None, rewriter, fixer, verify, answers: Answers | None, n: int) -> DataFrame:
    """file_id, text, normalized, enforced: what is written anew, of about n files that went through the rules, and what is
    repaired."""
    if rewriter:
        new = _enforced(anew, n, rewriter, answers).select("file_id", "text", "normalized", "enforced")
    else:
        new = anew.select("file_id", "text", F.col("changed").alias("normalized"), F.lit(False).alias("enforced"))
    if broken is None:
        return new
    return new.unionByName(fix(broken, fixer, verify, answers).join(broken.select("file_id", "normalized", "enforced"), "file_id"))


def _again(new: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """new with `again`: whether the text is that of the round before, which was read then."""
    if earlier is None:
        return new.withColumn("again", F.lit(False))
    was = earlier.select("file_id", F.sha2("new_text", 256).alias("was"))
    return new.join(was, "file_id", "left").withColumn("again", F.coalesce(F.sha2("text", 256) == F.col("was"), F.lit(False))).drop("was")


def modernize(files: DataFrame, rewriter: Rewriter | None = None, verify: Verify | None = None, max_attempts: int = 3, fixer: Fixer | None = None, planned: bool = False, answers: Answers | None = None, run: str | None = None, rounds: int | None = None) -> DataFrame:
    """file_id, text, new_text, n_findings, function_count, risk_score, normalized, enforced, n_issues, issues, semantic_ok,
    success, error_log, attempts, score, rating.

    verify takes (file_id, text) and gives (file_id, success, error_log); without it every file succeeds. With planned the
    rewriter gets the plan of its file too. After each attempt the router tells where a file goes: it is done, or the
    fixer repairs what didn't compile (without a fixer that is written anew), or it is planned, and rewritten from the
    original, again. Each round is written once and read from there: a text is rewritten, read and compiled once a round.

    With run, a folder that the cluster shares, each round is committed there, and a call with the same files and options goes
    on behind the last whole round, in any session; rounds then tells how many new ones this call may add, and files that
    aren't done by then are not in its result. With answers, what the rewriter and the fixer say is kept as it comes, so that a
    round that was broken off doesn't ask again.
    """
    files = files.select("file_id", "text")
    scratch = Run(files.sparkSession, run, _about(files, max_attempts, planned, rewriter, fixer, verify)) if run else Scratch(files.sparkSession, "modernize")
    if rounds is not None and (not run or rounds < 1):
        raise ValueError("rounds are one or more of those of a run")
    parsed = scratch.write(extract(files, only=(*ANALYZED, *guard.COMPARED)), "parsed")
    before = scratch.write(last_records(unnest(parsed, "functions")).drop("first_pos", "id_collision"), "before")
    count = before.groupBy("file_id").agg(F.countDistinct("unique_fqn").alias("function_count"))
    found = analyzer_findings(files, before, unnest(parsed, "types"))
    plans = scratch.write(plan(found, files).join(count, "file_id", "left").na.fill(0, ["function_count"]), "plans")
    # Files to be read: all, then those that aren't done.
    total = left = plans.count()
    earlier, broken, done, added = None, None, None, 0
    for attempt in range(1, max_attempts + 1):
        if run and not scratch.has(f"round{attempt}"):
            if added == rounds:
                break
            added += 1
        if run and scratch.has(f"new{attempt}"):
            new = scratch.read(f"new{attempt}")
            new = new if "again" in new.columns else new.withColumn("again", F.lit(False))
        else:
            ruled = scratch.write(_ruled(files, plans if planned and rewriter else None, total), "rules") if attempt == 1 or run else ruled
            anew = ruled if earlier is None else ruled.join(earlier.where("not fixing").select("file_id"), "file_id", "left_semi")
            new = scratch.write(_again(_round(anew, broken, rewriter, fixer, verify, answers, left), earlier), f"new{attempt}")
        # The reading of a text that is as it was is as it was.
        other = new.where("not again")
        after = unnest(scratch.write(extract(dealt(other, left), only=guard.COMPARED), f"read{attempt}"), "functions")
        known = before if earlier is None else before.join(other.select("file_id"), "file_id", "left_semi")
        found = scratch.write(guard.issues(known, after, other), f"issues{attempt}")
        issues = found.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("category", "message", "severity"))).alias("issues"))
        s = guard.summary(found, other).select("file_id", "n_issues", "semantic_ok").join(issues, "file_id", "left")
        if earlier is not None:
            s = s.unionByName(earlier.join(new.where("again").select("file_id"), "file_id", "left_semi").select(*s.columns))
        new = new.drop("again")
        v = verify(new.select("file_id", "text")) if verify else new.select("file_id", F.lit(True).alias("success"), F.lit("").alias("error_log"))
        r = new.withColumnRenamed("text", "new_text").join(s, "file_id").join(v, "file_id").withColumn("attempts", F.lit(attempt))
        r = scratch.write(r.withColumn("next", route(F.col("success"), F.col("semantic_ok"), F.lit(attempt), F.lit(max_attempts), F.col("error_log"))), f"round{attempt}")
        ended = r.where("next = 'end'")
        done = ended if done is None else done.unionByName(ended)
        to_fixer = (F.col("next") == "fixer") & F.lit(fixer is not None and verify is not None)
        counts = r.agg(F.count_if(to_fixer).alias("broken"), F.count_if((F.col("next") != "end") & ~to_fixer).alias("anew")).first()
        if not counts.broken and not counts.anew:
            break
        left = counts.broken + counts.anew
        earlier = r.where("next != 'end'").withColumn("fixing", to_fixer)
        broken = earlier.where("fixing").select("file_id", F.col("new_text").alias("text"), "error_log", "normalized", "enforced") if counts.broken else None
    out = files.join(plans.select("file_id", "n_findings", "function_count", "risk_score"), "file_id").join(done, "file_id")
    s = F.round(score(F.col("n_findings"), F.col("success"), F.col("semantic_ok")), 6)
    return out.select("file_id", "text", "new_text", "n_findings", "function_count", "risk_score", "normalized", "enforced", "n_issues", "issues", "semantic_ok", "success", "error_log", "attempts", s.alias("score"), rating(s).alias("rating"))
