"""Patient-prompt queries over customer x nation as profile rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..constants import (COGNITIVE_MODEL_FIELDS, PROFILE_BLANK_EXACT, PROFILE_BLANK_SUBSTR,
                         PROFILE_FIELDS, PROFILE_TAIL_FIELDS)
from ..functions.prompts import _SLOT
from ..operators import profiles as PR
from ..sources.tables import table
from ..session import spread
from .registry import register
from .sqlbits import in_list, q, strip, words

NL = "chr(10)"
_SEV = ["mild", "moderate", "severe", "Moderately severe", "none"]
_SYMPTOMS = ["Anxiety", "Insomnia", "Fatigue"]


def profile_rows(spark, sf_dir):
    """R5-shaped profile rows derived from customer (J2: nation looked up by key)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = spread(c).join(n, c.c_nationkey == n.n_nationkey, "left")
    k = F.col("c_custkey")
    sev = F.array(*[F.lit(s) for s in _SEV])

    def sev_of(i):
        return F.try_element_at(sev, ((k + i) % 5 + 1).cast("int"))

    profile = F.struct(
        F.col("c_name").alias("name"), (F.lit(20) + k % 50).cast("string").alias("age"),
        F.when(k % 3 == 0, "Female").when(k % 3 == 1, "Male").otherwise("Not specified").alias("gender"),
        F.col("c_mktsegment").alias("occupation"),
        F.try_element_at(F.array(*[F.lit(x) for x in ["Married", "Single", "Unknown", "N/A"]]),
                     (F.col("c_nationkey") % 4 + 1).cast("int")).alias("marital status"),
        F.concat(F.lit("Lives in "), F.coalesce("n_name", F.lit("nowhere"))).alias("situation of the client"),
        F.when(F.col("c_acctbal") > 5000, "Had CBT Before").otherwise("Cannot be determined")
        .alias("counseling history"),
        F.when(F.col("c_acctbal") < 0, "High").otherwise("low").alias("resistance toward the support"),
        F.create_map(*[x for i, s in enumerate(_SYMPTOMS) for x in (F.lit(s), sev_of(i))])
        .alias("symptom severity"),
        F.create_map(F.lit("Catastrophizing"), F.when(k % 2 == 0, "exhibited").otherwise("Not exhibited"),
                     F.lit("Labeling"), F.when(k % 5 == 0, "exhibited").otherwise("not exhibited"))
        .alias("cognition distortion exhibition"),
        F.when(k % 4 == 0, "Moderate").when(k % 4 == 1, "unknown").otherwise("Severe")
        .alias("depression severity"),
        F.when(k % 7 == 0, "N/A").otherwise("Low").alias("suicidal ideation severity"),
        F.when(k % 2 == 0, "Not mentioned").otherwise("none").alias("homicidal ideation severity"))
    models = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct(
        F.concat(F.lit("Situation "), i.cast("string"), F.lit(" for "), F.col("c_name")).alias("situation"),
        F.when(i == 1, "").otherwise("I will fail").alias("automatic_thoughts"),
        F.lit("sad").alias("emotion"),
        F.when(k % 2 == 0, "withdraws").otherwise("").alias("behavior")))
    cognitive = F.struct(
        F.concat(F.lit("Grew up in "), F.coalesce("n_name", F.lit("nowhere")), F.lit(" and works in "),
                 F.lower("c_mktsegment"), F.lit(".")).alias("life_history"),
        F.when(F.col("c_acctbal") < 1000, "I am helpless").otherwise("I am unlovable").alias("core_beliefs"),
        F.lit("").alias("core_belief_description"),
        F.lit("If I try, I will fail").alias("intermediate_beliefs"),
        F.lit("Nothing will change").alias("intermediate_beliefs_during_depression"),
        F.lit("Avoids people").alias("coping_strategies"), models.alias("cognitive_models"))
    return j.select(k.alias("profile_id"), profile.alias("profile"), cognitive.alias("cognitive profile"))


# ---------------------------------------------------------------- SQL twin of the fixture + rules

_SEV_SQL = "[" + ", ".join(q(s) for s in _SEV) + "]"
_FIX = f"""
fx AS (SELECT c.c_custkey AS profile_id, c.c_name AS name, CAST(20 + c.c_custkey % 50 AS VARCHAR) AS age,
         CASE c.c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Not specified' END AS gender,
         c.c_mktsegment AS occupation,
         ['Married', 'Single', 'Unknown', 'N/A'][c.c_nationkey % 4 + 1] AS marital,
         'Lives in ' || coalesce(n.n_name, 'nowhere') AS situation,
         CASE WHEN c.c_acctbal > 5000 THEN 'Had CBT Before' ELSE 'Cannot be determined' END AS history,
         CASE WHEN c.c_acctbal < 0 THEN 'High' ELSE 'low' END AS resistance,
         {_SEV_SQL}[(c.c_custkey + 0) % 5 + 1] AS s0, {_SEV_SQL}[(c.c_custkey + 1) % 5 + 1] AS s1,
         {_SEV_SQL}[(c.c_custkey + 2) % 5 + 1] AS s2,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'exhibited' ELSE 'Not exhibited' END AS d0,
         CASE WHEN c.c_custkey % 5 = 0 THEN 'exhibited' ELSE 'not exhibited' END AS d1,
         CASE c.c_custkey % 4 WHEN 0 THEN 'Moderate' WHEN 1 THEN 'unknown' ELSE 'Severe' END AS depression,
         CASE WHEN c.c_custkey % 7 = 0 THEN 'N/A' ELSE 'Low' END AS suicidal,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'Not mentioned' ELSE 'none' END AS homicidal,
         'Grew up in ' || coalesce(n.n_name, 'nowhere') || ' and works in ' || lower(c.c_mktsegment) || '.' AS life,
         CASE WHEN c.c_acctbal < 1000 THEN 'I am helpless' ELSE 'I am unlovable' END AS core,
         c.c_custkey % 3 AS n_models
       FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)
"""


def _valid(x):
    cond = " OR ".join([f"{x} IS NULL", f"lower({x}) IN {in_list(PROFILE_BLANK_EXACT)}"]
                       + [f"contains(lower({x}), {q(s)})" for s in PROFILE_BLANK_SUBSTR])
    return f"(CASE WHEN {cond} THEN '' ELSE {x} END)"


def _bullet(label, x):
    v = _valid(x)
    return f"(CASE WHEN {v} = '' THEN '' ELSE '- {label}: ' || {v} || {NL} END)"


_SRC = {"name": "name", "gender": "gender", "age": "age", "marital status": "marital",
        "occupation": "occupation", "situation of the client": "situation",
        "counseling history": "history", "resistance toward the support": "resistance",
        "depression severity": "depression", "suicidal ideation severity": "suicidal",
        "homicidal ideation severity": "homicidal"}


def _block_sql():
    parts = {}
    for key, slot, label, low in PROFILE_FIELDS:
        col = _SRC[key]
        parts[slot] = _bullet(label, f"lower({col})" if low else col)
    sym_items = " || ".join(
        f"(CASE WHEN contains(lower(s{i}), '{tag}') THEN '  - {s.lower()}: {tag}' || {NL} ELSE '' END)"
        for tag in ["severe", "moderate", "mild"] for i, s in enumerate(_SYMPTOMS))
    parts["symptom_severity"] = (f"(CASE WHEN ({sym_items}) = '' THEN '' ELSE '- symptom severity' || {NL} "
                                 f"|| ({sym_items}) END)")
    dist_items = " || ".join(
        f"(CASE WHEN NOT contains(lower({d}), 'not exhibited') THEN '  - {name}: exhibited' || {NL} ELSE '' END)"
        for d, name in [("d0", "catastrophizing"), ("d1", "labeling")])
    parts["cognition_distortion_exhibition"] = (
        f"(CASE WHEN ({dist_items}) = '' THEN '${{cognition_distortion_exhibition}}' "
        f"ELSE '- cognition distortion exhibition' || {NL} || ({dist_items}) END)")
    for key, slot, label in PROFILE_TAIL_FIELDS:
        parts[slot] = _bullet(label, _SRC[key])
    order = [s for _, s, _, _ in PROFILE_FIELDS] + ["symptom_severity", "cognition_distortion_exhibition"] \
        + [s for _, s, _ in PROFILE_TAIL_FIELDS]
    return " || ".join(parts[s] for s in order)


_PROFILE_CTE = f"{_FIX}, pf AS (SELECT *, '## PROFILE' || {NL} || {NL} || {_block_sql()} || {NL} AS patient_profile FROM fx)"


@register("profile_prompt", f"WITH {_PROFILE_CTE} SELECT profile_id, patient_profile FROM pf")
def profile_prompt(spark, sf_dir):
    return PR.patient_prompts(profile_rows(spark, sf_dir)).select("profile_id", "patient_profile")


def _models_sql():
    lines = []
    for f, label in COGNITIVE_MODEL_FIELDS:
        val = {"situation": "'Situation ' || CAST(k AS VARCHAR) || ' for ' || name",
               "automatic_thoughts": "CASE WHEN k = 1 THEN '' ELSE 'I will fail' END",
               "emotion": "'sad'",
               "behavior": "CASE WHEN profile_id % 2 = 0 THEN 'withdraws' ELSE '' END"}[f]
        lines.append(f"(CASE WHEN ({val}) = '' THEN '' ELSE '  - {label}: ' || ({val}) || {NL} END)")
    one = f"'Model ' || CAST(k + 1 AS VARCHAR) || ':' || {NL} || " + " || ".join(lines) + f" || {NL}"
    return f"array_to_string(list_transform(range(0, n_models + 1), lambda k: {one}), '')"


def _template_sql(template, values):
    out, pos = [], 0
    for m in _SLOT.finditer(template):
        out.append(q(template[pos:m.start()]))
        name = m.group(2) or m.group(3)
        out.append(values.get(name, q(m.group(0))))
        pos = m.end()
    out.append(q(template[pos:]))
    return " || ".join(out)


_PROMPT_SQL_EXPR = _template_sql(PR.PATIENT_TEMPLATE, {
    "psy_profile": "patient_profile", "history": "life", "core_belief": "core",
    "intermediate_belief": "'If I try, I will fail'",
    "intermediate_belief_depression": "'Nothing will change'",
    "coping_strategies": "'Avoids people'", "cognitive_models": _models_sql()})
_PROMPT_CTE = f"{_PROFILE_CTE}, pp AS (SELECT profile_id, {_PROMPT_SQL_EXPR} AS prompt FROM pf)"


@register("cognitive_block", f"WITH {_PROMPT_CTE} SELECT profile_id, prompt FROM pp")
def cognitive_block(spark, sf_dir):
    return PR.patient_prompts(profile_rows(spark, sf_dir)).select("profile_id", "prompt")


def backstory_writer():
    """Stand-in text generator (U-2): deterministic backstory from the history section."""
    def write(history: str) -> str:
        return f"Backstory of {len(history.split())} words. {history.strip()}"
    return write


_H0, _H1 = "Patient History:", "In the upcoming conversation"
_HRE = f"(?s){re.escape(_H0)}(.*?){re.escape(_H1)}"
_EXPAND_SQL = f"""WITH {_PROMPT_CTE},
h AS (SELECT profile_id, prompt, regexp_extract(prompt, {q(_HRE)}, 1) AS history FROM pp)
SELECT profile_id, {words('history')} AS history_words,
       substr(prompt, 1, strpos(prompt, {q(_H0)}) - 1) || {q(_H0)} || ' '
       || {strip(f"'Backstory of ' || CAST({words('history')} AS VARCHAR) || ' words. ' || {strip('history')}")}
       || {NL} || {NL} || {q(_H1)} || substr(prompt, strpos(prompt, {q(_H1)}) + {len(_H1)}) AS expanded
FROM h"""


@register("expand_history", _EXPAND_SQL)
def expand_history(spark, sf_dir):
    from ..functions.text import word_count
    p = PR.patient_prompts(profile_rows(spark, sf_dir))
    e = PR.expand_histories(p, backstory_writer)
    return e.select("profile_id", word_count("history").alias("history_words"), "expanded")
