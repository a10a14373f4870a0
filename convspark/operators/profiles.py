"""Patient prompts from profile rows (S7 shape, F8, F9, X12-X16, J2, J5)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PROFILE_FIELDS, PROFILE_TAIL_FIELDS, PROFILE_TEMPLATE
from ..functions import prompts as P
from ..functions.text import py_strip
from .scoring import run_model

# Our own patient-instruction template: the slot names and the two anchors
# ('Patient History:' ... 'In the upcoming conversation') are what the
# operators rely on; callers pass their own template text.
PATIENT_TEMPLATE = (
    "You are the client in a therapy session. Who you are:\n${psy_profile}\n"
    "Patient History: ${history}\n\nHow you see yourself and others.\n"
    "- deep down you hold that: ${core_belief}\n- so you live by the rules: ${intermediate_belief}\n"
    "- on a low day these become: ${intermediate_belief_depression}\n"
    "- to get by you: ${coping_strategies}\n\n"
    "Moments that show it:\n${cognitive_models}\n\n"
    "In the upcoming conversation, answer in a sentence or two and never step out of the role."
)


def _field(profile: Column, key: str, lower: bool) -> Column:
    v = F.coalesce(profile[key], F.lit(""))
    return F.lower(v) if lower else v


def profile_prompt(profile: Column) -> Column:
    """The profile template filled from one ``profile`` struct (R5 shape)."""
    vals = {slot: P.bullet(label, _field(profile, key, low)) for key, slot, label, low in PROFILE_FIELDS}
    sym = profile["symptom severity"]
    symptoms = P.sub_list("symptom severity", [(P.keys_with(sym, "severe"), "severe"),
                                               (P.keys_with(sym, "moderate"), "moderate"),
                                               (P.keys_with(sym, "mild"), "mild")])
    vals["symptom_severity"] = F.coalesce(symptoms, F.lit(""))
    dist = P.keys_with(profile["cognition distortion exhibition"], "not exhibited", negate=True)
    # no distortions -> no value -> the slot stays in the text (Q13)
    vals["cognition_distortion_exhibition"] = P.sub_list("cognition distortion exhibition",
                                                         [(dist, "exhibited")])
    for key, slot, label in PROFILE_TAIL_FIELDS:
        vals[slot] = P.bullet(label, F.coalesce(profile[key], F.lit("")))
    return P.safe_substitute(PROFILE_TEMPLATE, vals)


def patient_prompts(profiles: DataFrame, template: str = PATIENT_TEMPLATE) -> DataFrame:
    """S7 rows (``profile_id``, ``profile`` struct, ``cognitive profile`` struct) ->
    ``profile_id, patient_profile, prompt``."""
    cog = F.col("`cognitive profile`")
    with_profile = profiles.withColumn("patient_profile", P.profile_section(profile_prompt(F.col("profile"))))
    vals = {"psy_profile": F.col("patient_profile"), "history": cog["life_history"],
            "core_belief": cog["core_beliefs"], "intermediate_belief": cog["intermediate_beliefs"],
            "intermediate_belief_depression": cog["intermediate_beliefs_during_depression"],
            "coping_strategies": cog["coping_strategies"],
            "cognitive_models": P.cognitive_models_block(cog["cognitive_models"])}
    return with_profile.select("profile_id", "patient_profile",
                               P.safe_substitute(template, vals).alias("prompt"))


def expand_histories(prompts: DataFrame, factory: Callable, partitions: int | None = None) -> DataFrame:
    """J5 + U-2: generate a backstory from each history section and splice it in."""
    h = prompts.withColumn("history", P.history_section("prompt"))
    if partitions is None:
        from ..session import spread
        h = spread(h, per_core=2)
    gen = run_model(h, "history", factory, out="backstory", partitions=partitions)
    return gen.withColumn("expanded", P.splice_history("prompt", py_strip("backstory")))
