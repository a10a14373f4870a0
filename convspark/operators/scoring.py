"""Judge scoring (J1, U-1..U-3, X11, X8, A1-A3, A11).

conversations x metric templates -> rendered prompts -> any user-supplied
model (run by ``mapInPandas``, built once per task) -> parsed scores ->
per-metric / per-experiment means.  Prompt text never crosses a shuffle:
it is rendered after the (broadcast, 6-row) template join and dropped once
the score is parsed; only ``(conversation, metric, score)`` is aggregated.
"""

from __future__ import annotations

from typing import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import JUDGE_METRICS, SKIPPED_TEMPLATES
from ..functions.scores import parse_score
from ..session import bound_batches, default_partitions

SLOT = "{conversation}"

# Default metric templates: the metric names are fixed, the wording is ours.
# Users drop their own ``<metric>.txt`` files into a folder instead (U-5, S6).
DEFAULT_TEMPLATES = {
    m: ("You are rating a counseling session between a therapist and a client.\n"
        f"Criterion: {m.replace('_', ' ')}.\n"
        "Transcript:\n{conversation}\n"
        "Answer with a score from 0 to 6, a comma, and a one-line reason.")
    for m in JUDGE_METRICS
}


def template_pieces(template: str) -> list[str]:
    """X11 on the driver-free side: the template split at its slots, with
    ``{{``/``}}`` unescaped as ``str.format`` would, so the conversation text
    itself is inserted literally."""
    return [p.replace("{{", "{").replace("}}", "}") for p in template.split(SLOT)]


def templates_frame(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """Metric template table ``(metric, template, pieces)`` from a dict (sorted by metric)."""
    templates = templates or DEFAULT_TEMPLATES
    rows = [(m, t, template_pieces(t)) for m, t in sorted(templates.items())]
    return spark.createDataFrame(rows, "metric string, template string, pieces array<string>")


def load_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.txt`` in ``folder`` (PANAS files skipped), metric = file stem."""
    raw = (spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
           .select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("template")))
    raw = raw.filter(~F.col("name").isin(*SKIPPED_TEMPLATES))
    pieces = F.transform(F.split("template", "\\{conversation\\}", -1),
                         lambda p: F.replace(F.replace(p, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")))
    return raw.select(F.regexp_replace("name", "\\.[^.]*$", "").alias("metric"), "template",
                      pieces.alias("pieces"))


#: Templates up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


def render_prompts(docs: DataFrame, templates: DataFrame, text_col: str = "transcript",
                   partitions: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """J1 + X11: every document x every template.

    The templates are measured first.  Up to ``broadcast_bytes`` they are broadcast (nested loop).  Beyond,
    they are cut into chunks of half that size, and each chunk meets the documents in cells, a chunk
    against a share of the documents, by an equi-join.

    ``partitions`` round-robins the documents first, so the model calls that
    follow run on that many tasks; documents are 1/len(templates) of the
    prompt bytes, so this is the cheapest place to spread the work."""
    if partitions:
        docs = docs.repartition(partitions)
    t = templates.select("metric", "pieces")
    weight = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p))
    total = t.agg(F.sum(weight)).first()[0] or 0
    prompt = F.expr(f"array_join(pieces, `{text_col}`)")
    if total <= broadcast_bytes:
        return docs.crossJoin(F.broadcast(t)).withColumn("prompt", prompt).drop("pieces")
    chunks = -(-2 * total // broadcast_bytes)
    shares = default_partitions(docs.sparkSession)
    t = t.withColumn("_chunk", F.pmod(F.xxhash64("metric"), F.lit(chunks)))
    t = t.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    d = docs.withColumn("_share", F.pmod(F.xxhash64(text_col), F.lit(shares)))
    d = d.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    return d.hint("shuffle_merge").join(t, ["_chunk", "_share"]).withColumn("prompt", prompt).select(*docs.columns, "metric", "prompt")


ModelFactory = Callable[[], Callable[[str], str]]

#: Most bytes of an Arrow batch of prompts.
BATCH_BYTES = 8 << 20


def run_model(df: DataFrame, prompt_col: str, factory: ModelFactory, out: str = "reply",
              partitions: int | None = None, checkpoint: bool = False, drop: Sequence[str] = ()) -> DataFrame:
    """U-1/U-2/U-3: apply a user model to every prompt, in parallel.

    ``factory()`` is called once per task (model load reused across prompts);
    the returned callable maps one prompt to one string.  A failing call yields
    ``''`` and the error text in ``<out>_error`` (the evaluation keeps going).
    ``partitions`` spreads prompts by count: model latency, not bytes, dominates.
    ``checkpoint=True`` writes the replies once to the shared checkpoint folder
    (reliable ``checkpoint``): a sampling model is not deterministic, so a lost
    executor must not make Spark call it again for rows already scored.
    ``drop`` names columns that nobody reads afterwards: Python gets the prompt alone of them and
    returns none, so a worker holds one batch's prompts and no second copy of the texts.
    The session's Arrow batches are held to ``BATCH_BYTES``: a batch of prompts is its bytes several times over.
    """
    bound_batches(df.sparkSession, BATCH_BYTES)
    if partitions:
        df = df.repartition(partitions)
    df = df.drop(*[c for c in drop if c != prompt_col])
    kept = [c for c in df.columns if c not in drop]
    schema = T.StructType([df.schema[c] for c in kept]
                          + [T.StructField(out, T.StringType()),
                             T.StructField(f"{out}_error", T.StringType())])

    def apply(batches: Iterable):
        model = factory()
        for pdf in batches:
            replies, errors = [], []
            for p in pdf[prompt_col]:
                try:
                    r = model(p)
                    replies.append("" if r is None else str(r))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any model failure is recorded
                    replies.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            pdf = pdf[kept].assign(**{out: replies, f"{out}_error": errors})
            yield pdf

    replies = df.mapInPandas(apply, schema)
    if checkpoint:
        from ..session import cut_lineage
        replies = cut_lineage(replies)
    return replies


def word_count_judge() -> Callable[[str], str]:
    """Deterministic stand-in judge: score = whitespace words of the prompt mod 7."""
    def judge(prompt: str) -> str:
        n = len(prompt.split())
        return f"{n % 7}, words={n}"
    return judge


def score_replies(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """X8 on every reply: adds ``score`` DOUBLE and ``explanation``."""
    p = parse_score(reply_col)
    return df.withColumn("score", p["score"]).withColumn("explanation", p["explanation"])


def materialized(scores: DataFrame) -> DataFrame:
    """Scores written once to the checkpoint folder, for readers that would otherwise run the model again."""
    from ..session import cut_lineage
    return cut_lineage(scores)


def metric_means(scores: DataFrame, key: str = "conv_id") -> DataFrame:
    """A1 + A3: mean score per metric (unparsed ignored; null when none parsed),
    number of conversations evaluated and number of parsed scores.

    Two aggregates read the scores, so they are materialized first: one model call per prompt."""
    scores = materialized(scores.select(key, "metric", "score"))
    n_conv = scores.agg(F.countDistinct(key).alias("n_conversations"))
    per = scores.groupBy("metric").agg(F.avg("score").alias("avg_score"),
                                      F.count("score").alias("n_scored"))
    return per.crossJoin(n_conv)


def scores_by_conversation(scores: DataFrame, key: str = "conv_id") -> DataFrame:
    """A2/K3 shape: one row per conversation, ``scores`` MAP<metric, STRUCT<score, explanation, raw>>."""
    entry = F.struct("metric", F.struct("score", "explanation", F.col("reply").alias("raw")).alias("v"))
    return scores.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("scores"))


def experiment_rollup(scores: DataFrame, experiment: str = "experiment") -> DataFrame:
    """Mean per (experiment, metric) with experiment subtotals and a grand total."""
    return scores.rollup(experiment, "metric").agg(F.avg("score").alias("avg_score"),
                                                  F.count("score").alias("n_scores"))


def experiment_pivot(scores: DataFrame, metrics: list[str] | None = None,
                     experiment: str = "experiment") -> DataFrame:
    """A11 comparison table: one row per experiment, one column per metric."""
    return scores.groupBy(experiment).pivot("metric", metrics or JUDGE_METRICS).avg("score")
