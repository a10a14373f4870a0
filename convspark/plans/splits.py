"""Train/test split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split as SP
from ..sources.tables import turns
from .registry import register

_SPLIT_CTE = """
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT count(*) AS n FROM ids),
r AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || CAST(conv_id AS VARCHAR))) AS rk FROM ids),
sp AS (SELECT conv_id, CASE WHEN rk <= CAST(floor(CAST(n AS DOUBLE) * (1.0::DOUBLE - (1.0::DOUBLE - 0.9::DOUBLE))) AS BIGINT)
                         THEN 'train' ELSE 'test' END AS split FROM r, n)
"""


@register("train_test_split", f"WITH {_SPLIT_CTE} SELECT conv_id, split FROM sp")
def train_test_split(spark, sf_dir):
    return SP.split_ids(turns(spark, sf_dir).select("conv_id"))


_CHECK_SQL = f"""WITH {_SPLIT_CTE}
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
       (SELECT count(*) FROM (SELECT conv_id FROM sp WHERE split = 'train'
                              INTERSECT SELECT conv_id FROM sp WHERE split = 'test')) AS n_overlap,
       (SELECT count(*) FROM (SELECT conv_id FROM ids EXCEPT SELECT conv_id FROM sp)) AS n_missing
FROM sp"""


@register("split_check", _CHECK_SQL)
def split_check(spark, sf_dir):
    t = turns(spark, sf_dir)
    return SP.split_check(t.select("conv_id"), SP.split_ids(t.select("conv_id")))


_TURNS_SQL = f"""WITH {_SPLIT_CTE}
SELECT s.split, count(DISTINCT c.conv_id) AS n_conversations, count(*) AS n_turns
FROM conversations c JOIN sp s ON s.conv_id = c.conv_id GROUP BY s.split"""


@register("split_turns", _TURNS_SQL)
def split_turns(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.join(SP.split_ids(t.select("conv_id")), "conv_id").groupBy("split").agg(
        F.countDistinct("conv_id").alias("n_conversations"), F.count(F.lit(1)).alias("n_turns"))
