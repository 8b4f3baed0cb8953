"""All registered market queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import chain, folds, regression, selection
from .plans import gauntlet, research, spreads
from .plans.gauntlet import GAUNTLET
from .plans.inference import INFERENCE
from .plans.research import RESEARCH
from .plans.roster import ROSTER
from .plans.sessions import SESSIONS
from .plans.spreads import SPREADS
from .plans.views import compose, duck, spark as spark_text
from .sinks import lake
from .sources.tables import query
from .streaming import keyed, windows


BODIES = ROSTER | RESEARCH | INFERENCE | SPREADS | GAUNTLET | SESSIONS
#: What Spark runs in another form than the SQL has, by query: views, and the statement itself as "body"
SPARK_VIEWS = gauntlet.SPARK_VIEWS | research.SPARK_VIEWS | spreads.SPARK_VIEWS


def _text(name: str, instead: dict[str, str] | None = None) -> str:
    body, extra = BODIES[name] if isinstance(BODIES[name], tuple) else (BODIES[name], None)
    views = (extra or {}) | (instead or {})
    return compose(views.pop("body", body), views)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = spark_text(_text(name, SPARK_VIEWS.get(name)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir, text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in BODIES} | folds.QUERIES | selection.QUERIES | chain.QUERIES | lake.QUERIES | regression.QUERIES | windows.QUERIES | keyed.QUERIES
ORACLE_SQL: dict[str, str] = {name: duck(_text(name)) for name in BODIES} | folds.ORACLE_SQL | chain.ORACLE_SQL | lake.ORACLE_SQL | windows.ORACLE_SQL | keyed.ORACLE_SQL
