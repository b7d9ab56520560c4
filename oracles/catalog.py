"""All oracle statements by query name."""

from oracles.models import model_sql
from oracles.portfolio import portfolio_sql
from oracles.quality import quality_sql
from oracles.stages import stage_sql


def all_sql() -> dict[str, str]:
    return {**portfolio_sql(), **quality_sql(), **model_sql(),
            **stage_sql()}
