"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from ledgernet.functions.stats import (  # noqa: F401
    STATS, six_stat_aggs, entropy_expr, stats_from_parts, zero_if_null,
)
from ledgernet.functions.draws import uniform, uniform_sql  # noqa: F401
from ledgernet.functions.scalars import (  # noqa: F401
    log_bucket, int_log_bucket, epoch_seconds, split_exp_id,
)
