"""All operators under one name: ``from cartlens import api``."""

from cartlens.functions.scalars import month, nan_to_null, ratio, table_name, whole_days
from cartlens.operators.charts import (
    bar_data,
    box_summary,
    combo_data,
    concentration_long,
    heatmap_cells,
    heatmap_pivot,
    histogram,
    ols_trend,
    pareto_flagged,
    quadrants,
    series_long,
    to_long,
    top_n_by,
    treemap_rollup,
)
from cartlens.operators.cleaning import (
    coerce_numbers,
    coerce_timestamps,
    drop_exact_duplicates,
    drop_incomplete,
    exact_duplicate_report,
    fill_constants,
    fill_medians,
    keep_first,
    keep_latest,
    normalize_geolocation,
    surrogate_key,
)
from cartlens.operators.customers import (
    compute_basket_size,
    compute_correlation,
    compute_geographic_summary,
    compute_market_opportunity,
    compute_payment_summary,
    compute_rating_summary,
)
from cartlens.operators.delivery import compute_delivery_metrics, compute_freight_ratio
from cartlens.operators.ordered import exact_quantiles, global_rank, ordered_scan
from cartlens.operators.quality import (
    foreign_key_check,
    orphan_rows,
    primary_key_check,
    profile,
    sanity_checks,
)
from cartlens.operators.revenue import (
    aggregate_by,
    compute_concentration_stats,
    compute_distribution_stats,
    compute_kpis,
    compute_pareto,
    compute_product_performance,
    compute_revenue_share,
    entity_values,
)
from cartlens.operators.scoring import compute_composite_score
from cartlens.operators.series import (
    compute_growth_rate,
    compute_monthly_revenue_rank,
    compute_monthly_series,
    compute_rolling_avg,
)
from cartlens.plans.flat import flat_order_items, flat_payments, flat_reviews, translate_categories
from cartlens.plans.users import get_users
from cartlens.plans.warehouse import build, read_raw
from cartlens.sources.csv_files import clean_table_name, read_all_csv, read_csv, write_csv_tables
from cartlens.sources.jdbc import jdbc_options, partition_options, read_jdbc, write_jdbc
from cartlens.sources.messages import parse_messages, send_to_kafka, to_messages, write_json_lines
from cartlens.sources.tables import database_has_data, load_all_csv, save_table, scan_limit
from cartlens.staging import release
from cartlens.streaming.json_events import stream_from_files, stream_from_kafka, write_available

__all__ = [name for name in dir() if not name.startswith("_")]
