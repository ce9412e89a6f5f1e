"""The names of the query language in one place."""

from kolonna.catalog import create, delete, describe, drop, get_partitions, get_tables, open_table, partitions, save, schema, tables
from kolonna.functions.aggregates import Aggregation, Fold, aggregate_expression, h_avg, h_cardinality, h_combine, h_count, h_max, h_min, h_minhash_merge, h_nlargest, h_nsmallest, h_sum, h_union
from kolonna.functions.columns import column_function, day, ip_aton, ip_ntoa, month, year
from kolonna.operators.small_files import compact_table
from kolonna.plans.query import Future, QueryResult, check_query, select
from kolonna.plans.stats import stat
from kolonna.printing import cat
from kolonna.settings import Settings
from kolonna.sources.decoders import csv_decoder, fixed_width_decoder, json_decoder, kv_decoder
from kolonna.sources.ingest import insert
from kolonna.table import Table, star

__all__ = [
    "Aggregation", "Fold", "Future", "QueryResult", "Settings", "Table", "aggregate_expression", "cat", "check_query", "column_function", "compact_table", "create", "csv_decoder", "day",
    "delete", "describe", "drop", "fixed_width_decoder", "get_partitions", "get_tables", "h_avg", "h_cardinality", "h_combine", "h_count", "h_max", "h_min", "h_minhash_merge", "h_nlargest", "h_nsmallest",
    "h_sum", "h_union", "insert", "ip_aton", "ip_ntoa", "json_decoder", "kv_decoder", "month", "open_table", "partitions", "save", "schema", "select", "star", "stat", "tables", "year",
]
