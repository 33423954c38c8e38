"""Reading and writing: header CSV, dictionaries, parquet checkpoints, libsvm feature sets and metric reports."""

from cohortspark.sources.checkpoints import (
    checkpoint_or_reload,
    durable,
    published_counts,
    read_parquet,
    remove_old_runs,
    shared_folder,
    write_parquet_checkpoint,
)
from cohortspark.sources.tables import (
    infer_table_name,
    read_csv_table,
    read_dictionary_ids,
    read_dictionary_text,
    read_typed_csv,
)
from cohortspark.sources.vectors import (
    feature_set_path,
    read_feature_sets,
    read_libsvm,
    report_metrics,
    sweep_feature_sets,
    write_feature_sets,
    write_libsvm,
)

__all__ = [
    "checkpoint_or_reload",
    "durable",
    "feature_set_path",
    "infer_table_name",
    "published_counts",
    "read_csv_table",
    "read_dictionary_ids",
    "read_dictionary_text",
    "read_feature_sets",
    "read_libsvm",
    "read_parquet",
    "read_typed_csv",
    "remove_old_runs",
    "report_metrics",
    "shared_folder",
    "sweep_feature_sets",
    "write_feature_sets",
    "write_libsvm",
    "write_parquet_checkpoint",
]
