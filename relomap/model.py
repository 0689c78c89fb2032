"""Options and schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DELETE, INSERT = "delete", "insert"
POLICIES = ("leaf_only", "top_level_only", "all_regions")
GROUP_KINDS = ("move_1_to_1", "moves_many", "delete_only", "insert_only", "copy_or_repeat", "ambiguous")

NODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("node_idx", T.LongType()),
        T.StructField("unit_no", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("xpath", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class CanonicalOptions:
    ignore_outer_diff_wrapper: bool = True
    ignore_diff_ws: bool = True
    ignore_whitespace_only_text: bool = True


@dataclass(frozen=True)
class FilterOptions:
    policy: str = "leaf_only"
    drop_whitespace_only: bool = True
    skip_pre_marked: bool = False
    #: Least UTF-8 bytes of the raw text, before any trimming.
    min_bytes: int = 2

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}, not {self.policy!r}")


@dataclass(frozen=True)
class OutputOptions:
    #: Namespace that the written document declares for the move attributes.
    namespace: str = "urn:relomap:moves"
    prefix: str = "mv"
    #: Keep the root step in the paths of units of an archive.
    rooted_archive_paths: bool = False
