"""End to end: from diff documents to regions, candidates, groups, tags, annotated documents and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relomap.model import CanonicalOptions, FilterOptions, OutputOptions
from relomap.operators.annotate import annotated_xml, move_entries, plan_tags, summaries, summary_json
from relomap.operators.filters import filter_regions
from relomap.operators.groups import content_groups, group_counts
from relomap.operators.matching import greedy_pairs, unmatched
from relomap.operators.nesting import checked, regions
from relomap.operators.registry import number_candidates
from relomap.session import ship
from relomap.sources.xml import scan_nodes
from relomap.tables import written


@dataclass
class Moves:
    """The tables of one detection. Nodes, regions and candidates are written tables; what follows from them is lazy."""

    documents: DataFrame
    nodes: DataFrame
    regions: DataFrame
    candidates: DataFrame
    tags: DataFrame
    output: OutputOptions

    @property
    def entries(self) -> DataFrame:
        return move_entries(self.tags)

    @property
    def groups(self) -> DataFrame:
        return content_groups(self.candidates)

    @property
    def counts(self) -> DataFrame:
        return group_counts(self.candidates)

    @property
    def matches(self) -> DataFrame:
        return greedy_pairs(self.candidates)

    @property
    def unmatched(self) -> DataFrame:
        return unmatched(self.candidates, self.matches)

    @property
    def summaries(self) -> DataFrame:
        return summaries(self.regions, self.candidates, self.tags, self.documents)

    @property
    def json(self) -> DataFrame:
        return summary_json(self.summaries)

    @property
    def xml(self) -> DataFrame:
        return annotated_xml(self.nodes, self.tags, self.output)


def detect_moves(
    documents: DataFrame,
    filter_options: FilterOptions | None = None,
    canonical: CanonicalOptions | None = None,
    output: OutputOptions | None = None,
    across_documents: bool = False,
    strict: bool = False,
) -> Moves:
    """Detect moves in ``documents`` (``doc_id``, ``xml``).

    Contents are matched within each document, across its units; ``across_documents`` matches them over all documents.
    Documents that are not well formed have no regions; with ``strict`` any integrity error is raised.
    """
    spark = documents.sparkSession
    ship(spark)
    output = output or OutputOptions()
    # Both tables have several readers: they are written once, so that documents are parsed once.
    nodes = written(spark, scan_nodes(documents, output.rooted_archive_paths), "nodes")
    found = written(spark, regions(checked(nodes) if strict else nodes, canonical), "regions")
    candidates = number_candidates(filter_regions(found, filter_options), "doc_id", "start_idx")
    tags = plan_tags(candidates, () if across_documents else ("doc_id",))
    return Moves(documents, nodes, found, candidates, tags, output)


def debug_report(moves: Moves, most_buckets: int = 20, most_groups: int = 20, preview: int = 5) -> dict[str, DataFrame]:
    """The parts of the full debug report as tables."""
    from relomap.operators.groups import first_groups, registry_summary, top_buckets
    from relomap.operators.registry import counts, file_stats

    return {
        "registry": counts(moves.candidates),
        "summary": registry_summary(moves.counts),
        "files": file_stats(moves.candidates),
        "buckets": top_buckets(moves.counts, "canonical_text", most_buckets),
        "groups": first_groups(moves.groups, most_groups, preview),
        "matches": moves.matches,
        "unmatched": moves.unmatched,
    }


def write_outputs(moves: Moves, xml_path: str, json_path: str | None = None) -> None:
    """Write annotated documents, and summaries if asked for, as text tables: a folder with a row for each document."""
    moves.xml.write.mode("overwrite").parquet(xml_path)
    if json_path:
        moves.summaries.write.mode("overwrite").json(json_path)


def entries_with_files(moves: Moves) -> DataFrame:
    """Move entries with the sorted file names that their paths mention."""
    from relomap.functions.text import files_of_paths

    return moves.entries.withColumns({"from_files": files_of_paths(F.col("from_xpaths")), "to_files": files_of_paths(F.col("to_xpaths"))})
