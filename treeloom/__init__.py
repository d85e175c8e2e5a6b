"""Nested documents into relational tables, on Spark."""

from treeloom.functions.policies import AddPolicy, AppendPolicy, ExtendPolicy, FirstNonNullPolicy, LastWritePolicy, MaxPolicy, MergePolicy, MinPolicy
from treeloom.functions.selectors import FieldSpec, field_of
from treeloom.functions.transforms import apply, coalesce, column_function, concat, format_id, get, get_from_parent, get_from_root, index, key, len_of, literal, lookup, node, parent_index, parent_key, transform
from treeloom.plans.graph import partition_components, topological_sort, weakly_connected_components
from treeloom.plans.links import RelationshipIncompleteError
from treeloom.plans.lowlevel import InstanceEmit, IterationLevel, ManyToOneSpec, MappingResult, MappingSpec, TableEmit, TraversalSpec, bind_many_to_one, run_mapping
from treeloom.plans.pipeline import PipelineBuilder, PipelineResult, TableStats, etl, stream
from treeloom.plans.schema import Target, target_of
from treeloom.plans.scope import Scope
from treeloom.plans.tables import Field, Root, TempField
from treeloom.sources.chunks import CallableChunkSource, Chunk, ChunkSource, ExternalPartitionChunkSource, GroupByChunkSource, OneRecordPerChunkSource, PreSegmentedChunkSource
from treeloom.sources.documents import consecutive_groups, from_json, from_objects, from_rows
from treeloom.sources.sinks import ClientSink, DbApiSink, JdbcSink, MemorySink, ParquetSink, Sink, TableSink
from treeloom.streaming.flush import BufferedKeyFlushStrategy, FlushContext, FlushStrategy, KeyCompleteFlushStrategy, UpsertFlushStrategy
from treeloom.telemetry import FlushCompleted, FlushFailed, FlushStarted, MapCompleted, MapStarted, TelemetryEvent

__all__ = [n for n in dir() if not n.startswith("_")]
