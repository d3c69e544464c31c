"""Schemas of the evidence tables; nothing is inferred.  They are plain types, so that importing needs no session."""

from pyspark.sql import types as T

TEXT, LONG, INT, REAL, FLAG = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TEXT_MAP = T.MapType(TEXT, TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCORE = struct(value=REAL, numerator=REAL, denominator=LONG, reason=TEXT)

OBSERVATION = struct(
    condition=TEXT, component_id=TEXT, partition=TEXT, example_id=TEXT, group_id=TEXT, repetition=INT, status=TEXT, expected_metric_ids=T.ArrayType(TEXT), scores=T.MapType(TEXT, SCORE),
    elapsed_seconds=REAL, memory_observation_bytes=LONG, input_tokens=LONG, output_tokens=LONG, output_sha256=TEXT, prompt_sha256=TEXT, error_type=TEXT, parsed=TEXT, raw_output=TEXT,
)

RECORD_PLAN = struct(source_id=TEXT, group_key=TEXT, kind=TEXT, split=TEXT, ordinal=LONG)
MANIFEST = struct(path=TEXT, bytes=LONG, sha256=TEXT)
TASK = struct(ordinal=INT, id=TEXT, stage=TEXT, condition=TEXT, component_id=TEXT, control_position=TEXT)
METRIC = struct(metric=TEXT, role=TEXT, direction=TEXT)
RECORD = struct(id=TEXT, partition=TEXT, input=struct(text=TEXT), expected=TEXT, metadata=TEXT_MAP)
DATASET = struct(license=TEXT, revision=TEXT, partitions=T.MapType(TEXT, T.ArrayType(RECORD)))
SPAN_EVENT = struct(name=TEXT, timestamp=LONG, attributes=TEXT_MAP)
SPAN = struct(
    name=TEXT, trace_id=TEXT, span_id=TEXT, parent_span_id=TEXT, start_ns=LONG, end_ns=LONG, duration_ns=LONG, status=TEXT, attributes=TEXT_MAP, events=T.ArrayType(SPAN_EVENT)
)
COUNTER = struct(name=TEXT, points=T.ArrayType(struct(attributes=TEXT_MAP, value=LONG)))
TRACE = struct(trace_id=TEXT, complete=FLAG, dropped_spans=LONG, spans=T.ArrayType(SPAN), metrics=T.ArrayType(COUNTER))
