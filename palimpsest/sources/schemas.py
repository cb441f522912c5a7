"""Schemas of the stored entities."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TOOL_CALL = struct(index=I, id=S, name=S, arguments=S, result_summary=S, result_full=S, result_truncated=B)
SEGMENT = struct(type=S, text=S, toolCallIndex=I)
SUMMARY = struct(currentTask=S, progressMade=T.ArrayType(S), currentState=T.ArrayType(S), nextSteps=T.ArrayType(S), keyFindings=T.ArrayType(S))

#: A stored round; the table adds its key, round_file.
ROUND = struct(
    id=S, userPrompt=S, responseSequence=S, turnIndex=I, userTimestamp=L, toolCallCount=I, toolCallNames=T.ArrayType(S), toolCalls=T.ArrayType(TOOL_CALL),
    responseSegments=T.ArrayType(SEGMENT), promptEmbedding=T.ArrayType(D), parentId=S, relatedParentId=S, needsFollowup=B, recovered=B, summary=SUMMARY,
)

#: What parsing a log gives.
PARSED_ROUND = struct(
    session=S, error=S, id=S, userPrompt=S, responseSequence=S, turnIndex=I, userTimestamp=L, responseEndTimestamp=L, toolCallCount=I, toolCallNames=T.ArrayType(S),
    toolCalls=T.ArrayType(TOOL_CALL), responseSegments=T.ArrayType(SEGMENT), needsFollowup=B, source=S, cwd=S, gitBranch=S, sourceSession=S,
)

VECTOR_ROW = struct(round_file=S, suffix=S, model=S, input_hash=S, vector=T.ArrayType(D), shard=S, pos=L)
TOOL_ROW = struct(round_file=S, tool_index=I, tool_name=S, searchable=S)
STATS = struct(
    version=I, positionScores=T.ArrayType(struct(presentedCount=L, readCount=L, presentedHash=S)), lastUpdated=S, position5=struct(presentedCount=L, readCount=L)
)
