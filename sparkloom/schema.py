"""Record types of the code graph and the grammar of its ids."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_KINDS = (
    "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component"
).split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()
CALLABLE = ("function", "method")

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODE = _struct(
    id=_S, kind=_S, name=_S, qualified_name=_S, file_path=_S, language=_S, start_line=_I, end_line=_I, start_column=_I, end_column=_I,
    docstring=_S, signature=_S, visibility=_S, return_type=_S, is_exported=_B, is_async=_B, is_static=_B, is_abstract=_B,
    decorators=T.ArrayType(_S), type_parameters=T.ArrayType(_S), updated_at=_L,
)
EDGE = _struct(source=_S, target=_S, kind=_S, metadata=T.MapType(_S, _S), line=_I, col=_I, provenance=_S)
REF = _struct(from_node_id=_S, reference_name=_S, reference_kind=_S, line=_I, col=_I, file_path=_S, language=_S, candidates=T.ArrayType(_S))
PROBLEM = _struct(message=_S, file_path=_S, line=_I, column=_I, severity=_S, code=_S)
FILE = _struct(path=_S, content_hash=_S, language=_S, size=_L, modified_at=_L, indexed_at=_L, node_count=_I, errors=T.ArrayType(PROBLEM))


def node_id(kind: str, path: str, name: str = "") -> str:
    """file:<path>, else <kind>:<path>::<name> with spaces replaced."""
    return f"file:{path}" if kind == "file" else f"{kind}:{path}::{name}".replace(" ", "_")
