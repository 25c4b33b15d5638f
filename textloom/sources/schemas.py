"""Explicit schemas of every source; nothing is inferred."""

from pyspark.sql import types as T

S = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names])


#: The scenario file by position: the ninth header is empty, the tenth packs eleven names.
SCENARIOS = _struct("baseline", "c1", "hedged_baseline", "c2", "politeness_question", "left_of_slider", "right_of_slider", "predicate_question", "unnamed", "packed")
UTTERANCES = T.StructType([T.StructField("id", S), T.StructField("text", S), T.StructField("meta", T.MapType(S, S))])
DYNAMIC_UTTERANCES = T.StructType([T.StructField("id", S), T.StructField("text", S), T.StructField("meta", T.VariantType())])
PAGES = T.StructType([
    T.StructField("title", S), T.StructField("ns", S), T.StructField("id", S),
    T.StructField("revision", T.ArrayType(T.StructType([
        T.StructField("timestamp", S), T.StructField("contributor", _struct("username")),
        T.StructField("text", T.StructType([T.StructField("_VALUE", S), T.StructField("_bytes", S)])),
    ]))),
])
TALK_PAGES = _struct("page_id", "title", "timestamp", "last_editor", "text")
_PARTS = T.ArrayType(T.StructType([T.StructField("parts", T.ArrayType(_struct("text")))]))
REQUESTS = T.StructType([T.StructField("key", S), T.StructField("request", T.StructType([T.StructField("contents", _PARTS)]))])
RESPONSES = T.StructType([T.StructField("key", S), T.StructField("response", T.StructType([
    T.StructField("candidates", T.ArrayType(T.StructType([T.StructField("content", T.StructType([T.StructField("parts", T.ArrayType(_struct("text")))]))])))]))])
JOBS = _struct("job_name", "state", "src_file", "dest_file", "display_name")
RESPONSE_FIELDS = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in RESPONSES)
TALK_PAGE_FIELDS = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in TALK_PAGES)
